"""Corpus operators against brute force, on small tables with nulls, ties, repeated rows, long texts and clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from framespark.llm import common, decontaminate, exact_dedup, mixing, near_dedup, secret_scan, sharding, token_counts, token_files, toxicity, url_filter

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, shard int, block string, n int, row string"


def frame(spark, rows):
    """rows: (doc_id, text, source); the other columns have names that operators use inside."""
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), 1, 2, "x", 3, "y") for i, t, s in rows], SCHEMA)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    line = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage = line(40)
    texts = [None, "", " \t\n", "one", "one two", "One  TWO", "é ▁ <|endoftext|> x", "a" * 5000]
    for k in range(60):
        base = line(rng.choice([3, 8, 60, 150]))
        texts.append(base)
        if k % 3 == 0:
            texts.append(passage + " " + base)
        for _ in range(k % 4):  # near copies, and copies but for white space
            w = base.split(" ")
            if rng.random() < 0.5:
                w[rng.randrange(len(w))] = "changed"
            texts.append("  ".join(w))
    texts.append(line(20_000))
    out = [(i * 3 % 1000 + 1000 * (i // 333), t, [None, "s0", "s0", "s0", "b", "c"][i % 6]) for i, t in enumerate(texts)]
    return out + [out[9], out[9], (None, "null id " + passage, "b"), (None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return frame(spark, rows).repartition(5)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or ""))


def collect(df):
    return [tuple(r) for r in df.collect()]


# --- URL filter ---
def test_url_filter(spark):
    urls = [None, "", "no scheme", "http://Casino.COM/fr/1?a=1&utm_source=x#t", "https://a.example.org/es/2", "https://example.org/en/12", "http://org", "http://org/", "http://xorg/", "https://spam.net/x/", "http://SPAM.net:80/x?ref=1", "http://spam.net/y", "https://a.com/de/1", "http://a.com/de"]
    pages = spark.createDataFrame([(i, u, "k", 5) for i, u in enumerate(urls + urls[-5:] + [urls[9]] * 50)], "page_id long, url string, k string, w0 int")
    listed = spark.createDataFrame([("spam.net/x",), ("spam.net/x",), (None,)], "canonical string")
    got = {(r.page_id): r for r in url_filter.filter_urls(pages, listed).collect()}
    assert len(got) == pages.count()
    assert (got[3].host, got[3].path, got[3].rule, got[3].verdict) == ("casino.com", "/fr/1", "com/fr/", "allow")
    assert got[3].canonical == "casino.com/fr/1?a=1"
    assert [got[i].rule for i in (4, 5, 6, 7, 8, 12, 13)] == ["example.org/es/", "example.org/en/1", None, "org/", None, "com/de/", None]
    assert [got[i].verdict for i in (0, 1, 2, 9, 10, 11)] == ["allow", "allow", "allow", "block", "block", "allow"]
    assert [(got[i].host, got[i].path) for i in (0, 2)] == [("", ""), ("", "")]
    none = spark.createDataFrame([], "canonical string")
    assert {r.listed for r in url_filter.filter_urls(pages, none).collect()} == {False}
    assert url_filter.filter_urls(pages.limit(0), listed).count() == 0
    same = lambda df: sorted(map(str, collect(df)))
    assert same(url_filter.filter_urls(pages, listed, hot_rows=20)) == same(url_filter.filter_urls(pages, listed))
    assert same(url_filter.filter_urls(pages, listed, max_blocks=1)) == same(url_filter.filter_urls(pages, listed))
    long = spark.createDataFrame([(1, "http://a.net/" + "/" * 2_000_000 + "x"), (2, "http://a.net" + "/" * 2_000_000)], "page_id long, url string")
    assert [len(r.canonical) for r in url_filter.filter_urls(long, listed).orderBy("page_id").collect()] == [2_000_007, 5]


def test_hosts_with_thin_pages_are_listed_whole(spark):
    long = "long" * 1000
    rows = [("http://a.net/x", "short"), ("https://A.net/y", long), ("http://a.net:80/y/?utm_source=y", long), ("http://b.net/x", long), ("http://b.net/y", None), ("http://c.net/1", "short")] + [("http://c.net/2", long)] * 9 + [("none", "short"), (None, None)]
    pages = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(rows)], "page_id long, url string, html string")
    got = {r.page_id: (r.listed, r.verdict) for r in url_filter.filter_urls(pages, url_filter.listed_of_thin_hosts(pages)).collect()}
    # a.net has 1 of 3, c.net 1 of 10, all pages 2 of 15: pages 1 and 2 aren't thin themselves
    assert {i for i, (listed, _) in got.items() if listed} == {0, 1, 2}
    assert all(verdict == ("block" if listed else "allow") for listed, verdict in got.values())
    assert url_filter.listed_of_thin_hosts(pages.limit(0)).count() == 0


def test_bloom_has_no_false_negatives(spark):
    keys = spark.range(3000).select(F.concat(F.lit("k"), "id").alias("k"))
    blocks = common.block_count(3000, 1 << 16)
    bloom = common.bloom_table(keys, "k", blocks)
    probe = spark.range(6000).select(F.concat(F.lit("k"), "id").alias("k"), (F.col("id") < 3000).alias("there"))
    hit = probe.withColumn("block", common.bloom_block(F.col("k"), blocks)).join(bloom, "block", "left").withColumn("hit", common.bloom_hit(F.col("k")))
    counts = {(r.there, r.hit): r["count"] for r in hit.groupBy("there", "hit").count().collect()}
    assert counts[True, True] == 3000 and counts.get((False, True), 0) < 120


# --- mixing ---
def test_mixing(spark, docs, rows):
    mixed = lambda d: collect(mixing.mix(d, block_words=32).select("doc_id", "source", "size", "source_size", "target", "taken", F.size("slots").alias("copies")))
    got = mixed(docs)
    assert sorted(map(str, got)) == sorted(map(str, mixed(docs.repartition(3))))
    assert len(got) == len(rows)
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(words(t))
    order = sorted([s for s in sizes if s is not None]) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, target = 1.5 * sum(sizes.values()), {}
    while True:  # the excess is reshared by weight until none is above
        free = [s for s in order if s not in target]
        rest = total - sum(target.values())
        over = [s for s in free if rest * weight[s] / sum(weight[x] for x in free) > 2 * sizes[s]]
        if not over:
            target |= {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
            break
        target |= {s: 2.0 * sizes[s] for s in over}
    taken = Counter()
    for _, s, size, source_size, t, k, copies in got:
        assert source_size == sizes[s] and abs(t - target[s]) < 1e-6 and 0 <= k <= 2 * size and copies <= 2
        taken[s] += k
    assert all(taken[s] == int(target[s] + 1e-9) for s in order)
    slots = mixing.schedule(mixing.source_targets(docs.groupBy("source").agg(F.sum(mixing.word_count(F.col("text"))).alias("source_size"))), 32).collect()
    assert len({r.slot for r in slots}) == len(slots) and len({(r.source, r.use) for r in slots}) == len(slots)
    for n in (50, 200, len(slots)):  # any beginning of the schedule is mixed in proportion
        share = Counter(r.source for r in slots if r.slot < n)
        assert all(abs(share[s] / n - target[s] / total) < 0.12 for s in order)
    assert mixing.mix(docs.limit(0)).count() == 0
    assert mixing.mix(docs.limit(0), keep=True).count() == 0


def test_mixing_order_is_the_schedule(spark, docs, rows, monkeypatch):
    """Slots by brute force from the golden-ratio points; other points give another order and the same words of each source."""
    got = mixing.mix(docs, block_words=32).collect()
    whole = {r.source: (int(r.target), r.source_size) for r in got}
    need = {s: t // n * -(-n // 32) + -(-(t % n) // 32) if n else 0 for s, (t, n) in whole.items()}
    order = sorted((s for s in need if s is not None and need[s])) + [None] * bool(need.get(None))
    total, upto, edges = sum(need.values()), 0, []
    for s in order:
        edges.append((round(upto / total * mixing.POINTS), round((upto + need[s]) / total * mixing.POINTS), s))
        upto += need[s]
    uses, taken, spare = Counter(), {}, []
    for slot in range(total):
        point = slot * mixing.GOLDEN % mixing.POINTS
        source = next(s for lo, hi, s in edges if lo <= point < hi)
        if uses[source] < need[source]:
            taken[source, uses[source]] = slot
            uses[source] += 1
        else:
            spare.append(slot)
    for s in order:
        for use in range(uses[s], need[s]):
            taken[s, use] = spare.pop(0)
    for r in got:
        per, want = -(-r.source_size // 32) if r.source_size else 0, []
        for epoch in range(2):
            block = r.start // 32
            words = min(32, r.source_size - block * 32, whole[r.source][0] - epoch * r.source_size - block * 32)
            if r.size and words > r.start % 32:
                want.append(taken[r.source, epoch * per + block])
        assert r.slots == sorted(want)
    kept = mixing.mix(docs, block_words=32, keep=True)
    assert kept.columns == docs.columns
    place = sorted((slot, r.at, str(r.doc_id), r.size) for r in got for slot in r.slots)
    assert [p[2] for p in place] == [str(r.doc_id) for r in kept.collect()]
    monkeypatch.setattr(mixing, "GOLDEN", 1_000_000_007)
    other = mixing.mix(docs, block_words=32).collect()
    sums = lambda rs: {s: sum(r.taken for r in rs if r.source == s) for s in whole}
    assert sums(other) == sums(got) and sorted(map(str, (r.slots for r in other))) != sorted(map(str, (r.slots for r in got)))


def test_mixing_without_ids(spark):
    """A third of the rows without an id and a third with one id: their buckets are split."""
    docs = frame(spark, [([None, 5, i][i % 3], f"w{i} a b", "s") for i in range(3000)])
    sized = docs.select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("tie"), F.lit(0).alias("nth"))
    spans = sorted(r.start for r in mixing.shuffled_spans(sized, 3000, bucket_rows=20).collect())
    assert spans == list(range(0, 9000, 3))


# --- secrets ---
def base_by_rule(text):
    out = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A):
        if len(m[2]) >= 8:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(out)


def test_secret_scan(spark):
    rng = random.Random(2)
    bits = ["token", " = ", '"', "PassWord", ":", "secret", "AKIA", "A1B2C3D4E5F6", "0123456789abcdef" * 2, " ", "api_key", "apikey=", "short", "longervalue123", "é", "'", "\n", "x9/+_.=-", "ToKen ſecret"]
    drawn = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(24))
    names = lambda: "".join(rng.choice(["user", "name", "get", "data", "value", "index"]) for _ in range(4))
    labelled = frame(spark, [(i, f"token = {drawn()} {names()} {names()}", "s") for i in range(400)])
    texts = [None, "", *["".join(rng.choice(bits) for _ in range(rng.randint(1, 14))) for _ in range(600)], "getUserName internationalization snake_case_name " * 5 + " xK9q27Lm4Zt8Wp3Rv6Yb1 " + "token = " + "9f" * 20]
    docs = frame(spark, [(i, t, "s") for i, t in enumerate(texts)])
    ratio = secret_scan.train(labelled)
    got = {r.doc_id: r for r in secret_scan.scan_secrets(docs, ratio).collect()}
    kinds = ("assign", "access", "hex", "markov")
    for i, t in enumerate(texts):
        base = base_by_rule(t or "")
        assert base == secret_scan.base_spans(t or "")
        assert got[i].base_sha256 == hashlib.sha256(",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in base).encode()).hexdigest()
        assert (got[i].n_assign, got[i].n_access, got[i].n_hex) == tuple(sum(x[1] == k for x in base) for k in range(3))
        spans = [x.split(":") for x in got[i].spans.split(",") if x]
        assert {(kinds[k], str(a), str(b)) for a, k, b in base} <= {tuple(x) for x in spans}
        assert [(int(a), kinds.index(k)) for k, a, _ in spans] == sorted((int(a), kinds.index(k)) for k, a, _ in spans)
        assert [x for x in spans if x[0] == "markov"] == [["markov", str(a), str(b)] for a, b in markov_by_rule(t or "", ratio, base)]
    assert got[len(texts) - 1].n_markov == 1
    assert secret_scan.scan_secrets(docs.limit(0), secret_scan.train(docs.limit(0))).count() == 0


def markov_by_rule(text, ratio, taken):
    """Runs and parts one by one, scored pair by pair, against every span."""
    out, place = [], {c: i for i, c in enumerate(secret_scan.ALPHABET)}
    for pattern, least in (("[A-Za-z0-9+/_=-]+", 16), ("[A-Za-z0-9]+", 8)):
        found = []
        for m in re.finditer(pattern, text):
            codes = [secret_scan.START, *(place[c] for c in m[0])]
            mean = sum(ratio[a * (secret_scan.START + 1) + b] for a, b in zip(codes, codes[1:], strict=False)) / len(m[0])
            free = not any(a < m.end() and m.start() < b for a, b in [(s[0], s[2]) for s in taken] + out)
            if len(m[0]) >= least and free and mean >= 1.5 + 0.2 * max(0, 16 - len(m[0])) - 1e-12:
                found.append(m.span())
        out += found
    return sorted(out)


def test_secrets_in_a_long_text():
    """5 MB with 100,000 spans and as many candidates."""
    ratio = secret_scan.fit([])
    text = "token = abcdefgh12 plain words_of-text/here and more0 " * 100_000
    spans = secret_scan.base_spans(text)
    assert len(spans) == 100_000 and secret_scan.markov_spans(text, ratio + 5, 1.5, spans)[:2] == [(25, 3, 43), (79, 3, 97)]
    assert len(secret_scan.samples(text)[0]) == 100_000


def test_secret_models_tell_random_from_ordinary():
    rng = random.Random(1)
    hexes = ["".join(rng.choice("0123456789abcdef") for _ in range(32)) for _ in range(300)]
    names = ["".join(rng.choice(["user", "name", "get", "data", "value", "index"]) for _ in range(4)) for _ in range(300)]
    counts = Counter()
    for label, some in ((1, hexes[:200]), (0, names[:200])):
        for w in some:
            counts.update((label, int(p)) for p in secret_scan.pairs(w))
    ratio = secret_scan.fit([(a, b, n) for (a, b), n in counts.items()])
    right = [ratio[secret_scan.pairs(w)].mean() > 0 for w in hexes[200:]] + [ratio[secret_scan.pairs(w)].mean() < 0 for w in names[200:]]
    assert sum(right) >= 198


# --- toxicity ---
def test_toxicity_learns_words_and_pairs(spark):
    rng = random.Random(3)
    filler = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(60)]
    rows, labels = [], []
    for i in range(3000):
        bag, insult, group = rng.sample(filler, 12), rng.random() < 0.4, rng.random() < 0.4
        bag += ["wretch"] * insult + ["outlander"] * group
        rng.shuffle(bag)
        rows.append((i, " ".join(bag), "s"))
        labels.append((i, int(insult and group)))  # an interaction that no sum of weights over two words needs to get right
    rows += [(9000, None, None), (9001, "", None)]
    docs, marks = frame(spark, rows), spark.createDataFrame(labels + [labels[0], (None, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.train(docs, marks, fold=~toxicity.held_out())
    got = {r.doc_id: r for r in toxicity.score_toxicity(docs, model).collect()}
    held = [i for i in range(3000) if zlib.crc32(str(i).encode()) % 4 == 2]
    truth = dict(labels)
    assert sum((got[i].score >= 0.5) == bool(truth[i]) for i in held) > 0.97 * len(held)
    assert got[9000].score == got[9001].score and 0 <= got[9000].score <= 1
    assert all(r.predicted == int(r.score >= 0.3) for r in got.values())
    kept = toxicity.score_toxicity(docs, model, keep=True)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if not r.predicted}
    # the machine's score, from every pair of terms
    place = {int(t): i for i, t in enumerate(model["terms"])}
    for i, text, _ in rows[:40] + rows[-2:]:
        words_ = {w for w in re.findall(r"[^\W\d_]+", (text or "").lower())}
        at = sorted({place[t] for w in words_ for t in [zlib.crc32(w.encode()) % toxicity.BUCKETS, *(zlib.crc32(w[:n].encode(), n) % toxicity.BUCKETS for n in (3, 4, 5, 6) if len(w) >= n)] if t in place})
        z = model["bias"] + sum(model["w"][a] for a in at) + sum(float(model["v"][a] @ model["v"][b]) for a in at for b in at if a < b)
        assert abs(got[i].score - 1 / (1 + np.exp(-z))) < 1e-9
    again = toxicity.train(docs.unionByName(docs), marks, fold=~toxicity.held_out())
    assert (again["terms"] == model["terms"]).all() and np.allclose(again["v"], model["v"])
    assert toxicity.score_toxicity(docs.limit(0), model).count() == 0
    empty = toxicity.train(docs, marks.limit(0))
    assert toxicity.score_toxicity(docs.limit(3), empty).count() == 3


# --- tokens ---
def odd_texts(n=3000):
    rng = random.Random(3)
    bits = ["a", "b", " ", "  ", "\n", "\x1c", "é", "<|endoftext|>", "<s>", ".", "\t", " foo", "　", "'s", "\x00", "\xa0", "\xad", "中", " 12", "\x85", "▁", "the"]
    return ["".join(rng.choice(bits) for _ in range(rng.randint(0, 14))) for _ in range(n)]


def test_token_counts(spark, docs, rows):
    model = token_counts.load_pieces(token_counts.model_path(token_counts.MODEL))
    for text in odd_texts():
        assert sum(len(model.encode(w)) if w else 1 for w in token_counts.pretokens(text)) == len(model.encode(text)), repr(text)
    got = sorted(map(str, collect(token_counts.count_tokens(docs, token_counts.model_path(token_counts.MODEL)))))
    want = sorted(str((i, len((t or "").encode()), n := len(model.encode(t or "")), n > 4096)) for i, t, _ in rows)
    assert got == want
    for few in (0, 50):  # pre-tokens by the broadcast part of the table
        assert sorted(map(str, collect(token_counts.count_tokens(docs, token_counts.model_path(token_counts.MODEL), frequent=few, sample=40)))) == want
    assert token_counts.count_tokens(docs.limit(0), token_counts.model_path(token_counts.MODEL)).count() == 0
    some = odd_texts(400) + ["long" * 500_000, "two words " * 200_000]
    got = token_counts.count_tokens(frame(spark, [(i, t, None) for i, t in enumerate(some)]), token_counts.model_path(token_counts.MODEL), frequent=20)
    assert {r.doc_id: r.n_tokens for r in got.collect()} == {i: len(model.encode(t)) for i, t in enumerate(some)}


def test_long_pretokens_of_many_texts_are_broadcast(spark):
    """A line without spaces in most texts, one in few and one that passes the bound of bytes."""
    path = token_counts.model_path(token_counts.MODEL)
    often, seldom, large = "\u8a9e" * 300, "x/" * 300, "y=" * 40_000
    texts = [f"{often} word {i}" + f" {seldom}" * (i < 9) + f" {large}" * (i < 40) for i in range(90)]
    some = spark.createDataFrame([(t,) for t in texts], "text string")
    kept = token_counts.frequent_pieces(some, path, long_bytes=10_000)
    assert often in kept and "word" in kept and seldom not in kept and large not in kept
    assert large in token_counts.frequent_pieces(some, path)
    model = token_counts.load_pieces(path)
    got = token_counts.count_tokens(frame(spark, [(i, t, None) for i, t in enumerate(texts)]), path)
    assert {r.doc_id: r.n_tokens for r in got.collect()} == {i: len(model.encode(t)) for i, t in enumerate(texts)}


def test_token_files(spark, docs, rows, tmp_path):
    from tokenizers import Tokenizer

    path = token_counts.model_path(token_files.MODEL)
    library = Tokenizer.from_file(path)
    encode = lambda t: library.encode(t, add_special_tokens=False).ids
    texts = odd_texts()
    assert [x.tolist() for x in token_files.Encoder(path).encode(texts)] == [encode(t) for t in texts]
    out = str(tmp_path / "tokens")
    token_files.write_token_files(docs, out, path, shard_ids=4000)
    got = token_files.read_token_files(spark, out, with_ids=True).orderBy("start").collect()
    assert token_files.token_files(spark, out).count() > 4
    want = sorted(((i, t or "") for i, t, _ in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    start = 0
    for r, (i, t) in zip(got, want, strict=True):
        ids = np.array([*encode(t), 0], "<u4")
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32, bytes(r.ids)) == (i, start, len(ids), zlib.crc32(ids.tobytes()), ids.tobytes())
        start += len(ids)
    some = next(r for r in got if r.n_tokens > 100 and sum(x.doc_id == r.doc_id for x in got) == 1)
    assert [r.ids for r in token_files.read_stretch(spark, out, some.doc_id, 20, 30).collect()] == [np.frombuffer(some.ids, "<u4")[20:50].tolist()]
    empty = str(tmp_path / "empty")
    token_files.write_token_files(docs.limit(0), empty, path)
    assert token_files.read_token_files(spark, empty).count() == 0


def test_token_files_of_repeated_ids_and_a_long_text(spark, tmp_path):
    """Rows that share an id, or have none, spread over ranges; a text of 2 MB is a shard of its own."""
    from tokenizers import Tokenizer

    path = token_counts.model_path(token_files.MODEL)
    library, out = Tokenizer.from_file(path), str(tmp_path / "tokens")
    rows = [(7, f"text {i % 3}", None) for i in range(300)] + [(None, f"none {i}", None) for i in range(100)] + [(9, "long words " * 200_000, None)]
    token_files.write_token_files(frame(spark, rows), out, path, shard_ids=300, part_bytes=1 << 18)
    got = token_files.read_token_files(spark, out).orderBy("start").collect()
    assert [r.start for r in got] == [sum(x.n_tokens for x in got[:i]) for i in range(len(got))] and [r.doc_id for r in got] == [None] * 100 + [7] * 300 + [9]
    crc = lambda t: zlib.crc32(np.array([*library.encode(t, add_special_tokens=False).ids, 0], "<u4").tobytes())
    assert Counter(r.ids_crc32 for r in got) == Counter(crc(t) for _, t, _ in rows)
    assert len({r.part for r in token_files.token_files(spark, out).collect()}) > 2


def test_words_that_are_known_are_not_matched_again(monkeypatch):
    path, tried = token_counts.model_path(token_files.MODEL), []
    opens = token_files.OPENS
    monkeypatch.setattr(token_files, "OPENS", type("Counted", (), {"match": staticmethod(lambda w: tried.append(w) or opens.match(w))}))
    plain = ["one two,\nthree two...", " begins\nÉté words", "\nbreak first", "", "word"]
    odd = [" ", "　wide first", "a 　b", "two  spaces", "ends ", "ends\n", "a\n\nb", "a \nb", "a\n b", "\n", "\n\n", "tab \tx", "a\n\u200bb c", "</s> x <|endoftext|> y"]
    encoder = token_files.Encoder(path)
    for texts in (plain, odd, plain + odd, odd + plain):
        assert [x.tolist() for x in encoder.encode(texts)] == [e.ids for e in encoder.library.encode_batch(texts, add_special_tokens=False)]
    assert tried
    tried.clear()
    encoder.encode(plain)
    assert not tried


def test_distinct_words_are_looked_up_once_and_letters_are_encoded_in_runs():
    path, asked, by_pattern = token_counts.model_path(token_files.MODEL), [], []
    encoder = token_files.Encoder(path)
    encoder.words = type("Counted", (dict,), {"get": lambda self, w: asked.append(w) or dict.get(self, w)})()
    plain = encoder.plain
    encoder.plain = lambda texts, by=None: by_pattern.extend(texts if by is None else []) or plain(texts, by)
    texts = ["one two Éà où... nº ª\nthree"] * 50 + ["three\nÉà one", "", "à"]
    assert [x.tolist() for x in encoder.encode(texts)] == [e.ids for e in encoder.library.encode_batch(texts, add_special_tokens=False)]
    assert len(asked) == len(set(asked)) and sorted(by_pattern) == ["", "..."]
    rng = random.Random(6)
    for _ in range(300):
        some = ["".join(rng.choice(["the", "à", "º", "ĳ", "ɐ", "ж", "'s", "...", "7", " ", " ", " ", "\n", "\xa0", "\t", "　", "\u0301", "Ġ", "Ċ", "Â"]) for _ in range(rng.randrange(9))) for _ in range(20)]
        assert [x.tolist() for x in encoder.encode(some)] == [e.ids for e in encoder.library.encode_batch(some, add_special_tokens=False)]
    assert encoder.encode([]) == []
    batch = pa.RecordBatch.from_pydict({"k": [1, 2, 3, 4], "t": ["a" * 9, "", "b" * 30, "c"]})
    assert [k for k, _ in token_files.at_once(iter([batch, batch]), 12)] == [[1, 2], [3], [4, 1, 2], [3], [4]]


def test_frequent_pairs_of_few_and_of_many_bits():
    rng = np.random.default_rng(5)
    for bits in (8, 34, 63):
        pairs = rng.choice(np.append(rng.integers(0, 1 << bits, 40), -1), 900)
        want = {p: n for p, n in sorted(Counter(pairs.tolist()).items()) if p >= 0 and n >= 20}
        some, counts, held, found = token_files.frequent(pairs, bits, 20)
        assert dict(zip(some.tolist(), counts.tolist(), strict=True)) == want
        assert held.tolist() == [i for i, p in enumerate(pairs.tolist()) if p in want] and (some[found] == pairs[held]).all()
    assert [len(x) for x in token_files.frequent(np.zeros(0, np.int64), 34, 8)] == [0] * 4


def test_repair_goes_on_until_no_pair_is_frequent():
    rng = np.random.default_rng(2)
    for ids in (np.full(100_000, 5), rng.integers(0, 3, 5000), np.tile(rng.integers(0, 9, 40), 300), np.zeros(0, int), np.array([1])):
        symbols, at, left, right, sizes = token_files.compress(ids.astype("<u4"), np.zeros(1, np.int64), 10)
        assert (token_files.expand(symbols, left, right, 10) == ids).all()
        assert max(Counter(zip(symbols[::2].tolist(), symbols[1::2].tolist(), strict=False)).values(), default=0) < token_files.MIN_COUNT
        pairs = Counter(zip(symbols.tolist(), symbols[1:].tolist(), strict=False))
        assert all(n < token_files.MIN_COUNT for (a, b), n in pairs.items() if a != b)
    symbols, _, left, *_ = token_files.compress(np.full(100_000, 5, "<u4"), np.zeros(1, np.int64), 10)
    assert len(symbols) + 2 * len(left) < 60


def test_repair_round_trip_and_random_access():
    rng = np.random.default_rng(1)
    lengths = rng.integers(1, 400, 60)
    phrase = rng.integers(0, 50, 30)
    docs = [np.concatenate([phrase if rng.random() < 0.5 else rng.integers(0, 50, 30) for _ in range(20)])[:n].astype("<u4") for n in lengths]
    ids, starts = np.concatenate(docs), np.cumsum(lengths) - lengths
    symbols, at, left, right, sizes = token_files.compress(ids, starts, 50)
    assert len(symbols) < 0.6 * len(ids) and len(left) == len(sizes)
    assert (token_files.expand(symbols, left, right, 50) == ids).all()
    ends = np.append(at[1:], len(symbols))
    for d, a, b in zip(docs, at, ends, strict=True):
        assert (token_files.expand(symbols[a:b], left, right, 50) == d).all()
        for _ in range(5):
            start = int(rng.integers(0, len(d)))
            n = int(rng.integers(1, 50))
            assert (token_files.stretch(symbols[a:b], left, right, sizes, 50, start, n) == d[start : start + n]).all()


# --- exact dedup ---
def test_exact_dedup(docs, rows):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    groups = defaultdict(list)
    for i, t, _ in rows:
        groups[norm(t)].append((-len(t or ""), i is None, i or 0, i))
    want = []
    for n, g in groups.items():
        g.sort(key=lambda r: r[:3])
        want += [(r[3], g[0][3], len(g), k == 0, hashlib.sha256(n.encode()).hexdigest()) for k, r in enumerate(g)]
    assert sorted(map(str, collect(exact_dedup.dedup(docs)))) == sorted(map(str, want))
    for more in ({"memtable_rows": 7, "fanout": 3}, {"memtable_rows": 20, "fanout": 2, "max_blocks": 1, "salts": 1}):
        assert sorted(map(str, collect(exact_dedup.dedup(docs, **more)))) == sorted(map(str, want))
    assert exact_dedup.dedup(docs.limit(0)).count() == 0


def test_index_of_digests(spark):
    """Memtables hold no more rows than they may, runs are sorted, levels end with one run, and lookups find what is there."""
    texts = [f"text {i % 150}" for i in range(400)]
    rows = spark.createDataFrame([(i, False, len(t), hashlib.sha256(t.encode()).digest(), i) for i, t in enumerate(texts)], "doc_id long, doc_null boolean, n_chars int, digest binary, row long")
    filled = Counter(r.run for r in exact_dedup.fill_memtables(rows, 30).collect())
    assert set(filled) == set(range(14)) and max(filled.values()) == 30
    runs = exact_dedup.flush_runs(rows, 30)
    assert runs.count() == 400 and runs.agg(F.max("run")).first()[0] == 13
    for max_blocks in (1, 1 << 16):
        index = exact_dedup.compact(exact_dedup.flush_runs(rows, 30), 3, max_blocks)
        got = {bytes(r.digest): (r.best.doc_id, r.n, r.run) for r in index.collect()}
        assert got == {hashlib.sha256(f"text {k}".encode()).digest(): (k, 3 if k < 100 else 2, 0) for k in range(150)}
    keys = [hashlib.sha256(t).digest() for t in (b"text 3", b"text 149", b"absent")]
    assert sorted((r.best.doc_id, r.n) for r in exact_dedup.lookup(index, keys).collect()) == [(3, 3), (149, 2)]
    texts = spark.createDataFrame([(b"a", "x"), (b"a", "x"), (b"b", "x"), (b"b", "y")], "digest binary, norm string")
    assert [bytes(r.digest) for r in exact_dedup.unequal_bytes(texts).collect()] == [b"b"]


# --- sharding ---
def test_sharding(spark, docs, rows, tmp_path):
    got = sharding.reshard_documents(docs, str(tmp_path / "a")).collect()
    assert sorted(map(str, ((r.doc_id, r.size, r.text_crc32) for r in got))) == sorted(map(str, ((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _ in rows)))
    total, largest = sum(r.size for r in got), max(r.size for r in got)
    bytes_, slots = Counter(), defaultdict(list)
    for r in got:
        bytes_[r.shard] += r.size
        slots[r.shard].append(r.slot)
        assert r.law == "bytes" and r.grown_shard is None
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(abs(bytes_[j] - total / 8) <= largest for j in range(8))
    # the new shards are complete: the manifest's files hold every row once, and files of groups that stay aren't written
    manifest = spark.read.parquet(str(tmp_path / "a.manifest")).collect()
    held = [(r.shard, *row) for r in manifest for row in spark.read.parquet(r.file).select("doc_id", "text").collect()]
    assert sorted(map(str, ((j, i, zlib.crc32((t or "").encode())) for j, i, t in held))) == sorted(str((r.shard, r.doc_id, r.text_crc32)) for r in got)
    assert sum(r.moved for r in got) > 0
    assert sharding.reshard_documents(docs.limit(0), str(tmp_path / "b")).count() == 0


def test_sharding_even_and_least_moved(spark, tmp_path):
    rng = random.Random(1)
    docs = frame(spark, [(i, "x" * rng.randint(0, 300), "s") for i in range(4000)])
    got = sharding.reshard_documents(docs, str(tmp_path / "a")).collect()
    total = sum(r.size for r in got)
    by = Counter()
    old = Counter()
    for r in got:
        by[r.shard] += r.size
        old[zlib.crc32(str(r.doc_id).encode()) % 6] += r.size
    assert max(by.values()) - min(by.values()) < 0.001 * total
    least = sum(max(0, old[i] - total / 8) for i in range(6))
    assert sum(r.size for r in got if r.moved) < 1.01 * least + 300


def test_sharding_of_null_and_repeated_ids(spark, tmp_path):
    docs = frame(spark, [([None, 7, i][i % 3], "x" * (i % 50), "s") for i in range(6000)]).repartition(6)
    got = sharding.reshard_documents(docs, str(tmp_path / "a")).collect()
    by = Counter()
    for r in got:
        by[r.shard] += r.size
    assert max(by.values()) - min(by.values()) < 0.01 * sum(by.values())
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert len(got) == 6000 and all(sorted(s) == list(range(len(s))) for s in slots.values())
    manifest = spark.read.parquet(str(tmp_path / "a.manifest")).collect()
    assert any(not r.rewritten for r in manifest) and any(r.rewritten for r in manifest)


def test_sharding_to_fewer_shards(spark, tmp_path):
    docs = frame(spark, [(i, "x" * (i % 90), "s") for i in range(3000)])
    got = sharding.reshard_documents(docs, str(tmp_path / "a"), 6, 4).collect()
    by = Counter()
    for r in got:
        by[r.shard] += r.size
    assert set(by) == set(range(4)) and max(by.values()) - min(by.values()) < 0.01 * sum(by.values())


def test_min_cost_flow_matches_enumeration():
    rng = random.Random(5)
    for _ in range(60):
        supply, capacity = [rng.randint(0, 3) for _ in range(3)], [rng.randint(1, 4) for _ in range(3)]
        if sum(supply) > sum(capacity):
            continue
        cost = [[rng.randint(0, 4) for _ in range(3)] for _ in range(3)]
        flow = sharding.min_cost_flow(supply, capacity, cost)
        assert [sum(r) for r in flow] == supply and all(sum(c) <= m for c, m in zip(zip(*flow, strict=True), capacity, strict=True))
        units = [i for i in range(3) for _ in range(supply[i])]

        def best(k, room):
            if k == len(units):
                return 0
            return min((cost[units[k]][j] + best(k + 1, [r - (x == j) for x, r in enumerate(room)]) for j in range(3) if room[j]), default=99)

        assert sum(flow[i][j] * cost[i][j] for i in range(3) for j in range(3)) == best(0, capacity)


# --- near duplicates ---
def test_a_thousand_shards_are_planned_in_bulk():
    """1,000 shards of uneven sizes to 1,200 of even ones: no more bytes leave their shard than must, and blocks follow the flow."""
    rng = random.Random(7)
    supply = [rng.randint(10**9, 10**10) for _ in range(1000)]
    total = sum(supply)
    capacity = [total * (j + 1) // 1200 - total * j // 1200 for j in range(1200)]
    flow = sharding.min_cost_flow(supply, capacity, [[int(i != j) for j in range(1200)] for i in range(1000)])
    assert [sum(r) for r in flow] == supply and [sum(c) for c in zip(*flow, strict=True)] == capacity
    assert sum(flow[i][i] for i in range(1000)) == sum(map(min, supply, capacity))
    sizes = {(i, g, b): s // 256 for i, s in enumerate(supply) for g in range(16) for b in range(16)}
    to, held = sharding.place_blocks(sizes, flow), Counter()
    for block, new in to.items():
        held[new] += sizes[block]
    assert to.keys() == sizes.keys() and max(abs(held[j] - capacity[j]) for j in range(1200)) < 0.02 * total / 1200


def shingle_set(text, k):
    w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in words(text)]
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute_components(rows, k):
    sets = [(i, shingle_set(t, k)) for i, t, _ in rows]
    parent = {i: i for i, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x, (i, a) in enumerate(sets):
        for j, b in sets[:x]:
            if i is not None and j is not None and a and b and 100 * len(a & b) >= 80 * len(a | b):
                p, q = sorted((root(i), root(j)))
                parent[q] = p
    return [(i, len(s), None if i is None else root(i), i is None or root(i) == i) for i, s in sets]


@pytest.mark.parametrize("k", [4, 5])
def test_near_duplicates(docs, rows, k):
    assert sorted(map(str, collect(near_dedup.near_duplicates(docs, k)))) == sorted(map(str, brute_components(rows, k)))


def test_near_duplicates_on_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text, None) for r in docs.collect()]
    assert sorted(collect(near_dedup.near_duplicates(docs, 4))) == sorted(brute_components(rows, 4))
    assert near_dedup.near_duplicates(docs.limit(0)).count() == 0


def test_near_duplicates_in_split_buckets(spark):
    """A family of near copies larger than a bucket's part, one passage that many share, and pairs inside that crowd."""
    rng = random.Random(8)
    line = lambda n: ["".join(rng.choice("abcdefghijklm") for _ in range(5)) for _ in range(n)]
    base, passage, rows = line(120), line(60), []
    for i in range(150):
        w = list(base)
        w[rng.randrange(120)] = f"w{i}"
        rows.append((i, " ".join(w), None))
    for i in range(200, 400, 2):
        own = line(40)
        rows += [(i, " ".join(passage + own), None), (i + 1, " ".join(passage + own[:-1] + ["z"]), None)]
    got = collect(near_dedup.near_duplicates(frame(spark, rows), 4, part=10))
    assert sorted(got) == sorted(brute_components(rows, 4))


def dense_components(texts, k):
    """The least row reachable of each text, from the common shingles of all pairs."""
    sets, known = [shingle_set(t, k) for t in texts], {}
    held = np.zeros((len(sets), len(set().union(*sets))), np.float32)
    for i, s in enumerate(sets):
        held[i, [known.setdefault(x, len(known)) for x in s]] = 1
    common, size = held @ held.T, held.sum(1)
    linked = 100 * common >= 80 * (size[:, None] + size[None] - common)
    least = np.arange(len(sets))
    while True:
        new = np.where(linked, least[None], len(sets)).min(1)
        if (new == least).all():
            return least.tolist()
        least = new


def test_near_duplicates_in_a_dense_family(spark):
    """3,000 near copies of one text, with links and components of all sizes among them."""
    rng = random.Random(1)
    base, texts = [f"w{rng.randrange(10**6)}" for _ in range(80)], []
    for _ in range(3000):
        w = list(base)
        for _ in range(rng.randint(1, 6)):
            w[rng.randrange(80)] = f"x{rng.randrange(3)}"
        texts.append(" ".join(w))
    want = dense_components(texts, 4)
    assert 1000 < len(set(want)) < 2000
    got = near_dedup.near_duplicates(frame(spark, [(i, t, None) for i, t in enumerate(texts)]).repartition(8), 4)
    assert {r.doc_id: r.component_id for r in got.collect()} == dict(enumerate(want))


def test_digests_tell_sets_apart():
    sets = [np.array(x, np.uint64) for x in ([], [1], [2], [1, 2], [3], [1, 2])]
    halves = list(zip(*near_dedup.set_digests(sets), strict=True))
    assert len(set(halves)) == 5 and halves[3] == halves[5]


def test_near_duplicates_in_a_template_crowd(spark):
    """Pairs at 0.82 inside a crowd that shares a template and whose other pairs are at 0.78, once in one block and once in several."""
    ids = random.Random(4).sample(range(10_000), 1000)
    template = [f"t{j}" for j in range(79)]
    rows = [(d, " ".join(template + [f"p{i // 2}x", f"p{i // 2}y"] + [f"d{i}v{j}" for j in range(9)]), None) for i, d in enumerate(ids)]
    want = sorted((d, 90, min(ids[i - i % 2], ids[i - i % 2 + 1]), d == min(ids[i - i % 2], ids[i - i % 2 + 1])) for i, d in enumerate(ids))
    assert sorted(collect(near_dedup.near_duplicates(frame(spark, rows), 1))) == want
    few = rows[:60]
    classes = frame(spark, few).selectExpr("doc_id AS id", "90L AS n", *[f"7L AS {c}" for c in near_dedup.signature_columns(1)])
    home = spark.createDataFrame([(d, 0) for d, _, _ in few[:20]], "id long, component long")
    texts = frame(spark, few).selectExpr("doc_id AS id", "text")
    for most in (1000, 10**6):
        links = {tuple(sorted(r)) for r in near_dedup.crowd_links(classes, home, texts, 1, side=1, most=most).collect()}
        assert links == {tuple(sorted(ids[i : i + 2])) for i in range(20, 60, 2)}


def test_large_buckets_are_split_by_further_values(spark):
    """In a bucket of 400 twins meet in every table, though their ids fall into different parts; a small bucket of two frequent values isn't split."""
    names, side = near_dedup.signature_columns(2), 2
    twins = [(2 * i + j, 50, 1, 100 + i, 2, 200 + i) for i in range(200) for j in range(2)]
    rows = spark.createDataFrame(twins, "id long, n long, " + ", ".join(f"{c} long" for c in names))
    met = {(r.a, r.b): r.n for r in near_dedup.candidates(rows, side, part=10).collect()}
    # each of the three tables with buckets of two gives a pair twice, as neighbour and as smallest id
    assert all(met[2 * i, 2 * i + 1] >= 7 for i in range(200))
    # 7 with 8 has three holders, each value twenty-three
    small = [(i, 50, 7, 8) for i in range(3)] + [(10 + i, 50, 7, 1000 + i) for i in range(20)] + [(40 + i, 50, 2000 + i, 8) for i in range(20)]
    rows = spark.createDataFrame(small, "id long, n long, a0 long, b0 long")
    assert {(r.a, r.b) for r in near_dedup.candidates(rows, 1, part=3, neighbours=1).collect()} == {(0, 1), (0, 2), (1, 2)}


# --- decontamination ---
def bench_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_hits(rows, items):
    windows = defaultdict(set)
    for item, text in items:
        w = bench_words(text)
        size = min(10, len(w))
        for i in range(len(w) - size + 1 if w else 0):
            windows[tuple(w[i : i + size])].add(item)
    sizes = {len(w) for w in windows}
    out = []
    for i, t, _ in rows:
        w, hit, found = bench_words(t), set(), set()
        for n in sizes:
            for at in range(len(w) - n + 1):
                if (x := tuple(w[at : at + n])) in windows:
                    hit.update(range(at, at + n))
                    found |= windows[x]
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


def test_decontamination(spark, docs, rows):
    texts = [t for _, t, _ in rows if t and len(t) > 300]
    cut = lambda t, a, b: " ".join(t.split()[a:b]).upper()
    items = [(str(i), cut(t, 5 + i, 5 + i + n)) for i, (t, n) in enumerate(zip(texts, [30, 12, 10, 9, 3, 2, 1, 25, 40, 11], strict=False))]
    items += [("x", None), ("y", ""), ("z", "never seen before"), items[0], ("dup", items[0][1]), ("é", "É x")]
    bench = spark.createDataFrame([(a, b, 1) for a, b in items], "item_id string, text string, hits int")
    want = sorted(map(str, brute_hits(rows, [i for i in items if i[1]])))
    got = decontaminate.decontaminate(docs, bench).drop("hits")
    assert sorted(map(str, collect(got))) == want
    assert sorted(map(str, collect(decontaminate.decontaminate(docs, bench, max_bits=64).drop("hits")))) == want
    assert {r.contaminated for r in decontaminate.decontaminate(docs, bench.limit(0)).collect()} == {False}
    assert decontaminate.decontaminate(docs.limit(0), bench).count() == 0


def test_words_are_hashed_alike_wherever_they_lie():
    import pyarrow as pa

    texts = ["", "Aa1 b", "b,aa1", "é\x00É  aa1", "x" * 3000, "aa1b", "-", "b aa1 " * 400]
    seen = {}
    for size in (8, 1 << 20):
        decontaminate.PIECE, before = size, decontaminate.PIECE
        try:
            got = defaultdict(list)
            for first, _, data, start, end, hashes, text in decontaminate.Pieces().of(pa.array(["skip", *texts])[1:]):
                for a, b, h, t in zip(start, end, hashes, text, strict=True):
                    got[first + t].append(data[a:b].tobytes().decode())
                    assert seen.setdefault(got[first + t][-1], int(h)) == int(h)
        finally:
            decontaminate.PIECE = before
        assert [got[i] for i in range(len(texts))] == [bench_words(t) for t in texts]
    assert len(set(seen.values())) == len(seen)


def test_decontamination_of_a_passage_in_most_documents(spark):
    """One window in two thirds of the documents and in many items, a text of 2 MB that is all windows, repeated rows."""
    rng = random.Random(6)
    line = lambda n: " ".join(rng.choice("abcdefg") + str(rng.randint(0, 60)) for _ in range(n))
    passage = line(14)
    items = [(f"i{k}", passage + " " + line(k % 5)) for k in range(40)] + [("one", "zzz"), ("two", "zzz q1")]
    rows = [(i, line(20) + " " + (passage if i % 3 else "") + " " + line(5) + " zzz" * (i % 7 == 0) + " q1" * (i % 2), None) for i in range(300)]
    rows += [rows[1], (None, passage, None)]
    long = (passage + " ") * 25_000
    for part in (decontaminate.PART, 20):  # prefixes with the parts of any prefix, and with more by their counts
        got = decontaminate.decontaminate(frame(spark, [*rows, (999, long, None)]), spark.createDataFrame(items, "item_id string, text string"), part=part).collect()
        assert sorted(map(str, ((*r,)[:-1] for r in got if r.doc_id != 999))) == sorted(map(str, brute_hits(rows, items)))
        assert [(r.n_words, r.n_hit) for r in got if r.doc_id == 999] == [(350_000, 350_000)]


def test_decontamination_on_documents(spark, sf_dir):
    docs, bench = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    rows = [(r.doc_id, r.text, None) for r in docs.collect()]
    want = brute_hits(rows, [(str(r.item_id), r.text) for r in bench.collect()])
    assert any(w[5] for w in want)
    assert sorted(collect(decontaminate.decontaminate(docs, bench).drop("hits"))) == sorted(want)


# --- the pipeline ---
def test_pipeline(spark, sf_dir):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    bench = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    before = docs
    for name, stage in P.STAGES[:-1]:
        after = common.materialize(stage(spark, before, sf_dir), name)
        assert after.columns == docs.columns
        a, b = [(r.doc_id, r.text, r.source) for r in before.collect()], [(r.doc_id, r.text, r.source) for r in after.collect()]
        assert b and set(b) <= set(a)
        if name == "near_dedup":
            assert sorted(r[0] for r in b) == sorted(r[0] for r in brute_components(a, 5) if r[3])
        if name == "decontamination":
            assert sorted(r[0] for r in b) == sorted(r[0] for r in brute_hits(a, bench) if not r[5])
        if name == "mixing":
            assert Counter(r[0] for r in b) == Counter({r.doc_id: len(r.slots) for r in mixing.mix(before).collect() if r.slots})
        before = after
    last = P.STAGES[-1][1](spark, before, sf_dir).collect()
    assert sorted(r.doc_id for r in last) == sorted(r.doc_id for r in before.collect())


def test_stages_with_odd_tables(spark, sf_dir, rows):
    """Stages on nulls, repeated rows, an empty table, and columns that have the helpers' names."""
    import corpus_pipeline as P

    extra = ["gone", "nth", "slot", "at", "copies", "doc_id_", "_gone", "_id", "_nth", "kept", "contaminated", "score"]
    docs = frame(spark, rows).select("*", *[F.lit(1).alias(c) for c in extra if c not in ("n", "row")])
    for table in (docs, docs.limit(0)):
        before = table
        for name, stage in P.STAGES:
            out = stage(spark, before, sf_dir)
            if name != "sharding":
                assert out.columns == docs.columns
                before = common.materialize(out, name)
            else:
                assert out.count() == before.count()


def test_only_own_tables_are_deleted(spark, docs, tmp_path):
    """An input in a folder of the library's name stays, with a first block of items that has no window."""
    path = str(tmp_path / "framespark" / "corpus")
    docs.select("doc_id", "text").write.parquet(path)
    bench = spark.createDataFrame([("a", "..."), ("b", " ".join(f"w{i}" for i in range(30)))], "item_id string, text string")
    given = spark.read.parquet(path)
    assert decontaminate.decontaminate(given, bench).count() == docs.count()
    common.discard(given)
    common.discard(given.select("doc_id"))
    assert spark.read.parquet(path).count() == docs.count()
    own = common.materialize(given, "own")
    where = own._own_path
    common.discard(own)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(where)

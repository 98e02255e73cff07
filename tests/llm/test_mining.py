"""Clustering, phrases and the Jaccard join against brute force, with nulls, ties, repeated rows, long texts and clashing columns."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from framespark.llm import clustering, jaccard_join, phrases
from framespark.llm.near_dedup import WordHashes


# --- clustering ---
def search(points, vectors):
    d = ((vectors[:, None, :] - points[None, :, :]) ** 2).sum(axis=2)
    return d.argmin(axis=1), d.min(axis=1)


@pytest.mark.parametrize("k", [1, 2, 3, 8, 60, 300])
def test_tree_finds_the_nearest_and_of_equal_ones_the_smallest(k):
    rng = np.random.default_rng(k)
    points = rng.integers(-6, 7, (k, 3))  # small integers: many ties and repeated points
    vectors = np.concatenate([rng.integers(-8, 9, (500, 3)), points])
    number, best, taken = clustering.nearest(clustering.build_tree(points), vectors)
    want, far = search(points, vectors)
    assert (number == want).all() and (best == far).all()
    large = points * 1000
    vectors = large[rng.integers(0, k, 400)] + rng.integers(-50, 51, (400, 3))
    number, best, taken = clustering.nearest(clustering.build_tree(large), vectors)
    want, far = search(large, vectors)
    assert (number == want).all() and (best == far).all()
    if k == 300:
        assert taken < 400 * k / 3  # most of the tree isn't opened


def test_tree_with_the_largest_components():
    rng = np.random.default_rng(1)
    points = rng.choice([-clustering.LARGEST, clustering.LARGEST - 1], (40, 64))
    vectors = rng.choice([-clustering.LARGEST, clustering.LARGEST - 1, 0], (200, 64))
    number, best, _ = clustering.nearest(clustering.build_tree(points), vectors)
    want = [min((sum((int(a) - int(b)) ** 2 for a, b in zip(v, p, strict=True)), c) for c, p in enumerate(points)) for v in vectors]
    assert list(zip(best.tolist(), number.tolist(), strict=True)) == want


def lloyd(rows, k, rounds, scale, salt):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{salt}{r[0]}".encode()).hexdigest(), r[1]))
    points = [list(v) for _, v in order[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, p, strict=True)), c) for c, p in enumerate(points))
    for _ in range(rounds):
        groups = defaultdict(list)
        for _, v in kept:
            groups[near(v)[1]].append(v)
        for c, g in groups.items():
            points[c] = [math.floor(Fraction(sum(x), len(g))) for x in zip(*g, strict=True)]
    return [(i, near(v)[1], near(v)[0]) for i, v in kept], points


def test_clusters(spark):
    rng = random.Random(3)
    rows = [(i, [rng.gauss(i % 4, 0.4) for _ in range(5)]) for i in range(200)]
    rows += [rows[7]] * 80 + [(i, [0.1] * 5) for i in range(300, 320)] + [(None, [0.2] * 5)]
    odd = [(400, None), (401, [1.0] * 4), (402, [None] + [1.0] * 4), (403, [float("nan")] + [1.0] * 4), (404, [float("inf")] * 5), (405, [])]
    far = [(500, [1e6] * 5), (501, [-3e38, 0.0, 0.0, 0.0, 0.0])]
    table = spark.createDataFrame([(i, v, 1, "x", 2) for i, v in rows + odd + far], "vec_id long, embedding array<double>, cluster int, v string, n int").repartition(7)
    got = clustering.cluster(table, 6, 4, 5).collect()
    want, points = lloyd(rows, 6, 4, 1024, "3:")
    inside = [r for r in got if r.cluster is not None]
    assert Counter((r.vec_id, r.cluster, r.distance) for r in inside) == Counter(want)
    assert sorted((r.vec_id, r.distance, r.inertia) for r in got if r.cluster is None) == [(500, None, None), (501, None, None)]
    by = Counter()
    for _, c, d in want:
        by[c] += d
    assert all(r.cluster_inertia == by[r.cluster] and r.inertia == sum(by.values()) for r in inside)
    assert all(r.centroid_sha256 == hashlib.sha256(",".join(map(str, points[r.cluster])).encode()).hexdigest() for r in inside)
    assert clustering.cluster(table.limit(0), 6, 4, 5).collect() == []
    few = spark.createDataFrame([(1, [1.0]), (2, [1.0]), (3, [4.0])], "vec_id long, embedding array<float>")
    assert {(r.vec_id, r.cluster is not None, r.distance) for r in clustering.cluster(few, 8, 3, 1).collect()} == {(1, True, 0), (2, True, 0), (3, True, 0)}
    with pytest.raises(ValueError):
        clustering.cluster(few, 8, 3, 65)


def test_a_round_of_clusters_takes_no_job_for_each_shuffle_partition(spark):
    name, group = "spark.sql.shuffle.partitions", "one round"
    before, adaptive = spark.conf.get(name), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    vectors = spark.createDataFrame([(i, [i % 7, i % 5]) for i in range(100)], "vec_id long, v array<long>")
    spark.conf.set(name, "40")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.sparkContext.setJobGroup(group, "")
    try:
        new = clustering.moved(vectors, np.array([[0, 0], [6, 4]], np.int64), 2)
    finally:
        spark.conf.set(name, before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", adaptive)
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    near = [min((0, 1), key=lambda c: ((i % 7 - 6 * c) ** 2 + (i % 5 - 4 * c) ** 2, c)) for i in range(100)]
    mean = lambda c, m: sum(i % m for i in range(100) if near[i] == c) // near.count(c)
    assert new.tolist() == [[mean(c, 7), mean(c, 5)] for c in (0, 1)]
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(group)) < 10


# --- phrases ---
def mined(rows, least, longest, top, inside=100):
    """Plain counting of all phrases."""
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    counts = defaultdict(Counter)
    for text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(lower)):
            w = re.findall(r"[^\x20\x09]+", piece)
            for m in range(1, longest + 1):
                for i in range(len(w) - m + 1):
                    counts[lang or "und"][tuple(w[i : i + m])] += 1
    out = []
    for lang, f in counts.items():
        n = sum(v for p, v in f.items() if len(p) == 1)
        held = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        within = lambda p, q: len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))
        rows = []
        for p, a in held.items():
            if not any(within(p, q) and 100 * b >= inside * a for q, b in held.items()):
                score, _, l, r = min((1000 * a * n // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))  # noqa: E741
                rows.append((score, a, " ".join(p), l, r, n))
        rows.sort(key=lambda r: (-r[0], -r[1], r[2].encode()))
        out += [(lang, i + 1, p, a, l, r, n, s) for i, (s, a, p, l, r, n) in enumerate(rows[:top])]
    return sorted(out)


NAMES = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def prose(seed, docs=150):
    rng = random.Random(seed)
    vocabulary = [rng.choice(["Aa", "b", "ç", "日本", "x\x00y", "d\xa0e"]) + str(i % 9) for i in range(14)]
    fixed = ["new york city", "no no no no no no", "of the , of the", "a\tb  c\nd"]
    texts = []
    for _ in range(docs):
        words = [rng.choice(vocabulary) if rng.random() < 0.8 else rng.choice(fixed) for _ in range(rng.randint(0, 40))]
        texts.append("".join(w + rng.choice([" ", " ", " ", ". ", ", ", "\t", "\n", "!", "\r\n"]) for w in words))
    rows = [(t, [None, "en", "en", "en", "fr"][i % 5]) for i, t in enumerate(texts)]
    return rows + [(None, "en"), (None, None), ("", "fr"), (" \t\n.,", "xx"), ("und und und", "und")] + [rows[3]] * 5


@pytest.mark.parametrize("least,longest,inside", [(10, 5, 100), (3, 4, 60), (25, 2, 100)])
def test_phrases(spark, least, longest, inside):
    rows = prose(least)
    docs = spark.createDataFrame([(t, g, 1, "k", 2) for t, g in rows], "text string, lang string, n int, word string, id int").repartition(5)
    want = mined(rows, least, longest, 30, inside)
    for head in (phrases.HEAD, 3, 0) if longest == 5 else (3,):  # all keys by broadcast, some and all of them by the join
        got = phrases.mine_phrases(docs, least, longest, 30, inside, head=head)
        assert sorted(tuple(r[n] for n in NAMES) for r in got.collect()) == want
    assert len(want) > 20 or longest == 2


def test_phrases_of_nothing(spark):
    docs = spark.createDataFrame([("one two", "en"), (None, None)], "text string, lang string")
    assert phrases.mine_phrases(docs).collect() == []
    assert phrases.mine_phrases(docs.limit(0)).collect() == []


def test_phrases_of_a_long_text_and_long_words(spark):
    long = "w" * 200_000
    rows = [(" ".join(["alpha beta"] * 150_000), "en"), (f"{long} end . " * 12, "en"), ("x" * 2_000_000, None)]
    docs = spark.createDataFrame(rows, "text string, lang string")
    assert sorted(tuple(r[n] for n in NAMES) for r in phrases.mine_phrases(docs, 10, 3).collect()) == mined(rows, 10, 3, 2000)


def test_exact_scores_beyond_64_bits(spark, monkeypatch):
    rows = [("a b", "en")] * 40
    docs = spark.createDataFrame(rows, "text string, lang string")
    real = phrases.frequent

    def many(*args):
        totals, found = real(*args)
        big = lambda c: F.transform(c, lambda x: x * 100_000_000_000)
        return totals.withColumn("total", F.col("total") * 100_000_000_000 + 7), found.withColumns({"a": F.col("a") * 100_000_000_000, "first": big("first"), "last": big("last")})

    monkeypatch.setattr(phrases, "frequent", many)
    got = phrases.mine_phrases(docs, 10).collect()
    a, n = 4_000_000_000_000, 8_000_000_000_007
    assert [(r.a, r.n, r.score) for r in got] == [(a, n, 1000 * a * n // (a * a))]


def test_dense_and_sparse_tiles_count_alike():
    rng = np.random.default_rng(2)
    ids = (rng.zipf(1.3, 50_000) % 5000).astype(np.int32)
    ids[rng.integers(0, len(ids), 900)] = -1
    codes = phrases.codes_of(ids)
    codes = codes[codes >= 0]
    want = Counter(codes.tolist())
    for side, dense, held in ((64, 500, 4), (1024, 1, 8), (16, 10**9, 8)):
        tiles, got = phrases.Tiles(side, dense, held), Counter()
        for some in np.array_split(codes, 7):
            for c, n in zip(*tiles.add(some), strict=True):
                got[int(c)] += int(n)
        assert len(tiles.held) <= held and (dense == 10**9) == (not tiles.held)
        for cells, n in tiles.counted():
            got.update(dict(zip(cells.tolist(), n.tolist(), strict=True)))
        assert got == want


@pytest.mark.parametrize("module,sql,query", [(clustering, clustering.OP12_SQL, clustering.op12_clustering), (phrases, phrases.OP13_SQL, phrases.op13_phrases)])
def test_queries_equal_their_sql(spark, sf_dir, module, sql, query):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    want = con.execute(sql)
    names = [c[0] for c in want.description]
    got = query(spark, sf_dir).select(*names)
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())


# --- Jaccard join ---
def joined(rows, k, percent):
    """{doc_id: (n, component)} by all pairs."""
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    parent, reps, sizes = {}, {}, defaultdict(set)

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    def join(a, b):
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)

    for i, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(lower))
        s = frozenset(tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))) if w else frozenset()
        sizes[i].add(len(s))
        if i is None:
            continue
        parent.setdefault(i, i)
        if s:
            join(i, reps.setdefault(s, i))
    sets, links = list(reps.items()), 0
    for x in range(len(sets)):
        for y in range(x):
            both = len(sets[x][0] & sets[y][0])
            if both and 100 * both >= percent * (len(sets[x][0]) + len(sets[y][0]) - both):
                join(sets[x][1], sets[y][1])
                links += 1
    return {(i, n, None if i is None else root(i)) for i, ns in sizes.items() for n in ns}, links


def crowd(seed, families=6, size=25):
    """Families of near copies around the limit, a template that many share without being similar, copies and odd texts."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6)))
    texts = [None, "", " \t\n", "one", "ONE", "one two", "one two three", "one  two\tthree", "x" * 5000, "é 日本 \u00a0 x y z"]
    for f in range(families):
        base = [word() for _ in range(rng.choice([6, 30, 90, 250]))]
        for _ in range(size):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 60 + f % 3))):
                at = rng.randrange(len(w))
                w[at : at + rng.randint(0, 2)] = [word()] * rng.randint(0, 2)
            texts.append(" ".join(w))
    template = [word() for _ in range(120)]
    for _ in range(60):
        own = [word() for _ in range(rng.choice([12, 14, 30]))]
        texts.append(" ".join(template[: rng.choice([100, 120])] + own))
    rng.shuffle(texts)
    rows = [(i * 7 % 1009, t) for i, t in enumerate(texts)]
    return rows + [rows[20]] * 30 + [(5000, rows[30][1]), (5000, rows[60][1]), (None, rows[40][1]), (None, None)]


@pytest.mark.parametrize("k,percent", [(4, 85), (2, 70)])
def test_jaccard_join(spark, k, percent):
    rows = crowd(k)
    docs = spark.createDataFrame([(i, t, 1, 2, "x", 3) for i, t in rows], "doc_id long, text string, n int, id int, grp string, component int").repartition(6)
    want, links = joined(rows, k, percent)
    assert links > 50
    for weight, part in ((jaccard_join.WEIGHT, jaccard_join.PART), (1500, 10)):  # small groups: links across them must be found by the matrix
        got = jaccard_join.jaccard_join(docs, k, percent, weight=weight, part=part).collect()
        assert len(got) == len(rows)
        assert {(r.doc_id, r.n_shingles, r.component_id) for r in got} == want


def test_the_matrix_alone_finds_all_links(spark, monkeypatch):
    """Without groups found beforehand every set is a group of its own."""
    rows = crowd(11, 4, 15)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(jaccard_join, "families", lambda classes, *_: spark.createDataFrame([], "a long, b long"))
    want, _ = joined(rows, 4, 85)
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.jaccard_join(docs, 4, 85).collect()} == want


def test_jaccard_join_of_nothing_and_of_long_texts(spark):
    docs = spark.createDataFrame([(1, None), (2, " ")], "doc_id long, text string")
    assert {tuple(r) for r in jaccard_join.jaccard_join(docs).collect()} == {(1, 0, 1), (2, 0, 2)}
    assert jaccard_join.jaccard_join(docs.limit(0)).collect() == []
    rng = random.Random(1)
    long = " ".join(str(rng.randrange(10**9)) for _ in range(220_000))  # over 2 MB
    docs = spark.createDataFrame([(1, long), (2, long + " end"), (3, "y" * 2_000_000), (4, long[: len(long) // 2])], "doc_id long, text string")
    assert {(r.doc_id, r.component_id) for r in jaccard_join.jaccard_join(docs, 4, 85).collect()} == {(1, 1), (2, 1), (3, 3), (4, 4)}


def test_prefixes_of_similar_sets_share_enough():
    """The bound behind the matrix, for all sizes and the least overlap that links."""
    for percent in (70, 80, 85, 95):
        for n in range(1, 150):
            for s in range(n, n * 100 // percent + 1):
                least = jaccard_join.least_shared(n, s, percent)
                small, _, shared = jaccard_join.prefix_lengths(n, percent)
                _, large, _ = jaccard_join.prefix_lengths(s, percent)
                assert 100 * least >= percent * (n + s - least) and shared <= least <= n
                assert n - least + shared <= small and s - least + shared <= large  # l shared tokens lie in both


def test_shingles_are_whole_words_in_order():
    hashes = WordHashes()
    sets = jaccard_join.shingle_sets(["a b c d e", "A  b\tc d", "b a c d", "a b", "", None, "ab", "a b c d a b c d"], 4, hashes)
    assert [len(s) for s in sets] == [2, 1, 1, 1, 0, 0, 1, 4]
    assert sets[1][0] in sets[0] and sets[1][0] in sets[7] and len({int(s[0]) for s in sets[1:4]} | {int(sets[6][0])}) == 4
    assert all(np.array_equal(x, jaccard_join.shingles(t, 4, hashes)) for x, t in zip(sets, ["a b c d e", "A  b\tc d", "b a c d", "a b", "", None, "ab", "a b c d a b c d"], strict=True))

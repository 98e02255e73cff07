"""Near-duplicates by MinHash with tensored banding.

A table's key combines one value of collection A with one of collection B, each made of two minhashes. Ten values in
either collection key 100 tables from 40 minhashes, where 100 independent bands of four would take 400.

Texts with equal shingle sets form one class first. A class's values that no other class shares are dropped before they
are combined. In a bucket no pairs of all are formed: members meet the bucket's smallest id and their neighbours in
the order of other minhash values, where near copies are adjacent; a large bucket is split by a further minhash value,
so near copies tend to stay together, into parts whose smallest ids meet. Every candidate is verified on the full shingle sets. The best partner of each class is verified first;
of the others only those that would join components that are still apart. Members of a bucket that then are still in
different components meet in full: their common shingles are counted in blocks of members, so no pair that shares a
table's key is left out unless it is in one component already.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import block_count, bloom_block, bloom_hit, bloom_table, discard, map_batches, materialize, table

#: Words in a shingle and the similarity, in percent, from which documents are linked, of the query.
QUERY_SHINGLE, PERCENT = 4, 80
#: The same for stages, where no contract says otherwise.
SHINGLE = 5
#: Values in either collection, and minhashes in a value.
SIDE, ROWS = 10, 2
#: Members from which a bucket is split, and about those of a part.
PART = 1000
#: Neighbours in a bucket's order that a member meets.
NEIGHBOURS = 2
#: Shingles, about, in a block of a crowd's members, and what a member counts beside its shingles.
CROWD, MEMBER = 500_000, 64
SALTS = 16
MAX_BLOCKS = 1 << 16
LOWER_BYTES = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_U = np.uint64


class WordHashes(dict):
    """64-bit hashes of words, remembered."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > 200_000:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), _U, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(32))) * _U(0x9E3779B97F4A7C15)
    x = (x ^ (x >> _U(29))) * _U(0xBF58476D1CE4E5B9)
    return x ^ (x >> _U(32))


def shingles(text: str | None, k: int, hashes: WordHashes) -> np.ndarray:
    """Sorted hashes of the distinct k-word shingles; of the whole sequence if it is shorter; none without words."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER_BYTES).split()
    if not words:
        return np.zeros(0, _U)
    ids = hashes.of(words)
    n = max(1, len(ids) - k + 1)
    value = np.full(n, min(k, len(ids)), _U)
    for i in range(min(k, len(ids))):
        value = mixed(value ^ ids[i : i + n])
    return np.unique(value)


def set_digests(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The two halves of a 128-bit digest of each whole set: of 10^11 sets, two that differ share one with probability 10^-17."""
    import xxhash

    digests = np.frombuffer(b"".join(xxhash.xxh3_128_digest(s.tobytes()) for s in sets), "<u8").astype(_U).reshape(-1, 2)
    return digests[:, 0], digests[:, 1]


def signature_columns(side: int = SIDE) -> list[str]:
    return [f"{s}{i}" for s in "ab" for i in range(side)]


def signatures(docs: DataFrame, k: int, side: int = SIDE, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text", seed: int = 17) -> DataFrame:
    """(doc_id, n, h1, h2, a0.., b0..): size and 128-bit hash of the shingle set, and its values in both collections (null without shingles)."""
    seeds = np.random.default_rng(seed).integers(0, 2**63, 2 * side * rows).astype(_U)
    names = signature_columns(side)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for at in range(0, len(texts), 128):
                sets = [shingles(t, k, hashes) for t in texts[at : at + 128]]
                sizes = np.array([len(s) for s in sets])
                full = sizes > 0
                every = np.concatenate(sets)
                starts = (np.cumsum(sizes) - sizes)[full]
                h1, h2 = set_digests(sets)
                values = []
                if len(every):
                    least = [np.minimum.reduceat(mixed(every ^ s), starts) for s in seeds]
                    for v in range(2 * side):
                        value = np.full(len(starts), v, _U)
                        for m in least[v * rows : (v + 1) * rows]:
                            value = mixed(value ^ m)
                        column = np.zeros(len(sets), np.int64)
                        column[full] = value.view(np.int64)
                        values.append(pa.array(column, mask=~full))
                else:
                    values = [pa.nulls(len(sets), pa.int64())] * (2 * side)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(sets)), pa.array(sizes), pa.array(h1.copy().view(np.int64)), pa.array(h2.copy().view(np.int64)), *values], names=["doc_id", "n", "h1", "h2", *names])

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_batches(texts, run, "doc_id long, n long, h1 long, h2 long, " + ", ".join(f"{c} long" for c in names))


def candidates(classes: DataFrame, side: int = SIDE, percent: int = PERCENT, part: int = PART, neighbours: int = NEIGHBOURS) -> DataFrame:
    """(a, b, n): pairs of class ids that meet in n of the side * side tables, a < b, from (id, n, a0.., b0..)."""
    values = F.array(*[F.struct(F.lit(i).alias("v"), F.col(c).alias("x")) for i, c in enumerate(signature_columns(side))])
    entries = classes.where("n > 0").select("id", "n", F.explode(values).alias("e")).select("id", "n", "e.v", "e.x")
    shared = materialize(entries.groupBy("v", "x").agg(F.count("*").alias("m")).where("m > 1"), "minhash_shared")
    entries = materialize(entries, "minhash_entries")
    kept = entries.join(shared, ["v", "x"])
    # values of a class that others share, at most 2 * side of them
    own = kept.groupBy("id", "n").agg(F.collect_list(F.struct("v", "x", "m")).alias("values"))
    half = lambda low: F.filter("values", lambda e: (e["v"] < side) if low else (e["v"] >= side))
    own = own.select("id", "n", half(True).alias("av"), half(False).alias("bv")).where("size(av) > 0 and size(bv) > 0")
    # the order in a bucket: the values that follow those in the key, so each table has another one
    a_of, b_of = F.col("av")[F.col("i")], F.col("bv")[F.col("j")]
    next_of = lambda side_, at: F.col(side_)[(F.col(at) + 1) % F.size(side_)]["x"]
    near = F.shiftleft(F.hash(next_of("av", "i")).cast("long"), 32) + F.hash(next_of("bv", "j")).cast("long")
    tables = own.select("*", F.explode(F.sequence(F.lit(0), F.size("av") - 1)).alias("i")).select("*", F.explode(F.sequence(F.lit(0), F.size("bv") - 1)).alias("j")).select("id", "n", next_of("av", "i").alias("next"), near.alias("near"), a_of.alias("a"), b_of.alias("b"))
    most = F.least(F.col("a.m"), F.col("b.m"))
    key, further = F.xxhash64("a.v", "a.x", "b.v", "b.x"), F.xxhash64("a.v", "a.x", "b.v", "b.x", "next")
    keyed = tables.select(key.alias("key"), further.alias("further"), (most > part).alias("large"), "near", "id", "n")
    # only what two frequent values key can be large; its own count decides
    large = keyed.where("large").groupBy("key").agg(F.count("*").alias("members")).where(F.col("members") > part)
    keyed = keyed.join(large, "key", "left").select("key", F.when(F.col("members").isNotNull(), F.pmod("further", F.ceil(F.col("members") / part))).otherwise(0).cast("int").alias("part"), F.col("members").isNotNull().alias("split"), "near", "id", "n")
    bucket, ordered = Window.partitionBy("key", "part"), Window.partitionBy("key", "part").orderBy("near", "id")
    row = F.struct("id", "n")
    before = [F.lag(row, k).over(ordered) for k in range(1, neighbours + 1)]
    met = keyed.select("key", "split", row.alias("row"), F.array_compact(F.array(*before, F.min(row).over(bucket))).alias("met"))
    met = met.where("split or size(met) > 1 or met[0] <> row")
    pairs = met.select(F.col("row").alias("q"), F.explode("met").alias("p"))
    hubs = met.where("split and met[size(met) - 1] = row").select("key", "row")
    top = hubs.select(F.col("row").alias("q"), F.min("row").over(Window.partitionBy("key")).alias("p"))
    pairs = pairs.unionByName(top).where("p.id <> q.id")
    pairs = pairs.select(F.least("p.id", "q.id").alias("a"), F.greatest("p.id", "q.id").alias("b"), F.least("p.n", "q.n").alias("fewer"), F.greatest("p.n", "q.n").alias("more"))
    # sets whose sizes differ too much can't be similar enough
    out = materialize(pairs.where(F.col("fewer") * 100 >= F.col("more") * percent).groupBy("a", "b").agg(F.count("*").alias("n")), "minhash_pairs")
    discard(shared)
    discard(entries)
    return out


def one_of_each(texts: DataFrame, signed: DataFrame) -> DataFrame:
    """Rows (id, text), of identical ones one: only rows whose id is repeated are shuffled for that."""
    again = materialize(signed.where("doc_id is not null").groupBy(F.col("doc_id").alias("id")).agg(F.count("*").alias("m")).where("m > 1").select("id"), "minhash_again")
    if not again.limit(1).count():
        return texts
    rows = texts.join(again, "id").groupBy("id", F.md5("text").alias("digest")).agg(F.any_value("text").alias("text"))
    return texts.join(again, "id", "left_anti").unionByName(rows.select("id", "text"))


def texts_near(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of docs whose id is in ids, and few others: those that pass a filter of bounded size by chance."""
    blocks = block_count(ids.count(), MAX_BLOCKS)
    return docs.withColumn("block", bloom_block(F.col("id"), blocks)).join(F.broadcast(bloom_table(ids, "id", blocks)), "block").where(bloom_hit(F.col("id"))).select("id", "text")


def verify(pairs: DataFrame, docs: DataFrame, k: int, percent: int = PERCENT) -> DataFrame:
    """(a, b) of those pairs whose full shingle sets are similar enough. docs: (id, text) of all classes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            keep, last, left = [], None, None
            for a, x, y in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if last is None or a != last:
                    last, left = a, shingles(x, k, hashes)
                right = shingles(y, k, hashes)
                both = len(np.intersect1d(left, right, assume_unique=True))
                keep.append(100 * both >= percent * (len(left) + len(right) - both))
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep, pa.bool_())) for c in (batch.column(0), batch.column(1))], names=["a", "b"])

    held = texts_near(docs, pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))))
    left = pairs.select("a", "b").join(held.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
    both = left.join(held.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
    return map_batches(both.select("a", "b", "text_a", "text_b"), run, "a long, b long")


def joining(sets: list[np.ndarray], component: np.ndarray, left: np.ndarray, right: np.ndarray, percent: int, rows: int = 64) -> list[tuple[int, int]]:
    """Of all similar enough pairs of a left and a right member, as many as join the members' components. The common shingles of every pair are counted: frequent shingles by a matrix product, the others by their lists of members."""
    component, sizes, links = component.copy(), np.array([len(s) for s in sets]), []
    _, token, held = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    member = np.repeat(np.arange(len(sets)), sizes)
    often, several = (held > 1) & (held * 8 > len(sets)), held > 1
    dense = np.zeros((len(sets), int(often.sum())), np.float32)
    at = often[token]
    dense[member[at], (np.cumsum(often) - 1)[token[at]]] = 1
    at = several[token] & ~often[token]
    member, token = member[at], token[at]
    lists = member[np.argsort(token, kind="stable")]
    count = np.bincount(token, minlength=len(held))
    start = np.cumsum(count) - count
    own = np.searchsorted(member, np.arange(len(sets) + 1))
    other = dense[right].T
    for first in range(0, len(left), rows):
        block = left[first : first + rows]
        common = np.zeros((len(block), len(right)), np.int64) + np.rint(dense[block] @ other).astype(np.int64)
        for r, i in enumerate(block):
            t = token[own[i] : own[i + 1]]
            if len(t):
                places = np.repeat(start[t] - (np.cumsum(count[t]) - count[t]), count[t]) + np.arange(count[t].sum())
                common[r] += np.bincount(lists[places], minlength=len(sets))[right]
        similar = 100 * common >= percent * (sizes[block][:, None] + sizes[right][None, :] - common)
        for r, i in enumerate(block):
            near = right[similar[r]]
            for c, j in zip(*np.unique(component[near], return_index=True), strict=True):
                if c != component[i]:
                    links.append((int(i), int(near[j])))
                    component[component == c] = component[i]
    return links


def crowd_links(classes: DataFrame, found: DataFrame, docs: DataFrame, k: int, percent: int = PERCENT, side: int = SIDE, most: int = CROWD) -> DataFrame:
    """(a, b): links that join components among the classes that share a value of collection A.

    Buckets that are one component, or so small that neighbours are all members, are done. In each other one the members
    outside its largest component meet all members, in blocks of bounded size: every block of theirs meets every block.
    """
    values = F.array(*[F.struct(F.lit(i).alias("v"), F.col(c).alias("x")) for i, c in enumerate(signature_columns(side)[:side])])
    placed = classes.join(found, "id", "left").select("id", (F.col("n") + MEMBER).alias("weight"), F.coalesce("component", "id").alias("component"), F.explode(values).alias("e"))
    entries = placed.select("id", "weight", "component", "e.v", "e.x")
    sizes = entries.groupBy("v", "x", "component").agg(F.count("*").alias("m"), F.sum("weight").alias("weight"))
    crowds = sizes.groupBy("v", "x").agg(F.sum("m").alias("m"), F.count("*").alias("parts"), F.sum("weight").alias("total"), F.max(F.struct("m", "component", "weight")).alias("home"))
    crowds = crowds.where((F.col("parts") > 1) & (F.col("m") > NEIGHBOURS + 1))
    whole = F.col("total") <= most
    outer = F.when(whole, 1).otherwise(F.ceil((F.col("total") - F.col("home.weight")) / most))
    inner = F.when(whole, 0).otherwise(F.ceil(F.col("home.weight") / most))
    crowds = crowds.select("v", "x", F.col("home.component").alias("home"), whole.alias("whole"), outer.cast("int").alias("outer"), inner.cast("int").alias("inner"))
    rows = entries.join(crowds, ["v", "x"]).withColumn("away", F.col("component") != F.col("home"))
    part = lambda of: F.pmod(F.xxhash64("id", "v"), F.greatest(F.col(of), F.lit(1))).cast("int")
    rows = rows.withColumn("block", F.when(F.col("whole"), 0).when(F.col("away"), part("outer")).otherwise(F.col("outer") + part("inner")))
    met = F.when(F.col("block") < F.col("outer"), F.col("outer") + F.col("inner") - 1).otherwise(F.col("outer") - 1)
    rows = rows.select("id", "component", "away", "block", "v", "x", F.explode(F.sequence(F.lit(0), met)).alias("with"))
    rows = materialize(rows.select("id", "component", "away", "block", "v", "x", F.least("block", "with").alias("p"), F.greatest("block", "with").alias("q")), "minhash_crowds")

    def run(group: pa.Table) -> pa.Table:
        hashes = WordHashes()
        ids, component, away, block, p, q = (group.column(c).to_numpy() for c in ("id", "component", "away", "block", "p", "q"))
        sets = [shingles(t, k, hashes) for t in group.column("text").to_pylist()]
        left = np.flatnonzero(away & (block == p))
        links = joining(sets, component, left, np.flatnonzero(block == q), percent)
        return pa.table({"a": pa.array([int(ids[i]) for i, _ in links], pa.int64()), "b": pa.array([int(ids[j]) for _, j in links], pa.int64())})

    with_texts = rows.join(texts_near(docs, rows.select("id").distinct()), "id")
    links = materialize(with_texts.groupBy("v", "x", "p", "q").applyInArrow(run, "a long, b long"), "minhash_crowd_links")
    discard(rows)
    return links


def components(links: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable, of every id in links (a, b). Rounds of least neighbours and shortcuts, each written to the shared folder."""
    both = materialize(links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v"))), "links")
    labels = materialize(both.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("id"), F.least("u", "v").alias("component")), "labels")
    while True:
        known = labels.select(F.col("id").alias("v"), "component")
        least = both.join(known, "v").groupBy(F.col("u").alias("id")).agg(F.min("component").alias("near"))
        hooked = labels.join(least, "id").select("id", F.col("component").alias("was"), F.least("component", "near").alias("to"))
        jump = labels.select(F.col("id").alias("to"), F.col("component").alias("further"))
        new = materialize(hooked.join(jump, "to", "left").select("id", F.least("to", F.coalesce("further", "to")).alias("component"), "was"), "labels")
        discard(labels)
        changed, labels = new.where("component <> was").limit(1).count(), new
        if not changed:
            discard(both)
            return labels


def near_duplicates(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text", side: int = SIDE, rows: int = ROWS, salts: int = SALTS, part: int = PART) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row, on whole texts.

    Rows are linked if 100 * |intersection| >= percent * |union| of their shingle sets; component_id is the smallest
    doc_id reachable and kept says that it is the row's own. Null texts and texts without words have no shingles and are
    linked with nothing. Rows with a null doc_id are linked with nothing and kept, component null; repeated doc_ids are in
    one component with whatever either of their texts is linked to. Other columns are ignored.
    """
    signed = materialize(signatures(docs, k, side, rows, id_col, text_col), "minhash")
    names = signature_columns(side)
    classes = signed.where("doc_id is not null and n > 0").groupBy("n", "h1", "h2").agg(F.min("doc_id").alias("id"), F.count("*").alias("copies"), *[F.min(c).alias(c) for c in names])
    classes = materialize(classes, "minhash_classes")
    pairs = candidates(classes.select("id", "n", *names), side, percent, part)
    texts = one_of_each(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")), signed)
    best = materialize(pairs.groupBy("b").agg(F.max_by("a", F.struct("n", -F.col("a"))).alias("a")).select("a", "b"), "minhash_best")
    first = materialize(verify(best, texts, k, percent), "minhash_links")
    # the rest, where it would join what is still apart
    found = components(first)
    comp = lambda c: found.select(F.col("id").alias(c), F.col("component").alias(f"{c}_component"))
    rest = pairs.join(best.withColumn("done", F.lit(True)), ["a", "b"], "left").where("done is null").join(comp("a"), "a", "left").join(comp("b"), "b", "left")
    rest = materialize(rest.where("coalesce(a_component, a) <> coalesce(b_component, b)").select("a", "b").distinct(), "minhash_rest")
    second = materialize(first.unionByName(verify(rest, texts, k, percent)), "minhash_links")
    # members of a bucket that are still apart
    nearly = components(second)
    third = crowd_links(classes.select("id", "n", *names), nearly, texts, k, percent, side)
    links = second.unionByName(third)
    # a repeated doc_id joins the classes of its texts
    repeated = signed.where("n > 0 and doc_id is not null").groupBy("n", "h1", "h2", "doc_id").count().groupBy("doc_id").agg(F.count("*").alias("sets")).where("sets > 1").select("doc_id")
    same = signed.where("n > 0").join(repeated, "doc_id").join(classes.select("n", "h1", "h2", "id"), ["n", "h1", "h2"]).select(F.col("doc_id").alias("a"), F.col("id").alias("b")).where("a <> b")
    last = materialize(links.unionByName(same).distinct(), "minhash_links")
    for done in (pairs, best, first, rest, found, second, nearly, third):
        discard(done)
    found = components(last)
    discard(last)
    # classes of several rows, or in a component with others, are salted to meet their rows
    placed = classes.select("id", "n", "h1", "h2", "copies").join(found, "id", "left").withColumn("component", F.coalesce("component", "id"))
    placed = placed.where("copies > 1 or component <> id").select(F.col("n").alias("cn"), F.col("h1").alias("c1"), F.col("h2").alias("c2"), "component", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("cs"))
    salted = signed.select("doc_id", "n", "h1", "h2", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int").alias("s"))
    out = salted.join(placed, (F.col("n") == F.col("cn")) & (F.col("h1") == F.col("c1")) & (F.col("h2") == F.col("c2")) & (F.col("s") == F.col("cs")), "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), QUERY_SHINGLE)

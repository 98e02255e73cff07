"""Benchmark decontamination by a prefix-filtered set join.

An item is a set of windows of 10 consecutive words (one shorter window if it has fewer), a window a set of shingles of up
to 3 words. A window is contained in a document only if all its shingles are, so the prefix that must match is a single
shingle: the rarest one, by the number of documents that have it. A place where a document has a window's rarest shingle
bounds where the window may lie (position) and whether it fits (length); the words there are then compared.

Windows, shingles, their counts and the prefixes are tables, so a benchmark of any size is spread over tasks. Documents are
read twice: to count the benchmark's shingles, and to find the prefixes. Both passes drop nearly all other shingles by a
Bloom filter of bounded size; what passes by chance finds no partner in the joins that follow. Only words around a prefix
leave the scan, never texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, map_batches, materialize, table

WINDOW, SHINGLE = 10, 3
#: Bits of the filter of shingles that is broadcast: 16 a shingle, at most so many (4 MB).
MAX_BITS = 1 << 25
#: Bytes of text that are cut into words at once; a longer text is one piece.
PIECE = 1 << 20
#: Distinct shingles that a task counts before it hands them on.
MAX_COUNTS = 1 << 20
#: Parts of a prefix's places, at least; one that many documents have gets a part for each so many of them. Counts of so many such prefixes are broadcast (1 MB), the most frequent first.
SALTS, PART, HOT_KEYS = 4, 100_000, 1 << 16
#: ASCII other than letters and digits separates words; A-Z become lower case; bytes of other characters stay.
WORD_BYTES = np.array([c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)], np.uint8)
_U = np.uint64
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)
SHIFTS = (0, 21, 42)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(32))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(29))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(32))


class Pieces:
    """Cuts the texts of Arrow batches into words and hashes the words, many texts at once."""

    def __init__(self):
        self.powers = self.inverses = np.ones(1, _U)

    def reach(self, n: int) -> None:
        if len(self.powers) < n:
            grown = lambda b: np.cumprod(np.append(_U(1), np.full(max(n, PIECE) - 1, b, _U)))
            self.powers, self.inverses = grown(BASE), grown(BASE_INVERSE)

    def of(self, column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(first text, texts, bytes with words told apart by spaces, start and end of each word, its hash, its text's number)."""
        if not len(column):
            return
        column = column.cast(pa.large_string())
        _, offsets, data = column.buffers()
        offsets = np.frombuffer(offsets, "<i8")[column.offset : column.offset + len(column) + 1]
        data = np.frombuffer(data or b"", np.uint8)
        first = 0
        while first < len(column):
            stop = max(first + 1, int(np.searchsorted(offsets, offsets[first] + PIECE, "right")) - 1)
            yield first, stop - first, *self.words(WORD_BYTES[data[offsets[first] : offsets[stop]]], offsets[first:stop] - offsets[first])
            first = stop

    def words(self, data: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        n = len(data)
        inside = data != 32
        first = np.zeros(n + 1, bool)
        first[begins] = True
        head, tail = inside.copy(), inside.copy()
        head[1:] &= ~inside[:-1] | first[1:n]
        tail[:-1] &= ~inside[1:] | first[1:n]
        start, end = np.flatnonzero(head), np.flatnonzero(tail) + 1
        self.reach(n)
        upto = np.append(_U(0), np.cumsum(data * self.powers[:n]))
        hashes = mixed((upto[end] - upto[start]) * self.inverses[start] + (end - start).astype(_U))
        return data, start, end, hashes, np.searchsorted(begins, start, "right") - 1


def shingle_keys(hashes: np.ndarray, text: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, key) of each run of k words of one text."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, _U)
    key = np.full(n, k, _U)
    for i in range(k):
        key = mixed(key + hashes[i : i + n])
    at = np.flatnonzero(text[:n] == text[k - 1 :])
    return at, key[at]


def windows_of(items: DataFrame) -> DataFrame:
    """(item, window, size, k, keys) of every window of (item, text): its words, how many, and the keys of its shingles of k words in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces()
        for batch in batches:
            names = batch.column(0).to_pylist()
            for first, n, data, start, end, hashes, text in pieces.of(batch.column(1)):
                edges = np.searchsorted(text, np.arange(n + 1))
                for i in range(n):
                    a, b = edges[i], edges[i + 1]
                    words = [data[s:e].tobytes() for s, e in zip(start[a:b], end[a:b], strict=True)]
                    size = min(WINDOW, len(words))
                    k = min(SHINGLE, size)
                    keys = shingle_keys(hashes[a:b], text[a:b], k)[1].view(np.int64).tolist() if k else []
                    for at in range(0, len(words) - size + 1 if words else 0, 1000):
                        some = range(at, min(at + 1000, len(words) - size + 1))
                        rows = [[names[first + i]] * len(some), [b" ".join(words[j : j + size]).decode() for j in some], [size] * len(some), [k] * len(some), [keys[j : j + size - k + 1] for j in some]]
                        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(rows, (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.list_(pa.int64())), strict=True)], names=["item", "window", "size", "k", "keys"])

    return map_batches(items, run, "item string, window string, size int, k int, keys array<long>")


def shingle_filter(keys: DataFrame, most: int = MAX_BITS) -> np.ndarray:
    """Words of a Bloom filter of the longs `key`: `most` bits at most, built by partial aggregates."""
    bits = 64
    wanted = 16 * keys.count()
    while bits < min(wanted, most):
        bits *= 2
    places = F.array(*[F.shiftrightunsigned("key", s).bitwiseAND(F.lit(bits - 1)) for s in SHIFTS])
    marked = keys.select(F.explode(places).alias("b")).groupBy(F.shiftright("b", 6).alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("b").bitwiseAND(F.lit(63)).cast("int"))).alias("bits"))
    got, out = marked.toArrow(), np.zeros(bits // 64, np.int64)
    out[got.column("w").to_numpy()] = got.column("bits").to_numpy()
    return out.view(_U)


def held(words: np.ndarray, keys: np.ndarray) -> np.ndarray:
    mask, out = _U(64 * len(words) - 1), np.ones(len(keys), bool)
    for s in SHIFTS:
        b = (keys >> _U(s)) & mask
        out &= (words[b >> _U(6)] >> (b & _U(63))) & _U(1) == 1
    return out


def document_counts(texts: DataFrame, kinds: list[int], words) -> DataFrame:
    """(key, n): in how many documents each shingle that passes the filter occurs, over all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, pieces, some, n = words.value, Pieces(), [], 0

        def counted() -> pa.RecordBatch:
            keys, counts = np.unique(np.concatenate([np.zeros(0, _U), *some]), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts)], names=["key", "n"])

        for batch in batches:
            for *_, hashes, text in pieces.of(batch.column(0)):
                for k in kinds:
                    at, keys = shingle_keys(hashes, text, k)
                    hit = held(own, keys)
                    at, keys = at[hit], keys[hit]
                    order = np.lexsort((keys, text[at]))
                    keys, docs = keys[order], text[at[order]]
                    once = np.append(True, (keys[1:] != keys[:-1]) | (docs[1:] != docs[:-1]))[: len(keys)]
                    some.append(keys[once])
                    n += int(once.sum())
            if n > MAX_COUNTS:
                yield counted()
                some, n = [], 0
        yield counted()

    return map_batches(texts, run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def places(rows: DataFrame, kinds: list[int], words) -> DataFrame:
    """(row, doc_id, n_words, at, key, around, back): a row for each row of (row, doc_id, text), where the others are null, and one for each place of a shingle that passes the filter, with the words around it, `back` of them before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, pieces = words.value, Pieces()
        for batch in batches:
            ids, names = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            for first, n, data, start, end, hashes, text in pieces.of(batch.column(2)):
                edges = np.searchsorted(text, np.arange(n + 1))
                row, name = ids[first : first + n], names[first : first + n]
                yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(name, pa.int64()), pa.array(np.diff(edges)), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.string()), pa.nulls(n, pa.int32())], names=columns)
                for k in kinds:
                    at, keys = shingle_keys(hashes, text, k)
                    hit = held(own, keys)
                    at, keys = at[hit], keys[hit]
                    for i in range(0, len(at), 10_000):
                        some = at[i : i + 10_000]
                        doc = text[some]
                        low, high = np.maximum(some - (WINDOW - k), edges[doc]), np.minimum(some + WINDOW, edges[doc + 1])
                        around = [b" ".join(data[a:b].tobytes().split()).decode() for a, b in zip(start[low], end[high - 1], strict=True)]
                        yield pa.RecordBatch.from_arrays([pa.array(row[doc]), pa.array([name[d] for d in doc], pa.int64()), pa.array(edges[doc + 1] - edges[doc]), pa.array(some - edges[doc]), pa.array(keys[i : i + 10_000].view(np.int64)), pa.array(around, pa.string()), pa.array((some - low).astype(np.int32))], names=columns)

    columns = ["row", "doc_id", "n_words", "at", "key", "around", "back"]
    return map_batches(rows, run, "row long, doc_id long, n_words long, at long, key long, around string, back int")


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", max_bits: int = MAX_BITS, salts: int = SALTS, part: int = PART) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated, hits) of every row of docs, of whole texts.

    hits: (start, end) in words of each place where a window occurs, in order. Null texts have no words. Items with null or
    empty texts have no windows; repeated items count once; a null item id is the item ''. Repeated rows are judged each;
    other columns are ignored; texts and items may be of any length; without items nothing is hit; an empty table gives an
    empty one.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), F.col(item_text_col).cast("string").alias("text")).where("text is not null")
    every = materialize(windows_of(items), "bench_windows")
    # items by window: windows of one passage share a set of items, which is told by its digest
    sets = every.groupBy("window").agg(F.any_value("size").alias("size"), F.any_value("k").alias("k"), F.any_value("keys").alias("keys"), F.array_sort(F.collect_set("item")).alias("items"))
    windows = materialize(sets.withColumn("set", F.sha2(F.to_json("items"), 256)), "bench_sets")
    members = windows.groupBy("set").agg(F.any_value("items").alias("items"))
    kinds = sorted(r.k for r in windows.select("k").distinct().collect())  # up to SHINGLE
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    # the rarest shingle of each window, of equal ones the first
    parts = windows.select("window", F.posexplode("keys").alias("offset", "key"))
    known = materialize(parts.select("key").distinct(), "bench_shingles")
    counts = document_counts(rows.select("text"), kinds, spark.sparkContext.broadcast(shingle_filter(known, max_bits)))
    counts = materialize(counts.join(known, "key"), "bench_counts")
    rarest = parts.join(counts, "key", "left").groupBy("window").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "offset", "key")).alias("p"))
    prefix = materialize(windows.select("window", "size", "set").join(rarest, "window").select("window", "size", "set", "p.n", "p.offset", "p.key"), "bench_prefix")
    words = spark.sparkContext.broadcast(shingle_filter(prefix.select("key").distinct(), max_bits))
    found = materialize(places(rows, kinds, words), "bench_places")
    # salted by the prefix's own count, so that a passage in many documents is spread over as many tasks as it needs
    many = prefix.groupBy(F.col("key").alias("hot")).agg(F.max("n").alias("n")).select("hot", F.ceil(F.col("n") / part).cast("int").alias("parts")).where(F.col("parts") > salts)
    many = F.broadcast(many.orderBy(F.desc("parts"), "hot").limit(HOT_KEYS))
    parted = lambda df: df.join(many, F.col("key") == F.col("hot"), "left").withColumn("parts", F.coalesce("parts", F.lit(salts))).drop("hot")
    spread = parted(prefix).select(F.col("key").alias("pk"), "offset", "window", "size", "set", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("ps"))
    met = parted(found.where("at is not null")).withColumn("s", F.pmod(F.xxhash64("row", "at"), F.col("parts")).cast("int")).join(spread, (F.col("key") == F.col("pk")) & (F.col("s") == F.col("ps")))
    start = F.col("at") - F.col("offset")
    fits = (start >= 0) & (start + F.col("size") <= F.col("n_words"))
    same = F.array_join(F.slice(F.split("around", " "), F.col("back") - F.col("offset") + 1, F.col("size")), " ") == F.col("window")
    # a window that lies in the text has its words among those around the prefix
    hits = materialize(met.where(F.when(fits, same).otherwise(False)).select("row", "set", start.alias("start"), (start + F.col("size")).alias("end")), "bench_hits")
    longer = lambda a, h: F.struct((a["n"] + F.greatest(F.lit(0), h["end"] - F.greatest(a["end"], h["start"]))).alias("n"), F.greatest(a["end"], h["end"]).alias("end"))
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))
    spans = hits.groupBy("row").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("hits")).withColumn("n_hit", F.aggregate("hits", zero, longer)["n"])
    pairs = hits.select("row", "set").distinct()
    in_sets = pairs.join(members, "set").select("row", F.explode("items").alias("item")).distinct()
    named = in_sets.groupBy("row").agg(F.count("*").alias("n_items"), F.sha2(F.array_join(F.array_sort(F.collect_list("item")), ","), 256).alias("items_sha256"))
    out = found.where("at is null").select("row", "doc_id", "n_words").join(spans, "row", "left").join(named, "row", "left")
    for done in (every, known, counts):
        discard(done)
    n_hit = F.coalesce("n_hit", F.lit(0))
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0)).alias("n_items"), F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), (n_hit > 0).alias("contaminated"), F.coalesce("hits", F.array().cast("array<struct<start:bigint,end:bigint>>")).alias("hits"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("hits")

"""Exact deduplication through a log-structured merge index of text digests. DataFrame functions only.

Rows fill memtables of a bounded number of rows, in order. Each is flushed as a run: its digests, sorted, with the best row
and the number of rows of each, in Parquet files with Bloom filters on the digest for point lookups (lookup()). Compaction
goes by levels: every FANOUT runs of a level are merged into one of the next, keeping the smallest identifier of the longest
text, until one run is left. While the runs' blocked Bloom filters fit a broadcast, digests that no other run of the group
may hold pass a level without a shuffle. The rows then look their digests up: those that a filter of the repeated digests
rejects are alone, the others are joined exactly, and the texts of these hits are verified byte by byte.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import _bits, block_count, bloom_block, bloom_hit, bloom_table, discard, materialize, table

MEMTABLE_ROWS, FANOUT = 1 << 15, 16
#: Blocks, of 72 bytes, in a broadcast of filters.
MAX_BLOCKS = 1 << 16
SALTS = 16


def normalized(text: Column) -> Column:
    """The text (null: empty) without the characters [\\x20\\x09-\\x0D]."""
    out = F.coalesce(text, F.lit(""))
    for c in " \n\t\r\x0b\x0c":
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def fill_memtables(rows: DataFrame, memtable_rows: int = MEMTABLE_ROWS) -> DataFrame:
    """Adds `run`, the memtable of each row: rows in order of `row`, which is the task's number and the place in it, `memtable_rows` at a time."""
    task, place = F.shiftright("row", 33), F.col("row").bitwiseAND(F.lit((1 << 33) - 1))
    counts = rows.groupBy(task.alias("t")).agg(F.count("*").alias("m"))  # a row for each task that wrote rows
    before = Window.orderBy("t").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("t", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("before"))
    return rows.join(counts, task == F.col("t")).withColumn("run", F.floor((F.col("before") + place) / memtable_rows)).drop("t", "before")


def flush_runs(rows: DataFrame, memtable_rows: int = MEMTABLE_ROWS) -> DataFrame:
    """Writes the runs: (run, digest, best, n), sorted by digest, with Parquet Bloom filters. best: (-code points, doc_id, row) of the row that stays."""
    dealt = fill_memtables(rows, memtable_rows).select("run", "digest", F.struct((-F.col("n_chars")).alias("minus"), "doc_null", "doc_id", "row").alias("best"))
    flushed = dealt.groupBy("run", "digest").agg(F.min("best").alias("best"), F.count("*").alias("n"))
    return _write(flushed, "dedup_runs")


def _write(runs: DataFrame, name: str) -> DataFrame:
    # the files' filters are sized for a memtable's digests; without a number each takes 1 MB
    options = {"parquet.bloom.filter.enabled#digest": "true", "parquet.bloom.filter.expected.ndv#digest": str(MEMTABLE_ROWS)}
    return materialize(runs.sortWithinPartitions("run", "digest"), name, **options)


def lookup(index: DataFrame, digests: list[bytes]) -> DataFrame:
    """Index rows of a few digests: the filter is pushed to the files' Bloom filters and statistics."""
    return index.where(F.col("digest").isin(digests))


def compact(runs: DataFrame, fanout: int = FANOUT, max_blocks: int = MAX_BLOCKS) -> DataFrame:
    """(run, digest, best, n), one row a digest: levels of merged runs until there is one, each level written and the one before deleted."""
    while count := (runs.agg(F.max("run")).first()[0] or 0):
        level = runs.withColumn("to", F.floor(F.col("run") / fanout))
        blocks = block_count(runs.count() // (count + 1), max_blocks)
        if blocks * (count + 1) <= max_blocks:
            level = _mark(level, blocks)
        else:
            level = level.withColumn("elsewhere", F.lit(True))
        met = level.where("elsewhere").groupBy("to", "digest").agg(F.min("best").alias("best"), F.sum("n").alias("n"))
        merged = level.where("not elsewhere").select("to", "digest", "best", "n").unionByName(met)
        new = _write(merged.select(F.col("to").alias("run"), "digest", "best", "n"), "dedup_level")
        discard(runs)
        runs = new
    return runs


def _mark(level: DataFrame, blocks: int) -> DataFrame:
    """Adds `elsewhere`: whether the filter of another run of the same group may hold the digest."""
    words = F.struct("run", *[f"w{i}" for i in range(8)])
    filters = bloom_table(level, "digest", blocks, "to", "run").groupBy("to", "block").agg(F.collect_list(words).alias("filters"))
    bits = _bits(F.col("digest"))

    def holds(f: Column) -> Column:
        hit = f["w0"].bitwiseAND(bits[0]) != 0
        for i in range(1, 8):
            hit = hit & (f[f"w{i}"].bitwiseAND(bits[i]) != 0)
        return hit

    # the row's own run holds it for sure
    probed = level.withColumn("block", bloom_block(F.col("digest"), blocks)).join(F.broadcast(filters), ["to", "block"])
    return probed.withColumn("elsewhere", F.size(F.filter("filters", holds)) > 1).drop("filters", "block")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", memtable_rows: int = MEMTABLE_ROWS, fanout: int = FANOUT, salts: int = SALTS, max_blocks: int = MAX_BLOCKS) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) of every row.

    Of rows with equal normalised texts the one with the most code points in its text stays, then the one with the
    smallest doc_id (null last); of identical rows one stays. Null texts count as empty and are equal to texts of white
    space; texts of any length are read whole. Other columns are ignored; an empty table gives an empty one.
    """
    text = normalized(F.col(text_col))
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.length(text_col), F.lit(0)).alias("n_chars"), text.alias("norm"))
    # `row` tells identical rows apart; it is fixed by writing it once
    rows = base.select("doc_id", F.col("doc_id").isNull().alias("doc_null"), "n_chars", F.unhex(F.sha2("norm", 256)).alias("digest"), F.monotonically_increasing_id().alias("row"))
    rows = materialize(rows, "dedup_rows")
    index = compact(flush_runs(rows, memtable_rows), fanout, max_blocks)
    repeated = materialize(index.where("n > 1").select("digest", "best", "n"), "dedup_repeated")
    blocks = block_count(repeated.count(), max_blocks)
    bloom = F.broadcast(materialize(bloom_table(repeated, "digest", blocks), "dedup_filter"))  # max_blocks bounds it
    probe = lambda df: df.withColumn("block", bloom_block(F.col("digest"), blocks)).join(bloom, "block", "left").withColumn("maybe", bloom_hit(F.col("digest"))).drop("block", *[f"w{i}" for i in range(8)])
    # hits are salted, so that a group of copies is spread over tasks
    groups = repeated.select(F.col("digest").alias("gd"), F.col("best.row").alias("keep_row"), F.col("best.doc_id").alias("keep_id"), "n", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("gs"))
    probed = probe(rows)
    salted = probed.where("maybe").withColumn("salt", F.pmod(F.xxhash64("row", F.lit(3)), F.lit(salts)).cast("int"))
    met = salted.join(groups, (F.col("digest") == F.col("gd")) & (F.col("salt") == F.col("gs")), "left").select("doc_id", "digest", "row", "n", "keep_row", "keep_id")
    alone = probed.where("not maybe").select("doc_id", "digest", "row", *[F.lit(None).cast("long").alias(c) for c in ("n", "keep_row", "keep_id")])
    single = F.col("n").isNull()
    out = met.unionByName(alone).select(
        "doc_id", F.when(single, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        (single | (F.col("row") == F.col("keep_row"))).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"),
    )
    if unequal_bytes(probe(base.select("norm", F.unhex(F.sha2("norm", 256)).alias("digest"))).where("maybe")).limit(1).count():
        raise ValueError("texts with equal SHA-256 digests differ")
    return out


def unequal_bytes(hits: DataFrame) -> DataFrame:
    """Byte verification of (digest, norm): digests whose texts differ (none, unless SHA-256 collides). Each group's texts meet in partial aggregates; the smallest and the largest are equal only if all are."""
    return hits.groupBy("digest").agg(F.min("norm").alias("least"), F.max("norm").alias("most")).where("least <> most")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents"))


OP7_SQL = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n_chars, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER w = 1 AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY n_chars DESC, doc_id)
"""

"""What the corpus operators share: tables, the shared folder, bounded samples, Arrow batches and blocked Bloom filters."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir or, where that is unset and there is one machine (tests), a temporary one."""
    if base := spark.conf.get("spark.checkpoint.dir", None):
        return base.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _own.setdefault("dir", tempfile.mkdtemp(prefix="framespark-"))


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/framespark/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage ends there, and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.options(compression="zstd", **options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._own_path = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes what materialize() wrote, once nothing reads it any more. df must be what it returned; anything else is left alone."""
    if path := df.__dict__.pop("_own_path", None):
        spark = df.sparkSession
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def free_name(name: str, *frames: DataFrame) -> str:
    """A column name that none of the frames has."""
    taken = {c.lower() for f in frames for c in f.columns}
    while name.lower() in taken:
        name += "_"
    return name


def bounded_sample(df: DataFrame, key: str, bound: int, rows: int, seed: int = 7) -> DataFrame:
    """About `bound` of `rows` rows, chosen by a hash of `key` inside the scan (all of them if they are no more): for fitting a model only."""
    share = min(1.0, bound / max(rows, 1))
    return df if share >= 1 else df.where(F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(1_000_003)) < int(share * 1_000_003))


#: Rows in an Arrow batch of texts, unless the session asks for fewer. maxBytesPerBatch (64 MB) bounds batches of long texts.
BATCH_ROWS = 500


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """mapInArrow in batches that keep Python workers small."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name)) <= BATCH_ROWS:
        conf.set(name, BATCH_ROWS)
    return df.mapInArrow(fn, schema)


def crc32_unsigned(column: Column) -> Column:
    return F.crc32(F.encode(F.coalesce(column, F.lit("")), "utf-8"))


# --- blocked Bloom filters -------------------------------------------------------------------------------------------
#: A block is eight 64-bit words. A key chooses one block and sets one bit in each word.
WORDS = 8
BITS_PER_KEY = 12


def block_count(keys: int, most: int) -> int:
    """Blocks for so many keys, at most `most`: beyond that the filter lets more rows pass, and results stay exact."""
    return max(1, min(most, -(-keys * BITS_PER_KEY // (64 * WORDS))))


def _bits(digest: Column) -> list[Column]:
    """One bit for each word, from 6-bit slices of a second hash."""
    h = F.xxhash64(digest, F.lit(11))
    return [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(h, 6 * i).bitwiseAND(F.lit(63)).cast("int")) for i in range(WORDS)]


def bloom_block(digest: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(digest, F.lit(5)), F.lit(blocks))


def bloom_table(keys: DataFrame, digest: str, blocks: int, *by: str) -> DataFrame:
    """(by..., block, w0..w7): the filter as a table, built by a partial aggregate with bit_or. It has at most `blocks` rows for each value of `by`."""
    marked = keys.select(*by, bloom_block(F.col(digest), blocks).alias("block"), *[b.alias(f"w{i}") for i, b in enumerate(_bits(F.col(digest)))])
    return marked.groupBy(*by, "block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)])


def bloom_hit(digest: Column) -> Column:
    """Whether all bits of the key are set in the block's words w0..w7 of the same row (null words: no)."""
    bits = _bits(digest)
    hit = F.col("w0").bitwiseAND(bits[0]) != 0
    for i in range(1, WORDS):
        hit = hit & (F.col(f"w{i}").bitwiseAND(bits[i]) != 0)
    return F.coalesce(hit, F.lit(False))

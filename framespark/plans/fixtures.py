"""The driver's tables as the operators' inputs, in Spark and, as SQL text, in DuckDB."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import index as X

SEED = 42
#: Ids in a bucket.
BUCKET = 1 << 16


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def raw_frames(spark: SparkSession, d: str) -> DataFrame:
    """Embeddings as 8 x 8 frames of one channel; label: pixel > 0.125. Items are numbered in buckets of ids, so no task sorts a file's frames."""
    e = table(spark, d, "embeddings").withColumn("_bucket", F.expr(f"vec_id div {BUCKET}"))
    earlier = Window.partitionBy("label").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = e.groupBy("label", "_bucket").agg(F.count("*").alias("_n")).withColumn("_offset", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    inside = F.row_number().over(Window.partitionBy("label", "_bucket").orderBy("vec_id")) - 1
    e = e.withColumn("_inside", inside).join(offsets.select("label", "_bucket", "_offset"), ["label", "_bucket"])
    item = F.col("_offset") + F.col("_inside")
    return e.select(
        F.col("label").cast("int").alias("file_id"), item.cast("long").alias("item_idx"), F.concat(F.lit("d"), (F.col("vec_id") % 5).cast("string")).alias("detector"), F.lit(1).alias("c"), F.lit(8).alias("h"), F.lit(8).alias("w"),
        F.col("embedding").alias("pixels"), F.transform("embedding", lambda v: (v > 0.125).cast("float")).alias("label"),
    )


def manifest(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select(F.col("label").cast("int").alias("file_id")).distinct()
    return e.select("file_id", F.concat(F.lit("file_"), F.col("file_id").cast("string")).alias("path"))


def index(spark: SparkSession, d: str) -> DataFrame:
    return X.build_index(manifest(spark, d), table(spark, d, "embeddings").select(F.col("label").cast("int").alias("file_id")))


def frames(spark: SparkSession, d: str) -> DataFrame:
    return X.assign_global_ids(raw_frames(spark, d), index(spark, d))


def total(spark: SparkSession, d: str) -> int:
    return table(spark, d, "embeddings").count()  # answered from file footers


def digest(df: DataFrame, column: str = "pixels", *keys: str) -> DataFrame:
    """Keys, number of values, weighted sum and sum of squares of an array column."""
    weighted = F.aggregate(F.transform(F.col(column), lambda v, i: v.cast("double") * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    squares = F.aggregate(F.col(column), F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return df.select(*(keys or ("frame_id",)), F.size(column).cast("long").alias("n"), rounded(weighted).alias("s1"), rounded(squares).alias("s2"))


def rounded(c: Column, digits: int = 6) -> Column:
    return F.round(c, digits) + F.lit(0.0)


#: Frames f(file_id, item_idx, frame_id, vec_id, det, px, lab).
FR = """WITH e AS (SELECT CAST(label AS INT) AS file_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS item_idx, vec_id, list_transform(embedding, lambda v: v::DOUBLE) AS px FROM embeddings),
ix AS (SELECT file_id, count(*) AS n, CAST(sum(count(*)) OVER (ORDER BY file_id) AS BIGINT) - count(*) AS start FROM e GROUP BY file_id),
f AS (SELECT e.file_id, item_idx, start + item_idx AS frame_id, vec_id, 'd' || (vec_id % 5) AS det, px, list_transform(px, lambda v: CASE WHEN v > 0.125 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS lab FROM e JOIN ix ON e.file_id = ix.file_id)
"""


def digest_sql(expression: str, source: str = "f", keys: str = "frame_id", more: str = "") -> str:
    """SQL for digest() of an array expression over a table of FR."""
    return f"{FR}{more}, g AS (SELECT {keys}, {expression} AS v FROM {source}) SELECT {keys}, CAST(len(v) AS BIGINT) AS n, round(list_sum(list_transform(v, lambda x, i: x * i)), 6) + 0.0 AS s1, round(list_sum(list_transform(v, lambda x: x * x)), 6) + 0.0 AS s2 FROM g"


def u_sql(seed, *keys: str) -> str:
    """SQL for rand.u()."""
    return f"(('0x' || substr(md5(concat_ws(':', '{seed}', {', '.join(f'({k})::VARCHAR' for k in keys)})), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


def permuted_sql(n: str, seed: str) -> str:
    """SQL of rand.permuted() for all of 0 .. n - 1 (n a query): (id, pos), by as many steps as the walks need."""
    bits = lambda k, v: f"('0x' || substr(md5('{seed}:{k}:' || {v}::BIGINT::VARCHAR), 1, 8))::BIGINT"
    step = "SELECT id, walk, n, a, b, v % a AS p0, v // a AS q0 FROM r WHERE walk = 0 OR v >= n"
    for k, (half, other) in enumerate([("p0", "q0"), ("q0", "p1"), ("p1", "q1"), ("q1", "p2")]):
        new, size = f"{half[0]}{int(half[1]) + 1}", "a" if half[0] == "p" else "b"
        step = f"SELECT *, ({half} + {bits(k, other)}) % {size} AS {new} FROM ({step})"
    grid = f"SELECT n, a, (n + a - 1) // a AS b FROM (SELECT n, ceil(sqrt(n))::BIGINT AS a FROM ({n}) AS t(n))"
    return f"(WITH RECURSIVE g AS ({grid}), r AS (SELECT id, 0 AS walk, id AS v, n, a, b FROM (SELECT unnest(range(n)) AS id, n, a, b FROM g) UNION ALL SELECT id, walk + 1, q2 * a + p2, n, a, b FROM ({step})) SELECT id, v AS pos FROM r WHERE walk > 0 AND v < n)"


def moved_sql(h: int, w: int, y: str, x: str, px: str = "px", ih: int = 8, iw: int = 8) -> str:
    """SQL for one-channel frames of h x w that take pixel (y, x) of the input, expressions of oy and ox, or 0."""
    y, x = (s.replace("oy", f"(i // {w})").replace("ox", f"(i % {w})") for s in (y, x))
    return f"list_transform(range({h * w}), lambda i: CASE WHEN {y} >= 0 AND {y} < {ih} AND {x} >= 0 AND {x} < {iw} THEN {px}[({y}) * {iw} + {x} + 1] ELSE 0.0::DOUBLE END)"


_own: dict[str, str] = {}


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share: spark.checkpoint.dir or, where that is unset and there is one machine (tests), a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = _own.setdefault("dir", tempfile.mkdtemp(prefix="framespark-"))
    return f"{base.rstrip('/')}/framespark/{name}-{uuid.uuid4().hex}"

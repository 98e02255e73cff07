"""Global index over frames in many files: lengths, prefix sums, lookups and ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def build_index(manifest: DataFrame, frames: DataFrame) -> DataFrame:
    """X1. (file_id, path, n, start, end_excl, error): frames per file and their exclusive prefix sums in manifest order. A file without readable frames keeps its place with n = 0.

    frames needs only file_id, so a scan reads one column. The window runs over the manifest, one row a file.
    """
    counts = frames.groupBy(F.col("file_id").alias("_f")).agg(F.count("*").alias("_n"))
    error = F.col("error") if "error" in manifest.columns else F.when(F.col("_n").isNull(), "no readable frames")
    joined = manifest.join(counts, F.col("file_id") == F.col("_f"), "left").select("file_id", "path", F.coalesce("_n", F.lit(0)).alias("n"), error.alias("error"))
    upto = F.sum("n").over(Window.orderBy("file_id").rowsBetween(Window.unboundedPreceding, 0))
    return joined.select("file_id", "path", "n", (upto - F.col("n")).alias("start"), upto.alias("end_excl"), "error")


def assign_global_ids(frames: DataFrame, index: DataFrame) -> DataFrame:
    """X2. Adds frame_id = start of the file + item_idx. The index joins on file_id; Spark broadcasts it while it is small."""
    starts = index.select(F.col("file_id").alias("_f"), F.col("start").alias("_start"))
    base = frames.drop("frame_id")
    return base.join(starts, F.col("file_id") == F.col("_f")).withColumn("frame_id", F.col("_start") + F.col("item_idx")).drop("_f", "_start")


def locate(ids: DataFrame, index: DataFrame, id_col: str = "id", bucket: int = 1024) -> DataFrame:
    """X3. (id, file_id, path, item_idx, error): the file and item of each global id; ids outside get an error.

    An equi-join on id div bucket, then the range condition, so it never compares every id with every file. A file enters
    once for each bucket that it touches.
    """
    spans = index.where("n > 0").select("file_id", "path", "start", "end_excl", F.explode(F.sequence(F.floor(F.col("start") / bucket), F.floor((F.col("end_excl") - 1) / bucket))).alias("_b"))
    asked = ids.select(F.col(id_col).alias("id"), F.floor(F.col(id_col) / bucket).alias("_a"))
    found = asked.join(spans, (F.col("_a") == F.col("_b")) & (F.col("id") >= F.col("start")) & (F.col("id") < F.col("end_excl")), "left")
    return found.select("id", "file_id", "path", (F.col("id") - F.col("start")).alias("item_idx"), F.when(F.col("file_id").isNull(), "index out of range").alias("error"))


def expand_items(index: DataFrame) -> DataFrame:
    """X4. (file_id, item_idx, frame_id) of every item; files without frames give none."""
    return index.where("n > 0").select("file_id", "start", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("item_idx")).select("file_id", "item_idx", (F.col("start") + F.col("item_idx")).alias("frame_id"))


def file_stats(index: DataFrame) -> DataFrame:
    """X5. (file_id, n, share, total): items of each file and in all."""
    return index.crossJoin(F.broadcast(total_size(index))).select("file_id", "n", (F.col("n") / F.greatest("total", F.lit(1))).alias("share"), "total")


def total_size(index: DataFrame) -> DataFrame:
    """X5. One row: files, readable files and items in all."""
    return index.agg(F.count("*").alias("files"), F.sum((F.col("n") > 0).cast("int")).alias("readable"), F.coalesce(F.sum("n"), F.lit(0)).alias("total"))


def _ranges(spark: SparkSession, n: Column, base: Column, world: int) -> DataFrame:
    q, r, k = F.floor(n / world), n % world, F.col("rank")
    start = base + k * q + F.least(k, r)
    return spark.range(world).select(F.col("id").alias("rank")).select("rank", start.alias("start"), (start + q + (k < r).cast("long")).alias("end_excl"))


def rank_ranges(spark: SparkSession, total: int, world: int, rank: int | None = None) -> DataFrame:
    """X6. (rank, start, end_excl): contiguous ranges of ids, the remainder to the first ranks."""
    if world < 1 or rank is not None and not 0 <= rank < world:
        raise ValueError(f"rank {rank} is not in a world of {world}")
    out = _ranges(spark, F.lit(total), F.lit(0), world)
    return out if rank is None else out.where(F.col("rank") == rank)


def remaining_ranges(spark: SparkSession, total: int, progress: int, world: int) -> DataFrame:
    """X7. Ranges of what is left after `progress` items for a new world size; empty ranges at `progress` if nothing is."""
    if world < 1:
        raise ValueError("a world has one rank or more")
    return _ranges(spark, F.lit(max(total - progress, 0)), F.lit(progress), world)


def check_index(index: DataFrame) -> DataFrame:
    """X17. (check, file_id, detail): violations: repeated paths, gaps or overlaps, wrong lengths. Empty if the index is sound."""
    order = Window.orderBy("file_id")
    seen = index.withColumn("_before", F.lag("end_excl", 1, 0).over(order)).withColumn("_same", F.count("*").over(Window.partitionBy("path")))
    checks = F.array(
        F.when(F.col("_same") > 1, F.struct(F.lit("duplicate path").alias("check"), F.col("path").alias("detail"))),
        F.when(F.col("_before") != F.col("start"), F.struct(F.lit("gap or overlap").alias("check"), F.col("_before").cast("string").alias("detail"))),
        F.when(F.col("end_excl") - F.col("start") != F.col("n"), F.struct(F.lit("length").alias("check"), F.col("n").cast("string").alias("detail"))),
    )
    return seen.select("file_id", F.explode(F.filter(checks, lambda c: c.isNotNull())).alias("v")).select("v.check", "file_id", "v.detail")


def check_frames(frames: DataFrame, assignment: DataFrame | None = None, world: int | None = None) -> DataFrame:
    """X18. (check, id, n): frames with a wrong number of pixels or with null or NaN pixels, and ranks without frames. All rows are checked."""
    size = F.coalesce(F.size("pixels"), F.lit(-1)) != F.col("c") * F.col("h") * F.col("w")
    odd = F.size(F.filter("pixels", lambda x: x.isNull() | F.isnan(x)))
    found = frames.select("frame_id", F.explode(F.filter(F.array(F.when(size, F.struct(F.lit("size").alias("check"), F.coalesce(F.size("pixels"), F.lit(-1)).alias("n"))), F.when(odd > 0, F.struct(F.lit("null or NaN").alias("check"), odd.alias("n")))), lambda v: v.isNotNull())).alias("v"))
    found = found.select("v.check", F.col("frame_id").alias("id"), F.col("v.n").cast("long").alias("n"))
    if assignment is not None:
        ranks = frames.sparkSession.range(world).join(assignment.select(F.col("rank").cast("long").alias("id")).distinct(), "id", "left_anti")
        found = found.unionByName(ranks.select(F.lit("empty rank").alias("check"), "id", F.lit(0).cast("long").alias("n")))
    return found

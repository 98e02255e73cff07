"""Positions in a global order without a global sort."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bucketed_position(df: DataFrame, key: Column, tie: str, by: list[str] | None = None, name: str = "pos", digits: int = 3) -> DataFrame:
    """Adds the rank (from 0) of each row in the order of a hexadecimal key, then `tie`, within `by`.

    Rows are ranked inside buckets of equal leading digits; a bucket's offset is the prefix sum of at most 16**digits
    counts for each group, so no task sees more than a bucket.
    """
    by = by or []
    keyed = df.withColumn("_key", key).withColumn("_bucket", F.substring("_key", 1, digits))
    counts = keyed.groupBy(*by, "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*[F.col(b).alias(f"_o_{b}") for b in by], F.col("_bucket").alias("_o"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(*by, "_bucket").orderBy("_key", tie)
    same = F.col("_bucket") == F.col("_o")
    for b in by:
        same = same & F.col(b).eqNullSafe(F.col(f"_o_{b}"))
    ranked = keyed.withColumn("_inside", F.row_number().over(inside) - 1).join(offsets, same)
    return ranked.withColumn(name, (F.col("_offset") + F.col("_inside")).cast("long")).select(*df.columns, name)


def ordered_position(df: DataFrame, group: str, item: str, name: str = "pos", bucket: int = 1 << 16) -> DataFrame:
    """Adds the rank (from 0) of each row in the order of two whole numbers (group, item).

    Rows are ranked in buckets of `bucket` consecutive items; only the buckets' counts, one row each, are summed in one task.
    """
    keyed = df.withColumn("_bucket", F.floor(F.col(item) / bucket))
    counts = keyed.groupBy(F.col(group).alias("_g"), F.col("_bucket").alias("_b")).agg(F.count("*").alias("_n"))
    offsets = counts.withColumn("_offset", F.coalesce(F.sum("_n").over(Window.orderBy("_g", "_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = F.row_number().over(Window.partitionBy(group, "_bucket").orderBy(item)) - 1
    ranked = keyed.withColumn("_inside", inside).join(offsets, F.col(group).eqNullSafe(F.col("_g")) & F.col("_bucket").eqNullSafe(F.col("_b")))
    return ranked.withColumn(name, (F.col("_offset") + F.col("_inside")).cast("long")).select(*df.columns, name)


def shard_of(pos: Column, n: Column, world: int) -> tuple[Column, Column]:
    """(rank, position in rank) when n rows are cut into `world` contiguous ranges whose sizes differ by one at most, the larger first."""
    q, r = F.floor(n / world), n % world
    cut = r * (q + 1)
    rank = F.when(pos < cut, F.floor(pos / (q + 1))).otherwise(r + F.floor((pos - cut) / F.greatest(q, F.lit(1))))
    local = F.when(pos < cut, pos % (q + 1)).otherwise((pos - cut) % F.greatest(q, F.lit(1)))
    return rank.cast("int"), local.cast("long")

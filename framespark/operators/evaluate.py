"""Losses over batches, ranks and iterations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def drop_none_batches(batches: DataFrame, column: str = "loss") -> DataFrame:
    """P6. Batches that are there."""
    return batches.where(F.col(column).isNotNull())


def batch_loss(losses: DataFrame, column: str = "loss") -> DataFrame:
    """E1. (rank, batch_id, loss, n): mean of a batch's loss map, from an array of pixel losses a row or a number a row; every pixel weighs the same."""
    if dict(losses.dtypes)[column].startswith("array"):
        total = F.aggregate(F.col(column).cast("array<double>"), F.lit(0.0), lambda a, x: a + x)
        sums = losses.select("rank", "batch_id", total.alias("s"), F.size(column).alias("n"))
    else:
        sums = losses.select("rank", "batch_id", F.col(column).alias("s"), F.lit(1).alias("n"))
    return sums.groupBy("rank", "batch_id").agg((F.sum("s") / F.sum("n")).alias("loss"), F.sum("n").alias("n"))


def eval_loss(batches: DataFrame, world: int, weighted: bool = False) -> DataFrame:
    """E2, E3. One row (loss, nan_ranks): the mean over ranks of each rank's mean over its batches that are not NaN.

    A rank without such batches counts as NaN; the divisor is world - nan_ranks + 1e-6, and the loss is null if all are.
    weighted: batches weigh by n, and ranks by their sum.
    """
    good = batches.where(F.col("loss").isNotNull() & ~F.isnan("loss"))
    if weighted:
        got = good.agg((F.sum(F.col("loss") * F.col("n")) / F.sum("n")).alias("loss"), F.count_distinct("rank").alias("ranks"))
        return got.select("loss", (F.lit(world) - F.col("ranks")).alias("nan_ranks"))
    got = good.groupBy("rank").agg(F.avg("loss").alias("m")).agg(F.sum("m").alias("s"), F.count("*").alias("ranks"))
    return got.select((F.col("s") / (F.col("ranks") + 1e-6)).alias("loss"), (F.lit(world) - F.col("ranks")).alias("nan_ranks"))


def limit_batches(batches: DataFrame, max_iter: int | None) -> DataFrame:
    """E4. The first max_iter batches of each rank; 0 or None means all."""
    return batches.where(F.col("batch_id") < max_iter) if max_iter else batches


def best_checkpoints(evaluations: DataFrame, by: list[str] | None = None, bucket: int = 4096) -> DataFrame:
    """E5. Evaluations (step, loss) of a run whose loss is below every earlier one; null and NaN losses never are.

    Each bucket of steps has its least loss, and the running minimum over buckets is the start of the one inside a bucket,
    so no task sorts a run's evaluations.
    """
    by = by or []
    good = evaluations.where(F.col("loss").isNotNull() & ~F.isnan("loss")).withColumn("_bucket", F.floor(F.col("step") / bucket))
    earlier = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    least = good.groupBy(*by, "_bucket").agg(F.min("loss").alias("_least")).withColumn("_earlier", F.min("_least").over(earlier))
    least = least.select(*[F.col(b).alias(f"_e_{b}") for b in by], F.col("_bucket").alias("_e"), "_earlier")
    same = F.col("_bucket").eqNullSafe(F.col("_e"))
    for b in by:
        same = same & F.col(b).eqNullSafe(F.col(f"_e_{b}"))
    inside = Window.partitionBy(*by, "_bucket").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    before = good.join(least, same).withColumn("best_before", F.least(F.min("loss").over(inside), "_earlier"))
    return before.where("best_before is null or loss < best_before").select(*evaluations.columns, "best_before")


def iteration_rollup(batches: DataFrame, k: int, patch: int, flops_per_token: float, peak_flops: float) -> DataFrame:
    """E6. (iteration, loss, tokens, tokens_per_sec, mfu) of windows of k batches, from (rank, batch_id, loss, numel, seconds).

    loss: a window's mean loss, averaged over ranks. Tokens are numel / patch**2, summed over ranks; the time is rank 0's.
    """
    window = F.floor(F.col("batch_id") / k).alias("iteration")
    own = batches.groupBy(window, "rank").agg(F.avg("loss").alias("l"), F.sum(F.col("numel") / patch**2).alias("t"), F.sum("seconds").alias("s"))
    got = own.groupBy("iteration").agg(F.avg("l").alias("loss"), F.sum("t").alias("tokens"), F.max(F.when(F.col("rank") == 0, F.col("s"))).alias("seconds"))
    rate = F.col("tokens") / F.col("seconds")
    return got.select("iteration", "loss", "tokens", rate.alias("tokens_per_sec"), (rate * flops_per_token / peak_flops).alias("mfu"))


def is_last_batch(batch_id: Column, n: Column | int) -> Column:
    """E7."""
    return batch_id + 1 == n

"""The same operators over streams."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions.rank import ordered_position, shard_of
from ..operators.shards import place_in_epoch, redistribute
from ..operators.transforms import Transform, apply_chain
from ..schema import FRAMES


def stream_frames(spark: SparkSession, path: str, transforms: list[Transform], files_per_trigger: int = 100) -> DataFrame:
    """W1. Frames of a growing folder through a chain of transforms. Draws depend on keys alone, so a restart from the checkpoint with other workers goes on with the same rows."""
    return apply_chain(spark.readStream.schema(FRAMES).option("maxFilesPerTrigger", files_per_trigger).parquet(path), transforms)


def write_frames(frames: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """W1. Appends what is there to Parquet files, exactly once, and stops."""
    return frames.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_assigned(frames: DataFrame, sink: Callable[[DataFrame, int], None], world: int, offsets: str, checkpoint: str) -> StreamingQuery:
    """W1. Numbers arriving frames and cuts each micro-batch evenly over `world` ranks: gives `sink` the frames with sample_id, rank and local_pos, and stops when all is read.

    sample_id counts all frames that ever came, by micro-batch and then by (file_id, item_idx), which is a key. The folder
    `offsets` holds for each micro-batch where it starts and how many frames it has, so a restart, with the same or another
    number of ranks, goes on at the exact sample. A micro-batch that failed is given again with the same sample_ids; a sink
    that replaces what it has of a batch_id, as replace_batch() does, has each sample once.
    """

    def one(arrived: DataFrame, batch_id: int) -> None:
        spark = arrived.sparkSession
        first = spark.read.parquet(f"{offsets}/batch_id={batch_id - 1}").selectExpr("first + n").first()[0] if batch_id else 0
        n = arrived.count()
        spark.range(1).select(F.lit(first).cast("long").alias("first"), F.lit(n).cast("long").alias("n")).write.mode("overwrite").parquet(f"{offsets}/batch_id={batch_id}")
        rank, local = shard_of(F.col("_pos"), F.lit(n), world)
        placed = ordered_position(arrived, "file_id", "item_idx", "_pos").withColumns({"sample_id": F.lit(first) + F.col("_pos"), "rank": rank, "local_pos": local})
        sink(placed.drop("_pos"), batch_id)

    return frames.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def replace_batch(path: str) -> Callable[[DataFrame, int], None]:
    """W1. A sink of Parquet files in folders by batch_id; a batch that comes again replaces what is there of it."""

    def write(frames: DataFrame, batch_id: int) -> None:
        frames.drop("batch_id").write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return write


def stream_progress(samples: DataFrame, assigned: DataFrame) -> DataFrame:
    """W2. (rank, processed, epochs) so far, in update or complete mode. assigned: a static (rank, assigned), a row for each rank."""
    a = assigned.select(F.col("rank").alias("_r"), "assigned")
    counts = samples.join(a, F.col("rank") == F.col("_r")).groupBy("rank", "assigned").agg(F.count("*").alias("processed"))
    return counts.select("rank", "processed", F.floor(F.col("processed") / F.greatest("assigned", F.lit(1))).alias("epochs"))


def improvements(evaluations: pd.DataFrame, best: float) -> pd.DataFrame:
    """Evaluations, in order of step, whose loss is below `best` and all earlier ones."""
    seen = evaluations.sort_values(["step", "loss"])
    before = seen["loss"].cummin().shift(fill_value=float("inf")).clip(upper=best).ffill()
    return seen[seen["loss"] < before]


class BestLoss(StatefulProcessor):
    """Emits an evaluation whenever its loss is below all that the run had before."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.best = handle.getValueState("best", "loss double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        best, better = self.best.get()[0] if self.best.exists() else float("inf"), None
        for some in rows:  # of what came so far only improvements can be improvements of the whole
            better = improvements(some if better is None else pd.concat([better, some]), best)
        if better is None:
            return
        if len(better):
            self.best.update((float(better["loss"].min()),))
        yield pd.DataFrame({"run_id": pd.Series([key[0]] * len(better), dtype=object), "step": better["step"].to_numpy(), "loss": better["loss"].to_numpy()})

    def close(self) -> None:
        pass


def stream_best_loss(evaluations: DataFrame) -> DataFrame:
    """W3. (run_id, step, loss) of each strict improvement, append mode. A run's evaluations of one trigger are compared in order of step; NaN never improves."""
    return evaluations.groupBy("run_id").transformWithStateInPandas(BestLoss(), "run_id string, step long, loss double", "append", "None")


def stream_epochs(batches: DataFrame, total: int, world: int, every: int, sink: Callable[[DataFrame, int], None], seed: int, checkpoint: str, keyed: bool = True) -> StreamingQuery:
    """W4. For each micro-batch of frames gives `sink` the frames with their rank and position in the epoch that its number falls in: reshuffled every `every` batches.

    Positions are arithmetic on the ids that arrive; keyed=False takes the order of hashes, for which all ids are ranked anew.
    """

    def one(frames: DataFrame, batch_id: int) -> None:
        epoch = batch_id // every
        if keyed:
            sink(place_in_epoch(frames, total, world, epoch, seed), batch_id)
            return
        assignment = redistribute(frames.sparkSession, total, world, 0, seed + epoch if epoch else None)
        placed = assignment.select(F.col("frame_id").alias("_f"), "rank", "local_pos")
        sink(frames.join(placed, F.col("frame_id") == F.col("_f")).drop("_f").withColumn("epoch", F.lit(epoch)), batch_id)

    return batches.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

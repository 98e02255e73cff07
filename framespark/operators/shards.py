"""Assignment of frames to ranks, epochs, segments and batches. Ids are assigned first; pixels are joined last."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.rand import order_key, permuted, u
from ..functions.rank import bucketed_position, shard_of


def sample_subset(frames: DataFrame, start: int, size: int, total: int, id_col: str = "frame_id") -> DataFrame:
    """P1. Rows of a window of ids, its start clamped at 0 and its end at the total."""
    start = max(start, 0)
    return frames.where((F.col(id_col) >= start) & (F.col(id_col) < min(start + size, total)))


def event_subset(events: DataFrame, wanted: list[int], event_col: str = "event") -> DataFrame:
    """P2. Rows of the listed events with idx, their place in the list; a list that names an event twice gives it twice."""
    asked = events.sparkSession.createDataFrame([(i, e) for i, e in enumerate(wanted)], "idx int, _e long")
    return events.drop("idx").join(asked, F.col(event_col) == F.col("_e")).drop("_e")


def due(iteration: Column, every: Column | int | None, zero_based: bool = True) -> Column:
    """P3. Whether an action of every k-th iteration is due; never if k is null. The counter starts at 0, or at 1."""
    every = F.lit(every).cast("long") if not isinstance(every, Column) else every
    return F.coalesce((iteration + int(zero_based)) % every == 0, F.lit(False))


def ranks(ids: DataFrame, world: int, total: int, seed: int | None = None, id_col: str = "frame_id") -> DataFrame:
    """(frame_id, pos, rank, local_pos) of ids in order, or shuffled by the seed."""
    base = ids.select(F.col(id_col).cast("long").alias("frame_id"))
    ordered = base.withColumn("pos", F.col("frame_id")) if seed is None else bucketed_position(base, order_key(seed, F.col("frame_id")), "frame_id")
    rank, local = shard_of(F.col("pos"), F.lit(total), world)
    return ordered.select("frame_id", "pos", rank.alias("rank"), local.alias("local_pos"))


def redistribute(spark: SparkSession, total: int, world: int, progress: int = 0, seed: int | None = None, keyed: bool = False) -> DataFrame:
    """X8. (frame_id, part, pos, rank, local_pos): ids not yet processed (from progress % total on) and those processed, each cut evenly over ranks; in a rank the remaining ones come first.

    Without a seed positions are arithmetic on the id, without a sort; with one they are bucketed ranks, or, keyed,
    arithmetic on the id again: another order, in which nothing is shuffled.
    """
    at = progress % total if total else 0
    ids = spark.range(total).select(F.col("id").alias("frame_id"), F.when(F.col("id") >= at, "remaining").otherwise("processed").alias("part"))
    if seed is None:
        placed = ids.withColumn("pos", F.when(F.col("part") == "remaining", F.col("frame_id") - at).otherwise(F.col("frame_id")))
    elif keyed:
        placed = ids.withColumn("pos", F.when(F.col("part") == "remaining", permuted(F.col("frame_id") - at, total - at, seed)).otherwise(permuted(F.col("frame_id"), at, seed)))
    else:
        placed = bucketed_position(ids, order_key(seed, F.col("frame_id")), "frame_id", ["part"])
    n = F.when(F.col("part") == "remaining", total - at).otherwise(at)
    rank, local = shard_of(F.col("pos"), n, world)
    # how many remaining ids a rank has before its processed ones
    left = total - at
    before = F.floor(F.lit(left) / world) + (F.col("rank") < left % world).cast("long")
    out = placed.select("frame_id", "part", "pos", rank.alias("rank"), local.alias("_l"))
    return out.select("frame_id", "part", "pos", "rank", (F.col("_l") + F.when(F.col("part") == "processed", before).otherwise(0)).alias("local_pos"))


def shuffle_epoch(spark: SparkSession, total: int, world: int, step: int, every: int | None, seed: int = 0, keyed: bool = False) -> DataFrame:
    """X9. The assignment in force at a step: all ids anew with seed + epoch, where epoch counts the positive multiples of `every` reached; unshuffled before the first, and always without `every`. keyed: in an order that needs no shuffle."""
    epoch = step // every if every and every > 0 else 0
    return redistribute(spark, total, world, 0, seed + epoch if epoch else None, keyed).withColumn("epoch", F.lit(epoch))


def place_in_epoch(frames: DataFrame, total: int, world: int, epoch: int, seed: int = 0, id_col: str = "frame_id") -> DataFrame:
    """X9. Adds rank, local_pos and epoch to any frames of 0 .. total - 1 by arithmetic on their ids: the keyed order of shuffle_epoch(). Other ids are left out."""
    pos = permuted(F.col(id_col), total, seed + epoch) if epoch else F.col(id_col)
    rank, local = shard_of(F.col("_pos"), F.lit(total), world)
    placed = frames.where((F.col(id_col) >= 0) & (F.col(id_col) < total)).withColumn("_pos", pos)
    return placed.withColumns({"rank": rank, "local_pos": local, "epoch": F.lit(epoch)}).drop("_pos")


def segments(ids: DataFrame, seg_size: int, world: int = 1, total: int | None = None, start: int = 0, id_col: str = "frame_id") -> DataFrame:
    """X10, X11, X12. Adds seg, seg_start and seg_end: consecutive windows of seg_size * world ids from `start`, the last one clipped at the total; earlier ids are left out."""
    size = seg_size * world
    seg = F.floor((F.col(id_col) - start) / size)
    end = start + (seg + 1) * size
    out = ids.where(F.col(id_col) >= start) if start else ids
    return out.select("*", seg.alias("seg"), (start + seg * size).alias("seg_start"), (F.least(end, F.lit(total)) if total is not None else end).alias("seg_end"))


def segment_table(spark: SparkSession, total: int, seg_size: int, world: int = 1) -> DataFrame:
    """X10. One row for each of the ceil(total / (seg_size * world)) segments."""
    size = seg_size * world
    return spark.range(-(-total // size)).select(F.col("id").alias("seg"), (F.col("id") * size).alias("seg_start"), F.least((F.col("id") + 1) * size, F.lit(total)).alias("seg_end"))


def next_segment(state: DataFrame, total: int, seg_size: int | None) -> DataFrame:
    """X13. (start, end_excl, next_start, next_end): the window after one, from 0 again at the end; without a size everything."""
    start = F.when(F.col("end_excl") < total, F.col("end_excl")).otherwise(0)
    end = F.lit(total) if seg_size is None else F.least(start + seg_size, F.lit(total))
    return state.select("start", "end_excl", (F.lit(0) if seg_size is None else start).cast("long").alias("next_start"), end.cast("long").alias("next_end"))


def strided_shards(ids: DataFrame, world: int, seed: int | None = None, drop_last: bool = False, seg_col: str = "seg", id_col: str = "frame_id") -> DataFrame:
    """X14. (seg, frame_id, pos, rank): in each segment ids in order or shuffled go to ranks in turn. The tail is dropped, or filled up from the beginning as often as needed, to a multiple of world."""
    base = ids.select(F.col(seg_col).alias("seg"), F.col(id_col).alias("frame_id"))
    key = F.format_string("%016x", F.col("frame_id")) if seed is None else order_key(seed, F.col("frame_id"))
    placed = bucketed_position(base, key, "frame_id", ["seg"], digits=12 if seed is None else 3)
    sizes = base.groupBy(F.col("seg").alias("_s")).agg(F.count("*").alias("_n"))
    sized = placed.join(sizes, F.col("seg").eqNullSafe(F.col("_s")))
    if drop_last:
        out = sized.where(F.col("pos") < F.col("_n") - F.col("_n") % world)
    else:
        short = F.pmod(-F.col("_n"), F.lit(world))
        # a segment of n ids and a short tail of s needs positions n .. n + s - 1, each a repeat of position (p - n) % n
        repeats = F.when(F.col("pos") < short, F.transform(F.sequence(F.lit(0), F.floor((short - 1 - F.col("pos")) / F.col("_n"))), lambda k: F.col("_n") + F.col("pos") + k * F.col("_n"))).otherwise(F.array().cast("array<bigint>"))
        out = sized.withColumn("pos", F.explode(F.concat(F.array("pos"), repeats)))
    return out.select("seg", "frame_id", "pos", (F.col("pos") % world).cast("int").alias("rank"))


def random_eval_segment(frames: DataFrame, total: int, seg_size: int, world: int, step: int, seed: int = 0, id_col: str = "frame_id") -> DataFrame:
    """X15. Rows of one segment whose start is drawn uniformly from [0, max(total - size, 1))."""
    size = seg_size * world
    start = F.floor(u(seed, F.lit(step)) * max(total - size, 1)).cast("long")
    return frames.where((F.col(id_col) >= start) & (F.col(id_col) < start + size)).withColumn("eval_start", start)


def split_files(manifest: DataFrame, ratio: float = 0.8, seed: int = 0) -> DataFrame:
    """X16. Adds split: the first int(n * ratio) files in shuffled order are train, the others eval. The window runs over the manifest."""
    order = Window.orderBy(order_key(seed, F.col("path")), "path")
    n = F.count("*").over(Window.partitionBy())
    return manifest.withColumn("split", F.when(F.row_number().over(order) <= F.floor(n * ratio + 1e-9), "train").otherwise("eval"))


def progress_summary(assignment: DataFrame, processed: int, world: int) -> DataFrame:
    """X19. (rank, assigned, processed, remaining, percent, first_id, last_id, current_id) of each rank that has `processed` samples behind it."""
    done = F.least(F.lit(processed), F.col("assigned"))
    got = assignment.groupBy("rank").agg(F.count("*").alias("assigned"), F.min("frame_id").alias("first_id"), F.max("frame_id").alias("last_id"), F.max(F.when(F.col("local_pos") == processed - 1, F.col("frame_id"))).alias("current_id"))
    every = assignment.sparkSession.range(world).select(F.col("id").cast("int").alias("rank"))
    got = every.join(got, "rank", "left").withColumn("assigned", F.coalesce("assigned", F.lit(0)))
    percent = F.when(F.col("assigned") == 0, 100.0).otherwise(done * 100.0 / F.col("assigned"))
    return got.select("rank", "assigned", done.alias("processed"), (F.col("assigned") - done).alias("remaining"), percent.alias("percent"), "first_id", "last_id", "current_id")


def advance(position: Column, assigned: Column) -> tuple[Column, Column]:
    """X20. (position in the epoch, epochs completed) after `position` samples of a rank that has `assigned`; nothing moves without any."""
    n = F.greatest(assigned, F.lit(1))
    return F.when(assigned > 0, position % n).otherwise(0), F.when(assigned > 0, F.floor(position / n)).otherwise(0)


def make_batches(assignment: DataFrame, size: int, drop_last: bool = False) -> DataFrame:
    """B1. Adds batch_id: consecutive batches of a rank's samples; the short last one can be dropped."""
    out = assignment.withColumn("batch_id", F.floor(F.col("local_pos") / size))
    if drop_last:
        n = assignment.groupBy(F.col("rank").alias("_r")).agg(F.count("*").alias("_n"))
        out = out.join(n, F.col("rank") == F.col("_r")).where(F.col("batch_id") < F.floor(F.col("_n") / size)).drop("_r", "_n")
    return out


def cycle_batches(batches: DataFrame, steps: int) -> DataFrame:
    """B2. (step, ...): a rank's batches of the first pass again and again, for so many steps."""
    n = batches.groupBy(F.col("rank").alias("_r")).agg((F.max("batch_id") + 1).alias("_n"))
    # each batch lists the steps that replay it: no join of all steps with all batches
    replays = F.sequence(F.col("batch_id"), F.lit(steps - 1).cast("long"), F.col("_n"))
    kept = batches.join(n, F.col("rank") == F.col("_r")).where(F.col("batch_id") < steps)
    return kept.withColumn("step", F.explode(replays)).drop("_r", "_n")


def collate(samples: DataFrame) -> DataFrame:
    """B3. (rank, batch_id, n, inputs, targets): a batch as arrays of pixel arrays in order. For export: a batch is bounded by its size."""
    item = F.struct("local_pos", "pixels", "label")
    got = samples.groupBy("rank", "batch_id").agg(F.array_sort(F.collect_list(item)).alias("_i"))
    return got.select("rank", "batch_id", F.size("_i").alias("n"), F.col("_i.pixels").alias("inputs"), F.col("_i.label").alias("targets"))


def accum_windows(batches: DataFrame, k: int) -> DataFrame:
    """B4. (rank, iteration, batches): windows of k batches; the last one counts what it has, which is its divisor."""
    one = batches.select("rank", "batch_id").distinct()
    return one.groupBy("rank", F.floor(F.col("batch_id") / k).alias("iteration")).agg(F.count("*").alias("batches"))

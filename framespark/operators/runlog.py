"""Analytics of training logs: records of a header line and a message, which is k=v pairs or free text."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.arrays import let_all
from ..sources.io import RECORD_HEADER as HEADER
from .shards import due

#: Of a header line: time, rank if the run is distributed, level, logger.
FIELDS = r"^(\d{2}/\d{2}/\d{4} \d{2}:\d{2}:\d{2}) (?:\[RANK (\d+)\] )?([A-Z]+) (.*)$"


def parse_records(logs: DataFrame, text: str = "value") -> DataFrame:
    """R1. (run_id, rank, ts, level, logger, message) of each record: a header line, then the message on the next lines. The single-process form has no rank. Text before the first header is left out.

    Only the header line meets the pattern; a message of any length is cut off as it is.
    """
    parts = F.explode(F.split(F.col(text), rf"(?m)(?=^{HEADER}$)")).alias("r")
    records = logs.select(*([c for c in ("run_id",) if c in logs.columns] or [F.lit(None).cast("string").alias("run_id")]), parts)
    records = records.where(F.col("r").contains("\n")).withColumn("_head", F.substring_index("r", "\n", 1))
    get = lambda i: F.regexp_extract("_head", FIELDS, i)
    message = F.expr("substring(r, instr(r, '\\n') + 1)")
    got = records.where(F.col("_head").rlike(FIELDS))
    return got.select("run_id", F.when(get(2) != "", get(2).cast("int")).alias("rank"), F.to_timestamp(get(1), "MM/dd/yyyy HH:mm:ss").alias("ts"), get(3).alias("level"), get(4).alias("logger"), F.rtrim(F.rtrim(message, F.lit("\n"))).alias("message"))


def parse_kv(records: DataFrame, message: str = "message") -> DataFrame:
    """R2. Adds kv, the map of the k=v pairs between ` | `, and logevent, its value of that name. Text without `=` is no pair, so messages in free text have an empty map; of a repeated key the last value holds."""
    pairs = F.filter(F.split(message, r" \| "), lambda p: p.contains("="))
    keys = F.transform(pairs, lambda p: F.trim(F.substring_index(p, "=", 1)))
    values = F.transform(pairs, lambda p: F.trim(F.substring(p, F.instr(p, "=") + 1, F.length(p))))
    last = let_all({"k": keys, "v": values}, lambda b: F.map_from_entries(F.filter(F.arrays_zip(b["k"], b["v"]), lambda e, i: ~F.array_contains(F.slice(b["k"], i + 2, F.size(b["k"])), e["k"]))))
    kv = F.when(F.size(F.array_distinct(keys)) == F.size(keys), F.map_from_arrays(keys, values)).otherwise(last)
    return records.withColumn("kv", kv).withColumn("logevent", F.try_element_at("kv", F.lit("logevent")))


def _text(key: str) -> Column:
    return F.try_element_at("kv", F.lit(key))


def _number(key: str, to: str = "double") -> Column:
    return _text(key).try_cast(to)


def _of(records: DataFrame, event: str) -> DataFrame:
    """Records of an event. The plain search in the message is pushed below the parsing of pairs, so others aren't parsed."""
    kept = records.where(F.col("message").contains(f"logevent={event}")) if "message" in records.columns else records
    return kept.where(F.col("logevent") == event)


def _rank() -> Column:
    """The header's rank, or that of the message where a single process wrote the header."""
    return F.coalesce("rank", _number("rank", "int")).alias("rank")


def train_curve(records: DataFrame, window: int = 5) -> DataFrame:
    """R3. (run_id, rank, iteration, segment, learning_rates, learning_rate, grad_norm, loss, tokens_per_sec, mfu, accum, smooth_loss) of LOSS:TRAIN records.

    learning_rates has the rate of each parameter group, learning_rate is the first; accum counts the micro-batches since gradients were
    last exchanged; smooth_loss is the mean of the last `window` iterations.
    """
    rates = F.transform(F.split(_text("learning_rate"), ","), lambda r: r.try_cast("double"))
    got = _of(records, "LOSS:TRAIN").select(
        "run_id", _rank(), _number("iteration", "long").alias("iteration"), _text("segment").alias("segment"), rates.alias("learning_rates"), F.try_element_at(rates, F.lit(1)).alias("learning_rate"),
        _number("grad_norm").alias("grad_norm"), _number("mean_train_loss").alias("loss"), _number("tokens_per_sec").alias("tokens_per_sec"), _number("mfu_per_iteration").alias("mfu"), _number("grad_nosync_counter", "int").alias("accum"),
    )
    order = Window.partitionBy("run_id", "rank").orderBy("iteration").rowsBetween(-(window - 1), 0)
    return got.withColumn("smooth_loss", F.avg("loss").over(order))


def activation_stats(records: DataFrame) -> DataFrame:
    """R4. (run_id, iteration, name, pre_mean, pre_std, post_mean, post_std) of DYNAMICS:ACT records, averaged over ranks: a module's values before and after its activation."""
    got = _of(records, "DYNAMICS:ACT")
    keys = {"pre_mean": "preact.mean", "pre_std": "preact.std", "post_mean": "act.mean", "post_std": "act.std"}
    flat = got.select("run_id", _number("iteration", "long").alias("iteration"), _text("name").alias("name"), *[_number(k).alias(c) for c, k in keys.items()])
    return flat.groupBy("run_id", "iteration", "name").agg(*[F.avg(c).alias(c) for c in keys])


def param_update_curve(records: DataFrame) -> DataFrame:
    """R5. (run_id, iteration, type, name, update, ranks) of DYNAMICS:PARAMS records: log10 of the relative size of each parameter's update, averaged over the ranks that logged a finite one. A parameter without any has a null update and 0 ranks."""
    got = _of(records, "DYNAMICS:PARAMS")
    update = _number("update")
    finite = F.when(~F.isnan(update) & (F.abs(update) != float("inf")), update)
    flat = got.select("run_id", _number("iteration", "long").alias("iteration"), _text("type").alias("type"), _text("name").alias("name"), finite.alias("update"))
    return flat.groupBy("run_id", "iteration", "type", "name").agg(F.avg("update").alias("update"), F.count("update").alias("ranks"))


def param_update_stats(params: DataFrame, lr: float) -> DataFrame:
    """R5. (name, percent_update, grad_mean, grad_std) from (name, grad, weight): log10 of std(grad * lr) / std(weight), with sample deviations. Rows without a gradient don't count."""
    got = params.where("grad is not null").groupBy("name").agg(F.stddev_samp(F.col("grad") * lr).alias("u"), F.stddev_samp("weight").alias("w"), F.avg("grad").alias("grad_mean"), F.stddev_samp("grad").alias("grad_std"))
    return got.select("name", F.when((F.col("w") > 0) & (F.col("u") > 0), F.log10(F.col("u") / F.col("w"))).alias("percent_update"), "grad_mean", "grad_std")


def params_matching(params: DataFrame, contains: str | None = None, names: list[str] | None = None, weights_only: bool = False) -> DataFrame:
    """P7. Parameters whose name contains a pattern, is one of a list, or is not a bias."""
    out = params
    if contains is not None:
        out = out.where(F.col("name").contains(contains))
    if names is not None:
        out = out.where(F.col("name").isin(names))
    return out.where(~F.col("name").contains(".bias")) if weights_only else out


def eval_curve(records: DataFrame) -> DataFrame:
    """R6. (run_id, epoch, seg_start, seg_end, train, validation, gap) of LOSS:EVAL records, which are free text: `[RANK r] LOSS:EVAL - epoch E, seg A-B, mean SPLIT loss = L`. Splits of an evaluation with the same segment are one row; repeats are averaged."""
    pattern = r"^\[RANK \d+\] LOSS:EVAL - epoch (\d+), seg (\d+)-(\d+), mean (train|validation) loss = (\S+)$"
    get = lambda i: F.regexp_extract("message", pattern, i)
    got = records.where(F.col("message").contains("LOSS:EVAL") & F.col("message").rlike(pattern)).select("run_id", get(1).cast("int").alias("epoch"), get(2).cast("long").alias("seg_start"), get(3).cast("long").alias("seg_end"), get(4).alias("split"), get(5).try_cast("double").alias("loss"))
    pivoted = got.groupBy("run_id", "epoch", "seg_start", "seg_end").pivot("split", ["train", "validation"]).agg(F.avg("loss"))
    return pivoted.withColumn("gap", F.col("validation") - F.col("train"))


#: A run's id, as its start in UTC or local time writes it; runs of an earlier form lack the seconds.
RUN_ID = r"\d{4}_\d{4}_\d{4}(?:_\d{2})?"


def checkpoint_saves(records: DataFrame) -> DataFrame:
    """R7. (run_id, ts, path, preempt, epoch, end_idx) of each save that a log tells of. A checkpoint's place is in its name, that of a preemptive one only in its record."""
    pattern = r"^(?:Saving checkpoint|\[RANK \d+\] Saving preemptive checkpoint \(epoch (\d+), end_idx (\d+)\)) at (.*)\.$"
    get = lambda i: F.regexp_extract("message", pattern, i)
    got = records.where(F.col("message").contains("Saving ") & F.col("message").rlike(pattern)).select("run_id", "ts", get(3).alias("path"), (get(1) != "").alias("preempt"), get(1).alias("_e"), get(2).alias("_i"))
    named = lambda key: F.regexp_extract("path", rf"\.{key}_(\d+)", 1)
    place = lambda own, key: F.when(F.col("preempt"), F.col(own)).otherwise(named(key)).try_cast("long")
    return got.select("run_id", "ts", "path", "preempt", place("_e", "epoch").cast("int").alias("epoch"), place("_i", "end_idx").alias("end_idx"))


def checkpoint_catalog(paths: DataFrame, saves: DataFrame | None = None) -> DataFrame:
    """R7. (path, prefix, run_id, epoch, end_idx, preempt, latest) of names `{prefix.}{run}.epoch_{e}.end_idx_{i}` and `{prefix.}{run}.preempt`; others are left out.

    A run writes its preemptive checkpoint again and again under one name, without a place: epoch and end_idx are those of its last
    record in saves (checkpoint_saves()), or null. latest: furthest of its run, of equally far ones the preemptive one; one without a known place comes first.
    """
    pattern = rf"(?:^|/)(?:([^/]*)\.)?({RUN_ID})(?:\.epoch_(\d+)\.end_idx_(\d+)|(\.preempt))$"
    get = lambda i: F.regexp_extract("path", pattern, i)
    got = paths.where(F.col("path").rlike(pattern)).select("path", get(1).alias("prefix"), get(2).alias("run_id"), get(3).try_cast("int").alias("epoch"), get(4).try_cast("long").alias("end_idx"), (get(5) != "").alias("preempt"))
    if saves is not None:
        last = saves.where("preempt").groupBy(F.col("path").alias("_p")).agg(F.max_by(F.struct("epoch", "end_idx"), F.struct("ts", "epoch", "end_idx")).alias("_at"))
        got = got.join(last, F.col("preempt") & (F.col("path") == F.col("_p")), "left").withColumns({"epoch": F.coalesce("epoch", "_at.epoch"), "end_idx": F.coalesce("end_idx", "_at.end_idx")}).drop("_p", "_at")
    furthest = got.groupBy(F.col("run_id").alias("_r")).agg(F.max_by("path", F.struct(F.coalesce("epoch", F.lit(-1)), F.coalesce("end_idx", F.lit(-1)), "preempt", "path")).alias("_p"))
    return got.join(furthest, F.col("run_id") == F.col("_r")).withColumn("latest", F.col("path") == F.col("_p")).drop("_r", "_p")


def run_time(run_id: Column) -> Column:
    """R8. Run id yyyy_MMdd_HHmm[_ss] as a timestamp; others are null."""
    return F.coalesce(F.try_to_timestamp(run_id, F.lit("yyyy_MMdd_HHmm_ss")), F.try_to_timestamp(run_id, F.lit("yyyy_MMdd_HHmm")))


def packed_time(ts: Column) -> Column:
    """R8. A timestamp as the integer yyyyMMddHHmmss."""
    return F.date_format(ts, "yyyyMMddHHmmss").cast("long")


def unpacked_time(packed: Column) -> Column:
    return F.to_timestamp(packed.cast("string"), "yyyyMMddHHmmss")


def expected_rate(iteration: Column, base: float, warmup: int, total: int, floor: float = 0.0) -> Column:
    """R9. Learning rate of an iteration: linear up to warmup, then a cosine from the base to the floor, then the floor."""
    cosine = floor + (base - floor) * 0.5 * (1 + F.cos(math.pi * (iteration - warmup) / max(total - warmup, 1)))
    return F.when(iteration < warmup, base * iteration / max(warmup, 1)).when(iteration >= total, floor).otherwise(cosine)


def lr_audit(curve: DataFrame, base: float, warmup: int, total: int, floor: float = 0.0, tolerance: float = 1e-9) -> DataFrame:
    """R9. (run_id, iteration, learning_rate, expected, verdict): a negative rate was logged before the scheduler's first step; others are ok or off."""
    want = expected_rate(F.col("iteration"), base, warmup, total, floor)
    verdict = F.when(F.col("learning_rate") < 0, "not stepped").when(F.abs(F.col("learning_rate") - F.col("expected")) <= tolerance, "ok").otherwise("off")
    return curve.select("run_id", "iteration", "learning_rate", want.alias("expected")).withColumn("verdict", verdict)


def due_events(spark: SparkSession, iterations: int, every: dict[str, int | None], zero_based: bool = True) -> DataFrame:
    """R10. (iteration, action): which iterations trigger which of the named actions."""
    named = F.array(*[F.when(due(F.col("id"), k, zero_based), name) for name, k in every.items()])
    return spark.range(iterations).select(F.col("id").alias("iteration"), F.explode(F.array_compact(named)).alias("action"))

"""Training targets and losses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import let, let_all
from ..functions.rand import u
from .transforms import patch_grid, patchify


def one_hot(classes: Column, k: int) -> Column:
    """L1. k planes of 0 and 1, class by class, of an array of class numbers."""
    return let(classes, lambda y: F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda c: F.transform(y, lambda v: (v == c).cast("int"))))


def softmax(logits: Column) -> Column:
    """L2. Probabilities of class planes: array of k arrays of n values, over the classes of each pixel."""

    def build(z: Column) -> Column:
        pixels = F.sequence(F.lit(0), F.size(z[0]) - 1)
        top = F.transform(pixels, lambda i: F.array_max(F.transform(z, lambda p: F.get(p, i))))

        def shares(t: Column) -> Column:
            sums = F.transform(pixels, lambda i: F.aggregate(z, F.lit(0.0), lambda a, p: a + F.exp(F.get(p, i) - F.get(t, i))))
            return let(sums, lambda s: F.transform(z, lambda p: F.transform(p, lambda v, i: F.exp(v - F.get(t, i)) / F.get(s, i))))

        return let(top, shares)

    return let(logits.cast("array<array<double>>"), build)


def focal_loss(logits: Column, classes: Column, alpha: list[float], gamma: float = 2.0) -> Column:
    """L3. Loss of each pixel: -alpha (1 - p)^gamma ln p of its true class, p kept in [1e-8, 1 - 1e-8]. Classes outside the planes lose nothing."""
    values = {"p": softmax(logits), "y": classes.cast("array<int>"), "a": F.array(*[F.lit(float(a)) for a in alpha])}

    def build(b: Column) -> Column:
        def loss(y: Column, i: Column) -> Column:
            p = F.greatest(F.lit(1e-8), F.least(F.lit(1 - 1e-8), F.get(F.get(b["p"], y), i)))
            return let(p, lambda q: F.when((y >= 0) & (y < len(alpha)), -F.get(b["a"], y) * F.pow(1 - q, F.lit(gamma)) * F.log(q)).otherwise(0.0))

        return F.transform(b["y"], loss)

    return let_all(values, build)


def mask_units(units: DataFrame, ratio: float, seed: int = 0, frame: str = "frame_id", unit: str = "unit") -> DataFrame:
    """L4. Adds keep: the int(n * (1 - ratio)) units of each frame with the smallest noise."""
    order = Window.partitionBy(frame).orderBy(u(seed, F.col(frame), F.col(unit)), unit)
    n = F.count("*").over(Window.partitionBy(frame))
    return units.withColumn("keep", F.row_number().over(order) <= F.floor(n * (1 - ratio) + 1e-9))


def mask_bits(units: Column | int, ratio: float, seed: int = 0, frame: str = "frame_id") -> Column:
    """L4. The same mask in the frame's row: an array of longs, in which bit i % 64 of word i div 64 is 1 if unit i is kept. No rows, window or join."""
    n = (F.lit(units) if isinstance(units, int) else units).cast("int")

    def build(b: Column) -> Column:
        draws = F.transform(F.sequence(F.lit(0), b["n"] - 1), lambda i: F.struct(u(seed, b["f"], i).alias("u"), i.alias("i")))
        kept = F.slice(F.array_sort(draws), F.lit(1), F.floor(b["n"] * (1 - ratio) + 1e-9).cast("int"))
        word = lambda k, j: F.aggregate(F.filter(k, lambda d: F.floor(d["i"] / 64) == j), F.lit(0).cast("long"), lambda a, d: a.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), d["i"] % 64)))
        return F.when(b["n"] > 0, let(kept, lambda k: F.transform(F.sequence(F.lit(0).cast("long"), F.ceil(b["n"] / 64) - 1), lambda j: word(k, j)))).otherwise(F.array().cast("array<bigint>"))

    return let_all({"n": n, "f": F.col(frame)}, build)


def hidden_units(bits: Column, units: Column | int) -> Column:
    """L4. Numbers of the units that a packed mask doesn't keep, in order; units beyond the mask's words are in neither."""
    n = (F.lit(units) if isinstance(units, int) else units).cast("long")
    hidden = lambda b: F.filter(F.sequence(F.lit(0).cast("long"), b["n"] - 1), lambda i: F.getbit(F.get(b["bits"], F.floor(i / 64).cast("int")), (i % 64).cast("int")) == 0)
    return let_all({"n": n, "bits": bits}, lambda b: F.when(b["n"] > 0, hidden(b)).otherwise(F.array().cast("array<bigint>")))


def _standard(values: Column, eps: float = 1e-6) -> Column:
    def build(v: Column) -> Column:
        mean = F.aggregate(v, F.lit(0.0), lambda a, x: a + x) / F.size(v)
        return let(mean, lambda m: let(F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + (x - m) * (x - m)) / (F.size(v) - 1) + eps), lambda d: F.transform(v, lambda x: (x - m) / d)))

    return let(values.cast("array<double>"), build)


def _channels_last(px: Column, c: Column, size: int) -> Column:
    """A patch's values in the order (y, x, channel)."""
    return let_all({"px": px, "c": c}, lambda b: F.transform(F.sequence(F.lit(0), b["c"] * size - 1), lambda i: F.get(b["px"], (i % b["c"] * size + F.floor(i / b["c"])).cast("int"))))


def _hidden_patches(frames: DataFrame, s: int, bits: Column, also: dict[str, Column] | None = None) -> DataFrame:
    ny, nx = patch_grid(s, s)
    more = {f"_{x}": a for x, a in (also or {}).items()}
    own = frames.select("frame_id", "c", "h", "w", "pixels", hidden_units(bits, ny * nx).alias("_hidden"), *[a.alias(x) for x, a in more.items()])
    return patchify(own, s, s, F.col("_hidden"), {x: F.col(f"_{x}") for x in also or {}}).drop("_hidden", *more)


def patch_targets(frames: DataFrame, s: int, mask: DataFrame | None = None, norm: bool = True, bits: Column | None = None) -> DataFrame:
    """L5. (frame_id, patch, target): s x s patches that the mask doesn't keep (all without a mask), values in the order (y, x, channel), standardised by the patch's sample variance if wanted.

    mask: (frame_id, unit, keep), which is joined; bits: a packed mask in the frame's row, with which only the hidden
    patches are cut and nothing is shuffled.
    """
    cut = _hidden_patches(frames, s, bits) if bits is not None else patchify(frames.select("frame_id", "c", "h", "w", "pixels"), s, s)
    if mask is not None:
        hidden = mask.where(~F.col("keep")).select(F.col("frame_id").alias("_f"), F.col("unit").alias("_u"))
        cut = cut.join(hidden, (F.col("frame_id") == F.col("_f")) & (F.col("patch") == F.col("_u")))
    values = _channels_last(F.col("pixels"), F.col("c"), s * s)
    return cut.select("frame_id", "patch", (_standard(values) if norm else values).alias("target"))


def patch_targets_3d(frames: DataFrame, s: int, stride: int, mask: DataFrame | None = None, norm: bool = True, video: str = "video", t: str = "t") -> DataFrame:
    """L6. (video, patch, target): L5 on the first frame of each time stride; patches count over (t, y, x)."""
    some = frames.where(F.col(t) % stride == 0)
    cut = patchify(some.select(F.col(video).alias("frame_id"), F.floor(F.col(t) / stride).alias("_t"), "c", "h", "w", F.col("h").alias("_h"), F.col("w").alias("_w"), "pixels"), s, s)
    per = F.ceil(F.col("_h") / s) * F.ceil(F.col("_w") / s)
    cut = cut.withColumn("patch", F.col("_t") * per + F.col("patch"))
    if mask is not None:
        hidden = mask.where(~F.col("keep")).select(F.col("frame_id").alias("_f"), F.col("unit").alias("_u"))
        cut = cut.join(hidden, (F.col("frame_id") == F.col("_f")) & (F.col("patch") == F.col("_u")))
    values = _channels_last(F.col("pixels"), F.col("c"), s * s)
    return cut.select(F.col("frame_id").alias(video), "patch", (_standard(values) if norm else values).alias("target"))


def masked_mse(targets: DataFrame, predictions: DataFrame) -> DataFrame:
    """L7. One row: mean squared error over the patches of targets, and their number. Both have (frame_id, patch, target or prediction)."""
    p = predictions.select(F.col("frame_id").alias("_f"), F.col("patch").alias("_p"), "prediction")
    both = targets.join(p, (F.col("frame_id") == F.col("_f")) & (F.col("patch") == F.col("_p")))
    square = F.aggregate(F.zip_with("target", "prediction", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, x: a + x)
    return both.agg((F.sum(square) / F.sum(F.size("target"))).alias("loss"), F.count("*").alias("patches"))


def masked_mse_in_rows(frames: DataFrame, s: int, bits: Column, prediction: Column, norm: bool = True) -> DataFrame:
    """L7. The same from frames that have their predictions beside them: an array that holds at place p the values of patch p. Patches without a prediction don't count. Only the sums are shuffled."""
    cut = _hidden_patches(frames, s, bits, {"prediction": prediction}).where("prediction is not null")
    values = _channels_last(F.col("pixels"), F.col("c"), s * s)
    both = cut.select((_standard(values) if norm else values).alias("target"), "prediction")
    square = F.aggregate(F.zip_with("target", "prediction", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, x: a + x)
    return both.agg((F.sum(square) / F.sum(F.size("target"))).alias("loss"), F.count("*").alias("patches"))


def stitch_patches(patches: DataFrame, s: int, grid_h: int, grid_w: int, value: str = "pixels", classes: int = 1) -> DataFrame:
    """L8. (frame_id, c, h, w, pixels): a grid of s x s patches as one map for each class, maps one after another; a missing patch is zeros. A patch has s * s * classes values in the order (y, x, class). A frame gathers its own patches, which are grid_h * grid_w."""
    held = patches.groupBy("frame_id").agg(F.map_from_entries(F.collect_list(F.struct(F.col("patch").cast("int"), F.col(value).cast("array<double>")))).alias("p"))
    h, w = grid_h * s, grid_w * s

    def build(p: Column) -> Column:
        def one(i: Column) -> Column:
            k, y, x = F.floor(i / (h * w)), F.floor(i / w) % h, i % w
            own = F.try_element_at(p, (F.floor(y / s) * grid_w + F.floor(x / s)).cast("int"))
            return F.coalesce(F.get(own, ((y % s * s + x % s) * classes + k).cast("int")), F.lit(0.0))

        return F.transform(F.sequence(F.lit(0), F.lit(classes * h * w - 1)), one)

    return held.select("frame_id", F.lit(classes).alias("c"), F.lit(h).alias("h"), F.lit(w).alias("w"), let(F.col("p"), build).alias("pixels"))


def max_pool_groups(units: DataFrame, stride: int, frame: str = "frame_id", pos: str = "pos", value: str = "value") -> DataFrame:
    """L10. (frame_id, pos, value): the largest of `stride` rows that lie n / stride apart."""
    n = units.groupBy(F.col(frame).alias("_f")).agg(F.floor(F.count("*") / stride).alias("_n"))
    return units.join(n, F.col(frame) == F.col("_f")).groupBy(frame, (F.col(pos) % F.col("_n")).alias(pos)).agg(F.max(value).alias(value))

"""Frame transforms. Each output pixel takes one input pixel or 0, so a transform is one array expression on the pixels and on the label.

Columns: pixels and label are row-major arrays of c * h * w values. Draws are keyed by a column, frame_id if not told
otherwise; batch_id gives a batch one draw. A frame and its label share their draws.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import gather, let, let_all, mean_and_variance, planes, window
from ..functions.rand import gauss, u

Transform = Callable[[DataFrame], DataFrame]


def _mapped(df: DataFrame, h: Column | int, w: Column | int, source: Callable[[Column, Column, Column, Column], Column], given: dict[str, Column] | None = None) -> DataFrame:
    """Frames of h x w whose pixel (y, x) of a channel is that at source(y, x, bound values, channel start) or 0; bound values have h and w of the input."""
    hc, wc = (F.lit(v) if isinstance(v, int) else v for v in (h, w))
    values = {"h": F.col("h"), "w": F.col("w"), "oh": hc, "ow": wc, **(given or {})}

    def at(i: Column, b: Column) -> Column:
        plane = b["oh"] * b["ow"]
        return source(F.floor(i % plane / b["ow"]), i % b["ow"], b, F.floor(i / plane) * b["h"] * b["w"])

    def moved(c: str) -> Column:
        return F.when(F.col(c).isNotNull(), gather(F.col(c), F.col("c") * hc * wc, at, values))

    return df.select(*[moved(x).alias(x) if x in ("pixels", "label") else hc.cast("int").alias(x) if x == "h" else wc.cast("int").alias(x) if x == "w" else F.col(x) for x in df.columns])


def _cut(df: DataFrame, h: Column | int, w: Column | int, top: Column, left: Column) -> DataFrame:
    """Frames of h x w whose corner lies at (top, left) of the input; outside is 0."""
    hc, wc = (F.lit(v) if isinstance(v, int) else v for v in (h, w))

    def moved(x: str) -> Column:
        return F.when(F.col(x).isNotNull(), let_all({**planes(F.col(x), F.col("c")), "oh": hc, "ow": wc, "top": top, "left": left}, lambda b: window(b, b["oh"], b["ow"], b["top"], b["left"])))

    return df.select(*[moved(x).alias(x) if x in ("pixels", "label") else hc.cast("int").alias(x) if x == "h" else wc.cast("int").alias(x) if x == "w" else F.col(x) for x in df.columns])


def _inside(y: Column, x: Column, b: Column, start: Column) -> Column:
    return F.when((y >= 0) & (y < b["h"]) & (x >= 0) & (x < b["w"]), start + y * b["w"] + x)


def cast_pixels(df: DataFrame, to: str = "double") -> DataFrame:
    """P5. Pixels as another number type."""
    return df.withColumn("pixels", F.col("pixels").cast(f"array<{to}>"))


def binarize_label(df: DataFrame, threshold: float = 0.5) -> DataFrame:
    """P4. Labels as 1 above the threshold and 0 else."""
    return df.withColumn("label", F.transform("label", lambda v: (v > threshold).cast("double")))


def pad(df: DataFrame, h: int, w: int, style: str = "center") -> DataFrame:
    """T1. Grows frames to at least h x w with zeros around, or at the bottom and right."""
    if style not in ("center", "bottom-right"):
        raise ValueError(f"pad style {style}")
    oh, ow = F.greatest("h", F.lit(h)), F.greatest("w", F.lit(w))
    half = lambda o, s: F.floor((o - s) / 2) if style == "center" else F.lit(0)
    return _cut(df, oh, ow, -half(oh, F.col("h")), -half(ow, F.col("w")))


def crop(df: DataFrame, h: int, w: int, style: str = "center") -> DataFrame:
    """T2. Cuts frames to h x w around the centre or from the top left; a smaller frame is filled with zeros at the right and bottom."""
    if style not in ("center", "top-left"):
        raise ValueError(f"crop style {style}")
    off = lambda s, o: F.floor(F.greatest(F.col(s) - o, F.lit(0)) / 2) if style == "center" else F.lit(0)
    return _cut(df, h, w, off("h", h), off("w", w))


def downscale_mean(df: DataFrame, fy: int = 2, fx: int = 2) -> DataFrame:
    """T3. Means of fy x fx blocks; rows and columns beyond the last whole block are dropped."""
    oh, ow = F.floor(F.col("h") / fy), F.floor(F.col("w") / fx)

    def means(c: str) -> Column:
        values = {"px": F.col(c).cast("array<double>"), "h": F.col("h"), "w": F.col("w"), "oh": oh, "ow": ow, "n": (F.col("c") * oh * ow).cast("int")}

        def build(b: Column) -> Column:
            def block(i: Column) -> Column:
                plane = b["oh"] * b["ow"]
                start = F.floor(i / plane) * b["h"] * b["w"] + F.floor(i % plane / b["ow"]) * fy * b["w"] + i % b["ow"] * fx
                return reduce(lambda a, k: a + F.get(b["px"], (start + k // fx * b["w"] + k % fx).cast("int")), range(fy * fx), F.lit(0.0)) / (fy * fx)

            return F.when(b["n"] > 0, F.transform(F.sequence(F.lit(0), b["n"] - 1), block)).otherwise(F.array().cast("array<double>"))

        return F.when(F.col(c).isNotNull(), let_all(values, build))

    return df.select(*[means(x).alias(x) if x in ("pixels", "label") else oh.cast("int").alias(x) if x == "h" else ow.cast("int").alias(x) if x == "w" else F.col(x) for x in df.columns])


def random_patch(df: DataFrame, n: int, ph: int, pw: int, var_h: float = 0.0, var_w: float = 0.0, seed: int = 0, key: str = "frame_id", with_mask: bool = False) -> DataFrame:
    """T4. Sets n rectangles to zero: corner uniform in the frame, sides jittered by up to a fraction, clipped at the border. with_mask adds `mask`, 0 where a patch is."""
    k = F.col(key)
    jitter = lambda p, v, name, j: p + F.floor(u(seed, k, F.lit(name), j) * (2 * int(p * min(max(v, 0.0), 1.0)) + 1)) - int(p * min(max(v, 0.0), 1.0))

    def rect(j: Column) -> Column:
        top, left = F.floor(u(seed, k, F.lit("y"), j) * F.col("h")), F.floor(u(seed, k, F.lit("x"), j) * F.col("w"))
        return F.struct(top.alias("t"), left.alias("l"), (top + jitter(ph, var_h, "h", j)).alias("b"), (left + jitter(pw, var_w, "w", j)).alias("r"))

    rects = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), rect) if n else F.array().cast("array<struct<t:bigint,l:bigint,b:bigint,r:bigint>>")

    def kept(c: Column) -> Column:
        def build(b: Column) -> Column:
            plane = b["h"] * b["w"]

            def one(v: Column, i: Column) -> Column:
                y, x = F.floor(i % plane / b["w"]), i % b["w"]
                return F.when(F.exists(b["rects"], lambda r: (y >= r["t"]) & (y < r["b"]) & (x >= r["l"]) & (x < r["r"])), 0.0).otherwise(v)

            return F.transform(b["px"], one)

        return let_all({"px": c.cast("array<double>"), "rects": rects, "h": F.col("h"), "w": F.col("w")}, build)

    ones = F.array_repeat(F.lit(1.0), F.col("c") * F.col("h") * F.col("w"))
    out = df.select(*[kept(F.col(x)).alias(x) if x in ("pixels", "label") else F.col(x) for x in df.columns], *([kept(ones).alias("mask")] if with_mask else []))
    return out


def rotate(df: DataFrame, angle: Column) -> DataFrame:
    """T5. Turns frames about their centre by an angle in degrees: bilinear, zeros outside.

    Output pixel (y, x) takes the input at its place turned back, about ((h - 1) / 2, (w - 1) / 2).
    """
    near = lambda v: F.rint(v * 1e9) / 1e9  # noqa: E731  right angles land on pixels

    def turned(c: str) -> Column:
        values = {"px": F.col(c).cast("array<double>"), "h": F.col("h"), "w": F.col("w"), "n": F.col("c") * F.col("h") * F.col("w"), "my": (F.col("h") - 1) / 2, "mx": (F.col("w") - 1) / 2, "cos": F.cos(F.radians(angle)), "sin": F.sin(F.radians(angle))}

        def build(b: Column) -> Column:
            plane = b["h"] * b["w"]

            def one(i: Column) -> Column:
                y, x = F.floor(i % plane / b["w"]) - b["my"], i % b["w"] - b["mx"]
                back = {"y": near(y * b["cos"] + x * b["sin"] + b["my"]), "x": near(x * b["cos"] - y * b["sin"] + b["mx"])}

                def value(s: Column) -> Column:
                    y0, x0 = F.floor(s["y"]), F.floor(s["x"])
                    out = F.lit(0.0)
                    for yy, wy in ((y0, 1 - (s["y"] - y0)), (y0 + 1, s["y"] - y0)):
                        for xx, wx in ((x0, 1 - (s["x"] - x0)), (x0 + 1, s["x"] - x0)):
                            inside = (yy >= 0) & (yy < b["h"]) & (xx >= 0) & (xx < b["w"])
                            out = out + F.when(inside, wy * wx * F.get(b["px"], (F.floor(i / plane) * plane + yy * b["w"] + xx).cast("int"))).otherwise(0.0)
                    return out

                return let_all(back, value)

            return F.when(b["n"] > 0, F.transform(F.sequence(F.lit(0), b["n"] - 1), one)).otherwise(F.array().cast("array<double>"))

        return F.when(F.col(c).isNotNull(), let_all(values, build))

    return df.select(*[turned(x).alias(x) if x in ("pixels", "label") else F.col(x) for x in df.columns])


def random_rotate(df: DataFrame, angle_max: float = 360.0, seed: int = 0, key: str = "frame_id") -> DataFrame:
    """T5. Rotation by an angle uniform in [0, angle_max)."""
    return rotate(df, u(seed, F.col(key), F.lit("angle")) * angle_max)


def random_shift(df: DataFrame, frac_y: float = 0.01, frac_x: float = 0.01, seed: int = 0, key: str = "frame_id") -> DataFrame:
    """T6. Shifts by trunc(U(-h * f, h * f)) in each axis; what comes in is 0."""
    by = lambda name, size, f: ((2 * u(seed, F.col(key), F.lit(name)) - 1) * F.col(size) * f).cast("int")
    return _cut(df, F.col("h"), F.col("w"), -by("sy", "h", frac_y), -by("sx", "w", frac_x))


def patch_grid(p: int, stride: int) -> tuple[Column, Column]:
    """Numbers of patches down and across a frame of h x w that is padded to multiples of p."""
    up = lambda s: F.ceil(F.col(s) / p) * p
    return F.floor((up("h") - p) / stride) + 1, F.floor((up("w") - p) / stride) + 1


def patch_arrays(x: str, p: int, stride: int, wanted: Column | None = None) -> Column:
    """T7. The patches of a pixel column as an array of arrays in the frame's row, all or those whose numbers are wanted."""
    half = lambda s: F.floor((F.ceil(F.col(s) / p) * p - F.col(s)) / 2)
    ny, nx = patch_grid(p, stride)
    wanted = F.sequence(F.lit(0).cast("long"), ny * nx - 1) if wanted is None else wanted
    values = {**planes(F.col(x), F.col("c")), "nx": nx, "t": half("h"), "l": half("w"), "wanted": wanted}
    each = lambda b: F.transform(b["wanted"], lambda k: window(b, p, p, F.floor(k / b["nx"]) * stride - b["t"], k % b["nx"] * stride - b["l"]))
    return F.when(F.col(x).isNotNull(), let_all(values, each))


def patchify(df: DataFrame, p: int, stride: int, wanted: Column | None = None, also: dict[str, Column] | None = None) -> DataFrame:
    """T7. One row a patch: frames are padded around to multiples of p, then cut into p x p windows at a stride; patch counts row by row.

    A frame's patches are made in its row before they become rows, so no row of a patch carries the frame. wanted: numbers
    of the patches to make; also: further arrays of the frame, of which each patch gets its element.
    """
    ny, nx = patch_grid(p, stride)
    numbers = F.sequence(F.lit(0).cast("long"), ny * nx - 1) if wanted is None else wanted
    cut = [x for x in ("pixels", "label") if x in df.columns]
    parts = [numbers.alias("patch"), *[F.coalesce(patch_arrays(x, p, stride, numbers), F.array().cast("array<array<double>>")).alias(x) for x in cut], *[let_all({"n": numbers, "a": a}, lambda b: F.transform(b["n"], lambda k: F.get(b["a"], k.cast("int")))).alias(x) for x, a in (also or {}).items()]]
    out = df.select(*[x for x in df.columns if x not in (*cut, "h", "w")], F.explode(F.arrays_zip(*parts)).alias("_p"))
    own = {"h": F.lit(p), "w": F.lit(p), **{x: F.col(f"_p.{x}") for x in cut}}
    return out.select(*[own.get(x, F.col(x)).alias(x) for x in df.columns], "_p.patch", *[f"_p.{x}" for x in also or {}])


def _scaled(c: str, mean: Column, std: Column) -> Column:
    return let_all({"px": F.col(c).cast("array<double>"), "m": mean, "s": std}, lambda b: F.transform(b["px"], lambda v: (v - b["m"]) / b["s"]))


def norm_by_detector(df: DataFrame, stats: DataFrame) -> DataFrame:
    """T8. (x - mean) / std of the frame's detector; a frame of an unknown detector gets null pixels and an error. stats has a row for each detector."""
    known = stats.select(F.col("detector").alias("_d"), F.col("mean").alias("_m"), F.col("std").alias("_s"))
    joined = df.join(known, F.col("detector") == F.col("_d"), "left")
    error = F.when(F.col("_d").isNull(), F.concat(F.lit("unknown detector "), F.coalesce("detector", F.lit("null"))))
    return joined.withColumn("pixels", F.when(F.col("_d").isNotNull(), _scaled("pixels", F.col("_m"), F.col("_s")))).withColumn("error", error).drop("_d", "_m", "_s")


def norm_by_file(df: DataFrame, manifest: DataFrame, applies: bool = True) -> DataFrame:
    """T9. (x - mean) / std of the frame's file, from the manifest; pixels stay where it has none, or with applies=False."""
    if not applies:
        return df
    known = manifest.select(F.col("file_id").alias("_f"), F.col("mean").alias("_m"), F.col("std").alias("_s"))
    joined = df.join(known, F.col("file_id") == F.col("_f"), "left")
    scaled = F.when(F.col("_m").isNotNull() & F.col("_s").isNotNull(), _scaled("pixels", F.col("_m"), F.col("_s"))).otherwise(F.col("pixels").cast("array<double>"))
    return joined.withColumn("pixels", scaled).drop("_f", "_m", "_s")


def instance_norm(df: DataFrame, eps: float = 1e-6, scales_variance: bool = True) -> DataFrame:
    """T10. x - mean over the frame and, if wanted, / sqrt(population variance + eps)."""
    scaled = let(F.col("pixels").cast("array<double>"), lambda px: let(mean_and_variance(px), lambda s: let(F.sqrt(s["variance"] + eps), lambda d: F.transform(px, lambda v: (v - s["mean"]) / d if scales_variance else v - s["mean"]))))
    return df.withColumn("pixels", scaled)


def polar_crops(df: DataFrame, hv: int, wv: int, sigma: float = 0.33, n: int = 1, seed: int = 0, key: str = "frame_id") -> DataFrame:
    """T11. n crops a frame, as rows with `crop`, around centres drawn at a uniform angle and a normal distance from the middle; a view larger than the frame is capped."""
    out = df.withColumn("crop", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    vh, vw = F.least(F.lit(hv), F.col("h")), F.least(F.lit(wv), F.col("w"))
    k = [F.col(key), F.col("crop")]
    theta, r = 2 * F.pi() * u(seed, *k, F.lit("theta")), F.abs(gauss(seed, *k, F.lit("r"))) * sigma
    clamp = lambda v: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), v))
    cy = clamp(r * F.cos(theta)) * (F.col("h") - vh) / 2 + F.col("h") / 2
    cx = clamp(r * F.sin(theta)) * (F.col("w") - vw) / 2 + F.col("w") / 2
    return _cut(out, vh, vw, (cy - F.floor(vh / 2)).cast("int"), (cx - F.floor(vw / 2)).cast("int"))


def merge_batch_patch(df: DataFrame, n: int, child: str = "crop") -> DataFrame:
    """T12. Children of frames as frames of their own: frame_id * n + child."""
    return df.withColumn("frame_id", F.col("frame_id") * n + F.col(child)).drop(child)


def split_channels(df: DataFrame) -> DataFrame:
    """T13. One row a channel, with `channel`; frames without channels give none."""
    out = df.select("*", F.explode(F.when(F.col("c") > 0, F.sequence(F.lit(0), F.col("c") - 1)).otherwise(F.array().cast("array<int>"))).alias("channel"))
    size = F.col("h") * F.col("w")
    cut = lambda x: F.slice(F.col(x), F.col("channel") * size + 1, size)
    return out.select(*[cut(x).alias(x) if x in ("pixels", "label") else F.lit(1).alias(x) if x == "c" else F.col(x) for x in out.columns])


def batch_sample(df: DataFrame, fraction: float | None = None, seed: int = 0, batch: str = "batch_id", id_col: str = "frame_id") -> DataFrame:
    """T14. max(int(n * fraction), 1) rows of each batch without replacement; None keeps all."""
    if fraction is None:
        return df
    if not 0 < fraction <= 1:
        raise ValueError(f"sampling fraction {fraction}")
    order = Window.partitionBy(batch).orderBy(u(seed, F.col(batch), F.col(id_col)), id_col)
    ranked = df.withColumn("_r", F.row_number().over(order)).withColumn("_n", F.count("*").over(Window.partitionBy(batch)))
    return ranked.where(F.col("_r") <= F.greatest(F.floor(F.col("_n") * fraction + 1e-9), F.lit(1))).drop("_r", "_n")


def identity(df: DataFrame) -> DataFrame:
    """T15."""
    return df


def apply_chain(df: DataFrame, transforms: list[Transform], threshold: float | None = 0.5, norm: Transform | None = None) -> DataFrame:
    """T16. Transforms in order on pixels and label together, then the label as 0 or 1, then a norm of the pixels. Any DataFrame -> DataFrame callable is a transform (M3)."""
    out = reduce(lambda d, t: d.transform(t), transforms, df)
    out = binarize_label(out, threshold) if threshold is not None and transforms else out
    return out.transform(norm) if norm else out


#: Switches of a chain's settings, in the order in which they act.
CHAIN = ("polar_crops", "merge_batch_patch", "batch_sample", "random_patch", "random_rotate", "random_shift", "instance_norm")


def chain_from_config(settings: dict[str, dict | None]) -> list[Transform]:
    """T17. Transforms of a settings dictionary {name: keyword arguments, or None for off}, in the order of CHAIN whatever order it has."""
    if unknown := set(settings) - set(CHAIN):
        raise ValueError(f"unknown transforms {sorted(unknown)}")
    return [lambda d, f=globals()[name], kw=settings[name]: f(d, **kw) for name in CHAIN if settings.get(name) is not None]


def resize_nearest(df: DataFrame, h: int, w: int) -> DataFrame:
    """L9. Nearest-neighbour resize: the source is floor(y * h_in / h)."""
    return _mapped(df, h, w, lambda y, x, b, s: _inside(F.floor(y * b["h"] / b["oh"]), F.floor(x * b["w"] / b["ow"]), b, s))

"""Array expressions over frames: pixels stay in one array column, and no value is computed once per pixel that isn't one."""

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, fn: Callable[[Column], Column]) -> Column:
    """fn(value) with the value computed once; the optimizer would copy a plain column into every use inside a lambda."""
    return F.transform(F.array(F.struct(value.alias("v"))), lambda b: fn(b["v"]))[0]


def let_all(values: dict[str, Column], fn: Callable[[Column], Column]) -> Column:
    """The same for several values, which fn gets as a struct."""
    return F.transform(F.array(F.struct(*[v.alias(k) for k, v in values.items()])), fn)[0]


def gather(pixels: Column, n: Column | int, source: Callable[[Column, Column], Column], given: dict[str, Column] | None = None, default: float = 0.0) -> Column:
    """Array of n values: value i is pixels[source(i)], or the default where that is null or outside. given: values that source gets, bound once."""
    n = F.lit(n) if isinstance(n, int) else n
    size = n.cast("int")

    def build(b: Column) -> Column:
        at = lambda i: F.get(b["px"], source(i, b).cast("int"))
        return F.when(b["n"] > 0, F.transform(F.sequence(F.lit(0), b["n"] - 1), lambda i: F.coalesce(at(i), F.lit(default).cast("double")))).otherwise(F.array().cast("array<double>"))

    return let_all({"px": pixels.cast("array<double>"), "n": size, **(given or {})}, build)


def plane(h: Column | int, w: Column | int) -> Callable[[Column], tuple[Column, Column, Column]]:
    """index -> (channel, y, x) in arrays of h x w planes."""

    def split(i: Column) -> tuple[Column, Column, Column]:
        hw = h * w
        return F.floor(i / hw), F.floor(i % hw / w), i % w

    return split


def whole(pixels: Column, n: Column) -> Column:
    """Pixels as doubles, n at least; null and absent ones are 0."""
    px = pixels.cast("array<double>")
    filled = F.when(F.exists(px, lambda v: v.isNull()), F.transform(px, lambda v: F.coalesce(v, F.lit(0.0)))).otherwise(px)
    return F.when(F.size(px) < n, F.concat(filled, F.array_repeat(F.lit(0.0), (n - F.size(px)).cast("int")))).otherwise(filled)


def window(b: Column, oh: Column | int, ow: Column | int, top: Column, left: Column) -> Column:
    """Windows of oh x ow, with their corner at (top, left), of the planes of a bound struct (px, c, h, w); outside is 0.

    A row of a window is a slice of px between runs of zeros, so nothing is looked up pixel by pixel.
    """
    oh, ow, top, left = ((F.lit(v) if isinstance(v, int) else v).cast("int") for v in (oh, ow, top, left))
    values = {"oh": oh, "ow": ow, "top": top, "x0": F.greatest(left, F.lit(0)), "zeros": F.least(F.greatest(-left, F.lit(0)), ow), "n": F.greatest(F.least(b["w"], left + ow) - F.greatest(left, F.lit(0)), F.lit(0))}

    def build(v: Column) -> Column:
        none = F.array_repeat(F.lit(0.0), v["ow"])

        def row(i: Column) -> Column:
            y = i % v["oh"] + v["top"]
            start = (F.floor(i / v["oh"]) * b["h"] + y) * b["w"] + v["x0"] + 1
            strip = F.concat(F.array_repeat(F.lit(0.0), v["zeros"]), F.slice(b["px"], start.cast("int"), v["n"]), F.array_repeat(F.lit(0.0), v["ow"] - v["zeros"] - v["n"]))
            return F.when((v["n"] > 0) & (y >= 0) & (y < b["h"]), strip).otherwise(none)

        return F.when(b["c"] * v["oh"] * v["ow"] > 0, F.flatten(F.transform(F.sequence(F.lit(0), b["c"] * v["oh"] - 1), row))).otherwise(F.array().cast("array<double>"))

    return let_all(values, build)


def planes(pixels: Column, c: Column | int = 1) -> dict[str, Column]:
    """What window() wants to have bound, of a frame's row."""
    c = F.lit(c) if isinstance(c, int) else c
    return {"px": whole(pixels, c * F.col("h") * F.col("w")), "c": c.cast("int"), "h": F.col("h").cast("int"), "w": F.col("w").cast("int")}


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def mean_and_variance(values: Column) -> Column:
    """Struct (mean, variance) with the population variance, in two passes."""
    return let(values, lambda v: let(total(v) / F.size(v), lambda m: F.struct(m.alias("mean"), (F.aggregate(v, F.lit(0.0), lambda a, x: a + (x - m) * (x - m)) / F.size(v)).alias("variance"))))

"""Detector geometry, masks and outliers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import gather, let_all, planes, window


def apply_mask(df: DataFrame, mask: DataFrame, mask_value: float = float("nan"), on: str = "panel") -> DataFrame:
    """D1. Keeps pixels where the mask is not 0 and puts mask_value elsewhere. mask: (panel, mask array), a row for each panel; frames of a panel without one stay."""
    m = mask.select(F.col(on).alias("_p"), F.col("mask").alias("_mask"))
    masked = F.when(F.col("_mask").isNull(), F.col("pixels").cast("array<double>")).otherwise(F.zip_with(F.col("pixels").cast("array<double>"), "_mask", lambda v, k: F.when(k != 0, v).otherwise(mask_value)))
    return df.join(m, F.col(on) == F.col("_p"), "left").withColumn("pixels", masked).drop("_p", "_mask")


#: Panels that a detector can have: what is broadcast is a few numbers for each.
MAX_PANELS = 1 << 16


def panel_list(table: DataFrame, *columns: str) -> DataFrame:
    """One row: the panels of a mask or a geometry as an array of structs, each once, to be broadcast. Running it fails beyond MAX_PANELS."""
    got = table.agg(F.count("*").alias("n"), F.collect_list(F.struct(*columns)).alias("all"))
    too_many = F.raise_error(F.concat(F.lit("a detector of "), F.col("n").cast("string"), F.lit(f" panels, more than {MAX_PANELS}")))
    return got.select(F.when(F.col("n") <= MAX_PANELS, F.array_distinct("all")).otherwise(too_many).alias("_panels"))


def prepare_events(events: DataFrame, panels: DataFrame, mask: DataFrame) -> DataFrame:
    """D2. (idx, event, panel, h, w, pixels): every panel of every listed event, in the mask's panels; a missing image is zeros, masked pixels are 0. mask: (panel, h, w, mask), a row for each panel.

    Only the list of panels is broadcast, up to MAX_PANELS numbers; masks are joined by panel.
    """
    asked = events.select("idx", "event").crossJoin(F.broadcast(panel_list(mask, "panel"))).select("idx", "event", F.explode("_panels.panel").alias("_k"))
    asked = asked.join(mask.select("panel", "h", "w", "mask"), F.col("_k").eqNullSafe(F.col("panel"))).drop("_k")
    px = panels.select(F.col("event").alias("_e"), F.col("panel").alias("_p"), F.col("pixels").cast("array<double>").alias("_px"))
    got = asked.join(px, (F.col("event") == F.col("_e")) & (F.col("panel") == F.col("_p")), "left")
    filled = F.coalesce("_px", F.array_repeat(F.lit(0.0), F.size("mask")))
    return got.select("idx", "event", "panel", "h", "w", F.zip_with(filled, "mask", lambda v, k: F.when(k != 0, v).otherwise(0.0)).alias("pixels"))


def select_panel(panels: DataFrame, panel: int | None = None) -> DataFrame:
    """D3. One panel of each event, or all."""
    return panels if panel is None else panels.where(F.col("panel") == panel)


def assemble_panels(frames: DataFrame, pixel_map: DataFrame) -> DataFrame:
    """D4. (frame_id, h, w, c, pixels): pixels scattered to their rounded (x, y, z) on a canvas of extent max - min + 1, from zeros; where two meet the later one stays. pixel_map: one row (x, y, z arrays).

    y runs along rows, x along columns and z over channels, which come first in the result.
    """
    near = lambda c: F.transform(c, lambda v: F.bround(v).cast("int"))
    spots = pixel_map.select(near("x").alias("x"), near("y").alias("y"), near("z").alias("z"))
    low = [F.array_min(a) for a in ("x", "y", "z")]
    size = [F.array_max(a) - F.array_min(a) + 1 for a in ("x", "y", "z")]
    spots = spots.select("*", *[c.alias(n) for c, n in zip((*low, *size), ("x0", "y0", "z0", "w", "h", "c"), strict=True)])
    # for each cell the last pixel that lands there: a table of the detector's size, found once
    cell = lambda s: ((s["z"] - F.col("z0")) * F.col("h") + s["y"] - F.col("y0")) * F.col("w") + s["x"] - F.col("x0")
    zipped = spots.select("h", "w", "c", F.posexplode(F.transform(F.arrays_zip("x", "y", "z"), cell)).alias("i", "cell"))
    last = zipped.groupBy("h", "w", "c", "cell").agg(F.max("i").alias("i"))
    table = last.groupBy("h", "w", "c").agg(F.map_from_entries(F.collect_list(F.struct("cell", "i"))).alias("at"))
    table = table.select("h", "w", "c", F.transform(F.sequence(F.lit(0), F.col("h") * F.col("w") * F.col("c") - 1), lambda k: F.try_element_at("at", k)).alias("_at"))
    joined = frames.select("frame_id", "pixels").crossJoin(F.broadcast(table))  # one row
    return joined.select("frame_id", "h", "w", "c", gather(F.col("pixels"), F.col("h") * F.col("w") * F.col("c"), lambda i, b: F.get(b["at"], i), {"at": F.col("_at")}).alias("pixels"))


def panel_bounds(names: DataFrame) -> DataFrame:
    """D5. (panel, x_min, y_min, x_max, y_max): bounds of the parts named like p0a1, maxima exclusive; other names are left out."""
    panel = F.regexp_extract("name", r"^[a-z](\d+)[a-z](\d+)", 1)
    hits = names.where(F.col("name").rlike(r"^[a-z]\d+[a-z]\d+")).select(panel.cast("int").alias("panel"), "x_min", "y_min", "x_max", "y_max")
    return hits.groupBy("panel").agg(F.min("x_min").alias("x_min"), F.min("y_min").alias("y_min"), (F.max("x_max") + 1).alias("x_max"), (F.max("y_max") + 1).alias("y_max"))


def to_mosaic(panels: DataFrame, geom: DataFrame) -> DataFrame:
    """D6. (event, h, w, pixels): each panel's top left part at its bounds on one canvas, which is as large as the largest bounds; elsewhere 0, and where panels overlap the later one.

    A canvas gathers its event's panels, which are as many as the detector has.
    """
    own = panels.select("event", "panel", "h", "w", F.col("pixels").cast("array<double>").alias("px"))
    held = own.groupBy("event").agg(F.map_from_entries(F.collect_list(F.struct("panel", F.struct("h", "w", "px")))).alias("p"))
    # for each cell the panels whose bounds hold it, with the place in them: a table of the detector's size, found once
    g = geom.agg(F.max("y_max").alias("gh"), F.max("x_max").alias("gw"), F.array_sort(F.collect_list(F.struct("panel", "x_min", "y_min", "x_max", "y_max"))).alias("g"))
    spots = g.select("gw", F.posexplode("g").alias("k", "b")).where("b.y_max > b.y_min and b.x_max > b.x_min")
    spots = spots.select("gw", "k", "b", F.explode(F.sequence(F.col("b.y_min"), F.col("b.y_max") - 1)).alias("y")).select("gw", "k", "b", "y", F.explode(F.sequence(F.col("b.x_min"), F.col("b.x_max") - 1)).alias("x")).where("y >= 0 and x >= 0")
    spots = spots.groupBy((F.col("y") * F.col("gw") + F.col("x")).alias("cell")).agg(F.array_sort(F.collect_list(F.struct("k", (F.col("y") - F.col("b.y_min")).alias("ly"), (F.col("x") - F.col("b.x_min")).alias("lx")))).alias("on"))
    at = spots.agg(F.map_from_entries(F.collect_list(F.struct("cell", "on"))).alias("m"))
    cells = g.crossJoin(at).select("gh", "gw", F.transform("g", lambda b: b["panel"]).alias("names"), F.transform(F.sequence(F.lit(0), F.col("gh") * F.col("gw") - 1), lambda i: F.try_element_at("m", i)).alias("at"))  # one row each
    both = held.crossJoin(F.broadcast(cells))  # one row

    def canvas(b: Column) -> Column:
        def over(a: Column, r: Column) -> Column:
            p = F.get(b["p"], r["k"])
            return F.when((r["ly"] < p["h"]) & (r["lx"] < p["w"]), F.get(p["px"], (r["ly"] * p["w"] + r["lx"]).cast("int"))).otherwise(a)

        return F.transform(b["at"], lambda on: F.when(on.isNull(), 0.0).otherwise(F.aggregate(on, F.lit(0.0), over)))

    values = {"p": let_all({"p": F.col("p"), "names": F.col("names")}, lambda b: F.transform(b["names"], lambda n: F.try_element_at(b["p"], n))), "at": F.col("at")}
    return both.select("event", F.col("gh").alias("h"), F.col("gw").alias("w"), let_all(values, canvas).alias("pixels"))


def from_mosaic(mosaics: DataFrame, geom: DataFrame) -> DataFrame:
    """D7. (event, panel, h, w, pixels): the canvas cut back into panels by their bounds, 0 beyond it; a canvas without pixels gives panels without. geom: up to MAX_PANELS rows of other bounds."""
    panels = panel_list(geom, "panel", "x_min", "y_min", "x_max", "y_max")
    both = mosaics.select("event", "h", "w", "pixels").crossJoin(F.broadcast(panels))

    def cut(b: Column) -> Column:
        """All panels in the mosaic's row: no row of a panel carries the mosaic."""

        def one(g: Column) -> Column:
            h, w = g["y_max"] - g["y_min"], g["x_max"] - g["x_min"]
            return F.struct(g["panel"].alias("panel"), h.alias("h"), w.alias("w"), window(b, h, w, g["y_min"], g["x_min"]).alias("pixels"))

        return F.transform(b["panels"], one)

    return both.select("event", F.inline(let_all({**planes(F.col("pixels")), "panels": F.col("_panels")}, cut)))


def peaks_to_mosaic(peaks: DataFrame, geom: DataFrame) -> DataFrame:
    """D8. Adds mosaic_y and mosaic_x to (panel, y, x); a peak on an unknown panel gets nulls and an error."""
    g = geom.select(F.col("panel").alias("_p"), F.col("x_min").alias("_x"), F.col("y_min").alias("_y"))
    error = F.when(F.col("_p").isNull(), "unknown panel")
    return peaks.join(g, F.col("panel") == F.col("_p"), "left").withColumn("mosaic_y", F.col("y") + F.col("_y")).withColumn("mosaic_x", F.col("x") + F.col("_x")).withColumn("error", error).drop("_p", "_x", "_y")


#: Rows on either side of a rank that the quantile sketch may miss it by, as a share of a group's rows.
SKETCH = 1e-4


def exact_percentiles(df: DataFrame, value: str, by: list[str], shares: list[float]) -> DataFrame:
    """(by..., q0, q1, ...): percentiles of each group, linear between neighbours, exact, in bounded memory.

    A quantile sketch brackets each rank; rows below a bracket are counted, the few in it are counted by value, and the
    next values beyond its ends serve ranks that fall just outside. Null and NaN values: nulls don't count, NaN is the
    largest. A group without values has nulls.
    """
    v = df.select(*by, F.col(value).cast("double").alias("v")).where("v is not null")
    ends = [min(1.0, max(0.0, p + e)) for p in shares for e in (-2 * SKETCH, 2 * SKETCH)]
    g = v.groupBy(*by).agg(F.count("*").alias("n"), F.percentile_approx("v", ends, int(1 / SKETCH)).alias("ends"))
    name = lambda k: [F.col(b).alias(f"_{b}{k}") for b in by]
    same = lambda k: [F.col(b).eqNullSafe(F.col(f"_{b}{k}")) for b in by]
    joined = lambda left, right, k: (left.join(right.select(*name(k), *[c for c in right.columns if c not in by]), same(k)) if by else left.crossJoin(right)).drop(*[f"_{b}{k}" for b in by])  # noqa: E731  without groups: one row
    wide = joined(v, g, 1)
    beyond = wide.groupBy(*by).agg(*[c for i in range(len(shares)) for c in (F.max(F.when(F.col("v") < F.col("ends")[2 * i], F.col("v"))).alias(f"a{i}"), F.min(F.when(F.col("v") > F.col("ends")[2 * i + 1], F.col("v"))).alias(f"b{i}"))])
    bounds = joined(g, beyond, 2).select(*by, "n", F.array(*[F.struct(F.coalesce(f"a{i}", F.col("ends")[2 * i]).alias("lo"), F.coalesce(f"b{i}", F.col("ends")[2 * i + 1]).alias("hi"), F.floor(F.lit(p) * (F.col("n") - 1)).alias("rank"), (F.lit(p) * (F.col("n") - 1)).alias("at")) for i, p in enumerate(shares)]).alias("w"))
    # rows by value inside a bracket, all rows below it as one
    told = joined(v, bounds, 3).select(*by, "v", F.posexplode("w").alias("i", "w")).where("v <= w.hi")
    counts = told.groupBy(*by, "i", "w", F.when(F.col("v") >= F.col("w.lo"), F.col("v")).alias("v")).agg(F.count("*").alias("m"))
    upto = F.sum("m").over(Window.partitionBy(*by, "i").orderBy(F.col("v").asc_nulls_first()))
    ranked = counts.withColumn("upto", upto).where("v is not null")
    held = lambda r: F.min(F.when(F.col("upto") > r, F.struct("upto", "v"))).getField("v")
    found = ranked.groupBy(*by, "i").agg(held(F.col("w.rank")).alias("x"), held(F.col("w.rank") + 1).alias("y"), F.max(F.col("w.at") - F.col("w.rank")).alias("f"))
    found = found.select(*by, "i", F.when(F.col("f") == 0, F.col("x")).otherwise((1 - F.col("f")) * F.col("x") + F.col("f") * F.col("y")).alias("q"))
    return found.groupBy(*by).agg(*[F.max(F.when(F.col("i") == i, F.col("q"))).alias(f"q{i}") for i in range(len(shares))])


def zero_outliers(df: DataFrame, value: str, by: list[str], percentile: float = 5.0) -> DataFrame:
    """D9. Adds kept: the value, or 0 outside the fence of 1.5 spreads beyond the p-th and (100 - p)-th percentiles of its group. The percentiles are exact."""
    p = percentile / 100
    q = exact_percentiles(df, value, by, [p, 1 - p]).select(*[F.col(b).alias(f"_{b}") for b in by], F.col("q0").alias("_q1"), F.col("q1").alias("_q3"))
    on = [F.col(b).eqNullSafe(F.col(f"_{b}")) for b in by]
    spread = 1.5 * (F.col("_q3") - F.col("_q1"))
    inside = (F.col(value) >= F.col("_q1") - spread) & (F.col(value) <= F.col("_q3") + spread)
    joined = df.join(q, on, "left") if by else df.crossJoin(q)  # one row
    return joined.withColumn("kept", F.when(inside, F.col(value)).otherwise(0.0)).drop("_q1", "_q3", *[f"_{b}" for b in by])

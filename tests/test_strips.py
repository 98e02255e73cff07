"""Windows made of slices, and masks packed in the frame's row."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from framespark.operators import detector as D
from framespark.operators import targets as L
from framespark.operators import transforms as T
from framespark.schema import FRAMES


def some(spark, *pixels, h=5, w=7, c=1, label=None):
    return spark.createDataFrame([(0, k, k, "d", c, h, w, p, label) for k, p in enumerate(pixels)], FRAMES)


def cut_np(a, h, w, top, left):
    out = np.zeros((len(a), h, w))
    for y in range(h):
        for x in range(w):
            if 0 <= y + top < a.shape[1] and 0 <= x + left < a.shape[2]:
                out[:, y, x] = a[:, y + top, x + left]
    return out.ravel().tolist()


@pytest.mark.parametrize("h,w,top,left", [(5, 7, 0, 0), (3, 2, 1, 4), (9, 11, -2, -2), (4, 4, -3, 5), (2, 2, 7, 0), (2, 2, 0, 7), (2, 2, -2, 0), (2, 2, 0, -9), (1, 30, 4, -10), (0, 3, 0, 0), (3, 0, 0, 0)])
def test_windows_anywhere(spark, h, w, top, left):
    a = np.arange(1.0, 71.0).reshape(2, 5, 7)
    got = T._cut(some(spark, a.ravel().tolist(), c=2), h, w, F.lit(top), F.lit(left)).first()
    assert got.pixels == cut_np(a, h, w, top, left) and (got.h, got.w, got.label) == (h, w, None)


def test_windows_of_incomplete_frames(spark):
    """Null pixels and those that an array lacks are 0; a frame without pixels has none; without channels it is empty."""
    holed = [None if k % 3 == 0 else float(k) for k in range(35)]
    rows = T.pad(some(spark, holed, [1.0, 2.0], [], None), 6, 7, "bottom-right").orderBy("frame_id").collect()
    assert rows[0].pixels == [v or 0.0 for v in holed] + [0.0] * 7
    assert rows[1].pixels == [1.0, 2.0] + [0.0] * 40 and rows[2].pixels == [0.0] * 42 and rows[3].pixels is None
    assert T.crop(some(spark, [], c=0), 2, 2).first().pixels == []


def test_patches_of_frames_without_labels_or_pixels(spark):
    rows = T.patchify(some(spark, [float(k) for k in range(35)], None), 4, 2).collect()
    assert len(rows) == 2 * 3 * 3 and {r.label for r in rows} == {None} and sum(r.pixels is None for r in rows) == 9
    assert {(r.h, r.w) for r in rows} == {(4, 4)} and sorted(r.patch for r in rows if r.frame_id == 0) == list(range(9))
    a = np.pad(np.arange(35.0).reshape(5, 7), ((1, 2), (0, 1)))
    for r in rows[:9]:
        y, x = r.patch // 3 * 2, r.patch % 3 * 2
        assert r.pixels == a[y : y + 4, x : x + 4].ravel().tolist()


def test_panels_beyond_the_mosaic_are_zeros(spark):
    mosaic = spark.createDataFrame([(1, 2, 3, [1.0, 2.0, 3.0, 4.0, 5.0, 6.0], "extra")], "event int, h int, w int, pixels array<double>, panel string")
    geom = spark.createDataFrame([(0, 1, 0, 3, 2), (1, 2, 1, 4, 3)], "panel int, x_min int, y_min int, x_max int, y_max int")
    got = {r.panel: r.pixels for r in D.from_mosaic(mosaic, geom).collect()}
    assert got == {0: [2.0, 3.0, 5.0, 6.0], 1: [6.0, 0.0, 0.0, 0.0]}


@pytest.mark.parametrize("n,ratio", [(1, 0.6), (16, 0.0), (16, 1.0), (63, 0.5), (64, 0.5), (65, 0.25), (200, 0.6), (0, 0.5)])
def test_packed_masks_are_those_of_rows(spark, n, ratio):
    frames = spark.range(5).withColumnRenamed("id", "frame_id")
    packed = {r.frame_id: r.hidden for r in frames.select("frame_id", L.hidden_units(L.mask_bits(n, ratio, 3), n).alias("hidden")).collect()}
    if n == 0:
        assert set(map(tuple, packed.values())) == {()}
        return
    units = frames.select("frame_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("unit"))
    rows = L.mask_units(units, ratio, 3).where("not keep").collect()
    assert packed == {f: sorted(r.unit for r in rows if r.frame_id == f) for f in range(5)}


def test_targets_of_packed_masks_need_no_shuffle(spark, tmp_path):
    some(spark, *[np.random.default_rng(k).normal(size=128).tolist() for k in range(6)], h=8, w=8, c=2).write.parquet(str(tmp_path / "f"))
    frames = spark.read.parquet(str(tmp_path / "f"))
    bits = L.mask_bits(16, 0.6, 1)
    targets = L.patch_targets(frames, 2, bits=bits)
    plan = targets._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan and "Join" not in plan
    units = frames.select("frame_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(15).cast("long"))).alias("unit"))
    want = {(r.frame_id, r.patch): r.target for r in L.patch_targets(frames, 2, L.mask_units(units, 0.6, 1)).collect()}
    assert {(r.frame_id, r.patch): r.target for r in targets.collect()} == want and len(want) == 6 * 10
    guesses = frames.withColumn("guess", F.transform(F.sequence(F.lit(0), F.lit(15)), lambda p: F.when(p != 3, F.array_repeat(F.lit(0.5), 8))))
    got = L.masked_mse_in_rows(guesses, 2, bits, F.col("guess")).first()
    counted = [np.array(t) for (_, p), t in want.items() if p != 3]
    assert got.patches == len(counted) and got.loss == pytest.approx(np.mean([(t - 0.5) ** 2 for t in counted]))


def test_more_panels_than_the_bound_fail(spark, monkeypatch):
    monkeypatch.setattr(D, "MAX_PANELS", 2)
    mosaic = spark.createDataFrame([(1, 1, 1, [1.0])], "event int, h int, w int, pixels array<double>")
    geom = spark.createDataFrame([(k, 0, 0, 1, 1) for k in range(3)], "panel int, x_min int, y_min int, x_max int, y_max int")
    assert D.from_mosaic(mosaic, geom.limit(2)).count() == 2
    with pytest.raises(Exception, match="a detector of 3 panels"):
        D.from_mosaic(mosaic, geom).collect()


def test_events_get_the_masks_of_their_panels(spark):
    events = spark.createDataFrame([(0, 7), (1, 7), (2, 8)], "idx int, event long")
    panels = spark.createDataFrame([(7, 0, [1.0, 2.0])], "event long, panel int, pixels array<double>")
    mask = spark.createDataFrame([(0, 1, 2, [0, 1]), (1, 1, 2, [1, 1])], "panel int, h int, w int, mask array<int>")
    rows = {(r.idx, r.panel): r.pixels for r in D.prepare_events(events, panels, mask).collect()}
    assert rows == {(i, p): [0.0, 2.0] if (i < 2 and p == 0) else [0.0, 0.0] for i in range(3) for p in range(2)}

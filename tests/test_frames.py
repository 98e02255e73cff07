"""Golden frames, invariants and the cases that the SQL comparison can't reach."""

import json
import math
import random
import struct
import zlib
from datetime import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from framespark.functions import arrays as A
from framespark.operators import detector as D
from framespark.operators import evaluate as E
from framespark.operators import index as X
from framespark.operators import runlog as R
from framespark.operators import scoring as M
from framespark.operators import shards as B
from framespark.operators import targets as L
from framespark.operators import transforms as T
from framespark.schema import FRAMES
from framespark.sources import io as S
from framespark.streaming import streams as W


def frame(spark, img, label=None, fid=0, det="d"):
    img = np.asarray(img, float)
    c, h, w = (1, *img.shape) if img.ndim == 2 else img.shape
    lab = None if label is None else [float(v) for v in np.asarray(label, float).ravel()]
    return spark.createDataFrame([(0, fid, fid, det, c, h, w, [float(v) for v in img.ravel()], lab)], FRAMES)


def one(df, column="pixels"):
    r = df.first()
    return np.array(r[column], float).reshape(-1, r["h"], r["w"]).squeeze()


RAMP = np.arange(16).reshape(4, 4)
ODD = np.arange(35).reshape(5, 7)
SMALL = np.arange(6).reshape(2, 3)


# --- transforms ---
def pad_np(a, h, w, style="center"):
    out = np.zeros((max(a.shape[0], h), max(a.shape[1], w)))
    t, left = ((out.shape[0] - a.shape[0]) // 2, (out.shape[1] - a.shape[1]) // 2) if style == "center" else (0, 0)
    out[t : t + a.shape[0], left : left + a.shape[1]] = a
    return out


@pytest.mark.parametrize("a", [RAMP, ODD, SMALL])
def test_pad_and_crop(spark, a):
    for style in ("center", "bottom-right"):
        assert (one(T.pad(frame(spark, a, a), 6, 5, style)) == pad_np(a, 6, 5, style)).all()
    got = one(T.crop(frame(spark, a, a), 3, 4), "label")
    t, left = max(a.shape[0] - 3, 0) // 2, max(a.shape[1] - 4, 0) // 2
    want = np.zeros((3, 4))
    cut = a[t : t + 3, left : left + 4]
    want[: cut.shape[0], : cut.shape[1]] = cut
    assert (got == want).all()
    for bad in (lambda: T.pad(frame(spark, a), 6, 6, "left"), lambda: T.crop(frame(spark, a), 2, 2, "bottom-right")):
        with pytest.raises(ValueError):
            bad()


def test_downscale_drops_the_remainder(spark):
    assert np.allclose(one(T.downscale_mean(frame(spark, ODD))), ODD[:4, :6].reshape(2, 2, 3, 2).mean(axis=(1, 3)))
    two = np.stack([RAMP, RAMP + 100])
    assert np.allclose(one(T.downscale_mean(frame(spark, two))), two.reshape(2, 2, 2, 2, 2).mean(axis=(2, 4)))


def test_instance_norm(spark):
    z = one(T.instance_norm(frame(spark, ODD)))
    assert np.allclose(z, (ODD - ODD.mean()) / np.sqrt(ODD.var() + 1e-6))
    assert (one(T.instance_norm(frame(spark, np.full((3, 3), 7)))) == 0).all()
    assert np.allclose(one(T.instance_norm(frame(spark, ODD), scales_variance=False)), ODD - ODD.mean())
    assert np.isnan(one(T.instance_norm(frame(spark, [[1.0, math.nan]])))).all()


def test_statistics_are_not_recomputed_for_each_pixel(spark):
    plan = T.instance_norm(frame(spark, ODD))._jdf.queryExecution().optimizedPlan().toString()
    pixel = plan[plan.rindex("transform(") :]
    assert pixel.count("aggregate(") == 0


@pytest.mark.parametrize("angle", [0, 90, 180, 270, 360])
def test_rotate_by_right_angles(spark, angle):
    assert np.allclose(one(T.rotate(frame(spark, RAMP, RAMP), F.lit(float(angle)))), np.rot90(RAMP, angle // 90))


def test_rotate_is_bilinear(spark):
    got = one(T.rotate(frame(spark, np.eye(5)), F.lit(45.0)))
    assert abs(got[2, 2] - 1) < 1e-6 and got[0, 0] == 0 and np.allclose(got, got[::-1, ::-1], atol=1e-6)


def test_shift_patch_and_polar_share_draws(spark):
    df = frame(spark, ODD + 1, ODD + 1)
    for t in (lambda d: T.random_shift(d, 0.5, 0.5, 3), lambda d: T.random_patch(d, 2, 2, 3, 0.5, 0.5, 3), lambda d: T.polar_crops(d, 3, 3, n=4, seed=3), lambda d: T.random_rotate(d, 360.0, 3)):
        for r in t(df).collect():
            assert r.pixels == r.label
    masked = T.random_patch(df, 2, 2, 3, seed=1, with_mask=True).first()
    assert [v * m for v, m in zip((ODD + 1).ravel(), masked.mask, strict=True)] == masked.pixels and 0 in masked.mask
    big = T.polar_crops(df, 99, 99).first()
    assert (big.h, big.w) == (5, 7) and big.pixels == [float(v) for v in (ODD + 1).ravel()]


def test_shift_moves_and_fills(spark):
    got = one(T.random_shift(frame(spark, np.ones((10, 10))), 0.5, 0.0, 1))
    lost = int((got.sum(axis=1) == 0).sum())
    assert got.sum() == 100 - 10 * lost and set(np.unique(got)) <= {0.0, 1.0}


def test_patchify_then_stitch(spark):
    patches = T.patchify(frame(spark, ODD), 4, 4)
    back = one(L.stitch_patches(patches, 4, 2, 2))
    want = np.zeros((8, 8))
    want[1:6, 0:7] = ODD
    assert (back == want).all()
    assert T.patchify(frame(spark, RAMP), 2, 1).count() == 9


def test_channels_and_children(spark):
    two = np.stack([RAMP, RAMP + 100])
    parts = {r.channel: r for r in T.split_channels(frame(spark, two, two)).collect()}
    assert parts[1].c == 1 and parts[1].pixels == [float(v) for v in (RAMP + 100).ravel()] == parts[1].label
    assert T.merge_batch_patch(T.polar_crops(frame(spark, RAMP, fid=5), 2, 2, n=3), 3).agg(F.min("frame_id"), F.max("frame_id")).first() == (15, 17)


def test_batch_sample(spark):
    df = spark.range(25).select(F.col("id").alias("frame_id"), (F.col("id") / 10).cast("int").alias("batch_id"))
    got = {r.batch_id: r["count"] for r in T.batch_sample(df, 0.3).groupBy("batch_id").count().collect()}
    assert got == {0: 3, 1: 3, 2: 1}
    assert T.batch_sample(df, 0.01).count() == 3 and T.batch_sample(df).count() == 25
    with pytest.raises(ValueError):
        T.batch_sample(df, 0.0)


def test_norms(spark):
    df = frame(spark, RAMP).unionByName(frame(spark, RAMP, fid=1, det="x"))
    stats = spark.createDataFrame([("d", 2.0, 4.0)], "detector string, mean double, std double")
    got = {r.detector: r for r in T.norm_by_detector(df, stats).collect()}
    assert got["x"].error == "unknown detector x" and got["x"].pixels is None and got["d"].error is None
    assert np.allclose(got["d"].pixels, (RAMP.ravel() - 2) / 4)
    none = spark.createDataFrame([(0, None, None)], "file_id int, mean double, std double")
    assert T.norm_by_file(df, none).first().pixels == [float(v) for v in RAMP.ravel()]
    assert T.norm_by_file(df, none, applies=False) is df


def test_chain(spark):
    with pytest.raises(ValueError):
        T.chain_from_config({"nothing": {}})
    assert T.apply_chain(frame(spark, RAMP, RAMP), []).first().label == [float(v) for v in RAMP.ravel()]  # no transforms: labels stay
    got = T.apply_chain(frame(spark, RAMP, RAMP), [T.identity], 8.0).first()
    assert got.label == [float(v > 8) for v in RAMP.ravel()]


# --- index, shards ---
def test_index_keeps_unreadable_and_repeated_files(spark):
    manifest = spark.createDataFrame([(0, "a"), (1, "b"), (2, "a")], "file_id int, path string")
    frames = spark.createDataFrame([(0,), (0,), (2,)], "file_id int")
    index = X.build_index(manifest, frames)
    rows = [(r.file_id, r.n, r.start, r.end_excl, r.error) for r in index.orderBy("file_id").collect()]
    assert rows == [(0, 2, 0, 2, None), (1, 0, 2, 2, "no readable frames"), (2, 1, 2, 3, None)]
    assert [tuple(r) for r in X.check_index(index).collect()] == [("duplicate path", 0, "a"), ("duplicate path", 2, "a")]
    ids = spark.createDataFrame([(-1,), (0,), (2,), (3,)], "id long")
    got = {r.id: (r.file_id, r.item_idx, r.error) for r in X.locate(ids, index, bucket=2).collect()}
    assert got == {-1: (None, None, "index out of range"), 0: (0, 0, None), 2: (2, 0, None), 3: (None, None, "index out of range")}
    assert X.build_index(manifest.limit(0), frames).count() == 0


@pytest.mark.parametrize(("n", "world"), [(0, 3), (2, 5), (10, 3), (100, 7)])
def test_ranges_and_redistribution(spark, n, world):
    ranges = X.rank_ranges(spark, n, world).orderBy("rank").collect()
    assert ranges[0].start == 0 and ranges[-1].end_excl == n and all(a.end_excl == b.start for a, b in zip(ranges, ranges[1:], strict=False))
    sizes = [r.end_excl - r.start for r in ranges]
    assert max(sizes) - min(sizes) <= 1 and sizes == sorted(sizes, reverse=True)
    for seed in (None, 4):
        got = B.redistribute(spark, n, world, 13, seed).collect()
        assert sorted(r.frame_id for r in got) == list(range(n))
        for part in ("remaining", "processed"):
            per = [sum(r.rank == k and r.part == part for r in got) for k in range(world)]
            assert max(per) - min(per) <= 1
        for k in range(world):
            own = sorted((r.local_pos, r.part) for r in got if r.rank == k)
            assert [p for p, _ in own] == list(range(len(own))) and [x for _, x in own] == sorted((x for _, x in own), reverse=True)


def test_ranks_out_of_range(spark):
    for bad in (-1, 3):
        with pytest.raises(ValueError):
            X.rank_ranges(spark, 10, 3, bad)
    assert X.rank_ranges(spark, 10, 3, 1).count() == 1
    left = X.remaining_ranges(spark, 10, 25, 2).collect()
    assert [(r.start, r.end_excl) for r in left] == [(25, 25), (25, 25)]


def test_same_shards_for_any_partitioning(spark):
    a = sorted(map(tuple, B.redistribute(spark, 500, 4, 100, 1).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    b = sorted(map(tuple, B.redistribute(spark, 500, 4, 100, 1).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert a == b


def test_epochs(spark):
    ids = lambda step, every: [r.frame_id for r in B.shuffle_epoch(spark, 50, 1, step, every, 9).orderBy("local_pos").collect()]
    assert ids(9, 10) == list(range(50)) == ids(99, None) == ids(99, 0)
    assert ids(10, 10) == ids(19, 10) != ids(20, 10) and sorted(ids(20, 10)) == list(range(50))


def test_strided_shards_pad_short_segments(spark):
    ids = spark.range(2).select(F.col("id").alias("frame_id"), F.lit(0).alias("seg"))
    got = B.strided_shards(ids, 5).orderBy("pos").collect()
    assert [(r.pos, r.frame_id, r.rank) for r in got] == [(0, 0, 0), (1, 1, 1), (2, 0, 2), (3, 1, 3), (4, 0, 4)]
    assert B.strided_shards(ids, 5, drop_last=True).count() == 0


def test_progress(spark):
    a = B.redistribute(spark, 3, 4)
    got = {r["rank"]: r for r in B.progress_summary(a, 1, 4).collect()}
    assert (got[3].assigned, got[3].percent, got[3].current_id) == (0, 100.0, None) and got[0].current_id == 0
    assert B.progress_summary(a, 0, 4).where("rank = 0").first().current_id is None
    pos, epochs = B.advance(F.lit(7), F.lit(0))
    assert spark.range(1).select(pos, epochs).first() == (0, 0)


def test_subset_and_batches(spark):
    f = spark.range(10).withColumnRenamed("id", "frame_id")
    assert [r.frame_id for r in B.sample_subset(f, -3, 4, 10).collect()] == [0, 1, 2, 3]
    assert [r.frame_id for r in B.sample_subset(f, 8, 99, 10).collect()] == [8, 9]
    b = B.make_batches(B.redistribute(spark, 10, 1), 4)
    assert b.where("batch_id = 2").count() == 2 and B.make_batches(B.redistribute(spark, 10, 1), 4, True).count() == 8
    steps = B.cycle_batches(b.select("rank", "batch_id").distinct(), 7).orderBy("step").collect()
    assert [(r.step, r.batch_id) for r in steps] == [(k, k % 3) for k in range(7)]
    assert [r.batches for r in B.accum_windows(b, 2).orderBy("iteration").collect()] == [2, 1]


# --- detector ---
def test_outliers(spark):
    df = spark.createDataFrame([(float(v),) for v in [*range(100), 10_000]], "v double")
    got = D.zero_outliers(df, "v", []).where("v > 5000").first()
    assert got.kept == 0.0


def test_percentiles_are_exact(spark):
    rng = np.random.default_rng(4)
    groups = {"a": rng.normal(size=30_000), "b": np.full(500, 3.0), "c": rng.exponential(size=7), "d": np.array([1.5]), "e": rng.integers(0, 4, 9000).astype(float)}
    rows = [(g, float(x)) for g, v in groups.items() for x in v] + [("a", None), ("f", None), (None, 2.0), (None, 4.0)]
    shares = [0.0, 0.05, 0.5, 0.95, 0.999, 1.0]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    got = {r.g: [r[f"q{i}"] for i in range(len(shares))] for r in D.exact_percentiles(df, "v", ["g"], shares).collect()}
    assert set(got) == {*"abcde", None} and np.allclose(got[None], np.quantile([2.0, 4.0], shares))
    assert all(np.allclose(got[g], np.quantile(v, shares), rtol=1e-12, atol=0) for g, v in groups.items())
    assert D.zero_outliers(df, "v", ["g"]).count() == len(rows)


def test_mosaic_of_overlapping_and_absent_panels(spark):
    geom = spark.createDataFrame([(0, 0, 0, 3, 3), (1, 2, 1, 4, 3), (5, 0, 3, 2, 4)], "panel int, x_min int, y_min int, x_max int, y_max int")
    panels = spark.createDataFrame([(1, 0, 3, 3, [1.0] * 9), (1, 1, 1, 2, [2.0] * 2), (2, 1, 2, 2, [3.0] * 4)], "event long, panel int, h int, w int, pixels array<double>")
    got = {r.event: np.reshape(r.pixels, (r.h, r.w)).tolist() for r in D.to_mosaic(panels, geom).collect()}
    assert got[1] == [[1, 1, 1, 0], [1, 1, 2, 2], [1, 1, 1, 0], [0, 0, 0, 0]] and got[2] == [[0] * 4, [0, 0, 3, 3], [0, 0, 3, 3], [0] * 4]


def test_mosaic_round_trip(spark):
    geom = spark.createDataFrame([(0, 0, 0, 3, 2), (1, 4, 1, 7, 3)], "panel int, x_min int, y_min int, x_max int, y_max int")
    panels = spark.createDataFrame([(7, p, 2, 3, [float(p * 10 + i) for i in range(6)]) for p in (0, 1)], "event long, panel int, h int, w int, pixels array<double>")
    mosaic = D.to_mosaic(panels, geom)
    want = np.zeros((3, 7))
    want[0:2, 0:3], want[1:3, 4:7] = np.arange(6).reshape(2, 3), np.arange(10, 16).reshape(2, 3)
    assert (one(mosaic) == want).all()
    back = {r.panel: r.pixels for r in D.from_mosaic(mosaic, geom).collect()}
    assert back == {0: [float(i) for i in range(6)], 1: [10.0 + i for i in range(6)]}


def test_assembly_rounds_half_to_even_and_the_last_pixel_stays(spark):
    spots = spark.createDataFrame([([10.5, 11.5, 12.0], [0.0, 0.0, 0.0], [0.0, 0.0, 0.0])], "x array<double>, y array<double>, z array<double>")
    got = D.assemble_panels(frame(spark, [[1, 2, 3]]), spots).first()
    assert (got.w, got.h, got.c, got.pixels) == (3, 1, 1, [1.0, 0.0, 3.0])


def test_mask_default_is_nan(spark):
    df = frame(spark, [[1, 2]]).withColumn("panel", F.lit(0))
    mask = spark.createDataFrame([(0, [1, 0])], "panel int, mask array<int>")
    got = D.apply_mask(df, mask).first().pixels
    assert got[0] == 1.0 and math.isnan(got[1])


# --- targets, losses ---
def test_softmax_and_focal_loss(spark):
    df = spark.createDataFrame([([[1000.0, 0.0], [0.0, 0.0], [-1000.0, 0.0]], [0, 2])], "z array<array<double>>, y array<int>")
    p = np.array(df.select(L.softmax(F.col("z")).alias("p")).first().p)
    assert np.allclose(p.sum(axis=0), 1) and np.isfinite(p).all()
    loss = df.select(L.focal_loss(F.col("z"), F.col("y"), [0.25, 0.5, 0.25]).alias("l")).first().l
    assert 0 <= loss[0] < 1e-12 and math.isclose(loss[1], 0.25 * (2 / 3) ** 2 * math.log(3))
    assert df.select(L.one_hot(F.col("y"), 3).alias("o")).first().o == [[1, 0], [0, 0], [0, 1]]


@pytest.mark.parametrize("ratio", [0.3, 0.6, 0.9])
def test_masks_keep_exactly_k(spark, ratio):
    units = spark.range(3).select(F.col("id").alias("frame_id"), F.explode(F.sequence(F.lit(0), F.lit(19))).alias("unit"))
    got = L.mask_units(units, ratio, 1).where("keep").groupBy("frame_id").count().collect()
    assert {r["count"] for r in got} == {int(20 * (1 - ratio) + 1e-9)}


def test_patch_targets_of_channels(spark):
    two = np.stack([RAMP, RAMP + 100])
    got = L.patch_targets(frame(spark, two), 2, norm=False).where("patch = 1").first().target
    assert got == [2, 102, 3, 103, 6, 106, 7, 107]
    z = np.array(L.patch_targets(frame(spark, RAMP), 2).where("patch = 0").first().target)
    assert np.allclose(z, (np.array([0, 1, 4, 5]) - 2.5) / np.sqrt(np.var([0, 1, 4, 5], ddof=1) + 1e-6))


# --- evaluation ---
def test_eval_loss_without_a_single_number(spark):
    b = spark.createDataFrame([(0, 0, math.nan, 1), (1, 0, None, 1)], "rank int, batch_id long, loss double, n long")
    assert E.eval_loss(b, 2).first() == (None, 2)
    c = spark.createDataFrame([(0, 0, 1.0, 1), (0, 1, 3.0, 1), (1, 0, 10.0, 8), (2, 0, math.nan, 1)], "rank int, batch_id long, loss double, n long")
    got = E.eval_loss(c, 3).first()
    assert got.nan_ranks == 1 and math.isclose(got.loss, 12 / (2 + 1e-6))
    assert math.isclose(E.eval_loss(c, 3, weighted=True).first().loss, 84 / 10)
    assert E.limit_batches(c, 0).count() == 4 and E.limit_batches(c, 1).count() == 3


def test_best_checkpoints_in_buckets_of_steps(spark):
    rng = random.Random(3)
    rows = [(rng.choice([None, 0, 1]), step, rng.choice([None, float("nan"), float(rng.randint(0, 400)) / (1 + step)])) for step in range(300)]
    want, best = set(), {}
    for rank, step, loss in rows:
        if loss is not None and loss == loss and loss < best.get(rank, float("inf")):
            best[rank] = loss
            want.add((rank, step, loss))
    e = spark.createDataFrame(rows, "rank int, step long, loss double")
    for bucket in (7, 64, 4096):
        got = E.best_checkpoints(e, ["rank"], bucket)
        assert got.columns == ["rank", "step", "loss", "best_before"]
        assert {(r.rank, r.step, r.loss) for r in got.collect()} == want


def test_best_checkpoints_skip_missing_losses(spark):
    e = spark.createDataFrame([(0, 3.0), (1, math.nan), (2, 3.0), (3, None), (4, 1.0)], "step long, loss double")
    assert [r.step for r in E.best_checkpoints(e).orderBy("step").collect()] == [0, 4]


# --- run logs ---
LOG = """starting
01/02/2024 03:04:05 [RANK 3] INFO __main__
rank=3 | logevent=LOSS:TRAIN | iteration=7 | segment=0-100 | learning_rate=0.001,0.002 | grad_norm=1.500000 | mean_train_loss=0.250000 | tokens_per_sec=1.0e+03 | mfu_per_iteration=0.412 | grad_nosync_counter=4
01/02/2024 03:04:06 [RANK 3] WARNING __main__
two lines
of = text

01/02/2024 03:04:07 INFO __main__
[RANK 0] LOSS:EVAL - epoch 2, seg 0-400, mean validation loss = nan
01/02/2024 03:04:08 INFO __main__
[RANK 0] LOSS:EVAL - epoch 2, seg 0-400, mean train loss = 0.12345678
01/02/2024 03:04:09 [RANK 1] INFO __main__
rank=1 | iteration=8 | logevent=DYNAMICS:ACT | name=stages.0.act | preact.mean=-0.5 | preact.std=1e-05 | act.mean=0.25 | act.std=nan
01/02/2024 03:04:09 [RANK 1] INFO __main__
rank=1 | iteration=8 | logevent=DYNAMICS:PARAMS | type=encoder | name=stem.weight | update=-3.5
01/02/2024 03:04:09 [RANK 2] INFO __main__
rank=2 | iteration=8 | logevent=DYNAMICS:PARAMS | type=encoder | name=stem.weight | update=-inf
01/02/2024 03:04:10 [RANK 0] INFO __main__
Saving checkpoint at a.b/v1.2024_0102_0304_05.epoch_2.end_idx_400.
01/02/2024 03:04:11 [RANK 0] INFO __main__
[RANK 0] Saving preemptive checkpoint (epoch 2, end_idx 300) at a.b/2024_0102_0304_05.preempt.
01/02/2024 03:04:12 [RANK 1] INFO __main__
[RANK 1] Saving preemptive checkpoint (epoch 3, end_idx 100) at a.b/2024_0102_0304_05.preempt.
01/02/2024 03:04:12 [RANK 0] INFO __main__
[RANK 0] Saving preemptive metadata (epoch 3, end_idx 100) at meta.txt.
"""


def test_run_log(spark, tmp_path):
    folder = tmp_path / "2024_0102_0304_05"
    folder.mkdir()
    (folder / "rank3.log").write_text(LOG)
    log = S.read_run_log(spark, str(tmp_path))
    assert log.select("run_id", "file_rank").first() == ("2024_0102_0304_05", 3)
    records = R.parse_kv(R.parse_records(log))
    rows = records.orderBy("ts").collect()
    assert [(r["rank"], r.level, r.logger, r.ts) for r in rows[:3]] == [(3, "INFO", "__main__", datetime(2024, 1, 2, 3, 4, 5)), (3, "WARNING", "__main__", datetime(2024, 1, 2, 3, 4, 6)), (None, "INFO", "__main__", datetime(2024, 1, 2, 3, 4, 7))]
    assert rows[1].message == "two lines\nof = text" and len(rows) == 11
    curve = R.train_curve(records).collect()
    assert [(r.iteration, r.learning_rates, r.learning_rate, r.grad_norm, r.loss, r.tokens_per_sec, r.mfu, r.accum, r.segment, r["rank"]) for r in curve] == [(7, [0.001, 0.002], 0.001, 1.5, 0.25, 1000.0, 0.412, 4, "0-100", 3)]
    (ev,) = R.eval_curve(records).collect()
    assert (ev.epoch, ev.seg_start, ev.seg_end, ev.train) == (2, 0, 400, 0.12345678) and math.isnan(ev.validation)
    (act,) = R.activation_stats(records).collect()
    assert (act.iteration, act.name, act.pre_mean, act.pre_std, act.post_mean) == (8, "stages.0.act", -0.5, 1e-05, 0.25) and math.isnan(act.post_std)
    assert [tuple(r) for r in R.param_update_curve(records).collect()] == [("2024_0102_0304_05", 8, "encoder", "stem.weight", -3.5, 1)]
    saves = R.checkpoint_saves(records)
    assert sorted((r.path, r.preempt, r.epoch, r.end_idx) for r in saves.collect()) == [("a.b/2024_0102_0304_05.preempt", True, 2, 300), ("a.b/2024_0102_0304_05.preempt", True, 3, 100), ("a.b/v1.2024_0102_0304_05.epoch_2.end_idx_400", False, 2, 400)]
    paths = saves.select("path").distinct().unionByName(spark.createDataFrame([("a.b/2024_0102_0304_05.epoch_2.end_idx_9.preempt",), ("a.b/note.txt",)], "path string"))
    catalog = {(r.path.rsplit("/", 1)[1], r.prefix, r.epoch, r.end_idx, r.preempt, r.latest) for r in R.checkpoint_catalog(paths, saves).collect()}
    assert catalog == {("2024_0102_0304_05.preempt", "", 3, 100, True, True), ("v1.2024_0102_0304_05.epoch_2.end_idx_400", "v1", 2, 400, False, False)}
    assert {(r.preempt, r.epoch, r.latest) for r in R.checkpoint_catalog(paths).collect()} == {(True, None, False), (False, 2, True)}


def test_of_a_repeated_key_the_last_value_holds(spark):
    df = spark.createDataFrame([("logevent=X | a=1 | b= 2=3 | a=4 | no pair | =5",), ("plain",), (None,)], "message string")
    rows = R.parse_kv(df).collect()
    assert rows[0].logevent == "X" and rows[0].kv == {"logevent": "X", "a": "4", "b": "2=3", "": "5"}
    assert rows[1].kv == {} and rows[1].logevent is None and not rows[2].kv


def test_rate_at_the_end_of_a_warmup_that_is_all(spark):
    df = spark.range(9, 12).select(R.expected_rate(F.col("id"), 1.0, 10, 10, 0.25).alias("r"))
    assert [x.r for x in df.collect()] == [0.9, 0.25, 0.25]


def test_long_log_is_read_in_splits(spark, tmp_path):
    folder = tmp_path / "run"
    folder.mkdir()
    text = "before\n" + "".join(f"01/02/2024 03:04:{k % 60:02d} INFO train\n[LOSS:TRAIN] iteration={k}\nmore {k}\n" for k in range(500))
    (folder / "rank0.log").write_text(text)
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        log = S.read_run_log(spark, str(tmp_path))
        assert log.count() == 501 and {len(r.value.split("\n")) for r in log.collect()} == {1, 3}
        assert sorted(r.message for r in R.parse_records(log).collect()) == sorted(f"[LOSS:TRAIN] iteration={k}\nmore {k}" for k in range(500))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)


def test_run_ids_keep_their_seconds(spark):
    df = spark.createDataFrame([("2024_0102_0304_05",), ("2024_0102_0304",), ("x",)], "r string").select(R.run_time(F.col("r")).alias("t"))
    df = df.select("t", R.packed_time(F.col("t")).alias("p")).select("t", "p", R.unpacked_time(F.col("p")).alias("u"))
    assert [(r.p, r.t == r.u) for r in df.collect()][:2] == [(20240102030405, True), (20240102030400, True)] and df.collect()[2].t is None


def test_due_counts_from_zero_or_one(spark):
    assert [r.iteration for r in R.due_events(spark, 10, {"a": 4}).collect()] == [3, 7]
    assert [r.iteration for r in R.due_events(spark, 10, {"a": 4}, zero_based=False).collect()] == [0, 4, 8]


# --- sources ---
def test_manifests(spark, tmp_path):
    (tmp_path / "m.csv").write_text("directory_path\n/a\n\n/b\n/a\n")
    assert [tuple(r) for r in S.read_manifest(spark, str(tmp_path / "m.csv")).collect()] == [(0, "/a"), (1, "/b"), (2, "/a")]
    (tmp_path / "s.csv").write_text("/a,1.5,2\n/b,0,1\n")
    assert [tuple(r) for r in S.read_manifest(spark, str(tmp_path / "s.csv"), True).collect()] == [(0, "/a", 1.5, 2.0), (1, "/b", 0.0, 1.0)]
    split = B.split_files(S.read_manifest(spark, str(tmp_path / "s.csv")), 0.5)
    S.write_split(split, str(tmp_path / "split"))
    assert sorted(r.split for r in split.collect()) == ["eval", "train"]
    assert S.read_manifest(spark, str(tmp_path / "split/split=train")).count() == 1


def test_index_cache(spark, tmp_path):
    manifest = spark.createDataFrame([(0, "a"), (1, "b")], "file_id int, path string")
    index = X.build_index(manifest, spark.createDataFrame([(0,)], "file_id int"))
    S.save_index(index, str(tmp_path))
    assert sorted(S.load_index(spark, manifest.orderBy(F.desc("path")), str(tmp_path)).collect()) == sorted(index.collect())


def safetensors(**arrays):
    header, data = {}, b""
    for k, a in arrays.items():
        header[k] = {"dtype": "F32", "shape": list(a.shape), "data_offsets": [len(data), len(data) + a.nbytes]}
        data += a.tobytes()
    head = json.dumps(header).encode()
    return struct.pack("<Q", len(head)) + head + data


def test_containers(spark, tmp_path):
    store = tmp_path / "in" / "a.zarr"
    data = np.arange(3 * 2 * 2, dtype="<f4").reshape(3, 2, 2)
    for name, add, codec in (("images", 0, "zlib"), ("labels", 1, None)):
        (store / name).mkdir(parents=True)
        (store / name / ".zarray").write_text(json.dumps({"shape": [3, 2, 2], "chunks": [2, 2, 2], "dtype": "<f4", "order": "C", "compressor": codec and {"id": codec}}))
        for k in (0, 1):
            block = np.zeros((2, 2, 2), "<f4")
            block[: len(data[2 * k : 2 * k + 2])] = data[2 * k : 2 * k + 2] + add
            raw = block.tobytes()
            (store / name / f"{k}.0.0").write_bytes(zlib.compress(raw) if codec else raw)
    bad = tmp_path / "in" / "b.zarr" / "images"
    bad.mkdir(parents=True)
    (bad / ".zarray").write_text(json.dumps({"shape": [1, 1, 1], "chunks": [1, 1, 1], "dtype": "<f4", "compressor": {"id": "blosc"}}))
    (bad / "0.0.0").write_bytes(b"xxxx")
    (tmp_path / "in" / "x.safetensors").write_bytes(safetensors(image=np.ones((1, 2, 3), "f4"), label=np.zeros((1, 2, 3), "f4")))
    (tmp_path / "in" / "y.safetensors").write_bytes(b"broken")
    rows = {(r.store.split("/")[-1], r.item_idx): r for r in S.ingest_containers(spark, str(tmp_path / "in")).collect()}
    assert rows["a.zarr", 2].pixels == [8.0, 9.0, 10.0, 11.0] and rows["a.zarr", 2].label == [9.0, 10.0, 11.0, 12.0]
    assert len([k for k in rows if k[0] == "a.zarr"]) == 3
    assert "blosc" in rows["b.zarr", -1].error and rows["y.safetensors", 0].error
    assert (rows["x.safetensors", 0].h, rows["x.safetensors", 0].w, rows["x.safetensors", 0].error) == (2, 3, None)
    found = S.discover_files(spark, str(tmp_path / "in")).collect()
    assert sorted(r.store.split("/")[-1] for r in found) == ["a.zarr", "b.zarr"]


def test_safetensors_with_several_frames(spark, tmp_path):
    a = np.arange(18, dtype="f4").reshape(3, 2, 3)
    for name, image, label in (("a", a, a + 1), ("b", a[:, None], a[:2]), ("c", a, a[:, :1])):
        (tmp_path / f"{name}.safetensors").write_bytes(safetensors(image=image, label=label))
    rows = {(r.store[-13], r.item_idx): r for r in S.ingest_containers(spark, str(tmp_path)).collect()}
    assert sorted(rows) == [(n, i) for n in "abc" for i in range(3)]
    for i in range(3):
        assert (rows["a", i].h, rows["a", i].w, rows["a", i].error) == (2, 3, None)
        assert rows["a", i].pixels == a[i].ravel().tolist() and rows["a", i].label == (a[i] + 1).ravel().tolist()
        assert rows["c", i].error and rows["c", i].pixels is None
    assert rows["b", 1].pixels == a[1].ravel().tolist() and rows["b", 1].error is None and "label 2" in rows["b", 2].error


def test_zarr_tiles_groups_and_absent_chunks(spark, tmp_path):
    a = np.arange(3 * 3 * 5, dtype="<f4").reshape(3, 3, 5)

    def write(folder, sep, absent=(), fill=7.0, **more):
        folder.mkdir(parents=True)
        (folder / ".zarray").write_text(json.dumps({"shape": [3, 3, 5], "chunks": [2, 2, 3], "dtype": "<f4", "fill_value": fill, "zarr_format": 2, "compressor": None, **more}))
        for at in np.ndindex(2, 2, 2):
            if at not in absent:
                block = np.zeros((2, 2, 3), "<f4")
                part = a[tuple(slice(i * s, (i + 1) * s) for i, s in zip(at, (2, 2, 3), strict=True))]
                block[tuple(map(slice, part.shape))] = part
                file = folder / sep.join(map(str, at))
                file.parent.mkdir(parents=True, exist_ok=True)
                file.write_bytes(block.tobytes())

    write(tmp_path / "a.zarr" / "images", ".")
    write(tmp_path / "a.zarr" / "labels", "/")
    write(tmp_path / "b.zarr" / "group" / "images", "/", absent=[(0, 1, 0), (1, 0, 0), (1, 0, 1), (1, 1, 0), (1, 1, 1)])
    write(tmp_path / "c.zarr" / "images", ".", absent=[(1, 1, 1)], fill=None)
    write(tmp_path / "d.zarr" / "images", ".", filters=[{"id": "delta"}])
    (tmp_path / "e.zarr" / "images" / "c" / "0").mkdir(parents=True)
    (tmp_path / "e.zarr" / "images" / "c" / "0" / "0").write_bytes(b"x")
    (tmp_path / "e.zarr" / "zarr.json").write_text("{}")
    rows = {(r.store.split(tmp_path.name + "/")[1], r.item_idx): r for r in S.ingest_containers(spark, str(tmp_path)).collect()}
    filled = a.copy()
    filled[:2, 2:, :3] = filled[2] = 7
    for i in range(3):
        assert rows["a.zarr", i].pixels == rows["a.zarr", i].label == a[i].ravel().tolist() and rows["a.zarr", i].error is None
        assert rows["b.zarr/group", i].pixels == filled[i].ravel().tolist() and (rows["b.zarr/group", i].h, rows["b.zarr/group", i].w) == (3, 5)
    assert rows["c.zarr", 0].pixels == a[0].ravel().tolist() and "absent" in rows["c.zarr", 2].error
    assert "filters" in rows["d.zarr", -1].error and "not a chunk" in rows["e.zarr", -1].error


def test_array_metadata_is_found_in_tasks(spark, tmp_path):
    """Stores at several depths, in folders with spaces, without chunks; the driver lists nothing when the reader is made."""
    found = {spread: S.array_metadata(spark, str(tmp_path), spread) for spread in (0, 1, 2)}
    meta = json.dumps({"shape": [2, 2, 2], "chunks": [1, 2, 2], "dtype": "<f4", "fill_value": 3.0, "zarr_format": 2, "compressor": None})
    for at in ("a.zarr", "run 1/b.zarr", "run 1/day/2/c d.zarr/group", "run 1/plain"):
        for name in ("images", "labels"):
            (tmp_path / at / name / "0").mkdir(parents=True)
            (tmp_path / at / name / ".zarray").write_text(meta)
            (tmp_path / at / name / "0" / ".zarray").write_text("not listed")
    (tmp_path / "x.safetensors").write_bytes(b"broken")
    want = sorted((f"file:{tmp_path}/{at}/{name}", meta) for at in ("a.zarr", "run 1/b.zarr", "run 1/day/2/c d.zarr/group") for name in ("images", "labels"))
    for spread, df in found.items():
        assert sorted(map(tuple, df.collect())) == want, spread
    assert S.array_metadata(spark, str(tmp_path / "x.safetensors")).count() == 0
    assert len(S.array_metadata(spark, str(tmp_path / "a.zarr")).collect()) == 2
    rows = {(r.store.split(f"{tmp_path}/")[-1], r.item_idx): (r.pixels, r.error) for r in S.ingest_containers(spark, str(tmp_path)).collect()}
    for at in ("a.zarr", "run 1/b.zarr", "run 1/day/2/c d.zarr/group"):
        assert rows[at, 0] == rows[at, 1] == ([3.0] * 4, None)


def test_frames_and_predictions(spark, tmp_path):
    f = frame(spark, RAMP, RAMP)
    f.write.parquet(str(tmp_path / "f"))
    plan = S.read_frames(spark, str(tmp_path / "f")).where("file_id = 0").select("frame_id")._jdf.queryExecution().executedPlan().toString()
    assert "pixels" not in plan and "PushedFilters: [IsNotNull(file_id), EqualTo(file_id,0)]" in plan
    S.write_predictions(f.select("frame_id", F.lit(3).alias("step"), F.lit("train").alias("eval_type")), str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p/step=3/eval_type=train")).count() == 1
    distill = f.withColumn("label", F.concat("label", "label")).withColumn("label_c", F.lit(2))
    distill.write.parquet(str(tmp_path / "d"))
    got = S.on_label_channels(S.read_distill_frames(spark, str(tmp_path / "d")), lambda d: T.crop(d, 2, 2)).first()
    assert got.pixels == [5.0, 6.0, 9.0, 10.0] and got.label == got.pixels * 2 and (got.h, got.c) == (2, 1)


def test_model_is_made_once_for_a_batch(spark):
    def make():
        return lambda x: np.stack([x.sum(axis=1), np.full(len(x), len(x))], axis=1)

    df = spark.range(4).select(F.array(*[F.col("id").cast("float")] * 3).alias("pixels"))
    got = M.score_frames(df.coalesce(1), make, 3, 4).orderBy(F.col("pixels")[0]).collect()
    assert [r.classes[0] for r in got] == [0, 3, 6, 9]


# --- streams ---
def test_stream_frames_resumes(spark, tmp_path):
    src, out, ck = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck")
    for k in range(2):
        frame(spark, RAMP, RAMP, fid=k).write.mode("append").parquet(src)
        W.write_frames(W.stream_frames(spark, src, [lambda d: T.crop(d, 2, 2)]), out, ck).awaitTermination()
        got = spark.read.parquet(out)
        assert got.count() == k + 1 and got.first().h == 2


def test_stream_progress(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.range(10).select((F.col("id") % 2).cast("int").alias("rank")).write.parquet(src)
    assigned = spark.createDataFrame([(0, 2), (1, 10)], "rank int, assigned int")
    q = W.stream_progress(spark.readStream.schema("rank int").parquet(src), assigned).writeStream.format("memory").queryName("progress").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(tuple(r) for r in spark.table("progress").collect()) == [(0, 5, 2), (1, 5, 0)]


def test_best_loss_state():
    class Value:
        def __init__(self):
            self.v = None

        def exists(self):
            return self.v is not None

        def get(self):
            return self.v

        def update(self, v):
            self.v = v

    p = W.BestLoss()
    p.best = Value()
    run = lambda *rows: [int(s) for s in next(p.handleInputRows(("r",), iter([pd.DataFrame(rows, columns=["step", "loss"])]), None))["step"]]
    assert run((1, 5.0), (2, 6.0), (3, math.nan), (4, 4.0), (5, 4.0)) == [1, 4]
    assert run((6, 4.0)) == [] and run((7, 3.0), (8, 2.0)) == [7, 8]


def test_improvements_do_not_depend_on_chunks():
    rng = random.Random(5)
    rows = pd.DataFrame([(step, rng.choice([float("nan"), rng.random() * 100 / (1 + step)])) for step in range(200)], columns=["step", "loss"]).sample(frac=1, random_state=1)
    whole, kept = W.improvements(rows, 90.0), rows[:0]
    for at in range(0, 200, 30):
        kept = W.improvements(pd.concat([kept, rows[at : at + 30]]), 90.0)
    assert len(whole) > 2 and kept.equals(whole)


def test_stream_best_loss(spark, tmp_path):
    pytest.importorskip("google.protobuf")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    src = str(tmp_path / "in")
    spark.createDataFrame([("a", k, v) for k, v in enumerate([5.0, 6.0, 4.0])], "run_id string, step long, loss double").write.parquet(src)
    q = W.stream_best_loss(spark.readStream.schema("run_id string, step long, loss double").parquet(src)).writeStream.format("memory").queryName("best").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.step for r in spark.table("best").collect()) == [0, 2]


def test_stream_epochs(spark, tmp_path):
    src, seen = str(tmp_path / "in"), []
    for k in range(4):
        spark.range(k * 5, k * 5 + 5).withColumnRenamed("id", "frame_id").coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema("frame_id long").option("maxFilesPerTrigger", 1).parquet(src)
    W.stream_epochs(stream, 20, 2, 2, lambda df, b: seen.extend((b, r.epoch, r.frame_id) for r in df.collect()), 7, str(tmp_path / "ck")).awaitTermination()
    assert {(b, e) for b, e, _ in seen} == {(0, 0), (1, 0), (2, 1), (3, 1)} and sorted(i for *_, i in seen) == list(range(20))


def test_synthetic_frames(spark):
    f = S.synth_frames(spark.range(40).withColumnRenamed("id", "frame_id"), 1, 5, 5, 3)
    rows = f.collect()
    px = np.concatenate([r.pixels for r in rows])
    assert abs(px.mean()) < 0.1 and abs(px.std() - 1) < 0.1 and set(np.concatenate([r.label for r in rows])) == {0.0, 1.0}
    assert rows == S.synth_frames(spark.range(40).repartition(7).withColumnRenamed("id", "frame_id"), 1, 5, 5, 3).orderBy("frame_id").collect()


def test_let_binds_once(spark):
    df = spark.createDataFrame([([1.0, 2.0],)], "v array<double>")
    assert df.select(A.let(F.col("v"), lambda v: F.size(v) + v[0]).alias("r")).first().r == 3.0


def test_stores_are_written_and_read_in_pieces_of_bounded_size(spark, tmp_path):
    import re
    import sys

    from framespark.plans import file_queries as Q

    rows = [(i, [float(i % 50 + k) for k in range(64)], 0) for i in range(600)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))

    def pack(data):
        assert len(sys._getframe(1).f_locals["pdf"]) <= 256  # frames that the task holds
        return data

    Q._write_stores(spark, str(tmp_path), str(tmp_path / "stores"), ("images", "labels"), (5, 3), 1, ((None, pack), (None, pack)))
    got = S.ingest_containers(spark, str(tmp_path / "stores"))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and not re.search(r"MapInPandas [^\n]*\b(tile|px)#", plan)  # pixels are no Python objects
    assert sorted((r.item_idx, list(r.pixels), r.error) for r in got.collect()) == [(i, v, None) for i, v, _ in rows]

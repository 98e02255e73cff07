"""Orders without a sort, streams that go on with other workers, and logs framed split by split."""

import pytest
from pyspark.sql import functions as F

from framespark.functions.rand import permuted
from framespark.operators import shards as B
from framespark.sources import io as S
from framespark.streaming import streams as W


@pytest.mark.parametrize("n", [1, 2, 3, 5, 7, 10, 26, 82, 101, 1000, 10001])
def test_keyed_order_is_one_to_one(spark, n):
    rows = spark.range(n).select("id", permuted(F.col("id"), n, 5).alias("pos")).select("*", permuted(F.col("pos"), n, 5, back=True).alias("again")).collect()
    assert sorted(r.pos for r in rows) == list(range(n)) and all(r.again == r.id for r in rows)


def test_keyed_order_looks_random(spark):
    n = 10000
    rows = spark.range(n).select("id", permuted(F.col("id"), n, 1).alias("a"), permuted(F.col("id"), n, 2).alias("b")).toPandas()
    assert rows.corr().abs().where(lambda c: c < 1).max().max() < 0.05
    step = rows.sort_values("id")["a"].diff().dropna()
    assert step.nunique() > 0.5 * n and (rows["a"] // 1000).groupby(rows["id"] // 1000).nunique().min() == 10


def test_ids_outside_have_no_place(spark):
    df = spark.createDataFrame([(-1,), (0,), (3,), (None,)], "frame_id long")
    assert [r.p for r in df.select(permuted(F.col("frame_id"), 3, 1).alias("p")).collect()][::3] == [None, None]
    assert df.select(permuted(F.col("frame_id"), 0, 1).alias("p")).where("p is not null").count() == 0
    assert B.place_in_epoch(df, 3, 2, 1).count() == 1


@pytest.mark.parametrize("progress", [0, 40, 1003])
def test_keyed_redistribution_shuffles_nothing(spark, progress):
    df = B.redistribute(spark, 103, 4, progress, 9, keyed=True)
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    rows = df.collect()
    assert sorted(r.frame_id for r in rows) == list(range(103))
    for rank in range(4):
        own = sorted((r.local_pos, r.part) for r in rows if r["rank"] == rank)
        assert [p for p, _ in own] == list(range(len(own))) and sorted((p for _, p in own), reverse=True) == [p for _, p in own]


def test_places_of_arriving_frames_are_those_of_the_epoch(spark):
    want = {(r.frame_id, r["rank"], r.local_pos) for r in B.shuffle_epoch(spark, 50, 3, 2, 1, 8, keyed=True).collect()}
    got = B.place_in_epoch(spark.range(50).withColumnRenamed("id", "frame_id"), 50, 3, 2, 8)
    assert {(r.frame_id, r["rank"], r.local_pos) for r in got.collect()} == want


def test_stream_goes_on_at_the_exact_sample_with_other_workers(spark, tmp_path):
    src, out, offsets, state = (str(tmp_path / k) for k in ("in", "out", "offsets", "state"))
    items = lambda k: spark.range(k * 10, k * 10 + 7).select(F.lit(k).alias("file_id"), F.col("id").alias("item_idx"))
    for k in range(4):
        items(k).coalesce(1).write.mode("append").parquet(src)
    stream = lambda: spark.readStream.schema("file_id int, item_idx long").option("maxFilesPerTrigger", 1).parquet(src)
    keep = W.replace_batch(out)

    def stops(df, b):
        keep(df.limit(3) if b == 2 else df, b)  # a part of the third micro-batch is written before the end
        if b == 2:
            raise RuntimeError("stop")

    with pytest.raises(Exception, match="stop"):
        W.stream_assigned(stream(), stops, 4, offsets, state).awaitTermination()
    W.stream_assigned(stream(), keep, 3, offsets, state).awaitTermination()
    items(4).coalesce(1).write.mode("append").parquet(src)
    W.stream_assigned(stream(), keep, 2, offsets, state).awaitTermination()
    rows = spark.read.parquet(out).collect()
    assert sorted(r.sample_id for r in rows) == list(range(35)) and len({(r.file_id, r.item_idx) for r in rows}) == 35
    worlds = {b: {r["rank"] for r in rows if r.batch_id == b} for b in range(5)}
    assert [len(worlds[b]) for b in range(5)] == [4, 4, 3, 3, 2]
    for b in range(5):
        assert [r.item_idx % 10 for r in sorted((r for r in rows if r.batch_id == b), key=lambda r: r.sample_id)] == list(range(7))


@pytest.mark.parametrize("size", ["60", "200", "100000"])
def test_records_across_splits(spark, tmp_path, size):
    """Records longer than several splits, two files in one run, and lines before the first header."""
    want = {}
    for rank in range(2):
        long = "\n".join(f"line {rank} {k}" for k in range(40))
        records = ["before\nanything", f"01/02/2024 03:04:05 INFO a\n{long}", "01/02/2024 03:04:06 INFO b", f"01/02/2024 03:04:07 INFO c\nshort {rank}"]
        (tmp_path / "run").mkdir(exist_ok=True)
        (tmp_path / "run" / f"rank{rank}.log").write_text("\n".join(records) + "\n")
        want[rank] = sorted(records)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    try:
        rows = S.read_run_log(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert {rank: sorted(r.value for r in rows if r.file_rank == rank) for rank in range(2)} == want

"""One query for each operator over the driver's tables, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..operators import detector as D
from ..operators import evaluate as E
from ..operators import index as X
from ..operators import runlog as R
from ..operators import scoring as M
from ..operators import shards as B
from ..operators import targets as L
from ..operators import transforms as T
from ..sources import io as S
from .fixtures import FR, SEED, digest, digest_sql, frames, index, manifest, moved_sql, permuted_sql, rounded, scratch, table, total, u_sql

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


# --- sources ---------------------------------------------------------------------------------------------------------
def _stats_manifest(s, d):
    """Sources of the documents as files with mean and deviation of their lengths."""
    g = table(s, d, "documents").groupBy("source").agg(F.avg("n_chars").alias("mean"), F.stddev_pop("n_chars").alias("std"))
    return g.select(F.regexp_replace("source", "src", "").cast("int").alias("file_id"), F.col("source").alias("path"), "mean", "std")


@query("s2_manifest_with_stats", "SELECT CAST(row_number() OVER (ORDER BY source) - 1 AS INT) AS file_id, source AS path, round(avg(n_chars), 6) AS mean, round(stddev_pop(n_chars), 6) AS std FROM documents GROUP BY source")
def s2(s, d):
    """A list of files with two numbers each, written and read back."""
    path = scratch(s, "manifest")
    _stats_manifest(s, d).coalesce(1).sortWithinPartitions("path").select("path", "mean", "std").write.csv(path)
    return S.read_manifest(s, path, with_stats=True).select("file_id", "path", rounded(F.col("mean")).alias("mean"), rounded(F.col("std")).alias("std"))


@query("s6_distill_channels", digest_sql("list_concat(list_transform(range(16), lambda i: px[(i // 4) * 2 * 8 + (i % 4) * 2 + 1] * 0 + (px[(i // 4) * 16 + (i % 4) * 2 + 1] + px[(i // 4) * 16 + (i % 4) * 2 + 2] + px[(i // 4) * 16 + (i % 4) * 2 + 9] + px[(i // 4) * 16 + (i % 4) * 2 + 10]) / 4), list_transform(range(16), lambda i: (lab[(i // 4) * 16 + (i % 4) * 2 + 1] + lab[(i // 4) * 16 + (i % 4) * 2 + 2] + lab[(i // 4) * 16 + (i % 4) * 2 + 9] + lab[(i // 4) * 16 + (i % 4) * 2 + 10]) / 4))"))
def s6(s, d):
    f = frames(s, d).withColumn("label", F.concat("pixels", "label")).withColumn("label_c", F.lit(2))
    return digest(S.on_label_channels(f, T.downscale_mean), "label")


@query("s7_synth_frames", f"""WITH i AS (SELECT vec_id AS frame_id, unnest(range(16)) AS k FROM embeddings)
SELECT frame_id, round(sum(sqrt(-2 * ln(1 - {u_sql(SEED, 'frame_id', 'k', '0')})) * cos(2 * pi() * {u_sql(SEED, 'frame_id', 'k', '1')}) * (k + 1)), 6) + 0.0 AS s1, CAST(sum(CASE WHEN {u_sql(SEED, 'frame_id', 'k', "'l'")} > 0.5 THEN 1 ELSE 0 END) AS BIGINT) AS ones FROM i GROUP BY frame_id""")
def s7(s, d):
    f = S.synth_frames(table(s, d, "embeddings"), 1, 4, 4, SEED, "vec_id")
    return digest(f).join(f.select("frame_id", F.size(F.filter("label", lambda v: v > 0)).cast("long").alias("ones")), "frame_id").select("frame_id", "s1", "ones")


@query("s9_index_key", "SELECT substr(md5(string_agg(path, '|' ORDER BY path)), 1, 8) AS key FROM (SELECT DISTINCT 'file_' || label AS path FROM embeddings)")
def s9(s, d):
    return S.index_key(manifest(s, d))


@query("s10_index_is_fresh", "WITH m AS (SELECT user_id, max(ts) AS modified FROM events GROUP BY user_id) SELECT count(*) FILTER (WHERE modified IS NULL) = 0 AND count(*) FILTER (WHERE modified > TIMESTAMP '2024-01-02') = 0 AS fresh, count(*) FILTER (WHERE modified IS NULL) AS missing, count(*) FILTER (WHERE modified > TIMESTAMP '2024-01-02') AS newer FROM customer LEFT JOIN m ON c_custkey = user_id")
def s10(s, d):
    listed = table(s, d, "customer").select(F.col("c_custkey").cast("string").alias("path"))
    files = table(s, d, "events").select(F.col("user_id").cast("string").alias("path"), F.col("ts").alias("modified"))
    return S.index_is_fresh(listed, files, F.lit("2024-01-02").cast("timestamp"))


# --- index, shards ---------------------------------------------------------------------------------------------------
def _lines(s, d):
    """A large index: line items, whose files are their suppliers."""
    return table(s, d, "lineitem").select(F.col("l_suppkey").cast("int").alias("file_id"))


def _line_index(s, d):
    files = table(s, d, "supplier").select(F.col("s_suppkey").cast("int").alias("file_id"), F.concat(F.lit("s"), F.col("s_suppkey")).alias("path"))
    return X.build_index(files, _lines(s, d))


IX = "li AS (SELECT CAST(s_suppkey AS INT) AS file_id, 's' || s_suppkey AS path, count(l_suppkey) AS n, CAST(sum(count(l_suppkey)) OVER (ORDER BY s_suppkey) AS BIGINT) AS end_excl FROM supplier LEFT JOIN lineitem ON s_suppkey = l_suppkey GROUP BY s_suppkey)"


@query("x1_build_index", f"WITH {IX} SELECT file_id, path, n, end_excl - n AS start, end_excl, CASE WHEN n = 0 THEN 'no readable frames' END AS error FROM li")
def x1(s, d):
    return _line_index(s, d)


@query("x2_assign_global_ids", FR + "SELECT vec_id, frame_id FROM f")
def x2(s, d):
    e = table(s, d, "embeddings")
    items = e.select("vec_id", F.col("label").cast("int").alias("file_id"), (F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1).alias("item_idx"))
    return X.assign_global_ids(items, index(s, d)).select("vec_id", "frame_id")


@query("x3_locate", f"WITH {IX}, q AS (SELECT o_orderkey * 5 AS id FROM orders) SELECT q.id, li.file_id, li.path, q.id - (li.end_excl - li.n) AS item_idx, CASE WHEN li.file_id IS NULL THEN 'index out of range' END AS error FROM q LEFT JOIN li ON q.id >= end_excl - n AND q.id < end_excl")
def x3(s, d):
    return X.locate(table(s, d, "orders").select((F.col("o_orderkey") * 5).alias("id")), _line_index(s, d))


@query("x4_expand_items", f"WITH {IX} SELECT file_id, i AS item_idx, end_excl - n + i AS frame_id FROM (SELECT *, unnest(range(n)) AS i FROM li)")
def x4(s, d):
    return X.expand_items(_line_index(s, d))


@query("x5_file_stats", f"WITH {IX} SELECT file_id, n, round(n / (SELECT sum(n) FROM li)::DOUBLE, 9) AS share, CAST((SELECT sum(n) FROM li) AS BIGINT) AS total FROM li")
def x5(s, d):
    return X.file_stats(_line_index(s, d)).select("file_id", "n", rounded(F.col("share"), 9).alias("share"), "total")


@query("x5_total_size", f"WITH {IX} SELECT count(*) AS files, CAST(sum((n > 0)::INT) AS BIGINT) AS readable, CAST(sum(n) AS BIGINT) AS total FROM li")
def x5b(s, d):
    return X.total_size(_line_index(s, d))


@query("x6_rank_ranges", "WITH t AS (SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber) - 1 AS id, ntile(7) OVER (ORDER BY l_orderkey, l_linenumber) - 1 AS rank FROM lineitem) SELECT rank, min(id) AS start, max(id) + 1 AS end_excl FROM t GROUP BY rank")
def x6(s, d):
    return X.rank_ranges(s, table(s, d, "lineitem").count(), 7)


@query("x7_remaining_ranges", "WITH t AS (SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber) - 1 AS id FROM lineitem), r AS (SELECT id, ntile(5) OVER (ORDER BY id) - 1 AS rank FROM t WHERE id >= 1234) SELECT rank, min(id) AS start, max(id) + 1 AS end_excl FROM r GROUP BY rank")
def x7(s, d):
    return X.remaining_ranges(s, table(s, d, "lineitem").count(), 1234, 5)


def _redistributed(progress: str, seed: str | None, world: int) -> str:
    order = f"md5('{seed}:' || id), id" if seed else "id"
    return f"""WITH t AS (SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber) - 1 AS id FROM lineitem),
p AS (SELECT id, CASE WHEN id >= {progress} % (SELECT count(*) FROM lineitem) THEN 'remaining' ELSE 'processed' END AS part FROM t),
r AS (SELECT id, part, row_number() OVER (PARTITION BY part ORDER BY {order}) - 1 AS pos, ntile({world}) OVER (PARTITION BY part ORDER BY {order}) - 1 AS rank FROM p)
SELECT id AS frame_id, part, pos, CAST(rank AS INT) AS rank, row_number() OVER (PARTITION BY rank ORDER BY CASE part WHEN 'remaining' THEN 0 ELSE 1 END, pos) - 1 AS local_pos FROM r"""


@query("x8_redistribute", _redistributed("777", str(SEED), 4))
def x8(s, d):
    return B.redistribute(s, table(s, d, "lineitem").count(), 4, 777, SEED)


@query("x8_redistribute_in_order", _redistributed("60777", None, 3))
def x8b(s, d):
    return B.redistribute(s, table(s, d, "lineitem").count(), 3, 60777)


@query("x9_shuffle_epoch", "SELECT frame_id, rank, local_pos, 2 AS epoch FROM (" + _redistributed("0", "44", 4) + ")")
def x9(s, d):
    return B.shuffle_epoch(s, table(s, d, "lineitem").count(), 4, 25, 10, SEED).select("frame_id", "rank", "local_pos", "epoch")


def _keyed(n: str, seed: str, world: int) -> str:
    """Ids in the keyed order, cut evenly over ranks."""
    return f"SELECT id AS frame_id, CAST(rank AS INT) AS rank, row_number() OVER (PARTITION BY rank ORDER BY pos) - 1 AS local_pos FROM (SELECT *, ntile({world}) OVER (ORDER BY pos) - 1 AS rank FROM {permuted_sql(n, seed)})"


@query("x9_shuffle_epoch_keyed", "SELECT *, 2 AS epoch FROM (" + _keyed("SELECT count(*) FROM lineitem", "44", 4) + ")")
def x9b(s, d):
    return B.shuffle_epoch(s, table(s, d, "lineitem").count(), 4, 25, 10, SEED, keyed=True).select("frame_id", "rank", "local_pos", "epoch")


@query("x10_segments", "WITH t AS (SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber) - 1 AS id, count(*) OVER () AS n FROM lineitem) SELECT id AS frame_id, id // 400 AS seg, id // 400 * 400 AS seg_start, least(id // 400 * 400 + 400, n) AS seg_end FROM t")
def x10(s, d):
    n = table(s, d, "lineitem").count()
    return B.segments(s.range(n).withColumnRenamed("id", "frame_id"), 100, 4, n)


@query("x10_segment_table", "WITH n AS (SELECT count(*) AS n FROM lineitem) SELECT seg, seg * 400 AS seg_start, least(seg * 400 + 400, n) AS seg_end FROM (SELECT n, unnest(range((n + 399) // 400)) AS seg FROM n)")
def x10b(s, d):
    return B.segment_table(s, table(s, d, "lineitem").count(), 100, 4)


@query("x11_segments_from", FR + "SELECT frame_id, (frame_id - 70) // 64 AS seg, 70 + (frame_id - 70) // 64 * 64 AS seg_start FROM f WHERE frame_id >= 70")
def x11(s, d):
    return B.segments(frames(s, d).select("frame_id"), 32, 2, start=70).select("frame_id", "seg", "seg_start")


@query("x12_micro_segments", FR + "SELECT frame_id, item_idx, frame_id // 12 AS seg FROM f")
def x12(s, d):
    return B.segments(frames(s, d).select("frame_id", "item_idx"), 3, 4).select("frame_id", "item_idx", "seg")


@query("x13_next_segment", f"WITH {IX}, t AS (SELECT sum(n) AS n FROM li) SELECT end_excl - li.n AS start, end_excl, CASE WHEN end_excl < t.n THEN end_excl ELSE 0 END AS next_start, CAST(least(CASE WHEN end_excl < t.n THEN end_excl ELSE 0 END + 500, t.n) AS BIGINT) AS next_end FROM li, t")
def x13(s, d):
    return B.next_segment(_line_index(s, d), table(s, d, "lineitem").count(), 500)


STRIDED = """WITH t AS (SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber) - 1 AS id FROM lineitem),
p AS (SELECT id, id // 1001 AS seg, row_number() OVER (PARTITION BY id // 1001 ORDER BY {order}) - 1 AS pos, count(*) OVER (PARTITION BY id // 1001) AS n FROM t)
"""


@query("x14_strided_shards", STRIDED.format(order="md5('42:' || id), id") + "SELECT seg, id AS frame_id, q AS pos, CAST(q % 4 AS INT) AS rank FROM (SELECT *, unnest(list_filter([pos, pos + n, pos + 2 * n, pos + 3 * n], lambda x: x < (n + 3) // 4 * 4)) AS q FROM p)")
def x14(s, d):
    ids = s.range(table(s, d, "lineitem").count()).withColumnRenamed("id", "frame_id")
    return B.strided_shards(B.segments(ids, 1001), 4, SEED)


@query("x14_strided_shards_dropped", STRIDED.format(order="id") + "SELECT seg, id AS frame_id, pos, CAST(pos % 4 AS INT) AS rank FROM p WHERE pos < n // 4 * 4")
def x14b(s, d):
    ids = s.range(table(s, d, "lineitem").count()).withColumnRenamed("id", "frame_id")
    return B.strided_shards(B.segments(ids, 1001), 4, None, True)


@query("x15_random_eval_segment", FR + f", s AS (SELECT CAST(floor({u_sql(SEED, '7')} * greatest((SELECT count(*) FROM f) - 64, 1)) AS BIGINT) AS a) SELECT frame_id, a AS eval_start FROM f, s WHERE frame_id >= a AND frame_id < a + 64")
def x15(s, d):
    return B.random_eval_segment(frames(s, d).select("frame_id"), total(s, d), 16, 4, 7, SEED)


@query("x16_split_files", "WITH m AS (SELECT 's' || s_suppkey AS path FROM supplier), r AS (SELECT path, row_number() OVER (ORDER BY md5('42:' || path), path) AS r, count(*) OVER () AS n FROM m) SELECT path, CASE WHEN r <= floor(n * 0.8 + 1e-9) THEN 'train' ELSE 'eval' END AS split FROM r")
def x16(s, d):
    return B.split_files(table(s, d, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey")).alias("path")), 0.8, SEED)


@query("x17_check_index", f"WITH {IX}, b AS (SELECT file_id, path, n, end_excl - n + CASE WHEN file_id % 9 = 4 THEN 1 ELSE 0 END AS start, end_excl FROM li), c AS (SELECT *, coalesce(lag(end_excl) OVER (ORDER BY file_id), 0) AS before FROM b) SELECT 'gap or overlap' AS \"check\", file_id, before::VARCHAR AS detail FROM c WHERE before <> start UNION ALL SELECT 'length', file_id, n::VARCHAR FROM c WHERE end_excl - start <> n")
def x17(s, d):
    bad = _line_index(s, d).withColumn("start", F.col("start") + F.when(F.col("file_id") % 9 == 4, 1).otherwise(0))
    return X.check_index(bad)


@query("x18_check_frames", FR + "SELECT 'size' AS \"check\", frame_id AS id, 64::BIGINT AS n FROM f WHERE frame_id % 50 = 3 UNION ALL SELECT 'null or NaN', frame_id, len(list_filter(px, lambda v: v > 0.3)) FROM f WHERE len(list_filter(px, lambda v: v > 0.3)) > 0 UNION ALL SELECT 'empty rank', 4, 0")
def x18(s, d):
    f = frames(s, d).withColumn("pixels", F.transform("pixels", lambda v: F.when(v.cast("double") > 0.3, F.lit(float("nan")).cast("float")).otherwise(v))).withColumn("h", F.when(F.col("frame_id") % 50 == 3, 7).otherwise(8))
    return X.check_frames(f, B.redistribute(s, total(s, d), 4), 5)


@query("x19_progress_summary", "WITH a AS (" + _redistributed("0", None, 4) + ") SELECT rank, count(*) AS assigned, least(500, count(*)) AS processed, count(*) - least(500, count(*)) AS remaining, round(least(500, count(*)) * 100.0::DOUBLE / count(*), 6) AS percent, min(frame_id) AS first_id, max(frame_id) AS last_id, max(CASE WHEN local_pos = 499 THEN frame_id END) AS current_id FROM a GROUP BY rank")
def x19(s, d):
    p = B.progress_summary(B.redistribute(s, table(s, d, "lineitem").count(), 4), 500, 4)
    return p.withColumn("percent", rounded(F.col("percent"))).withColumn("processed", F.col("processed").cast("long"))


@query("x20_advance", "WITH c AS (SELECT o_custkey, count(*) AS n, sum(o_orderkey) AS p FROM orders GROUP BY o_custkey) SELECT o_custkey, CAST(p % n AS BIGINT) AS pos, CAST(p // n AS BIGINT) AS epochs FROM c")
def x20(s, d):
    g = table(s, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("p"))
    pos, epochs = B.advance(F.col("p"), F.col("n"))
    return g.select("o_custkey", pos.cast("long").alias("pos"), epochs.cast("long").alias("epochs"))


@query("p1_sample_subset", FR + "SELECT frame_id FROM f WHERE frame_id >= 0 AND frame_id < least(120, (SELECT count(*) FROM f))")
def p1(s, d):
    return B.sample_subset(frames(s, d).select("frame_id"), -5, 120, total(s, d))


@query("p2_event_subset", "SELECT event_id, idx FROM events JOIN (SELECT unnest([5, 3, 3, 999, 100000000]) AS e, generate_subscripts([5, 3, 3, 999, 100000000], 1)::INT - 1 AS idx) ON event_id = e")
def p2(s, d):
    return B.event_subset(table(s, d, "events").select("event_id"), [5, 3, 3, 999, 100_000_000], "event_id")


@query("p3_due", "SELECT event_id, (event_id + 1) % 7 = 0 AS due7, false AS due_none FROM events")
def p3(s, d):
    return table(s, d, "events").select("event_id", B.due(F.col("event_id"), 7).alias("due7"), B.due(F.col("event_id"), None).alias("due_none"))


# --- batches ---------------------------------------------------------------------------------------------------------
ASSIGNED = FR + ", a AS (SELECT frame_id, CAST(ntile(4) OVER (ORDER BY md5('42:' || frame_id), frame_id) - 1 AS INT) AS rank, row_number() OVER (ORDER BY md5('42:' || frame_id), frame_id) AS o, px, lab FROM f), b AS (SELECT *, row_number() OVER (PARTITION BY rank ORDER BY o) - 1 AS local_pos, count(*) OVER (PARTITION BY rank) AS cnt FROM a)"


def _assigned(s, d):
    n = total(s, d)
    return B.ranks(s.range(n).withColumnRenamed("id", "frame_id"), 4, n, SEED)


@query("b1_make_batches", ASSIGNED + " SELECT frame_id, rank, local_pos // 16 AS batch_id FROM b WHERE local_pos // 16 < cnt // 16")
def b1(s, d):
    return B.make_batches(_assigned(s, d), 16, True).select("frame_id", "rank", "batch_id")


@query("b2_cycle_batches", ASSIGNED + ", c AS (SELECT DISTINCT rank, local_pos // 16 AS batch_id, (cnt + 15) // 16 AS n FROM b) SELECT rank, batch_id, step FROM (SELECT *, unnest(range(40)) AS step FROM c) WHERE step % n = batch_id")
def b2(s, d):
    b = B.make_batches(_assigned(s, d), 16).select("rank", "batch_id").distinct()
    return B.cycle_batches(b, 40)


@query("b3_collate", ASSIGNED + " SELECT rank, local_pos // 16 AS batch_id, count(*)::INT AS n, round(sum(px[1] * (local_pos % 16 + 1)), 6) + 0.0 AS first_pixels, round(sum(list_sum(lab)), 6) AS ones FROM b GROUP BY ALL")
def b3(s, d):
    got = B.collate(B.make_batches(_assigned(s, d), 16).join(frames(s, d).select("frame_id", "pixels", "label"), "frame_id"))
    first = A.total(F.transform("inputs", lambda p, i: p[0].cast("double") * (i + 1)))
    ones = F.aggregate("targets", F.lit(0.0), lambda a, t: a + F.aggregate(t, F.lit(0.0), lambda x, v: x + v))
    return got.select("rank", "batch_id", "n", rounded(first).alias("first_pixels"), rounded(ones).alias("ones"))


@query("b4_accum_windows", ASSIGNED + ", c AS (SELECT DISTINCT rank, local_pos // 16 AS batch_id FROM b) SELECT rank, batch_id // 3 AS iteration, count(*) AS batches FROM c GROUP BY ALL")
def b4(s, d):
    return B.accum_windows(B.make_batches(_assigned(s, d), 16), 3)


# --- transforms ------------------------------------------------------------------------------------------------------
@query("p4_binarize_label", digest_sql("list_transform(px, lambda v: CASE WHEN v > 0.05 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)"))
def p4(s, d):
    return digest(T.binarize_label(frames(s, d).withColumn("label", F.col("pixels")), 0.05), "label")


@query("p5_cast_pixels", digest_sql("px"))
def p5(s, d):
    return digest(T.cast_pixels(frames(s, d)))


@query("t1_pad", digest_sql(moved_sql(11, 13, "oy - 1", "ox - 2")))
def t1(s, d):
    return digest(T.pad(frames(s, d), 11, 13))


@query("t1_pad_bottom_right_label", digest_sql(moved_sql(9, 8, "oy", "ox", "lab")))
def t1b(s, d):
    return digest(T.pad(frames(s, d), 9, 5, "bottom-right"), "label")


@query("t2_crop", digest_sql(moved_sql(5, 4, "oy + 1", "ox + 2")))
def t2(s, d):
    return digest(T.crop(frames(s, d), 5, 4))


@query("t2_crop_larger", digest_sql(moved_sql(10, 3, "oy", "ox")))
def t2b(s, d):
    return digest(T.crop(frames(s, d), 10, 3, "top-left"))


@query("t3_downscale_mean", digest_sql("list_transform(range(8), lambda i: list_sum(list_transform(range(6), lambda k: px[((i // 4) * 3 + k // 2) * 8 + (i % 4) * 2 + k % 2 + 1])) / 6)"))
def t3(s, d):
    return digest(T.downscale_mean(frames(s, d), 3, 2))


_R = lambda what, j: u_sql(SEED, "frame_id", f"'{what}'", str(j))
_RECTS = ", q AS (SELECT *, " + ", ".join(f"floor({_R('y', j)} * 8) AS t{j}, floor({_R('x', j)} * 8) AS l{j}, floor({_R('y', j)} * 8) + 3 + floor({_R('h', j)} * 3) - 1 AS b{j}, floor({_R('x', j)} * 8) + 2 + floor({_R('w', j)} * 1) - 0 AS r{j}" for j in (0, 1)) + " FROM f)"


@query("t4_random_patch", digest_sql("list_transform(range(64), lambda i: CASE WHEN (i // 8 >= t0 AND i // 8 < b0 AND i % 8 >= l0 AND i % 8 < r0) OR (i // 8 >= t1 AND i // 8 < b1 AND i % 8 >= l1 AND i % 8 < r1) THEN 0.0::DOUBLE ELSE px[i + 1] END)", "q", more=_RECTS))
def t4(s, d):
    return digest(T.random_patch(frames(s, d), 2, 3, 2, 0.4, 0.4, SEED))


@query("t5_rotate_90", digest_sql("list_transform(range(64), lambda i: px[(i % 8) * 8 + 7 - i // 8 + 1])"))
def t5(s, d):
    return digest(T.rotate(frames(s, d), F.lit(90.0)))


_TURNED = f""", a AS (SELECT frame_id, px, radians({u_sql(SEED, "frame_id", "'angle'")} * 360.0) AS t FROM f), k AS (SELECT frame_id, px, i, cos(t) AS ct, sin(t) AS st, i // 8 - 3.5::DOUBLE AS y, i % 8 - 3.5::DOUBLE AS x FROM a, (SELECT unnest(range(64)) AS i)),
b AS (SELECT frame_id, px, i, round_even((y * ct + x * st + 3.5) * 1e9, 0) / 1e9 AS sy, round_even((x * ct - y * st + 3.5) * 1e9, 0) / 1e9 AS sx FROM k),
w AS (SELECT *, CAST(floor(sy) AS BIGINT) + dy AS yy, CAST(floor(sx) AS BIGINT) + dx AS xx, abs(1 - dy - (sy - floor(sy))) * abs(1 - dx - (sx - floor(sx))) AS weight FROM b, (SELECT unnest([0, 0, 1, 1]) AS dy, unnest([0, 1, 0, 1]) AS dx)),
v AS (SELECT frame_id, i, sum(CASE WHEN yy BETWEEN 0 AND 7 AND xx BETWEEN 0 AND 7 THEN weight * px[yy * 8 + xx + 1] ELSE 0 END) AS v FROM w GROUP BY frame_id, i)
SELECT frame_id, count(*) AS n, round(sum(v * (i + 1)), 6) + 0.0 AS s1, round(sum(v * v), 6) + 0.0 AS s2 FROM v GROUP BY frame_id"""


@query("t5_random_rotate", FR + _TURNED)
def t5b(s, d):
    return digest(T.random_rotate(frames(s, d), 360.0, SEED))


_SHIFT = f", q AS (SELECT *, trunc((2 * {u_sql(SEED, 'frame_id', chr(39) + 'sy' + chr(39))} - 1) * 8 * 0.4)::INT AS sy, trunc((2 * {u_sql(SEED, 'frame_id', chr(39) + 'sx' + chr(39))} - 1) * 8 * 0.3)::INT AS sx FROM f)"


@query("t6_random_shift", digest_sql(moved_sql(8, 8, "(oy - sy)", "(ox - sx)"), "q", more=_SHIFT))
def t6(s, d):
    return digest(T.random_shift(frames(s, d), 0.4, 0.3, SEED))


@query("t7_patchify", digest_sql(moved_sql(3, 3, "(oy + p // 4 * 2)", "(ox + p % 4 * 2)").replace("(oy + p", "(oy + p"), "q", "frame_id, patch", ", q AS (SELECT frame_id, px, patch, patch AS p FROM (SELECT *, unnest(range(16)) AS patch FROM f))"))
def t7(s, d):
    return digest(T.patchify(frames(s, d), 3, 2), "pixels", "frame_id", "patch")


_DET = ", st AS (SELECT 'd' || (row_number() OVER (ORDER BY event_type) - 1) AS det, avg(value) AS m, stddev_pop(value) AS s FROM events WHERE event_type <> 'signup' GROUP BY event_type)"


def _detectors(s, d):
    g = table(s, d, "events").where("event_type <> 'signup'").groupBy("event_type").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))
    return g.select(F.concat(F.lit("d"), (F.row_number().over(Window.orderBy("event_type")) - 1).cast("string")).alias("detector"), "mean", "std")


@query("t8_norm_by_detector", digest_sql("CASE WHEN m IS NULL THEN NULL ELSE list_transform(px, lambda v: (v - m) / s) END", "(SELECT frame_id, px, m, s, CASE WHEN st.det IS NULL THEN 'unknown detector ' || f.det END AS error FROM f LEFT JOIN st ON f.det = st.det)", "frame_id, error", _DET).replace("CAST(len(v) AS BIGINT)", "coalesce(CAST(len(v) AS BIGINT), -1)"))
def t8(s, d):
    out = digest(T.norm_by_detector(frames(s, d), _detectors(s, d)), "pixels", "frame_id", "error")
    return out.withColumn("n", F.coalesce("n", F.lit(-1)))


@query("t9_norm_by_file", digest_sql("list_transform(px, lambda v: (v - m) / s)", "(SELECT frame_id, px, m, s FROM f JOIN st ON f.file_id = st.fid)", more=", st AS (SELECT CAST(replace(source, 'src', '') AS INT) AS fid, avg(n_chars) AS m, stddev_pop(n_chars) AS s FROM documents GROUP BY source)"))
def t9(s, d):
    return digest(T.norm_by_file(frames(s, d), _stats_manifest(s, d)))


_NORM = "list_transform(px, lambda v: (v - list_avg(px)) / sqrt(list_var_pop(px) + 1e-6))"


@query("t10_instance_norm", digest_sql("list_transform(px, lambda v: (v - m) / sqrt(q + 1e-6))", "(SELECT frame_id, px, list_avg(px) AS m, list_var_pop(px) AS q FROM f)"))
def t10(s, d):
    return digest(T.instance_norm(frames(s, d)))


def _polar(j: str) -> str:
    k = ("frame_id", j)
    r = f"abs(sqrt(-2 * ln(1 - {u_sql(SEED, *k, chr(39) + 'r' + chr(39), '0')})) * cos(2 * pi() * {u_sql(SEED, *k, chr(39) + 'r' + chr(39), '1')})) * 0.33"
    t = f"2 * pi() * {u_sql(SEED, *k, chr(39) + 'theta' + chr(39))}"
    at = lambda f: f"trunc(greatest(-1.0, least(1.0, {r} * {f}({t}))) * (8 - 5) / 2.0 + 4.0 - 2)::INT"
    return f", q AS (SELECT frame_id, crop, px, {at('cos')} AS top, {at('sin')} AS lft FROM (SELECT *, unnest(range(3)) AS crop FROM f))"


@query("t11_polar_crops", digest_sql(moved_sql(5, 5, "(oy + top)", "(ox + lft)").replace("tox", "t"), "q", "frame_id, crop", _polar("crop")))
def t11(s, d):
    return digest(T.polar_crops(frames(s, d), 5, 5, 0.33, 3, SEED).withColumn("crop", F.col("crop").cast("long")), "pixels", "frame_id", "crop")


@query("t12_merge_batch_patch", digest_sql(moved_sql(3, 3, "(oy + p // 4 * 2)", "(ox + p % 4 * 2)"), "q", "frame_id", ", q AS (SELECT frame_id * 16 + p AS frame_id, px, p FROM (SELECT *, unnest(range(16)) AS p FROM f))"))
def t12(s, d):
    return digest(T.merge_batch_patch(T.patchify(frames(s, d), 3, 2), 16, "patch"))


@query("t13_split_channels", digest_sql("CASE channel WHEN 0 THEN px ELSE lab END", "(SELECT *, unnest([0, 1]) AS channel FROM f)", "frame_id, channel"))
def t13(s, d):
    f = frames(s, d).withColumn("pixels", F.concat("pixels", "label")).withColumn("label", F.col("pixels")).withColumn("c", F.lit(2))
    return digest(T.split_channels(f), "pixels", "frame_id", "channel")


@query("t14_batch_sample", ASSIGNED + f", r AS (SELECT frame_id, rank * 100000 + local_pos // 16 AS batch_id FROM b), s AS (SELECT *, row_number() OVER (PARTITION BY batch_id ORDER BY {u_sql(SEED, 'batch_id', 'frame_id')}, frame_id) AS r, count(*) OVER (PARTITION BY batch_id) AS n FROM r) SELECT frame_id, batch_id FROM s WHERE r <= greatest(floor(n * 0.3 + 1e-9), 1)")
def t14(s, d):
    b = B.make_batches(_assigned(s, d), 16).select("frame_id", (F.col("rank") * 100_000 + F.col("batch_id")).alias("batch_id"))
    return T.batch_sample(b, 0.3, SEED)


@query("t15_identity", digest_sql("lab"))
def t15(s, d):
    return digest(T.identity(frames(s, d)), "label")


_CHAIN_SQL = moved_sql(6, 6, "(oy + 1)", "(ox + 1)")


@query("t16_apply_chain", digest_sql("list_transform(v0, lambda v: (v - m) / sqrt(q + 1e-6))", "(SELECT frame_id, v0, list_avg(v0) AS m, list_var_pop(v0) AS q FROM c)", more=f", c AS (SELECT frame_id, {_CHAIN_SQL} AS v0 FROM f)"))
def t16(s, d):
    return digest(T.apply_chain(frames(s, d), [lambda x: T.pad(x, 12, 12), lambda x: T.crop(x, 6, 6)], 0.5, T.instance_norm))


@query("t16_apply_chain_label", digest_sql(moved_sql(6, 6, "(oy + 1)", "(ox + 1)", "lab")))
def t16b(s, d):
    return digest(T.apply_chain(frames(s, d), [lambda x: T.pad(x, 12, 12), lambda x: T.crop(x, 6, 6)], 0.5, T.instance_norm), "label")


@query("t17_chain_from_config", digest_sql("list_transform(v0, lambda v: (v - m) / sqrt(q + 1e-6))", "(SELECT frame_id, v0, list_avg(v0) AS m, list_var_pop(v0) AS q FROM c)", more=_SHIFT + f", c AS (SELECT frame_id, {moved_sql(8, 8, '(oy - sy)', '(ox - sx)')} AS v0 FROM q)"))
def t17(s, d):
    settings = {"instance_norm": {}, "random_shift": {"frac_y": 0.4, "frac_x": 0.3, "seed": SEED}, "random_patch": None}
    return digest(T.apply_chain(frames(s, d), T.chain_from_config(settings)))


@query("m3_custom_transform", digest_sql("list_transform(px, lambda v: v * 2 + 1)"))
def m3(s, d):
    return digest(T.apply_chain(frames(s, d), [lambda x: x.withColumn("pixels", F.transform("pixels", lambda v: v.cast("double") * 2 + 1))]))


# --- detector --------------------------------------------------------------------------------------------------------
def _panels(s, d):
    """Embeddings as panels of 8 x 8: event vec_id div 4, panel vec_id % 4."""
    return table(s, d, "embeddings").select(F.expr("vec_id div 4").alias("event"), (F.col("vec_id") % 4).cast("int").alias("panel"), F.lit(8).alias("h"), F.lit(8).alias("w"), F.transform("embedding", lambda v: v.cast("double")).alias("pixels"))


def _geom(s, d):
    """Four panels at (0, 0), (9, 1), (1, 10), (10, 9)."""
    n = table(s, d, "nation").where("n_nationkey < 4").select(F.col("n_nationkey").cast("int").alias("panel"))
    x0, y0 = F.col("panel") % 2 * 9 + F.expr("panel div 2"), F.expr("panel div 2") * 9 + (F.col("panel") % 4 == 2).cast("int")
    return n.select("panel", x0.cast("int").alias("x_min"), y0.cast("int").alias("y_min"), (x0 + 8).cast("int").alias("x_max"), (y0 + 8).cast("int").alias("y_max"))


PN = "WITH p AS (SELECT vec_id // 4 AS event, CAST(vec_id % 4 AS INT) AS panel, list_transform(embedding, lambda v: v::DOUBLE) AS px FROM embeddings), g AS (SELECT CAST(n_nationkey AS INT) AS panel, CAST(n_nationkey % 2 * 9 + n_nationkey // 2 AS INT) AS x_min, CAST(n_nationkey // 2 * 9 + (CASE WHEN n_nationkey = 2 THEN 1 ELSE 0 END) AS INT) AS y_min FROM nation WHERE n_nationkey < 4)"
SUMS = "CAST(len(v) AS BIGINT) AS n, round(list_sum(list_transform(v, lambda x, i: x * i)), 6) + 0.0 AS s1, round(list_sum(list_transform(v, lambda x: x * x)), 6) + 0.0 AS s2"


def _mask(s, d):
    g = _geom(s, d).select("panel", F.lit(8).alias("h"), F.lit(8).alias("w"))
    return g.withColumn("mask", F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: ((i + F.col("panel")) % 5 != 0).cast("int")))


@query("d1_apply_mask", PN + f", q AS (SELECT event, panel, list_transform(px, lambda v, i: CASE WHEN (i - 1 + panel) % 5 <> 0 THEN v ELSE -1.0::DOUBLE END) AS v FROM p) SELECT event, panel, {SUMS} FROM q")
def d1(s, d):
    return digest(D.apply_mask(_panels(s, d), _mask(s, d), -1.0), "pixels", "event", "panel")


@query("d2_prepare_events", PN + f", a AS (SELECT DISTINCT event + 3 AS event, event AS idx FROM p), q AS (SELECT a.event, g.panel, a.idx, list_transform(range(64), lambda i: CASE WHEN (i + g.panel) % 5 <> 0 THEN coalesce(px[i + 1], 0.0::DOUBLE) ELSE 0.0::DOUBLE END) AS v FROM a CROSS JOIN g LEFT JOIN p ON p.event = a.event AND p.panel = g.panel) SELECT idx, event, panel, {SUMS} FROM q")
def d2(s, d):
    p = _panels(s, d)
    asked = p.select("event").distinct().select(F.col("event").alias("idx"), (F.col("event") + 3).alias("event"))
    return digest(D.prepare_events(asked, p, _mask(s, d)), "pixels", "idx", "event", "panel")


@query("d3_select_panel", PN + f", q AS (SELECT event, px AS v FROM p WHERE panel = 2) SELECT event, {SUMS} FROM q")
def d3(s, d):
    return digest(D.select_panel(_panels(s, d), 2), "pixels", "event")


@query("d4_assemble_panels", FR + f", k AS (SELECT frame_id, unnest(range(64)) AS i, unnest(px) AS pv FROM f), c AS (SELECT frame_id, CAST(round_even(i % 8 * 1.5, 0) AS INT) AS x, CAST(round_even(i // 8 * 0.8, 0) AS INT) AS y, max(i) AS i, arg_max(pv, i) AS pv FROM k GROUP BY 1, 2, 3) SELECT frame_id, CAST(7 * 11 AS BIGINT) AS n, round(sum(pv * (y * 11 + x + 1)), 6) + 0.0 AS s1, round(sum(pv * pv), 6) + 0.0 AS s2 FROM (SELECT * FROM c) GROUP BY frame_id")
def d4(s, d):
    i = F.sequence(F.lit(0), F.lit(63))
    spots = s.range(1).select(F.transform(i, lambda k: k % 8 * 1.5 + 100).alias("x"), F.transform(i, lambda k: F.floor(k / 8) * 0.8).alias("y"), F.transform(i, lambda k: k * 0.0).alias("z"))
    return digest(D.assemble_panels(frames(s, d), spots))


@query("d5_panel_bounds", "SELECT CAST(n_regionkey AS INT) AS panel, min(n_nationkey * 3 % 17) AS x_min, min(n_nationkey * 7 % 19) AS y_min, max(n_nationkey * 3 % 17 + 9) + 1 AS x_max, max(n_nationkey * 7 % 19 + 5) + 1 AS y_max FROM nation WHERE n_nationkey <> 24 GROUP BY n_regionkey")
def d5(s, d):
    x, y = F.col("n_nationkey") * 3 % 17, F.col("n_nationkey") * 7 % 19
    name = F.when(F.col("n_nationkey") == 24, "other").otherwise(F.concat(F.lit("p"), F.col("n_regionkey"), F.lit("a"), F.col("n_nationkey")))
    return D.panel_bounds(table(s, d, "nation").select(name.alias("name"), x.alias("x_min"), y.alias("y_min"), (x + 9).alias("x_max"), (y + 5).alias("y_max")))


_MOSAIC = PN + ", c AS (SELECT event, panel, y_min + (i - 1) // 8 AS y, x_min + (i - 1) % 8 AS x, v FROM (SELECT event, p.panel, x_min, y_min, unnest(px) AS v, generate_subscripts(px, 1) AS i FROM p JOIN g ON p.panel = g.panel)), m AS (SELECT event, y, x, arg_max(v, panel) AS v FROM c GROUP BY ALL)"


@query("d6_to_mosaic", _MOSAIC + " SELECT event, 18 AS h, 18 AS w, round(sum(v * (y * 18 + x + 1)), 6) + 0.0 AS s1, round(sum(v * v), 6) + 0.0 AS s2 FROM m GROUP BY event")
def d6(s, d):
    return digest(D.to_mosaic(_panels(s, d), _geom(s, d)), "pixels", "event", "h", "w").drop("n")


@query("d7_from_mosaic", PN + ", k AS (SELECT event, unnest([0, 1, 2, 3]) AS panel FROM (SELECT DISTINCT event FROM p)), q AS (SELECT k.event, k.panel::INT AS panel, coalesce(px, list_transform(range(64), lambda i: 0.0::DOUBLE)) AS v FROM k LEFT JOIN p ON k.event = p.event AND k.panel = p.panel) SELECT event, panel, " + SUMS + " FROM q")
def d7(s, d):
    return digest(D.from_mosaic(D.to_mosaic(_panels(s, d), _geom(s, d)), _geom(s, d)), "pixels", "event", "panel")


@query("d8_peaks_to_mosaic", PN + ", k AS (SELECT event_id, CAST(event_id % 5 AS INT) AS panel, CAST(event_id % 8 AS INT) AS y, CAST(user_id % 8 AS INT) AS x FROM events) SELECT event_id, k.panel, y + y_min AS mosaic_y, x + x_min AS mosaic_x, CASE WHEN g.panel IS NULL THEN 'unknown panel' END AS error FROM k LEFT JOIN g ON k.panel = g.panel")
def d8(s, d):
    k = table(s, d, "events").select("event_id", (F.col("event_id") % 5).cast("int").alias("panel"), (F.col("event_id") % 8).cast("int").alias("y"), (F.col("user_id") % 8).cast("int").alias("x"))
    return D.peaks_to_mosaic(k, _geom(s, d)).drop("x", "y")


@query("d9_zero_outliers", "WITH q AS (SELECT event_type, quantile_cont(value, 0.05) AS a, quantile_cont(value, 0.95) AS b FROM events GROUP BY event_type) SELECT event_id, round(CASE WHEN value >= a - 1.5 * (b - a) AND value <= b + 1.5 * (b - a) THEN value ELSE 0 END, 6) AS kept FROM events JOIN q USING (event_type)")
def d9(s, d):
    return D.zero_outliers(table(s, d, "events"), "value", ["event_type"]).select("event_id", rounded(F.col("kept")).alias("kept"))


# --- targets, losses -------------------------------------------------------------------------------------------------
@query("l1_one_hot", digest_sql("list_concat(list_transform(lab, lambda v: 1 - v), lab)"))
def l1(s, d):
    f = frames(s, d).withColumn("planes", F.flatten(L.one_hot(F.col("label").cast("array<int>"), 2)))
    return digest(f, "planes")


def _logits(s, d):
    f = frames(s, d)
    return f.withColumn("logits", F.array(F.transform("pixels", lambda v: v.cast("double") * 8), F.transform("pixels", lambda v: -v.cast("double") * 8)))


@query("l2_softmax", digest_sql("list_concat(list_transform(px, lambda v: exp(8 * v - abs(8 * v)) / (exp(8 * v - abs(8 * v)) + exp(-8 * v - abs(8 * v)))), list_transform(px, lambda v: exp(-8 * v - abs(8 * v)) / (exp(8 * v - abs(8 * v)) + exp(-8 * v - abs(8 * v)))))"))
def l2(s, d):
    return digest(_logits(s, d).withColumn("p", F.flatten(L.softmax(F.col("logits")))), "p")


_FOCAL = "list_transform(list_zip(px, lab), lambda z: CASE WHEN z[2] > 0.5 THEN -0.75 * pow(1 - 1 / (1 + exp(16 * z[1])), 2) * ln(1 / (1 + exp(16 * z[1]))) ELSE -0.25 * pow(1 - 1 / (1 + exp(-16 * z[1])), 2) * ln(1 / (1 + exp(-16 * z[1]))) END)"


def _focal(s, d):
    return _logits(s, d).withColumn("loss", L.focal_loss(F.col("logits"), F.col("label"), [0.25, 0.75]))


@query("l3_focal_loss", digest_sql(_FOCAL))
def l3(s, d):
    return digest(_focal(s, d), "loss")


_UNITS = FR + f", k AS (SELECT frame_id, unnest(range(16)) AS unit FROM f), m AS (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY {u_sql(SEED, 'frame_id', 'unit')}, unit) <= 6 AS keep FROM k)"


def _unit_mask(s, d):
    units = frames(s, d).select("frame_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(15).cast("long"))).alias("unit"))
    return L.mask_units(units, 0.6, SEED)


@query("l4_mask_units", _UNITS + " SELECT frame_id, unit, keep FROM m")
def l4(s, d):
    return _unit_mask(s, d)


@query("l4_mask_bits", _UNITS + " SELECT frame_id, string_agg(unit::VARCHAR, ',' ORDER BY unit) AS hidden FROM m WHERE NOT keep GROUP BY frame_id")
def l4_bits(s, d):
    hidden = L.hidden_units(L.mask_bits(16, 0.6, SEED), 16)
    return frames(s, d).select("frame_id", F.array_join(F.transform(hidden, lambda i: i.cast("string")), ",").alias("hidden"))


_TARGETS = _UNITS + ", t AS (SELECT m.frame_id, unit AS patch, list_transform(range(4), lambda i: px[(unit // 4 * 2 + i // 2) * 8 + unit % 4 * 2 + i % 2 + 1]) AS t0 FROM m JOIN f USING (frame_id) WHERE NOT keep), tt AS (SELECT frame_id, patch, t0, list_transform(t0, lambda v: (v - a) / sqrt(q + 1e-6)) AS v FROM (SELECT *, list_avg(t0) AS a, list_var_samp(t0) AS q FROM t))"


@query("l5_patch_targets", _TARGETS + f" SELECT frame_id, patch, {SUMS} FROM tt")
def l5(s, d):
    return digest(L.patch_targets(frames(s, d), 2, _unit_mask(s, d)), "target", "frame_id", "patch")


@query("l5_patch_targets_bits", ORACLE_SQL["l5_patch_targets"])
def l5_bits(s, d):
    """Masks in the frames' rows: no join."""
    return digest(L.patch_targets(frames(s, d), 2, bits=L.mask_bits(16, 0.6, SEED)), "target", "frame_id", "patch")


@query("l6_patch_targets_3d", FR + f", k AS (SELECT frame_id // 4 AS video, frame_id % 4 // 2 * 4 + p AS patch, list_transform(range(16), lambda i: px[(p // 2 * 4 + i // 4) * 8 + p % 2 * 4 + i % 4 + 1]) AS v FROM (SELECT *, unnest(range(4)) AS p FROM f WHERE frame_id % 2 = 0)) SELECT video, patch, {SUMS} FROM k")
def l6(s, d):
    f = frames(s, d).withColumn("video", F.expr("frame_id div 4")).withColumn("t", F.col("frame_id") % 4)
    return digest(L.patch_targets_3d(f, 4, 2, norm=False), "target", "video", "patch")


@query("l7_masked_mse", _TARGETS + " SELECT round(sum(list_sum(list_transform(list_zip(v, t0), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) / sum(len(v)), 6) AS loss, count(*) AS patches FROM tt")
def l7(s, d):
    f = frames(s, d)
    raw = L.patch_targets(f, 2, norm=False).select("frame_id", "patch", F.col("target").alias("prediction"))
    return L.masked_mse(L.patch_targets(f, 2, _unit_mask(s, d)), raw).select(rounded(F.col("loss")).alias("loss"), "patches")


@query("l7_masked_mse_bits", ORACLE_SQL["l7_masked_mse"])
def l7_bits(s, d):
    got = L.masked_mse_in_rows(frames(s, d), 2, L.mask_bits(16, 0.6, SEED), T.patch_arrays("pixels", 2, 2))
    return got.select(rounded(F.col("loss")).alias("loss"), "patches")


@query("l8_stitch_patches", digest_sql("px"))
def l8(s, d):
    return digest(L.stitch_patches(T.patchify(frames(s, d), 2, 2), 2, 4, 4))


@query("l8_stitch_classes", digest_sql("list_concat(px, list_concat(list_transform(px, lambda v: v * 2), list_transform(px, lambda v: v * -3)))"))
def l8_classes(s, d):
    """Patches of three classes side by side, as a decoder gives them, become three maps."""
    cut = T.patchify(frames(s, d), 2, 2).withColumn("pixels", F.flatten(F.transform(F.col("pixels").cast("array<double>"), lambda v: F.array(v, v * 2, v * -3))))
    return digest(L.stitch_patches(cut, 2, 4, 4, classes=3))


@query("l9_resize_mask", digest_sql("list_transform(range(20 * 12), lambda i: lab[(i // 12 * 8 // 20) * 8 + i % 12 * 8 // 12 + 1])"))
def l9(s, d):
    return digest(T.resize_nearest(frames(s, d), 20, 12), "label")


@query("l10_max_pool_groups", FR + ", k AS (SELECT frame_id, unnest(px) AS v, generate_subscripts(px, 1) - 1 AS pos FROM f) SELECT frame_id, pos % 16 AS pos, max(v) AS value FROM k GROUP BY ALL")
def l10(s, d):
    units = frames(s, d).select("frame_id", F.posexplode("pixels").alias("pos", "value")).select("frame_id", F.col("pos").cast("long").alias("pos"), F.col("value").cast("double").alias("value"))
    return L.max_pool_groups(units, 4)


# --- evaluation ------------------------------------------------------------------------------------------------------
EV = "WITH l AS (SELECT CAST(user_id % 4 AS INT) AS rank, event_id // 16 AS batch_id, CASE WHEN event_type = 'error' AND event_id % 3 = 0 THEN 'nan'::DOUBLE ELSE value END AS loss, event_id, ts FROM events), b AS (SELECT rank, batch_id, sum(loss) / count(*) AS loss, count(*) AS n FROM l GROUP BY ALL)"


def _losses(s, d):
    loss = F.when((F.col("event_type") == "error") & (F.col("event_id") % 3 == 0), float("nan")).otherwise(F.col("value"))
    return table(s, d, "events").select((F.col("user_id") % 4).cast("int").alias("rank"), F.expr("event_id div 16").alias("batch_id"), loss.alias("loss"), "event_id")


def _batches(s, d):
    return E.batch_loss(_losses(s, d))


def _nan_free(c):
    return F.when(~F.isnan(c), rounded(c))


@query("e1_batch_loss", EV + " SELECT rank, batch_id, CASE WHEN NOT isnan(loss) THEN round(loss, 6) END AS loss, n FROM b")
def e1(s, d):
    return _batches(s, d).withColumn("loss", _nan_free(F.col("loss")))


@query("e1_batch_loss_of_maps", ASSIGNED + f", c AS (SELECT rank, local_pos // 16 AS batch_id, list_sum({_FOCAL}) AS v FROM b) SELECT rank, batch_id, round(sum(v) / (64 * count(*)), 6) AS loss, CAST(64 * count(*) AS BIGINT) AS n FROM c GROUP BY ALL")
def e1b(s, d):
    losses = B.make_batches(_assigned(s, d), 16).join(_focal(s, d).select("frame_id", "loss"), "frame_id")
    return E.batch_loss(losses).withColumn("loss", rounded(F.col("loss")))


@query("e2_eval_loss", EV + ", r AS (SELECT rank, avg(loss) AS m FROM b WHERE NOT isnan(loss) GROUP BY rank) SELECT round(sum(m) / (count(*) + 1e-6), 6) AS loss, 5 - count(*) AS nan_ranks FROM r")
def e2(s, d):
    return E.eval_loss(_batches(s, d), 5).withColumn("loss", rounded(F.col("loss")))


@query("e3_eval_loss_weighted", EV + " SELECT round(sum(loss * n) / sum(n), 6) AS loss, 4 - count(DISTINCT rank) AS nan_ranks FROM b WHERE NOT isnan(loss)")
def e3(s, d):
    return E.eval_loss(_batches(s, d), 4, weighted=True).withColumn("loss", rounded(F.col("loss")))


@query("e4_limit_batches", EV + " SELECT rank, batch_id, n FROM b WHERE batch_id < 20")
def e4(s, d):
    return E.limit_batches(_batches(s, d), 20).drop("loss")


@query("e5_best_checkpoints", EV + ", v AS (SELECT rank, batch_id AS step, loss FROM b WHERE NOT isnan(loss)), w AS (SELECT *, min(loss) OVER (PARTITION BY rank ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM v) SELECT rank, step, round(loss, 6) AS loss FROM w WHERE before IS NULL OR loss < before")
def e5(s, d):
    best = E.best_checkpoints(_batches(s, d).select("rank", F.col("batch_id").alias("step"), "loss"), ["rank"])
    return best.select("rank", "step", rounded(F.col("loss")).alias("loss"))


@query("e6_iteration_rollup", "WITH b AS (SELECT CAST(user_id % 4 AS INT) AS rank, event_id // 16 AS batch_id, value AS loss, 4096 * (1 + event_id % 3) AS numel, 0.5 + event_id % 7 AS seconds FROM events), o AS (SELECT batch_id // 4 AS iteration, rank, avg(loss) AS l, sum(numel / 256.0::DOUBLE) AS t, sum(seconds)::DOUBLE AS s FROM b GROUP BY ALL), g AS (SELECT iteration, avg(l) AS loss, sum(t) AS tokens, max(CASE WHEN rank = 0 THEN s END) AS seconds FROM o GROUP BY iteration) SELECT iteration, round(loss, 6) AS loss, round(tokens, 6) AS tokens, round(tokens / seconds, 6) AS tokens_per_sec, round(tokens / seconds * 6e9 / 312e12, 9) AS mfu FROM g")
def e6(s, d):
    b = table(s, d, "events").select((F.col("user_id") % 4).cast("int").alias("rank"), F.expr("event_id div 16").alias("batch_id"), F.col("value").alias("loss"), (4096 * (1 + F.col("event_id") % 3)).alias("numel"), (0.5 + F.col("event_id") % 7).alias("seconds"))
    r = E.iteration_rollup(b, 4, 16, 6e9, 312e12)
    return r.select("iteration", *[rounded(F.col(c)).alias(c) for c in ("loss", "tokens", "tokens_per_sec")], rounded(F.col("mfu"), 9).alias("mfu"))


@query("e7_is_last_batch", EV + " SELECT rank, batch_id, batch_id = max(batch_id) OVER (PARTITION BY rank) AS last FROM b")
def e7(s, d):
    b = _batches(s, d)
    n = b.groupBy("rank").agg((F.max("batch_id") + 1).alias("n_batches"))
    return b.join(n, "rank").select("rank", "batch_id", E.is_last_batch(F.col("batch_id"), F.col("n_batches")).alias("last"))


@query("p6_drop_none_batches", "SELECT event_id FROM events WHERE event_type <> 'view'")
def p6(s, d):
    e = table(s, d, "events").withColumn("loss", F.when(F.col("event_type") != "view", F.col("value")))
    return E.drop_none_batches(e).select("event_id")


# --- run logs --------------------------------------------------------------------------------------------------------
def _messages() -> list:
    """The messages that a trainer writes, by event_id % 8: four of training losses, one each of activations, updates, an evaluation and a save."""
    f, i = F.format_string, lambda e: F.expr(e).cast("string")
    segment = F.concat(i("event_id div 100 * 100"), F.lit("-"), i("event_id div 100 * 100 + 100"))
    train = F.concat(
        F.lit("rank="), i("user_id % 4"), F.lit(" | logevent=LOSS:TRAIN | iteration="), i("event_id"), F.lit(" | segment="), segment, F.lit(" | learning_rate="), f("%.6f", F.col("value") / 1000), F.lit(","), f("%.6f", F.col("value") / 500),
        F.lit(" | grad_norm="), f("%.6f", "value"), F.lit(" | mean_train_loss="), f("%.6f", F.col("value") * 2), F.lit(" | tokens_per_sec="), f("%.1e", F.col("event_id") * 1.37 + 1000.003), F.lit(" | mfu_per_iteration=0.412 | grad_nosync_counter="), i("event_id % 5"),
    )
    num = lambda e: F.when(F.col("event_id") % 11 == 0, "nan").otherwise(F.round(F.expr(e), 3).cast("string"))
    act = F.concat(F.lit("rank="), i("user_id % 4"), F.lit(" | iteration="), i("event_id div 400"), F.lit(" | logevent=DYNAMICS:ACT | name=stages."), i("event_id div 8 % 3"), F.lit(".act | preact.mean="), num("value"), F.lit(" | preact.std="), num("value / 2"), F.lit(" | act.mean="), num("value * 3"), F.lit(" | act.std="), num("value + 1"))
    update = F.concat(F.lit("rank="), i("user_id % 4"), F.lit(" | iteration="), i("event_id div 400"), F.lit(" | logevent=DYNAMICS:PARAMS | type=encoder | name=stages."), i("event_id div 8 % 3"), F.lit(".weight | update="), F.when(F.col("event_id") % 11 == 0, "-inf").otherwise(F.concat(F.lit("-"), F.round("value", 3).cast("string"))))
    evaluation = F.concat(F.lit("[RANK 0] LOSS:EVAL - epoch "), i("event_id div 400"), F.lit(", seg "), i("event_id div 400 * 400"), F.lit("-"), i("event_id div 400 * 400 + 400"), F.lit(", mean "), F.when(F.col("event_id") % 16 == 6, "train").otherwise("validation"), F.lit(" loss = "), f("%.8f", "value"))
    root = F.concat(F.lit("chkpts/v1."), _run_id())
    save = F.when(F.col("event_id") % 16 == 7, F.concat(F.lit("Saving checkpoint at "), root, F.lit(".epoch_"), i("event_id div 400"), F.lit(".end_idx_"), i("event_id"), F.lit("."))).otherwise(
        F.concat(F.lit("[RANK "), i("user_id % 4"), F.lit("] Saving preemptive checkpoint (epoch "), i("event_id div 400"), F.lit(", end_idx "), i("event_id"), F.lit(") at "), root, F.lit(".preempt."))
    )
    return [train, act, update, evaluation, save]


def _run_id():
    """A run for every 60 users, named as its start names it."""
    return F.concat(F.lit("2024_0101_00"), F.lpad(F.col("user_id") % 60, 2, "0"), F.lit("_05"))


RUN = "'2024_0101_00' || lpad((user_id % 60)::VARCHAR, 2, '0') || '_05'"


def _num_sql(e: str) -> str:
    return f"CASE WHEN event_id % 11 = 0 THEN 'nan' ELSE round({e}, 3)::VARCHAR END"


_MESSAGES_SQL = [
    "'rank=' || user_id % 4 || ' | logevent=LOSS:TRAIN | iteration=' || event_id || ' | segment=' || event_id // 100 * 100 || '-' || (event_id // 100 * 100 + 100) || ' | learning_rate=' || printf('%.6f', value / 1000) || ',' || printf('%.6f', value / 500) || ' | grad_norm=' || printf('%.6f', value) || ' | mean_train_loss=' || printf('%.6f', value * 2) || ' | tokens_per_sec=' || printf('%.1e', event_id * 1.37::DOUBLE + 1000.003::DOUBLE) || ' | mfu_per_iteration=0.412 | grad_nosync_counter=' || event_id % 5",
    f"'rank=' || user_id % 4 || ' | iteration=' || event_id // 400 || ' | logevent=DYNAMICS:ACT | name=stages.' || event_id // 8 % 3 || '.act | preact.mean=' || {_num_sql('value')} || ' | preact.std=' || {_num_sql('value / 2')} || ' | act.mean=' || {_num_sql('value * 3')} || ' | act.std=' || {_num_sql('value + 1')}",
    "'rank=' || user_id % 4 || ' | iteration=' || event_id // 400 || ' | logevent=DYNAMICS:PARAMS | type=encoder | name=stages.' || event_id // 8 % 3 || '.weight | update=' || CASE WHEN event_id % 11 = 0 THEN '-inf' ELSE '-' || round(value, 3)::VARCHAR END",
    "'[RANK 0] LOSS:EVAL - epoch ' || event_id // 400 || ', seg ' || event_id // 400 * 400 || '-' || (event_id // 400 * 400 + 400) || ', mean ' || CASE WHEN event_id % 16 = 6 THEN 'train' ELSE 'validation' END || ' loss = ' || printf('%.8f', value)",
    f"CASE WHEN event_id % 16 = 7 THEN 'Saving checkpoint at chkpts/v1.' || {RUN} || '.epoch_' || event_id // 400 || '.end_idx_' || event_id || '.' ELSE '[RANK ' || user_id % 4 || '] Saving preemptive checkpoint (epoch ' || event_id // 400 || ', end_idx ' || event_id || ') at chkpts/v1.' || {RUN} || '.preempt.' END",
]
#: Records r(run_id, rank, ts, level, logger, message, event_id, user_id, value).
REC = f"WITH r AS (SELECT {RUN} AS run_id, CASE WHEN user_id % 60 > 0 THEN CAST(user_id % 4 AS INT) END AS rank, date_trunc('second', ts) AS ts, 'INFO' AS level, '__main__' AS logger, CASE WHEN event_id % 8 < 4 THEN {_MESSAGES_SQL[0]} " + " ".join(f"WHEN event_id % 8 = {k + 3} THEN {m}" for k, m in enumerate(_MESSAGES_SQL) if k) + " END AS message, event_id, user_id, value FROM events) "


def _logs(s, d):
    """Events as records of a trainer's rank logs, a header line and a message; the first of 60 runs is a single process, whose headers have no rank."""
    rank = F.when(F.col("user_id") % 60 > 0, F.concat(F.lit("[RANK "), F.col("user_id") % 4, F.lit("] "))).otherwise("")
    head = F.concat(F.date_format("ts", "MM/dd/yyyy HH:mm:ss"), F.lit(" "), rank, F.lit("INFO __main__"))
    train, *others = _messages()
    message = F.when(F.col("event_id") % 8 < 4, train)
    for k, m in enumerate(others, 4):
        message = message.when(F.col("event_id") % 8 == k, m)
    return table(s, d, "events").select(_run_id().alias("run_id"), F.concat(head, F.lit("\n"), message, F.lit("\n")).alias("value"))


def _records(s, d):
    return R.parse_kv(R.parse_records(_logs(s, d)))


@query("r1_parse_records", REC + "SELECT run_id, rank, ts, level, logger, message FROM r")
def r1(s, d):
    return R.parse_records(_logs(s, d))


@query("r2_parse_kv", REC + "SELECT regexp_extract(message, 'logevent=([A-Z:]+)', 1) AS logevent, nullif(regexp_extract(message, 'iteration=([0-9]+)', 1), '') AS iteration, nullif(regexp_extract(message, 'segment=([0-9-]+)', 1), '') AS segment, CAST(len(string_split(message, ' | ')) AS BIGINT) AS keys FROM r WHERE event_id % 8 < 6 UNION ALL SELECT NULL, NULL, NULL, 0 + contains(message, ' = ')::BIGINT FROM r WHERE event_id % 8 >= 6")
def r2(s, d):
    get = lambda k: F.try_element_at("kv", F.lit(k)).alias(k)
    return _records(s, d).select("logevent", get("iteration"), get("segment"), F.size("kv").cast("long").alias("keys"))


@query("r3_train_curve", f"WITH t AS (SELECT {RUN} AS run_id, CAST(user_id % 4 AS INT) AS rank, event_id AS iteration, printf('%.6f', value / 1000)::DOUBLE AS learning_rate, printf('%.6f', value / 500)::DOUBLE AS second_rate, printf('%.6f', value)::DOUBLE AS grad_norm, printf('%.6f', value * 2)::DOUBLE AS loss, printf('%.1e', event_id * 1.37::DOUBLE + 1000.003::DOUBLE)::DOUBLE AS tokens_per_sec, CAST(event_id % 5 AS INT) AS accum FROM events WHERE event_id % 8 < 4) SELECT run_id, rank, iteration, learning_rate, second_rate, 2 AS rates, grad_norm, loss, tokens_per_sec, 0.412::DOUBLE AS mfu, accum, round(avg(loss) OVER (PARTITION BY run_id, rank ORDER BY iteration ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 6) AS smooth_loss FROM t")
def r3(s, d):
    got = R.train_curve(_records(s, d))
    rates = {"second_rate": F.col("learning_rates")[1], "rates": F.size("learning_rates"), "smooth_loss": rounded(F.col("smooth_loss"))}
    return got.withColumns(rates).drop("segment", "learning_rates")


@query("r4_activation_stats", REC + "SELECT run_id, event_id // 400 AS iteration, 'stages.' || event_id // 8 % 3 || '.act' AS name, " + ", ".join(f"round(avg(CASE WHEN event_id % 11 = 0 THEN 'nan'::DOUBLE ELSE round({e}, 3) END), 6) AS {c}" for c, e in (("pre_mean", "value"), ("pre_std", "value / 2"), ("post_mean", "value * 3"), ("post_std", "value + 1"))) + " FROM r WHERE event_id % 8 = 4 GROUP BY 1, 2, 3")
def r4(s, d):
    got = R.activation_stats(_records(s, d))
    return got.select("run_id", "iteration", "name", *[rounded(F.col(c)).alias(c) for c in ("pre_mean", "pre_std", "post_mean", "post_std")])


@query("r5_param_update_curve", REC + "SELECT run_id, event_id // 400 AS iteration, 'encoder' AS type, 'stages.' || event_id // 8 % 3 || '.weight' AS name, round(avg(-round(value, 3)) FILTER (event_id % 11 <> 0), 6) AS update, count(*) FILTER (event_id % 11 <> 0) AS ranks FROM r WHERE event_id % 8 = 5 GROUP BY ALL")
def r5_lines(s, d):
    return R.param_update_curve(_records(s, d)).withColumn("update", rounded(F.col("update")))


@query("r5_param_update_stats", "SELECT l_returnflag || '.' || l_linestatus AS name, round(log10(stddev_samp(l_discount * 0.01) / stddev_samp(l_quantity)), 6) AS percent_update, round(avg(l_discount), 6) AS grad_mean, round(stddev_samp(l_discount), 6) AS grad_std FROM lineitem GROUP BY 1")
def r5(s, d):
    p = table(s, d, "lineitem").select(F.concat_ws(".", "l_returnflag", "l_linestatus").alias("name"), F.col("l_discount").alias("grad"), F.col("l_quantity").alias("weight"))
    r = R.param_update_stats(p, 0.01)
    return r.select("name", *[rounded(F.col(c)).alias(c) for c in ("percent_update", "grad_mean", "grad_std")])


@query("p7_params_matching", "SELECT name FROM (SELECT 'layer' || event_id % 12 || CASE WHEN event_id % 2 = 0 THEN '.bias' ELSE '.weight' END AS name FROM events) WHERE contains(name, 'layer1') AND NOT contains(name, '.bias')")
def p7(s, d):
    name = F.concat(F.lit("layer"), F.col("event_id") % 12, F.when(F.col("event_id") % 2 == 0, ".bias").otherwise(".weight"))
    return R.params_matching(table(s, d, "events").select(name.alias("name")), "layer1", weights_only=True)


@query("r6_eval_curve", REC + ", g AS (SELECT run_id, CAST(event_id // 400 AS INT) AS epoch, event_id // 400 * 400 AS seg_start, avg(printf('%.8f', value)::DOUBLE) FILTER (event_id % 16 = 6) AS t, avg(printf('%.8f', value)::DOUBLE) FILTER (event_id % 16 <> 6) AS v FROM r WHERE event_id % 8 = 6 GROUP BY ALL) SELECT run_id, epoch, seg_start, seg_start + 400 AS seg_end, round(t, 6) AS train, round(v, 6) AS validation, round(v - t, 6) + 0.0 AS gap FROM g")
def r6(s, d):
    got = R.eval_curve(R.parse_records(_logs(s, d)))
    return got.select("run_id", "epoch", "seg_start", "seg_end", *[rounded(F.col(c)).alias(c) for c in ("train", "validation", "gap")])


_CATALOG = REC + """, k AS (SELECT run_id, ts, CAST(event_id // 400 AS INT) AS epoch, event_id AS end_idx, event_id % 16 <> 7 AS preempt FROM r WHERE event_id % 8 = 7),
p AS (SELECT 'chkpts/v1.' || run_id || '.epoch_' || epoch || '.end_idx_' || end_idx AS path, run_id, epoch, end_idx, preempt FROM k WHERE NOT preempt
UNION ALL SELECT 'chkpts/v1.' || run_id || '.preempt', run_id, b[1], b[2], true FROM (SELECT run_id, arg_max((epoch, end_idx), (ts, epoch, end_idx)) AS b FROM k WHERE preempt GROUP BY run_id))
SELECT path, 'v1' AS prefix, run_id, epoch, end_idx, preempt, row_number() OVER (PARTITION BY run_id ORDER BY epoch DESC, end_idx DESC, preempt DESC) = 1 AS latest FROM p"""


@query("r7_checkpoint_catalog", _CATALOG)
def r7(s, d):
    """The folders that the logs tell of, a preemptive one of each run among them, with the place of its last record."""
    saves = R.checkpoint_saves(R.parse_records(_logs(s, d)))
    return R.checkpoint_catalog(saves.select("path").distinct(), saves)


@query("r8_run_time", "SELECT event_id, date_trunc('second', ts) AS ts, CAST(strftime(ts, '%Y%m%d%H%M%S') AS BIGINT) AS packed, date_trunc('second', ts) AS unpacked FROM events")
def r8(s, d):
    e = table(s, d, "events").select("event_id", R.run_time(F.date_format("ts", "yyyy_MMdd_HHmm_ss")).alias("ts"))
    return e.select("event_id", "ts", R.packed_time(F.col("ts")).alias("packed")).withColumn("unpacked", R.unpacked_time(F.col("packed")))


@query("r9_lr_audit", "WITH c AS (SELECT event_id AS iteration, CASE WHEN event_id = 0 THEN -1.0 WHEN event_id % 10 = 3 THEN 0.5 END AS odd, CASE WHEN event_id < 100 THEN 0.001 * event_id / 100 WHEN event_id > 5000 THEN 1e-5 ELSE 1e-5 + (0.001 - 1e-5) * 0.5 * (1 + cos(pi() * (event_id - 100) / 4900)) END::DOUBLE AS expected FROM events) SELECT 'r' AS run_id, iteration, round(expected, 9) AS expected, CASE WHEN odd < 0 THEN 'not stepped' WHEN odd IS NULL THEN 'ok' ELSE 'off' END AS verdict FROM c")
def r9(s, d):
    want = R.expected_rate(F.col("event_id"), 0.001, 100, 5000, 1e-5)
    rate = F.when(F.col("event_id") == 0, -1.0).when(F.col("event_id") % 10 == 3, 0.5).otherwise(want)
    curve = table(s, d, "events").select(F.lit("r").alias("run_id"), F.col("event_id").alias("iteration"), rate.alias("learning_rate"))
    return R.lr_audit(curve, 0.001, 100, 5000, 1e-5).select("run_id", "iteration", rounded(F.col("expected"), 9).alias("expected"), "verdict")


@query("r10_due_events", "SELECT event_id AS iteration, unnest(list_filter([CASE WHEN (event_id + 1) % 40 = 0 THEN 'eval' END, CASE WHEN (event_id + 1) % 15 = 0 THEN 'save' END], lambda x: x IS NOT NULL)) AS action FROM events")
def r10(s, d):
    return R.due_events(s, table(s, d, "events").count(), {"eval": 40, "save": 15, "never": None})


# --- scoring ---------------------------------------------------------------------------------------------------------
def _threshold_model():
    return lambda x: (x > 0.125).astype(np.float32)


@query("m1_score_frames", digest_sql("lab"))
def m1(s, d):
    return digest(M.score_frames(frames(s, d), _threshold_model, 64).withColumn("classes", F.col("classes").cast("array<double>")), "classes")


def _pool_model():
    def model(x: np.ndarray) -> dict[str, np.ndarray]:
        img = x.reshape(-1, 4, 2, 4, 2)
        return {"half": img.max(axis=(2, 4)).reshape(len(x), -1), "whole": x.max(axis=1, keepdims=True)}

    return model


@query("m2_extract_features", FR + ", k AS (SELECT frame_id, list_transform(range(16), lambda i: list_max(list_transform(range(4), lambda k: px[(i // 4 * 2 + k // 2) * 8 + i % 4 * 2 + k % 2 + 1]))) AS v, list_max(px) AS top FROM f) SELECT frame_id, round(list_sum(list_transform(v, lambda x, i: x * i)), 4) AS s1, round(top, 6) AS top FROM k")
def m2(s, d):
    f = M.extract_features(frames(s, d), _pool_model, ["half", "whole"], 64)
    weighted = A.total(F.transform("features.half", lambda v, i: v.cast("double") * (i + 1)))
    return f.select("frame_id", rounded(weighted, 4).alias("s1"), rounded(F.col("features.whole")[0].cast("double")).alias("top"))


# --- the flagship ----------------------------------------------------------------------------------------------------
@query("flagship_epoch", ASSIGNED + ", z AS (SELECT rank, local_pos // 16 AS batch_id, list_avg(px) AS m, sqrt(list_var_pop(px) + 1e-6) AS sd, px FROM b) SELECT rank, batch_id, count(*) AS frames, round(sum(list_sum(list_transform(px, lambda v: abs((v - m) / sd)))) / (64 * count(*)), 6) AS mean_abs, round(max(list_max(list_transform(px, lambda v: (v - m) / sd))), 6) AS top FROM z GROUP BY ALL")
def flagship(s, d):
    """Index, shard, batch, normalise, aggregate: an epoch in one plan. Ids are assigned before pixels are joined."""
    batches = B.make_batches(_assigned(s, d), 16).select("frame_id", "rank", "batch_id")
    normed = T.instance_norm(frames(s, d)).select("frame_id", "pixels")
    z = batches.join(normed, "frame_id").select("rank", "batch_id", A.total(F.transform("pixels", F.abs)).alias("a"), F.array_max("pixels").alias("top"), F.size("pixels").alias("n"))
    return z.groupBy("rank", "batch_id").agg(F.count("*").alias("frames"), rounded(F.sum("a") / F.sum("n")).alias("mean_abs"), rounded(F.max("top")).alias("top"))

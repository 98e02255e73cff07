"""Queries of sources, sinks and streams: what they write to the shared folder comes from the driver's tables, and is read back."""

from __future__ import annotations

import json
import zlib

import numpy as np
from pyspark.sql import functions as F

from ..operators import shards as B
from ..operators import transforms as T
from ..operators.index import locate
from ..operators.runlog import parse_records
from ..sources import io as S
from ..sources import items as I
from ..streaming import streams as W
from .fixtures import FR, SEED, digest, digest_sql, frames, index, manifest, moved_sql, rounded, scratch, table, total
from .queries import EV, ORACLE_SQL, RUN, _batches, _keyed, _logs, query


@query("s1_read_manifest", "SELECT CAST(row_number() OVER (ORDER BY s_suppkey) - 1 AS INT) AS file_id, 's' || s_suppkey AS path FROM supplier")
def s1(s, d):
    """A list of files with a header and an empty line."""
    path = scratch(s, "manifest")
    lines = table(s, d, "supplier").select(F.col("s_suppkey").alias("k"), F.concat(F.lit("s"), F.col("s_suppkey")).alias("value"))
    head = s.createDataFrame([(-2, "directory_path"), (-1, "")], "k long, value string")
    lines.select(F.col("k").cast("long"), "value").unionByName(head).coalesce(1).sortWithinPartitions("k").select("value").write.text(path)
    return S.read_manifest(s, path)


@query("s4_read_frames", digest_sql("list_concat(px, lab)", "(SELECT file_id, item_idx, frame_id, px, lab FROM f)", "file_id, item_idx, frame_id"))
def s4(s, d):
    """Every frame as it was written, pixels and labels."""
    path = scratch(s, "frames")
    frames(s, d).write.parquet(path)
    both = S.read_frames(s, path).withColumn("both", F.concat("pixels", "label"))
    return digest(both, "both", "file_id", "item_idx", "frame_id")


@query("s3_discover_files", "SELECT 's=' || user_id % 7 || '.zarr' AS store, (count(*) + 999) // 1000 AS files, true AS filled FROM events GROUP BY user_id % 7")
def s3(s, d):
    """Stores of several files, one of another suffix beside them."""
    path = scratch(s, "stores")
    e = table(s, d, "events").select("event_id", F.concat(F.col("user_id") % 7, F.lit(".zarr")).alias("s"))
    e.unionByName(s.range(5).select(F.col("id").alias("event_id"), F.lit("odd.csv").alias("s"))).repartition("s").write.option("maxRecordsPerFile", 1000).partitionBy("s").parquet(path)
    found = S.discover_files(s, path)
    return found.select(F.regexp_extract("store", "([^/]+)$", 1).alias("store"), "files", ((F.col("bytes") > 0) & F.col("modified").isNotNull()).alias("filled"))


def blosc_frame(data: bytes, size: int, codec: str, bits: bool, block: int) -> bytes:
    """A Blosc frame of elements of `size` bytes; full blocks have a stream for each byte of an element if the codec is lz4."""
    import struct

    import pyarrow as pa

    split, starts, body = codec == "lz4" and block // size >= 128, [], b""
    count = -(-len(data) // block)
    for i in range(count):
        part = np.frombuffer(data[i * block : (i + 1) * block], np.uint8)
        n = len(part) // size
        head, tail = part[: n * size].reshape(n, size), part[n * size :]
        if not bits:
            part = np.concatenate([head.T.ravel(), tail])
        elif n % 8 == 0:
            part = np.concatenate([np.packbits(np.unpackbits(head, axis=1, bitorder="little").T, axis=1, bitorder="little").ravel(), tail])
        starts.append(16 + 4 * count + len(body))
        for stream in np.split(part, size) if split and len(part) == block else [part]:
            packed = pa.Codec("lz4_raw" if codec == "lz4" else codec).compress(stream.tobytes(), asbytes=True)
            packed = packed if len(packed) < len(stream) else stream.tobytes()
            body += struct.pack("<i", len(packed)) + packed
    flags = (4 if bits else 1) | (0 if split else 16) | {"lz4": 1, "zstd": 4}[codec] << 5
    return struct.pack("<BBBBIII", 2, 1, flags, size, len(data), block, 16 + 4 * count + len(body)) + struct.pack(f"<{count}i", *starts) + body


#: How chunks of images and labels are packed: zarr's description of the codec, and the codec.
PLAIN = ((None, bytes), ({"id": "zlib", "level": 1}, zlib.compress))
BLOSC = (
    ({"id": "blosc", "cname": "lz4", "clevel": 5, "shuffle": 1, "blocksize": 0}, lambda b: blosc_frame(b, 4, "lz4", False, 640)),
    ({"id": "blosc", "cname": "zstd", "clevel": 5, "shuffle": 2, "blocksize": 0}, lambda b: blosc_frame(b, 4, "zstd", True, 256)),
)


#: Frames in a chunk, and those that a task packs at once.
FRAMES_IN_CHUNK, FRAMES_IN_GROUP = 16, 256


def _write_stores(s, d, path: str, names: tuple[str, str], tile: tuple[int, ...], label_planes: int, packing=PLAIN) -> None:
    """Frames as zarr stores, one a file, in chunks of 16 frames cut into tiles; labels stacked `label_planes` times."""
    planes = {names[0]: 1, names[1]: label_planes}
    shape = lambda name, n: [n, *([planes[name]] if len(tile) == 3 else []), 8, 8]

    def put(name: str, data: bytes) -> None:
        from pyarrow import fs

        system, at = fs.FileSystem.from_uri(name) if "://" in name or name.startswith("file:") else (fs.LocalFileSystem(), name)
        system.create_dir(at.rsplit("/", 1)[0])
        with system.open_output_stream(at) as out:
            out.write(data)

    chunks = [FRAMES_IN_CHUNK, *tile]

    def describe(it):
        for pdf in it:
            for file_id, n in zip(pdf["file_id"], pdf["n"], strict=True):
                for name, (codec, _) in zip(names, packing, strict=True):
                    meta = {"zarr_format": 2, "shape": shape(name, int(n)), "chunks": chunks, "dtype": "<f4", "order": "C", "fill_value": 0, "filters": None, "compressor": codec}
                    put(f"{path}/f{file_id}.zarr/{name}/.zarray", json.dumps(meta).encode())
            yield pdf[["file_id"]]

    def store(pdf):
        """The chunks of some of a file's frames, which begin with the first of a chunk."""
        block = f"{path}/f{pdf['file_id'][0]}.zarr"
        pdf = pdf.sort_values("item_idx")
        first = int(pdf["item_idx"].iloc[0]) // FRAMES_IN_CHUNK
        for name, column, (_, pack) in zip(names, ("pixels", "label"), packing, strict=True):
            n = shape(name, len(pdf))
            values = np.stack(pdf[column].map(lambda v: np.asarray(v, "<f4").reshape(n[1:])))
            for at in np.ndindex(*[-(-a // b) for a, b in zip(n, chunks, strict=True)]):
                part, full = values[tuple(slice(i * c, (i + 1) * c) for i, c in zip(at, chunks, strict=True))], np.zeros(chunks, "<f4")
                full[tuple(slice(k) for k in part.shape)] = part
                if full.any():  # what is all fill value is left out
                    put(f"{block}/{name}/{'.'.join(map(str, (first + at[0], *at[1:])))}", pack(full.tobytes()))
        return pdf[["file_id"]].head(1)

    f = frames(s, d).withColumn("label", F.flatten(F.array_repeat("label", label_planes)))
    f.groupBy("file_id").agg(F.count("*").alias("n")).mapInPandas(describe, "file_id int").count()
    # items are numbered without gaps, so a group is whole chunks and doesn't grow with its file
    f.groupBy("file_id", F.expr(f"item_idx div {FRAMES_IN_GROUP}")).applyInPandas(store, "file_id int").count()


_INGESTED = "file_id, item_idx, c, label_c, h, w, error"


@query("s5_ingest_containers", digest_sql("list_concat(px, lab)", "(SELECT file_id, item_idx, 1 AS c, 1 AS label_c, 8 AS h, 8 AS w, NULL::VARCHAR AS error, px, lab FROM f)", _INGESTED))
def s5(s, d):
    """Stores whose chunks split frames into tiles of 5 x 3."""
    path = scratch(s, "containers")
    _write_stores(s, d, path, ("images", "labels"), (5, 3), 1)
    got = S.ingest_containers(s, path).withColumn("file_id", F.regexp_extract("store", r"f(\d+)\.zarr$", 1).cast("int"))
    return digest(got.withColumn("both", F.concat("pixels", "label")), "both", *_INGESTED.split(", "))


@query("s5_ingest_blosc", ORACLE_SQL["s5_ingest_containers"])
def s5_blosc(s, d):
    """The same in Blosc frames: lz4 shuffled by bytes with split blocks, and zstd shuffled by bits."""
    path = scratch(s, "containers")
    _write_stores(s, d, path, ("images", "labels"), (8, 8), 1, BLOSC)
    got = S.ingest_containers(s, path).withColumn("file_id", F.regexp_extract("store", r"f(\d+)\.zarr$", 1).cast("int"))
    return digest(got.withColumn("both", F.concat("pixels", "label")), "both", *_INGESTED.split(", "))


def _stores(s, d, path: str):
    """Stores in Blosc frames, and their manifest."""
    _write_stores(s, d, path, ("images", "labels"), (8, 3), 1, BLOSC)
    return manifest(s, d).select("file_id", F.concat(F.lit(f"{path}/f"), "file_id", F.lit(".zarr")).alias("path"))


@query("x3_read_items", digest_sql("list_concat(px, lab)", "(SELECT user_id AS id, file_id, item_idx, CASE WHEN frame_id IS NULL THEN 'index out of range' END AS error, px, lab FROM (SELECT DISTINCT user_id FROM events) LEFT JOIN f ON frame_id = user_id)", "id, file_id, item_idx, error"))
def x3_items(s, d):
    """The items that users of the events ask for by global id, each read from the chunk that holds it; ids beyond the last are errors."""
    stores = _stores(s, d, scratch(s, "containers"))
    ix = I.index_of_counts(stores, I.refresh_counts(stores))
    ids = table(s, d, "events").select(F.col("user_id").alias("id")).distinct()
    got = I.read_items(locate(ids, ix)).withColumn("file_id", F.regexp_extract("path", r"f(\d+)\.zarr$", 1).try_cast("int"))
    return digest(got.withColumn("both", F.concat("pixels", "label")), "both", "id", "file_id", "item_idx", "error")


@query("s10_refresh_counts", FR + "SELECT file_id, n, start, file_id % 3 = 0 AS counted FROM ix")
def s10_delta(s, d):
    """An index whose cache lacks some stores and is older than others: only those are counted."""
    stores = _stores(s, d, scratch(s, "containers"))
    cached = scratch(s, "counts")
    before = F.when(F.col("file_id") % 2 == 0, F.col("modified") - F.expr("interval 1 day")).otherwise(F.col("modified"))
    known = I.refresh_counts(stores).join(stores, "path")
    known.where(F.col("file_id") % 6 != 3).withColumn("modified", F.when(F.col("file_id") % 3 == 0, before).otherwise(F.col("modified"))).write.parquet(cached)
    counts = I.refresh_counts(stores, s.read.parquet(cached))
    return I.index_of_counts(stores, counts).join(counts.select("path", "counted"), "path").select("file_id", "n", "start", "counted")


@query("s6_ingest_distill", digest_sql("list_concat(list_transform(range(16), lambda i: (lab[(i // 4) * 16 + (i % 4) * 2 + 1] + lab[(i // 4) * 16 + (i % 4) * 2 + 2] + lab[(i // 4) * 16 + (i % 4) * 2 + 9] + lab[(i // 4) * 16 + (i % 4) * 2 + 10]) / 4), list_transform(range(16), lambda i: (lab[(i // 4) * 16 + (i % 4) * 2 + 1] + lab[(i // 4) * 16 + (i % 4) * 2 + 2] + lab[(i // 4) * 16 + (i % 4) * 2 + 9] + lab[(i // 4) * 16 + (i % 4) * 2 + 10]) / 4))", "f", "file_id, item_idx"))
def s6(s, d):
    """Containers whose targets have two channels, each of which a transform acts on."""
    path = scratch(s, "containers")
    _write_stores(s, d, path, ("inputs", "features"), (1, 8, 4), 2)
    got = S.ingest_containers(s, path, "inputs", "features").withColumn("file_id", F.regexp_extract("store", r"f(\d+)\.zarr$", 1).cast("int"))
    return digest(S.on_label_channels(got, T.downscale_mean), "label", "file_id", "item_idx")


@query("s8_write_split", "WITH r AS (SELECT 's' || s_suppkey AS path, row_number() OVER (ORDER BY md5('42:' || 's' || s_suppkey), 's' || s_suppkey) AS r, count(*) OVER () AS n FROM supplier) SELECT path, CASE WHEN r <= floor(n * 0.8 + 1e-9) THEN 'train' ELSE 'eval' END AS split FROM r")
def s8(s, d):
    path = scratch(s, "split")
    files = table(s, d, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey")).alias("path"))
    S.write_split(B.split_files(files, 0.8, SEED), path)
    sides = [S.read_manifest(s, f"{path}/split={side}").select("path", F.lit(side).alias("split")) for side in ("train", "eval")]
    return sides[0].unionByName(sides[1])


@query("s9_load_index", FR + "SELECT file_id, n, start FROM ix")
def s9(s, d):
    folder = scratch(s, "index")
    S.save_index(index(s, d), folder)
    return S.load_index(s, manifest(s, d), folder).select("file_id", "n", "start")


@query("s11_write_predictions", EV + " SELECT rank AS step, batch_id % 2 AS half, CAST(sum(n) AS BIGINT) AS n, count(*) AS batches, CAST(sum(isnan(loss)::INT) AS BIGINT) AS missing, round(sum(CASE WHEN NOT isnan(loss) THEN loss * (batch_id % 97 + 1) END), 4) AS losses FROM b GROUP BY ALL")
def s11(s, d):
    path = scratch(s, "predictions")
    half = F.when(F.col("batch_id") % 2 == 0, "train").otherwise("validation")
    written = _batches(s, d).select(F.col("rank").alias("step"), half.alias("eval_type"), "batch_id", "n", "loss")
    S.write_predictions(written, path)
    S.write_predictions(written.where("step % 2 = 0"), path)  # a retry leaves one copy
    weighted = F.when(~F.isnan("loss"), F.col("loss") * (F.col("batch_id") % 97 + 1))
    got = s.read.parquet(path).groupBy("step", "eval_type").agg(F.sum("n").alias("n"), F.count("*").alias("batches"), F.count_if(F.isnan("loss")).alias("missing"), rounded(F.sum(weighted), 4).alias("losses"))
    return got.select("step", F.when(F.col("eval_type") == "train", 0).otherwise(1).cast("long").alias("half"), "n", "batches", "missing", "losses")


@query("s12_read_run_log", f"SELECT {RUN} AS run_id, count(*) AS records FROM events GROUP BY 1")
def s12(s, d):
    """A folder for each run; the log files in it are whole texts of many records."""
    path = scratch(s, "logs")
    _logs(s, d).repartition(8, "run_id").write.partitionBy("run_id").text(path)
    logs = S.read_run_log(s, path).withColumn("run_id", F.regexp_replace("run_id", "^run_id=", ""))
    return parse_records(logs).groupBy("run_id").agg(F.count("*").alias("records"))


# --- streams ---------------------------------------------------------------------------------------------------------
@query("w1_stream_frames", digest_sql(moved_sql(4, 6, "oy + 2", "ox + 1")))
def w1(s, d):
    source, out = scratch(s, "stream_in"), scratch(s, "stream_out")
    frames(s, d).write.parquet(source)
    W.write_frames(W.stream_frames(s, source, [lambda f: T.crop(f, 4, 6)], 2), out, scratch(s, "stream_state")).awaitTermination()
    return digest(s.read.parquet(out))


_GOES = FR + ", g AS (SELECT *, file_id % 2 AS go FROM f), p AS (SELECT *, row_number() OVER (PARTITION BY go ORDER BY file_id, item_idx) - 1 AS pos, (SELECT count(*) FROM g) - count(*) OVER (PARTITION BY go) AS other FROM g), q AS (SELECT *, CASE go WHEN 0 THEN ntile(4) OVER (PARTITION BY go ORDER BY pos) ELSE ntile(3) OVER (PARTITION BY go ORDER BY pos) END - 1 AS rank FROM p)"


@query("w1_stream_resume", _GOES + " SELECT file_id, item_idx, pos + go * other AS sample_id, CAST(rank AS INT) AS rank, row_number() OVER (PARTITION BY go, rank ORDER BY pos) - 1 AS local_pos, go AS batch_id FROM q")
def w1_resume(s, d):
    """Half of the files come first and go to four ranks; after a restart the others go to three."""
    source, out, offsets, state = (scratch(s, f"stream_{name}") for name in ("in", "out", "offsets", "state"))
    f = frames(s, d)
    for go, world in enumerate((4, 3)):
        f.where(F.col("file_id") % 2 == go).write.mode("append").parquet(source)
        stream = W.stream_frames(s, source, [], 1 << 20)
        W.stream_assigned(stream, W.replace_batch(out), world, offsets, state).awaitTermination()
    return s.read.parquet(out).select("file_id", "item_idx", "sample_id", "rank", "local_pos", "batch_id")


@query("w2_stream_progress", "SELECT CAST(user_id % 4 AS INT) AS rank, count(*) AS processed, count(*) // (100 * (1 + user_id % 4)) AS epochs FROM events GROUP BY user_id % 4")
def w2(s, d):
    source, name = scratch(s, "stream_in"), f"progress_{abs(hash(scratch(s, 'n')))}"
    table(s, d, "events").select((F.col("user_id") % 4).cast("int").alias("rank")).repartition(4).write.parquet(source)
    assigned = s.range(4).select(F.col("id").cast("int").alias("rank"), (100 * (1 + F.col("id"))).alias("assigned"))
    stream = s.readStream.schema("rank int").option("maxFilesPerTrigger", 2).parquet(source)
    # one row a rank
    W.stream_progress(stream, assigned).writeStream.format("memory").queryName(name).outputMode("complete").option("checkpointLocation", scratch(s, "stream_state")).trigger(availableNow=True).start().awaitTermination()
    return s.table(name)


@query("w3_stream_best_loss", "WITH e AS (SELECT 'r' || user_id % 9 AS run_id, event_id AS step, CASE WHEN event_type = 'error' THEN NULL ELSE value END AS loss FROM events), b AS (SELECT *, min(loss) OVER (PARTITION BY run_id ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM e) SELECT run_id, step, loss FROM b WHERE loss < coalesce(best, 'inf'::DOUBLE)")
def w3(s, d):
    """Improvements of each run; the second half of the evaluations comes after a restart, which goes on with the state."""
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = s.conf.get(provider)
    s.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        source, out, state = scratch(s, "stream_in"), scratch(s, "stream_out"), scratch(s, "stream_state")
        loss = F.when(F.col("event_type") == "error", float("nan")).otherwise(F.col("value"))
        e = table(s, d, "events").select(F.concat(F.lit("r"), F.col("user_id") % 9).alias("run_id"), F.col("event_id").alias("step"), loss.alias("loss"))
        half = e.agg(F.expr("max(step) div 2")).first()[0]
        for part in (e.where(F.col("step") <= half), e.where(F.col("step") > half)):
            part.repartition(3).write.mode("append").parquet(source)
            stream = s.readStream.schema("run_id string, step long, loss double").parquet(source)
            W.stream_best_loss(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    finally:
        s.conf.set(provider, before)
    return s.read.parquet(out)


def _epoch_sql(epoch: int, n: str = "(SELECT count(*) FROM embeddings)") -> str:
    order = f"md5('{SEED + epoch}:' || id), id" if epoch else "id"
    return f"SELECT id AS frame_id, {epoch} AS epoch, rank, row_number() OVER (PARTITION BY rank ORDER BY pos) - 1 AS local_pos FROM (SELECT id, row_number() OVER (ORDER BY {order}) AS pos, CAST(ntile(4) OVER (ORDER BY {order}) - 1 AS INT) AS rank FROM (SELECT unnest(range({n})) AS id)) QUALIFY true"


def _epochs(s, d, keyed):
    source, out, state = scratch(s, "stream_in"), scratch(s, "stream_out"), scratch(s, "stream_state")
    n = total(s, d)
    for k in range(3):
        s.range(n).where(F.col("id") % 3 == k).withColumnRenamed("id", "frame_id").write.mode("append").parquet(source)
        stream = s.readStream.schema("frame_id long").parquet(source)
        W.stream_epochs(stream, n, 4, 1, lambda df, b: df.write.mode("append").parquet(out), SEED, state, keyed).awaitTermination()
    return s.read.parquet(out).select("frame_id", "epoch", "rank", "local_pos")


@query("w4_stream_epochs", " UNION ALL ".join(f"SELECT * FROM ({_epoch_sql(e)}) WHERE frame_id % 3 = {e}" for e in range(3)).replace(" QUALIFY true", ""))
def w4(s, d):
    """A third of the frames in each of three micro-batches: the first epoch in order, the others shuffled."""
    return _epochs(s, d, False)


_N = "SELECT count(*) FROM embeddings"
_IN_ORDER = f"SELECT id AS frame_id, CAST(ntile(4) OVER (ORDER BY id) - 1 AS INT) AS rank, id FROM (SELECT unnest(range(({_N}))) AS id)"


@query("w4_stream_epochs_keyed", f"SELECT frame_id, 0 AS epoch, rank, local_pos FROM (SELECT *, row_number() OVER (PARTITION BY rank ORDER BY id) - 1 AS local_pos FROM ({_IN_ORDER})) WHERE frame_id % 3 = 0" + "".join(f" UNION ALL SELECT frame_id, {e}, rank, local_pos FROM ({_keyed(_N, str(SEED + e), 4)}) WHERE frame_id % 3 = {e}" for e in (1, 2)))
def w4_keyed(s, d):
    """The same in the keyed order: what arrives is placed by arithmetic on its ids."""
    return _epochs(s, d, True)

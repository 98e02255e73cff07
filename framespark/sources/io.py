"""Readers and writers: manifests, frames, containers, indexes, predictions, run logs."""

from __future__ import annotations

import json
import math
import struct
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.rand import gauss, u
from ..schema import FRAMES
from .blosc import decode_blosc

HEADERS = ("directory_path", "path")
#: The first line of a log record.
RECORD_HEADER = r"\d{2}/\d{2}/\d{4} \d{2}:\d{2}:\d{2} (?:\[RANK \d+\] )?[A-Z]+ [^\n]*"


def read_manifest(spark: SparkSession, path: str, with_stats: bool = False) -> DataFrame:
    """S1, S2. (file_id, path[, mean, std]) of a CSV list of files in the order of its lines; empty lines and a header line `directory_path` or `path` are left out. A manifest is small: it is numbered in one task."""
    schema = "path string" + (", mean double, std double" if with_stats else ", _rest string")
    lines = spark.read.csv(path, schema=schema, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True, mode="PERMISSIVE").drop("_rest")
    kept = lines.where(F.col("path").isNotNull() & (F.col("path") != "") & ~F.lower("path").isin(*HEADERS))
    numbered = kept.withColumn("_line", F.monotonically_increasing_id())
    return numbered.select((F.row_number().over(Window.orderBy("_line")) - 1).alias("file_id"), *kept.columns)


def discover_files(spark: SparkSession, path: str, suffix: str = ".zarr") -> DataFrame:
    """S3. (store, files, bytes, modified) of each folder below `path` whose name ends with the suffix. File contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "modificationTime", "length")
    root = F.regexp_extract("path", rf"^(.*?{suffix.replace('.', chr(92) + '.')})/", 1)
    return files.withColumn("store", root).where(F.col("store") != "").groupBy("store").agg(F.count("*").alias("files"), F.sum("length").alias("bytes"), F.max("modificationTime").alias("modified"))


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    """S4. Frames of Parquet files with the frames schema; a scan that needs no pixels reads none."""
    return spark.read.schema(FRAMES).parquet(path)


def read_distill_frames(spark: SparkSession, path: str) -> DataFrame:
    """S6. Frames whose label has several channels, with label_c; transforms act on each of them as on the pixels."""
    return spark.read.schema(FRAMES + ", label_c int").parquet(path)


def on_label_channels(frames: DataFrame, transform) -> DataFrame:
    """S6. A transform on the pixels and, with the same draws, on each channel of the label; the channels are stacked again."""
    label = frames.select("*", F.col("c").alias("_c")).withColumn("_both", F.concat("pixels", "label")).withColumn("c", F.col("c") + F.col("label_c"))
    out = transform(label.drop("pixels", "label").withColumnRenamed("_both", "pixels"))
    size = F.col("h") * F.col("w")
    out = out.withColumn("label", F.slice("pixels", F.col("_c") * size + 1, F.col("label_c") * size)).withColumn("pixels", F.slice("pixels", F.lit(1), F.col("_c") * size))
    return out.withColumn("c", F.col("_c")).drop("_c")


def _npy(kind: str) -> str:
    return {"F64": "<f8", "F32": "<f4", "F16": "<f2", "I64": "<i8", "I32": "<i4", "I16": "<i2", "U8": "|u1", "I8": "|i1", "BOOL": "|b1"}[kind]


def decode_safetensors(data: bytes) -> dict[str, np.ndarray]:
    size = struct.unpack("<Q", data[:8])[0]
    header = json.loads(data[8 : 8 + size])
    return {k: np.frombuffer(data[8 + size + v["data_offsets"][0] : 8 + size + v["data_offsets"][1]], _npy(v["dtype"])).reshape(v["shape"]) for k, v in header.items() if k != "__metadata__"}


def stacked(path: str, image: np.ndarray, label: np.ndarray):
    """Rows of the frames at each index of the first axis; an error where one of the two ends, or for other shapes than (h, w) or (1, h, w)."""
    for i in range(max(len(image), len(label))):
        if i >= min(len(image), len(label)):
            yield path, i, None, None, None, None, f"image has {len(image)} frames, label {len(label)}"
        elif image[i].ndim < 2 or image[i].size != np.prod(image[i].shape[-2:]) or label[i].size != image[i].size or label[i].shape[-2:] != image[i].shape[-2:]:
            yield path, i, None, None, None, None, f"shapes {image.shape} and {label.shape} can't be read"
        else:
            yield path, i, *image[i].shape[-2:], image[i].astype(np.float32).ravel(), label[i].astype(np.float32).ravel(), None


def zstandard_bytes(data: bytes) -> bytes:
    """All of a zstd stream, whether its header tells the size or not."""
    return pa.CompressedInputStream(pa.BufferReader(data), "zstd").read()


def decode_chunk(data: bytes, meta: dict) -> np.ndarray:
    """A chunk of a zarr v2 array; codecs other than none, zlib, gzip, lz4, zstd and blosc are an error."""
    codec = (meta.get("compressor") or {}).get("id")
    if codec in ("zlib", "gzip"):
        data = zlib.decompress(data, 47)
    elif codec == "blosc":
        data = decode_blosc(data)
    elif codec == "zstd":
        data = zstandard_bytes(data)
    elif codec == "lz4":  # a length, then a raw block
        data = pa.Codec("lz4_raw").decompress(data[4:], struct.unpack("<I", data[:4])[0]).to_pybytes()
    elif codec is not None:
        raise ValueError(f"codec {codec} can't be read")
    return np.frombuffer(data, meta["dtype"]).reshape(meta["chunks"], order=meta.get("order", "C"))


def zarr_layout(text: str) -> dict:
    """Metadata of a stack of frames (n, h, w) or (n, c, h, w) in zarr v2; other layouts are an error."""
    meta = json.loads(text)
    if meta.get("zarr_format", 2) != 2 or meta.get("filters") or len(meta["shape"]) not in (3, 4) or len(meta["chunks"]) != len(meta["shape"]):
        raise ValueError(f"shape {meta['shape']}, filters {meta.get('filters')}, format {meta.get('zarr_format')} can't be read")
    return meta


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI as Spark writes them (without escapes), and the path in it."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    if "://" in path:
        return fs.FileSystem.from_uri(quote(path, safe=":/@?=&,+%"))
    return fs.LocalFileSystem(), path


def read_file(path: str) -> bytes | None:
    """None where there is no such file."""
    system, at = file_system(path)
    try:
        with system.open_input_stream(at) as f:
            return f.read()
    except FileNotFoundError:
        return None


def array_metadata(spark: SparkSession, path: str, spread: int = 2) -> DataFrame:
    """(folder, meta): the .zarray texts at any depth of the stores below `path`.

    Folders are listed and metadata is opened in tasks. The first `spread` levels of folders are dealt over tasks one after the other, what lies
    deeper is walked by the task that has its folder. A folder of chunks isn't listed: its .zarray tells it.
    """
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    root = root.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(root).toString().rstrip("/")

    def below(folder: str) -> tuple[str | None, list[str]]:
        """The folder's .zarray or, where it isn't an array, its folders."""
        if ".zarr" in folder and (data := read_file(f"{folder}/.zarray")) is not None:
            return data.decode(), []
        system, at = file_system(folder)
        if system.get_file_info(at).type != fs.FileType.Directory:  # a path that is a file
            return None, []
        return None, [f"{folder}/{f.base_name}" for f in system.get_file_info(fs.FileSelector(at)) if f.type == fs.FileType.Directory]

    def level(folder: str, meta: str | None) -> list[tuple[str, str | None]]:
        found, more = (meta, []) if meta is not None else below(folder)
        return [(f, None) for f in more] if found is None else [(folder, found)]

    def walk(folder: str, meta: str | None) -> Iterator[tuple[str, str | None]]:
        folders = [folder]
        while folders:
            at = folders.pop()
            found, more = (meta, []) if meta is not None else below(at)
            folders += more
            if found is not None:
                yield at, found

    def batches(step):
        def run(it):
            rows = []
            for pdf in it:
                for folder, meta in zip(pdf["folder"], pdf["meta"], strict=True):
                    for row in step(folder, meta):
                        rows.append(row)
                        if len(rows) == 1000:
                            yield pd.DataFrame(rows, columns=["folder", "meta"])
                            rows = []
            yield pd.DataFrame(rows, columns=["folder", "meta"])

        return run

    columns = "folder string, meta string"
    out = spark.createDataFrame([(root, None)], columns)
    for _ in range(spread):
        out = out.mapInPandas(batches(level), columns).repartition("folder")
    return out.mapInPandas(batches(walk), columns)


#: Pixels in an Arrow batch of frames, about, before it is sent: 16 MB.
OUT_PIXELS = 1 << 22


def arrow_rows(rows: list[tuple], types: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows, strict=True), types.values(), strict=True)], names=list(types))


def ingest_containers(spark: SparkSession, path: str, image: str = "images", label: str = "labels") -> DataFrame:
    """S5, S6. (store, item_idx, c, label_c, h, w, pixels, label, error): frames of the zarr v2 stores and safetensors files below `path`, one row a frame. A file that can't be read is a row with an error.

    zarr chunks are tiles of stacks (n, h, w) or (n, c, h, w), named with '.' or '/', in stores or groups of them (store is then the group's
    folder); a chunk that isn't there holds fill_value. Frames of images and labels meet by store and number; array
    metadata, one row an array, joins to its chunks. Containers for distillation have a label of several channels, label_c. A frame with a tile that can't be read has an error, as has the chunk,
    under -1 - its number. safetensors files have stacks (image, label) with a frame at each index of the first axis.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    chunk = r"^(.*\.zarr/.+?)/((?:\d+[./])*\d+)$"
    parts = lambda c: (F.regexp_extract(c, "^(.*)/[^/]+$", 1), F.regexp_extract(c, "[^/]+$", 0))
    named = files.where(F.col("path").rlike(r"\.zarr/")).select("path", "content", F.regexp_extract("path", chunk, 1).alias("folder"), F.regexp_extract("path", chunk, 2).alias("chunk"))
    metas = array_metadata(spark, path)
    wanted = parts("folder")[1].isin(image, label)
    # files that are no chunks of an array, and chunks of arrays inside a folder of that name
    odd = named.where((F.col("folder") == "") | (~wanted & F.col("folder").rlike(rf"\.zarr/(.*/)?({image}|{label})/")))
    odd = odd.select(F.regexp_extract("path", r"^(.*?\.zarr)/", 1).alias("store"), F.lit(-1).cast("long").alias("item_idx"), F.concat(F.lit("not a chunk of a zarr v2 array: "), "path").alias("error"))
    chunks = named.where(wanted).join(metas, "folder", "left").select("folder", "chunk", "content", "meta")

    def tiles(batches):
        for batch in batches:
            for i in range(batch.num_rows):  # a chunk at a time, so Python holds no more than Arrow's batch and one chunk
                r = dict(zip(batch.schema.names, (c[i].as_py() for c in batch.columns), strict=True))
                at = [int(k) for k in r["chunk"].replace("/", ".").split(".")]
                span = range(0)
                try:
                    if r["meta"] is None:
                        raise ValueError("no .zarray")
                    meta = zarr_layout(r["meta"])
                    shape, size = meta["shape"], meta["chunks"]
                    if len(at) != len(shape):
                        raise ValueError("not a chunk of a stack")
                    start, *offset = (k * n for k, n in zip(at, size, strict=True))
                    if any(o >= n for o, n in zip(offset, shape[1:], strict=True)):
                        continue
                    span = range(start, min(start + size[0], shape[0]))
                    block = decode_chunk(r["content"], meta)[:, *[slice(n - o) for o, n in zip(offset, shape[1:], strict=True)]].astype(np.float32)
                    rows = [(r["folder"], k, offset, list(block.shape[1:]), block[k - start].ravel(), None) for k in span]
                except Exception as e:  # noqa: BLE001  a bad file must not end the job
                    why = f"chunk {r['chunk']}: {e}"
                    rows = [(r["folder"], k, [], [], None, why) for k in (-1 - at[0], *span)]
                if rows:
                    yield arrow_rows(rows, cut_types)  # of one chunk

    def expected(it):
        for pdf in it:
            for r in pdf.itertuples():
                try:
                    rows, why = zarr_layout(r.meta)["shape"][0], None
                except Exception as e:  # noqa: BLE001
                    rows, why = 0, str(e)
                yield pd.DataFrame([(r.folder, rows, why)], columns=["folder", "frames", "error"])

    def frames(batches):
        for batch in batches:
            out_rows, held = [], 0
            column = batch.column(batch.schema.get_field_index("tiles"))
            ends, each = column.offsets.to_pylist(), column.values
            where, sizes, errors = each.field("at"), each.field("dims"), each.field("error")
            # pixels stay in Arrow's buffer until they are copied into their frame
            values, starts = each.field("tile").values.to_numpy(zero_copy_only=False), each.field("tile").offsets.to_numpy()
            keys = [batch.column(batch.schema.get_field_index(k)) for k in ("folder", "item_idx", "meta")]
            for i in range(batch.num_rows):
                folder, item_idx, text = (k[i].as_py() for k in keys)
                own = range(ends[i], ends[i + 1])
                try:
                    if bad := [e for t in own if (e := errors[t].as_py())]:
                        raise ValueError("; ".join(sorted(bad)))
                    meta = zarr_layout(text)
                    *c, h, w = shape = meta["shape"][1:]
                    if len(own) < math.prod(-(-n // k) for n, k in zip(shape, meta["chunks"][1:], strict=True)) and meta.get("fill_value") is None:
                        raise ValueError("chunks are absent and there is no fill_value")
                    out = np.full(shape, float(meta.get("fill_value") or 0), np.float32)
                    for t in own:
                        dims = sizes[t].as_py()
                        out[tuple(slice(o, o + n) for o, n in zip(where[t].as_py(), dims, strict=True))] = values[starts[t] : starts[t + 1]].reshape(dims)
                    row = (folder, item_idx, math.prod(c), h, w, out.ravel(), None)
                    held += out.size
                except Exception as e:  # noqa: BLE001
                    row = (folder, item_idx, None, None, None, None, str(e))
                out_rows.append(row)
                if len(out_rows) == 64 or held > OUT_PIXELS:
                    yield arrow_rows(out_rows, frame_types)
                    out_rows, held = [], 0
            if out_rows:
                yield arrow_rows(out_rows, frame_types)

    cut_types = {"folder": pa.string(), "item_idx": pa.int64(), "at": pa.list_(pa.int32()), "dims": pa.list_(pa.int32()), "tile": pa.list_(pa.float32()), "error": pa.string()}
    frame_types = {"folder": pa.string(), "item_idx": pa.int64(), "c": pa.int32(), "h": pa.int32(), "w": pa.int32(), "px": pa.list_(pa.float32()), "error": pa.string()}
    cut = chunks.mapInArrow(tiles, "folder string, item_idx long, at array<int>, dims array<int>, tile array<float>, error string")
    held = cut.where("item_idx >= 0").groupBy("folder", "item_idx").agg(F.collect_list(F.struct("at", "dims", "tile", "error")).alias("tiles"))
    arrays = metas.where(wanted)
    sizes = arrays.mapInPandas(expected, "folder string, frames long, error string")
    items = sizes.where("frames > 0").select("folder", F.explode(F.sequence(F.lit(0).cast("long"), F.col("frames") - 1)).alias("item_idx")).join(arrays, "folder")
    whole = items.join(held, ["folder", "item_idx"], "left").withColumn("tiles", F.coalesce("tiles", F.array()))
    cut_frames = whole.mapInArrow(frames, "folder string, item_idx long, c int, h int, w int, px array<float>, error string").withColumns({"store": parts("folder")[0], "array": parts("folder")[1]})
    side = lambda name, to: cut_frames.where(F.col("array") == name).select("store", "item_idx", F.col("c").alias(f"c_{to}"), F.col("h").alias(f"h_{to}"), F.col("w").alias(f"w_{to}"), F.col("px").alias(to), F.col("error").alias(f"e_{to}"))
    both = side(image, "pixels").join(side(label, "label"), ["store", "item_idx"], "full")
    from_zarr = both.select("store", "item_idx", F.col("c_pixels").alias("c"), F.col("c_label").alias("label_c"), F.coalesce("h_pixels", "h_label").alias("h"), F.coalesce("w_pixels", "w_label").alias("w"), "pixels", "label", F.coalesce("e_pixels", "e_label").alias("error"))
    broken = cut.where("item_idx < 0").select(parts("folder")[0].alias("store"), "item_idx", "error")
    broken = broken.unionByName(sizes.where("error is not null").select(parts("folder")[0].alias("store"), F.lit(-1).cast("long").alias("item_idx"), "error")).unionByName(odd)
    from_zarr = from_zarr.unionByName(broken, allowMissingColumns=True)

    def tensors(it):
        for pdf in it:
            for r in pdf.itertuples():
                try:
                    got = decode_safetensors(r.content)
                    rows = stacked(r.path, got["image"], got["label"])
                except Exception as e:  # noqa: BLE001
                    rows = [(r.path, 0, None, None, None, None, str(e))]
                for row in rows:
                    yield pd.DataFrame([row], columns=["store", "item_idx", "h", "w", "pixels", "label", "error"])

    single = files.where(F.col("path").endswith(".safetensors")).select("path", "content")
    return from_zarr.unionByName(single.mapInPandas(tensors, "store string, item_idx long, h int, w int, pixels array<float>, label array<float>, error string").withColumns({"c": F.when(F.col("error").isNull(), 1), "label_c": F.when(F.col("error").isNull(), 1)}))


def synth_frames(ids: DataFrame, c: int, h: int, w: int, seed: int = 0, id_col: str = "frame_id") -> DataFrame:
    """S7. Random frames for given ids: normal pixels, label 1 where a uniform draw is above 0.5."""
    each = F.sequence(F.lit(0), F.lit(c * h * w - 1))
    return ids.select(F.col(id_col).alias("frame_id"), F.lit(c).alias("c"), F.lit(h).alias("h"), F.lit(w).alias("w"), F.transform(each, lambda i: gauss(seed, F.col(id_col), i)).alias("pixels"), F.transform(each, lambda i: (u(seed, F.col(id_col), i, F.lit("l")) > 0.5).cast("double")).alias("label"))


def write_split(files: DataFrame, path: str) -> None:
    """S8. CSV manifests with the header directory_path at path/split=train and path/split=eval."""
    files.select(F.col("path").alias("directory_path"), "split").write.mode("overwrite").option("header", True).partitionBy("split").csv(path)


def index_key(manifest: DataFrame) -> DataFrame:
    """S9. One row: the key of a list of files, whatever their order. A manifest fits one row."""
    return manifest.agg(F.substring(F.md5(F.array_join(F.array_sort(F.collect_list("path")), "|")), 1, 8).alias("key"))


def save_index(index: DataFrame, folder: str) -> str:
    """S9. Writes the index under its key and returns the path."""
    path = f"{folder}/index_{index_key(index).first()['key']}"
    index.write.mode("overwrite").parquet(path)
    return path


def load_index(spark: SparkSession, manifest: DataFrame, folder: str) -> DataFrame:
    """S9."""
    return spark.read.parquet(f"{folder}/index_{index_key(manifest).first()['key']}")


def index_is_fresh(manifest: DataFrame, files: DataFrame, cached_at: Column) -> DataFrame:
    """S10. One row (fresh, missing, newer): an index is fresh if every file of the manifest is there and none is newer. files: (path, modified)."""
    seen = files.groupBy(F.col("path").alias("_p")).agg(F.max("modified").alias("_m"))
    got = manifest.join(seen, F.col("path") == F.col("_p"), "left")
    counts = got.agg(F.count_if(F.col("_p").isNull()).alias("missing"), F.count_if(F.col("_m") > cached_at).alias("newer"))
    return counts.select(((F.col("missing") == 0) & (F.col("newer") == 0)).alias("fresh"), "missing", "newer")


def write_predictions(predictions: DataFrame, path: str) -> None:
    """S11. Input, target, output and loss of evaluated batches, in folders by step, eval_type and, if there is such a column, rank.

    What is written again replaces the folders that it has rows for and leaves all others, so a step that is retried is there once.
    """
    keys = [c for c in ("step", "eval_type", "rank") if c in predictions.columns]
    predictions.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def read_run_log(spark: SparkSession, path: str) -> DataFrame:
    """S12. (run_id, file_rank, value) of rank log files <run_id>/rank<r>.log: a row for each record, its header line and the lines up to the next one. Lines before the first header are one row.

    Files are read by lines, in splits of any size. A split counts its headers, and the sum over the splits before it in the
    file numbers its records; lines before its first header belong to the record that the splits before left open. So a long
    log is sorted split by split and has as many tasks. parse_records() reads the records.
    """
    at = {"_f": F.col("_metadata.file_path"), "_block": F.col("_metadata.file_block_start"), "_nth": F.monotonically_increasing_id()}
    lines = spark.read.option("recursiveFileLookup", True).text(path).select("value", *[c.alias(k) for k, c in at.items()])
    lines = lines.withColumn("_is_head", F.col("value").rlike(f"^{RECORD_HEADER}$"))
    splits = lines.groupBy(F.col("_f").alias("_sf"), F.col("_block").alias("_sb")).agg(F.count_if("_is_head").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("_sf").orderBy("_sb").rowsBetween(Window.unboundedPreceding, -1))
    splits = splits.withColumn("_before", F.coalesce(before, F.lit(0)))
    so_far = F.count_if("_is_head").over(Window.partitionBy("_f", "_block").orderBy("_nth"))
    numbered = lines.withColumn("_so_far", so_far).join(splits, (F.col("_f") == F.col("_sf")) & (F.col("_block") == F.col("_sb")))
    each = numbered.groupBy("_f", (F.col("_before") + F.col("_so_far")).alias("_record")).agg(F.array_sort(F.collect_list(F.struct("_block", "_nth", "value"))).alias("_lines"))
    records = each.select("_f", F.array_join(F.transform("_lines", lambda r: r["value"]), "\n").alias("value"))
    return records.select(F.regexp_extract("_f", r"([^/]+)/[^/]*$", 1).alias("run_id"), F.regexp_extract("_f", r"rank_?(\d+)\.log$", 1).try_cast("int").alias("file_rank"), "value")

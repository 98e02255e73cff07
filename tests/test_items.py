"""Blosc frames, items read on demand and the index of stores that counts only what has changed."""

import json
import os
import struct
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from framespark.operators import targets as L
from framespark.operators.index import locate
from framespark.plans.file_queries import blosc_frame
from framespark.sources import io as S
from framespark.sources import items as I
from framespark.sources.blosc import decode_blosc


@pytest.mark.parametrize("codec", ["lz4", "zstd"])
@pytest.mark.parametrize("bits", [False, True])
@pytest.mark.parametrize("size", [1, 2, 4, 8])
def test_blosc_round_trip(codec, bits, size):
    rng = np.random.default_rng(size)
    for n, block in ((0, 1024), (size * 8, 1024), (5000, 2048), (4096, 2048), (777 * size + 3, 1600), (100_000, 1 << 14)):
        for data in (rng.integers(0, 256, n).astype(np.uint8).tobytes(), (np.arange(n) // 50).astype(np.uint8).tobytes(), bytes(n)):
            assert decode_blosc(blosc_frame(data, size, codec, bits, block)) == data


def test_blosc_frames_by_hand():
    head = lambda flags, size, n, block, held: struct.pack("<BBBBIII", 2, 1, flags, size, n, block, held)
    assert decode_blosc(head(0x02, 4, 5, 5, 21) + b"abcde") == b"abcde"  # stored whole
    packed = zlib.compress(b"\x01\x01\x01\x01\x02\x02\x02\x02")
    assert decode_blosc(head(0x01 | 0x10 | 3 << 5, 2, 8, 8, 16 + 4 + 4 + len(packed)) + struct.pack("<ii", 20, len(packed)) + packed) == b"\x01\x02" * 4
    for bad in (b"", b"x" * 15, head(0x10, 1, 4, 4, 99) + b"....", head(0x10, 1, 4, 4, 25) + struct.pack("<ii", 20, 1) + b"x"):
        with pytest.raises(Exception):  # noqa: B017
            decode_blosc(bad)


def store(path, name, values, chunks, separator=".", **meta):
    folder = path / name
    folder.mkdir(parents=True)
    (folder / ".zarray").write_text(json.dumps({"zarr_format": 2, "shape": values.shape, "chunks": chunks, "dtype": "<f4", "order": "C", "fill_value": 0, "filters": None, "compressor": None, "dimension_separator": separator} | meta))
    for at in np.ndindex(*[-(-n // c) for n, c in zip(values.shape, chunks, strict=True)]):
        full = np.zeros(chunks, "<f4")
        part = values[tuple(slice(i * c, (i + 1) * c) for i, c in zip(at, chunks, strict=True))]
        full[tuple(slice(n) for n in part.shape)] = part
        file = folder / separator.join(map(str, at))
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_bytes(full.tobytes())


def test_items_open_only_their_chunks(spark, tmp_path):
    rng = np.random.default_rng(1)
    data = {k: (rng.random((20 + k, 4, 6)).astype("<f4"), rng.random((20 + k, 2, 4, 6)).astype("<f4")) for k in range(3)}
    for k, (x, y) in data.items():
        store(tmp_path / f"f{k}.zarr", "images", x, [8, 4, 3])
        store(tmp_path / f"f{k}.zarr", "labels", y, [5, 2, 4, 6], "/")
    manifest = spark.createDataFrame([(k, f"{tmp_path}/f{k}.zarr") for k in range(3)] + [(3, f"{tmp_path}/none.zarr")], "file_id int, path string")
    index = I.index_of_counts(manifest, I.refresh_counts(manifest))
    assert [(r.n, r.start, r.error is None) for r in index.orderBy("file_id").collect()] == [(20, 0, True), (21, 20, True), (22, 41, True), (0, 63, False)]
    asked = [0, 7, 7, 25, 40, 62, 63, -1]
    located = locate(spark.createDataFrame([(i,) for i in asked], "id long"), index)
    want = {0: (0, 0), 7: (0, 7), 25: (1, 5), 40: (1, 20), 62: (2, 21)}
    needed = {(k, f"images/{i // 8}.0.{t}") for k, i in want.values() for t in (0, 1)} | {(k, f"labels/{i // 5}/0/0/0") for k, i in want.values()}
    for root, _, names in os.walk(tmp_path):  # all other chunks are broken
        for n in names:
            full = os.path.join(root, n)
            at = os.path.relpath(full, tmp_path).split("/", 1)
            if n != ".zarray" and (int(at[0][1]), at[1]) not in needed:
                open(full, "w").write("broken")
    rows = I.read_items(located).collect()
    assert sorted(r.id for r in rows) == sorted(asked)
    for r in rows:
        if r.id in want:
            k, i = want[r.id]
            assert r.error is None and (r.c, r.label_c, r.h, r.w) == (1, 2, 4, 6)
            assert np.array_equal(np.array(r.pixels, "f4"), data[k][0][i].ravel()) and np.array_equal(np.array(r.label, "f4"), data[k][1][i].ravel())
        else:
            assert r.error == "index out of range" and r.pixels is None
    assert {(int(r.path[-6]), c) for r in rows if r.chunks for c in r.chunks} == needed
    only = I.read_items(located.where("error is null"), columns=("pixels",)).collect()
    assert all(r.label is None and all(c.startswith("images/") for c in r.chunks) for r in only)
    # items of a broken chunk, absent stores, nulls
    odd = spark.createDataFrame([(1, f"{tmp_path}/f0.zarr", 12), (2, f"{tmp_path}/none.zarr", 0), (3, f"{tmp_path}/f0.zarr", 20), (4, None, 1), (5, f"{tmp_path}/f0.zarr", None)], "id long, path string, item_idx long")
    assert all(r.error and r.pixels is None for r in I.read_items(odd).collect()) and I.read_items(odd).count() == 5
    assert I.read_items(odd.limit(0)).count() == 0


def test_only_newer_stores_are_counted(spark, tmp_path):
    for k in range(4):
        store(tmp_path / f"f{k}.zarr", "images", np.zeros((k + 1, 2, 2), "<f4"), [2, 2, 2])
    manifest = spark.createDataFrame([(k, f"{tmp_path}/f{k}.zarr") for k in range(4)], "file_id int, path string")
    first = I.refresh_counts(manifest)
    assert {r.counted for r in first.collect()} == {True}
    first.drop("counted").where(~F.col("path").endswith("f3.zarr")).write.parquet(f"{tmp_path}/cache")
    cached = spark.read.parquet(f"{tmp_path}/cache")
    # f1 grows, f2 loses its metadata but keeps its folder, f3 is new
    meta = tmp_path / "f1.zarr/images/.zarray"
    meta.write_text(meta.read_text().replace('"shape": [2,', '"shape": [9,'))
    os.utime(meta, (time.time() + 60, time.time() + 60))
    (tmp_path / "f2.zarr/images/.zarray").unlink()
    got = {r.path[-6]: (r.n, r.counted, r.error is None) for r in I.refresh_counts(manifest, cached).collect()}
    assert got == {"0": (1, False, True), "1": (9, True, True), "2": (0, True, False), "3": (4, True, True)}


def test_codecs_of_chunks():
    import pyarrow as pa

    values = np.arange(24, dtype="<f4").reshape(2, 3, 4)
    raw = values.tobytes()
    packed = {None: raw, "zlib": zlib.compress(raw), "zstd": pa.Codec("zstd").compress(raw, asbytes=True), "lz4": struct.pack("<I", len(raw)) + pa.Codec("lz4_raw").compress(raw, asbytes=True), "blosc": blosc_frame(raw, 4, "zstd", True, 64)}
    for codec, data in packed.items():
        meta = {"compressor": codec and {"id": codec}, "dtype": "<f4", "chunks": [2, 3, 4]}
        assert np.array_equal(S.decode_chunk(data, meta), values)
    with pytest.raises(ValueError):
        S.decode_chunk(raw, {"compressor": {"id": "lzma"}, "dtype": "<f4", "chunks": [2, 3, 4]})


def test_predictions_written_again_are_there_once(spark, tmp_path):
    path = str(tmp_path / "predictions")
    rows = [(s, e, r, b, float(b)) for s in (1, 2) for e in ("train", "validation") for r in (0, 1) for b in range(3)]
    first = spark.createDataFrame(rows, "step int, eval_type string, rank int, batch_id int, loss double")
    S.write_predictions(first, path)
    S.write_predictions(first.where("step = 2 and rank = 1").withColumn("loss", F.lit(9.0)), path)
    got = spark.read.parquet(path).select(*first.columns).collect()
    assert sorted(map(tuple, got)) == sorted((s, e, r, b, 9.0 if (s, r) == (2, 1) else x) for s, e, r, b, x in rows)


def test_stitched_classes(spark):
    tokens = np.arange(6 * 4 * 3, dtype=float).reshape(6, 12)  # a grid of 2 x 3 patches of 2 x 2, three classes
    rows = [(7, k, t.tolist()) for k, t in enumerate(tokens) if k != 4]
    got = L.stitch_patches(spark.createDataFrame(rows, "frame_id long, patch int, pixels array<double>"), 2, 2, 3, classes=3).first()
    tokens[4] = 0
    want = tokens.reshape(2, 3, 2, 2, 3).transpose(4, 0, 2, 1, 3).reshape(3, 4, 6)
    assert (got.c, got.h, got.w) == (3, 4, 6) and np.array_equal(np.array(got.pixels), want.ravel())

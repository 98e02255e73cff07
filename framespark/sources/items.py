"""Single items of many zarr stores, read on demand, and an index of stores that counts only what has changed.

Everything that opens a store runs in tasks, through pyarrow's file systems: no folder is listed, and the driver opens nothing.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .io import decode_chunk, file_system, read_file, zarr_layout

ITEM = "id long, path string, item_idx long, c int, label_c int, h int, w int, pixels array<float>, label array<float>, chunks array<string>, error string"


class Array:
    """An array of a store: its layout, and chunks that are opened once."""

    def __init__(self, folder: str) -> None:
        if (text := read_file(f"{folder}/.zarray")) is None:
            raise ValueError(f"no {folder.rsplit('/', 1)[-1]}/.zarray")
        self.folder, self.meta, self.separator, self.tiles = folder, zarr_layout(text.decode()), json.loads(text).get("dimension_separator", "."), {}
        self.shape, self.size = self.meta["shape"], self.meta["chunks"]

    def tile(self, at: tuple[int, ...]) -> tuple[str, np.ndarray | None]:
        name = self.separator.join(map(str, at))
        if name not in self.tiles:
            data = read_file(f"{self.folder}/{name}")
            self.tiles[name] = None if data is None else decode_chunk(data, self.meta)
        return name, self.tiles[name]

    def item(self, i: int) -> tuple[np.ndarray, list[str]]:
        """An item with its channels, and the chunks that held it."""
        if not 0 <= i < self.shape[0]:
            raise ValueError(f"item {i} of {self.shape[0]}")
        inner, fill, used = self.shape[1:], self.meta.get("fill_value"), []
        out = np.full(inner, float(fill or 0), np.float32)
        for at in np.ndindex(*[-(-n // k) for n, k in zip(inner, self.size[1:], strict=True)]):
            name, tile = self.tile((i // self.size[0], *at))
            if tile is None:
                if fill is None:
                    raise ValueError(f"chunk {name} is absent and there is no fill_value")
                continue
            used.append(name)
            place = tuple(slice(a * k, min((a + 1) * k, n)) for a, k, n in zip(at, self.size[1:], inner, strict=True))
            out[place] = tile[i % self.size[0]][tuple(slice(p.stop - p.start) for p in place)]
        return out, used


def read_items(located: DataFrame, image: str = "images", label: str = "labels", columns: tuple[str, ...] = ("pixels", "label")) -> DataFrame:
    """S4, X3. (id, path, item_idx, c, label_c, h, w, pixels, label, chunks, error) of the items that locate() found, from (id, path, item_idx[, error]).

    The items of a chunk of a store are one group, so each chunk that holds any is opened once and no other is; what moves between tasks is
    ids. columns says which of the two arrays are read: the other one isn't opened and is null. chunks names the chunks that an item came from. An
    item that can't be read is a row with an error, and rows that came with one stay as they are.
    """
    errors = F.col("error") if "error" in located.columns else F.lit(None).cast("string")
    asked = located.select("id", "path", F.col("item_idx").cast("long").alias("item_idx"), errors.alias("error"))
    sides = [(name, array) for name, array in (("pixels", image), ("label", label)) if name in columns]

    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lengths: dict[str, int] = {}
        for pdf in batches:
            for path in set(pdf["path"]) - lengths.keys():
                try:
                    lengths[path] = Array(f"{path}/{sides[0][1]}").size[0]
                except Exception:  # noqa: BLE001  told when the item is read
                    lengths[path] = 1 << 20
            yield pdf.assign(block=[int(i) // lengths[p] for p, i in zip(pdf["path"], pdf["item_idx"], strict=True)])

    def read(group: pa.Table) -> pa.Table:
        path, arrays, rows = group.column("path")[0].as_py(), {}, []
        for name, array in sides:
            try:
                arrays[name] = Array(f"{path}/{array}")
            except Exception as e:  # noqa: BLE001
                arrays[name] = e
        for i, item in zip(group.column("id").to_pylist(), group.column("item_idx").to_pylist(), strict=True):
            row = {"id": i, "path": path, "item_idx": item}
            try:
                used = []
                for name, array in sides:
                    if isinstance(arrays[name], Exception):
                        raise arrays[name]
                    values, chunks = arrays[name].item(item)
                    used += [f"{array}/{c}" for c in chunks]
                    row |= {name: values.ravel(), "c" if name == "pixels" else "label_c": math.prod(values.shape[:-2]), "h": values.shape[-2], "w": values.shape[-1]}
                row["chunks"] = used
            except Exception as e:  # noqa: BLE001  a bad chunk must not end the job
                row = {"id": i, "path": path, "item_idx": item, "error": str(e)}
            rows.append(row)
        types = {"id": pa.int64(), "path": pa.string(), "item_idx": pa.int64(), "c": pa.int32(), "label_c": pa.int32(), "h": pa.int32(), "w": pa.int32(), "pixels": pa.list_(pa.float32()), "label": pa.list_(pa.float32()), "chunks": pa.list_(pa.string()), "error": pa.string()}
        return pa.table({k: pa.array([r.get(k) for r in rows], t) for k, t in types.items()})

    bad = F.col("error").isNotNull() | F.col("path").isNull() | F.col("item_idx").isNull()
    placed = asked.where(~bad).select("id", "path", "item_idx").mapInPandas(blocks, "id long, path string, item_idx long, block long")
    got = placed.groupBy("path", "block").applyInArrow(read, ITEM)
    rest = asked.where(bad).withColumn("error", F.coalesce("error", F.lit("no file or item")))
    return got.unionByName(rest, allowMissingColumns=True)


# --- the index of stores ------------------------------------------------------------------------------------------------
def store_times(manifest: DataFrame, image: str = "images") -> DataFrame:
    """(file_id, path, modified): when the image array's metadata of each store was written, null where there is none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            times = []
            for path in pdf["path"]:
                system, at = file_system(f"{path}/{image}/.zarray")
                info = system.get_file_info(at)
                times.append(info.mtime_ns // 1000 if info.mtime_ns else None)
            yield pdf.assign(modified=pd.array(times, "Int64"))

    stores = manifest.select(F.col("file_id").cast("long").alias("file_id"), "path")
    return stores.mapInPandas(run, "file_id long, path string, modified long").withColumn("modified", F.timestamp_micros("modified"))


def count_items(stores: DataFrame, image: str = "images") -> DataFrame:
    """(path, modified, n, error): items of each of the stores (path, modified), from the image array's metadata. One that can't be read has 0 and an error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            counts, errors = [], []
            for path in pdf["path"]:
                try:
                    n, error = Array(f"{path}/{image}").shape[0], None
                except Exception as e:  # noqa: BLE001
                    n, error = 0, str(e)
                counts.append(n), errors.append(error)
            yield pdf[["path", "modified"]].assign(n=counts, error=errors)

    return stores.select("path", "modified").mapInPandas(run, "path string, modified timestamp, n long, error string")


def refresh_counts(manifest: DataFrame, cached: DataFrame | None = None, image: str = "images") -> DataFrame:
    """S10. (path, modified, n, error, counted) for the stores of a manifest: those in cached (path, modified, n, error) that weren't written since keep their counts, only new and newer ones are opened (counted)."""
    times = store_times(manifest, image).select("path", "modified").distinct()
    if cached is None:
        return count_items(times, image).withColumn("counted", F.lit(True))
    known = cached.select(F.col("path").alias("_p"), F.col("modified").alias("_m"), "n", "error")
    both = times.join(known, (F.col("path") == F.col("_p")) & (F.col("modified") <= F.col("_m")), "left")
    kept = both.where("_p is not null").select("path", "modified", "n", "error", F.lit(False).alias("counted"))
    return kept.unionByName(count_items(both.where("_p is null"), image).withColumn("counted", F.lit(True)))


def index_of_counts(manifest: DataFrame, counts: DataFrame) -> DataFrame:
    """X1. (file_id, path, n, start, end_excl, error) from (path, n, error), in manifest order. The window runs over the manifest, one row a file."""
    known = counts.select(F.col("path").alias("_p"), F.col("n").alias("_n"), "error")
    joined = manifest.select("file_id", "path").join(known, F.col("path") == F.col("_p"), "left").select("file_id", "path", F.coalesce("_n", F.lit(0)).alias("n"), F.when(F.col("_p").isNull(), "not counted").otherwise(F.col("error")).alias("error"))
    upto = F.sum("n").over(Window.orderBy("file_id").rowsBetween(Window.unboundedPreceding, 0))
    return joined.select("file_id", "path", "n", (upto - F.col("n")).alias("start"), upto.alias("end_excl"), "error")

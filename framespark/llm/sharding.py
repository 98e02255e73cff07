"""Resharding by minimum-cost flow: from old shard sizes and new capacities to the block transfers that move the fewest bytes.

A layout is a folder of Parquet files for each shard. The files of a shard fall into a bounded number of groups, and the
rows of a group into blocks, by place in their file; blocks are summed in one pass with a partial aggregate, so the driver
gets a bounded number of rows whatever the data's size and whatever the ids. A minimum-cost flow between old and new
shards tells how many bytes go from where to where. Whole groups of files fill the flows as far as they fit; what is left
is made up of blocks of few groups. Only files of groups that move or are split are written anew; the others stay where they
are. A manifest lists the files of each new shard.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import crc32_unsigned, new_path, table

OLD_SHARDS, NEW_SHARDS = 6, 8
#: Groups of files and blocks in a shard, and blocks in all shards, at most.
GROUPS, BLOCKS, ALL_BLOCKS = 128, 2048, 1 << 18
LAW = "bytes"
LAYOUT = "doc_id long, text string, old int"


def size_of(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def old_shard(doc_id: Column, shards: int) -> Column:
    """The layout before: by hash of the id."""
    return F.pmod(F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "utf-8")), F.lit(shards)).cast("int")


def min_cost_flow(supply: list[int], capacity: list[int], cost: list[list[int]]) -> list[list[int]]:
    """Units from each supply to each capacity, of least total cost (costs of 0 or more), all supply placed.

    Successive shortest paths on a graph of shards. A round finds the shortest distances (Bellman-Ford, a matrix at a time:
    used arcs have negative cost backwards). Distances never fall from round to round, so where the shortest path is an arc,
    all arcs as short are filled in that round. With a cost of one for each byte that leaves its shard two rounds do, whatever
    the number of shards.
    """
    if sum(supply) > sum(capacity):
        raise ValueError("the new shards hold less than the old ones have")
    n, m = len(supply), len(capacity)
    costs = np.array(cost, np.float64).reshape(n, m)
    flow = np.zeros((n, m), np.int64)
    left, room = np.array(supply, np.int64), np.array(capacity, np.int64)
    while left.any():
        # distances of old and new shards, and the shard before each on its path: changed by nearer ones only, so paths have no circles
        far, came = np.where(left > 0, 0.0, np.inf), np.full(n, -1)
        there, via = np.full(m, np.inf), np.full(m, -1)
        while True:
            reach = far[:, None] + costs
            first = reach.argmin(axis=0)
            nearer = (best := reach[first, np.arange(m)]) < there
            if not nearer.any():
                break
            there, via = np.where(nearer, best, there), np.where(nearer, first, via)
            back = np.where(flow > 0, there - costs, np.inf)
            last = back.argmin(axis=1)
            nearer = (best := back[np.arange(n), last]) < far
            far, came = np.where(nearer, best, far), np.where(nearer, last, came)
        end = int(np.where(room > 0, there, np.inf).argmin())
        if came[via[end]] < 0:
            for i in np.flatnonzero(left):
                for j in np.flatnonzero((costs[i] == there[end]) & (room > 0)):
                    amount = min(left[i], room[j])
                    flow[i, j] += amount
                    left[i] -= amount
                    room[j] -= amount
                    if not left[i]:
                        break
            continue
        arcs, j = [], end  # (old, new, 1 to use it, -1 to give it back)
        while True:
            i = int(via[j])
            arcs.append((i, j, 1))
            if came[i] < 0:
                break
            j = int(came[i])
            arcs.append((i, j, -1))
        amount = min([left[i], room[end], *[flow[a, b] for a, b, way in arcs if way < 0]])
        for a, b, way in arcs:
            flow[a, b] += way * amount
        left[i] -= amount
        room[end] -= amount
    return flow.tolist()


def place_blocks(sizes: dict[tuple[int, int, int], int], flow: list[list[int]]) -> dict[tuple[int, int, int], int]:
    """New shard of each block (old shard, group, block): whole groups, the largest first, where a flow holds them; then blocks, of as few groups as will do, to the nearest half block; the rest at home."""
    out: dict[tuple[int, int, int], int] = {}
    carry: dict[int, int] = {}  # what a shard still lacks of the flows so far
    by_old: dict[int, dict[int, list[tuple[int, int]]]] = {}
    for (old, group, block), size in sizes.items():
        by_old.setdefault(old, {}).setdefault(group, []).append((size, block))
    for old, groups in sorted(by_old.items()):
        home = old < len(flow[old])
        left = {j: amount + carry.pop(j, 0) for j, amount in enumerate(flow[old]) if j != old and amount}
        most = lambda: max(left, key=lambda j: (left[j], -j))
        rest = []
        for group in sorted(groups, key=lambda g: (-sum(s for s, _ in groups[g]), g)):
            size = sum(s for s, _ in groups[group])
            if left and left[to := most()] >= size:
                left[to] -= size
                out.update({(old, group, block): to for _, block in groups[group]})
            else:
                rest.append(group)
        for group in rest:
            for size, block in sorted(groups[group], key=lambda b: (-b[0], b[1])):
                if left and (not home or 2 * left[to := most()] >= size > 0):
                    to = most()
                    left[to] -= size
                    out[old, group, block] = to
                else:
                    out[old, group, block] = old
        carry.update({j: amount + carry.get(j, 0) for j, amount in left.items()})
    return out


def lay_out(docs: DataFrame, path: str, shards: int = OLD_SHARDS, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes rows (doc_id, text) as a layout by hash of the id, without a shuffle: the state before resharding."""
    doc_id = F.col(id_col).cast("long")
    docs.select(doc_id.alias("doc_id"), F.col(text_col).cast("string").alias("text"), old_shard(doc_id, shards).alias("old")).write.option("compression", "zstd").partitionBy("old").parquet(path)


def _blocks(layout: DataFrame, groups: int, blocks: int) -> DataFrame:
    """The rows of a layout with their file, its group, their place in it and their block."""
    file = F.col("_metadata.file_path")
    keyed = layout.select("doc_id", "text", "old", file.alias("file"), F.col("_metadata.row_index").alias("nth"))
    group, block = F.pmod(F.xxhash64(F.substring_index("file", "/", -1)), F.lit(groups)), F.pmod(F.xxhash64("nth", "file"), F.lit(blocks // groups))
    return keyed.select("*", group.cast("int").alias("group"), block.cast("int").alias("block"))


def reshard_plan(rows: DataFrame, old_shards: int, new_shards: int) -> list[tuple[int, int, int, int, bool]]:
    """(old shard, group, block, new shard, whether the group's files are written anew) of each block: at most ALL_BLOCKS rows."""
    got = {(r[0], r[1], r[2]): r[3] for r in rows.groupBy("old", "group", "block").agg(F.sum(size_of(F.col("text")))).collect()}
    supply = [0] * old_shards
    for (old, *_), size in got.items():
        supply[old] += size
    total = sum(supply)
    capacity = [total * (j + 1) // new_shards - total * j // new_shards for j in range(new_shards)]
    flow = min_cost_flow(supply, capacity, [[int(i != j) for j in range(new_shards)] for i in range(old_shards)])
    to = place_blocks(got, flow)
    moved = {(old, group) for (old, group, _), new in to.items() if new != old}
    return [(old, group, block, new, (old, group) in moved) for (old, group, block), new in sorted(to.items())]


def reshard(spark: SparkSession, old_path: str, out: str, old_shards: int = OLD_SHARDS, new_shards: int = NEW_SHARDS) -> DataFrame:
    """Rewrites affected files of the layout at old_path into `out`/shard=..., writes `out`.manifest (shard, file, before, rows, rewritten) and returns (doc_id, size, text_crc32, law, shard, slot, grown_shard, moved) of every row, as it lies in the new shards.

    The law is `bytes`: shards of near equal bytes, counting one more for each row. A row's slot is its place in the shard's
    files: they run from 0 in each shard. Null texts have size 1; rows with null or repeated ids are rows like others, and
    texts of any length are too; an empty layout gives an empty table.
    """
    layout = spark.read.schema(LAYOUT).parquet(old_path)
    blocks = max(1, min(BLOCKS, ALL_BLOCKS // old_shards))
    groups = min(GROUPS, blocks, max(1, len(layout.inputFiles()) // old_shards))
    rows = _blocks(layout, groups, blocks)
    plan = reshard_plan(rows, old_shards, new_shards)
    at = F.broadcast(spark.createDataFrame(plan, "old int, group int, block int, shard int, anew boolean"))  # ALL_BLOCKS rows
    placed = rows.join(at, ["old", "group", "block"])
    placed.where("anew").select("doc_id", "text", "old", "shard").write.option("compression", "zstd").partitionBy("shard").parquet(out)
    written = spark.read.schema(LAYOUT + ", shard int").parquet(out).select("doc_id", "text", "old", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("nth"), "shard", F.lit(True).alias("rewritten"))
    every = placed.where("not anew").select("doc_id", "text", "old", "file", "nth", "shard", F.lit(False).alias("rewritten")).unionByName(written)
    files = every.groupBy("shard", "file", "rewritten").agg(F.count("*").alias("rows"))
    in_order = Window.partitionBy("shard").orderBy("rewritten", "file").rowsBetween(Window.unboundedPreceding, -1)
    files.select("shard", "file", F.coalesce(F.sum("rows").over(in_order), F.lit(0)).alias("before"), "rows", "rewritten").write.parquet(f"{out}.manifest")
    before = spark.read.schema(MANIFEST).parquet(f"{out}.manifest").select("file", "before")
    light = every.select("doc_id", "file", "nth", "shard", "old", size_of(F.col("text")).alias("size"), crc32_unsigned(F.col("text")).alias("text_crc32"))
    return light.join(before, "file").select("doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard", (F.col("before") + F.col("nth")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), (F.col("shard") != F.col("old")).alias("moved"))


MANIFEST = "shard int, file string, before long, rows long, rewritten boolean"


def reshard_documents(docs: DataFrame, out: str, old_shards: int = OLD_SHARDS, new_shards: int = NEW_SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Lays docs out in old shards at `out`.old and reshards that to `out`; other columns are ignored."""
    lay_out(docs, f"{out}.old", old_shards, id_col, text_col)
    return reshard(docs.sparkSession, f"{out}.old", out, old_shards, new_shards)


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reshard_documents(table(spark, sf_dir, "documents"), new_path(spark, "shards"))

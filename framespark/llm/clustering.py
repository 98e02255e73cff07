"""Centroid clustering with exact integers; nearest centroids by a vantage-point tree.

The tree is rebuilt in the driver from the centroids of each round and broadcast; centroids are a bounded number (`k`, and
`k * dims` integers). A node has a vantage centroid and, for each of its two sides, the least and largest distance from
there. Every vector searches best first: it opens the node with the least lower bound, until that bound is beyond its best
distance. The bound is inclusive, with a margin above the rounding of square roots, so centroids at equal distance are
all met; distances themselves are 64-bit integers, and of equal ones the smaller number holds.

A batch of vectors takes its steps together: each has a row of bounds, one for each node of the tree.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table

#: Of the query: centroids, rounds, components, units to 1, and the text before an id whose hash orders the first centroids.
K, ROUNDS, DIMS, SCALE, SALT = 8, 10, 64, 1024, "3:"
#: Components, in units, stay below this magnitude, so squared distances of up to 64 components fit 63 bits.
LARGEST = 1 << 27
#: Centroids in a leaf at most.
LEAF = 3
#: What square roots and their differences may be off, for distances below 2**32.
MARGIN = 1e-4
#: Bounds in the rows of a batch, about: so many vectors at once that they fit a few MB.
CELLS = 1 << 18


@dataclass
class Tree:
    """Arrays by node: its vantage centroid (-1: a leaf), its two sides with the range of distances in each, its centroids if it is a leaf."""

    points: np.ndarray
    vantage: np.ndarray
    side: np.ndarray
    low: np.ndarray
    high: np.ndarray
    leaf: list[np.ndarray]


def squares(points: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer rows."""
    off = points - to
    return np.einsum("...i,...i->...", off, off)


def build_tree(points: np.ndarray, leaf: int = LEAF) -> Tree:
    vantage, side, low, high, leaves = [], [], [], [], []

    def node(members: np.ndarray) -> int:
        at = len(vantage)
        vantage.append(-1), side.append((-1, -1)), low.append((0.0, 0.0)), high.append((0.0, 0.0)), leaves.append(members)
        if len(members) > leaf:
            # the vantage centroid is the one furthest from the first
            first = squares(points[members], points[members[0]])
            v = int(np.argmax(first))
            rest = np.delete(members, v)
            far = np.sqrt(squares(points[rest], points[members[v]]).astype(np.float64))
            order = np.argsort(far, kind="stable")
            halves = order[: len(order) // 2], order[len(order) // 2 :]
            vantage[at], leaves[at] = int(members[v]), members[:0]
            low[at], high[at] = tuple(float(far[h].min()) for h in halves), tuple(float(far[h].max()) for h in halves)
            side[at] = tuple(node(rest[h]) for h in halves)
        return at

    if len(points):
        node(np.arange(len(points)))
    return Tree(points, np.array(vantage, np.int64), np.array(side, np.int64), np.array(low), np.array(high), leaves)


def nearest(tree: Tree, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Number and squared distance of each vector's nearest centroid, and how many distances that took."""
    n, nodes = len(vectors), len(tree.vantage)
    best, number = np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
    bounds = np.full((n, nodes), np.inf)
    bounds[:, 0] = 0
    open_, taken = np.arange(n), 0

    def meet(rows: np.ndarray, centroid: int) -> np.ndarray:
        d = squares(vectors[rows], tree.points[centroid])
        better = (d < best[rows]) | ((d == best[rows]) & (centroid < number[rows]))
        best[rows[better]], number[rows[better]] = d[better], centroid
        return d

    while len(open_):
        at = np.argmin(bounds[open_], axis=1)
        least = bounds[open_, at]
        # inclusive: a node whose bound equals the best distance is opened
        more = least <= np.sqrt(best[open_].astype(np.float64)) + MARGIN
        open_, at, least = open_[more], at[more], least[more]
        bounds[open_, at] = np.inf
        for k in np.unique(at):
            rows, bound = open_[at == k], least[at == k]
            if (v := tree.vantage[k]) < 0:
                for c in tree.leaf[k]:
                    meet(rows, int(c))
                taken += len(rows) * len(tree.leaf[k])
                continue
            d = np.sqrt(meet(rows, int(v)).astype(np.float64))
            taken += len(rows)
            for s in (0, 1):
                bounds[rows, tree.side[k, s]] = np.maximum(bound, np.maximum(tree.low[k, s] - d, d - tree.high[k, s]))
        open_ = open_[np.isfinite(bounds[open_]).any(axis=1)]
    return number, best, taken


def _batches(batch: pa.RecordBatch, tree: Tree, dims: int) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray]]:
    column = batch.column(batch.schema.get_field_index("v"))
    vectors = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
    step = max(1, CELLS // max(1, len(tree.vantage)))
    for at in range(0, len(vectors), step):
        some = vectors[at : at + step]
        yield slice(at, at + len(some)), some, *nearest(tree, some)[:2]


def assigned(vectors: DataFrame, centroids: np.ndarray, dims: int) -> DataFrame:
    """(vec_id, cluster, distance) of every row of vectors (vec_id, v)."""
    tree = vectors.sparkSession.sparkContext.broadcast(build_tree(centroids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, _, number, best in _batches(batch, tree.value, dims):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at.start, at.stop - at.start), pa.array(number, pa.int32()), pa.array(best, pa.int64())], names=["vec_id", "cluster", "distance"])

    return vectors.select("vec_id", "v").mapInArrow(run, "vec_id long, cluster int, distance long")


def moved(vectors: DataFrame, centroids: np.ndarray, dims: int) -> np.ndarray:
    """The centroids after a round: floors of the exact means of their vectors; those without any stay. Tasks send a sum for each centroid and component."""
    tree = vectors.sparkSession.sparkContext.broadcast(build_tree(centroids))
    k = len(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((k, dims), np.int64), np.zeros(k, np.int64)

        def rows() -> pa.RecordBatch:
            held = np.flatnonzero(counts)
            flat = pa.array(sums[held].ravel())
            return pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(counts[held]), pa.ListArray.from_arrays(pa.array(np.arange(len(held) + 1) * dims, pa.int32()), flat)], names=["cluster", "n", "s"])

        for batch in batches:
            for _, some, number, _ in _batches(batch, tree.value, dims):
                order = np.argsort(number, kind="stable")
                clusters, starts = np.unique(number[order], return_index=True)
                sums[clusters] += np.add.reduceat(some[order], starts, axis=0)
                counts += np.bincount(number, minlength=k)
            if counts.sum() > 1 << 34:  # far from 63 bits
                yield rows()
                sums[:], counts[:] = 0, 0
        yield rows()

    parts = vectors.select("v").mapInArrow(run, "cluster int, n long, s array<long>")
    total = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
    by = parts.select("cluster", "n", F.posexplode("s").alias("i", "s")).groupBy("cluster", "i").agg(total("n"), total("s"))
    out = centroids.copy()
    for r in by.collect():  # k * dims rows, in one job: an iterator has a job for each shuffle partition
        out[r["cluster"], r["i"]] = int(r["s"]) // int(r["n"])
    tree.destroy()
    return out


def units(vectors: DataFrame, dims: int, scale: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, v, fits) of the vectors with `dims` components, none null or non-finite, as integers floor(scale * x)."""
    x = F.col(vector_col).cast("array<double>")
    finite = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != float("inf")))
    kept = vectors.where((F.size(vector_col) == dims) & finite)
    # beyond 2**27 units no integer is made
    fits = F.forall(x, lambda e: F.abs(e * scale) < LARGEST)
    return kept.select(F.col(id_col).cast("long").alias("vec_id"), F.when(fits, F.transform(x, lambda e: F.floor(e * scale))).alias("v"))


def cluster(vectors: DataFrame, k: int, rounds: int, dims: int, scale: int = SCALE, salt: str = SALT, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector with `dims` components, none null or non-finite.

    The first centroids are the k vectors with the smallest sha256 of salt and id; equal hashes, of repeated ids, are
    ordered by their components, and null ids come last. With fewer vectors there are fewer centroids; without any, no rows. Repeated
    vectors may be several centroids: the smallest number takes the vectors then, and the others stay. A vector with a
    component of 2**27 units or more (131,072 at the scale 1,024), where squared distances pass 63 bits, has null cluster,
    distance and inertia and moves no centroid. inertia is null if it passes 63 bits. Other columns are ignored.
    """
    if dims > 64:
        raise ValueError("squared distances of more than 64 components may pass 63 bits")
    held = materialize(units(vectors, dims, scale, id_col, vector_col), "vectors")
    inside = held.where("v is not null")
    order = F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")), 256)
    first = inside.orderBy(order.asc_nulls_last(), F.col("v")).limit(k).collect()
    points = np.array([r["v"] for r in first], np.int64).reshape(len(first), dims)
    for _ in range(rounds if len(points) else 0):
        new = moved(inside, points, dims)
        if (new == points).all():  # further rounds are the same
            break
        points = new
    spark = vectors.sparkSession
    out = materialize(assigned(inside, points, dims), "assigned")
    outside = held.where("v is null").select("vec_id")
    long = lambda c: F.sum(F.col(c).cast("decimal(38,0)"))
    # k rows
    by = out.groupBy("cluster").agg(long("distance").alias("s"))
    digest = [(i, hashlib.sha256(",".join(map(str, p)).encode()).hexdigest()) for i, p in enumerate(points.tolist())]
    digests = spark.createDataFrame(digest, "cluster int, centroid_sha256 string")
    whole = by.agg(long("s").try_cast("long").alias("inertia"))
    stats = by.select("cluster", F.col("s").try_cast("long").alias("cluster_inertia")).join(F.broadcast(digests), "cluster").crossJoin(F.broadcast(whole))
    got = out.join(F.broadcast(stats), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
    return got.unionByName(outside, allowMissingColumns=True)


def op12_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(table(spark, sf_dir, "embeddings"), K, ROUNDS, DIMS)


def _sql() -> str:
    """The rounds as common tables, one after another."""
    near = "SELECT rid, vec_id, arg_min(c, (d, c)) AS c, min(d) AS d FROM (SELECT vec_id, rid, c, list_sum(list_transform(list_zip(v, p), lambda x: ((x[1] - x[2]) * (x[1] - x[2]))::HUGEINT)) AS d FROM kept, {0}) GROUP BY rid, vec_id"
    parts = [
        f"kept AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE len(embedding) = {DIMS} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIMS})",
        f"p0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, v) - 1 AS c, v AS p FROM (SELECT sha256('{SALT}' || vec_id::VARCHAR) AS h, v FROM kept) ORDER BY h, v LIMIT {K})",
    ]
    for r in range(ROUNDS):
        parts.append(f"a{r} AS MATERIALIZED ({near.format(f'p{r}')})")
        parts.append(
            f"p{r + 1} AS MATERIALIZED (SELECT p.c, coalesce(m.p, p.p) AS p FROM p{r} p LEFT JOIN (SELECT c, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS p FROM "
            f"(SELECT c, i, sum(x)::HUGEINT AS s, count(*)::HUGEINT AS n FROM (SELECT c, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM kept JOIN a{r} USING (rid)) GROUP BY c, i) GROUP BY c) m USING (c))"
        )
    parts.append(f"last AS MATERIALIZED ({near.format(f'p{ROUNDS}')})")
    return (
        "WITH " + ", ".join(parts) + " SELECT vec_id, c::INTEGER AS cluster, d::BIGINT AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, "
        "sha256(array_to_string(p, ',')) AS centroid_sha256 FROM last JOIN p{} USING (c)".format(ROUNDS)
    )


OP12_SQL = _sql()

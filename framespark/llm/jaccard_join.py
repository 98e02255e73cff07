"""Exact Jaccard join of shingle sets by a matrix of tokens and groups.

Texts with equal shingle sets are one class. Similar classes are put into groups: those that share a minhash value are linked
inside blocks of bounded size first, and what is linked lies together in groups of bounded weight. The matrix says which
groups hold a token. Only tokens of a set's prefix enter it: in an order of all tokens (heavy ones last), two sets
that share at least `a` tokens share l of the first n - a + l ones of either. A set and a group that meet often enough there, with sizes
that fit, are a query of that group. The group's stored token union bounds the similarity to each of its members: only a group whose
union shares enough tokens with the query is opened, and its members are compared with it in full. Sets that are in one component
already are no query of each other's groups.

Every step is exact: a link that joins two components has a token pair in the matrix, passes the union's bound and is found when the
group is opened. Minhashes and heavy tokens decide about groups and order, that is about work, and never about results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, map_batches, materialize, table
from .near_dedup import LOWER_BYTES, WordHashes, components, joining, mixed, one_of_each, set_digests, texts_near

#: Words in a shingle and percent of the query.
QUERY_SHINGLE, QUERY_PERCENT = 4, 85
#: The same where no contract says otherwise.
SHINGLE, PERCENT = 5, 80
#: Minhash values that choose groups.
VALUES = 4
#: Shingles, about, in a group or a block of queries, and what a set counts beside its own.
WEIGHT, MEMBER = 200_000, 64
#: Members, about, of a part in which groups are cut in order.
PART = 2000
#: One more token must be shared for so many in a set (l = 1 + n // STEP).
STEP = 32
#: Buckets of tokens by leading bits, of which heavy ones come last in the order; a task reports so many, and so many are kept.
BUCKET_BITS, REPORTED, HEAVY = 24, 1 << 16, 1 << 18
#: Times the mean of all buckets, and occurrences, from which a bucket is heavy.
TIMES, LEAST = 8, 64
#: Classes that a task remembers to send each once.
SEEN = 1 << 20
_U = np.uint64
#: Odd factors of the words of a shingle by place, drawn once: shingles have so many words at most.
_FACTORS = np.random.default_rng(31).integers(0, 2**63, 64).astype(_U) * _U(2) + _U(1)


def shingle_sets(texts: list[str | None], k: int, hashes: WordHashes) -> list[np.ndarray]:
    """Sorted hashes of the distinct k-word shingles of each text; of the whole sequence if it is shorter; none without words."""
    words = [(t or "").encode("utf-8", "surrogatepass").translate(LOWER_BYTES).split() for t in texts]
    sizes = np.array([len(w) for w in words])
    ids = np.concatenate([np.zeros(0, _U), *(hashes.of(w) for w in words)])
    padded = np.concatenate([ids, np.zeros(k, _U)])
    value = np.full(len(ids), k, _U)
    for i in range(k):
        value += padded[i : i + len(ids)] * _FACTORS[i]
    value = mixed(value)
    out, at = [], 0
    for n in sizes.tolist():
        if n >= k:
            out.append(np.unique(value[at : at + n - k + 1]))
        elif n:
            short = _U(n)
            for i in range(n):
                short = mixed(short + ids[at + i : at + i + 1] * _FACTORS[i])
            out.append(short)
        else:
            out.append(np.zeros(0, _U))
        at += n
    return out


def shingles(text: str | None, k: int, hashes: WordHashes) -> np.ndarray:
    return shingle_sets([text], k, hashes)[0]


def bucket(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> _U(64 - BUCKET_BITS)).astype(np.int64)


def signatures(docs: DataFrame, k: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, n, h1, h2, m, heavy): size and digest of the shingle set and its minhash values. A row with n = -1 for each task has its buckets with many tokens instead, as pairs of 64-bit numbers."""
    seeds = np.random.default_rng(29).integers(0, 2**63, VALUES).astype(_U)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, counts = WordHashes(), np.zeros(1 << BUCKET_BITS, np.int32)
        names = ["doc_id", "n", "h1", "h2", "m", "heavy"]
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for at in range(0, len(texts), 256):
                sets = shingle_sets(texts[at : at + 256], k, hashes)
                sizes = np.array([len(s) for s in sets])
                every, full = np.concatenate(sets), sizes > 0
                np.add.at(counts, bucket(every), 1)
                values = np.zeros((len(sets), VALUES), np.int64)
                if len(every):
                    starts = (np.cumsum(sizes) - sizes)[full]
                    for v, seed in enumerate(seeds):
                        values[full, v] = np.minimum.reduceat(mixed(every ^ seed), starts).view(np.int64)
                m = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * VALUES, pa.int32()), pa.array(values.ravel()))
                h1, h2 = set_digests(sets)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(sets)), pa.array(sizes), pa.array(h1.copy().view(np.int64)), pa.array(h2.copy().view(np.int64)), m, pa.nulls(len(sets), pa.binary())], names=names)
        top = np.flatnonzero(counts > TIMES * counts.mean() + TIMES)
        top = top[np.argsort(-counts[top], kind="stable")[:REPORTED]]
        many = np.stack([top, counts[top].astype(np.int64)], axis=1).tobytes() + np.array([-1, counts.sum(dtype=np.int64)]).tobytes()
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.array([-1]), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([None], pa.list_(pa.int64())), pa.array([many], pa.binary())], names=names)

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_batches(texts, run, "doc_id long, n long, h1 long, h2 long, m array<long>, heavy binary")


def token_levels(signed: DataFrame) -> np.ndarray:
    """The level of each bucket in the order of tokens: 0, or more for heavier ones. A table of fixed size, from the tasks' reports."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for value in batch.column(0):
                pairs = np.frombuffer(value.as_py(), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["b", "n"])

    counts = signed.where("n = -1").select("heavy").mapInArrow(run, "b long, n long").groupBy("b").agg(F.sum("n").alias("n"))
    heavy = {r["b"]: r["n"] for r in counts.where("b < 0").collect()} | {r["b"]: r["n"] for r in counts.where("b >= 0").orderBy(F.desc("n"), "b").limit(HEAVY).collect()}
    least = max(LEAST, TIMES * heavy.pop(-1, 0) / (1 << BUCKET_BITS))
    levels = np.zeros(1 << BUCKET_BITS, np.uint8)
    for b, n in heavy.items():
        if n >= least:
            levels[b] = 1 + int(np.log2(n / least))
    return levels


# --- groups ---------------------------------------------------------------------------------------------------------------
def in_blocks(rows: DataFrame, keys: list[str], order: list[str], most: int, part: int) -> DataFrame:
    """Adds part and block: members of equal keys (id, n, m), in blocks of about `most` shingles. Many members are dealt into parts by their minhash values, so similar ones stay together; `order` holds inside a part."""
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("_members")).where(F.col("_members") > part)
    rows = rows.join(sizes, keys, "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("m"), F.ceil(F.col("_members") / part)), F.lit(0)).cast("int"))
    running = Window.partitionBy(*keys, "part").orderBy(*order, "id").rowsBetween(Window.unboundedPreceding, -1)
    weight = F.coalesce(F.sum(F.col("n") + MEMBER).over(running), F.lit(0))
    return rows.withColumn("block", F.floor(weight / most).cast("long")).drop("_members")


def links_in_groups(rows: DataFrame, texts: DataFrame, keys: list[str], k: int, percent: int) -> DataFrame:
    """(a, b): links inside the groups of rows (id, component, keys...) that join components."""

    def run(group: pa.Table) -> pa.Table:
        hashes = WordHashes()
        ids, component = group.column("id").to_numpy(), group.column("component").to_numpy()
        sets = shingle_sets(group.column("text").to_pylist(), k, hashes)
        names, members = np.unique(component, return_counts=True)
        left = np.flatnonzero(component != names[np.argmax(members)])
        # either member of a pair outside the largest component meets all others
        links = joining(sets, component, left, np.arange(len(sets)), percent)
        return pa.table({"a": pa.array([int(ids[i]) for i, _ in links], pa.int64()), "b": pa.array([int(ids[j]) for _, j in links], pa.int64())})

    with_texts = rows.join(texts_near(texts, rows.select("id").distinct()), "id").select("id", "component", *keys, "text")
    return materialize(with_texts.groupBy(*keys).applyInArrow(run, "a long, b long"), "join_links")


def families(classes: DataFrame, texts: DataFrame, k: int, percent: int, weight: int, part: int) -> DataFrame:
    """(a, b): links between classes that share a minhash value, found in blocks: first for one value, then for the others where components are still apart."""
    links = None
    for values in ([0], list(range(1, VALUES))):
        rows = classes
        if links is not None:
            found = components(links)
            rows = classes.join(found, "id", "left").withColumn("component", F.coalesce("component", "id"))
        else:
            rows = classes.withColumn("component", F.col("id"))
        entries = rows.select("id", "n", "m", "component", F.explode(F.array(*[F.struct(F.lit(v).alias("v"), F.col("m")[v].alias("x")) for v in values])).alias("e")).select("id", "n", "m", "component", "e.v", "e.x")
        apart = entries.groupBy("v", "x").agg(F.min("component").alias("_l"), F.max("component").alias("_g")).where("_l <> _g").select("v", "x")
        blocks = materialize(in_blocks(entries.join(apart, ["v", "x"]), ["v", "x"], ["m"], weight, part), "join_blocks")
        new = links_in_groups(blocks, texts, ["v", "x", "part", "block"], k, percent)
        discard(blocks)
        links = new if links is None else materialize(links.unionByName(new), "join_links")
    return links


# --- the matrix -----------------------------------------------------------------------------------------------------------
def least_shared(n: int | Column, s: int | Column, percent: int):
    """Shared tokens that sets of n and s tokens need."""
    both = n + s
    return F.ceil(both * percent / (100 + percent)) if isinstance(both, Column) else -(-both * percent // (100 + percent))


def prefix_lengths(n: int, percent: int) -> tuple[int, int, int]:
    """Tokens in the prefix of a set of n tokens as the smaller one of a pair and as the larger one; tokens that both must share there."""
    shared = 1 + n // STEP
    return n - least_shared(n, n, percent) + shared, min(n, n - -(-n * percent // 100) + shared), shared


def prefixes(texts: DataFrame, k: int, percent: int, levels: np.ndarray) -> DataFrame:
    """(tok, c, at): the prefix tokens of each text; c is half of its set's digest, at has its size in the upper 32 bits and the token's place in the lower."""
    held = texts.sparkSession.sparkContext.broadcast(levels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, seen = WordHashes(), set()
        for batch in batches:
            tok, c, at = [], [], []
            sets = [s for s in shingle_sets(batch.column(0).to_pylist(), k, hashes) if len(s)]
            for tokens, h1, h2 in zip(sets, *set_digests(sets), strict=True):
                if (both := (int(h1), int(h2))) in seen:
                    continue
                seen.add(both)
                longest = prefix_lengths(len(tokens), percent)[1]
                first = tokens[np.argsort(held.value[bucket(tokens)], kind="stable")[:longest]]
                tok.append(first)
                c.append(np.full(len(first), h1))
                at.append((len(tokens) << 32) + np.arange(len(first)))
            if len(seen) > SEEN:
                seen.clear()
            if tok:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(_U, copy=False).view(np.int64)) for x in (tok, c, at)], names=["tok", "c", "at"])

    return map_batches(texts.select("text"), run, "tok long, c long, at long")


def matrix(entries: DataFrame, placed: DataFrame) -> DataFrame:
    """(tok, id, n, pos, grp, component) of the tokens that lie in several components. placed: (id, n, h1, grp, component)."""
    by = Window.partitionBy("tok")
    # most tokens are one class's: they end here
    several = entries.withColumns({"_l": F.min("c").over(by), "_g": F.max("c").over(by)}).where("_l <> _g").select("tok", "c", "at").distinct()
    rows = several.select("tok", "c", F.shiftright("at", 32).alias("n"), F.col("at").bitwiseAND(0xFFFFFFFF).alias("pos"))
    rows = rows.join(placed.withColumnRenamed("h1", "c"), ["c", "n"])
    rows = rows.withColumns({"_l": F.min("component").over(by), "_g": F.max("component").over(by)}).where("_l <> _g")
    return materialize(rows.select("tok", "id", "n", "pos", "grp", "component"), "join_matrix")


def queries_of_groups(cells: DataFrame, percent: int) -> DataFrame:
    """(id, n, grp, component, least): sets and groups of other components with members at least as large that share enough prefix tokens; least is the size of the smallest such member, or the set's own."""
    n, pos = F.col("n"), F.col("pos")
    shared = 1 + F.floor(n / STEP)
    # the largest partner for which a token at this place still counts
    reach = F.floor((n - pos + shared - 1) * (100 + percent) / percent) - n
    cells = cells.select("*", reach.alias("reach"), shared.alias("shared"))
    groups = cells.groupBy("tok", "grp", "component").agg(F.min("n").alias("g_least"), F.max("n").alias("g_most"), F.max("reach").alias("g_reach"))
    groups = groups.select("tok", "grp", F.col("component").alias("g_component"), "g_least", "g_most", "g_reach")
    asks = cells.where(pos < n - least_shared(n, n, percent) + shared).select("tok", "id", "n", "component", "reach", "shared")
    met = asks.join(groups, "tok").where((F.col("component") != F.col("g_component")) & (F.col("g_most") >= n) & (F.col("g_least") <= F.col("reach")) & (F.col("g_reach") >= n) & (F.col("g_least") * percent <= n * 100))
    by = met.groupBy("id", "n", "component", "grp", "shared").agg(F.count("*").alias("hits"), F.min("g_least").alias("least"))
    return by.where(F.col("hits") >= F.col("shared")).select("id", "n", "component", "grp", F.greatest("least", "n").alias("least"))


def unions(members: DataFrame, texts: DataFrame, k: int) -> DataFrame:
    """(grp, tokens): the sorted tokens of each group's members, from members (id, grp)."""

    def run(group: pa.Table) -> pa.Table:
        hashes = WordHashes()
        every = np.unique(np.concatenate(shingle_sets(group.column("text").to_pylist(), k, hashes)))
        return pa.table({"grp": group.column("grp")[:1], "tokens": pa.array([every.tobytes()], pa.binary())})

    with_texts = members.join(texts_near(texts, members.select("id")), "id").select("grp", "text")
    return materialize(with_texts.groupBy("grp").applyInArrow(run, "grp long, tokens binary"), "join_unions")


def _in_query_blocks(asked: DataFrame, weight: int) -> tuple[DataFrame, DataFrame]:
    """asked with a block of its group's queries, and (grp, block) of all blocks."""
    blocks = asked.groupBy("grp").agg(F.ceil(F.sum(F.col("n") + MEMBER) / weight).cast("int").alias("blocks"))
    asked = asked.join(blocks, "grp").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).drop("blocks")
    return asked, blocks.select("grp", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))


def qualifying(asked: DataFrame, united: DataFrame, texts: DataFrame, k: int, percent: int, weight: int) -> DataFrame:
    """The rows of asked whose group's union shares enough tokens with the set."""

    def run(group: pa.Table) -> pa.Table:
        hashes = WordHashes()
        union = [np.frombuffer(t, _U) for t in group.column("tokens").to_pylist() if t is not None]
        keep = []
        for text, n, least in zip(group.column("text").to_pylist(), group.column("n").to_pylist(), group.column("least").to_pylist(), strict=True):
            bound = len(np.intersect1d(shingles(text, k, hashes), union[0], assume_unique=True)) if n is not None else 0
            keep.append(n is not None and bound >= least_shared(n, least, percent))
        return group.filter(pa.array(keep, pa.bool_())).select(["id", "n", "component", "grp"])

    asked, blocks = _in_query_blocks(asked, weight)
    rows = asked.join(texts_near(texts, asked.select("id").distinct()), "id").select("grp", "block", "id", "n", "component", "least", "text")
    rows = rows.unionByName(blocks.join(united, "grp"), allowMissingColumns=True)
    return materialize(rows.groupBy("grp", "block").applyInArrow(run, "id long, n long, component long, grp long"), "join_qualifying")


def opened(asked: DataFrame, members: DataFrame, texts: DataFrame, k: int, percent: int, weight: int) -> DataFrame:
    """(a, b): links between the sets of asked (id, n, component, grp) and members (id, component, grp) of their groups."""

    def run(group: pa.Table) -> pa.Table:
        hashes = WordHashes()
        ids, component, query = (group.column(c).to_numpy(zero_copy_only=False) for c in ("id", "component", "query"))
        sets = shingle_sets(group.column("text").to_pylist(), k, hashes)
        links = joining(sets, component, np.flatnonzero(query), np.flatnonzero(~query), percent)
        return pa.table({"a": pa.array([int(ids[i]) for i, _ in links], pa.int64()), "b": pa.array([int(ids[j]) for _, j in links], pa.int64())})

    asked, blocks = _in_query_blocks(asked, weight)
    rows = asked.select("grp", "block", "id", "component", F.lit(True).alias("query"))
    rows = rows.unionByName(members.join(blocks, "grp").select("grp", "block", "id", "component", F.lit(False).alias("query")))
    rows = materialize(rows, "join_opened")
    with_texts = rows.join(texts_near(texts, rows.select("id").distinct()), "id")
    links = materialize(with_texts.groupBy("grp", "block").applyInArrow(run, "a long, b long"), "join_links")
    discard(rows)
    return links


def jaccard_join(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text", weight: int = WEIGHT, part: int = PART, salts: int = 16) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row, on whole texts.

    Rows are linked if 100 * |intersection| >= percent * |union| of their shingle sets (of 64-bit hashes); component_id is the smallest
    doc_id reachable. Texts of fewer than k words are one shingle; null texts, and texts without words, have none and
    are linked with nothing. Rows with a null doc_id are linked with nothing, component null; repeated doc_ids are in one component
    with whatever either of their texts is linked to. An empty table gives none; texts of any length are read whole; other columns are ignored.
    """
    if not 0 < k <= len(_FACTORS):
        raise ValueError(f"shingles have 1 to {len(_FACTORS)} words")
    signed = materialize(signatures(docs, k, id_col, text_col), "join_signatures")
    rows = signed.where("n >= 0").select("doc_id", "n", "h1", "h2", "m")
    classes = materialize(rows.where("doc_id is not null and n > 0").groupBy("n", "h1", "h2").agg(F.min("doc_id").alias("id"), F.count("*").alias("copies"), F.min("m").alias("m")), "join_classes")
    texts = one_of_each(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")), rows)
    first = families(classes.select("id", "n", "m"), texts, k, percent, weight, part)
    found = components(first)
    # groups: parts of a component, a few sizes in each
    placed = classes.join(found, "id", "left").select("id", "n", "h1", "m", F.coalesce("component", "id").alias("component"))
    placed = in_blocks(placed, ["component"], ["n"], weight, part)
    placed = materialize(placed.withColumn("grp", F.min("id").over(Window.partitionBy("component", "part", "block"))).select("id", "n", "h1", "grp", "component"), "join_groups")
    cells = matrix(prefixes(docs.where(F.col(id_col).isNotNull()).select(F.col(text_col).cast("string").alias("text")), k, percent, token_levels(signed)), placed)
    asked = materialize(queries_of_groups(cells, percent), "join_queries")
    touched = placed.join(asked.select("grp").distinct(), "grp", "left_semi").select("id", "grp", "component")
    united = unions(touched.select("id", "grp"), texts, k)
    passed = qualifying(asked, united, texts, k, percent, weight)
    second = opened(passed, placed.join(passed.select("grp").distinct(), "grp", "left_semi").select("id", "grp", "component"), texts, k, percent, weight)
    # a repeated doc_id joins the classes of its texts
    held = rows.where("n > 0 and doc_id is not null")
    repeated = held.groupBy("n", "h1", "h2", "doc_id").count().groupBy("doc_id").agg(F.count("*").alias("sets")).where("sets > 1").select("doc_id")
    same = held.join(repeated, "doc_id").join(classes.select("n", "h1", "h2", "id"), ["n", "h1", "h2"]).select(F.col("doc_id").alias("a"), F.col("id").alias("b")).where("a <> b")
    links = materialize(first.unionByName(second).unionByName(same).distinct(), "join_links")
    for done in (first, found, placed, cells, asked, united, passed, second):
        discard(done)
    final = components(links)
    discard(links)
    # classes of several rows, or linked with others, are salted to meet their rows
    told = classes.join(final, "id", "left").withColumn("component", F.coalesce("component", "id")).where("copies > 1 or component <> id")
    told = told.select(F.col("n").alias("_n"), F.col("h1").alias("_1"), F.col("h2").alias("_2"), "component", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_s"))
    salted = rows.select("doc_id", "n", "h1", "h2", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int").alias("s"))
    out = salted.join(told, (F.col("n") == F.col("_n")) & (F.col("h1") == F.col("_1")) & (F.col("h2") == F.col("_2")) & (F.col("s") == F.col("_s")), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))


def op11_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents"), QUERY_SHINGLE, QUERY_PERCENT)

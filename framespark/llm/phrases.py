"""Phrases whose words occur together more often than apart, counted by tiles of ranked pairs.

Words that are frequent enough get ids by falling frequency, so a small id is a frequent word and the pairs of
small ids fill a corner of the matrix of pairs. Tasks cut that matrix into square tiles: a tile with many pairs is counted in a
dense array (numpy's bincount), all others as sorted coordinates with counts. Partial counts meet in an aggregate
by pair. Frequent pairs are ranked again and get ids of their own: the pair of the ids at two neighbouring places is then a
phrase of one more word, counted in the same way, up to the longest phrase. A part of a frequent phrase is at least as frequent as
the phrase, so no phrase is missed.

Texts become blocks of ids, written once for each length; a break is -1. Ids of the most frequent entries reach the tasks by a
broadcast of bounded size (HEAD entries, HEAD_BYTES), those of any others by a join with the keys of each block.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, map_batches, materialize, table

#: Of the query: least occurrences, most words, phrases a language, percent of a phrase's occurrences that lie in a longer one.
LEAST, LONGEST, TOP, INSIDE = 100, 5, 2000, 100
#: Side of a tile; pairs in a chunk from which it is dense, and dense tiles that a task holds.
TILE, DENSE, HELD = 1024, 1 << 16, 8
#: Pairs that a task counts at once, and ids in a block.
CHUNK, BLOCK = 1 << 22, 1 << 16
#: Entries of a dictionary that are broadcast, their bytes, and those of one word.
HEAD, HEAD_BYTES, WORD_BYTES = 1 << 18, 16 << 20, 1 << 16
#: Different words that a task counts at once, and parts of a language in the choice of its first phrases.
WORDS, PARTS = 300_000, 64
#: Separators become full stops, and capital letters of ASCII small ones.
_MAP = bytes.maketrans(bytes(range(65, 91)) + b",;:!?\n\x0b\x0c\r", bytes(range(97, 123)) + b"." * 9)


def tokens(text: bytes | None) -> list[bytes]:
    """The words, with b"." between pieces (it is no word, as it separates pieces)."""
    return (text or b"").translate(_MAP).replace(b".", b" . ").split()


def _texts(docs: DataFrame, lang_col: str, text_col: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).cast("string").cast("binary").alias("text"))


def word_counts(texts: DataFrame, most: int = WORDS) -> DataFrame:
    """(lang, word, n) from (lang, text): counted in tasks first."""

    def rows(counts: dict[str, Counter]) -> Iterator[pa.RecordBatch]:
        for lang, words in counts.items():
            words.pop(b".", None)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(words), pa.string()), pa.array(list(words), pa.binary()), pa.array(list(words.values()), pa.int64())], names=["lang", "word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, seen = defaultdict(Counter), 0
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                counts[lang].update(tokens(text.as_py()))
            if sum(map(len, counts.values())) > most:
                yield from rows(counts)
                counts = defaultdict(Counter)
        yield from rows(counts)

    return map_batches(texts, run, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def ranked(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Adds id, the place by falling n from 0. Rows are sorted in ranges: a row's place is that in its range and the sizes of the ranges before."""
    placed = materialize(counts.sort(F.desc("n"), *keys).withColumn("_at", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("_at", 33)
    sizes = sorted((r["p"], r["m"]) for r in placed.groupBy(part.alias("p")).agg(F.count("*").alias("m")).collect())  # a row a range
    before, offset = {}, 0
    for p, m in sizes:
        before[p], offset = offset - (p << 33), offset + m
    if offset >= 1 << 31:
        raise ValueError(f"{offset} frequent entries are more than 31 bits number")
    starts = counts.sparkSession.createDataFrame(list(before.items()), "_part long, _start long")
    return placed.join(F.broadcast(starts), part == F.col("_part")).withColumn("id", (F.col("_at") + F.col("_start")).cast("int")).drop("_at", "_part", "_start")


# --- ids of words and pairs -----------------------------------------------------------------------------------------------
class WordIds:
    """Ids of the words of each language in a broadcast."""

    def __init__(self, words: DataFrame, most: int, most_bytes: int) -> None:
        sizes = words.where(F.col("id") < most).select("id", F.length("word").alias("size")).toPandas().sort_values("id")
        sizes = sizes[sizes["size"] <= WORD_BYTES]
        sizes = sizes[sizes["size"].cumsum() <= most_bytes]
        self.last = int(sizes["id"].max()) if len(sizes) else -1
        self.inside = (F.col("id") <= self.last) & (F.length("word") <= WORD_BYTES)
        held: dict[str, dict[bytes, int]] = defaultdict(dict)
        for r in words.where(self.inside).toLocalIterator():
            held[r["lang"]][bytes(r["word"])] = r["id"]
        self.held = words.sparkSession.sparkContext.broadcast(dict(held))


class PairIds:
    """Ids of pairs in a broadcast: sorted codes, and the id of each."""

    def __init__(self, pairs: DataFrame, most: int) -> None:
        self.inside = F.col("id") < most
        got = pairs.where(self.inside).select("code", "id").toPandas().sort_values("code")
        self.held = pairs.sparkSession.sparkContext.broadcast((got["code"].to_numpy(np.int64), got["id"].to_numpy(np.int32)))


def found(codes: np.ndarray, known: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The id of each code, -1 where it isn't known."""
    if not len(known):
        return np.full(len(codes), -1, np.int32)
    at = np.minimum(np.searchsorted(known, codes), len(known) - 1)
    return np.where(known[at] == codes, ids[at], np.int32(-1))


def codes_of(ids: np.ndarray) -> np.ndarray:
    """The pair at each place and the next, -1 where one of the two is a break."""
    a, b = ids[:-1].astype(np.int64), ids[1:].astype(np.int64)
    return np.where((a >= 0) & (b >= 0), (a << 32) | b, np.int64(-1))


def blocks(parts: Iterator[np.ndarray], most: int = BLOCK) -> Iterator[pa.RecordBatch]:
    """Sequences as rows of one binary column. Only places with a neighbour matter; a block ends at a break."""
    held, size = [], 0

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([np.concatenate(held).tobytes()], pa.binary())], names=["ids"])

    for ids in parts:
        known = np.concatenate([[False], ids >= 0, [False]])
        keep = known[1:-1] & (known[:-2] | known[2:])
        # a break after each run
        kept = np.where(keep, ids, np.int32(-1))[keep | np.concatenate([[False], keep[:-1]])]
        if len(kept):
            held.append(np.append(kept, np.int32(-1)).astype(np.int32))
            size += len(kept) + 1
        if size >= most:
            yield row()
            held, size = [], 0
    if held:
        yield row()


def _sequences(column: pa.Array) -> Iterator[np.ndarray]:
    for value in column:
        yield np.frombuffer(value.as_py(), np.int32)


def _with_tail(rows: DataFrame, keys_of: Callable[[pa.RecordBatch], Iterator[list]], kind: str, rest: DataFrame, on: list[str]) -> DataFrame:
    """rows with own, the list of (key, id) of those of its keys that only `rest` has. Keys outside the broadcast are rare ones, each joined once for a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, lang, keys in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), keys_of(batch), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array([row] * len(keys), pa.int64()), pa.array([lang] * len(keys), pa.string()), pa.array(keys, pa.binary() if kind == "binary" else pa.int64())], names=["row", "lang", "key"])

    asked = map_batches(rows, run, f"row long, lang string, key {kind}")
    own = asked.join(rest, on).groupBy("row").agg(F.collect_list(F.struct("key", "id")).alias("own"))
    return rows.join(own, "row", "left")


def word_blocks(texts: DataFrame, words: DataFrame, most: int = HEAD, most_bytes: int = HEAD_BYTES) -> DataFrame:
    """(ids): blocks of word ids of (lang, text), from words (lang, word, n, id)."""
    known = WordIds(words, most, most_bytes)
    held, rest = known.held, words.where(~known.inside)
    tail = bool(rest.limit(1).count())
    rows = texts
    if tail:
        rows = materialize(texts.withColumn("row", F.monotonically_increasing_id()), "phrase_texts").select("row", "lang", "text")

        def keys_of(batch: pa.RecordBatch) -> Iterator[list]:
            for lang, text in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                yield list(set(tokens(text.as_py())).difference(held.value.get(lang, {}), [b"."]))

        rows = _with_tail(rows, keys_of, "binary", rest.select("lang", F.col("word").alias("key"), "id"), ["lang", "key"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts() -> Iterator[np.ndarray]:
            for batch in batches:
                at = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
                own = at["own"].to_pylist() if tail else [None] * batch.num_rows
                for lang, text, more in zip(at["lang"].to_pylist(), at["text"], own, strict=True):
                    ids = held.value.get(lang, {})
                    if more:
                        extra = {m["key"]: m["id"] for m in more}
                        seq = [ids.get(w, -1) if w in ids else extra.get(w, -1) for w in tokens(text.as_py())]
                    else:
                        seq = [ids.get(w, -1) for w in tokens(text.as_py())]
                    yield np.array(seq, np.int32)

        yield from blocks(parts())

    return materialize(map_batches(rows, run, "ids binary"), "phrase_ids")


def pair_blocks(sequences: DataFrame, pairs: DataFrame, most: int = HEAD) -> DataFrame:
    """(ids): the blocks with the id of each place's pair, from pairs (code, n, id)."""
    known = PairIds(pairs, most)
    held, rest = known.held, pairs.where(~known.inside)
    tail = bool(rest.limit(1).count())
    rows = sequences
    if tail:
        rows = materialize(sequences.select(F.monotonically_increasing_id().alias("row"), F.lit(None).cast("string").alias("lang"), "ids"), "phrase_rows")

        def keys_of(batch: pa.RecordBatch) -> Iterator[list]:
            for ids in _sequences(batch.column(2)):
                codes = np.unique(codes_of(ids))
                yield codes[(codes >= 0) & (found(codes, *held.value) < 0)].tolist()

        rows = _with_tail(rows, keys_of, "long", rest.select(F.col("code").alias("key"), "id"), ["key"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts() -> Iterator[np.ndarray]:
            for batch in batches:
                own = batch.column(batch.schema.get_field_index("own")).to_pylist() if tail else [None] * batch.num_rows
                for ids, more in zip(_sequences(batch.column(batch.schema.get_field_index("ids"))), own, strict=True):
                    codes = codes_of(ids)
                    out = found(codes, *held.value)
                    if more:
                        extra = np.array(sorted((m["key"], m["id"]) for m in more), np.int64)
                        out = np.where(out < 0, found(codes, extra[:, 0], extra[:, 1].astype(np.int32)), out)
                    yield out

        yield from blocks(parts())

    return materialize(map_batches(rows, run, "ids binary"), "phrase_ids")


# --- counts of pairs ------------------------------------------------------------------------------------------------------
class Tiles:
    """Counts of pairs of ids: dense tiles, held while the task runs, and sorted coordinates for all others."""

    def __init__(self, side: int = TILE, dense: int = DENSE, held: int = HELD) -> None:
        self.side, self.dense, self.most, self.held = side, dense, held, {}

    def add(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts what lies in dense tiles; returns the codes of the others, sorted, with counts."""
        a, b = codes >> 32, codes & 0xFFFFFFFF
        tile = ((a // self.side) << 32) | (b // self.side)
        names, sizes = np.unique(tile, return_counts=True)
        for t in names[np.argsort(-sizes, kind="stable")]:
            size = sizes[np.searchsorted(names, t)]
            if t not in self.held and (size < self.dense or len(self.held) >= self.most):
                if size < self.dense:
                    break
                continue
            self.held.setdefault(int(t), np.zeros(self.side**2, np.int64))
        rest = np.ones(len(codes), bool)
        for t, cells in self.held.items():
            at = tile == t
            cells += np.bincount((a[at] % self.side) * self.side + b[at] % self.side, minlength=self.side**2)
            rest &= ~at
        return np.unique(codes[rest], return_counts=True)

    def counted(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for t, cells in self.held.items():
            at = np.flatnonzero(cells)
            yield (((t >> 32) * self.side + at // self.side) << 32) | ((t & 0xFFFFFFFF) * self.side + at % self.side), cells[at]


def pair_counts(sequences: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(code, n) of all neighbouring pairs in the blocks."""

    def rows(codes: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(codes), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(codes[at : at + (1 << 16)]), pa.array(n[at : at + (1 << 16)])], names=["code", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tiles, waiting, size = Tiles(), [], 0
        for batch in batches:
            for ids in _sequences(batch.column(0)):
                codes = codes_of(ids)
                waiting.append(codes[codes >= 0])
                size += len(waiting[-1])
                if size >= chunk:
                    yield from rows(*tiles.add(np.concatenate(waiting)))
                    waiting, size = [], 0
        if waiting:
            yield from rows(*tiles.add(np.concatenate(waiting)))
        for codes, n in tiles.counted():
            yield from rows(codes, n)

    return map_batches(sequences, run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


# --- phrases --------------------------------------------------------------------------------------------------------------
def frequent(docs: DataFrame, least: int, longest: int, lang_col: str = "lang", text_col: str = "text", head: int = HEAD) -> tuple[DataFrame, DataFrame]:
    """(lang, total) and (lang, words, a, first, last) of all phrases of 2 to `longest` words with a >= least occurrences; first and last have the occurrences of its first and last 1, 2, ... words."""
    texts = _texts(docs, lang_col, text_col)
    counts = materialize(word_counts(texts), "phrase_words")
    totals = materialize(counts.groupBy("lang").agg(F.sum("n").alias("total")), "phrase_totals")
    words = materialize(ranked(counts.where(F.col("n") >= least), ["lang", "word"]), "phrase_words")
    discard(counts)
    sequences = word_blocks(texts, words, head)
    known = words.select("id", "lang", F.array(F.col("word").cast("string")).alias("words"), F.array("n").alias("first"), F.array("n").alias("last"))
    levels = []
    for m in range(2, longest + 1):
        pairs = materialize(ranked(pair_counts(sequences).where(F.col("n") >= least), ["code"]), "phrase_pairs")
        left = known.select(F.col("id").alias("a"), "lang", F.col("words").alias("l"), "first")
        right = known.select(F.col("id").alias("b"), F.col("words").alias("r"), "last")
        both = pairs.select("id", "n", F.shiftright("code", 32).cast("int").alias("a"), F.col("code").bitwiseAND(0xFFFFFFFF).cast("int").alias("b"))
        both = both.join(left, "a").join(right, "b")
        known = materialize(both.select("id", "lang", F.concat("l", F.slice("r", -1, 1)).alias("words"), F.concat("first", F.array("n")).alias("first"), F.concat("last", F.array("n")).alias("last")), "phrases")
        levels.append(known.select("lang", "words", F.col("first")[m - 1].alias("a"), "first", "last"))
        if m < longest:
            following = pair_blocks(sequences, pairs, head)
            discard(sequences)
            sequences = following
    discard(sequences)
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return totals, out


def _phrase(words: Column | str) -> Column:
    return F.array_join(words, " ")


def mine_phrases(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, inside: int = INSIDE, lang_col: str = "lang", text_col: str = "text", head: int = HEAD) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first `top` phrases by falling score, then falling a, then phrase.

    Pieces are cut at .,;:!? and line breaks, words at spaces and tabs; A-Z is lower-cased. n counts the words of the language, a the
    phrase's occurrences inside pieces, overlapping ones too. Of the cuts into a first and a last part with l and r
    occurrences the one with the lowest floor(1000 * a * n / (l * r)) counts, of equal ones that after the fewest words. A phrase
    inside a longer one that has `inside` percent of its occurrences or more is left out. Null texts are empty, a null lang is und, and
    other columns are ignored; repeated rows count again; texts of any length are read whole; without frequent phrases there are no rows.
    """
    if longest < 2 or least < 1:
        raise ValueError("phrases have two words and one occurrence at least")
    totals, candidates = frequent(docs, least, longest, lang_col, text_col, head)
    # parts of longer candidates, with the occurrences of the most frequent one
    size = F.size("words")
    lengths = F.sequence(F.lit(2), size - 1)
    parts = F.flatten(F.transform(lengths, lambda k: F.transform(F.sequence(F.lit(1), size - k + 1), lambda i: _phrase(F.slice("words", i, k)))))
    within = candidates.where(size > 2).select("lang", "a", F.explode(parts).alias("phrase")).groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    whole = candidates.select("*", _phrase("words").alias("phrase")).join(within, ["lang", "phrase"], "left")
    whole = whole.where(F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * inside)).join(totals, "lang")
    exact = lambda c: c.cast("decimal(19,0)")
    product = (exact(F.col("a")) * 1000) * exact(F.col("total"))

    def cut(k: Column) -> Column:
        l, r = F.element_at("first", k), F.element_at("last", F.size("words") - k)  # noqa: E741
        return F.struct(F.call_function("div", product, exact(l) * exact(r)).alias("score"), k.alias("k"), l.alias("l"), r.alias("r"))

    scored = whole.withColumn("cut", F.array_min(F.transform(F.sequence(F.lit(1), size - 1), cut))).select("lang", "phrase", "a", "cut.l", "cut.r", F.col("total").alias("n"), "cut.score")
    order = (F.desc("score"), F.desc("a"), "phrase")
    # the first of each part of a language, then of the language
    some = scored.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS)))
    some = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    first = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return first.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine_phrases(table(spark, sf_dir, "documents"))


OP13_SQL = rf"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM d),
f AS MATERIALIZED (SELECT lang, m, phrase, count(*) AS a FROM (
  SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase FROM (SELECT lang, w, m, unnest(generate_series(1, len(w) - m + 1)) AS i FROM w, generate_series(1, {LONGEST}) AS g(m))) GROUP BY ALL),
n AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE m = 1 GROUP BY lang),
c AS MATERIALIZED (SELECT * FROM f WHERE m > 1 AND a >= {LEAST}),
kept AS (SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM c d WHERE d.lang = c.lang AND d.m > c.m AND 100 * d.a >= {INSIDE} * c.a AND contains(' ' || d.phrase || ' ', ' ' || c.phrase || ' '))),
cuts AS (SELECT kept.*, k, array_to_string(string_split(phrase, ' ')[1:k], ' ') AS x, array_to_string(string_split(phrase, ' ')[k + 1:], ' ') AS y FROM kept, generate_series(1, {LONGEST - 1}) AS g(k) WHERE k < m),
scored AS (SELECT cuts.lang, cuts.phrase, cuts.a, k, fx.a AS l, fy.a AS r, n, (1000::HUGEINT * cuts.a * n) // (fx.a::HUGEINT * fy.a) AS score FROM cuts JOIN n USING (lang) JOIN f fx ON fx.lang = cuts.lang AND fx.phrase = x JOIN f fy ON fy.lang = cuts.lang AND fy.phrase = y),
best AS (SELECT lang, phrase, any_value(a) AS a, min((score, k, l, r)) AS b, any_value(n) AS n FROM scored GROUP BY lang, phrase),
placed AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY b[1] DESC, a DESC, phrase) AS rank, phrase, a, b[3] AS l, b[4] AS r, n, b[1]::BIGINT AS score FROM best)
SELECT * FROM placed WHERE rank <= {TOP}
"""

"""Token counts of a sentencepiece BPE model, without token ids of documents.

No piece of the vocabulary has its space mark after another character, so a text falls apart before each run of spaces
into pre-tokens that the model encodes independently. The pieces of each distinct pre-token are counted once, in a table,
which is joined to the documents' pre-token frequencies, and the products are summed for each document.

Few pre-tokens make up most of a text. Those that are frequent in a bounded sample are a bounded part of the table, which
is broadcast: their join happens in the scan. The other pre-tokens leave the scan with their frequencies and meet their
part of the table by a shuffle. Which way a pre-token takes makes no difference to the counts.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_sample, discard, map_batches, materialize, table

MODEL = "piece_bpe_32k.model"
TOKEN_LIMIT = 4096
#: Pre-tokens of the broadcast part of the table: so many at most, of so many characters at most, about 130 bytes each in a worker.
FREQUENT, FREQUENT_CHARS = 300_000, 40
#: Longer ones (lines of scripts without spaces, URLs, base64) join them if the sample has them so often, up to so many bytes in all.
LONG_LEAST, LONG_BYTES = 16, 16 << 20
#: Documents, about, in whose texts frequent pre-tokens are looked for.
SAMPLE = 20_000
#: Pre-tokens that a task counts before it hands them on.
MAX_WORDS = 400_000
MARK = "▁"


def model_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def load_pieces(path: str):
    """The model, after a check of what the splitting rests on."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = (model.id_to_piece(i) for i in range(model.get_piece_size()))
    if any(MARK in p.lstrip(MARK) for p in pieces):
        raise ValueError(f"{path}: pieces cross pre-tokens, so counts of pre-tokens don't add up")
    return model


_models: dict = {}


def worker_model(path: str):
    """The worker's model, which serves the next tasks too."""
    if path not in _models:
        _models[path] = load_pieces(path)
    return _models[path]


def pretokens(text: str) -> list[str]:
    """Pre-tokens without the one space before each, which the model puts there itself."""
    if not text:
        return []
    words = text.split(" ")
    if "" not in words and MARK not in text:
        return words
    return [w[1:] for w in re.findall(" +[^ ]*", " " + text.replace(MARK, " "))]


def frequencies(texts: DataFrame) -> DataFrame:
    """(w, n): how often each pre-token occurs in the texts, counted in each task and then over all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bag: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                bag.update(pretokens(text))
                if len(bag) > MAX_WORDS:
                    yield pa.RecordBatch.from_arrays([pa.array(list(bag), pa.string()), pa.array(list(bag.values()), pa.int64())], names=["w", "n"])
                    bag = Counter()
        yield pa.RecordBatch.from_arrays([pa.array(list(bag), pa.string()), pa.array(list(bag.values()), pa.int64())], names=["w", "n"])

    return map_batches(texts, run, "w string, n long").groupBy("w").agg(F.sum("n").alias("n"))


def piece_counts(words: DataFrame, path: str) -> DataFrame:
    """(w, pieces) of distinct pre-tokens (w); a space alone is one piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = worker_model(path)
        for batch in batches:
            got = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) if w else 1 for w, x in zip(got, model.encode(got, num_threads=1), strict=True)], pa.int32())], names=["w", "pieces"])

    return map_batches(words.select("w"), run, "w string, pieces int")


def frequent_pieces(texts: DataFrame, path: str, most: int = FREQUENT, chars: int = FREQUENT_CHARS, long_bytes: int = LONG_BYTES) -> dict[str, int]:
    """Pieces of the most frequent pre-tokens: those above the lowest power of two that leaves `most` at most. Longer ones than `chars` have a bound of bytes of their own."""
    wanted = (F.length("w") <= chars) | (F.col("n") >= LONG_LEAST)
    found = materialize(frequencies(texts).where(wanted), "token_frequencies")
    is_long, size = F.length("w") > chars, F.floor(F.log2("n"))
    by_size = found.groupBy(is_long.alias("long"), size.alias("e")).agg(F.count("*").alias("number"), F.sum(F.octet_length("w")).alias("bytes")).collect()  # 126 rows at most
    out: dict[str, int] = {}
    for is_it, most_bytes in ((False, float("inf")), (True, long_bytes)):
        least, number, held = 63, 0, 0
        for r in sorted((r for r in by_size if r.long == is_it), key=lambda r: -r.e):
            number, held = number + r.number, held + r.bytes
            if number > most or held > most_bytes:
                break
            least = r.e
        if least < 63:
            got = piece_counts(found.where((is_long == F.lit(is_it)) & (F.col("n") >= 1 << least)), path).toArrow()
            out.update(zip(got.column("w").to_pylist(), got.column("pieces").to_pylist(), strict=True))
    discard(found)
    return out


def bags(rows: DataFrame, known) -> DataFrame:
    """(row, doc_id, n_bytes, tokens, words, counts) of (row, doc_id, text): tokens of the pre-tokens in `known`, and the frequencies of the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = known.value.get
        for batch in batches:
            texts = batch.column(2).to_pylist()
            for at in range(0, len(texts), 64):
                n_bytes, tokens, words, counts, ends = [], [], [], [], [0]
                for text in texts[at : at + 64]:
                    bag = Counter(pretokens(text))
                    found = list(map(pieces, bag))
                    total = 0
                    for w, n, k in zip(bag, bag.values(), found, strict=True):
                        if k is None:
                            words.append(w)
                            counts.append(n)
                        else:
                            total += n * k
                    n_bytes.append(len(text.encode()))
                    tokens.append(total)
                    ends.append(len(words))
                ends = pa.array(ends, pa.int32())
                lists = [pa.ListArray.from_arrays(ends, pa.array(words, pa.string())), pa.ListArray.from_arrays(ends, pa.array(counts, pa.int64()))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, 64), batch.column(1).slice(at, 64), pa.array(n_bytes, pa.int64()), pa.array(tokens, pa.int64()), *lists], names=["row", "doc_id", "n_bytes", "tokens", "words", "counts"])

    return map_batches(rows, run, "row long, doc_id long, n_bytes long, tokens long, words array<string>, counts array<long>")


def count_tokens(docs: DataFrame, path: str, limit: int = TOKEN_LIMIT, id_col: str = "doc_id", text_col: str = "text", frequent: int = FREQUENT, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row, of whole texts. Null and empty texts have 0 bytes and tokens.

    Repeated rows are counted each; a null id stays null; a text without spaces is one pre-token, however long; other
    columns are ignored; an empty table gives an empty one.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    some = bounded_sample(rows.withColumn("key", F.coalesce("doc_id", "row")), "key", sample, docs.count()).select("text")
    known = docs.sparkSession.sparkContext.broadcast(frequent_pieces(some, path, frequent))  # `frequent` pre-tokens at most
    held = materialize(bags(rows, known), "token_bags")
    rest = held.select("row", F.explode(F.arrays_zip("words", "counts")).alias("e")).select("row", F.col("e.words").alias("w"), F.col("e.counts").alias("n"))
    pieces = materialize(piece_counts(rest.select("w").distinct(), path), "token_pieces")
    # no pre-token of the rest is in a large share of the rows, however long, unless the sample misses it or LONG_BYTES is full; skewed joins are split at run time
    more = rest.join(pieces, "w").groupBy("row").agg(F.sum(F.col("n") * F.col("pieces")).alias("more"))
    n_tokens = F.col("tokens") + F.coalesce("more", F.lit(0))
    return held.select("row", "doc_id", "n_bytes", "tokens").join(more, "row", "left").select("doc_id", "n_bytes", n_tokens.alias("n_tokens"), (n_tokens > limit).alias("over_limit"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), model_path(MODEL))

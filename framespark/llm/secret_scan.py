"""Secret scan: fixed patterns, and character Markov models of random strings and ordinary identifiers.

Both models are first-order over the characters of a candidate. They are fitted from counts over a bounded sample of
documents: strings that the patterns mark and that hold a digit are the samples of random strings (values without one are
ordinary words too often), other words of the same alphabet the samples of identifiers. Candidates are runs of the alphabet
and the parts of runs between separators. One whose log-likelihood ratio per character is high enough for its length becomes
one more span.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_sample, map_batches, table

KINDS = ("assign", "access", "hex", "markov")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
#: Maximal runs that are long enough: what is left of `AKIA[A-Z0-9]+` and `[0-9a-f]+` once short matches are dropped.
ACCESS, HEX = re.compile(r"AKIA[A-Z0-9]{12,}"), re.compile(r"[0-9a-f]{32,}")
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Candidates of the models: runs of the alphabet that are as long as the first, and parts between separators as long as the second.
RUN, PART = 16, 8
WORD = re.compile(r"[A-Za-z0-9+/_=-]{8,}")
#: Log-likelihood ratio per character from which a candidate of RUN characters is a secret, and what each character fewer adds.
THRESHOLD, SHORTER = 1.5, 0.2
#: Documents from which the models are fitted: about so many, all if there are no more.
TRAIN_DOCS = 20_000
START = len(ALPHABET)
CODES = np.full(128, -1, np.int64)
CODES[[ord(c) for c in ALPHABET]] = np.arange(len(ALPHABET))
SEPARATORS = np.array([c in "+/_=-" for c in ALPHABET])


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, by start, then kind."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8] if ":" in text or "=" in text else []
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def samples(text: str) -> tuple[list[str], list[str]]:
    """(random strings, identifiers): the values that the patterns mark and that hold a digit, and all other words of 8 characters or more."""
    values = [m[2] for m in ASSIGN.finditer(text) if len(m[2]) >= 8] if ":" in text or "=" in text else []
    values += ACCESS.findall(text) + HEX.findall(text)
    spans = base_spans(text)
    words = [(m.start(), m.end(), m[0]) for m in WORD.finditer(text)]
    apart = ~overlapping(np.array([w[0] for w in words], np.int64), np.array([w[1] for w in words], np.int64), spans)
    others = [w[2] for w, free in zip(words, apart, strict=True) if free]
    return [v for v in values if any(c.isdigit() for c in v)], others


def pairs(word: str) -> np.ndarray:
    codes = CODES[np.frombuffer(word.encode("ascii", "replace"), np.uint8) & 127]
    codes = np.append(START, codes[codes >= 0])
    return codes[:-1] * (START + 1) + codes[1:]


def pair_counts(docs: DataFrame) -> DataFrame:
    """(label, pair, n): character pairs in the samples, counted in each task and then over all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, (START + 1) ** 2), np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                for label, words in zip((1, 0), samples(text), strict=True):
                    if words:
                        codes = CODES[np.frombuffer(" ".join(["", *words]).encode("ascii", "replace"), np.uint8) & 127]
                        codes[codes < 0] = START
                        counts[label] += np.bincount(codes[:-1] * (START + 1) + codes[1:], minlength=counts.shape[1])
        label, pair = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(label.astype(np.int32)), pa.array(pair.astype(np.int32)), pa.array(counts[label, pair])], names=["label", "pair", "n"])

    return map_batches(docs, run, "label int, pair int, n long").groupBy("label", "pair").agg(F.sum("n").alias("n"))


def fit(counts: list[tuple[int, int, int]], smoothing: float = 0.5, backing: float = 20.0) -> np.ndarray:
    """Log-likelihood ratio (random against ordinary) of each character pair, from at most 2 * 69**2 counts.

    A pair's probability is backed by that of its second character, which is smoothed towards the uniform one, so a model
    without samples is uniform.
    """
    n = np.zeros((2, START + 1, START))
    for label, pair, count in counts:
        if pair % (START + 1) < START:
            n[label, pair // (START + 1), pair % (START + 1)] += count
    single = n.sum(axis=1, keepdims=True) + smoothing
    single /= single.sum(axis=2, keepdims=True)
    logs = np.log((n + backing * single) / (n.sum(axis=2, keepdims=True) + backing))
    ratio = np.zeros((START + 1, START + 1))
    ratio[:, :START] = logs[1] - logs[0]
    return ratio.ravel()


def overlapping(start: np.ndarray, end: np.ndarray, spans: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of the stretches meet one of the spans, which come in order of start."""
    if not spans:
        return np.zeros(len(start), bool)
    begins = np.array([s[0] for s in spans])
    furthest = np.maximum.accumulate([s[2] for s in spans])
    at = np.searchsorted(begins, end) - 1
    return (at >= 0) & (furthest[np.maximum(at, 0)] > start)


def _stretches(inside: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    step = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
    start, end = step[::2], step[1::2]
    long = end - start >= least
    return start[long], end[long]


def markov_spans(text: str, ratio: np.ndarray, threshold: float, taken: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans of candidates that the models call random, in order: a whole run, or else those of its parts that are."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    codes = np.where(points < 128, CODES[np.minimum(points, 127)], -1)
    out, used = [], taken
    runs = codes >= 0
    for inside, least in ((runs, RUN), (runs & ~SEPARATORS[codes], PART)):
        start, end = _stretches(inside, least)
        if not len(start):
            continue
        before = np.where(np.append(False, inside[:-1]), np.append(START, codes[:-1]), START)
        upto = np.append(0.0, np.cumsum(np.where(inside, ratio[before * (START + 1) + np.maximum(codes, 0)], 0.0)))
        length = end - start
        random = (upto[end] - upto[start]) / length >= threshold + SHORTER * np.maximum(RUN - length, 0)
        random &= ~overlapping(start, end, used)
        out += [(int(a), 3, int(b)) for a, b in zip(start[random], end[random], strict=True)]
        used = sorted([*taken, *out])
    return sorted(out)


def scan_secrets(docs: DataFrame, ratio: np.ndarray, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, n_markov, base_sha256, spans) of every row, of whole texts.

    Spans are kind:start:end in code points, end exclusive, by start, then kind. The models only add spans, where no
    pattern's span is. Null texts count as empty: no spans, and the digest of the empty string. Repeated rows are scanned
    each; texts of any length are scanned whole, in time in proportion to it; other columns are ignored; an empty table gives
    an empty one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        write = lambda spans: ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)
        for batch in batches:
            counts, digests, spans = [], [], []
            for text in batch.column(1).to_pylist():
                base = base_spans(text)
                more = markov_spans(text, ratio, threshold, base)
                counts.append([sum(s[1] == k for s in (*base, *more)) for k in range(4)])
                digests.append(hashlib.sha256(write(base).encode()).hexdigest())
                spans.append(write(sorted(base + more)))
            n = np.array(counts, np.int64).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(n[:, k]) for k in range(4)], pa.array(digests, pa.string()), pa.array(spans, pa.string())], names=["doc_id", "n_assign", "n_access", "n_hex", "n_markov", "base_sha256", "spans"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return map_batches(rows, run, "doc_id long, n_assign long, n_access long, n_hex long, n_markov long, base_sha256 string, spans string")


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bound: int = TRAIN_DOCS) -> np.ndarray:
    sample = bounded_sample(docs.select(F.col(id_col), F.col(text_col)), id_col, bound, docs.count())
    return fit([tuple(r) for r in pair_counts(sample.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"))).collect()])


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scan_secrets(docs, train(docs))

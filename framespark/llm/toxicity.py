"""Toxicity: a factorization machine over hashed terms.

score = sigmoid(bias + sum_i w_i + sum_{i<j} <v_i, v_j>) over the selected terms i that a document has. The pairwise part
learns interactions, such as an insult with a group's name, that additive weights miss. Terms are words and their beginnings
(so that inflected forms share weight), hashed. The fit uses a bounded sample of labelled rows:
the terms that tell the labels apart best by chi-square are kept, and the machine is fitted to them by gradient descent.
Scoring reads each text once, in the scan's tasks, without a shuffle.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_sample, map_batches, table

BUCKETS = 1 << 20
#: Labelled rows from which the machine is fitted: about so many, all if there are no more.
TRAIN_ROWS = 16_000
TERMS = 1024
FACTORS = 4
THRESHOLD = 0.3
WORD = re.compile(r"[^\W\d_]+")


class Hasher:
    """Distinct hashed terms of a text or, given `terms`, the positions in them of those it has. Words are remembered, up to a bound."""

    def __init__(self, terms: np.ndarray | None = None, most: int = 150_000):
        self.known: dict[str, tuple[int, ...]] = {}
        self.place = None if terms is None else {int(t): i for i, t in enumerate(terms)}
        self.most = most

    def learn(self, word: str) -> tuple[int, ...]:
        found = [zlib.crc32(word.encode()) % BUCKETS, *[zlib.crc32(word[:n].encode(), n) % BUCKETS for n in (3, 4, 5, 6) if len(word) >= n]]
        return tuple(found if self.place is None else [self.place[t] for t in found if t in self.place])

    def __call__(self, text: str) -> np.ndarray:
        if len(self.known) > self.most:
            self.known.clear()
        words = set(WORD.findall(text.lower()))
        known = self.known
        for word in words:
            if word not in known:
                known[word] = self.learn(word)
        out = set().union(*map(known.__getitem__, words))
        return np.fromiter(out, np.int64, len(out))


def term_sets(rows: DataFrame) -> DataFrame:
    """(doc_id, label, terms) of rows (text, label, doc_id)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = Hasher()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(2), batch.column(1), pa.array([np.sort(hashed(t)).astype("<u4").tobytes() for t in batch.column(0).to_pylist()], pa.binary())], names=["doc_id", "label", "terms"])

    return map_batches(rows, run, "doc_id long, label int, terms binary")


def select_terms(sets: list[np.ndarray], labels: np.ndarray, most: int = TERMS, least_rows: int = 5, least_chi2: float = 12.0) -> np.ndarray:
    """Sorted buckets with the highest chi-square statistic against the label."""
    n, positive = len(labels), max(1, labels.sum())
    hits, toxic = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for terms, label in zip(sets, labels, strict=True):  # each term is in a set once
        hits[terms] += 1
        if label:
            toxic[terms] += 1
    expected = hits * positive / max(n, 1)
    chi2 = np.divide((toxic - expected) ** 2, expected * (1 - positive / max(n, 1)) + 1e-9, out=np.zeros(BUCKETS), where=hits >= least_rows)
    best = np.lexsort((np.arange(BUCKETS), -chi2))[:most]
    return np.sort(best[chi2[best] >= least_chi2])


def fit(sets: list[np.ndarray], labels: np.ndarray, factors: int = FACTORS, epochs: int = 30, rate: float = 0.05, decay: float = 1e-4, seed: int = 5) -> dict:
    """Fits the machine to term sets by AdaGrad over mini-batches. Without rows of both labels the score is the labels' smoothed mean."""
    terms = select_terms(sets, labels)
    rng = np.random.default_rng(seed)
    w, v = np.zeros(len(terms)), rng.normal(0, 0.02, (len(terms), factors))
    mean = (labels.sum() + 0.5) / (len(labels) + 1)
    bias = float(np.log(mean / (1 - mean)))
    if len(terms) and 0 < labels.sum() < len(labels):
        at = [index_terms(s.astype(np.int64), terms) for s in sets]
        gw, gv, gb = np.full(w.shape, 1e-6), np.full(v.shape, 1e-6), 1e-6
        # rows without a selected term only move the bias: they enter as one weighted row
        has = np.array([len(a) > 0 for a in at])
        rows = np.flatnonzero(has)
        none, none_toxic = int((~has).sum()), int(labels[~has].sum())
        for _ in range(epochs):
            order = rng.permutation(rows)
            for i in range(0, len(order), 256):
                some = order[i : i + 256]
                cols, sizes = np.concatenate([at[r] for r in some]), np.array([len(at[r]) for r in some])
                starts = np.cumsum(sizes) - sizes
                vs = np.add.reduceat(v[cols], starts)
                z = bias + np.add.reduceat(w[cols], starts) + 0.5 * (vs**2 - np.add.reduceat(v[cols] ** 2, starts)).sum(axis=1)
                error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[some]) / len(some)
                per = np.repeat(error, sizes)
                dw, dv = np.bincount(cols, per, len(w)), np.zeros(v.shape)
                np.add.at(dv, cols, per[:, None] * (np.repeat(vs, sizes, axis=0) - v[cols]))
                dw, dv = dw + decay * w, dv + decay * v
                gw, gv = gw + dw**2, gv + dv**2
                w, v = w - rate * dw / np.sqrt(gw), v - rate * dv / np.sqrt(gv)
                share = len(some) / len(rows)
                db = error.sum() + (none / (1 + np.exp(-bias)) - none_toxic) * share / len(some)
                gb += db**2
                bias -= rate * db / np.sqrt(gb)
    return {"terms": terms, "w": w, "v": v, "bias": bias}


def index_terms(buckets: np.ndarray, terms: np.ndarray) -> np.ndarray:
    """Positions in `terms` of those buckets that are selected."""
    if not len(terms):
        return np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(terms, buckets), len(terms) - 1)
    return np.sort(at[terms[at] == buckets])


def score_one(at: np.ndarray, model: dict) -> float:
    at = np.sort(at)
    v = model["v"][at]
    z = model["bias"] + model["w"][at].sum() + 0.5 * (v.sum(axis=0) ** 2 - (v**2).sum(axis=0)).sum()
    return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def train(docs: DataFrame, labels: DataFrame, bound: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", fold=None) -> dict:
    """Fits to about `bound` labelled rows, of which `fold` (a condition on doc_id) leaves out the held-out ones. Null labels and ids don't count; of repeated labels of a row the largest holds, and of rows that share an id one counts. An empty table or no labels give a model of the bias alone."""
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).where("doc_id is not null and label is not null")
    known = known.where(fold) if fold is not None else known
    sample = bounded_sample(known, "doc_id", bound, known.count()).groupBy("doc_id").agg(F.max("label").alias("label"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # the sample is bounded, so it is broadcast, the texts are not shuffled, and the term sets fit one task
    sets = term_sets(rows.join(F.broadcast(sample), "doc_id").select("text", "label", "doc_id"))
    # rows that share an id count once
    sets = sets.groupBy("doc_id").agg(F.min(F.struct("label", "terms")).alias("row")).select("row.label", "row.terms")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = sorted((t, y) for b in batches for y, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))  # the order of tasks must not matter
        model = fit([np.frombuffer(t, "<u4") for t, _ in got], np.array([y for _, y in got], float))
        columns = [pa.array([model["terms"].astype("<i8").tobytes()]), pa.array([model["w"].tobytes()]), pa.array([model["v"].tobytes()]), pa.array([model["bias"]])]
        yield pa.RecordBatch.from_arrays(columns, names=["terms", "w", "v", "bias"])

    row = map_batches(sets.repartition(1), run, "terms binary, w binary, v binary, bias double").first()
    return {"terms": np.frombuffer(row.terms, "<i8"), "w": np.frombuffer(row.w), "v": np.frombuffer(row.v).reshape(-1, FACTORS), "bias": row.bias}


def score_toxicity(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, keep: bool = False) -> DataFrame:
    """(doc_id, score, predicted) of every row, or with keep=True all columns of the rows that are not predicted toxic.

    The score lies in 0..1 and depends on the text alone, which is read whole. Null and empty texts get the score of the
    bias. Repeated rows are scored each; an empty table gives an empty one. With keep=True columns of any name, score and predicted too, pass through untouched.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = Hasher(model["terms"])
        for batch in batches:
            scores = [score_one(hashed(t or ""), model) for t in batch.column(text_col if keep else "text").to_pylist()]
            if keep:
                yield batch.filter(pa.array([s < threshold for s in scores], pa.bool_()))
            else:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32())], names=["doc_id", "score", "predicted"])

    if keep:
        return map_batches(docs, run, docs.schema)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return map_batches(rows, run, "doc_id long, score double, predicted int")


def held_out():
    """The rows that no fit may see: crc32 of doc_id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.encode(F.col("doc_id").cast("string"), "utf-8")) % 4 == 2, F.lit(False))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"), fold=~held_out())
    return score_toxicity(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")

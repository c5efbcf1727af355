"""Toxicity scores by a factorization machine over hashed terms.

Method: the terms of a text are its distinct words and their beginnings of 4, 5
and 6 bytes, hashed to 32 bits. With x the indicator of the terms present, the
score is the logistic function of

    bias + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j

so that pairs of terms, such as an insult and the mention of a group, count for
more than their sum. Texts are scored whole and without a shuffle; the model is a
broadcast of at most ``TERMS`` terms.

Fit: a bounded sample of labelled rows, at most ``sample`` of each label, those with
the smallest hash of their id. Of the terms found in it, counted by Spark, the
``TERMS`` with the largest chi-square against the label, and at least ``LEAST``, are
kept. The sample's kept terms (bounded by sample times TERMS) go to the driver,
where Adam minimises the logistic loss. Each label's share of the sample is not its
share of all labelled documents, so these are counted, and the bias is moved by the
difference of the two log odds: the threshold means the same for any sample.

Defined results: null and empty texts have no terms and score as the bias says.
Rows are scored one by one, so repeated rows and null ids give rows of their own.
Labels with a null id or label, or without a document, are not used; of several
labels of an id the largest counts. Without any label the score is 0; with one
label alone it is near that label. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.llm import wordhash as wh
from tallyfold.llm.shared import Scratch

#: Labelled rows of each label that the fit may use.
SAMPLE = 4000
TERMS = 4096
LEAST = 15.0
FACTORS = 8
PREFIXES = (4, 5, 6)


def _terms(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, hashed terms, row of each); terms may repeat."""
    for lo, hi, data, offs in wh.slices(column):
        start, end, row = wh.words(data, offs, wh.NOT_ALNUM)
        hashes = [(h >> np.uint64(32)).astype(np.uint32) for h in wh.word_hashes(data, start, end, PREFIXES)]
        yield lo, hi, np.concatenate(hashes), np.concatenate([row] * len(hashes))


@dataclass
class Machine:
    """A fitted model: sorted term hashes with a weight and factors each."""

    terms: np.ndarray
    bias: float
    weight: np.ndarray
    factor: np.ndarray

    def __post_init__(self):
        self.maybe = np.zeros(1 << 20, dtype=bool)
        self.maybe[self.terms & np.uint32(0xFFFFF)] = True

    def present(self, column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first row, row after the last, row, index of a kept term), each pair once."""
        for lo, hi, term, row in _terms(column):
            some = np.flatnonzero(self.maybe[term & np.uint32(0xFFFFF)])
            term, row = term[some], row[some]
            at = np.minimum(np.searchsorted(self.terms, term), max(0, len(self.terms) - 1))
            hit = self.terms[at] == term if len(self.terms) else np.zeros(0, dtype=bool)
            pair = np.unique(row[hit] * len(self.terms) + at[hit])
            yield lo, hi, *(np.divmod(pair, len(self.terms)) if len(pair) else (pair, pair))

    def scores(self, column: pa.Array) -> np.ndarray:
        out = np.empty(len(column))
        for lo, hi, row, at in self.present(column):
            n = hi - lo
            z = self.bias + np.bincount(row, self.weight[at], n)
            for f in self.factor.T:
                z += 0.5 * (np.bincount(row, f[at], n) ** 2 - np.bincount(row, f[at] ** 2, n))
            out[lo:hi] = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        return out


def train(x: np.ndarray, y: np.ndarray, *, epochs: int = 15, batch: int = 256, rate: float = 0.02, decay: float = 1e-4) -> tuple[float, np.ndarray, np.ndarray]:
    """(bias, weights, factors) for the 0/1 rows ``x`` and labels ``y``."""
    rng = np.random.default_rng(1)
    n = x.shape[1]
    p = [np.zeros(1, np.float32), np.zeros(n, np.float32), rng.normal(0, 0.02, (n, FACTORS)).astype(np.float32)]
    mean, square = [np.zeros_like(q) for q in p], [np.zeros_like(q) for q in p]
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for i in range(0, len(y), batch):
            rows = order[i : i + batch]
            b = x[rows].astype(np.float32)
            s = b @ p[2]
            z = p[0] + b @ p[1] + 0.5 * ((s * s).sum(1) - b @ (p[2] ** 2).sum(1))
            g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[rows]) / len(rows)
            by = b.T @ g
            grads = [g.sum(keepdims=True), by + decay * p[1], b.T @ (g[:, None] * s) - p[2] * by[:, None] + decay * p[2]]
            step += 1
            for q, m, v, d in zip(p, mean, square, grads):
                m += 0.1 * (d - m)
                v += 0.01 * (d * d - v)
                q -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return float(p[0][0]), p[1].astype(float), p[2].astype(float)


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        label = batch.column(1).to_numpy(zero_copy_only=False)
        for lo, _, term, row in _terms(batch.column(2)):
            pair = np.unique((row.astype(np.uint64) << np.uint64(32)) | term)
            y = label[lo + (pair >> np.uint64(32)).astype(np.int64)]
            t, at = np.unique(pair & np.uint64(0xFFFFFFFF), return_inverse=True)
            ones = np.bincount(at, y, len(t)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(t.astype(np.int64)), pa.array(np.bincount(at, minlength=len(t)).astype(np.int64)), pa.array(ones)], names=["term", "n", "ones"])


def _kept_terms(model: Machine) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, row, at in model.present(batch.column(2)):
                lists = np.split(at, np.searchsorted(row, np.arange(1, hi - lo)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array([x.tolist() for x in lists], pa.list_(pa.int32()))], names=["doc_id", "label", "at"])

    return run


def _none(bias: float) -> Machine:
    return Machine(np.zeros(0, np.uint32), bias, np.zeros(0), np.zeros((0, FACTORS)))


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE, terms: int = TERMS, least: float = LEAST) -> Machine:
    """A machine for ``labels`` (id, 0/1) of ``docs``; pass only the labels it may learn from. ``sample`` rows of each label and ``terms`` terms of a chi-square of ``least`` at least are used at most."""
    scratch = Scratch(docs.sparkSession, "toxicity")
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).dropna().groupBy("doc_id").agg(F.max("label").alias("label"))
    parts = [known.where(F.col("label") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for y in (0, 1)]
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    chosen = scratch.write(parts[0].union(parts[1]), "chosen")
    rows = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    rows = scratch.write(rows, "sample")
    sizes = {r.label: r["count"] for r in rows.groupBy("label").count().collect()}
    n, ones = sum(sizes.values()), sizes.get(1, 0)
    if ones in (0, n):
        return _none(-30.0 if not n else 4.0 if ones else -4.0)
    counts = rows.mapInArrow(_count_terms, "term long, n long, ones long").groupBy("term").agg(F.sum("n").alias("n"), F.sum("ones").alias("ones")).where("n >= 4")
    cross = F.col("ones") * (n - ones) - (F.col("n") - F.col("ones")) * ones
    chi = cross.cast("double") * cross * n / (F.lit(float(ones)) * (n - ones) * F.col("n") * (n - F.col("n") + 1e-9))
    kept = counts.withColumn("chi", chi).where(F.col("chi") >= least).orderBy(F.desc("chi"), "term").limit(terms)
    model = _none(0.0)
    model.terms = np.sort(np.array([r.term for r in kept.select("term").collect()], dtype=np.uint32))
    model = Machine(model.terms, 0.0, np.zeros(len(model.terms)), np.zeros((len(model.terms), FACTORS)))
    found = sorted(rows.mapInArrow(_kept_terms(model), "doc_id long, label int, at array<int>").collect())
    x, y = np.zeros((len(found), len(model.terms)), dtype=np.uint8), np.array([r.label for r in found], dtype=np.float32)
    for i, r in enumerate(found):
        x[i, r.at] = 1
    model.bias, model.weight, model.factor = train(x, y)
    if chosen.groupBy("label").count().where(F.col("count") >= sample).count():
        every = {r.label: r["count"] for r in known.join(texts.select("doc_id").distinct(), "doc_id", "left_semi").groupBy("label").count().collect()}
        model.bias += float(np.log(every[1] / every[0]) - np.log(ones / (n - ones)))
    scratch.drop("sample", "chosen")
    return model


def score(docs: DataFrame, model: Machine, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, score, predicted (1 from 0.5)."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = held.value.scores(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(run, "doc_id long, score double, predicted int")


def reject(docs: DataFrame, model: Machine, *, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that score below 0.5, all columns as they are."""
    held, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(held.value.scores(batch.column(at)) < 0.5))

    return docs.mapInArrow(run, docs.schema)


def learnable(labels: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """The labels outside the held-out fifth, whose crc32 of the id as text is divisible by five."""
    return labels.where(F.crc32(F.col(id_col).cast("string")) % 5 != 0)

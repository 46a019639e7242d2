"""Quality grades by ordinal cumulative-link regression (operator 3).

P(grade <= k) = logistic(threshold_k - w.x): one weight vector over hashed text features is shared by all grades and
the thresholds are ordered by construction. x holds square roots of relative counts of hashed words and of hashed
word shapes (case, digits, trailing marks, length, repetition of the word before), so texts of any length compare.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words as W
from .common import Scratch

#: Hash buckets, labelled documents that the model is fitted on at most (those with the smallest hash of their id).
BUCKETS, SAMPLE = 1 << 18, 12_000
_SHAPE_SALT = np.uint64(0xA0761D6478BD642F)


def _shapes(w: W.Words) -> np.ndarray:
    """A number for the look of each word."""
    data, s, e = w.data, w.start, w.end
    kind = np.zeros(256, np.int64)
    kind[[*range(0x61, 0x7B)]] = 1
    kind[[*range(0x41, 0x5B)]] = 2
    kind[[*range(0x30, 0x3A)]] = 3
    kind[[*range(0x80, 0x100)]] = 4
    first, second, last = data[s], data[np.minimum(s + 1, e - 1)], data[e - 1]
    mark = np.where(kind[last] == 0, last, 0).astype(np.int64)
    before = data[np.maximum(e - 2, s)]
    twice = (before == last) & (e - s > 1)
    size = np.minimum(e - s, 24) // 4
    again = np.zeros(len(s), bool)
    if len(s) > 1:
        again[1:] = (w.hash[1:] == w.hash[:-1]) & (w.text[1:] == w.text[:-1])
    return ((((kind[first] * 5 + kind[second]) * 256 + mark) * 2 + twice) * 8 + size) * 2 + again


def vectors(w: W.Words) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bucket, value) of each text."""
    n = np.diff(w.bounds)
    mask = np.uint64(BUCKETS - 1)
    both = np.concatenate([W.mix(w.hash) & mask, W.mix(_shapes(w).astype(np.uint64) ^ _SHAPE_SALT) & mask]).astype(np.int64)
    key, count = np.unique(np.concatenate([w.text, w.text]) * BUCKETS + both, return_counts=True)
    text = key // BUCKETS
    cuts = np.searchsorted(text, np.arange(len(n) + 1))
    for i, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        yield key[lo:hi] - i * BUCKETS, np.sqrt(count[lo:hi] / max(1, n[i]))


@dataclass
class Model:
    grades: np.ndarray
    weight: np.ndarray
    threshold: np.ndarray

    def below(self, z: np.ndarray) -> np.ndarray:
        """P(grade <= k) for all but the last grade."""
        return 1 / (1 + np.exp(-(self.threshold[None, :] - z[:, None])))

    def logits(self, w: W.Words) -> np.ndarray:
        return np.array([self.weight[b] @ v for b, v in vectors(w)])

    def read(self, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Expected grade, and the probability of the highest grade."""
        p = np.diff(np.concatenate([np.zeros((len(z), 1)), self.below(z), np.ones((len(z), 1))], axis=1))
        return p @ self.grades, p[:, -1]


def fit(vec: list[tuple[np.ndarray, np.ndarray]], grade: np.ndarray, l2: float = 1e-4, rounds: int = 300) -> Model:
    grades = np.unique(grade).astype(float)
    k = np.searchsorted(grades, grade)
    share = np.cumsum(np.bincount(k, minlength=len(grades)))[:-1] / len(k)
    first = np.log(share / (1 - share))
    cols, c = np.unique(np.concatenate([b for b, _ in vec]), return_inverse=True)
    r, x = np.repeat(np.arange(len(vec)), [len(b) for b, _ in vec]), np.concatenate([v for _, v in vec])
    w = np.zeros(len(cols))
    theta = np.concatenate([first[:1], np.log(np.maximum(np.diff(first), 1e-3))])  # first threshold, logs of the steps
    mw, sw, mt, st = (np.zeros_like(a) for a in (w, w, theta, theta))
    rows = np.arange(len(vec))
    for t in range(1, rounds + 1):
        cut = np.cumsum(np.concatenate([theta[:1], np.exp(theta[1:])]))
        z = np.bincount(r, x * w[c], len(vec))
        p = np.concatenate([np.zeros((len(z), 1)), 1 / (1 + np.exp(-(cut[None, :] - z[:, None]))), np.ones((len(z), 1))], axis=1)
        d = p * (1 - p)
        q = np.maximum(p[rows, k + 1] - p[rows, k], 1e-9)
        gz = (d[rows, k + 1] - d[rows, k]) / q / len(vec)  # derivative of the mean loss by z
        gc = np.zeros(len(cut) + 2)
        np.add.at(gc, k + 1, -d[rows, k + 1] / q / len(vec))
        np.add.at(gc, k, d[rows, k] / q / len(vec))
        gc = gc[1:-1]
        tail = np.cumsum(gc[::-1])[::-1]
        gt = np.concatenate([tail[:1], tail[1:] * np.exp(theta[1:])])
        gw = np.bincount(c, x * gz[r], len(cols)) + l2 * w
        step = 0.05 * min(1.0, 2 * (1 - t / rounds))
        for v, g, m, s in ((w, gw, mw, sw), (theta, gt, mt, st)):
            m += 0.1 * (g - m)
            s += 0.01 * (g * g - s)
            v -= step * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.99**t)) + 1e-8)
    weight = np.zeros(BUCKETS)
    weight[cols] = w
    return Model(grades, weight, np.cumsum(np.concatenate([theta[:1], np.exp(theta[1:])])))


def train(docs: DataFrame, ratings: DataFrame, id_col: str = "doc_id", text_col: str = "text", grade_col: str = "quality", sample: int = SAMPLE) -> Model:
    """A model of the graded ratings (id_col, grade_col), fitted on sample rated documents at most.

    Grades are numbers; any count of grades from two on. Of ratings that repeat an id the highest counts, of documents
    that repeat one the smallest text, so no more than sample rows reach the driver. Null ratings and ratings without a document do not count;
    with fewer than two grades every text gets the one grade (or 0).
    """
    sc = Scratch(docs.sparkSession, "quality")
    rated = ratings.where(F.col(grade_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max(F.col(grade_col).cast("double")).alias("grade"))
    rated = sc.write(rated.orderBy(F.xxhash64(F.col(id_col).cast("string")), id_col).limit(sample), "ratings")  # sample rows: 200 kB
    rows = docs.select(F.col(id_col), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).join(F.broadcast(rated), id_col).groupBy(id_col).agg(F.first("grade").alias("grade"), F.min("text").alias("text")).select("grade", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch, "text"):
                got = list(vectors(W.scan(part, "text", W.SPACED)))
                yield pa.record_batch({"grade": part.column(0), "b": pa.array([b.astype("<i4").tobytes() for b, _ in got], pa.binary()), "v": pa.array([v.astype("<f4").tobytes() for _, v in got], pa.binary())})

    got: pd.DataFrame = rows.mapInArrow(run, "grade double, b binary, v binary").toPandas().sort_values(["b", "v", "grade"])  # the same order on each run
    sc.drop(rated)
    if got.grade.nunique() < 2:
        return Model(np.array(got.grade.unique() if len(got) else [0.0]), np.zeros(BUCKETS), np.empty(0))
    return fit([(np.frombuffer(b, "<i4"), np.frombuffer(v, "<f4").astype(float)) for b, v in zip(got.b, got.v, strict=True)], got.grade.to_numpy())


def grade(text: Column, model: Model, spark) -> Column:
    """struct(expected, top): the expected grade, and the probability of the highest grade, of whole texts (null: empty)."""
    lit = spark.sparkContext.broadcast(model)

    @F.arrow_udf(T.StructType([T.StructField("expected", T.DoubleType()), T.StructField("top", T.DoubleType())]))
    def run(texts: pa.Array) -> pa.Array:
        part = pa.record_batch({"text": texts})
        z = [lit.value.logits(W.scan(x, "text", W.SPACED)) for x in W.slices(part, "text")]
        expected, top = lit.value.read(np.concatenate([*z, np.empty(0)]))
        return pa.StructArray.from_arrays([pa.array(expected), pa.array(top)], ["expected", "top"])

    return run(F.coalesce(text.cast("string"), F.lit("")))

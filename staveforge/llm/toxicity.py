"""Counterfactual-regularised toxicity classifier (operator 4).

Features are the distinct words of a text and their 4, 5 and 6 byte prefixes, as exact 64-bit hashes; which of them
count is chosen by how strongly they go with the label. A logistic model is fitted on a bounded sample of labelled
texts. Each sample text that names a group gets counterfactuals, in which its identity terms are swapped for others of
the same kind; the loss adds the squared change of the logit between the two, so a group's name cannot carry a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words as W
from .common import Scratch

# Identity terms by kind; a counterfactual swaps a term for the next ones of its kind.
IDENTITY_TERMS = {
    "gender en": ["woman", "man", "nonbinary"],
    "gender plural en": ["women", "men", "girls", "boys"],
    "religion en": ["muslim", "christian", "jewish", "hindu", "buddhist", "atheist"],
    "religion plural en": ["muslims", "christians", "jews", "hindus", "buddhists", "atheists"],
    "ethnicity en": ["black", "white", "asian", "latino", "arab", "african"],
    "orientation en": ["gay", "straight", "lesbian", "bisexual", "transgender", "queer"],
    "origin en": ["immigrant", "refugee", "native", "foreigner"],
    "religion de": ["muslimisch", "christlich", "jüdisch"],
    "people de": ["frauen", "männer", "ausländer", "flüchtlinge"],
    "religion fr": ["musulman", "chrétien", "juif"],
    "people fr": ["femmes", "hommes", "immigrés", "réfugiés"],
    "religion es": ["musulmán", "cristiano", "judío"],
    "people es": ["mujeres", "hombres", "inmigrantes", "refugiados"],
}

#: Labelled rows that the model is fitted on at most (those with the smallest hash of their id), and features kept.
SAMPLE, FEATURES = 12_000, 2_000
_SALT = np.array([0x1B873593CC9E2D51, 0x85EBCA6BC2B2AE35, 0x2545F4914F6CDD1D, 0x94D049BB133111EB], np.uint64)


def features(w: W.Words) -> tuple[np.ndarray, np.ndarray]:
    """(word number, feature) of every word and of its prefixes; a word that is no longer than a prefix has no such feature."""
    low = W._LOWER[w.data].astype(np.uint64)
    length = w.end - w.start
    at, out = [np.arange(len(w.hash))], [W.mix(w.hash ^ _SALT[0])]
    prefix = np.zeros(len(w.hash), np.uint64)
    for n in range(6):
        inside = length > n
        prefix[inside] |= low[w.start[inside] + n] << np.uint64(8 * n)
        if n >= 3:
            longer = np.flatnonzero(length > n + 1)
            at.append(longer)
            out.append(W.mix(prefix[longer] ^ _SALT[n - 2]))
    return np.concatenate(at), np.concatenate(out)


def by_text(w: W.Words) -> Iterator[np.ndarray]:
    """The distinct features of each text."""
    at, f = features(w)
    text = w.text[at]
    order = np.argsort(text, kind="stable")
    cuts = np.searchsorted(text[order], np.arange(len(w.offsets)))
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        yield np.unique(f[order[lo:hi]])


def _terms() -> dict[str, list[str]]:
    """For each term the others of its kind, nearest first."""
    return {t: kind[i + 1 :] + kind[:i] for kind in IDENTITY_TERMS.values() for i, t in enumerate(kind)}


def _hashes(words: list[str]) -> np.ndarray:
    batch = pa.record_batch({"text": pa.array(words, pa.string())})
    w = W.scan(batch, "text", W.ALNUM)
    return w.hash[w.bounds[:-1]]


def swapped(text: str, w: W.Words, k: int, step: int, terms: dict[int, list[str]]) -> str | None:
    """The text with each of its identity terms replaced by the step-th other one of its kind, or None if it has none."""
    raw, out, at = text.encode(), [], 0
    for i in range(w.bounds[k], w.bounds[k + 1]):
        if (others := terms.get(int(w.hash[i]))) is not None:
            s, e = w.start[i] - w.offsets[k], w.end[i] - w.offsets[k]
            out += [raw[at:s], others[step % len(others)].encode()]
            at = e
    return b"".join([*out, raw[at:]]).decode() if out else None


def _explained(sample: DataFrame, swaps: int) -> DataFrame:
    """(label, features, swapped array<features>) of the sample's texts; features are arrays of longs."""
    table = _terms()
    terms = dict(zip(_hashes(list(table)).tolist(), table.values(), strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.array(sorted(terms), np.uint64)
        for batch in batches:
            for part in W.slices(batch, "text"):
                w = W.scan(part, "text", W.ALNUM)
                own = [f.view(np.int64) for f in by_text(w)]
                other: list[list[np.ndarray]] = [[] for _ in own]
                for k in np.unique(w.text[np.isin(w.hash, known)]).tolist():
                    alt = [x for s in range(swaps) if (x := swapped(part.column(1)[k].as_py() or "", w, k, s, terms)) is not None]
                    v = W.scan(pa.record_batch({"text": pa.array(alt, pa.string())}), "text", W.ALNUM)
                    other[k] = [f.view(np.int64) for f in by_text(v)]
                yield pa.record_batch({"label": part.column(0).cast(pa.int32()), "features": pa.array(own, pa.list_(pa.int64())), "swapped": pa.array(other, pa.list_(pa.list_(pa.int64())))})

    return sample.select("label", "text").mapInArrow(run, "label int, features array<long>, swapped array<array<long>>")


@dataclass
class Model:
    feature: np.ndarray  # sorted hashes
    weight: np.ndarray
    bias: float

    def logits(self, w: W.Words) -> np.ndarray:
        out = np.full(len(w.offsets) - 1, self.bias)
        if len(self.feature) and len(w.hash):
            if not hasattr(self, "_sieve"):
                self._sieve = np.zeros(1 << 20, bool)
                self._sieve[self.feature >> np.uint64(44)] = True
            at, f = features(w)
            hit = self._sieve[f >> np.uint64(44)]
            at, f = at[hit], f[hit]
            pos = np.searchsorted(self.feature, f)
            pos[pos == len(self.feature)] = 0
            ok = self.feature[pos] == f
            once = np.unique(w.text[at[ok]] * np.int64(len(self.feature)) + pos[ok])
            text, pos = once // len(self.feature), once % len(self.feature)
            out += np.bincount(text, self.weight[pos], len(out))
        return out


def fit(rows: list[np.ndarray], label: np.ndarray, pairs: list[tuple[np.ndarray, np.ndarray]], n: int, l2: float = 1e-3, fairness: float = 1.0, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Weights and bias of min logloss + l2 |w|^2 / 2 + fairness * mean over pairs of (w.x - w.x')^2 / 2, by gradient steps with moments.

    rows and pairs hold column numbers of features that are present. The loss is weighed so that both labels count alike
    up to the square root of their ratio.
    """

    def flat(x: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        return np.repeat(np.arange(len(x)), [len(v) for v in x]), np.concatenate([*x, np.empty(0, np.int64)]).astype(np.int64)

    r, c = flat(rows)
    (pr, pc), (qr, qc) = flat([a for a, _ in pairs]), flat([b for _, b in pairs])
    y = label.astype(float)
    share = min(max(y.mean(), 1e-3), 1 - 1e-3)
    weight = np.where(y > 0, ((1 - share) / share) ** 0.5, 1.0)
    weight /= weight.sum()
    w, b, vw, vb = np.zeros(n), np.log(share / (1 - share)), np.zeros(n), 0.0
    gw2, gb2 = np.zeros(n), 0.0
    for t in range(1, rounds + 1):
        z = np.bincount(r, w[c], len(rows)) + b
        d = weight * (1 / (1 + np.exp(-z)) - y)
        g, gb = np.bincount(c, d[r], n) + l2 * w / len(rows) ** 0.5, d.sum()
        if pairs:
            gap = (np.bincount(pr, w[pc], len(pairs)) - np.bincount(qr, w[qc], len(pairs))) * fairness / len(pairs)
            g += np.bincount(pc, gap[pr], n) - np.bincount(qc, gap[qr], n)
        vw, vb = 0.9 * vw + 0.1 * g, 0.9 * vb + 0.1 * gb
        gw2, gb2 = 0.99 * gw2 + 0.01 * g * g, 0.99 * gb2 + 0.01 * gb * gb
        k = 1 - 0.9**t, 1 - 0.99**t
        step = 0.1 * min(1.0, 2 * (1 - t / rounds))
        w = w - step * (vw / k[0]) / (np.sqrt(gw2 / k[1]) + 1e-8)
        b = b - step * (vb / k[0]) / (np.sqrt(gb2 / k[1]) + 1e-8)
    return w, float(b)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE, keep: int = FEATURES, swaps: int = 2, fairness: float = 1.0) -> Model:
    """A model of label_col in labels (id_col, label_col), fitted on sample labelled documents at most.

    Features are kept by the size of the z-score between the label's two rates of presence, among those in at least
    three sample texts, and identity terms always, so that their weights can be held together. Of labels that repeat an
    id the highest counts, of documents that repeat one the smallest text. Null labels and labels without a document do
    not count. Without rows of both labels the score is constant.
    """
    sc = Scratch(docs.sparkSession, "toxicity")
    lab = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max(F.col(label_col).cast("int")).alias("label"))
    lab = sc.write(lab.orderBy(F.xxhash64(F.col(id_col).cast("string")), id_col).limit(sample), "labels")  # sample rows: 200 kB
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col), text.alias("text")).join(F.broadcast(lab), id_col).groupBy(id_col).agg(F.first("label").alias("label"), F.min("text").alias("text")).select("label", "text")
    seen = sc.write(_explained(rows, swaps), "explained")
    n, pos = seen.agg(F.count(F.lit(1)), F.sum("label")).first()
    if not n or not pos or pos == n:
        return Model(np.empty(0, np.uint64), np.empty(0), float(np.log(((pos or 0) + 0.5) / (n - (pos or 0) + 0.5))))
    neg, p = n - pos, (F.col("t") + F.col("c")) / F.lit(float(n))
    z = (F.col("t") / float(pos) - F.col("c") / float(neg)) / F.sqrt(p * (1 - p) * (1.0 / pos + 1.0 / neg) + 1e-12)
    counts = seen.select("label", F.explode("features").alias("f")).groupBy("f").agg(F.sum("label").alias("t"), F.sum(1 - F.col("label")).alias("c"))
    best = counts.where("t + c >= 3").withColumn("z", z).where("abs(z) >= 4").orderBy(F.abs("z").desc(), "f").limit(keep).select("f").collect()
    own = W.mix(_hashes(list(_terms())) ^ _SALT[0])
    vocab = np.unique(np.concatenate([np.array([r["f"] for r in best], np.int64).view(np.uint64), own]))
    lit = sc.spark.sparkContext.broadcast(vocab)

    def narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = lit.value

        def only(x: list[int] | None) -> np.ndarray:
            return np.flatnonzero(np.isin(v, np.array(x or [], np.int64).view(np.uint64)))

        for b in batches:
            yield pa.record_batch({"label": b.column(0), "x": pa.array([only(x) for x in b.column(1).to_pylist()], pa.list_(pa.int64())), "y": pa.array([[only(s) for s in y] for y in b.column(2).to_pylist()], pa.list_(pa.list_(pa.int64())))})

    got: pd.DataFrame = seen.mapInArrow(narrow, "label int, x array<long>, y array<array<long>>").toPandas()
    got = got.assign(k=[(len(x), tuple(x), y) for x, y in zip(got.x, got.label, strict=True)]).sort_values("k")  # the same order on each run
    rows_ = [np.asarray(x, np.int64) for x in got.x]
    pairs = [(x, np.asarray(s, np.int64)) for x, y in zip(rows_, got.y, strict=True) for s in y]
    w, b = fit(rows_, got.label.to_numpy(), pairs, len(vocab), fairness=fairness)
    sc.drop(lab, seen)
    return Model(vocab, w, b)


def score(text: Column, model: Model, spark) -> Column:
    """The probability of the label for whole texts; null and empty texts get the model's base rate."""
    lit = spark.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def run(texts: pa.Array) -> pa.Array:
        part = pa.record_batch({"text": texts})
        z = [lit.value.logits(W.scan(x, "text", W.ALNUM)) for x in W.slices(part, "text")]
        return pa.array(1 / (1 + np.exp(-np.concatenate([*z, np.empty(0)]))))

    return run(F.coalesce(text.cast("string"), F.lit("")))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """docs whose score is below threshold, columns and texts as they were; the model is trained on labels."""
    model = train(docs, labels, id_col, text_col, label_col)
    return docs.where(score(F.col(text_col), model, docs.sparkSession) < threshold)

"""Toxicity by cumulative-link ordinal regression on sparse text features.

P(grade <= k) = sigmoid(t_k - w.x): one weight vector for all grades, ordered thresholds t_0 < t_1 < ... A text's
features are its lower-cased words and their beginnings of 4 to 8 bytes, with their rate per 100 words. The model is
fitted on a bounded sample of labelled rows (`sample` of each side of the first threshold, by hash of the id): features
that occur in at least `least_docs` of them are ranked by the log-likelihood ratio of their counts, the first
`features` are kept, and weights and thresholds follow from penalised likelihood by accelerated gradient descent. Rows
are weighted so that grades count as in all labels. Every text is then scored whole.

Labels may have any number of grades. Where only a flag is known, `graded` makes three: texts with the flag are split
at the median rate of the features that tell them from the others.

Defined cases: a null or empty text has no features and is scored by the thresholds alone; labels that are null or
belong to no document are ignored, the highest label of a document holds, and of several texts of a labelled id the
least by bytes is fitted; without labels of two grades every text has severity 0; rows that repeat are scored alike; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldstone.llm.arrow import as_bytes, map_batches
from fieldstone.shared import written

#: ASCII letters in lower case, digits and all bytes of other characters stay; the rest separates words.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
SHORT, LONG = 4, 8
#: Rates over 5 in 100 words count as 5, so that one word said over and over is not worth more than all others together.
RATE_CAP = 5.0


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(FOLD).split()


def features_of(word: bytes) -> list[bytes]:
    """The word, marked by '=', and its beginnings."""
    return [b"=" + word, *(word[:k] for k in range(SHORT, min(LONG, len(word) - 1) + 1))]


@dataclass
class Model:
    names: list[bytes] = field(default_factory=list)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    thresholds: np.ndarray = field(default_factory=lambda: np.full(1, 30.0))

    def vector(self, text: bytes | None, index: dict[bytes, int], roots: set[bytes]) -> tuple[list[int], list[float]]:
        """Sparse features of a text."""
        words = words_of(text)
        counts: Counter[int] = Counter()
        for w in words:
            if w[:SHORT] in roots:
                counts.update(index[f] for f in features_of(w) if f in index)
        return list(counts), [min(RATE_CAP, 100 * n / (len(words) + 20)) for n in counts.values()]

    def lookup(self) -> tuple[dict[bytes, int], set[bytes]]:
        return {n: i for i, n in enumerate(self.names)}, {n.removeprefix(b"=")[:SHORT] for n in self.names}

    def grades(self, scores: np.ndarray) -> np.ndarray:
        """P(grade = k) for each score and k."""
        upto = 1 / (1 + np.exp(-np.clip(self.thresholds[None, :] - scores[:, None], -500, 500)))
        return np.diff(np.concatenate([np.zeros((len(scores), 1)), upto, np.ones((len(scores), 1))], axis=1), axis=1)


def unpack(z: np.ndarray, d: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights of d features, and thresholds from a start and the logarithms of their gaps."""
    return z[:d], z[d] + np.concatenate([[0], np.cumsum(np.exp(np.clip(z[d + 1 :], -20, 20)))])


def loss(z: np.ndarray, x: np.ndarray, grade: np.ndarray, weight: np.ndarray, penalty: float) -> tuple[float, np.ndarray]:
    """Penalised negative log-likelihood of the grades and its gradient."""
    d = x.shape[1]
    w, t = unpack(z, d)
    k, s = len(t), x @ w
    hi, lo = np.append(t, np.inf)[grade] - s, np.concatenate([[-np.inf], t])[grade] - s
    sig = lambda v: 1 / (1 + np.exp(-np.clip(v, -500, 500)))
    a, b = sig(hi), sig(lo)
    p = np.maximum(a - b, 1e-12)
    da, db = weight * a * (1 - a) / p, weight * b * (1 - b) / p
    gt = np.bincount(grade, -da, k + 1)[:k] + np.bincount(grade, db, k + 1)[1:]
    gaps = np.exp(np.clip(z[d + 1 :], -20, 20))
    g = np.concatenate([x.T @ (da - db) + 2 * penalty * w, [gt.sum()], np.cumsum(gt[::-1])[::-1][1:] * gaps])
    return float(-(weight * np.log(p)).sum() + penalty * w @ w), g


def fit(x: np.ndarray, grade: np.ndarray, weight: np.ndarray, penalty: float = 2e-4, steps: int = 400) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds of the rows x, by Nesterov's method with restarts. Thresholds are a start and positive gaps."""
    k, d = int(grade.max()), x.shape[1]
    weight = weight / weight.sum()
    share = np.clip(np.array([weight[grade <= i].sum() for i in range(k)]), 1e-6, 1 - 1e-6)
    start = np.log(share / (1 - share))
    z = np.concatenate([np.zeros(d), [start[0]], np.log(np.maximum(np.diff(start), 1e-3))])
    f_of = lambda z: loss(z, x, grade, weight, penalty)
    y, rate, momentum = z.copy(), 1.0, 1.0
    value = f_of(z)[0]
    for _ in range(steps):
        f, g = f_of(y)
        while rate > 1e-12 and f_of(y - rate * g)[0] > f - 0.5 * rate * (g @ g):
            rate /= 2
        following = y - rate * g
        now = f_of(following)[0]
        if now > value:
            y, momentum = z.copy(), 1.0
            continue
        ahead = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        y = following + (momentum - 1) / ahead * (following - z)
        z, value, momentum, rate = following, now, ahead, rate * 1.5
    return unpack(z, d)


def rank_features(rows: DataFrame, features: int, least_docs: int) -> list[tuple[bytes, float]]:
    """(feature, log ratio of its share among flagged and other rows) of the features that tell rows (text, flag) apart."""

    def count(batches):
        for batch in batches:
            names, flags = [], []
            for t, flag in zip(as_bytes(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                found = {f for w in set(words_of(t)) for f in features_of(w)}
                names.extend(found)
                flags.extend([flag] * len(found))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(flags, pa.int64())], ["f", "flag"])

    sides = {r["flag"]: r["n"] for r in rows.groupBy("flag").agg(F.count(F.lit(1)).alias("n")).collect()}
    n1, n0 = sides.get(1, 0), sides.get(0, 0)
    if not n1 or not n0:
        return []
    counts = rows.select("text", F.col("flag").cast("bigint")).mapInArrow(count, "f binary, flag long").groupBy("f").agg(F.sum("flag").alias("a"), F.sum(1 - F.col("flag")).alias("b"))
    a, b = (F.col("a") + 0.5) / (n1 + 1), (F.col("b") + 0.5) / (n0 + 1)
    both = (F.col("a") + F.col("b") + 1) / (n1 + n0 + 2)
    gain = F.col("a") * F.log(a / both) + F.col("b") * F.log(b / both)
    top = counts.filter(F.col("a") + F.col("b") >= least_docs).select("f", gain.alias("gain"), F.log(a / b).alias("ratio")).orderBy(F.desc("gain"), "f").limit(features)
    return [(bytes(r["f"]), r["ratio"]) for r in top.collect()]


def vectors(rows: DataFrame, model: Model) -> list:
    """Collected (id, flag, indices, values) of a bounded sample of rows (id, text, flag)."""
    index, roots = model.lookup()

    def run(batches):
        for batch in batches:
            found = [model.vector(t, index, roots) for t in as_bytes(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([i for i, _ in found], pa.list_(pa.int64())), pa.array([v for _, v in found], pa.list_(pa.float64()))], ["id", "flag", "i", "v"])

    return rows.select("id", "text", F.col("flag").cast("bigint")).mapInArrow(run, "id long, flag long, i array<long>, v array<double>").collect()


def graded(flags: np.ndarray, x: np.ndarray, ratios: np.ndarray) -> np.ndarray:
    """Grades 0, 1 and 2 from flags: flagged rows are 2 from the median of their telling features' rates up."""
    rate = x @ (ratios > 1).astype(float)
    return np.where(flags == 0, 0, np.where(rate > np.median(rate[flags == 1]), 2, 1))


def train(docs: DataFrame, labels: DataFrame, sample: int = 4000, features: int = 1024, least_docs: int = 5, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """A model from labels (id, label_col). With grades 0 and 1 alone, graded() makes three."""
    known = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("grade"))
    known = written(known, "toxic-labels")
    totals = {r["grade"]: r["count"] for r in known.groupBy("grade").count().collect()}
    if len(totals) < 2:
        return Model()
    order = F.xxhash64("id", F.lit("sample"))
    chosen = known.filter("grade = 0").orderBy(order, "id").limit(sample).unionByName(known.filter("grade > 0").orderBy(order, "id").limit(sample))  # at most 2 * sample rows
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id").groupBy("id", "grade").agg(F.min("text").alias("text"))
    rows = texts.withColumn("flag", (F.col("grade") > 0).cast("int"))
    rows = written(rows, "toxic-sample")
    ranked = rank_features(rows, features, least_docs)
    model = Model([f for f, _ in ranked])
    found = vectors(rows.withColumn("flag", F.col("grade")), model)
    labelled = np.array([r["flag"] for r in found], np.int64)
    if len(set(labelled.tolist())) < 2:
        return Model()
    x = np.zeros((len(found), len(ranked)))
    for k, r in enumerate(found):
        x[k, r["i"]] = r["v"]
    stands_for = {g: totals[g] / n for g, n in Counter(labelled.tolist()).items()}
    each = np.array([stands_for[g] for g in labelled.tolist()])
    grade = graded(labelled, x, np.array([r for _, r in ranked])) if set(totals) <= {0, 1} else labelled
    model.weights, model.thresholds = fit(x, grade, each)
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, expected_severity, grade (the likeliest), p_toxic, toxic (p_toxic over one half)."""

    def make():
        index, roots = model.lookup()

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [model.vector(t, index, roots) for t in as_bytes(batch.column(1))]
            p = model.grades(np.array([model.weights[i] @ np.array(v) if i else 0.0 for i, v in found]))
            above = 1 - p[:, 0]
            columns = [p @ np.arange(p.shape[1]), p.argmax(axis=1).astype(np.int32), above, above > 0.5]
            return pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, columns)], [id_col, "expected_severity", "grade", "p_toxic", "toxic"])

        return run

    kind = docs.select(id_col).schema[0].dataType.simpleString()
    return map_batches(docs.select(id_col, text_col), make, f"`{id_col}` {kind}, expected_severity double, grade int, p_toxic double, toxic boolean", text_col)

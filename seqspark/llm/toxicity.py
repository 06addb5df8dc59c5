"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents are the positives, a sample of all documents is the unlabelled set.  A linear numpy
classifier over screened word features minimises the class-prior-corrected risk
``prior * R_P(+) + max(0, R_U(-) - prior * R_P(-))``; several seeds are averaged.

Defined results: null and empty texts get the score of a text without words; with no positives the score is the
class prior (0 if nothing is labelled); label rows that repeat count once, null labels are ignored; repeated
documents each get a row; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fold, held_out, lowest_ids, map_texts, pick, table

#: Bounds of the fitting sample: positives and unlabelled documents, and bytes of the word sets of either.
MAX_POSITIVE, MAX_UNLABELLED, MAX_BYTES = 4000, 12000, 64 << 20
BITS, MAX_FEATURES = 20, 2048
STRIP = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())


@dataclass
class Model:
    features: np.ndarray  # sorted hashed words
    weights: np.ndarray
    bias: float

    def dense(self) -> np.ndarray:
        out = np.zeros(1 << BITS, np.float32)
        out[self.features] = self.weights
        return out


def hashed_words(text: str | None) -> np.ndarray:
    """Distinct words of the whole text, lower-cased and without outer punctuation, as sorted numbers below 2**BITS."""
    words = {w.strip(STRIP) for w in set((text or "").lower().split())}
    words.discard("")
    return np.unique(np.fromiter((zlib.crc32(w.encode("utf-8", "replace")) for w in words), np.int64, len(words)) & ((1 << BITS) - 1)).astype(np.int32)


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _sum_by_row(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    total = np.r_[0.0, values.cumsum()]
    ends = sizes.cumsum()
    return total[ends] - total[ends - sizes]


def nn_pu(rows: list[np.ndarray], positive: np.ndarray, width: int, prior: float, steps: int = 300, rate: float = 0.05, decay: float = 1e-3, seed: int = 0) -> tuple[np.ndarray, float]:
    """Weights and bias for rows of active feature numbers; Adam on the non-negative risk, full batches over a bootstrap of the rows."""
    rng = np.random.default_rng(seed)
    chosen = np.concatenate([rng.choice(np.flatnonzero(positive == k), (positive == k).sum()) for k in (True, False)])
    rows, pos = [rows[i] for i in chosen], positive[chosen]
    cols, sizes = np.concatenate([*rows, np.zeros(0, np.int64)]).astype(np.int64), np.array([len(r) for r in rows])
    w, b = np.zeros(width), float(np.log(prior / (1 - prior)))
    m, v = np.zeros(width + 1), np.zeros(width + 1)
    n_p, n_u = pos.sum(), (~pos).sum()
    for t in range(1, steps + 1):
        p = _sigmoid(_sum_by_row(w[cols], sizes) + b)
        loss_neg = -np.log(1 - p + 1e-12)
        negative_risk = loss_neg[~pos].mean() - prior * loss_neg[pos].mean()
        g = np.zeros(len(rows))
        if negative_risk >= 0:
            g[pos] = prior * ((p[pos] - 1) - p[pos]) / n_p  # of R_P(+) and of -R_P(-)
            g[~pos] = p[~pos] / n_u
        else:  # step back out of the overfitted part
            g[pos] = prior * p[pos] / n_p
            g[~pos] = -p[~pos] / n_u
        grad = np.r_[np.bincount(cols, np.repeat(g, sizes), width) + decay * w / len(rows), g.sum()]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
        w, b = w - step[:-1], b - step[-1]
    return w, b


def train(rows: list[np.ndarray], positive: np.ndarray, prior: float, seeds: int = 3) -> Model:
    """Screen words whose document rate differs between positives and unlabelled rows, then fit and average."""
    prior = min(max(prior, 1e-4), 0.5)
    unique: dict[tuple, int] = {}
    for i, r in enumerate(rows):  # copies count once
        unique.setdefault((bool(positive[i]), r.tobytes()), i)
    kept = sorted(unique.values())
    rows, positive = [rows[i] for i in kept], positive[kept]
    if not positive.any() or positive.all():
        return Model(np.zeros(0, np.int64), np.zeros(0), float(np.log(prior / (1 - prior))))
    count = lambda on: np.bincount(np.concatenate([r for r, p in zip(rows, positive, strict=True) if p == on] + [np.zeros(0, np.int32)]), minlength=1 << BITS)
    n_p, n_u = positive.sum(), (~positive).sum()
    in_p, in_u = count(True), count(False)
    all_rate = (in_p + in_u + 1) / (n_p + n_u + 2)
    z = (in_p / n_p - in_u / n_u) / np.sqrt(all_rate * (1 - all_rate) * (1 / n_p + 1 / n_u))
    good = np.flatnonzero((np.abs(z) >= 3.5) & (in_p + in_u >= 5))
    good = np.sort(good[np.argsort(-np.abs(z[good]), kind="stable")[:MAX_FEATURES]])
    place = np.full(1 << BITS, -1)
    place[good] = np.arange(len(good))
    small = [(x := place[r])[x >= 0] for r in rows]
    fits = [nn_pu(small, positive, len(good), prior, seed=k) for k in range(seeds)]
    return Model(good, np.mean([w for w, _ in fits], 0) if len(good) else np.zeros(0), float(np.mean([b for _, b in fits])))


def scorer(model: Model):
    dense = model.dense()
    return lambda texts: [_sigmoid(np.array([float(dense[hashed_words(t)].sum()) for t in texts]) + model.bias)]


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """``labels`` (doc_id, toxic) are those that may be learned from; their texts and the unlabelled texts come from ``docs``."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n, toxic = known.agg(F.count("*"), F.sum("toxic")).first()
    if not n:
        return Model(np.zeros(0, np.int64), np.zeros(0), -30.0)
    positives = lowest_ids(known.where("toxic = 1"), "doc_id", MAX_POSITIVE).withColumn("_pos", F.lit(True))
    unlabelled = lowest_ids(docs, "doc_id", MAX_UNLABELLED).withColumn("_pos", F.lit(False))
    chosen = pick(docs.select("doc_id", "text"), positives.unionByName(unlabelled)).select("doc_id", "_pos", "text")
    sets = map_texts(chosen, lambda: lambda texts: [[hashed_words(t).tobytes() for t in texts]], [("words", "binary")])
    # of a sample of very long texts as many as a task holds, by the same order; at most 16,000 rows meet here
    upto = Window.partitionBy("_pos").orderBy(F.xxhash64(F.lit(11), "doc_id"), "doc_id", "words").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sets = sets.withColumn("_upto", F.sum(F.octet_length("words")).over(upto))
    sample = sets.where(F.col("_upto") <= MAX_BYTES).select("doc_id", "_pos", "words")
    # a task fits, so that the driver holds only the model
    got = sample.repartition(1).mapInArrow(_fitter(toxic / n), "features array<long>, weights array<double>, bias double").first()
    if got is None:  # no row is in the sample
        return train([], np.zeros(0, bool), toxic / n)
    return Model(np.array(got["features"], np.int64), np.array(got["weights"], np.float64), got["bias"])


def _fitter(prior: float):
    def run(batches):
        import pyarrow as pa

        held = [*batches]
        if not held:
            return
        got = pa.Table.from_batches(held).sort_by([("doc_id", "ascending"), ("_pos", "ascending")])
        rows = [np.frombuffer(x, np.int32) for x in got.column("words").to_pylist()]
        model = train(rows, np.array(got.column("_pos").to_pylist(), bool), prior)
        yield pa.RecordBatch.from_pylist([{"features": model.features.tolist(), "weights": model.weights.tolist(), "bias": model.bias}], schema=pa.schema([("features", pa.list_(pa.int64())), ("weights", pa.list_(pa.float64())), ("bias", pa.float64())]))

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Columns of ``docs`` except text, and ``score``."""
    return map_texts(docs, lambda: scorer(model), [("score", "double")])


def learnable(labels: DataFrame) -> DataFrame:
    return labels.where(fold(F.col("doc_id"), 5) != 0)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: learn where crc32(doc_id) mod 5 is not 0, score every document."""
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, learnable(table(spark, sf_dir, "labels").select("doc_id", "toxic")))
    scored = score(docs.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "text"), model)
    return scored.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))

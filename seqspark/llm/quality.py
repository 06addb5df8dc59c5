"""Quality classifier: random-indexing word vectors pooled per document, a two-layer numpy network, calibrated probabilities.

Each token has a fixed sparse ternary index vector; a word's vector is the sum of the index vectors seen around
it over the *whole* corpus (accumulated per partition, added up by a hash aggregation; the vocabulary is hashed to
VOCAB rows, so the table has a fixed size).  A document is the mean of its tokens' unit vectors.  The network's
temperature is fitted on a fold that training leaves out.

Defined results: null and empty texts pool to the zero vector and are scored like any text; with no labels or one
class only the score is that class's rate (0.5 without labels); null labels are ignored, label rows that repeat
count once; repeated documents each get a row; extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold, held_out, lowest_ids, map_texts, pick, table

#: Rows and width of the table of word vectors; non-zero places of an index vector; neighbours on each side.
VOCAB, DIM, NONZERO, REACH = 1 << 14, 32, 2, 2
#: Bound of the labelled sample.
SAMPLE = 12000
TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+")


def _index_vectors(seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Places (VOCAB, NONZERO) and signs of every index vector."""
    rng = np.random.default_rng(seed)
    return rng.integers(0, DIM, (VOCAB, NONZERO)), rng.choice(np.array([-1.0, 1.0]), (VOCAB, NONZERO))


def token_ids(text: str | None, memo: dict[str, int]) -> np.ndarray:
    """Row numbers of a whole text's tokens: words, numbers and runs of signs; case kept.  ``memo`` is emptied when large."""
    if len(memo) > 200_000:
        memo.clear()
    tokens = TOKEN.findall(text or "")
    for t in set(tokens):
        if t not in memo:
            memo[t] = zlib.crc32(t.encode("utf-8", "replace")) & (VOCAB - 1)
    return np.fromiter(map(memo.__getitem__, tokens), np.int64, len(tokens))


def corpus_vectors(docs: DataFrame) -> np.ndarray:
    """(VOCAB, DIM) context sums over all of ``docs``."""

    def run(batches):
        import pyarrow as pa

        places, signs = _index_vectors()
        memo: dict[str, int] = {}
        total = np.zeros((DIM, VOCAB))
        for b in batches:
            for i in range(0, b.num_rows, 256):
                rows = [token_ids(t, memo) for t in b.column(0).slice(i, 256).to_pylist()]
                gap = np.full(REACH, -1)
                ids = np.concatenate([x for r in rows for x in (r, gap)])  # a gap after each text: no context reaches over it
                for step in range(1, REACH + 1):
                    a, c = ids[:-step], ids[step:]
                    ok = (a >= 0) & (c >= 0)
                    a, c = a[ok], c[ok]
                    for word, near in ((a, c), (c, a)):
                        for k in range(NONZERO):
                            total += np.bincount(places[near, k] * VOCAB + word, signs[near, k], DIM * VOCAB).reshape(DIM, VOCAB)
        seen = np.flatnonzero(np.abs(total).sum(0))
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), *(pa.array(total[d, seen]) for d in range(DIM))], names=["word", *(f"d{d}" for d in range(DIM))])

    parts = docs.select("text").mapInArrow(run, "word int, " + ", ".join(f"d{d} double" for d in range(DIM)))
    got = parts.groupBy("word").agg(*(F.sum(f"d{d}").alias(f"d{d}") for d in range(DIM))).toArrow()
    out = np.zeros((VOCAB, DIM), np.float32)
    if got.num_rows:
        out[got.column("word").to_numpy()] = np.stack([got.column(f"d{d}").to_numpy() for d in range(DIM)], 1)
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(norm > 0, norm, 1)


def pooler(vectors: np.ndarray):
    """texts -> (n, 2 * DIM): the mean word vector, and the mean index vector of the tokens themselves."""
    places, signs = _index_vectors()
    own = np.zeros((VOCAB, DIM), np.float32)
    for k in range(NONZERO):
        own[np.arange(VOCAB), places[:, k]] += signs[:, k]
    both = np.hstack([vectors, own]).astype(np.float32)
    memo: dict[str, int] = {}

    def run(texts) -> np.ndarray:
        out = np.zeros((len(texts), 2 * DIM), np.float32)
        for i, t in enumerate(texts):
            ids = token_ids(t, memo)
            if len(ids):
                rows, n = np.unique(ids, return_counts=True)
                out[i] = (n.astype(np.float32) @ both[rows]) / len(ids)
        return out

    return run


@dataclass
class Network:
    vectors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x).astype(float) / self.temperature, -30, 30)))


def train(x: np.ndarray, y: np.ndarray, calibrate: np.ndarray, vectors: np.ndarray, hidden: int = 24, steps: int = 600, seed: int = 5) -> Network:
    """Adam on weighted cross-entropy over the rows outside ``calibrate``; the temperature minimises the loss on ``calibrate``."""
    rate = float(y.mean()) if len(y) else 0.5
    width = x.shape[1]
    net = Network(vectors, x.mean(0) if len(x) else np.zeros(width), (x.std(0) + 1e-3) if len(x) else np.ones(width), np.zeros((width, hidden)), np.zeros(hidden), np.zeros(hidden), float(np.log((rate + 1e-3) / (1 - rate + 1e-3))))
    own = ~calibrate
    if len(set(y[own].tolist())) < 2:
        return net
    rng = np.random.default_rng(seed)
    p = [rng.normal(0, width**-0.5, (width, hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, hidden), np.array(net.b2)]
    m, v = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
    z, t_all = (x[own] - net.mean) / net.scale, y[own].astype(float)
    for t in range(1, steps + 1):
        some = rng.integers(0, len(z), min(256, len(z)))
        xb, yb = z[some], t_all[some]
        h = np.tanh(xb @ p[0] + p[1])
        d = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -30, 30))) - yb) / len(xb)
        dh = d[:, None] * p[2] * (1 - h**2)
        grads = [xb.T @ dh + 1e-3 * p[0], dh.sum(0), h.T @ d + 1e-3 * p[2], d.sum()]
        for k, g in enumerate(grads):
            m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g**2
            p[k] = p[k] - 0.005 * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    net.w1, net.b1, net.w2, net.b2 = p[0], p[1], p[2], float(p[3])
    if calibrate.any():
        logit, target = net.logits(x[calibrate]), y[calibrate].astype(float)
        loss = lambda s: np.mean(np.logaddexp(0, logit / s) - target * logit / s)
        net.temperature = float(min(np.geomspace(0.25, 8, 61), key=loss))
    return net


def fit(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE) -> Network:
    """Word vectors from all of ``docs``; the network from at most ``bound`` of the learnable ``labels`` (doc_id, quality)."""
    vectors = corpus_vectors(docs)
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    ids = lowest_ids(known, "doc_id", bound).join(known, F.col("_id") == known["doc_id"]).select("_id", "quality")
    chosen = pick(docs.select("doc_id", "text"), ids).select("doc_id", "quality", (fold(F.col("doc_id"), 5) == 1).alias("calibrate"), "text")

    def make():
        pool = pooler(vectors)
        return lambda texts: [[r.tobytes() for r in pool(texts)]]

    got = map_texts(chosen, make, [("x", "binary")]).toArrow().sort_by([("doc_id", "ascending"), ("quality", "ascending")])
    x = np.array([np.frombuffer(r, np.float32) for r in got.column("x").to_pylist()], np.float64).reshape(-1, 2 * DIM)
    return train(x, np.array(got.column("quality").to_pylist(), int), np.array(got.column("calibrate").to_pylist(), bool), vectors)


def score(docs: DataFrame, net: Network) -> DataFrame:
    """Columns of ``docs`` except text, and ``score``."""

    def make():
        pool = pooler(net.vectors)
        return lambda texts: [net.probability(pool(texts))]

    return map_texts(docs, make, [("score", "double")])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: learn where crc32(doc_id) mod 5 is not 0, score every document."""
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality").where(fold(F.col("doc_id"), 5) != 0)
    net = fit(docs, labels)
    scored = score(docs.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "text"), net)
    return scored.withColumn("predicted", F.when(F.col("score") >= 0.3, 1).otherwise(0))

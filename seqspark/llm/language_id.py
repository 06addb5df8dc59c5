"""Language identification with a byte convolutional network trained in numpy.

A byte embedding feeds filters of several widths; each filter is max-pooled over a window of fixed length and a
softmax layer maps the pooled values to languages.  A text is cut into consecutive windows over its whole UTF-8
form; its log-probabilities are the mean over its windows.

Defined results: null texts and texts without a letter (Unicode category L) give ``und`` with score 0; rows with a null ``lang`` are
predicted but not learned from; an empty training set predicts ``und`` for all; repeated rows each get a row;
extra columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, held_out, map_texts, table

MAYBE_LETTER = re.compile(r"[^\W\d_]")
WIDTHS = (2, 3, 4)
#: Bound of the training sample: documents of each language, whole.
PER_LANG = 600
LENGTH, EMBED, FILTERS = 96, 8, 8


@dataclass
class ByteCnn:
    """Weights: emb (256, E); conv {width: (width, E, F)}; bias {width: (F,)}; out (3F, L), out_b (L,)."""

    langs: list[str]
    emb: np.ndarray
    conv: dict[int, np.ndarray]
    bias: dict[int, np.ndarray]
    out: np.ndarray
    out_b: np.ndarray


def has_letter(text: str) -> bool:
    """Whether some character is a letter (category L); the first candidate nearly always is."""
    return any(m[0].isalpha() for m in MAYBE_LETTER.finditer(text))


def windows(raw: bytes, length: int = LENGTH) -> np.ndarray:
    """All bytes in consecutive rows of ``length``; the last row starts earlier so that it is full, short texts are padded with spaces."""
    x = np.frombuffer(raw, np.uint8)
    if len(x) <= length:
        return np.pad(x, (0, length - len(x)), constant_values=32)[None]
    full = len(x) // length
    rows = x[: full * length].reshape(full, length)
    return rows if len(x) % length == 0 else np.vstack([rows, x[-length:][None]])


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def train(x: np.ndarray, y: np.ndarray, langs: list[str], weight: np.ndarray, steps: int = 400, batch: int = 64, seed: int = 3) -> ByteCnn:
    """Adam on cross-entropy.  x: windows (n, length) uint8; y: class numbers; weight: how often a window is drawn, adding up to 1."""
    rng = np.random.default_rng(seed)
    n_lang = len(langs)
    p = {"emb": rng.normal(0, 0.5, (256, EMBED)), "out": rng.normal(0, 0.2, (len(WIDTHS) * FILTERS, n_lang)), "out_b": np.zeros(n_lang)}
    for w in WIDTHS:
        p[f"c{w}"], p[f"b{w}"] = rng.normal(0, 1 / np.sqrt(w * EMBED), (w * EMBED, FILTERS)), np.zeros(FILTERS)
    p = {k: a.astype(np.float32) for k, a in p.items()}
    m, v = {k: np.zeros_like(a) for k, a in p.items()}, {k: np.zeros_like(a) for k, a in p.items()}
    for t in range(1, steps + 1):
        pickd = rng.choice(len(x), batch, p=weight)
        xb, yb = x[pickd], y[pickd]
        e = p["emb"][xb]
        pooled, keep = [], []
        for w in WIDTHS:
            cols = np.concatenate([e[:, j : xb.shape[1] - w + 1 + j] for j in range(w)], axis=2)
            act = cols @ p[f"c{w}"] + p[f"b{w}"]
            at = act.argmax(1)
            top = np.take_along_axis(act, at[:, None], 1)[:, 0]
            pooled.append(np.maximum(top, 0))
            keep.append((cols, at, top > 0))
        h = np.hstack(pooled)
        d = _softmax(h @ p["out"] + p["out_b"])
        d[np.arange(batch), yb] -= 1
        d /= batch
        g = {"out": h.T @ d + 1e-4 * p["out"], "out_b": d.sum(0), "emb": np.zeros_like(p["emb"])}
        dh = d @ p["out"].T
        for i, w in enumerate(WIDTHS):
            cols, at, on = keep[i]
            dtop = dh[:, i * FILTERS : (i + 1) * FILTERS] * on
            seen = np.take_along_axis(cols, at[:, :, None], 1)  # (batch, F, w*E)
            g[f"c{w}"], g[f"b{w}"] = np.einsum("bf,bfk->kf", dtop, seen), dtop.sum(0)
            back = np.einsum("bf,kf->bfk", dtop, p[f"c{w}"]).reshape(batch, FILTERS, w, EMBED)
            for j in range(w):
                np.add.at(g["emb"], xb[np.arange(batch)[:, None], at + j], back[:, :, j])
        for k in p:
            m[k] = 0.9 * m[k] + 0.1 * g[k]
            v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
            p[k] -= 0.01 * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    return ByteCnn(langs, p["emb"], {w: p[f"c{w}"].reshape(w, EMBED, FILTERS) for w in WIDTHS}, {w: p[f"b{w}"] for w in WIDTHS}, p["out"], p["out_b"])


def predictor(model: ByteCnn):
    """Window log-probabilities.  A filter is a sum of table rows: pairs of bytes index one table for their joint contribution."""
    one = {w: [(model.emb @ model.conv[w][j]).astype(np.float32) for j in range(w)] for w in WIDTHS}
    pair = {(w, j): (one[w][j][:, None] + one[w][j + 1][None]).reshape(65536, FILTERS) for w in WIDTHS for j in range(0, w - 1, 2)}

    def run(x: np.ndarray) -> np.ndarray:
        xt = np.ascontiguousarray(x.T)  # a row for each position: the running maximum over positions stays in cache
        pairs = xt[:-1].astype(np.intp) * 256 + xt[1:]
        pooled, act, more = [], np.empty((len(x), FILTERS), np.float32), np.empty((len(x), FILTERS), np.float32)
        for w in WIDTHS:
            best = np.full((len(x), FILTERS), -np.inf, np.float32)
            for i in range(x.shape[1] - w + 1):
                np.take(pair[w, 0], pairs[i], axis=0, out=act, mode="clip")
                if w >= 4:
                    act += np.take(pair[w, 2], pairs[i + 2], axis=0, out=more, mode="clip")
                if w % 2:
                    act += np.take(one[w][w - 1], xt[i + w - 1], axis=0, out=more, mode="clip")
                np.maximum(best, act, out=best)
            pooled.append(np.maximum(best + model.bias[w].astype(np.float32), 0))
        return np.log(_softmax(np.hstack(pooled) @ model.out + model.out_b) + 1e-12)

    return run


def predict_texts(model: ByteCnn | None, texts: list[str | None], run=None, block: int = 1024) -> tuple[list[str], list[float]]:
    langs, scores = ["und"] * len(texts), [0.0] * len(texts)
    if model is None:
        return langs, scores
    run = run or predictor(model)
    rows, owner = [], []
    for i, t in enumerate(texts):
        if t and has_letter(t):
            rows.append(windows(t.encode("utf-8", "replace")))
            owner.append(i)
    if not rows:
        return langs, scores
    sizes = np.array([len(r) for r in rows])
    x = np.vstack(rows)
    logp = np.vstack([run(x[i : i + block]) for i in range(0, len(x), block)])
    mean = np.add.reduceat(logp, np.r_[0, sizes[:-1].cumsum()], axis=0) / sizes[:, None]
    prob = _softmax(mean)
    for i, best, s in zip(owner, prob.argmax(1), prob.max(1), strict=True):
        langs[i], scores[i] = model.langs[best], float(s)
    return langs, scores


def fit(docs: DataFrame, bound: int = PER_LANG) -> ByteCnn | None:
    """Learn from ``text`` and ``lang`` of at most ``bound`` documents of each language (lowest seeded id hashes), from all their windows.

    Every language is drawn equally often, and every document of a language.
    """
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    ids = cut(usable.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("_id"), F.col("lang").alias("_lang")).distinct())
    # ids whose hash is far above the lowest of a common language don't go to its ranking: four times the bound does
    counts = ids.groupBy("_lang").agg((F.lit(4.0 * bound) / F.count("*")).alias("_share"))
    ids = ids.withColumn("_h", F.pmod(F.xxhash64(F.lit(7), F.col("_id")), F.lit(1 << 32))).join(F.broadcast(counts), "_lang").where(F.col("_h") <= F.col("_share") * (1 << 32)).drop("_share")
    order = Window.partitionBy("_lang").orderBy("_h", "_id")
    ids = ids.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= bound).drop("_n")
    chosen = usable.join(F.broadcast(ids), (usable["doc_id"] == ids["_id"]) & (usable["lang"] == ids["_lang"]), "left_semi")

    def cutter():
        return lambda texts: [[windows(t.encode("utf-8", "replace")).tobytes() for t in texts]]

    got = map_texts(chosen.select("doc_id", "lang", "text"), cutter, [("w", "binary")])
    got = got.toArrow().sort_by([("doc_id", "ascending"), ("lang", "ascending")])
    if not got.num_rows:
        return None
    names = got.column("lang").to_pylist()
    langs = sorted(set(names))
    rows = [np.frombuffer(b, np.uint8).reshape(-1, LENGTH) for b in got.column("w").to_pylist()]
    y, sizes = np.array([langs.index(n) for n in names]), np.array([len(r) for r in rows])
    weight = np.repeat(1 / (len(langs) * np.bincount(y)[y] * sizes), sizes)
    return train(np.vstack(rows), np.repeat(y, sizes), langs, weight / weight.sum())


def predict(docs: DataFrame, model: ByteCnn | None) -> DataFrame:
    """Columns of ``docs`` except text, and ``lang_pred``, ``score``."""

    def make():
        run = predictor(model) if model else None
        return lambda texts: predict_texts(model, texts, run)

    return map_texts(docs, make, [("lang_pred", "string"), ("score", "double")])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: learn where crc32(doc_id) mod 3 is not 1, predict every document."""
    docs = table(spark, sf_dir, "documents")
    held = held_out(F.col("doc_id"), 3, 1)
    model = fit(docs.where(F.col("doc_id").isNotNull() & ~held).select("doc_id", "text", "lang"))
    return predict(docs.select("doc_id", held.alias("held_out"), "text"), model)

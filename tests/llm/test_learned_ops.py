"""Held-out accuracy, recall and awkward inputs of the learned operators, and the pipeline's stages."""

import re
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from seqspark.llm import ann, language_id, quality, stages, toxicity
from seqspark.llm.common import cut

from .helpers import DOCS, awkward, empty, save

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("awkward"))
    save(awkward(spark), d, "documents")
    save(spark.createDataFrame([(1, 1, 1), (1, 1, 1), (5, 0, None), (6, None, 0), (None, 1, 1), (99, 0, 0)], "doc_id long, quality int, toxic int"), d, "labels")
    return d


@pytest.fixture(scope="module")
def nothing(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("nothing"))
    save(empty(spark), d, "documents")
    save(spark.createDataFrame([], "doc_id long, quality int, toxic int"), d, "labels")
    return d


def auc(y, s):
    r = pd.Series(s).rank().to_numpy()
    n = (y == 1).sum()
    return (r[y == 1].sum() - n * (n + 1) / 2) / n / (len(y) - n)


@pytest.mark.parametrize("op", [toxicity, quality, language_id])
def test_awkward_and_empty(spark, folder, nothing, op):
    out = op.query(spark, folder).toPandas()
    assert len(out) == 10 and out.score.between(0, 1).all()
    assert op.query(spark, nothing).count() == 0
    if op is language_id:
        assert set(out[out.doc_id.isin([2, 3, 4, 8])].lang_pred) == {"und"}
    else:
        assert set(out.predicted) <= {0, 1}


def test_toxicity_held_out(spark):
    out = toxicity.query(spark, SF).toPandas().merge(pd.read_parquet(f"{SF}/labels.parquet"), on="doc_id")
    assert (out.held_out == out.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 5 == 0)).all()
    held = out[out.held_out]
    assert auc(held.toxic.to_numpy(), held.score.to_numpy()) > 0.75 and (held.predicted == held.toxic).mean() > 0.9


def test_nn_pu_never_learns_from_negative_labels():
    rng = np.random.default_rng(0)
    rows = [np.array([0, 2 + rng.integers(5)]) for _ in range(100)] + [np.array([1, 2 + rng.integers(5)]) if rng.random() > 0.1 else np.array([0, 2]) for _ in range(400)]
    w, b = toxicity.nn_pu(rows, np.arange(500) < 100, 7, 0.1)
    assert w[0] + b > 0 > w[1] + b


def test_quality_held_out(spark):
    out = quality.query(spark, SF).toPandas().merge(pd.read_parquet(f"{SF}/labels.parquet"), on="doc_id")
    held = out[out.held_out]
    assert (held.predicted == held.quality).mean() > 0.93 and auc(held.quality.to_numpy(), held.score.to_numpy()) > 0.75


def test_word_vectors_cover_all_rows(spark):
    docs = spark.createDataFrame([("red apple pie",), ("green apple pie",), (None,), ("",)], "text string")
    v = quality.corpus_vectors(docs)
    memo = {}
    apple, pie, red, green = (quality.token_ids(x, memo)[0] for x in ("apple", "pie", "red", "green"))
    assert np.isclose(np.linalg.norm(v[[apple, pie, red, green]], axis=1), 1).all() and np.allclose(v[red], v[green])


def test_language_held_out(spark):
    out = language_id.query(spark, SF).toPandas().merge(pd.read_parquet(f"{SF}/documents.parquet", columns=["doc_id", "lang"]), on="doc_id")
    held = out[out.held_out]
    assert len(held) > 200 and (held.lang_pred == held.lang).mean() > 0.97


def test_windows_cover_every_byte():
    for n in (0, 1, 95, 96, 97, 500):
        raw = bytes(range(1, 251)) * 2
        w = language_id.windows(raw[:n])
        assert w.shape[1] == language_id.LENGTH and (n == 0 or set(raw[:n]) <= set(w.reshape(-1).tolist()))


def brute_neighbours(ids, x, k=20):
    x = x.astype(float)
    s = x @ x.T
    out = {}
    for i in np.flatnonzero(ids % 20 == 0):
        row = s[i].copy()
        row[i] = -np.inf
        out[int(ids[i])] = ids[np.lexsort((ids, -row))[: min(k, len(ids) - 1)]].tolist()
    return out


def test_neighbours_recall(spark):
    e = pd.read_parquet(f"{SF}/embeddings.parquet").sort_values("vec_id")
    want = brute_neighbours(e.vec_id.to_numpy(), np.stack(e.embedding))
    got = ann.query(spark, SF).toPandas()
    assert set(got.query_id) == set(want) and (got.groupby("query_id")["rank"].max() == 20).all()
    assert np.mean([len(set(g.vec_id) & set(want[q])) / 20 for q, g in got.groupby("query_id")]) >= 0.9


def test_neighbours_awkward(spark):
    rng = np.random.default_rng(1)
    same = [1.0, 0.0, 0.0]
    rows = [(i, same, "c") for i in range(60)] + [(100 + i, rng.normal(size=3).tolist(), "c") for i in range(8)]
    rows += [(200, None, "c"), (220, [0.0, 0.0, 0.0], "c"), (240, [float("nan"), 1.0, 1.0], "c"), (260, [None, 1.0, 2.0], "c"), (280, [1.0], "c"), (None, same, "c"), (0, same, "c")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string")
    got = ann.search(df, lambda i: i % 20 == 0).toPandas()
    assert set(got.query_id) == {0, 20, 40, 100}
    assert got[got.query_id == 0].sort_values("rank").vec_id.tolist() == list(range(1, 21))  # equal scores: smaller ids
    assert got[got.query_id == 20].sort_values("rank").vec_id.tolist() == [i for i in range(21) if i != 20]
    few = ann.search(df.where("vec_id in (100, 101)"), lambda i: i % 20 == 0).toPandas()
    assert few[["query_id", "rank", "vec_id"]].values.tolist() == [[100, 1, 101]]
    assert ann.search(df.limit(0), lambda i: i % 20 == 0).count() == 0


def shingles(text, k=5):
    w = re.findall(rb"[^\x20\x09-\x0D]+", text.encode().lower())
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def test_near_duplicate_stage(spark):
    rng = np.random.default_rng(3)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 6))
    base = [" ".join(word() for _ in range(200)) for _ in range(12)]
    rows, i = [], 0
    for b in base:
        for change in (0, 0, 1, 2):
            w = b.split()
            for at in rng.integers(0, 200, change):
                w[at] = word()
            rows.append((i, " ".join(w), "en", "a", 0))
            i += 1
    rows += [(1000, None, None, None, None), (1001, "", None, None, None), (1002, "one", "en", "a", 3), (1003, "two", "en", "a", 3), (None, base[0], "en", "a", 1)]
    kept = stages.drop_near_duplicates(spark, spark.createDataFrame(rows, DOCS), SF)
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    ids = {r["doc_id"] for r in kept.collect()}
    assert ids == {4 * k for k in range(12)} | {1000, 1002, 1003}


def test_stages_keep_columns_and_take_effect(spark, folder, tmp_path):
    save(spark.read.parquet(f"{SF}/labels.parquet"), str(tmp_path), "labels")
    save(spark.read.parquet(f"{SF}/benchmark.parquet"), str(tmp_path), "benchmark")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = docs.count()
    names = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = cut(stage(spark, docs, str(tmp_path)))
        after = docs.count()
        assert docs.columns == names and (after == before if name == "secret_scan" else 0.7 * before < after < before), name
        before = after
    mixed = stages.mix_sources(spark, docs, str(tmp_path))
    assert mixed.where("taken > 0").count() == mixed.count() > 0
    from seqspark.llm import decontaminate, secret_scan

    assert secret_scan.secret_spans(docs).where("spans <> ''").count() == 0
    assert decontaminate.contamination(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).where("contaminated").count() == 0


@pytest.mark.parametrize("at", range(5))
def test_stages_on_awkward_and_empty(spark, folder, nothing, at):
    name, stage = corpus_pipeline.STAGES[at]
    for d, frame in ((folder, spark.read.parquet(f"{folder}/documents.parquet")), (nothing, empty(spark))):
        bench = spark.createDataFrame([(1, "nothing in common with any of the other texts here at all")], "item_id long, text string")
        save(bench, d, "benchmark")
        out = stage(spark, frame, d)
        n = frame.count()
        assert out.count() <= n, name
        if name in ("benchmark_decontamination", "secret_scan"):
            assert out.count() == n, name
        own = ["size", "source_size", "target", "taken", "mix_start"] if name == "source_mixing" else []
        assert sorted(out.columns) == sorted({*frame.columns, *own}), name
        for c in {"score", "_row", "code", "digest"} & set(frame.columns):  # clashing columns come back as they were
            assert {r[0] for r in out.select(c).distinct().collect()} <= {"clash"}, (name, c)


def test_sketch_distances():
    bounds = [stages.sketch_distances(j, 512) for j in (0.95, 0.9, 0.8, 0.5)]
    assert bounds == sorted(bounds) and all(0 <= lo < (1 - j) / 2 * 512 < hi for (lo, hi), j in zip(bounds, (0.95, 0.9, 0.8, 0.5), strict=True))


def test_jaccard_reaches():
    rng = np.random.default_rng(4)
    for _ in range(300):
        a, b = (np.unique(rng.integers(0, 60, rng.integers(0, 60)).astype(np.uint32)) for _ in range(2))
        u = len(np.union1d(a, b))
        assert stages.jaccard_reaches(a, b, 0.5) == (u == 0 or len(np.intersect1d(a, b)) >= 0.5 * u)


def test_rows_are_the_same_in_any_split(spark, tmp_path):
    """What a stage keeps doesn't change with the splits of its input between one read and the next."""
    from seqspark.llm.common import with_row

    rows = [(i // 2, f"text number {i // 3} of some words that repeat {i % 7}", "en", "abc"[i % 3], 0) for i in range(400)]
    spark.createDataFrame(rows, DOCS).repartition(16).write.parquet(str(tmp_path / "documents.parquet"))
    save(spark.createDataFrame([(1, "text number 5 of some words that repeat 1 text number")], "item_id long, text string"), str(tmp_path), "benchmark")
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = []
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        lazy = with_row(docs, "_row")
        for size in ("1g", "2k"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "1k" if size == "2k" else "4m")
            assert len({(r["_row"], r["doc_id"], r["text"]) for r in lazy.collect()}) == 400
            seen.append({(tuple(r["_row"]), r["doc_id"], r["text"]) for r in lazy.collect()})
        assert seen[0] == seen[1]
        kept = []
        for n, name in enumerate(("drop_near_duplicates", "drop_contaminated", "mix_sources")):
            spark.conf.set("spark.sql.files.maxPartitionBytes", "1g")
            out = getattr(stages, name)(spark, docs, str(tmp_path))
            spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")  # executors have come between decision and join
            kept.append(sorted((r["doc_id"], r["text"]) for r in out.select("doc_id", "text").collect()))
            again = getattr(stages, name)(spark, docs, str(tmp_path))
            assert kept[n] == sorted((r["doc_id"], r["text"]) for r in again.select("doc_id", "text").collect())
        texts = {}
        for i, t, *_ in rows:
            texts[t] = min(i, texts.get(t, i))
        assert all(texts[t] == i for i, t in kept[0])
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_working_tables_are_deleted(spark, tmp_path):
    from seqspark.llm import common

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    with common.tracked() as used:
        common.cut(docs.limit(5))
    path = used[0].removeprefix("file://")
    import os

    assert len(used) == 1 and os.path.isdir(path)
    common.drop_path(spark, used[0])
    assert not os.path.exists(path)


@pytest.mark.parametrize("n", [1, 4, 40, 400, 8000])
def test_sketches_estimate_jaccard_at_every_size(n):
    rng = np.random.default_rng(n)
    bits = 64 * stages.SKETCH
    got, want = [], []
    for _ in range(20):
        a = np.unique(rng.integers(0, 1 << 63, n + max(1, n // 4), dtype=np.uint64))
        b = a[rng.permutation(len(a))[:n]]
        got.append(np.bitwise_count(stages.minwise_sketch(a) ^ stages.minwise_sketch(np.sort(b))).sum())
        want.append((1 - len(b) / len(a)) / 2 * bits)
    assert abs(np.mean(got) - np.mean(want)) < 4 * np.sqrt(np.mean(want) / 20) + 1
    assert not stages.minwise_sketch(np.zeros(0, np.uint64)).any()


def test_near_duplicate_stage_against_exact_jaccard(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("text is not null")
    texts = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    sets = {i: shingles(t) for i, t in texts.items()}
    where: dict = {}
    for i, s in sets.items():
        for x in s:
            where.setdefault(x, set()).add(i)
    near: dict = {i: {} for i in sets}
    for i, s in sets.items():
        for j in set().union(*(where[x] for x in s)) - {i}:
            near[i][j] = len(s & sets[j]) / len(s | sets[j])
    group = {i: i for i in sets}

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in sets:
        for j, x in near[i].items():
            if x >= 0.8:
                a, b = sorted((root(i), root(j)))
                group[b] = a
    blank = [i for i in sets if not sets[i]]
    for i in blank:
        group[i] = min(blank)
    kept = {r["doc_id"] for r in stages.drop_near_duplicates(spark, docs, SF).select("doc_id").collect()}
    assert kept == {i for i in sets if group[i] == i}


def test_fold_of_null_ids(spark):
    from seqspark.llm.common import held_out

    df = spark.createDataFrame([(None,), (3,)], "doc_id long")
    assert [r[0] for r in df.select(held_out(F.col("doc_id"), 5, 0)).collect()] == [False, zlib.crc32(b"3") % 5 == 0]


def test_cut_and_extended_copies_meet():
    rng = np.random.default_rng(8)
    for n in (60, 250, 1000):
        met = 0
        for i in range(300):
            w = [f"w{x}" for x in rng.integers(0, 1 << 40, n)]
            cut_off = w[: int(np.ceil(0.8 * (n - 4))) + 4]  # Jaccard similarity of five-word shingles: 0.8 or just above
            codes = [r[0] for r in (stages._sketcher()([" ".join(x)])[0] for x in (w, cut_off))]
            met += any(a == b for a, b in zip(*codes, strict=True))
        assert met >= 0.99 * 300 - 2, n


def test_near_duplicate_stage_finds_cut_copies(spark):
    rng = np.random.default_rng(9)
    rows = []
    for i in range(200):
        w = [f"w{x}" for x in rng.integers(0, 1 << 40, 250)]
        rows += [(2 * i, " ".join(w), "en", "a", 0), (2 * i + 1, " ".join(w[:214]), "en", "a", 0)]  # 210 of 246 shingles: 0.854
    kept = stages.drop_near_duplicates(spark, spark.createDataFrame(rows, DOCS), SF).count()
    assert kept == 200


@pytest.mark.parametrize("limit", [3, 20_000])
def test_links_in_doubt_are_proven(spark, limit):
    """Chains of copies at 0.75 and 0.83 of their neighbours: the sketches alone can't tell them apart."""
    rng = np.random.default_rng(10)
    rows = []
    for chain, step in enumerate((36, 23) * 20):
        w = [f"w{x}" for x in rng.integers(0, 1 << 40, 254 + 5 * step)]
        rows += [(10 * chain + k, " ".join(w[k * step : k * step + 254]), "en", "a", 0) for k in range(6)]  # shares 250 - step of 250 + step shingles
    docs = spark.createDataFrame(rows, DOCS)
    old = stages.LIMIT
    try:
        stages.near_groups.__defaults__ = (limit,)
        kept = {r["doc_id"] for r in stages.drop_near_duplicates(spark, docs, SF).select("doc_id").collect()}
    finally:
        stages.near_groups.__defaults__ = (old,)
    assert kept == {i for i, *_ in rows if (i // 10) % 2 == 0 or i % 10 == 0}


@pytest.mark.parametrize("limit", [4, 16, 20_000])
def test_every_member_of_a_code_is_compared(spark, limit):
    from seqspark.llm.components import components

    rng = np.random.default_rng(limit)
    most, full = 51, rng.integers(0, 1 << 63, 8, dtype=np.uint64)

    def flipped(sketch, at):
        bits = np.unpackbits(sketch.view(np.uint8))
        bits[at] ^= 1
        return np.packbits(bits).view(np.uint64)

    # chains: each row near the next, none near the one after; two chains share a code, their rows are mixed
    chains = [[flipped(full, slice(0, 0))], [~full]]
    for c in chains:
        for k in range(9):
            c.append(flipped(c[-1], slice(40 * k, 40 * k + 40)))
    sketches = [x for c in chains for x in c]
    order = rng.permutation(20)
    order = np.r_[order[order % 10 == 5], order[order % 10 != 5]]  # a middle row comes first and would lead
    rows = [(0, 7, int(i), bytearray(sketches[at].tobytes())) for i, at in enumerate(order)] + [(1, 7, 100, bytearray(full.tobytes())), (0, 8, 101, bytearray(full.tobytes()))]
    df = spark.createDataFrame(rows, "t int, code long, node long, sketch binary")
    root = {r["node"]: r["root"] for r in components(stages.link_sketches(df, 0, most, limit).where("not sure").select("u", "v")).collect()}
    got: dict = {}
    for i, at in enumerate(order):
        got.setdefault(root.get(i, i), set()).add(int(at))
    words = np.array(sketches)
    near = np.bitwise_count(words[:, None] ^ words[None]).sum(2) <= most
    reach = np.linalg.matrix_power(near.astype(float), 20) > 0
    assert sorted(map(sorted, got.values())) == sorted(map(list, {tuple(np.flatnonzero(r).tolist()) for r in reach}))
    assert 100 not in root and 101 not in root


def test_bits_of_a_simhash_are_majorities():
    rng = np.random.default_rng(12)
    for n in (0, 1, 5, 193, 1000):
        z = rng.integers(0, 1 << 63, (n, 3), dtype=np.uint64)
        assert (stages.bit_counts(z) == np.unpackbits(z.view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.int64)).all()
        h = z[:, 0]
        words = stages.simhash_words(h)
        ones = sum((stages.mix(h, 1) >> np.uint64(k) & np.uint64(1)).sum() * 2 > n and 1 << k for k in range(stages.BITS))
        assert words[0] == ones and (words < 1 << stages.BITS).all()


@pytest.mark.parametrize(("n", "m"), [(5, 4), (6, 5), (10, 8), (45, 36), (250, 200), (1000, 800)])
def test_near_sets_meet_within_the_budget_of_some_word(n, m):
    rng = np.random.default_rng(n)
    met = 0
    for _ in range(500):
        h = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        a, b = stages.simhash_words(h), stages.simhash_words(h[:m])  # Jaccard similarity 0.8
        k = min(len(a), len(b))
        met += (np.bitwise_count((a[:k] ^ b[:k]).astype(np.uint64)) <= stages.BUDGET).any()
    assert met >= 0.998 * 500 - 3


@pytest.mark.parametrize("limit", [4, 20_000])
def test_candidates_are_what_the_trie_join_finds(spark, limit):
    """Equal sketches are linked if their words are within the budget, wherever the bits differ, and not otherwise."""
    from seqspark.llm.components import components

    rng = np.random.default_rng(13)
    rows, node, want = [], 0, []
    for t, away in [(t, away) for t in (0, 3) for away in (1, 2, 3, 4, 9)]:
        for _ in range(6):
            sketch = bytearray(rng.integers(0, 1 << 63, stages.SKETCH, dtype=np.uint64).tobytes())
            word = int(rng.integers(0, 1 << stages.BITS))
            flip = sum(1 << int(k) for k in rng.choice(stages.BITS, away, replace=False))
            rows += [(t, word, node, sketch), (t, word ^ flip, node + 1, sketch), (t + 1, word, node + 2, sketch)]
            want += [{node, node + 1}] if away <= stages.BUDGET else []
            node += 3
    hot = bytearray(rng.integers(0, 1 << 63, stages.SKETCH, dtype=np.uint64).tobytes())
    rows += [(0, 5 ^ (k % 2), node + k, hot) for k in range(40)]  # many rows of two words
    df = spark.createDataFrame(rows, "t int, code long, node long, sketch binary")
    got: dict = {}
    for r in components(stages.link_sketches(df, 0, 51, limit).where("sure").select("u", "v")).collect():
        got.setdefault(r["root"], set()).add(r["node"])
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, [*want, set(range(node, node + 40))]))


def test_near_duplicate_stage_takes_candidates_from_simhash(spark, monkeypatch):
    """Without a budget of bits near copies hardly meet: the trie join of the words makes the candidates."""
    rng = np.random.default_rng(14)
    rows = []
    for i in range(60):
        w = [f"w{x}" for x in rng.integers(0, 1 << 40, 250)]
        rows += [(2 * i, " ".join(w), "en", "a", 0), (2 * i + 1, " ".join(w[:210]), "en", "a", 0)]
    docs = spark.createDataFrame(rows, DOCS)
    assert stages.drop_near_duplicates(spark, docs, SF).count() == 60
    found = stages.trie_pairs
    monkeypatch.setattr(stages, "trie_pairs", lambda codes, starts, budget, bits: found(codes, starts, 0, bits))
    assert stages.drop_near_duplicates(spark, docs, SF).count() > 90


def test_components_at_once_and_in_rounds(spark):
    from seqspark.llm.components import components

    rng = np.random.default_rng(15)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 400, (300, 2))] + [(1000 + i, 1001 + i) for i in range(50)]
    df = spark.createDataFrame(links, "u long, v long")
    rounds, at_once = ({tuple(r) for r in components(df, few=few).collect()} for few in (0, 1000))
    assert rounds == at_once and len(at_once) > 300
    assert components(df.limit(0), few=1000).count() == 0


def test_the_driver_gets_neither_the_fitting_sample_nor_rounds_of_links(spark, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame as Classic

    def gathered(*_):
        raise AssertionError("rows of the sample reach the driver")

    docs, labels = (spark.read.parquet(f"{SF}/{x}.parquet") for x in ("documents", "labels"))
    with monkeypatch.context() as m:
        m.setattr(Classic, "toArrow", gathered)
        m.setattr(Classic, "toPandas", gathered)
        model = toxicity.fit(docs, toxicity.learnable(labels.select("doc_id", "toxic")))
    assert len(model.features) == len(model.weights) > 0
    spark.sparkContext.setJobGroup("near", "near")
    try:
        stages.drop_near_duplicates(spark, docs, SF).count()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("near")) <= 60
    empty_sample = toxicity.fit(docs.limit(0), toxicity.learnable(labels.select("doc_id", "toxic")))
    assert not len(empty_sample.features) and np.isfinite(empty_sample.bias)

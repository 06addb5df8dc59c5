"""Golden values and invariants of indexes, lookups, alignment, sampling, comparison and streams."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqspark.functions.scoring import EDIT, preset, simple, simple_affine
from seqspark.operators import align, compare, index, lookup, reduce, sampling
from seqspark.plans import aligner, indexing
from seqspark.streaming import reads as streams


def test_banana(spark):
    t = spark.createDataFrame([(1, "BANANA")], "ref_id long, seq string")
    for sa in (index.suffix_array(t), index.suffix_array_doubling(t, first=1)):
        assert [r["pos"] for r in sa.orderBy("row").collect()] == [6, 5, 3, 1, 0, 4, 2]
        assert tuple(index.bwt_string(index.bwt(t, sa)).first())[1:] == ("ANNBAA", 4)


def test_rank_and_locate_invariants(spark):
    rng = random.Random(1)
    seq = "".join(rng.choices("ACGT", k=300))
    t = spark.createDataFrame([(1, seq), (2, "AAAAAAAAAA"), (3, "")], "ref_id long, seq string")
    sa = index.suffix_array(t)
    rows = index.bwt(t, sa)
    ranks = {r["row"]: r for r in index.rank_table(rows).where("ref_id = 1").collect()}
    text = "".join(ranks[i]["ch"] for i in range(301))
    assert all(ranks[i][f"occ_{c.lower()}"] == text[: i + 1].count(c) for i in range(0, 301, 7) for c in "ACGT")
    p = spark.createDataFrame([(i, seq[i : i + 6]) for i in range(0, 290, 13)] + [(900, "NNNNNN"), (901, "AAAAAA")], "query_id long, pattern string")
    hits = lookup.match(lookup.match_ranges(sa, t, 6), p)
    found = {(r["query_id"], r["ref_id"], r["pos"]) for r in lookup.locate(hits, sa).collect()}
    want = {(q, k, i) for q, w in [tuple(r) for r in p.collect()] for k, s in ((1, seq), (2, "A" * 10)) for i in range(len(s) - 5) if s[i : i + 6] == w}
    assert found == want
    walk = lookup.locate_sampled(hits.withColumn("row", F.explode(F.sequence("begin", "end"))), index.ssa_by_value(sa, 8), index.inverse_psi(rows), 8)
    assert {(r["query_id"], r["ref_id"], r["pos"]) for r in walk.collect()} == want
    m = lookup.mismatch_search(t, p, 6, 1)
    brute = {(q, k, i) for q, w in [tuple(r) for r in p.collect()] for k, s in ((1, seq), (2, "A" * 10)) for i in range(len(s) - 5) if sum(a != b for a, b in zip(s[i : i + 6], w, strict=True)) <= 1}
    assert {(r["query_id"], r["ref_id"], r["pos"]) for r in m.collect()} == brute


GOLDEN_SCORES = [
    ("GGGTGCTCAA", "AAAAGGGTGCTCAA", 0), ("GGGTAAGCTC", "AAAAGGGTGCTCAA", -2), ("AAGGGTGCTC", "AAAAGGGTGCAATC", -2), ("AAAAGGGTGC", "AAAAGGGTGCTCAA", 0), ("AAAAGGGTG", "AAAAGGAAGTGCTC", -2), ("CACCGGGT", "AACAGGGTGCTC", -2),
]
P, T = "ACAACTA", "AAACACCCTAACACACTAAA"


def test_golden_scores():
    for p, t, want in GOLDEN_SCORES:
        for band in (None, 7):
            assert align.Matrix([p], [t], EDIT, "semi_global", band).sinks()[0][0][0] == want


@pytest.mark.parametrize("scheme", [simple(2, -1, -1, -1), simple_affine(2, -1, -1, -1)])
@pytest.mark.parametrize("mode, band, want", [("global", None, "1M2D3M1D3M10D"), ("local", None, "4M1D3M"), ("semi_global", None, "4M1D3M"), ("semi_global", 7, "4M1D3M")])
def test_golden_tracebacks(spark, scheme, mode, band, want):
    df = spark.createDataFrame([(1, P, T), (2, None, T)], "id int, pattern string, text string")
    got = {r["id"]: r for r in align.align_traceback(df, scheme, mode, band).collect()}
    assert got[1]["ops_rev"] == want and got[2]["score"] is None


def rescore(ops, p, t, s):
    i = j = score = 0
    last = ""
    for op in ops:
        if op == "M":
            score += s.match if p[j] == t[i] else s.mismatch_max
            i, j = i + 1, j + 1
        elif op == "D":
            score += s.text_extend if last == "D" else s.text_open
            i += 1
        else:
            score += s.pattern_extend if last == "I" else s.pattern_open
            j += 1
        last = op
    return score


def test_tracebacks_rescore_to_their_score():
    rng = random.Random(5)
    for s in (EDIT, simple(2, -1, -2, -2), simple_affine(2, -3, -5, -1)):
        ps = ["".join(rng.choices("ACGT", k=rng.randint(1, 25))) for _ in range(30)]
        ts = ["".join(rng.choices("ACGT", k=rng.randint(1, 30))) for _ in range(30)]
        for mode in align.MODES:
            m = align.Matrix(ps, ts, s, mode, trace=True)
            for k, found in enumerate(m.sinks()):
                score, i, j = found[0]
                rev, i0, j0 = m.trace(k, i, j)
                assert rescore(rev[::-1], ps[k][j0:j], ts[k][i0:i], s) == score


def test_md_string():
    assert align.describe("ACGTAC", "ACTTAC", "MMMMMM")[:2] == ("2T3", 1)
    assert align.describe("ACAC", "ACGGAC", "MMDDMM")[0] == "2^GG2"
    assert align.describe("ACTTAC", "ACAC", "MMIIMM")[:5] == ("4", 2, 0, 1, 1)


def test_aligner_finds_planted_reads(spark):
    rng = random.Random(8)
    texts = {i: "".join(rng.choices("ACGT", k=2000)) for i in range(3)}
    comp = str.maketrans("ACGT", "TGCA")
    reads, want = [], {}
    for k in range(12):
        ref, pos = k % 3, rng.randint(0, 1850)
        s = texts[ref][pos : pos + 100]
        s = s[:50] + ("A" if s[50] != "A" else "C") + s[51:]
        if k % 4 == 3:
            s = s[::-1].translate(comp)
        reads.append((k, s, 100))
        want[k] = (ref, pos, int(k % 4 == 3))
    reads.append((99, "ACGT" * 3, 12))
    t = spark.createDataFrame(list(texts.items()), "ref_id long, seq string")
    r = spark.createDataFrame(reads, "read_id long, seq string, len int")
    got = {x["read_id"]: x for x in aligner.align(r, t, aligner.Parameters(seed_length=20)).collect()}
    for k, w in want.items():
        assert (got[k]["ref_id"], got[k]["pos"], got[k]["rc"], got[k]["cigar"], got[k]["n_mm"]) == (*w, "100M", 1)
    assert got[99]["pos"] is None and len(got) == 13
    pairs = spark.createDataFrame([(1, texts[0][300:350], texts[0][500:550][::-1].translate(comp)), (2, texts[1][10:60], "".join(rng.choices("ACGT", k=50)))], "read_id long, seq1 string, seq2 string")
    both = {x["read_id"]: x for x in aligner.align_pairs(pairs, t, aligner.Parameters(seed_length=20)).collect()}
    assert both[1]["paired"] and (both[1]["end1"], both[1]["end2"], both[1]["rc1"], both[1]["rc2"]) == (350, 550, 0, 1) and not both[2]["paired"]


def test_index_build_and_load(spark, tmp_path):
    t = spark.createDataFrame([(0, "a", "ACGTNNACGT"), (1, "b", "GGGTTT")], "ref_id long, name string, seq string").withColumn("anno", F.lit(""))
    indexing.build_index(t, str(tmp_path), sa_interval=2, both_strands=True)
    got = indexing.load_index(spark, str(tmp_path))
    assert [tuple(r) for r in got["ambs"].collect()] == [(4, 2, "N")]
    assert {r["ref_id"]: r["n_ambs"] for r in got["contigs"].collect()} == {0: 1, 1: 0}
    assert {r["ref_id"]: r["length"] for r in got["meta"].collect()} == {0: 10, 1: 6}


def test_sum_tree_goldens(spark):
    trees = {1: [i for i in range(128)], 2: [0] * 64 + [1] * 64, 3: [1] * 64 + [0] * 64}
    leaves = spark.createDataFrame([(t, i, w) for t, ws in trees.items() for i, w in enumerate(ws)], "tree_id long, leaf long, weight long")
    draws = spark.createDataFrame([(t, u) for t in trees for u in (0.0, 0.5, 1.0)], "tree_id long, u double")
    got = {(r["tree_id"], r["u"]): r["leaf"] for r in sampling.weighted_pick(leaves, draws).collect()}
    assert [got[t, u] for t in trees for u in (0.0, 0.5, 1.0)] == [1, 90, 127, 64, 96, 127, 0, 32, 63]


def test_budgeted_reduction_stops(spark):
    rows = [(1, i, -5, 1000 * i, 0, 50) for i in range(40)] + [(1, 40, 0, 90000, 0, 50)]
    hits = spark.createDataFrame(rows, "read_id long, ord long, score long, pos long, rc int, len int")
    r = reduce.best_two_with_budget(hits, max_effort=5, min_ext=10).first()
    assert (r["score"], r["extensions"]) == (-5, 10)
    full = reduce.best_two(hits).first()
    assert (full["score"], full["second_score"]) == (0, -5)


def test_bloom_has_no_false_negatives(spark):
    keys = spark.range(0, 500, 1).select(F.col("id").alias("k"))
    bloom = lookup.bloom_build(keys, "k", 3, 1 << 14)
    assert lookup.bloom_has(keys, "k", bloom, 3, 1 << 14).where("not has").count() == 0
    others = spark.range(10_000, 10_500).select(F.col("id").alias("k"))
    assert lookup.bloom_has(others, "k", bloom, 3, 1 << 14).where("has").count() < 25


def test_mate_windows(spark):
    w = lambda mode, rc: spark.range(1).select(lookup.mate_window(F.lit(1000), F.lit(50), F.lit(rc), F.lit(50), mode).alias("w")).first()["w"]
    assert tuple(w("fr", False)) == (1000, 1500, True) and tuple(w("fr", True)) == (550, 1050, False)
    assert not w("ff", False)["rc"] and w("rr", True)["rc"]


def test_histograms(spark):
    df = spark.createDataFrame([(-9,), (0,), (0,), (9,)], "v int")
    assert sorted(map(tuple, compare.cumulative(compare.histogram(df, F.col("v"), 4)).collect())) == [(-4, 1, 1), (0, 2, 3), (3, 1, 4)]


def test_stream_of_read_batches(spark, tmp_path):
    for i in range(2):
        spark.createDataFrame([(i, "ACGTACGT", 8)], streams.READ_SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    q = streams.align_stream(streams.read_stream(spark, str(tmp_path / "in")), lambda b: b.select("read_id", F.reverse("seq").alias("r")), str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination()
    assert sorted(r["read_id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [0, 1]


def test_active_rounds(spark):
    todo = spark.range(5).withColumnRenamed("id", "read_id")
    done = streams.active_rounds(todo, lambda d, n: d.where(F.col("read_id") % 3 == n % 3), 3, lambda d: d)
    assert done.count() == 5


@pytest.mark.parametrize("name", ["default", "local", "base1"])
def test_presets_score(name):
    m = align.Matrix(["ACGTACGTAC"], ["TTACGTACGTACTT"], preset(name), "semi_global")
    assert m.sinks()[0][0] == (10 * preset(name).match, 12, 10)


def test_all_places_of_a_read_in_many_texts(spark):
    rng = random.Random(9)
    dna = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    read, tail = dna(60), dna(40)
    texts = spark.createDataFrame([(i, dna(30) + read + dna(20)) for i in range(150)] + [(150, dna(30) + tail)], "ref_id long, seq string")
    reads = spark.createDataFrame([(1, read, 60), (2, read[:40] + tail, 80)], "read_id long, seq string, len int")
    p = aligner.Parameters(seed_length=16)
    got = aligner.align_all(reads, texts, p).where("read_id = 1 and score = 0").collect()
    assert sorted((r["ref_id"], r["end"]) for r in got) == [(i, 90) for i in range(150)]
    # the rarest seeds are kept, with all their places; a seed's places are not cut
    places = aligner.candidates(reads, texts, p, 1).where("read_id = 2").collect()
    assert {r["ref_id"] for r in places} == {150}
    assert aligner.candidates(reads, texts, p, 1).where("read_id = 1").count() == 150


def test_read_pairs_are_halves_of_every_item(spark, tmp_path):
    from seqspark.catalog import alignments
    from seqspark.operators.derive import reads

    rng = random.Random(4)
    items = [(i, "".join(rng.choice("ACGT") for _ in range(n))) for i, n in enumerate((240, 99, 20, 0))]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    texts = [(0, "ACGTTGCA" * 4 + "".join(t for _, t in items[:2])), (1, "TTGACCAT" * 9)]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    length = {r["read_id"]: r["len"] for r in reads(spark, str(tmp_path)).collect()}
    got = {r["read_id"]: r for r in alignments.align_read_pairs(spark, str(tmp_path)).collect()}
    assert set(got) == {0, 1, 2, 3}  # every item has a row
    for i in (0, 1):
        assert got[i]["paired"] and got[i]["total"] == 0
        assert got[i]["end2"] - got[i]["end1"] == length[i] - length[i] // 2  # halves that meet
    assert not got[3]["paired"] and got[3]["score1"] is None and got[3]["score2"] is None


@pytest.mark.parametrize("substitutions", [0, 1])
def test_reads_of_repeats_are_seeded_again(spark, substitutions):
    rng = random.Random(6)
    dna = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    twice, once = dna(30), dna(30)
    texts = spark.createDataFrame([(0, twice), (1, twice), (2, once)], "ref_id long, seq string")
    reads = spark.createDataFrame([(1, twice, 30), (2, once, 30)], "read_id long, seq string, len int")
    n = lambda rep: {(r["read_id"], r["ref_id"]): r["n_seeds"] for r in aligner.candidates(reads, texts, aligner.Parameters(seed_length=16, seed_interval=15, max_reseed=1, rep_seeds=rep, substitutions=substitutions)).where("rc = 0 and pos = 0").collect()}
    assert n(3) == {(1, 0): 1, (1, 1): 1, (2, 2): 1}
    assert n(2) == {(1, 0): 2, (1, 1): 2, (2, 2): 1}  # an average of two hits a seed: one more round


def test_sorts(spark):
    from seqspark.operators import sampling

    df = spark.range(2000).select(((F.col("id") * 7919) % 100003 * 41).alias("k"))
    rows = [r["k"] for r in sampling.sort_global(df, "k").collect()]
    assert rows == sorted(rows)
    high = [r["k"] >> 16 for r in sampling.sort_high_bits(df, "k", partitions=5).collect()]
    assert high == sorted(high) and len(high) == 2000


def test_mismatch_search_long_patterns(spark):
    """Patterns of more symbols than one long holds, exact ends, symbols outside the alphabet."""
    import random

    rng = random.Random(5)
    text = "".join(rng.choice("ACGT") for _ in range(300))
    text = text[:50] + "N" + text[51:]
    patterns = []
    for i in range(40):
        at = rng.randrange(0, 250)
        p = list(text[at : at + 45])
        for _ in range(rng.randrange(0, 4)):
            p[rng.randrange(45)] = rng.choice("ACGTN")
        patterns.append((i, "".join(p)))
    texts, pats = spark.createDataFrame([(1, text)], "ref_id int, seq string"), spark.createDataFrame(patterns, "query_id int, pattern string")
    for exact in (0, 10):
        got = sorted(tuple(r) for r in lookup.mismatch_search(texts, pats, 45, 2, exact).collect())
        want = sorted((i, 1, at, d) for i, p in patterns for at in range(len(text) - 44) if (d := sum(a != b for a, b in zip(p, text[at : at + 45], strict=True))) <= 2 and (not exact or p[-exact:] == text[at + 45 - exact : at + 45]))
        assert got == want


def plain_best(p, t, s, mode, band, low, quals):
    """The best end by a dictionary of cells."""
    inside = lambda i, j: band is None or low <= i - j < low + band
    h, e, f, none = {}, {}, {}, align.LOW
    for i in range(len(t) + 1):
        for j in range(len(p) + 1):
            if not inside(i, j):
                continue
            if i == 0:
                h[i, j] = 0 if mode == "local" or j == 0 else s.pattern_open + s.pattern_extend * (j - 1)
            elif j == 0:
                h[i, j] = s.text_open + s.text_extend * (i - 1) if mode == "global" else 0
            else:
                e[i, j] = max(h.get((i, j - 1), none) + s.pattern_open, e.get((i, j - 1), none) + s.pattern_extend)
                f[i, j] = max(h.get((i - 1, j), none) + s.text_open, f.get((i - 1, j), none) + s.text_extend)
                cost = s.mismatch_max if quals is None else int(s.mismatch(np.array([quals[j - 1]]))[0])
                best = max(h.get((i - 1, j - 1), none) + (s.match if p[j - 1] == t[i - 1] else cost), e[i, j], f[i, j])
                h[i, j] = max(best, 0) if mode == "local" else best
    last = {"global": lambda i, j: (i, j) == (len(t), len(p)), "semi_global": lambda i, j: j == len(p) and (i > 0 or j == 0), "local": lambda i, j: True}[mode]
    return max(((v, *at) for at, v in h.items() if last(*at) and v > none // 2), default=None)


@pytest.mark.parametrize("band, low", [(None, 0), (5, 0), (7, -3), (3, -2), (15, -15)])
def test_bands_and_qualities_equal_plain_cells(band, low):
    rng = random.Random(3)
    for s in (EDIT, simple(2, -1, -1, -1), simple_affine(2, -3, -5, -1), preset("default")):
        for mode in align.MODES:
            ps, ts = (["".join(rng.choices("ACGT", k=rng.randint(0, n))) for _ in range(20)] for n in (14, 18))
            for quals in (None, [[rng.randint(0, 40) for _ in p] for p in ps]):
                found = align.Matrix(ps, ts, s, mode, band, quals, True, low).sinks()
                for k, best in enumerate(found):
                    assert (best[0] if best else None) == plain_best(ps[k], ts[k], s, mode, band, low, quals and quals[k])


def test_band_is_all_that_is_stored():
    m = align.Matrix(["ACGT" * 25], ["ACGT" * 50], EDIT, "semi_global", 7, trace=True)
    assert m.h.shape == m.dir.shape == (1, 9, 101)


def test_reads_over_a_begin_and_qualities(spark):
    rng = random.Random(12)
    text = "".join(rng.choices("ACGT", k=400))
    other = "A" if text[150] != "A" else "C"
    changed = text[100:150] + other + text[151:200]
    comp = str.maketrans("ACGT", "TGCA")
    back = changed[::-1].translate(comp)
    low_at = lambda k: [40] * k + [0] + [40] * (99 - k)
    rows = [(1, "TT" + text[:98], [40] * 100), (2, changed, [40] * 100), (3, changed, low_at(50)), (4, back, low_at(49)), (5, changed, None)]
    reads = spark.createDataFrame([(i, s, 100, q) for i, s, q in rows], "read_id long, seq string, len int, qual array<int>")
    texts = spark.createDataFrame([(7, text)], "ref_id long, seq string")
    p = aligner.Parameters(seed_length=16)
    got = {r["read_id"]: r for r in aligner.align(reads, texts, p).collect()}
    assert (got[1]["pos"], got[1]["cigar"], got[1]["score"]) == (0, "2I98M", -11)  # the read begins before the text
    assert [got[k]["score"] for k in (2, 3, 4, 5)] == [-6, -2, -2, -6] and got[4]["rc"] == 1
    assert all((got[k]["pos"], got[k]["n_mm"]) == (100, 1) for k in (2, 3, 4, 5))
    contigs = spark.createDataFrame([(7, "c")], "ref_id long, name string")
    lines = {r["qname"]: r for r in aligner.records(aligner.align(reads, texts, p), reads, contigs).collect()}
    assert lines["4"]["qual"] == "I" * 50 + "!" + "I" * 49 and lines["5"]["qual"] == "*"


def test_both_mates_are_traced_back(spark):
    rng = random.Random(13)
    text, comp = "".join(rng.choices("ACGT", k=1200)), str.maketrans("ACGT", "TGCA")
    second = text[500:530] + text[532:562]  # two symbols of the text are missing
    pairs = spark.createDataFrame([(1, text[300:360], second[::-1].translate(comp)), (2, text[800:860], "A" * 60), (3, "C" * 60, "G" * 60)], "read_id long, seq1 string, seq2 string")
    texts = spark.createDataFrame([(4, text)], "ref_id long, seq string")
    found = aligner.align_pairs(pairs, texts, aligner.Parameters(seed_length=20))
    got = {r["read_id"]: r for r in found.collect()}
    assert (got[1]["paired"], got[1]["total"], got[1]["pos1"], got[1]["cigar1"], got[1]["pos2"], got[1]["end2"], got[1]["ed2"], got[1]["n_gapo2"]) == (True, -11, 300, "60M", 500, 562, 2, 1)
    assert got[1]["mapq1"] == got[1]["mapq2"] > 0
    assert (got[2]["paired"], got[2]["cigar1"], got[2]["cigar2"]) == (False, "60M", None) and got[3]["score1"] is None
    lines = {(r["qname"], r["flag"] & 64 != 0): r for r in aligner.pair_records(found, pairs, spark.createDataFrame([(4, "c")], "ref_id long, name string")).collect()}
    assert len(lines) == 6
    one, two = lines["1", True], lines["1", False]
    assert (one["flag"], two["flag"]) == (1 | 2 | 32 | 64, 1 | 2 | 16 | 128)
    assert (one["rnext"], one["pnext"], one["tlen"], two["pnext"], two["tlen"]) == ("=", 501, 262, 301, -262)
    assert lines["2", True]["flag"] == 1 | 8 | 64 and lines["2", False]["flag"] & 4 and lines["2", False]["rname"] == "*"


def test_state_of_a_group_of_reads():
    """Best, second distinct best and count of many reads at once, whatever the batches, against each read by itself."""
    import random

    import numpy as np

    from seqspark.streaming import reads as stream

    random.seed(5)
    rows = [(random.randrange(30), -random.randrange(6)) for _ in range(400)] + [(99, -(1 << 40)), (100, 3), (100, 3)]
    kept = np.empty(0, stream.STATE)
    for at in range(0, len(rows), 70):
        part = np.array([(r, s, 0, False, 1) for r, s in rows[at : at + 70]], stream.STATE)
        kept = stream._best_two(np.concatenate([kept, part]))
    for read in {r for r, _ in rows}:
        mine = [s for r, s in rows if r == read]
        two = sorted(set(mine), reverse=True)[:2]
        (got,) = kept[kept["read_id"] == read].tolist()
        assert (got[1], got[2] if got[3] else None, got[4]) == (two[0], two[1] if len(two) > 1 else None, len(mine))
    assert len(stream._best_two(kept[:0])) == 0


def test_scores_without_the_matrix(monkeypatch):
    """Semi-global scores come from the last anti-diagonals, the same as from the whole matrix, in a bounded block of memory."""
    import random
    import tracemalloc

    import pandas as pd

    from seqspark.functions.scoring import preset, simple
    from seqspark.operators import align

    random.seed(4)
    word = lambda n, of="ACGT": "".join(random.choices(of, k=n))
    rows = []
    for k in range(150):
        t = word(random.randrange(50), "ACGTN" if k % 5 == 0 else "ACGT")
        p = "".join(c if random.random() < 0.9 else random.choice(("", "A", "CG")) for c in t[random.randrange(len(t) + 1) :][:30])
        rows.append((p, t, [random.randrange(41) for _ in p], random.choice((0, -3, 2, None))))
    df = pd.DataFrame(rows, columns=["p", "t", "q", "low"])
    for scheme in (preset("default"), simple(0, -1, -1, -1)):
        for band, qual in ((None, None), (31, None), (31, "q"), (None, "q")):
            found = pd.concat(align._aligner(scheme, "semi_global", band, False, "p", "t", qual, None, 2, (), "low" if band else None)(iter([df])))
            for (p, t, q, low), got in zip(rows, found[["score", "text_end", "pattern_end", "second_score", "second_end"]].astype(object).values.tolist(), strict=True):
                mx = align.Matrix([p], [t], scheme, "semi_global", None if band is None or low is None or low != low else band, [q] if qual else None, low=int(low) if low == low and low is not None else 0)
                (want,) = mx.sinks(2, 2)
                flat = [*(want[0] if want else (None,) * 3), *(want[1][:2] if len(want) > 1 else (None, None))]
                assert [None if x is pd.NA else x for x in got] == flat
    big = pd.DataFrame([(word(150), word(181), 0)] * 3000, columns=["p", "t", "low"])
    tracemalloc.start()
    list(align._aligner(preset("default"), "semi_global", 31, False, "p", "t", None, None, 0, ("p", "t"), "low")(iter([big])))
    assert tracemalloc.get_traced_memory()[1] < 30_000_000
    tracemalloc.stop()


def test_kmer_counts_pass_on_a_row_for_each_kmer(spark):
    from collections import Counter

    from seqspark.operators import lookup

    texts = ["ACGTACGTTTAC" * 5, "ACG", "", "TTTT"]
    df = spark.createDataFrame([(t,) for t in texts] + [(None,)], "seq string").coalesce(1)
    want = Counter(t[i : i + 4] for t in texts for i in range(len(t) - 3))
    found = lookup.kmer_counts(df, 4)
    assert {r["kmer"]: r["n"] for r in found.collect()} == want
    assert "Generate" not in found._jdf.queryExecution().executedPlan().toString()  # no row for each place
    with pytest.raises(Exception, match="other than A, C, G and T"):
        lookup.kmer_counts(spark.createDataFrame([("ACGTN",)], "seq string"), 4).collect()


def test_approximate_seeds_of_odd_length(spark):
    """Halves of two lengths, hits at either end of a text, hits of both halves once."""
    from seqspark.operators import lookup

    reads = spark.createDataFrame([(1, "ACGTTGCAAGC", 11), (2, "ACGT", 4)], "read_id long, seq string, len int")
    texts = spark.createDataFrame([(7, "ACGTTGCAAGC"), (8, "ACGTTGCAAGGACGATGCAAGC"), (9, "ACGTTGCAAG"), (10, "TTACGTTGCAACG")], "ref_id long, seq string")
    for size in (11, 10):
        got = sorted(tuple(r) for r in lookup.map_approximate(reads, texts, size, 15).where("rc = 0").collect())
        want = []
        for ref, t in ((7, "ACGTTGCAAGC"), (8, "ACGTTGCAAGGACGATGCAAGC"), (9, "ACGTTGCAAG"), (10, "TTACGTTGCAACG")):
            for at in range(len(t) - size + 1):
                d = sum(x != y for x, y in zip("ACGTTGCAAGC"[:size], t[at : at + size], strict=True))
                want += [(1, ref, 0, 0, at, d)] if d <= 1 else []
        assert got == want
    plan = lookup.map_approximate(reads, texts, 20, 15)._jdf.queryExecution().optimizedPlan().toString()
    assert "zip_with" not in plan  # symbols are compared by plain expressions

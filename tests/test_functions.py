"""Symbol, scoring and record functions against plain Python and hand-made values."""

import math

import pytest
from pyspark.sql import functions as F

from seqspark.functions import sam, scoring, symbols


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_codes_and_strands(spark):
    r = one(spark, symbols.encode(F.lit("ACGTNa-")), symbols.encode_io(F.lit("acGT-x")), symbols.decode(F.lit("01234")), symbols.reverse_complement(F.lit("AACgt")), symbols.unpack2(symbols.pack2(F.lit("TGCATTA")), 7), symbols.pack2(F.lit("ANA")))
    assert tuple(r) == ("0123444", "012354", "ACGTN", "acGTT", "TGCATTA", None)
    codes = [one(spark, symbols.char_to_code(F.lit(c)))[0] for c in "ACGTaN"]
    assert codes == [0, 1, 2, 3, 4, 4] and [one(spark, symbols.code_to_char(F.lit(i)))[0] for i in range(5)] == list("ACGTN")


def test_integer_functions(spark):
    r = one(spark, symbols.nth_set_bit(F.lit(0b101100), 2), symbols.count_2bit(F.lit(0b11100100), 3), symbols.log_bin(F.lit(-5)), symbols.round_up(F.lit(13), 8), symbols.lcg(F.lit(1).cast("long")), symbols.solexa_to_phred(F.lit(0)), symbols.solexa_to_phred(F.lit(20)))
    assert tuple(r) == (3, 1, -3, 16, (1664525 + 1013904223) % 2**32, 0, 10)
    assert one(spark, symbols.quality(F.lit("!I"), "phred33"))[0] == [0, 40]


def test_hash_mix(spark):
    def plain(key):
        m = 0xFFFFFFFF
        key = (key + (~(key << 15) & m)) & m
        key ^= key >> 10
        key = (key + (key << 3)) & m
        key ^= key >> 6
        key = (key + (~(key << 11) & m)) & m
        return key ^ (key >> 16)

    for x in (0, 1, 12345, 0xFFFFFFFF):
        assert one(spark, symbols.hash32_mix(F.lit(x).cast("long")))[0] == plain(x)
    assert one(spark, symbols.hash64_fold(F.lit(3 << 32 | 5).cast("long")))[0] == 3 << 32 | 6
    assert one(spark, symbols.add64(F.lit(2**63 - 1), F.lit(1).cast("long")))[0] == -(2**63)


def test_scoring(spark):
    assert [scoring.band_length(d) for d in (0, 1, 2, 3, 7, 15)] == [3, 3, 7, 7, 15, 31]
    r = one(spark, scoring.min_score(F.lit(100), -0.6, -0.6), scoring.min_score(F.lit(100), 0.0, 10.0, True), scoring.gap_budget(F.lit(100), F.lit(0), F.lit(-5), -1))
    assert tuple(r) == (-60, int(10 * math.log(100)), 5)
    assert scoring.preset("local").match == 2 and scoring.preset("default").text_open == -8 and scoring.preset("base1").mismatch_max == -3


@pytest.mark.parametrize(
    "best, second, want", [(0, None, 42), (-10, None, 42), (-15, None, 40), (-61, None, 0), (0, -60, 39), (0, 0, 1), (0, -1, 6), (-50, -51, 2), (0, -30, 35), (-30, -60, 5)]
)
def test_mapq(spark, best, second, want):
    assert one(spark, scoring.mapq(F.lit(best), F.lit(second).cast("int"), F.lit(0), F.lit(-60)))[0] == want


def test_records(spark):
    ops = sam.parse_cigar(F.lit("3S10M2I4D5M"))
    r = one(spark, sam.cigar_text(ops), sam.cigar_text(ops, True), sam.reference_length(ops), sam.read_length(ops), sam.md_mismatches(F.lit("10A5^ACG0T3")), sam.runs_of(F.lit("MMDDM")))
    assert tuple(r) == ("3S10M2I4D5M", "5M4D2I10M3S", 19, 20, 2, "2M2D1M")
    t, f = F.lit(True), F.lit(False)
    assert one(spark, sam.flags(F.lit(0), t, t, t, t, t, f))[0] == 64 + 1 + 2 + 16
    assert one(spark, sam.flags(F.lit(1), f, t, t, t, f, t))[0] == 128 + 1 + 4 + 8
    assert one(spark, sam.template_length(F.lit(100), F.lit(150), F.lit(300), F.lit(350), t, t))[0] == 250
    assert one(spark, sam.template_length(F.lit(300), F.lit(350), F.lit(100), F.lit(150), t, t))[0] == -250


def test_contig_boundary(spark):
    contigs = spark.createDataFrame([(1, "a", 0, 100), (2, "b", 100, 70000), (3, "e", 70100, 0)], "ref_id int, name string, offset long, len long")
    q = spark.createDataFrame([(0,), (60,), (99,), (100,), (70099,), (70100,)], "g long")
    got = [(r["g"], r["ref_name"], r["ref_pos"], r["crosses"]) for r in sam.contig_coordinates(q, contigs, "g", F.lit(50)).orderBy("g").collect()]
    assert got == [(0, "a", 1, False), (60, "a", 61, True), (99, "a", 100, True), (100, "b", 1, False), (70099, "b", 70000, True), (70100, None, None, None)]

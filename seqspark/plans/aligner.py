"""Read alignment as a plan of operators: seeds, candidates, scores, best two, traceback, records."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import sam
from ..functions.scoring import EDIT, Scheme, band_length, mapq, preset
from ..functions.symbols import reverse_complement
from ..operators import lookup, reduce
from ..operators.align import align_score, align_traceback, extension_window
from ..operators.filters import MIN_READ_LENGTH, needs_reseed
from ..operators.windows import top_k
from ..sources.store import stored


@dataclass(frozen=True)
class Parameters:
    # fixed values: defaults of the modelled aligner
    seed_length: int = 22
    seed_interval: int = 15
    max_hits: int = 100
    max_dist: int = 15
    max_reseed: int = 2
    rep_seeds: int = 1000
    substitutions: int = 0
    sub_seed: int = 0
    min_read_length: int = MIN_READ_LENGTH
    mode: str = "semi_global"
    scheme: Scheme = field(default_factory=lambda: preset("default"))
    pe: str = "fr"
    min_frag: int = 0
    max_frag: int = 500
    mixed: bool = True

    @property
    def band(self) -> int:
        return band_length(self.max_dist)


def rarest_seeds(hits: DataFrame, most: int) -> DataFrame:
    """All hits of the ``most`` seeds of each read and round that have fewest hits (both strands together), of equal ones the first."""
    seed = ["read_id", "round", "rc", "pos_in_read"]
    kept = top_k(hits.groupBy(*seed).agg(F.count("*").alias("_n")), ["read_id", "round"], [F.col("_n"), F.col("pos_in_read"), F.col("rc")], most, "_ord")
    return hits.join(kept.select(*seed), seed, "left_semi")


def candidates(reads: DataFrame, texts: DataFrame, p: Parameters, max_hits: int | None = None) -> DataFrame:
    """(read_id, ref_id, rc, pos, n_seeds): every place of a read's seeds, or of its ``max_hits`` rarest seeds in a round.

    Reads without hits, or whose seeds have ``rep_seeds`` hits or more on average, are seeded again from shifted places,
    up to ``max_reseed`` times; places of all their rounds count.  The seeds of all rounds meet the texts' k-mers in one
    join, as the k-mers are by far the larger side; rounds that a read had no need of are dropped behind it.
    """
    retries = tuple(range(p.max_reseed + 1))
    some = reads.where(F.col("len") >= p.min_read_length)
    if p.substitutions == 0:
        hits = lookup.map_exact(some, texts, p.seed_length, p.seed_interval, retries)
    else:
        hits = lookup.map_seeds(some, texts, p.substitutions, p.sub_seed, length=p.seed_length, interval=p.seed_interval, retry=retries).drop("mismatches")
    starts = lookup.seed_starts(p.seed_interval, retries)
    hits = stored(hits.withColumn("round", F.array_position(F.array(*map(F.lit, starts)), F.pmod("pos_in_read", F.lit(p.seed_interval))).cast("int") - 1))
    ranges = hits.groupBy("read_id", "round", "rc", "pos_in_read").agg(F.count("*").alias("_n"))
    seeded = ranges.groupBy("read_id", "round").agg(F.count("*").alias("_c"), F.sum("_n").alias("_s")).where(~needs_reseed(F.col("_c"), F.col("_s"), p.rep_seeds))
    last = seeded.groupBy("read_id").agg(F.min("round").alias("_last"))
    hits = hits.join(last, "read_id", "left").where(F.col("_last").isNull() | (F.col("round") <= F.col("_last"))).drop("_last")
    if max_hits is not None:
        hits = rarest_seeds(hits, max_hits)
    return lookup.seed_diagonals(hits)


def _side(reads: DataFrame) -> DataFrame:
    """Reads as (read_id, _q, len) and, if they have base qualities, _qual; ``mate`` stays."""
    extra = [c for c in ("mate",) if c in reads.columns] + ([F.col("qual").alias("_qual")] if "qual" in reads.columns else [])
    return reads.select("read_id", F.col("seq").alias("_q"), "len", *extra)


def _turned(df: DataFrame, rc: str = "rc") -> DataFrame:
    """Reads as patterns on the strand of their hit, with their qualities."""
    back = F.col(rc) == 1
    out = df.withColumn("pattern", F.when(back, reverse_complement(F.col("_q"))).otherwise(F.col("_q")))
    if "_qual" in df.columns:
        out = out.withColumn("qual", F.when(back, F.reverse("_qual")).otherwise(F.col("_qual")))
    return out.drop("_q", "_qual")


def _with_quality(df: DataFrame) -> dict:
    """Options of the matrix: qualities decide the cost of a mismatch where there are any."""
    has = "qual" in df.columns
    return {"qual": "qual" if has else None, "drop": ("pattern", "text", "qual") if has else ("pattern", "text")}


def scored(reads: DataFrame, texts: DataFrame, places: DataFrame, p: Parameters) -> DataFrame:
    """(read_id, ref_id, rc, pos, len, score, text_from, low, text_end): each place's banded score, at or above the threshold.

    The reference's text stays on its side until a place needs its window; only windows reach the scorer, which
    fills the band around the place's diagonal.
    """
    met = _turned(places.join(_side(reads), "read_id")).join(texts.select("ref_id", F.col("seq").alias("ref_seq")), "ref_id")
    windows = extension_window(met, p.band).drop("ref_seq").withColumn("least", p.scheme.threshold(F.col("len")))
    out = align_score(windows, p.scheme, p.mode, p.band, min_score="least", low="low", **_with_quality(windows))
    return out.where("score is not null")


#: what the traceback needs to know of a window
WINDOW = ("begin", "low")


def _hits(df: DataFrame) -> DataFrame:
    """Scored places as hits on one coordinate: contigs are kept apart by a step larger than any of them."""
    return df.select("read_id", "score", (F.col("ref_id") * F.lit(1 << 32) + F.col("text_from") + F.col("text_end")).alias("pos"), "rc", "len", F.col("text_from").alias("begin"), "low")


def _contig(pos: str):
    return F.shiftright(F.col(pos), 32)


def _end(pos: str):
    return F.col(pos).bitwiseAND(F.lit(0xFFFFFFFF)).cast("int")


def align(reads: DataFrame, texts: DataFrame, p: Parameters = Parameters()) -> DataFrame:
    """Best alignment of every read of (read_id, seq, len[, qual]): read_id, len, ref_id, pos (0-based), rc, score, second_score, mapq, cigar, md, ed, gap counts; nulls if none.

    Two phases: scores decide the best two of a read, tracebacks run on winners only.  Scores are written once.  ``qual`` (Phred values)
    decides the cost of mismatches where reads have it.
    """
    places = stored(scored(reads, texts, candidates(reads, texts, p, p.max_hits), p))
    best = reduce.best_two(_hits(places), carry=WINDOW)
    at = best.select("read_id", _contig("pos").alias("ref_id"), _end("pos").alias("end"), "rc", "second_score", *WINDOW)
    out = traced(at, reads, texts, p)
    quality = mapq(F.col("score"), F.col("second_score"), p.scheme.perfect(F.col("len")), p.scheme.threshold(F.col("len")), p.scheme.monotone)
    found = out.select("read_id", "ref_id", "pos", "rc", "score", "second_score", quality.alias("mapq"), *TRACED)
    return reads.select("read_id", "len").join(found, "read_id", "left")


TRACED = ("cigar", "md", "ed", "n_mm", "n_gapo", "n_gape")


def traced(at: DataFrame, reads: DataFrame, texts: DataFrame, p: Parameters, key: tuple[str, ...] = ("read_id",)) -> DataFrame:
    """Winners (key, ref_id, begin, end, low, rc, ...) with their traceback in the window, and the band, that scored them.

    The window is cut where the best score was found, so the same end wins again.  Adds len, pos, score, CIGAR, MD and counts.
    """
    met = _turned(at.join(_side(reads), list(key))).join(texts.select("ref_id", F.col("seq").alias("ref_seq")), "ref_id")
    met = met.withColumn("text", F.substring("ref_seq", F.col("begin") + 1, F.col("end") - F.col("begin"))).drop("ref_seq")
    out = align_traceback(met, p.scheme, p.mode, p.band, low="low", **_with_quality(met))
    return out.withColumn("pos", F.col("begin") + F.col("text_begin"))


def align_all(reads: DataFrame, texts: DataFrame, p: Parameters = Parameters()) -> DataFrame:
    """Every distinct end of a read's places at or above the threshold; neither places nor seeds are capped."""
    places = scored(reads, texts, candidates(reads, texts, p), p)
    return places.groupBy("read_id", "ref_id", "rc", (F.col("text_from") + F.col("text_end")).alias("end")).agg(F.max("score").alias("score"))


def align_pairs(pairs: DataFrame, texts: DataFrame, p: Parameters = Parameters()) -> DataFrame:
    """Best pair of every read pair (read_id, seq1, seq2[, qual1, qual2]): anchors of either mate, the other scored in its window; mates alone where no pair fits, nulls if none.

    read_id, paired, total and, for either mate k, ref_id, pos, end, rc, score, mapq, CIGAR, MD and counts with k behind
    the name.  Both mates of a winner are traced back: the anchor in its band, the opposite mate in the full matrix of
    its window.  Mapping quality is that of the pair's total and second total, or of the mate alone.
    """
    cols = lambda k: [F.col(f"seq{k}").alias("seq"), F.length(f"seq{k}").alias("len")] + ([F.col(f"qual{k}").alias("qual")] if f"qual{k}" in pairs.columns else [])
    side = lambda k: pairs.select("read_id", *cols(k))
    both, single = None, None
    for anchor, other in ((1, 2), (2, 1)):
        found = stored(scored(side(anchor), texts, candidates(side(anchor), texts, p, p.max_hits), p))
        alone = reduce.best_two(_hits(found), carry=WINDOW).withColumn("mate", F.lit(anchor))
        single = alone if single is None else single.unionByName(alone)
        anchors = found.groupBy("read_id", "ref_id", "rc", (F.col("text_from") + F.col("text_end")).alias("end"), "len").agg(F.max(F.struct("score", F.col("text_from").alias("begin"), "low")).alias("_a"))
        mate = _opposite(anchors.select("*", F.col("_a.score").alias("a_score"), "_a.begin", "_a.low").drop("_a"), side(other), texts, p, anchor == 1)
        base = F.col("ref_id") * F.lit(1 << 32)
        a = {"score": F.col("a_score"), "pos": base + F.col("end"), "rc": F.col("rc").cast("int"), "len": F.col("len"), "begin": F.col("begin"), "low": F.col("low")}
        o = {"score": F.col("score"), "pos": base + F.col("text_from") + F.col("text_end"), "rc": F.col("o_rc"), "len": F.col("o_len"), "begin": F.col("text_from"), "low": F.lit(None).cast("int")}
        one, two = (a, o) if anchor == 1 else (o, a)
        rows = mate.select("read_id", *(one[c].alias(c) for c in ("score", "pos", "rc", "len")), *(two[c].alias(f"o_{c}") for c in ("score", "pos", "rc", "len")), *(d[c].alias(f"{c}{k}") for k, d in ((1, one), (2, two)) for c in WINDOW))
        both = rows if both is None else both.unionByName(rows)
    best = reduce.best_two_pairs(stored(both), carry=(*(f"{c}{k}" for k in (1, 2) for c in WINDOW), "len", "o_len"))
    place = lambda k, pos, rc, score, size="len": [F.col(size).alias(f"len{k}"), _contig(pos).alias(f"ref_id{k}"), _end(pos).alias(f"end{k}"), F.col(rc).alias(f"rc{k}"), F.col(score).alias(f"score{k}"), *([f"begin{k}", f"low{k}"])]
    paired = best.select("read_id", "total", "second_total", *place(1, "pos", "rc", "score"), *place(2, "o_pos", "o_rc", "o_score", "o_len"))

    def lone(k: int) -> DataFrame:
        mine = single.where(F.col("mate") == k).withColumnsRenamed({c: f"{c}{k}" for c in WINDOW})
        return mine.select("read_id", *place(k, "pos", "rc", "score"), F.col("second_score").alias(f"second{k}"))

    found = reduce.pairs_or_singles(paired, lone(1).join(lone(2), "read_id", "full_outer"), mixed=p.mixed)
    if not p.mixed:
        found = found.withColumns({f"second{k}": F.lit(None).cast("int") for k in (1, 2)})
    return pairs.select("read_id").join(_traced_pairs(found, side(1).withColumn("mate", F.lit(1)).unionByName(side(2).withColumn("mate", F.lit(2))), texts, p), "read_id", "left").withColumn("paired", F.coalesce("paired", F.lit(False)))


def _opposite(anchors: DataFrame, reads: DataFrame, texts: DataFrame, p: Parameters, first: bool) -> DataFrame:
    """Anchors with the other mate's score in the window that the fragment limits leave it: adds o_rc, o_len, text_from, score, text_end."""
    mate = anchors.join(_side(reads).withColumnRenamed("len", "o_len"), "read_id").join(texts.select("ref_id", F.col("seq").alias("ref_seq")), "ref_id")
    mate = mate.withColumn("_w", lookup.mate_window(F.col("end") - F.col("len"), F.col("len"), F.col("rc") == 1, F.col("o_len"), p.pe, F.lit(first), p.min_frag, p.max_frag))
    stop = F.least(F.col("_w.end"), F.length("ref_seq")).cast("int")
    mate = mate.withColumn("o_rc", F.col("_w.rc").cast("int")).withColumn("text_from", F.col("_w.begin").cast("int")).withColumn("text", F.substring("ref_seq", F.col("text_from") + 1, F.greatest(stop - F.col("text_from"), F.lit(0))))
    mate = _turned(mate, "o_rc").withColumn("least", p.scheme.threshold(F.col("o_len"))).drop("_w", "ref_seq")
    return align_score(mate, p.scheme, p.mode, min_score="least", **_with_quality(mate)).where("score is not null")


def _traced_pairs(found: DataFrame, mates: DataFrame, texts: DataFrame, p: Parameters) -> DataFrame:
    """Pairs or lone mates with the traceback and mapping quality of each mate."""
    pair, perfect, least = F.col("paired"), p.scheme.perfect, p.scheme.threshold

    def mate(k: int):
        size = F.col(f"len{k}")
        both = lambda f: F.when(pair, f(F.col("len1")) + f(F.col("len2"))).otherwise(f(size))
        place = (F.col(f"{c}{k}").alias(c) for c in ("ref_id", "begin", "end", "low", "rc"))
        return F.struct(F.lit(k).alias("mate"), *place, F.when(pair, F.col("total")).otherwise(F.col(f"score{k}")).alias("_best"), F.when(pair, F.col("second_total")).otherwise(F.col(f"second{k}")).alias("_second"), both(perfect).alias("_perfect"), both(least).alias("_least"))

    # a winner's row travels with its mates, so nothing before the traceback is planned twice
    at = found.select("read_id", F.struct(*(c for c in found.columns if c != "read_id")).alias("_f"), F.explode(F.array(mate(1), mate(2))).alias("_m")).select("read_id", "_f", "_m.*").where("end is not null")
    quality = mapq(F.col("_best"), F.col("_second"), F.col("_perfect"), F.col("_least"), p.scheme.monotone)
    one = F.struct("pos", "mapq", *TRACED)
    rows = traced(at, mates, texts, p, ("read_id", "mate")).withColumn("mapq", quality)
    wide = rows.groupBy("read_id").agg(F.any_value("_f").alias("_f"), *(F.max(F.when(F.col("mate") == k, one)).alias(f"_t{k}") for k in (1, 2)))
    columns = lambda k: [f"_f.ref_id{k}", f"_t{k}.pos", f"_f.end{k}", f"_f.rc{k}", f"_f.score{k}", *(f"_t{k}.{c}" for c in ("mapq", *TRACED))]
    named = lambda k: [F.col(c).alias(c.split(".")[1].rstrip("12") + str(k)) for c in columns(k)]
    return wide.select("read_id", "_f.paired", "_f.total", *named(1), *named(2))


def pair_records(aligned: DataFrame, pairs: DataFrame, contigs: DataFrame, name: str = "read_id") -> DataFrame:
    """Two SAM rows a pair, with flags, the mate's place and the template length; ``contigs`` (ref_id, name)."""
    met = aligned.join(pairs, "read_id")
    for k in (1, 2):
        met = met.join(contigs.select(F.col("ref_id").alias(f"ref_id{k}"), F.col("name").alias(f"_ref{k}")), f"ref_id{k}", "left")

    def row(k: int, o: int):
        mapped, other = F.col(f"pos{k}").isNotNull(), F.col(f"pos{o}").isNotNull()
        back = F.coalesce(F.col(f"rc{k}") == 1, F.lit(False))
        flag = sam.flags(F.lit(k - 1), mapped, back, F.lit(True), F.col("paired"), other, F.coalesce(F.col(f"rc{o}") == 1, F.lit(False)))
        same = F.coalesce(F.col(f"ref_id{k}") == F.col(f"ref_id{o}"), F.lit(False))
        size = sam.template_length(F.col(f"pos{k}"), F.col(f"end{k}"), F.col(f"pos{o}"), F.col(f"end{o}"), same, mapped & other)
        seq = F.when(back, reverse_complement(F.col(f"seq{k}"))).otherwise(F.col(f"seq{k}"))
        return F.struct(
            F.col(name).cast("string").alias("qname"), flag.alias("flag"), F.coalesce(f"_ref{k}", F.lit("*")).alias("rname"), F.coalesce(F.col(f"pos{k}") + 1, F.lit(0)).alias("pos"), F.coalesce(f"mapq{k}", F.lit(0)).alias("mapq"),
            F.coalesce(f"cigar{k}", F.lit("*")).alias("cigar"), sam.mate_reference(F.col(f"_ref{k}"), F.col(f"_ref{o}"), other).alias("rnext"), F.coalesce(F.col(f"pos{o}") + 1, F.lit(0)).alias("pnext"), size.cast("int").alias("tlen"), seq.alias("seq"), _quality_text(met, f"qual{k}", back).alias("qual"),
            F.col(f"ed{k}").alias("NM"), F.col(f"score{k}").alias("AS"), F.lit(None).cast("int").alias("XS"), F.col(f"n_mm{k}").alias("XM"), F.col(f"n_gapo{k}").alias("XO"), F.col(f"n_gape{k}").alias("XG"), F.col(f"md{k}").alias("MD"),
        )

    return met.select(F.explode(F.array(row(1, 2), row(2, 1))).alias("_r")).select("_r.*")


def _quality_text(df: DataFrame, column: str, back):
    """Phred values as a quality string in the direction of the record; * without any."""
    if column not in df.columns:
        return F.lit("*")
    text = lambda q: F.array_join(F.transform(q, lambda v: F.char(v + 33)), "")
    out = F.when(back, text(F.reverse(column))).otherwise(text(F.col(column)))
    return F.when(F.coalesce(F.length(out), F.lit(0)) > 0, out).otherwise(F.lit("*"))


def records(aligned: DataFrame, reads: DataFrame, contigs: DataFrame, name: str = "read_id") -> DataFrame:
    """Alignments as SAM columns with tags; ``contigs`` (ref_id, name)."""
    met = aligned.join(reads.select("read_id", "seq", *(c for c in ("qual",) if c in reads.columns)), "read_id").join(contigs.select("ref_id", F.col("name").alias("_ref")), "ref_id", "left")
    gone = F.col("pos").isNull()
    flag = sam.flags(F.lit(0), ~gone, F.coalesce(F.col("rc") == 1, F.lit(False)), F.lit(False), F.lit(False), F.lit(False), F.lit(False))
    seq = F.when(F.col("rc") == 1, reverse_complement(F.col("seq"))).otherwise(F.col("seq"))
    return met.select(
        F.col(name).cast("string").alias("qname"), flag.alias("flag"), F.coalesce("_ref", F.lit("*")).alias("rname"), F.coalesce(F.col("pos") + 1, F.lit(0)).alias("pos"), F.coalesce("mapq", F.lit(0)).alias("mapq"),
        F.coalesce("cigar", F.lit("*")).alias("cigar"), F.lit("*").alias("rnext"), F.lit(0).alias("pnext"), F.lit(0).alias("tlen"), seq.alias("seq"), _quality_text(met, "qual", F.coalesce(F.col("rc") == 1, F.lit(False))).alias("qual"),
        F.col("ed").alias("NM"), F.col("score").alias("AS"), F.col("second_score").alias("XS"), F.col("n_mm").alias("XM"), F.col("n_gapo").alias("XO"), F.col("n_gape").alias("XG"), F.col("md").alias("MD"),
    )


def seed_vote(reads: DataFrame, texts: DataFrame, k: int = 16, interval: int = 15) -> DataFrame:
    """The flagship plan in built-in operators only: the place of each read with most exact seeds, and its Hamming distance there."""
    places = lookup.seed_diagonals(lookup.map_exact(reads, texts, k, interval))
    best = top_k(places, ["read_id"], [F.desc("n_seeds"), F.col("ref_id"), F.col("pos"), F.col("rc")], 1).drop("rank")
    met = best.join(reads.select("read_id", F.col("seq").alias("_q"), "len"), "read_id").join(texts.select("ref_id", F.col("seq").alias("_t")), "ref_id")
    q = F.when(F.col("rc") == 1, reverse_complement(F.col("_q"))).otherwise(F.col("_q"))
    begin = F.greatest(F.col("pos"), F.lit(0))
    skip = begin - F.col("pos")
    t = F.substring("_t", begin + 1, F.col("len") - skip)
    part = F.substring(q, skip + 1, F.length(t))
    return met.select("read_id", "ref_id", "rc", "pos", "n_seeds", lookup.hamming(part, t).alias("mismatches"), F.length(t).alias("compared"))


EDIT_PARAMETERS = Parameters(scheme=EDIT)

"""Alignment-record functions: flags, coordinates, CIGAR and MD strings, predicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: flag bits of the alignment format
PAIRED, PROPER, UNMAPPED, MATE_UNMAPPED, REVERSE, MATE_REVERSE, READ1, READ2, SECONDARY = 1, 2, 4, 8, 16, 32, 64, 128, 256
CIGAR_TYPE = "array<struct<op:string,len:int>>"


def has(flag: Column, bit: int) -> Column:
    return flag.bitwiseAND(F.lit(bit)) != 0


def flags(mate: Column, mapped: Column, rc: Column, paired: Column, concordant: Column, mate_mapped: Column, mate_rc: Column) -> Column:
    """Composed flag.  Single-end reads carry the first-read bit too, as the record writer does."""
    on = lambda cond, bit: F.when(F.coalesce(cond, F.lit(False)), bit).otherwise(0)
    parts = [
        F.when(mate == 0, READ1).otherwise(READ2), on(paired, PAIRED), on(paired & mapped & concordant, PROPER), on(~mapped, UNMAPPED), on(mapped & rc, REVERSE),
        on(paired & ~mate_mapped, MATE_UNMAPPED), on(paired & mate_mapped & mate_rc, MATE_REVERSE),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.bitwiseOR(p)
    return out.cast("int")


def contig_coordinates(df: DataFrame, contigs: DataFrame, pos: str, span: Column) -> DataFrame:
    """Global positions as contig coordinates: adds ref_id, ref_name, ref_pos (1-based), crosses (spans a contig's end).

    ``contigs`` (ref_id, name, offset, len) are cut into blocks of 2**16 positions, so the range join is an
    equi-join on the block and a filter; no side is broadcast unless it is small.
    """
    shift = 16
    c = contigs.where("len > 0").select("ref_id", F.col("name").alias("ref_name"), F.col("offset").alias("_o"), F.col("len").alias("_n"))
    c = c.withColumn("_b", F.explode(F.sequence(F.shiftright(F.col("_o"), shift), F.shiftright(F.col("_o") + F.col("_n") - 1, shift))))
    at = df.withColumn("_p", F.shiftright(F.col(pos), shift))
    met = at.join(c, (F.col("_p") == F.col("_b")) & (F.col(pos) >= F.col("_o")) & (F.col(pos) < F.col("_o") + F.col("_n")), "left")
    met = met.withColumn("ref_pos", F.col(pos) - F.col("_o") + 1).withColumn("crosses", F.col(pos) + span > F.col("_o") + F.col("_n"))
    return met.drop("_o", "_n", "_b", "_p")


def template_length(start: Column, end: Column, mate_start: Column, mate_end: Column, same_contig: Column, both: Column) -> Column:
    """Outer distance of the mates, negative if the mate starts first; 0 on other contigs or without a mate."""
    size = F.greatest(end, mate_end) - F.least(start, mate_start)
    return F.when(both & same_contig, F.when(mate_start < start, -size).otherwise(size)).otherwise(F.lit(0))


def mate_reference(ref: Column, mate_ref: Column, mate_mapped: Column) -> Column:
    return F.when(mate_mapped, F.when(ref == mate_ref, "=").otherwise(mate_ref)).otherwise("*")


# --- CIGAR ------------------------------------------------------------------------------------------------------------


def parse_cigar(text: Column) -> Column:
    runs = F.regexp_extract_all(text, F.lit("([0-9]+[MIDNSHP=X])"), F.lit(1))
    return F.transform(runs, lambda r: F.struct(F.substring(r, -1, 1).alias("op"), F.regexp_extract(r, "[0-9]+", 0).cast("int").alias("len")))


def cigar_text(ops: Column, backwards: bool = False) -> Column:
    """Rendered runs; ``backwards`` for runs stored end to start."""
    return F.array_join(F.transform(F.reverse(ops) if backwards else ops, lambda r: F.concat(r["len"].cast("string"), r["op"])), "")


def cigar_sum(ops: Column, kinds: str) -> Column:
    return F.aggregate(F.filter(ops, lambda r: F.contains(F.lit(kinds), r["op"])), F.lit(0), lambda a, r: a + r["len"])


def reference_length(ops: Column) -> Column:
    return cigar_sum(ops, "MDN=X")


def read_length(ops: Column) -> Column:
    return cigar_sum(ops, "MIS=X")


def runs_of(ops: Column) -> Column:
    """Run lengths of a string of single operations, 'MMDM' to 2M1D1M."""
    return F.array_join(F.transform(F.regexp_extract_all(ops, F.lit(r"((.)\2*)"), F.lit(1)), lambda r: F.concat(F.length(r).cast("string"), F.substring(r, 1, 1))), "")


def cigar_summary(ops: Column) -> Column:
    """Counts of the comparison tool: mismatches (X), substituted or matched symbols (M, X, =), insertions, deletions."""
    return F.struct(cigar_sum(ops, "X").alias("n_mm"), cigar_sum(ops, "MX=").alias("subs"), cigar_sum(ops, "I").alias("ins"), cigar_sum(ops, "D").alias("dels"))


def md_mismatches(md: Column) -> Column:
    """Letters outside the ``^`` deletion runs."""
    return F.length(F.regexp_replace(F.regexp_replace(md, r"\^[A-Za-z]+", ""), "[^A-Za-z]", ""))


# --- predicates -------------------------------------------------------------------------------------------------------


def distinct_alignments(pos1: Column, rc1: Column, pos2: Column, rc2: Column, dist: Column) -> Column:
    """Another strand, or further apart than ``dist``."""
    return (rc1 != rc2) | (F.abs(pos1 - pos2) > dist)


def distinct_pairs(p1: Column, r1: Column, o1: Column, s1: Column, p2: Column, r2: Column, o2: Column, s2: Column, dist: Column, o_dist: Column) -> Column:
    """Pairs are the same only if both mates are."""
    return distinct_alignments(p1, r1, p2, r2, dist) | distinct_alignments(o1, s1, o2, s2, o_dist)


def is_mapped(flag: Column, pos: Column) -> Column:
    return ~has(flag, UNMAPPED) & (pos != 0)


def is_unique(has_second: Column) -> Column:
    return ~has_second


def is_ambiguous(has_second: Column, score: Column, second: Column) -> Column:
    return has_second & (score == second)


def distant(pos1: Column, pos2: Column, length: Column) -> Column:
    return F.abs(pos1 - pos2) > length

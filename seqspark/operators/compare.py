"""Comparison of two alignment tables and statistics of one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sam import distant, is_ambiguous, is_mapped
from ..functions.symbols import log_bin

#: The compared measures: column of a record, whether higher is better, whether differences are binned by logarithm.
MEASURES = {
    "score": ("score", True, False), "ed": ("ed", False, False), "mapq": ("mapq", True, False), "mapped": ("mapped_bases", True, True), "pos": ("pos", True, True),
    "subs": ("subs", False, False), "ins": ("ins", False, False), "dels": ("dels", False, False), "mms": ("n_mm", False, False),
}


def prepare(side: DataFrame) -> DataFrame:
    """Records with mapped, unique, ambiguous and mapped_bases."""
    mapped = is_mapped(F.col("flag"), F.col("pos"))
    return side.withColumn("mapped", mapped).withColumn("unique", mapped & ~F.col("has_second")).withColumn("ambiguous", mapped & is_ambiguous(F.col("has_second"), F.col("score"), F.col("sec_score"))).withColumn("mapped_bases", F.col("subs") + F.col("ins"))


def contingency(both: DataFrame, column: str) -> DataFrame:
    """One row: counts on the left, on the right, only left, only right, on both, and the mean share of left and right."""
    left, right = (F.coalesce(F.col(f"{s}_{column}"), F.lit(False)) for s in "lr")
    n = lambda c: F.count_if(c)
    return both.where("matched").agg(
        n(left).alias("n_left"), n(right).alias("n_right"), n(left & ~right).alias("only_left"), n(~left & right).alias("only_right"), n(left & right).alias("n_both"),
        ((n(left) + n(right)) / F.nullif(2 * F.count("*"), F.lit(0))).alias("average"),
    )


def histogram(df: DataFrame, value: Column, half: int) -> DataFrame:
    """(bin, n): values clamped to -half .. half - 1."""
    return df.groupBy(F.greatest(F.least(value, F.lit(half - 1)), F.lit(-half)).alias("bin")).agg(F.count("*").alias("n"))


def cumulative(hist: DataFrame, backwards: bool = False) -> DataFrame:
    """(bin, n, upto): sums from one end.  One row a bin, so one task is enough."""
    order = F.col("bin").desc() if backwards else F.col("bin").asc()
    return hist.withColumn("upto", F.sum("n").over(Window.orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)))


def histogram2d(df: DataFrame, x: Column, y: Column, half_x: int, half_y: int) -> DataFrame:
    clamp = lambda v, h: F.greatest(F.least(v, F.lit(h - 1)), F.lit(-h))
    return df.groupBy(clamp(x, half_x).alias("x"), clamp(y, half_y).alias("y")).agg(F.count("*").alias("n"))


def measure_rows(both: DataFrame) -> DataFrame:
    """(read_id, mate, measure, diff, bin, better): a row for each measure of each record pair mapped on both sides."""
    rows = []
    for name, (column, high, log) in MEASURES.items():
        diff = (F.col(f"l_{column}") - F.col(f"r_{column}")).cast("long")
        better = F.when(diff == 0, "both").when((diff > 0) == F.lit(high), "left").otherwise("right")
        rows.append(F.struct(F.lit(name).alias("measure"), diff.alias("diff"), (log_bin(diff) if log else diff).cast("long").alias("bin"), better.alias("better")))
    mapped = both.where(F.col("matched") & F.col("l_mapped") & F.col("r_mapped"))
    away = distant(F.col("l_pos"), F.col("r_pos"), F.col("l_read_len")) | (F.col("l_ref_id") != F.col("r_ref_id"))
    discord = (F.col("l_flag").bitwiseAND(F.lit(16))) != (F.col("r_flag").bitwiseAND(F.lit(16)))
    out = mapped.select("read_id", "mate", away.alias("distant"), discord.alias("discordant"), F.explode(F.array(*rows)).alias("_m"))
    return out.select("read_id", "mate", "distant", "discordant", "_m.*")


def measure_statistics(rows: DataFrame) -> DataFrame:
    """(subset, measure, n, left_better, right_better, sum_diff): all pairs, distant ones, discordant ones, in one pass."""
    subsets = F.explode(F.filter(F.array(F.lit("all"), F.when(F.col("distant"), "distant"), F.when(F.col("discordant"), "discordant")), lambda s: s.isNotNull()))
    side = lambda s: F.count_if(F.col("better").isin(s, "both"))
    return rows.withColumn("subset", subsets).groupBy("subset", "measure").agg(F.count("*").alias("n"), side("left").alias("left_better"), side("right").alias("right_better"), F.sum("diff").alias("sum_diff"))


def pair_breakdown(pairs: DataFrame) -> DataFrame:
    """One row of counts of pairs with both mates mapped on both sides: (l|r)(1|2)_(ref_id|pos|rc), len1, len2.

    Precedence: other contig (both mates, first, second), then distant (both, first, second); discordant strands
    are counted on their own, each pair once.
    """
    ref = [F.col(f"l{k}_ref_id") != F.col(f"r{k}_ref_id") for k in (1, 2)]
    far = [distant(F.col(f"l{k}_pos"), F.col(f"r{k}_pos"), F.col(f"len{k}")) for k in (1, 2)]
    rc = [F.col(f"l{k}_rc") != F.col(f"r{k}_rc") for k in (1, 2)]
    kind = F.when(ref[0] & ref[1], "ref_both").when(ref[0], "ref_1").when(ref[1], "ref_2").when(far[0] & far[1], "far_both").when(far[0], "far_1").when(far[1], "far_2").otherwise("same")
    turn = F.when(rc[0] & rc[1], "both").when(rc[0], "1").when(rc[1], "2")
    names = ("ref_both", "ref_1", "ref_2", "far_both", "far_1", "far_2", "same")
    return pairs.withColumn("_k", kind).withColumn("_t", turn).agg(F.count("*").alias("n"), *(F.count_if(F.col("_k") == k).alias(k) for k in names), *(F.count_if(F.coalesce(F.col("_t") == t, F.lit(False))).alias(f"discordant_{t}") for t in ("both", "1", "2")))


def measure_histograms(rows: DataFrame) -> DataFrame:
    """(measure, side, bin, n): differences of the pairs in which a side is as good or better, binned by size as the measure says."""
    side = F.explode(F.filter(F.array(F.when(F.col("better").isin("left", "both"), "left"), F.when(F.col("better").isin("right", "both"), "right")), lambda s: s.isNotNull()))
    return rows.withColumn("side", side).groupBy("measure", "side", F.abs("bin").alias("bin")).agg(F.count("*").alias("n"))


def pair_histograms(pairs: DataFrame) -> DataFrame:
    """(kind, subset, mapq_bin, n): pairs on other contigs or distant, by the right side's mapping quality.

    ``subset`` is all, unique (no second on either side) or not_ambiguous (no equal second on either side).  Reads
    the columns of :func:`pair_breakdown` and mapq, l_unique, r_unique, l_ambiguous, r_ambiguous.  Pairs on other
    contigs count as distant too.
    """
    ref = [F.col(f"l{k}_ref_id") != F.col(f"r{k}_ref_id") for k in (1, 2)]
    far = [distant(F.col(f"l{k}_pos"), F.col(f"r{k}_pos"), F.col(f"len{k}")) for k in (1, 2)]
    kinds = F.when(ref[0] | ref[1], F.array(F.lit("different_ref"), F.lit("distant"))).when(far[0] | far[1], F.array(F.lit("distant"))).otherwise(F.array().cast("array<string>"))
    subsets = F.array(F.lit("all"), F.when(F.col("l_unique") & F.col("r_unique"), "unique"), F.when(~F.col("l_ambiguous") & ~F.col("r_ambiguous"), "not_ambiguous"))
    rows = pairs.select(F.explode(kinds).alias("kind"), F.filter(subsets, lambda s: s.isNotNull()).alias("_s"), log_bin(F.col("mapq")).alias("mapq_bin"))
    return rows.select("kind", F.explode("_s").alias("subset"), "mapq_bin").groupBy("kind", "subset", "mapq_bin").agg(F.count("*").alias("n"))


def output_statistics(records: DataFrame) -> DataFrame:
    """One row: reads, mapped, unique (no second), multiple, ambiguous (equal second), unambiguous."""
    mapped = F.col("score").isNotNull()
    second = F.col("second_score").isNotNull()
    tie = F.coalesce(F.col("score") == F.col("second_score"), F.lit(False))
    return records.agg(F.count("*").alias("n_reads"), F.count_if(mapped).alias("n_mapped"), F.count_if(mapped & ~second).alias("n_unique"), F.count_if(mapped & second).alias("n_multiple"), F.count_if(mapped & second & tie).alias("n_ambiguous"), F.count_if(mapped & second & ~tie).alias("n_unambiguous"))


def value_histograms(records: DataFrame, columns: list[str]) -> DataFrame:
    """(name, value, n) of several columns in one aggregation."""
    rows = F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).cast("long").alias("value")) for c in columns)))
    return records.select(rows.alias("_v")).select("_v.*").groupBy("name", "value").agg(F.count("*").alias("n"))


def checksum(df: DataFrame, columns: list[Column], modulus: int = 1_000_003) -> DataFrame:
    """Order-independent check value: the sum of a polynomial of each row modulo a prime."""
    row = F.lit(0).cast("long")
    for c in columns:
        row = F.pmod(row * 31 + F.pmod(c.cast("long"), F.lit(modulus)), F.lit(modulus))
    return df.agg(F.count("*").alias("n"), F.sum(row).alias("check"))


def all_any(df: DataFrame, condition: Column) -> DataFrame:
    return df.agg(F.every(condition).alias("all"), F.some(condition).alias("any"), F.count_if(condition).alias("n"))

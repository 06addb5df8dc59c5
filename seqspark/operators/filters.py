"""Read, seed, hit and record filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.symbols import count_symbol

MIN_READ_LENGTH = 12


def no_unknown(seed: Column) -> Column:
    """Exact seeds hold no N."""
    return ~F.contains(seed, F.lit("N"))


def few_unknown(seed: Column, exact: int) -> Column:
    """No N in the first ``exact`` symbols and at most one in the rest."""
    return no_unknown(F.substring(seed, 1, exact)) & (count_symbol(F.substring(seed, exact + 1, 1 << 20), "N") <= 1)


def long_enough(length: Column, least: int = MIN_READ_LENGTH) -> Column:
    return length >= least


def guard_length(df: DataFrame, length: str, most: int) -> DataFrame:
    """Fails on an over-long read instead of cutting it."""
    checked = F.assert_true(F.col(length) <= most, F.concat(F.lit("read longer than "), F.lit(str(most))))
    return df.where(F.coalesce(checked.cast("boolean"), F.lit(True)))


def second_best(df: DataFrame) -> DataFrame:
    return df.where("second_score is not null")


def needs_reseed(range_count: Column, range_sum: Column, rep_seeds: int = 1000) -> Column:
    """No ranges, or an average range of at least ``rep_seeds``."""
    return (range_count == 0) | (range_sum >= rep_seeds * range_count)


def still_active(second_score: Column, max_dist: int) -> Column:
    """Reads stay active unless their second best is within the search bound."""
    return second_score.isNull() | (-second_score > max_dist)


def unseen_locations(hits: DataFrame) -> DataFrame:
    """One row for each (read, strand, position): a shuffle on those keys only."""
    return hits.dropDuplicates(["read_id", "rc", "pos"])


def above_threshold(score: Column, least: Column) -> Column:
    return score >= least


def valid_anchors(hits: DataFrame) -> DataFrame:
    return hits.where("anchor_score is not null")


def passes_mapq(mapq: Column, mapped: Column, least: int) -> Column:
    """Otherwise the record is written as unmapped."""
    return mapped & (mapq >= least)


def diff_filter(flags: Column, stats: Column, delta: Column, want_flags: int, want_stats: int, limit: int) -> Column:
    """Rows that share a flag and a statistic with the wanted masks and whose delta passes a signed limit."""
    passed = (delta >= limit) if limit > 0 else (delta <= limit)
    return (flags.bitwiseAND(F.lit(want_flags)) != 0) & (stats.bitwiseAND(F.lit(want_stats)) != 0) & passed


def lower_bound(values: Column, x: Column) -> Column:
    """0-based place of the first element of a sorted array that isn't below x."""
    return F.size(F.filter(values, lambda v: v < x))


def upper_bound(values: Column, x: Column) -> Column:
    return F.size(F.filter(values, lambda v: v <= x))


def find_pivot(values: Column, predicate) -> Column:
    """0-based place of the first element for which a monotone predicate holds; the size if none does."""
    return F.size(values) - F.size(F.filter(values, predicate))

"""Scoring schemes, cost and score-threshold functions, gap budgets and mapping quality."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from .symbols import phred_to_maq

# --- costs and thresholds ---------------------------------------------------------------------------------------------


def rounded_quality_cost(q: Column) -> Column:
    return phred_to_maq(q)


def quality_cost(q: Column, low: int, high: int) -> Column:
    """low + int(min(q, 40) / 40 * (high - low)), in single precision."""
    share = (F.least(q, F.lit(40)).cast("float") / F.lit(40.0).cast("float")).cast("float")
    return F.lit(low) + (share * F.lit(float(high - low)).cast("float")).cast("float").cast("int")


def min_score(length: Column, const: float, coeff: float, log: bool = False) -> Column:
    """int(const + coeff * x) with x the length or its natural logarithm, in single precision; truncates toward zero."""
    single = lambda c: c.cast("float")
    x = single(F.log(length.cast("double"))) if log else single(length)
    return single(single(F.lit(const)) + single(single(F.lit(coeff)) * x)).cast("int")


def gap_budget(length: Column, best: Column, least: Column, extend: int, first: int | None = None) -> Column:
    """How many gap symbols a score can afford: gaps are taken until the score falls below ``least``, and the last is given back.

    ``extend`` and ``first`` (cost of a first symbol, default the same) are negative.  0 if even the best score is too low.
    """
    first = extend if first is None else first
    left = best - least
    # smallest n whose gaps cost more than what is left
    n = F.when(left + first < 0, 1).otherwise(F.floor((left + first) / F.lit(-extend)) + 2)
    return F.when(best < least, 0).otherwise(F.least(n, length) - 1).cast("int")


def band_length(max_dist: int) -> int:
    """The smallest 2**k - 1, k at least 2, that holds 2 * max_dist + 1."""
    size = 3
    while size < 2 * max_dist + 1:
        size = 2 * size + 1
    return size


# --- schemes ----------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Scheme:
    """Costs of an aligner.  Gap values are penalties already negated; ``open`` covers a gap's first symbol."""

    match: int = 0
    mismatch_min: int = -2
    mismatch_max: int = -6
    n_penalty: int = -1
    text_open: int = -8
    text_extend: int = -3
    pattern_open: int = -8
    pattern_extend: int = -3
    min_const: float = -0.6
    min_coeff: float = -0.6
    min_log: bool = False
    affine: bool = True

    @property
    def monotone(self) -> bool:
        return self.match == 0

    def perfect(self, length):
        return length * self.match

    def threshold(self, length: Column) -> Column:
        return min_score(length, self.min_const, self.min_coeff, self.min_log)

    def mismatch(self, qual: np.ndarray | None) -> np.ndarray | int:
        """By base quality if there is one, otherwise the largest penalty."""
        if qual is None:
            return self.mismatch_max
        share = (np.minimum(qual, 40) / np.float32(40)).astype(np.float32)
        return self.mismatch_min - (share * np.float32(self.mismatch_min - self.mismatch_max)).astype(int)


def simple(match: int, mismatch: int, deletion: int, insertion: int) -> Scheme:
    """Linear gaps."""
    return Scheme(match, mismatch, mismatch, mismatch, deletion, deletion, insertion, insertion, affine=False)


def simple_affine(match: int, mismatch: int, gap_open: int, gap_extend: int) -> Scheme:
    return Scheme(match, mismatch, mismatch, mismatch, gap_open, gap_extend, gap_open, gap_extend)


EDIT = simple(0, -1, -1, -1)
# fixed values: the presets' options
OPTIONS = {
    "default": {},
    "local": {"match": "2", "score-min-const": "0.0", "score-min-coeff": "10.0", "score-min-type": "log"},
    "base1": {"match": "1", "mm-penalty-min": "3", "mm-penalty-max": "3", "N-penalty-min": "3", "N-penalty-max": "3", "score-min-const": "37.0", "score-min-coeff": "0.3", "read-gap-const": "11", "read-gap-coeff": "4", "ref-gap-const": "11", "ref-gap-coeff": "4"},
}


def from_options(options: dict[str, str]) -> Scheme:
    """A scheme from key/value options; missing ones take the default preset's values."""
    whole = lambda key, default: int(options.get(key, default))
    real = lambda key, default: float(str(options.get(key, default)).rstrip("f"))
    read_open, read_ext = whole("read-gap-const", 5), whole("read-gap-coeff", 3)
    ref_open, ref_ext = whole("ref-gap-const", 5), whole("ref-gap-coeff", 3)
    return Scheme(
        whole("match", 0), -whole("mm-penalty-min", 2), -whole("mm-penalty-max", 6), -whole("N-penalty-max", 1), -(ref_open + ref_ext), -ref_ext, -(read_open + read_ext), -read_ext,
        real("score-min-const", -0.6), real("score-min-coeff", -0.6), options.get("score-min-type", "linear") == "log",
    )


def preset(name: str) -> Scheme:
    return from_options(OPTIONS[name])


def from_file(path: str) -> Scheme:
    """``key value`` pairs separated by white space."""
    with open(path) as f:
        tokens = f.read().split()
    return from_options(dict(zip(tokens[::2], tokens[1::2], strict=False)))


# --- mapping quality --------------------------------------------------------------------------------------------------


def _ladder(value: Column, steps: list[tuple[Column, Column | int]], last: Column | int) -> Column:
    out = last if isinstance(last, Column) else F.lit(last)
    for bound, result in reversed(steps):
        out = F.when(value >= bound, result).otherwise(out)
    return out


@dataclass(frozen=True)
class MapqTable:
    """Fixed values of the second mapping-quality model, for one kind of scheme."""

    alone: tuple[int, ...]
    wide: tuple[tuple[int, int], ...]  # gap >= .9, .8, .7, .6: (full, not full)
    cuts: tuple[tuple[float, ...], ...]  # gap >= .5 .. .1: cuts of the best score
    near: tuple[tuple[int, ...], ...]  # full, then for each cut, then below
    last_cut: float
    least: tuple[int, int, int, int] = field(default=(6, 2, 1, 0))


# fixed values
MONOTONE = MapqTable(
    (42, 40, 24, 23, 8, 3, 0), ((39, 33), (38, 27), (37, 26), (36, 22)), ((0.84, 0.68), (0.84, 0.68), (0.88, 0.67), (0.88, 0.67), (0.88, 0.67)),
    ((35, 25, 16, 5), (34, 21, 14, 4), (32, 18, 15, 3), (31, 17, 11, 0), (30, 12, 7, 0)), 0.67, (6, 2, 1, 0),
)
LOCAL = MapqTable(
    (44, 42, 41, 36, 28, 24, 22), ((40, 40), (39, 39), (38, 38), (37, 37)), ((0.5,),) * 5,
    ((35, 25, 20), (34, 21, 19), (33, 18, 16), (32, 17, 12), (31, 14, 9)), 0.5, (11, 2, 1, 0),
)


def mapq(best: Column, second: Column, perfect: Column, least: Column, monotone: bool = True) -> Column:
    """Mapping quality from the best and second score (null: none), the perfect score and the threshold."""
    t = MONOTONE if monotone else LOCAL
    diff, over = (perfect - least).cast("float"), (best - least).cast("float")
    gap = F.abs(F.abs(best) - F.abs(second)).cast("float")
    part = lambda f: (diff * F.lit(f).cast("float")).cast("float")
    alone = _ladder(over, [(part(f), v) for f, v in zip((0.8, 0.7, 0.6, 0.5, 0.4, 0.3), t.alone, strict=False)], t.alone[6])
    full = over == diff
    steps: list = [(part(f), F.when(full, a).otherwise(b)) for f, (a, b) in zip((0.9, 0.8, 0.7, 0.6), t.wide, strict=True)]
    for f, cuts, values in zip((0.5, 0.4, 0.3, 0.2, 0.1), t.cuts, t.near, strict=True):
        steps.append((part(f), F.when(full, values[0]).otherwise(_ladder(over, [(part(c), v) for c, v in zip(cuts, values[1:], strict=False)], values[-1]))))
    high = over >= part(t.last_cut)
    two = _ladder(gap, steps, F.when(gap > 0, F.when(high, t.least[0]).otherwise(t.least[1])).otherwise(F.when(high, t.least[2]).otherwise(t.least[3])))
    return F.when(best < least, 0).when(second.isNull(), alone).otherwise(two).cast("int")


# fixed values: the table model's rows by score gap, columns by distance from the perfect score
TABLE_ALONE = (43, 42, 41, 36, 32, 27, 20, 11, 4, 1, 0)
TABLE_TWO = (
    (2, 2, 2, 1, 1, 0, 0, 0, 0, 0, 0), (20, 14, 7, 3, 2, 1, 0, 0, 0, 0, 0), (20, 16, 10, 6, 3, 1, 0, 0, 0, 0, 0), (20, 17, 13, 9, 3, 1, 1, 0, 0, 0, 0),
    (21, 19, 15, 9, 5, 2, 2, 0, 0, 0, 0), (22, 21, 16, 11, 10, 5, 0, 0, 0, 0, 0), (23, 22, 19, 16, 11, 0, 0, 0, 0, 0, 0), (24, 25, 21, 30, 0, 0, 0, 0, 0, 0, 0),
    (30, 26, 29, 0, 0, 0, 0, 0, 0, 0, 0), (30, 27, 0, 0, 0, 0, 0, 0, 0, 0, 0), (30, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0),
)
TABLE_PERFECT = (2, 16, 23, 30, 31, 32, 34, 36, 38, 40, 42)
PERFECT_ALONE = 44


def mapq_table(best: Column, second: Column, perfect: Column, least: Column, paired: Column | None = None) -> Column:
    """The table-based model: scores are binned to tenths of the range from threshold to perfect.

    A best score equal to the perfect one takes the perfect rows (by gap, if there is a second).
    """
    norm = F.lit(10.0) / (perfect - least).cast("double")
    bin_of = lambda x: F.least(F.greatest((x.cast("double") * norm + 0.5).cast("int"), F.lit(0)), F.lit(10))
    away = bin_of(F.greatest(perfect - best, F.lit(0)))
    gap = bin_of(best - second)
    pick = lambda values, i: F.element_at(F.array(*map(F.lit, values)), i + 1)
    flat = [v for row in TABLE_TWO for v in row]
    out = F.when(best < least, 0).when(second.isNull(), F.when(best == perfect, PERFECT_ALONE).otherwise(pick(TABLE_ALONE, away)))
    out = out.otherwise(F.when(best == perfect, pick(TABLE_PERFECT, gap)).otherwise(pick(flat, gap * 11 + away)))
    return out if paired is None else F.when(paired, PERFECT_ALONE).otherwise(out)

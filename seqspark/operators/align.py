"""Pairwise alignment scores and tracebacks as Arrow-batched functions over numpy anti-diagonals.

Edit distance, linear-gap and affine-gap aligners; global, local and semi-global (free text ends) modes; full or
banded.  A batch of pairs is scored together: a step handles one anti-diagonal of all pairs at once.  A band holds
the diagonals from ``low`` to ``low + band - 1`` (text place less pattern place) and only their cells are stored.

Rules: the pattern runs along j, the text along i.  Deletion consumes text, insertion consumes pattern.
Substitution wins ties against gaps; between gaps a full matrix prefers insertion, a banded one deletion.  A gap
is extended only if that is strictly better than opening it again.  Of equal scores the cell with the largest
text end, then pattern end, is reported.  Operations are returned start to end; ``ops_rev`` is end to start.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scoring import EDIT, Scheme

LOW = -(1 << 28)
MODES = ("global", "local", "semi_global")
MAX_CELLS = 1 << 22  # of a block of matrices
MAX_WIDTH = 1 << 18  # pairs times places of a block of scores: some arrays of four bytes each that a processor's cache holds
FULL = 1 << 40  # stands for the lowest diagonal of a pair that takes the full matrix


def _codes(strings: list[str], width: int, pad: int) -> np.ndarray:
    out = np.full((len(strings), width), pad, np.uint8)
    for i, s in enumerate(strings):
        b = np.frombuffer(s.encode("ascii", "replace"), np.uint8)
        out[i, : len(b)] = b
    return out


class Matrix:
    """The DP of a batch: H for every cell; with ``trace`` also the directions (0 stop, 1 substitution, 2 insertion, 3 deletion) and extension bits.

    Planes are laid out by text and pattern place, banded ones by diagonal and pattern place with an empty diagonal
    at either side.  Gap scores are kept for the last anti-diagonal only, by pattern place.
    """

    def __init__(self, patterns: list[str], texts: list[str], scheme: Scheme, mode: str, band: int | None = None, quals: list | None = None, trace: bool = False, low: int = 0):
        assert mode in MODES
        n = len(patterns)
        self.m, self.n = np.array([len(p) for p in patterns]), np.array([len(t) for t in texts])
        big_m, big_n = int(self.m.max(initial=0)), int(self.n.max(initial=0))
        p, t = _codes(patterns, big_m, 1), _codes(texts, big_n, 2)
        self.mode, self.band, self.low, self.scheme = mode, band, low, scheme
        ins = (scheme.pattern_open, scheme.pattern_extend)
        dele = (scheme.text_open, scheme.text_extend)
        miss = np.full((n, big_m), scheme.mismatch_max, np.int32)
        if quals is not None:
            for i, q in enumerate(quals):
                if q is not None:
                    miss[i, : len(q)] = scheme.mismatch(np.asarray(q))
        local = mode == "local"
        h = np.full((n, big_n + 1 if band is None else band + 2, big_m + 1), LOW, np.int32)
        e, f = np.full((n, big_m + 1), LOW, np.int32), np.full((n, big_m + 1), LOW, np.int32)  # ending in an insertion, in a deletion
        rows, cols = np.arange(big_n + 1), np.arange(big_m + 1)
        rows, cols = rows[self._inside(rows, 0)], cols[self._inside(0, cols)]
        first = lambda gap, k: np.where(k > 0, gap[0] + gap[1] * (k - 1), 0)
        h[:, *self._at(0 * cols, cols)] = 0 if local else first(ins, cols)
        h[:, *self._at(rows, 0 * rows)] = first(dele, rows)[None] if mode == "global" else 0
        self.dir = np.zeros(h.shape, np.uint8) if trace else None
        self.ext_e = np.zeros(h.shape, bool) if trace else None
        self.ext_f = np.zeros(h.shape, bool) if trace else None
        for d in range(2, big_n + big_m + 1):
            i = np.arange(max(1, d - big_m), min(big_n, d - 1) + 1)
            j = d - i
            ok = self._inside(i, j)
            i, j = i[ok], j[ok]
            if not len(i):
                continue
            here, left, top, before = self._at(i, j), self._at(i, j - 1), self._at(i - 1, j), self._at(i - 1, j - 1)
            same = (p[:, j - 1] == t[:, i - 1]) & (p[:, j - 1] != 78)
            unknown = (p[:, j - 1] == 78) | (t[:, i - 1] == 78)
            diag = h[:, *before] + np.where(same, scheme.match, np.where(unknown & (quals is not None), scheme.n_penalty, miss[:, j - 1]))
            left_open, left_ext = h[:, *left] + ins[0], np.where(self._inside(i, j - 1), e[:, j - 1], LOW) + ins[1]
            top_open, top_ext = h[:, *top] + dele[0], f[:, j] + dele[1]
            ext_e, ext_f = left_ext > left_open, top_ext > top_open
            ev, fv = np.maximum(left_open, left_ext), np.maximum(top_open, top_ext)
            best = np.maximum(np.maximum(diag, ev), fv)
            if local:
                best = np.maximum(best, 0)
            h[:, *here], e[:, j], f[:, j] = best, ev, fv
            if trace:
                gap = np.where(ev > fv, 2, np.where(fv > ev, 3, 2 if band is None else 3))
                to = np.where(diag >= np.maximum(ev, fv), 1, gap).astype(np.uint8)
                if local:
                    to[best == 0] = 0
                self.dir[:, *here], self.ext_e[:, *here], self.ext_f[:, *here] = to, ext_e, ext_f
        self.h = h

    def _inside(self, i, j):
        d = np.asarray(i - j)
        return np.ones(d.shape, bool) if self.band is None else (d >= self.low) & (d < self.low + self.band)

    def _at(self, i, j):
        return (i, j) if self.band is None else (i - j - self.low + 1, j)

    def sinks(self, count: int = 1, distinct: int = 0) -> list[list[tuple[int, int, int]]]:
        """For each pair its best (score, text end, pattern end), and with ``count`` 2 the best one more than ``distinct`` away in the text."""
        out = []
        for k in range(len(self.m)):
            m, n = int(self.m[k]), int(self.n[k])
            if self.mode == "global":
                cells = [(int(self.h[k, *self._at(n, m)]), n, m)] if self._inside(n, m) else []
            elif self.mode == "semi_global":
                ends = np.arange(0 if m == 0 else 1, n + 1)
                ends = ends[self._inside(ends, m)]
                cells = [(int(v), int(i), m) for v, i in zip(self.h[k, *self._at(ends, m)], ends, strict=True)]
            elif self.band is None:
                box = self.h[k, : n + 1, : m + 1]
                j = (m - box[:, ::-1].argmax(1)) if m else np.zeros(n + 1, int)
                cells = [(int(box[i, j[i]]), i, int(j[i])) for i in range(n + 1)]
            else:  # a text row's cells, largest pattern end first
                i = np.arange(n + 1)[:, None]
                j = i - self.low - np.arange(self.band)
                real = (j >= 0) & (j <= m)
                box = np.where(real, self.h[k, np.arange(self.band) + 1, np.clip(j, 0, m)], LOW)
                at = box.argmax(1)
                cells = [(int(box[r, c]), r, int(j[r, c])) for r, c in enumerate(at)]
            cells = [c for c in cells if c[0] > LOW // 2]
            found = [max(cells)] if cells else []
            if count > 1 and found:
                far = [c for c in cells if abs(c[1] - found[0][1]) > distinct]
                found += [max(far)] if far else []
            out.append(found)
        return out

    def trace(self, k: int, i: int, j: int) -> tuple[str, int, int]:
        """(operations end to start, text begin, pattern begin)."""
        ops, state = [], "h"
        while i > 0 and j > 0:
            at = self._at(i, j)
            if state == "h":
                to = self.dir[k, *at]
                if to == 0:
                    break
                if to == 1:
                    ops.append("M")
                    i, j = i - 1, j - 1
                    continue
                state = "e" if to == 2 else "f"
            if state == "e":
                ops.append("I")
                state = "e" if self.ext_e[k, *at] else "h"
                j -= 1
            else:
                ops.append("D")
                state = "f" if self.ext_f[k, *at] else "h"
                i -= 1
        if self.mode != "local":
            ops += ["I"] * j
            j = 0
            if self.mode == "global":
                ops += ["D"] * i
                i = 0
        return "".join(ops), i, j


def run_lengths(ops: str) -> str:
    out, at = [], 0
    for k in range(1, len(ops) + 1):
        if k == len(ops) or ops[k] != ops[at]:
            out.append(f"{k - at}{ops[at]}")
            at = k
    return "".join(out)


def describe(pattern: str, text: str, ops: str) -> tuple[str, int, int, int, int, int]:
    """(MD string, edit distance, mismatches, gap opens, gap extensions, matches) of forward ops over aligned parts; MD names the text's bases."""
    md, same, i, j = [], 0, 0, 0
    mm = opens = exts = matches = 0
    last = ""
    for op in ops:
        if op == "M":
            if pattern[j] == text[i]:
                same += 1
                matches += 1
            else:
                md.append(f"{same}{text[i]}")
                same, mm = 0, mm + 1
            i, j = i + 1, j + 1
        else:
            if op == last:
                exts += 1
            else:
                opens += 1
                if op == "D":
                    md.append(f"{same}^")
                    same = 0
            if op == "D":
                md.append(text[i])
                i += 1
            else:
                j += 1
        last = op
    return "".join(md) + str(same), mm + opens + exts, mm, opens, exts, matches


def last_row(patterns: list[str], texts: list[str], scheme: Scheme, band: int | None = None, quals: list | None = None, low: int = 0) -> np.ndarray:
    """Semi-global scores (text end, pair) at the whole pattern, those of :class:`Matrix`, LOW elsewhere; patterns aren't empty.

    Only the last anti-diagonals are held, by pattern place and pair, so a step works on plain slices.
    """
    m, n = np.array([len(p) for p in patterns]), np.array([len(t) for t in texts])
    big_m, big_n, least = int(m.max()), int(n.max()), int(m.min())
    p, t = np.ascontiguousarray(_codes(patterns, big_m, 1).T), np.ascontiguousarray(_codes(texts, big_n, 2).T)
    (ins0, ins1), (del0, del1) = (scheme.pattern_open, scheme.pattern_extend), (scheme.text_open, scheme.text_extend)
    miss = np.full((big_m, len(m)), scheme.mismatch_max, np.int32) if quals is not None else None
    for i, q in enumerate(quals or []):
        if q is not None:
            miss[: len(q), i] = scheme.mismatch(np.asarray(q))
    some_n = bool((p == 78).any() or (t == 78).any())
    inside = lambda i, j: band is None or low <= i - j < low + band
    h, e, f = (np.full((size, big_m + 2, len(m)), LOW, np.int32) for size in (3, 2, 2))
    out = np.full((big_n + 1, len(m)), LOW, np.int32)
    if inside(0, 0):
        h[0, 0] = 0
    for d in range(1, big_n + big_m + 1):
        now, last, before = h[d % 3], h[(d - 1) % 3], h[(d - 2) % 3]
        e_now, e_last, f_now, f_last = e[d % 2], e[(d - 1) % 2], f[d % 2], f[(d - 1) % 2]
        lo, hi = max(1, d - big_n), min(big_m, d - 1)
        if band is not None:  # low <= d - 2 j < low + band
            lo, hi = max(lo, (d - low - band) // 2 + 1), min(hi, (d - low) // 2)
        if lo > hi:
            now.fill(LOW), e_now.fill(LOW), f_now.fill(LOW)
        else:
            here, left = slice(lo, hi + 1), slice(lo - 1, hi)
            a, b = p[left], t[d - hi - 1 : d - lo][::-1]
            same = a == b
            worse = scheme.mismatch_max if miss is None else miss[left]
            if some_n:
                same &= a != 78
                if miss is not None:
                    worse = np.where((a == 78) | (b == 78), scheme.n_penalty, worse)
            diag = np.where(same, np.int32(scheme.match), worse if miss is not None else np.int32(worse))
            diag += before[left]
            np.maximum(last[left] + np.int32(ins0), e_last[left] + np.int32(ins1), out=e_now[here])
            np.maximum(last[here] + np.int32(del0), f_last[here] + np.int32(del1), out=f_now[here])
            np.maximum(diag, e_now[here], out=diag)
            np.maximum(diag, f_now[here], out=now[here])
            now[lo - 1] = now[hi + 1] = e_now[lo - 1] = f_now[hi + 1] = LOW
            if hi >= least:
                at = np.flatnonzero((m >= lo) & (m <= hi) & (d - m <= n))
                out[d - m[at], at] = now[m[at], at]
        if d <= big_n and inside(d, 0):
            now[0] = 0
        if d <= big_m and inside(0, d):
            now[d] = ins0 + ins1 * (d - 1)
    return out


def best_ends(rows: np.ndarray, distinct: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(score, text end) of each pair's best end, then of the best more than ``distinct`` away; scores are LOW where there is none.  Changes ``rows``."""
    ends = np.arange(len(rows))[:, None]
    for _ in range(2):
        end = len(rows) - 1 - rows[::-1].argmax(0)
        score = rows.max(0)
        yield np.where(score > LOW // 2, score, LOW), end
        rows[abs(ends - end) <= distinct] = LOW


def _blocks(order: np.ndarray, cells: np.ndarray, low: np.ndarray, most: int = MAX_CELLS) -> Iterator[np.ndarray]:
    """Pairs of like size and one lowest diagonal together, as many as fit ``most`` cells."""
    start = 0
    while start < len(order):
        end = start + 1
        while end < len(order) and low[order[end]] == low[order[start]] and cells[order[end]] * (end + 1 - start) <= most:
            end += 1
        yield order[start:end]
        start = end


SCORE_FIELDS = "score int, text_end int, pattern_end int, second_score int, second_end int"
TRACE_FIELDS = "score int, text_begin int, text_end int, pattern_begin int, pattern_end int, cigar string, ops_rev string, md string, ed int, n_mm int, n_gapo int, n_gape int"


def _aligner(scheme: Scheme, mode: str, band: int | None, with_trace: bool, pattern: str, text: str, qual: str | None, min_score: str | None, distinct: int, drop: tuple[str, ...], low: str | None = None):
    fields = [f.split()[0] for f in (TRACE_FIELDS if with_trace else SCORE_FIELDS).split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ps, ts = b[pattern].tolist(), b[text].tolist()
            known = np.array([p is not None and t is not None for p, t in zip(ps, ts, strict=True)], bool)
            lows = b[low].fillna(FULL).to_numpy(np.int64) if low else np.zeros(len(b), np.int64)
            if band is None:
                lows[:] = FULL
            cells = np.array([(len(p or "") + 1) * (len(t or "") + 1 if at == FULL else band + 2) for p, t, at in zip(ps, ts, lows, strict=True)], np.int64)
            out: list = [(None,) * len(fields)] * len(b)
            order = np.flatnonzero(known)
            order = order[np.lexsort((cells[order], lows[order]))]
            least = b[min_score].tolist() if min_score else None
            if mode == "semi_global" and not with_trace:
                width = np.array([max(len(p or ""), len(t or "")) + 2 for p, t in zip(ps, ts, strict=True)], np.int64)
                fast = np.array([bool(ps[k]) for k in order], bool)
                of = order[fast]
                for block in _blocks(of[np.lexsort((width[of], lows[of]))], width, lows, MAX_WIDTH):
                    quals = [b[qual].iloc[k] for k in block] if qual else None
                    rows = last_row([ps[k] for k in block], [ts[k] for k in block], scheme, None if lows[block[0]] == FULL else band, quals, int(lows[block[0]]))
                    (best, end), (second, second_end) = (tuple(x.tolist() for x in found) for found in best_ends(rows, distinct))
                    for at, k in enumerate(block):
                        if best[at] > LOW and (least is None or best[at] >= least[k]):
                            out[k] = (best[at], end[at], len(ps[k]), *((second[at], second_end[at]) if second[at] > LOW else (None, None)))
                order = order[~fast]
            for block in _blocks(order, cells, lows):
                quals = [b[qual].iloc[k] for k in block] if qual else None
                mx = Matrix([ps[k] for k in block], [ts[k] for k in block], scheme, mode, None if lows[block[0]] == FULL else band, quals, with_trace, int(lows[block[0]]))
                for at, found in enumerate(mx.sinks(1 if with_trace else 2, distinct)):
                    k = block[at]
                    if not found or least is not None and found[0][0] < least[k]:
                        continue
                    score, i, j = found[0]
                    if not with_trace:
                        out[k] = (score, i, j, *(found[1][:2] if len(found) > 1 else (None, None)))
                        continue
                    rev, i0, j0 = mx.trace(at, i, j)
                    forward = rev[::-1]
                    md, ed, mm, go, ge, _ = describe(ps[k][j0:j], ts[k][i0:i], forward)
                    cigar = (f"{j0}S" if j0 else "") + run_lengths(forward) + (f"{len(ps[k]) - j}S" if j < len(ps[k]) else "")
                    out[k] = (score, i0, i, j0, j, cigar, run_lengths(rev), md, ed, mm, go, ge)
            found = pd.DataFrame(out, columns=fields, index=b.index)
            for c in found:
                if c not in ("cigar", "ops_rev", "md"):
                    found[c] = found[c].astype("Int32")
            yield pd.concat([b.drop(columns=list(drop)), found], axis=1)

    return run


def _apply(df: DataFrame, fields: str, with_trace: bool, scheme: Scheme, mode: str, band: int | None, pattern: str, text: str, qual: str | None, min_score: str | None, distinct: int = 0, drop: tuple[str, ...] = (), low: str | None = None) -> DataFrame:
    from pyspark.sql import types as T

    kept = [f for f in df.schema.fields if f.name not in drop]
    schema = T.StructType(kept + T._parse_datatype_string(fields).fields)
    return df.mapInPandas(_aligner(scheme, mode, band, with_trace, pattern, text, qual, min_score, distinct, drop, low), schema)


def align_score(df: DataFrame, scheme: Scheme = EDIT, mode: str = "semi_global", band: int | None = None, pattern: str = "pattern", text: str = "text", qual: str | None = None, min_score: str | None = None, distinct: int = 0, drop: tuple[str, ...] = (), low: str | None = None) -> DataFrame:
    """Adds score, text_end, pattern_end and the second best more than ``distinct`` text symbols away; null below ``min_score``.

    ``qual`` names a column of Phred values of the pattern, ``low`` one with the band's lowest diagonal (default 0; null: the full matrix).
    """
    return _apply(df, SCORE_FIELDS, False, scheme, mode, band, pattern, text, qual, min_score, distinct, drop, low)


def align_traceback(df: DataFrame, scheme: Scheme = EDIT, mode: str = "semi_global", band: int | None = None, pattern: str = "pattern", text: str = "text", qual: str | None = None, min_score: str | None = None, drop: tuple[str, ...] = (), low: str | None = None) -> DataFrame:
    """Adds score, begins and ends, CIGAR (with soft clips), ops_rev, MD, edit distance and gap counts."""
    return _apply(df, TRACE_FIELDS, True, scheme, mode, band, pattern, text, qual, min_score, 0, drop, low)


def edit_distance_global(pattern, text):
    """Global edit-distance score by the built-in function: no Python."""
    return -F.levenshtein(pattern, text)


def extension_window(df: DataFrame, band: int, genome: str = "ref_seq", pos: str = "pos", length: str = "len", out: str = "text") -> DataFrame:
    """Adds the text that a hit is extended over, from pos - band / 2 and clipped to the sequence, its begin and the band's lowest diagonal in it.

    Where the window is clipped at the sequence's begin the diagonals stay those of the hit: ``low`` is below 0.
    """
    whole = F.col(pos) - band // 2
    begin = F.greatest(whole, F.lit(0))
    stop = F.least(whole + F.col(length) + band, F.length(genome))
    out_df = df.withColumn("text_from", begin.cast("int")).withColumn("low", (whole - begin).cast("int"))
    return out_df.withColumn(out, F.substring(genome, begin.cast("int") + 1, F.greatest(stop - begin, F.lit(0)).cast("int")))

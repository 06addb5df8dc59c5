"""SimHash near-duplicates: a binary trie is joined with itself, node pairs are followed together and dropped once
their differing bits exceed the budget.

Spread over a cluster: with a budget of e bits, two linked codes agree wholly in one of e + 1 blocks of bits, so
codes are dealt out once for each block and every task joins the tries below its block values.  A block value
with more than ``LIMIT`` codes is dealt out again by blocks of its remaining bits, as often as needed: no task
holds an unbounded group, and no link is lost.  Within a task links are reduced to a spanning forest, so a dense
group leaves a row for each member, not for each pair.

Defined results: null and empty texts have fingerprint zero and are linked like any other; repeated rows each get
a row; a null doc_id never becomes a component's id (a component of only such rows has a null id); empty tables
give empty results; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, map_texts, table
from .components import components

#: Most codes of one block value in a task; larger groups are dealt out again by more bits.
LIMIT = 50_000
#: Node pairs followed at once.
FRONT = 1 << 18
SEED = 42


# --- fingerprints ---------------------------------------------------------------------------------------------


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    """XXH64 of every run of ``size`` words, A-Z lower-cased (one run if there are fewer words, none without words)."""
    w = (text or "").encode("utf-8", "replace").lower().split()  # bytes: lower() and split() are ASCII only
    if not w:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    runs = [b" ".join(w)] if len(w) < size else map(b" ".join, zip(*(w[i:] for i in range(size)), strict=False))
    return np.fromiter((digest(r, SEED) for r in runs), np.uint64, max(1, len(w) - size + 1))


def majority(h: np.ndarray) -> int:
    """Bits set in over half of the hashes."""
    counts = np.zeros(64, np.int64)
    for i in range(0, len(h), 16384):
        counts += np.unpackbits(h[i : i + 16384].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(h), bitorder="little").view(np.uint64)[0])


def mix(h: np.ndarray, n: int) -> np.ndarray:
    """The n-th independent 64 bits of each hash (a public integer finaliser over h + n times an odd constant)."""
    z = h + np.uint64((n * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def fingerprints(docs: DataFrame, size: int = 3) -> DataFrame:
    """Columns of ``docs`` except text, and ``fp``: the 64-bit fingerprint as a long."""

    def make():
        return lambda texts: [np.array([majority(shingle_hashes(t, size)) for t in texts], np.uint64).view(np.int64)]

    return map_texts(docs, make, [("fp", "long")])


# --- the trie -------------------------------------------------------------------------------------------------


def trie_pairs(codes: np.ndarray, starts: np.ndarray, budget: int, bits: int = 64) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs i < j of codes within ``budget`` bits, in one of the groups that begin at ``starts``.

    ``codes`` (uint64) ascend strictly within each group, so a node of a group's trie is a range of places.  A
    front holds pairs of ranges of one depth and their differing bits so far; it grows depth first in pieces.
    """
    n = len(codes)
    ends = np.r_[starts[1:], n].astype(np.int64)
    ones: dict[int, np.ndarray] = {}

    def middle(depth: int, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        if depth not in ones:
            ones[depth] = np.r_[0, ((codes >> np.uint64(bits - 1 - depth)) & np.uint64(1)).astype(np.int32).cumsum()]
        return hi - (ones[depth][hi] - ones[depth][lo])

    many = ends - starts > 1
    s, e = starts[many].astype(np.int64), ends[many]
    stack = [(0, s[i : i + FRONT], e[i : i + FRONT], s[i : i + FRONT], e[i : i + FRONT], np.zeros(len(s[i : i + FRONT]), np.int8)) for i in range(0, len(s), FRONT)]
    while stack:
        depth, al, ah, bl, bh, diff = stack.pop()
        single = (ah - al == 1) & (bh - bl == 1)
        if single.any():  # two paths without branches: count the bits that are left at once
            i, j = al[single], bl[single]
            near = (i < j) & (np.bitwise_count(codes[i] ^ codes[j]) <= budget)
            if near.any():
                yield i[near], j[near]
            al, ah, bl, bh, diff = (x[~single] for x in (al, ah, bl, bh, diff))
        if not len(al):
            continue
        am, bm = middle(depth, al, ah), middle(depth, bl, bh)
        own = al == bl  # a node with itself: its two children meet once
        parts = [
            (al, am, bl, bm, diff, np.ones(len(al), bool)), (am, ah, bm, bh, diff, np.ones(len(al), bool)),
            (al, am, bm, bh, diff + 1, diff < budget), (am, ah, bl, bm, diff + 1, (diff < budget) & ~own),
        ]
        new = []
        for pl, ph, ql, qh, d, ok in parts:
            ok = ok & (ph > pl) & (qh > ql) & ~((pl == ql) & (ph - pl == 1))
            new.append([x[ok] for x in (pl, ph, ql, qh, d.astype(np.int8))])
        grown = [np.concatenate(x) for x in zip(*new, strict=True)]
        for i in range(0, len(grown[0]), FRONT):
            stack.append((depth + 1, *(x[i : i + FRONT] for x in grown)))


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A star for each component of the links: (member, smallest member)."""
    names, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    label = np.arange(len(names))
    while True:
        least = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], least)
        np.minimum.at(new, label[b], least)
        while True:
            jumped = new[new]
            if (jumped == new).all():
                break
            new = jumped
        if (new == label).all():
            break
        label = new
    moved = label != np.arange(len(names))
    return names[moved], names[label[moved]]


# --- dealing out ----------------------------------------------------------------------------------------------


def blocks(mask: int, count: int) -> list[int]:
    """The bits of ``mask`` in ``count`` runs, as masks."""
    places = [i for i in range(63, -1, -1) if mask >> i & 1]
    cuts = [round(k * len(places) / count) for k in range(count + 1)]
    return [sum(1 << p for p in places[cuts[k] : cuts[k + 1]]) for k in range(count)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def deal(rows: DataFrame, budget: int, bits: int = 64, limit: int = LIMIT, fixed: list[str] | None = None) -> DataFrame:
    """``rows`` (with ``code``) once for each block of bits: plus ``mask`` and ``value``, the bits that a group shares.

    Groups above ``limit`` are dealt out again by the blocks of their free bits; ends when none is left, or when
    a group has no more distinct codes than the limit can hold.
    """
    fixed = fixed or []
    whole = (1 << bits) - 1
    masks = blocks(whole, budget + 1)
    masked = lambda m: F.struct(F.lit(_signed(m)).alias("mask"), F.col("code").bitwiseAND(F.lit(_signed(m))).alias("value"))
    out = rows.withColumn("_k", F.explode(F.array(*map(masked, masks)))).select("*", "_k.*").drop("_k")
    while True:
        again = {m: [m | b for b in blocks(whole & ~m, budget + 1)] for m in masks if bits - m.bit_count() > limit.bit_length() - 1 and bits - m.bit_count() > budget}
        if not again:
            return out
        key = [*fixed, "mask", "value"]
        hot = out.where(F.col("mask").isin([_signed(m) for m in again])).groupBy(*key).agg(F.count("*").alias("_n")).where(F.col("_n") > limit).select(*key)
        if hot.isEmpty():
            return out
        hot = cut(hot)
        split = out.join(hot, key, "left_semi")
        finer = None
        for m in again:
            part = split.where(F.col("mask") == F.lit(_signed(m))).drop("mask", "value").withColumn("_k", F.explode(F.array(*map(masked, again[m])))).select("*", "_k.*").drop("_k")
            finer = part if finer is None else finer.unionByName(part)
        out = out.join(hot, key, "left_anti").unionByName(finer)
        masks = [x for m in again for x in again[m]]


def _groups(batches, keys: list[str], rows: int):
    """Tables of whole groups: the stream, sorted by ``keys``, cut at a change of key once ``rows`` are together."""
    import pyarrow as pa

    held: list = []
    size = 0
    for b in batches:
        held.append(b)
        size += b.num_rows
        if size < rows:
            continue
        t = pa.Table.from_batches(held).combine_chunks()
        change = np.zeros(t.num_rows, bool)
        for k in keys:
            x = t.column(k).to_numpy()
            change[1:] |= x[1:] != x[:-1]
        last = int(np.flatnonzero(change)[-1]) if change.any() else 0
        if last:
            yield t.slice(0, last)
        held, size = t.slice(last).to_batches(), t.num_rows - last
    if size:
        yield pa.Table.from_batches(held).combine_chunks()


class Links:
    """Links gathered by a task, reduced to stars whenever many are held."""

    def __init__(self, most: int = 1 << 20):
        self.u, self.v, self.size, self.most = [], [], 0, most

    def add(self, u: np.ndarray, v: np.ndarray) -> None:
        self.u.append(u)
        self.v.append(v)
        self.size += len(u)
        if self.size > self.most:
            self.reduce()
            self.most = max(self.most, 2 * self.size)

    def reduce(self) -> tuple[np.ndarray, np.ndarray]:
        if self.size:
            u, v = forest(np.concatenate(self.u), np.concatenate(self.v))
            self.u, self.v, self.size = [u], [v], len(u)
        return (self.u[0], self.v[0]) if self.u else (np.zeros(0, np.int64),) * 2


def code_links(codes: DataFrame, budget: int, bits: int = 64, limit: int = LIMIT) -> DataFrame:
    """(u, v) stars that join all distinct ``code`` (long) within ``budget`` bits of each other."""
    keys = ["mask", "value"]
    dealt = deal(codes.select("code"), budget, bits, limit).repartition(*keys).sortWithinPartitions(*keys)

    def run(batches):
        import pyarrow as pa

        links = Links()
        for t in _groups(batches, keys, 4 * FRONT):
            mask, value, code = (t.column(c).to_numpy() for c in ("mask", "value", "code"))
            unsigned = code.view(np.uint64)
            order = np.lexsort((unsigned, value, mask))
            mask, value, unsigned = mask[order], value[order], unsigned[order]
            new = np.r_[True, (mask[1:] != mask[:-1]) | (value[1:] != value[:-1])]
            fresh = new | np.r_[True, unsigned[1:] != unsigned[:-1]]
            unsigned, new = unsigned[fresh], new[fresh]
            for i, j in trie_pairs(unsigned, np.flatnonzero(new), budget, bits):
                links.add(unsigned[i].view(np.int64), unsigned[j].view(np.int64))
        u, v = links.reduce()
        for i in range(0, len(u), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(u[i : i + (1 << 16)]), pa.array(v[i : i + (1 << 16)])], names=["u", "v"])

    return dealt.mapInArrow(run, "u long, v long")


def near_duplicates(docs: DataFrame, size: int = 3, budget: int = 2) -> DataFrame:
    """(doc_id, fp, component_id) of every row of (doc_id, text)."""
    marked = cut(fingerprints(docs.select("doc_id", "text"), size))
    codes = cut(marked.groupBy(F.col("fp").alias("code")).agg(F.min("doc_id").alias("least")))  # copies fold into one code
    roots = components(code_links(codes, budget))
    named = codes.join(roots, F.col("code") == F.col("node"), "left").withColumn("root", F.coalesce("root", "code"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    of_code = named.select("code", "root").join(least, "root").select("code", "component_id")
    return marked.join(of_code, F.col("fp") == F.col("code")).select("doc_id", "fp", "component_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4: all documents."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")

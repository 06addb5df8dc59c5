"""Stage functions of the corpus pipeline: each takes (spark, docs, sf_dir) and returns what it keeps.

A stage decides by a row's file and place in it (:func:`common.with_row`), so what it keeps depends neither on how the
table is split nor on executors that come and go.

Defined results, in every stage: a null text counts as empty; repeated rows are documents of their own, but exact
copies for near-dedup; an empty table gives an empty result; all columns of ``docs`` come back, whatever their names
(the last stage's own size, source_size, target, taken and mix_start replace columns of these names).
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, mixing, secret_scan, toxicity
from .common import cut, fresh, map_texts, table, with_row
from .components import components
from .simhash import FRONT, Links, _groups, blocks, deal, forest, mix, shingle_hashes, trie_pairs


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5; the classifier learns from this input's texts and the learnable labels."""
    labels = toxicity.learnable(table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    model = toxicity.fit(docs, labels)

    def make():
        score = toxicity.scorer(model)
        return lambda texts: [texts, score(texts)[0]]

    names = docs.columns
    text, score = fresh(docs, "_text", "_score")
    scored = map_texts(docs, make, [(text, "string"), (score, "double")])
    return scored.where(F.col(score) < 0.5).drop(score).withColumnRenamed(text, "text").select(*names)


# --- near-duplicates: SimHash words joined by their tries, similarity by minwise values of five-word shingles -----

#: SimHash words of a text, bits of a word, and differing bits within which the trie join takes two words for candidates.
#: Sets with Jaccard similarity 0.8 differ in a bit with chance acos(0.889) / pi = 0.152 at most, so they meet in a word
#: with chance 0.37 and in some word with 0.998.
TABLES, BITS, BUDGET = 14, 28, 3
#: Sets of up to this many shingles differ in a bit with chance up to 3 / 16, so they have more words: 0.998 as well.
FEW, TABLES_OF_FEW = 6, 30
#: 64-bit words of the shingle sketch.
SKETCH = 8
SHINGLE, SIMILARITY = 5, 0.8
#: Standard errors of a sketch around the similarity asked for within which a candidate's shingles are compared.
DOUBT = 4.0
#: Hashes drawn at once for a sketch; rows that a task of the join looks at together, pairs it compares at once.
DRAWN, ROWS, PAIRS = 4096, 1 << 16, 1 << 14
#: Most rows of one code, and most bytes of shingles, that meet in a group; larger groups meet in pairs of blocks.
LIMIT, BYTES = 20_000, 64 << 20
#: Links that one task joins (24 MB); more are joined in rounds.
FEW_LINKS = 1_500_000


def sketch_distances(similarity: float, bits: int, doubt: float = DOUBT) -> tuple[int, int]:
    """(sure, most): sketches that differ in at most ``sure`` bits are of near sets, those above ``most`` aren't."""
    p = (1 - similarity) / 2
    away = doubt * np.sqrt(p * (1 - p) * bits)
    return max(0, int(np.floor(p * bits - away))), int(np.ceil(p * bits + away))


def minwise_values(h: np.ndarray, bits: int = 64 * SKETCH) -> np.ndarray:
    """``bits`` values (a power of two, below 4096; uint64) that two sets share each with chance Jaccard.

    In every round each of the distinct hashes ``h`` falls into one of ``bits`` bins.  A bin's value is the
    smallest in the first round that reaches the bin, so rounds are drawn until no bin is empty.  No hashes: zeros.
    """
    if not len(h):
        return np.zeros(bits, np.uint64)
    width = bits.bit_length() - 1
    at, rest = np.uint64(64 - width), np.uint64(64 - width - DRAWN.bit_length())
    out, empty, drawn = np.zeros(bits, np.uint64), np.ones(bits, bool), 0
    low = (np.uint64(1) << rest) - np.uint64(1)
    many = max(1, DRAWN // len(h))
    while empty.any():
        steps = mix(np.arange(drawn + 1, drawn + 1 + many, dtype=np.uint64), 1)
        z = mix(h[None, :] ^ steps[:, None], 2)
        # one number orders by bin, then round, then value
        key = ((z >> at) << at) | (np.arange(many, dtype=np.uint64) << rest)[:, None] | (z & low)
        key = np.sort(key, axis=None)
        bin_of = key >> at
        first = np.r_[True, bin_of[1:] != bin_of[:-1]]
        reached, values = bin_of[first].astype(np.int64), key[first] & low
        new = empty[reached]
        out[reached[new]] = values[new]
        empty[reached] = False
        drawn += many
    return out


def sketch_of(values: np.ndarray) -> np.ndarray:
    """The last bit of each value, as uint64 words: two sets share a bit with chance (1 + Jaccard) / 2."""
    return np.packbits((values & np.uint64(1)).astype(np.uint8), bitorder="little").view(np.uint64)


def minwise_sketch(h: np.ndarray, bits: int = 64 * SKETCH) -> np.ndarray:
    """The sketch of the set of distinct hashes ``h``."""
    return sketch_of(minwise_values(h, bits))


def bit_counts(z: np.ndarray) -> np.ndarray:
    """How many rows of ``z`` (uint64, n x words) have each bit: full adders on whole columns, until few rows are left."""
    total, weight = np.zeros(64 * z.shape[1], np.int64), 1
    while len(z):
        carries = []
        while len(z) > 192:
            m = len(z) // 3
            a, b, c = z[:m], z[m : 2 * m], z[2 * m : 3 * m]
            x = a ^ b
            carries.append((a & b) | (x & c))
            z = np.concatenate([x ^ c, z[3 * m :]])
        total += weight * np.unpackbits(z.view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.uint8).astype(np.int64)
        z, weight = np.concatenate([*carries, z[:0]]), 2 * weight
    return total


def simhash_words(h: np.ndarray) -> np.ndarray:
    """The SimHash of a set of distinct hashes as words of BITS bits (int64): a bit is 1 if set in over half of the hashes."""
    tables = TABLES if len(h) > FEW else TABLES_OF_FEW
    count = -(-tables * BITS // 64)
    ones = np.zeros(64 * count, np.int64)
    for i in range(0, len(h), 16384):
        ones += bit_counts(np.stack([mix(h[i : i + 16384], k + 1) for k in range(count)], axis=1))
    bits = (ones * 2 > len(h))[: tables * BITS].reshape(tables, BITS)
    return bits @ (1 << np.arange(BITS, dtype=np.int64))


def block_codes(words: np.ndarray) -> np.ndarray:
    """Each word's blocks of bits: words within BUDGET bits have one of them in common."""
    return (words[:, None] & np.array(blocks((1 << BITS) - 1, BUDGET + 1))).reshape(-1)


def _sketcher():
    def run(texts):
        codes, sketches = [], []
        for t in texts:
            h = np.unique(shingle_hashes(t, SHINGLE))
            codes.append(block_codes(simhash_words(h)).tolist())
            sketches.append(sketch_of(minwise_values(h)).tobytes())
        return [codes, sketches]

    return run


def _words(codes: str) -> Column:
    """The words of a text, put together from their blocks."""
    n = BUDGET + 1
    word = lambda t: functools.reduce(Column.bitwiseOR, (F.get(codes, t * n + k) for k in range(n)))
    return F.transform(F.sequence(F.lit(0), (F.size(codes) / n).cast("int") - 1), word)


def near_links(sketch: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(i, j): links between near rows that join all rows which near pairs join.

    A search from row to row: each row is compared with every row that no other has reached yet, so only links
    within what is joined already are left out, and a dense group costs little more than its members.
    """
    out_i, out_j, free = [], [], np.arange(len(sketch))
    while len(free) > 1:
        front, free = free[:1], free[1:]
        while len(front) and len(free):
            step = max(1, PAIRS // len(free))
            part, front = front[:step], front[step:]
            near = np.bitwise_count(sketch[part][:, None] ^ sketch[free][None]).sum(2) <= most
            hit = near.any(0)
            out_i.append(part[near.argmax(0)[hit]])
            out_j.append(free[hit])
            front, free = np.concatenate([front, free[hit]]), free[~hit]
    return (np.concatenate(out_i), np.concatenate(out_j)) if out_i else (np.zeros(0, np.int64),) * 2


def in_blocks(rows: DataFrame, limit: int, size: str | None = None, most: int = BYTES, keys: tuple[str, ...] = ("t", "code")) -> DataFrame:
    """``rows`` (keys, node, ...) with ``part``: groups of equal keys above ``limit`` rows, or ``most`` bytes of ``size``, are cut into blocks of about half of it.

    A row is in a part for each other block, so any two rows of a group are together in some part.
    """
    blocks = F.ceil(F.col("_n") * 2 / limit)
    large = F.col("_n") > limit
    if size:
        blocks, large = F.greatest(blocks, F.ceil(F.col("_s") * 2 / most)), large | (F.col("_s") > most)
    sums = F.sum(size) if size else F.lit(0)
    hot = rows.groupBy(*keys).agg(F.count("*").alias("_n"), sums.alias("_s")).where(large).select(*keys, F.greatest(blocks, F.lit(2)).cast("long").alias("_b"))
    if hot.isEmpty():
        return rows.withColumn("part", F.lit(0).cast("long"))
    hot = cut(hot)
    own = F.pmod(F.xxhash64("node"), F.col("_b"))
    others = F.filter(F.sequence(F.lit(0).cast("long"), F.col("_b") - 1), lambda x: x != F.col("_own"))
    part = F.transform(others, lambda x: F.least(x, F.col("_own")) * F.col("_b") + F.greatest(x, F.col("_own")))
    split = rows.join(hot, [*keys]).withColumn("_own", own).withColumn("part", F.explode(part)).drop("_own", "_b")
    rest = rows.join(hot, [*keys], "left_anti").withColumn("part", F.lit(0).cast("long"))
    return rest.unionByName(split)


def _sketches(column) -> np.ndarray:
    import pyarrow as pa

    fixed = column.cast(pa.binary(8 * SKETCH)).combine_chunks()
    return np.frombuffer(fixed.buffers()[1], np.uint64)[SKETCH * fixed.offset :][: SKETCH * len(fixed)].reshape(-1, SKETCH)


def _stars(links: Links, **same):
    import pyarrow as pa

    u, v = links.reduce()
    for i in range(0, len(u), 1 << 16):
        part = u[i : i + (1 << 16)]
        yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(v[i : i + (1 << 16)]), *(pa.array([x] * len(part)) for x in same.values())], names=["u", "v", *same])


def member_pairs(i: np.ndarray, j: np.ndarray, first: np.ndarray, count: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows (a, b) of every member of word i with every member of word j, in pieces; word k has ``count[k]`` rows from ``first[k]``."""
    n = count[i] * count[j]
    single = n == 1
    yield first[i[single]], first[j[single]]
    for k in np.flatnonzero(n > FRONT):
        a, b = (np.arange(first[x], first[x] + count[x]) for x in (i[k], j[k]))
        step = max(1, FRONT // len(b))
        for lo in range(0, len(a), step):
            part = a[lo : lo + step]
            yield np.repeat(part, len(b)), np.tile(b, len(part))
    i, j, n = (x[~single & (n <= FRONT)] for x in (i, j, n))
    upto, lo = n.cumsum(), 0
    while lo < len(n):
        base = upto[lo - 1] if lo else 0
        hi = max(lo + 1, int(upto.searchsorted(base + FRONT, "right")))
        of = np.repeat(np.arange(lo, hi), n[lo:hi])
        at = np.arange(len(of)) - np.repeat(upto[lo:hi] - n[lo:hi] - base, n[lo:hi])
        yield first[i[of]] + at // count[j[of]], first[j[of]] + at % count[j[of]]
        lo = hi


class Joined:
    """Names of what links have joined among a task's rows, so that dense groups aren't compared pair by pair."""

    def __init__(self, rows: int):
        self.name, self.held, self.size = np.arange(rows), [], 0

    def apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self.name[a] != self.name[b]

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        self.held.append((a, b))
        self.size += len(a)
        if self.size >= 4096:
            u, v = forest(*(self.name[np.concatenate(x)] for x in zip(*self.held, strict=True)))
            least = np.arange(len(self.name))
            least[u] = v
            self.name, self.held, self.size = least[self.name], [], 0


def link_sketches(rows: DataFrame, sure: int, most: int, limit: int = LIMIT) -> DataFrame:
    """(u, v, sure) stars over nodes with words within BUDGET bits and sketches that differ in at most ``most`` bits, or ``sure``.

    rows: t (the word's number), code (the word), node, sketch.  Words are dealt by blocks of their bits and the trie of
    a group is joined with itself.  Every two nodes that meet there are compared unless other links join them, so which
    nodes are joined depends neither on their order nor on the size of their group.
    """
    group = ("t", "mask", "value")
    dealt = in_blocks(deal(rows, BUDGET, BITS, fixed=["t"]), limit, keys=group)
    # one number for a group: should two share it, more is compared, no less
    dealt = dealt.select(F.xxhash64(*group, "part").alias("key"), F.col("code").cast("int").alias("word"), "node", "sketch")
    dealt = dealt.repartition("key").sortWithinPartitions("key", "word")

    def run(batches):
        found = {at: Links(1 << 18) for at in (sure, most)}
        for g in _groups(batches, ["key"], ROWS):
            key, word, node = (g.column(c).to_numpy() for c in ("key", "word", "node"))
            sketch = _sketches(g.column("sketch"))
            new = np.r_[True, key[1:] != key[:-1]]
            first = np.flatnonzero(new | np.r_[True, word[1:] != word[:-1]])
            count = np.diff(np.r_[first, len(word)])
            # one word: a search, so that a dense group costs little more than its members
            twos = first[count == 2]
            away = np.bitwise_count(sketch[twos] ^ sketch[twos + 1]).sum(1)
            joined = {at: Joined(len(node)) for at in found}
            for at, links in found.items():
                near = twos[away <= at]
                links.add(node[near], node[near + 1])
                joined[at].add(near, near + 1)
                for k in np.flatnonzero(count > 2):
                    i, j = near_links(sketch[first[k] : first[k] + count[k]], at)
                    links.add(node[first[k] + i], node[first[k] + j])
                    joined[at].add(first[k] + i, first[k] + j)
            # words that differ: what the trie join finds
            for i, j in trie_pairs(word[first].astype(np.uint64), np.flatnonzero(new[first]), BUDGET, BITS):
                for a, b in member_pairs(i, j, first, count):
                    apart = joined[sure].apart(a, b)
                    a, b = a[apart], b[apart]
                    away = np.bitwise_count(sketch[a] ^ sketch[b]).sum(1)
                    for at, links in found.items():
                        near = away <= at
                        u, v = a[near], b[near]
                        apart = joined[at].apart(u, v)
                        links.add(node[u[apart]], node[v[apart]])
                        joined[at].add(u[apart], v[apart])
        yield from _stars(found[sure], sure=True)
        yield from _stars(found[most], sure=False)

    return dealt.mapInArrow(run, "u long, v long, sure boolean")


def shingle_set(text: str | None) -> np.ndarray:
    """The distinct shingles, as sorted 32-bit numbers."""
    return np.unique(shingle_hashes(text, SHINGLE).astype(np.uint32))


def jaccard_reaches(a: np.ndarray, b: np.ndarray, similarity: float = SIMILARITY) -> bool:
    """Whether two sorted sets have this Jaccard similarity or more."""
    least, largest = sorted((len(a), len(b)))
    if least < similarity * largest:
        return False
    both = np.concatenate([a, b])
    both.sort(kind="stable")  # merges two sorted runs
    shared = int(np.count_nonzero(both[1:] == both[:-1]))
    return shared >= similarity * (least + largest - shared) - 1e-9


def proven_links(sketch: np.ndarray, label: np.ndarray, sets: list[np.ndarray], most: int) -> tuple[np.ndarray, np.ndarray]:
    """(i, j) links between rows of different labels whose sketches are within ``most`` bits and whose sets are near.

    A search as in :func:`near_links`: rows of one label are joined already, so they are reached together.
    """
    out, free = [], np.arange(len(sketch))
    while len(free):
        front, free = [free[0]], free[1:]
        while front and len(free):
            i = front.pop()
            same = label[free] == label[i]
            maybe = np.flatnonzero(~same & (np.bitwise_count(sketch[free] ^ sketch[i]).sum(1) <= most))
            hit = same.copy()
            for k in maybe:
                j = free[k]
                if jaccard_reaches(sets[i], sets[j]):
                    hit[k] = True
                    out.append((i, j))
            front += free[hit].tolist()
            free = free[~hit]
    i, j = np.array(out, np.int64).reshape(-1, 2).T
    return i, j


def prove(members: DataFrame, most: int, limit: int = LIMIT, most_bytes: int = BYTES) -> DataFrame:
    """(u, v) links of labels: members (code, node, label, sketch, text) of one code are compared by their shingles."""
    sized = map_texts(members, lambda: lambda texts: [[shingle_set(x).tobytes() for x in texts]], [("shingles", "binary")])
    sized = cut(sized.withColumn("t", F.lit(0)))
    keys = ["code", "part"]
    dealt = in_blocks(sized.withColumn("_len", F.octet_length("shingles")), limit, "_len", most_bytes).repartition(*keys).sortWithinPartitions(*keys)

    def run(batches):
        links = Links(1 << 18)
        for g in _groups(batches, keys, 256):
            code, part, label = (g.column(c).to_numpy() for c in ("code", "part", "label"))
            sketch = _sketches(g.column("sketch"))
            starts = np.flatnonzero(np.r_[True, (code[1:] != code[:-1]) | (part[1:] != part[:-1])])
            for lo, hi in zip(starts, np.r_[starts[1:], len(code)], strict=True):
                sets = [np.frombuffer(x.as_buffer(), np.uint32) for x in g.column("shingles").slice(lo, hi - lo)]
                i, j = proven_links(sketch[lo:hi], label[lo:hi], sets, most)
                links.add(label[lo + i], label[lo + j])
        yield from _stars(links)

    return dealt.select(*keys, "label", "sketch", "shingles").mapInArrow(run, "u long, v long")


def near_groups(nodes: DataFrame, texts: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(node, root) of every node (node, at, codes, sketch) that is near another; ``texts`` (at, text) are read for those in doubt.

    Sketches far from the threshold decide at once.  Of what the others could join, the shingles are compared, and
    only of that.
    """
    sure, most = sketch_distances(SIMILARITY, 64 * SKETCH)
    rows = nodes.select(F.posexplode(_words("codes")).alias("t", "code"), "node", "sketch")
    links = cut(link_sketches(rows, sure, most, limit))
    roots = components(links.where("sure").select("u", "v"), few=FEW_LINKS)
    # links in doubt, between groups that are sure
    of = lambda side: roots.select(F.col("node").alias(side), F.col("root").alias(f"_{side}"))
    doubt = links.where("not sure").join(of("u"), "u", "left").join(of("v"), "v", "left").select(F.coalesce("_u", "u").alias("u"), F.coalesce("_v", "v").alias("v")).where("u <> v")
    doubt = cut(doubt)
    if doubt.isEmpty():
        return roots
    open_groups = components(doubt, few=FEW_LINKS).select(F.col("node").alias("label"), F.col("root").alias("code"))
    labelled = nodes.select("node", "at", "sketch").join(roots, "node", "left").select("node", "at", "sketch", F.coalesce("root", "node").alias("label"))
    members = labelled.join(open_groups, "label")
    proven = components(prove(members.join(texts, "at").select("code", "node", "label", "sketch", "text"), most, limit), few=FEW_LINKS)
    named = labelled.join(proven.select(F.col("node").alias("label"), "root"), "label", "left")
    return named.select("node", F.coalesce("root", "label").alias("root"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of exact or near copies: the one with the smallest doc_id.

    Near: the Jaccard similarity of the sets of five-word shingles is 0.8 or more.  Candidates are what the trie join of
    the SimHash words finds.
    """
    row, = fresh(docs, "_row")
    numbered = with_row(docs, row)
    digest = F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256))
    marked = map_texts(numbered.select(F.col(row).alias("row"), "doc_id", digest.alias("digest"), "text"), _sketcher, [("codes", "array<long>"), ("sketch", "binary")])
    marked = cut(marked.withColumn("id", F.monotonically_increasing_id()))
    # copies fold into one node before any link: its name is a row of the group
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "digest", "row"))
    one = F.min_by(F.struct("codes", "sketch", "row"), "id")
    nodes = marked.groupBy("digest").agg(F.min("id").alias("node"), first.alias("first"), one.alias("one"))
    nodes = cut(nodes.select("node", "first", F.col("one.row").alias("at"), "one.codes", "one.sketch"))
    roots = near_groups(nodes, numbered.select(F.col(row).alias("at"), "text"))
    named = nodes.select("node", "first").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    kept = cut(named.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.row").alias("_keep")))
    return numbered.join(kept, numbered[row] == kept["_keep"], "left_semi").select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no ten-word window with a benchmark item."""
    row, = fresh(docs, "_row")
    numbered = with_row(docs, row)
    found = decontaminate.contamination(numbered.select(F.col(row).alias("_at"), "doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"), row="_at")
    hit = found.where("contaminated").select("_at")
    return numbered.join(hit, numbered[row] == hit["_at"], "left_anti").select(*docs.columns)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret found replaced in the text."""
    return secret_scan.redact_documents(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with their words in it (``taken``, repeats counted) and place (``mix_start``)."""
    row, = fresh(docs, "_row")
    numbered = with_row(docs, row)
    mixed = mixing.mix(numbered.select("doc_id", "source", "text", F.col(row).alias("_of")), keep=("_of",))
    own = ["size", "source_size", "target", "taken", "mix_start"]
    part = mixed.where("taken > 0").select("_of", *own)
    others = [c for c in docs.columns if c.lower() not in own]
    return numbered.select(row, *others).join(part, F.col(row) == F.col("_of")).select(*others, *own)

"""Nearest neighbours by largest inner product: a forest of random-projection trees searched through one shared
priority queue, then exact reranking of the leaves' vectors.

The trees are grown on a bounded sample; every row is indexed (it gets its leaf in every tree).  Vectors are
extended by one component so that all have the same length, which makes the largest inner product the nearest
direction.  A query takes leaves off one queue over all trees, best margin first, until they hold ``share`` of
the sample; every vector in one of its leaves is a candidate and is scored exactly in double precision.  The
stopping rule is a share, not a number, so that recall does not fall as the table grows; the share is the least
that finds TARGET of the sample's own neighbours, which in a larger table lie deeper than the k nearest do.

Queries meet rows by a join on the leaf: a row goes to its leaf in each tree, a query to the leaves that it takes,
and only these pairs are scored.  A leaf with more than ``ROWS`` rows is split, and its queries go to every part.
A task holds one part's rows and a block of queries.

Equal vectors are indexed once with their smallest ids: of equal scores the smaller id wins, so no others can be
among the first k.

Defined results: vectors that are null, zero, of another length than most, or hold null or non-finite components
take no part, nor do null ids; a vec_id that repeats keeps its smallest vector; fewer candidates than k give
fewer rows; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table

#: Bound of the sample that the trees are grown on; trees; vectors of the table in a leaf (more once the sample's leaves have 8).
SAMPLE, TREES, LEAF = 20_000, 4, 512
#: Recall asked for on the sample, and the sample's queries that measure it.
TARGET, PROBES = 0.93, 96
#: Most vectors of a leaf in a task, and queries that they are multiplied with at once.
ROWS, QUERIES = 8192, 512


@dataclass
class Tree:
    """Inner nodes: normal, threshold, children (an inner node if >= 0, else leaf -1 - child); members: sample rows of each leaf."""

    normals: np.ndarray
    thresholds: np.ndarray
    children: np.ndarray
    members: list[np.ndarray]


def grow(x: np.ndarray, leaf: int, seed: int) -> Tree:
    rng = np.random.default_rng(seed)
    normals, thresholds, children, members = [], [], [], []
    todo = [(np.arange(len(x)), None)]
    while todo:
        ix, parent = todo.pop()
        at = None
        if len(ix) > leaf:
            for _ in range(4):
                a, b = rng.choice(ix, 2, replace=False)
                v = x[a] - x[b]
                size = np.linalg.norm(v)
                if size < 1e-9:
                    continue
                p = x[ix] @ (v / size)
                t = float(np.median(p))
                right = p >= t
                if right.any() and not right.all():
                    at = len(normals)
                    normals.append(v / size)
                    thresholds.append(t)
                    children.append([0, 0])
                    todo += [(ix[~right], (at, 0)), (ix[right], (at, 1))]
                    break
        if at is None:
            members.append(ix)
            at = -len(members)
        if parent is not None:
            children[parent[0]][parent[1]] = at
    width = x.shape[1]
    return Tree(np.array(normals).reshape(-1, width), np.array(thresholds), np.array(children, int).reshape(-1, 2), members)


def leaves_of(tree: Tree, x: np.ndarray) -> np.ndarray:
    """The leaf number of each row."""
    at = np.zeros(len(x), int) if len(tree.normals) else np.full(len(x), -1)
    rows = np.flatnonzero(at >= 0)
    while len(rows):
        n = at[rows]
        side = (np.einsum("ij,ij->i", x[rows], tree.normals[n]) >= tree.thresholds[n]).astype(int)
        at[rows] = tree.children[n, side]
        rows = rows[at[rows] >= 0]
    return -1 - at


def visits(forest: list[Tree], q: np.ndarray, share: float, size: int) -> np.ndarray:
    """(queries, all leaves) of bool: the leaves that each query takes off its queue."""
    offsets = np.r_[0, np.cumsum([len(t.members) for t in forest])]
    margins = [(q @ t.normals.T - t.thresholds) if len(t.normals) else None for t in forest]
    kids = [t.children.tolist() for t in forest]
    out = np.zeros((len(q), offsets[-1]), bool)
    need = share * size
    for i in range(len(q)):
        own = [m[i].tolist() if m is not None else None for m in margins]
        queue = [(0.0, t, 0 if own[t] is not None else -1) for t in range(len(forest))]
        seen, found = np.zeros(size, bool), 0
        while queue and found < need:
            worst, t, node = heapq.heappop(queue)  # the largest miss of a split on the way, smallest first
            while node >= 0:
                m = own[t][node]
                near, far = (kids[t][node][1], kids[t][node][0]) if m >= 0 else (kids[t][node][0], kids[t][node][1])
                heapq.heappush(queue, (max(worst, abs(m)), t, far))
                node = near
            leaf = -1 - node
            out[i, offsets[t] + leaf] = True
            rows = forest[t].members[leaf]
            found += len(rows) - int(np.count_nonzero(seen[rows]))
            seen[rows] = True
    return out


def calibrate(forest: list[Tree], x: np.ndarray, k: int, target: float = TARGET, probes: int = PROBES) -> float:
    """The least share (in steps of 1/32) whose searches find ``target`` of the k nearest rows of x, on average over evenly spaced rows."""
    at = np.unique(np.linspace(0, len(x) - 1, probes).astype(int))
    q = x[at].copy()
    q[:, -1] = 0
    scores = q @ x.T
    scores[np.arange(len(at)), at] = -np.inf
    k = min(k, len(x) - 1)
    if k < 1:
        return 1.0
    true = np.argpartition(-scores, k - 1, axis=1)[:, :k]
    leaves = [leaves_of(t, x) + o for t, o in zip(forest, np.cumsum([0] + [len(t.members) for t in forest]), strict=False)]

    def recall(share: float) -> float:
        taken = visits(forest, q, share, len(x))
        return float(np.mean([np.any([taken[i, ls[true[i]]] for ls in leaves], axis=0).mean() for i in range(len(at))]))

    low, high = 0, 32
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (low, mid) if recall(mid / 32) >= target else (mid, high)
    return high / 32


def rerank(q: np.ndarray, x: np.ndarray, least: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, vector row, score) of each query's k best rows, by double-precision inner product."""
    qd, xd = q.astype(float), x.astype(float)
    scores = qd @ xd.T
    if len(x) > k:
        floor = np.partition(scores, len(x) - k, axis=1)[:, len(x) - k]
        keep = scores >= floor[:, None] - 1e-12 * np.abs(floor)[:, None]
    else:
        keep = np.ones(scores.shape, bool)
    i, j = np.nonzero(keep)
    exact = (qd[i] * xd[j]).sum(1)  # the same order of sums for every pair, in whatever task
    order = np.lexsort((least[j], -exact, i))
    i, j, exact = i[order], j[order], exact[order]
    first = np.r_[0, np.flatnonzero(i[1:] != i[:-1]) + 1] if len(i) else np.zeros(0, int)
    rank = np.arange(len(i)) - np.repeat(first, np.diff(np.r_[first, len(i)]))
    return i[rank < k], j[rank < k], exact[rank < k]


class Best:
    """The k best of each query that a task has found so far: (least, vec_id, score); ``most`` rows are held at once."""

    def __init__(self, k: int, most: int = 1 << 20):
        self.k, self.most, self.held, self.size, self.next = k, most, [], 0, most

    def add(self, least: np.ndarray, vec_id: np.ndarray, score: np.ndarray):
        """Yields rows once even the best of the queries are too many to hold."""
        self.held.append((least, vec_id, score))
        self.size += len(least)
        if self.size > self.next:
            rows = self.reduce()
            if len(rows[0]) > self.most // 2:
                self.held, self.size = [], 0
                yield rows

    def reduce(self) -> tuple[np.ndarray, ...]:
        if not self.held:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        least, vec_id, score = (np.concatenate(x) for x in zip(*self.held, strict=True))
        order = np.lexsort((vec_id, -score, least))
        least, vec_id, score = least[order], vec_id[order], score[order]
        new = np.r_[True, (least[1:] != least[:-1]) | (vec_id[1:] != vec_id[:-1])]  # found in several trees: equal scores are neighbours
        least, vec_id, score = least[new], vec_id[new], score[new]
        first = np.flatnonzero(np.r_[True, least[1:] != least[:-1]])
        rank = np.arange(len(least)) - np.repeat(first, np.diff(np.r_[first, len(least)]))
        ok = rank < self.k
        self.held, self.size = [(least[ok], vec_id[ok], score[ok])], int(ok.sum())
        return self.held[0]


def usable(vectors: DataFrame, id_col: str, vector: str) -> DataFrame:
    """(id, v): valid vectors, one for each id."""
    double = vectors.schema[vector].dataType.elementType.typeName() == "double"
    v = F.col(vector).cast("array<double>" if double else "array<float>")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    some = F.exists("v", lambda x: x != 0)
    ok = vectors.select(F.col(id_col).alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull())
    return ok.where(F.coalesce(~bad & some, F.lit(False))).groupBy("id").agg(F.min("v").alias("v"))


def search(vectors: DataFrame, queries, k: int = 20, id_col: str = "vec_id", vector: str = "embedding", sample: int = SAMPLE, trees: int = TREES, leaf: int = LEAF, target: float = TARGET) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of every row for which ``queries(id column)`` holds."""
    spark = vectors.sparkSession
    empty = "query_id long, rank int, vec_id long, score double"
    ok = usable(vectors, id_col, vector).withColumn("_len", F.size("v"))
    rows = cut(ok)
    lengths = rows.groupBy("_len").count().orderBy(F.desc("count"), "_len").first()
    if lengths is None:
        return spark.createDataFrame([], empty)
    width = lengths["_len"]
    rows = rows.where(F.col("_len") == width).drop("_len")
    # distinct vectors with their k + 1 smallest ids: ranked before the shuffle too, so a common vector stays small
    near = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    distinct = cut(rows.withColumn("_n", near).where(F.col("_n") <= k + 1).groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids")).withColumn("least", F.col("ids")[0]))
    n, longest = distinct.agg(F.count("*"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))).first()
    some = distinct.orderBy(F.xxhash64(F.lit(5), "least"), "least").limit(sample).select("v", "least").toArrow().sort_by("least")
    base = np.stack(some.column("v").to_numpy()).astype(np.float64).reshape(len(some), width)

    def extended(x: np.ndarray) -> np.ndarray:
        x = x.astype(np.float64)
        return np.hstack([x, np.sqrt(np.maximum(longest - (x**2).sum(1), 0))[:, None]])

    plain = extended(base)
    in_leaf = max(8, round(leaf * len(base) / n))
    forest = [grow(plain, in_leaf, seed) for seed in range(trees)]
    offsets = np.r_[0, np.cumsum([len(t.members) for t in forest])]
    share = calibrate(forest, plain, k, target)

    def matrix(column) -> np.ndarray:
        flat = column.combine_chunks() if hasattr(column, "combine_chunks") else column
        return flat.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)

    def index(batches):
        import pyarrow as pa

        for b in batches:
            x = extended(matrix(b.column("v")))
            at = np.stack([leaves_of(t, x) + o for t, o in zip(forest, offsets, strict=False)], 1).astype(np.int32)
            yield b.append_column("leaves", pa.ListArray.from_arrays(np.arange(0, at.size + 1, at.shape[1], dtype=np.int32), at.reshape(-1)))

    def ask(batches):
        import pyarrow as pa

        for b in batches:
            for i in range(0, b.num_rows, QUERIES):
                part = b.slice(i, QUERIES)
                q = matrix(part.column("v")).astype(np.float64)
                taken = visits(forest, np.hstack([q, np.zeros((len(q), 1))]), share, len(base))
                ends = np.r_[0, taken.sum(1).cumsum()].astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column("least"), part.column("v"), pa.ListArray.from_arrays(ends, np.nonzero(taken)[1].astype(np.int32))], names=["least", "v", "leaves"])

    kind = distinct.schema["v"].dataType.simpleString()
    indexed = cut(distinct.select("least", "v", "ids").mapInArrow(index, f"least long, v {kind}, ids array<long>, leaves array<int>"))
    # a row for each leaf, fewer than the sample has rows for each tree
    parts = indexed.select(F.explode("leaves").alias("at")).groupBy("at").agg(F.ceil(F.count("*") / ROWS).cast("int").alias("_parts"))
    spread = indexed.select("least", "v", "ids", F.explode("leaves").alias("at")).join(F.broadcast(parts), "at").withColumn("part", F.pmod(F.xxhash64("least"), F.col("_parts")).cast("int"))
    asked = rows.where(queries(F.col("id")))
    of_query = asked.join(distinct.select("v", "least"), "v").select(F.col("id").alias("query_id"), "least")
    sought = of_query.select("least").distinct().join(distinct.select("least", "v"), "least").mapInArrow(ask, f"least long, v {kind}, leaves array<int>")
    sought = sought.select("least", "v", F.explode("leaves").alias("at")).join(F.broadcast(parts), "at").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    keys = ["at", "part"]
    met = spread.select(*keys, F.lit(False).alias("asks"), "least", "v", "ids").unionByName(sought.select(*keys, F.lit(True).alias("asks"), "least", "v", F.array().cast("array<long>").alias("ids")))
    dealt = met.repartition(*keys).sortWithinPartitions(*keys, "asks")

    def best(batches):
        import pyarrow as pa

        found = Best(k + 1)

        def batch(least, vec_id, score):
            for i in range(0, len(least), 1 << 16):
                to = slice(i, i + (1 << 16))
                yield pa.RecordBatch.from_arrays([pa.array(least[to], pa.int64()), pa.array(vec_id[to], pa.int64()), pa.array(score[to], pa.float64())], names=["least", "vec_id", "score"])

        at = part = None
        held: list = []  # the rows of the part, which come before its queries
        x = least = ids = None
        for b in batches:
            a, p, asks = (b.column(c).to_numpy(zero_copy_only=False) for c in ("at", "part", "asks"))
            starts = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (p[1:] != p[:-1]) | (asks[1:] != asks[:-1])])
            for lo, hi in zip(starts, np.r_[starts[1:], len(a)], strict=True):
                if (a[lo], p[lo]) != (at, part):
                    at, part, held, x = a[lo], p[lo], [], None
                run = b.slice(lo, hi - lo)
                if not asks[lo]:
                    held.append(run)
                    continue
                if not held:
                    continue
                if x is None:
                    t = pa.Table.from_batches(held)
                    x, least, ids = matrix(t.column("v")), t.column("least").to_numpy(), t.column("ids").to_pylist()
                for i in range(0, run.num_rows, QUERIES):
                    some = run.slice(i, QUERIES)
                    qi, j, s = rerank(matrix(some.column("v")), x, least, k + 1)
                    times = np.array([len(ids[m]) for m in j], int)
                    names = np.array([v for m in j for v in ids[m]], np.int64)
                    for rows in found.add(np.repeat(some.column("least").to_numpy()[qi], times), names, np.repeat(s, times)):
                        yield from batch(*rows)
        yield from batch(*found.reduce())

    scored = dealt.mapInArrow(best, "least long, vec_id long, score double")
    # a vector that several trees find has one rank; ranks are limited within tasks before the shuffle
    order = Window.partitionBy("least").orderBy(F.desc("score"), "vec_id")
    top = scored.withColumn("_r", F.dense_rank().over(order)).where(F.col("_r") <= k + 1).select("least", "vec_id", "score").distinct()
    pairs = of_query.join(top, "least").where("query_id <> vec_id")
    ranked = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: every vec_id divisible by 20 against all rows."""
    return search(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), lambda i: i % 20 == 0)

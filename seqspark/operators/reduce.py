"""Reductions of scored hits to the best distinct alignments of a read or a pair, and hit aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sam import distinct_alignments


def best_two(hits: DataFrame, key: str = "read_id", dist: Column | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """(key, score, pos, rc, second_score, second_pos, second_rc) from hits (key, score, pos, rc, len), with the columns ``carry`` of the best.

    The best hit (ties: smallest position, forward first), then the best that is distinct from it: on the other
    strand or more than half a read away.  Aggregates only: partial results combine before the shuffle, so a
    read with very many hits costs one row a task.
    """
    rank = F.struct(F.col("score").alias("s"), (-F.col("pos")).alias("p"), (-F.col("rc").cast("int")).alias("r"), *carry)
    best = hits.groupBy(key).agg(F.max(rank).alias("_b"), F.max("len").alias("len"))
    best = best.select(key, F.col("_b.s").alias("score"), (-F.col("_b.p")).alias("pos"), (-F.col("_b.r")).alias("rc"), "len", *(f"_b.{c}" for c in carry))
    far = dist if dist is not None else F.floor(F.col("_l") / 2)
    others = hits.select(key, F.col("score").alias("_s"), F.col("pos").alias("_p"), F.col("rc").cast("int").alias("_r")).join(best.select(key, F.col("pos").alias("_bp"), F.col("rc").alias("_br"), F.col("len").alias("_l")), key)
    others = others.where(distinct_alignments(F.col("_p"), F.col("_r"), F.col("_bp"), F.col("_br"), far))
    second = others.groupBy(key).agg(F.max(F.struct(F.col("_s").alias("s"), (-F.col("_p")).alias("p"), (-F.col("_r")).alias("r"))).alias("_2"))
    out = best.join(second, key, "left")
    return out.select(key, "score", "pos", "rc", F.col("_2.s").alias("second_score"), (-F.col("_2.p")).alias("second_pos"), (-F.col("_2.r")).alias("second_rc"), "len", *carry)


def best_two_pairs(pairs: DataFrame, key: str = "read_id", carry: tuple[str, ...] = ()) -> DataFrame:
    """The same on pair scores: pairs (key, score, o_score, pos, rc, o_pos, o_rc, len, o_len); a pair is the same if both mates are."""
    p = pairs.withColumn("total", F.col("score") + F.col("o_score"))
    rank = F.struct(F.col("total").alias("t"), (-F.col("pos")).alias("p"), (-F.col("o_pos")).alias("q"), "rc", "o_rc", "score", "o_score", *carry)
    best = p.groupBy(key).agg(F.max(rank).alias("b"))
    met = p.join(best, key)
    differs = lambda a, r, b, s, n: (F.col(r) != F.col(s)) | (F.abs(F.col(a) - b) > F.floor(F.col(n) / 2))
    other = met.where(differs("pos", "rc", -F.col("b.p"), "b.rc", "len") | differs("o_pos", "o_rc", -F.col("b.q"), "b.o_rc", "o_len"))
    second = other.groupBy(key).agg(F.max(rank).alias("c"))
    out = best.join(second, key, "left")
    return out.select(
        key, F.col("b.t").alias("total"), F.col("b.score").alias("score"), (-F.col("b.p")).alias("pos"), F.col("b.rc").alias("rc"), F.col("b.o_score").alias("o_score"), (-F.col("b.q")).alias("o_pos"), F.col("b.o_rc").alias("o_rc"),
        F.col("c.t").alias("second_total"), (-F.col("c.p")).alias("second_pos"), (-F.col("c.q")).alias("second_o_pos"), *(f"b.{c}" for c in carry),
    )


def pairs_or_singles(paired: DataFrame, single: DataFrame, key: str = "read_id", mixed: bool = True) -> DataFrame:
    """Reads with a pair keep it; the others fall back to the best of each mate, if mixed results are allowed."""
    rest = single.join(paired.select(key).distinct(), key, "left_anti").withColumn("paired", F.lit(False))
    both = paired.withColumn("paired", F.lit(True))
    return both.unionByName(rest, allowMissingColumns=True) if mixed else both


def best_two_with_budget(hits: DataFrame, max_effort: int = 15, min_ext: int = 30, max_ext: int = 400) -> DataFrame:
    """The order-dependent form: hits (read_id, ord, score, pos, rc, len) are looked at in order, and a read stops after
    ``max_effort`` failures in a row once ``min_ext`` hits were seen, or after ``max_ext``.

    Only the first ``max_ext`` hits of a read can count, so that many are kept before a read's rows meet; they are
    folded in order by one aggregate over the sorted array, without Python.
    """
    w = Window.partitionBy("read_id").orderBy("ord")
    some = hits.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= max_ext)
    hit = F.struct(F.col("_n").cast("int").alias("n"), F.col("score").cast("long").alias("s"), F.col("pos").cast("long").alias("p"), F.col("rc").cast("int").alias("r"), F.floor(F.col("len") / 2).cast("long").alias("far"))
    lists = some.groupBy("read_id").agg(F.array_sort(F.collect_list(hit)).alias("_h"))
    one = "struct<s:bigint,p:bigint,r:int>"
    none = F.lit(None).cast(one)
    start = F.struct(none.alias("b"), none.alias("c"), F.lit(0).alias("fails"), F.lit(0).alias("seen"), F.lit(False).alias("over"))

    def step(a: Column, h: Column) -> Column:
        b, c = a["b"], a["c"]
        this = F.struct(h["s"].alias("s"), h["p"].alias("p"), h["r"].alias("r"))
        same = lambda x: x.isNotNull() & (x["p"] == h["p"]) & (x["r"] == h["r"])
        again = F.coalesce(same(b), F.lit(False)) | F.coalesce(same(c), F.lit(False))
        apart = b.isNull() | (h["r"] != b["r"]) | (F.abs(h["p"] - b["p"]) > F.col("_far"))
        better = b.isNull() | (h["s"] > b["s"])
        second = apart & (c.isNull() | (h["s"] > c["s"]))
        fails = F.when(again, a["fails"]).when(better | second, 0).otherwise(a["fails"] + 1)
        over = ~again & ~better & ~second & (fails >= max_effort) & (a["seen"] + 1 >= min_ext)
        new_b = F.when(~again & better, this).otherwise(b)
        new_c = F.when(again, c).when(better, F.when(b.isNotNull() & apart, b).otherwise(c)).when(second, this).otherwise(c)
        next_ = F.struct(new_b.alias("b"), new_c.alias("c"), fails.alias("fails"), (a["seen"] + 1).alias("seen"), over.alias("over"))
        return F.when(a["over"], a).otherwise(next_)

    done = lists.withColumn("_far", F.col("_h")[0]["far"]).select("read_id", F.aggregate("_h", start, step).alias("a"))
    names = {"b": ("score", "pos", "rc"), "c": ("second_score", "second_pos", "second_rc")}
    return done.select("read_id", *(F.col(f"a.{k}.{f}").alias(n) for k, out in names.items() for f, n in zip("spr", out, strict=True)), F.col("a.seen").alias("extensions"))


def target_score(best: Column, second: Column, worst: Column) -> Column:
    """second + (best - second) * 3 / 4 in whole numbers (toward zero), or the worst score without a second."""
    return F.when(second.isNotNull(), second + ((best - second) * 3 / 4).cast("int")).otherwise(worst)


def hit_counts(ranges: DataFrame) -> DataFrame:
    """(read_id, range_count, range_sum)"""
    return ranges.groupBy("read_id").agg(F.count("*").alias("range_count"), F.sum(F.col("sa_end") - F.col("sa_begin")).alias("range_sum"))


def hit_statistics(ranges: DataFrame) -> DataFrame:
    """One row: totals of ranges, hits, the largest range and the smallest of each read."""
    size = F.col("sa_end") - F.col("sa_begin")
    per = ranges.groupBy("read_id").agg(F.count("*").alias("n"), F.sum(size).alias("hits"), F.min(size).alias("top"), F.max(size).alias("largest"))
    return per.agg(F.count("*").alias("reads"), F.sum("n").alias("ranges"), F.sum("hits").alias("hits"), F.sum("top").alias("top_hits"), F.max("largest").alias("max_range"))


def hit_histograms(ranges: DataFrame) -> DataFrame:
    """(name, bin, n): reads by the logarithm of their number of ranges, of hits and of hits in the smallest range; ranges by that of their size."""
    from ..functions.symbols import log_bin

    size = F.col("sa_end") - F.col("sa_begin")
    sized = ranges.select("read_id", size.alias("_size"))
    per = sized.groupBy("read_id").agg(F.count("*").alias("ranges"), F.sum("_size").alias("hits"), F.min("_size").alias("top_hits"))
    rows = F.explode(F.array(*(F.struct(F.lit(c).alias("name"), log_bin(F.col(c)).alias("bin")) for c in ("ranges", "hits", "top_hits"))))
    of_reads = per.select(rows.alias("_r")).groupBy(F.col("_r.name").alias("name"), F.col("_r.bin").alias("bin")).agg(F.count("*").alias("n"))
    of_ranges = sized.groupBy(F.lit("range_size").alias("name"), log_bin(F.col("_size")).alias("bin")).agg(F.count("*").alias("n"))
    return of_reads.unionByName(of_ranges)


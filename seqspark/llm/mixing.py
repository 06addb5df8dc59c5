"""Mixing sources to target weights by weighted fair queueing.  DataFrame functions only.

Documents of a source are shuffled by a seeded digest; a document's virtual finish time is the source's words up
to its end, over the source's target.  Further passes over a source continue its clock, so a source has its target
at time 1.  All copies are ordered by virtual finish time, and the mix is truncated at the total budget: that
alone decides what a document gives.

A copy on its way when time 1 passes is queued as packets of a 16,384th of its source's target (one word at
least), so that no long document carries its source past the target.  Copies that end by time 1 stay whole, as all
their packets are taken; copies that start after the last time which the budget can reach can't be.

Running sums are two-level everywhere: sums of fixed key ranges first, then within a range, so a source that
holds a third of all rows, or the whole mix, is never one task's work.

Defined results: a null or blank text has size 0 and takes nothing; null sources are one source, last in order;
with fewer words than asked for, targets stop at ``passes`` times a source's words; repeated rows are documents of
their own; an empty table gives an empty result; extra columns are ignored but for those in ``keep``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table

WORD = r"[^\x20\x09-\x0D]+"
#: Key ranges of a running sum; packets that a source's target is cut into at most.
RANGES, PACKETS = 4096, 16384
WEIGHTS, SHARE, PASSES = (5.0, 2.0, 1.0), 1.5, 2


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_key(source: Column) -> Column:
    """A non-null key in the order of the sources: by code point, null last."""
    return F.coalesce(F.concat(F.lit("0"), source), F.lit("1"))


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, passes: int = PASSES) -> DataFrame:
    """(_key, source_size, target, _packet, _last, _budget), one row a source, from (_key, size).

    ``_packet`` is the words of a packet, ``_last`` the time by which any packet has finished that starts before time
    1: the mix ends by then, as what starts before time 1 is all that is asked for.

    ``share`` of all words is dealt by weight; no target passes ``passes`` times its source's words, the excess
    goes to the others by weight.  Sources are taken in order of cap over weight, the order in which a rising
    level fills them: a source is full if the level which the rest would then reach is above its own.
    """
    per = sizes.groupBy("_key").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy("_key")) - 1
    per = per.withColumn("_n", rank).withColumn("_w", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("_n") % len(weights) + 1).cast("int")))
    per = per.withColumn("_cap", F.col("source_size") * F.lit(float(passes))).withColumn("_fill", F.col("_cap") / F.col("_w"))
    every = Window.orderBy("_fill", "_n").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = Window.orderBy("_fill", "_n").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("_wanted", F.sum("source_size").over(every) * F.lit(share) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
    per = per.withColumn("_level", F.col("_wanted") / (F.sum("_w").over(every) - F.coalesce(F.sum("_w").over(before), F.lit(0.0))))
    per = per.withColumn("_open", F.col("_level") < F.col("_fill"))
    level = F.min(F.when(F.col("_open"), F.struct("_fill", "_n", "_level"))).over(every)["_level"]
    per = per.withColumn("target", F.coalesce(F.least(level * F.col("_w"), F.col("_cap")), F.col("_cap")))
    per = per.withColumn("_packet", F.greatest(F.floor(F.col("target") / PACKETS), F.lit(1).cast("long")))
    last = F.max(F.when(F.col("target") > 0, F.col("_packet") / F.col("target"))).over(every)
    per = per.withColumn("_last", 1 + F.coalesce(last, F.lit(0.0))).withColumn("_budget", F.sum(F.floor("target")).over(every))
    return per.select("_key", "source_size", "target", "_packet", "_last", "_budget")


def running(df: DataFrame, key: str, order: list[str], value: str, out: str) -> DataFrame:
    """``df`` plus ``out``: the sum of ``value`` over the rows before, in the order of ``key`` and ``order``.

    ``key`` numbers the ranges of the order, below RANGES.  Sums of ranges are added up first, then rows within a range.
    """
    sums = df.groupBy(key).agg(F.sum(value).alias("_s"))
    offsets = sums.select(key, (F.sum("_s").over(Window.orderBy(key)) - F.col("_s")).alias("_o"))
    within = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.join(offsets, key).withColumn(out, F.col("_o") + F.sum(value).over(within) - F.col(value)).drop("_o")


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, passes: int = PASSES, seed: int = 17, budget: int | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row for every row of ``docs`` (doc_id, source, text): doc_id, source, size, source_size, target, taken, mix_start, and ``keep``.

    ``taken`` counts the words of all copies in the mix, ``mix_start`` is the place in words of the first (null: none).
    The budget is the sum of the whole targets; a smaller ``budget`` ends the mix there.
    """
    same = ["doc_id", "source", "size", *keep]
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("doc_id").cast("string")))
    sized = docs.select("doc_id", "source", words(F.col("text")).alias("size"), *keep, source_key(F.col("source")).alias("_key"), digest.alias("_h"), F.xxhash64("text").alias("_t"), F.monotonically_increasing_id().alias("_row"))
    sized = cut(sized.withColumn("_b", F.conv(F.substring("_h", 1, 3), 16, 10).cast("int")))  # sizes are used three times, texts are read once
    # documents meet their target by source and range: no join or window deals them by source alone
    ranges = sized.groupBy("_key", "_b").agg(F.sum("size").alias("_s"))
    targets = source_targets(ranges.select("_key", F.col("_s").alias("size")), weights, share, passes)
    upto = F.sum("_s").over(Window.partitionBy("_key").orderBy("_b"))  # at most RANGES rows a source
    known = ranges.select("_key", "_b", (upto - F.col("_s")).alias("_o")).join(targets, "_key")
    within = Window.partitionBy("_key", "_b").orderBy("_h", "doc_id", "size", "_t", "_row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    clock = sized.join(known, ["_key", "_b"]).withColumn("_before", F.col("_o") + F.sum("size").over(within) - F.col("size")).drop("_o")
    copies = clock.withColumn("_pass", F.explode(F.sequence(F.lit(0), F.lit(passes - 1)))).withColumn("_start", F.col("_before") + F.col("_pass") * F.col("source_size"))
    size, start, target, packet = (F.col(c) for c in ("size", "_start", "target", "_packet"))
    never = (size == 0) | (target <= 0) | (start >= F.col("_last") * target)
    whole = start + size <= target
    pieces = F.least(F.ceil(size / packet), F.ceil((F.col("_last") * target - start) / packet))
    queue = copies.withColumn("_k", F.explode(F.sequence(F.lit(0).cast("long"), F.when(never | whole, F.lit(0).cast("long")).otherwise(pieces - 1))))
    begin = F.when(whole, start).otherwise(start + F.col("_k") * packet)
    queue = queue.withColumn("_part", F.when(never, 0).when(whole, size).otherwise(F.least(packet, size - F.col("_k") * packet)).cast("long"))
    queue = queue.withColumn("_finish", F.when(never, F.lit(0.0)).otherwise((begin + F.col("_part")) / target))
    # copies that take nothing add nothing to any sum: they are spread over the ranges instead of meeting at one time
    at = F.when(F.col("_part") > 0, F.least((F.col("_finish") / F.col("_last") * RANGES).cast("int"), F.lit(RANGES - 1))).otherwise(F.col("_b"))
    queue = queue.withColumn("_range", F.coalesce(at, F.lit(0)))
    mixed = running(queue, "_range", ["_finish", "_h", "doc_id", "_t", "_row", "_pass", "_k"], "_part", "_at")
    end = F.col("_budget") if budget is None else F.least(F.col("_budget"), F.lit(budget))
    mixed = mixed.withColumn("_part", F.greatest(F.lit(0).cast("long"), F.least(F.col("_part"), end - F.col("_at"))))
    out = mixed.groupBy("_row").agg(*(F.first(c).alias(c) for c in [*same, "source_size", "target"]), F.sum("_part").alias("taken"), F.min(F.when(F.col("_part") > 0, F.col("_at"))).alias("mix_start"))
    return out.drop("_row")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: all documents."""
    mixed = mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "mix_start")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         coalesce('0' || source, '1') AS k, md5(concat_ws(':', '17', doc_id::VARCHAR)) AS h, row_number() OVER () AS r FROM documents),
p AS (SELECT k, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY k) - 1 AS n FROM d GROUP BY k),
w AS (SELECT *, CASE n % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w, source_size * 2.0::DOUBLE AS cap FROM p),
v AS (SELECT *, (sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE
         - coalesce(sum(cap) OVER (ORDER BY cap / w, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS wanted,
         (sum(w) OVER ()) - coalesce(sum(w) OVER (ORDER BY cap / w, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS weight_left FROM w),
u AS (SELECT k, source_size, coalesce(least(w * (first_value(wanted / weight_left) OVER (ORDER BY CASE WHEN wanted / weight_left < cap / w THEN 0 ELSE 1 END, cap / w, n
         ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)), cap), cap) AS target,
         bool_or(wanted / weight_left < cap / w) OVER () AS any_open, cap FROM v),
t AS (SELECT k, source_size, CASE WHEN any_open THEN target ELSE cap END AS target FROM u),
m AS (SELECT *, greatest(floor(target / 16384), 1)::BIGINT AS packet FROM t),
l AS (SELECT *, 1 + coalesce(max(CASE WHEN target > 0 THEN packet / target END) OVER (), 0) AS late, sum(floor(target)) OVER () AS budget FROM m),
c AS (SELECT r, doc_id, size, h, source_size, target, packet, late, budget,
         sum(size) OVER (PARTITION BY d.k ORDER BY h, doc_id, size, r ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS before
      FROM d JOIN l ON d.k = l.k),
q AS (SELECT *, before + pass * source_size AS start FROM (SELECT *, unnest([0, 1]) AS pass FROM c)),
-- a copy that is under way at time 1 is queued in packets
g AS (SELECT *, start + size <= target AS whole FROM q WHERE size > 0 AND target > 0 AND start < late * target),
e AS (SELECT r, h, doc_id, pass, budget, target, i, CASE WHEN whole THEN start ELSE start + i * packet END AS since, CASE WHEN whole THEN size ELSE least(packet, size - i * packet) END AS part
      FROM (SELECT *, unnest(range(0, CASE WHEN whole THEN 1 ELSE least(ceil(size / packet), ceil((late * target - start) / packet)) END::BIGINT)) AS i FROM g)),
-- the queue: one order by virtual finish time, cut where the budget ends
f AS (SELECT r, budget, part, sum(part) OVER (ORDER BY (since + part) / target, h, doc_id, r, pass, i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - part AS place FROM e),
x AS (SELECT r, sum(least(part, budget - place))::BIGINT AS taken, min(place)::BIGINT AS mix_start FROM f WHERE place < budget GROUP BY r)
SELECT doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken, mix_start FROM c LEFT JOIN x USING (r)
"""

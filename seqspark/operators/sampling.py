"""Selection, sorting and weighted sampling of hits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .windows import running_sum, top_k


def sort_global(df: DataFrame, *keys: str) -> DataFrame:
    return df.orderBy(*keys)


def sort_high_bits(df: DataFrame, key: str, bits: int = 16, partitions: int | None = None) -> DataFrame:
    """Coarse order by the high bits only: ranges of the key, sorted within."""
    high = F.shiftrightunsigned(F.col(key), bits)
    return df.withColumn("_h", high).repartitionByRange(*([partitions] if partitions else []), F.col("_h")).sortWithinPartitions("_h").drop("_h")


def merge_sorted(a: Column, b: Column) -> Column:
    """Two sorted arrays as one."""
    return F.array_sort(F.concat(a, b))


def smallest_ranges(ranges: DataFrame, most: int = 100) -> DataFrame:
    """The bounded heap of a read: its ``most`` smallest ranges, the largest evicted first."""
    size = F.col("sa_end") - F.col("sa_begin")
    return top_k(ranges.withColumn("size", size), ["read_id"], [F.col("size"), F.col("pos_in_read"), F.col("rc"), F.col("sa_begin")], most)


def both_ends(df: DataFrame, key: str, order: str) -> DataFrame:
    """Double-ended queue ranks: place from the smallest and from the largest."""
    w = Window.partitionBy(key)
    return df.withColumn("from_bottom", F.row_number().over(w.orderBy(F.col(order).asc(), "id"))).withColumn("from_top", F.row_number().over(w.orderBy(F.col(order).desc(), "id")))


def select_round(ranges: DataFrame, round_no: int, width: int = 1) -> DataFrame:
    """The hits that round ``round_no`` takes: ``width`` suffix-array rows a read, smallest range first, going on where one is used up.

    A range's place is its running size within the read, so only the ranges a round meets are exploded.
    """
    w = Window.partitionBy("read_id").orderBy("size", "pos_in_read", "rc", "sa_begin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = ranges.withColumn("size", F.col("sa_end") - F.col("sa_begin")).where("size > 0").withColumn("_to", F.sum("size").over(w)).withColumn("_from", F.col("_to") - F.col("size"))
    low, high = round_no * width, (round_no + 1) * width
    met = placed.where((F.col("_to") > low) & (F.col("_from") < high))
    first, last = F.greatest(F.col("_from"), F.lit(low)), F.least(F.col("_to"), F.lit(high)) - 1
    rows = met.withColumn("_k", F.explode(F.sequence(first, last)))
    return rows.select("read_id", "pos_in_read", "rc", (F.col("sa_begin") + F.col("_k") - F.col("_from")).alias("row"), F.col("_k").alias("ord"))


def select_all(ranges: DataFrame) -> DataFrame:
    return ranges.where("sa_end > sa_begin").withColumn("row", F.explode(F.sequence(F.col("sa_begin"), F.col("sa_end") - 1)))


def select_top_range(ranges: DataFrame) -> DataFrame:
    return select_all(smallest_ranges(ranges, 1))


def uniform(*keys: Column) -> Column:
    """A number in (0, 1) from a digest of the keys: the same on every run."""
    digits = F.substring(F.md5(F.concat_ws(":", *(k.cast("string") for k in keys))), 1, 12)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 48)


def random_ranges(ranges: DataFrame, count: int, seed: int = 0, keep_top: bool = True) -> DataFrame:
    """``count`` ranges a read without replacement, with weight 1 / size squared (exponential keys); the smallest always, if asked."""
    size = (F.col("sa_end") - F.col("sa_begin")).cast("double")
    key = -F.log(uniform(F.lit(seed), F.col("read_id"), F.col("pos_in_read"), F.col("rc"), F.col("sa_begin"))) * size * size
    first = F.row_number().over(Window.partitionBy("read_id").orderBy(size, "pos_in_read", "rc", "sa_begin"))
    keyed = ranges.where("sa_end > sa_begin").withColumn("_key", key)
    if keep_top:
        keyed = keyed.withColumn("_key", F.when(first == 1, F.lit(-1.0)).otherwise(F.col("_key")))
    return top_k(keyed, ["read_id"], [F.col("_key")], count).drop("_key")


def prefix_weights(leaves: DataFrame) -> DataFrame:
    """(tree_id, leaf, weight, upto): inclusive sums of the weights in leaf order."""
    return running_sum(leaves, "leaf", "weight", "upto", ["tree_id"], inclusive=True)


def weighted_pick(leaves: DataFrame, draws: DataFrame) -> DataFrame:
    """Draws (tree_id, u) with the leaf they fall on: the first whose running sum exceeds u times the total, else the last with weight."""
    sums = prefix_weights(leaves).where("weight > 0")
    total = sums.groupBy("tree_id").agg(F.max("upto").alias("total"), F.max("leaf").alias("last"))
    wanted = draws.join(total, "tree_id")
    # a range join through the running sums: the leaf whose interval holds the number
    met = wanted.join(sums.select("tree_id", "leaf", (F.col("upto") - F.col("weight")).alias("_lo"), F.col("upto").alias("_hi")), "tree_id").where((F.col("u") * F.col("total") >= F.col("_lo")) & (F.col("u") * F.col("total") < F.col("_hi")))
    return wanted.join(met.select("tree_id", "u", "leaf"), ["tree_id", "u"], "left").select("tree_id", "u", F.coalesce("leaf", "last").alias("leaf"))

"""Running sums and top-k that don't gather a table in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_sum(df: DataFrame, order: str, value: str, out: str, group: list[str] | None = None, shift: int = 12, inclusive: bool = False) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over the rows before (or up to) a row, by an integer order column.

    Two levels: blocks of 2**shift keys are summed first, then rows within a block, so a window task holds one
    block or one row a block.
    """
    group = group or []
    keyed = df.withColumn("_b", F.shiftright(F.col(order).cast("long"), shift))
    sums = keyed.groupBy(*group, "_b").agg(F.sum(value).alias("_s"))
    across = (Window.partitionBy(*group).orderBy("_b") if group else Window.orderBy("_b")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    offsets = sums.select(*group, "_b", (F.sum("_s").over(across) - F.col("_s")).alias("_o"))
    within = Window.partitionBy(*group, "_b").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = F.col("_o") + F.sum(value).over(within)
    joined = keyed.join(offsets, [*group, "_b"])
    return joined.withColumn(out, (total if inclusive else total - F.col(value)).cast("long")).drop("_b", "_o")


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each key; Spark ranks within tasks before it shuffles, so a hot key sends k rows a task."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= k)

"""Connected components of a links table by alternating star operations; links never leave the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop_path


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the node's smallest neighbour (or itself)."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _named(stars: DataFrame) -> DataFrame:
    return stars.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(stars.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _at_once(edges: DataFrame) -> DataFrame:
    """The stars of all components, found by one task."""

    def run(batches):
        import pyarrow as pa

        from .simhash import forest

        t = pa.Table.from_batches([*batches], schema=pa.schema([("u", pa.int64()), ("v", pa.int64())]))
        if not t.num_rows:
            return
        u, v = forest(t.column("u").to_numpy(), t.column("v").to_numpy())
        for i in range(0, len(u), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(u[i : i + (1 << 16)]), pa.array(v[i : i + (1 << 16)])], names=["u", "v"])

    return edges.repartition(1).mapInArrow(run, "u long, v long")


def components(edges: DataFrame, most_rounds: int = 60, few: int = 0) -> DataFrame:
    """(node, root) of every node on an edge of (u, v); root is the component's smallest node.

    Joins are on the node with one row for each node on the other side, so AQE splits a node with very many
    links.  Each round is written to the shared folder.  Up to ``few`` links are joined by one task instead: rounds
    leave many jobs and plans with the driver.
    """
    now = cut(edges.where("u <> v").select("u", "v").distinct())
    state = _state(now)
    if state[0] <= few:
        after = cut(_at_once(now))
        drop_path(after.sparkSession, now)
        return _named(after)
    for _ in range(most_rounds):
        after = cut(_small_star(_large_star(now)))
        after_state = _state(after)
        drop_path(after.sparkSession, now)
        now = after
        if after_state == state:
            break
        state = after_state
    else:
        raise RuntimeError("components did not settle")
    return _named(now)

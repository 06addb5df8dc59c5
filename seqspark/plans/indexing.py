"""Index building from sequences to parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import index
from ..operators.windows import running_sum

TABLES = ("genome", "contigs", "ambs", "bwt", "ranks", "ssa", "meta")


def build_index(texts: DataFrame, path: str, sa_interval: int = 16, occ_interval: int = 64, both_strands: bool = False, long_texts: bool = True) -> None:
    """Writes the index of (ref_id, name, seq) below ``path``: sequences with unknown symbols filled, annotations, transform,
    sampled ranks and suffix array, metadata; with ``both_strands`` also the reversed texts' under ``reverse/``.

    With ``long_texts`` the suffix array comes by prefix doubling, each round written and read back.
    """
    spark = texts.sparkSession
    unknown = index.unknown_runs(texts)
    placed = running_sum(texts.withColumn("len", F.length("seq")), "ref_id", "len", "offset")
    holes = placed.select("ref_id", F.col("offset").alias("_base")).join(unknown, "ref_id").select((F.col("_base") + F.col("offset")).alias("offset"), "len", "amb")
    index.annotations(texts, placed, unknown).write.mode("overwrite").parquet(f"{path}/contigs")
    holes.write.mode("overwrite").parquet(f"{path}/ambs")
    index.fill_unknown(texts).select("ref_id", "seq").write.mode("overwrite").parquet(f"{path}/genome")
    genome = spark.read.parquet(f"{path}/genome")
    _one_direction(genome, path, sa_interval, occ_interval, long_texts)
    if both_strands:
        _one_direction(genome.withColumn("seq", F.reverse("seq")), f"{path}/reverse", sa_interval, occ_interval, long_texts)


def _one_direction(genome: DataFrame, path: str, sa_interval: int, occ_interval: int, long_texts: bool) -> None:
    spark = genome.sparkSession
    rounds = iter(range(1 << 10))

    def keep(df: DataFrame) -> DataFrame:
        at = f"{path}/rounds/{next(rounds)}"
        df.write.mode("overwrite").parquet(at)
        return spark.read.schema(df.schema).parquet(at)

    sa = index.suffix_array_doubling(genome, keep=keep) if long_texts else index.suffix_array(genome)
    index.bwt(genome, sa).write.mode("overwrite").parquet(f"{path}/bwt")
    rows = spark.read.parquet(f"{path}/bwt")
    index.occurrence_samples(index.rank_table(rows), occ_interval).write.mode("overwrite").parquet(f"{path}/ranks")
    index.ssa_by_row(rows.select("ref_id", "row", "pos"), sa_interval).write.mode("overwrite").parquet(f"{path}/ssa")
    primary = rows.where("ch = '$'").select("ref_id", F.col("row").alias("primary"))
    index.l2_counts(genome).join(primary, "ref_id").write.mode("overwrite").parquet(f"{path}/meta")


def load_index(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The index's tables by name, lazily: only what a plan uses is read."""
    return {t: spark.read.parquet(f"{path}/{t}") for t in TABLES}


def publish(tables: dict[str, DataFrame], prefix: str = "index_") -> list[str]:
    """Cached global views that other sessions of the application can query; returns their names."""
    names = []
    for name, df in tables.items():
        df.cache().createOrReplaceGlobalTempView(f"{prefix}{name}")
        names.append(f"global_temp.{prefix}{name}")
    return names

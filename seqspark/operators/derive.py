"""Sequence tables derived from the text tables by expressions that mean the same in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.symbols import AS_DNA, dna
from .windows import running_sum

SQL_DNA = f"translate(upper(regexp_replace(coalesce({{text}}, ''), '[^A-Za-z]', '', 'g')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '{AS_DNA}')"


def sql_dna(text: str = "text") -> str:
    return SQL_DNA.format(text=text)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sequences(spark: SparkSession, sf_dir: str, name: str = "documents", key: str = "doc_id", out: str = "ref_id") -> DataFrame:
    """(out, seq, len)"""
    seqs = table(spark, sf_dir, name).select(F.col(key).alias(out), dna(F.coalesce("text", F.lit(""))).alias("seq"))
    return seqs.withColumn("len", F.length("seq"))


def contigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ref_id, name, seq, len, offset): documents laid end to end in order of id."""
    return running_sum(sequences(spark, sf_dir), "ref_id", "len", "offset").withColumn("name", F.concat(F.lit("doc"), F.col("ref_id").cast("string")))


CONTIGS_SQL = f"SELECT doc_id AS ref_id, 'doc' || doc_id AS name, {sql_dna()} AS seq, length({sql_dna()}) AS len, (sum(length({sql_dna()})) OVER (ORDER BY doc_id) - length({sql_dna()}))::BIGINT AS \"offset\" FROM documents"


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(read_id, seq, len): benchmark items."""
    return sequences(spark, sf_dir, "benchmark", "item_id", "read_id")


READS_SQL = f"SELECT item_id AS read_id, {sql_dna()} AS seq, length({sql_dna()}) AS len FROM benchmark"


def qualities(df: DataFrame, key: str = "read_id", size: str = "len") -> DataFrame:
    """Adds qual: pmod(place * 7 + id, 41) for places from 1."""
    return df.withColumn("qual", F.when(F.col(size) > 0, F.transform(F.sequence(F.lit(1), F.greatest(F.col(size), F.lit(1))), lambda i: F.pmod(i * 7 + F.col(key), F.lit(41)).cast("int"))).otherwise(F.array().cast("array<int>")))

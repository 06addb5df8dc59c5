"""Corpus pipeline: documents without toxic texts, near copies, benchmark passages and secrets, mixed to source targets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from seqspark.llm import stages
from seqspark.llm.common import cut, drop_path, tracked

STAGES = [
    ("toxicity", stages.drop_toxic),
    ("simhash_near_dedup", stages.drop_near_duplicates),
    ("benchmark_decontamination", stages.drop_contaminated),
    ("secret_scan", stages.mask_secrets),
    ("source_mixing", stages.mix_sources),
]

#: Learned scores and sketches have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each keeps is written to the shared folder and read by the next.

    A stage's working tables, and what the stage before kept, are deleted once its result is written; those of the
    last stage, whose result is still to be read, when the driver ends.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for i, (_, stage) in enumerate(STAGES):
        with tracked() as used:
            out = stage(spark, docs, sf_dir)
        if i + 1 == len(STAGES):
            return out
        with tracked() as kept:
            docs = cut(out)
        for path in used + before:
            drop_path(spark, path)
        before = kept

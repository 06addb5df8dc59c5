"""All registered queries of the sequence operators, with the SQL that states the same result."""

from pyspark.sql import DataFrame, SparkSession

from . import alignments, files, indexes, lookups, records, symbols

QUERIES: dict = {}
ORACLES: dict = {}
for _module in (symbols, indexes, lookups, alignments, records, files):
    QUERIES.update(_module.QUERIES)
    ORACLES.update(_module.ORACLES)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seed lookup, diagonal vote and Hamming check of the benchmark reads against all documents."""
    return QUERIES["seed_vote"](spark, sf_dir)

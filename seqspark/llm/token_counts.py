"""Token counts through a digest cache.

Every text is reduced to a content digest; digests that the cache holds for this tokenizer version take the
stored count, and only one text of each missing digest is encoded and appended to the cache.

Defined results: a null text counts as the empty text; repeated rows each get a row; an empty table gives an
empty result and appends nothing; extra columns of the input are ignored (only ``doc_id`` and ``text`` are read).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, fresh, shared_dir, table, with_row

CACHE_SCHEMA = "tokenizer string, digest binary, n_tokens long"
_LOADED: dict[str, object] = {}


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def tokenizer_version(path: str) -> str:
    """Digest of the vocabulary file: another file is another tokenizer."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def load_encoder(path: str):
    """``texts -> counts`` for a .model (sentencepiece) or .json (tokenizers) file, kept for the worker's life."""
    if path not in _LOADED:
        if path.endswith(".model"):
            import sentencepiece

            sp = sentencepiece.SentencePieceProcessor(model_file=path)
            _LOADED[path] = lambda texts: [len(x) for x in sp.encode(texts, num_threads=1)]
        elif path.endswith(".json"):
            from tokenizers import Tokenizer

            tok = Tokenizer.from_file(path)
            tok.no_truncation()
            tok.no_padding()
            _LOADED[path] = lambda texts: [len(tok.encode(t, add_special_tokens=False).ids) for t in texts]
        else:
            raise ValueError(f"no library for {path}")
    return _LOADED[path]


def _encode_batches(name: str, max_chars: int = 1 << 20):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count = load_encoder(tokenizer_path(name))
        for b in batches:
            texts, out, start, size = b["text"].tolist(), [], 0, 0
            for i, t in enumerate(texts):
                size += len(t)
                if size > max_chars:
                    out += count(texts[start : i + 1])
                    start, size = i + 1, 0
            out += count(texts[start:]) if start < len(texts) else []
            yield pd.DataFrame({"digest": b["digest"], "n_tokens": pd.array(out, dtype="int64")})

    return run


#: A digest with more than this share of the rows is joined by broadcast: there are fewer than 1 / HOT of them.
HOT = 1 / 1000


def token_counts(docs: DataFrame, name: str, cache: str, limit: int = 4096) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row; ``cache`` is a parquet folder that may not exist yet.

    Normalising maps null to the empty text and nothing else: any further change could alter a count.  Digests meet
    the cache first; texts are fetched only for one row of each digest that it lacks.
    """
    spark = docs.sparkSession
    version = tokenizer_version(tokenizer_path(name))
    row, = fresh(docs, "_row")
    text = F.coalesce(F.col("text"), F.lit(""))
    placed = with_row(docs, row).select(F.col(row).alias("row"), "doc_id", text.alias("text"))
    slim = cut(placed.select("row", "doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.unhex(F.sha2("text", 256)).alias("digest")))
    # one row a digest: partial aggregation leaves a row for each digest and task, whatever the size of a group of copies
    digests = cut(slim.groupBy("digest").agg(F.count("*").alias("n"), F.min("row").alias("row")))
    known = lambda: read_cache(spark, cache).where(F.col("tokenizer") == version).select("digest", "n_tokens").dropDuplicates(["digest"])
    misses = digests.join(known(), "digest", "left_anti").select("row", "digest")
    fresh_counts = placed.select("row", "text").join(misses, "row").select("digest", "text").mapInPandas(_encode_batches(name), "digest binary, n_tokens long")
    fresh_counts.select(F.lit(version).alias("tokenizer"), "digest", "n_tokens").write.mode("append").parquet(cache)
    counts = known()
    total = digests.agg(F.sum("n")).first()[0] or 0
    hot = digests.where(F.col("n") > HOT * total).select("digest")
    often = slim.join(F.broadcast(counts.join(F.broadcast(hot), "digest", "left_semi")), "digest")
    rest = slim.join(F.broadcast(hot), "digest", "left_anti").join(counts, "digest")
    return often.unionByName(rest).select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def read_cache(spark: SparkSession, cache: str) -> DataFrame:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(cache)
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], CACHE_SCHEMA)
    return spark.read.schema(CACHE_SCHEMA).parquet(cache)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: all documents against a cache that starts empty, so every distinct text is encoded once."""
    return token_counts(table(spark, sf_dir, "documents"), "piece_bpe_32k.model", shared_dir(spark))

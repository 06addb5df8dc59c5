"""Helpers shared by the corpus operators: reading, label folds, bounded samples, checkpoints."""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id's text modulo ``folds``; null for a null id."""
    return F.crc32(doc_id.cast("string")) % F.lit(folds)


def held_out(doc_id: Column, folds: int, at: int) -> Column:
    return F.coalesce(fold(doc_id, folds) == at, F.lit(False))


def shared_dir(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``, which all executors share.

    Where the session names none (local tests), a temporary folder of this machine is set up; a cluster
    must name one.
    """
    base = spark.conf.get("spark.checkpoint.dir", "") or ""
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), "seqspark-checkpoints")
    path = f"{base.rstrip('/')}/{uuid.uuid4().hex}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)  # what nobody has dropped goes with the driver
    for paths in _TRACKED.get():
        paths.append(path)
    return path


#: Lists that gather the folders made while they are open.
_TRACKED: ContextVar[tuple[list[str], ...]] = ContextVar("_TRACKED", default=())


@contextmanager
def tracked():
    """A list of the folders that :func:`shared_dir` names within the block."""
    paths: list[str] = []
    token = _TRACKED.set((*_TRACKED.get(), paths))
    try:
        yield paths
    finally:
        _TRACKED.reset(token)


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back: short lineage that survives lost executors."""
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as make it new among the columns of ``df`` (in any case)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def with_row(docs: DataFrame, name: str) -> DataFrame:
    """``docs`` with ``name``: a row's file and its place there, the same however often and in what splits the rows are read.

    Numbers that Spark gives out while it runs depend on the splits, and these on the executors at hand.  What isn't
    a plain scan of Parquet files is written to the shared folder first.
    """
    for df in (docs, None):
        df = cut(docs) if df is None else df
        if df._jdf.queryExecution().analyzed().getClass().getSimpleName() != "LogicalRelation":
            continue
        meta = df.metadataColumn("_metadata")
        try:
            return df.select("*", F.struct(F.xxhash64(meta["file_path"]).alias("file"), meta["row_index"].alias("place")).alias(name))
        except AnalysisException:  # files of another format have no row_index
            continue
    raise AssertionError("a Parquet table has rows in files")


def drop_path(spark: SparkSession, df_or_path) -> None:
    """Delete what :func:`cut` wrote."""
    paths = [df_or_path] if isinstance(df_or_path, str) else list({os.path.dirname(f) for f in df_or_path.inputFiles()})
    jvm = spark.sparkContext._jvm
    for p in paths:
        hpath = jvm.org.apache.hadoop.fs.Path(p)
        hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hpath, True)


def lowest_ids(df: DataFrame, id_col: str, bound: int, seed: int = 7) -> DataFrame:
    """At most ``bound`` distinct non-null ids: those with the smallest seeded hash, so that reruns agree."""
    ids = df.select(F.col(id_col).alias("_id")).where(F.col("_id").isNotNull()).distinct()
    return ids.orderBy(F.xxhash64(F.lit(seed), F.col("_id")), F.col("_id")).limit(bound)


def pick(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose doc_id is among ``ids`` (_id, and further columns); ids has a documented bound, so it is broadcast."""
    return docs.join(F.broadcast(ids), docs["doc_id"] == ids["_id"])


def map_texts(df: DataFrame, make, fields: list[tuple[str, str]], max_chars: int = 4_000_000) -> DataFrame:
    """``df`` without ``text``, plus the columns that ``make()(texts)`` computes from whole texts; no shuffle.

    ``make`` runs once a task; its result takes a list of texts (None for null) and returns one list or array
    for each of ``fields`` (name, Spark type).  Texts are handed over in slices of about ``max_chars``.  Other
    columns pass through as Arrow arrays, untouched.
    """
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_type

    keep = [c for c in df.columns if c != "text"]
    added = T._parse_datatype_string(", ".join(f"`{n}` {t}" for n, t in fields))
    arrow = {f.name: to_arrow_type(f.dataType) for f in added.fields}
    schema = T.StructType([df.schema[c] for c in keep] + added.fields)

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        fn = make()
        for b in batches:
            chars = pc.fill_null(pc.binary_length(b.column("text")), 0).to_numpy(zero_copy_only=False).cumsum()
            start = 0
            while start < b.num_rows:
                base = chars[start - 1] if start else 0
                end = max(start + 1, int(chars.searchsorted(base + max_chars, "right")))
                part = b.slice(start, end - start)
                cols = fn(part.column("text").to_pylist())
                arrays = [part.column(c) for c in keep] + [pa.array(v, type=t) for v, t in zip(cols, arrow.values(), strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names=[*keep, *arrow])
                start = end

    return df.select(*keep, "text").mapInArrow(run, schema)

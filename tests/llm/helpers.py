"""Small awkward tables and brute-force versions."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def awkward(spark):
    """Null columns, empty, blank and very long texts, repeated rows, clashing extra columns."""
    long = "the quick brown fox jumps over the lazy dog " * 700
    rows = [
        (1, "alpha beta gamma delta", "en", "a", 22), (2, None, None, None, None), (3, "", "en", "a", 0), (4, " \t\n ", "en", None, 4), (5, long, "en", "b", len(long)), (1, "alpha beta gamma delta", "en", "a", 22),
        (6, "Größe ähnlich 𝒳 naïve", "de", "b", 21), (None, "no id here", "en", "b", 10), (7, "x" * 70000, None, "c", 70000), (8, "12345 !!! ###", "en", "c", 13),
    ]
    df = spark.createDataFrame(rows, DOCS)
    extra = df
    for name in ("size", "score", "code", "fp", "text_", "node", "digest", "_row", "word", "predicted", "held_out", "h"):
        from pyspark.sql import functions as F

        extra = extra.withColumn(name, F.lit("clash"))
    return extra


def empty(spark):
    return spark.createDataFrame([], DOCS)


def save(df, folder, name):
    df.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")

"""Benchmark decontamination by winnowing.  DataFrame functions only.

Both sides are cut into words; every k-gram of words is hashed and of each run of ``w`` k-grams the smallest hash
is kept as a fingerprint with its place, w + k - 1 = 10, so any shared span of ten words has a fingerprint at the
same place on both sides.  Fingerprints are joined, each hit is extended word by word to both sides, and the
windows of ten equal words around it are covered.  Items with fewer than ten words are one window of their own
length and match through hashes of that length.

Each fingerprint row carries the words that its extension can need, so verifying asks for no second join and
works alike for a short text and a very long one.

Defined results: a null or wordless text has no words, no hits, no items; a null or wordless item matches nothing;
an item_id that repeats counts once; documents that repeat each get a row; empty tables give empty results or
clean documents; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, table, with_row

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same once A-Z are lower case: the usual letters are tested first, and a run is never given back.
LOWERED_WORD = r"[a-z\x{80}-\x{10FFFF}0-9]++"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WINDOW, GRAM = 10, 5
RUN = WINDOW - GRAM + 1
SIDE = WINDOW - GRAM
#: Most bytes of benchmark text whose fingerprints are broadcast; beyond it the join shuffles.
BROADCAST_BYTES = 8 << 20


def words(text: Column) -> Column:
    low = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))  # A-Z only
    return F.coalesce(F.regexp_extract_all(low, F.lit(LOWERED_WORD), F.lit(0)), F.array().cast("array<string>"))


def _gram_hashes(wh: Column, n: int) -> Column:
    """Hashes of the n-grams over an array of word hashes; empty if it is shorter."""
    count = F.size(wh) - (n - 1)
    grams = F.transform(F.sequence(F.lit(0), F.greatest(count, F.lit(1)) - 1), lambda i: F.xxhash64(*(F.get(wh, i + j) for j in range(n))))
    return F.when(count > 0, grams).otherwise(F.array().cast("array<bigint>"))


def _stretch(tests: list[Column]) -> Column:
    """How many of ``tests`` hold before the first that doesn't (null: doesn't)."""
    out = F.lit(len(tests))
    for n, test in reversed(list(enumerate(tests))):
        out = F.when(F.coalesce(test, F.lit(False)), out).otherwise(F.lit(n))
    return out


def fingerprints(df: DataFrame) -> DataFrame:
    """``df`` (with words ``_w``) exploded into winnowed fingerprints ``_h`` at word ``_i``, and a row at -1 for each row of df.

    A k-gram stays if it is the least of some run of RUN k-grams (ties all stay): the k-grams to its left and
    right that aren't smaller make up such a run with it.
    """
    grams = df.withColumn("_wh", F.transform("_w", lambda x: F.xxhash64(x))).withColumn("_g", _gram_hashes(F.col("_wh"), GRAM)).drop("_wh")
    rows = grams.withColumn("_i", F.explode(F.sequence(F.lit(-1), F.size("_g") - 1))).withColumn("_h", F.get("_g", F.col("_i")))
    left = _stretch([F.get("_g", F.col("_i") - j) >= F.col("_h") for j in range(1, RUN)])
    right = _stretch([F.get("_g", F.col("_i") + j) >= F.col("_h") for j in range(1, RUN)])
    return rows.where((F.col("_i") < 0) | (left + right + 1 >= RUN)).drop("_g")


def hits(docs: DataFrame, items: DataFrame, broadcast: bool, lengths: list[int]) -> DataFrame:
    """(_row, doc_id, n_words, item_id, _from, _to) of every verified span, and a row without item for each document."""
    hint = F.broadcast if broadcast else (lambda x: x)
    around = range(-SIDE, WINDOW)
    bench = fingerprints(items.where(F.size("_w") >= WINDOW)).where("_i >= 0")
    bench = bench.select("item_id", F.col("_h").alias("_bh"), F.array(*(F.get("_w", F.col("_i") + j) for j in around)).alias("_b"))
    marked = fingerprints(docs)
    context = lambda: F.array(*(F.get("_w", F.col("_i") + j) for j in around))
    if not broadcast:  # a shuffled row takes along only the words that it can need
        marked = marked.withColumn("_d", context()).drop("_w")
    met = marked.join(hint(bench), F.col("_h") == F.col("_bh"), "left").where((F.col("_i") < 0) | F.col("_bh").isNotNull())
    if broadcast:
        met = met.withColumn("_d", context())
    # _d is used twice, so it is computed in the join's generated code and no row with a whole text's words leaves that;
    # and no filter on what follows, as it would be merged into the one that every fingerprint passes
    eq = F.zip_with("_d", "_b", lambda x, y: F.coalesce(x == y, F.lit(False)))
    met = met.select("_row", "doc_id", "n_words", "item_id", "_i", eq.alias("_eq"), F.size("_d").alias("_n"))
    run = lambda part, n: F.coalesce(F.when(F.array_position(part, F.lit(False)) == 0, F.lit(n)).otherwise(F.array_position(part, F.lit(False)) - 1), F.lit(0))
    left, right = run(F.reverse(F.slice("_eq", 1, SIDE)), SIDE), run(F.slice("_eq", SIDE + 1, WINDOW), WINDOW)
    found = met.select("_row", "doc_id", "n_words", "item_id", "_i", left.cast("int").alias("_l"), right.cast("int").alias("_r"), "_n")
    ok = (F.col("_i") >= 0) & (F.col("_n") == len(around)) & (F.col("_r") >= GRAM) & (F.col("_l") + F.col("_r") >= WINDOW)
    found = found.select("_row", "doc_id", "n_words", "item_id", (F.col("_i") - F.col("_l")).alias("_from"), (F.col("_i") + F.col("_r")).alias("_to"), ok.alias("_ok"))
    for n in lengths:
        few = items.where(F.size("_w") == n).select("item_id", F.col("_w").alias("_b")).withColumn("_bh", F.xxhash64(F.array_join("_b", " ")))
        at = docs.where(F.size("_w") >= n).withColumn("_i", F.explode(F.sequence(F.lit(0), F.size("_w") - n)))
        at = at.withColumn("_t", F.concat_ws(" ", *(F.get("_w", F.col("_i") + j) for j in range(n)))).withColumn("_h", F.xxhash64("_t"))
        same = at.join(hint(few), (F.col("_h") == F.col("_bh")) & (F.col("_t") == F.array_join("_b", " ")))
        found = found.unionByName(same.select("_row", "doc_id", "n_words", "item_id", F.col("_i").alias("_from"), (F.col("_i") + n).alias("_to"), F.lit(True).alias("_ok")))
    return found


def contamination(docs: DataFrame, benchmark: DataFrame, row: str | None = None) -> DataFrame:
    """One row for every row of ``docs`` (doc_id, text): doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    ``row`` names a column that tells rows apart, which comes back too; without one it is a row's place in its file.
    """
    at = row or fresh(docs, "_row")[0]
    keyed = (docs if row else with_row(docs, at)).select(F.col(at).alias("_row"), "doc_id", "text")
    items = benchmark.select("item_id", words(F.col("text")).alias("_w"))
    sized = benchmark.select(F.octet_length("text").alias("bytes"), F.size(words(F.col("text"))).alias("n"))
    total, lengths = sized.agg(F.sum("bytes"), F.array_sort(F.collect_set(F.when((F.col("n") > 0) & (F.col("n") < WINDOW), F.col("n"))))).first()
    listed = keyed.select("_row", "doc_id", words(F.col("text")).alias("_w")).withColumn("n_words", F.size("_w").cast("long"))
    found = hits(listed, items, (total or 0) <= BROADCAST_BYTES, lengths)
    # a document's spans are at most as many as its words: gathering them is bounded by its own length
    spans = F.array_sort(F.collect_set(F.when(F.col("_ok"), F.struct("_from", "_to"))))
    per = found.groupBy("_row").agg(F.first("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), spans.alias("_spans"), F.array_sort(F.collect_set(F.when(F.col("_ok"), F.col("item_id").cast("string")))).alias("_items"))
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("to"))
    covered = F.aggregate("_spans", start, lambda a, x: F.struct((a["n"] + F.greatest(F.lit(0), x["_to"] - F.greatest(x["_from"], a["to"]))).alias("n"), F.greatest(a["to"], x["_to"]).alias("to")))["n"]
    out = per.withColumn("n_hit", covered.cast("long"))
    return out.select(*([F.col("_row").alias(row)] if row else []), "doc_id", "n_words", "n_hit", F.size("_items").cast("long").alias("n_items"), F.sha2(F.array_join("_items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: all documents against all benchmark items."""
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark").select("item_id", "text"))


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w,
             row_number() OVER () AS r FROM documents),
b AS (SELECT item_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS g
       FROM (SELECT *, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT r, n, i, array_to_string(w[i : i + n - 1], ' ') AS g
       FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
h AS (SELECT r, item_id, i, dw.n FROM dw JOIN bw ON dw.n = bw.n AND dw.g = bw.g),
p AS (SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS k FROM h) GROUP BY r),
t AS (SELECT r, count(item_id) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM (SELECT DISTINCT r, item_id FROM h) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p USING (r) LEFT JOIN t USING (r)
"""

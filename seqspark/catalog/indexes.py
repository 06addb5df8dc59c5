"""Queries of index construction: the texts are the benchmark items, whole."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import index
from ..operators.derive import READS_SQL, contigs, CONTIGS_SQL, reads, sequences, table
from .symbols import DOCS

QUERIES, ORACLES = {}, {}

SA_SQL = f"SELECT ref_id, (row_number() OVER (PARTITION BY ref_id ORDER BY substr(seq, pos + 1)) - 1)::INT AS \"row\", pos, seq FROM (SELECT read_id AS ref_id, seq, unnest(range(0, len + 1))::INT AS pos FROM ({READS_SQL}))"
BWT_SQL = f"SELECT ref_id, \"row\", pos, CASE WHEN pos = 0 THEN '$' ELSE substr(seq, pos, 1) END AS ch, seq FROM ({SA_SQL})"
RANK_SQL = f"SELECT ref_id, \"row\", pos, ch, " + ", ".join(f"(count(*) FILTER (ch = '{c}') OVER (PARTITION BY ref_id ORDER BY \"row\"))::BIGINT AS occ_{c.lower()}" for c in "ACGT") + f" FROM ({BWT_SQL})"


def register(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def texts(spark, sf_dir):
    return reads(spark, sf_dir).select(F.col("read_id").alias("ref_id"), "seq")


def sa_of(spark, sf_dir):
    return index.suffix_array(texts(spark, sf_dir))


def bwt_of(spark, sf_dir):
    return index.bwt(texts(spark, sf_dir), sa_of(spark, sf_dir))


@register("suffix_array", f'SELECT ref_id, "row", pos FROM ({SA_SQL})')
def suffix_array(spark, sf_dir):
    return sa_of(spark, sf_dir)


@register("suffix_array_doubling", f'SELECT ref_id, "row", pos FROM ({SA_SQL})')
def suffix_array_doubling(spark, sf_dir):
    return index.suffix_array_doubling(texts(spark, sf_dir), keep=lambda df: df.checkpoint() if spark.sparkContext.getCheckpointDir() else df)


@register("bwt", f'SELECT ref_id, "row", pos, ch FROM ({BWT_SQL})')
def bwt(spark, sf_dir):
    return bwt_of(spark, sf_dir)


@register("bwt_string", f"SELECT ref_id, string_agg(CASE WHEN ch = '$' THEN '' ELSE ch END, '' ORDER BY \"row\") AS bwt, max(\"row\") FILTER (ch = '$') AS \"primary\" FROM ({BWT_SQL}) GROUP BY ref_id")
def bwt_string(spark, sf_dir):
    return index.bwt_string(bwt_of(spark, sf_dir))


@register("reverse_bwt", f"SELECT ref_id, string_agg(CASE WHEN pos = 0 THEN '' ELSE substr(seq, pos, 1) END, '' ORDER BY \"row\") AS bwt, max(\"row\") FILTER (pos = 0) AS \"primary\" FROM ({SA_SQL.replace('SELECT read_id AS ref_id, seq,', 'SELECT read_id AS ref_id, reverse(seq) AS seq,')}) GROUP BY ref_id")
def reverse_bwt(spark, sf_dir):
    back = texts(spark, sf_dir).withColumn("seq", F.reverse("seq"))
    return index.bwt_string(index.bwt(back, index.suffix_array(back)))


@register("l2_counts", f"SELECT read_id AS ref_id, len::INT AS length, a AS l2_c, a + c AS l2_g, a + c + g AS l2_t FROM (SELECT *, (len - length(replace(seq, 'A', '')))::INT AS a, (len - length(replace(seq, 'C', '')))::INT AS c, (len - length(replace(seq, 'G', '')))::INT AS g FROM ({READS_SQL}))")
def l2_counts(spark, sf_dir):
    return index.l2_counts(texts(spark, sf_dir)).select("ref_id", "length", *(F.col("l2")[i].alias(f"l2_{c}") for i, c in ((1, "c"), (2, "g"), (3, "t"))))


@register("rank_table", f"SELECT * FROM ({RANK_SQL})")
def rank_table(spark, sf_dir):
    return index.rank_table(bwt_of(spark, sf_dir))


@register("occurrence_samples", f'SELECT * FROM ({RANK_SQL}) WHERE "row" % 64 = 63')
def occurrence_samples(spark, sf_dir):
    return index.occurrence_samples(index.rank_table(bwt_of(spark, sf_dir)))


@register("ssa_by_value", f'SELECT ref_id, "row", pos FROM ({SA_SQL}) WHERE pos % 32 = 0')
def ssa_by_value(spark, sf_dir):
    return index.ssa_by_value(sa_of(spark, sf_dir))


@register("ssa_by_row", f'SELECT ref_id, "row", pos FROM ({SA_SQL}) WHERE "row" % 32 = 0')
def ssa_by_row(spark, sf_dir):
    return index.ssa_by_row(sa_of(spark, sf_dir))


@register("inverse_psi", f"SELECT ref_id, \"row\", ch, (row_number() OVER (PARTITION BY ref_id ORDER BY CASE WHEN ch = '$' THEN '' ELSE ch END, \"row\") - 1)::INT AS lf FROM ({BWT_SQL})")
def inverse_psi(spark, sf_dir):
    return index.inverse_psi(bwt_of(spark, sf_dir))


@register("base_counts", f"SELECT count(*) AS n_seqs, sum(length(seq))::BIGINT AS n_bases FROM {DOCS}")
def base_counts(spark, sf_dir):
    return index.base_counts(sequences(spark, sf_dir))


@register("contig_offsets", f'SELECT ref_id, name, len, "offset" FROM ({CONTIGS_SQL})')
def contig_offsets(spark, sf_dir):
    return contigs(spark, sf_dir).select("ref_id", "name", F.col("len").cast("long").alias("len"), "offset")


def masked(spark, sf_dir):
    """Letters B become N: runs to find."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("ref_id"), F.regexp_replace(F.translate(F.upper(F.regexp_replace("text", "[^A-Za-z]", "")), "HIJ", "NNN"), "[^ACGTN]", "A").alias("seq"))


@register("unknown_runs", """WITH s AS (SELECT item_id AS ref_id, regexp_replace(translate(upper(regexp_replace(text, '[^A-Za-z]', '', 'g')), 'HIJ', 'NNN'), '[^ACGTN]', 'A', 'g') AS seq FROM benchmark),
  p AS (SELECT ref_id, i, substr(seq, i + 1, 1) AS c FROM (SELECT ref_id, seq, unnest(range(0, length(seq))) AS i FROM s)),
  n AS (SELECT ref_id, i, i - row_number() OVER (PARTITION BY ref_id ORDER BY i) AS g FROM p WHERE c = 'N')
  SELECT ref_id, min(i)::BIGINT AS "offset", count(*)::INT AS len, 'N' AS amb FROM n GROUP BY ref_id, g""")
def unknown_runs(spark, sf_dir):
    return index.unknown_runs(masked(spark, sf_dir))


@register("fill_unknown", """WITH s AS (SELECT item_id AS ref_id, regexp_replace(translate(upper(regexp_replace(text, '[^A-Za-z]', '', 'g')), 'HIJ', 'NNN'), '[^ACGTN]', 'A', 'g') AS seq FROM benchmark)
  SELECT ref_id, array_to_string(list_transform(range(1, length(seq) + 1), lambda i: CASE WHEN substr(seq, i, 1) <> 'N' THEN substr(seq, i, 1) ELSE substr('ACGT', ((strpos('0123456789abcdef', substr(md5('11:' || ref_id || ':' || (i - 1)), 1, 1)) - 1) % 4 + 1)::INT, 1) END), '') AS seq FROM s""")
def fill_unknown(spark, sf_dir):
    return index.fill_unknown(masked(spark, sf_dir))


@register("contig_annotations", f'SELECT ref_id, name, "offset", len, 0::BIGINT AS n_ambs FROM ({CONTIGS_SQL})')
def contig_annotations(spark, sf_dir):
    c = contigs(spark, sf_dir)
    return index.annotations(c, c.withColumn("len", F.col("len").cast("long")), index.unknown_runs(c))


TRIE_SQL = "SELECT substr(p_name, 1, l) AS prefix, l::INT AS level, count(*) AS n, count(*) FILTER (length(p_name) = l) AS n_leaf FROM (SELECT p_name, unnest(range(0, length(p_name) + 1)) AS l FROM part) GROUP BY 1, 2"


@register("trie_nodes", TRIE_SQL)
def trie_nodes(spark, sf_dir):
    return index.trie_nodes(table(spark, sf_dir, "part"), "p_name")


@register("trie_children", f"SELECT substr(prefix, 1, level - 1) AS parent, prefix AS child, substr(prefix, -1) AS symbol, n FROM ({TRIE_SQL}) WHERE level > 0")
def trie_children(spark, sf_dir):
    return index.trie_children(index.trie_nodes(table(spark, sf_dir, "part"), "p_name"))


@register("dictionary_ranges", 'SELECT prefix, (sum(n) OVER (ORDER BY prefix) - n)::BIGINT AS "begin", (sum(n) OVER (ORDER BY prefix))::BIGINT AS "end" FROM (SELECT substr(p_name, 1, 3) AS prefix, count(*) AS n FROM part GROUP BY 1)')
def dictionary_ranges(spark, sf_dir):
    return index.dictionary_ranges(table(spark, sf_dir, "part"), "p_name", 3)

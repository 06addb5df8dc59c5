"""Queries of lookups, selection and sampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import filters, index, lookup, reduce, sampling
from ..operators.derive import READS_SQL, reads, sequences, sql_dna, table
from ..plans.aligner import seed_vote as vote
from .indexes import RANK_SQL, SA_SQL, bwt_of, sa_of, texts
from .symbols import DOCS

QUERIES, ORACLES = {}, {}


def register(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


CONV = f"(SELECT conv_id * 1000 + turn AS query_id, {sql_dna()} AS seq FROM conversations)"


def conv(spark, sf_dir):
    from ..functions.symbols import dna

    return table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), dna(F.coalesce("text", F.lit(""))).alias("seq"))


@register("kmer_count", f"SELECT kmer, count(*) AS n FROM (SELECT substr(seq, i, 12) AS kmer FROM (SELECT seq, unnest(range(1, length(seq) - 10)) AS i FROM {DOCS} WHERE length(seq) >= 12)) GROUP BY kmer")
def kmer_count(spark, sf_dir):
    return lookup.kmer_counts(sequences(spark, sf_dir), 12)


RANGES_SQL = f'SELECT ref_id, substr(seq, pos + 1, 8) AS kmer, min("row") AS "begin", max("row") AS "end" FROM ({SA_SQL}) WHERE pos + 8 <= length(seq) GROUP BY 1, 2'


def pieces_sql(k: int) -> str:
    return f"SELECT query_id * 1000000 + i AS query_id, substr(seq, (i + 1)::INT, {k}) AS pattern FROM (SELECT query_id, seq, unnest(range(0, length(seq) - {k - 1}, {k})) AS i FROM {CONV} WHERE length(seq) >= {k})"


PATTERNS_SQL = pieces_sql(8)


def pieces(spark, sf_dir, k: int):
    """Whole conversations cut into consecutive patterns."""
    return lookup.kmers(conv(spark, sf_dir), k, "query_id", step=k).select((F.col("query_id") * 1000000 + F.col("pos")).alias("query_id"), F.col("kmer").alias("pattern"))


def patterns(spark, sf_dir):
    return pieces(spark, sf_dir, 8)


@register("fm_match", f'SELECT query_id, ref_id, "begin", "end" FROM ({PATTERNS_SQL}) p JOIN ({RANGES_SQL}) r ON p.pattern = r.kmer')
def fm_match(spark, sf_dir):
    t = texts(spark, sf_dir)
    return lookup.match(lookup.match_ranges(sa_of(spark, sf_dir), t, 8), patterns(spark, sf_dir)).select("query_id", "ref_id", "begin", "end")


@register("fm_match_reverse", f'SELECT query_id, ref_id, "begin", "end" FROM ({PATTERNS_SQL}) p JOIN ({RANGES_SQL}) r ON reverse(p.pattern) = r.kmer')
def fm_match_reverse(spark, sf_dir):
    t = texts(spark, sf_dir)
    return lookup.match(lookup.match_ranges(sa_of(spark, sf_dir), t, 8), patterns(spark, sf_dir), backwards=True).select("query_id", "ref_id", "begin", "end")


LOCATE_SQL = f"SELECT query_id, ref_id, pos FROM ({PATTERNS_SQL}) p JOIN (SELECT ref_id, pos, substr(seq, pos + 1, 8) AS kmer FROM ({SA_SQL}) WHERE pos + 8 <= length(seq)) t ON p.pattern = t.kmer"


@register("fm_locate", LOCATE_SQL)
def fm_locate(spark, sf_dir):
    t, sa = texts(spark, sf_dir), sa_of(spark, sf_dir)
    hits = lookup.match(lookup.match_ranges(sa, t, 8), patterns(spark, sf_dir))
    return lookup.locate(hits, sa).select("query_id", "ref_id", "pos")


@register("fm_locate_sampled", LOCATE_SQL)
def fm_locate_sampled(spark, sf_dir):
    t, sa = texts(spark, sf_dir), sa_of(spark, sf_dir)
    hits = lookup.match(lookup.match_ranges(sa, t, 8), patterns(spark, sf_dir)).withColumn("row", F.explode(F.sequence("begin", "end")))
    walk = index.inverse_psi(bwt_of(spark, sf_dir))
    return lookup.locate_sampled(hits, index.ssa_by_value(sa, 4), walk, 4).select("query_id", "ref_id", "pos")


@register("rank_queries", f"""SELECT q.ref_id, q."row", q.ch, (CASE q.ch WHEN 'A' THEN occ_a WHEN 'C' THEN occ_c WHEN 'G' THEN occ_g ELSE occ_t END)::BIGINT AS rank
  FROM (SELECT ref_id, "row", substr('ACGT', ("row" % 4 + 1)::INT, 1) AS ch FROM ({SA_SQL})) q JOIN ({RANK_SQL}) r ON q.ref_id = r.ref_id AND q."row" = r."row" """)
def rank_queries(spark, sf_dir):
    ranks = index.rank_table(bwt_of(spark, sf_dir))
    q = sa_of(spark, sf_dir).select("ref_id", "row", F.substring(F.lit("ACGT"), (F.col("row") % 4 + 1).cast("int"), 1).alias("ch"))
    return lookup.rank_at(ranks, q)


SEEDS_SQL = f"""SELECT read_id, i::INT AS pos_in_read, rc, substr(s, i + 1, 16) AS seed FROM (SELECT read_id, rc, s, unnest(range(0, length(s) - 15, 15)) AS i FROM
  (SELECT read_id, 0 AS rc, seq AS s FROM ({READS_SQL}) UNION ALL SELECT read_id, 1, reverse(translate(seq, 'ACGT', 'TGCA')) FROM ({READS_SQL})) WHERE length(s) >= 16)"""
KMERS_SQL = f"SELECT ref_id, (i - 1)::INT AS pos, substr(seq, i, 16) AS seed FROM (SELECT doc_id AS ref_id, seq, unnest(range(1, length(seq) - 14)) AS i FROM {DOCS} WHERE length(seq) >= 16)"
HITS_SQL = f"SELECT read_id, ref_id, rc, pos_in_read, pos FROM ({SEEDS_SQL}) s JOIN ({KMERS_SQL}) k USING (seed)"


@register("seed_map_exact", HITS_SQL)
def seed_map_exact(spark, sf_dir):
    return lookup.map_exact(reads(spark, sf_dir), sequences(spark, sf_dir), 16, 15)


@register("seed_diagonals", f"SELECT read_id, ref_id, rc, pos - pos_in_read AS pos, count(*) AS n_seeds FROM ({HITS_SQL}) GROUP BY ALL")
def seed_diagonals(spark, sf_dir):
    return lookup.seed_diagonals(lookup.map_exact(reads(spark, sf_dir), sequences(spark, sf_dir), 16, 15))


@register("seed_vote", f"""WITH v AS (SELECT read_id, ref_id, rc, pos - pos_in_read AS pos, count(*) AS n_seeds FROM ({HITS_SQL}) GROUP BY ALL),
  b AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY read_id ORDER BY n_seeds DESC, ref_id, pos, rc) = 1),
  m AS (SELECT b.*, CASE WHEN rc = 1 THEN reverse(translate(r.seq, 'ACGT', 'TGCA')) ELSE r.seq END AS q, d.seq AS t, r.len FROM b JOIN ({READS_SQL}) r USING (read_id) JOIN {DOCS} d ON d.doc_id = b.ref_id),
  c AS (SELECT read_id, ref_id, rc, pos, n_seeds, substr(t, greatest(pos, 0) + 1, len - (greatest(pos, 0) - pos)) AS t, q, greatest(pos, 0) - pos AS skip FROM m)
  SELECT read_id, ref_id, rc, pos, n_seeds, hamming(substr(q, skip + 1, length(t)), t)::INT AS mismatches, length(t)::INT AS compared FROM c""")
def seed_vote(spark, sf_dir):
    return vote(reads(spark, sf_dir), sequences(spark, sf_dir))


@register("seed_map_mismatch", f"""WITH s AS ({SEEDS_SQL.replace('16', '20').replace('- 15, 15', '- 19, 15')}), k AS ({KMERS_SQL.replace('16', '20').replace('- 14', '- 18')})
  SELECT read_id, ref_id, rc, pos_in_read, pos, hamming(s.seed, k.seed)::INT AS mismatches FROM s JOIN k ON substr(s.seed, 1, 10) = substr(k.seed, 1, 10) WHERE hamming(s.seed, k.seed) <= 1""")
def seed_map_mismatch(spark, sf_dir):
    return lookup.map_one_mismatch(reads(spark, sf_dir), sequences(spark, sf_dir), 20, 15)


@register("seed_map_approximate", f"""WITH s AS ({SEEDS_SQL.replace('16', '20').replace('- 15, 15', '- 19, 15')}), k AS ({KMERS_SQL.replace('16', '20').replace('- 14', '- 18')})
  SELECT read_id, ref_id, rc, pos_in_read, pos, hamming(s.seed, k.seed)::INT AS mismatches FROM s JOIN k ON substr(s.seed, 1, 10) = substr(k.seed, 1, 10) WHERE hamming(s.seed, k.seed) <= 1
  UNION SELECT read_id, ref_id, rc, pos_in_read, pos, hamming(s.seed, k.seed)::INT FROM s JOIN k ON substr(s.seed, 11, 10) = substr(k.seed, 11, 10) WHERE hamming(s.seed, k.seed) <= 1""")
def seed_map_approximate(spark, sf_dir):
    return lookup.map_approximate(reads(spark, sf_dir), sequences(spark, sf_dir), 20, 15)


@register("whole_read_map", f"""WITH r AS (SELECT read_id, 0 AS rc, seq AS s FROM ({READS_SQL}) UNION ALL SELECT read_id, 1, reverse(translate(seq, 'ACGT', 'TGCA')) FROM ({READS_SQL})), k AS ({KMERS_SQL})
  SELECT read_id, ref_id, rc, pos FROM r JOIN k ON substr(s, 1, 16) = seed JOIN {DOCS} d ON d.doc_id = ref_id WHERE length(s) >= 16 AND substr(d.seq, pos + 1, length(s)) = s""")
def whole_read_map(spark, sf_dir):
    return lookup.map_whole(reads(spark, sf_dir), sequences(spark, sf_dir))


@register("mismatch_search", f"""WITH p AS ({pieces_sql(14)}), t AS (SELECT ref_id, (i - 1)::INT AS pos, substr(seq, i, 14) AS kmer FROM (SELECT read_id AS ref_id, seq, unnest(range(1, length(seq) - 12)) AS i FROM ({READS_SQL}) WHERE length(seq) >= 14))
  SELECT query_id, ref_id, pos, hamming(pattern, kmer)::INT AS mismatches FROM p JOIN t ON hamming(pattern, kmer) <= 2""")
def mismatch_search(spark, sf_dir):
    return lookup.mismatch_search(texts(spark, sf_dir), pieces(spark, sf_dir, 14), 14, 2)


# seed ranges made from orders: read = customer
RANGES = "(SELECT o_custkey AS read_id, (o_orderkey % 97)::INT AS pos_in_read, (o_orderkey % 2)::INT AS rc, o_orderkey * 10 AS sa_begin, o_orderkey * 10 + (o_orderkey * 31 + o_custkey) % 23 AS sa_end FROM orders)"


def ranges(spark, sf_dir):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return table(spark, sf_dir, "orders").select(c.alias("read_id"), (k % 97).cast("int").alias("pos_in_read"), (k % 2).cast("int").alias("rc"), (k * 10).alias("sa_begin"), (k * 10 + (k * 31 + c) % 23).alias("sa_end"))


ORDER = "sa_end - sa_begin, pos_in_read, rc, sa_begin"


@register("hit_topk_smallest", f"SELECT *, sa_end - sa_begin AS size, row_number() OVER (PARTITION BY read_id ORDER BY {ORDER})::INT AS rank FROM {RANGES} QUALIFY rank <= 4")
def hit_topk_smallest(spark, sf_dir):
    return sampling.smallest_ranges(ranges(spark, sf_dir), 4)


@register("hit_counts", f"SELECT read_id, count(*) AS range_count, sum(sa_end - sa_begin)::BIGINT AS range_sum FROM {RANGES} GROUP BY read_id")
def hit_counts(spark, sf_dir):
    return reduce.hit_counts(ranges(spark, sf_dir))


@register("reseed_candidates", f"SELECT c_custkey AS read_id, coalesce(n, 0) AS range_count, coalesce(s, 0)::BIGINT AS range_sum FROM customer LEFT JOIN (SELECT read_id, count(*) AS n, sum(sa_end - sa_begin) AS s FROM {RANGES} GROUP BY 1) ON read_id = c_custkey WHERE coalesce(n, 0) = 0 OR s >= 12 * n")
def reseed_candidates(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("read_id")).join(reduce.hit_counts(ranges(spark, sf_dir)), "read_id", "left").fillna(0, ["range_count", "range_sum"])
    return c.where(filters.needs_reseed(F.col("range_count"), F.col("range_sum"), 12))


@register("hit_statistics", f"SELECT count(*) AS reads, sum(n)::BIGINT AS ranges, sum(hits)::BIGINT AS hits, sum(top)::BIGINT AS top_hits, max(largest) AS max_range FROM (SELECT read_id, count(*) AS n, sum(sa_end - sa_begin) AS hits, min(sa_end - sa_begin) AS top, max(sa_end - sa_begin) AS largest FROM {RANGES} GROUP BY 1)")
def hit_statistics(spark, sf_dir):
    return reduce.hit_statistics(ranges(spark, sf_dir))


@register("select_round", f"""SELECT read_id, pos_in_read, rc, "row", ord FROM (SELECT *, (row_number() OVER (PARTITION BY read_id ORDER BY sa_end - sa_begin, pos_in_read, rc, sa_begin, "row") - 1)::BIGINT AS ord FROM (SELECT *, unnest(range(sa_begin, sa_end)) AS "row" FROM {RANGES})) WHERE ord >= 6 AND ord < 9""")
def select_round(spark, sf_dir):
    return sampling.select_round(ranges(spark, sf_dir), 2, 3)


@register("select_all", f'SELECT read_id, unnest(range(sa_begin, sa_end)) AS "row" FROM {RANGES}')
def select_all(spark, sf_dir):
    return sampling.select_all(ranges(spark, sf_dir)).select("read_id", "row")


@register("select_top_range", f'SELECT read_id, unnest(range(sa_begin, sa_end)) AS "row" FROM (SELECT * FROM {RANGES} QUALIFY row_number() OVER (PARTITION BY read_id ORDER BY {ORDER}) = 1)')
def select_top_range(spark, sf_dir):
    return sampling.select_top_range(ranges(spark, sf_dir)).select("read_id", "row")


@register("random_ranges", f"""SELECT read_id, pos_in_read, rc, sa_begin, sa_end, row_number() OVER (PARTITION BY read_id ORDER BY CASE WHEN first = 1 THEN -1.0::DOUBLE ELSE -ln((u + 0.5) / 281474976710656.0::DOUBLE) * size * size END)::INT AS rank
   FROM (SELECT *, (sa_end - sa_begin)::DOUBLE AS size, ('0x' || substr(md5(concat_ws(':', 0, read_id, pos_in_read, rc, sa_begin)), 1, 12))::BIGINT::DOUBLE AS u, row_number() OVER (PARTITION BY read_id ORDER BY {ORDER}) AS first FROM {RANGES} WHERE sa_end > sa_begin) QUALIFY rank <= 3""")
def random_ranges(spark, sf_dir):
    return sampling.random_ranges(ranges(spark, sf_dir), 3)


@register("deque_ends", "SELECT o_orderkey AS id, o_custkey AS read_id, (o_orderkey * 31 + o_custkey) % 23 AS size, row_number() OVER (PARTITION BY o_custkey ORDER BY (o_orderkey * 31 + o_custkey) % 23, o_orderkey)::INT AS from_bottom, row_number() OVER (PARTITION BY o_custkey ORDER BY (o_orderkey * 31 + o_custkey) % 23 DESC, o_orderkey)::INT AS from_top FROM orders")
def deque_ends(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("read_id"), ((F.col("o_orderkey") * 31 + F.col("o_custkey")) % 23).alias("size"))
    return sampling.both_ends(o, "read_id", "size")


LEAVES = "(SELECT o_custkey AS tree_id, o_orderkey AS leaf, (o_orderkey * 13 + 5) % 11 AS weight FROM orders)"


@register("prefix_weights", f"SELECT *, (sum(weight) OVER (PARTITION BY tree_id ORDER BY leaf))::BIGINT AS upto FROM {LEAVES}")
def prefix_weights(spark, sf_dir):
    return sampling.prefix_weights(leaves(spark, sf_dir))


def leaves(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("tree_id"), F.col("o_orderkey").alias("leaf"), ((F.col("o_orderkey") * 13 + 5) % 11).alias("weight"))


@register("weighted_pick", f"""WITH s AS (SELECT tree_id, leaf, weight, sum(weight) OVER (PARTITION BY tree_id ORDER BY leaf) AS upto FROM {LEAVES} WHERE weight > 0),
  t AS (SELECT tree_id, max(upto) AS total, max(leaf) AS last FROM s GROUP BY 1), d AS (SELECT c_custkey AS tree_id, (c_custkey % 8) / 8.0::DOUBLE AS u FROM customer)
  SELECT d.tree_id, d.u, coalesce(s.leaf, t.last) AS leaf FROM d JOIN t USING (tree_id) LEFT JOIN s ON s.tree_id = d.tree_id AND d.u * total >= upto - weight AND d.u * total < upto""")
def weighted_pick(spark, sf_dir):
    d = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("tree_id"), ((F.col("c_custkey") % 8) / F.lit(8.0)).alias("u"))
    return sampling.weighted_pick(leaves(spark, sf_dir), d)


_LOGS = "CASE WHEN {x} = 0 THEN 0 ELSE length(bin({x})) END::INT"


@register("hit_histograms", f"""WITH p AS (SELECT read_id, count(*) AS ranges, sum(sa_end - sa_begin)::BIGINT AS hits, min(sa_end - sa_begin) AS top_hits FROM {RANGES} GROUP BY 1)
   SELECT name, bin, count(*) AS n FROM (SELECT 'ranges' AS name, {_LOGS.format(x='ranges')} AS bin FROM p UNION ALL SELECT 'hits', {_LOGS.format(x='hits')} FROM p UNION ALL SELECT 'top_hits', {_LOGS.format(x='top_hits')} FROM p UNION ALL SELECT 'range_size', {_LOGS.format(x='(sa_end - sa_begin)')} FROM {RANGES}) GROUP BY 1, 2""")
def hit_histograms(spark, sf_dir):
    return reduce.hit_histograms(ranges(spark, sf_dir))


@register("invert_hits", f'SELECT read_id, pos_in_read * 2 + rc AS range_id, unnest(range(sa_begin, sa_end)) AS "row" FROM {RANGES}')
def invert_hits(spark, sf_dir):
    return lookup.invert_hits(ranges(spark, sf_dir).withColumn("range_id", F.col("pos_in_read") * 2 + F.col("rc")))


@register("sorted_hits", f"SELECT * FROM {RANGES}")
def sorted_hits(spark, sf_dir):
    """By the high bits in ranges, then as a whole; a test looks at the order."""
    return sampling.sort_global(sampling.sort_high_bits(ranges(spark, sf_dir), "sa_begin"), "sa_begin", "sa_end")


@register("merged_lists", "SELECT o_custkey, array_to_string(list_sort(list_concat(list(o_orderkey) FILTER (o_orderkey % 2 = 0), list(o_orderkey) FILTER (o_orderkey % 2 = 1))), ',') AS merged FROM orders GROUP BY 1")
def merged_lists(spark, sf_dir):
    k = F.col("o_orderkey")
    half = lambda r: F.array_sort(F.collect_list(F.when(k % 2 == r, k)))
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(half(0).alias("a"), half(1).alias("b")).select("o_custkey", F.array_join(sampling.merge_sorted(F.col("a"), F.col("b")).cast("array<string>"), ",").alias("merged"))


@register("seed_dispatch", f"""WITH s AS ({SEEDS_SQL.replace('16', '20').replace('- 15, 15', '- 19, 15')}), k AS ({KMERS_SQL.replace('16', '20').replace('- 14', '- 18')})
  SELECT read_id, ref_id, rc, pos_in_read, pos, hamming(s.seed, k.seed)::INT AS mismatches FROM s JOIN k ON substr(s.seed, 1, 12) = substr(k.seed, 1, 12) WHERE hamming(s.seed, k.seed) <= 1""")
def seed_dispatch(spark, sf_dir):
    return lookup.map_seeds(reads(spark, sf_dir), sequences(spark, sf_dir), substitutions=1, sub_seed=12, length=20, interval=15)

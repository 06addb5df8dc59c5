"""Queries of alignment records: flags, coordinates, CIGAR and MD, comparison of two tables, statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import sam
from ..operators import compare, filters, lookup
from ..operators.derive import CONTIGS_SQL, contigs, table

QUERIES, ORACLES = {}, {}


def register(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


@register("sam_flags", """SELECT o_orderkey, ((CASE WHEN mate = 0 THEN 64 ELSE 128 END) | (CASE WHEN paired THEN 1 ELSE 0 END) | (CASE WHEN paired AND mapped AND conc THEN 2 ELSE 0 END) | (CASE WHEN NOT mapped THEN 4 ELSE 0 END) | (CASE WHEN mapped AND rc THEN 16 ELSE 0 END)
   | (CASE WHEN paired AND NOT m2 THEN 8 ELSE 0 END) | (CASE WHEN paired AND m2 AND rc2 THEN 32 ELSE 0 END))::INT AS flag
   FROM (SELECT o_orderkey, o_orderkey % 2 AS mate, o_orderkey % 3 > 0 AS mapped, o_orderkey % 5 > 2 AS rc, o_orderkey % 7 > 1 AS paired, o_orderkey % 11 > 3 AS conc, o_orderkey % 13 > 2 AS m2, o_orderkey % 17 > 8 AS rc2 FROM orders)""")
def sam_flags(spark, sf_dir):
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", sam.flags(k % 2, k % 3 > 0, k % 5 > 2, k % 7 > 1, k % 11 > 3, k % 13 > 2, k % 17 > 8).alias("flag"))


@register("template_lengths", """SELECT o_orderkey, CASE WHEN b AND s THEN CASE WHEN m < p THEN -(greatest(p + 50, m + 60) - least(p, m)) ELSE greatest(p + 50, m + 60) - least(p, m) END ELSE 0 END::BIGINT AS tlen, CASE WHEN b THEN CASE WHEN s THEN '=' ELSE 'c2' END ELSE '*' END AS rnext
   FROM (SELECT o_orderkey, o_orderkey * 17 % 1000 AS p, o_orderkey * 23 % 1000 AS m, o_orderkey % 3 > 0 AS s, o_orderkey % 5 > 0 AS b FROM orders)""")
def template_lengths(spark, sf_dir):
    k = F.col("o_orderkey")
    p, m, same, both = k * 17 % 1000, k * 23 % 1000, k % 3 > 0, k % 5 > 0
    ref = F.when(same, "c2").otherwise("c1")
    return table(spark, sf_dir, "orders").select("o_orderkey", sam.template_length(p, p + 50, m, m + 60, same, both).alias("tlen"), sam.mate_reference(ref, F.lit("c2"), both).alias("rnext"))


@register("contig_lookup", f"""WITH c AS ({CONTIGS_SQL}), t AS (SELECT sum(len)::BIGINT AS total FROM c), q AS (SELECT o_orderkey, (o_orderkey * 7919 % total)::BIGINT AS g FROM orders, t)
   SELECT o_orderkey, g, ref_id, name AS ref_name, g - "offset" + 1 AS ref_pos, g + 50 > "offset" + len AS crosses FROM q JOIN c ON g >= "offset" AND g < "offset" + len""")
def contig_lookup(spark, sf_dir):
    c = contigs(spark, sf_dir).select("ref_id", "name", "offset", "len")
    total = c.agg(F.sum("len").alias("total"))  # one row
    q = table(spark, sf_dir, "orders").select("o_orderkey").join(F.broadcast(total), how="cross").select("o_orderkey", (F.col("o_orderkey") * 7919 % F.col("total")).alias("g"))
    return sam.contig_coordinates(q, c, "g", F.lit(50))


CIGAR = "(o_orderkey % 30 + 1) || 'M' || (o_orderkey % 3 + 1) || 'I' || (o_orderkey % 20 + 1) || 'M' || (o_orderkey % 4 + 1) || 'D' || (o_orderkey % 9 + 1) || 'X' || (o_orderkey % 5 + 1) || 'S'"


def with_cigar(spark, sf_dir):
    k = F.col("o_orderkey")
    n = lambda m: (k % m + 1).cast("string")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.concat(n(30), F.lit("M"), n(3), F.lit("I"), n(20), F.lit("M"), n(4), F.lit("D"), n(9), F.lit("X"), n(5), F.lit("S")).alias("cigar"))


def _sum(kinds: str) -> str:
    return f"coalesce(list_sum([regexp_extract(x, '[0-9]+')::INT FOR x IN regexp_extract_all(cigar, '[0-9]+[{kinds}]')]), 0)::INT"


@register("cigar_summary", f"SELECT o_orderkey, {_sum('X')} AS n_mm, {_sum('MX')} AS subs, {_sum('I')} AS ins, {_sum('D')} AS dels, {_sum('MDX')} AS ref_len, {_sum('MISX')} AS read_len, cigar AS again FROM (SELECT o_orderkey, {CIGAR} AS cigar FROM orders)")
def cigar_summary(spark, sf_dir):
    ops = sam.parse_cigar(F.col("cigar"))
    return with_cigar(spark, sf_dir).select("o_orderkey", sam.cigar_summary(ops).alias("s"), sam.reference_length(ops).alias("ref_len"), sam.read_length(ops).alias("read_len"), sam.cigar_text(ops).alias("again")).select("o_orderkey", "s.*", "ref_len", "read_len", "again")


@register("md_mismatches", "SELECT o_orderkey, length(regexp_replace(regexp_replace(md, '\\^[A-Za-z]+', '', 'g'), '[^A-Za-z]', '', 'g'))::INT AS n FROM (SELECT o_orderkey, (o_orderkey % 30) || 'A' || (o_orderkey % 9) || '^' || substr('ACGTACGT', 1, (o_orderkey % 4 + 1)::INT) || (o_orderkey % 7) || 'C' || (o_orderkey % 3) || substr('GT', 1, (o_orderkey % 3)::INT) AS md FROM orders)")
def md_mismatches(spark, sf_dir):
    k = F.col("o_orderkey")
    n = lambda m: (k % m).cast("string")
    md = F.concat(n(30), F.lit("A"), n(9), F.lit("^"), F.substring(F.lit("ACGTACGT"), F.lit(1), (k % 4 + 1).cast("int")), n(7), F.lit("C"), n(3), F.substring(F.lit("GT"), F.lit(1), (k % 3).cast("int")))
    return table(spark, sf_dir, "orders").select("o_orderkey", sam.md_mismatches(md).alias("n"))


# --- two alignment tables made from orders -------------------------------------------------------------------------------

#: column -> (expression for the left table, for the right one); the right one lacks every 19th read
COLUMNS = {
    "read_len": ("100", "100 + (k % 23 = 0)::INT"), "flag": ("(k % 2) * 16 + (k % 11 = 0)::INT * 4", "(k % 2) * 16 + (k % 13 = 0)::INT * 16 + (k % 17 = 0)::INT * 4"), "ref_id": ("k % 5", "(k + (k % 29 = 0)::INT) % 5"), "pos": ("k * 31 % 5000 + 1", "k * 31 % 5000 + 1 + (k % 7 = 0)::INT * 150"),
    "score": ("-(k % 40)", "-((k + c % 3) % 40)"), "mapq": ("k % 43", "(k + c % 2) % 43"), "ed": ("k % 6", "(k + c % 2) % 6"), "subs": ("95 + k % 5", "95 + c % 5"), "ins": ("k % 3", "c % 3"), "dels": ("k % 4", "c % 4"), "n_mm": ("k % 7", "c % 7"),
    "sec_score": ("-(k % 40) - k % 3", "-((k + c % 3) % 40) - c % 2"),
}


def side_sql(i: int) -> str:
    cols = ", ".join(f"({e[i]})::INT AS {c}" for c, e in COLUMNS.items())
    return f"(SELECT k AS read_id, 0 AS mate, {cols}, k % 3 > 0 AS has_second FROM (SELECT o_orderkey AS k, o_custkey AS c FROM orders) {'WHERE k % 19 <> 0' if i else ''})"


def side(spark, sf_dir, i: int):
    o = table(spark, sf_dir, "orders").selectExpr("o_orderkey as k", "o_custkey as c")
    if i:
        o = o.where("k % 19 <> 0")
    cols = [f"cast({e[i].replace('::INT', '')} as int) as {c}" for c, e in COLUMNS.items()]
    cols = [c.replace("(k % 23 = 0)", "int(k % 23 = 0)").replace("(k % 11 = 0)", "int(k % 11 = 0)").replace("(k % 13 = 0)", "int(k % 13 = 0)").replace("(k % 17 = 0)", "int(k % 17 = 0)").replace("(k % 29 = 0)", "int(k % 29 = 0)").replace("(k % 7 = 0)", "int(k % 7 = 0)") for c in cols]
    return o.selectExpr("k as read_id", "0 as mate", *cols, "k % 3 > 0 as has_second")


def both(spark, sf_dir):
    return lookup.zip_alignments(compare.prepare(side(spark, sf_dir, 0)), compare.prepare(side(spark, sf_dir, 1)))


PREPARED = "SELECT *, (flag & 4) = 0 AND pos <> 0 AS mapped, (flag & 4) = 0 AND pos <> 0 AND NOT has_second AS uniq, (flag & 4) = 0 AND pos <> 0 AND has_second AND score = sec_score AS ambiguous, subs + ins AS mapped_bases FROM "
BOTH_SQL = f"SELECT coalesce(l.read_id, r.read_id) AS read_id, l, r, coalesce(l.read_len = r.read_len, false) AS matched FROM ({PREPARED}{side_sql(0)}) l FULL JOIN ({PREPARED}{side_sql(1)}) r ON l.read_id = r.read_id AND l.mate = r.mate"


@register("diff_zip", f"SELECT matched, count(*) AS n FROM ({BOTH_SQL}) GROUP BY matched")
def diff_zip(spark, sf_dir):
    return both(spark, sf_dir).groupBy("matched").agg(F.count("*").alias("n"))


def _contingency(column: str, sql_name: str):
    a, b = f"coalesce(l.{sql_name}, false)", f"coalesce(r.{sql_name}, false)"
    sql = f"SELECT count(*) FILTER ({a}) AS n_left, count(*) FILTER ({b}) AS n_right, count(*) FILTER ({a} AND NOT {b}) AS only_left, count(*) FILTER (NOT {a} AND {b}) AS only_right, count(*) FILTER ({a} AND {b}) AS n_both, (count(*) FILTER ({a}) + count(*) FILTER ({b})) / (2 * count(*))::DOUBLE AS average FROM ({BOTH_SQL}) WHERE matched"

    @register(f"diff_contingency_{column}", sql)
    def query(spark, sf_dir, column=column):
        return compare.contingency(both(spark, sf_dir), column)


for _c, _s in (("mapped", "mapped"), ("unique", "uniq"), ("ambiguous", "ambiguous")):
    _contingency(_c, _s)

MAPPED = f"(SELECT read_id, l, r FROM ({BOTH_SQL}) WHERE matched AND l.mapped AND r.mapped)"


def mapped_both(spark, sf_dir):
    return both(spark, sf_dir).where("matched and l_mapped and r_mapped")


HIST_SQL = f"SELECT greatest(least((l.score - r.score)::INT, 15), -16) AS bin, count(*) AS n FROM {MAPPED} GROUP BY 1"


@register("diff_hist", HIST_SQL)
def diff_hist(spark, sf_dir):
    return compare.histogram(mapped_both(spark, sf_dir), F.col("l_score") - F.col("r_score"), 16)


@register("diff_cumulative", f"SELECT bin, n, sum(n) OVER (ORDER BY bin)::BIGINT AS upto FROM ({HIST_SQL})")
def diff_cumulative(spark, sf_dir):
    return compare.cumulative(diff_hist(spark, sf_dir))


@register("diff_cumulative_reverse", f"SELECT bin, n, sum(n) OVER (ORDER BY bin DESC)::BIGINT AS upto FROM ({HIST_SQL})")
def diff_cumulative_reverse(spark, sf_dir):
    return compare.cumulative(diff_hist(spark, sf_dir), backwards=True)


@register("diff_hist2d", f"SELECT greatest(least(l.mapq, 31), -32) AS x, greatest(least(r.mapq, 31), -32) AS y, count(*) AS n FROM {MAPPED} GROUP BY 1, 2")
def diff_hist2d(spark, sf_dir):
    return compare.histogram2d(mapped_both(spark, sf_dir), F.col("l_mapq"), F.col("r_mapq"), 32, 32)


def _measures_sql() -> str:
    rows = []
    for name, (column, high, _) in compare.MEASURES.items():
        d = f"(l.{column} - r.{column})::BIGINT"
        rows.append(f"SELECT read_id, '{name}' AS measure, {d} AS diff, CASE WHEN {d} = 0 THEN 'both' WHEN ({d} > 0) = {str(high).lower()} THEN 'left' ELSE 'right' END AS better, abs(l.pos - r.pos) > l.read_len OR l.ref_id <> r.ref_id AS distant, (l.flag & 16) <> (r.flag & 16) AS discordant FROM {MAPPED}")
    m = " UNION ALL ".join(rows)
    stats = "count(*) AS n, count(*) FILTER (better IN ('left', 'both')) AS left_better, count(*) FILTER (better IN ('right', 'both')) AS right_better, sum(diff)::BIGINT AS sum_diff"
    return " UNION ALL ".join(f"SELECT '{s}' AS subset, measure, {stats} FROM ({m}) WHERE {c} GROUP BY measure" for s, c in (("all", "true"), ("distant", "distant"), ("discordant", "discordant")))


@register("diff_measures", _measures_sql())
def diff_measures(spark, sf_dir):
    return compare.measure_statistics(compare.measure_rows(both(spark, sf_dir)))


@register("diff_filter", f"SELECT read_id FROM {MAPPED} WHERE (l.flag & 16) <> 0 AND ((CASE WHEN l.ref_id <> r.ref_id THEN 1 ELSE 0 END) | (CASE WHEN l.score <> r.score THEN 2 ELSE 0 END) & 3) <> 0 AND (l.score - r.score) >= 1")
def diff_filter(spark, sf_dir):
    stats = F.when(F.col("l_ref_id") != F.col("r_ref_id"), 1).otherwise(0).bitwiseOR(F.when(F.col("l_score") != F.col("r_score"), 2).otherwise(0))
    return mapped_both(spark, sf_dir).where(filters.diff_filter(F.col("l_flag"), stats, F.col("l_score") - F.col("r_score"), 16, 3, 1)).select("read_id")


PAIR_SQL = "(SELECT k % 5 AS l1_ref_id, (k + (k % 29 = 0)::INT) % 5 AS r1_ref_id, k % 5 AS l2_ref_id, (k + (k % 31 = 0)::INT) % 5 AS r2_ref_id, k AS l1_pos, k + (k % 7 = 0)::INT * 150 AS r1_pos, k AS l2_pos, k + (k % 6 = 0)::INT * 150 AS r2_pos, k % 2 AS l1_rc, (k + (k % 13 = 0)::INT) % 2 AS r1_rc, k % 2 AS l2_rc, (k + (k % 3 = 0)::INT) % 2 AS r2_rc, 100 AS len1, 100 AS len2 FROM (SELECT o_orderkey AS k FROM orders))"


@register("diff_pairs", f"""SELECT count(*) AS n, count(*) FILTER (kind = 'ref_both') AS ref_both, count(*) FILTER (kind = 'ref_1') AS ref_1, count(*) FILTER (kind = 'ref_2') AS ref_2, count(*) FILTER (kind = 'far_both') AS far_both, count(*) FILTER (kind = 'far_1') AS far_1, count(*) FILTER (kind = 'far_2') AS far_2,
   count(*) FILTER (kind = 'same') AS same, count(*) FILTER (d1 AND d2) AS discordant_both, count(*) FILTER (d1 AND NOT d2) AS discordant_1, count(*) FILTER (NOT d1 AND d2) AS discordant_2 FROM
   (SELECT *, l1_rc <> r1_rc AS d1, l2_rc <> r2_rc AS d2, CASE WHEN l1_ref_id <> r1_ref_id AND l2_ref_id <> r2_ref_id THEN 'ref_both' WHEN l1_ref_id <> r1_ref_id THEN 'ref_1' WHEN l2_ref_id <> r2_ref_id THEN 'ref_2' WHEN abs(l1_pos - r1_pos) > 100 AND abs(l2_pos - r2_pos) > 100 THEN 'far_both' WHEN abs(l1_pos - r1_pos) > 100 THEN 'far_1' WHEN abs(l2_pos - r2_pos) > 100 THEN 'far_2' ELSE 'same' END AS kind FROM {PAIR_SQL})""")
def diff_pairs(spark, sf_dir):
    import re

    exprs = re.sub(r"\((k % \d+ = 0)\)::INT", r"int(\1)", PAIR_SQL)[8:].split(" FROM ")[0].split(", ")
    return compare.pair_breakdown(table(spark, sf_dir, "orders").selectExpr("o_orderkey as k").selectExpr(*exprs))


def _histograms_sql() -> str:
    rows = []
    for name, (column, high, log) in compare.MEASURES.items():
        d = f"(l.{column} - r.{column})::BIGINT"
        size = f"CASE WHEN {d} = 0 THEN 0 ELSE length(bin(abs({d}))) END" if log else f"abs({d})"
        rows.append(f"SELECT '{name}' AS measure, {size}::BIGINT AS bin, CASE WHEN {d} = 0 THEN ['left', 'right'] WHEN ({d} > 0) = {str(high).lower()} THEN ['left'] ELSE ['right'] END AS sides FROM {MAPPED}")
    return f"SELECT measure, side, bin, count(*) AS n FROM (SELECT measure, bin, unnest(sides) AS side FROM ({' UNION ALL '.join(rows)})) GROUP BY ALL"


@register("diff_measure_histograms", _histograms_sql())
def diff_measure_histograms(spark, sf_dir):
    return compare.measure_histograms(compare.measure_rows(both(spark, sf_dir)))


_MARKS = "o_orderkey % 43 AS mapq, o_orderkey % 3 > 0 AS l_unique, o_orderkey % 4 > 0 AS r_unique, o_orderkey % 5 = 0 AS l_ambiguous, o_orderkey % 6 = 0 AS r_ambiguous"


@register("diff_pair_histograms", f"""WITH p AS (SELECT a.*, b.* FROM (SELECT *, row_number() OVER (ORDER BY l1_pos) AS i FROM {PAIR_SQL}) a JOIN (SELECT {_MARKS}, row_number() OVER (ORDER BY o_orderkey) AS j FROM orders) b ON i = j),
   q AS (SELECT *, CASE WHEN l1_ref_id <> r1_ref_id OR l2_ref_id <> r2_ref_id THEN ['different_ref', 'distant'] WHEN abs(l1_pos - r1_pos) > 100 OR abs(l2_pos - r2_pos) > 100 THEN ['distant'] ELSE [] END AS kinds,
           ['all'] || CASE WHEN l_unique AND r_unique THEN ['unique'] ELSE [] END || CASE WHEN NOT l_ambiguous AND NOT r_ambiguous THEN ['not_ambiguous'] ELSE [] END AS subsets FROM p)
   SELECT kind, subset, mapq_bin, count(*) AS n FROM (SELECT kind, mapq_bin, unnest(subsets) AS subset FROM (SELECT unnest(kinds) AS kind, subsets, CASE WHEN mapq = 0 THEN 0 ELSE length(bin(mapq)) END::INT AS mapq_bin FROM q)) GROUP BY ALL""")
def diff_pair_histograms(spark, sf_dir):
    import re

    exprs = re.sub(r"\((k % \d+ = 0)\)::INT", r"int(\1)", PAIR_SQL)[8:].split(" FROM ")[0].split(", ")
    marks = [m.replace("o_orderkey", "k") for m in _MARKS.split(", ")]
    return compare.pair_histograms(table(spark, sf_dir, "orders").selectExpr("o_orderkey as k").selectExpr(*exprs, *marks))


RECORDS = "(SELECT CASE WHEN o_orderkey % 11 > 0 THEN -(o_orderkey % 40) END AS score, CASE WHEN o_orderkey % 11 > 0 AND o_custkey % 2 = 0 THEN -(o_orderkey % 40) - o_custkey % 3 END AS second_score, o_orderkey % 43 AS mapq, o_orderkey % 6 AS ed FROM orders)"


def result_records(spark, sf_dir):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    score = F.when(k % 11 > 0, -(k % 40))
    return table(spark, sf_dir, "orders").select(score.alias("score"), F.when(c % 2 == 0, score - c % 3).alias("second_score"), (k % 43).alias("mapq"), (k % 6).alias("ed"))


@register("output_stats", f"SELECT count(*) AS n_reads, count(score) AS n_mapped, count(*) FILTER (score IS NOT NULL AND second_score IS NULL) AS n_unique, count(second_score) AS n_multiple, count(*) FILTER (score = second_score) AS n_ambiguous, count(*) FILTER (score <> second_score) AS n_unambiguous FROM {RECORDS}")
def output_stats(spark, sf_dir):
    return compare.output_statistics(result_records(spark, sf_dir))


@register("output_histograms", f"SELECT 'mapq' AS name, mapq AS value, count(*) AS n FROM {RECORDS} GROUP BY mapq UNION ALL SELECT 'ed', ed, count(*) FROM {RECORDS} GROUP BY ed")
def output_histograms(spark, sf_dir):
    return compare.value_histograms(result_records(spark, sf_dir), ["mapq", "ed"])


@register("queue_checksum", "SELECT count(*) AS n, sum((((0 * 31 + o_orderkey % 1000003) % 1000003) * 31 + o_custkey % 1000003) % 1000003)::BIGINT AS \"check\" FROM orders")
def queue_checksum(spark, sf_dir):
    return compare.checksum(table(spark, sf_dir, "orders"), [F.col("o_orderkey"), F.col("o_custkey")])


@register("all_any", "SELECT bool_and(o_orderkey >= 0) AS \"all\", bool_or(o_orderkey >= 0) AS \"any\", count(*) FILTER (o_orderkey >= 0) AS n FROM orders")
def all_any(spark, sf_dir):
    return compare.all_any(table(spark, sf_dir, "orders"), F.col("o_orderkey") >= 0)


@register("unseen_hits", "SELECT DISTINCT o_custkey % 50 AS read_id, o_orderkey % 2 AS rc, o_orderkey * 17 % 100 AS pos FROM orders")
def unseen_hits(spark, sf_dir):
    k = F.col("o_orderkey")
    return filters.unseen_locations(table(spark, sf_dir, "orders").select((F.col("o_custkey") % 50).alias("read_id"), (k % 2).alias("rc"), (k * 17 % 100).alias("pos")))


@register("distinct_pairs", "SELECT o_orderkey, r1 <> r2 OR abs(p1 - p2) > 50 AS d, r1 <> r2 OR abs(p1 - p2) > 50 OR abs(o1 - o2) > 60 AS dp FROM (SELECT o_orderkey, o_orderkey % 2 AS r1, o_custkey % 2 AS r2, o_orderkey * 17 % 200 AS p1, o_custkey * 17 % 200 AS p2, o_orderkey * 13 % 150 AS o1, o_custkey * 13 % 150 AS o2 FROM orders)")
def distinct_pairs(spark, sf_dir):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    p1, p2, o1, o2 = k * 17 % 200, c * 17 % 200, k * 13 % 150, c * 13 % 150
    zero = F.lit(0)
    return table(spark, sf_dir, "orders").select("o_orderkey", sam.distinct_alignments(p1, k % 2, p2, c % 2, F.lit(50)).alias("d"), sam.distinct_pairs(p1, k % 2, o1, zero, p2, c % 2, o2, zero, F.lit(50), F.lit(60)).alias("dp"))


@register("mapq_filter", "SELECT o_orderkey, o_orderkey % 3 > 0 AND o_orderkey % 43 >= 20 AS kept FROM orders")
def mapq_filter(spark, sf_dir):
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", filters.passes_mapq(k % 43, k % 3 > 0, 20).alias("kept"))

"""Queries of pairwise alignment, read alignment and best-two reduction."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scoring import EDIT, preset, simple, simple_affine
from ..operators import reduce
from ..operators.align import align_score, align_traceback, edit_distance_global
from ..operators.derive import READS_SQL, qualities, reads, sequences, sql_dna, table
from ..plans import aligner

QUERIES, ORACLES = {}, {}


def register(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


PAIRS_SQL = f"SELECT a.read_id AS pair_id, a.seq AS pattern, b.seq AS text FROM ({READS_SQL}) a JOIN ({READS_SQL}) b ON b.read_id = a.read_id + 1"


def pairs(spark, sf_dir):
    """Each item with the next: whole sequences."""
    r = reads(spark, sf_dir)
    nxt = r.select((F.col("read_id") - 1).alias("read_id"), F.col("seq").alias("text"))
    return r.join(nxt, "read_id").select(F.col("read_id").alias("pair_id"), F.col("seq").alias("pattern"), "text").repartition(8)


@register("ed_global", f"SELECT pair_id, -levenshtein(pattern, text)::INT AS score FROM ({PAIRS_SQL})")
def ed_global(spark, sf_dir):
    return pairs(spark, sf_dir).select("pair_id", edit_distance_global(F.col("pattern"), F.col("text")).alias("score"))


@register("ed_global_matrix", f"SELECT pair_id, -levenshtein(pattern, text)::INT AS score FROM ({PAIRS_SQL})")
def ed_global_matrix(spark, sf_dir):
    return align_score(pairs(spark, sf_dir), EDIT, "global").select("pair_id", "score")


SCHEMES = {"ed": EDIT, "sw": simple(2, -1, -1, -1), "gotoh": simple_affine(2, -1, -3, -1)}


def _modes():
    for name, scheme in SCHEMES.items():
        for mode in ("global", "local", "semi_global"):

            def score(spark, sf_dir, scheme=scheme, mode=mode):
                return align_score(pairs(spark, sf_dir), scheme, mode, drop=("pattern", "text"))

            def trace(spark, sf_dir, scheme=scheme, mode=mode):
                return align_traceback(pairs(spark, sf_dir), scheme, mode, drop=("pattern", "text"))

            QUERIES[f"{name}_score_{mode}"] = score
            QUERIES[f"{name}_traceback_{mode}"] = trace

        def banded(spark, sf_dir, scheme=scheme):
            return align_traceback(pairs(spark, sf_dir), scheme, "semi_global", 31, drop=("pattern", "text"))

        QUERIES[f"{name}_traceback_banded"] = banded


_modes()


@register("align_reads")
def align_reads(spark, sf_dir):
    return aligner.align(reads(spark, sf_dir), sequences(spark, sf_dir), aligner.Parameters(seed_length=16))


@register("align_reads_edit")
def align_reads_edit(spark, sf_dir):
    return aligner.align(reads(spark, sf_dir), sequences(spark, sf_dir), aligner.Parameters(seed_length=16, scheme=simple(0, -1, -1, -1)))


@register("align_reads_all")
def align_reads_all(spark, sf_dir):
    return aligner.align_all(reads(spark, sf_dir), sequences(spark, sf_dir), aligner.Parameters(seed_length=16))


@register("align_reads_quality")
def align_reads_quality(spark, sf_dir):
    """Base qualities decide the cost of a mismatch."""
    return aligner.align(qualities(reads(spark, sf_dir)), sequences(spark, sf_dir), aligner.Parameters(seed_length=16))


def halves(spark, sf_dir):
    """The two halves of every item as mates, the second on the other strand."""
    half = F.floor(F.col("len") / 2).cast("int")
    rest = F.substring("seq", half + 1, F.col("len") - half)
    return reads(spark, sf_dir).select("read_id", F.substring("seq", F.lit(1), half).alias("seq1"), F.reverse(F.translate(rest, "ACGT", "TGCA")).alias("seq2"))


@register("align_read_pairs")
def align_read_pairs(spark, sf_dir):
    """Halves of items as pairs; those that are too short to align are rows without a place."""
    return aligner.align_pairs(halves(spark, sf_dir), sequences(spark, sf_dir), aligner.Parameters(seed_length=16))


@register("align_pair_records")
def align_pair_records(spark, sf_dir):
    from ..sources.writers import sam_lines

    contigs = sequences(spark, sf_dir).select("ref_id", F.concat(F.lit("doc"), F.col("ref_id").cast("string")).alias("name"))
    return sam_lines(aligner.pair_records(align_read_pairs(spark, sf_dir), halves(spark, sf_dir), contigs))


@register("align_records")
def align_records(spark, sf_dir):
    from ..sources.writers import sam_lines

    contigs = sequences(spark, sf_dir).select("ref_id", F.concat(F.lit("doc"), F.col("ref_id").cast("string")).alias("name"))
    r = reads(spark, sf_dir)
    return sam_lines(aligner.records(aligner.align(r, sequences(spark, sf_dir), aligner.Parameters(seed_length=16, scheme=preset("default"))), r, contigs))


# scored hits made from orders: read = customer
HITS = "(SELECT o_custkey AS read_id, o_orderkey AS ord, (-(o_orderkey * 7 % 40))::BIGINT AS score, o_orderkey * 17 % 1000 AS pos, (o_orderkey % 2)::INT AS rc, 50 AS len FROM orders)"


def hits(spark, sf_dir):
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("read_id"), k.alias("ord"), (-(k * 7 % 40)).alias("score"), (k * 17 % 1000).alias("pos"), (k % 2).cast("int").alias("rc"), F.lit(50).alias("len"))


@register("best2_distinct", f"""WITH b AS (SELECT * FROM {HITS} QUALIFY row_number() OVER (PARTITION BY read_id ORDER BY score DESC, pos, rc) = 1),
  s AS (SELECT h.* FROM {HITS} h JOIN b ON h.read_id = b.read_id WHERE h.rc <> b.rc OR abs(h.pos - b.pos) > 25 QUALIFY row_number() OVER (PARTITION BY h.read_id ORDER BY h.score DESC, h.pos, h.rc) = 1)
  SELECT b.read_id, b.score, b.pos, b.rc, s.score AS second_score, s.pos AS second_pos, s.rc AS second_rc, b.len FROM b LEFT JOIN s ON s.read_id = b.read_id""")
def best2_distinct(spark, sf_dir):
    return reduce.best_two(hits(spark, sf_dir))


@register("best2_budget", f"""WITH RECURSIVE h AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY read_id ORDER BY ord) AS n FROM {HITS} QUALIFY n <= 400),
  r AS (SELECT read_id, n, score AS bs, pos AS bp, rc AS br, NULL::BIGINT AS cs, NULL::BIGINT AS cp, NULL::INT AS cr, 0 AS fails, false AS over FROM h WHERE n = 1 UNION ALL
    SELECT read_id, n, CASE WHEN up THEN score ELSE bs END, CASE WHEN up THEN pos ELSE bp END, CASE WHEN up THEN rc ELSE br END,
           CASE WHEN up AND apart THEN bs WHEN two THEN score ELSE cs END, CASE WHEN up AND apart THEN bp WHEN two THEN pos ELSE cp END, CASE WHEN up AND apart THEN br WHEN two THEN rc ELSE cr END,
           CASE WHEN again THEN fails WHEN up OR two THEN 0 ELSE fails + 1 END, NOT again AND NOT up AND NOT two AND fails + 1 >= 15 AND n >= 30
    FROM (SELECT *, NOT again AND score > bs AS up, NOT again AND score <= bs AND apart AND (cs IS NULL OR score > cs) AS two
      FROM (SELECT r.*exclude(n), h.n, h.score, h.pos, h.rc, coalesce(h.pos = bp AND h.rc = br, false) OR coalesce(h.pos = cp AND h.rc = cr, false) AS again, h.rc <> br OR abs(h.pos - bp) > 25 AS apart
            FROM r JOIN h ON h.read_id = r.read_id AND h.n = r.n + 1 WHERE NOT over)))
  SELECT read_id, bs AS score, bp AS pos, br AS rc, cs AS second_score, cp AS second_pos, cr AS second_rc, n::INT AS extensions FROM r QUALIFY row_number() OVER (PARTITION BY read_id ORDER BY n DESC) = 1""")
def best2_budget(spark, sf_dir):
    return reduce.best_two_with_budget(hits(spark, sf_dir))


PAIR_HITS = "(SELECT o_custkey AS read_id, (-(o_orderkey * 7 % 40))::BIGINT AS score, (-(o_orderkey * 11 % 30))::BIGINT AS o_score, o_orderkey * 17 % 1000 AS pos, (o_orderkey % 2)::INT AS rc, o_orderkey * 23 % 1000 AS o_pos, ((o_orderkey + 1) % 2)::INT AS o_rc FROM orders)"


@register("best2_pairs", f"""WITH p AS (SELECT *, score + o_score AS total FROM {PAIR_HITS}),
  b AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY read_id ORDER BY total DESC, pos, o_pos, rc DESC, o_rc DESC, score DESC) = 1),
  c AS (SELECT p.* FROM p JOIN b USING (read_id) WHERE p.rc <> b.rc OR abs(p.pos - b.pos) > 25 OR p.o_rc <> b.o_rc OR abs(p.o_pos - b.o_pos) > 25 QUALIFY row_number() OVER (PARTITION BY p.read_id ORDER BY p.total DESC, p.pos, p.o_pos, p.rc DESC, p.o_rc DESC, p.score DESC) = 1)
  SELECT b.read_id, b.total, b.score, b.pos, b.rc, b.o_score, b.o_pos, b.o_rc, c.total AS second_total, c.pos AS second_pos, c.o_pos AS second_o_pos FROM b LEFT JOIN c ON c.read_id = b.read_id""")
def best2_pairs(spark, sf_dir):
    k = F.col("o_orderkey")
    p = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("read_id"), (-(k * 7 % 40)).alias("score"), (-(k * 11 % 30)).alias("o_score"), (k * 17 % 1000).alias("pos"), (k % 2).cast("int").alias("rc"), (k * 23 % 1000).alias("o_pos"), ((k + 1) % 2).cast("int").alias("o_rc"), F.lit(50).alias("len"), F.lit(50).alias("o_len"),
    )
    return reduce.best_two_pairs(p)


@register("target_scores", "SELECT o_orderkey, CASE WHEN s IS NOT NULL THEN s + trunc((b - s) * 3 / 4)::INT ELSE -60 END::INT AS target FROM (SELECT o_orderkey, (-(o_orderkey % 30))::INT AS b, CASE WHEN o_custkey % 3 > 0 THEN (-(o_orderkey % 30) - o_custkey % 17)::INT END AS s FROM orders)")
def target_scores(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    b = (-(F.col("o_orderkey") % 30)).cast("int")
    s = F.when(F.col("o_custkey") % 3 > 0, (b - F.col("o_custkey") % 17).cast("int"))
    return o.select("o_orderkey", reduce.target_score(b, s, F.lit(-60)).alias("target"))


def _mate_sql() -> str:
    cols = []
    for mode in ("ff", "fr", "rf", "rr"):
        left = "NOT rc" if mode in ("rr", "rf") else "rc"
        turned = "rc" if mode in ("ff", "rr") else "NOT rc"
        cols += [f"CASE WHEN {left} THEN greatest(pos + 50 - 500, 0) ELSE pos END::INT AS {mode}_begin", f"CASE WHEN {left} THEN pos + 50 ELSE pos + 500 END::INT AS {mode}_end", f"{turned} AS {mode}_rc"]
    return f"SELECT o_orderkey, {', '.join(cols)} FROM (SELECT o_orderkey, (o_orderkey * 17 % 10000)::INT AS pos, o_orderkey % 2 = 1 AS rc FROM orders)"


@register("mate_windows", _mate_sql())
def mate_windows(spark, sf_dir):
    from ..operators.lookup import mate_window

    k = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders").select("o_orderkey", (k * 17 % 10000).cast("int").alias("pos"), (k % 2 == 1).alias("rc"))
    modes = ("ff", "fr", "rf", "rr")
    o = o.select("o_orderkey", *(mate_window(F.col("pos"), F.lit(50), F.col("rc"), F.lit(60), m).alias(m) for m in modes))
    return o.select("o_orderkey", *(F.col(f"{m}.{f}").alias(f"{m}_{f}") for m in modes for f in ("begin", "end", "rc")))


@register("active_states", f"SELECT read_id, min(ord % 5)::INT AS round, true AS finished FROM {HITS} WHERE score >= -15 AND ord % 5 < 4 GROUP BY read_id")
def active_states(spark, sf_dir):
    """Rounds over reads that are still open: a round looks at a fifth of the hits, a read is done at its first good one."""
    from ..streaming.reads import active_rounds
    from ..sources.store import folder

    h = hits(spark, sf_dir)

    def keep(df):
        path = folder(spark)
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    def step(todo, n):
        return h.where(((F.col("ord") % 5) == n) & (F.col("score") >= -15)).join(todo, "read_id", "left_semi").select("read_id", F.lit(n).alias("round")).distinct()

    return active_rounds(h.select("read_id").distinct(), step, 4, keep)


@register("streamed_scores", f"SELECT read_id, max(score) AS best, max(score) FILTER (score < top) AS second, count(*) AS seen FROM (SELECT *, max(score) OVER (PARTITION BY read_id) AS top FROM {HITS}) GROUP BY read_id")
def streamed_scores(spark, sf_dir):
    """The state of every read after four micro-batches."""
    from ..streaming.reads import best_score_state
    from ..sources.store import folder

    source, out = folder(spark), folder(spark)
    h = hits(spark, sf_dir).select("read_id", "score")
    h.repartition(4).write.parquet(f"{source}/in")
    stream = spark.readStream.schema(h.schema).option("maxFilesPerTrigger", 1).parquet(f"{source}/in")
    write = lambda batch, n: batch.write.mode("overwrite").parquet(f"{out}/batch={n}")
    best_score_state(stream).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{source}/state").trigger(availableNow=True).start().awaitTermination()
    found = spark.read.schema("read_id long, best long, second long, seen long").parquet(f"{out}/batch=*")
    return found.groupBy("read_id").agg(F.max_by(F.struct("best", "second"), "seen").alias("_s"), F.max("seen").alias("seen")).select("read_id", "_s.best", "_s.second", "seen")


@register("streamed_reads", f"SELECT read_id, len::INT AS len FROM ({READS_SQL})")
def streamed_reads(spark, sf_dir):
    from ..sources.store import folder
    from ..streaming.reads import align_stream, read_stream

    path = folder(spark)
    reads(spark, sf_dir).select("read_id", "seq", F.col("len").cast("int").alias("len")).repartition(3).write.parquet(f"{path}/in")
    align_stream(read_stream(spark, f"{path}/in"), lambda batch: batch.select("read_id", "len"), f"{path}/out", f"{path}/state").awaitTermination()
    return spark.read.schema("read_id long, len int").parquet(f"{path}/out/batch=*")


# --- the alignment matrix in SQL ---------------------------------------------------------------------------------------------


P_SQL = f"p AS MATERIALIZED (SELECT pair_id, pattern, text, length(pattern) AS m, length(text) AS n, 0 AS low FROM ({PAIRS_SQL}))"


def cells_sql(scheme, mode: str, band: int | None = None, before: str = P_SQL, cost: str | None = None) -> str:
    """CTEs p (pairs) and c (pair_id, i, j, h, e, f, dir, ee, ef): every cell of each pair's matrix, one text row an iteration.

    ``before`` states p and what it needs, ``cost`` that of a mismatch.
    """
    ins0, ins1, del0, del1 = scheme.pattern_open, scheme.pattern_extend, scheme.text_open, scheme.text_extend
    low = "(-100000000)::BIGINT"
    local = mode == "local"
    top = "0" if local else f"CASE WHEN j = 0 THEN 0 ELSE {ins0} + {ins1} * (j - 1) END"
    side = f"{del0} + {del1} * i" if mode == "global" else "0"  # of row i + 1
    inside = f"AND j <= i + 1 - low AND j > i + 1 - low - {band}" if band else ""
    first = f"AND j <= -low AND j > -low - {band}" if band else ""
    t = "greatest(diag, f, 0)" if local else "greatest(diag, f)"
    stop = "WHEN h = 0 THEN 0 " if local else ""
    return f"""WITH RECURSIVE {before},
  c AS (SELECT pair_id, 0 AS i, j, ({top})::BIGINT AS h, {low} AS e, {low} AS f, 0 AS dir, false AS ee, false AS ef FROM (SELECT pair_id, low, unnest(range(0, m + 1)) AS j FROM p) WHERE true {first}
   UNION ALL
   SELECT pair_id, i, j, h, e, f, CASE {stop}WHEN j = 0 THEN 0 WHEN diag >= greatest(e, f) THEN 1 WHEN e > f THEN 2 WHEN f > e THEN 3 ELSE {3 if band else 2} END,
          coalesce(lag(e) OVER w + {ins1} > lag(h) OVER w + {ins0}, false), ef
   FROM (SELECT *, CASE WHEN j = 0 THEN t ELSE greatest(t, e) END AS h FROM (SELECT *, CASE WHEN j = 0 THEN {low} ELSE coalesce(max(t - {ins1} * j) OVER (PARTITION BY pair_id ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + {ins0} + {ins1} * (j - 1), {low}) END AS e
     FROM (SELECT pair_id, i + 1 AS i, j, diag, f, ef, (CASE WHEN j = 0 THEN {side} ELSE {t} END)::BIGINT AS t
       FROM (SELECT pair_id, i, j, coalesce(hd, {low}) + CASE WHEN substr(pattern, j::INT, 1) = substr(text, i + 1, 1) THEN {scheme.match} ELSE {cost or scheme.mismatch_max} END AS diag,
              CASE WHEN j = 0 THEN {low} ELSE greatest(h + {del0}, f + {del1}) END AS f, f + {del1} > h + {del0} AS ef
         FROM (SELECT k.pair_id, k.i, k.j, coalesce(a.h, {low}) AS h, coalesce(a.f, {low}) AS f, b.h AS hd
               FROM (SELECT pair_id, i, unnest(range(0, m + 1)) AS j FROM (SELECT pair_id, max(i) AS i FROM c GROUP BY pair_id) JOIN p USING (pair_id) WHERE i < n) k
               LEFT JOIN c a ON a.pair_id = k.pair_id AND a.j = k.j LEFT JOIN c b ON b.pair_id = k.pair_id AND b.j = k.j - 1) JOIN p USING (pair_id) WHERE true {inside}))))
   WINDOW w AS (PARTITION BY pair_id ORDER BY j))"""


def ends_sql(mode: str, band: int | None = None) -> str:
    """CTE s (pair_id, score, i, j): the cells where an alignment may end, in a local matrix the best of each row."""
    if mode == "global":
        where = "c.i = p.n AND c.j = p.m"
    elif mode == "semi_global":
        where = "c.j = p.m AND (c.i > 0 OR p.m = 0)" + (" AND p.n >= p.m" if band else "")
    else:
        return "s AS (SELECT pair_id, max(h) AS score, i, arg_max(j, h * 100000 + j) AS j FROM c GROUP BY pair_id, i)"
    return f"s AS (SELECT c.pair_id, c.h AS score, c.i, c.j FROM c JOIN p USING (pair_id) WHERE {where} AND c.h > -50000000)"


def score_sql(scheme, mode: str) -> str:
    return f"""{cells_sql(scheme, mode)}, {ends_sql(mode)},
  b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY pair_id ORDER BY score DESC, i DESC, j DESC) = 1),
  o AS (SELECT s.* FROM s JOIN b USING (pair_id) WHERE s.i <> b.i QUALIFY row_number() OVER (PARTITION BY s.pair_id ORDER BY s.score DESC, s.i DESC, s.j DESC) = 1)
  SELECT pair_id, b.score::INT AS score, b.i::INT AS text_end, b.j::INT AS pattern_end, o.score::INT AS second_score, o.i::INT AS second_end FROM p LEFT JOIN b USING (pair_id) LEFT JOIN o USING (pair_id)"""


def traceback_sql(scheme, mode: str, band: int | None = None, ends: str | None = None) -> str:
    """Steps from the best end along the directions; operations and the symbols of the MD string are gathered from them.

    ``ends`` states p, c and b (pair_id, score, i, j) where that isn't the best end of every pair.
    """
    tail = "''" if mode == "local" else "repeat('I', j::INT)" + (" || repeat('D', i::INT)" if mode == "global" else "")
    i0, j0 = "i" if mode != "global" else "0", "j" if mode == "local" else "0"
    alone = "CASE WHEN score IS NOT NULL THEN coalesce({}, 0) END::INT".format
    runs = "array_to_string(list_transform(regexp_extract_all({}, 'M+|I+|D+'), lambda x: length(x) || substr(x, 1, 1)), '')"
    best = "b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY pair_id ORDER BY score DESC, i DESC, j DESC) = 1)"
    return f"""{ends or f'{cells_sql(scheme, mode, band)}, {ends_sql(mode, band)}, {best}'},
  w AS (SELECT pair_id, i, j, 'h' AS st, '' AS ops, 0 AS n FROM b UNION ALL
    SELECT pair_id, CASE WHEN st IN ('m', 'f') THEN i - 1 ELSE i END, CASE WHEN st IN ('m', 'e') THEN j - 1 ELSE j END,
           CASE WHEN st = 'e' AND ee THEN 'e' WHEN st = 'f' AND ef THEN 'f' ELSE 'h' END, ops || CASE st WHEN 'm' THEN 'M' WHEN 'e' THEN 'I' ELSE 'D' END, n + 1
    FROM (SELECT w.pair_id, w.i, w.j, ops, n, ee, ef, CASE WHEN st <> 'h' THEN st WHEN dir = 1 THEN 'm' WHEN dir = 2 THEN 'e' WHEN dir = 3 THEN 'f' END AS st FROM w JOIN c ON c.pair_id = w.pair_id AND c.i = w.i AND c.j = w.j WHERE w.i > 0 AND w.j > 0) WHERE st IS NOT NULL),
  l AS (SELECT *, ops || {tail} AS rev FROM w QUALIFY row_number() OVER (PARTITION BY pair_id ORDER BY n DESC) = 1),
  t AS (SELECT pair_id, b.score, {i0.replace('i', 'l.i')}::INT AS text_begin, b.i::INT AS text_end, {j0.replace('j', 'l.j')}::INT AS pattern_begin, b.j::INT AS pattern_end, rev, reverse(rev) AS fwd FROM l JOIN b USING (pair_id)),
  y AS (SELECT pair_id, k, substr(fwd, k, 1) AS op, CASE WHEN k > 1 THEN substr(fwd, k - 1, 1) ELSE '' END AS before,
          text_begin + length(replace(substr(fwd, 1, k), 'I', '')) AS ti, pattern_begin + length(replace(substr(fwd, 1, k), 'D', '')) AS pj FROM (SELECT *, unnest(range(1, length(fwd) + 1))::INT AS k FROM t)),
  z AS (SELECT pair_id, k, op, before, CASE WHEN op = 'I' THEN '' WHEN op = 'D' THEN CASE WHEN before = 'D' THEN '' ELSE '^' END || lower(substr(text, ti::INT, 1)) WHEN substr(text, ti::INT, 1) = substr(pattern, pj::INT, 1) THEN '=' ELSE substr(text, ti::INT, 1) END AS sym FROM y JOIN p USING (pair_id)),
  a AS (SELECT pair_id, string_agg(sym, '' ORDER BY k) || '#' AS syms, count(*) FILTER (op = 'M' AND sym <> '=') AS n_mm, count(*) FILTER (op <> 'M' AND op <> before) AS n_gapo, count(*) FILTER (op <> 'M' AND op = before) AS n_gape FROM z GROUP BY pair_id)
  SELECT pair_id, score::INT AS score, text_begin, text_end, pattern_begin, pattern_end,
    CASE WHEN pattern_begin > 0 THEN pattern_begin || 'S' ELSE '' END || {runs.format('fwd')} || CASE WHEN pattern_end < m THEN (m - pattern_end) || 'S' ELSE '' END AS cigar, {runs.format('rev')} AS ops_rev,
    CASE WHEN score IS NOT NULL THEN replace(upper(array_to_string(list_transform(regexp_extract_all(coalesce(syms, '#'), '=*(?:\\^[acgt]+|[ACGT]|#)'), lambda x: (length(x) - length(ltrim(x, '='))) || ltrim(x, '=')), '')), '#', '') END AS md,
    {alone('n_mm + n_gapo + n_gape')} AS ed, {alone('n_mm')} AS n_mm, {alone('n_gapo')} AS n_gapo, {alone('n_gape')} AS n_gape
  FROM p LEFT JOIN t USING (pair_id) LEFT JOIN a USING (pair_id)"""


for _name, _scheme in SCHEMES.items():
    for _mode in ("global", "local", "semi_global"):
        ORACLES[f"{_name}_score_{_mode}"] = score_sql(_scheme, _mode)
        ORACLES[f"{_name}_traceback_{_mode}"] = traceback_sql(_scheme, _mode)
    ORACLES[f"{_name}_traceback_banded"] = traceback_sql(_scheme, "semi_global", 31)


# --- the aligner in SQL ------------------------------------------------------------------------------------------------------


def places_sql(scheme, max_hits: int | None, cost: str | None = None) -> str:
    """CTEs from reads to s (pair_id, score, i, j): seeds of all rounds, places, their windows and banded cells; then g, the best end of each place that reaches the threshold."""
    p = aligner.Parameters(seed_length=16)
    some = f"JOIN (SELECT * FROM sn QUALIFY row_number() OVER (PARTITION BY read_id, round ORDER BY n, pir, rc) <= {max_hits}) USING (read_id, round, rc, pir)" if max_hits else ""
    before = f"""r AS MATERIALIZED (SELECT read_id, seq, len::INT AS len FROM ({READS_SQL})), d AS MATERIALIZED (SELECT doc_id AS ref_id, {sql_dna()} AS seq FROM documents),
  st AS (SELECT read_id, 0 AS rc, seq AS q, len FROM r UNION ALL SELECT read_id, 1, reverse(translate(seq, 'ACGT', 'TGCA')), len FROM r),
  sd AS (SELECT read_id, rc, pir, pir % 15 // 5 AS round, substr(q, pir + 1, 16) AS seed FROM (SELECT *, unnest(range(0, len - 15))::INT AS pir FROM st) WHERE pir % 15 IN (0, 5, 10)),
  km AS (SELECT ref_id, pos, substr(seq, pos + 1, 16) AS seed FROM (SELECT *, unnest(range(0, length(seq) - 15))::INT AS pos FROM d)),
  ht AS MATERIALIZED (SELECT read_id, ref_id, rc, pir, round, pos FROM sd JOIN km USING (seed)),
  sn AS (SELECT read_id, round, rc, pir, count(*) AS n FROM ht GROUP BY ALL),
  la AS (SELECT read_id, min(round) AS last FROM (SELECT read_id, round FROM sn GROUP BY ALL HAVING sum(n) < {p.rep_seeds} * count(*)) GROUP BY read_id),
  pl AS (SELECT DISTINCT read_id, ref_id, rc, pos - pir AS pos FROM ht {some} LEFT JOIN la USING (read_id) WHERE last IS NULL OR round <= last),
  wn AS (SELECT read_id, ref_id, rc, len, q AS pattern, seq, greatest(pos - {p.band // 2}, 0) AS a, least(pos - {p.band // 2} + len + {p.band}, length(seq)) AS z, pos - {p.band // 2} AS whole FROM pl JOIN st USING (read_id, rc) JOIN d USING (ref_id)),
  p AS MATERIALIZED (SELECT row_number() OVER () AS pair_id, read_id, ref_id, rc, len, pattern, substr(seq, a + 1, greatest(z - a, 0)) AS text, length(pattern) AS m, greatest(z - a, 0) AS n, a, (whole - a)::INT AS low, trunc({scheme.min_const}::FLOAT + {scheme.min_coeff}::FLOAT * len::FLOAT)::INT AS least FROM wn)"""
    return f"""{cells_sql(scheme, p.mode, p.band, before, cost)}, {ends_sql(p.mode)},
  g AS MATERIALIZED (SELECT s.*, read_id, ref_id, rc, len, a, low, least, ref_id * 4294967296 + a + s.i AS pos FROM s JOIN p USING (pair_id) WHERE score >= least QUALIFY row_number() OVER (PARTITION BY pair_id ORDER BY score DESC, s.i DESC) = 1)"""


def align_all_sql(scheme) -> str:
    return f"{places_sql(scheme, None)} SELECT read_id, ref_id, rc, (a + i)::INT AS \"end\", max(score)::INT AS score FROM g GROUP BY ALL"


def align_sql(scheme, cost: str | None = None) -> str:
    """The best place of each read is traced back; the best that is distinct from it counts for the mapping quality."""
    from .symbols import mapq_case

    first = "QUALIFY row_number() OVER (PARTITION BY read_id ORDER BY score DESC, pos, rc, a DESC, low DESC) = 1"
    ends = f"""{places_sql(scheme, aligner.Parameters().max_hits, cost)}, bw AS MATERIALIZED (SELECT * FROM g {first}), b AS (SELECT pair_id, score, i, j FROM bw),
  sc AS (SELECT g.read_id, max(g.score) AS second FROM g JOIN bw USING (read_id) WHERE g.rc <> bw.rc OR abs(g.pos - bw.pos) > bw.len // 2 GROUP BY g.read_id)"""
    head, _, last = traceback_sql(scheme, "semi_global", aligner.Parameters().band, ends).rpartition("\n  SELECT pair_id")
    return f"""{head}, tb AS (SELECT pair_id{last} WHERE t.score IS NOT NULL),
  fi AS (SELECT bw.read_id, ref_id, (a + text_begin)::INT AS pos, rc, tb.score, second::INT AS second_score, {mapq_case()} AS mapq, cigar, md, ed, n_mm, n_gapo, n_gape
    FROM (SELECT bw.*, second, bw.score AS best, (0 - least)::FLOAT AS diff, (bw.score - least)::FLOAT AS over, abs(abs(bw.score) - abs(second))::FLOAT AS gap FROM bw LEFT JOIN sc USING (read_id)) bw JOIN tb USING (pair_id))
  SELECT read_id, r.len, fi.* EXCLUDE (read_id) FROM r LEFT JOIN fi USING (read_id)"""


ORACLES["align_reads_all"] = align_all_sql(preset("default"))
ORACLES["align_reads"] = align_sql(preset("default"))
ORACLES["align_reads_edit"] = align_sql(simple(0, -1, -1, -1))
# a base's quality is its place on the read times 7 plus the read's id, modulo 41
ORACLES["align_reads_quality"] = align_sql(preset("default"), "-2 - trunc((least((CASE WHEN rc = 1 THEN m + 1 - j ELSE j END * 7 + read_id) % 41, 40)::FLOAT / 40::FLOAT)::FLOAT * 4::FLOAT)::INT")


def record_sql() -> str:
    """Lines of align_records: an unmapped read has neither place nor tags."""
    tags = "".join(f" || CASE WHEN {c} IS NOT NULL THEN chr(9) || '{t}' || {c} ELSE '' END" for t, c in (("NM:i:", "ed"), ("AS:i:", "score"), ("XS:i:", "second_score"), ("XM:i:", "n_mm"), ("XO:i:", "n_gapo"), ("XG:i:", "n_gape"), ("MD:Z:", "md")))
    turned = "CASE WHEN rc = 1 THEN reverse(translate(seq, 'ACGT', 'TGCA')) ELSE seq END"
    return f"""WITH al AS ({align_sql(preset('default'))})
  SELECT concat_ws(chr(9), read_id, 64 + CASE WHEN pos IS NULL THEN 4 WHEN rc = 1 THEN 16 ELSE 0 END, coalesce('doc' || ref_id, '*'), coalesce(pos + 1, 0), coalesce(mapq, 0), coalesce(cigar, '*'), '*', 0, 0, {turned}, '*'){tags} AS line
  FROM al JOIN (SELECT read_id, seq FROM ({READS_SQL})) USING (read_id)"""


ORACLES["align_records"] = record_sql()

"""Queries of the symbol, quality, integer and scoring functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scoring, symbols
from ..operators import filters, lookup
from ..operators.derive import READS_SQL, qualities, reads, sequences, sql_dna, table

QUERIES, ORACLES = {}, {}


def register(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


DOCS = f"(SELECT doc_id, {sql_dna()} AS seq FROM documents)"


@register("seq_revcomp", f"SELECT doc_id, md5(reverse(translate(seq, 'ACGTacgt', 'TGCAtgca'))) AS rc, md5(reverse(seq)) AS r FROM {DOCS}")
def seq_revcomp(spark, sf_dir):
    d = sequences(spark, sf_dir, out="doc_id")
    return d.select("doc_id", F.md5(symbols.reverse_complement(F.col("seq"))).alias("rc"), F.md5(symbols.reverse(F.col("seq"))).alias("r"))


@register("seq_counts", f"SELECT doc_id, length(seq) AS n, length(seq) - length(replace(seq, 'A', '')) AS a, length(seq) - length(replace(seq, 'C', '')) AS c, length(seq) - length(replace(seq, 'G', '')) AS g, least(length(seq) - length(replace(seq, 'T', '')), 100) AS t_most FROM {DOCS}")
def seq_counts(spark, sf_dir):
    d = sequences(spark, sf_dir, out="doc_id")
    s = F.col("seq")
    return d.select("doc_id", F.length(s).cast("long").alias("n"), *(symbols.count_symbol(s, x).cast("long").alias(x.lower()) for x in "ACG"), symbols.count_symbol(s, "T", 100).cast("long").alias("t_most"))


@register("seq_codes", "SELECT doc_id, md5(translate(regexp_replace(t, '[^ACGT]', 'N', 'g'), 'ACGTN', '01234')) AS strict, md5(translate(regexp_replace(translate(t, 'acgt', 'ACGT'), '[^ACGT-]', 'N', 'g'), 'ACGTN-', '012345')) AS io, length(t) AS n FROM (SELECT doc_id, regexp_replace(text, '[^A-Za-z-]', '', 'g') AS t FROM documents)")
def seq_codes(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.regexp_replace("text", "[^A-Za-z-]", "").alias("t"))
    return d.select("doc_id", F.md5(symbols.encode(F.col("t"))).alias("strict"), F.md5(symbols.encode_io(F.col("t"))).alias("io"), F.length("t").cast("long").alias("n"))


@register("seq_views", f"SELECT doc_id, substr(seq, 11, 20) AS view, CASE WHEN doc_id % 2 = 1 THEN reverse(translate(substr(seq, 11, 20), 'ACGT', 'TGCA')) ELSE substr(seq, 11, 20) END AS strand, substr(seq, 1, 15) AS clipped FROM {DOCS}")
def seq_views(spark, sf_dir):
    d = sequences(spark, sf_dir, out="doc_id")
    view = symbols.window(F.col("seq"), F.lit(10), F.lit(20))
    return d.select("doc_id", view.alias("view"), symbols.strand_view(view, F.col("doc_id") % 2 == 1).alias("strand"), symbols.window(F.col("seq"), F.lit(-5), F.lit(20)).alias("clipped"))


@register("seq_pack", f"SELECT doc_id, pos, list_sum([(strpos('ACGT', substr(s, i, 1)) - 1) * (1::BIGINT << (2 * (16 - i))) FOR i IN range(1, 17)])::BIGINT AS packed, s AS unpacked FROM (SELECT doc_id, i::INT AS pos, substr(seq, (i + 1)::INT, 16) AS s FROM (SELECT doc_id, seq, unnest(range(0, length(seq) - 15, 16)) AS i FROM {DOCS} WHERE length(seq) >= 16))")
def seq_pack(spark, sf_dir):
    d = lookup.kmers(sequences(spark, sf_dir, out="doc_id"), 16, "doc_id", step=16, out="s")
    packed = symbols.pack2(F.col("s"))
    return d.select("doc_id", "pos", packed.alias("packed"), symbols.unpack2(packed, 16).alias("unpacked"))


@register("quality_values", """SELECT event_id, q33, CASE WHEN q33 < 5 THEN 0 WHEN q33 < 15 THEN 10 WHEN q33 < 25 THEN 20 ELSE 30 END AS maq, floor(10.0 * log10(1.0 + pow(10.0, (q33 - 10)::DOUBLE / 10)) + 0.5)::INT AS solexa,
  (2 + trunc(((least(q33, 40)::FLOAT / 40.0::FLOAT) * 4.0::FLOAT)::FLOAT))::INT AS cost FROM (SELECT event_id, ((event_id * 7) % 41)::INT AS q33 FROM events)""")
def quality_values(spark, sf_dir):
    d = table(spark, sf_dir, "events").select("event_id", (F.col("event_id") * 7 % 41).cast("int").alias("q33"))
    raw = F.concat(F.char(F.col("q33") + 33))
    q = F.get(symbols.quality(raw, "phred33"), F.lit(0))
    return d.select("event_id", q.alias("q33"), symbols.phred_to_maq(q).alias("maq"), symbols.solexa_to_phred(q).alias("solexa"), scoring.quality_cost(q, 2, 6).alias("cost"))


_H = "event_id * 2654435761 % 4294967296"


@register("integer_functions", f"""SELECT event_id, bit_count(x)::INT AS ones, (x >> 16) AS high, CASE WHEN x > 0 THEN length(bin(x)) - 1 END::INT AS log2, ceil((x + 6) // 7)::BIGINT AS up7, ((-x % 8 + 8) % 8) + x AS round8, x - x % 8 AS down8,
   (x * 1664525 + 1013904223) % 4294967296 AS lcg, CASE WHEN d = 0 THEN 0 ELSE sign(d) * (length(bin(abs(d)))) END::INT AS lbin,
   CASE WHEN n <= 16 THEN 0 WHEN n <= 36 THEN 1 WHEN n <= 100 THEN 2 WHEN n <= 150 THEN 3 WHEN n <= 200 THEN 4 WHEN n <= 250 THEN 5 WHEN n <= 300 THEN 6 WHEN n <= 350 THEN 7 WHEN n <= 400 THEN 8 WHEN n <= 450 THEN 9 WHEN n <= 500 THEN 10 ELSE 11 END AS len_bin
   FROM (SELECT event_id, ({_H})::BIGINT AS x, (event_id % 2001 - 1000)::BIGINT AS d, (event_id % 600)::BIGINT AS n FROM events)""")
def integer_functions(spark, sf_dir):
    d = table(spark, sf_dir, "events").select("event_id", (F.col("event_id") * F.lit(2654435761) % F.lit(4294967296)).alias("x"), (F.col("event_id") % 2001 - 1000).alias("d"), (F.col("event_id") % 600).alias("n"))
    x = F.col("x")
    return d.select(
        "event_id", symbols.popcount(x).alias("ones"), symbols.high_bits(x).alias("high"), symbols.log2_int(x).alias("log2"), symbols.divide_up(x, F.lit(7)).cast("long").alias("up7"), symbols.round_up(x, 8).alias("round8"), symbols.round_down(x, 8).alias("down8"),
        symbols.lcg(x).alias("lcg"), symbols.log_bin(F.col("d")).alias("lbin"), symbols.read_length_bin(F.col("n")).alias("len_bin"),
    )


def sql_hash32(rows: str, key: str = "event_id") -> str:
    """Rows (key, x) with x hashed."""
    a = "x"
    steps = ["((({a} + 2127912214) & 4294967295) + ({a} << 12)) & 4294967295", "xor(xor({a}, 3345072700), ({a} >> 19)) & 4294967295", "({a} + 374761393 + ({a} << 5)) & 4294967295",
             "xor(({a} + 3550635116) & 4294967295, ({a} << 9)) & 4294967295", "({a} + 4251993797 + ({a} << 3)) & 4294967295", "xor(xor({a}, 3042594569), ({a} >> 16)) & 4294967295"]
    for s in steps:
        rows = f"SELECT {key}, {s.format(a=a)} AS x FROM ({rows})"
    return rows


def sql_hash32_mix(rows: str, key: str = "event_id") -> str:
    for s in ("(x + 4294967295 - ((x << 15) & 4294967295)) & 4294967295", "xor(x, x >> 10)", "(x + (x << 3)) & 4294967295", "xor(x, x >> 6)", "(x + 4294967295 - ((x << 11) & 4294967295)) & 4294967295", "xor(x, x >> 16)"):
        rows = f"SELECT {key}, ({s})::BIGINT AS x FROM ({rows})"
    return rows


EVENT_NUMBERS = "SELECT event_id, (event_id * 2654435761 % 4294967296)::BIGINT AS x FROM events"


@register("integer_hash", f"SELECT event_id, x AS h FROM ({sql_hash32(EVENT_NUMBERS)})")
def integer_hash(spark, sf_dir):
    x = F.col("event_id") * F.lit(2654435761) % F.lit(4294967296)
    return table(spark, sf_dir, "events").select("event_id", symbols.hash32(x).alias("h"))


def _sql_hash64() -> str:
    rows, m = "SELECT event_id, (event_id * 2654435761 * 97)::HUGEINT AS x FROM events", 1 << 64
    for up, down in ((32, 22), (13, 8), (3, 15), (27, 31)):
        shifted = f"((x * {1 << up}) % {m})"
        rows = f"SELECT event_id, (x + {shifted if up == 3 else f'({m - 1} - {shifted})'}) % {m} AS x FROM ({rows})"
        rows = f"SELECT event_id, xor(x, x // {1 << down}) AS x FROM ({rows})"
    return f"SELECT event_id, (CASE WHEN x >= {1 << 63} THEN x - {m} ELSE x END)::BIGINT AS mix FROM ({rows})"


_ELF = "(h * 16 + b) & 4294967295"


@register("integer_hash_wide", f"""SELECT event_id, h2.x AS mix32, mix, xor(k >> 32, k) AS fold, list_reduce([0::BIGINT, k & 255, (k >> 8) & 255, (k >> 16) & 255, (k >> 24) & 255, (k >> 32) & 255, (k >> 40) & 255, (k >> 48) & 255, (k >> 56) & 255], lambda h, b: xor({_ELF}, (({_ELF}) & 4026531840) >> 24) & 268435455)::BIGINT AS elf
   FROM (SELECT event_id, (event_id * 2654435761 * 97)::BIGINT AS k FROM events) JOIN ({sql_hash32_mix(EVENT_NUMBERS)}) h2 USING (event_id) JOIN ({_sql_hash64()}) USING (event_id)""")
def integer_hash_wide(spark, sf_dir):
    n = F.col("event_id") * F.lit(2654435761)
    d = table(spark, sf_dir, "events").select("event_id", (n % F.lit(4294967296)).alias("x"), (n * 97).alias("k"))
    return symbols.hash64_mix(d, "k", "mix").select("event_id", symbols.hash32_mix(F.col("x")).alias("mix32"), "mix", symbols.hash64_fold(F.col("k")).alias("fold"), symbols.hash64_elf(F.col("k")).alias("elf"))


@register("bit_fields", f"""SELECT event_id, bit_count(x)::INT AS ones, (list_filter(range(0, 32), lambda i: (x >> i) & 1 = 1)[3])::INT AS third, len(list_filter(range(0, 16), lambda i: (x >> (2 * i)) & 3 = 2))::INT AS twos FROM ({EVENT_NUMBERS})""")
def bit_fields(spark, sf_dir):
    x = F.col("event_id") * F.lit(2654435761) % F.lit(4294967296)
    return table(spark, sf_dir, "events").select("event_id", symbols.popcount(x).alias("ones"), symbols.nth_set_bit(x, 3).alias("third"), symbols.count_2bit(x, 2).alias("twos"))


@register("strand_qualities", f"SELECT read_id, md5(array_to_string(CASE WHEN read_id % 2 = 1 THEN list_reverse(q) ELSE q END, ',')) AS q FROM (SELECT read_id, [((i * 7 + read_id) % 41) FOR i IN range(1, len + 1)] AS q FROM ({READS_SQL}))")
def strand_qualities(spark, sf_dir):
    return qualities(reads(spark, sf_dir)).select("read_id", F.md5(F.array_join(symbols.strand_quality(F.col("qual"), F.col("read_id") % 2 == 1).cast("array<string>"), ",")).alias("q"))


@register("scheme_options", "SELECT * FROM (VALUES ('default', 0, -2, -6, -1, -8, -3, -8, -3, false), ('local', 2, -2, -6, -1, -8, -3, -8, -3, true), ('base1', 1, -3, -3, -3, -15, -4, -15, -4, false), ('own', 3, -1, -4, -1, -6, -1, -8, -3, false)) t(name, \"match\", mismatch_min, mismatch_max, n_penalty, text_open, text_extend, pattern_open, pattern_extend, min_log)")
def scheme_options(spark, sf_dir):
    """The presets and a scheme read from a file of key and value pairs."""
    import tempfile

    with tempfile.NamedTemporaryFile("w", suffix=".txt") as f:
        f.write("match 3\nmm-penalty-min 1 mm-penalty-max 4\nref-gap-const 5\tref-gap-coeff 1\n")
        f.flush()
        own = scoring.from_file(f.name)
    names = ("match", "mismatch_min", "mismatch_max", "n_penalty", "text_open", "text_extend", "pattern_open", "pattern_extend", "min_log")
    rows = [(n, *(getattr(s, x) for x in names)) for n, s in [*((n, scoring.preset(n)) for n in scoring.OPTIONS), ("own", own)]]
    return spark.createDataFrame(rows, "name string, match int, mismatch_min int, mismatch_max int, n_penalty int, text_open int, text_extend int, pattern_open int, pattern_extend int, min_log boolean")


@register("cigar_strings", "SELECT o_orderkey, array_to_string(list_transform(regexp_extract_all(ops, 'M+|I+|D+'), lambda x: length(x) || substr(x, 1, 1)), '') AS cigar, array_to_string(list_transform(regexp_extract_all(reverse(ops), 'M+|I+|D+'), lambda x: length(x) || substr(x, 1, 1)), '') AS backwards FROM (SELECT o_orderkey, substr('MMDMIIMMMDDMIMMMMDIM', 1, (o_orderkey % 20 + 1)::INT) AS ops FROM orders)")
def cigar_strings(spark, sf_dir):
    from ..functions import sam

    d = table(spark, sf_dir, "orders").select("o_orderkey", F.substring(F.lit("MMDMIIMMMDDMIMMMMDIM"), F.lit(1), (F.col("o_orderkey") % 20 + 1).cast("int")).alias("ops"))
    runs = sam.runs_of(F.col("ops"))
    return d.select("o_orderkey", runs.alias("cigar"), sam.cigar_text(sam.parse_cigar(runs), backwards=True).alias("backwards"))


@register("name_crc", """WITH RECURSIVE step AS (SELECT b, b AS c, 0 AS n FROM (SELECT unnest(range(0, 256)) AS b) UNION ALL SELECT b, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n + 1 FROM step WHERE n < 8),
   tab AS (SELECT list(c ORDER BY b) AS t FROM step WHERE n = 8)
   SELECT c_custkey, xor(list_reduce([4294967295::BIGINT] || list_transform(range(1, length(c_name) + 1), lambda i: ord(substr(c_name, i, 1))::BIGINT), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)::BIGINT AS crc FROM customer, tab""")
def name_crc(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", F.crc32("c_name").alias("crc"))


@register("read_filters", f"""SELECT read_id, len >= 12 AS long_enough, position('N' in s) = 0 AS exact, position('N' in substr(s, 1, 10)) = 0 AND length(substr(s, 11)) - length(replace(substr(s, 11), 'N', '')) <= 1 AS approx
   FROM (SELECT read_id, len, regexp_replace(seq, 'ACA', 'ANA', 'g') AS s FROM ({READS_SQL}))""")
def read_filters(spark, sf_dir):
    r = reads(spark, sf_dir).withColumn("s", F.regexp_replace("seq", "ACA", "ANA"))
    return r.select("read_id", filters.long_enough(F.col("len")).alias("long_enough"), filters.no_unknown(F.col("s")).alias("exact"), filters.few_unknown(F.col("s"), 10).alias("approx"))


@register("read_batch_stats", f"SELECT count(*) AS n, min(len)::INT AS min_len, max(len)::INT AS max_len, ceil(avg(len))::BIGINT AS avg_len FROM ({READS_SQL})")
def read_batch_stats(spark, sf_dir):
    from ..sources.readers import batch_statistics

    return batch_statistics(reads(spark, sf_dir).withColumnRenamed("len", "read_len"))


@register("read_qualities", f"SELECT read_id, list_sum([((i * 7 + read_id) % 41) FOR i IN range(1, len + 1)])::BIGINT AS total FROM ({READS_SQL})")
def read_qualities(spark, sf_dir):
    return qualities(reads(spark, sf_dir)).select("read_id", F.aggregate("qual", F.lit(0), lambda a, x: a + x).cast("long").alias("total"))


@register("score_thresholds", """SELECT event_id, trunc((-0.6)::FLOAT + (-0.6)::FLOAT * n::FLOAT)::INT AS linear, trunc(0::FLOAT + 10::FLOAT * ln(n::DOUBLE)::FLOAT)::INT AS log,
   CASE WHEN best < least THEN 0 ELSE least(CASE WHEN best - least - 8 < 0 THEN 1 ELSE floor((best - least - 8) / 3) + 2 END, n) - 1 END::INT AS gaps
   FROM (SELECT event_id, (event_id % 490 + 10)::INT AS n, 0 AS best, trunc((-0.6)::FLOAT + (-0.6)::FLOAT * (event_id % 490 + 10)::FLOAT)::INT AS least FROM events)""")
def score_thresholds(spark, sf_dir):
    d = table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 490 + 10).cast("int").alias("n"))
    least = scoring.min_score(F.col("n"), -0.6, -0.6)
    return d.select("event_id", least.alias("linear"), scoring.min_score(F.col("n"), 0.0, 10.0, True).alias("log"), scoring.gap_budget(F.col("n"), F.lit(0), least, -3, -8).alias("gaps"))


def mapq_case() -> str:
    """The first model's quality from columns best, second, least, diff, over and gap."""
    f = lambda x: f"(diff * {x}::FLOAT)::FLOAT"
    out = "CASE WHEN best < least THEN 0 WHEN second IS NULL THEN CASE " + " ".join(f"WHEN over >= {f(a)} THEN {b}" for a, b in zip((0.8, 0.7, 0.6, 0.5, 0.4, 0.3), (42, 40, 24, 23, 8, 3), strict=True)) + " ELSE 0 END"
    for a, (x, y) in zip((0.9, 0.8, 0.7, 0.6), ((39, 33), (38, 27), (37, 26), (36, 22)), strict=True):
        out += f" WHEN gap >= {f(a)} THEN CASE WHEN over = diff THEN {x} ELSE {y} END"
    rows = ((0.5, 0.84, 0.68, 35, 25, 16, 5), (0.4, 0.84, 0.68, 34, 21, 14, 4), (0.3, 0.88, 0.67, 32, 18, 15, 3), (0.2, 0.88, 0.67, 31, 17, 11, 0), (0.1, 0.88, 0.67, 30, 12, 7, 0))
    for a, c1, c2, v0, v1, v2, v3 in rows:
        out += f" WHEN gap >= {f(a)} THEN CASE WHEN over = diff THEN {v0} WHEN over >= {f(c1)} THEN {v1} WHEN over >= {f(c2)} THEN {v2} ELSE {v3} END"
    out += f" WHEN gap > 0 THEN CASE WHEN over >= {f(0.67)} THEN 6 ELSE 2 END ELSE CASE WHEN over >= {f(0.67)} THEN 1 ELSE 0 END END"
    return f"{out}::INT"


def _mapq_sql() -> str:
    return f"SELECT o_orderkey, {mapq_case()} AS mapq FROM (SELECT o_orderkey, best, second, least, (0 - least)::FLOAT AS diff, (best - least)::FLOAT AS over, abs(abs(best) - abs(second))::FLOAT AS gap FROM (SELECT o_orderkey, (-(o_orderkey % 70))::INT AS best, CASE WHEN o_custkey % 3 > 0 THEN (-(o_orderkey % 70) - o_custkey % 50)::INT END AS second, -60 AS least FROM orders))"


@register("mapq_model", _mapq_sql())
def mapq_model(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    best = (-(F.col("o_orderkey") % 70)).cast("int")
    second = F.when(F.col("o_custkey") % 3 > 0, (best - F.col("o_custkey") % 50).cast("int"))
    return o.select("o_orderkey", scoring.mapq(best, second, F.lit(0), F.lit(-60)).alias("mapq"))


def _mapq_local_sql() -> str:
    f = lambda x: f"(diff * {x}::FLOAT)::FLOAT"
    out = "CASE WHEN best < least THEN 0 WHEN second IS NULL THEN CASE " + " ".join(f"WHEN over >= {f(a)} THEN {b}" for a, b in zip((0.8, 0.7, 0.6, 0.5, 0.4, 0.3), (44, 42, 41, 36, 28, 24), strict=True)) + " ELSE 22 END"
    out += "".join(f" WHEN gap >= {f(a)} THEN {x}" for a, x in zip((0.9, 0.8, 0.7, 0.6), (40, 39, 38, 37), strict=True))
    for a, full, high, rest in ((0.5, 35, 25, 20), (0.4, 34, 21, 19), (0.3, 33, 18, 16), (0.2, 32, 17, 12), (0.1, 31, 14, 9)):
        out += f" WHEN gap >= {f(a)} THEN CASE WHEN over = diff THEN {full} WHEN over >= {f(0.5)} THEN {high} ELSE {rest} END"
    out += f" WHEN gap > 0 THEN CASE WHEN over >= {f(0.5)} THEN 11 ELSE 2 END ELSE CASE WHEN over >= {f(0.5)} THEN 1 ELSE 0 END END"
    alone, perfect, two = (list(x) for x in (scoring.TABLE_ALONE, scoring.TABLE_PERFECT, sum(scoring.TABLE_TWO, ())))
    bin_of = lambda x: f"least(greatest(trunc({x}::DOUBLE * (10.0::DOUBLE / 60) + 0.5), 0), 10)::INT"
    away, gap = bin_of("greatest(100 - best, 0)"), bin_of("(best - second)")
    by_table = f"CASE WHEN best < least THEN 0 WHEN second IS NULL THEN CASE WHEN best = 100 THEN 44 ELSE {alone}[{away} + 1] END WHEN best = 100 THEN {perfect}[{gap} + 1] ELSE {two}[{gap} * 11 + {away} + 1] END"
    rows = "SELECT o_orderkey, (100 - o_orderkey % 70)::INT AS best, CASE WHEN o_custkey % 3 > 0 THEN (100 - o_orderkey % 70 - o_custkey % 50)::INT END AS second, 40 AS least FROM orders"
    return f"SELECT o_orderkey, {out}::INT AS mapq, {by_table}::INT AS mapq_table FROM (SELECT *, 60::FLOAT AS diff, (best - least)::FLOAT AS over, abs(abs(best) - abs(second))::FLOAT AS gap FROM ({rows}))"


@register("mapq_local", _mapq_local_sql())
def mapq_local(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    best = (100 - F.col("o_orderkey") % 70).cast("int")
    second = F.when(F.col("o_custkey") % 3 > 0, (best - F.col("o_custkey") % 50).cast("int"))
    return o.select("o_orderkey", scoring.mapq(best, second, F.lit(100), F.lit(40), monotone=False).alias("mapq"), scoring.mapq_table(best, second, F.lit(100), F.lit(40)).alias("mapq_table"))


@register("sorted_bounds", "SELECT o_orderkey, len(list_filter([2, 5, 5, 9, 14], lambda v: v < k))::INT AS lower, len(list_filter([2, 5, 5, 9, 14], lambda v: v <= k))::INT AS upper, len(list_filter([2, 5, 5, 9, 14], lambda v: NOT v > k))::INT AS pivot FROM (SELECT o_orderkey, (o_orderkey % 17)::INT AS k FROM orders)")
def sorted_bounds(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 17).cast("int").alias("k"))
    v = F.array(*map(F.lit, (2, 5, 5, 9, 14)))
    return o.select("o_orderkey", filters.lower_bound(v, F.col("k")).alias("lower"), filters.upper_bound(v, F.col("k")).alias("upper"), filters.find_pivot(v, lambda x: x > F.col("k")).alias("pivot"))


_KEYS = "SELECT DISTINCT key, key AS x FROM (SELECT o_custkey AS key FROM orders UNION ALL SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0)"


@register("bloom_membership", f"""WITH b AS (SELECT a.key, (a.x + m.x * i) & 4095 AS bit FROM ({sql_hash32(_KEYS, 'key')}) a JOIN ({sql_hash32_mix(_KEYS, 'key')}) m USING (key), (SELECT unnest(range(0, 3)) AS i)),
   held AS (SELECT DISTINCT bit FROM b WHERE key IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0))
   SELECT o_orderkey, o_custkey, has FROM orders JOIN (SELECT key, bool_and(bit IN (SELECT bit FROM held)) AS has FROM b GROUP BY key) ON key = o_custkey""")
def bloom_membership(spark, sf_dir):
    """What a filter of 4,096 bits over every second customer answers, false positives too."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    bloom = lookup.bloom_build(table(spark, sf_dir, "customer").where("c_custkey % 2 = 0"), "c_custkey", 3, 4096)
    return lookup.bloom_has(o, "o_custkey", bloom, 3, 4096).select("o_orderkey", "o_custkey", "has")


STATES = "(SELECT o_orderkey AS k, (o_orderkey % 300 + 1)::INT AS len, -(o_orderkey % 40) AS score, CASE WHEN o_custkey % 3 > 0 THEN -(o_orderkey % 40) - o_custkey % 11 END AS second_score, CASE WHEN o_orderkey % 7 > 0 THEN -(o_orderkey % 30) END AS anchor_score FROM orders)"


@register("read_states", f"SELECT k, second_score IS NOT NULL AS has_second, second_score IS NULL OR -second_score > 15 AS active, score >= -20 AS above, anchor_score IS NOT NULL AS anchored FROM {STATES}")
def read_states(spark, sf_dir):
    """Reads by state; an over-long read would fail the query."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    d = table(spark, sf_dir, "orders").select(k.alias("k"), (k % 300 + 1).cast("int").alias("len"), (-(k % 40)).alias("score"), F.when(c % 3 > 0, -(k % 40) - c % 11).alias("second_score"), F.when(k % 7 > 0, -(k % 30)).alias("anchor_score"))
    d = filters.guard_length(d, "len", 300)
    marks = lambda kept, name: kept.select("k", F.lit(True).alias(name))
    out = d.select("k", filters.still_active(F.col("second_score"), 15).alias("active"), filters.above_threshold(F.col("score"), F.lit(-20)).alias("above"))
    out = out.join(marks(filters.second_best(d), "has_second"), "k", "left").join(marks(filters.valid_anchors(d), "anchored"), "k", "left")
    return out.fillna(False, ["has_second", "anchored"])

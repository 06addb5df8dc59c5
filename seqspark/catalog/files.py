"""Queries of sources and sinks: whole tables are written in a format, read back and stated by SQL on the tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import index
from ..operators.derive import CONTIGS_SQL, READS_SQL, contigs, qualities, reads, sequences, table
from ..sources import readers, writers
from ..sources.store import folder
from .indexes import BWT_SQL, bwt_of, texts
from .records import side, side_sql
from .symbols import DOCS

QUERIES, ORACLES = {}, {}


def register(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


@register("fasta_round_trip", f"SELECT 'doc' || doc_id AS name, md5(seq) AS seq, length(seq)::INT AS len FROM {DOCS}")
def fasta_round_trip(spark, sf_dir):
    """Headers with a remark, lines of 60 symbols."""
    path = folder(spark)
    d = sequences(spark, sf_dir)
    d.select(F.concat(F.lit(">doc"), F.col("ref_id").cast("string"), F.lit(" some remark\n"), F.regexp_replace("seq", "(.{60})", "$1\n"))).write.text(path)
    return readers.read_fasta(spark, path).select("name", F.md5("seq").alias("seq"), F.length("seq").alias("len"))


def fastq_lines(spark, sf_dir, first: bool = True):
    r = qualities(reads(spark, sf_dir))
    q = F.array_join(F.transform("qual", lambda x: F.char(x + 33)), "")
    seq = F.col("seq") if first else F.reverse("seq")
    return r.select("read_id", F.concat(F.lit("@r"), F.col("read_id").cast("string"), F.lit(" x\n"), seq, F.lit("\n+\n"), q).alias("line"))


def fastq(spark, sf_dir, first: bool = True, **options):
    path = folder(spark)
    fastq_lines(spark, sf_dir, first).orderBy("read_id").coalesce(1).select("line").write.option("compression", "gzip" if first else "none").text(path)
    return readers.read_fastq(spark, path, **options)


@register("fastq_round_trip", f"SELECT 'r' || read_id AS name, seq, len::INT AS read_len, list_sum([((i * 7 + read_id) % 41) FOR i IN range(1, len + 1)])::BIGINT AS total FROM ({READS_SQL})")
def fastq_round_trip(spark, sf_dir):
    return fastq(spark, sf_dir).select("name", "seq", "read_len", F.when(F.size("qual") > 0, F.aggregate("qual", F.lit(0), lambda a, x: a + x)).cast("long").alias("total"))


@register("fastq_limits", f"SELECT 'r' || read_id AS name, substr(seq, 1, 50) AS seq FROM ({READS_SQL}) ORDER BY read_id LIMIT 7")
def fastq_limits(spark, sf_dir):
    """The reader's own limits: the first reads, cut to a length."""
    return fastq(spark, sf_dir, max_reads=7, max_read_len=50).select("name", "seq")


@register("paired_reads", f"SELECT 'r' || read_id AS name1, seq AS seq1, 'r' || read_id AS name2, reverse(seq) AS seq2 FROM ({READS_SQL})")
def paired_reads(spark, sf_dir):
    return readers.paired(fastq(spark, sf_dir), fastq(spark, sf_dir, False)).select("name1", "seq1", "name2", "seq2")


# records made from orders
SAM_COLUMNS = {
    "qname": "'r' || k", "flag": "CASE WHEN k % 11 = 0 THEN 4 ELSE (k % 2) * 16 + CASE WHEN k % 13 = 0 THEN 256 ELSE 0 END END", "rname": "CASE WHEN k % 11 = 0 THEN '*' ELSE 'c' || (k % 5 + 1) END", "pos": "CASE WHEN k % 11 = 0 THEN 0 ELSE k * 31 % 50000 + 1 END",
    "mapq": "CASE WHEN k % 11 = 0 THEN 0 ELSE k % 43 END", "cigar": "CASE WHEN k % 11 = 0 THEN '*' ELSE (k % 10 + 1) || 'M2D' || (k % 7 + 1) || 'M' END", "rnext": "'*'", "pnext": "0", "tlen": "0", "seq": "substr('ACGTTGCAACGGTTCAGACT', 1, k % 10 + k % 7 + 2)", "qual": "substr('IIHHGGFFEEDDCCBBAA@@', 1, k % 10 + k % 7 + 2)",
    "NM": "CASE WHEN k % 11 > 0 THEN k % 6 END", "AS": "CASE WHEN k % 11 > 0 THEN -(k % 40) END", "MD": "CASE WHEN k % 11 > 0 THEN (k % 10 + 1) || '^AC' || (k % 7 + 1) END",
}
WHOLE = ("flag", "pos", "mapq", "pnext", "tlen", "NM", "AS")


def records(spark, sf_dir):
    cols = []
    for c, e in SAM_COLUMNS.items():
        e = e.replace("1, k % 10 + k % 7 + 2)", "1, int(k % 10 + k % 7 + 2))")
        cols.append(f"cast({e} as {'int' if c in WHOLE else 'string'}) as `{c}`")
    return table(spark, sf_dir, "orders").selectExpr("o_orderkey as k").selectExpr(*cols)


RECORDS_SQL = "(SELECT " + ", ".join(f"({e.replace('k % 10 + k % 7 + 2)', '(k % 10 + k % 7 + 2)::INT)')})::{'INT' if c in WHOLE else 'VARCHAR'} AS \"{c}\"" for c, e in SAM_COLUMNS.items()) + " FROM (SELECT o_orderkey AS k FROM orders))"
READ_SQL = f"SELECT *, coalesce(\"NM\"::VARCHAR, '') AS tag_nm, coalesce(\"AS\"::VARCHAR, '') AS tag_as, coalesce(\"MD\", '') AS tag_md FROM {RECORDS_SQL}"
REF = [(f"c{i}", 60000) for i in range(1, 6)]


def refs(spark):
    return spark.createDataFrame([(i, n, size) for i, (n, size) in enumerate(REF)], "ref_id int, name string, len int")


def shown(df):
    tag = lambda n: F.coalesce(F.try_element_at("tags", F.lit(n)), F.lit(""))
    return df.select("qname", "flag", "rname", "pos", "mapq", "cigar", "rnext", "pnext", "tlen", "seq", "qual", tag("NM").alias("tag_nm"), tag("AS").alias("tag_as"), tag("MD").alias("tag_md"))


SHOWN_SQL = f"SELECT qname, flag, rname, pos, mapq, cigar, rnext, pnext, tlen, seq, qual, tag_nm, tag_as, tag_md FROM ({READ_SQL})"


def sam(spark, sf_dir):
    path = folder(spark)
    writers.write_alignments(records(spark, sf_dir), path, refs(spark), "sam")
    return path


def bam(spark, sf_dir):
    path = folder(spark)
    tags = F.map_filter(F.create_map(*(x for t in ("NM", "AS", "MD") for x in (F.lit(t), F.col(t).cast("string")))), lambda _, v: v.isNotNull())
    writers.write_alignments(records(spark, sf_dir).withColumn("tags", tags).repartition("qname"), path, refs(spark), "bam")
    return path


@register("sam_round_trip", SHOWN_SQL)
def sam_round_trip(spark, sf_dir):
    return shown(readers.read_sam(spark, sam(spark, sf_dir)))


@register("sam_header", "SELECT kind, f.k AS key, f.v AS value FROM (SELECT 'HD' AS kind, {k: 'VN', v: '1.3'} AS f UNION ALL SELECT 'PG', {k: x, v: 'seqspark'} FROM (SELECT unnest(['ID', 'PN']) AS x) UNION ALL SELECT 'SQ', unnest([{k: 'SN', v: 'c' || i}, {k: 'LN', v: '60000'}]) FROM (SELECT unnest(range(1, 6)) AS i))")
def sam_header(spark, sf_dir):
    return readers.read_sam_header(spark, sam(spark, sf_dir)).select("kind", F.explode("fields"))


@register("bam_round_trip", SHOWN_SQL)
def bam_round_trip(spark, sf_dir):
    return shown(readers.read_bam(spark, bam(spark, sf_dir)))


@register("primary_reads", f"SELECT qname AS name, CASE WHEN flag & 16 <> 0 THEN reverse(translate(seq, 'ACGT', 'TGCA')) ELSE seq END AS seq, CASE WHEN flag & 16 <> 0 THEN reverse(qual) ELSE qual END AS qual, length(seq)::INT AS read_len FROM {RECORDS_SQL} WHERE flag & 256 = 0")
def primary_reads(spark, sf_dir):
    found = readers.read_sequences(spark, sam(spark, sf_dir), "sam")
    return found.withColumn("qual", F.array_join(F.transform("qual", lambda q: F.char(q + 33)), ""))


@register("alignment_records", f"SELECT qname, flag, pos - 1 AS pos, \"AS\" AS score, mapq, \"NM\" AS ed, CASE WHEN flag & 4 = 0 THEN length(seq) ELSE 0 END::INT AS subs, 0 AS ins, CASE WHEN flag & 4 = 0 THEN 2 ELSE 0 END AS dels, 0 AS n_mm, false AS has_second FROM {RECORDS_SQL}")
def alignment_records(spark, sf_dir):
    """Records of a BAM file as the comparison reads them; ids are digests that names of large files share, so names stay for the SQL."""
    found = readers.alignment_records(readers.read_bam(spark, bam(spark, sf_dir)), keep=("qname",))
    return found.select("qname", "flag", "pos", "score", "mapq", "ed", "subs", "ins", "dels", "n_mm", "has_second")


@register("debug_round_trip", f"SELECT read_id, mate, read_len, flag, ref_id, pos, score, mapq, ed, subs, ins, dels, n_mm, has_second, CASE WHEN has_second THEN sec_score END AS sec_score FROM {side_sql(0)}")
def debug_round_trip(spark, sf_dir):
    path = folder(spark)
    d = side(spark, sf_dir, 0).withColumn("n_gapo", F.lit(0)).withColumn("n_gape", F.lit(0))
    writers.write_alignments(d.repartition("read_id"), path, fmt="debug")
    return readers.read_debug(spark, f"{path}/mate=1").drop("n_gapo", "n_gape")


@register("filter_file", f"SELECT read_id FROM {side_sql(0)} WHERE mapq >= 20")
def filter_file(spark, sf_dir):
    path = folder(spark)
    writers.write_filter(side(spark, sf_dir, 0), F.col("mapq") >= 20, path)
    return spark.read.parquet(path)


@register("annotation_files", f'SELECT name, \'\' AS anno, "offset", len::INT AS len, 0 AS n_ambs, 0 AS gi FROM ({CONTIGS_SQL})')
def annotation_files(spark, sf_dir):
    path = folder(spark)
    c = contigs(spark, sf_dir).select("ref_id", "name", F.lit("").alias("anno"), "offset", "len", F.lit(0).alias("n_ambs"), F.lit(0).alias("gi"))
    writers.write_annotations(c, spark.createDataFrame([], "offset long, len int, amb string"), f"{path}/index")
    return readers.read_annotations(spark, f"{path}/index")[0].drop("ref_id")


@register("packed_files", f"SELECT 't' || read_id || '.pac' AS file, seq FROM ({READS_SQL})")
def packed_files(spark, sf_dir):
    path = folder(spark)
    writers.write_index_files(readers.pack_files(reads(spark, sf_dir).select(F.concat(F.lit("t"), F.col("read_id").cast("string")).alias("name"), "seq")), path)
    return readers.read_pac(spark, path)


@register("transform_files", f"""SELECT 't' || ref_id || '.bwt' AS file, max("row") FILTER (ch = '$')::INT AS "primary", string_agg(CASE WHEN ch = '$' THEN '' ELSE ch END, '' ORDER BY "row") AS bwt, (count(*) - 1)::INT AS size FROM ({BWT_SQL}) GROUP BY ref_id HAVING count(*) > 1""")
def transform_files(spark, sf_dir):
    path = folder(spark)
    rows = index.bwt_string(bwt_of(spark, sf_dir)).join(index.l2_counts(texts(spark, sf_dir)), "ref_id").where("length > 0")
    named = rows.select(F.concat(F.lit("t"), F.col("ref_id").cast("string")).alias("name"), "bwt", "primary", F.slice("l2", 2, 4).alias("l2"))
    writers.write_index_files(readers.bwt_files(named), path)
    return readers.read_bwt(spark, path).select("file", "primary", "bwt", F.col("l2")[3].alias("size"))


@register("input_listing", "SELECT i::VARCHAR || '.fq' AS name FROM (SELECT unnest(range(0, 3)) AS i)")
def input_listing(spark, sf_dir):
    path = folder(spark)
    for i in range(3):
        writers._text(spark.createDataFrame([(0, "@a\nA\n+\nI")], "o long, line string"), f"{path}/{i}.fq")
    found = readers.list_inputs(spark, f"{path}/*.fq")
    return spark.createDataFrame([(f.rpartition("/")[2],) for f in found], "name string")


@register("index_round_trip", f'SELECT ref_id, length(seq)::INT AS length, max("row") FILTER (ch = \'$\')::INT AS "primary" FROM ({BWT_SQL}) GROUP BY ref_id, seq')
def index_round_trip(spark, sf_dir):
    """An index is built, published to other sessions of the application, and read there."""
    from ..plans import indexing

    path = folder(spark)
    indexing.build_index(texts(spark, sf_dir).withColumn("name", F.col("ref_id").cast("string")), path, long_texts=False)
    found = indexing.load_index(spark, path)
    (name,) = indexing.publish({"meta": found["meta"]}, f"seqspark_{uuid.uuid4().hex}_")
    return spark.newSession().table(name).select("ref_id", "length", "primary")

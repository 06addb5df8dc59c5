"""SAM, BAM, debug and sidecar writers; the default sink of a table is parquet."""

from __future__ import annotations

import gzip
import re
import struct
import uuid
import zlib

import pandas as pd
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .readers import BASES, CIGAR_OPS, DEBUG_HEAD, DEBUG_INFO

CIGAR = re.compile(r"(\d+)([MIDNSHP=X])")
#: fixed values: a base's four bits as a hexadecimal digit, 15 for any other symbol; a quality symbol's Phred value
FOUR_BITS = bytes(b"0123456789abcdef"[BASES.find(chr(c))] for c in range(256))
PHRED = bytes((c - 33) % 256 for c in range(256))

#: fixed value: the empty block that ends a blocked gzip file
BGZF_END = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")


def sam_header(contigs: DataFrame, version: str = "1.3", program: str = "seqspark") -> DataFrame:
    """(line) of the header, one @SQ for each contig in order of ref_id."""
    spark = contigs.sparkSession
    head = spark.createDataFrame([(0, f"@HD\tVN:{version}")], "o int, line string")
    end = spark.createDataFrame([(0, f"@PG\tID:{program}\tPN:{program}")], "o int, line string")
    sq = contigs.orderBy("ref_id").select(F.format_string("@SQ\tSN:%s\tLN:%d", "name", F.col("len").cast("int")).alias("line"))
    return head.select("line").unionByName(sq).unionByName(end.select("line"))


def sam_lines(records: DataFrame) -> DataFrame:
    """(line) of records with the SAM columns and optional typed tags NM, AS, XS, XM, XO, XG (int) and MD (string).  Unmapped records have no place, quality, CIGAR or tags."""
    gone = F.col("flag").bitwiseAND(F.lit(4)) != 0
    s = lambda c, other: F.when(gone, F.lit(other)).otherwise(F.coalesce(F.col(c).cast("string"), F.lit(other)))
    names = set(records.columns)
    tags = [F.when(~gone & F.col(t).isNotNull(), F.concat(F.lit(f"{t}:{'Z' if t == 'MD' else 'i'}:"), F.col(t).cast("string"))) for t in ("NM", "AS", "XS", "XM", "XO", "XG", "MD") if t in names]
    fields = [F.col("qname"), F.col("flag").cast("string"), s("rname", "*"), s("pos", "0"), s("mapq", "0"), s("cigar", "*"), s("rnext", "*"), s("pnext", "0"), s("tlen", "0"), F.coalesce("seq", F.lit("*")), F.coalesce("qual", F.lit("*"))]
    return records.select(F.concat_ws("\t", *fields, *tags).alias("line"))


def write_sam(records: DataFrame, contigs: DataFrame, path: str) -> None:
    """The header is the first part file."""
    sam_header(contigs).coalesce(1).unionByName(sam_lines(records)).write.mode("overwrite").text(path)


def bgzf(raw: bytes) -> bytes:
    """Blocks of at most 64 KB, each a gzip member that tells its size; without the end block."""
    out = []
    for i in range(0, len(raw), 0xFF00):
        part = raw[i : i + 0xFF00]
        c = zlib.compressobj(6, zlib.DEFLATED, -15)
        body = c.compress(part) + c.flush()
        out.append(b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x06\0BC\x02\0" + struct.pack("<H", len(body) + 25) + body + struct.pack("<II", zlib.crc32(part), len(part)))
    return b"".join(out)


def bam_header(contigs: list[tuple[str, int]], text: str = "@HD\tVN:1.3\n") -> bytes:
    refs = b"".join(struct.pack("<i", len(n) + 1) + n.encode() + b"\0" + struct.pack("<i", size) for n, size in contigs)
    return b"BAM\x01" + struct.pack("<i", len(text)) + text.encode() + struct.pack("<i", len(contigs)) + refs


def bam_bin(begin: int, end: int) -> int:
    """The smallest bin of the format's binning scheme that holds begin .. end - 1."""
    # fixed values: bin size as a power of two, number of the first bin of that size
    for shift, first in ((14, 4681), (17, 585), (20, 73), (23, 9), (26, 1)):
        if begin >> shift == (end - 1) >> shift:
            return first + (begin >> shift)
    return 0


def bam_record(r: dict, ref_ids: dict[str, int]) -> bytes:
    """One record; without a place its bin is that of place -1."""
    gone = r["flag"] & 4
    ref = -1 if gone else ref_ids.get(r["rname"], -1)
    nref = ref if r["rnext"] == "=" else ref_ids.get(r["rnext"], -1)
    ops = [] if gone or r["cigar"] in (None, "*") else [int(n) << 4 | CIGAR_OPS.index(o) for n, o in CIGAR.findall(r["cigar"])]
    seq = "" if r["seq"] in (None, "*") else r["seq"]
    packed = bytes.fromhex((seq.encode("ascii", "replace").translate(FOUR_BITS) + b"0" * (len(seq) & 1)).decode())
    qual = bytes([255] * len(seq)) if r["qual"] in (None, "*") else r["qual"].encode("latin-1").translate(PHRED)
    if len(qual) and max(qual) > 222 and r["qual"] not in (None, "*"):
        raise ValueError(f"quality below 33 in {r['qual']!r}")
    name = r["qname"].encode() + b"\0"
    begin = -1 if gone else r["pos"] - 1
    span = sum(x >> 4 for x in ops if CIGAR_OPS[x & 15] in "MDN=X") or 1
    tags = b"".join(k.encode() + (b"Z" + str(v).encode() + b"\0" if k == "MD" else b"i" + struct.pack("<i", int(v))) for k, v in (r.get("tags") or {}).items())
    body = struct.pack("<iiBBHHHiiii", ref, begin, len(name), 0 if gone else r["mapq"], bam_bin(begin, begin + span), len(ops), r["flag"], len(seq), nref, (r["pnext"] or 0) - 1, r["tlen"] or 0)
    body += name + struct.pack(f"<{len(ops)}I", *ops) + packed + qual + tags
    return struct.pack("<i", len(body)) + body


#: Pieces of a file at most, of up to 10,000 records each: a reader's task takes a whole file.
FILE_PIECES = 25


def bam_pieces(records: DataFrame, contigs: list[tuple[str, int]]) -> DataFrame:
    """(n, content): the pieces of each task's BAM files in order."""
    ids = {n: i for i, (n, _) in enumerate(contigs)}
    names = ["qname", "flag", "rname", "pos", "mapq", "cigar", "rnext", "pnext", "tlen", "seq", "qual", "tags"]
    encode = lambda b: bgzf(b"".join(bam_record(dict(zip(names, r, strict=True)), ids) for r in b[names].astype(object).itertuples(index=False, name=None)))
    return records.select(*names).mapInPandas(_pieces(encode, bgzf(bam_header(contigs)), BGZF_END), "n long, content binary")


def _pieces(encode, head: bytes = b"", end: bytes = b""):
    """Batches to pieces of files: every FILE_PIECES pieces are a file, with its head and end.  A task without rows has no file, and only a piece is held."""

    def run(batches):
        number, held = 0, None
        for part in (b.iloc[i : i + 10_000] for b in batches for i in range(0, len(b), 10_000)):
            if held is not None:
                yield pd.DataFrame({"n": [held[0]], "content": [held[1] + (end if number % FILE_PIECES == 0 else b"")]})
            held = len(part), (head if number % FILE_PIECES == 0 else b"") + encode(part)
            number += 1
        if held is not None:
            yield pd.DataFrame({"n": [held[0]], "content": [held[1] + end]})

    return run


def write_bam(records: DataFrame, contigs: list[tuple[str, int]], path: str) -> int:
    """BAM files, one or more a task, written by the tasks; returns how many records were written."""
    return _write_pieces(bam_pieces(records, contigs), path, "bam")


def _write_pieces(pieces: DataFrame, path: str, end: str) -> int:
    """Every FILE_PIECES pieces (n, content) of a task become a file ``part-*.end`` below ``path``, written by the task; the driver only renames.

    Spark's sink that takes bytes as they are is that of text, which puts a separator behind each row.  A piece ends as a gzip
    member does, by its size in four bytes; the last is 0, as a member has less than 16 MB, and it is the separator.
    """
    spark = pieces.sparkSession
    at = f"{path}/_pieces-{uuid.uuid4().hex}"
    rows = Observation()
    size = F.length("content")
    zero = F.hex(F.substring("content", size, F.lit(1))) == "00"
    content = F.when(zero, F.substring("content", F.lit(1), size - 1)).otherwise(F.raise_error(F.lit("a piece must end by a zero byte")).cast("binary"))
    counted = pieces.observe(rows, F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    counted.select(content.cast("string").alias("value")).write.options(lineSep="\0", compression="none", maxRecordsPerFile=FILE_PIECES).text(at)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    fs = hadoop.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for f in fs.listStatus(hadoop.Path(at)):
        name = f.getPath().getName()
        if name.startswith("part-") and f.getLen():
            target = hadoop.Path(f"{path}/{name[:10]}-{name.rpartition('-c')[2].partition('.')[0]}.{end}")
            fs.delete(target, False)
            if not fs.rename(f.getPath(), target):
                raise OSError(f"{f.getPath()} could not be renamed {target}")
    fs.delete(hadoop.Path(at), True)
    return rows.get["n"]


def _write_files(parts: DataFrame, path: str) -> int:
    """Each (name, n, content) row becomes a file below ``path``.  Files stream through the driver one at a time; nothing is gathered."""
    spark = parts.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    total = 0
    for r in parts.select("name", "n", "content").toLocalIterator():
        target = jvm.org.apache.hadoop.fs.Path(f"{path}/{r['name']}")
        stream = target.getFileSystem(conf).create(target, True)
        stream.write(bytearray(r["content"]))
        stream.close()
        total += r["n"]
    return total


def debug_record(r: dict) -> bytes:
    if not r["pos"]:
        return struct.pack(DEBUG_HEAD, r["read_id"] & 0xFFFFFFFF, r["read_len"], 0)
    sec = r["sec_score"] if r["has_second"] else 0
    info = struct.pack(DEBUG_INFO, r["flag"], r["ref_id"] & 0xFFFFFFFF, r["mate"], r["mapq"], r["ed"], 0, r["subs"], r["ins"], r["dels"], r["n_mm"], r["n_gapo"], r["n_gape"], int(r["has_second"]), r["score"], int(sec))
    return struct.pack(DEBUG_HEAD, r["read_id"] & 0xFFFFFFFF, r["read_len"], r["pos"]) + info


def write_debug(records: DataFrame, path: str) -> int:
    """Binary debug files, one or more for each task and mate, written by the tasks: a '#' in the path becomes the mate's number."""
    encode = lambda b: gzip.compress(b"".join(map(debug_record, b.astype(object).where(b.notna(), None).to_dict("records"))))
    total = 0
    for mate in (0, 1):
        part = records.where(F.col("mate") == mate).mapInPandas(_pieces(encode), "n long, content binary")
        total += _write_pieces(part, path.replace("#", str(mate + 1)) if "#" in path else f"{path}/mate={mate + 1}", "dbg")
    return total


def write_index_files(files: DataFrame, path: str) -> int:
    """Binary index files: rows (name, content), such as the encoders of packed sequences, transforms and samples make."""
    return _write_files(files.select("name", F.lit(1).alias("n"), "content"), path)


def write_annotations(contigs: DataFrame, ambs: DataFrame, prefix: str, seed: int = 11) -> None:
    """The two text sidecars: a header line, then two lines a contig; one line a hole.  One task: a line for each contig."""
    total, n = contigs.agg(F.coalesce(F.sum("len"), F.lit(0)), F.count("*")).first()
    spark = contigs.sparkSession
    first = F.concat(F.coalesce(F.col("gi"), F.lit(0)).cast("string"), F.lit(" "), "name", F.when(F.length("anno") > 0, F.concat(F.lit(" "), F.col("anno"))).otherwise(""))
    body = contigs.select(F.col("ref_id").cast("long").alias("o"), F.concat(first, F.lit("\n"), F.concat_ws(" ", "offset", "len", "n_ambs")).alias("line"))
    _text(spark.createDataFrame([(-1, f"{total} {n} {seed}")], "o long, line string").unionByName(body), f"{prefix}.ann")
    holes = ambs.count()
    _text(spark.createDataFrame([(-1, f"{total} {n} {holes}")], "o long, line string").unionByName(ambs.select(F.col("offset").alias("o"), F.concat_ws(" ", "offset", "len", "amb").alias("line"))), f"{prefix}.amb")


def _text(lines: DataFrame, path: str) -> None:
    """One file with ``lines`` in order of o."""
    spark = lines.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    stream = target.getFileSystem(conf).create(target, True)
    for r in lines.orderBy("o").toLocalIterator():
        stream.write(bytearray((r["line"] + "\n").encode()))
    stream.close()


def write_filter(both: DataFrame, condition, path: str) -> None:
    """The ids of the records that pass a comparison filter."""
    both.where(condition).select("read_id").write.mode("overwrite").parquet(path)


def write_alignments(df: DataFrame, path: str, contigs: DataFrame | None = None, fmt: str | None = None) -> None:
    """By format, or by extension: .sam, .bam, .dbg, .parquet; /dev/null runs the plan and writes nothing."""
    ends = {".sam": "sam", ".bam": "bam", ".dbg": "debug", ".parquet": "parquet"}
    fmt = fmt or ("null" if path == "/dev/null" else next((f for e, f in ends.items() if path.endswith(e)), "sam"))
    if fmt == "null":
        df.write.format("noop").mode("overwrite").save()
    elif fmt == "sam":
        write_sam(df, contigs, path)
    elif fmt == "bam":
        write_bam(df, [(r["name"], r["len"]) for r in contigs.orderBy("ref_id").select("name", "len").toLocalIterator()], path)
    elif fmt == "debug":
        write_debug(df, path)
    else:
        df.write.mode("overwrite").parquet(path)


def write_stage(df: DataFrame, folder: str, stage: str, round_no: int) -> None:
    """Keeps an intermediate table of a run for inspection."""
    df.write.mode("overwrite").parquet(f"{folder}/stage={stage}/round={round_no}")


def html_table(df: DataFrame, title: str, most: int = 1000) -> str:
    """A report of a (small) result table; ``most`` is the report's row limit."""
    import html

    rows = df.limit(most).collect()
    head = "".join(f"<th>{html.escape(c)}</th>" for c in df.columns)
    body = "".join("<tr>" + "".join(f"<td>{html.escape('' if v is None else str(v))}</td>" for v in r) + "</tr>" for r in rows)
    return f"<!doctype html><html><head><title>{html.escape(title)}</title></head><body><h1>{html.escape(title)}</h1><table><tr>{head}</tr>{body}</table></body></html>"

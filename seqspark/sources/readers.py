"""FASTA, FASTQ, SAM, BAM and index-sidecar readers as DataFrames.

Line formats are read by Spark's own text source (splittable, transparent gzip) and parsed by expressions; binary
ones by Spark's binary source and an Arrow-batched decoder, so any file system that Spark reads will do.
"""

from __future__ import annotations

import gzip
import itertools
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.sam import SECONDARY, has
from ..functions.symbols import quality
from ..schemas import RECORD

# --- FASTA ------------------------------------------------------------------------------------------------------------


def read_fasta(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, ord, name, seq): the name ends at the first space, white space in sequences is dropped, the rest of the header too.

    ``ord`` ascends with the place in the files.  A record is one row of the text source split at '>' after a line end.
    """
    rows = spark.read.option("lineSep", "\n>").text(path).select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("ord"), F.regexp_replace("value", r"^\s*>?", "").alias("v"))
    rows = rows.where(F.length(F.trim("v")) > 0)
    head = F.regexp_extract("v", r"^([^\n]*)", 1)
    name = F.regexp_extract(head, r"^([^ \r]*)", 1)
    seq = F.regexp_replace(F.substring("v", F.length(head) + 1, F.lit(1 << 30)), r"\s", "")
    return rows.select("file", "ord", name.alias("name"), seq.alias("seq"))


# --- FASTQ ------------------------------------------------------------------------------------------------------------


def _numbered_lines(lines: DataFrame) -> DataFrame:
    """Adds line (from 0, within the file).  Lines of a task are consecutive; only counts of tasks are put in order."""
    marked = lines.withColumn("_id", F.monotonically_increasing_id()).withColumn("_p", F.shiftright("_id", 33))
    sizes = marked.groupBy("file", "_p").agg(F.count("*").alias("_n"), F.min("_id").alias("_first"))
    upto = Window.partitionBy("file").orderBy("_start", "_p").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    starts = marked.groupBy("file", "_p").agg(F.min("_block").alias("_start"))
    offsets = sizes.join(starts, ["file", "_p"]).withColumn("_o", F.sum("_n").over(upto) - F.col("_n")).select("file", "_p", "_o", "_first")
    return marked.join(offsets, ["file", "_p"]).withColumn("line", F.col("_o") + F.col("_id") - F.col("_first")).drop("_id", "_p", "_o", "_first", "_block")


def read_fastq(spark: SparkSession, path: str | list[str], encoding: str = "phred33", max_reads: int | None = None, max_read_len: int | None = None) -> DataFrame:
    """(file, ord, name, seq, qual, read_len) of four-line records, plain or gzip; large plain files are split.

    A record whose marker lines are missing or that is cut off raises an error.  For multi-line bases use
    :func:`read_fastq_multiline`.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"), F.col("value"))
    rows = _numbered_lines(lines).withColumn("ord", F.floor(F.col("line") / 4))
    part = lambda k: F.max(F.when(F.pmod("line", F.lit(4)) == k, F.regexp_replace("value", "\r$", "")))
    records = rows.groupBy("file", "ord").agg(part(0).alias("h"), part(1).alias("seq"), part(2).alias("plus"), part(3).alias("q"), F.count("*").alias("n")).where("not (n = 1 and h = '')")
    good = (F.col("n") == 4) & F.startswith("h", F.lit("@")) & F.startswith("plus", F.lit("+")) & (F.length("seq") == F.length("q"))
    records = records.withColumn("h", F.when(F.coalesce(good, F.lit(False)), F.col("h")).otherwise(F.raise_error(F.concat(F.lit("bad FASTQ record "), F.col("ord").cast("string")))))
    return _reads(records.select("file", "ord", F.regexp_extract("h", r"^@(\S*)", 1).alias("name"), "seq", "q"), encoding, max_reads, max_read_len)


def parse_fastq(text: str) -> Iterator[tuple[str, str, str]]:
    """(name, bases, qualities): bases run until the '+' line and may span lines, qualities are one line."""
    lines = iter(text.splitlines())
    for line in lines:
        if not line.strip():
            continue
        if not line.startswith("@"):
            raise ValueError(f"record marker expected, found {line[:20]!r}")
        bases = []
        for more in lines:
            if more.startswith("+"):
                break
            bases.append(more.strip())
        else:
            raise ValueError("file ends within a record")
        q = next(lines, None)
        if q is None:
            raise ValueError("file ends within a record")
        yield line[1:].split()[0] if len(line) > 1 and line[1:].split() else "", "".join(bases), q.strip()


def read_fastq_multiline(spark: SparkSession, path: str | list[str], encoding: str = "phred33", max_reads: int | None = None, max_read_len: int | None = None) -> DataFrame:
    """The same for records whose bases span lines: a task reads a whole file."""

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for file, content in zip(b["path"], b["content"], strict=True):
                raw = gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content
                rows = [(file, i, *r) for i, r in enumerate(parse_fastq(raw.decode("ascii", "replace")))]
                yield pd.DataFrame(rows, columns=["file", "ord", "name", "seq", "q"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return _reads(files.mapInPandas(decode, "file string, ord long, name string, seq string, q string"), encoding, max_reads, max_read_len)


def _reads(records: DataFrame, encoding: str, max_reads: int | None, max_read_len: int | None) -> DataFrame:
    if max_reads is not None:
        records = records.orderBy("file", "ord").limit(max_reads)
    if max_read_len is not None:
        records = records.withColumn("seq", F.substring("seq", 1, max_read_len)).withColumn("q", F.substring("q", 1, max_read_len))
    return records.select("file", "ord", "name", "seq", quality(F.col("q"), encoding).alias("qual"), F.length("seq").alias("read_len"))


def paired(first: DataFrame, second: DataFrame) -> DataFrame:
    """Two read tables in lock-step by ``ord``; the longer one's tail is dropped."""
    a, b = (d.select("ord", *(F.col(c).alias(f"{c}{k}") for c in ("name", "seq", "qual", "read_len"))) for k, d in ((1, first), (2, second)))
    return a.join(b, "ord")


def batch_statistics(reads: DataFrame) -> DataFrame:
    return reads.agg(F.count("*").alias("n"), F.min("read_len").alias("min_len"), F.max("read_len").alias("max_len"), F.ceil(F.avg("read_len")).alias("avg_len"))


# --- SAM --------------------------------------------------------------------------------------------------------------


def read_sam(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """All records with their tags (name to value); header lines are left out."""
    lines = spark.read.text(path).where(~F.startswith("value", F.lit("@")) & (F.length("value") > 0))
    c = F.split("value", "\t")
    tags = F.map_from_entries(F.transform(F.filter(F.slice(c, 12, 1000), lambda t: F.contains(t, F.lit(":"))), lambda t: F.struct(F.substring(t, 1, 2).alias("k"), F.substring(t, 6, 1 << 20).alias("v"))))
    whole = {1, 3, 4, 7, 8}
    names = ["qname", "flag", "rname", "pos", "mapq", "cigar", "rnext", "pnext", "tlen", "seq", "qual"]
    return lines.select(*((F.get(c, F.lit(i)).cast("int") if i in whole else F.get(c, F.lit(i))).alias(n) for i, n in enumerate(names)), tags.alias("tags"))


def read_sam_header(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(kind, fields) of the header lines."""
    lines = spark.read.text(path).where(F.startswith("value", F.lit("@")))
    fields = F.map_from_entries(F.transform(F.filter(F.split("value", "\t"), lambda t: F.substring(t, 3, 1) == ":"), lambda t: F.struct(F.substring(t, 1, 2).alias("k"), F.substring(t, 4, 1 << 20).alias("v"))))
    return lines.select(F.substring("value", 2, 2).alias("kind"), fields.alias("fields"))


def primary_reads(records: DataFrame) -> DataFrame:
    """(name, seq, qual, read_len) of records that aren't secondary, as sequenced: reverse-strand records are turned back."""
    from ..functions.symbols import strand_view

    rc = has(F.col("flag"), 16)
    q = quality(F.col("qual"), "phred33")
    return records.where(~has(F.col("flag"), SECONDARY)).select(F.col("qname").alias("name"), strand_view(F.col("seq"), rc).alias("seq"), F.when(rc, F.reverse(q)).otherwise(q).alias("qual"), F.length("seq").alias("read_len"))


# --- BAM --------------------------------------------------------------------------------------------------------------

#: fixed values: symbols of the four-bit codes
BASES = "=ACMGRSVTWYHKDBN"
CIGAR_OPS = "MIDNSHP=X"
_PAIRS = [a + b for a in BASES for b in BASES]
_QUALITY = bytes((x + 33) % 256 for x in range(256))


class _Inflated:
    """The data of a file of gzip members, inflated as it is asked for: only the part being read is held."""

    STEP = 1 << 16

    def __init__(self, content: bytes):
        self.rest, self.from_, self.raw, self.at, self.member = memoryview(content), 0, b"", 0, None

    def have(self, size: int) -> bool:
        """Whether ``size`` bytes are left from ``at`` of ``raw``; moves both."""
        if len(self.raw) - self.at >= size:
            return True
        out, got = [self.raw[self.at :]], len(self.raw) - self.at
        while got < size and (self.from_ < len(self.rest) or self.member is not None):
            if self.member is None:
                self.member = zlib.decompressobj(31)
            part = self.rest[self.from_ : self.from_ + self.STEP]
            got_now = self.member.decompress(part)
            self.from_ += len(part)
            if self.member.eof:
                self.from_ -= len(self.member.unused_data)
                self.member = None
                while self.from_ < len(self.rest) and self.rest[self.from_] == 0:  # padding between members
                    self.from_ += 1
            elif not len(part):
                raise EOFError("file ends within a gzip member")
            out.append(got_now)
            got += len(got_now)
        self.raw, self.at = b"".join(out), 0
        return got >= size

    def take(self, size: int) -> bytes:
        if not self.have(size):
            raise EOFError("file ends within a record")
        self.at += size
        return self.raw[self.at - size : self.at]


def decode_bam(content: bytes) -> Iterator[tuple]:
    """Records of a (blocked) gzip file's content, as RECORD rows."""
    data = _Inflated(content)
    if not data.have(4) or data.take(4) != b"BAM\x01":
        raise ValueError("not a BAM file")
    number = lambda: struct.unpack("<i", data.take(4))[0]
    data.take(number())
    refs = []
    for _ in range(number()):
        refs.append(data.take(number())[:-1].decode())
        number()
    while data.have(1):
        raw = data.take(number())
        ref, pos, l_name, mapq, _, n_cigar, flag, l_seq, nref, npos, tlen = struct.unpack_from("<iiBBHHHiiii", raw)
        p, end = 32, len(raw)
        name = raw[p : p + l_name - 1].decode()
        p += l_name
        ops = struct.unpack_from(f"<{n_cigar}I", raw, p)
        p += 4 * n_cigar
        seq = "".join(_PAIRS[x] for x in raw[p : p + (l_seq + 1) // 2])[:l_seq]
        p += (l_seq + 1) // 2
        q = raw[p : p + l_seq]
        p += l_seq
        tags = {}
        while p < end:
            key, kind = raw[p : p + 2].decode(), chr(raw[p + 2])
            p += 3
            if kind in "ZH":
                stop = raw.index(b"\0", p)
                tags[key], p = raw[p:stop].decode(), stop + 1
            elif kind == "B":
                sub, count = chr(raw[p]), struct.unpack_from("<i", raw, p + 1)[0]
                fmt = f"<{count}{ {'c': 'b', 'C': 'B', 's': 'h', 'S': 'H', 'i': 'i', 'I': 'I', 'f': 'f'}[sub]}"
                tags[key] = ",".join(map(str, struct.unpack_from(fmt, raw, p + 5)))
                p += 5 + struct.calcsize(fmt)
            elif kind == "A":
                tags[key], p = chr(raw[p]), p + 1
            else:
                fmt = "<" + {"c": "b", "C": "B", "s": "h", "S": "H", "i": "i", "I": "I", "f": "f"}[kind]
                tags[key] = str(struct.unpack_from(fmt, raw, p)[0])
                p += struct.calcsize(fmt)
        cigar = "".join(f"{o >> 4}{CIGAR_OPS[o & 15]}" for o in ops) or "*"
        rname = refs[ref] if ref >= 0 else "*"
        rnext = "*" if nref < 0 else "=" if nref == ref else refs[nref]
        qual = "*" if not l_seq or q[0] == 255 else q.translate(_QUALITY).decode("latin-1")
        yield name, flag, rname, pos + 1, mapq, cigar, rnext, npos + 1, tlen, seq or "*", qual, tags


def _some(rows: Iterator[tuple], size: int = 10_000) -> Iterator[list[tuple]]:
    while part := list(itertools.islice(rows, size)):
        yield part


def read_bam(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """The same columns as :func:`read_sam`; a task decodes a whole file, some records at a time."""
    names = [f.split()[0] for f in RECORD.split(", ")]

    def decode(batches):
        for b in batches:
            for content in b["content"]:
                for rows in _some(decode_bam(content)):
                    yield pd.DataFrame(rows, columns=names)

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(decode, RECORD)


# --- dispatch and listings --------------------------------------------------------------------------------------------


def read_sequences(spark: SparkSession, path: str, fmt: str | None = None, **options) -> DataFrame:
    """By format, or by extension: .fasta/.fa, .sam, .bam, otherwise FASTQ."""
    base = path[:-3] if path.endswith(".gz") else path
    fmt = fmt or next((f for f, ends in (("fasta", (".fasta", ".fa")), ("sam", (".sam",)), ("bam", (".bam",))) if base.endswith(ends)), "fastq")
    if fmt == "fasta":
        return read_fasta(spark, path)
    if fmt in ("sam", "bam"):
        return primary_reads((read_sam if fmt == "sam" else read_bam)(spark, path))
    return read_fastq(spark, path, **options)


def list_inputs(spark: SparkSession, pattern: str) -> list[str]:
    """Files that a glob names, in order."""
    return [r[0] for r in spark.read.format("binaryFile").load(pattern).select("path").orderBy("path").collect()]


# --- alignments for comparison ----------------------------------------------------------------------------------------


def alignment_records(records: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """SAM or BAM records as comparison records: read_id is the CRC of the name, positions are 0-based, tags are typed.  ``keep`` names columns that stay, such as the name itself."""
    from ..functions.sam import cigar_summary, md_mismatches, parse_cigar

    tag = lambda n: F.try_element_at("tags", F.lit(n)).cast("int")
    c = cigar_summary(parse_cigar(F.col("cigar")))
    return records.select(
        F.crc32("qname").alias("read_id"), F.when(has(F.col("flag"), 128), 1).otherwise(0).alias("mate"), F.length("seq").alias("read_len"), "flag", F.crc32("rname").alias("ref_id"), (F.col("pos") - 1).alias("pos"),
        tag("AS").alias("score"), "mapq", tag("NM").alias("ed"), c["subs"].alias("subs"), c["ins"].alias("ins"), c["dels"].alias("dels"), F.coalesce(md_mismatches(F.try_element_at("tags", F.lit("MD"))), tag("XM"), F.lit(0)).alias("n_mm"),
        F.coalesce(tag("XO"), F.lit(0)).alias("n_gapo"), F.coalesce(tag("XG"), F.lit(0)).alias("n_gape"), tag("XS").isNotNull().alias("has_second"), tag("XS").alias("sec_score"), *keep,
    )


#: Layout of the binary debug records: id, read length, place; then, for aligned reads, the details.
DEBUG_HEAD, DEBUG_INFO = "<III", "<IIBBBBHBBBBBBii"


def decode_debug(content: bytes) -> Iterator[tuple]:
    data, more = _Inflated(content), struct.calcsize(DEBUG_INFO)
    while data.have(12):
        rid, length, pos = struct.unpack(DEBUG_HEAD, data.take(12))
        if pos:
            flag, ref, mate, mapq, ed, _, subs, ins, dels, mms, gapo, gape, second, score, sec = struct.unpack(DEBUG_INFO, data.take(more))
            yield rid, mate, length, flag, ref, pos, score, mapq, ed, subs, ins, dels, mms, gapo, gape, bool(second), sec if second else None
        else:
            yield rid, 0, length, 4, None, 0, None, 0, None, 0, 0, 0, 0, 0, 0, False, None


def read_debug(spark: SparkSession, path: str | list[str]) -> DataFrame:
    from ..schemas import ALIGNMENT

    names = [f.split()[0] for f in ALIGNMENT.split(", ")]

    def decode(batches):
        for b in batches:
            for content in b["content"]:
                for rows in _some(decode_debug(content)):
                    yield pd.DataFrame(rows, columns=names).astype({c: "Int64" if c == "read_id" else "Int32" for c in names if c != "has_second"})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(decode, ALIGNMENT)


# --- index files ------------------------------------------------------------------------------------------------------


def decode_pac(content: bytes) -> str:
    """Bases of a packed file: four a byte, first base highest; the last byte holds the length modulo 4."""
    rest = content[-1]
    size = (len(content) - 2) * 4 + rest if rest else (len(content) - 2) * 4
    x = np.frombuffer(content, np.uint8)[: (size + 3) // 4]
    codes = np.stack([x >> 6, x >> 4 & 3, x >> 2 & 3, x & 3], 1).reshape(-1)[:size]
    return np.frombuffer(b"ACGT", np.uint8)[codes].tobytes().decode()


def encode_pac(seq: str) -> bytes:
    codes = np.array(["ACGT".index(c) for c in seq], np.uint8)
    padded = np.pad(codes, (0, -len(codes) % 4)).reshape(-1, 4)
    body = (padded[:, 0] << 6 | padded[:, 1] << 4 | padded[:, 2] << 2 | padded[:, 3]).astype(np.uint8).tobytes()
    return body + (b"\0" if len(seq) % 4 == 0 else b"") + bytes([len(seq) % 4])


def decode_bwt(content: bytes) -> tuple[int, list[int], str]:
    """(primary, cumulative counts, symbols) of a transform file: 32-bit header words, then 16 symbols a word, first highest."""
    head = struct.unpack_from("<5I", content, 0)
    words = np.frombuffer(content, "<u4", offset=20)
    codes = (words[:, None] >> np.arange(30, -1, -2, dtype=np.uint32)).astype(np.uint8).reshape(-1) & 3
    size = head[4] or len(codes)
    return head[0], list(head[1:]), np.frombuffer(b"ACGT", np.uint8)[codes[:size]].tobytes().decode()


def encode_bwt(primary: int, counts: list[int], symbols: str) -> bytes:
    codes = np.array(["ACGT".index(c) for c in symbols], np.uint32)
    padded = np.pad(codes, (0, -len(codes) % 16)).reshape(-1, 16)
    words = (padded << np.arange(30, -1, -2, dtype=np.uint32)).sum(1, dtype=np.uint32)
    return struct.pack("<5I", primary, *counts) + words.astype("<u4").tobytes()


def decode_sa(content: bytes, primary: int, length: int) -> tuple[int, np.ndarray]:
    """(interval, sampled positions); a header that belongs to another index is an error."""
    head = struct.unpack_from("<7I", content, 0)
    if head[0] != primary or head[6] != length:
        raise ValueError("suffix array file mismatch")
    return head[5], np.frombuffer(content, "<u4", offset=28)


def encode_sa(primary: int, counts: list[int], interval: int, length: int, samples: list[int]) -> bytes:
    return struct.pack("<7I", primary, *counts, interval, length) + np.array(samples, "<u4").tobytes()


def pack_files(texts: DataFrame) -> DataFrame:
    """(name, content) of a packed file for every text (name, seq)."""

    def encode(batches):
        for b in batches:
            yield pd.DataFrame({"name": b["name"] + ".pac", "content": [encode_pac(s) for s in b["seq"]]})

    return texts.select("name", "seq").mapInPandas(encode, "name string, content binary")


def read_pac(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, seq) of packed files; a task decodes a file at a time."""

    def decode(batches):
        for b in batches:
            yield pd.DataFrame({"file": b["path"].str.extract(r"([^/]*)$")[0], "seq": [decode_pac(c) for c in b["content"]]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(decode, "file string, seq string")


def bwt_files(transforms: DataFrame) -> DataFrame:
    """(name, content) of a transform file for every row (name, bwt, primary, l2 of four ends)."""

    def encode(batches):
        for b in batches:
            rows = zip(b["primary"], b["l2"], b["bwt"], strict=True)
            yield pd.DataFrame({"name": b["name"] + ".bwt", "content": [encode_bwt(int(p), [int(x) for x in c], s) for p, c, s in rows]})

    return transforms.select("name", "bwt", "primary", "l2").mapInPandas(encode, "name string, content binary")


def read_bwt(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, primary, l2, bwt) of transform files."""

    def decode(batches):
        for b in batches:
            rows = [decode_bwt(c) for c in b["content"]]
            yield pd.DataFrame({"file": b["path"].str.extract(r"([^/]*)$")[0], "primary": [r[0] for r in rows], "l2": [r[1] for r in rows], "bwt": [r[2] for r in rows]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(decode, "file string, primary int, l2 array<int>, bwt string")


def read_annotations(spark: SparkSession, prefix: str) -> tuple[DataFrame, DataFrame]:
    """(contigs, ambs) of the two text sidecars."""
    ann = spark.read.text(f"{prefix}.ann", wholetext=True)
    rows = ann.select(F.posexplode(F.split(F.regexp_replace("value", r"\s+$", ""), "\n")).alias("i", "v")).where("i > 0")
    pairs = rows.groupBy(F.floor((F.col("i") - 1) / 2).cast("int").alias("ref_id")).agg(F.max(F.when(F.pmod("i", F.lit(2)) == 1, F.col("v"))).alias("a"), F.max(F.when(F.pmod("i", F.lit(2)) == 0, F.col("v"))).alias("b"))
    a, b = F.split("a", " ", 3), F.split("b", " ")
    contigs = pairs.select("ref_id", a[1].alias("name"), F.coalesce(F.get(a, F.lit(2)), F.lit("")).alias("anno"), b[0].cast("long").alias("offset"), b[1].cast("int").alias("len"), b[2].cast("int").alias("n_ambs"), a[0].cast("int").alias("gi"))
    amb = spark.read.text(f"{prefix}.amb", wholetext=True).select(F.posexplode(F.split(F.regexp_replace("value", r"\s+$", ""), "\n")).alias("i", "v")).where("i > 0 and v <> ''")
    c = F.split("v", " ")
    return contigs, amb.select(c[0].cast("long").alias("offset"), c[1].cast("int").alias("len"), c[2].alias("amb"))


def crc_of(name: str) -> int:
    return zlib.crc32(name.encode())

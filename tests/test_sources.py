"""Round trips of the file formats, with hand-made files."""

import gzip

import pytest
from pyspark.sql import functions as F

from seqspark.sources import readers, writers


def test_fasta(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">one some words\nACGT\nac gt\n>two\r\nNN--NN\r\n>empty\n>three x\nA\n")
    got = [(r["name"], r["seq"]) for r in readers.read_sequences(spark, str(tmp_path / "a.fa")).orderBy("ord").collect()]
    assert got == [("one", "ACGTacgt"), ("two", "NN--NN"), ("empty", ""), ("three", "A")]


def test_fastq(spark, tmp_path):
    text = "".join(f"@r{i} x\nACGT{'ACGT'[i % 4]}\n+\n@III!\n" for i in range(50))
    (tmp_path / "a.fq").write_text(text)
    with gzip.open(tmp_path / "b.fq.gz", "wt") as f:
        f.write(text)
    for name in ("a.fq", "b.fq.gz"):
        got = readers.read_sequences(spark, str(tmp_path / name)).orderBy("ord").collect()
        assert [r["name"] for r in got] == [f"r{i}" for i in range(50)] and got[1]["seq"] == "ACGTC" and got[0]["qual"] == [31, 40, 40, 40, 0]
    assert readers.read_fastq(spark, str(tmp_path / "a.fq"), max_reads=3, max_read_len=2).agg(F.sum("read_len")).first()[0] == 6
    stats = readers.batch_statistics(readers.read_fastq(spark, str(tmp_path / "a.fq"))).first()
    assert tuple(stats) == (50, 5, 5, 5)
    (tmp_path / "bad.fq").write_text("@r\nACGT\n+\n")
    with pytest.raises(Exception, match="bad FASTQ record"):
        readers.read_fastq(spark, str(tmp_path / "bad.fq")).collect()
    (tmp_path / "m.fq").write_text("@r\nAC\nGT\n+\nIIII\n")
    assert readers.read_fastq_multiline(spark, str(tmp_path / "m.fq")).first()["seq"] == "ACGT"
    with pytest.raises(ValueError):
        list(readers.parse_fastq("@r\nAC\n"))


SAM = "qname string, flag int, rname string, pos int, mapq int, cigar string, rnext string, pnext int, tlen int, seq string, qual string"


def test_sam_and_bam(spark, tmp_path):
    rows = [("r1", 0, "c1", 5, 30, "4M", "*", 0, 0, "ACGT", "IIII"), ("r2", 16, "c2", 7, 20, "2M1D2M", "=", 9, 12, "AACC", "ABCD"), ("r3", 256, "c1", 1, 0, "4M", "*", 0, 0, "TTTT", "IIII"), ("r4", 4, "*", 0, 0, "*", "*", 0, 0, "GGNA", "*")]
    df = spark.createDataFrame(rows, SAM).withColumn("NM", F.lit(1)).withColumn("AS", F.lit(-3)).withColumn("MD", F.lit("4"))
    contigs = spark.createDataFrame([(0, "c1", 100), (1, "c2", 200)], "ref_id int, name string, len int")
    writers.write_alignments(df, str(tmp_path / "x.sam"), contigs)
    back = readers.read_sam(spark, str(tmp_path / "x.sam"))
    assert sorted(tuple(r)[:11] for r in back.collect()) == sorted(rows)
    assert {r["kind"] for r in readers.read_sam_header(spark, str(tmp_path / "x.sam")).collect()} == {"HD", "SQ", "PG"}
    assert back.where("qname = 'r1'").first()["tags"] == {"NM": "1", "AS": "-3", "MD": "4"} and back.where("qname = 'r4'").first()["tags"] == {}
    reads = {r["name"]: r for r in readers.primary_reads(back).collect()}
    assert set(reads) == {"r1", "r2", "r4"} and reads["r2"]["seq"] == "GGTT" and reads["r2"]["qual"] == [35, 34, 33, 32]
    bam = back.withColumn("tags", F.col("tags"))
    assert writers.write_bam(bam, [("c1", 100), ("c2", 200)], str(tmp_path / "y.bam")) == 4
    again = readers.read_bam(spark, str(tmp_path / "y.bam") + "/*.bam")
    assert sorted(tuple(r)[:11] for r in again.collect()) == sorted(rows)
    aln = {r["pos"]: r for r in readers.alignment_records(again).where("flag < 256").collect()}
    assert aln[6]["dels"] == 1 and aln[4]["score"] == -3


def test_debug_and_sidecars(spark, tmp_path):
    cols = "read_id long, mate int, read_len int, flag int, ref_id int, pos int, score int, mapq int, ed int, subs int, ins int, dels int, n_mm int, n_gapo int, n_gape int, has_second boolean, sec_score int"
    rows = [(7, 0, 100, 0, 1, 50, -3, 30, 1, 100, 0, 0, 1, 0, 0, True, -9), (8, 1, 100, 16, 1, 60, -2, 30, 1, 100, 0, 0, 1, 0, 0, False, None)]
    assert writers.write_debug(spark.createDataFrame(rows, cols), str(tmp_path / "d#")) == 2
    assert sorted(tuple(r) for r in readers.read_debug(spark, [str(tmp_path / "d1"), str(tmp_path / "d2")]).collect()) == rows
    contigs = spark.createDataFrame([(0, "a", "note b", 0, 10, 1, 0), (1, "b", "", 10, 5, 0, 0)], "ref_id int, name string, anno string, offset long, len int, n_ambs int, gi int")
    ambs = spark.createDataFrame([(3, 2, "N")], "offset long, len int, amb string")
    writers.write_annotations(contigs, ambs, str(tmp_path / "idx"))
    c, a = readers.read_annotations(spark, str(tmp_path / "idx"))
    assert sorted(tuple(r) for r in c.collect()) == sorted(tuple(r) for r in contigs.collect()) and [tuple(r) for r in a.collect()] == [(3, 2, "N")]


def test_bam_files_are_cut_and_streamed(spark, tmp_path, monkeypatch):
    """Tasks write their files, a piece at a time and of bounded size; a reader holds a part of a file."""
    import tracemalloc

    import pandas as pd
    from pyspark.sql import DataFrame

    monkeypatch.setattr(writers, "FILE_PIECES", 2)
    batches = [pd.DataFrame({"x": range(n)}) for n in (10_001, 3, 4)]
    pieces = list(pd.concat(writers._pieces(lambda b: b"%d" % len(b), b"<", b">")(iter(batches))).itertuples(index=False, name=None))
    assert pieces == [(10_000, b"<10000"), (1, b"1>"), (3, b"<3"), (4, b"4>")] and not list(writers._pieces(lambda b: b"", b"<", b">")(iter(batches[:0])))
    monkeypatch.undo()

    def gathered(self, *a, **k):
        raise AssertionError("files go by way of the driver")

    one = ("r", 0, "c1", 5, 30, "4M", "*", 0, 0, "ACGT" * 50, "I" * 200)
    df = spark.createDataFrame([(f"r{i}", *one[1:]) for i in range(300)], SAM).withColumn("tags", F.create_map(F.lit("NM"), F.lit("1"))).repartition(3)
    monkeypatch.setattr(DataFrame, "toLocalIterator", gathered)
    for _ in range(2):  # the second run takes the place of the first
        assert writers.write_bam(df, [("c1", 100)], str(tmp_path / "z.bam")) == 300
    monkeypatch.undo()
    assert sorted(f.name for f in (tmp_path / "z.bam").iterdir() if not f.name.startswith(".")) == [f"part-{i:05d}-000.bam" for i in range(3)]
    assert sorted(r["qname"] for r in readers.read_bam(spark, str(tmp_path / "z.bam")).collect()) == sorted(f"r{i}" for i in range(300))

    record = writers.bam_record(dict(zip(SAM.replace(" string", "").replace(" int", "").split(", "), one, strict=True)), {"c1": 0})
    content = writers.bgzf(writers.bam_header([("c1", 100)])) + writers.bgzf(record * 30_000) + writers.BGZF_END
    tracemalloc.start()
    assert sum(1 for _ in readers.decode_bam(content)) == 30_000  # 10 MB
    assert tracemalloc.get_traced_memory()[1] < 3_000_000
    tracemalloc.stop()
    with pytest.raises(EOFError):
        list(readers.decode_bam(content[:-2000]))


def test_alignment_records_of_names_that_share_a_digest(spark, tmp_path):
    from seqspark.catalog import files

    keys = (13, 10_221_900)  # 'r' and the key have one CRC
    assert len({readers.crc_of(f"r{k}") for k in keys}) == 1
    spark.createDataFrame([(k,) for k in keys], "o_orderkey long").write.parquet(str(tmp_path / "orders.parquet"))
    assert sorted(r["qname"] for r in files.alignment_records(spark, str(tmp_path)).collect()) == sorted(f"r{k}" for k in keys)


def test_debug_files_are_written_by_tasks_and_streamed(spark, tmp_path, monkeypatch):
    import gzip
    import tracemalloc

    from pyspark.sql import DataFrame

    r = {"read_id": 7, "mate": 0, "read_len": 100, "flag": 0, "ref_id": 1, "pos": 50, "score": -3, "mapq": 30, "ed": 1, "subs": 100, "ins": 0, "dels": 0, "n_mm": 1, "n_gapo": 0, "n_gape": 0, "has_second": True, "sec_score": -9}

    def gathered(self, *a, **k):
        raise AssertionError("files go by way of the driver")

    monkeypatch.setattr(DataFrame, "toLocalIterator", gathered)
    kinds = ", ".join(f"{k} {'long' if k == 'read_id' else 'boolean' if k == 'has_second' else 'int'}" for k in r)
    df = spark.createDataFrame([tuple({**r, "read_id": i, "mate": i % 2}.values()) for i in range(100)], kinds).repartition(3)
    assert writers.write_debug(df, str(tmp_path / "d")) == 100
    monkeypatch.undo()
    assert sorted(x["read_id"] for x in readers.read_debug(spark, [str(tmp_path / "d/mate=1"), str(tmp_path / "d/mate=2")]).collect()) == list(range(100))
    content = b"".join(gzip.compress(writers.debug_record(r) * 1000) for _ in range(200))
    tracemalloc.start()
    assert sum(1 for _ in readers.decode_debug(content)) == 200_000  # 10 MB
    assert tracemalloc.get_traced_memory()[1] < 8_000_000
    tracemalloc.stop()


def test_packed_files():
    for seq in ("", "A", "ACGT", "ACGTTGCATT"):
        assert readers.decode_pac(readers.encode_pac(seq)) == seq
    assert readers.decode_bwt(readers.encode_bwt(4, [1, 2, 3, 6], "ANNGAA".replace("N", "C"))) == (4, [1, 2, 3, 6], "ACCGAA")
    raw = readers.encode_sa(4, [1, 2, 3, 6], 2, 6, [6, 3, 0, 2])
    assert readers.decode_sa(raw, 4, 6)[1].tolist() == [6, 3, 0, 2]
    with pytest.raises(ValueError):
        readers.decode_sa(raw, 5, 6)


def test_html_report(spark):
    assert "<td>&lt;x&gt;</td>" in writers.html_table(spark.createDataFrame([("<x>",)], "a string"), "t")

"""Explicit schemas of the file formats and tables; nothing is inferred."""

READS = "read_id long, name string, seq string, qual array<int>, read_len int"
CONTIGS = "ref_id int, name string, anno string, offset long, len int, n_ambs int, gi int"
AMBS = "offset long, len int, amb string"
RECORD = (
    "qname string, flag int, rname string, pos int, mapq int, cigar string, rnext string, pnext int, tlen int, seq string, qual string, tags map<string,string>"
)
ALIGNMENT = (
    "read_id long, mate int, read_len int, flag int, ref_id int, pos int, score int, mapq int, ed int, subs int, ins int, dels int, n_mm int, n_gapo int, n_gape int, "
    "has_second boolean, sec_score int"
)
INDEX_META = "ref_id long, length int, primary int, l2 array<int>"
SEED_HIT = "read_id long, sa_begin int, sa_end int, pos_in_read int, rc int, index_dir int"

"""Text indexes as tables: suffix array, Burrows-Wheeler transform, ranks, samples, tries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def suffixes(texts: DataFrame, key: str = "ref_id", seq: str = "seq") -> DataFrame:
    """(key, pos, len, prev): a row for each suffix with the empty one; prev is the symbol before it ('$' at the start)."""
    rows = texts.select(key, seq, F.length(seq).alias("len"), F.explode(F.sequence(F.lit(0), F.length(seq))).alias("pos"))
    return rows.withColumn("prev", F.when(F.col("pos") == 0, "$").otherwise(F.substring(seq, F.col("pos"), 1)))


def suffix_array(texts: DataFrame, key: str = "ref_id", seq: str = "seq") -> DataFrame:
    """(key, row, pos) by sorting the suffixes themselves: for texts of a few thousand symbols; see suffix_array_doubling."""
    rows = suffixes(texts, key, seq).withColumn("_s", F.substring(seq, F.col("pos") + 1, F.lit(1 << 30)))
    order = Window.partitionBy(key).orderBy("_s")
    return rows.select(key, (F.row_number().over(order) - 1).alias("row"), "pos")


def suffix_array_doubling(texts: DataFrame, key: str = "ref_id", seq: str = "seq", first: int = 16, keep=lambda df: df) -> DataFrame:
    """(key, row, pos) by prefix doubling: ranks of 2n symbols come from two ranks of n, a join and a window a round.

    Rows hold numbers, not suffixes, so a text of n symbols costs n log n small rows.  ``keep`` is called on each
    round's ranks (write and read back on long inputs); rounds end when all ranks differ.
    """
    rows = texts.select(key, seq, F.explode(F.sequence(F.lit(0), F.length(seq))).alias("pos"))
    ranked = rows.select(key, "pos", F.dense_rank().over(Window.partitionBy(key).orderBy(F.substring(seq, F.col("pos") + 1, F.lit(first)))).alias("rank"))
    size = first
    while True:
        ranked = keep(ranked)
        if ranked.groupBy(key, "rank").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
            return ranked.select(key, (F.col("rank") - 1).alias("row"), "pos")
        later = ranked.select(key, (F.col("pos") - size).alias("pos"), F.col("rank").alias("next"))
        both = ranked.join(later, [key, "pos"], "left").withColumn("next", F.coalesce("next", F.lit(0)))
        ranked = both.select(key, "pos", F.dense_rank().over(Window.partitionBy(key).orderBy("rank", "next")).alias("rank"))
        size *= 2


def bwt(texts: DataFrame, sa: DataFrame, key: str = "ref_id", seq: str = "seq") -> DataFrame:
    """(key, row, pos, ch): the symbol before each suffix; '$' marks the primary row."""
    met = sa.join(texts.select(key, seq), key)
    return met.select(key, "row", "pos", F.when(F.col("pos") == 0, "$").otherwise(F.substring(seq, F.col("pos"), 1)).alias("ch"))


def bwt_string(rows: DataFrame, key: str = "ref_id") -> DataFrame:
    """(key, bwt, primary): the transform without its sentinel."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("row", "ch"))), lambda r: r["ch"])
    return rows.groupBy(key).agg(F.replace(F.array_join(ordered, ""), F.lit("$"), F.lit("")).alias("bwt"), F.max(F.when(F.col("ch") == "$", F.col("row"))).alias("primary"))


def l2_counts(texts: DataFrame, key: str = "ref_id", seq: str = "seq") -> DataFrame:
    """(key, length, l2): l2[c] counts the symbols below c, five entries for A, C, G, T and the end."""
    n = [F.length(seq) - F.length(F.replace(F.col(seq), F.lit(c), F.lit(""))) for c in "ACGT"]
    sums = [F.lit(0), n[0], n[0] + n[1], n[0] + n[1] + n[2], n[0] + n[1] + n[2] + n[3]]
    return texts.select(key, F.length(seq).alias("length"), F.array(*sums).alias("l2"))


def rank_table(rows: DataFrame, key: str = "ref_id") -> DataFrame:
    """(key, row, pos, ch, occ_a, occ_c, occ_g, occ_t): inclusive running counts, all four at once."""
    upto = Window.partitionBy(key).orderBy("row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.select("*", *(F.sum(F.when(F.col("ch") == c, 1).otherwise(0)).over(upto).alias(f"occ_{c.lower()}") for c in "ACGT"))


def occurrence_samples(ranks: DataFrame, interval: int = 64) -> DataFrame:
    """The rank table's rows at the end of each block of ``interval`` rows."""
    return ranks.where(F.pmod("row", F.lit(interval)) == interval - 1)


def ssa_by_value(sa: DataFrame, interval: int = 32) -> DataFrame:
    return sa.where(F.pmod("pos", F.lit(interval)) == 0)


def ssa_by_row(sa: DataFrame, interval: int = 32) -> DataFrame:
    return sa.where(F.pmod("row", F.lit(interval)) == 0)


def inverse_psi(rows: DataFrame, key: str = "ref_id") -> DataFrame:
    """(key, row, lf): the row of the suffix one symbol longer.  Rows of one symbol keep their order, sentinel first."""
    first = F.row_number().over(Window.partitionBy(key).orderBy(F.when(F.col("ch") == "$", "").otherwise(F.col("ch")), "row")) - 1
    return rows.select(key, "row", "ch", first.alias("lf"))


def base_counts(texts: DataFrame, seq: str = "seq") -> DataFrame:
    return texts.agg(F.count("*").alias("n_seqs"), F.coalesce(F.sum(F.length(seq)), F.lit(0)).alias("n_bases"))


def unknown_runs(texts: DataFrame, key: str = "ref_id", seq: str = "seq", offset: str | None = None) -> DataFrame:
    """(key, offset, len, amb): runs of one symbol other than A, C, G, T, in order, found by one regular expression a text."""
    runs = texts.select(key, F.posexplode(F.regexp_extract_all(seq, F.lit(r"([ACGT]+|([^ACGT])\2*)"), F.lit(1))).alias("_i", "_run"), *( [F.col(offset).alias("_base")] if offset else [F.lit(0).alias("_base")]))
    at = Window.partitionBy(key).orderBy("_i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = runs.withColumn("_at", F.sum(F.length("_run")).over(at) - F.length("_run"))
    return placed.where(F.col("_run").rlike("^[^ACGT]")).select(key, (F.col("_base") + F.col("_at")).cast("long").alias("offset"), F.length("_run").alias("len"), F.substring("_run", 1, 1).alias("amb"))


def fill_unknown(texts: DataFrame, key: str = "ref_id", seq: str = "seq", seed: int = 11) -> DataFrame:
    """Every symbol that isn't a base becomes one chosen by a digest of its place: the same on every run."""
    digit = lambda i: F.instr(F.lit("0123456789abcdef"), F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"), i.cast("string"))), 1, 1)) - 1
    pick = lambda i: F.substring(F.lit("ACGT"), F.pmod(digit(i), F.lit(4)) + 1, F.lit(1))
    filled = F.array_join(F.transform(F.filter(F.split(seq, ""), lambda c: c != ""), lambda c, i: F.when(c.isin("A", "C", "G", "T"), c).otherwise(pick(i))), "")
    return texts.withColumn(seq, F.when(F.col(seq).rlike("[^ACGT]"), filled).otherwise(F.col(seq)))


def annotations(texts: DataFrame, offsets: DataFrame, unknown: DataFrame, key: str = "ref_id") -> DataFrame:
    """(key, name, offset, len, n_ambs) of each sequence."""
    holes = unknown.groupBy(key).agg(F.count("*").alias("n_ambs"))
    return offsets.join(holes, key, "left").select(key, "name", "offset", "len", F.coalesce("n_ambs", F.lit(0)).alias("n_ambs"))


def trie_nodes(strings: DataFrame, column: str, depth: int | None = None) -> DataFrame:
    """(prefix, level, n, n_leaf): a node for each distinct prefix, with the strings below it and those that end there."""
    most = F.length(column) if depth is None else F.least(F.length(column), F.lit(depth))
    rows = strings.select(F.col(column).alias("_s"), F.explode(F.sequence(F.lit(0), most)).alias("level"))
    rows = rows.select(F.substring("_s", F.lit(1), F.col("level")).alias("prefix"), "level", (F.length("_s") == F.col("level")).cast("int").alias("_end"))
    return rows.groupBy("prefix", "level").agg(F.count("*").alias("n"), F.sum("_end").alias("n_leaf"))


def trie_children(nodes: DataFrame) -> DataFrame:
    """(parent, child, symbol, n) edges of a node table."""
    inner = nodes.where("level > 0")
    return inner.select(F.substring("prefix", F.lit(1), F.col("level") - 1).alias("parent"), F.col("prefix").alias("child"), F.substring("prefix", -1, 1).alias("symbol"), "n")


def dictionary_ranges(strings: DataFrame, column: str, level: Column | int) -> DataFrame:
    """(prefix, begin, end): the half-open rows of a sorted dictionary below each node of one level."""
    sized = strings.select(F.col(column).alias("_s")).groupBy(F.substring("_s", F.lit(1), F.lit(level)).alias("prefix")).agg(F.count("*").alias("n"))
    upto = Window.orderBy("prefix").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # one row a node of the level
    return sized.select("prefix", (F.sum("n").over(upto) - F.col("n")).alias("begin"), F.sum("n").over(upto).alias("end"))

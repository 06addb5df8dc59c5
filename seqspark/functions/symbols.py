"""Symbol, string, quality and integer functions as Column expressions (all inside whole-stage codegen or built-ins)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Any text as DNA: letter number modulo 4.
AS_DNA = "".join("ACGT"[i % 4] for i in range(26))


def dna(text: Column) -> Column:
    """A DNA string from any text: its ASCII letters, mapped to A, C, G, T."""
    return F.translate(F.upper(F.regexp_replace(text, "[^A-Za-z]", "")), ALPHABET, AS_DNA)


# --- codes --------------------------------------------------------------------------------------------------------


def char_to_code(c: Column) -> Column:
    """A, C, G, T (upper case only) to 0..3, anything else to 4; null stays null."""
    return F.when(c.isNotNull(), F.coalesce(F.nullif(F.instr(F.lit("ACGT"), F.nullif(c, F.lit(""))), F.lit(0)) - 1, F.lit(4)))


def code_to_char(code: Column) -> Column:
    return F.when(code.isNotNull(), F.coalesce(F.nullif(F.substring(F.lit("ACGT"), code + 1, 1), F.lit("")), F.lit("N")))


def encode(seq: Column) -> Column:
    """The codes of a whole string as a digit string: one translate, no array."""
    return F.translate(F.regexp_replace(seq, "[^ACGT]", "N"), "ACGTN", "01234")


def decode(digits: Column) -> Column:
    return F.translate(F.regexp_replace(digits, "[^0-3]", "4"), "01234", "ACGTN")


def encode_io(seq: Column) -> Column:
    """Reader codes: case-insensitive, '-' to 5, anything else that isn't a base to 4."""
    return F.translate(F.regexp_replace(F.translate(seq, "acgt", "ACGT"), "[^ACGT-]", "N"), "ACGTN-", "012345")


def reverse(seq: Column) -> Column:
    return F.reverse(seq)


def complement(seq: Column) -> Column:
    """Case is kept, symbols outside the alphabet stay."""
    return F.translate(seq, "ACGTacgt", "TGCAtgca")


def complement_code(code: Column, alphabet: int = 4) -> Column:
    return F.when(code >= alphabet, code).otherwise(F.lit(alphabet - 1) - code)


def reverse_complement(seq: Column) -> Column:
    return F.reverse(complement(seq))


def window(seq: Column, begin: Column, size: Column) -> Column:
    """0-based substring, clipped to the string (offset views, genome windows)."""
    start = F.greatest(begin, F.lit(0))
    return F.substring(seq, start + 1, F.greatest(begin + size - start, F.lit(0)))


def strand_view(seq: Column, rc: Column) -> Column:
    return F.when(rc, reverse_complement(seq)).otherwise(seq)


def strand_quality(qual: Column, rc: Column) -> Column:
    return F.when(rc, F.reverse(qual)).otherwise(qual)


def count_symbol(seq: Column, symbol: str, most: int | None = None) -> Column:
    n = F.length(seq) - F.length(F.replace(seq, F.lit(symbol), F.lit("")))
    return n if most is None else F.least(n, F.lit(most))


def symbol_counts(seq: Column, symbols: str = "ACGT") -> Column:
    return F.struct(*(count_symbol(seq, s).alias(s) for s in symbols))


def pack2(seq: Column) -> Column:
    """Up to 31 bases as a long, two bits each, first base highest; null if a symbol isn't a base.

    Through a base-4 number: the conversion is one built-in call."""
    clean = F.when((F.length(seq) <= 31) & (F.length(seq) > 0) & ~seq.rlike("[^ACGT]"), F.translate(seq, "ACGT", "0123"))
    return F.conv(clean, 4, 10).cast("long")


def unpack2(packed: Column, size: int) -> Column:
    return F.translate(F.lpad(F.conv(packed.cast("string"), 10, 4), size, "0"), "0123", "ACGT")


def popcount(x: Column) -> Column:
    return F.bit_count(x)


def nth_set_bit(x: Column, n: int, bits: int = 32) -> Column:
    """Place of the n-th (from 1) set bit, lowest first; null if there are fewer."""
    places = F.filter(F.sequence(F.lit(0), F.lit(bits - 1)), lambda i: F.getbit(x.cast("long"), i) == 1)
    return F.get(places, F.lit(n - 1))


def count_2bit(x: Column, symbol: int, symbols: int = 16) -> Column:
    """How many of the lowest ``symbols`` two-bit fields of x equal ``symbol``: bit tricks, no loop."""
    low = sum(1 << (2 * i) for i in range(symbols))
    same = x.cast("long").bitwiseXOR(F.lit((3 - symbol) * low))  # a field is 3 where it equals the symbol
    return F.bit_count(same.bitwiseAND(F.shiftright(same, 1)).bitwiseAND(F.lit(low)))


# --- qualities ----------------------------------------------------------------------------------------------------


def solexa_to_phred(q: Column) -> Column:
    """Phred value of a raw Solexa byte, whose zero stands for -10: the log-odds turned into an error probability."""
    return F.floor(F.lit(10.0) * F.log10(F.lit(1.0) + F.pow(F.lit(10.0), (q - 10).cast("double") / 10)) + 0.5).cast("int")


def quality(raw: Column, encoding: str = "phred33") -> Column:
    """A quality string as an array of Phred values."""
    value = {"phred": lambda b: b, "phred33": lambda b: b - 33, "phred64": lambda b: b - 64, "solexa": solexa_to_phred}[encoding]
    return F.transform(F.filter(F.split(raw, ""), lambda c: c != ""), lambda c: value(F.ascii(c)).cast("int"))


def phred_to_maq(q: Column) -> Column:
    return F.when(q < 5, 0).when(q < 15, 10).when(q < 25, 20).otherwise(30)


# --- integers -----------------------------------------------------------------------------------------------------

_32, _64 = 0xFFFFFFFF, 64


def _u32(x: Column) -> Column:
    return x.bitwiseAND(F.lit(_32).cast("long"))


def hash32(a: Column) -> Column:
    """Six-step 32-bit integer hash (unsigned, as a long)."""
    # fixed values
    a = _u32(_u32(a + F.lit(0x7ED55D16)) + F.shiftleft(a, 12))
    a = _u32(a.bitwiseXOR(F.lit(0xC761C23C)).bitwiseXOR(F.shiftright(a, 19)))
    a = _u32(a + F.lit(0x165667B1) + F.shiftleft(a, 5))
    a = _u32(_u32(a + F.lit(0xD3A2646C)).bitwiseXOR(F.shiftleft(a, 9)))
    a = _u32(a + F.lit(0xFD7046C5) + F.shiftleft(a, 3))
    return _u32(a.bitwiseXOR(F.lit(0xB55A4F09)).bitwiseXOR(F.shiftright(a, 16)))


def hash32_mix(a: Column) -> Column:
    """32-bit shift-add mix (unsigned, as a long)."""
    # fixed values
    a = _u32(a + F.bitwise_not(F.shiftleft(a, 15)))
    a = a.bitwiseXOR(F.shiftright(a, 10))
    a = _u32(a + F.shiftleft(a, 3))
    a = a.bitwiseXOR(F.shiftright(a, 6))
    a = _u32(a + F.bitwise_not(F.shiftleft(a, 11)))
    return a.bitwiseXOR(F.shiftright(a, 16))


def add64(a: Column, b: Column) -> Column:
    """Wrapping 64-bit addition by halves (plain + fails on overflow in ANSI mode)."""
    mask = F.lit(_32)
    low = a.bitwiseAND(mask) + b.bitwiseAND(mask)
    high = F.shiftrightunsigned(a, 32) + F.shiftrightunsigned(b, 32) + F.shiftrightunsigned(low, 32)
    return F.shiftleft(high, 32).bitwiseOR(low.bitwiseAND(mask))


def hash64_mix(df: DataFrame, key: str, out: str) -> DataFrame:
    """``df`` with ``out``: the 64-bit shift-add mix of a long column.  A projection for each pair of steps, as each names its input often."""
    # fixed values
    for i, (up, down) in enumerate(((32, 22), (13, 8), (3, 15), (27, 31))):
        a = F.col(key if i == 0 else out)
        shifted = F.shiftleft(a, up)
        df = df.withColumn(out, add64(a, shifted if up == 3 else F.bitwise_not(shifted)))
        df = df.withColumn(out, F.col(out).bitwiseXOR(F.shiftrightunsigned(out, down)))
    return df


def hash64_fold(key: Column) -> Column:
    return F.shiftrightunsigned(key, 32).bitwiseXOR(key)


def hash64_elf(key: Column) -> Column:
    """28-bit hash of the eight bytes of a long, lowest first: shift by four, add, fold the top four bits of 32 back."""

    def step(h: Column, i: Column) -> Column:
        byte = F.call_function("shiftrightunsigned", key, i * 8).bitwiseAND(F.lit(255))
        h = _u32(F.shiftleft(h, 4) + byte)
        return h.bitwiseXOR(F.shiftright(h.bitwiseAND(F.lit(0xF0000000)), 24)).bitwiseAND(F.lit(0x0FFFFFFF))

    return F.aggregate(F.sequence(F.lit(0), F.lit(7)), F.lit(0).cast("long"), step)


def lcg(state: Column) -> Column:
    """One step of the linear congruential generator, as a long below 2**32."""
    return _u32(F.pmod(state * F.lit(1664525) + F.lit(1013904223), F.lit(1 << 32)))


def log2_int(x: Column) -> Column:
    """floor(log2 x) without rounding trouble: the length of the binary form."""
    return F.when(x > 0, F.length(F.bin(x)) - 1)


def divide_up(x: Column, y: Column) -> Column:
    return F.floor((x + y - 1) / y)


def round_up(x: Column, y: int) -> Column:
    return F.pmod(-x, F.lit(y)) + x


def round_down(x: Column, y: int) -> Column:
    return x - F.pmod(x, F.lit(y))


def high_bits(x: Column, n: int = 16) -> Column:
    return F.shiftrightunsigned(x, n)


def log_bin(x: Column) -> Column:
    """0 for 0, otherwise the sign times 1 + floor(log2 |x|)."""
    return F.when(x == 0, 0).otherwise(F.signum(x).cast("int") * (1 + log2_int(F.abs(x))))


#: fixed values: upper bounds of read length classes
READ_LENGTHS = (16, 36, 100, 150, 200, 250, 300, 350, 400, 450, 500)


def read_length_bin(n: Column) -> Column:
    out = F.lit(len(READ_LENGTHS))
    for i, bound in reversed(list(enumerate(READ_LENGTHS))):
        out = F.when(n <= bound, F.lit(i)).otherwise(out)
    return out

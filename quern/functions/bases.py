"""Bases, complements and canonical k-mers as Column expressions.

Sequences are strings; only A, C, G and T in either case are bases.  A canonical k-mer is the
smaller of a word and its reverse complement as strings, which for equal lengths is the order of
their codes (A=0, C=1, G=2, T=3, most significant first), for every k up to 32.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_K = 32


def check_k(k: int) -> int:
    """k itself if a k-mer of that size has a code."""
    if not isinstance(k, int) or isinstance(k, bool) or not 1 <= k <= MAX_K:
        raise ValueError(f"k must be between 1 and {MAX_K}: {k!r}")
    return k


def normal(seq: Column) -> Column:
    """Bases in capitals; other characters, and so all positions, stay."""
    return F.translate(seq, "acgt", "ACGT")


def byte_wise(text: Column) -> Column:
    """A text with one character for each byte of its UTF-8 form."""
    return F.decode(F.encode(text, "UTF-8"), "ISO-8859-1")


def encode_base(base: Column) -> Column:
    """0 to 3 for a base in either case, else null."""
    return F.when(F.length(base) == 1, F.nullif(F.instr(F.lit("ACGT"), normal(base)), F.lit(0)) - 1)


def decode_base(code: Column) -> Column:
    """The base of a code's two lowest bits."""
    return F.substring(F.lit("ACGT"), F.bitwise_not(F.bitwise_not(code)).bitwiseAND(F.lit(3)).cast("int") + 1, F.lit(1))


def complement_bits(code: Column) -> Column:
    """3 minus the code's two lowest bits."""
    return F.lit(3) - code.bitwiseAND(F.lit(3))


def complement(seq: Column) -> Column:
    """Complementary bases; N for every other character."""
    return F.regexp_replace(F.translate(normal(seq), "ACGT", "TGCA"), "[^ACGT]", "N")


def reverse_complement(seq: Column) -> Column:
    return F.reverse(complement(seq))


def _flip(word: Column) -> Column:
    return F.reverse(F.translate(word, "ACGT", "TGCA"))


def is_kmer(word: Column) -> Column:
    """Whether a word in capitals has bases only."""
    return (F.length(word) > 0) & ~word.rlike("[^ACGT]")


def canonical(word: Column) -> Column:
    """The smaller of a word of bases and its reverse complement."""
    return F.least(word, _flip(word))


def strand(word: Column) -> Column:
    """0 if a word is canonical itself, else 1."""
    return (_flip(word) < word).cast("int")


def kmer_code(word: Column) -> Column:
    """The code of a word of up to 32 bases as DECIMAL(20,0); null for other words."""
    return F.when(is_kmer(word) & (F.length(word) <= MAX_K), F.conv(F.translate(word, "ACGT", "0123"), 4, 10).cast("decimal(20,0)"))


def reverse_complement_code(word: Column) -> Column:
    return kmer_code(F.when(is_kmer(word), _flip(word)))


def frequency_class(cf: Column, thresholds: tuple[int, int, int]) -> Column:
    """0 rare, 1 medium, 2 hot, 3 very hot: bounds are inclusive upper bounds."""
    rare, medium, hot = thresholds
    return F.when(cf <= rare, 0).when(cf <= medium, 1).when(cf <= hot, 2).otherwise(3)


CLASS_LABELS = ("rare", "medium", "hot", "very_hot")


def class_label(cls: Column) -> Column:
    return F.element_at(F.array(*(F.lit(x) for x in CLASS_LABELS)), cls + 1)


def strand_label(s: Column) -> Column:
    return F.when(s == 0, "forward").otherwise("reverse")


def varint_length(value: Column) -> Column:
    """Bytes of an unsigned number at seven bits to a byte."""
    size = F.lit(1)
    for bits in range(7, 63, 7):
        size = size + (value >= F.lit(1 << bits)).cast("int")
    return size


def information(documents: Column, df: Column, k: Column) -> Column:
    """ln((N+1)/(df+1)) times max(1, k/15)."""
    return F.log((documents + F.lit(1.0)) / (df + F.lit(1.0))) * F.greatest(F.lit(1.0), k / F.lit(15.0))


def conservative_stop(best: Column, runner_up: Column, remaining: Column) -> Column:
    """Whether no candidate can overtake the best any more."""
    return best > runner_up + remaining

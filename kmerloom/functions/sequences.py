"""Column expressions over sequences and packed words (2 bits a letter, first letter highest)."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

DNA = "ACGT"
PAIR_MASK = 0x5555555555555555


def check_alphabet(alphabet: str) -> str:
    if not 2 <= len(alphabet) <= 4 or len(set(alphabet)) != len(alphabet):
        raise ValueError("an alphabet has 2 to 4 distinct letters")
    return alphabet


def clean(seq: Column, alphabet: str = DNA) -> Column:
    """Upper-case letters of the alphabet alone; what stood on both sides of a dropped letter is joined."""
    letters = re.escape(check_alphabet(alphabet).upper() + alphabet.lower())
    return F.upper(F.regexp_replace(seq, f"[^{letters}]+", ""))


def reverse_complement(seq: Column, alphabet: str = DNA) -> Column:
    """Letter i becomes letter b-1-i, back to front."""
    return F.reverse(F.translate(seq, alphabet, alphabet[::-1]))


def digits(seq: Column, alphabet: str = DNA) -> Column:
    return F.translate(seq, alphabet, "0123"[: len(alphabet)])


def pack(word: Column, alphabet: str = DNA) -> Column:
    """The word as a number; at most 31 letters."""
    return F.conv(digits(word, alphabet), 4, 10).cast("bigint")


def unpack(code: Column, length: int, alphabet: str = DNA) -> Column:
    return F.translate(F.lpad(F.conv(code.cast("string"), 10, 4), length, "0"), "0123"[: len(alphabet)], alphabet)


def nth_word(n: Column, b: int = 4) -> Column:
    """The packed form of the n-th word of an alphabet of b letters, in order."""
    return F.conv(F.conv(n.cast("string"), 10, b), 4, 10).cast("bigint")


def reverse_complement_code(code: Column, length: int, alphabet: str = DNA) -> Column:
    return pack(reverse_complement(unpack(code, length, alphabet), alphabet), alphabet)


def hamming(a: Column, b: Column) -> Column:
    """Letters that differ between two packed words of one length."""
    x = a.bitwiseXOR(b)
    return F.bit_count(x.bitwiseOR(F.shiftright(x, 1)).bitwiseAND(F.lit(PAIR_MASK)))


def subsequence(seq: Column, start: int, length: int) -> Column:
    """Letters start..start+length-1 (0-based), cut at the ends."""
    lo = max(start, 0)
    return F.substring(seq, lo + 1, max(start + length - lo, 0))


def mutate(seq: Column, position: Column, letter: Column) -> Column:
    """The sequence with the letter at a 0-based position replaced; unchanged where it has no such position."""
    inside = (position >= 0) & (position < F.length(seq))
    return F.when(inside, F.overlay(seq, letter, position + 1, F.lit(1))).otherwise(seq)


def dinucleotides(seq: Column, alphabet: str = DNA) -> Column:
    """For each pair of neighbours, index of the first + b * index of the second."""
    b = len(alphabet)
    pairs = F.regexp_extract_all(digits(seq, alphabet), F.lit("(?=(..))"), F.lit(1))
    return F.transform(pairs, lambda p: F.substring(p, 1, 1).cast("int") + b * F.substring(p, 2, 1).cast("int"))


def gc_content(seq: Column) -> Column:
    """G and C over all letters, of whatever kind; null for an empty sequence."""
    s = F.upper(seq)
    return F.when(F.length(seq) > 0, F.length(F.regexp_replace(s, "[^GC]", "")) / F.length(seq))


def pattern_hits(seq: Column, pattern: str) -> Column:
    """Places, overlaps too, where a word with '.' for any letter stands."""
    if not re.fullmatch(r"[A-Za-z.]+", pattern):
        raise ValueError("a pattern has letters and dots")
    return F.regexp_count(F.upper(seq), F.lit(f"(?={pattern.upper()})"))


def common_words(a: Column, b: Column, size: int = 4) -> Column:
    """Full words that match both gapped words: 0, or size^(places where both are '.')."""
    x, y = F.split(a, ""), F.split(b, "")
    pairs = F.zip_with(x, y, lambda p, q: F.when((p == ".") & (q == "."), size).when((p == ".") | (q == ".") | (p == q), 1).otherwise(0))
    return F.aggregate(pairs, F.lit(1).cast("bigint"), lambda s, v: s * v)


def background_log_odds(pattern: Column) -> Column:
    """Log odds of a pattern when A and T are 1.25 times as frequent, and C and G that much less: +log 1.25 or -log 1.25 a letter."""
    at = F.length(F.regexp_replace(pattern, "[^ATat]", ""))
    gc = F.length(F.regexp_replace(pattern, "[^CGcg]", ""))
    return (at - gc) * F.log(F.lit(1.25))

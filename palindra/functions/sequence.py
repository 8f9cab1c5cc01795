"""Column functions over DNA strings. A base other than A, C, G, T is special and matches nothing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BASES = "ACGT"


def normalised(seq: Column) -> Column:
    """Upper case, every special base an N."""
    return F.regexp_replace(F.upper(seq), "[^ACGT]", "N")


def complement(seq: Column) -> Column:
    return F.translate(seq, "ACGT", "TGCA")


def reverse_complement(seq: Column) -> Column:
    return F.reverse(complement(seq))


def base_code(base: Column) -> Column:
    """0 .. 3 for A, C, G, T in either case, null for a special base."""
    at = F.instr(F.lit(BASES), F.upper(base))
    return F.when((F.length(base) == 1) & (at > 0), at - 1)


def base_at(seq: Column, position: Column) -> Column:
    """The base at a position from 0, N for a special one, "" outside."""
    return F.when(position >= 0, F.substr(normalised(seq), (position + 1).cast("int"), F.lit(1))).otherwise(F.lit(""))


def count_bases(seq: Column) -> Column:
    """Positions that hold A, C, G or T."""
    return F.length(F.regexp_replace(F.upper(seq), "[^ACGT]", ""))


def common_prefix(left: Column, right: Column) -> Column:
    """Length of the longest common prefix of two strings, up to the first special base."""
    a, b = F.translate(normalised(left), "N", "["), F.translate(normalised(right), "N", "]")

    def longest(x: Column) -> Column:
        # a bit of the length at a time, from the highest down: what is known to be equal is not compared again
        most = F.least(F.length(x["a"]), F.length(x["b"]))
        bits = F.sequence(F.length(F.bin(most)) - 1, F.lit(0), F.lit(-1))
        step = lambda k: F.call_function("shiftleft", F.lit(1), k)
        more = lambda n, k: (n + step(k) <= most) & (F.substr(x["a"], n + 1, step(k)) == F.substr(x["b"], n + 1, step(k)))
        return F.aggregate(bits, F.lit(0), lambda n, k: F.when(more(n, k), n + step(k)).otherwise(n))

    # within a lambda the strings are made once
    found = F.transform(F.array(F.struct(a.alias("a"), b.alias("b"))), longest)[0]
    return F.when(left.isNotNull() & right.isNotNull(), found)


def similarity(left: Column, right: Column) -> Column:
    """100 * (1 - edit distance / longer length); special bases equal each other."""
    longer = F.greatest(F.length(left), F.length(right))
    return F.lit(100.0) * (F.lit(1.0) - F.levenshtein(left, right) / longer)


def two_decimals(value: Column) -> Column:
    """Two decimals, the exact binary value rounded half to even."""
    return F.format_string("%.2f", F.bround(value, 2))

"""Phred qualities, as text (code point minus 33) or arrays of integers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MOST, OFFSET, SOLEXA_OFFSET = 93, 33, 64


def half_up(x: Column) -> Column:
    """Rounds halves up, also below zero."""
    return F.floor(x + 0.5)


def to_char(q: Column) -> Column:
    """Null outside 0 to 93."""
    return F.when(q.between(0, MOST), F.char(q + OFFSET))


def from_char(c: Column) -> Column:
    return F.ascii(c) - OFFSET


def phreds(quals: Column) -> Column:
    """array<int> of a quality string; ``*`` and the empty string are empty."""
    chars = F.regexp_extract_all(quals, F.lit("(?s)."), F.lit(0))
    return F.when((quals == "*") | (F.length(quals) == 0), F.array().cast("array<int>")).otherwise(F.transform(chars, lambda c: F.ascii(c) - OFFSET))


def text(q: Column) -> Column:
    return F.array_join(F.transform(q, lambda x: F.char(x + OFFSET)), "")


def error_probability(q: Column) -> Column:
    return F.pow(F.lit(10.0), -q / 10.0)


def phred_of(p: Column) -> Column:
    """From an error probability."""
    return half_up(-10.0 * F.log10(p)).cast("int")


def phred_of_counts(errors: Column, observations: Column) -> Column:
    return phred_of(errors / observations)


def expected_errors(q: Column, bases: Column | None = None) -> Column:
    """Sum of error probabilities; a no-call counts 1 if bases are given."""
    if bases is None:
        return F.aggregate(q, F.lit(0.0), lambda acc, x: acc + error_probability(x))
    marked = F.zip_with(q, F.regexp_extract_all(bases, F.lit("(?s)."), F.lit(0)), lambda x, b: F.when(b.isin("N", "n", "."), 1.0).otherwise(error_probability(x)))
    return F.aggregate(marked, F.lit(0.0), lambda acc, x: acc + x)


def sum_at_least(q: Column, least: int = 15) -> Column:
    return F.aggregate(q, F.lit(0), lambda acc, x: acc + F.when(x >= least, x).otherwise(0))


def trim_point(q: Column, threshold: int) -> Column:
    """Bases to keep: from the 3' end, the place where the sum of threshold - quality is largest, until it falls below 0."""
    if threshold < 1:
        return F.lit(0)
    n = F.size(q)
    state = F.struct(F.lit(0).alias("sum"), F.lit(0).alias("best"), n.alias("at"), (n - 1).alias("i"), F.lit(True).alias("open"))

    def step(acc, x):
        total = acc["sum"] + F.lit(threshold) - x
        go = acc["open"] & (total >= 0)
        better = go & (total > acc["best"])
        return F.struct(total.alias("sum"), F.when(better, total).otherwise(acc["best"]).alias("best"), F.when(better, acc["i"]).otherwise(acc["at"]).alias("at"), (acc["i"] - 1).alias("i"), go.alias("open"))

    return F.when(n == 0, 0).otherwise(F.aggregate(F.reverse(q), state, step)["at"])


def solexa_to_phred(q: Column) -> Column:
    return half_up(10.0 * F.log10(1.0 + F.pow(F.lit(10.0), q / 10.0))).cast("int")


def solexa13_to_phred(c: Column) -> Column:
    return F.ascii(c) - SOLEXA_OFFSET

"""String, date and formatting helpers."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf


def split_excess(text: Column, delimiter: str, most: int) -> Column:
    """At most so many tokens; the last one holds the rest."""
    return F.split(text, _literal(delimiter), most)


def split_first(text: Column, delimiter: str, most: int) -> Column:
    """The first so many tokens; the rest is dropped."""
    return F.slice(F.split(text, _literal(delimiter)), 1, most)


def _literal(delimiter: str) -> str:
    return "\\Q" + delimiter + "\\E"


def split_whitespace(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda x: x != "")


def upper_ascii(text: Column) -> Column:
    return F.translate(text, "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def word_wrap(text: Column, width: int) -> Column:
    """Breaks a line feed into every run of so many characters."""
    return F.rtrim(F.regexp_replace(text, f"([^\\n]{{{width}}})(?!\\n|$)", "$1\n"))


def is_blank(text: Column) -> Column:
    return text.rlike(r"^\s*$")


def hamming(a: Column, b: Column) -> Column:
    """Places that differ; null for unequal lengths."""
    chars = lambda c: F.regexp_extract_all(c, F.lit("(?s)."), F.lit(0))
    differ = F.zip_with(chars(a), chars(b), lambda x, y: F.when(x == y, 0).otherwise(1))
    return F.when(F.length(a) == F.length(b), F.aggregate(differ, F.lit(0), lambda acc, x: acc + x))


def within_hamming(a: Column, b: Column, most: int) -> Column:
    return hamming(a, b) <= most


def levenshtein_of(a: str, b: str, swap: int, substitution: int, insertion: int, deletion: int) -> int:
    """Weighted, with transpositions of neighbours that aren't edited again."""
    before2, before = None, [j * insertion for j in range(len(b) + 1)]
    for i in range(1, len(a) + 1):
        now = [i * deletion] + [0] * len(b)
        for j in range(1, len(b) + 1):
            best = before[j - 1] + (substitution if a[i - 1] != b[j - 1] else 0)
            if before2 is not None and j > 1 and a[i - 2] == b[j - 1] and a[i - 1] == b[j - 2] and a[i - 1] != b[j - 1]:
                best = min(best, before2[j - 2] + swap)
            now[j] = min(best, before[j] + deletion, now[j - 1] + insertion)
        before2, before = before, now
    return before[-1]


def levenshtein(a: Column, b: Column, swap: int = 1, substitution: int = 1, insertion: int = 1, deletion: int = 1) -> Column:
    """The built-in distance if no weights or swaps matter can't do transpositions, so this one is an Arrow UDF."""

    @pandas_udf(T.IntegerType())
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([levenshtein_of(p, q, swap, substitution, insertion, deletion) if p is not None and q is not None else None for p, q in zip(x, y, strict=True)], dtype="Int32")

    return run(a, b)


def natural_key(name: Column, digits: int = 20) -> Column:
    """A sort key in which runs of digits compare as numbers: leading zeros go, and the rest is padded."""
    stripped = F.regexp_replace(name, r"(?<![0-9])0+(?=[0-9])", "")
    padded = F.regexp_replace(stripped, r"([0-9]+)", "0" * digits + "$1")
    return F.regexp_replace(padded, r"0*([0-9]{" + str(digits) + r"})(?![0-9])", "$1")


def human_bytes(n: Column) -> Column:
    size = n.cast("double")
    out = F.format_string("%.2f B", size)
    for power, unit in enumerate(("kB", "MB", "GB", "TB"), 1):
        out = F.when(size >= 1000.0**power, F.format_string(f"%.2f {unit}", size / 1000.0**power)).otherwise(out)
    return out


def metric_text(x: Column) -> Column:
    """At most six fraction digits, halves rounded down; ``?`` for NaN and infinities."""
    scaled = x.cast("decimal(38,12)")
    cut = F.expr("null") if x is None else F.signum(scaled) * F.ceil(F.abs(scaled) * 1000000 - F.lit("0.5").cast("decimal(2,1)")) / 1000000
    plain = F.regexp_replace(F.regexp_replace(cut.cast("decimal(38,6)").cast("string"), r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), "?").otherwise(plain)


def metric_flag(x: Column) -> Column:
    return F.when(x, "Y").otherwise("N")


def iso_time(text: Column) -> Column:
    """ISO 8601 from a year down to fractions of a second with a zone."""
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(p)) for p in ("yyyy-MM-dd'T'HH:mm:ss.SSSXXX", "yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mmXXX", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd", "yyyy-MM", "yyyy")])

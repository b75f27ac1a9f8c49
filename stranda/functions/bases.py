"""Base sequences as strings."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

#: The bases that each IUPAC code stands for, as bits A=1, C=2, G=4, T=8.
IUPAC = {"A": 1, "C": 2, "G": 4, "T": 8, "M": 3, "R": 5, "W": 9, "S": 6, "Y": 10, "K": 12, "V": 7, "H": 11, "D": 13, "B": 14, "N": 15}


def complement(bases: Column) -> Column:
    """Of A, C, G and T in either case; other characters stay."""
    return F.translate(bases, "ACGTacgt", "TGCAtgca")


def reverse_complement(bases: Column) -> Column:
    return F.reverse(complement(bases))


def iupac_bits(base: Column) -> Column:
    """The bit set of a code, in either case; ``.`` counts as N and other characters as 0."""
    letters = F.upper(base)
    pairs = [F.lit(x) for code, bits in [*IUPAC.items(), (".", 15)] for x in (code, bits)]
    return F.coalesce(F.create_map(*pairs)[letters], F.lit(0))


def bases_equal(a: Column, b: Column) -> Column:
    """Whether two codes stand for the same bases."""
    return (iupac_bits(a) == iupac_bits(b)) & (iupac_bits(a) > 0) | (a == b)


def matches_with_ambiguity(read: Column, ref: Column) -> Column:
    """Whether the read's code stands for a subset of the reference's."""
    return iupac_bits(read).bitwiseAND(iupac_bits(ref)) == iupac_bits(read)


def is_no_call(base: Column) -> Column:
    return base.isin("N", "n", ".")


def is_valid(base: Column) -> Column:
    return base.isin(*"ACGTacgt")


def is_iupac(base: Column) -> Column:
    return F.upper(base).isin(*IUPAC, ".")


def only_upper_acgtn(bases: Column) -> Column:
    return bases.rlike("^[ACGTN]*$")


def gc_fraction(bases: Column) -> Column:
    """Share of G and C in either case; 0 for no bases."""
    return F.when(F.length(bases) == 0, 0.0).otherwise(F.length(F.regexp_replace(bases, "[^GCgc]", "")) / F.length(bases))


def to_stored(bases: Column) -> Column:
    """Upper-case codes of the binary alphabet; others become N."""
    return F.regexp_replace(F.translate(bases, "acgtnmrwsykvhdb", "ACGTNMRWSYKVHDB"), "[^=ACMGRSVTWYHKDBN]", "N")


def kmers(bases: Column, k: int) -> Column:
    """All substrings of k bases, in order."""
    n = F.length(bases) - (k - 1)
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(bases, i, F.lit(k)))).otherwise(F.array().cast("array<string>"))


def all_kmers(k: int) -> list[str]:
    """Every sequence of k of the four bases."""
    return reduce(lambda out, _: [x + b for x in out for b in "ACGT"], range(k), [""])


def bisulfite_equal(read: Column, ref: Column, negative: Column) -> Column:
    """Equal, or converted: C read as T on the positive strand, G read as A on the negative."""
    a, b = F.upper(read), F.upper(ref)
    return (a == b) | (~negative & (b == "C") & (a == "T")) | (negative & (b == "G") & (a == "A"))


def md5(bases: Column) -> Column:
    """Of the upper-case bases."""
    return F.md5(F.upper(bases).cast("binary"))


def name_from_header(header: Column) -> Column:
    """A read name from a FASTQ header: up to the first space, without trailing /1 or /2."""
    return F.regexp_replace(F.substring_index(header, " ", 1), r"(?:/[12])+$", "")


def aligned_pairs(bases: str, start: int, cigar: str, reference: str):
    """(operator, read bases, reference bases) of each element, as far as the reference goes."""
    import re

    read, ref = 0, start - 1
    for n, op in re.findall(r"(\d+)([MIDNSHP=X])", cigar or ""):
        n = int(n)
        a = bases[read : read + n] if op in "MIS=X" else ""
        b = reference[ref : ref + n] if op in "MDN=X" else ""
        yield op, a, b
        read += n * (op in "MIS=X")
        ref += n * (op in "MDN=X")


def md_and_nm_of(bases: str, start: int, cigar: str, reference: str) -> tuple[str, int]:
    md, run, nm = [], 0, 0
    for op, a, b in aligned_pairs(bases, start, cigar, reference):
        if op in "M=X":
            for x, y in zip(a, b, strict=False):
                if x == "\0" or x.upper() == y.upper():
                    run += 1
                else:
                    md += [str(run), y]
                    run = 0
                    nm += 1
            if len(b) < len(a):
                break
        elif op == "D":
            md += [str(run), "^" + b]
            run = 0
            nm += len(b)
        elif op == "I":
            nm += len(a)
    return "".join(md) + str(run), nm


@pandas_udf(T.StructType([T.StructField("md", T.StringType()), T.StructField("nm", T.IntegerType())]))
def md_and_nm(bases: pd.Series, start: pd.Series, cigar: pd.Series, reference: pd.Series) -> pd.DataFrame:
    """MD and NM of reads against their contigs' bases; walks the CIGAR, which built-in functions can't do base by base."""
    rows = [md_and_nm_of(*x) for x in zip(bases, start, cigar, reference, strict=True)]
    return pd.DataFrame(rows, columns=["md", "nm"])


def reference_from_md_of(bases: str, cigar: str, md: str) -> str:
    """Reference bases under an alignment; inserted bases are ``-``, skipped ones N."""
    import re

    tokens = re.findall(r"\d+|\^[A-Za-z]+|[A-Za-z]", md)
    aligned = []
    for token in tokens:
        if token.isdigit():
            aligned += [None] * int(token)
        elif token[0] == "^":
            continue
        else:
            aligned.append(token)
    deleted = iter(t[1:] for t in tokens if t[0] == "^")
    out, read, at = [], 0, 0
    for n, op in re.findall(r"(\d+)([MIDNSHP=X])", cigar or ""):
        n = int(n)
        if op in "M=X":
            for k in range(n):
                ref = aligned[at] if at < len(aligned) else None
                out.append(ref or bases[read + k])
                at += 1
        elif op == "I":
            out.append("-" * n)
        elif op == "D":
            out.append(next(deleted, "N" * n))
        elif op == "N":
            out.append("N" * n)
        read += n * (op in "MIS=X")
    return "".join(out)


@pandas_udf(T.StringType())
def reference_from_md(bases: pd.Series, cigar: pd.Series, md: pd.Series) -> pd.Series:
    return pd.Series([reference_from_md_of(*x) for x in zip(bases, cigar, md, strict=True)])


@pandas_udf(T.StructType([T.StructField("mismatches", T.IntegerType()), T.StructField("quality_sum", T.IntegerType())]))
def mismatches(bases: pd.Series, quals: pd.Series, start: pd.Series, cigar: pd.Series, reference: pd.Series) -> pd.DataFrame:
    """Mismatching aligned bases and the sum of their Phred qualities."""
    rows = []
    for b, q, s, c, r in zip(bases, quals, start, cigar, reference, strict=True):
        read, n, total = 0, 0, 0
        for op, x, y in aligned_pairs(b, s, c, r):
            if op in "M=X":
                for k, (u, v) in enumerate(zip(x, y, strict=False)):
                    if u.upper() != v.upper():
                        n += 1
                        total += ord(q[read + k]) - 33 if read + k < len(q) else 0
            read += len(x)
        rows.append((n, total))
    return pd.DataFrame(rows, columns=["mismatches", "quality_sum"])

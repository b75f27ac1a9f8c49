"""Flag bits, pairs and record-level scalars."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from stranda import schema as S
from stranda.functions import cigar as C

#: Bit names in order, with the letter of the string format.
NAMES = [
    (S.PAIRED, "READ_PAIRED", "p"),
    (S.PROPER, "PROPER_PAIR", "P"),
    (S.UNMAPPED, "READ_UNMAPPED", "u"),
    (S.MATE_UNMAPPED, "MATE_UNMAPPED", "U"),
    (S.REVERSE, "READ_REVERSE_STRAND", "r"),
    (S.MATE_REVERSE, "MATE_REVERSE_STRAND", "R"),
    (S.FIRST, "FIRST_OF_PAIR", "1"),
    (S.SECOND, "SECOND_OF_PAIR", "2"),
    (S.SECONDARY, "SECONDARY_ALIGNMENT", "s"),
    (S.QC_FAIL, "READ_FAILS_VENDOR_QUALITY_CHECK", "x"),
    (S.DUPLICATE, "DUPLICATE_READ", "d"),
    (S.SUPPLEMENTARY, "SUPPLEMENTARY_ALIGNMENT", "S"),
]


def has(flag: Column, bit: int) -> Column:
    """Whether any of the bits is set."""
    return flag.bitwiseAND(bit) != 0


def mate_flag(flag: Column, bit: int) -> Column:
    """A mate's bit; null for an unpaired read, where it has no meaning."""
    return F.when(has(flag, S.PAIRED), has(flag, bit))


def names(flag: Column) -> Column:
    found = F.array(*[F.when(has(flag, bit), F.lit(name)) for bit, name, _ in NAMES])
    return F.filter(found, lambda x: x.isNotNull())


def letters(flag: Column) -> Column:
    """The string format: a letter for each bit, ``m`` and ``M`` for a mapped read and mapped mate, ``f``/``F`` for forward strands."""
    parts = [F.when(has(flag, bit), F.lit(letter)).otherwise("") for bit, _, letter in NAMES]
    parts[2] = F.when(has(flag, S.UNMAPPED), "u").otherwise("m")
    parts[3] = F.when(has(flag, S.PAIRED), F.when(has(flag, S.MATE_UNMAPPED), "U").otherwise("M")).otherwise("")
    parts[4] = F.when(has(flag, S.UNMAPPED), "").when(has(flag, S.REVERSE), "r").otherwise("f")
    parts[5] = F.when(has(flag, S.PAIRED) & ~has(flag, S.MATE_UNMAPPED), F.when(has(flag, S.MATE_REVERSE), "R").otherwise("F")).otherwise("")
    return F.concat(*parts)


def parse(text: Column) -> Column:
    """From decimal, hexadecimal (0x) or octal (leading 0) text."""
    return (
        F.when(text.rlike("^0[xX][0-9a-fA-F]+$"), F.conv(F.substring(text, 3, 20), 16, 10))
        .when(text.rlike("^0[0-7]+$"), F.conv(text, 8, 10))
        .when(text.rlike("^[0-9]+$"), text)
        .cast("int")
    )


def pair_orientation(flag: Column, start: Column, end: Column, mate_start: Column, mate_end: Column | None, tlen: Column) -> Column:
    """FR, RF or TANDEM of two mapped ends of one contig; ``mate_end`` (from the mate's CIGAR) is preferred to ``tlen``."""
    negative, mate_negative = has(flag, S.REVERSE), has(flag, S.MATE_REVERSE)
    other = start + tlen - 1 if mate_end is None else F.coalesce(mate_end, start + tlen - 1)
    plus = F.when(negative, mate_start).otherwise(start)
    minus = F.when(negative, end).otherwise(other)
    return F.when(negative == mate_negative, "TANDEM").when(plus <= minus, "FR").otherwise("RF")


def insert_size(start1, end1, negative1, mapped1, ref1, start2, end2, negative2, mapped2, ref2) -> Column:
    """From 5' end to 5' end, signed for the first of the two; 0 if one is unmapped or they lie on different contigs."""
    one = F.when(negative1, end1).otherwise(start1)
    two = F.when(negative2, end2).otherwise(start2)
    size = two - one + F.when(two >= one, 1).otherwise(-1)
    return F.when(mapped1 & mapped2 & (ref1 == ref2), size).otherwise(0)


def mate_end(mate_start: Column, mate_cigar: Column) -> Column:
    """From the mate's CIGAR; null without it."""
    return C.alignment_end(mate_start, C.elements(mate_cigar))


def paired_name(name: Column, flag: Column) -> Column:
    return F.concat(name, F.when(has(flag, S.PAIRED), F.when(has(flag, S.FIRST), "/1").otherwise("/2")).otherwise(""))


def canonical_name(read_group: Column, name: Column) -> Column:
    return F.when(read_group.isNull(), name).otherwise(F.concat(read_group, F.lit(":"), name))


def mapq_rank(mapq: Column) -> Column:
    """An order of mapping qualities in which the unknown 255 comes just after 0."""
    return F.when(mapq == 0, 0.0).when(mapq == 255, 0.5).otherwise(mapq.cast("double"))


def combine_mapqs(a: Column, b: Column) -> Column:
    one = lambda q: F.when(q == 255, 1).otherwise(q * 100)
    return one(a) + one(b)


def murmur3_of(text: str, seed: int) -> int:
    """The public 32-bit Murmur3 over a text's UTF-16 code units, two a block, as a signed integer."""
    data = text.encode("utf-16-le")
    mask, h = 0xFFFFFFFF, seed & 0xFFFFFFFF

    def mix(k: int) -> int:
        k = k * 0xCC9E2D51 & mask
        k = (k << 15 | k >> 17) & mask
        return k * 0x1B873593 & mask

    whole = len(data) // 4 * 4
    for i in range(0, whole, 4):
        h ^= mix(int.from_bytes(data[i : i + 4], "little"))
        h = (h << 13 | h >> 19) & mask
        h = (h * 5 + 0xE6546B64) & mask
    if whole < len(data):
        h ^= mix(int.from_bytes(data[whole:], "little"))
    h ^= len(data)
    h = (h ^ h >> 16) * 0x85EBCA6B & mask
    h = (h ^ h >> 13) * 0xC2B2AE35 & mask
    h ^= h >> 16
    return h - (1 << 32) if h >> 31 else h


def murmur3(text: Column, seed: int = 1) -> Column:
    """Built-in hashes work on UTF-8 and mix the tail differently, so this one is an Arrow UDF."""

    @pandas_udf(T.IntegerType())
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: murmur3_of(x, seed), na_action="ignore").astype("Int32")

    return run(text)


def with_bit(flag: Column, bit: int, on: Column) -> Column:
    return F.when(on, flag.bitwiseOR(bit)).otherwise(flag.bitwiseAND(~bit))

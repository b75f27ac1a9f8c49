"""Coordinate arithmetic on 1-based closed intervals, and hierarchical bins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def length(start: Column, end: Column) -> Column:
    return end - start + 1


def end_of(start: Column, size: Column) -> Column:
    return start + size - 1


def start_of(end: Column, size: Column) -> Column:
    return end - size + 1


def overlaps(start: Column, end: Column, start2: Column, end2: Column) -> Column:
    """Also true for an empty interval strictly inside the second one; not symmetric for empty intervals."""
    return start2.between(start, end) | end2.between(start, end) | encloses(start2, end2, start, end)


def encloses(outer_start: Column, outer_end: Column, inner_start: Column, inner_end: Column) -> Column:
    return (inner_start >= outer_start) & (inner_end <= outer_end)


def overlap_length(start: Column, end: Column, start2: Column, end2: Column) -> Column:
    """Only meaningful for intervals that overlap."""
    return F.least(end, end2) - F.greatest(start, start2) + 1


def intersection_length(contig, start, end, contig2, start2, end2) -> Column:
    """0 if disjoint."""
    return F.when((contig == contig2) & overlaps(start, end, start2, end2), overlap_length(start, end, start2, end2)).otherwise(0)


def within_distance(contig, start, end, contig2, start2, end2, distance) -> Column:
    return (contig == contig2) & overlaps(start, end, start2 - distance, end2 + distance)


def abuts(contig, start, end, contig2, start2, end2) -> Column:
    return (contig == contig2) & ((start == end2 + 1) | (end == start2 - 1))


def pad(start: Column, end: Column, left, right) -> tuple[Column, Column]:
    """Unclipped."""
    return start - left, end + right


def cycle(negative: Column, read_length: Column, position: Column) -> Column:
    """The sequencing cycle of a 1-based read position."""
    return F.when(negative, read_length - position + 1).otherwise(position)


def strand(symbol: Column) -> Column:
    """True for the negative strand, false for ``+`` and ``.``, null otherwise."""
    return F.when(symbol == "-", True).when(symbol.isin("+", "."), False)


def level_offset(level: int) -> int:
    """The first bin of a level of eight-fold bins (level 0: one bin for all)."""
    return ((1 << 3 * level) - 1) // 7


def bin_of(start: Column, end: Column, min_shift: int = 14, depth: int = 5) -> Column:
    """The smallest bin that holds a 1-based closed interval."""
    first, last = start - 1, end - 1
    out = F.lit(0)
    for level in range(1, depth + 1):
        shift = min_shift + 3 * (depth - level)
        out = F.when(F.shiftright(first, shift) == F.shiftright(last, shift), F.lit(level_offset(level)) + F.shiftright(first, shift)).otherwise(out)
    return out.cast("int")


def bins_overlapping(start: Column, end: Column, min_shift: int = 14, depth: int = 5) -> Column:
    """All bins that can hold something that overlaps."""
    parts = [F.array(F.lit(0))]
    for level in range(1, depth + 1):
        shift = min_shift + 3 * (depth - level)
        parts.append(F.sequence(F.shiftright(start - 1, shift) + level_offset(level), F.shiftright(end - 1, shift) + level_offset(level)))
    return F.concat(*parts)


def bin_level(bin_: Column, depth: int = 5) -> Column:
    out = F.lit(0)
    for level in range(1, depth + 1):
        out = F.when(bin_ >= level_offset(level), F.lit(level)).otherwise(out)
    return out


def bin_size(level: int, min_shift: int = 14, depth: int = 5) -> int:
    return 1 << (min_shift + 3 * (depth - level))

"""Interval joins, look-ups by position, pairings and liftover.

Overlaps are found by equality on (contig, bin): each interval is posted under every bin of BIN positions that it touches, and a pair is kept in
the first bin that both have in common, so it comes out once. Skewed bins are split by AQE like any other join key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stranda import schema as S
from stranda.functions import flags
from stranda.operators import tiles

BIN = 1 << 10


def _binned(df: DataFrame, side: str, width: int, before: int = 0, after: int = 0) -> DataFrame:
    row = F.struct(*[F.col(c) for c in df.columns]).alias(side)
    start, end = F.col("start") - before, F.col("end") + after
    first, last = F.floor(start / width), F.floor(end / width)
    usable = df.filter((end >= start) & F.col("contig").isNotNull())
    return usable.select(row, F.col("contig").alias("__contig"), start.alias(f"__{side}_start"), end.alias(f"__{side}_end"), first.alias(f"__{side}_first"), F.explode(F.sequence(first, last)).alias("__bin"))


def overlap_join(left: DataFrame, right: DataFrame, left_buffer: int = 0, right_buffer: int = 0, width: int = BIN) -> DataFrame:
    """Pairs as structs ``a`` and ``b``. A positive buffer trims a side's intervals at both ends; what gets empty is skipped."""
    a, b = _binned(left, "a", width, -left_buffer, -left_buffer), _binned(right, "b", width, -right_buffer, -right_buffer)
    meets = (F.col("__a_start") <= F.col("__b_end")) & (F.col("__a_end") >= F.col("__b_start")) & (F.col("__bin") == F.greatest("__a_first", "__b_first"))
    return a.join(b, ["__contig", "__bin"]).filter(meets).select("a", "b")


def _keyed(df: DataFrame) -> DataFrame:
    return df.withColumn("__row", F.monotonically_increasing_id())


def overlap_semi(left: DataFrame, right: DataFrame, contained: bool = False, width: int = BIN) -> DataFrame:
    """Left rows, once each, that overlap (or lie within) some right interval."""
    return _matching(left, right, "left_semi", contained, width)


def overlap_anti(left: DataFrame, right: DataFrame, contained: bool = False, width: int = BIN) -> DataFrame:
    return _matching(left, right, "left_anti", contained, width)


def _matching(left: DataFrame, right: DataFrame, how: str, contained: bool, width: int) -> DataFrame:
    # A row within one bin meets its matches there, so it is moved once, with that bin. Of rows over several bins only the places are posted.
    within = F.coalesce(F.floor(F.col("start") / width) == F.floor(F.col("end") / width), F.lit(True))
    table = right.select(F.col("contig").alias("__contig"), F.col("start").alias("__b_start"), F.col("end").alias("__b_end")).filter("__b_end >= __b_start")
    posted = table.withColumn("__b_bin", F.explode(F.sequence(F.floor(F.col("__b_start") / width), F.floor(F.col("__b_end") / width))))
    one = left.filter(within).withColumn("__bin", F.floor(F.col("start") / width))
    meets = (F.col("start") >= F.col("__b_start")) & (F.col("end") <= F.col("__b_end")) if contained else (F.col("start") <= F.col("__b_end")) & (F.col("end") >= F.col("__b_start"))
    near = one.join(posted, (F.col("contig") == F.col("__contig")) & (F.col("__bin") == F.col("__b_bin")) & (F.col("end") >= F.col("start")) & meets, how).drop("__bin")
    several = left.filter(~within)
    pairs = overlap_join(several.select("contig", "start", "end").distinct(), right.select("contig", "start", "end"), width=width)
    if contained:
        pairs = pairs.filter((F.col("a.start") >= F.col("b.start")) & (F.col("a.end") <= F.col("b.end")))
    hit = pairs.select(F.col("a.contig").alias("__contig"), F.col("a.start").alias("__start"), F.col("a.end").alias("__end")).distinct()
    far = several.join(hit, (F.col("contig") == F.col("__contig")) & (F.col("start") == F.col("__start")) & (F.col("end") == F.col("__end")), how)
    return near.unionByName(far)


def contained_join(outer: DataFrame, inner: DataFrame, width: int = BIN) -> DataFrame:
    """Pairs (a: outer, b: inner) where the inner interval lies within the outer."""
    return overlap_join(outer, inner, width=width).filter((F.col("b.start") >= F.col("a.start")) & (F.col("b.end") <= F.col("a.end")))


def count_overlaps(left: DataFrame, right: DataFrame, width: int = BIN) -> DataFrame:
    """Distinct left intervals with the number of right intervals that overlap them, 0 included."""
    keys = left.select("contig", "start", "end").distinct()
    counts = overlap_join(keys, right.select("contig", "start", "end"), width=width).groupBy("a.contig", "a.start", "a.end").agg(F.count("*").alias("n"))
    return keys.join(counts, ["contig", "start", "end"], "left").select("contig", "start", "end", F.coalesce("n", F.lit(0)).alias("overlaps"))


def first_overlapper(left: DataFrame, right: DataFrame, width: int = BIN) -> DataFrame:
    """Distinct left intervals with the smallest (start, end) that overlaps them."""
    pairs = overlap_join(left.select("contig", "start", "end").distinct(), right.select("contig", "start", "end"), width=width)
    out = pairs.groupBy("a.contig", "a.start", "a.end").agg(F.min(F.struct("b.start", "b.end")).alias("m"))
    return out.select("contig", "start", "end", F.col("m.start").alias("first_start"), F.col("m.end").alias("first_end"))


def nearest(probes: DataFrame, table: DataFrame, forward: bool) -> DataFrame:
    """As-of look-up: for each distinct probe (contig, start, end) the smallest entry at or after it, or the largest at or before.

    Entries order by start, then end; null where there is none.
    """
    p = probes.select("contig", "start", "end").distinct().withColumn("__kind", F.lit(0))
    t = table.select("contig", "start", "end").distinct().withColumn("__kind", F.lit(1))
    sign = -1 if forward else 1
    both = tiles.with_tile(p.unionByName(t)).withColumn("__tile", F.col("__tile") * sign)
    entry = F.when(F.col("__kind") == 1, F.struct("start", "end"))
    # At equal places the entry comes first, so it is found.
    order = [F.col("start") * sign, F.col("end") * sign, F.col("__kind").desc()]
    found = tiles.carried(both, entry, order, "last", "__found", inclusive=True)
    return found.filter("__kind = 0").select("contig", "start", "end", F.col("__found.start").alias("found_start"), F.col("__found.end").alias("found_end"))


def ranks(df: DataFrame) -> DataFrame:
    """Distinct intervals with their rank (from 0) within the contig by (start, end)."""
    keys = tiles.with_tile(df.select("contig", "start", "end").distinct()).withColumn("__one", F.lit(1))
    return tiles.carried(keys, F.col("__one"), ["start", "end"], "sum", "__rank").select("contig", "start", "end", F.col("__rank").cast("long").alias("rank"))


def region_query(df: DataFrame, contig: str, start: int, end: int, contained: bool = False) -> DataFrame:
    """Rows of a region; an end of 0 is the contig's. The conditions are plain comparisons, so they reach the scan."""
    out = df.filter((F.col("contig") == contig) & (F.col("end") >= start))
    if end > 0:
        out = out.filter(F.col("start") <= end)
    if contained:
        out = out.filter(F.col("start") >= start)
        if end > 0:
            out = out.filter(F.col("end") <= end)
    return out


def mate_join(reads: DataFrame) -> DataFrame:
    """Primary first ends with their primary second ends, as structs ``a`` and ``b``."""
    primary = reads.filter(flags.has(F.col("flag"), S.PAIRED) & ~flags.has(F.col("flag"), S.SECONDARY | S.SUPPLEMENTARY))
    row = F.struct(*reads.columns)
    one = primary.filter(flags.has(F.col("flag"), S.FIRST)).select("read_name", row.alias("a"))
    two = primary.filter(flags.has(F.col("flag"), S.SECOND)).select("read_name", row.alias("b"))
    return one.join(two, "read_name").select("a", "b")


def fix_mates(reads: DataFrame) -> DataFrame:
    """Mate fields and insert size set from the primary other end; secondary and supplementary rows get those of their own primary's mate."""
    primary = ~flags.has(F.col("flag"), S.SECONDARY | S.SUPPLEMENTARY)
    unmapped, negative = flags.has(F.col("flag"), S.UNMAPPED), flags.has(F.col("flag"), S.REVERSE)
    ends = reads.filter(primary & flags.has(F.col("flag"), S.PAIRED)).select(
        "read_name", flags.has(F.col("flag"), S.FIRST).alias("__of_second"), F.col("ref").alias("m_ref"), F.col("start").alias("m_start"), F.col("end").alias("m_end"), F.col("cigar").alias("m_cigar"), unmapped.alias("m_unmapped"), negative.alias("m_negative")
    )
    own = reads.withColumn("__of_second", flags.has(F.col("flag"), S.SECOND)).join(ends, ["read_name", "__of_second"], "left")
    known = F.col("m_unmapped").isNotNull()
    flag = F.when(known, flags.with_bit(flags.with_bit(F.col("flag"), S.MATE_REVERSE, F.col("m_negative")), S.MATE_UNMAPPED, F.col("m_unmapped"))).otherwise(F.col("flag"))
    size = flags.insert_size(F.col("start"), F.col("end"), negative, ~unmapped, F.col("ref"), F.col("m_start"), F.col("m_end"), F.col("m_negative"), ~F.col("m_unmapped"), F.col("m_ref"))
    keep = [c for c in reads.columns if c not in ("flag", "mate_ref", "mate_start", "tlen", "mate_cigar")]
    return own.select(*keep, flag.alias("flag"), F.col("m_ref").alias("mate_ref"), F.col("m_start").alias("mate_start"), F.when(known, size).alias("tlen"), F.when(~F.col("m_unmapped"), F.col("m_cigar")).alias("mate_cigar"))


def look_up(df: DataFrame, dimension: DataFrame, key: Column) -> DataFrame:
    """Rows with the columns of a header dimension (read groups, sequences); unmatched rows stay."""
    return df.join(dimension, key, "left")


def lift_over(intervals: DataFrame, blocks: DataFrame, min_match: float = 0.95) -> DataFrame:
    """Intervals carried to another assembly, through chain blocks
    (chain, from_contig, from_start, from_end, to_contig, to_start, to_negative, to_size), 1-based closed on the source side and 0-based on the target.

    An interval is lifted if the blocks of just one chain cover ``min_match`` of it; others come out with null targets. ``fraction`` is the best one.
    """
    probes = intervals.select("contig", "start", "end", "name", "negative").distinct()
    table = blocks.select(F.col("from_contig").alias("contig"), F.col("from_start").alias("start"), F.col("from_end").alias("end"), "chain", "to_contig", "to_start", "to_negative", "to_size")
    hits = overlap_join(probes, table)
    low, high = F.greatest("a.start", "b.start"), F.least("a.end", "b.end")
    to_low, to_high = F.col("b.to_start") + (low - F.col("b.start")), F.col("b.to_start") + (high - F.col("b.start")) + 1
    per_chain = hits.groupBy("a", "b.chain").agg(F.sum(high - low + 1).alias("bases"), F.min(to_low).alias("low"), F.max(to_high).alias("high"), F.first("b.to_contig").alias("to"), F.first("b.to_negative").alias("turned"), F.first("b.to_size").alias("size"))
    share = F.col("bases") / (F.col("a.end") - F.col("a.start") + 1)
    good = share >= min_match
    best = per_chain.groupBy("a").agg(F.max(share).alias("fraction"), F.count(F.when(good, 1)).alias("n"), F.max(F.when(good, F.struct("to", "low", "high", "turned", "size"))).alias("m"))
    one = F.col("n") == 1
    start = F.when(F.col("m.turned"), F.col("m.size") - F.col("m.high")).otherwise(F.col("m.low")) + 1
    end = F.when(F.col("m.turned"), F.col("m.size") - F.col("m.low")).otherwise(F.col("m.high"))
    lifted = best.select("a.*", "fraction", F.when(one, F.col("m.to")).alias("to_contig"), F.when(one, start).alias("to_start"), F.when(one, end).alias("to_end"), F.when(one, F.col("a.negative") != F.col("m.turned")).alias("to_negative"))
    keys = ["contig", "start", "end", "name", "negative"]
    same = [probes[k].eqNullSafe(lifted[k]) for k in keys]
    condition = same[0] & same[1] & same[2] & same[3] & same[4]
    return probes.join(lifted, condition, "left").select(*[probes[k] for k in keys], F.coalesce("fraction", F.lit(0.0)).alias("fraction"), "to_contig", "to_start", "to_end", "to_negative")


def partial_lifts(intervals: DataFrame, blocks: DataFrame) -> DataFrame:
    """Every chain that an interval touches, with the fraction of it that the chain's blocks cover."""
    table = blocks.select(F.col("from_contig").alias("contig"), F.col("from_start").alias("start"), F.col("from_end").alias("end"), "chain", "to_contig")
    hits = overlap_join(intervals.select("contig", "start", "end").distinct(), table)
    size = F.least("a.end", "b.end") - F.greatest("a.start", "b.start") + 1
    return hits.groupBy("a.contig", "a.start", "a.end", "b.chain", "b.to_contig").agg((F.sum(size) / F.first(F.col("a.end") - F.col("a.start") + 1)).alias("fraction"))


def contig_map(blocks: DataFrame) -> DataFrame:
    return blocks.select("from_contig", "to_contig").distinct()


def ordered_union(*tables: DataFrame) -> DataFrame:
    """Rows of several sorted tables as one; a sort gives the order, whatever the inputs' was."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def window_of(*keys: str) -> Window:
    return Window.partitionBy(*keys)

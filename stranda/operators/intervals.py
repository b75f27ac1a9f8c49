"""Interval algebra over (contig, start, end[, negative, name]). ``sequences`` is (ref_index, name, length)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stranda import storage
from stranda.operators import joins, tiles

COLUMNS = ["contig", "start", "end", "negative", "name"]


def order() -> list:
    return ["start", "end", F.col("negative").asc(), F.col("name").asc_nulls_first()]


def full(df: DataFrame) -> DataFrame:
    """With all columns of an interval; a missing strand is positive, a missing name null."""
    have = set(df.columns)
    return df.select(
        "contig",
        F.col("start").cast("long").alias("start"),
        F.col("end").cast("long").alias("end"),
        (F.col("negative") if "negative" in have else F.lit(False)).alias("negative"),
        (F.col("name") if "name" in have else F.lit(None)).cast("string").alias("name"),
    )


def islands(df: DataFrame, abutting: bool = True, save: bool = False) -> DataFrame:
    """Appends ``island``: equal, within a contig, for intervals that overlap, or also abut, directly or through others.

    ``save``: whether what comes before is more than a scan.
    """
    tiled = tiles.with_tile(df)
    running = tiles.carried(tiled, F.col("end"), order(), "max", "__max", save=save)
    opens = (F.col("__max").isNull() | (F.col("start") > F.col("__max") + (1 if abutting else 0))).cast("int")
    return tiles.carried(running.withColumn("__open", opens), F.col("__open"), order(), "sum", "island", inclusive=True).drop("__max", "__open", "__tile")


def merge(df: DataFrame, abutting: bool = True, join_names: bool = True, same_strand: bool = False, save: bool = False) -> DataFrame:
    """Merged intervals: strand of the first; name of the first, or the distinct names joined by ``|`` in order.

    ``same_strand`` fails if intervals of both strands would be merged.
    """
    marked = islands(full(df), abutting, save)
    names = F.transform(F.array_sort(F.collect_list(F.when(F.col("name").isNotNull(), F.struct("start", "end", "negative", "name")))), lambda x: x["name"])
    first = F.min(F.struct("start", "end", "negative", F.coalesce("name", F.lit("")).alias("k"), "name"))
    out = marked.groupBy("contig", "island").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), first.alias("first"), F.array_distinct(names).alias("names"), F.min("negative").alias("lo"), F.max("negative").alias("hi")
    )
    name = F.when(F.size("names") > 0, F.array_join("names", "|")) if join_names else F.col("first.name")
    negative = F.col("first.negative")
    if same_strand:
        negative = F.when(F.col("lo") != F.col("hi"), F.raise_error(F.lit("intervals of both strands would be merged")).cast("boolean")).otherwise(negative)
    return out.select("contig", "start", "end", negative.alias("negative"), name.alias("name"))


def unique(df: DataFrame) -> DataFrame:
    return merge(df)


def concatenate(*lists: DataFrame) -> DataFrame:
    out = full(lists[0])
    for other in lists[1:]:
        out = out.unionByName(full(other))
    return out


def union(*lists: DataFrame) -> DataFrame:
    return merge(concatenate(*lists))


def invert(df: DataFrame, sequences: DataFrame) -> DataFrame:
    """The gaps of every contig, named ``interval-k`` throughout in dictionary order."""
    merged = merge(df).select("contig", "start", "end")
    ends = sequences.select(F.col("name").alias("contig"), F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("end"))
    stops = sequences.select(F.col("name").alias("contig"), (F.col("length") + 1).alias("start"), F.col("length").alias("end"))
    marked = tiles.with_tile(merged.unionByName(ends).unionByName(stops))
    before = tiles.carried(marked, F.col("end"), ["start", "end"], "max", "__last")
    gaps = before.filter(F.col("__last").isNotNull() & (F.col("start") > F.col("__last") + 1)).select("contig", (F.col("__last") + 1).alias("start"), (F.col("start") - 1).alias("end"))
    return numbered(gaps, sequences)


def numbered(gaps: DataFrame, sequences: DataFrame) -> DataFrame:
    """Named ``interval-k`` in dictionary order: ranks within tiles, after the counts of all earlier tiles."""
    placed = tiles.with_tile(storage.saved(gaps, "gaps")).join(sequences.select(F.col("name").alias("contig"), "ref_index"), "contig")
    counts = placed.groupBy("ref_index", "__tile").agg(F.count("*").alias("n"))
    earlier = Window.orderBy("ref_index", "__tile").rowsBetween(Window.unboundedPreceding, -1)  # one row for each tile
    offsets = counts.select("ref_index", "__tile", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("__offset"))
    rank = F.row_number().over(Window.partitionBy("ref_index", "__tile").orderBy("start"))
    named = placed.withColumn("__rank", rank).join(offsets, ["ref_index", "__tile"])
    return named.select("contig", "start", "end", F.lit(False).alias("negative"), F.concat(F.lit("interval-"), (F.col("__offset") + F.col("__rank")).cast("string")).alias("name"))


def intersect(left: DataFrame, right: DataFrame, names: bool = True) -> DataFrame:
    """All pairwise intersections, with the strand of the right side and both names, merged.

    Without ``names`` they are null and aren't carried along: places and strands are the same, as names only order what agrees in both.
    """
    keep = COLUMNS if names else COLUMNS[:4]
    a, b = full(left).select(*keep), full(right).select(*keep)
    pairs = joins.overlap_join(a, b)
    pieces = pairs.select(
        F.col("a.contig").alias("contig"),
        F.greatest("a.start", "b.start").alias("start"),
        F.least("a.end", "b.end").alias("end"),
        F.col("b.negative").alias("negative"),
        *([F.concat(F.coalesce("a.name", F.lit("null")), F.lit(" intersection "), F.coalesce("b.name", F.lit("null"))).alias("name")] if names else []),
    )
    if not names:
        pieces = pieces.distinct()
    return merge(pieces, save=True)


def subtract(left: DataFrame, right: DataFrame, sequences: DataFrame) -> DataFrame:
    """What of the left side the right side doesn't cover; merged, on the positive strand."""
    return intersect(left, invert(right, sequences))


def difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """What just one side covers, merged, on the positive strand and without names: one sweep over both sides' ends."""
    sides = merge(left).select("contig", "start", "end").unionByName(merge(right).select("contig", "start", "end"))
    event = F.explode(F.array(F.struct(F.col("start").alias("pos"), F.lit(1).alias("d")), F.struct((F.col("end") + 1).alias("pos"), F.lit(-1).alias("d"))))
    events = sides.select("contig", event.alias("e")).groupBy("contig", F.col("e.pos").alias("pos")).agg(F.sum("e.d").alias("delta")).filter("delta <> 0")
    depth = tiles.carried(tiles.with_tile(events, "pos"), F.col("delta"), ["pos"], "sum", "depth", inclusive=True)
    later = tiles.carried(depth.withColumn("__tile", -F.col("__tile")), F.col("pos"), [F.col("pos").desc()], "min", "next")
    return merge(later.filter("depth = 1").select("contig", F.col("pos").alias("start"), (F.col("next") - 1).alias("end")), save=True)


def overlapping(left: DataFrame, right: DataFrame) -> DataFrame:
    """Left intervals, as they are, that overlap any right one."""
    return joins.overlap_semi(left, right)


def pad(df: DataFrame, before: int, after: int, sequences: DataFrame) -> DataFrame:
    """Extended, within contig bounds."""
    sized = df.join(sequences.select(F.col("name").alias("contig"), F.col("length").alias("__length")), "contig")
    return sized.withColumns({"start": F.greatest(F.lit(1), F.col("start") - before), "end": F.least(F.col("__length"), F.col("end") + after)}).select(*df.columns)


def break_at_bands(df: DataFrame, band: int) -> DataFrame:
    """Split at multiples of a band; pieces of a split interval are named ``name.1``, ``name.2`` and so on. Empty intervals stay."""
    first, last = F.floor(F.col("start") / band), F.floor(F.col("end") / band)
    whole = (F.col("end") < F.col("start")) | (first == last)
    numbered_ = full(df).withColumn("__i", F.explode(F.when(whole, F.array(first)).otherwise(F.sequence(first, F.greatest(first, last)))))
    i = F.col("__i")
    return numbered_.select(
        "contig",
        F.when(whole, F.col("start")).otherwise(F.greatest(F.col("start"), i * band)).cast("long").alias("start"),
        F.when(whole, F.col("end")).otherwise(F.least(F.col("end"), (i + 1) * band - 1)).cast("long").alias("end"),
        "negative",
        F.when(whole, F.col("name")).otherwise(F.concat("name", F.lit("."), (i - first + 1).cast("string"))).alias("name"),
    )


def base_count(df: DataFrame) -> DataFrame:
    return df.agg(F.coalesce(F.sum(F.col("end") - F.col("start") + 1), F.lit(0)).alias("bases"))


def unique_base_count(df: DataFrame) -> DataFrame:
    return base_count(merge(df))


def disordered(df: DataFrame) -> DataFrame:
    """Intervals that overlap an earlier one: none, if a list is free of overlaps."""
    running = tiles.carried(tiles.with_tile(full(df)), F.col("end"), order(), "max", "__max", save=False)
    return running.filter(F.col("start") <= F.col("__max")).select(*COLUMNS)


def optimize(df: DataFrame) -> DataFrame:
    """Query intervals (contig, start, end): sorted and merged; an end of 0 reaches to the contig's end and takes in all after it."""
    far = (1 << 31) - 1
    closed = df.select("contig", F.col("start").cast("long").alias("start"), F.when(F.col("end") <= 0, far).otherwise(F.col("end")).cast("long").alias("end"))
    return merge(closed).select("contig", "start", F.when(F.col("end") >= far, 0).otherwise(F.col("end")).alias("end"))

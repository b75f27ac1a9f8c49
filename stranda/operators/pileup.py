"""Coverage by locus. Reads are (read_name, contig, start, flag, mapq, cigar[, quals as array<int>])."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stranda import schema as S
from stranda.functions import cigar as C
from stranda.functions import flags
from stranda.operators import joins, tiles


def usable(reads: DataFrame, min_mapq: int = 0, include_failed: bool = True) -> DataFrame:
    """Mapped primary reads that aren't duplicates."""
    drop = S.UNMAPPED | S.SECONDARY | S.SUPPLEMENTARY | S.DUPLICATE | (0 if include_failed else S.QC_FAIL)
    return reads.filter(~flags.has(F.col("flag"), drop) & (F.col("mapq") >= min_mapq))


def aligned_bases(reads: DataFrame, min_mapq: int = 0, min_quality: int = 0) -> DataFrame:
    """(contig, pos, read_name, offset): each aligned base, offset from 0 in the read."""
    kept = usable(reads, min_mapq)
    block = F.explode(C.blocks(F.col("start"), C.elements(F.col("cigar")))).alias("b")
    columns = ["contig", "read_name"] + (["quals"] if "quals" in reads.columns else [])
    per_block = kept.select(*columns, block)
    out = per_block.select(*columns, "b", F.explode(F.sequence(F.lit(0), F.col("b.len") - 1)).alias("k"))
    offset = F.col("b.read_start") - 1 + F.col("k")
    if min_quality > 0 and "quals" in reads.columns:
        out = out.filter((F.size("quals") == 0) | (F.get(F.col("quals"), offset) >= min_quality))
    return out.select("contig", (F.col("b.ref_start") + F.col("k")).alias("pos"), "read_name", offset.alias("offset"))


def depth(reads: DataFrame, min_mapq: int = 0, min_quality: int = 0) -> DataFrame:
    """(contig, pos, depth) of covered loci: from stretches of equal depth; only a filter on base quality needs each base."""
    if min_quality > 0 and "quals" in reads.columns:
        return aligned_bases(reads, min_mapq, min_quality).groupBy("contig", "pos").agg(F.count("*").alias("depth"))
    return loci(stretches(reads, min_mapq))


def loci(runs: DataFrame) -> DataFrame:
    """(contig, pos, depth): each locus of stretches."""
    return runs.select("contig", F.explode(F.sequence("start", "end")).alias("pos"), "depth")


def stretches(reads: DataFrame, min_mapq: int = 0) -> DataFrame:
    """Stretches (contig, start, end, depth) of equal depth above 0, cut at tiles' ends: blocks are cut to their tiles first, so nothing is carried over."""
    block = usable(reads, min_mapq).select("contig", F.explode(C.blocks(F.col("start"), C.elements(F.col("cigar")))).alias("b"))
    ends = block.select("contig", F.col("b.ref_start").alias("start"), (F.col("b.ref_start") + F.col("b.len") - 1).alias("end")).filter("end >= start")
    tile = F.explode(F.sequence(F.floor(F.col("start") / tiles.TILE).cast("int"), F.floor(F.col("end") / tiles.TILE).cast("int"))).alias("__tile")
    low = F.col("__tile") * tiles.TILE
    event = F.explode(F.array(F.struct(F.greatest("start", low).alias("pos"), F.lit(1).alias("d")), F.struct((F.least("end", low + (tiles.TILE - 1)) + 1).alias("pos"), F.lit(-1).alias("d"))))
    edge = ends.select("contig", "start", "end", tile).select("contig", "__tile", event.alias("e")).groupBy("contig", "__tile", F.col("e.pos").alias("pos")).agg(F.sum("e.d").alias("delta")).filter("delta <> 0")
    in_tile = Window.partitionBy("contig", "__tile").orderBy("pos")
    runs = edge.select("contig", F.col("pos").alias("start"), (F.lead("pos").over(in_tile) - 1).alias("end"), F.sum("delta").over(in_tile.rowsBetween(Window.unboundedPreceding, 0)).alias("depth"))
    return runs.filter("depth > 0")


def depth_in(reads: DataFrame, intervals: DataFrame, min_mapq: int = 0, min_quality: int = 0) -> DataFrame:
    """Depth at every locus of disjoint intervals, 0 included."""
    zero = intervals.select("contig", F.explode(F.sequence(F.col("start").cast("int"), F.col("end").cast("int"))).alias("pos"), F.lit(0).cast("long").alias("depth"))
    near = joins.overlap_semi(reads.withColumn("end", C.text_end(F.col("start"), F.col("cigar"))).filter("end >= start"), intervals)
    covered = depth(near, min_mapq, min_quality).join(zero.select("contig", "pos"), ["contig", "pos"], "left_semi")
    return zero.unionByName(covered.select("contig", "pos", "depth")).groupBy("contig", "pos").agg(F.sum("depth").alias("depth"))


def indels(reads: DataFrame, min_mapq: int = 0) -> DataFrame:
    """(contig, pos, kind, n): insertions at the base before them, deletions at each deleted base."""
    parts = usable(reads, min_mapq).select("contig", F.explode(C.walk(F.col("start"), C.elements(F.col("cigar")))).alias("p"))
    inserted = parts.filter("p.op = 'I'").select("contig", (F.col("p.ref_start") - 1).alias("pos"), F.lit("I").alias("kind"))
    deleted = parts.filter("p.op = 'D'").select("contig", F.explode(F.sequence(F.col("p.ref_start"), F.col("p.ref_start") + F.col("p.len") - 1)).alias("pos"), F.lit("D").alias("kind"))
    return inserted.unionByName(deleted).groupBy("contig", "pos", "kind").agg(F.count("*").alias("n"))


def edges(reads: DataFrame, min_mapq: int = 0) -> DataFrame:
    """(contig, pos, delta): +1 where a block begins, -1 just after it ends, summed by place."""
    block = usable(reads, min_mapq).select("contig", F.explode(C.blocks(F.col("start"), C.elements(F.col("cigar")))).alias("b"))
    event = F.explode(F.array(F.struct(F.col("b.ref_start").alias("pos"), F.lit(1).alias("d")), F.struct((F.col("b.ref_start") + F.col("b.len")).alias("pos"), F.lit(-1).alias("d"))))
    return block.select("contig", event.alias("e")).groupBy("contig", F.col("e.pos").alias("pos")).agg(F.sum("e.d").alias("delta"))


def coverage(reads: DataFrame, min_mapq: int = 0) -> DataFrame:
    """Stretches (contig, start, end, depth) of equal depth above 0, from edges alone: no base is ever exploded."""
    events = tiles.with_tile(edges(reads, min_mapq).filter("delta <> 0"), "pos")
    running = tiles.carried(events, F.col("delta"), ["pos"], "sum", "depth", inclusive=True)
    later = tiles.carried(running.withColumn("__tile", -F.col("__tile")), F.col("pos"), [F.col("pos").desc()], "min", "next")
    return later.filter("depth > 0").select("contig", F.col("pos").alias("start"), (F.col("next") - 1).alias("end"), "depth")


def capped(reads: DataFrame, most: int) -> DataFrame:
    """(contig, pos, depth) with at most so many bases counted per locus (a plain limit for each locus)."""
    return loci(capped_stretches(reads, most).filter("depth > 0"))


def capped_stretches(reads: DataFrame, most: int, min_mapq: int = 0) -> DataFrame:
    """Stretches with depths of at most so many bases: which bases a limit leaves doesn't change how many there are."""
    return stretches(reads, min_mapq).withColumn("depth", F.least("depth", F.lit(most).cast("long")))


def with_reference(loci: DataFrame, reference: DataFrame) -> DataFrame:
    """Loci with the base of a reference stored in pieces (contig, offset, bases), offset from 0, pieces of one size."""
    size = reference.select(F.max(F.length("bases"))).first()[0] or 1
    piece = F.floor((F.col("pos") - 1) / size) * size
    joined = loci.withColumn("offset", piece).join(reference, ["contig", "offset"])
    return joined.withColumn("base", F.substring("bases", F.col("pos") - F.col("offset"), F.lit(1))).drop("offset", "bases")

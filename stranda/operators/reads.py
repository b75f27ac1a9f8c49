"""Read filters, orders, sampling and duplicate sets. Filter columns are true for reads to drop."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stranda import schema as S
from stranda.functions import cigar as C
from stranda.functions import flags
from stranda.operators import joins

# Filters: each gives a Column that is true for a read to drop.


def aligned(include: bool = True) -> Column:
    unmapped = flags.has(F.col("flag"), S.UNMAPPED)
    return unmapped if include else ~unmapped


def duplicate() -> Column:
    return flags.has(F.col("flag"), S.DUPLICATE)


def fails_vendor_quality() -> Column:
    return flags.has(F.col("flag"), S.QC_FAIL)


def insert_size(least: int, most: int) -> Column:
    return ~flags.has(F.col("flag"), S.PAIRED) | ~F.abs(F.col("tlen")).between(least, most)


def mapping_quality(least: int) -> Column:
    return F.col("mapq") < least


def secondary() -> Column:
    return flags.has(F.col("flag"), S.SECONDARY)


def secondary_or_supplementary() -> Column:
    return flags.has(F.col("flag"), S.SECONDARY | S.SUPPLEMENTARY)


def overclipped(least_aligned: int, single_end: bool = False) -> Column:
    """Too few aligned bases, with soft clips at both ends (or at one, for ``single_end``)."""
    parts = C.merge_adjacent(C.elements(F.col("cigar")))
    runs = F.size(F.filter(parts, lambda p: p["op"] == "S"))
    return (C.total(parts, "MI=X") < least_aligned) & (runs >= (1 if single_end else 2))


def names(listed: list[str], include: bool = True) -> Column:
    known = F.col("read_name").isin(listed)
    return ~known if include else known


def tag(name: str, values: list[str], include: bool = True) -> Column:
    known = F.coalesce(F.col("tags")[name].isin(values), F.lit(False))
    return ~known if include else known


def noise() -> Column:
    """Only A and no-calls."""
    return F.col("bases").rlike("^[AaNn.]*$")


def whole_read_clipped() -> Column:
    return F.coalesce(F.col("tags")["XT"] == "1", F.lit(False))


def any_of(*drops: Column) -> Column:
    return reduce(lambda a, b: a | b, drops)


def inverted(drop: Column) -> Column:
    return ~drop


def apply(reads: DataFrame, drop: Column) -> DataFrame:
    return reads.filter(~F.coalesce(drop, F.lit(False)))


#: How a pair is judged from its ends' verdicts: dropped if either, or both, are.
PAIR_RULES = {"either": "max", "both": "min"}


def apply_to_pairs(reads: DataFrame, drop: Column, rule: str = "either") -> DataFrame:
    """Judges templates as a whole: all rows of a name stay or go together."""
    fold = F.max if PAIR_RULES[rule] == "max" else F.min
    gone = reads.groupBy("read_name").agg(fold(F.coalesce(drop, F.lit(False))).alias("__gone"))
    return reads.join(gone, "read_name").filter(~F.col("__gone")).drop("__gone")


def in_intervals(reads: DataFrame, intervals: DataFrame) -> DataFrame:
    """Reads that overlap an interval; reads are (contig, start, end, ...)."""
    return joins.overlap_semi(reads, intervals)


# Orders.


def coordinate_key(sequences: bool = True) -> list[Column]:
    index = F.when(F.col("ref_index") < 0, 1 << 30).otherwise(F.col("ref_index"))
    return [index.asc(), F.col("start").asc(), flags.has(F.col("flag"), S.REVERSE).asc(), F.col("read_name").asc(), F.col("flag").asc(), F.col("mapq").asc()]


def queryname_key() -> list[Column]:
    flag = F.col("flag")
    return [
        F.col("read_name").asc(),
        (~flags.has(flag, S.PAIRED)).asc(),
        flags.has(flag, S.SECOND).asc(),
        flags.has(flag, S.REVERSE).asc(),
        flags.has(flag, S.SECONDARY).asc(),
        flags.has(flag, S.SUPPLEMENTARY).asc(),
    ]


def sort(reads: DataFrame, key: list[Column]) -> DataFrame:
    """A total order, by range partitions; nothing is gathered."""
    return reads.orderBy(*key)


def out_of_order(reads: DataFrame, partition: str, position: str, ordinal: str) -> DataFrame:
    """Rows whose position lies before that of the row before."""
    previous = F.lag(position).over(Window.partitionBy(partition).orderBy(ordinal))
    return reads.withColumn("__prev", previous).filter(F.col(position) < F.col("__prev")).drop("__prev")


# Sampling: decisions are made by template name, so mates stay together.

LEAST, MOST = -(1 << 31), (1 << 31) - 1


def threshold(p: float) -> int:
    return LEAST + round((MOST - LEAST) * p) if p < 1 else MOST


def downsample(reads: DataFrame, p: float, seed: int = 1) -> DataFrame:
    """Keeps a template if its name's hash lies below a share p of the hashes; needs no memory."""
    return reads.filter(flags.murmur3(F.col("read_name"), seed) <= threshold(p))


def downsample_exact(reads: DataFrame, p: float, accuracy: float = 0.0001, seed: int = 1) -> DataFrame:
    """The share of templates is p to within an accuracy: of each run of ceil(1/accuracy) templates in hash order as many as p says.

    Templates are dealt to hash ranges by their count, so no range is larger than a few runs.
    """
    names_ = reads.select("read_name").distinct()
    run = max(1, -int(-1 // accuracy))
    buckets = max(1, -(-names_.count() // run))
    h = F.pmod(F.xxhash64("read_name", F.lit(seed)), F.lit(1 << 30))
    bucket = F.floor(h * buckets / (1 << 30))
    window = Window.partitionBy("__bucket").orderBy("__h", "read_name")
    size = F.count("*").over(Window.partitionBy("__bucket"))
    ranked = names_.withColumns({"__h": h, "__bucket": bucket}).withColumns({"__rank": F.row_number().over(window), "__size": size})
    kept = ranked.filter(F.col("__rank") <= F.round(F.col("__size") * p)).select("read_name")
    return reads.join(kept, "read_name", "left_semi")


def downsample_chained(reads: DataFrame, p: float, accuracy: float = 0.0001, seed: int = 1) -> DataFrame:
    """First by hash to a little more than p, then exactly."""
    more = min(1.0, p + 3.3 * (p / 50000) ** 0.5)
    return downsample_exact(downsample(reads, more, seed), min(1.0, p / more), accuracy, seed)


# Duplicate sets.

UNKNOWN_LIBRARY = "Unknown Library"


def duplicate_keys(reads: DataFrame) -> DataFrame:
    """Mapped primary reads (with ref, start, flag, cigar, library, and optionally mate_ref, mate_start, mate_cigar) with their keys."""
    flag, parts = F.col("flag"), C.elements(F.col("cigar"))
    usable = ~flags.has(flag, S.UNMAPPED | S.SECONDARY | S.SUPPLEMENTARY)
    own = F.when(flags.has(flag, S.REVERSE), C.unclipped_end(F.col("start"), parts)).otherwise(C.unclipped_start(F.col("start"), parts))
    negative = flags.has(flag, S.REVERSE)
    paired = flags.has(flag, S.PAIRED) & ~flags.has(flag, S.MATE_UNMAPPED)
    have = set(reads.columns)
    out = reads.filter(usable).withColumns({"__library": F.coalesce(F.col("library"), F.lit(UNKNOWN_LIBRARY)), "__five": own, "__negative": negative})
    if {"mate_ref", "mate_start", "mate_cigar"} <= have:
        mate = C.elements(F.coalesce(F.col("mate_cigar"), F.lit("*")))
        mate_negative = flags.has(flag, S.MATE_REVERSE)
        mate_five = F.when(mate_negative, C.unclipped_end(F.col("mate_start"), mate)).otherwise(C.unclipped_start(F.col("mate_start"), mate))
        return out.withColumns({"__mate_ref": F.when(paired, F.col("mate_ref")), "__mate_five": F.when(paired, mate_five), "__mate_negative": F.when(paired, mate_negative)})
    return out.withColumns({"__mate_ref": F.lit(None).cast("string"), "__mate_five": F.lit(None).cast("int"), "__mate_negative": F.lit(None).cast("boolean")})


KEYS = ["__library", "ref", "__five", "__negative", "__mate_ref", "__mate_five", "__mate_negative"]


def score(quals: Column, flag: Column) -> Column:
    """Sum of qualities of 15 and more, at most 16383, far less for reads that fail quality control."""
    total = F.least(F.aggregate(quals, F.lit(0), lambda acc, q: acc + F.when(q >= 15, q).otherwise(0)), F.lit(16383))
    return total - F.when(flags.has(flag, S.QC_FAIL), 16384).otherwise(0)


def score_by_length(reference_length: Column, flag: Column) -> Column:
    return F.least(reference_length, F.lit(16383)) - F.when(flags.has(flag, S.QC_FAIL), 16384).otherwise(0)


def duplicate_sets(reads: DataFrame, score_column: str = "score") -> DataFrame:
    """(keys, size, representative name): the best read of each set by paired, score and name, nulls last, by aggregation alone."""
    keyed = duplicate_keys(reads)
    paired = flags.has(F.col("flag"), S.PAIRED).cast("int")
    best = F.min(F.struct((-paired).alias("p"), F.col(score_column).isNull().alias("no_s"), (-F.col(score_column)).alias("s"), F.col("read_name").isNull().alias("no_n"), F.col("read_name").alias("n"), F.col("flag").alias("f")))
    return keyed.groupBy(*KEYS).agg(F.count("*").alias("size"), best.alias("best")).select(*KEYS, "size", F.col("best.n").alias("representative"), F.col("best.f").alias("representative_flag"))


def mark_duplicates(reads: DataFrame, score_column: str = "score") -> DataFrame:
    """All but a set's representative get the duplicate bit; unmapped and non-primary reads are left as they are."""
    usable = ~flags.has(F.col("flag"), S.UNMAPPED | S.SECONDARY | S.SUPPLEMENTARY)
    sets = duplicate_sets(reads, score_column)
    keyed = duplicate_keys(reads)
    condition = reduce(lambda a, b: a & b, [keyed[k].eqNullSafe(sets[k]) for k in KEYS])
    joined = keyed.join(sets, condition)
    best = (F.col("read_name") == F.col("representative")) & (F.col("flag") == F.col("representative_flag"))
    marked = joined.select(*[keyed[c] for c in reads.columns if c != "flag"], flags.with_bit(F.col("flag"), S.DUPLICATE, ~best).alias("flag"))
    return marked.select(*reads.columns).unionByName(reads.filter(~usable))


def keep_pairs_in(reads: DataFrame, intervals: DataFrame) -> DataFrame:
    """Paired primary reads that overlap an interval themselves or whose mate does; needs ``mate_cigar`` for mapped mates.

    Reads are (contig, start, end, flag, mate_ref, mate_start, mate_cigar, ...).
    """
    flag = F.col("flag")
    usable = reads.filter(flags.has(flag, S.PAIRED) & ~flags.has(flag, S.SECONDARY | S.SUPPLEMENTARY))
    missing = ~flags.has(flag, S.MATE_UNMAPPED) & F.col("mate_cigar").isNull()
    end = F.when(missing, F.raise_error(F.concat(F.lit("no CIGAR of the mate of "), "read_name")).cast("int")).otherwise(C.alignment_end(F.col("mate_start"), C.elements(F.col("mate_cigar"))))
    keys = ["contig", "start", "end", "flag", "mate_ref", "mate_start", "mate_cigar", "read_name"]
    own = joins.overlap_join(usable.filter(~flags.has(flag, S.UNMAPPED)).select(*keys).distinct(), intervals.select("contig", "start", "end")).select("a.*")
    mates = usable.filter(~flags.has(flag, S.MATE_UNMAPPED)).select(F.col("mate_ref").alias("contig"), F.col("mate_start").alias("start"), end.alias("end"), F.struct(*keys).alias("row")).distinct()
    others = joins.overlap_join(mates, intervals.select("contig", "start", "end")).select("a.row.*")
    hit = own.unionByName(others).distinct()
    return usable.join(hit, reduce(lambda a, b: a & b, [usable[k].eqNullSafe(hit[k]) for k in keys]), "left_semi")


def next_covered(positions: DataFrame, mask: DataFrame) -> DataFrame:
    """(contig, pos, covered, next): whether a position lies in a mask of merged intervals, and the next one at or after it that does."""
    probes = positions.select("contig", F.col("pos").cast("long").alias("start"), F.col("pos").cast("long").alias("end")).distinct()
    table = mask.select("contig", "start", "end")
    before = joins.nearest(probes.select("contig", "start", (F.col("start") + (1 << 40)).alias("end")), table, forward=False).select("contig", "start", F.col("found_end").alias("b_end"))
    after = joins.nearest(probes.select("contig", "start", F.lit(0).cast("long").alias("end")), table, forward=True).select("contig", "start", F.col("found_start").alias("a_start"))
    both = before.join(after, ["contig", "start"])
    covered = F.coalesce(F.col("b_end") >= F.col("start"), F.lit(False))
    return both.select("contig", F.col("start").alias("pos"), covered.alias("covered"), F.when(covered, F.col("start")).otherwise(F.col("a_start")).alias("next"))

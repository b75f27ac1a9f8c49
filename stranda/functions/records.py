"""Row rewrites of reads and sites: each takes and gives the columns that it changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stranda import schema as S
from stranda.functions import bases as B
from stranda.functions import cigar as C
from stranda.functions import flags


def set_tag(tags: Column, name: str, value: Column) -> Column:
    """A null value removes the tag."""
    rest = F.map_filter(tags, lambda k, _: k != name)
    return F.when(value.isNull(), rest).otherwise(F.map_concat(rest, F.create_map(F.lit(name), value.cast("string"))))


def has_tag(tags: Column, name: str) -> Column:
    return F.map_contains_key(tags, name)


def tag_names(tags: Column) -> Column:
    return F.array_sort(F.map_keys(tags))


def integer_tag(tags: Column, name: str) -> Column:
    """Null if absent; an error if it isn't an integer. Unsigned 32-bit values fit a long."""
    value = tags[name]
    return F.when(value.isNull(), None).when(value.rlike("^[-+]?[0-9]+$"), value.cast("long")).otherwise(F.raise_error(F.lit(f"tag {name} isn't an integer")).cast("long"))


def float_tag(tags: Column, name: str) -> Column:
    return tags[name].try_cast("double")


def array_tag(tags: Column, name: str) -> Column:
    """A numeric array tag (B): its values without the leading type letter."""
    return F.transform(F.slice(F.split(tags[name], ","), 2, 1 << 20), lambda x: x.cast("double"))


def compare_to_interval(start: Column, end: Column, interval_start: Column, interval_end: Column) -> Column:
    """BEFORE, AFTER, CONTAINED or OVERLAPPING, within one contig."""
    return F.when(end < interval_start, "BEFORE").when(start > interval_end, "AFTER").when((start >= interval_start) & (end <= interval_end), "CONTAINED").otherwise("OVERLAPPING")


def make_unmapped(reads: DataFrame, keep_originals: bool = False) -> DataFrame:
    """Clears what only a mapped read has; the place of origin can be kept in tags OP, OC, OF and OR."""
    bits = ~(S.PROPER | S.SECONDARY | S.SUPPLEMENTARY | S.DUPLICATE | S.REVERSE)
    tags = F.col("tags")
    if keep_originals:
        for name, value in (("OP", F.col("start")), ("OC", F.col("cigar")), ("OF", F.col("flag")), ("OR", F.col("ref"))):
            tags = set_tag(tags, name, value.cast("string"))
    negative = flags.has(F.col("flag"), S.REVERSE)
    return reads.withColumns(
        {
            "tags": tags,
            "bases": F.when(negative, B.reverse_complement(F.col("bases"))).otherwise(F.col("bases")),
            "quals": F.when(negative & (F.col("quals") != "*"), F.reverse("quals")).otherwise(F.col("quals")),
            "ref": F.lit(None).cast("string"),
            "start": F.lit(0),
            "mapq": F.lit(0),
            "cigar": F.lit("*"),
            "tlen": F.lit(0),
            "flag": F.col("flag").bitwiseAND(bits).bitwiseOR(S.UNMAPPED),
        }
    )


def is_proper(orientation: Column, mapped: Column, mate_mapped: Column, same_contig: Column, expected: tuple[str, ...] = ("FR",)) -> Column:
    return mapped & mate_mapped & same_contig & orientation.isin(*expected)


def set_proper(flag: Column, proper: Column) -> Column:
    return flags.with_bit(flag, S.PROPER, proper)


def reverse_complemented(reads: DataFrame, turned: tuple[str, ...] = (), reversed_: tuple[str, ...] = ()) -> DataFrame:
    """Bases turned round and complemented, qualities turned round, and so for the tags named."""
    tags = F.col("tags")
    for name in turned:
        tags = F.when(has_tag(tags, name), set_tag(tags, name, B.reverse_complement(tags[name]))).otherwise(tags)
    for name in reversed_:
        tags = F.when(has_tag(tags, name), set_tag(tags, name, F.reverse(tags[name]))).otherwise(tags)
    return reads.withColumns({"bases": B.reverse_complement(F.col("bases")), "quals": F.reverse("quals"), "tags": tags})


def original_alignment(ref: Column, start: Column, negative: Column, cigar: Column, mapq: Column, nm: Column) -> Column:
    """The text of an OA tag: contig, start, strand, CIGAR, mapping quality and NM, each with a comma, then a semicolon."""
    return F.concat(F.concat_ws(",", ref, start.cast("string"), F.when(negative, "-").otherwise("+"), cigar, mapq.cast("string"), F.coalesce(nm.cast("string"), F.lit(""))), F.lit(";"))


def other_alignments(reads: DataFrame) -> DataFrame:
    """One row for each entry of the SA tag: read_name, ref, start, negative, cigar, mapq, nm."""
    entry = F.explode(F.filter(F.split(F.col("tags")["SA"], ";"), lambda x: x != "")).alias("e")
    t = F.split("e", ",")
    return reads.select("read_name", entry).select("read_name", t[0].alias("ref"), t[1].cast("int").alias("start"), (t[2] == "-").alias("negative"), t[3].alias("cigar"), t[4].cast("int").alias("mapq"), t[5].cast("int").alias("nm"))


def maps_nothing(parts: Column) -> Column:
    """A CIGAR without any operator that consumes both read and reference."""
    return ~F.exists(parts, lambda p: p["op"].isin("M", "=", "X"))


def past_contig(start: Column, length: Column) -> Column:
    return start > length


def clip_to_contig(start: Column, parts: Column, length: Column) -> Column:
    """The CIGAR with what reaches over its contig's end soft-clipped."""
    end = C.alignment_end(start, parts)
    first_past = C.read_position(start, parts, length) + 1
    return F.when(end <= length, C.text(parts)).otherwise(C.text(C.clip_from(parts, first_past)))


def clip_mate_overlap(reads: DataFrame) -> DataFrame:
    """The left-most read of a pair is clipped where its mate begins; a read that is clipped wholly is made unmapped by its CIGAR ``*``."""
    parts = C.elements(F.col("cigar"))
    left = flags.has(F.col("flag"), S.PAIRED) & ~flags.has(F.col("flag"), S.UNMAPPED | S.MATE_UNMAPPED) & ((F.col("mate_start") > F.col("start")) | ((F.col("mate_start") == F.col("start")) & ~flags.has(F.col("flag"), S.FIRST)))
    n = F.when(left & (F.col("mate_ref") == F.col("ref")), C.mate_overlap_to_clip(F.col("start"), parts, F.col("mate_start"))).otherwise(0)
    trailing = C.read_length(parts) - n - F.when(C.right_clipped(parts), C.trailing_clips(parts)).otherwise(0)
    return reads.withColumn("cigar", F.when(n <= 0, F.col("cigar")).when(trailing <= 0, "*").otherwise(C.text(C.clip_from(parts, trailing + 1))))


def fastq_tags(name: Column) -> Column:
    """Tags written in a FASTQ header after the name, as ``XX:T:value`` with spaces or tabs between."""
    parts = F.filter(F.split(name, r"\s+"), lambda x: x.rlike("^[A-Za-z][A-Za-z0-9]:[AifZHB]:"))
    return F.map_from_arrays(F.transform(parts, lambda x: F.substring(x, 1, 2)), F.transform(parts, lambda x: F.substring(x, 6, 1 << 20)))


def add_filter(filters: Column, name: str) -> Column:
    """Adds a filter; sites to which none were applied count as filtered from now on."""
    return F.array_union(F.coalesce(filters, F.array().cast("array<string>")), F.array(F.lit(name)))


def passed() -> Column:
    return F.array().cast("array<string>")


def subset_samples(genotypes: Column, names: list[str]) -> Column:
    return F.filter(genotypes, lambda g: g["sample"].isin(names))


def same_alleles(ref1: Column, alts1: Column, ref2: Column, alts2: Column) -> Column:
    return (ref1 == ref2) & (F.array_sort(alts1) == F.array_sort(alts2))

"""BED, GFF3, interval lists and locus lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stranda.functions import coords
from stranda.sources import lines


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    """3 to 12 columns; starts become 1-based. A score that isn't a number leaves it and all after it null."""
    raw = spark.read.text(path).filter(~F.col("value").rlike(r"^(#|track|browser|\s*$)"))
    t = raw.select(F.split(F.trim("value"), r"\t|\s+").alias("t"))
    at = lambda i: F.get(F.col("t"), F.lit(i))
    score = at(4).try_cast("double")
    later = lambda i: F.when(score.isNotNull(), at(i))
    numbers = lambda c: F.transform(F.filter(F.split(c, ","), lambda x: x != ""), lambda x: x.cast("int"))
    start = at(1).cast("int") + 1
    exons = F.zip_with(numbers(later(11)), numbers(later(10)), lambda s, n: F.struct((start + s).alias("start"), (start + s + n - 1).alias("end")))
    return t.select(at(0).alias("contig"), start.alias("start"), at(2).cast("int").alias("end"), at(3).alias("name"), score.alias("score"), coords.strand(later(5)).alias("negative"), (later(6).cast("int") + 1).alias("thick_start"), later(7).cast("int").alias("thick_end"), later(8).alias("color"), exons.alias("exons"))


def write_bed(df: DataFrame, path: str) -> None:
    name = F.coalesce(F.col("name"), F.lit(".")) if "name" in df.columns else F.lit(".")
    lines.write_lines(df.select(F.concat_ws("\t", "contig", (F.col("start") - 1).cast("string"), F.col("end").cast("string"), name).alias("value"), "contig", "start"), path, None, ["contig", "start"])


def read_gff3(spark: SparkSession, path: str) -> DataFrame:
    """Nine columns with URL-decoded values; attributes are lists by key. Directives and what follows ##FASTA are left out."""
    raw = lines.numbered(spark, path)
    fasta = raw.filter(F.col("value").startswith("##FASTA")).groupBy("file").agg(F.min("line").alias("stop"))
    body = raw.join(F.broadcast(fasta), "file", "left").filter((F.col("stop").isNull() | (F.col("line") < F.col("stop"))) & ~F.col("value").startswith("#") & (F.trim("value") != ""))
    t = body.select(F.split("value", "\t").alias("t"))
    at = lambda i: F.get(F.col("t"), F.lit(i))
    decode = lambda c: F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))
    pairs = F.filter(F.split(at(8), ";"), lambda x: F.instr(x, "=") > 0)
    attributes = F.map_from_arrays(F.transform(pairs, lambda p: decode(F.trim(F.substring_index(p, "=", 1)))), F.transform(pairs, lambda p: F.transform(F.split(F.regexp_replace(p, "^[^=]*=", ""), ","), decode)))
    number = lambda c, kind: F.when(c == ".", None).otherwise(c.try_cast(kind))
    return t.select(decode(at(0)).alias("contig"), decode(at(1)).alias("source"), decode(at(2)).alias("type"), at(3).cast("int").alias("start"), at(4).cast("int").alias("end"), F.coalesce(number(at(5), "double"), F.lit(-1.0)).alias("score"), at(6).alias("strand"), F.coalesce(number(at(7), "int"), F.lit(-1)).alias("phase"), attributes.alias("attributes"))


def gff3_edges(features: DataFrame) -> DataFrame:
    """(child, parent) by ID, for features that have both."""
    return features.select(F.get(F.col("attributes")["ID"], F.lit(0)).alias("child"), F.explode(F.col("attributes")["Parent"]).alias("parent")).filter("child is not null").distinct()


def gff3_descendants(edges: DataFrame, most: int = 32) -> DataFrame:
    """(ancestor, descendant, depth): the closure by repeated joins, until nothing new is found."""
    step = edges.select(F.col("parent").alias("ancestor"), F.col("child").alias("descendant"), F.lit(1).alias("depth"))
    out, front = step, step
    for depth in range(2, most):
        front = front.alias("f").join(edges.alias("e"), F.col("f.descendant") == F.col("e.parent")).select("f.ancestor", F.col("e.child").alias("descendant"), F.lit(depth).alias("depth")).distinct()
        if front.isEmpty():
            break
        out = out.unionByName(front)
    return out.groupBy("ancestor", "descendant").agg(F.min("depth").alias("depth"))


def write_gff3(features: DataFrame, path: str) -> None:
    encode = lambda c: F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "%", "%25"), ";", "%3B"), "=", "%3D"), ",", "%2C"), "\t", "%09")
    attributes = F.array_join(F.transform(F.array_sort(F.map_keys("attributes")), lambda k: F.concat(encode(k), F.lit("="), F.array_join(F.transform(F.col("attributes")[k], encode), ","))), ";")
    dot = lambda c, missing: F.when(F.col(c) == missing, ".").otherwise(F.regexp_replace(F.col(c).cast("string"), r"\.0$", ""))
    value = F.concat_ws("\t", encode("contig"), "source", "type", F.col("start").cast("string"), F.col("end").cast("string"), dot("score", -1.0), "strand", dot("phase", -1), F.when(attributes == "", ".").otherwise(attributes))
    lines.write_lines(features.select(value.alias("value"), "contig", "start", F.col("end").alias("e")), path, ["##gff-version 3"], ["contig", "start", F.col("e").desc()])


def read_interval_list(spark: SparkSession, path: str) -> DataFrame:
    """Five columns after a header of @-lines."""
    t = spark.read.text(path).filter(~F.col("value").startswith("@") & (F.trim("value") != "")).select(F.split("value", "\t").alias("t"))
    at = lambda i: F.get(F.col("t"), F.lit(i))
    return t.select(at(0).alias("contig"), at(1).cast("int").alias("start"), at(2).cast("int").alias("end"), coords.strand(at(3)).alias("negative"), F.nullif(at(4), F.lit(".")).alias("name"))


def check_intervals(intervals: DataFrame, sequences: DataFrame) -> DataFrame:
    """(contig, start, end, problem): unknown contigs, starts below 1, ends before starts or past the contig, unknown strands."""
    sized = intervals.join(sequences.select(F.col("name").alias("contig"), "length"), "contig", "left")
    problem = F.when(F.col("length").isNull(), "UNKNOWN_CONTIG").when(F.col("start") < 1, "START_BELOW_1").when(F.col("end") < F.col("start") - 1, "END_BEFORE_START").when(F.col("end") > F.col("length"), "END_PAST_CONTIG").when(F.col("negative").isNull(), "UNKNOWN_STRAND")
    return sized.withColumn("problem", problem).filter("problem is not null").select("contig", "start", "end", "problem")


def write_interval_list(intervals: DataFrame, sequences: DataFrame, path: str) -> None:
    head = ["@HD\tVN:1.6"] + [f"@SQ\tSN:{r.name}\tLN:{r.length}" for r in sequences.orderBy("ref_index").collect()]
    value = F.concat_ws("\t", "contig", F.col("start").cast("string"), F.col("end").cast("string"), F.when(F.col("negative"), "-").otherwise("+"), F.coalesce("name", F.lit(".")))
    placed = intervals.join(F.broadcast(sequences.select(F.col("name").alias("contig"), "ref_index")), "contig")
    lines.write_lines(placed.select(value.alias("value"), "ref_index", "start", F.col("end").alias("e")), path, head, ["ref_index", "start", "e"])


def read_loci(spark: SparkSession, path: str) -> DataFrame:
    """``contig``, ``contig:start`` or ``contig:start-end`` on each line; commas in numbers are ignored, an end of 0 is the contig's."""
    raw = spark.read.text(path).filter(F.trim("value") != "").select(F.trim("value").alias("value"))
    part = lambda k: F.regexp_replace(F.regexp_extract("value", r"^(.*?)(?::([0-9,]+)(?:-([0-9,]+))?)?$", k), ",", "")
    start = F.coalesce(part(2).try_cast("int"), F.lit(1))
    end = F.coalesce(part(3).try_cast("int"), F.when(part(2) != "", start).otherwise(0))
    return raw.select(F.regexp_extract("value", r"^(.*?)(?::([0-9,]+)(?:-([0-9,]+))?)?$", 1).alias("contig"), start.alias("start"), end.alias("end"))

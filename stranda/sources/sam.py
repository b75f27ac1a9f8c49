"""Alignments as tab-separated text with a header of @-lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stranda.functions import cigar as C
from stranda.sources import lines

HEADER = r"^@[A-Za-z]{2}(\t|$)"
FIELDS = ["read_name", "flag", "ref", "start", "mapq", "cigar", "mate_ref", "mate_start", "tlen", "bases", "quals"]


def _optional(tokens: Column) -> Column:
    return F.slice(tokens, F.lit(12), F.greatest(F.size(tokens) - 11, F.lit(0)))


def read(spark: SparkSession, path: str) -> DataFrame:
    """Records with tags as a map from name to value and their types as another; ``*`` and 0 become null where they mean unknown."""
    t = F.split("value", "\t")
    raw = spark.read.text(path).filter(~F.col("value").rlike(HEADER) & (F.col("value") != "")).select(t.alias("t"))
    known = lambda c: F.when(c == "*", None).otherwise(c)
    tags = _optional(F.col("t"))
    at = lambda i: F.get(F.col("t"), F.lit(i))
    out = raw.select(
        at(0).alias("read_name"),
        at(1).cast("int").alias("flag"),
        known(at(2)).alias("ref"),
        at(3).cast("int").alias("start"),
        at(4).cast("int").alias("mapq"),
        at(5).alias("cigar"),
        F.when(at(6) == "=", known(at(2))).otherwise(known(at(6))).alias("mate_ref"),
        at(7).cast("int").alias("mate_start"),
        at(8).cast("int").alias("tlen"),
        at(9).alias("bases"),
        at(10).alias("quals"),
        F.map_from_arrays(F.transform(tags, lambda x: F.substring(x, 1, 2)), F.transform(tags, lambda x: F.substring(x, 6, 1 << 30))).alias("tags"),
        F.map_from_arrays(F.transform(tags, lambda x: F.substring(x, 1, 2)), F.transform(tags, lambda x: F.substring(x, 4, 1))).alias("tag_types"),
    )
    end = F.when(F.col("flag").bitwiseAND(4) == 0, C.alignment_end(F.col("start"), C.elements(F.col("cigar"))))
    return out.withColumn("end", end)


def header(spark: SparkSession, path: str) -> DataFrame:
    """(line, kind, fields): header lines; ``fields`` maps two-letter keys to values."""
    rows = lines.numbered(spark, path).filter(F.col("value").startswith("@") & F.col("value").rlike(HEADER))
    parts = F.slice(F.split("value", "\t"), 2, 1 << 20)
    pairs = F.filter(parts, lambda x: x.rlike("^[A-Za-z][A-Za-z0-9]:"))
    keyed = F.map_from_arrays(F.transform(pairs, lambda x: F.substring(x, 1, 2)), F.transform(pairs, lambda x: F.substring(x, 4, 1 << 30)))
    return rows.select("line", F.substring("value", 2, 2).alias("kind"), keyed.alias("fields"), "value")


def sequences(spark: SparkSession, path: str) -> DataFrame:
    """The dictionary of @SQ lines; contigs keep the order of the header."""
    from pyspark.sql import Window

    sq = header(spark, path).filter("kind = 'SQ'")
    index = (F.row_number().over(Window.orderBy("line")) - 1).cast("int")
    return sq.select(index.alias("ref_index"), F.col("fields")["SN"].alias("name"), F.col("fields")["LN"].cast("long").alias("length"), F.col("fields")["M5"].alias("md5"))


def read_groups(spark: SparkSession, path: str) -> DataFrame:
    return header(spark, path).filter("kind = 'RG'").select(F.col("fields")["ID"].alias("id"), F.col("fields")["SM"].alias("sample"), F.col("fields")["LB"].alias("library"), F.col("fields")["PL"].alias("platform"), F.col("fields").alias("attributes"))


def line(reads: DataFrame) -> DataFrame:
    """(value): each record as a line; tags in name order, of type Z unless ``tag_types`` says otherwise."""
    known = lambda c: F.coalesce(F.col(c), F.lit("*"))
    kinds = F.col("tag_types") if "tag_types" in reads.columns else F.create_map().cast("map<string,string>")
    tags = F.transform(F.array_sort(F.map_keys("tags")), lambda k: F.concat(k, F.lit(":"), F.coalesce(F.get(F.map_values(F.map_filter(kinds, lambda a, _: a == k)), F.lit(0)), F.lit("Z")), F.lit(":"), F.col("tags")[k]))
    mate = F.when(F.col("mate_ref") == F.col("ref"), "=").otherwise(known("mate_ref"))
    number = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("string")
    core = F.array("read_name", number("flag"), known("ref"), number("start"), number("mapq"), known("cigar"), mate, number("mate_start"), number("tlen"), known("bases"), known("quals"))
    return reads.select(F.array_join(F.concat(core, F.coalesce(tags, F.array().cast("array<string>"))), "\t").alias("value"), *[c for c in ("ref", "start", "read_name", "flag") if c in reads.columns])


def write(reads: DataFrame, path: str, header_lines: list[str], order: list | None = None) -> None:
    lines.write_lines(line(reads), path, header_lines, order)

"""Variant call text: sites with INFO maps and genotypes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stranda.functions import variants as V
from stranda.sources import lines


def _list(c, separator: str):
    return F.when(c == ".", None).otherwise(F.split(c, separator))


def samples(spark: SparkSession, path: str) -> list[str]:
    """Sample names of the column line."""
    row = spark.read.text(path).filter(F.col("value").startswith("#CHROM")).first()
    return row.value.split("\t")[9:] if row else []


def header(spark: SparkSession, path: str) -> DataFrame:
    """(kind, id, number, type, description, value) of INFO, FORMAT, FILTER, contig and other ##-lines."""
    rows = spark.read.text(path).filter(F.col("value").startswith("##"))
    pick = lambda key: F.nullif(F.regexp_extract("value", f"[<,]{key}=([^,>]*)", 1), F.lit(""))
    return rows.select(F.regexp_extract("value", "^##([^=]+)=", 1).alias("kind"), pick("ID").alias("id"), pick("Number").alias("number"), pick("Type").alias("type"), F.nullif(F.regexp_extract("value", 'Description="((?:[^"\\\\\\\\]|\\\\\\\\.)*)"', 1), F.lit("")).alias("description"), "value")


def contigs(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.text(path).filter(F.col("value").startswith("##contig="))
    return rows.select(F.regexp_extract("value", "[<,]ID=([^,>]*)", 1).alias("name"), F.regexp_extract("value", "[<,]length=([0-9]+)", 1).try_cast("long").alias("length"))


def read(spark: SparkSession, path: str) -> DataFrame:
    """Sites. ``filters``: null where filters weren't applied, empty where they passed. A flag's INFO value is ``true``.

    ``genotypes``: one entry for each sample, with the FORMAT keys of the site as a map; trailing fields may be missing.
    """
    names = samples(spark, path)
    t = spark.read.text(path).filter(~F.col("value").startswith("#") & (F.col("value") != "")).select(F.split("value", "\t").alias("t"))
    at = lambda i: F.get(F.col("t"), F.lit(i))
    entries = F.filter(F.split(at(7), ";"), lambda e: (e != "") & (e != "."))
    key = lambda e: F.substring_index(e, "=", 1)
    value = lambda e: F.when(F.instr(e, "=") > 0, F.regexp_replace(e, "^[^=]*=", "")).otherwise("true")
    info = F.map_from_arrays(F.transform(entries, key), F.transform(entries, value))
    fields = F.split(at(8), ":")
    each = [
        F.struct(
            F.lit(n).alias("sample"),
            F.map_from_arrays(F.slice(fields, F.lit(1), F.least(F.size(fields), F.size(F.split(at(9 + i), ":")))), F.slice(F.split(at(9 + i), ":"), F.lit(1), F.least(F.size(fields), F.size(F.split(at(9 + i), ":"))))).alias("fields"),
        )
        for i, n in enumerate(names)
    ]
    ref = F.upper(at(3))
    start = at(1).cast("int")
    out = t.select(
        at(0).alias("contig"),
        start.alias("start"),
        F.nullif(at(2), F.lit(".")).alias("id"),
        ref.alias("ref"),
        F.coalesce(_list(at(4), ","), F.array().cast("array<string>")).alias("alts"),
        V.vcf_double(at(5)).alias("qual"),
        F.when(at(6) == ".", None).when(at(6) == "PASS", F.array().cast("array<string>")).otherwise(F.split(at(6), ";")).alias("filters"),
        info.alias("info"),
        (F.array(*each) if each else F.array().cast("array<struct<sample:string,fields:map<string,string>>>")).alias("genotypes"),
    )
    return out.withColumn("stop", V.stop_of(F.col("start"), F.col("ref"), F.col("info")["END"]))


def genotypes(sites: DataFrame) -> DataFrame:
    """One row for each site and sample: contig, start, ref, alts, sample, gt, phased, gq, dp, ad, pl, fields."""
    g = sites.select("contig", "start", "ref", "alts", F.explode("genotypes").alias("g"))
    f = F.col("g.fields")
    numbers = lambda c: F.transform(F.split(c, ","), lambda x: x.try_cast("int"))
    return g.select("contig", "start", "ref", "alts", F.col("g.sample").alias("sample"), V.parse_gt(f["GT"]).alias("gt"), F.contains(f["GT"], F.lit("|")).alias("phased"), f["GQ"].try_cast("int").alias("gq"), f["DP"].try_cast("int").alias("dp"), numbers(f["AD"]).alias("ad"), numbers(f["PL"]).alias("pl"), f.alias("fields"))


def sites_only(sites: DataFrame) -> DataFrame:
    return sites.withColumn("genotypes", F.array().cast("array<struct<sample:string,fields:map<string,string>>>"))


def as_intervals(sites: DataFrame, include_filtered: bool = False) -> DataFrame:
    kept = sites if include_filtered else sites.filter(F.col("filters").isNull() | (F.size("filters") == 0))
    return kept.select("contig", "start", F.col("stop").alias("end"), F.lit(False).alias("negative"), F.col("id").alias("name"))


def line(sites: DataFrame, names: list[str]) -> DataFrame:
    """(value): INFO sorted by key, QUAL with two digits at most, filters sorted, GT first among FORMAT keys."""
    dot = lambda c: F.coalesce(c, F.lit("."))
    info = F.array_join(F.transform(F.array_sort(F.map_keys("info")), lambda k: F.when(F.col("info")[k] == "true", k).otherwise(F.concat(k, F.lit("="), F.col("info")[k]))), ";")
    qual = F.regexp_replace(F.format_string("%.2f", "qual"), r"\.?0+$", "")
    filters = F.when(F.col("filters").isNull(), ".").when(F.size("filters") == 0, "PASS").otherwise(F.array_join(F.array_sort("filters"), ";"))
    core = [F.col("contig"), F.col("start").cast("string"), dot(F.col("id")), F.col("ref"), F.when(F.size("alts") == 0, ".").otherwise(F.array_join("alts", ",")), dot(qual), filters, F.when(F.length(info) == 0, ".").otherwise(info)]
    if names:
        keys = F.array_distinct(F.flatten(F.transform("genotypes", lambda g: F.map_keys(g["fields"]))))
        keys = F.concat(F.filter(keys, lambda k: k == "GT"), F.array_sort(F.filter(keys, lambda k: k != "GT")))
        core.append(F.when(F.size(keys) == 0, ".").otherwise(F.array_join(keys, ":")))
        for i in range(len(names)):
            f = F.get(F.col("genotypes"), F.lit(i))["fields"]
            core.append(_sample(keys, f))
    return sites.select(F.array_join(F.array(*core), "\t").alias("value"), "contig", "start")


def _sample(keys, fields):
    return F.array_join(F.transform(keys, lambda k: F.coalesce(fields[k], F.lit("."))), ":")


def write(sites: DataFrame, path: str, header_lines: list[str], names: list[str], order: list | None = None) -> None:
    columns = "\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", *(["FORMAT", *names] if names else [])])
    lines.write_lines(line(sites, names), path, [*header_lines, columns], order)

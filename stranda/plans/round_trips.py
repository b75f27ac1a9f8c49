"""Queries that write stock tables in a format of the field, read the files back, and give the rows for comparison; and header queries."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stranda.operators import headers
from stranda.plans.catalogue import query
from stranda.plans.derived import cte, sequences, view
from stranda.sources import features, formats, sam, vcf
from stranda.sources import sequences as S
from stranda.storage import shared_dir


def place(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


HEAD = ["@HD\tVN:1.6\tSO:unsorted", *[f"@SQ\tSN:chr{k + 1}\tLN:2000000" for k in range(5)], "@RG\tID:g1\tSM:s1\tLB:l1\tPL:ILLUMINA"]


def sam_file(spark: SparkSession, d: str) -> str:
    path = place(spark, "reads.sam")
    rows = view(spark, d, "reads").select(
        "read_name", "flag", "ref", "start", "mapq", "cigar", F.lit(None).cast("string").alias("mate_ref"), F.lit(0).alias("mate_start"), "tlen",
        F.lit(None).cast("string").alias("bases"), F.lit(None).cast("string").alias("quals"),
        F.create_map(F.lit("AS"), (F.col("mapq") + 7).cast("string"), F.lit("RG"), F.col("library")).alias("tags"),
        F.create_map(F.lit("AS"), F.lit("i"), F.lit("RG"), F.lit("Z")).alias("tag_types"),
    )
    sam.write(rows, path, HEAD)
    return path


@query(cte("reads") + " SELECT read_name, flag, ref, start, mapq, cigar, tlen, CAST(mapq + 7 AS VARCHAR) AS score, library FROM reads")
def sam_round_trip(spark, d):
    return sam.read(spark, sam_file(spark, d)).select("read_name", "flag", "ref", "start", "mapq", "cigar", "tlen", F.col("tags")["AS"].alias("score"), F.col("tags")["RG"].alias("library"))


@query(cte("reads") + " SELECT flag, count(*) AS n, CAST(sum(start) AS BIGINT) AS places FROM reads GROUP BY flag")
def open_by_content(spark, d):
    """The format is told from the file's first bytes."""
    return formats.open_path(spark, sam_file(spark, d)).groupBy("flag").agg(F.count("*").alias("n"), F.sum("start").alias("places"))


@query("SELECT CAST(range AS INTEGER) AS ref_index, concat('chr', range + 1) AS name, 2000000::BIGINT AS length FROM range(5)")
def sam_dictionary(spark, d):
    return sam.sequences(spark, sam_file(spark, d)).select("ref_index", "name", "length")


@query(cte("variants") + """ SELECT contig, start, CAST(site AS VARCHAR) AS id, ref, alt, CASE WHEN alt = '<DEL>' THEN start + 500 ELSE start + length(ref) - 1 END AS stop, CAST(site % 7 AS VARCHAR) AS depth FROM variants""")
def vcf_round_trip(spark, d):
    rows = view(spark, d, "variants")
    end = F.when(F.array_contains("alts", "<DEL>"), (F.col("start") + 500).cast("string"))
    info = F.map_filter(F.create_map(F.lit("DP"), (F.col("site") % 7).cast("string"), F.lit("END"), end), lambda k, v: v.isNotNull())
    rows = rows.select("contig", "start", F.col("site").cast("string").alias("id"), "ref", "alts", "qual", F.array().cast("array<string>").alias("filters"), info.alias("info"), F.array().cast("array<struct<sample:string,fields:map<string,string>>>").alias("genotypes"))
    path = place(spark, "sites.vcf")
    vcf.write(rows, path, ["##fileformat=VCFv4.2"], [])
    return vcf.read(spark, path).select("contig", "start", "id", "ref", F.array_join("alts", ",").alias("alt"), "stop", F.col("info")["DP"].alias("depth"))


@query(cte("iv_a") + """ SELECT contig, CAST(start AS INTEGER) AS start, CAST("end" AS INTEGER) AS "end", name FROM iv_a""")
def bed_round_trip(spark, d):
    path = place(spark, "a.bed")
    features.write_bed(view(spark, d, "iv_a"), path)
    return features.read_bed(spark, path).select("contig", "start", "end", "name")


@query(cte("iv_a") + """ SELECT contig, CAST(start AS INTEGER) AS start, CAST("end" AS INTEGER) AS "end", negative, name FROM iv_a""")
def interval_list_round_trip(spark, d):
    path = place(spark, "a.interval_list")
    features.write_interval_list(view(spark, d, "iv_a"), sequences(spark), path)
    return features.read_interval_list(spark, path).select("contig", "start", "end", "negative", "name")


@query(cte("iv_b") + """ SELECT contig, CAST(start AS INTEGER) AS start, CAST("end" AS INTEGER) AS "end", CASE WHEN negative THEN '-' ELSE '+' END AS strand, name AS id, concat('a;b=', name, '%') AS note FROM iv_b""")
def gff3_round_trip(spark, d):
    """With reserved characters in attributes, which are encoded in the file."""
    b = view(spark, d, "iv_b")
    attributes = F.create_map(F.lit("ID"), F.array("name"), F.lit("note"), F.array(F.concat(F.lit("a;b="), "name", F.lit("%"))))
    strand = F.when(F.col("negative"), "-").otherwise("+")
    path = place(spark, "b.gff3")
    features.write_gff3(b.select("contig", F.lit("x").alias("source"), F.lit("gene").alias("type"), F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), F.lit(-1.0).alias("score"), strand.alias("strand"), F.lit(-1).alias("phase"), attributes.alias("attributes")), path)
    back = features.read_gff3(spark, path)
    return back.select("contig", "start", "end", F.when(F.col("negative"), "-").otherwise("+").alias("strand") if "negative" in back.columns else "strand", F.col("attributes")["ID"][0].alias("id"), F.col("attributes")["note"][0].alias("note"))


WHOLE = "regexp_replace(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz', 'ACGTACGTACGTACGTACGTACGTANACGTACGTACGTACGTACGTACGTAN'), '[^ACGTN]', '')"
WHOLE_SQL = "SELECT doc_id, " + WHOLE.replace("'[^ACGTN]', '')", "'[^ACGTN]', '', 'g')") + " AS bases FROM documents WHERE text IS NOT NULL"


def whole_bases(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.read.parquet(f"{d}/documents.parquet").filter("text is not null").selectExpr("cast(doc_id as string) AS name", f"{WHOLE} AS bases")
    return rows.filter("bases <> ''")


@query(f"WITH b AS ({WHOLE_SQL}) SELECT CAST(doc_id AS VARCHAR) AS name, length(bases)::BIGINT AS length, md5(bases) AS md5 FROM b WHERE bases <> ''")
def fasta_round_trip(spark, d):
    """Whole texts as contigs, wrapped lines, and the dictionary of what is read back."""
    path = place(spark, "c.fasta")
    S.write_fasta(whole_bases(spark, d), path)
    return S.fasta_dictionary(S.read_fasta(spark, path)).select("name", "length", "md5")


@query(f"WITH b AS ({WHOLE_SQL}) SELECT CAST(doc_id AS VARCHAR) AS name, md5(bases) AS bases, length(bases)::INTEGER AS n FROM b WHERE bases <> ''")
def fastq_round_trip(spark, d):
    path = place(spark, "c.fastq")
    S.write_fastq(whole_bases(spark, d).withColumn("quals", F.repeat(F.lit("I"), F.length("bases"))), path)
    return S.read_fastq(spark, path).select("name", F.md5(F.col("bases").cast("binary")).alias("bases"), F.length("quals").alias("n"))


@query("SELECT concat('chr', range + 1) AS name, CAST(range AS INTEGER) AS ref_index, 2000000::BIGINT AS length FROM range(5)")
def merged_dictionary(spark, d):
    """Two dictionaries that each lack some contigs, with orders that agree."""
    s = sequences(spark)
    return headers.merge_dictionaries(s.filter("ref_index <> 2"), s.filter("ref_index in (1, 2, 3)")).select("name", "ref_index", "length")


@query("SELECT s.source, CAST(n_nationkey % 4 AS VARCHAR) AS id, CASE WHEN s.source = 1 AND n_nationkey % 4 = 3 THEN '3.1' ELSE CAST(n_nationkey % 4 AS VARCHAR) END AS new_id FROM (SELECT DISTINCT n_nationkey % 4 AS n_nationkey FROM nation) n, (VALUES (0), (1)) s(source)")
def merged_read_groups(spark, d):
    """Equal groups once; one that differs gets an id of its own."""
    ids = spark.read.parquet(f"{d}/nation.parquet").select((F.col("n_nationkey") % 4).cast("string").alias("id")).distinct()
    one = ids.select("id", F.create_map(F.lit("SM"), F.col("id")).alias("attributes"))
    other = ids.select("id", F.create_map(F.lit("SM"), F.when(F.col("id") == "3", "zz").otherwise(F.col("id"))).alias("attributes"))
    return headers.merge_groups(one, other)


@query("SELECT 'INFO' AS kind, concat('I', n_regionkey) AS id, CASE WHEN n_regionkey = 0 THEN '.' ELSE '1' END AS number, CASE WHEN n_regionkey = 1 THEN 'Float' ELSE 'Integer' END AS type FROM (SELECT DISTINCT n_regionkey FROM nation)")
def merged_vcf_headers(spark, d):
    """A number in conflict becomes open, and whole numbers give way to fractions."""
    ids = spark.read.parquet(f"{d}/nation.parquet").select("n_regionkey").distinct()
    line = lambda number, kind: ids.select(F.lit("INFO").alias("kind"), F.concat(F.lit("I"), "n_regionkey").alias("id"), number.alias("number"), kind.alias("type"), F.lit("d").alias("description"))
    one = line(F.lit("1"), F.lit("Integer"))
    other = line(F.when(F.col("n_regionkey") == 0, "2").otherwise("1"), F.when(F.col("n_regionkey") == 1, "Float").otherwise("Integer"))
    return headers.merge_vcf_headers(one, other).select("kind", "id", "number", "type")


INFO = "CASE WHEN p_size % 3 = 0 THEN 'path' WHEN p_size % 3 = 1 THEN 'benign' END"


@query(f"WITH p AS (SELECT p_partkey, {INFO} AS cln, p_size FROM part) SELECT p_partkey FROM p WHERE (cln = 'path' AND p_size > 10) OR (cln LIKE 'ben%' AND p_size % 2 = 0)")
def jexl_info_strings(spark, d):
    """INFO entries compared as text, as patterns, as numbers and as flags."""
    from stranda.operators import genotypes

    part = spark.read.parquet(f"{d}/part.parquet")
    info = F.map_filter(F.create_map(F.lit("CLN"), F.expr(INFO), F.lit("SZ"), F.col("p_size").cast("string"), F.lit("EVEN"), F.when(F.col("p_size") % 2 == 0, "true")), lambda k, v: v.isNotNull())
    kept = genotypes.translate("(vc.getAttribute('CLN') == 'path' && SZ > 10) || (CLN =~ '^ben.*' && EVEN)", {})
    return part.select("p_partkey", info.alias("info")).filter(kept).select("p_partkey")

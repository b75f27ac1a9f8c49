"""Dictionaries, read groups, programs and VCF headers as small tables, and their merging."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: FORMAT and INFO lines that tools expect: (kind, id, number, type, description). Fixed values of the format.
STANDARD = [
    ("FORMAT", "GT", "1", "String", "Genotype"),
    ("FORMAT", "GQ", "1", "Integer", "Genotype Quality"),
    ("FORMAT", "DP", "1", "Integer", "Approximate read depth (reads with MQ=255 or with bad mates are filtered)"),
    ("FORMAT", "PL", "G", "Integer", "Normalized, Phred-scaled likelihoods for genotypes as defined in the VCF specification"),
    ("FORMAT", "AD", "R", "Integer", "Allelic depths for the ref and alt alleles in the order listed"),
    ("FORMAT", "FT", ".", "String", "Genotype-level filter"),
    ("INFO", "END", "1", "Integer", "Stop position of the interval"),
    ("INFO", "DB", "0", "Flag", "dbSNP Membership"),
    ("INFO", "DP", "1", "Integer", "Approximate read depth; some reads may have been filtered"),
    ("INFO", "AF", "A", "Float", "Allele Frequency, for each ALT allele, in the same order as listed"),
    ("INFO", "AC", "A", "Integer", "Allele count in genotypes, for each ALT allele, in the same order as listed"),
    ("INFO", "AN", "1", "Integer", "Total number of alleles in called genotypes"),
]


def merge_dictionaries(*tables: DataFrame) -> DataFrame:
    """One dictionary that keeps every input's order; fails if lengths differ or the orders can't be reconciled.

    Dictionaries hold some thousand rows, so the order is found on the driver.
    """
    spark = tables[0].sparkSession
    order: dict[str, set[str]] = {}
    lengths: dict[str, int] = {}
    for t in tables:
        before = None
        for r in t.orderBy("ref_index").collect():
            if lengths.setdefault(r["name"], r["length"]) != r["length"]:
                raise ValueError(f"{r['name']} has two lengths")
            order.setdefault(r["name"], set())
            if before is not None:
                order[r["name"]].add(before)
            before = r["name"]
    out: list[str] = []
    while len(out) < len(order):
        free = next((n for n, needs in order.items() if n not in out and needs <= set(out)), None)
        if free is None:
            raise ValueError("the dictionaries' orders contradict each other")
        out.append(free)
    return spark.createDataFrame([(i, n, lengths[n]) for i, n in enumerate(out)], "ref_index int, name string, length bigint")


def same_dictionary(a: DataFrame, b: DataFrame) -> bool:
    """Equal in index, name and length."""
    columns = ["ref_index", "name", "length"]
    return a.select(columns).exceptAll(b.select(columns)).isEmpty() and b.select(columns).exceptAll(a.select(columns)).isEmpty()


def dictionary_md5(sequences: DataFrame) -> DataFrame:
    """MD5 over the sequences' own MD5s and lengths, in order."""
    rows = F.array_sort(F.collect_list(F.struct("ref_index", F.concat(F.coalesce("md5", F.lit("")), F.col("length").cast("string")).alias("t"))))
    return sequences.agg(F.md5(F.array_join(F.transform(rows, lambda r: r["t"]), "").cast("binary")).alias("md5"))


def merge_groups(*tables: DataFrame) -> DataFrame:
    """Read groups or programs (id, attributes) of several headers: equal ones once; ids in conflict get a suffix.

    ``source`` is the number of the table that a row comes from, so records can be given their group's new id.
    """
    rows = None
    for i, t in enumerate(tables):
        part = t.select(F.lit(i).alias("source"), "id", F.array_join(F.transform(F.array_sort(F.map_entries("attributes")), lambda e: F.concat(e["key"], F.lit("\t"), e["value"])), "\n").alias("body"))
        rows = part if rows is None else rows.unionByName(part)
    kinds = rows.groupBy("id", "body").agg(F.min("source").alias("first"))
    nth = F.row_number().over(Window.partitionBy("id").orderBy("first", "body")) - 1
    named = kinds.withColumn("new_id", F.when(nth == 0, F.col("id")).otherwise(F.concat("id", F.lit("."), nth.cast("string"))))
    return rows.join(named, ["id", "body"]).select("source", "id", "new_id")


def remap_groups(reads: DataFrame, mapping: DataFrame, source: int) -> DataFrame:
    """A file's reads with the RG tag of the merged header."""
    from stranda.functions import records

    new = mapping.filter(F.col("source") == source).select(F.col("id").alias("__id"), "new_id")
    joined = reads.join(new, F.col("tags")["RG"] == F.col("__id"), "left")
    return joined.withColumn("tags", F.when(F.col("new_id").isNull(), F.col("tags")).otherwise(records.set_tag(F.col("tags"), "RG", F.col("new_id")))).select(*reads.columns)


def merge_vcf_headers(*tables: DataFrame) -> DataFrame:
    """Lines of several headers by kind and id: a Number in conflict becomes ``.``, Integer and Float become Float; other types fail."""
    rows = tables[0]
    for t in tables[1:]:
        rows = rows.unionByName(t)
    g = rows.filter("id is not null").groupBy("kind", "id").agg(F.collect_set("number").alias("n"), F.array_sort(F.collect_set("type")).alias("t"), F.min("description").alias("description"))
    number = F.when(F.size("n") > 1, ".").otherwise(F.get(F.col("n"), F.lit(0)))
    clash = F.raise_error(F.concat(F.lit("types of "), "id", F.lit(" can't be merged"))).cast("string")
    kind = F.when(F.size("t") <= 1, F.get(F.col("t"), F.lit(0))).when(F.col("t") == F.array(F.lit("Float"), F.lit("Integer")), "Float").otherwise(clash)
    return g.select("kind", "id", number.alias("number"), kind.alias("type"), "description")


def repair_standard(header: DataFrame) -> DataFrame:
    """Known lines with their standard number and type; missing ones are added."""
    spark: SparkSession = header.sparkSession
    standard = spark.createDataFrame(STANDARD, "kind string, id string, number string, type string, description string")
    return header.select("kind", "id", "number", "type", "description").join(standard, ["kind", "id"], "left_anti").unionByName(standard)


def program_chain(programs: DataFrame, new_id: str) -> DataFrame:
    """A new program linked to each that none follows: (id, previous)."""
    used = programs.select(F.col("attributes")["PP"].alias("id")).filter("id is not null")
    ends = programs.select("id").join(used, "id", "left_anti")
    nth = F.row_number().over(Window.orderBy("id"))
    return ends.select(F.when(nth == 1, F.lit(new_id)).otherwise(F.concat(F.lit(new_id + "."), (nth - 1).cast("string"))).alias("id"), F.col("id").alias("previous"))


def with_aliases(sequences: DataFrame, aliases: DataFrame) -> DataFrame:
    """A look-up (any_name, ref_index): names and alternative names (name, alias)."""
    extra = aliases.join(sequences, "name").select(F.col("alias").alias("any_name"), "ref_index")
    return sequences.select(F.col("name").alias("any_name"), "ref_index").unionByName(extra).distinct()

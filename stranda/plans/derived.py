"""Genomic-shaped views of the stock tables: each as SQL that Spark and DuckDB evaluate alike, and as a DataFrame."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stranda.functions import cigar as C

COLUMNS = {
    "iv_a": ("lineitem", {
        "contig": "concat('chr', cast(l_suppkey % 5 + 1 as string))",
        "start": "cast(l_partkey * 50 + l_linenumber * 7 as bigint)",
        "end": "cast(l_partkey * 50 + l_linenumber * 7 + cast(l_quantity as int) - 1 as bigint)",
        "negative": "l_returnflag = 'R'",
        "name": "concat(cast(l_orderkey as string), '_', cast(l_linenumber as string))",
    }),
    "iv_b": ("events", {
        "contig": "concat('chr', cast(user_id % 5 + 1 as string))",
        "start": "cast(event_id * 11 + 1 as bigint)",
        "end": "cast(event_id * 11 + 20 + event_id % 40 as bigint)",
        "negative": "event_id % 3 = 0",
        "name": "concat('e', cast(event_id as string))",
    }),
    "reads": ("lineitem", {
        "read_name": "cast(l_orderkey as string)",
        "contig": "concat('chr', cast(l_suppkey % 5 + 1 as string))",
        "ref": "concat('chr', cast(l_suppkey % 5 + 1 as string))",
        "ref_index": "cast(l_suppkey % 5 as int)",
        "flag": "cast(1 + case when l_linenumber % 2 = 1 then 64 else 128 end + case when l_returnflag = 'R' then 16 else 0 end + case when l_linestatus = 'F' then 1024 else 0 end"
        " + case when l_quantity > 45 then 512 else 0 end + case when l_quantity < 3 then 4 else 0 end + case when l_linenumber = 7 then 256 else 0 end as int)",
        "start": "cast(l_partkey * 50 + l_linenumber * 7 as int)",
        "mapq": "cast(cast(round(l_discount * 100) as int) * 6 as int)",
        "tlen": "cast((l_partkey % 700) - 350 as int)",
        "cigar": "concat(cast(l_linenumber as string), 'S', cast(cast(l_quantity as int) + 5 as string), 'M', case when l_returnflag = 'A' then '2D4M' when l_returnflag = 'N' then '3I6M' else '' end)",
        "score": "cast(l_extendedprice as int)",
        "library": "concat('lib', cast(l_suppkey % 2 as string))",
    }),
    "bases": ("documents", {
        "doc_id": "doc_id",
        "bases": "regexp_replace(translate(substr(text, 1, 120), 'ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz', 'ACGTACGTACGTACGTACGTACGTANACGTACGTACGTACGTACGTACGTAN'), '[^ACGTN]', '')",
    }),
    "variants": ("part", {
        "contig": "concat('chr', cast(p_size % 5 + 1 as string))",
        "start": "cast(p_partkey * 13 + 1 as int)",
        "site": "p_partkey",
        "ref": "case when p_size % 6 = 3 then 'ACG' when p_size % 6 = 1 then 'AC' else 'A' end",
        "alt": "case when p_size % 6 = 0 then 'G' when p_size % 6 = 1 then 'GT' when p_size % 6 = 2 then 'ATT' when p_size % 6 = 3 then 'A' when p_size % 6 = 4 then '<DEL>' else 'C,AT' end",
        "qual": "p_retailprice / 10",
    }),
    "genotypes": ("lineitem", {
        "site": "l_partkey",
        "sample": "cast(l_suppkey % 8 as int)",
        "a1": "cast(l_linenumber % 2 as int)",
        "a2": "cast(case when l_returnflag = 'R' then 1 when l_returnflag = 'A' then 0 else -1 end as int)",
        "gq": "cast(round(l_tax * 1000) as int)",
        "dp": "cast(l_quantity as int)",
    }),
    "hist": ("lineitem", {"bin": "cast(cast(l_quantity as int) as double)", "count": "cast(1.0 as double)"}),
    "names": ("customer", {"c_custkey": "c_custkey", "name": "c_name", "other": "c_mktsegment"}),
}

SEQUENCES = [(k, f"chr{k + 1}", 2_000_000) for k in range(5)]


def rounding(expression: str) -> str:
    """For Spark, which cuts a fraction off in a cast to int where DuckDB rounds it, halves to the even number."""
    return re.sub(r"cast\((l_quantity|l_extendedprice) as int\)", r"cast(rint(\1) as int)", expression)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    table, columns = COLUMNS[name]
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet").selectExpr(*[f"{rounding(e)} AS `{c}`" for c, e in columns.items()])
    if name == "hist":
        return df.groupBy("bin").agg(F.sum("count").alias("count"))
    if name == "variants":
        return df.withColumn("alts", F.split("alt", ",")).drop("alt")
    if name == "genotypes":
        return df.withColumn("gt", F.array("a1", "a2")).drop("a1", "a2")
    return df


def sequences(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SEQUENCES, "ref_index int, name string, length bigint")


def spanned(reads: DataFrame) -> DataFrame:
    """Reads with their alignment end."""
    return reads.withColumn("end", C.text_end(F.col("start"), F.col("cigar")))


def cte(*names: str) -> str:
    """The views as common table expressions for DuckDB."""
    parts = []
    for name in names:
        if name == "seqs":
            values = ", ".join(f"({i}, '{n}', {size}::BIGINT)" for i, n, size in SEQUENCES)
            parts.append(f"seqs(ref_index, name, length) AS (VALUES {values})")
            continue
        table, columns = COLUMNS[name]
        body = ", ".join(f'{e} AS "{c}"' for c, e in columns.items())
        if name == "bases":
            body = body.replace("'[^ACGTN]', '')", "'[^ACGTN]', '', 'g')")
        sql = f"SELECT {body} FROM {table}"
        if name == "hist":
            sql = f'SELECT bin, sum("count") AS "count" FROM ({sql}) GROUP BY bin'
        parts.append(f"{name} AS ({sql})")
    return "WITH RECURSIVE " + ", ".join(parts)

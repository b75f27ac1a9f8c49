"""A corpus pipeline of five stages over ``documents``; each stage works on all rows that its predecessor kept.

Each stage's result is written as Parquet in the shared folder and read again for the next. Rows with null columns, empty or very long texts,
repeated rows, tables without rows and further columns are handled as each operator's module says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stranda.llm import common, encoders, langid, line_dedup, near_copies, packing, quality


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without words, of mostly repeated passages, or outside their language's perplexity band go; a short text alone is no fault."""
    return quality.kept(docs, min_words=1)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language that can be told with some certainty go."""
    return langid.kept(docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that stand in ten documents or more go; every document stays."""
    return line_dedup.deduplicated(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: five-word shingles at a similarity of 0.8 or more."""
    return near_copies.kept(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 1024 tokens."""
    return packing.pack(docs, encoders.default_path("byte_bpe_50k.json"))


#: Scratch tables of the stage that ran last.
_left: list[str] = []


def alone(stage):
    """A stage that first frees the disks of what the stage before it left: that one's result is written by then, as these docs are read from it."""

    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        common.discard(spark, _left)
        before = common.scratch_count()
        rows = stage(spark, docs, sf_dir)
        _left[:] = common.made_since(before)
        return rows

    return run_stage


STAGES = [("quality rules", alone(quality_rules)), ("language ID", alone(language_id)), ("line dedup", alone(dedup_lines)), ("SimHash near-dedup", alone(near_dedup)), ("packing", alone(pack))]

#: The models of the first two stages can't be put in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    _left.clear()
    for name, stage in STAGES:
        out = common.scratch(spark, name.replace(" ", "-"), keep=True)
        rows = stage(spark, docs, sf_dir)
        rows.write.option("compression", "zstd").parquet(f"{out}/rows")
        docs = spark.read.schema(rows.schema).parquet(f"{out}/rows")
    return docs

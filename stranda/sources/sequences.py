"""FASTA, FASTQ, sequence dictionaries, chains and metrics files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stranda.functions import bases as B
from stranda.sources import lines

PIECE = 1 << 16


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(name, bases): names end at white space. A record is one row; see ``pieces`` for long contigs."""
    raw = spark.read.option("lineSep", "\n>").text(path).select(F.regexp_replace("value", "^>", "").alias("value")).filter(F.trim("value") != "")
    name = F.regexp_extract("value", r"^(\S*)", 1)
    body = F.regexp_replace(F.regexp_replace("value", r"^[^\n]*\n?", ""), r"\s", "")
    return raw.select(name.alias("name"), body.alias("bases"))


def pieces(fasta: DataFrame, size: int = PIECE) -> DataFrame:
    """(contig, offset, bases): contigs cut to pieces, so look-ups read no more than they need."""
    n = F.length("bases")
    offset = F.explode(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(size))).alias("offset")
    return fasta.select(F.col("name").alias("contig"), offset, "bases").select("contig", "offset", F.substring(F.col("bases"), F.col("offset") + 1, F.lit(size)).alias("bases"))


def subsequence(pieces_: DataFrame, regions: DataFrame, size: int = PIECE) -> DataFrame:
    """(contig, start, end, bases) of regions, from the pieces that they touch."""
    wanted = regions.select("contig", "start", "end").distinct().withColumn("k", F.explode(F.sequence(F.floor((F.col("start") - 1) / size), F.floor((F.col("end") - 1) / size))))
    joined = wanted.withColumn("offset", (F.col("k") * size).cast("int")).join(pieces_, ["contig", "offset"])
    low, high = F.greatest(F.col("start") - F.col("offset"), F.lit(1)), F.least(F.col("end") - F.col("offset"), F.lit(size))
    cut = joined.select("contig", "start", "end", "k", F.substring(F.col("bases"), low.cast("int"), (high - low + 1).cast("int")).alias("b"))
    return cut.groupBy("contig", "start", "end").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "b"))), lambda x: x["b"]), "").alias("bases"))


def fasta_dictionary(fasta: DataFrame) -> DataFrame:
    """(name, length, md5)."""
    return fasta.select("name", F.length("bases").cast("long").alias("length"), B.md5(F.col("bases")).alias("md5"))


def write_fasta(fasta: DataFrame, path: str, width: int = 80) -> None:
    wrapped = F.regexp_replace("bases", f"(.{{{width}}})(?=.)", "$1\n")
    fasta.select(F.concat(F.lit(">"), F.col("name"), F.lit("\n"), wrapped).alias("value")).write.text(path)


def read_fasta_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("sep", "\t").schema("name string, length bigint, offset bigint, bases_per_line int, bytes_per_line int").csv(path)


def read_fastq(spark: SparkSession, path: str, skip_blank: bool = False) -> DataFrame:
    """(name, bases, qual_header, quals): records of four lines; a read with unlike lengths gives an error."""
    rows = lines.numbered(spark, path, skip_blank).withColumn("r", F.floor(F.col("line") / 4))
    pick = lambda k: F.max(F.when(F.col("line") % 4 == k, F.col("value")))
    four = rows.groupBy("file", "r").agg(pick(0).alias("h"), pick(1).alias("bases"), pick(2).alias("p"), pick(3).alias("quals")).filter("quals is not null or bases is not null or h <> ''")
    bad = ~F.coalesce(F.col("h").startswith("@") & F.col("p").startswith("+") & (F.length("bases") == F.length("quals")), F.lit(False))
    name = F.when(bad, F.raise_error(F.concat(F.lit("not a read: "), F.coalesce("h", F.lit("")))).cast("string")).otherwise(F.substring("h", 2, 1 << 30))
    return four.select(name.alias("name"), "bases", F.nullif(F.substring("p", 2, 1 << 30), F.lit("")).alias("qual_header"), "quals")


def write_fastq(reads: DataFrame, path: str) -> None:
    plus = F.coalesce(F.col("qual_header"), F.lit("")) if "qual_header" in reads.columns else F.lit("")
    reads.select(F.concat(F.lit("@"), "name", F.lit("\n"), "bases", F.lit("\n+"), plus, F.lit("\n"), "quals").alias("value")).write.text(path)


def fastq_of_reads(reads: DataFrame) -> DataFrame:
    """Reads as they came from the machine: those on the reverse strand are turned back; paired names end in /1 or /2."""
    from stranda.functions import flags

    negative = F.col("flag").bitwiseAND(16) != 0
    return reads.select(flags.paired_name(F.col("read_name"), F.col("flag")).alias("name"), F.when(negative, B.reverse_complement(F.col("bases"))).otherwise(F.col("bases")).alias("bases"), F.lit(None).cast("string").alias("qual_header"), F.when(negative, F.reverse("quals")).otherwise(F.col("quals")).alias("quals"))


def unmapped_of_fastq(fastq: DataFrame) -> DataFrame:
    return fastq.select(B.name_from_header(F.col("name")).alias("read_name"), F.lit(4).alias("flag"), F.lit(None).cast("string").alias("ref"), F.lit(0).alias("start"), F.lit(0).alias("mapq"), F.lit("*").alias("cigar"), F.lit(None).cast("string").alias("mate_ref"), F.lit(0).alias("mate_start"), F.lit(0).alias("tlen"), "bases", "quals", F.create_map().cast("map<string,string>").alias("tags"))


def read_chain(spark: SparkSession, path: str) -> DataFrame:
    """Blocks for ``lift_over``: each row of a chain adds a block; source positions are 1-based and closed, target ones 0-based.

    Chain files hold some ten thousand lines, so running sums go over the file in order.
    """
    rows = lines.numbered(spark, path).filter((F.trim("value") != "") & ~F.col("value").startswith("#"))
    t = F.split(F.trim("value"), r"\s+")
    head = F.when(F.col("value").startswith("chain"), t)
    in_file = Window.partitionBy("file").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    marked = rows.select("file", "line", F.last(head, ignorenulls=True).over(in_file).alias("h"), F.sum(head.isNotNull().cast("int")).over(in_file).alias("k"), t.alias("t"), head.isNull().alias("block")).filter("block")
    at = lambda c, i: F.get(F.col(c), F.lit(i))
    size, dt, dq = at("t", 0).cast("long"), F.coalesce(at("t", 1).cast("long"), F.lit(0)), F.coalesce(at("t", 2).cast("long"), F.lit(0))
    before = Window.partitionBy("file", "k").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    source = at("h", 5).cast("long") + F.coalesce(F.sum(size + dt).over(before), F.lit(0))
    target = at("h", 10).cast("long") + F.coalesce(F.sum(size + dq).over(before), F.lit(0))
    return marked.select(F.col("k").cast("int").alias("chain"), at("h", 2).alias("from_contig"), (source + 1).alias("from_start"), (source + size).alias("from_end"), at("h", 7).alias("to_contig"), target.alias("to_start"), (at("h", 9) == "-").alias("to_negative"), at("h", 8).cast("long").alias("to_size"))


def read_metrics(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(metrics rows, histogram rows), as strings, of a small metrics file: both tables follow their ##-lines up to a blank line."""
    rows = [r.value for r in lines.numbered(spark, path).orderBy("line").collect()]

    def table(mark: str) -> DataFrame:
        at = next((i for i, r in enumerate(rows) if r.startswith(mark)), None)
        if at is None:
            return spark.createDataFrame([], "empty string")
        body = []
        for r in rows[at + 1 :]:
            if not r.strip():
                break
            body.append(r.split("\t"))
        names = body[0]
        return spark.createDataFrame([[x or None for x in r] + [None] * (len(names) - len(r)) for r in body[1:]], ", ".join(f"`{n}` string" for n in names))

    return table("## METRICS CLASS"), table("## HISTOGRAM")


def write_metrics(metrics: DataFrame, path: str, name: str, histogram: DataFrame | None = None) -> None:
    """A metrics file: one table, and a histogram if there is one; both are small by nature."""
    from stranda.functions import text

    def cells(df: DataFrame) -> DataFrame:
        shown = [F.coalesce(text.metric_text(F.col(c)) if k in ("double", "float") else text.metric_flag(F.col(c)) if k == "boolean" else F.col(c).cast("string"), F.lit("")) for c, k in df.dtypes]
        return df.select(F.concat_ws("\t", *shown).alias("value"))

    head = [f"## METRICS CLASS\t{name}", "\t".join(metrics.columns), *(r.value for r in cells(metrics).collect()), ""]
    if histogram is not None:
        head += ["## HISTOGRAM\tdouble", "\t".join(histogram.columns), *(r.value for r in cells(histogram.orderBy(histogram.columns[0])).collect()), ""]
    spark = metrics.sparkSession
    spark.createDataFrame([(i, h) for i, h in enumerate(head)], "i int, value string").coalesce(1).sortWithinPartitions("i").select("value").write.text(path)


def fasta_index(spark: SparkSession, path: str) -> DataFrame:
    """(name, length, offset, bases_per_line, bytes_per_line) of line-wrapped files with line feeds: where each contig's bases begin."""
    rows = lines.numbered(spark, path).select("file", "line", "value", (F.octet_length("value") + 1).alias("bytes"), F.col("value").startswith(">").alias("head"))
    in_file = Window.partitionBy("file").orderBy("line")
    # Files of references hold few lines for each contig when wrapped widely; sums go over a file in order.
    placed = rows.withColumns({"at": F.coalesce(F.sum("bytes").over(in_file.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "k": F.sum(F.col("head").cast("int")).over(in_file.rowsBetween(Window.unboundedPreceding, 0))})
    body = F.when(~F.col("head"), F.octet_length("value"))
    out = placed.groupBy("file", "k").agg(
        F.max(F.when(F.col("head"), F.regexp_extract("value", r"^>(\S*)", 1))).alias("name"), F.coalesce(F.sum(body), F.lit(0)).alias("length"), F.min(F.when(~F.col("head"), F.col("at"))).alias("offset"), F.max(body).alias("bases_per_line")
    )
    return out.filter("name is not null").select("name", "length", "offset", "bases_per_line", (F.col("bases_per_line") + 1).alias("bytes_per_line"))


def read_bundle(text: str) -> dict[str, dict]:
    """The resources of a bundle's JSON by type; fails on a missing schema or primary resource."""
    import json

    data = json.loads(text)
    if "version" not in data.get("schema", {}):
        raise ValueError("not a bundle")
    primary = data.get("primary")
    out = {k: v for k, v in data.items() if k not in ("schema", "primary")}
    if primary not in out:
        raise ValueError("a bundle names its primary resource")
    return out

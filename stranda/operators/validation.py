"""Data-quality rules as one row for each finding, and summaries of them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stranda import schema as S
from stranda.functions import cigar as C
from stranda.functions import flags, variants

MAX_INSERT = 1 << 29


def read_rules() -> dict[str, tuple[str, Column, set[str]]]:
    """Rule names with severity, a Column that is true where a read breaks the rule, and the columns that it needs."""
    flag = F.col("flag")
    has = lambda bit: flags.has(flag, bit)
    unpaired = ~has(S.PAIRED)
    parts = C.elements(F.col("cigar"))
    rules = {
        "INVALID_FLAG_PROPER_PAIR": ("ERROR", unpaired & has(S.PROPER), {"flag"}),
        "INVALID_FLAG_MATE_UNMAPPED": ("ERROR", unpaired & has(S.MATE_UNMAPPED), {"flag"}),
        "INVALID_FLAG_MATE_NEG_STRAND": ("ERROR", unpaired & has(S.MATE_REVERSE), {"flag"}),
        "INVALID_FLAG_FIRST_OF_PAIR": ("ERROR", unpaired & has(S.FIRST), {"flag"}),
        "INVALID_FLAG_SECOND_OF_PAIR": ("ERROR", unpaired & has(S.SECOND), {"flag"}),
        "PAIRED_READ_NOT_MARKED_AS_FIRST_OR_SECOND": ("ERROR", has(S.PAIRED) & ~has(S.FIRST | S.SECOND), {"flag"}),
        "INVALID_FLAG_NOT_PRIM_ALIGNMENT": ("ERROR", has(S.UNMAPPED) & has(S.SECONDARY), {"flag"}),
        "INVALID_FLAG_SUPPLEMENTARY_ALIGNMENT": ("ERROR", has(S.UNMAPPED) & has(S.SUPPLEMENTARY), {"flag"}),
        "INVALID_MAPPING_QUALITY": ("ERROR", (has(S.UNMAPPED) & (F.col("mapq") != 0)) | (~has(S.UNMAPPED) & (F.col("mapq") >= 256)), {"flag", "mapq"}),
        "INVALID_CIGAR": ("ERROR", ~has(S.UNMAPPED) & ~F.coalesce(C.is_sound(F.col("cigar")), F.lit(False)), {"cigar", "flag"}),
        "INVALID_INSERT_SIZE": ("ERROR", F.abs(F.col("tlen")) > MAX_INSERT, {"tlen"}),
        "MISMATCH_CIGAR_SEQ_LENGTH": ("ERROR", ~has(S.UNMAPPED) & (F.col("bases") != "*") & (C.read_length(parts) != F.length("bases")), {"bases", "cigar", "flag"}),
        "MISMATCH_SEQ_QUAL_LENGTH": ("ERROR", (F.col("bases") != "*") & (F.col("quals") != "*") & (F.length("bases") != F.length("quals")), {"bases", "quals"}),
        "EMPTY_READ": ("WARNING", F.length("bases") == 0, {"bases"}),
        "RECORD_MISSING_READ_GROUP": ("WARNING", F.col("tags")["RG"].isNull(), {"tags"}),
        "MISSING_TAG_NM": ("WARNING", ~has(S.UNMAPPED) & F.col("tags")["NM"].isNull(), {"flag", "tags"}),
    }
    return rules


def findings(rows: DataFrame, rules: dict[str, tuple[str, Column, set[str]]], keys: list[str]) -> DataFrame:
    """(keys, rule, severity): rules whose columns a table lacks are left out. Only rows that break a rule are looked at one by one."""
    have = set(rows.columns)
    usable = {n: (severity, column) for n, (severity, column, needs) in rules.items() if needs <= have}
    hits = F.array(*[F.when(c, F.struct(F.lit(n).alias("rule"), F.lit(s).alias("severity"))) for n, (s, c) in usable.items()])
    broken = reduce(lambda a, b: a | b, [F.coalesce(c, F.lit(False)) for _, c in usable.values()], F.lit(False))
    return rows.filter(broken).select(*keys, F.explode(F.filter(hits, lambda x: x.isNotNull())).alias("f")).select(*keys, "f.rule", "f.severity")


def summary(found: DataFrame) -> DataFrame:
    return found.groupBy("severity", "rule").agg(F.count("*").alias("n"))


def mate_findings(pairs: DataFrame) -> DataFrame:
    """Disagreements between the ends of pairs (structs a and b)."""
    a, b = (lambda c: F.col(f"a.{c}")), (lambda c: F.col(f"b.{c}"))
    checks = {
        "MISMATCH_FLAG_MATE_NEG_STRAND": flags.has(a("flag"), S.MATE_REVERSE) != flags.has(b("flag"), S.REVERSE),
        "MISMATCH_FLAG_MATE_UNMAPPED": flags.has(a("flag"), S.MATE_UNMAPPED) != flags.has(b("flag"), S.UNMAPPED),
        "MISMATCH_MATE_ALIGNMENT_START": a("mate_start") != b("start"),
        "MISMATCH_MATE_REF_INDEX": a("mate_ref") != b("ref"),
    }
    hits = F.array(*[F.when(c, F.lit(n)) for n, c in checks.items()])
    return pairs.select(F.col("a.read_name").alias("read_name"), F.explode(F.filter(hits, lambda x: x.isNotNull())).alias("rule"))


def mates_missing(reads: DataFrame) -> DataFrame:
    """Templates with a paired primary end but not both."""
    primary = reads.filter(flags.has(F.col("flag"), S.PAIRED) & ~flags.has(F.col("flag"), S.SECONDARY | S.SUPPLEMENTARY))
    ends = primary.groupBy("read_name").agg(F.max(flags.has(F.col("flag"), S.FIRST)).alias("one"), F.max(flags.has(F.col("flag"), S.SECOND)).alias("two"))
    return ends.filter(~(F.col("one") & F.col("two"))).select("read_name")


def variant_rules() -> dict[str, tuple[str, Column, set[str]]]:
    return {
        "NO_REFERENCE": ("ERROR", F.length("ref") == 0, {"ref"}),
        "UNACCEPTABLE_REFERENCE": ("ERROR", ~variants.acceptable(F.col("ref"), F.lit(True)), {"ref"}),
        "UNACCEPTABLE_ALTERNATE": ("ERROR", F.exists("alts", lambda a: ~variants.acceptable(a, F.lit(False))), {"alts"}),
        "DUPLICATE_ALLELE": ("ERROR", F.size(F.array_distinct(F.concat(F.array("ref"), "alts"))) != F.size("alts") + 1, {"ref", "alts"}),
        "STOP_MISMATCH": ("ERROR", ~F.exists("alts", lambda a: variants.is_symbolic(a)) & (F.col("stop") != F.col("start") + F.length("ref") - 1), {"ref", "alts", "start", "stop"}),
    }


def quality_encoding(quals: DataFrame, column: str = "quals") -> DataFrame:
    """The range of quality characters and the schemes that it allows: Standard 33-126, Solexa 59-126, Illumina 64-126."""
    lowest = F.min(F.array_min(F.transform(F.split(column, ""), lambda c: F.ascii(c))))
    highest = F.max(F.array_max(F.transform(F.split(column, ""), lambda c: F.ascii(c))))
    out = quals.filter(F.length(column) > 0).agg(lowest.alias("lowest"), highest.alias("highest"))
    best = F.when(F.col("lowest") < 59, "Standard").when(F.col("lowest") < 64, "Solexa").otherwise("Illumina")
    return out.select("lowest", "highest", best.alias("scheme"))


def read_group_checksum(groups: DataFrame) -> DataFrame:
    """MD5 over all read groups (id, attributes map) sorted by id: keys and values in key order, without the id."""
    entry = F.array_join(F.transform(F.array_sort(F.map_entries("attributes")), lambda e: F.concat(e["key"], e["value"])), "")
    rows = F.transform(F.array_sort(F.collect_list(F.struct("id", entry.alias("t")))), lambda r: r["t"])
    return groups.agg(F.md5(F.array_join(rows, "").cast("binary")).alias("checksum"))


def allele_count_findings(sites: DataFrame, counts: DataFrame, *site: str) -> DataFrame:
    """Sites whose reported AC or AN (columns ac and an) differ from those counted from genotypes (counted_ac, counted_an)."""
    both = sites.join(counts, list(site))
    hits = F.array(F.when(F.col("ac") != F.col("counted_ac"), F.lit("AC_MISMATCH")), F.when(F.col("an") != F.col("counted_an"), F.lit("AN_MISMATCH")))
    return both.select(*site, F.explode(F.filter(hits, lambda x: x.isNotNull())).alias("rule"))


def reference_findings(sites: DataFrame, reference: DataFrame) -> DataFrame:
    """Sites whose REF differs from the reference's bases (contig, start, end, bases at the sites)."""
    both = sites.join(reference.select("contig", "start", "bases"), ["contig", "start"])
    return both.filter(F.upper("ref") != F.upper("bases")).select("contig", "start", "ref", "bases")


def header_findings(header: DataFrame) -> DataFrame:
    """(rule, value) over header lines (kind, fields): missing version, sequences or platform, and ids that occur twice."""
    rg, sq = header.filter("kind = 'RG'"), header.filter("kind = 'SQ'")
    twice = lambda rows, key, rule: rows.groupBy(F.col("fields")[key].alias("value")).count().filter("count > 1").select(F.lit(rule).alias("rule"), "value")
    none = lambda rows, rule: rows.agg(F.count("*").alias("n")).filter("n = 0").select(F.lit(rule).alias("rule"), F.lit(None).cast("string").alias("value"))
    platform = rg.filter(F.col("fields")["PL"].isNull()).select(F.lit("MISSING_PLATFORM_VALUE").alias("rule"), F.col("fields")["ID"].alias("value"))
    version = header.filter("kind = 'HD'").filter(F.col("fields")["VN"].isNull()).select(F.lit("MISSING_VERSION_NUMBER").alias("rule"), F.lit(None).cast("string").alias("value"))
    return none(sq, "MISSING_SEQUENCE_DICTIONARY").unionByName(none(rg, "MISSING_READ_GROUP")).unionByName(platform).unionByName(version).unionByName(twice(rg, "ID", "DUPLICATE_READ_GROUP_ID")).unionByName(twice(sq, "SN", "DUPLICATE_SEQUENCE_NAME"))


def compare_reads(a: DataFrame, b: DataFrame, keys: tuple[str, ...] = ("read_name", "flag"), columns: tuple[str, ...] | None = None) -> DataFrame:
    """Records of two files that differ: (keys, column) for each column, or ``only in`` one file."""
    names = [c for c in (columns or a.columns) if c not in keys]
    left, right = a.select(*keys, F.struct(*names).alias("x")), b.select(*keys, F.struct(*names).alias("y"))
    both = left.join(right, list(keys), "full")
    differ = [F.when(F.col("x").isNotNull() & F.col("y").isNotNull() & ~F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}")), F.lit(c)) for c in names]
    hits = F.array(F.when(F.col("y").isNull(), F.lit("only in first")), F.when(F.col("x").isNull(), F.lit("only in second")), *differ)
    return both.select(*keys, F.explode(F.filter(hits, lambda h: h.isNotNull())).alias("column"))

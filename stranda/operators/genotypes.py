"""Sites and genotypes in long form: (site keys, sample, gt array<int>, ...), and expression filters."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stranda.functions import variants as V

TYPES = ["NO_CALL", "HOM_REF", "HET", "HOM_VAR", "MIXED", "UNAVAILABLE"]


def type_counts(genotypes: DataFrame, *site: str) -> DataFrame:
    kind = V.genotype_type(F.col("gt"))
    return genotypes.withColumn("__kind", kind).groupBy(*site).agg(*[F.count(F.when(F.col("__kind") == t, 1)).alias(t.lower()) for t in TYPES])


def chromosome_count(genotypes: DataFrame, *site: str) -> DataFrame:
    return genotypes.groupBy(*site).agg(F.sum(F.size(V.called(F.col("gt")))).alias("an"))


def allele_counts(genotypes: DataFrame, *site: str) -> DataFrame:
    """(site, allele, count) over called alleles."""
    return genotypes.select(*site, F.explode(V.called(F.col("gt"))).alias("allele")).groupBy(*site, "allele").agg(F.count("*").alias("count"))


def ac_an_af(genotypes: DataFrame, *site: str, founders: list | None = None) -> DataFrame:
    """(site, allele, ac, an, af) for each alternate allele seen; AF is taken among founders, if there are some."""
    used = F.lit(True) if not founders else F.col("sample").isin(founders)
    rows = genotypes.select(*site, used.alias("__founder"), F.explode(V.called(F.col("gt"))).alias("allele"))
    each = rows.groupBy(*site, "allele").agg(F.count("*").alias("ac"), F.count(F.when(F.col("__founder"), 1)).alias("fc"))
    totals = each.groupBy(*site).agg(F.sum("ac").alias("an"), F.sum("fc").alias("fn"))
    af = F.when(F.col("fn") == 0, 0.0).otherwise(F.col("fc") / F.col("fn"))
    return each.filter("allele > 0").join(totals, list(site)).select(*site, "allele", "ac", "an", af.alias("af"))


def top_alternate(genotypes: DataFrame, *site: str) -> DataFrame:
    """The alternate allele with the highest count, the first of several."""
    counts = allele_counts(genotypes, *site).filter("allele > 0")
    return counts.groupBy(*site).agg(F.max(F.struct("count", (-F.col("allele")).alias("a"))).alias("m")).select(*site, (-F.col("m.a")).alias("allele"), F.col("m.count").alias("ac"))


def max_ploidy(genotypes: DataFrame, *site: str, default: int = 2) -> DataFrame:
    n = F.max(F.size("gt"))
    return genotypes.groupBy(*site).agg(F.when(n > 0, n).otherwise(default).alias("ploidy"))


def is_monomorphic(genotypes: DataFrame, *site: str) -> DataFrame:
    return genotypes.groupBy(*site).agg(F.min(F.forall(V.called(F.col("gt")), lambda a: a == 0)).alias("monomorphic"))


def hardy_weinberg(genotypes: DataFrame, *site: str) -> DataFrame:
    c = type_counts(genotypes, *site)
    return c.withColumn("p", V.hwe(F.col("hom_ref"), F.col("het"), F.col("hom_var")))


# Filters that keep rows on true.


def genotype_quality(least: int) -> Column:
    return F.col("gq") >= least


def heterozygous(keep: bool = True) -> Column:
    het = V.genotype_type(F.col("gt")) == "HET"
    return het if keep else ~het


def passing() -> Column:
    return F.coalesce(F.size("filters") == 0, F.lit(True)) | F.col("filters").isNull()


def snp() -> Column:
    return V.variant_type(F.col("ref"), F.col("alts")) == "SNP"


def compound(parts: list[Column], every: bool = True) -> Column:
    """All, or any, of several; of none: true."""
    out = F.lit(True) if every or not parts else parts[0]
    for p in parts if every else parts[1:]:
        out = out & p if every else out | p
    return out


# Expressions.

SITE = {
    "CHROM": "contig",
    "POS": "start",
    "QUAL": "qual",
    "N_ALLELES": "size(alts) + 1",
    "TYPE": None,
}
TOKEN = re.compile(r"\"[^\"]*\"|'[^']*'|&&|\|\||==|!=|<=|>=|=~|!~|[A-Za-z_][A-Za-z_0-9.]*|[0-9.]+(?:[eE][-+]?[0-9]+)?|\S")
WORDS = {"&&": "AND", "||": "OR", "==": "=", "!=": "<>", "and": "AND", "or": "OR", "not": "NOT", "!": "NOT", "eq": "=", "ne": "<>", "lt": "<", "le": "<=", "gt": ">", "ge": ">=", "=~": "RLIKE"}


COMPARED = {"==", "!=", "<", "<=", ">", ">=", "=~", "!~", "eq", "ne", "lt", "le", "gt", "ge"}
ATTRIBUTE = re.compile(r"""vc\.(has|get)Attribute(?:AsString|AsInt|AsDouble)?\(\s*["']([^"']+)["']\s*(?:,[^()]*)?\)""")
GENOTYPE = re.compile(r"""vc\.getGenotype\(\s*["']([^"']+)["']\s*\)\.(?:get|is)([A-Za-z]+)\(\)""")
#: What can be asked of one sample's genotype, over its entry ``g`` of the genotypes.
OF_GENOTYPE = {
    "GQ": "try_cast(g.fields['GQ'] AS double)",
    "DP": "try_cast(g.fields['DP'] AS double)",
    "Het": "size(array_distinct(split(g.fields['GT'], '[/|]'))) > 1 AND NOT contains(g.fields['GT'], '.')",
    "HomRef": "NOT g.fields['GT'] RLIKE '[^0/|]'",
    "HomVar": "size(array_distinct(split(g.fields['GT'], '[/|]'))) = 1 AND NOT g.fields['GT'] RLIKE '^[0.]'",
    "NoCall": "NOT g.fields['GT'] RLIKE '[^./|]'",
    "Phased": "contains(g.fields['GT'], '|')",
}


def translate(expression: str, columns: dict[str, str], info: str | None = "info", missing: str = "mismatch", genotypes: str | None = None) -> Column:
    """A boolean expression in the common expression language of variant filters, as a Column.

    Names are bound to columns, then to entries of the INFO map. An entry is compared as text where the other side is a string or a pattern, as a
    number otherwise; alone, it stands for a flag. ``vc.hasAttribute("X")``, ``vc.getAttribute("X")``, calls without arguments of bound names
    (``vc.isSNP()``), and, where ``genotypes`` names that column, ``vc.getGenotype("sample").isHet()`` and the like are understood.
    ``missing``: what a missing value makes of it: mismatch, match or throw.
    """
    held: list[str] = []  # SQL that stands for a whole call; its token is its number

    def hold(sql: str) -> str:
        held.append(sql)
        return f" __held{len(held) - 1} "

    def attribute(m: re.Match) -> str:
        if info is None:
            raise ValueError(f"{m[2]} isn't known")
        return hold(f"({info}['{m[2]}'] IS NOT NULL)") if m[1] == "has" else f" {m[2]} "

    def genotype(m: re.Match) -> str:
        if genotypes is None or m[2] not in OF_GENOTYPE:
            raise ValueError(f"{m[0]} isn't known")
        return hold(f"(get(transform(filter({genotypes}, g -> g.sample = '{m[1]}'), g -> {OF_GENOTYPE[m[2]]}), 0))")

    tokens = TOKEN.findall(re.sub(r"([A-Za-z_0-9])\(\)", r"\1", GENOTYPE.sub(genotype, ATTRIBUTE.sub(attribute, expression))))
    beside = lambda i, k: tokens[i + k] if 0 <= i + k < len(tokens) else ""
    out = []
    for i, token in enumerate(tokens):
        name = token.removeprefix("vc.")
        if token.startswith("__held"):
            out.append(held[int(token[6:])])
        elif token == "!~":
            out.append("NOT RLIKE")
        elif token in WORDS:
            out.append(WORDS[token])
        elif token[0] in "\"'":
            out.append("'" + token[1:-1].replace("'", "''") + "'")
        elif name in columns:
            out.append(f"({columns[name]})")
        elif re.match(r"[A-Za-z_]", token) and token not in ("true", "false"):
            if info is None:
                raise ValueError(f"{token} isn't known")
            other = beside(i, 2) if beside(i, 1) in COMPARED else beside(i, -2) if beside(i, -1) in COMPARED else None
            entry = f"{info}['{name}']"
            if other is None and all(t in ("", "&&", "||", "!", "and", "or", "not", "(", ")") for t in (beside(i, -1), beside(i, 1))):
                out.append(f"coalesce({entry} = 'true', false)")
            elif "=~" in (beside(i, 1), beside(i, -1)) or "!~" in (beside(i, 1), beside(i, -1)) or (other or " ")[0] in "\"'":
                out.append(entry)
            else:
                out.append(f"try_cast({entry} AS double)")
        else:
            out.append(token)
    value = F.expr(" ".join(out)).cast("boolean")
    if missing == "throw":
        return F.when(value.isNull(), F.raise_error(F.lit(f"a value is missing in {expression}")).cast("boolean")).otherwise(value)
    return F.coalesce(value, F.lit(missing == "match"))

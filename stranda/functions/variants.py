"""Alleles, variant types, genotypes and likelihoods. A genotype is an array of allele numbers; -1 or null is a no-call."""

from __future__ import annotations

import math
from itertools import combinations_with_replacement

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

NON_REF = ("<NON_REF>", "<*>")
STRUCTURAL = 150
MOST_PL = 2147483647


def is_symbolic(allele: Column) -> Column:
    return allele.rlike(r"^<.*>$") | is_breakend(allele)


def is_breakend(allele: Column) -> Column:
    return allele.rlike(r"[\[\]]") | allele.rlike(r"^\..+|.+\.$")


def is_spanning_deletion(allele: Column) -> Column:
    return allele == "*"


def is_no_call_allele(allele: Column) -> Column:
    return allele == "."


def acceptable(allele: Column, is_ref: Column) -> Column:
    return F.when(is_ref, allele.rlike("^[ACGTNacgtn]+$")).otherwise(allele.rlike(r"^([ACGTNacgtn]+|\*|\.)$") | is_symbolic(allele))


def biallelic_type(ref: Column, alt: Column) -> Column:
    return F.when(is_symbolic(alt), "SYMBOLIC").when(F.length(ref) == F.length(alt), F.when(F.length(alt) == 1, "SNP").otherwise("MNP")).otherwise("INDEL")


def variant_type(ref: Column, alts: Column, ignore_non_ref: bool = False) -> Column:
    """NO_VARIATION, SNP, MNP, INDEL, SYMBOLIC or MIXED."""
    seen = F.filter(alts, lambda a: ~a.isin(*NON_REF)) if ignore_non_ref else alts
    kinds = F.array_distinct(F.transform(seen, lambda a: biallelic_type(ref, a)))
    return F.when(F.size(seen) == 0, "NO_VARIATION").when(F.size(kinds) == 1, F.get(kinds, F.lit(0))).otherwise("MIXED")


def is_simple_insertion(ref: Column, alts: Column) -> Column:
    alt = F.get(alts, F.lit(0))
    return (F.size(alts) == 1) & (variant_type(ref, alts) == "INDEL") & (F.length(ref) == 1) & (F.left(alt, F.lit(1)) == F.left(ref, F.lit(1)))


def is_simple_deletion(ref: Column, alts: Column) -> Column:
    alt = F.get(alts, F.lit(0))
    return (F.size(alts) == 1) & (variant_type(ref, alts) == "INDEL") & (F.length(alt) == 1) & (F.left(alt, F.lit(1)) == F.left(ref, F.lit(1)))


def is_complex_indel(ref: Column, alts: Column) -> Column:
    return (variant_type(ref, alts) == "INDEL") & ~is_simple_insertion(ref, alts) & ~is_simple_deletion(ref, alts)


def indel_lengths(ref: Column, alts: Column) -> Column:
    """Null unless the site is an indel or mixed."""
    return F.when(variant_type(ref, alts).isin("INDEL", "MIXED"), F.transform(alts, lambda a: F.length(a) - F.length(ref)))


def is_structural_indel(ref: Column, alts: Column) -> Column:
    return F.coalesce(F.exists(indel_lengths(ref, alts), lambda n: F.abs(n) > STRUCTURAL), F.lit(False))


def is_transition(ref: Column, alt: Column) -> Column:
    """A and G, or C and T; null unless both are single bases."""
    pair = F.concat(F.upper(ref), F.upper(alt))
    return F.when((F.length(ref) == 1) & (F.length(alt) == 1), pair.isin("AG", "GA", "CT", "TC"))


def stop_of(start: Column, ref: Column, info_end: Column) -> Column:
    return F.coalesce(info_end.cast("int"), start + F.length(ref) - 1)


def is_reference_block(alts: Column, info_end: Column) -> Column:
    return (F.size(alts) == 1) & F.get(alts, F.lit(0)).isin(*NON_REF) & info_end.isNotNull()


def filter_status(filters: Column) -> Column:
    """null: filters weren't applied; empty: passed; else filtered."""
    return F.when(filters.isNull(), "UNFILTERED").when(F.size(filters) == 0, "PASS").otherwise("FILTERED")


def phred_of_log10(log10_error: Column) -> Column:
    return -10.0 * log10_error


def vcf_double(text: Column) -> Column:
    """With the spellings of NaN and infinities that occur in files; a dot is null."""
    low = F.lower(text)
    return (
        F.when(low.isin(".", ""), None)
        .when(low.isin("nan", "+nan", "-nan"), float("nan"))
        .when(low.isin("inf", "+inf", "infinity", "+infinity"), float("inf"))
        .when(low.isin("-inf", "-infinity"), float("-inf"))
        .otherwise(F.expr("try_cast(null as double)") if text is None else text.try_cast("double"))
    )


def format_double(x: Column) -> Column:
    """Two digits from 1 on, three from 0.1, scientific for smaller ones; 0 as 0.00."""
    size = F.abs(x)
    return F.when(size >= 1, F.format_string("%.2f", x)).when(size >= 0.1, F.format_string("%.3f", x)).when(size < 1e-20, F.lit("0.00")).otherwise(F.format_string("%.3e", x))


def percent_decode(text: Column) -> Column:
    """The seven escapes of VCF 4.3."""
    out = text
    for code, char in (("%3A", ":"), ("%3B", ";"), ("%3D", "="), ("%2C", ","), ("%0D", "\r"), ("%0A", "\n"), ("%09", "\t"), ("%25", "%")):
        out = F.replace(out, F.lit(code), F.lit(char))
    return out


def called(gt: Column) -> Column:
    return F.filter(gt, lambda a: a.isNotNull() & (a >= 0))


def genotype_type(gt: Column) -> Column:
    """UNAVAILABLE, NO_CALL, MIXED, HET, HOM_REF or HOM_VAR."""
    n, seen = F.size(gt), called(gt)
    return (
        F.when(gt.isNull() | (n == 0), "UNAVAILABLE")
        .when(F.size(seen) == 0, "NO_CALL")
        .when(F.size(seen) < n, "MIXED")
        .when(F.size(F.array_distinct(seen)) > 1, "HET")
        .when(F.get(seen, F.lit(0)) == 0, "HOM_REF")
        .otherwise("HOM_VAR")
    )


def is_het_non_ref(gt: Column) -> Column:
    return (genotype_type(gt) == "HET") & ~F.array_contains(gt, 0)


def count_allele(gt: Column, allele: Column) -> Column:
    return F.size(F.filter(gt, lambda a: a == allele))


def gt_text(gt: Column, phased: Column) -> Column:
    return F.array_join(F.transform(gt, lambda a: F.when(a.isNull() | (a < 0), ".").otherwise(a.cast("string"))), F.lit("|")) if phased is True else F.when(phased, F.array_join(_alleles(gt), "|")).otherwise(F.array_join(_alleles(gt), "/"))


def _alleles(gt: Column) -> Column:
    return F.transform(gt, lambda a: F.when(a.isNull() | (a < 0), ".").otherwise(a.cast("string")))


def parse_gt(text: Column) -> Column:
    return F.transform(F.split(text, r"[/|]"), lambda a: F.when(a == ".", -1).otherwise(a.try_cast("int")))


def same_genotype(a: Column, b: Column, ignore_phase: bool = True) -> Column:
    return F.array_sort(a) == F.array_sort(b) if ignore_phase else a == b


def pl_index(j: Column, k: Column) -> Column:
    """Place of the diploid genotype of alleles j and k."""
    low, high = F.least(j, k), F.greatest(j, k)
    return (high * (high + 1) / 2).cast("int") + low


def pl_alleles(index: Column) -> Column:
    """The inverse, as a struct (j, k) with j <= k."""
    k = F.floor((F.sqrt(8.0 * index + 1.0) - 1.0) / 2.0).cast("int")
    return F.struct((index - (k * (k + 1) / 2).cast("int")).cast("int").alias("j"), k.alias("k"))


def likelihoods_count(alleles: int, ploidy: int) -> int:
    return math.comb(alleles + ploidy - 1, ploidy)


def genotype_order(alleles: int, ploidy: int) -> list[tuple[int, ...]]:
    """Allele numbers of each likelihood, in the order in which they are stored."""
    return sorted(combinations_with_replacement(range(alleles), ploidy), key=lambda g: g[::-1])


def gls_to_pls(gl: Column) -> Column:
    best = F.array_max(gl)
    return F.transform(gl, lambda x: F.floor(F.least(-10.0 * (x - best), F.lit(float(MOST_PL))) + 0.5).cast("int"))


def pls_to_gls(pl: Column) -> Column:
    return F.transform(pl, lambda x: x / -10.0)


def non_informative(pl: Column) -> Column:
    return F.forall(pl, lambda x: x == 0)


def normalise_log10(gl: Column) -> Column:
    """Probabilities that add up to 1."""
    best = F.array_max(gl)
    raw = F.transform(gl, lambda x: F.pow(F.lit(10.0), x - best))
    total = F.aggregate(raw, F.lit(0.0), lambda acc, x: acc + x)
    return F.transform(raw, lambda x: x / total)


def log10_gq(gl: Column, index: Column) -> Column:
    """Minus the lead of the chosen likelihood over the best other; if it trails, log10 of 1 - its posterior."""
    mine = F.get(gl, index)
    others = F.filter(gl, lambda x, i: i != index)
    lead = mine - F.array_max(others)
    return F.when(lead >= 0, -lead).otherwise(F.log10(1.0 - F.get(normalise_log10(gl), index)))


#: Heterozygote counts that are laid out at once.
HWE_CELLS = 1 << 20


def hwe_all(aa: np.ndarray, ab: np.ndarray, bb: np.ndarray) -> np.ndarray:
    """Two-sided exact Hardy-Weinberg p of many sites; -1 for counts that can't be.

    Given the alleles, h heterozygotes come up with a probability in proportion to n! 2^h / (hom! h! hom'!), for h of the rarer allele's parity. A
    tail holds the observed count too; p is twice the smaller tail, at most 1.
    """
    aa, ab, bb = (np.asarray(x, dtype=np.int64) for x in (aa, ab, bb))
    out = np.full(len(aa), -1.0)
    n = aa + ab + bb
    usable = np.flatnonzero((np.minimum(np.minimum(aa, ab), bb) >= 0) & (n > 0))
    if not len(usable):
        return out
    factorial = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, n[usable].max() + 1)))])
    rare = 2 * np.minimum(aa, bb) + ab
    width = rare // 2 + 1
    ends = np.cumsum(width[usable])
    for some in np.split(usable, np.flatnonzero(np.diff(ends // HWE_CELLS)) + 1):
        w = width[some]
        starts = np.cumsum(w) - w
        site = np.repeat(some, w)
        h = rare[site] % 2 + 2 * (np.arange(len(site)) - np.repeat(starts, w))
        low = (rare[site] - h) // 2
        logs = h * np.log(2.0) - factorial[h] - factorial[low] - factorial[n[site] - h - low]
        p = np.exp(logs - np.repeat(np.maximum.reduceat(logs, starts), w))
        total = np.add.reduceat(p, starts)
        upper, lower = (np.add.reduceat(np.where(side, p, 0.0), starts) / total for side in (h >= ab[site], h <= ab[site]))
        out[some] = np.minimum(1.0, 2 * np.minimum(upper, lower))
    return out


def hwe_of(aa: int, ab: int, bb: int) -> float:
    return float(hwe_all([aa], [ab], [bb])[0])


@pandas_udf(T.DoubleType())
def hwe(aa: pd.Series, ab: pd.Series, bb: pd.Series) -> pd.Series:
    """Exact test over one row for each site, a batch of sites at a time."""
    return pd.Series(hwe_all(aa.to_numpy(), ab.to_numpy(), bb.to_numpy()))


def binomial(n: int, k: int) -> int:
    return math.comb(n, k)

"""Column functions against plain Python."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from stranda.functions import bases, cigar, coords, flags, qualities, text, variants


def column(spark, rows, schema, expression):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, " + schema)
    return [r.out for r in df.select("i", expression.alias("out")).orderBy("i").collect()]


def parse(c):
    return [(int(n), o) for n, o in re.findall(r"(\d+)([MIDNSHP=X])", c)]


def random_cigars(n=60):
    rng = random.Random(1)
    out = ["*", "10M", "5H5S10M2I3M4D7M3S2H", "3S10M", "4M100N6M", "5=1X4="]
    for _ in range(n):
        core = "".join(f"{rng.randint(1, 9)}{o}" for o in rng.sample("MIDN=X", rng.randint(1, 4)))
        out.append(rng.choice(["", "2S", "3H", "1H2S"]) + core + rng.choice(["", "4S", "2S1H"]))
    return out


def test_cigar_lengths_and_clips(spark):
    cs = random_cigars()
    rows = [(c,) for c in cs]
    e = cigar.elements(F.col("c"))
    total = lambda c, ops: sum(n for n, o in parse(c) if o in ops)
    assert column(spark, rows, "c string", cigar.reference_length(e)) == [total(c, "MDN=X") for c in cs]
    assert column(spark, rows, "c string", cigar.read_length(e)) == [total(c, "MIS=X") for c in cs]
    assert column(spark, rows, "c string", cigar.text(e)) == cs
    lead = lambda c: sum(n for n, _ in parse(re.match(r"^((?:\d+[SH])*)", c)[1]))
    assert column(spark, rows, "c string", cigar.unclipped_start(F.lit(100), e)) == [100 - lead(c) for c in cs]
    trail = lambda c: sum(n for n, _ in parse(re.search(r"((?:\d+[SH])*)$", c)[1]))
    assert column(spark, rows, "c string", cigar.unclipped_end(F.lit(100), e)) == [99 + total(c, "MDN=X") + trail(c) for c in cs]
    assert column(spark, [("10Q",), ("",), (None,), ("M",)], "c string", e) == [None] * 4


def positions(start, c):
    """(read position, reference position) of aligned bases, 1-based."""
    read, ref, out = 1, start, []
    for n, o in parse(c):
        if o in "M=X":
            out += [(read + k, ref + k) for k in range(n)]
        read += n * (o in "MIS=X")
        ref += n * (o in "MDN=X")
    return out


def test_position_maps_and_blocks(spark):
    cs = random_cigars(20)
    e = cigar.elements(F.col("c"))
    grid = [(c, k) for c in cs for k in (1, 4, 9, 15)]
    by_read = {c: dict(positions(50, c)) for c in cs}
    by_ref = {c: {b: a for a, b in positions(50, c)} for c in cs}
    assert column(spark, grid, "c string, k int", cigar.ref_position(F.lit(50), e, F.col("k"))) == [by_read[c].get(k, 0) for c, k in grid]
    assert column(spark, grid, "c string, k int", cigar.read_position(F.lit(50), e, F.col("k") + 49)) == [by_ref[c].get(k + 49, 0) for c, k in grid]
    got = column(spark, [(c,) for c in cs], "c string", cigar.blocks(F.lit(50), e))
    for c, blocks in zip(cs, got, strict=True):
        assert [(b.read_start + k, b.ref_start + k) for b in blocks for k in range(b.len)] == positions(50, c)


def test_clipping_and_errors(spark):
    clip = cigar.text(cigar.clip_from(cigar.elements(F.col("c")), F.col("k")))
    rows = [("10M", 6), ("5M2I5M", 6), ("5M3D5M", 6), ("4S6M", 8), ("8M2S", 5), ("8M2S3H", 5), ("2H8M", 5)]
    assert column(spark, rows, "c string, k int", clip) == ["5M5S", "5M7S", "5M5S", "4S3M3S", "4M6S", "4M6S3H", "2H4M4S"]
    hard = cigar.text(cigar.clip_from(cigar.elements(F.col("c")), F.col("k"), "H"))
    assert column(spark, rows[:1] + rows[5:6], "c string, k int", hard) == ["5M5H", "4M9H"]
    bad = column(spark, [("10M",), ("0M",), ("5M2H5M",), ("5M2S5M",), ("1P5M",), ("5M2I1I5M",), ("5S",), ("1H2S5M2S1H",)], "c string", F.array_join(cigar.errors(cigar.elements(F.col("c"))), ","))
    assert bad == ["", "ZERO_LENGTH", "HARD_CLIP_PLACE", "SOFT_CLIP_PLACE", "PADDING_PLACE", "ADJACENT_INDELS", "NO_REAL_OPERATOR", ""]


def test_mate_overlap(spark):
    e = cigar.elements(F.col("c"))
    rows = [("10M", 106), ("10M", 111), ("5M5M", 103), ("4M2I6M", 105)]
    assert column(spark, rows, "c string, m int", cigar.mate_overlap_to_clip(F.lit(101), e, F.col("m"))) == [5, 0, 8, 6]


def test_coordinates(spark):
    rng = random.Random(2)
    rows = [tuple(rng.randint(1, 12) for _ in range(4)) for _ in range(200)]
    rows = [(a, a + b - 1, c, c + d - 2) for a, b, c, d in rows]
    got = column(spark, rows, "s int, e int, s2 int, e2 int", coords.overlaps(F.col("s"), F.col("e"), F.col("s2"), F.col("e2")))
    assert got == [(s <= s2 <= e) or (s <= e2 <= e) or (s >= s2 and e <= e2) for s, e, s2, e2 in rows]
    spans = [(1, 1), (16384, 16385), (1, 16384), (131072, 131073), (5, 1 << 27), (100_000_000, 100_000_050)]

    def plain_bin(s, e):
        s, e = s - 1, e - 1
        for shift, first in ((14, 4681), (17, 585), (20, 73), (23, 9), (26, 1)):
            if s >> shift == e >> shift:
                return first + (s >> shift)
        return 0

    assert column(spark, spans, "s int, e int", coords.bin_of(F.col("s"), F.col("e"))) == [plain_bin(*x) for x in spans]
    for (s, e), found in zip(spans, column(spark, spans, "s int, e int", coords.bins_overlapping(F.col("s"), F.col("e"))), strict=True):
        assert plain_bin(s, e) in found and plain_bin(s, s) in found and len(found) == len(set(found))


def test_bases(spark):
    rows = [("ACGTN",), ("acgtn.",), ("",), ("RYK-",)]
    assert column(spark, rows, "b string", bases.reverse_complement(F.col("b"))) == ["NACGT", ".nacgt", "", "-KYR"]
    assert column(spark, rows, "b string", bases.gc_fraction(F.col("b"))) == [0.4, pytest.approx(1 / 3), 0.0, 0.0]
    assert column(spark, rows, "b string", bases.to_stored(F.col("b"))) == ["ACGTN", "ACGTNN", "", "RYKN"]
    pairs = [("A", "a"), ("N", "A"), ("R", "N"), ("A", "R"), ("C", "R"), ("n", ".")]
    assert column(spark, pairs, "a string, b string", bases.bases_equal(F.col("a"), F.col("b"))) == [True, False, False, False, False, True]
    assert column(spark, pairs, "a string, b string", bases.matches_with_ambiguity(F.col("a"), F.col("b"))) == [True, False, True, True, False, True]
    assert len(bases.all_kmers(3)) == 64
    heads = [("r1/1 extra",), ("r1/2/1",), ("plain",)]
    assert column(spark, heads, "h string", bases.name_from_header(F.col("h"))) == ["r1", "r1", "plain"]


def test_md_nm_and_back(spark):
    rng = random.Random(3)
    reference = "".join(rng.choice("ACGT") for _ in range(300))
    rows = []
    for _ in range(60):
        c = rng.choice(["20M", "5S15M", "8M2D8M", "6M3I6M", "4M1D3M2I5M2S"])
        start = rng.randint(1, 200)
        read, ref = "", start - 1
        for n, o in parse(c):
            if o in "M=X":
                read += "".join(b if rng.random() > 0.15 else rng.choice("ACGT") for b in reference[ref : ref + n])
            elif o in "IS":
                read += "".join(rng.choice("ACGT") for _ in range(n))
            ref += n * (o in "MDN=X")
        rows.append((read, start, c, reference))
    out = column(spark, rows, "b string, s int, c string, r string", bases.md_and_nm(F.col("b"), F.col("s"), F.col("c"), F.col("r")))
    for (read, start, c, _), r in zip(rows, out, strict=True):
        pairs = positions(start, c)
        wrong = sum(read[a - 1] != reference[b - 1] for a, b in pairs)
        assert r.nm == wrong + sum(n for n, o in parse(c) if o in "ID")
        rebuilt = bases.reference_from_md_of(read, c, r.md).replace("-", "")
        span = sum(n for n, o in parse(c) if o in "MDN=X")
        assert rebuilt == reference[start - 1 : start - 1 + span]


def test_qualities(spark):
    rng = random.Random(4)
    rows = [([rng.randint(0, 41) for _ in range(rng.randint(0, 30))],) for _ in range(60)]

    def trim(q, t):
        total = best = 0
        at = len(q)
        for i in range(len(q) - 1, -1, -1):
            total += t - q[i]
            if total < 0:
                break
            if total > best:
                best, at = total, i
        return at

    assert column(spark, rows, "q array<int>", qualities.trim_point(F.col("q"), 15)) == [trim(q, 15) for (q,) in rows]
    assert column(spark, rows, "q array<int>", qualities.expected_errors(F.col("q"))) == [pytest.approx(sum(10 ** (-x / 10) for x in q)) for (q,) in rows]
    texts = column(spark, rows, "q array<int>", qualities.text(F.col("q")))
    assert texts == ["".join(chr(x + 33) for x in q) for (q,) in rows]
    assert column(spark, [(t,) for t in texts], "t string", qualities.phreds(F.col("t"))) == [q for (q,) in rows]
    assert column(spark, [(p,) for p in (1.0, 0.1, 0.001, 0.5)], "p double", qualities.phred_of(F.col("p"))) == [0, 10, 30, 3]


def test_flags(spark):
    every = [(f,) for f in (0, 4, 77, 141, 99, 147, 1024 + 16, 2048 + 256)]
    assert column(spark, every, "f int", flags.names(F.col("f")))[2] == ["READ_PAIRED", "READ_UNMAPPED", "MATE_UNMAPPED", "FIRST_OF_PAIR"]
    assert column(spark, [("0x63",), ("0143",), ("99",), ("zz",)], "t string", flags.parse(F.col("t"))) == [99, 99, 99, None]
    ranks = column(spark, [(q,) for q in (0, 255, 1, 60)], "q int", flags.mapq_rank(F.col("q")))
    assert ranks == sorted(ranks)
    # Known values of the 32-bit Murmur3 over UTF-16 text, computed from bytes.
    assert flags.murmur3_of("", 0) == 0 and flags.murmur3_of("ab", 7) == flags.murmur3_of("ab", 7) != flags.murmur3_of("ba", 7)
    assert column(spark, [("read1",), ("read2",), (None,)], "n string", flags.murmur3(F.col("n"), 1)) == [flags.murmur3_of("read1", 1), flags.murmur3_of("read2", 1), None]


def test_variant_types(spark):
    rows = [("A", ["G"]), ("AC", ["GT"]), ("A", ["AT"]), ("ACG", ["A"]), ("A", ["<DEL>"]), ("A", ["C", "AT"]), ("A", []), ("A", ["C", "<NON_REF>"]), ("A", ["]13:1]A"])]
    assert column(spark, rows, "r string, a array<string>", variants.variant_type(F.col("r"), F.col("a"))) == ["SNP", "MNP", "INDEL", "INDEL", "SYMBOLIC", "MIXED", "NO_VARIATION", "MIXED", "SYMBOLIC"]
    assert column(spark, rows, "r string, a array<string>", variants.variant_type(F.col("r"), F.col("a"), ignore_non_ref=True))[7] == "SNP"
    gts = [([0, 0],), ([0, 1],), ([1, 1],), ([-1, -1],), ([0, -1],), ([],), ([1, 2],)]
    assert column(spark, gts, "g array<int>", variants.genotype_type(F.col("g"))) == ["HOM_REF", "HET", "HOM_VAR", "NO_CALL", "MIXED", "UNAVAILABLE", "HET"]
    assert column(spark, gts, "g array<int>", variants.is_het_non_ref(F.col("g")))[-1] is True


def test_hardy_weinberg_matches_enumeration():
    def exact(aa, ab, bb):
        n, a = aa + ab + bb, 2 * aa + ab
        weight = {}
        for h in range(a % 2, min(a, 2 * n - a) + 1, 2):
            x, y = (a - h) // 2, (2 * n - a - h) // 2
            weight[h] = math.exp(math.lgamma(n + 1) - math.lgamma(x + 1) - math.lgamma(h + 1) - math.lgamma(y + 1) + h * math.log(2))
        total = sum(weight.values())
        up, down = sum(v for h, v in weight.items() if h >= ab) / total, sum(v for h, v in weight.items() if h <= ab) / total
        return 1.0 if up > 0.5 and down > 0.5 else 2 * min(up, down)

    rng = random.Random(5)
    for _ in range(200):
        aa, ab, bb = rng.randint(0, 30), rng.randint(0, 30), rng.randint(0, 30)
        if aa + ab + bb and ab <= min(2 * aa + ab, 2 * bb + ab):
            assert variants.hwe_of(aa, ab, bb) == pytest.approx(exact(aa, ab, bb), rel=1e-6)
    assert variants.hwe_of(-1, 2, 3) == -1


def test_likelihoods(spark):
    pairs = [(j, k) for k in range(6) for j in range(k + 1)]
    index = column(spark, pairs, "j int, k int", variants.pl_index(F.col("j"), F.col("k")))
    assert index == list(range(len(pairs)))
    assert [(r.j, r.k) for r in column(spark, [(x,) for x in index], "p int", variants.pl_alleles(F.col("p")))] == pairs
    assert variants.genotype_order(3, 2) == pairs[:6] and variants.likelihoods_count(3, 3) == len(variants.genotype_order(3, 3)) == 10
    assert column(spark, [([-0.1, -2.0, -5.3],)], "g array<double>", variants.gls_to_pls(F.col("g"))) == [[0, 19, 52]]


def test_text(spark):
    pairs = [("abc", "abd"), ("ab", "abc"), ("", ""), ("éa", "éb")]
    assert column(spark, pairs, "a string, b string", text.hamming(F.col("a"), F.col("b"))) == [1, None, 0, 1]
    assert column(spark, [("ab", "ba"), ("kitten", "sitting"), ("", "xy"), ("ca", "abc")], "a string, b string", text.levenshtein(F.col("a"), F.col("b"))) == [1, 3, 2, 3]
    names = ["r10", "r9", "r009a", "r1", "x", "r2b10", "r2b9"]
    keys = dict(zip(names, column(spark, [(n,) for n in names], "n string", text.natural_key(F.col("n"))), strict=True))
    assert sorted(names, key=keys.get) == ["r1", "r2b9", "r2b10", "r9", "r009a", "r10", "x"]
    shown = column(spark, [(x,) for x in (1.0, 0.1234565, 2.5e-7, float("nan"), float("inf"), -3.25)], "x double", text.metric_text(F.col("x")))
    assert shown == ["1", "0.123456", "0", "?", "?", "-3.25"]

"""Operators against brute force on small random tables."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from stranda.functions import flags
from stranda.operators import genotypes, histogram, intervals, joins, pileup, reads, tiles, validation
from stranda.streaming import events

IV = "contig string, start bigint, end bigint, negative boolean, name string"


def some(seed, n=120, size=400, empty=True):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        s = rng.randint(1, size)
        out.append((rng.choice(["c1", "c2"]), s, s + rng.randint(0 if empty else 1, 30) - 1, rng.random() < 0.4, f"n{i}"))
    return out


def covered(rows):
    return {(c, p) for c, s, e, *_ in rows for p in range(s, e + 1)}


def spans(df):
    return {(r.contig, p) for r in df.collect() for p in range(r.start, r.end + 1)}


@pytest.fixture(params=[1 << 17, 40])
def tile(request, monkeypatch):
    """Small tiles, so that rows are carried over many of them."""
    monkeypatch.setattr(tiles, "TILE", request.param)
    monkeypatch.setattr(tiles.with_tile, "__defaults__", ("start", request.param))
    return request.param


def test_interval_algebra_covers_the_right_places(spark, tile):
    a, b = some(1, empty=False), some(2, 40, empty=False)
    A, B = spark.createDataFrame(a, IV), spark.createDataFrame(b, IV)
    seqs = spark.createDataFrame([(0, "c1", 450), (1, "c2", 500), (2, "c3", 7)], "ref_index int, name string, length bigint")
    every = {(c, p) for c, n in (("c1", 450), ("c2", 500), ("c3", 7)) for p in range(1, n + 1)}
    merged = intervals.merge(A).collect()
    assert {(r.contig, p) for r in merged for p in range(r.start, r.end + 1)} == covered(a)
    ordered = sorted((r.contig, r.start, r.end) for r in merged)
    assert all(x[0] != y[0] or x[2] + 1 < y[1] for x, y in zip(ordered, ordered[1:], strict=False))
    assert spans(intervals.invert(A, seqs)) == every - covered(a)
    names = [r.name for r in sorted(intervals.invert(A, seqs).collect(), key=lambda r: ({"c1": 0, "c2": 1, "c3": 2}[r.contig], r.start))]
    assert names == [f"interval-{k + 1}" for k in range(len(names))]
    assert spans(intervals.intersect(A, B)) == covered(a) & covered(b)
    assert spans(intervals.subtract(A, B, seqs)) == covered(a) - covered(b)
    assert spans(intervals.difference(A, B)) == covered(a) ^ covered(b)
    assert spans(intervals.union(A, B)) == covered(a) | covered(b)
    assert intervals.disordered(intervals.merge(A)).count() == 0


def test_merge_names_strands_and_empty_intervals(spark):
    rows = [("c", 1, 5, True, "x"), ("c", 6, 9, False, "y"), ("c", 8, 9, False, "x"), ("c", 20, 19, False, None), ("c", 30, 31, False, None)]
    df = spark.createDataFrame(rows, IV)
    got = sorted((r.start, r.end, r.negative, r.name) for r in intervals.merge(df).collect())
    assert got == [(1, 9, True, "x|y"), (20, 19, False, None), (30, 31, False, None)]
    with pytest.raises(Exception, match="both strands"):
        intervals.merge(df, same_strand=True).collect()
    bands = sorted((r.start, r.end, r.name) for r in intervals.break_at_bands(df, 4).collect())
    assert ("x.1") in [b[2] for b in bands] and (20, 19, None) in bands


@pytest.mark.parametrize("width", [8, 1 << 14])
def test_overlap_joins(spark, width):
    a, b = some(3), some(4, 60)
    A, B = spark.createDataFrame(a + a[:5], IV), spark.createDataFrame(b, IV)
    hit = lambda x, y: x[0] == y[0] and x[1] <= y[2] and x[2] >= y[1] and x[2] >= x[1] and y[2] >= y[1]
    pairs = sorted((r.a.name, r.b.name) for r in joins.overlap_join(A, B, width=width).collect())
    assert pairs == sorted((x[4], y[4]) for x in a + a[:5] for y in b if hit(x, y))
    semi = sorted(r.name for r in joins.overlap_semi(A, B, width=width).collect())
    assert semi == sorted(x[4] for x in a + a[:5] if any(hit(x, y) for y in b))
    anti = sorted(r.name for r in joins.overlap_anti(A, B, width=width).collect())
    assert sorted(semi + anti) == sorted(x[4] for x in a + a[:5])
    inner = {(r.a.name, r.b.name) for r in joins.contained_join(A, B, width=width).collect()}
    assert inner == {(x[4], y[4]) for x in a for y in b if hit(x, y) and x[1] <= y[1] and y[2] <= x[2]}


def test_nearest_and_ranks(spark, tile):
    a, b = some(5, 80), some(6, 80)
    A, B = spark.createDataFrame(a, IV), spark.createDataFrame(b, IV)
    keys = {c: sorted({(s, e) for k, s, e, *_ in b if k == c}) for c in ("c1", "c2")}
    for forward in (False, True):
        for r in joins.nearest(A, B, forward).collect():
            near = [k for k in keys[r.contig] if (k >= (r.start, r.end) if forward else k <= (r.start, r.end))]
            want = (min(near) if forward else max(near)) if near else (None, None)
            assert (r.found_start, r.found_end) == want
    for r in joins.ranks(B).collect():
        assert keys[r.contig][r.rank] == (r.start, r.end)


READS = "read_name string, contig string, ref string, start int, flag int, mapq int, cigar string, score int, library string"


def some_reads(seed, n=150):
    rng = random.Random(seed)
    cigars = ["10M", "2S8M", "5M2D5M", "5M2I5M", "3M4N6M", "8M2S1H"]
    return [(f"r{i % (n // 2)}", c := rng.choice(["c1", "c2"]), c, rng.randint(1, 300), rng.choice([0, 16, 65, 81, 129, 1024, 4, 256, 2048]), rng.randint(0, 60), rng.choice(cigars), rng.randint(0, 9), rng.choice(["l1", None])) for i in range(n)]


def test_coverage_by_bases_and_by_edges_agree(spark, tile):
    rows = some_reads(7)
    df = spark.createDataFrame(rows, READS)
    want = {}
    for r in rows:
        if not r[4] & (4 | 256 | 1024 | 2048) and r[5] >= 10:
            from tests.test_functions import positions

            for _, p in positions(r[3], r[6]):
                want[r[1], p] = want.get((r[1], p), 0) + 1
    assert {(r.contig, r.pos): r.depth for r in pileup.depth(df, 10).collect()} == want
    runs = {(r.contig, p): r.depth for r in pileup.coverage(df, 10).collect() for p in range(r.start, r.end + 1)}
    assert runs == want
    zone = spark.createDataFrame([("c1", 50, 120)], "contig string, start bigint, end bigint")
    inside = {(r.contig, r.pos): r.depth for r in pileup.depth_in(df, zone, 10).collect()}
    assert inside == {("c1", p): want.get(("c1", p), 0) for p in range(50, 121)}


def test_duplicates_keep_one_of_each_set(spark):
    rows = some_reads(8, 300)
    df = spark.createDataFrame(rows, READS)
    marked = reads.mark_duplicates(df)
    assert marked.count() == len(rows)
    sets = reads.duplicate_sets(df).collect()
    usable = [r for r in rows if not r[4] & (4 | 256 | 2048)]
    assert sum(s["size"] for s in sets) == len(usable)
    keep = marked.filter(~flags.has(F.col("flag"), 4 | 256 | 2048) & ~flags.has(F.col("flag"), 1024)).count()
    assert keep >= len(sets)


def test_mates_are_fixed(spark):
    rows = [("p", "c1", 10, 19, 65, "10M"), ("p", "c1", 50, 59, 145, "10M"), ("u", "c1", 5, 14, 73, "10M"), ("u", "c1", 5, 5, 133, "*"), ("s", "c1", 1, 10, 0, "10M")]
    df = spark.createDataFrame([(n, r, s, e, f, c, None, 0, 0) for n, r, s, e, f, c in rows], "read_name string, ref string, start int, end int, flag int, cigar string, mate_ref string, mate_start int, tlen int")
    got = {(r.read_name, r.flag & 0x40): r for r in joins.fix_mates(df).collect()}
    one, two = got["p", 64], got["p", 0]
    assert (one.mate_start, one.tlen, one.flag & 0x20, one.mate_cigar) == (50, 50, 0x20, "10M") and (two.tlen, two.flag & 0x20) == (-50, 0)
    assert got["u", 64].flag & 8 and got["u", 64].tlen == 0 and got["s", 0].tlen is None


def test_histograms(spark):
    rng = random.Random(9)
    values = [rng.randint(1, 12) for _ in range(101)]
    df = histogram.build(spark.createDataFrame([(v,) for v in values], "v int"), F.col("v"))
    s = pd.Series(values)
    m = histogram.moments(df).first()
    assert (m.total, m.mean, m.sd, m.min, m.max) == (101, pytest.approx(s.mean()), pytest.approx(s.std()), s.min(), s.max())
    assert histogram.median(df).first().median == s.median()
    assert histogram.mad(df).first().mad == (s - s.median()).abs().median()
    assert histogram.mode(df).first().mode == s.mode()[0]
    even = histogram.build(spark.createDataFrame([(1,), (2,)], "v int"), F.col("v"))
    assert histogram.median(even).first().median == 1.5
    tail = spark.createDataFrame([(1.0, 2.0), (2.0, 9.0), (3.0, 8.0), (5.0, 8.0), (6.0, 8.0)], "bin double, count double")
    assert [r.bin for r in histogram.trim_tail(tail, 3).orderBy("bin").collect()] == [1.0, 2.0, 3.0]
    with pytest.raises(Exception, match="bins differ"):
        histogram.divide(tail, even).collect()
    assert {r.bin: (r.x, r.y) for r in histogram.joined({"x": tail, "y": even}).collect()}[2.0] == (9.0, 1.0)


def test_sampling_keeps_mates_together(spark):
    rows = [(f"t{i}", k) for i in range(2000) for k in (0, 1)]
    df = spark.createDataFrame(rows, "read_name string, k int")
    for part in (reads.downsample(df, 0.3), reads.downsample_exact(df, 0.3, 0.01), reads.downsample_chained(df, 0.3, 0.01)):
        counts = [r["count"] for r in part.groupBy("read_name").count().collect()]
        assert set(counts) == {2} and 450 < len(counts) < 750
    assert abs(reads.downsample_exact(df, 0.3, 0.01).count() / 4000 - 0.3) < 0.02
    assert reads.downsample(df, 1.0).count() == 4000


def test_expressions(spark):
    df = spark.createDataFrame([("c1", 5, 50.0, {"DP": "10"}), ("c2", 7, 10.0, {"DP": "3"}), ("c2", 9, None, {})], "contig string, start int, qual double, info map<string,string>")
    names = {"CHROM": "contig", "POS": "start", "QUAL": "qual"}
    keep = lambda e, **k: [r.start for r in df.filter(genotypes.translate(e, names, **k)).collect()]
    assert keep("DP > 5.0") == [5] and keep("vc.CHROM == 'c2' && !(QUAL > 20)") == [7]
    assert keep("DP > 5", missing="match") == [5, 9]
    assert keep("DP == '10'") == [5] and keep("vc.hasAttribute('DP') && !(DP =~ '^1')") == [7]
    called = spark.createDataFrame([(1, {"DB": "true"}, [("s", {"GT": "0/1", "GQ": "40"})]), (2, {}, [("s", {"GT": "1|1"})])], "start int, info map<string,string>, genotypes array<struct<sample:string,fields:map<string,string>>>")
    of = lambda e: [r.start for r in called.filter(genotypes.translate(e, {}, genotypes="genotypes")).collect()]
    assert of("vc.getGenotype('s').isHet() && vc.getGenotype('s').getGQ() > 30") == [1] and of("vc.getGenotype('s').isHomVar()") == [2] and of("DB") == [1]
    with pytest.raises(Exception, match="missing"):
        keep("DP > 5", missing="throw")


def test_validation_and_checksums(spark):
    df = spark.createDataFrame([("a", 0x40, 300, "10M"), ("b", 4 | 0x100, 3, "*"), ("c", 0, 20, "5M2H5M")], "read_name string, flag int, mapq int, cigar string")
    found = {(r.read_name, r.rule) for r in validation.findings(df, validation.read_rules(), ["read_name"]).collect()}
    assert found == {("a", "INVALID_FLAG_FIRST_OF_PAIR"), ("a", "INVALID_MAPPING_QUALITY"), ("b", "INVALID_FLAG_NOT_PRIM_ALIGNMENT"), ("b", "INVALID_MAPPING_QUALITY"), ("c", "INVALID_CIGAR")}
    groups = spark.createDataFrame([("b", {"SM": "s", "LB": "l"}), ("a", {"SM": "t"})], "id string, attributes map<string,string>")
    import hashlib

    assert validation.read_group_checksum(groups).first().checksum == hashlib.md5(b"SMtLBlSMs").hexdigest()


def test_streams_agree_with_batches(spark, tmp_path):
    rows = [(i, f"2026-01-0{1 + i % 3} 0{i % 10}:00:00", "a" if i % 2 else "b", float(i)) for i in range(60)]
    df = spark.createDataFrame(rows, "event_id int, t string, event_type string, value double").withColumn("ts", F.to_timestamp("t")).drop("t")
    df.repartition(3).write.parquet(str(tmp_path / "ev"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "ev"))
    assert sorted(events.run_to_end(events.windowed_counts(stream)).collect()) == sorted(events.windowed_counts(df).collect())


def test_bounded_reorder(spark, tmp_path):
    rows = [("c1", p, f"x{p}") for p in (5, 3, 9, 8, 30, 28, 55)]
    spark.createDataFrame(rows, "contig string, start int, name string").coalesce(1).write.parquet(str(tmp_path / "r"))
    stream = spark.readStream.schema("contig string, start int, name string").parquet(str(tmp_path / "r"))
    got = [r.start for r in events.run_to_end(events.reordered(stream, 10, "contig string, start int, name string"), "append").collect()]
    assert got == [3, 5, 8, 9, 28, 30]

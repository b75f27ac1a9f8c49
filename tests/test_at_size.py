"""Operators whose work must not grow faster than their tables: what they compute, and what their plans leave out."""

import itertools
import random

from pyspark.sql import functions as F

from stranda.functions import cigar
from stranda.operators import intervals, joins, pileup, tiles, validation


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def reads(spark, n=200):
    rng = random.Random(5)
    rows = [(f"r{i}", rng.choice(["c1", "c2"]), rng.randint(1, 150), rng.choice([0, 16, 4, 1024]), 30, rng.choice(["10M", "2S5M3D4M", "3M2I6M", "70M"])) for i in range(n)]
    return spark.createDataFrame(rows, "read_name string, contig string, start int, flag int, mapq int, cigar string")


def test_depth_and_caps_need_no_row_for_each_base(spark, monkeypatch):
    df = reads(spark)
    want = {(r.contig, r.pos): r.n for r in pileup.aligned_bases(df).groupBy("contig", "pos").agg(F.count("*").alias("n")).collect()}
    for tile in (1 << 17, 16):
        monkeypatch.setattr(tiles, "TILE", tile)
        assert {(r.contig, r.pos): r.depth for r in pileup.depth(df).collect()} == want
        assert {(r.contig, r.pos): r.depth for r in pileup.capped(df, 3).collect()} == {k: min(n, 3) for k, n in want.items()}
    assert pileup.capped(df, 0).count() == 0
    for rows in (pileup.stretches(df), pileup.capped(df, 3)):
        assert "read_name#" not in plan(rows).split("LogicalRDD")[0]
    assert pileup.stretches(df).filter("start > end").count() == 0


def test_a_cigar_is_sound_where_no_error_is_found(spark):
    made = ["".join(x) for n in (1, 2, 3, 4) for x in itertools.islice(itertools.product(["1M", "2I", "1D", "3S", "2H", "1P", "0N"], repeat=n), 0, None, n)]
    rows = [(c,) for c in [*made, "*", "", "M", "10", "1M*", "10M", "100S5M", "05M", "00M", "5=2X", None]]
    df = spark.createDataFrame(rows, "c string")
    parts = cigar.elements(F.col("c"))
    slow = parts.isNotNull() & (F.size(parts) > 0) & (F.size(cigar.errors(parts)) == 0)
    ends = df.select(cigar.alignment_end(F.lit(7), parts).alias("a"), cigar.text_end(F.lit(7), F.col("c")).alias("b")).collect()
    assert [r for r in ends if r.a != r.b] == [] and df.select(parts.alias("p")).schema["p"].dataType.simpleString() == "array<struct<len:int,op:string>>"
    got = df.select("c", F.coalesce(slow, F.lit(False)).alias("slow"), F.coalesce(cigar.is_sound(F.col("c")), F.lit(False)).alias("fast")).collect()
    assert [r for r in got if r.slow != r.fast] == [] and {r.slow for r in got} == {True, False}
    assert "lambda" not in plan(validation.findings(reads(spark).select("read_name", "flag", "cigar"), validation.read_rules(), ["read_name"]).groupBy().count()).split("Filter (")[-1]


def test_rows_of_one_bin_are_joined_as_they_are(spark):
    iv = "contig string, start bigint, end bigint, name string"
    rng = random.Random(8)
    a = [(rng.choice(["c1", "c2", None]), s, s + rng.randint(-2, 30), rng.choice(["x", "y", None])) for s in (rng.randint(1, 300) for _ in range(150))] * 2 + [("c1", None, 5, "n"), ("c1", 7, None, "n")]
    b = [(rng.choice(["c1", "c2", None]), s, s + rng.randint(-2, 40), "b") for s in (rng.randint(1, 300) for _ in range(25))]
    A, B = spark.createDataFrame(a, iv), spark.createDataFrame(b, iv)
    ok = lambda x: None not in x[:3] and x[2] >= x[1]
    for contained in (False, True):
        meets = lambda x, y: ok(x) and ok(y) and x[0] == y[0] and ((y[1] <= x[1] and x[2] <= y[2]) if contained else (x[1] <= y[2] and x[2] >= y[1]))  # noqa: B023, E731
        hit = [x for x in a if any(meets(x, y) for y in b)]
        miss = [x for x in a if not any(meets(x, y) for y in b)]
        for width in (16, 1024):
            assert sorted(map(tuple, joins.overlap_semi(A, B, contained, width).collect()), key=repr) == sorted(hit, key=repr)
            assert sorted(map(tuple, joins.overlap_anti(A, B, contained, width).collect()), key=repr) == sorted(miss, key=repr)
    # Whole rows are neither counted nor told apart: only places are made distinct.
    assert not any("name#" in x for x in plan(joins.overlap_semi(A, B)).splitlines() if "Aggregate [" in x)


def test_intersections_without_names_are_the_same_places(spark):
    iv = "contig string, start bigint, end bigint, negative boolean, name string"
    rng = random.Random(9)
    some = lambda n: spark.createDataFrame([(rng.choice(["c1", "c2"]), s, s + rng.randint(0, 20), rng.random() < 0.5, f"n{i}") for i, s in enumerate(rng.randint(1, 900) for _ in range(n))], iv)
    a, b = some(60), some(40)
    key = ["contig", "start", "end", "negative"]
    plain = intervals.intersect(a, b, names=False)
    assert sorted(map(tuple, plain.select(*key).collect())) == sorted(map(tuple, intervals.intersect(a, b).select(*key).collect()))
    assert plain.filter("name is not null").count() == 0 and plain.count() > 5

"""Row rewrites, header merging and binary alignments."""

import pytest
from pyspark.sql import functions as F

from stranda.functions import records
from stranda.operators import headers
from stranda.sources import bam, sam
from tests.test_sources import SAM, put


def test_tags_and_unmapping(spark, tmp_path):
    reads = sam.read(spark, put(tmp_path, "a.sam", SAM))
    out = reads.select("read_name", "flag", records.set_tag(F.col("tags"), "ZZ", F.lit("1")).alias("a"), records.set_tag(F.col("tags"), "NM", F.lit(None).cast("string")).alias("b"), records.integer_tag(F.col("tags"), "NM").alias("n"))
    row = next(r for r in out.collect() if r.flag == 99)
    assert row.a == {"RG": "g1", "NM": "3", "ZZ": "1"} and row.b == {"RG": "g1"} and row.n == 3
    un = next(r for r in records.make_unmapped(reads, keep_originals=True).collect() if r.tags.get("OF") == "147")
    assert (un.ref, un.start, un.cigar, un.bases, un.flag & 4, un.flag & 16) == (None, 0, "*", "ATGCCGCTG", 4, 0)
    assert (un.tags["OP"], un.tags["OC"], un.tags["OR"]) == ("37", "9M", "chr1")
    turned = records.reverse_complemented(reads.filter("flag = 4")).first()
    assert (turned.bases, turned.quals) == ("ACGT", "IIII")


def test_chimeras_clips_and_states(spark):
    df = spark.createDataFrame([("r", {"SA": "c1,5,-,4S6M,60,1;c2,9,+,10M,3,0;"})], "read_name string, tags map<string,string>")
    assert [tuple(r) for r in records.other_alignments(df).collect()] == [("r", "c1", 5, True, "4S6M", 60, 1), ("r", "c2", 9, False, "10M", 3, 0)]
    from stranda.functions import cigar

    c = spark.createDataFrame([(95, "10M"), (80, "10M"), (93, "4M2D6M")], "s int, c string")
    assert [r.o for r in c.select(records.clip_to_contig(F.col("s"), cigar.elements(F.col("c")), F.lit(100)).alias("o")).collect()] == ["6M4S", "10M", "4M2D2M4S"]
    pair = spark.createDataFrame([(1 + 64, "c", 10, "c", 15, "10M"), (1 + 128, "c", 15, "c", 10, "10M"), (1 + 64, "c", 10, "c", 40, "10M2S")], "flag int, ref string, start int, mate_ref string, mate_start int, cigar string")
    assert [r.cigar for r in records.clip_mate_overlap(pair).collect()] == ["5M5S", "10M", "10M2S"]
    s = spark.createDataFrame([(1, 4), (5, 9), (3, 12), (20, 30)], "s int, e int")
    assert [r.o for r in s.select(records.compare_to_interval(F.col("s"), F.col("e"), F.lit(5), F.lit(10)).alias("o")).collect()] == ["BEFORE", "CONTAINED", "OVERLAPPING", "AFTER"]
    f = spark.createDataFrame([("n XX:Z:a YY:i:3 zz",)], "h string").select(records.fastq_tags(F.col("h")).alias("t")).first()
    assert f.t == {"XX": "a", "YY": "3"}


def test_headers_merge(spark):
    seq = lambda *names: spark.createDataFrame([(i, n, len(n)) for i, n in enumerate(names)], "ref_index int, name string, length bigint")
    merged = headers.merge_dictionaries(seq("a", "c", "dd"), seq("a", "b", "c"))
    assert [r.name for r in merged.orderBy("ref_index").collect()] == ["a", "b", "c", "dd"]
    with pytest.raises(ValueError, match="contradict"):
        headers.merge_dictionaries(seq("a", "b"), seq("b", "a"))
    assert headers.same_dictionary(seq("a", "b"), seq("a", "b")) and not headers.same_dictionary(seq("a", "b"), seq("b", "a"))
    rg = lambda *rows: spark.createDataFrame(list(rows), "id string, attributes map<string,string>")
    got = {(r.source, r.id): r.new_id for r in headers.merge_groups(rg(("1", {"SM": "x"}), ("2", {"SM": "q"})), rg(("1", {"SM": "y"}), ("2", {"SM": "q"}))).collect()}
    assert got == {(0, "1"): "1", (1, "1"): "1.1", (0, "2"): "2", (1, "2"): "2"}
    h = "kind string, id string, number string, type string, description string"
    one = spark.createDataFrame([("INFO", "AF", "1", "Integer", "x")], h)
    two = spark.createDataFrame([("INFO", "AF", "A", "Float", "x"), ("FILTER", "q10", None, None, "y")], h)
    assert {(r.kind, r.id, r.number, r.type) for r in headers.merge_vcf_headers(one, two).collect()} == {("INFO", "AF", ".", "Float"), ("FILTER", "q10", None, None)}
    fixed = {r.id: r.number for r in headers.repair_standard(one).filter("kind = 'INFO'").collect()}
    assert fixed["AF"] == "A" and "END" in fixed


def test_binary_alignments_round_trip(spark, tmp_path):
    reads = sam.read(spark, put(tmp_path, "a.sam", SAM.replace("NM:i:3", "NM:i:3\tF1:f:1.5\tB1:B:s,1,-2,3\tBI:i:4000000000"))).coalesce(1)
    head = "\n".join(SAM.splitlines()[:4]) + "\n"
    parts = bam.encoded_parts(reads, head, [("chr1", 1000), ("chr2", 500)]).collect()
    for p in parts:
        (tmp_path / "out").mkdir(exist_ok=True)
        (tmp_path / "out" / f"{p.part}.bam").write_bytes(p.content)
    back = bam.read(spark, str(tmp_path / "out"))
    key = lambda r: (r.read_name, r.flag)
    want, got = sorted(reads.collect(), key=key), sorted(back.collect(), key=key)
    for a, b in zip(want, got, strict=True):
        assert a.asDict() == {k: b.asDict()[k] for k in a.asDict()}
    assert bam.header_text(spark, str(tmp_path / "out")) == head
    big = bam.deflate(bytes(range(256)) * 2000)
    assert b"".join(bam.inflate(big)) == bytes(range(256)) * 2000


def test_pairs_masks_and_file_checks(spark, tmp_path):
    from stranda.operators import reads, validation
    from stranda.sources import sequences

    rows = [("a", "c", 10, 19, 65, "c", 500, "10M"), ("a", "c", 500, 509, 129, "c", 10, "10M"), ("b", "c", 900, 909, 65, "c", 950, "10M"), ("x", "c", 12, 15, 0, None, 0, None), ("s", "c", 12, 15, 257, "c", 14, "4M")]
    df = spark.createDataFrame(rows, "read_name string, contig string, start int, end int, flag int, mate_ref string, mate_start int, mate_cigar string")
    zone = spark.createDataFrame([("c", 15, 40)], "contig string, start int, end int")
    assert sorted((r.read_name, r.start) for r in reads.keep_pairs_in(df, zone).collect()) == [("a", 10), ("a", 500)]
    spots = spark.createDataFrame([("c", p) for p in (1, 15, 40, 41)], "contig string, pos int")
    mask = spark.createDataFrame([("c", 15, 40), ("c", 60, 61)], "contig string, start bigint, end bigint")
    assert {r.pos: (r.covered, r.next) for r in reads.next_covered(spots, mask).collect()} == {1: (False, 15), 15: (True, 15), 40: (True, 40), 41: (False, 60)}
    sites = spark.createDataFrame([(1, 2, 4), (2, 1, 4)], "site int, ac int, an int")
    counts = spark.createDataFrame([(1, 2, 4), (2, 3, 6)], "site int, counted_ac int, counted_an int")
    assert sorted(r.rule for r in validation.allele_count_findings(sites, counts, "site").collect()) == ["AC_MISMATCH", "AN_MISMATCH"]
    head = sam.header(spark, put(tmp_path, "h.sam", SAM))
    assert [r.rule for r in validation.header_findings(head).collect()] == ["MISSING_PLATFORM_VALUE"]
    one = sam.read(spark, put(tmp_path, "b.sam", SAM))
    two = one.withColumn("mapq", F.when(F.col("flag") == 99, 7).otherwise(F.col("mapq"))).filter("flag <> 4")
    diff = validation.compare_reads(one, two, columns=("mapq", "start", "cigar"))
    assert sorted((r.flag, r.column) for r in diff.collect()) == [(4, "only in first"), (99, "mapq")]
    fa = put(tmp_path, "x.fa", ">c1 first\nACGT\nAC\n>c2\nGGGGG\n")
    assert sorted(tuple(r) for r in sequences.fasta_index(spark, fa).collect()) == [("c1", 6, 10, 4, 5), ("c2", 5, 22, 5, 6)]
    assert sequences.read_bundle('{"schema": {"name": "bundle", "version": "0.1.0"}, "primary": "ALIGNED_READS", "ALIGNED_READS": {"path": "a.bam"}}') == {"ALIGNED_READS": {"path": "a.bam"}}

"""Readers and writers on small files, and round trips."""

from pyspark.sql import functions as F

from stranda.sources import features, sam, sequences, vcf

SAM = """@HD\tVN:1.6\tSO:coordinate
@SQ\tSN:chr1\tLN:1000
@SQ\tSN:chr2\tLN:500\tM5:abc
@RG\tID:g1\tSM:s1\tLB:l1
r1\t99\tchr1\t7\t30\t4S8M2I4M1D3M\t=\t37\t39\tTTAGATAAAGGATACTGCAAA\t*\tRG:Z:g1\tNM:i:3
r2\t4\t*\t0\t0\t*\t*\t0\t0\tACGT\tIIII
r1\t147\tchr1\t37\t30\t9M\tchr2\t7\t-39\tCAGCGGCAT\t*\tXA:Z:a:b,c
"""

VCF = """##fileformat=VCFv4.2
##INFO=<ID=DP,Number=1,Type=Integer,Description="Depth, \\"all\\"">
##FORMAT=<ID=GT,Number=1,Type=String,Description="Genotype">
##contig=<ID=20,length=62435964>
#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tA\tB
20\t14370\trs6\tg\tA\t29.1\t.\tNS=3;DP=14;DB\tGT:GQ:AD\t0|0:48:1,2\t1|0
20\t17330\t.\tT\tA,<DEL>\t3\tq10;s50\tEND=17400\tGT\t./.\t1/2
20\t19\t.\tAC\t.\t.\tPASS\t.\tGT\t0/0\t0
"""


def put(tmp_path, name, text):
    (tmp_path / name).write_text(text)
    return str(tmp_path / name)


def lines(path):
    import glob

    return [x for f in sorted(glob.glob(f"{path}/part-*")) for x in open(f).read().splitlines()]


def test_sam_round_trip(spark, tmp_path):
    path = put(tmp_path, "a.sam", SAM)
    reads = sam.read(spark, path)
    rows = {(r.read_name, r.flag): r for r in reads.collect()}
    a = rows["r1", 99]
    assert (a.ref, a.start, a.end, a.mate_ref, a.mate_start, a.tags, a.tag_types) == ("chr1", 7, 22, "chr1", 37, {"RG": "g1", "NM": "3"}, {"RG": "Z", "NM": "i"})
    assert rows["r2", 4].ref is None and rows["r2", 4].end is None and rows["r1", 147].tags == {"XA": "a:b,c"}
    assert [(r.name, r.length, r.md5) for r in sam.sequences(spark, path).orderBy("ref_index").collect()] == [("chr1", 1000, None), ("chr2", 500, "abc")]
    assert [(r.id, r.library) for r in sam.read_groups(spark, path).collect()] == [("g1", "l1")]
    head = SAM.splitlines()[:4]
    sam.write(reads, str(tmp_path / "out"), head)
    got = lines(tmp_path / "out")
    assert got[:4] == head and sorted(got[4:]) == sorted(x.replace("RG:Z:g1\tNM:i:3", "NM:i:3\tRG:Z:g1") for x in SAM.splitlines()[4:])


def test_vcf_round_trip(spark, tmp_path):
    path = put(tmp_path, "a.vcf", VCF)
    sites = vcf.read(spark, path)
    rows = {r.start: r for r in sites.collect()}
    a, b, c = rows[14370], rows[17330], rows[19]
    assert (a.ref, a.alts, a.qual, a.filters, a.stop, a.info) == ("G", ["A"], 29.1, None, 14370, {"NS": "3", "DP": "14", "DB": "true"})
    assert (b.alts, b.filters, b.stop) == (["A", "<DEL>"], ["q10", "s50"], 17400)
    assert (c.alts, c.filters, c.qual, c.stop, c.info) == ([], [], None, 20, {})
    gts = {(r.start, r.sample): r for r in vcf.genotypes(sites).collect()}
    assert (gts[14370, "A"].gt, gts[14370, "A"].gq, gts[14370, "A"].ad, gts[14370, "A"].phased) == ([0, 0], 48, [1, 2], True)
    assert gts[14370, "B"].gq is None and gts[17330, "A"].gt == [-1, -1] and gts[19, "B"].gt == [0]
    h = {(r.kind, r.id): r for r in vcf.header(spark, path).collect()}
    assert h["INFO", "DP"].type == "Integer" and h["FORMAT", "GT"].number == "1"
    assert [(r.name, r.length) for r in vcf.contigs(spark, path).collect()] == [("20", 62435964)]
    assert {r.start for r in vcf.as_intervals(sites).collect()} == {14370, 19}
    vcf.write(sites, str(tmp_path / "out"), VCF.splitlines()[:4], ["A", "B"])
    got = lines(tmp_path / "out")
    assert got[:5] == VCF.splitlines()[:5]
    assert "20\t14370\trs6\tG\tA\t29.1\t.\tDB;DP=14;NS=3\tGT:AD:GQ\t0|0:1,2:48\t1|0:.:." in got
    assert "20\t17330\t.\tT\tA,<DEL>\t3\tq10;s50\tEND=17400\tGT\t./.\t1/2" in got


def test_bed_interval_list_and_loci(spark, tmp_path):
    bed = put(tmp_path, "a.bed", "track name=x\n#c\nchr1\t0\t10\nchr2\t5\t90\tn\t7\t-\t10\t20\t1,2,3\t2\t5,6,\t0,30,\nchr3\t1\t2\tm\tbad\t+\n")
    rows = {r.contig: r for r in features.read_bed(spark, bed).collect()}
    assert (rows["chr1"].start, rows["chr1"].end, rows["chr1"].name) == (1, 10, None)
    assert (rows["chr2"].negative, rows["chr2"].thick_start, [tuple(e) for e in rows["chr2"].exons]) == (True, 11, [(6, 10), (36, 41)])
    assert rows["chr3"].score is None and rows["chr3"].negative is None
    seqs = spark.createDataFrame([(0, "chr2", 100), (1, "chr1", 50)], "ref_index int, name string, length bigint")
    features.write_interval_list(features.read_bed(spark, bed).filter("contig <> 'chr3'").select("contig", "start", "end", "negative", "name"), seqs, str(tmp_path / "il"))
    assert lines(tmp_path / "il") == ["@HD\tVN:1.6", "@SQ\tSN:chr2\tLN:100", "@SQ\tSN:chr1\tLN:50", "chr2\t6\t90\t-\tn", "chr1\t1\t10\t+\t."]
    back = features.read_interval_list(spark, str(tmp_path / "il"))
    assert {tuple(r) for r in back.collect()} == {("chr2", 6, 90, True, "n"), ("chr1", 1, 10, False, None)}
    bad = spark.createDataFrame([("chr9", 1, 2, False), ("chr1", 0, 2, False), ("chr1", 5, 2, False), ("chr1", 5, 60, False), ("chr1", 5, 6, None), ("chr1", 1, 2, True)], "contig string, start int, end int, negative boolean")
    assert sorted(r.problem for r in features.check_intervals(bad, seqs).collect()) == ["END_BEFORE_START", "END_PAST_CONTIG", "START_BELOW_1", "UNKNOWN_CONTIG", "UNKNOWN_STRAND"]
    loci = put(tmp_path, "l.list", "chr1\nchr1:1,000\nHLA:1:5-70\n")
    assert [tuple(r) for r in features.read_loci(spark, loci).collect()] == [("chr1", 1, 0), ("chr1", 1000, 1000), ("HLA:1", 5, 70)]


def test_gff3(spark, tmp_path):
    text = "##gff-version 3\nc%201\tsrc\tgene\t1\t900\t.\t+\t.\tID=g1;Note=a%2Cb,c\nc%201\tsrc\tmRNA\t1\t900\t0.5\t+\t0\tID=t1;Parent=g1\nc%201\tsrc\texon\t1\t20\t.\t+\t.\tID=e1;Parent=t1,t2\n##FASTA\n>x\nACGT\n"
    rows = features.read_gff3(spark, put(tmp_path, "a.gff3", text))
    by = {r.type: r for r in rows.collect()}
    assert by["gene"].contig == "c 1" and by["gene"].attributes["Note"] == ["a,b", "c"] and by["gene"].score == -1.0 and by["mRNA"].phase == 0
    edges = features.gff3_edges(rows)
    assert {tuple(r) for r in edges.collect()} == {("t1", "g1"), ("e1", "t1"), ("e1", "t2")}
    assert ("g1", "e1", 2) in {tuple(r) for r in features.gff3_descendants(edges).collect()}
    features.write_gff3(rows, str(tmp_path / "out"))
    back = features.read_gff3(spark, str(tmp_path / "out"))
    assert sorted(map(str, back.select("type", "start", "score", "phase", F.map_entries("attributes")).collect())) == sorted(map(str, rows.select("type", "start", "score", "phase", F.map_entries("attributes")).collect()))


def test_fasta_and_regions(spark, tmp_path):
    path = put(tmp_path, "a.fa", ">chr1 first\nACGTAC\nGTNN\n>chr2\nTTTT\n")
    fasta = sequences.read_fasta(spark, path)
    assert {tuple(r) for r in fasta.collect()} == {("chr1", "ACGTACGTNN"), ("chr2", "TTTT")}
    pieces = sequences.pieces(fasta, 4)
    regions = spark.createDataFrame([("chr1", 2, 9), ("chr2", 4, 4)], "contig string, start int, end int")
    assert {tuple(r) for r in sequences.subsequence(pieces, regions, 4).collect()} == {("chr1", 2, 9, "CGTACGTN"), ("chr2", 4, 4, "T")}
    sequences.write_fasta(fasta, str(tmp_path / "out"), 4)
    assert {tuple(r) for r in sequences.read_fasta(spark, str(tmp_path / "out")).collect()} == {tuple(r) for r in fasta.collect()}
    assert {r.name: r.length for r in sequences.fasta_dictionary(fasta).collect()} == {"chr1": 10, "chr2": 4}


def test_fastq_with_qualities_that_look_like_headers(spark, tmp_path):
    path = put(tmp_path, "a.fq", "@r1 x\nACGT\n+\n@@@I\n@r2/1\nGG\n+r2\n+@\n")
    rows = {r.name: r for r in sequences.read_fastq(spark, path).collect()}
    assert rows["r1 x"].quals == "@@@I" and rows["r2/1"].qual_header == "r2"
    reads = sequences.unmapped_of_fastq(sequences.read_fastq(spark, path))
    assert {(r.read_name, r.flag) for r in reads.collect()} == {("r1", 4), ("r2", 4)}
    sequences.write_fastq(sequences.read_fastq(spark, path), str(tmp_path / "out"))
    assert {tuple(r) for r in sequences.read_fastq(spark, str(tmp_path / "out")).collect()} == {tuple(r) for r in sequences.read_fastq(spark, path).collect()}


def test_chain_and_liftover(spark, tmp_path):
    from stranda.operators import joins

    path = put(tmp_path, "a.chain", "chain 100 chr1 1000 + 100 300 chrA 2000 + 500 710 1\n50 10 20\n140\n\nchain 5 chr1 1000 + 600 700 chrB 900 - 100 200 2\n100\n")
    blocks = sequences.read_chain(spark, path)
    assert sorted((r.chain, r.from_start, r.from_end, r.to_contig, r.to_start, r.to_negative) for r in blocks.collect()) == [(1, 101, 150, "chrA", 500, False), (1, 161, 300, "chrA", 570, False), (2, 601, 700, "chrB", 100, True)]
    probes = spark.createDataFrame([("chr1", 111, 120, "p", False), ("chr1", 611, 620, "m", False), ("chr1", 140, 170, "gap", False), ("chr2", 1, 2, "none", False)], "contig string, start int, end int, name string, negative boolean")
    got = {r.name: (r.to_contig, r.to_start, r.to_end, r.to_negative) for r in joins.lift_over(probes, blocks).collect()}
    # The target of a reversed chain is counted from the contig's end.
    assert got == {"p": ("chrA", 511, 520, False), "m": ("chrB", 900 - 120 + 1, 900 - 110, True), "gap": (None,) * 4, "none": (None,) * 4}


def test_metrics_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1, 0.1234567, True), ("b", None, float("nan"), False)], "name string, n int, x double, flag boolean")
    hist = spark.createDataFrame([(1.0, 5.0), (2.0, 7.0)], "bin double, count double")
    sequences.write_metrics(rows, str(tmp_path / "m"), "Some", hist)
    got, bins = sequences.read_metrics(spark, str(tmp_path / "m"))
    assert [tuple(r) for r in got.collect()] == [("a", "1", "0.123457", "Y"), ("b", None, "?", "N")]
    assert [tuple(r) for r in bins.collect()] == [("1", "5"), ("2", "7")]


def test_texts_with_a_header_are_written_by_many_tasks_and_in_order(spark, tmp_path):
    import glob

    from stranda.sources import formats
    from stranda.sources import lines as text

    seqs = spark.createDataFrame([(0, "chr2", 9000), (1, "chr1", 9000)], "ref_index int, name string, length bigint")
    rows = spark.range(3000).selectExpr("concat('chr', id % 2 + 1) as contig", "id * 7 % 3001 + 1 as start", "id * 7 % 3001 + 5 as end", "id % 3 = 0 as negative", "cast(id as string) as name")
    # Small parts aren't joined.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        features.write_interval_list(rows, seqs, str(tmp_path / "il"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    sizes = [len(open(f).readlines()) for f in sorted(glob.glob(f"{tmp_path}/il/part-*"))]
    assert max(sizes) < 2000 and sum(sizes) == 3003
    got = lines(tmp_path / "il")
    assert got[:3] == ["@HD\tVN:1.6", "@SQ\tSN:chr2\tLN:9000", "@SQ\tSN:chr1\tLN:9000"]
    places = [(x.split("\t")[0] != "chr2", int(x.split("\t")[1])) for x in got[3:]]
    assert places == sorted(places) and len(places) == 3000
    assert formats.sniff(spark, str(tmp_path / "il")) == "interval_list"
    numbered = text.numbered(spark, str(tmp_path / "il"))
    by_file = {}
    for r in numbered.collect():
        by_file.setdefault(r.file, []).append(r.line)
    assert sorted(len(x) for x in by_file.values()) == sorted(s for s in sizes if s) and all(sorted(x) == list(range(len(x))) for x in by_file.values())
    # Lines aren't moved to be numbered: each split is one row.
    plan = numbered._jdf.queryExecution().optimizedPlan().toString()
    assert "row_number" not in plan


def test_lines_of_a_file_read_in_many_splits_are_numbered(spark, tmp_path):
    from stranda.sources import lines as text

    path = put(tmp_path, "long.txt", "".join("\n" if i % 10 == 3 else f"{i}\n" for i in range(5000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        assert all(r.value in ("", str(r.line)) for r in text.numbered(spark, path).collect()) and text.numbered(spark, path).select("line").distinct().count() == 5000
        full = [str(i) for i in range(5000) if i % 10 != 3]
        assert [r.value for r in text.numbered(spark, path, skip_blank=True).orderBy("line").collect()] == full
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")

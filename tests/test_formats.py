import gzip

import pytest

from stranda.functions import variants
from stranda.sources import formats

HEADS = {
    "sam": b"@HD\tVN:1.6\n@SQ\tSN:c\tLN:9\nr\t0\tc\t1",
    "interval_list": b"@HD\tVN:1.6\n@SQ\tSN:c\tLN:9\nc\t1\t5\t+\tx\n",
    "bam": b"BAM\1....",
    "cram": b"CRAM\3\0",
    "vcf": b"##fileformat=VCFv4.2\n",
    "bcf": b"BCF\2\2",
    "gff3": b"##gff-version 3\n",
    "bed": b"track name=x\nchr1\t0\t10\n",
    "fasta": b">c1\nACGT\n",
    "fastq": b"@r1\nACGT\n+\nIIII\n",
}


@pytest.mark.parametrize("name", sorted(HEADS))
def test_formats_are_told_by_their_first_bytes(name):
    assert formats.sniff_bytes(HEADS[name]) == name and formats.sniff_bytes(gzip.compress(HEADS[name])) == name
    assert formats.sniff_bytes(b"") is None and formats.sniff_bytes(b"\x1f\x8bbroken") is None


def test_names_and_indexes_beside_files(spark, tmp_path):
    assert formats.by_name("/a/b.vcf.gz") == "vcf" and formats.by_name("x.FA") == "fasta" and formats.by_name("x.txt") is None
    (tmp_path / "a.bam.bai").write_bytes(b"")
    assert formats.index_beside(spark, str(tmp_path / "a.bam")) == str(tmp_path / "a.bam.bai") and formats.index_beside(spark, str(tmp_path / "b.bam")) is None


def test_files_open_by_content_and_own_formats_come_first(spark, tmp_path):
    (tmp_path / "reads").write_bytes(b"@HD\tVN:1.6\nr1\t4\t*\t0\t0\t*\t*\t0\t0\tAC\tII\n")
    assert [r.read_name for r in formats.open_path(spark, str(tmp_path / "reads")).collect()] == ["r1"]
    (tmp_path / "mine").write_bytes(b"MINE1")
    with pytest.raises(ValueError, match="no reader"):
        formats.open_path(spark, str(tmp_path / "mine"))
    formats.register("mine", lambda head: head[:4] == b"MINE", (".mine",), lambda s, path: s.read.text(path))
    try:
        assert formats.open_path(spark, str(tmp_path / "mine")).count() == 1
    finally:
        del formats.FORMATS["mine"]


def test_many_sites_at_once_are_tested_like_single_ones(monkeypatch):
    monkeypatch.setattr(variants, "HWE_CELLS", 7)
    sites = [(a, b, c) for a in range(6) for b in range(6) for c in range(6)] + [(-1, 2, 3), (500, 300, 90)]
    got = variants.hwe_all(*zip(*sites, strict=True)).tolist()
    assert got == pytest.approx([variants.hwe_of(*s) for s in sites])

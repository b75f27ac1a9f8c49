"""Telling formats apart by content and by name, and one way in and out for all of them.

A registry holds, for each format, what its first bytes look like, its file endings, and its reader; ``register`` adds formats of one's own.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stranda.sources import bam, features, sam, vcf
from stranda.sources import sequences as S

HEAD_BYTES = 1 << 16
#: Endings of index files next to a data file, by the data's format. Fixed values of the formats.
INDEX_ENDINGS = {"bam": (".bai", ".csi"), "cram": (".crai",), "vcf": (".tbi", ".idx", ".csi"), "bed": (".tbi", ".idx"), "gff3": (".tbi", ".idx"), "fasta": (".fai",)}


@dataclass(frozen=True)
class Format:
    name: str
    looks: Callable[[bytes], bool]
    endings: tuple[str, ...]
    read: Callable[[SparkSession, str], DataFrame] | None


FORMATS: dict[str, Format] = {}


def register(name: str, looks: Callable[[bytes], bool], endings: tuple[str, ...], read: Callable[[SparkSession, str], DataFrame] | None) -> None:
    """Adds a format, or replaces one of this name. Those added later are asked first."""
    FORMATS.pop(name, None)
    FORMATS[name] = Format(name, looks, endings, read)


def _line(pattern: str) -> Callable[[bytes], bool]:
    compiled = re.compile(pattern.encode())
    return lambda head: compiled.match(head) is not None


register("fastq", _line(r"@[^\n]*\n[A-Za-z.*~-]*\r?\n\+"), (".fastq", ".fq"), S.read_fastq)
register("fasta", _line(r">"), (".fasta", ".fa", ".fna"), S.read_fasta)
register("bed", _line(r"(?:(?:#|track|browser)[^\n]*\n)*[^\t\n@>]+\t[0-9]+\t[0-9]+"), (".bed",), features.read_bed)
register("gff3", _line(r"##gff-version\s+3"), (".gff3", ".gff"), features.read_gff3)
register("interval_list", _line(r"(?:@[A-Z]{2}\t[^\n]*\n)+[^\t\n]+\t[0-9]+\t[0-9]+\t[+-]\t"), (".interval_list",), features.read_interval_list)
register("vcf", _line(r"##fileformat=VCF"), (".vcf",), vcf.read)
register("bcf", lambda head: head[:4] == b"BCF\2", (".bcf",), None)
register("sam", lambda head: _line(r"@(?:HD|SQ|RG|PG|CO)\t")(head) and not FORMATS["interval_list"].looks(head), (".sam",), sam.read)
register("cram", lambda head: head[:4] == b"CRAM", (".cram",), None)
register("bam", lambda head: head[:4] == b"BAM\1", (".bam",), bam.read)


def inflated(head: bytes) -> bytes:
    """The beginning of what a gzip or BGZF file holds; other bytes as they are."""
    if head[:2] != b"\x1f\x8b":
        return head
    try:
        return zlib.decompressobj(31).decompress(head, HEAD_BYTES)
    except zlib.error:
        return head


def is_bgzf(head: bytes) -> bool:
    """Whether a gzip member has the extra field that blocks of this kind carry."""
    return head[:4] == b"\x1f\x8b\x08\x04" and head[12:16] == b"BC\x02\x00"


def sniff_bytes(head: bytes) -> str | None:
    """The format that a file's first bytes show."""
    plain = inflated(head)
    return next((f.name for f in reversed(FORMATS.values()) if f.looks(plain)), None)


def sniff(spark: SparkSession, path: str) -> str | None:
    """The format of a file, or of the first one in a folder, whose header may be a part of its own: by its first bytes, else by its name.

    Reads HEAD_BYTES at most.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(conf)
    if fs.getFileStatus(at).isDirectory():
        inside = sorted((f.getPath().getName(), f.getPath(), f.getLen()) for f in fs.listStatus(at) if f.isFile() and not f.getPath().getName().startswith(("_", ".")))
        files = [p for _, p, n in inside if n][:2]
    else:
        files = [at]
    head = b""
    for file in files:
        if len(head) >= HEAD_BYTES:
            break
        stream = fs.open(file)
        try:
            head += inflated(bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(jvm.org.apache.commons.io.input.BoundedInputStream(stream, HEAD_BYTES - len(head)))))
        finally:
            stream.close()
    return sniff_bytes(head) or by_name(path)


def by_name(path: str) -> str | None:
    """The format that a name's ending stands for; endings of compression are left out first."""
    name = re.sub(r"\.(?:gz|bgz|bgzf|zst)$", "", path.rstrip("/").lower())
    return next((f.name for f in reversed(FORMATS.values()) if name.endswith(f.endings)), None)


def open_path(spark: SparkSession, path: str, name: str | None = None) -> DataFrame:
    """Rows of a file of any registered format, which is told by its content unless it is given."""
    name = name or sniff(spark, path)
    if name not in FORMATS or FORMATS[name].read is None:
        raise ValueError(f"no reader for {name or 'this format'}: {path}")
    return FORMATS[name].read(spark, path)


def index_beside(spark: SparkSession, path: str) -> str | None:
    """The index file next to a data file, as ``data.ext.idx`` or ``data.idx``, if there is one."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    stem = re.sub(r"\.[^./]*$", "", path)
    for ending in INDEX_ENDINGS.get(by_name(path) or "", ()):
        for candidate in (path + ending, stem + ending):
            at = jvm.org.apache.hadoop.fs.Path(candidate)
            if at.getFileSystem(conf).exists(at):
                return candidate
    return None


def sniffed(files: DataFrame, content: str = "content") -> DataFrame:
    """Rows of ``binaryFile`` with ``format`` appended, told from their first bytes: for folders of many files."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("string")
    def kind(heads):
        return heads.map(lambda h: sniff_bytes(bytes(h)) if h is not None else None)

    return files.withColumn("format", kind(F.substring(content, 1, HEAD_BYTES)))

"""Schemas of the engine's tables. Coordinates are 1-based and closed; an empty interval ends at start - 1."""

from __future__ import annotations

READS = (
    "read_name string, flag int, ref string, start int, mapq int, cigar string, mate_ref string, mate_start int, "
    "tlen int, bases string, quals string, tags map<string,string>"
)
INTERVALS = "contig string, start int, end int, negative boolean, name string"
SEQUENCES = "ref_index int, name string, length bigint"
VARIANTS = "contig string, start int, stop int, id string, ref string, alts array<string>, qual double, filters array<string>, info map<string,string>, genotypes array<struct<sample:string,fields:map<string,string>>>"
FEATURES = "contig string, source string, type string, start int, end int, score double, strand string, phase int, attributes map<string,array<string>>"
FASTQ = "name string, bases string, qual_header string, quals string"
HISTOGRAM = "bin double, count double"

PAIRED, PROPER, UNMAPPED, MATE_UNMAPPED, REVERSE, MATE_REVERSE = 0x1, 0x2, 0x4, 0x8, 0x10, 0x20
FIRST, SECOND, SECONDARY, QC_FAIL, DUPLICATE, SUPPLEMENTARY = 0x40, 0x80, 0x100, 0x200, 0x400, 0x800

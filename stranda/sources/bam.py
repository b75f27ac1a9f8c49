"""Binary alignments: blocked gzip around records, as the public format specification lays them out.

A file is read by one task (Spark hands it over, from any store), so many files are read in parallel; records stream out block by block.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stranda.functions import cigar as C

BASES, OPS = "=ACMGRSVTWYHKDBN", "MIDNSHP=X"
COLUMNS = "read_name string, flag int, ref string, start int, mapq int, cigar string, mate_ref string, mate_start int, tlen int, bases string, quals string, tags map<string,string>, tag_types map<string,string>"
NUMBERS = {"c": "<b", "C": "<B", "s": "<h", "S": "<H", "i": "<i", "I": "<I", "f": "<f"}
EOF_BLOCK = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")


def inflate(data: bytes) -> Iterator[bytes]:
    """The blocks of a blocked gzip file; each says in its extra field how long it is."""
    view, at = memoryview(data), 0
    while at < len(data):
        if bytes(view[at : at + 4]) != b"\x1f\x8b\x08\x04":
            raise ValueError("not a block of a blocked gzip file")
        extra, size, k = struct.unpack_from("<H", data, at + 10)[0], None, at + 12
        while k < at + 12 + extra:
            a, b, n = struct.unpack_from("<BBH", data, k)
            if (a, b) == (66, 67):
                size = struct.unpack_from("<H", data, k + 4)[0] + 1
            k += 4 + n
        yield zlib.decompress(view[at : at + size], 31)
        at += size


def deflate(data: bytes) -> bytes:
    out = []
    for at in range(0, len(data), 0xFF00):
        part = data[at : at + 0xFF00]
        pack = zlib.compressobj(6, zlib.DEFLATED, -15)
        body = pack.compress(part) + pack.flush()
        out.append(struct.pack("<4BI2BH2BHH", 31, 139, 8, 4, 0, 0, 255, 6, 66, 67, 2, len(body) + 25) + body + struct.pack("<II", zlib.crc32(part), len(part)))
    return b"".join(out) + EOF_BLOCK


class Stream:
    """Bytes of a blocked gzip file, with no more than a block or two held."""

    def __init__(self, data: bytes):
        self.blocks, self.held = inflate(data), b""

    def take(self, n: int) -> bytes:
        while len(self.held) < n:
            more = next(self.blocks, None)
            if more is None:
                return b""
            self.held += more
        out, self.held = self.held[:n], self.held[n:]
        return out

    def number(self) -> int | None:
        got = self.take(4)
        return struct.unpack("<i", got)[0] if got else None


def read_header(stream: Stream) -> tuple[str, list[str]]:
    if stream.take(4) != b"BAM\1":
        raise ValueError("not a binary alignment file")
    text = stream.take(stream.number()).rstrip(b"\0").decode()
    names = []
    for _ in range(stream.number()):
        names.append(stream.take(stream.number())[:-1].decode())
        stream.take(4)
    return text, names


def tags_of(data: bytes) -> tuple[dict[str, str], dict[str, str]]:
    values, kinds, at = {}, {}, 0
    while at < len(data):
        name, kind = data[at : at + 2].decode(), chr(data[at + 2])
        at += 3
        if kind in "ZH":
            end = data.index(0, at)
            value, at = data[at:end].decode(), end + 1
        elif kind == "A":
            value, at = chr(data[at]), at + 1
        elif kind == "B":
            sub, n = chr(data[at]), struct.unpack_from("<i", data, at + 1)[0]
            code = NUMBERS[sub]
            size = struct.calcsize(code)
            value = ",".join([sub, *(f"{x:.9g}" if sub == "f" else str(x) for x in struct.unpack_from(f"<{n}{code[1]}", data, at + 5))])
            at += 5 + n * size
        else:
            value = struct.unpack_from(NUMBERS[kind], data, at)[0]
            at += struct.calcsize(NUMBERS[kind])
            value, kind = (f"{value:.9g}", "f") if kind == "f" else (str(value), "i")
        values[name], kinds[name] = value, kind
    return values, kinds


def record(data: bytes, names: list[str]) -> tuple:
    ref, pos, l_name, mapq, _, n_ops, flag, n, mate, mate_pos, tlen = struct.unpack_from("<iiBBHHHiiii", data)
    at = 32
    name = data[at : at + l_name - 1].decode()
    at += l_name
    cigar = "".join(f"{x >> 4}{OPS[x & 15]}" for x in struct.unpack_from(f"<{n_ops}I", data, at)) or "*"
    at += 4 * n_ops
    packed = data[at : at + (n + 1) // 2]
    bases = "".join(BASES[b >> 4] + BASES[b & 15] for b in packed)[:n] or "*"
    at += (n + 1) // 2
    raw = data[at : at + n]
    quals = "*" if not n or raw[0] == 255 else "".join(chr(q + 33) for q in raw)
    values, kinds = tags_of(data[at + n :])
    place = lambda k: names[k] if k >= 0 else None
    return name, flag, place(ref), pos + 1, mapq, cigar, place(mate), mate_pos + 1, tlen, bases, quals, values, kinds


def read(spark: SparkSession, path: str) -> DataFrame:
    """The same columns as alignments read from text."""
    names = [c.split()[0] for c in COLUMNS.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for content in frame["content"]:
                stream = Stream(content)
                _, contigs = read_header(stream)
                rows = []
                while (size := stream.number()) is not None:
                    rows.append(record(stream.take(size), contigs))
                    if len(rows) >= 5000:
                        yield pd.DataFrame(rows, columns=names)
                        rows = []
                yield pd.DataFrame(rows, columns=names)

    out = spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, COLUMNS)
    return out.withColumn("end", F.when(F.col("flag").bitwiseAND(4) == 0, C.alignment_end(F.col("start"), C.elements(F.col("cigar")))))


def header_text(spark: SparkSession, path: str) -> str:
    content = spark.read.format("binaryFile").load(path).select("content").first().content
    return read_header(Stream(bytes(content)))[0]


def encode_tag(name: str, kind: str, value: str) -> bytes:
    head = name.encode() + (kind.encode() if kind != "i" else b"i")
    if kind == "i":
        n = int(value)
        return name.encode() + (b"I" + struct.pack("<I", n) if n > 2**31 - 1 else b"i" + struct.pack("<i", n))
    if kind == "f":
        return head + struct.pack("<f", float(value))
    if kind == "A":
        return head + value.encode()
    if kind == "B":
        sub, *rest = value.split(",")
        numbers = [float(x) if sub == "f" else int(x) for x in rest]
        return head + sub.encode() + struct.pack(f"<i{len(numbers)}{NUMBERS[sub][1]}", len(numbers), *numbers)
    return head + value.encode() + b"\0"


def encode(row: tuple, index: dict[str, int]) -> bytes:
    name, flag, ref, start, mapq, cigar, mate_ref, mate_start, tlen, bases, quals, values, kinds = row
    import re

    from stranda.functions.coords import level_offset

    ops = [int(n) << 4 | OPS.index(o) for n, o in re.findall(r"(\d+)([MIDNSHP=X])", cigar or "")]
    bases = "" if bases in (None, "*") else bases
    codes = [max(BASES.find(b.upper()), 0) if b.upper() in BASES else 15 for b in bases] + [0] * (len(bases) % 2)
    packed = bytes(codes[i] << 4 | codes[i + 1] for i in range(0, len(codes), 2))
    raw = b"\xff" * len(bases) if quals in (None, "*") else bytes(ord(q) - 33 for q in quals)
    span = sum(x >> 4 for x in ops if OPS[x & 15] in "MDN=X") or 1
    first, last = (start or 0) - 1, (start or 0) + span - 2
    bin_ = 0
    for level in range(5, 0, -1):
        shift = 29 - 3 * level
        if first >> shift == last >> shift:
            bin_ = level_offset(level) + (first >> shift)
            break
    tags = b"".join(encode_tag(k, (kinds or {}).get(k, "Z"), v) for k, v in sorted((values or {}).items()))
    body = struct.pack("<iiBBHHHiiii", index.get(ref, -1), (start or 0) - 1, len(name) + 1, mapq or 0, bin_ & 0xFFFF, len(ops), flag, len(bases), index.get(mate_ref, -1), (mate_start or 0) - 1, tlen or 0)
    body += name.encode() + b"\0" + struct.pack(f"<{len(ops)}I", *ops) + packed + raw + tags
    return struct.pack("<i", len(body)) + body


def encode_file(header: str, sequences: list[tuple[str, int]], rows: Iterator[tuple]) -> bytes:
    """A whole file's bytes, of rows in the order of COLUMNS."""
    index = {n: i for i, (n, _) in enumerate(sequences)}
    text = header.encode()
    head = b"BAM\1" + struct.pack("<i", len(text)) + text + struct.pack("<i", len(sequences))
    head += b"".join(struct.pack("<i", len(n) + 1) + n.encode() + b"\0" + struct.pack("<i", size) for n, size in sequences)
    return deflate(head + b"".join(encode(r, index) for r in rows))


def encoded_parts(reads: DataFrame, header: str, sequences: list[tuple[str, int]]) -> DataFrame:
    """(part, content): each partition as a file of its own, for a writer of binary files."""
    names = [c.split()[0] for c in COLUMNS.split(", ")]
    have = set(reads.columns)
    empty = F.create_map().cast("map<string,string>")
    rows = reads.select(*[n if n in have else empty.alias(n) for n in names], F.spark_partition_id().alias("part"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept, part = [], None
        for frame in frames:
            part = int(frame["part"].iloc[0]) if len(frame) else part
            kept += [tuple(dict(x) if isinstance(x, list) else x for x in r[:-1]) for r in frame.itertuples(index=False, name=None)]
        if part is not None:
            yield pd.DataFrame({"part": [part], "content": [encode_file(header, sequences, iter(kept))]})

    return rows.mapInPandas(run, "part int, content binary")

"""Line dedup: sharded cuckoo filters backed by exact reference-count tables.

A line's key is the line stripped of ASCII white space and lower-cased in A-Z; it is counted by its 128-bit digest. The reference
table holds, for each key, in how many documents it stands; the cuckoo filters hold the keys that stand in ``min_docs`` documents or
more, and take insertions and deletions. Applying the state, every line is looked up in its shard's filter, however large the state: the filters are
files that Spark hands to each executor and that workers memory-map. What may be there is settled by the exact table, so no line is lost to a
false positive: by a broadcast of its frequent keys where they are EXACT_BYTES at most, else by a join with those lines that the filters let
through. Deleting documents lowers the counts, so lines come back: the dedup is reversible. Shards grow in number with the frequent keys.

Defined results: a null or empty text has one empty line; empty keys (under ``min_chars`` code points) always stay; repeated rows
count once for each row; documents deleted before they are inserted leave negative counts, which their insertion makes up for; tables without
rows give tables without rows; other columns pass through, but for one that has an appended column's name, which is replaced.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stranda.llm import common

SPACE = b" \t\n\x0b\x0c\r"
#: Frequent keys in a shard at most, about; a shard's filter is made in one task. Shards are a power of two.
SHARD_KEYS = 250_000
#: Bytes of exact keys that may be broadcast; beyond, what the filters let through is joined with the exact table.
EXACT_BYTES = 16 << 20
SLOTS, KICKS = 4, 500

REFS = "key binary, n_docs bigint"
FILTERS = "shard int, buckets bigint, cells binary"


def line_key(line: bytes) -> bytes:
    return line.strip(SPACE).lower()


def digests(text: bytes, min_chars: int) -> list[bytes | None]:
    """The digest of each line's key; None for a line that always stays."""
    digest, out = xxhash.xxh3_128_digest, []
    for line in text.split(b"\n"):
        key = line.strip(SPACE).lower()
        out.append(digest(key) if key and (min_chars <= 1 or len(key.decode()) >= min_chars) else None)
    return out


class CuckooFilter:
    """Fingerprints of 16 bits in buckets of four; each key has two buckets. Supports deletion of what was inserted."""

    def __init__(self, buckets: int = 64, cells: np.ndarray | None = None):
        self.buckets = buckets
        self.cells = np.zeros((buckets, SLOTS), np.uint16) if cells is None else cells

    @classmethod
    def sized(cls, keys: int) -> CuckooFilter:
        buckets = 64
        while buckets * SLOTS * 0.85 < keys:
            buckets *= 2
        return cls(buckets)

    @classmethod
    def load(cls, buckets: int, cells: bytes) -> CuckooFilter:
        return cls(buckets, np.frombuffer(cells, np.uint16).reshape(buckets, SLOTS).copy())

    def dump(self) -> bytes:
        return self.cells.tobytes()

    def places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Fingerprint and both buckets of digests, an array (n, 16) of bytes."""
        words = np.ascontiguousarray(keys).view("<u4").reshape(-1, 4).astype(np.uint64)
        mask = np.uint64(self.buckets - 1)
        prints = words[:, 2] & np.uint64(0xFFFF)
        prints = np.where(prints == 0, np.uint64(1), prints)
        first = words[:, 1] & mask
        return prints.astype(np.uint16), first.astype(np.int64), (first ^ self._jump(prints)).astype(np.int64)

    def _jump(self, prints):
        return (prints * np.uint64(0x5BD1E995) >> np.uint64(3)) & np.uint64(self.buckets - 1)

    def might_contain(self, keys: np.ndarray) -> np.ndarray:
        prints, one, two = self.places(keys)
        return (self.cells[one] == prints[:, None]).any(axis=1) | (self.cells[two] == prints[:, None]).any(axis=1)

    def insert(self, keys: np.ndarray) -> bool:
        """False if the filter is too full; it then must be built anew, larger, from the exact table."""
        cells, rng = self.cells, 1
        for mark, one, two in zip(*(x.tolist() for x in self.places(keys)), strict=True):
            for at in (one, two):
                free = np.flatnonzero(cells[at] == 0)
                if len(free):
                    cells[at, free[0]] = mark
                    break
            else:
                at = two
                for _ in range(KICKS):
                    rng = (rng * 1103515245 + 12345) & 0x7FFFFFFF
                    slot = rng >> 16 & (SLOTS - 1)
                    mark, cells[at, slot] = int(cells[at, slot]), mark
                    at ^= int(self._jump(np.uint64(mark)))
                    free = np.flatnonzero(cells[at] == 0)
                    if len(free):
                        cells[at, free[0]] = mark
                        break
                else:
                    return False
        return True

    def delete(self, keys: np.ndarray) -> None:
        for mark, one, two in zip(*(x.tolist() for x in self.places(keys)), strict=True):
            for at in (one, two):
                held = np.flatnonzero(self.cells[at] == mark)
                if len(held):
                    self.cells[at, held[0]] = 0
                    break


def as_array(keys: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(keys), np.uint8).reshape(-1, 16)


def built(keys: np.ndarray) -> CuckooFilter:
    size = len(keys)
    while not (made := CuckooFilter.sized(size)).insert(keys):
        size = size * 2 + 64
    return made


def count_lines(docs: DataFrame, min_chars: int = 1, text: str = "text") -> DataFrame:
    """(key, n_docs): in how many rows each key stands; summed within a task before it is sent."""

    def run(parts: Iterator[list[pa.Array]]) -> Iterator[list]:
        counts: Counter = Counter()
        for (column,) in parts:
            for t in common.utf8(column):
                counts.update({d for d in digests(t, min_chars) if d})
            if len(counts) > 200_000:
                yield [list(counts), list(counts.values())]
                counts.clear()
        yield [list(counts), list(counts.values())]

    return common.emit(docs, REFS, run, [text]).groupBy("key").agg(F.sum("n_docs").alias("n_docs"))


def shard_of(key, shards: int):
    """A key's shard: its first four bytes, as a number, modulo the shards."""
    return F.pmod(F.conv(F.hex(F.substring(key, 1, 4)), 16, 10).cast("long"), F.lit(shards)).cast("int")


def shards_of(keys: np.ndarray, shards: int) -> np.ndarray:
    return np.ascontiguousarray(keys[:, :4]).view(">u4").ravel().astype(np.int64) % shards


class LineDedup:
    """State of an incremental line dedup: exact reference counts and filters, both written in the shared folder."""

    def __init__(self, spark: SparkSession, min_docs: int = 10, min_chars: int = 1, exact_bytes: int = EXACT_BYTES, shard_keys: int = SHARD_KEYS):
        self.spark, self.min_docs, self.min_chars, self.exact_bytes, self.shard_keys = spark, min_docs, min_chars, exact_bytes, shard_keys
        self.refs = spark.createDataFrame([], REFS)
        self.filters = spark.createDataFrame([], FILTERS)
        self.shards, self.n_hot = 1, 0

    def insert(self, docs: DataFrame, text: str = "text") -> LineDedup:
        return self._change(count_lines(docs, self.min_chars, text), 1)

    def delete(self, docs: DataFrame, text: str = "text") -> LineDedup:
        """Takes back documents that were inserted."""
        return self._change(count_lines(docs, self.min_chars, text), -1)

    def _change(self, delta: DataFrame, sign: int) -> LineDedup:
        least, zero = self.min_docs, F.lit(0).cast("long")
        if self.refs.isEmpty():
            changed = delta.select("key", zero.alias("old"), (F.col("n_docs") * sign).alias("new"))
        else:
            changed = (
                self.refs.select("key", F.col("n_docs").alias("old"), zero.alias("d"))
                .unionByName(delta.select("key", zero.alias("old"), (F.col("n_docs") * sign).alias("d")))
                .groupBy("key")
                .agg(F.sum("old").alias("old"), (F.sum("old") + F.sum("d")).alias("new"))
            )
        changed = common.save(changed, "line-changes")
        self.refs = changed.filter("new <> 0").select("key", F.col("new").alias("n_docs"))
        self.n_hot = self.hot().count()
        shards = 1
        while shards * self.shard_keys < self.n_hot:
            shards *= 2
        grown, self.shards = shards > self.shards, max(shards, self.shards)
        shard = shard_of(F.col("key"), self.shards).alias("shard")
        none = F.lit(None).cast("long").alias("buckets")
        # What each shard needs: its filter, the keys that crossed the threshold, and, for a rebuild, all its keys.
        parts = self.hot().select(shard, "key", F.lit(0).alias("kind"), none)
        if not grown:  # else all filters are made anew
            crossing = changed.filter((F.col("old") >= least) != (F.col("new") >= least))
            parts = parts.unionByName(crossing.select(shard, "key", F.when(F.col("new") >= least, 1).otherwise(2).alias("kind"), none)).unionByName(
                self.filters.select("shard", F.col("cells").alias("key"), F.lit(3).alias("kind"), "buckets")
            )
        self.filters = common.save(parts.groupBy("shard").applyInPandas(update_filter, FILTERS), "line-filters")
        return self

    def hot(self) -> DataFrame:
        """The keys whose lines go."""
        return self.refs.filter(F.col("n_docs") >= self.min_docs).select("key")

    def _filter_file(self) -> str:
        """All shards' filters in one file that Spark hands out; the driver holds one shard's at a time. Its name.

        The file begins with the number of shards and each one's buckets (none: no key).
        """
        sizes = {r.shard: r.buckets for r in self.filters.select("shard", "buckets").collect()}
        head = np.array([self.shards, *(sizes.get(k, 0) for k in range(self.shards))], np.int64).tobytes()
        cells = (bytes(r.cells) for r in self.filters.orderBy("shard").select("cells").toLocalIterator())
        return common.put_parts(self.spark, "line-filters", chain([head], cells))

    def dropped_lines(self, docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
        """Every row with its kept text and line counts appended: kept_text, n_lines, n_dropped. ``keep``: the columns that go on (all, if None)."""
        fields = [T.StructField("kept_text", T.StringType()), T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())]
        return self._applied(docs, fields, kept_text, text, keep)

    def digests(self, docs: DataFrame, text: str = "text") -> DataFrame:
        """Every row with n_lines, n_dropped and the SHA-256 of its kept text appended."""
        fields = [T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType()), T.StructField("kept_sha256", T.StringType())]
        return self._applied(docs, fields, kept_digest, text)

    def _applied(self, docs: DataFrame, fields, shape, text: str, keep: list[str] | None = None) -> DataFrame:
        least, name = self.min_chars, self._filter_file()
        if self.n_hot * 16 > self.exact_bytes:
            return self._joined(docs, fields, shape, text, name, keep)
        shared = self.spark.sparkContext.broadcast(b"".join(self.hot().toArrow()["key"].to_pylist()))

        def setup():
            data = shared.value
            return Filters(SparkFiles.get(name)), frozenset(data[i : i + 16] for i in range(0, len(data), 16))

        def run(state, column):
            filters, exact = state
            return shape(column, [[d in exact for d in found] for found in filters.passed([digests(t, least) for t in common.utf8(column)])])

        return common.add_columns(docs, fields, run, [text], setup, keep)

    def _joined(self, docs: DataFrame, fields, shape, text: str, name: str, keep: list[str] | None) -> DataFrame:
        """For more exact keys than may be broadcast: lines that the filters let through are joined with the exact table; skewed keys are split by AQE."""
        least = self.min_chars

        def keys_of(filters, parts):
            for (column,) in parts:
                texts = common.utf8(column)
                pairs = [(text_id(t), d) for t, found in zip(texts, filters.passed([digests(t, least) for t in texts]), strict=True) for d in {d for d in found if d}]
                yield [[p[0] for p in pairs], [p[1] for p in pairs]]

        keys = common.emit(docs, "uid binary, key binary", lambda parts: keys_of(Filters(SparkFiles.get(name)), parts), [text])
        # Equal texts share an id, so the set of a text's keys is bounded by its lines.
        found = keys.join(self.hot(), "key", "left_semi").groupBy("uid").agg(F.collect_set("key").alias("gone"))
        names = {f.name for f in fields}
        kept = [c for c in (docs.columns if keep is None else keep) if c not in names]
        rows = docs.select(struct_of(kept).alias("row"), F.col(f"`{text}`").alias("text"))
        rows = common.add_columns(rows, [T.StructField("uid", T.BinaryType())], lambda _, column: [[text_id(t) for t in common.utf8(column)]], ["text"], keep=["row", "text"])
        both = rows.join(found, "uid", "left")

        def run(state, column, gone):
            sets = [set(g) if g else frozenset() for g in gone.to_pylist()]
            return shape(column, [[d in s for d in digests(t, least)] for t, s in zip(common.utf8(column), sets, strict=True)])

        made = common.add_columns(both, fields, run, ["text", "gone"], keep=["row"])
        return made.select(*[F.col(f"row.`{c}`") for c in kept], *names_of(fields))


def struct_of(columns: list[str]) -> Column:
    """The columns as one struct; of none, a number."""
    return F.struct(*[F.col(f"`{c}`") for c in columns]) if columns else F.lit(0)


def names_of(fields: list[T.StructField]) -> list[str]:
    return [f.name for f in fields]


def text_id(text: bytes) -> bytes:
    return xxhash.xxh3_128_digest(text)


class Filters:
    """The filters of all shards, memory-mapped from their file."""

    def __init__(self, path: str):
        data = np.memmap(path, np.uint8, "r")
        self.shards = int(data[:8].view(np.int64)[0])
        sizes = data[8 : 8 + 8 * self.shards].view(np.int64).tolist()
        at = 8 + 8 * self.shards
        self.filters: list[CuckooFilter | None] = []
        for buckets in sizes:
            size = 2 * SLOTS * buckets
            self.filters.append(CuckooFilter(buckets, data[at : at + size].view(np.uint16).reshape(buckets, SLOTS)) if buckets else None)
            at += size

    def passed(self, texts: list[list[bytes | None]]) -> list[list[bytes | None]]:
        """The digests that their shard's filter may hold; None for all others."""
        out = [[None] * len(found) for found in texts]
        places = [(i, j) for i, found in enumerate(texts) for j, d in enumerate(found) if d]
        if not places:
            return out
        keys = as_array([texts[i][j] for i, j in places])
        of = shards_of(keys, self.shards)
        for shard in np.unique(of).tolist() if self.shards > 1 else [0]:
            if self.filters[shard] is not None:
                mine = np.flatnonzero(of == shard)
                for k in mine[self.filters[shard].might_contain(keys[mine])].tolist():
                    i, j = places[k]
                    out[i][j] = texts[i][j]
        return out


def update_filter(rows: pd.DataFrame) -> pd.DataFrame:
    """One shard's filter after its changes."""
    shard = int(rows["shard"].iloc[0])
    of = lambda kind: as_array(list(rows["key"][rows["kind"] == kind]))
    old = rows[rows["kind"] == 3]
    made = None
    if len(old):
        made = CuckooFilter.load(int(old["buckets"].iloc[0]), old["key"].iloc[0])
        made.delete(of(2))
        if not made.insert(of(1)):
            made = None
    if made is None:
        made = built(of(0))
    return pd.DataFrame({"shard": [shard], "buckets": [made.buckets], "cells": [made.dump()]})


def kept_lines(column: pa.Array, gone: list[list[bool]]) -> Iterator[tuple[bytes, int, int]]:
    for text, out in zip(common.utf8(column), gone, strict=True):
        n = sum(out)
        yield (b"\n".join(line for line, go in zip(text.split(b"\n"), out, strict=True) if not go) if n else text), len(out), n


def kept_text(column: pa.Array, gone: list[list[bool]]) -> list:
    rows = list(kept_lines(column, gone))
    return [[r[0].decode() for r in rows], [r[1] for r in rows], [r[2] for r in rows]]


def kept_digest(column: pa.Array, gone: list[list[bool]]) -> list:
    rows = list(kept_lines(column, gone))
    return [[r[1] for r in rows], [r[2] for r in rows], [hashlib.sha256(r[0]).hexdigest() for r in rows]]


def deduplicated(docs: DataFrame, min_docs: int = 10, text: str = "text") -> DataFrame:
    """All rows, with frequent lines taken out of their texts; ``n_chars``, if there, becomes the new length. A null text stays null."""
    state = LineDedup(docs.sparkSession, min_docs).insert(docs, text)
    others = [c for c in docs.columns if c != text]
    # A text goes to the workers once and comes back once.
    rows = docs.select(struct_of(others).alias("row"), F.col(f"`{text}`").isNull().alias("absent"), F.col(f"`{text}`").alias("text"))
    rows = state.dropped_lines(rows, keep=["row", "absent"])
    new = F.when(~F.col("absent"), F.col("kept_text"))
    out = {c: new if c == text else F.col(f"row.`{c}`") for c in docs.columns}
    if "n_chars" in others:
        out["n_chars"] = F.when(F.col("n_dropped") > 0, F.length(new)).otherwise(out["n_chars"]).cast(docs.schema["n_chars"].dataType)
    return rows.select(*[v.alias(c) for c, v in out.items()])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents", "doc_id", "text")
    state = LineDedup(spark, min_docs=10, min_chars=1).insert(docs)
    return state.digests(docs).select("doc_id", "n_lines", "n_dropped", "kept_sha256")


SQL = r"""
WITH lines AS (
  SELECT rid, doc_id, u.i AS i, u.line AS line,
         translate(regexp_replace(u.line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
       LATERAL (SELECT unnest(ls) AS line, unnest(range(len(ls))) AS i) AS u),
hot AS (SELECT k FROM lines WHERE k <> '' GROUP BY k HAVING count(DISTINCT rid) >= 10)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(h.k)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE h.k IS NULL), '')) AS kept_sha256
FROM lines LEFT JOIN hot h ON lines.k = h.k GROUP BY rid, doc_id
"""

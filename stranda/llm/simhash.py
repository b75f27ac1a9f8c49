"""SimHash near-dedup: byte-position inverted index with count filtering.

A fingerprint has 64 bits: a bit is 1 if it is set in over half of the hashes of a text's word shingles, repeats included. Two
fingerprints that differ in at most 3 bits share at least 5 of their 8 positional bytes. The index posts each distinct fingerprint
under sets of four positional bytes: 14 sets such that any three differing bytes miss at least one of them, so each pair that can
reach 5 shared bytes meets under some set. For pairs that meet, the shared positional bytes are tallied, pairs under the guaranteed minimum
are dropped, and the rest verified bit by bit. A posting list gives a spanning forest of its links, never all pairs, and lists
longer than LONG are posted again under a fifth byte, where at most 2**24 fingerprints can differ, and split by shared runs of bits while they
are longer still, so what is tallied is always a short list.

Defined results: a null or empty text has fingerprint zero, linked like any other; fewer words than a shingle make one shingle;
repeated rows and ties fall in one component, named by its smallest doc_id (nulls never name one, unless all are null); tables
without rows give tables without rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stranda.llm import common

BITS, SEED = 3, 42
#: A posting list of more fingerprints is posted again under a fifth byte, and, if it still is longer, under runs of its bits within its task.
LONG = 12_000


def covering() -> list[tuple[int, ...]]:
    """Sets of 4 of the 8 positions of which one at least avoids any 3 positions: the smallest greedy choice, self-complementary."""
    # The 14 words of weight four of the extended Hamming code of length 8: every 3 positions lie in exactly one of them, and
    # their complements are words as well.
    rows = (0b11110000, 0b11001100, 0b10101010, 0b11111111)
    words = set()
    for pick in range(16):
        word = 0
        for k, r in enumerate(rows):
            if pick >> k & 1:
                word ^= r
        words.add(word)
    return sorted(tuple(i for i in range(8) if w >> i & 1) for w in words if bin(w).count("1") == 4)


SETS = covering()


def fingerprint(text: bytes, size: int = 3) -> int:
    """Of UTF-8 text."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) <= size:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    hashes = np.array([digest(join(w), SEED) for w in zip(*(words[k:] for k in range(size)), strict=False)], dtype=np.uint64)
    return from_hashes(hashes)


def from_hashes(hashes: np.ndarray) -> int:
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, size: int = 3, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Rows with ``fp`` appended, the fingerprint as a signed long."""
    run = lambda _, column: [[signed(fingerprint(t, size)) for t in common.utf8(column)]]
    return common.add_columns(docs, [T.StructField("fp", T.LongType())], run, [text], keep=keep)


def pos_bytes(fps: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(fps.astype("<i8")).view(np.uint8).reshape(-1, 8)


def postings(fps: DataFrame) -> DataFrame:
    """(key, fp): each fingerprint under each set; the key is the set's number and its four bytes."""

    def run(parts: Iterator[list[pa.Array]]) -> Iterator[list]:
        for (column,) in parts:
            values = column.to_numpy(zero_copy_only=False)
            data = pos_bytes(values).astype(np.int64)
            keys = [(np.int64(s) << 32) | data[:, a] << 24 | data[:, b] << 16 | data[:, c] << 8 | data[:, d] for s, (a, b, c, d) in enumerate(SETS)]
            yield [pa.array(np.concatenate(keys)), pa.array(np.tile(values, len(keys)))]

    return common.emit(fps, "key bigint, fp bigint", run, ["fp"])


def fifth_byte(posts: DataFrame) -> DataFrame:
    """Postings of long lists again, under each fifth byte: at most three of the four others differ, so a pair still meets."""

    def run(parts):
        for keys, column in parts:
            k, values = keys.to_numpy(zero_copy_only=False), column.to_numpy(zero_copy_only=False)
            data, sets = pos_bytes(values).astype(np.int64), (k >> 32).astype(np.int64)
            rest = np.array([[p for p in range(8) if p not in s] for s in SETS])[sets]
            out = [k << 12 | np.int64(j) << 8 | np.take_along_axis(data, rest[:, j : j + 1], axis=1).ravel() for j in range(4)]
            yield [pa.array(np.concatenate(out)), pa.array(np.tile(values, 4))]

    return common.emit(posts, "key bigint, fp bigint", run, ["key", "fp"])


def free_bits(plain: np.ndarray) -> list[int]:
    """Bits in which some of these fingerprints differ."""
    every = int(np.bitwise_or.reduce(plain) ^ np.bitwise_and.reduce(plain)) if len(plain) else 0
    return [k for k in range(64) if every >> k & 1]


def forest(values: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among distinct fingerprints: (fingerprint, smallest of its component here) pairs."""
    values = np.unique(values)
    n = len(values)
    parent = np.arange(n)

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def union(i: int, others: np.ndarray) -> None:
        for j in others.tolist():
            a, b = find(i), find(j)
            if a != b:
                parent[max(a, b)] = min(a, b)

    data, plain = pos_bytes(values), values.view(np.uint64)
    open_ = [(np.arange(n), free_bits(plain))]
    while open_:
        rows, free = open_.pop()
        if len(rows) <= LONG:
            for k, i in enumerate(rows[:-1].tolist()):
                # The tally of shared positional bytes, then the exact check for pairs that reach the minimum.
                near = rows[k + 1 :][(data[rows[k + 1 :]] == data[i]).sum(axis=1) >= 8 - bits]
                near = near[np.bitwise_count(plain[near] ^ plain[i]) <= bits]
                if len(near):
                    union(i, np.unique(parent[near]))
            continue
        # Too many to compare: of bits + 1 runs of the bits that differ at all, a pair has one in common; each is a shorter list.
        for run in np.array_split(np.array(free), bits + 1):
            mask = np.uint64(sum(1 << int(k) for k in run))
            order = rows[np.argsort(plain[rows] & mask, kind="stable")]
            for some in np.split(order, np.flatnonzero(np.diff(plain[order] & mask)) + 1):
                if len(some) > 1:
                    open_.append((np.sort(some), [k for k in free if not int(mask) >> k & 1]))
    roots = np.array([find(i) for i in range(n)], dtype=np.int64) if n else np.zeros(0, np.int64)
    mine = np.flatnonzero(roots != np.arange(n))
    return values[mine], values[roots[mine]]


def solve(rows: pd.DataFrame) -> pd.DataFrame:
    a, b = forest(rows["fp"].to_numpy())
    return pd.DataFrame({"a": a, "b": b})


def links(fps: DataFrame) -> DataFrame:
    """(a, b): links between distinct fingerprints whose components are those of all links of at most 3 bits."""
    posts = postings(fps)
    sizes = posts.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    # Nearly all lists hold one fingerprint; only the others are gathered.
    shared = common.save(posts.join(sizes, "key"), "simhash-postings")
    short = shared.filter(F.col("n") <= LONG)
    long = fifth_byte(shared.filter(F.col("n") > LONG))
    # A list's cost isn't in its bytes, so lists are dealt to a fixed number of tasks.
    parts = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    both = short.select("key", "fp").unionByName(long).repartition(parts, "key")
    return both.groupBy("key").applyInPandas(solve, "a bigint, b bigint").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of nodes that have links: the smallest node reachable, by alternating large and small stars.

    Links are re-hung on the smallest neighbour until nothing changes; each round is written to the shared folder. Groups are only ever
    aggregated, and joined back, so a node with very many links isn't gathered in one task.
    """
    edges = common.save(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "links")
    if edges.isEmpty():
        return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        edges = common.save(small, "links")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now


def near_duplicates(docs: DataFrame, size: int = 3, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, fp, component_id) for each row."""
    return rooted(docs, size, text, doc_id).select(doc_id, "fp", "component_id")


def rooted(docs: DataFrame, size: int, text: str, doc_id: str) -> DataFrame:
    """(doc_id, fp, root, component_id): with the component's smallest fingerprint."""
    marked = common.save(fingerprints(docs, size, text, keep=[doc_id]), "fingerprints")
    distinct = marked.groupBy("fp").agg(F.min(doc_id).alias("least"))
    distinct = common.save(distinct, "fingerprint-groups")
    roots = components(links(distinct))
    groups = common.save(distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "fingerprint-roots")
    named = groups.groupBy("root").agg(F.min("least").alias("component_id"))
    return marked.join(groups.join(named, "root").select("fp", "root", "component_id"), "fp").select(doc_id, "fp", "root", "component_id")


def kept(docs: DataFrame, size: int = 3, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row of each component, with its own columns: the one with the smallest doc_id (null only if all are)."""
    found = rooted(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), size, "text", "doc_id")
    first = found.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("root").agg(F.min(F.struct("doc_id", "fp")).alias("r"))
    first = first.select(F.col("r.doc_id").alias("__id"), F.col("r.fp").alias("__fp"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), F.col(doc_id).alias("__doc"), F.col(text).alias("__text"))
    marked = fingerprints(rows, size, "__text", keep=["__row", "__doc"])
    stay = marked.join(first, F.col("__doc").eqNullSafe(F.col("__id")) & (F.col("fp") == F.col("__fp")), "left_semi")
    # Repeated rows of one document are one document.
    return stay.dropDuplicates(["__doc", "fp"]).select("__row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents", "doc_id", "text")
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")

"""Token-ID output: a content-addressed store of id streams.

Each document's ids are cut into chunks where a rolling hash of the last WINDOW ids says so, so equal passages give equal chunks wherever
they stand. A store is a folder of three Parquet tables, which Spark writes and commits as it does any table:

* ``chunks``: digest (SHA-256 of the payload), n_ids, payload (ids as little-endian unsigned integers of ``id_bytes`` bytes), each
  distinct chunk once;
* ``recipes``: part, seq, doc_id, n_tokens, digests (of its chunks, in order), root (Merkle root over the digests), sorted by
  doc_id within a part, parts in ascending order of doc_id;
* ``manifest``: part, n_docs, n_tokens, start (ids in all parts before), root (Merkle root over the documents' roots), id_bytes.

Readers check every payload against its digest and every document against its root, and fail on a difference.

Defined results: a null or empty text is just the end id; a null doc_id comes first; repeated rows are documents of their own, in the
order in which they were read; a table without rows gives a store without documents.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stranda.llm import common, encoders

END_ID = 1
WINDOW, LEAST, MOST, MASK_BITS = 8, 128, 2048, 9
#: Documents in a run whose Merkle root is folded at once (a power of two, so the roots over runs are those over documents), and in a part.
BLOCK, PART = 1 << 16, 1 << 20
#: Words that an encoder remembers.
WORDS = 1_200_000
#: Odd multipliers of the rolling hash: powers of one number.
POWERS = np.cumprod(np.full(WINDOW, 0x9E3779B97F4A7C15, np.uint64), dtype=np.uint64)
EMPTY_ROOT = hashlib.sha256(b"").digest()


def cuts(ids: np.ndarray) -> list[int]:
    """Ends of the chunks of an id stream, each of LEAST to MOST ids but for the last."""
    n = len(ids)
    if n <= LEAST:
        return [n]
    wide = ids.astype(np.uint64)
    rolling = np.zeros(n, np.uint64)
    for k in range(WINDOW):
        rolling[k:] += wide[: n - k] * POWERS[k]
    places = np.flatnonzero(rolling >> np.uint64(64 - MASK_BITS) == 0) + 1
    out, last, at = [], 0, 0
    while n - last > LEAST:
        at = max(at, int(np.searchsorted(places, last + LEAST)))
        cut = int(places[at]) if at < len(places) else n
        cut = min(cut, last + MOST, n)
        out.append(cut)
        last = cut
    if last < n:
        out.append(n)
    return out


def merkle(digests: list[bytes]) -> bytes:
    """Root of a binary tree of SHA-256 over the digests; an odd one at a level's end moves up."""
    if not digests:
        return EMPTY_ROOT
    level = list(digests)
    while len(level) > 1:
        pairs = [hashlib.sha256(level[i] + level[i + 1]).digest() for i in range(0, len(level) - 1, 2)]
        level = pairs + level[len(level) - 1 :] * (len(level) % 2)
    return level[0]


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, drops_space: bool = True, text: str = "text", doc_id: str = "doc_id") -> str:
    """Encodes documents and writes a store; its path."""
    spark = docs.sparkSession
    id_bytes = 2 if encoders.encoder(tokenizer, drops_space).tokenizer.get_vocab_size() <= 1 << 16 > end_id else 4
    end = np.array([end_id], "<u4")
    kind = f"<u{id_bytes}"

    def encode(parts) -> Iterator[list]:
        coder = encoders.encoder(tokenizer, drops_space, WORDS)
        seen: set[bytes] = set()  # chunks that this task has sent already; a new set when it is large
        for ids, column in parts:
            out = [ids, [], [], []]
            for found in coder.encode_column(column):
                tokens = np.append(found, end)
                digests, payloads, start = [], [], 0
                data = tokens.astype(kind).tobytes()
                for cut in cuts(tokens):
                    payload = data[start * id_bytes : cut * id_bytes]
                    digest = hashlib.sha256(payload).digest()
                    digests.append(digest)
                    payloads.append(None if digest in seen else payload)
                    seen.add(digest)
                    start = cut
                if len(seen) > 200_000:
                    seen.clear()
                out[1].append(len(tokens))
                out[2].append(digests)
                out[3].append(payloads)
            yield out

    kind_of_id = docs.schema[doc_id].dataType.simpleString()
    staged = common.emit(docs, f"doc_id {kind_of_id}, n_tokens bigint, digests array<binary>, payloads array<binary>", encode, [doc_id, text], rows=4096)
    staged = common.save(staged.withColumn("uid", F.monotonically_increasing_id()), "encoded")

    sent = staged.select(F.explode(F.arrays_zip("digests", "payloads")).alias("c")).select(F.col("c.digests").alias("digest"), F.col("c.payloads").alias("payload")).filter("payload is not null")
    sent.groupBy("digest").agg(F.first("payload").alias("payload")).select("digest", (F.length("payload") / id_bytes).cast("long").alias("n_ids"), "payload").write.option("compression", "zstd").parquet(f"{path}/chunks")

    def rooted(state, column):
        return [[merkle(d) for d in column.to_pylist()]]

    from pyspark.sql import types as T

    light = staged.select("uid", "doc_id", "n_tokens", "digests")
    # Parts grow in number with the documents, so none holds more than about PART of them.
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), -(-staged.count() // PART))
    ordered = light.repartitionByRange(parts, F.col("doc_id").asc_nulls_first(), "uid").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "uid")
    numbered = ordered.select(F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("seq"), "doc_id", "n_tokens", "digests")
    common.add_columns(numbered, [T.StructField("root", T.BinaryType())], rooted, ["digests"]).write.parquet(f"{path}/recipes")

    recipes = spark.read.parquet(f"{path}/recipes")
    # Roots of aligned runs of BLOCK documents first, so a task gathers BLOCK rows at most, then the root over a part's runs.
    blocks = folded(recipes.select("part", (F.col("seq") / BLOCK).cast("long").alias("block"), "seq", F.lit(1).cast("long").alias("n_docs"), "n_tokens", "root"), ["part", "block"], "seq")
    parts = folded(blocks, ["part"], "block")
    before = F.sum("n_tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))  # one row for each part
    parts.withColumn("start", F.coalesce(before, F.lit(0))).withColumn("id_bytes", F.lit(id_bytes)).coalesce(1).write.parquet(f"{path}/manifest")
    return path


def folded(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """(keys, n_docs, n_tokens, root) of each group: sums, and the Merkle root over the roots in order."""

    def fold(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(order)
        return pd.DataFrame({**{k: [group[k].iloc[0]] for k in keys}, "n_docs": [group["n_docs"].sum()], "n_tokens": [group["n_tokens"].sum()], "root": [merkle(list(group["root"]))]})

    schema = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)
    return rows.groupBy(*keys).applyInPandas(fold, f"{schema}, n_docs bigint, n_tokens bigint, root binary")


def payload_ids(digest: bytes, payload: bytes, n_ids: int, id_bytes: int) -> np.ndarray:
    """A stored chunk's ids as unsigned 32-bit integers, once its payload is found to be what its digest says."""
    if hashlib.sha256(payload).digest() != bytes(digest) or len(payload) != n_ids * id_bytes:
        raise ValueError(f"chunk {bytes(digest).hex()} is damaged")
    return np.frombuffer(payload, f"<u{id_bytes}").astype("<u4")


class TokenStore:
    """Reads a store back."""

    def __init__(self, spark: SparkSession, path: str):
        self.chunks, self.recipes, self.manifest = (spark.read.parquet(f"{path}/{t}") for t in ("chunks", "recipes", "manifest"))
        first = self.manifest.select("id_bytes").first()
        self.id_bytes = first.id_bytes if first else 2

    def documents(self) -> DataFrame:
        """(part, seq, doc_id, start, n_tokens, digests, root) for each document, in the store's order by part and seq."""
        running = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
        starts = self.manifest.select("part", F.col("start").alias("before"))
        return self.recipes.withColumn("running", F.coalesce(running, F.lit(0))).join(starts, "part").select("part", "seq", "doc_id", (F.col("before") + F.col("running")).alias("start"), "n_tokens", "digests", "root")

    def _gathered(self, value: DataFrame) -> DataFrame:
        """Documents with their chunks' values, in order: the links to chunks are joined by digest, skewed digests are split by AQE."""
        links = self.documents().select("part", "seq", "doc_id", "start", "n_tokens", "root", F.posexplode("digests").alias("pos", "digest"))
        found = links.join(value, "digest", "left")
        fields = ["digest", *[c for c in value.columns if c != "digest"]]
        whole = found.groupBy("part", "seq", "doc_id", "start", "n_tokens", "root").agg(F.sort_array(F.collect_list(F.struct("pos", *fields))).alias("chunks"))
        each = [F.col(f"chunks.{f}").alias("digests" if f == "digest" else f) for f in fields]
        return whole.select("doc_id", "start", "n_tokens", "root", *each)

    def digests(self) -> DataFrame:
        """(doc_id, start, n_tokens, ids_crc32): each stored chunk is read and checked once, and its CRC joined to those of its document."""
        width = self.id_bytes

        def summed(parts):
            for keys, sizes, payloads in parts:
                crcs = [zlib.crc32(payload_ids(k, p, n, width).tobytes()) for k, n, p in zip(keys.to_pylist(), sizes.to_pylist(), payloads.to_pylist(), strict=True)]
                yield [keys, sizes, crcs]

        values = common.emit(self.chunks, "digest binary, n_ids bigint, crc bigint", summed, ["digest", "n_ids", "payload"])

        def joined(parts):
            for ids, starts, sizes, roots, digests, lengths, crcs in parts:
                out = []
                for row in zip(sizes.to_pylist(), roots.to_pylist(), digests.to_pylist(), lengths.to_pylist(), crcs.to_pylist(), strict=True):
                    check_document(*row[:4])
                    out.append(encoders.join_crcs([(c, 4 * n) for c, n in zip(row[4], row[3], strict=True)]))
                yield [ids, starts, sizes, out]

        kind = self.recipes.schema["doc_id"].dataType.simpleString()
        whole = self._gathered(values)
        return common.emit(whole, f"doc_id {kind}, start bigint, n_tokens bigint, ids_crc32 bigint", joined, ["doc_id", "start", "n_tokens", "root", "digests", "n_ids", "crc"])

    def ids(self) -> DataFrame:
        """(doc_id, start, ids): the documents' whole id streams, put together from the chunks and checked."""
        width = self.id_bytes

        def joined(parts):
            for ids, starts, sizes, roots, digests, lengths, payloads in parts:
                out = []
                for row in zip(sizes.to_pylist(), roots.to_pylist(), digests.to_pylist(), lengths.to_pylist(), payloads.to_pylist(), strict=True):
                    check_document(*row[:4])
                    out.append(np.concatenate([payload_ids(d, p, n, width) for d, n, p in zip(*row[2:], strict=True)]).astype(np.int64))
                yield [ids, starts, out]

        kind = self.recipes.schema["doc_id"].dataType.simpleString()
        return common.emit(self._gathered(self.chunks), f"doc_id {kind}, start bigint, ids array<bigint>", joined, ["doc_id", "start", "n_tokens", "root", "digests", "n_ids", "payload"])


def check_document(n_tokens: int, root: bytes, digests: list[bytes], sizes: list[int]) -> None:
    if None in sizes:
        raise ValueError("a chunk is missing")
    if merkle(digests) != root or sum(sizes) != n_tokens:
        raise ValueError("a document differs from its recipe")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents", "doc_id", "text")
    path = write(docs, common.scratch(spark, "token-store"), encoders.default_path("word_bpe_49k.json"))
    return TokenStore(spark, path).digests()

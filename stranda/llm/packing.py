"""Packing by non-negative least squares: shallow combinations of lengths that fill a window, and how often to repeat each.

A document's tokens are cut at whole windows, each a sequence of its own. The remainders' lengths make a histogram (at most as many bins
as a window has tokens, whatever the corpus). All combinations of two or three of these lengths that add up to a window are enumerated;
repeat counts are solved against the histogram by non-negative least squares (projected gradient), rounded, and clipped to what is there.
Residuals are packed greedily: first into combinations that still can be filled, then end to end, cut where a window ends, so only
the very last sequence has padding.

The plan is made from counts alone. Each document finds its place by its rank among remainders of its length: its rank in the task that
encoded it, plus those of earlier tasks, of which there is a small table. No length, however common, is gathered in one task.

Defined results: a null or empty text is just the end id; repeated rows are documents of their own; a null doc_id is kept; tables
without rows give no pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stranda.llm import common, encoders

WINDOW, END_ID = 1024, 0
#: What the gradient of the least squares may be off by, relative to the largest count, and the most steps. Sums of whole repeats are off by as much anyway.
TOLERANCE, MOST_STEPS = 1e-3, 50_000


def combinations_filling(window: int, lengths: list[int]) -> list[tuple[int, ...]]:
    """Sorted pairs and triples of these lengths that add up to a window, pairs first."""
    have = set(lengths)
    ordered = sorted(have)
    out: list[tuple[int, ...]] = [(a, window - a) for a in ordered if 2 * a <= window and window - a in have]
    for i, a in enumerate(ordered):
        if 3 * a > window:
            break
        for b in ordered[i:]:
            c = window - a - b
            if c < b:
                break
            if c in have:
                out.append((a, b, c))
    return out


def solve(combos: list[tuple[int, ...]], counts: dict[int, int], tolerance: float = TOLERANCE) -> list[float]:
    """Repeat counts x >= 0 that minimise the squared differences between used and given counts.

    Projected gradient steps with momentum, begun anew where it overshoots, until the optimality conditions hold: no count's gradient is under
    -``tolerance`` of the largest count, nor that of a count above zero over it.
    """
    if not combos:
        return []
    lengths = sorted(counts)
    row = {k: i for i, k in enumerate(lengths)}
    b = np.array([counts[k] for k in lengths], np.float64)
    scale = b.max(initial=1.0) or 1.0
    b = b / scale
    place = np.array([[row[k] for k in c] + [len(b)] * (3 - len(c)) for c in combos])
    flat = place.ravel()

    def used(x):
        return np.bincount(flat, np.repeat(x, 3), len(b) + 1)[:-1]

    def gradient(x):
        left = np.append(used(x) - b, 0.0)
        return left[place].sum(axis=1)

    # The largest eigenvalue of A'A, from a few power steps, with a margin.
    v = np.ones(len(combos))
    for _ in range(30):
        w = np.append(used(v), 0.0)[place].sum(axis=1)
        norm = float(np.linalg.norm(w)) / max(float(np.linalg.norm(v)), 1e-300)
        v = w / max(float(np.linalg.norm(w)), 1e-300)
    step = 1 / (1.05 * norm)
    x = y = np.zeros(len(combos))
    t = 1.0
    for k in range(MOST_STEPS):
        g = gradient(y)
        new = np.maximum(y - step * g, 0.0)
        if (y - new) @ (new - x) > 0:
            t, y = 1.0, x
            continue
        t, last = (1 + (1 + 4 * t * t) ** 0.5) / 2, t
        x, y = new, new + (last - 1) / t * (new - x)
        if k % 50 == 49:
            g = gradient(x)
            if max(-g.min(), np.abs(g[x > 0]).max(initial=0.0)) <= tolerance:
                break
    return (x * scale).tolist()


@dataclass
class Plan:
    """Where the remainders of each length go, by rank: runs of ranks in combinations, then the stream of residuals."""

    window: int
    runs: dict[int, list[tuple[int, int, int, int]]] = field(default_factory=dict)  # length: (first rank, end, sequence, offset)
    taken: dict[int, int] = field(default_factory=dict)
    stream: dict[int, int] = field(default_factory=dict)  # length: where its residuals begin in the stream
    combined: int = 0  # sequences that are combinations

    @classmethod
    def make(cls, counts: dict[int, int], window: int = WINDOW) -> Plan:
        plan = cls(window, {k: [] for k in counts}, {k: 0 for k in counts})
        combos = combinations_filling(window, list(counts))
        x = solve(combos, counts)
        for i in sorted(range(len(combos)), key=lambda i: -x[i]):
            plan._repeat(combos[i], round(x[i]), counts)
        for combo in combos:
            plan._repeat(combo, 1 << 62, counts)
        at = 0
        for k in sorted(counts, reverse=True):
            plan.stream[k] = at
            at += k * (counts[k] - plan.taken[k])
        return plan

    def _repeat(self, combo: tuple[int, ...], times: int, counts: dict[int, int]) -> None:
        times = min(times, *((counts[k] - self.taken[k]) // combo.count(k) for k in combo))
        if times <= 0:
            return
        offset = 0
        for k in combo:
            first = self.taken[k]
            self.runs[k].append((first, first + times, self.combined, offset))
            self.taken[k] += times
            offset += k
        self.combined += times

    def place(self, length: int, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequences (from 0) and offsets of remainders of one length; those that reach over a window's end go on in the next."""
        sequence, offset = np.zeros(len(ranks), np.int64), np.zeros(len(ranks), np.int64)
        runs = np.array(self.runs[length], dtype=np.int64).reshape(-1, 4)
        inside = ranks < self.taken[length]
        if inside.any():
            at = np.searchsorted(runs[:, 0], ranks[inside], "right") - 1
            sequence[inside] = runs[at, 2] + ranks[inside] - runs[at, 0]
            offset[inside] = runs[at, 3]
        where = self.stream[length] + (ranks[~inside] - self.taken[length]) * length
        sequence[~inside] = self.combined + where // self.window
        offset[~inside] = where % self.window
        return sequence, offset


def encoded(docs: DataFrame, tokenizer: str, end_id: int, window: int, text: str, doc_id: str) -> DataFrame:
    """(task, doc_id, whole, earlier, rest, nth, ids), written once: whole windows and the remainder's length of each document, the whole windows
    and the remainders of that length that came before it in its task, and its ids as little-endian words of 32 bits."""

    def run(parts) -> Iterator[list]:
        coder, end = encoders.encoder(tokenizer, False), np.array([end_id], "<u4").tobytes()
        windows, seen = 0, np.zeros(window, np.int64)
        for ids, column in parts:
            out = [ids, [], [], [], [], []]
            for found in coder.encode_column(column):
                whole, rest = divmod(len(found) + 1, window)
                for target, value in zip(out[1:], (whole, windows, rest, int(seen[rest]), found.tobytes() + end), strict=True):
                    target.append(value)
                windows += whole
                seen[rest] += 1
            yield out

    kind = docs.schema[doc_id].dataType.simpleString()
    rows = common.emit(docs, f"doc_id {kind}, whole bigint, earlier bigint, rest bigint, nth bigint, ids binary", run, [doc_id, text], rows=2048)
    return common.save(rows.withColumn("task", F.spark_partition_id()), "packing-tokens")


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int = END_ID, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Pieces with their ids: (doc_id, start, length, ids, ids_crc32, doc_tokens, sequence_id, offset); ids as little-endian words of 32 bits."""
    spark = docs.sparkSession
    rows = encoded(docs, tokenizer, end_id, window, text, doc_id)
    kind = docs.schema[doc_id].dataType.simpleString()
    earlier = lambda *keys: Window.partitionBy(*keys).orderBy("task").rowsBetween(Window.unboundedPreceding, -1)

    # How many remainders of each length, and whole windows, a task has: at most ``window`` rows a task.
    sizes = common.save(rows.groupBy("rest", "task").agg(F.count("*").alias("n"), F.sum("whole").alias("whole")), "packing-sizes")
    totals = sizes.groupBy("rest").agg(F.sum("n").alias("n"), F.sum("whole").alias("whole")).collect()
    plan = spark.sparkContext.broadcast(Plan.make({r.rest: r.n for r in totals if r.rest}, window))
    n_whole = sum(r.whole for r in totals)
    by_task = sizes.groupBy("task").agg(F.sum("whole").alias("w")).withColumn("w_before", F.coalesce(F.sum("w").over(earlier()), F.lit(0))).select("task", "w_before")
    before = sizes.select("rest", "task", F.coalesce(F.sum("n").over(earlier("rest")), F.lit(0)).alias("r_before")).join(by_task, "task")
    numbered = rows.join(before, ["rest", "task"])

    def place(parts) -> Iterator[list]:
        where = plan.value
        for column in parts:
            names, (whole, first, rest, rank) = column[0], (c.to_numpy(zero_copy_only=False) for c in column[1:5])
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for k in np.unique(rest[rest > 0]).tolist():
                mine = np.flatnonzero(rest == k)
                sequence[mine], offset[mine] = where.place(k, rank[mine])
            out = [[] for _ in range(8)]
            source = []
            for i, data in enumerate(column[5].to_pylist()):
                pieces = [(k * window, window, int(first[i]) + k, 0) for k in range(int(whole[i]))]
                if rest[i]:
                    start, length, at, off = int(whole[i]) * window, int(rest[i]), n_whole + int(sequence[i]), int(offset[i])
                    head = min(length, window - off)
                    pieces.append((start, head, at, off))
                    if head < length:
                        pieces.append((start + head, length - head, at + 1, 0))
                for start, length, at, off in pieces:
                    part = data[4 * start : 4 * (start + length)]
                    for target, value in zip(out[1:], (start, length, part, zlib.crc32(part), len(data) // 4, at, off), strict=True):
                        target.append(value)
                source += [i] * len(pieces)
            out[0] = names.take(pa.array(source, pa.int64()))
            yield out

    schema = f"doc_id {kind}, start bigint, length bigint, ids binary, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
    inputs = numbered.select("doc_id", "whole", (F.col("w_before") + F.col("earlier")).alias("first"), "rest", (F.col("r_before") + F.col("nth")).alias("rank"), "ids")
    return common.emit(inputs, schema, place, ["doc_id", "whole", "first", "rest", "rank", "ids"])


def sequences(pieces: DataFrame) -> DataFrame:
    """(sequence_id, ids): the packed sequences, each the ids of its pieces one after another."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return pieces.groupBy("sequence_id").agg(F.aggregate(parts, F.lit(b""), lambda done, part: F.concat(done, part["ids"])).alias("ids"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents", "doc_id", "text")
    return pack(docs, encoders.default_path("byte_bpe_50k.json")).drop("ids")

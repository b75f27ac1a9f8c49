"""Exact top-k search: a Voronoi kNN join for the inner product of integer vectors.

Pivots are a bounded sample of the vectors; data and queries belong to the cell of their nearest pivot. Each query is first solved among about
CELL vectors of its own cell, which gives a k-th score that it has for certain; a cell of queries is summed up by its pivot p, its radius r and the
least of these scores. A vector x scores at most p.x + r |x| with any of its queries, and the members of a data cell with pivot o and radius
s at most p.o + |p| s + r (|o| + s). Cells of queries are gathered in groups of about BLOCK queries, near ones together, and a vector is sent to
a group only if both bounds reach the score of one of its cells. Each group is solved locally, in parts of about CELL vectors, and the parts' best
are merged. Where no bound excludes anything (vectors without clusters), every group gets every vector: then this is a comparison in blocks.

A component x becomes floor(256 * x). Scores are exact: in floating point where no sum can leave 2**53, else in 64-bit integers; vectors so
large that a score could leave these are an error.

Defined results: rows with a null vec_id, or a vector that is null or holds null or non-finite components, take no part; vectors are compared
with those of the same length only; a query's candidates are the rows of other vec_ids, repeated rows each; repeated query rows are one
query (the smallest vector, if they differ); ties go to the smaller vec_id; fewer than k candidates are all returned; tables without rows give
tables without rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stranda.llm import common

K, EVERY = 5, 50
#: Vectors for each pivot, about; the least and most pivots; vectors that are compared at once; queries in a group.
PER_PIVOT, PIVOTS, CELL, BLOCK = 2048, (8, 4096), 8192, 1024
#: What rounding in the bounds may amount to, relative to the sizes at hand.
SLACK = 1e-9


def vectors(rows: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, v): integer vectors as arrays of long."""
    usable = F.col(embedding).isNotNull() & ~F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf"))) & F.col(vec_id).isNotNull()
    return rows.filter(usable).select(F.col(vec_id).alias("vec_id"), F.transform(embedding, lambda x: F.floor(x.cast("double") * 256)).alias("v"))


def stack(column, width: int) -> np.ndarray:
    """An Arrow list column of equally long vectors as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), width)


def by_width(column):
    """Row numbers by the length of their vector."""
    widths = column.value_lengths().to_numpy(zero_copy_only=False)
    return [(int(w), np.flatnonzero(widths == w)) for w in np.unique(widths)]


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    a, b = x.astype(np.float64), pivots.astype(np.float64)
    squares = (a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)
    return np.sqrt(np.maximum(squares, 0))


def scores(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products (rows of x by rows of q), exactly."""
    most = float(np.abs(x).max(initial=0)) * float(np.abs(q).max(initial=0)) * x.shape[1]
    if most < 2**53:
        return (x.astype(np.float64) @ q.astype(np.float64).T).astype(np.int64)
    if most >= 2**63:
        raise ValueError("scores leave 64 bits")
    return x @ q.T


def best(ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, vec_id, score) of each query's k best rows of other ids, or more if ties are cut off later."""
    order = np.argsort(ids, kind="stable")
    ids, x = ids[order], x[order]
    found = [], [], []
    for at in range(0, len(query_ids), 256):
        table = scores(x, q[at : at + 256])
        for j, query in enumerate(query_ids[at : at + 256].tolist()):
            column = table[:, j]
            others = np.flatnonzero(ids != query)
            mine = column[others]
            if len(mine) > k:
                least = np.partition(mine, len(mine) - k)[len(mine) - k]
                over, ties = np.flatnonzero(mine > least), np.flatnonzero(mine == least)
                others = others[np.concatenate([over, ties[: k - len(over)]])]
            found[0].extend([query] * len(others))
            found[1].extend(ids[others].tolist())
            found[2].extend(column[others].tolist())
    return tuple(np.array(f, dtype=np.int64) for f in found)


@dataclass
class Cells:
    """Pivots of one vector length with the summaries of what is nearest to each: of data (size, radius), of queries (number, radius, and the least
    k-th score that any of them has for certain). As many rows as pivots, so it may be broadcast."""

    pivots: np.ndarray
    sizes: np.ndarray
    radius: np.ndarray
    asked: np.ndarray
    reach: np.ndarray
    floor: np.ndarray
    groups: list[list[int]] = field(default_factory=list)  # for each query group: its cells
    splits: list[int] = field(default_factory=list)  # and in how many parts by hash its queries are dealt
    first: int = 0  # number of the first query group of this length

    @classmethod
    def of(cls, pivots: np.ndarray) -> Cells:
        n = len(pivots)
        return cls(pivots.astype(np.float64), np.zeros(n, np.int64), np.zeros(n), np.zeros(n, np.int64), np.zeros(n), np.full(n, -np.inf))

    def gather(self, most: int) -> None:
        """Puts cells with queries in groups of about ``most`` queries: from any cell on to the nearest that is left. Larger cells are split by hash."""
        left = np.flatnonzero(self.asked).tolist()
        norms = (self.pivots**2).sum(1)
        at, size = None, most
        while left:
            if at is not None and size < most:
                away = norms[left] - 2 * self.pivots[left] @ self.pivots[at]
                at = left[int(away.argmin())]
            else:
                at = left[0]
            left.remove(at)
            if size >= most or size + self.asked[at] > most:
                self.groups.append([])
                self.splits.append(1)
                size = 0
            self.groups[-1].append(at)
            size += int(self.asked[at])
            self.splits[-1] = max(1, -(-size // most))

    def slack(self, norm: np.ndarray, c: np.ndarray | slice = slice(None)) -> np.ndarray:
        return SLACK * ((np.sqrt((self.pivots[c] ** 2).sum(1)) + self.reach[c]) * norm[:, None] + 1)

    def needed_groups(self) -> np.ndarray:
        """For each query cell (row) and data cell (column), whether any member of the one can be among the best of any of the other."""
        norm = np.sqrt((self.pivots**2).sum(1))
        far = norm + self.radius
        most = self.pivots @ self.pivots.T + norm[:, None] * self.radius + self.reach[:, None] * far
        return (most + self.slack(far).T >= self.floor[:, None]) & (self.asked[:, None] > 0) & (self.sizes > 0)

    def needed_rows(self, x: np.ndarray, cells: np.ndarray) -> np.ndarray:
        """The same for single vectors: (rows, cells)."""
        x = x.astype(np.float64)
        norm = np.sqrt((x * x).sum(1))
        return x @ self.pivots[cells].T + norm[:, None] * self.reach[cells] + self.slack(norm, cells) >= self.floor[cells]


def as_bytes(x: np.ndarray) -> list[bytes]:
    """Vectors as bytes, of 16 bits a component where they fit."""
    small = (np.abs(x) < 1 << 15).all(axis=1)
    return [row.astype("<i2" if fits else "<i8").tobytes() for row, fits in zip(x, small, strict=True)]


def from_bytes(data: list[bytes], width: int) -> np.ndarray:
    out = np.empty((len(data), width), np.int64)
    short = np.array([len(d) == 2 * width for d in data], bool)
    for mask, kind in ((short, "<i2"), (~short, "<i8")):
        if mask.any():
            out[mask] = np.frombuffer(b"".join([d for d, m in zip(data, mask, strict=True) if m]), kind).reshape(-1, width)
    return out


def mixed(ids: np.ndarray, parts) -> np.ndarray:
    return ((ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % np.asarray(parts, dtype=np.uint64)).astype(np.int64)


ASSIGNED = "vec_id bigint, x binary, width int, cell int, distance double"


class Join:
    """Data and queries in Voronoi cells, and the plan of what goes where."""

    def __init__(self, rows: DataFrame, queries: DataFrame, k: int = K, block: int = BLOCK):
        self.spark, self.k, self.block = rows.sparkSession, k, block
        n = rows.count()
        most = int(min(max(n // PER_PIVOT, PIVOTS[0]), PIVOTS[1]))
        chosen = rows.select("v").orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(most).toArrow()["v"].combine_chunks()
        self.pivots = {w: np.unique(stack(chosen.take(at), w), axis=0) for w, at in by_width(chosen) if w}
        widths = [r.w for r in rows.select(F.size("v").alias("w")).distinct().collect() if r.w and r.w not in self.pivots]
        self.pivots |= {w: np.zeros((1, w), np.int64) for w in widths}  # lengths that the sample missed: one cell each
        self.rows = common.save(self._assigned(rows), "knn-data")
        self.asked = common.save(self._assigned(queries.groupBy("vec_id").agg(F.min("v").alias("v"))), "knn-queries")
        self.cells = {w: Cells.of(p) for w, p in self.pivots.items()}
        for table, number, radius in ((self.rows, "sizes", "radius"), (self.asked, "asked", "reach")):
            for r in table.groupBy("width", "cell").agg(F.count("*").alias("n"), F.max("distance").alias("far")).collect():
                getattr(self.cells[r.width], number)[r.cell], getattr(self.cells[r.width], radius)[r.cell] = r.n, r.far
        self._find_floors()
        at = 0
        for cells in self.cells.values():
            cells.gather(block)
            cells.first = at
            at += len(cells.groups)

    def _assigned(self, rows: DataFrame) -> DataFrame:
        shared = self.spark.sparkContext.broadcast(self.pivots)

        def assign(parts):
            for ids, column in parts:
                out = [], [], [], [], []
                names = ids.to_numpy(zero_copy_only=False)
                for w, at in by_width(column):
                    if w not in shared.value:  # no data of this length
                        continue
                    x = stack(column.take(at), w)
                    d = distances(x, shared.value[w])
                    cell = d.argmin(axis=1)
                    for target, value in zip(out, (names[at].tolist(), as_bytes(x), [w] * len(at), cell.tolist(), d[np.arange(len(at)), cell].tolist()), strict=True):
                        target += value
                yield list(out)

        return common.emit(rows, ASSIGNED, assign, ["vec_id", "v"], rows=4096)

    def _cogrouped(self, data: DataFrame, queries: DataFrame, keys: list[str], solve, schema: str) -> DataFrame:
        parts = max(int(self.spark.conf.get("spark.sql.shuffle.partitions", "200")), 1)
        return data.repartition(parts, *keys).groupBy(*keys).cogroup(queries.repartition(parts, *keys).groupBy(*keys)).applyInPandas(solve, schema)

    def _find_floors(self) -> None:
        """Each query's k-th score among CELL vectors, about, of its own cell is one that it has for certain; the least of a cell counts for all of it."""
        k, block = self.k, self.block
        shared = self.spark.sparkContext.broadcast({w: (c.sizes, c.asked) for w, c in self.cells.items()})

        def near(parts):
            """A part of each cell that has queries, once for each part of these."""
            for ids, x, width, cell in parts:
                names, w, c = (a.to_numpy(zero_copy_only=False) for a in (ids, width, cell))
                out = [], [], []
                for size in np.unique(w).tolist():
                    sizes, asked = shared.value[size]
                    mine = np.flatnonzero(w == size)
                    copies = -(-asked[c[mine]] // block)
                    mine, copies = (m[mixed(names[mine], np.maximum(1, -(-sizes[c[mine]] // CELL))) == 0] for m in (mine, copies))
                    out[0].append(np.repeat(mine, copies))
                    out[1].append(np.arange(copies.sum()) - np.repeat(np.cumsum(copies) - copies, copies))
                take = pa.array(np.concatenate([np.zeros(0, np.int64), *out[0]]).astype(np.int64))
                yield [ids.take(take), x.take(take), width.take(take), cell.take(take), np.concatenate([np.zeros(0, np.int64), *out[1]])]

        def dealt(parts):
            for ids, x, width, cell in parts:
                names, w, c = (a.to_numpy(zero_copy_only=False) for a in (ids, width, cell))
                copies = [int(-(-shared.value[a][1][b] // block)) for a, b in zip(w.tolist(), c.tolist(), strict=True)]
                yield [ids, x, width, cell, mixed(names, np.maximum(1, copies))]

        def solve(data: pd.DataFrame, sent: pd.DataFrame) -> pd.DataFrame:
            if not len(sent):
                return pd.DataFrame({"width": [], "cell": [], "floor": []})
            width, least = int(sent["width"].iloc[0]), -np.inf
            if len(data):
                query, _, score = best(data["vec_id"].to_numpy(), from_bytes(list(data["x"]), width), sent["vec_id"].to_numpy(), from_bytes(list(sent["x"]), width), k)
                found = pd.Series(score).groupby(query).agg(["min", "size"])
                if len(found) == len(sent) and (found["size"] >= k).all():
                    least = float(found["min"].min())
            return pd.DataFrame({"width": [width], "cell": [int(sent["cell"].iloc[0])], "floor": [least]})

        schema = "vec_id bigint, x binary, width int, cell int, part int"
        columns = ["vec_id", "x", "width", "cell"]
        floors = self._cogrouped(common.emit(self.rows, schema, near, columns, rows=4096), common.emit(self.asked, schema, dealt, columns, rows=4096), ["width", "cell", "part"], solve, "width int, cell int, floor double")
        for r in floors.groupBy("width", "cell").agg(F.min("floor").alias("floor")).collect():
            self.cells[r.width].floor[r.cell] = r.floor

    def _sent(self) -> DataFrame:
        """(grp, part, vec_id, x, width): each vector once for each query group that may need it, dealt to parts of about CELL vectors."""
        shared = self.spark.sparkContext.broadcast(self.cells)

        def send(parts):
            plans: dict = {}
            for ids, x, width, cell in parts:
                names, w, c = (a.to_numpy(zero_copy_only=False) for a in (ids, width, cell))
                data = x.to_pylist()
                rows, groups, places = [], [], []
                for size in np.unique(w).tolist():
                    cells = shared.value[size]
                    if size not in plans:
                        plans[size] = cells.needed_groups(), parts_of(cells)
                    pairs, in_parts = plans[size]
                    mine = np.flatnonzero(w == size)
                    vectors_ = from_bytes([data[i] for i in mine.tolist()], size)
                    for g, own in enumerate(cells.groups):
                        own = np.array(own)
                        wanted = pairs[own][:, c[mine]].T
                        some = np.flatnonzero(wanted.any(axis=1))
                        some = some[(cells.needed_rows(vectors_[some], own) & wanted[some]).any(axis=1)]
                        salt = mixed(names[mine[some]], in_parts[g])
                        for part in range(cells.splits[g]):
                            rows.append(mine[some])
                            groups.append(np.full(len(some), cells.first + g))
                            places.append(salt * cells.splits[g] + part)
                take = pa.array(np.concatenate([np.zeros(0, np.int64), *rows]).astype(np.int64))
                yield [np.concatenate([np.zeros(0, np.int64), *groups]), np.concatenate([np.zeros(0, np.int64), *places]), ids.take(take), x.take(take), width.take(take)]

        return common.emit(self.rows, "grp int, part bigint, vec_id bigint, x binary, width int", send, ["vec_id", "x", "width", "cell"], rows=4096)

    def visited(self) -> float:
        """The share of all (query, vector) pairs that is compared in the end."""
        most = sum(int(c.asked.sum()) * int(c.sizes.sum()) for c in self.cells.values())
        number = [int(c.asked[g].sum()) / s for c in self.cells.values() for g, s in zip(c.groups, c.splits, strict=True)]
        return sum(number[r.grp] * r.n for r in self._sent().groupBy("grp").agg(F.count("*").alias("n")).collect()) / max(most, 1)

    def best(self) -> DataFrame:
        """(query_id, rank, vec_id, score)."""
        k = self.k
        shared = self.spark.sparkContext.broadcast(self.cells)

        def dealt(parts):
            """Queries to all parts of the data that their group gets."""
            plans: dict = {}
            for ids, x, width, cell in parts:
                out = [], [], []
                for i, (name, w, c) in enumerate(zip(ids.to_pylist(), width.to_pylist(), cell.to_pylist(), strict=True)):
                    cells = shared.value[w]
                    if w not in plans:
                        plans[w] = {own: g for g, members in enumerate(cells.groups) for own in members}, parts_of(cells)
                    g = plans[w][0][c]
                    part = int(mixed(np.array([name]), cells.splits[g])[0])
                    for salt in range(plans[w][1][g]):
                        for target, value in zip(out, (i, cells.first + g, salt * cells.splits[g] + part), strict=True):
                            target.append(value)
                take = pa.array(out[0], pa.int64())
                yield [out[1], out[2], ids.take(take), x.take(take), width.take(take)]

        def solve(data: pd.DataFrame, sent: pd.DataFrame) -> pd.DataFrame:
            if not len(data) or not len(sent):
                return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
            width = int(sent["width"].iloc[0])
            a, b, c = best(data["vec_id"].to_numpy(), from_bytes(list(data["x"]), width), sent["vec_id"].to_numpy(), from_bytes(list(sent["x"]), width), k)
            return pd.DataFrame({"query_id": a, "vec_id": b, "score": c})

        queries = common.emit(self.asked, "grp int, part bigint, vec_id bigint, x binary, width int", dealt, ["vec_id", "x", "width", "cell"], rows=4096)
        found = self._cogrouped(self._sent(), queries, ["grp", "part"], solve, "query_id bigint, vec_id bigint, score bigint")
        ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
        return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def parts_of(cells: Cells) -> list[int]:
    """In how many parts each query group's data is dealt, from the sizes of the cells that it may need."""
    pairs = cells.needed_groups()
    return [max(1, -(-int(cells.sizes[pairs[own].any(axis=0)].sum()) // CELL)) for own in cells.groups]


def top_k(rows: DataFrame, queries: DataFrame, k: int = K, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score) of vectors ``rows`` for vectors ``queries``, both (vec_id, v)."""
    return Join(rows, queries, k, block).best()


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(common.table(spark, sf_dir, "embeddings", "vec_id", "embedding"))
    return top_k(rows, rows.filter(F.col("vec_id") % EVERY == 0))


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""

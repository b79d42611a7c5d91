"""Approximate nearest neighbours by an inverted multi-index.

Each half of a unit vector is quantised by a codebook of its own; a cell is a pair of centroids. A query walks the cells
by the sum of its two distances with a heap until they hold enough rows, and those rows are reranked by exact cosine.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from papyrine.llm.common import materialize, sample_docs

CENTROIDS = 128  # a half, and a fourth of the sample at most
SAMPLE = 20_000
UNITS, UNIT_ROWS = 128, 1 << 16  # units at least, rows of one at most
NEAR = 1e-9  # what products of matrices may be off, for they depend on the shape


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 1) -> np.ndarray:
    """Lloyd's algorithm; fewer distinct points than k give repeated centroids, which only leaves cells empty."""
    r = np.random.default_rng(seed)
    centre = x[r.permutation(len(x))[:k]] if len(x) else np.zeros((1, x.shape[1]))
    for _ in range(rounds if len(x) else 0):
        near = ((centre**2).sum(1) - 2 * x @ centre.T).argmin(1)
        for j in range(len(centre)):
            if (near == j).any():
                centre[j] = x[near == j].mean(0)
    return centre


class MultiIndex:
    """Two codebooks, fitted on a sample of at most 2 * SAMPLE vectors; every row is indexed with them."""

    def __init__(self, sample: np.ndarray, k: int = CENTROIDS):
        unit = sample / np.linalg.norm(sample, axis=1, keepdims=True)
        self.half = unit.shape[1] // 2
        k = max(1, min(k, len(unit) // 4))
        self.books = [kmeans(unit[:, : self.half], k), kmeans(unit[:, self.half :], k, seed=2)]
        self.k = max(len(b) for b in self.books)

    def distances(self, x: np.ndarray) -> list[np.ndarray]:
        unit = x / np.linalg.norm(x, axis=1, keepdims=True)
        return [((b**2).sum(1) - 2 * part @ b.T) + (part**2).sum(1, keepdims=True) for b, part in zip(self.books, (unit[:, : self.half], unit[:, self.half :]))]

    def cells(self, x: np.ndarray) -> np.ndarray:
        a, b = self.distances(x)
        return a.argmin(1) * self.k + b.argmin(1)

    def walk(self, first: np.ndarray, second: np.ndarray, sizes: dict[int, int], enough: float) -> tuple[list[int], float]:
        """Cells that hold rows, nearest first, until they hold `enough`, and the summed distance of the last."""
        a, b = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
        near, other, rows, columns = first[a].tolist(), second[b].tolist(), (a * self.k).tolist(), b.tolist()
        heap, out, held, far = [(near[0] + other[0], 0, 0)], [], 0, 0.0
        while heap and held < enough:
            far, i, j = heapq.heappop(heap)
            cell = rows[i] + columns[j]
            if n := sizes.get(cell, 0):
                out.append(cell)
                held += n
            if j + 1 < len(columns):  # each pair is pushed once: along its row, and rows from their first pair on
                heapq.heappush(heap, (near[i] + other[j + 1], i, j + 1))
            if not j and i + 1 < len(rows):
                heapq.heappush(heap, (near[i + 1] + other[0], i + 1, 0))
        return out, far


def matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), -1)


def units_of(sizes: dict[int, int]) -> tuple[dict[int, int], dict[int, int]]:
    """First unit and number of units of each cell: small cells share a unit, a full cell is dealt over several of its own."""
    unit = min(UNIT_ROWS, max(64, math.ceil(sum(sizes.values()) / UNITS)))
    base, parts, at, room = {}, {}, 0, unit
    for cell in sorted(sizes):
        n = sizes[cell]
        if n > unit:
            base[cell], parts[cell] = at + (room < unit), math.ceil(n / unit)
            at, room = base[cell] + parts[cell], unit
            continue
        if n > room:
            at, room = at + 1, unit
        base[cell], parts[cell], room = at, 1, room - n
    return base, parts


def cosines(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Cosine of one vector with each row, in double precision; equal rows give equal values wherever they stand."""
    return (x * q).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((q * q).sum()))


def usable(vectors: DataFrame) -> DataFrame:
    """Rows whose vector is neither null nor zero, has only finite components, and is as long as most are."""
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    good = vectors.select("vec_id", "embedding").where(F.col("embedding").isNotNull() & F.col("vec_id").isNotNull()).where(F.coalesce(finite & F.exists("embedding", lambda v: v != 0), F.lit(False)))
    size = good.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).head()
    return good.where(F.size("embedding") == (size.n if size else 0))


def search(vectors: DataFrame, every: int = 50, top: int = 5, share: float = 0.4) -> DataFrame:
    """query_id, rank, vec_id, score: the `top` nearest rows of each row whose vec_id is divisible by `every`.

    A query looks at the nearest cells that hold `share` of the rows. Nearest first, ties to the smaller vec_id; a row
    is no candidate of its own, a repeated row is one. Scores are computed from the original vectors. Vectors that are
    null, zero, of another length, or hold null or non-finite components take no part; other columns are not read. An
    empty table gives an empty result. Cells are dealt to units of bounded size, a full cell to several.
    """
    spark = vectors.sparkSession
    good = usable(vectors)
    sample = sample_docs(good, SAMPLE, "vec_id").select("embedding").toArrow()
    if not sample.num_rows:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    index = MultiIndex(matrix(sample["embedding"]))
    kind = good.schema["embedding"].dataType.simpleString()
    kind = kind if kind in ("array<float>", "array<double>") else "array<double>"

    def assign(batches):
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(index.cells(matrix(batch.column(2))), pa.int32())], names=["vec_id", "row", "embedding", "cell"])

    numbered = good.select(F.col("vec_id").cast("long"), F.monotonically_increasing_id().alias("row"), F.col("embedding").cast(kind))
    stored = materialize(numbered.mapInArrow(assign, f"vec_id long, row long, embedding {kind}, cell int"), "cells")
    sizes = {r.cell: r["count"] for r in stored.groupBy("cell").count().collect()}
    enough = share * sum(sizes.values())
    base, parts = units_of(sizes)

    def deal(batches):
        """A row for each row, with its unit."""
        first, many = (np.zeros(index.k * index.k, dtype=np.int64) for _ in range(2))
        first[list(base)], many[list(parts)] = list(base.values()), list(parts.values())
        for batch in batches:
            cell, row = batch.column(3).to_numpy(), batch.column(1).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array((first[cell] + (row ^ row >> 33) % many[cell]).astype(np.int32)), *batch.columns], names=["unit", "vec_id", "row", "embedding", "cell"])

    def route(batches):
        """A row for each query and unit it visits, with the distance of the last cell it looks at."""
        for batch in batches:
            if not batch.num_rows:
                continue
            first, second = index.distances(matrix(batch.column(1)))
            rows, units, limits = [], [], []
            for i in range(batch.num_rows):
                cells, far = index.walk(first[i], second[i], sizes, enough)
                visited = {base[c] + p for c in cells for p in range(parts[c])}
                rows += [i] * len(visited)
                units += sorted(visited)
                limits += [far] * len(visited)
            picked = batch.take(pa.array(rows, pa.int64()))
            for at in range(0, len(rows), 20_000):
                yield pa.RecordBatch.from_arrays([*picked.slice(at, 20_000).columns, pa.array(units[at : at + 20_000], pa.int32()), pa.array(limits[at : at + 20_000], pa.float64())], names=["row", "embedding", "unit", "far"])

    queries = stored.where(F.col("vec_id") % every == 0).select("row", "embedding").mapInArrow(route, f"row long, embedding {kind}, unit int, far double")
    dealt = stored.mapInArrow(deal, f"unit int, vec_id long, row long, embedding {kind}, cell int")

    def rerank(asked: pa.Table, held: pa.Table) -> pa.Table:
        names = pa.schema([("row", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
        if not asked.num_rows or not held.num_rows:
            return names.empty_table()
        x, rows, ids, cell = matrix(held["embedding"]), held["row"].to_numpy(), held["vec_id"].to_numpy(), held["cell"].to_numpy()
        length = np.linalg.norm(x, axis=1)
        found: list[tuple] = []
        own, q, far = asked["row"].to_numpy(), matrix(asked["embedding"]), asked["far"].to_numpy()
        for at in range(0, len(q), 512):
            part = q[at : at + 512]
            first, second = index.distances(part)
            looked = first[:, cell // index.k] + second[:, cell % index.k] <= far[at : at + 512, None] + NEAR
            near = (part @ x.T) / (np.linalg.norm(part, axis=1)[:, None] * length)
            near[(own[at : at + 512, None] == rows) | ~looked] = -np.inf
            for i, line in enumerate(near):
                cut = np.partition(line, -top)[-top] - NEAR if len(line) > top else -np.inf
                some = np.flatnonzero((line >= cut) & (line > -np.inf))
                score = cosines(part[i], x[some])
                best = np.lexsort((ids[some], -score))[:top]
                found.append((np.full(len(best), own[at + i]), ids[some][best], score[best]))
        return pa.table([pa.array(np.concatenate([f[k] for f in found])) for k in range(3)], schema=names)

    near = queries.groupBy("unit").cogroup(dealt.groupBy("unit")).applyInArrow(rerank, "row long, vec_id long, score double")
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= top)
    asked = stored.where(F.col("vec_id") % every == 0).select("row", F.col("vec_id").alias("query_id"))
    return ranked.join(asked, "row").select("query_id", F.col("rank").cast("int"), "vec_id", "score")

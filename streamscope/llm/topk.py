"""Exact top-k inner products by a Voronoi join.

Vectors and queries are grouped by their nearest pivot. From each group's radius follow bounds on
every score between a query group and a data group; a data group is sent to a query group only if
its upper bound reaches the k-th best lower bound there. Inside a task, blocks of vectors meet
blocks of queries in one matrix product each.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import FloatType

from .common import written

SCALE = 64
K = 20
#: The number of pivots grows with the root of the vectors, up to this many; all that the driver
#: holds are the pivots and one row of figures for each.
MOST_PIVOTS = 512
DATA_ROWS = 2048
QUERY_ROWS = 1024
_EXACT = float(1 << 50)
_EXACT_SINGLE = float(1 << 24)


def usable_rows(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(__row, id, vec): vectors of floats as they are, others as doubles; unusable ones left out."""
    x = F.col(vec_col)
    usable = x.isNotNull() & F.forall(
        x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(math.inf))
    )
    single = vectors.select(x).schema[0].dataType.elementType == FloatType()
    return vectors.filter(usable & F.col(id_col).isNotNull()).select(
        F.monotonically_increasing_id().alias("__row"),
        F.col(id_col).cast("long").alias("id"),
        x.cast("array<float>" if single else "array<double>").alias("vec"),
    )


def _matrix(column: pa.Array, dim: int, scale: int) -> np.ndarray:
    """floor(scale * x) of lists as rows of whole numbers, short ones filled up with zeros."""
    out = np.zeros((len(column), dim))
    sizes = np.diff(column.offsets.to_numpy())
    mask = np.arange(dim) < sizes[:, None]
    out[mask] = np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(float) * scale)
    return out


@dataclass(frozen=True)
class Plan:
    """Pivots, the data radius of each cell, its salts, and the query group of each cell."""

    pivots: np.ndarray
    radius: np.ndarray
    salts: list[int]
    group: list[int]
    pairs: list[tuple[int, int]]


def nearest(points: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cell of each point and its distance from the pivot."""
    squares = (pivots**2).sum(axis=1) - 2 * points @ pivots.T
    cell = squares.argmin(axis=1)
    return cell, np.sqrt(((points - pivots[cell]) ** 2).sum(axis=1))


def plan(pivots: np.ndarray, figures: list, k: int, query_rows: int, data_rows: int) -> Plan:
    """Which data cells each query group needs, from (cell, n, radius, queries, query_radius)."""
    size = len(pivots)
    n, r, nq, rq = (np.zeros(size) for _ in range(4))
    for cell, *values in figures:
        n[cell], r[cell], nq[cell], rq[cell] = (v or 0 for v in values)
    inner, norm = pivots @ pivots.T, np.sqrt((pivots**2).sum(axis=1))
    slack = norm[:, None] * r[None, :] + norm[None, :] * rq[:, None] + rq[:, None] * r[None, :]
    slack += 1e-6 * (1 + np.abs(inner) + slack)
    high, low = inner + slack, inner - slack
    needed = np.zeros((size, size), dtype=bool)
    for i in np.flatnonzero(nq):
        best = np.argsort(-low[i])
        enough = np.searchsorted(np.cumsum(n[best]), k + 1)
        floor = low[i][best[enough]] if enough < size else -math.inf
        needed[i] = (high[i] >= floor) & (n > 0)
    # Cells near each other along the main axis of the pivots make up a query group.
    centred = pivots - pivots.mean(axis=0)
    axis = np.linalg.svd(centred, full_matrices=False)[2][0] if size > 1 else np.zeros(pivots.shape[1])
    group, at, held = [0] * size, 0, 0
    for i in np.argsort(centred @ axis, kind="stable").tolist():
        if held and held + nq[i] > query_rows:
            at, held = at + 1, 0
        group[i] = at
        held += nq[i]
    pairs = sorted({(group[i], j) for i, j in np.argwhere(needed).tolist()})
    salts = [max(1, math.ceil(x / data_rows)) for x in n.tolist()]
    return Plan(pivots, r, salts, group, pairs)


def _blocks(rows: DataFrame, *keys: str) -> DataFrame:
    parts = F.collect_list(F.struct("id", "__row", "vec"))
    return rows.groupBy(*keys).agg(parts.alias("part"))


def _best(scores: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> tuple:
    """The k best of each line of scores, best first; ties to the smaller id, then row.

    -inf marks what is not a candidate.
    """
    order = np.lexsort((rows, ids))
    scores, ids, rows = scores[:, order].astype(np.float64), ids[order], rows[order]
    width = scores.shape[1]
    usual = np.abs(scores[np.isfinite(scores)]).max(initial=0) * width < _EXACT
    if usual and width > k:
        key = scores * width - np.arange(width)
        top = np.argpartition(-key, k - 1, axis=1)[:, :k]
        top = np.take_along_axis(top, np.argsort(np.take_along_axis(-key, top, 1), 1), 1)
    else:
        top = np.argsort(-scores, axis=1, kind="stable")[:, :k]
    return np.take_along_axis(scores, top, 1), ids[top], rows[top]


class Best:
    """The k best candidates of each of some queries; -inf marks places that have none.

    Once a query has k, only scores that reach its k-th best are looked at. They wait until there
    are as many as places, and are then ranked together.
    """

    def __init__(self, queries: int, k: int):
        self.score = np.full((queries, k), -np.inf)
        self.id, self.row = (np.zeros((queries, k), dtype=np.int64) for _ in range(2))
        self.waiting: list[tuple] = []

    @property
    def floor(self) -> np.ndarray:
        """What a score has to reach."""
        return self.score[:, -1]

    def meet(self, asked: np.ndarray, scores: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        """Take in the scores of the queries at `asked` (lines) with some candidates (columns)."""
        floor = self.floor[asked]
        if np.isfinite(floor).all():
            reach = scores >= floor.astype(scores.dtype)[:, None]
            # Much faster than nonzero() of two dimensions.
            line, column = np.divmod(np.flatnonzero(reach), len(ids))
            self.waiting.append((asked[line], scores[line, column], ids[column], rows[column]))
            if sum(len(line) for line, *_ in self.waiting) > self.score.size:
                self.rank()
        else:
            best = _best(scores, ids, rows, self.score.shape[1])
            self.waiting.append((asked.repeat(best[0].shape[1]), *(x.ravel() for x in best)))
            self.rank()

    def rank(self) -> None:
        queries, k = self.score.shape
        own = (np.arange(queries).repeat(k), self.score.ravel(), self.id.ravel(), self.row.ravel())
        line, score, ids, rows = map(np.concatenate, zip(own, *self.waiting))
        order = np.lexsort((rows, ids, -score, line))
        top = order[np.searchsorted(line[order], np.arange(queries))[:, None] + np.arange(k)]
        self.score, self.id, self.row, self.waiting = score[top], ids[top], rows[top], []


def _products(queries: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Inner products; exact below 2 ** 50, and otherwise by whole-number arithmetic."""
    most = np.abs(queries).max(initial=0) * np.abs(data).max(initial=0) * queries.shape[1]
    if most < _EXACT_SINGLE:
        return queries.astype(np.float32) @ data.astype(np.float32).T
    if most < _EXACT:
        return queries @ data.T
    exact = np.frompyfunc(int, 1, 1)
    return (exact(queries) @ exact(data).T).astype(np.float64)


_RESULT = "query_row long, query_id long, id long, row long, score long"


def top_k(
    vectors: DataFrame,
    is_query: Column,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    k: int = K,
    scale: int = SCALE,
    data_rows: int = DATA_ROWS,
    query_rows: int = QUERY_ROWS,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of highest score for each query row.

    `is_query` is a condition on `id`. A score is the inner product of floor(scale * x); a row is
    no candidate for itself; ties go to the smaller id. Null vectors, those with null or
    non-finite components, and rows without an id take no part; shorter vectors count as filled
    up with zeros. Scores of 2 ** 50 and more are rounded to 53 bits. A cell of any size is cut
    into salted blocks, so equal vectors do not meet in one task.
    """
    spark = vectors.sparkSession
    rows = written(usable_rows(vectors, id_col, vec_col), "vectors")
    count, dim = rows.agg(F.count("*"), F.max(F.size("vec"))).first()
    if not count or not dim:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    some = min(MOST_PIVOTS, max(8, math.isqrt(count) // 4))
    sample = rows.orderBy(F.xxhash64("id"), "id", "__row").limit(4 * some).select("vec").collect()
    lists = pa.array([r.vec for r in sample], pa.list_(pa.float64()))
    pivots = np.unique(_matrix(lists, dim, scale), axis=0)
    pivots = pivots[np.random.default_rng(0).permutation(len(pivots))[:some]]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, far = nearest(_matrix(batch.column("vec"), dim, scale), pivots)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(cell.astype("i4")), pa.array(far)],
                [*batch.schema.names, "cell", "far"],
            )

    kind = rows.schema["vec"].dataType.simpleString()
    cells = written(
        rows.withColumn("asks", is_query).mapInArrow(
            assign, f"__row long, id long, vec {kind}, asks boolean, cell int, far double"
        ),
        "cells",
    )
    asks = F.coalesce("asks", F.lit(False))
    far = F.when(asks, F.col("far"))
    figures = cells.groupBy("cell").agg(
        F.count("*"), F.max("far"), F.count(far), F.max(far)
    ).collect()
    p = plan(pivots, [tuple(r) for r in figures], k, query_rows, data_rows)

    # Queries of a group meet the blocks it needs in as many tasks as there are slots.
    groups = max(p.group) + 1
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    slots = max(1, math.ceil(2 * parts / groups))
    of_cell = F.element_at(F.array(*map(F.lit, p.group)), F.col("cell") + 1)
    salts = F.element_at(F.array(*map(F.lit, p.salts)), F.col("cell") + 1)
    data = _blocks(cells.withColumn("salt", F.pmod(F.xxhash64("__row"), salts)), "cell", "salt")
    wanted = spark.createDataFrame(p.pairs, "group int, cell int")
    data = data.join(F.broadcast(wanted), "cell").select(
        "group",
        F.pmod(F.xxhash64("cell", "salt"), F.lit(slots)).cast("int").alias("slot"),
        "cell",
        F.col("part").alias("data"),
    )
    sizes = [0] * groups
    for r in figures:
        sizes[p.group[r[0]]] += r[3]
    piece = F.element_at(
        F.array(*[F.lit(max(1, math.ceil(n / query_rows))) for n in sizes]), F.col("group") + 1
    )
    asking = cells.filter(asks).withColumn("group", of_cell)
    queries = (
        _blocks(asking.withColumn("piece", F.pmod(F.xxhash64("__row"), piece)), "group", "piece")
        .withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))))
        .withColumnRenamed("part", "queries")
    )

    def opened(part: pa.Scalar) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ids, own, vec = part.values.flatten()
        return ids.to_numpy(), own.to_numpy(), _matrix(vec, dim, scale)

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, {}

        def result() -> Iterator[pa.RecordBatch]:
            for ids, own, _, _, best in held.values():
                best.rank()
                score, found, row = best.score, best.id, best.row
                real = np.isfinite(score)
                times = real.sum(axis=1)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.repeat(own, times)), pa.array(np.repeat(ids, times)),
                        pa.array(found[real]), pa.array(row[real]),
                        pa.array(score[real].clip(-(2.0**63), 2.0**63 - 1024).astype("i8")),
                    ],
                    ["query_row", "query_id", "id", "row", "score"],
                )

        for batch in batches:
            for group, slot, piece, asked, cell, part in zip(*batch.columns):
                key = (group.as_py(), slot.as_py())
                if key != at:
                    yield from result()
                    at, held = key, {}
                if (name := piece.as_py()) not in held:
                    ids, own, vec = opened(asked)
                    held[name] = [ids, own, vec, np.sqrt((vec**2).sum(axis=1)), Best(len(ids), k)]
                ids, own, vec, norm, best = held[name]
                c = cell.as_py()
                # Queries whose k-th best is above all that the cell can offer skip the block.
                high = vec @ p.pivots[c] + norm * p.radius[c]
                high += 1e-6 * (1 + np.abs(high))
                open_ = np.flatnonzero(high >= best.floor)
                if not len(open_):
                    continue
                there, rows_, points = opened(part)
                scores = _products(vec[open_], points)
                _, query, same = np.intersect1d(own[open_], rows_, True, return_indices=True)
                scores[query, same] = -np.inf
                best.meet(open_, scores, there, rows_)
        yield from result()

    # A merge join brings the rows of a group and slot to `solve` one after the other, so that a
    # query's k-th best is known from its first block on.
    met = queries.hint("merge").join(data, ["group", "slot"]).select(
        "group", "slot", "piece", "queries", "cell", "data"
    )
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "id", "row")
    return (
        met.mapInArrow(solve, _RESULT)
        .withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", F.col("id").alias("vec_id"), "score")
    )

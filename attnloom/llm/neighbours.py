"""Nearest neighbours by vantage-point trees, one per shard.

At most PIVOTS vectors are pivots; every vector belongs to the cell of its
nearest pivot, and cells are cut into shards of about SHARD rows. A query first
asks the shards of its own cell. The distance of its k-th best there then skips
each cell that the triangle inequality puts farther away: by the cell's least
and greatest distance from its pivot, and by half the difference of the
distances to both pivots. A task receives the vectors of a shard, builds one
tree, and then streams the queries through it in Arrow batches, so the tree is
built once and only one shard is in memory. A node's vantage point halves its
vectors by distance; a query skips the side for which |d(q, v) - radius| exceeds
factor times the distance of its k-th best so far. Factor 1 is exact; smaller
factors skip more. Queries walk the tree together, so every comparison is a
matrix operation on centred vectors; allowances for its rounding grow with the
norms, and what they admit is measured from the differences themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read_table, stored

SHARD, LEAF, PIVOTS = 8192, 512, 1024
#: Exponents of two from which vectors are scaled, so that squares neither overflow nor vanish.
EXTREME = 400
ROUTES = 10_000


def usable(vector: Column | str) -> Column:
    """Not null, not empty, not zero, no null or non-finite component."""
    v = F.col(vector) if isinstance(vector, str) else vector
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(v, lambda x: x != 0), F.lit(False))


def matrix(column: pa.Array, shift: int = 0) -> np.ndarray:
    """Rows of equally long vectors in double precision, divided by two to the power of `shift`."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    return np.ldexp(flat, -shift) if shift else flat


def filled(vectors: DataFrame, column: str, length: int) -> DataFrame:
    """Vectors as doubles of one length, shorter ones filled up with zeros."""
    v = F.col(column).cast("array<double>")
    return vectors.withColumn(column, F.when(F.size(v) == length, v).otherwise(F.concat(v, F.array_repeat(F.lit(0.0), length - F.size(v)))))


def _in_cells(cells: Cells, shift: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                vectors = matrix(batch.column("vector"), shift)
                gaps, error = cells.gaps(vectors)
                cell = gaps.argmin(axis=1)
                away = differences(vectors, cells.pivots[cell])
                yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, (cell, away, error))], [*batch.schema.names, "cell", "away", "error"])

    return run


def _routes(cells: Cells, shift: int, factor: float, at_home: bool):
    """(id, vector, shard) of the shards a query asks: those of its own cell, or others within its bound."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                gaps, error = cells.gaps(matrix(part.column("vector"), shift))
                if at_home:
                    row, cell = np.arange(len(gaps)), cells.home(gaps)
                else:
                    row, cell = np.nonzero(cells.others(gaps, error, np.ldexp(part.column("bound").to_numpy(), -shift), factor))
                many = cells.parts[cell]
                ends = np.cumsum(many)
                for a in range(0, int(many.sum()), ROUTES):
                    place = np.arange(a, min(a + ROUTES, int(ends[-1])))
                    of = np.searchsorted(ends, place, side="right")
                    shard = cells.first[cell[of]] + place - (ends[of] - many[of])
                    taken = pa.array(row[of])
                    yield pa.RecordBatch.from_arrays([part.column("id").take(taken), part.column("vector").take(taken), pa.array(shard)], ["id", "vector", "shard"])

    return run


def distances(queries: np.ndarray, points: np.ndarray) -> np.ndarray:
    square = (queries**2).sum(1)[:, None] + (points**2).sum(1) - 2 * (queries @ points.T)
    return np.sqrt(np.maximum(square, 0))


def rounding(dim: int) -> float:
    """Bound of the error of `distances`, as a share of the sum of both norms."""
    return 2 * float(np.sqrt((dim + 8) * np.finfo(float).eps))


def differences(queries: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Distances row by row, from the differences themselves."""
    return np.sqrt(((queries - points) ** 2).sum(axis=1))


def norms(points: np.ndarray) -> np.ndarray:
    return np.sqrt((points**2).sum(axis=1))


class VantageTree:
    """Rows of `points` (ids ascending within ties) in nested halves around vantage points."""

    def __init__(self, ids: np.ndarray, points: np.ndarray, leaf: int = LEAF) -> None:
        self.ids, self.points, self.leaf = ids, points, leaf
        self.middle = points.mean(axis=0)
        self.centred = points - self.middle
        self.farthest = float(norms(self.centred).max())
        self.root = self._grow(np.arange(len(ids)))

    def _grow(self, rows: np.ndarray):
        if len(rows) <= self.leaf:
            return rows
        vantage = rows[0]
        away = differences(self.points[rows], self.points[vantage])
        radius = float(np.median(away))
        near = away <= radius
        if near.all():  # copies of one vector: nothing to halve
            return rows
        return vantage, radius, self._grow(rows[near]), self._grow(rows[~near])

    def search(self, ids: np.ndarray, queries: np.ndarray, k: int, factor: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
        """Per query up to k (id, distance), nearest first, ties to smaller ids; places left over have infinite distance."""
        self.k, self.factor = k, factor
        self.best = np.full((len(ids), k), np.inf)
        self.found = np.full((len(ids), k), -1, np.int64)
        self.asked = queries - self.middle
        self.slack = rounding(queries.shape[1]) * (norms(self.asked) + self.farthest)
        self._walk(self.root, np.arange(len(ids)), ids, queries)
        return self.found, self.best

    def _walk(self, node, at: np.ndarray, ids: np.ndarray, queries: np.ndarray) -> None:
        if not len(at):
            return
        if isinstance(node, np.ndarray):
            self._compare(node, at, ids, queries)
            return
        vantage, radius, inner, outer = node
        away = differences(queries[at], self.points[vantage])
        first = away <= radius
        for mine, side, other in ((first, inner, outer), (~first, outer, inner)):
            own = at[mine]
            self._walk(side, own, ids, queries)
            # the small allowance keeps rounding from hiding a point on the boundary
            reach = self.factor * self.best[own, -1] + 1e-9 * (away[mine] + radius)
            self._walk(other, own[np.abs(away[mine] - radius) <= reach], ids, queries)

    def _compare(self, rows: np.ndarray, at: np.ndarray, ids: np.ndarray, queries: np.ndarray) -> None:
        rough = distances(self.asked[at], self.centred[rows])
        rough[self.ids[rows][None, :] == ids[at][:, None]] = np.inf
        near = rough <= self.best[at, -1:] + self.slack[at, None]
        near &= np.isfinite(rough)
        for i in np.flatnonzero(near.any(axis=1)):
            pick = near[i]
            if len(rows) > self.k:
                # everything that rounding could place among the k best
                pick = pick & (rough[i] <= np.partition(rough[i], self.k - 1)[self.k - 1] + 2 * self.slack[at[i]])
            pick = np.flatnonzero(pick)
            exact = differences(self.points[rows[pick]], queries[at[i]])
            all_d = np.concatenate([self.best[at[i]], exact])
            all_id = np.concatenate([self.found[at[i]], self.ids[rows[pick]]])
            order = np.lexsort((all_id, all_d))[: self.k]
            self.best[at[i]], self.found[at[i]] = all_d[order], all_id[order]


class Cells:
    """Pivots, and of every cell its number of shards, first shard, ring around the pivot and rounding error."""

    def __init__(self, pivots: np.ndarray) -> None:
        self.pivots, self.middle = pivots, pivots.mean(axis=0)
        self.centred = pivots - self.middle
        self.farthest = float(norms(self.centred).max())

    def gaps(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distances to all pivots and, per vector, the bound of their error."""
        own = vectors - self.middle
        return distances(own, self.centred), rounding(vectors.shape[1]) * (norms(own) + self.farthest)

    def set_rings(self, rows: list, shard: int) -> None:
        self.parts, self.low, self.high, self.error = np.zeros(len(self.pivots), np.int64), *np.zeros((3, len(self.pivots)))
        for cell, n, low, high, error in rows:
            self.parts[cell], self.low[cell], self.high[cell], self.error[cell] = -(-n // shard), low, high, error
        self.first = np.cumsum(self.parts) - self.parts

    def home(self, gaps: np.ndarray) -> np.ndarray:
        """The nearest cell that has rows."""
        return np.where(self.parts > 0, gaps, np.inf).argmin(axis=1)

    def others(self, gaps: np.ndarray, error: np.ndarray, bound: np.ndarray, factor: float) -> np.ndarray:
        """Which cells but the own may hold a row within factor times the bound."""
        own = self.home(gaps)
        at_home = np.take_along_axis(gaps, own[:, None], axis=1)
        least = np.maximum(np.maximum(gaps - self.high, self.low - gaps) - error[:, None], (gaps - at_home) / 2 - error[:, None] - self.error)
        near = (least <= factor * bound[:, None] + 1e-9 * (gaps + self.high)) & (self.parts > 0)
        near[np.arange(len(own)), own] = False
        return near


def _searcher(k: int, factor: float, leaf: int, shift: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, tree, ids, parts = None, None, [], []
        for batch in batches:
            # rows arrive by shard, vectors before queries
            shards, is_query = batch.column("shard").to_numpy(), batch.column("is_query").to_numpy(zero_copy_only=False)
            edges = np.flatnonzero((np.diff(shards) != 0) | (np.diff(is_query.astype(int)) != 0)) + 1
            for a, b in zip([0, *edges], [*edges, len(shards)], strict=True):
                if a == b:
                    continue
                own, vectors = batch.column("id").to_numpy()[a:b], matrix(batch.column("vector").slice(a, b - a), shift)
                if shards[a] != shard:
                    shard, tree, ids, parts = shards[a], None, [], []
                if not is_query[a]:
                    ids.append(own)
                    parts.append(vectors)
                    continue
                if not parts:
                    continue
                if tree is None:
                    every = np.concatenate(ids)
                    order = np.argsort(every, kind="stable")
                    tree = VantageTree(every[order], np.concatenate(parts)[order], leaf)
                found, best = tree.search(own, vectors, k, factor)
                hit = np.isfinite(best)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(own, hit.sum(axis=1))), pa.array(found[hit]), pa.array(np.ldexp(best[hit], shift))], ["query_id", "vec_id", "score"]
                )

    return run


def _largest(vector: str) -> Column:
    return F.array_max(F.transform(vector, lambda x: F.abs(x).cast("double")))


def nearest(vectors: DataFrame, queries: DataFrame, k: int, factor: float = 1.0, shard: int = SHARD, leaf: int = LEAF) -> DataFrame:
    """query_id, rank, vec_id, score: for each row of `queries` (id, vector) the k nearest of `vectors` (id, vector).

    Score is the Euclidean distance in double precision; ties go to the smaller
    id; a row never finds rows of its own id. Rows of null id or unusable
    vectors take no part; vectors shorter than the longest count as filled up
    with zeros. Repeated rows count each for itself among the candidates, once
    among the queries. Empty tables give no rows.
    """
    spark = vectors.sparkSession
    vectors = vectors.filter(usable("vector") & F.col("id").isNotNull()).select("id", "vector")
    queries = queries.filter(usable("vector") & F.col("id").isNotNull()).select("id", "vector").dropDuplicates(["id"])
    sides = vectors.select("vector", F.lit(1).alias("row")).unionByName(queries.select("vector", F.lit(0).alias("row")))
    total, length, largest = sides.agg(F.sum("row"), F.max(F.size("vector")), F.max(_largest("vector"))).first()
    if not total:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    exponent = int(np.frexp(largest)[1])
    shift = exponent if abs(exponent) > EXTREME else 0
    vectors, queries = filled(vectors, "vector", length), stored(filled(queries, "vector", length), "queries")
    first = vectors.orderBy(F.xxhash64("id"), "id").limit(min(PIVOTS, -(-total // shard))).select("vector").collect()  # PIVOTS vectors at most
    cells = Cells(np.ldexp(np.array([r[0] for r in first], np.float64), -shift))
    placed = vectors.withColumn("salt", F.xxhash64("id", F.monotonically_increasing_id()))
    placed = stored(placed.mapInArrow(_in_cells(cells, shift), "id long, vector array<double>, salt long, cell long, away double, error double"), "cells")
    rings = placed.groupBy("cell").agg(F.count("*"), F.min("away"), F.max("away"), F.max("error")).collect()  # PIVOTS rows at most
    cells.set_rings([tuple(r) for r in rings], shard)
    of = lambda numbers: F.element_at(F.array(*map(F.lit, numbers.tolist())), (F.col("cell") + 1).cast("int"))
    rows = placed.select("id", "vector", F.lit(False).alias("is_query"), (of(cells.first) + F.pmod("salt", of(cells.parts))).alias("shard"))

    def asked(those: DataFrame, at_home: bool) -> DataFrame:
        sent = those.mapInArrow(_routes(cells, shift, factor, at_home), "id long, vector array<double>, shard long").withColumn("is_query", F.lit(True))
        both = rows.unionByName(sent, allowMissingColumns=False).repartition(int(min(cells.parts.sum(), ROUTES)), "shard").sortWithinPartitions("shard", "is_query")
        return both.mapInArrow(_searcher(k, factor, leaf, shift), "query_id long, vec_id long, score double")

    def best(found: DataFrame) -> DataFrame:
        order = Window.partitionBy("query_id").orderBy("score", "vec_id")
        ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        return ranked.select("query_id", F.col("rank").cast("int"), "vec_id", "score")

    near = best(asked(queries, True))
    if len(rings) == 1:
        return near
    near = stored(near, "own-cells")
    bound = near.filter(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("bound"))
    bounded = queries.join(bound, "id", "left").withColumn("bound", F.coalesce("bound", F.lit(float("inf"))))
    return best(near.drop("rank").unionByName(asked(bounded, False)))


def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return nearest(rows, rows.filter("id % 100 = 0"), 10)

"""Principal components of the training rows of all probes of a sweep at once.

Both shapes take one way. Columns are centred by their means. The thin side of a
matrix, its columns if there are no more of them than rows and else its rows,
gives a Gram matrix by products of tiles, added in a tree; its eigenvectors are
the components, or turn into them by one more product with the tiles. Components
stay a table of column tiles, however many features there are. One task holds
the Gram matrix of one probe, whose size is that of the thin side. A matrix that
is one tile has nothing to be added across tiles and takes the same steps in one task.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import blocks as B
from .blocks import BLOCK, COL, COLS, ROW, ROWS, SAMPLE, SUMS

_THIN, _OTHER = "_thin", "_other"


def clamp_dim(wanted: int | None, n_features: int, n_train: int) -> int | None:
    """PCA cannot have more components than features or training rows."""
    return None if wanted is None else min(wanted, n_features, n_train)


def directions(gram: np.ndarray, n: int, d: int, dim: int | None) -> tuple[np.ndarray, np.ndarray, int]:
    """Falling eigenvalues and eigenvectors of the Gram matrix of the thin side of n x d, and its rank.

    As many as `dim` asks for, or without it all that have variance.
    """
    values, vectors = np.linalg.eigh(gram)
    values, vectors = np.maximum(values[::-1], 0.0), vectors[:, ::-1]
    rank = int((values > len(values) * np.finfo(float).eps * values[0]).sum())
    k = rank if dim is None else clamp_dim(dim, d, n)
    values, vectors = values[:k], vectors[:, :k].copy()
    if d > n:
        vectors[:, rank:] = 0.0  # beyond the rank rows span no direction
    return values, vectors, rank


def turned(x: np.ndarray, vectors: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Components, as columns, from eigenvectors of x x'."""
    scale = np.sqrt(values)
    return x.T @ (vectors / np.where(scale > 0, scale, np.inf))


def components_of_tile(x: np.ndarray, dim: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Mean, components as columns, their eigenvalues and the rank of a matrix that is one tile."""
    n, d = x.shape
    mean = x.mean(0)
    x = x - mean
    values, vectors, rank = directions(x @ x.T if d > n else x.T @ x, n, d, dim)
    return mean, turned(x, vectors, values) if d > n else vectors, values, rank


@dataclass(frozen=True)
class Shapes:
    """Largest numbers of tiles and of values along the sides of all matrices of a sweep, and which shapes occur.

    A sample is wide if it has fewer rows than features.
    """

    rows: int
    cols: int
    n: int
    d: int
    tall: bool
    wide: bool
    single: bool

    @staticmethod
    def of(sizes: DataFrame) -> Shapes:
        wide = F.col("n_features") > F.col("n_train")
        r = B.tile_counts(sizes).agg(
            F.max(ROWS).alias("rows"), F.max(COLS).alias("cols"), F.max("n_train").alias("n"), F.max("n_features").alias("d"),
            *[F.coalesce(F.bool_or(c), F.lit(False)).alias(n) for n, c in (("tall", ~wide), ("wide", wide), ("single", B.is_single()))],
        ).first()
        return Shapes(r["rows"] or 0, r["cols"] or 0, r["n"] or 0, r["d"] or 0, r["tall"], r["wide"], r["single"])


def _parts(df: DataFrame, keys: Sequence[str], *index: str) -> T.StructType:
    return B.schema(df, keys, **{c: T.IntegerType() for c in (SAMPLE, *index)}, **{SUMS: T.BinaryType()})


def column_means(tiles: DataFrame, sizes: DataFrame, keys: Sequence[str], shapes: Shapes) -> DataFrame:
    """(keys, SAMPLE, COL, mean, _wide) of the rows of every sample; `sizes` has keys and SAMPLE."""
    keys = list(keys)
    names = [*keys, SAMPLE, COL]

    def sums(key: tuple, tile: pd.Series) -> list[pd.DataFrame]:
        x, _, w = B.matrix(tile)
        return [B.keyed((*key[:-2], j, key[-1], key[-2]), [*names, BLOCK], **{SUMS: B.pack(x[mask].sum(0))}) for j, mask in B.samples_in(w)]

    parts = B.each_tile(tiles, [*keys, ROW, COL], sums, _parts(tiles, keys, COL, BLOCK))
    totals = B.tree_sum(parts, names, shapes.rows, B.TILE).join(sizes.select(*keys, SAMPLE, "n_train", "n_features"), [*keys, SAMPLE])

    def divide(key: tuple, total: pd.Series) -> list[pd.DataFrame]:
        n, d = int(total["n_train"]), int(total["n_features"])
        return [B.keyed(key, names, mean=B.pack(B.unpack(total[SUMS]) / n), _wide=d > n)]

    out = B.schema(tiles, keys, **{SAMPLE: T.IntegerType(), COL: T.IntegerType()}, mean=T.BinaryType(), _wide=T.BooleanType())
    return B.each_tile(totals, names, divide, out)


def with_means(tiles: DataFrame, means: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Tiles with the means of their columns in every sample."""
    lists = means.groupBy(*keys, COL).agg(F.collect_list(F.struct(SAMPLE, "mean", "_wide")).alias("_means"))
    return tiles.join(lists, [*keys, COL])


def _centred(tile: pd.Series) -> dict[int, tuple[np.ndarray, np.ndarray, bool]]:
    """Per sample with rows in the tile: these rows without their means, their mask, and whether the sample is wide."""
    x, _, w = B.matrix(tile)
    means = {int(m[SAMPLE]): m for m in tile["_means"]}
    return {j: (x[mask] - B.unpack(means[j]["mean"]), mask, bool(means[j]["_wide"])) for j, mask in B.samples_in(w) if j in means}


def _gram(tiles: DataFrame, keys: list[str], shapes: Shapes) -> DataFrame:
    """(keys, SAMPLE, _thin, _other, SUMS): tiles of the Gram matrices, upper half."""
    names = [*keys, SAMPLE, _THIN, _OTHER, BLOCK]
    out = _parts(tiles, keys, _THIN, _OTHER, BLOCK)

    def own(key: tuple, tile: pd.Series) -> list[pd.DataFrame]:
        row, col = key[-2:]
        return [
            B.keyed((*key[:-2], j, *((row, row, col) if wide else (col, col, row))), names, **{SUMS: B.pack(x @ x.T if wide else x.T @ x)})
            for j, (x, _, wide) in _centred(tile).items()
        ]

    parts = B.each_tile(tiles, [*keys, ROW, COL], own, out)
    for wide, thin, long, count, several in ((False, COL, ROW, COLS, shapes.tall and shapes.cols > 1), (True, ROW, COL, ROWS, shapes.wide and shapes.rows > 1)):
        if several:  # a thin side of several tiles: each pair of them, along every tile of the long side
            parts = parts.unionByName(_pairs(tiles, keys, wide, thin, long, count, names, out))
    longest = max(shapes.rows if shapes.tall else 1, shapes.cols if shapes.wide else 1)
    return B.tree_sum(parts, [*keys, SAMPLE, _THIN, _OTHER], longest, B.TILE**2)


def _pairs(tiles: DataFrame, keys: list[str], wide: bool, thin: str, long: str, count: str, names: list[str], out: T.StructType) -> DataFrame:
    shaped = tiles.select(*keys, F.col(thin).alias(_THIN), F.col(long).alias(BLOCK), F.col(count).alias("_thins"), "x", "y", "w", "_means")
    every = F.explode(F.sequence(F.lit(0), F.col("_thins") - 1))
    upper = F.col(_OTHER) > F.col(_THIN)
    first = shaped.withColumn(_OTHER, every).filter(upper)
    second = shaped.withColumnRenamed(_THIN, _OTHER).withColumn(_THIN, every).filter(upper)
    second = second.toDF(*second.columns)  # columns of its own, as both sides come from one table

    def pair(key: tuple, a: pd.Series, b: pd.Series) -> list[pd.DataFrame]:
        left, right = _centred(a), _centred(b)
        found = []
        for j in sorted(set(left) & set(right)):
            x, z = left[j][0], right[j][0]
            if left[j][2] == wide:
                found.append(B.keyed((*key[:-3], j, *key[-3:]), names, **{SUMS: B.pack(x @ z.T if wide else x.T @ z)}))
        return found

    return B.with_models(first, second, [*keys, _THIN, _OTHER, BLOCK], pair, out)


def _solve(gram: DataFrame, sizes: DataFrame, keys: list[str], dim: int | None) -> DataFrame:
    """(keys, SAMPLE, _thin, basis, values, pca_dim, rank, variance): eigenvectors of each thin tile, by falling eigenvalue."""
    names = [*keys, SAMPLE]
    kinds = {"basis": T.BinaryType(), "values": T.BinaryType(), "pca_dim": T.IntegerType(), "rank": T.IntegerType(), "variance": T.ArrayType(T.DoubleType())}
    out = B.schema(gram, names, **{_THIN: T.IntegerType()}, **kinds)

    def solve(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        n, d = int(pdf["n_train"].iloc[0]), int(pdf["n_features"].iloc[0])
        pieces = {(int(t), int(u)): B.unpack(data) for t, u, data in zip(pdf[_THIN], pdf[_OTHER], pdf[SUMS])}
        size = {t: round(len(values) ** 0.5) for (t, u), values in sorted(pieces.items()) if t == u}
        at = dict(zip(size, np.concatenate([[0], np.cumsum(list(size.values()))]).astype(int)))
        whole = np.zeros((sum(size.values()),) * 2)
        for (t, u), values in pieces.items():
            block = values.reshape(size[t], size[u])
            whole[at[t] : at[t] + size[t], at[u] : at[u] + size[u]] = block
            whole[at[u] : at[u] + size[u], at[t] : at[t] + size[t]] = block.T
        values, vectors, rank = directions(whole, n, d, dim)
        variance = (values / max(n - 1, 1)).tolist()
        rows = [B.keyed(key, names, **{_THIN: t}, basis=B.pack(vectors[at[t] : at[t] + size[t]]), values=B.pack(values), pca_dim=len(values),
                        rank=rank, variance=variance) for t in size]
        return pd.concat(rows, ignore_index=True)

    return gram.join(sizes.select(*names, "n_train", "n_features"), names).groupBy(*names).applyInPandas(solve, out)


def components_of(tiles: DataFrame, sizes: DataFrame, keys: Sequence[str], dim: int | None, shapes: Shapes) -> tuple[DataFrame, DataFrame]:
    """Of tiles with means: (keys, SAMPLE, COL, axes) with packed columns x components, and facts (keys, SAMPLE, pca_dim, rank, variance)."""
    keys = list(keys)
    names = [*keys, SAMPLE]
    solved = _solve(_gram(tiles, keys, shapes), sizes, keys, dim).persist(StorageLevel.MEMORY_AND_DISK)
    facts = solved.groupBy(*names).agg(F.max("pca_dim").alias("pca_dim"), F.max("rank").alias("rank"), F.first("variance").alias("variance"))
    counts = B.tile_counts(sizes).select(*names, COLS, (F.col("n_features") > F.col("n_train")).alias("_wide"))
    shaped = solved.join(counts, names)
    axes = shaped.filter("NOT _wide").select(*names, F.col(_THIN).alias(COL), F.col("basis").alias("axes"))
    if shapes.wide:
        bases = B.spread(shaped.filter("_wide").select(*names, F.col(_THIN).alias(ROW), COLS, "basis", "values"), COL, COLS).drop(COLS)

        def turn(key: tuple, tile: pd.Series, model: pd.Series) -> list[pd.DataFrame]:
            j, values = int(model[SAMPLE]), B.unpack(model["values"])
            x = _centred(tile)[j][0]
            part = turned(x, B.unpack(model["basis"]).reshape(len(x), len(values)), values)
            return [B.keyed((*key[:-2], j, key[-1], key[-2]), [*names, COL, BLOCK], **{SUMS: B.pack(part)})]

        parts = B.with_models(tiles, bases, [*keys, ROW, COL], turn, _parts(tiles, keys, COL, BLOCK))
        most = min(shapes.n, dim or shapes.n)
        axes = axes.unionByName(B.tree_sum(parts, [*names, COL], shapes.rows, B.TILE * most).withColumnRenamed(SUMS, "axes"))
    return axes, facts


def project(tiles: DataFrame, axes: DataFrame, sizes: DataFrame, keys: Sequence[str], shapes: Shapes, most: int) -> DataFrame:
    """(keys, SAMPLE, ROW, z): rows of every sample in component space, with y and weights as the last two columns of packed z."""
    keys = list(keys)
    names = [*keys, SAMPLE]
    models = B.spread(axes.join(B.tile_counts(sizes).select(*names, ROWS), names), ROW, ROWS).drop(ROWS)

    def turn(key: tuple, tile: pd.Series, model: pd.Series) -> list[pd.DataFrame]:
        j, held = int(model[SAMPLE]), _centred(tile)
        if j not in held:
            return []
        x, mask, _ = held[j]
        _, y, w = B.matrix(tile)
        z = x @ B.unpack(model["axes"]).reshape(x.shape[1], -1)
        first = float(key[-1] == 0)
        return [B.keyed((*key[:-2], j, *key[-2:]), [*names, ROW, BLOCK], **{SUMS: B.pack(np.column_stack([z, first * y[mask], first * w[mask, j]]))})]

    parts = B.with_models(tiles, models, [*keys, ROW, COL], turn, _parts(tiles, keys, ROW, BLOCK))
    return B.tree_sum(parts, [*names, ROW], shapes.cols, B.TILE * (most + 2)).withColumnRenamed(SUMS, "z")


def fit_pca(features: DataFrame, keys: Sequence[str], row: Sequence[str], dim: int) -> DataFrame:
    """(keys, pca_dim, rank, variance) of the training rows of `(keys, row, part, features)`, for all groups at once."""
    keys = list(keys)
    train = features.filter(F.col("part") == "train")
    sizes = train.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_train"), F.max(F.size("features")).alias("n_features"))
    sizes = sizes.withColumns({"n_rows": F.col("n_train"), SAMPLE: F.lit(0)}).persist()
    shapes = Shapes.of(sizes)
    rows = train.select(*dict.fromkeys([*keys, *row]), "features", F.lit(0.0).alias("y"), F.array(F.lit(1.0)).alias("w"))
    out = B.schema(train, keys, pca_dim=T.IntegerType(), rank=T.IntegerType(), variance=T.ArrayType(T.DoubleType()))

    def whole(key: tuple, x: np.ndarray, y: np.ndarray, w: np.ndarray) -> list[pd.DataFrame]:
        _, _, values, rank = components_of_tile(x, dim)
        return [B.keyed(key, keys, pca_dim=len(values), rank=rank, variance=(values / max(len(x) - 1, 1)).tolist())]

    found = []
    if shapes.single:
        found.append(B.each_single(rows, sizes, keys, whole, out))
    if shapes.rows > 1 or shapes.cols > 1:
        sizes = sizes.filter(~B.is_single())
        tiles = B.tiles(rows, sizes, keys, row)
        tiles = with_means(tiles, column_means(tiles, sizes, keys, shapes), keys)
        found.append(components_of(tiles, sizes, keys, dim, shapes)[1].drop(SAMPLE))
    return found[0] if len(found) == 1 else found[0].unionByName(found[1])


def explained_variance(components: DataFrame, keys: Sequence[str]) -> DataFrame:
    return components.select(*keys, "pca_dim", F.posexplode("variance").alias("component", "variance"))

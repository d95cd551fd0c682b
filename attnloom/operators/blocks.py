"""Many small-to-large matrices side by side: bounded tiles and tree sums.

Rows of all probes live in one table. The matrix of a probe is cut into tiles of
about TILE rows (by a hash of the example) and TILE columns, one table row each.
A task turns a tile into a matrix of sums; sums are added in a tree, and a task
adds no more of them at once than FAN_BYTES hold. So no task sees a whole matrix,
whatever its numbers of rows and columns are. A small matrix is one tile.

Resamples of the same rows share one matrix: a row has a weight for every sample,
and what a task makes of a tile it makes for each sample that has rows in it.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TILE = 1024
SAMPLE = "_sample"
FAN_BYTES = 1 << 28
#: Index and number of tiles along rows and columns; index of a part in a sum, and the sum.
ROW, ROWS, COL, COLS = "_row_tile", "_row_tiles", "_col_tile", "_col_tiles"
BLOCK, SUMS = "_block", "_sums"


def fields(df: DataFrame, names: Sequence[str]) -> list[T.StructField]:
    return [df.schema[n] for n in names]


def schema(df: DataFrame, keys: Sequence[str], **columns: T.DataType) -> T.StructType:
    """The fields of `keys` in `df`, and further columns."""
    return T.StructType([*fields(df, keys), *[T.StructField(n, t) for n, t in columns.items()]])


def pack(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values, dtype=np.float64).tobytes()


def unpack(data: bytes) -> np.ndarray:
    return np.frombuffer(data, dtype=np.float64)


def keyed(key: tuple, names: Sequence[str], **columns) -> pd.DataFrame:
    """One output row: the group key and some values."""
    values = {**dict(zip(names, key)), **columns}
    return pd.DataFrame({name: plain(pd.Series([value], dtype=object), value) for name, value in values.items()})


def plain(column: pd.Series, sample) -> pd.Series:
    """Numbers in a numeric dtype, everything else as objects: text must not become an Arrow-backed column."""
    return column.infer_objects() if isinstance(sample, (bool, int, float, np.number)) else column


def tile_counts(shapes: DataFrame) -> DataFrame:
    """`shapes` (n_rows, n_features) with the numbers of tiles along both sides."""
    along = {ROWS: "n_rows", COLS: "n_features"}
    return shapes.withColumns({name: F.ceil(F.col(n) / F.lit(float(TILE))).cast("int") for name, n in along.items()})


def is_single() -> Column:
    """Of shapes: the matrix is one tile."""
    return (F.col("n_rows") <= TILE) & (F.col("n_features") <= TILE)


def each_single(
    train: DataFrame, shapes: DataFrame, keys: Sequence[str], per_matrix: Callable[[tuple, np.ndarray, np.ndarray, np.ndarray], list[pd.DataFrame]],
    out: T.StructType,
) -> DataFrame:
    """Run a function on the matrix, y and weights (rows x samples) of every probe of `train` that is one tile."""
    keys = list(keys)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        x, w = (np.stack(pdf[c].to_numpy()) for c in ("features", "w"))
        return pd.concat(per_matrix(key, x, pdf["y"].to_numpy(), w), ignore_index=True)

    single = train.join(shapes.filter(is_single()).select(*keys), keys).select(*keys, "features", "y", "w")
    return single.groupBy(*keys).applyInPandas(run, out)


def tiles(train: DataFrame, shapes: DataFrame, keys: Sequence[str], row: Sequence[str]) -> DataFrame:
    """(keys, tile indices and counts, x, y, w): the matrix of every probe as packed tiles.

    `train` has keys, row, features (array), y and w, the weights of the row in
    every sample, 0 where it is in none. Column tiles carry y and w along. Rows
    of a tile are in the order of `row`.
    """
    keys = list(keys)
    own = [c for c in row if c not in keys]
    counted = train.join(tile_counts(shapes).select(*keys, ROWS, COLS), keys)
    cut = F.transform(F.sequence(F.lit(0), F.col(COLS) - 1), lambda i: F.slice("features", i * TILE + 1, TILE))
    rows = counted.withColumn(ROW, F.pmod(F.xxhash64(*row), F.col(ROWS)).cast("int")).select(
        *keys, *own, ROW, ROWS, COLS, "y", "w", F.posexplode(cut).alias(COL, "x")
    )
    names = [*keys, ROW, COL]

    def stack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(own, kind="stable") if own else pdf
        first = {c: int(pdf[c].iloc[0]) for c in (ROWS, COLS)}
        x, w = (pack(np.stack(pdf[c].to_numpy())) for c in ("x", "w"))
        return keyed(key, names, **first, x=x, y=pack(pdf["y"].to_numpy()), w=w)

    counts = {c: T.IntegerType() for c in (ROW, COL, ROWS, COLS)}
    out = schema(train, keys, **counts, x=T.BinaryType(), y=T.BinaryType(), w=T.BinaryType())
    return rows.groupBy(*names).applyInPandas(stack, out)


def matrix(tile: pd.Series) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """x, y and w of a tile."""
    y = unpack(tile["y"])
    return unpack(tile["x"]).reshape(len(y), -1), y, unpack(tile["w"]).reshape(len(y), -1)


def samples_in(w: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """Samples that hold rows of a tile, with the mask of these rows."""
    return [(int(j), w[:, j] > 0) for j in np.flatnonzero((w > 0).any(0))]


def rows_of(frames: list[pd.DataFrame], out: T.StructType) -> pd.DataFrame:
    if frames:
        return pd.concat(frames, ignore_index=True)
    return pd.DataFrame({f.name: pd.Series([], dtype=object) for f in out.fields})


def with_models(
    rows: DataFrame,
    models: DataFrame,
    names: Sequence[str],
    per_tile: Callable[[tuple, pd.Series, pd.Series], list[pd.DataFrame]],
    out: T.StructType,
) -> DataFrame:
    """Run a function on every row of `rows` together with each row of `models` of the same names."""

    def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = [] if left.empty else [f for _, model in right.iterrows() for f in per_tile(key, left.iloc[0], model)]
        return rows_of(found, out)

    return rows.groupBy(*names).cogroup(models.groupBy(*names)).applyInPandas(run, out)


def spread(models: DataFrame, index: str, count: str) -> DataFrame:
    """Each row once for every tile index below its count: a model travels once per tile, not once per row."""
    return models.withColumn(index, F.explode(F.sequence(F.lit(0), F.col(count) - 1)))


def each_tile(rows: DataFrame, names: Sequence[str], per_tile: Callable[[tuple, pd.Series], list[pd.DataFrame]], out: T.StructType) -> DataFrame:
    """Run a function on every row of `rows`, of which there is one per names."""
    return rows.groupBy(*names).applyInPandas(lambda key, pdf: rows_of(per_tile(key, pdf.iloc[0]), out), out)


def tree_sum(parts: DataFrame, names: Sequence[str], most: int, values: int) -> DataFrame:
    """Add the packed sums (SUMS) of each `names` over BLOCK, of which there are at most `most`, of about `values` numbers each."""
    names = list(names)
    fan = max(2, FAN_BYTES // (8 * max(1, values)))
    out = schema(parts, names, **{BLOCK: T.IntegerType(), SUMS: T.BinaryType()})

    def add(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        total = unpack(pdf[SUMS].iloc[0]).copy()
        for data in pdf[SUMS].iloc[1:]:
            total += unpack(data)
        return keyed(key, [*names, BLOCK], **{SUMS: pack(total)})

    while most > 1:
        merged = parts.withColumn(BLOCK, F.expr(f"{BLOCK} div {fan}").cast("int"))
        parts = merged.groupBy(*names, BLOCK).applyInPandas(add, out)
        most = -(-most // fan)
    return parts.drop(BLOCK)

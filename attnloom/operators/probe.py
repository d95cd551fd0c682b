"""Logistic-regression probes: L2 penalty, balanced classes, optional PCA.

A sweep is one table of feature rows keyed by probe, and all probes take one way.
Their matrices are cut into tiles. With PCA, and where there are more features
than rows, rows move into the space of the components (the penalty is invariant
under rotation, so without PCA all directions of the row space are kept). Damped
Newton steps follow: per pass every tile gives its probe's gradient and Hessian,
a tree adds them, and a small task solves for the next step; the number of passes
is that of the slowest probe (about ten). A probe that is one tile has no sums to
wait for and takes the same steps in one task.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import EXAMPLE
from ..session import cut_lineage
from . import blocks as B
from . import pca as P
from .metrics import probe_metrics

MAX_ITER = 2000  # fixed value: iteration limit of the reference solver, an upper bound here
SEED = 42  # fixed value: recorded seed; the fit itself has no random part
TOLERANCE = 1e-8
METRICS = ("auc", "average_precision", "precision", "recall", "f1")


def trained_in(samples: int | None) -> Column:
    """Samples in which a row trains: of `members`, or sample 0 for the training part."""
    if samples is None:
        return F.when(F.col("part") == "train", F.array(F.lit(0))).otherwise(F.array().cast("array<int>"))
    return F.transform(F.filter("members", lambda m: m["part"] == "train"), lambda m: m["sample"])


def probe_sizes(features: DataFrame, keys: Sequence[str], samples: int | None = None) -> DataFrame:
    """Training rows, class counts and width per probe and sample, and rows that train in any; one class or ragged features raise."""
    keys = list(keys)
    narrow = features.select(*keys, "label", F.size("features").alias("_d"), trained_in(samples).alias("_in"))
    sizes = narrow.select(*keys, "label", "_d", F.explode("_in").alias(B.SAMPLE)).groupBy(*keys, B.SAMPLE).agg(
        F.count(F.lit(1)).alias("n_train"),
        F.count_if(F.col("label") == 1).alias("n_1"),
        F.min("_d").alias("_narrow"),
        F.max("_d").alias("n_features"),
    )
    one_class = (F.col("n_1") == 0) | (F.col("n_1") == F.col("n_train"))
    guarded = (
        F.when(one_class, F.raise_error(F.lit("a probe needs training rows of both classes")))
        .when(F.col("_narrow") != F.col("n_features"), F.raise_error(F.lit("ragged features in one probe")))
        .otherwise(F.col("n_train"))
    )
    sizes = sizes.withColumn("n_train", guarded).drop("_narrow")
    if samples is None:
        return sizes.withColumn("n_rows", F.col("n_train"))
    rows = narrow.filter(F.size("_in") > 0).groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"))
    return sizes.join(rows, keys)


def balanced_weight(n: Column, n_1: Column, label: Column) -> Column:
    """n / (2 n_c): classes weigh the same and all weights sum to n."""
    return n / (2.0 * F.when(label == 1, n_1).otherwise(n - n_1))


def fit_probes(
    features: DataFrame,
    keys: Sequence[str],
    row: Sequence[str] = EXAMPLE,
    pca_dim: int | None = None,
    max_iter: int = MAX_ITER,
    tolerance: float = TOLERANCE,
    samples: int | None = None,
) -> DataFrame:
    """Fit every probe of `(keys, row, label, part, features)` on its training rows.

    Gives one row per probe: `coef` and `intercept` in the space of the given
    features (PCA is linear and folds into them), the number of trained
    parameters, the rank of the centred rows where they were rotated, and how
    the fit ended. With `samples`, rows have `members`, an array of (sample,
    part), instead of a part: every probe is fitted in each of that many samples
    of its rows, from one copy of them, and the result has a column `sample`.
    """
    keys = list(keys)
    sizes = cut_lineage(probe_sizes(features, keys, samples))
    shapes = P.Shapes.of(sizes)
    if not shapes.n:
        raise ValueError("no training rows")
    of = F.map_from_entries(F.collect_list(F.struct(B.SAMPLE, F.struct("n_train", "n_1"))))
    train = features.withColumn("_in", trained_in(samples)).filter(F.size("_in") > 0).join(sizes.groupBy(*keys).agg(of.alias("_sizes")), keys)

    def weight(j: int) -> Column:
        own = F.col("_sizes")[F.lit(j)]
        return F.when(F.array_contains("_in", j), balanced_weight(own["n_train"], own["n_1"], F.col("label"))).otherwise(F.lit(0.0))

    weights = F.array(*[weight(j) for j in range(samples or 1)])
    train = train.select(*keys, *[c for c in row if c not in keys], F.col("label").cast("double").alias("y"), weights.alias("w"), "features")
    kept: list[DataFrame] = []
    fitted = []
    try:
        if shapes.single:
            fitted.append(_fit_single(train, sizes, keys, pca_dim, max_iter, tolerance))
        if shapes.rows > 1 or shapes.cols > 1:
            sizes = sizes.filter(~B.is_single())
            tiles = B.tiles(train, sizes.select(*keys, "n_rows", "n_features").distinct(), keys, row)
            tiles = tiles.repartition(*keys, B.ROW, B.COL).persist(StorageLevel.MEMORY_AND_DISK)
            kept.append(tiles)
            rotated = F.lit(True) if pca_dim is not None else F.col("n_features") > F.col("n_train")
            for fit, own in ((_fit_rotated, sizes.filter(rotated)), (_fit_plain, sizes.filter(~rotated))):
                if not own.isEmpty():
                    fitted.append(fit(tiles, own, keys, pca_dim, max_iter, tolerance, kept))
        models = fitted[0]
        for more in fitted[1:]:
            models = models.unionByName(more)
        return cut_lineage(models.drop(B.SAMPLE) if samples is None else models.withColumnRenamed(B.SAMPLE, "sample"))
    finally:
        for table in kept:
            table.unpersist()


def _fit_single(train: DataFrame, sizes: DataFrame, keys: list[str], pca_dim: int | None, max_iter: int, tolerance: float) -> DataFrame:
    """Probes of one tile: all steps of the other fits, with nothing to add across tiles."""
    names = [*keys, B.SAMPLE]
    out = B.schema(
        train, keys, **{B.SAMPLE: T.IntegerType()}, coef=T.ArrayType(T.DoubleType()), intercept=T.DoubleType(), trainable_params=T.IntegerType(),
        pca_dim=T.IntegerType(), rank=T.IntegerType(), n_train=T.LongType(), iterations=T.IntegerType(), converged=T.BooleanType(),
    )

    def fit(key: tuple, x: np.ndarray, y: np.ndarray, s: np.ndarray) -> pd.DataFrame:
        n, d = x.shape
        mean, axes, rank = np.zeros(d), None, None
        if pca_dim is not None or d > n:
            mean, axes, _, rank = P.components_of_tile(x, pca_dim)
        beta, iterations, converged = newton(x if axes is None else (x - mean) @ axes, y, s, max_iter, tolerance)
        coef = beta[:-1] if axes is None else axes @ beta[:-1]
        dim = P.clamp_dim(pca_dim, d, n)
        return B.keyed(
            key, names, coef=coef.tolist(), intercept=float(beta[-1] - coef @ mean), trainable_params=(dim or d) + 1, pca_dim=dim,
            rank=rank, n_train=n, iterations=iterations, converged=converged,
        )

    def each(key: tuple, x: np.ndarray, y: np.ndarray, w: np.ndarray) -> list[pd.DataFrame]:
        return [fit((*key, j), x[mask], y[mask], w[mask, j]) for j, mask in B.samples_in(w)]

    return B.each_single(train, sizes.select(*keys, "n_rows", "n_features").distinct(), keys, each, out)


def _fit_rotated(
    tiles: DataFrame, sizes: DataFrame, keys: list[str], pca_dim: int | None, max_iter: int, tolerance: float, kept: list[DataFrame]
) -> DataFrame:
    """Probes on the components of their rows; coefficients return to the features by column tiles."""
    shapes = P.Shapes.of(sizes)
    names = [*keys, B.SAMPLE]
    means = P.column_means(tiles, sizes, keys, shapes).persist(StorageLevel.MEMORY_AND_DISK)
    whole = P.with_means(tiles, means, keys).repartition(*keys, B.ROW, B.COL).persist(StorageLevel.MEMORY_AND_DISK)
    axes, facts = P.components_of(whole, sizes, keys, pca_dim, shapes)
    axes, facts = axes.persist(StorageLevel.MEMORY_AND_DISK), facts.persist(StorageLevel.MEMORY_AND_DISK)
    kept += [means, whole, axes, facts]
    most = min(shapes.n, shapes.d, pca_dim or shapes.n)
    rows = P.project(whole, axes, sizes, keys, shapes, most)
    counts = B.tile_counts(sizes)
    start = counts.join(facts, names).select(*names, B.ROWS, F.col("pca_dim").alias("_d"))
    state = _newton(rows, start, names, shapes.rows, most, max_iter, tolerance)
    found = state.join(counts.select(*names, B.COLS), names)
    models = B.spread(found.select(*names, B.COLS, "_best"), B.COL, B.COLS).drop(B.COLS)
    parted = [*names, B.COL]

    def back(key: tuple, tile: pd.Series, model: pd.Series) -> list[pd.DataFrame]:
        beta, mean = B.unpack(model["_best"])[:-1], B.unpack(tile["mean"])
        coef = B.unpack(tile["axes"]).reshape(len(mean), -1) @ beta
        return [B.keyed(key, parted, part=coef.tolist(), shift=float(coef @ mean))]

    out = B.schema(sizes, names, **{B.COL: T.IntegerType()}, part=T.ArrayType(T.DoubleType()), shift=T.DoubleType())
    parts = B.with_models(axes.join(means.select(*parted, "mean"), parted), models, parted, back, out)
    joined = parts.groupBy(*names).agg(F.array_sort(F.collect_list(F.struct(B.COL, "part"))).alias("_parts"), F.sum("shift").alias("_shift"))
    ends = state.join(joined, names).join(facts.select(*names, F.col("pca_dim").alias("_dim"), "rank"), names).join(sizes.select(*names, "n_train", "n_features"), names)
    dim = F.lit(None).cast("int") if pca_dim is None else F.col("_dim")
    return ends.select(
        *names, F.flatten(F.transform("_parts", lambda p: p["part"])).alias("coef"), (F.col("_constant") - F.col("_shift")).alias("intercept"),
        (F.coalesce(dim, F.col("n_features")) + 1).cast("int").alias("trainable_params"), dim.alias("pca_dim"), "rank", "n_train", "iterations", F.col("done").alias("converged"),
    )


def _fit_plain(
    tiles: DataFrame, sizes: DataFrame, keys: list[str], pca_dim: None, max_iter: int, tolerance: float, kept: list[DataFrame]
) -> DataFrame:
    """Probes on their features as they are."""
    shapes = P.Shapes.of(sizes)
    names, step = [*keys, B.SAMPLE], B.TILE
    placed = [*names, B.ROW, B.BLOCK]

    def place(key: tuple, tile: pd.Series) -> list[pd.DataFrame]:
        x, y, w = B.matrix(tile)
        first = float(key[-1] == 0)
        found = []
        for j, mask in B.samples_in(w):
            if j in set(tile["_samples"]):
                z = np.zeros((mask.sum(), int(tile["n_features"]) + 2))
                z[:, key[-1] * step : key[-1] * step + x.shape[1]] = x[mask]
                z[:, -2], z[:, -1] = first * y[mask], first * w[mask, j]
                found.append(B.keyed((*key[:-2], j, *key[-2:]), placed, **{B.SUMS: B.pack(z)}))
        return found

    out = B.schema(tiles, keys, **{c: T.IntegerType() for c in (B.SAMPLE, B.ROW, B.BLOCK)}, **{B.SUMS: T.BinaryType()})
    sized = tiles.join(sizes.groupBy(*keys).agg(F.max("n_features").alias("n_features"), F.collect_list(B.SAMPLE).alias("_samples")), keys)
    parts = B.each_tile(sized, [*keys, B.ROW, B.COL], place, out)
    rows = B.tree_sum(parts, [*names, B.ROW], shapes.cols, B.TILE * (shapes.d + 2)).withColumnRenamed(B.SUMS, "z")
    start = B.tile_counts(sizes).select(*names, B.ROWS, F.col("n_features").cast("int").alias("_d"))
    state = _newton(rows, start, names, shapes.rows, shapes.d, max_iter, tolerance)
    none = F.lit(None).cast("int")
    return state.join(sizes.select(*names, "n_train", "n_features"), names).select(
        *names, F.col("_coef").alias("coef"), F.col("_constant").alias("intercept"), (F.col("n_features") + 1).cast("int").alias("trainable_params"),
        none.alias("pca_dim"), none.alias("rank"), "n_train", "iterations", F.col("done").alias("converged"),
    )


def objective(x: np.ndarray, y: np.ndarray, s: np.ndarray, beta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Weighted log loss of a block with its gradient and Hessian; the last column of `x` is the constant."""
    z = x @ beta
    p = 1.0 / (1.0 + np.exp(-np.clip(z, -700, 700)))
    loss = float(s @ (np.logaddexp(0.0, z) - y * z))
    return loss, x.T @ (s * (p - y)), x.T @ (x * (s * p * (1.0 - p))[:, None])


def newton_move(loss, gradient, hessian, beta, best, step, best_loss, slope, t, tolerance):
    """One damped step from the data terms at `beta`: accept and aim again, or halve the last step."""
    ridge = np.append(np.ones(len(beta) - 1), 0.0)  # the intercept has no penalty
    loss = loss + 0.5 * float(ridge @ beta**2)
    gradient = gradient + ridge * beta
    if loss <= best_loss + 1e-4 * t * slope + 1e-12 * max(1.0, abs(loss)):
        direction = -np.linalg.solve(hessian + np.diag(ridge), gradient)
        done = bool(np.max(np.abs(gradient)) <= tolerance * max(1.0, abs(loss)))
        return beta + direction, beta, direction, loss, float(gradient @ direction), 1.0, done
    return best + t / 2 * step, best, step, best_loss, slope, t / 2, bool(t < 1e-10)


def newton(x: np.ndarray, y: np.ndarray, s: np.ndarray, max_iter: int, tolerance: float) -> tuple[np.ndarray, int, bool]:
    """All steps on one matrix."""
    x = np.column_stack([x, np.ones(len(x))])
    zeros = np.zeros(x.shape[1])
    move = (zeros, zeros, zeros, float("inf"), 0.0, 1.0, False)
    for i in range(max_iter):
        move = newton_move(*objective(x, y, s, move[0]), *move[:-1], tolerance)
        if move[-1]:
            return move[1], i + 1, True
    return move[1], max_iter, False


_STATE = {
    B.ROWS: T.IntegerType(),
    "_d": T.IntegerType(),
    "_beta": T.BinaryType(),  # point to evaluate next
    "_best": T.BinaryType(),  # last accepted point
    "_step": T.BinaryType(),
    "_loss": T.DoubleType(),
    "_slope": T.DoubleType(),
    "_t": T.DoubleType(),
    "done": T.BooleanType(),
    "iterations": T.IntegerType(),
    "_constant": T.DoubleType(),
    "_coef": T.ArrayType(T.DoubleType()),
}


def _newton(
    rows: DataFrame, start: DataFrame, keys: list[str], most_tiles: int, width: int, max_iter: int, tolerance: float
) -> DataFrame:
    """Final state per probe of `rows` (keys, ROW, z: packed features, y, s); `start` has the tile counts and widths."""
    names = [*keys, B.ROW]
    part_schema = B.schema(rows, keys, **{B.BLOCK: T.IntegerType(), B.SUMS: T.BinaryType()})
    state_schema = B.schema(rows, keys, **_STATE)
    rows = rows.repartition(*names).persist(StorageLevel.MEMORY_AND_DISK)

    def sums(key: tuple, tile: pd.Series, model: pd.Series) -> list[pd.DataFrame]:
        d = int(model["_d"])
        z = B.unpack(tile["z"]).reshape(-1, d + 2)
        x, y, s = z[:, :d], z[:, d], z[:, d + 1]
        if model[B.ROWS] == 1:
            beta, iterations, converged = newton(x, y, s, max_iter, tolerance)
            out = np.concatenate([[iterations, converged], beta])
        else:
            loss, gradient, hessian = objective(np.column_stack([x, np.ones(len(x))]), y, s, B.unpack(model["_beta"]))
            out = np.concatenate([[loss], gradient, hessian.ravel()])
        return [B.keyed(key, [*keys, B.BLOCK], **{B.SUMS: B.pack(out)})]

    def advance(key: tuple, pdf: pd.DataFrame, model: pd.DataFrame) -> pd.DataFrame:
        m, total = model.iloc[0], B.unpack(pdf[B.SUMS].iloc[0])
        d, iterations = int(m["_d"]) + 1, int(m["iterations"]) + 1
        if m[B.ROWS] == 1:
            iterations, done, best = int(total[0]), bool(total[1]), total[2:]
            beta, step, loss, slope, t = best, best, 0.0, 0.0, 1.0
        else:
            beta, best, step, loss, slope, t, done = newton_move(
                total[0], total[1 : d + 1], total[d + 1 :].reshape(d, d), B.unpack(m["_beta"]), B.unpack(m["_best"]),
                B.unpack(m["_step"]), m["_loss"], m["_slope"], m["_t"], tolerance,
            )
        return B.keyed(
            key, keys, **{B.ROWS: int(m[B.ROWS])}, _d=d - 1, _beta=B.pack(beta), _best=B.pack(best), _step=B.pack(step),
            _loss=float(loss), _slope=float(slope), _t=float(t), done=done, iterations=iterations,
            _constant=float(best[-1]), _coef=best[:-1].tolist(),
        )

    def begin(key: tuple, m: pd.Series) -> list[pd.DataFrame]:
        zeros = B.pack(np.zeros(int(m["_d"]) + 1))
        return [B.keyed(
            key, keys, **{B.ROWS: int(m[B.ROWS])}, _d=int(m["_d"]), _beta=zeros, _best=zeros, _step=zeros, _loss=float("inf"),
            _slope=0.0, _t=1.0, done=False, iterations=0, _constant=0.0, _coef=[],
        )]

    state = B.each_tile(start, keys, begin, state_schema)
    try:
        for _ in range(max_iter):
            # a probe of one tile is through with its first pass, converged or not
            open_ = ~F.col("done") & ((F.col(B.ROWS) > 1) | (F.col("iterations") == 0))
            active = state.filter(open_)
            models = B.spread(active.select(*keys, F.col(B.ROWS).alias("_n"), B.ROWS, "_d", "_beta"), B.ROW, "_n").drop("_n")
            parts = B.with_models(rows, models, names, sums, part_schema)
            total = B.tree_sum(parts, keys, most_tiles, (width + 1) ** 2)
            moved = total.groupBy(*keys).cogroup(active.groupBy(*keys)).applyInPandas(advance, state_schema)
            state = cut_lineage(moved.unionByName(state.filter(~open_)))
            if state.filter(open_).isEmpty():
                break
    finally:
        rows.unpersist()
    return state


# ---------------------------------------------------------------- scoring


def score(features: DataFrame, models: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Probability of class 1 and the predicted class for every row; stays in the JVM.

    A row whose vector is not as wide as the probe's coefficients raises.
    """
    joined = features.join(models.select(*keys, "coef", "intercept"), list(keys))
    z = F.aggregate(
        F.zip_with("features", "coef", lambda x, c: x * c), F.col("intercept"), lambda acc, v: acc + v
    )
    width = F.raise_error(F.lit("features and probe differ in width"))
    z = F.when(F.size("features") != F.size("coef"), width).otherwise(z)
    scored = joined.withColumn("p1", 1.0 / (1.0 + F.exp(-z))).drop("features", "coef", "intercept")
    return scored.withColumn("pred", (F.col("p1") > 0.5).cast("int"))


def score_each(
    features: DataFrame, models: DataFrame, keys: Sequence[str], by: Sequence[str], row: Sequence[str], salts: int = 64,
    wanted: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """Every row under every model of its `keys`; models of equal keys differ in `by`.

    The models of a key are stacked into one row, so a vector meets them in one
    join and is copied for none of them. As few keys hold all rows, rows are
    dealt over `salts` copies of the stack. `wanted` of a model tells whether the
    row takes it. A model of another width raises.
    """
    keys, by = list(keys), list(by)
    stacks = models.groupBy(*keys).agg(F.collect_list(F.struct(*by, "coef", "intercept")).alias("_models"))
    stacks = stacks.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    dealt = features.withColumn("_salt", F.pmod(F.xxhash64(*row), F.lit(salts)).cast("int"))
    width = F.raise_error(F.lit("features and probe differ in width"))

    def scored(m: Column) -> Column:
        z = F.aggregate(F.zip_with("features", m["coef"], lambda x, c: x * c), m["intercept"], lambda acc, v: acc + v)
        z = F.when(F.size("features") != F.size(m["coef"]), width).otherwise(z)
        return F.struct(*[m[c].alias(c) for c in by], (1.0 / (1.0 + F.exp(-z))).alias("p1"))

    joined = dealt.join(stacks, [*keys, "_salt"]).withColumn("_scores", F.transform(F.filter("_models", wanted) if wanted else F.col("_models"), scored)).drop("_models", "_salt", "features")
    rest = [c for c in joined.columns if c != "_scores"]
    return joined.select(*rest, F.inline("_scores")).withColumn("pred", (F.col("p1") > 0.5).cast("int"))


def probe_results(predictions: DataFrame, models: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per probe: metadata and the five metrics of both parts."""
    keys = list(keys)
    per_part = probe_metrics(predictions, [*keys, "part"])
    wide = per_part.groupBy(*keys).agg(
        *[
            F.max(F.when(F.col("part") == part, F.col(m))).alias(f"{part}_{m}")
            for part in ("train", "test")
            for m in METRICS
        ]
    )
    facts = models.drop("coef", "intercept").withColumn("random_seed", F.lit(SEED)).withColumn("max_iter", F.lit(MAX_ITER))
    return facts.join(wide, keys)


def run_probes(
    features: DataFrame, keys: Sequence[str], row: Sequence[str] = EXAMPLE, pca_dim: int | None = None, samples: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """Fit, score and measure a sweep: `(results, predictions)`; with `samples` (see `fit_probes`) each sample for itself.

    Predictions are narrow and used several times, so they are written once;
    the metrics then start from them and not from the feature pipeline.
    """
    keys = list(keys)
    features = features.persist(StorageLevel.MEMORY_AND_DISK)  # read by sizes, fit and score
    try:
        models = fit_probes(features, keys, row, pca_dim, samples=samples)
        if samples is None:
            scored = score(features, models, keys)
        else:
            of = F.map_from_entries(F.transform("members", lambda m: F.struct(m["sample"], m["part"])))
            scored = score_each(features.withColumn("_part", of).drop("members"), models, keys, ["sample"], row, wanted=lambda m: F.map_contains_key("_part", m["sample"]))
            scored = scored.withColumn("part", F.col("_part")[F.col("sample")]).drop("_part")
            keys.append("sample")
        predictions = cut_lineage(scored)
    finally:
        features.unpersist()
    return probe_results(predictions, models, keys), predictions

"""Splits, samples, global orders and perturbations, all deterministic under any partitioning.

Random choices are orders by a seeded hash of the example key. The first rows of
an order come from `ordering.first_in_group`, ranks from `ordering.rank_in_group`,
so a run that holds most rows is still spread out.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import EXAMPLE, RUN
from .labels import valid_only
from .ordering import first_in_group, hash_bucket, rank_in_group


@dataclass(frozen=True)
class RandomOrder:
    """A pseudo-random order of examples: sort columns and a bucket that follows them.

    The default sorts by `xxhash64(row_idx, seed)`. Any expression of the key
    and the seed can be given instead, for instance one another engine can
    also evaluate.
    """

    key: Callable[[Column, Column], Column] = lambda row, seed: F.xxhash64(row, seed)
    bucket: Callable[[Column], Column] = hash_bucket

    def columns(self, row: Column, seed: Column) -> tuple[Column, list[Column]]:
        value = self.key(row, seed)
        return self.bucket(value), [value, row]


HASHED = RandomOrder()


def class_quota(counts: DataFrame, run: Sequence[str], n_train: Column) -> DataFrame:
    """Exact number of training rows per class by largest remainder, in integers.

    `counts` has one row per (run, label) with `n`; `n_train` may use `n_total`.
    """
    every = Window.partitionBy(*run)
    sized = counts.withColumn("n_total", F.sum("n").over(every)).withColumn("_train", n_train.cast("long"))
    exact = F.col("_train") * F.col("n")
    shares = sized.select(
        "*", F.expr("(_train * n) div n_total").alias("_floor"), (exact % F.col("n_total")).alias("_rest")
    )
    by_rest = Window.partitionBy(*run).orderBy(F.col("_rest").desc(), "label")
    left_over = F.col("_train") - F.sum("_floor").over(every)
    quota = F.col("_floor") + (F.row_number().over(by_rest) <= left_over).cast("long")
    return shares.select(*run, "label", quota.alias("quota"))


def _quota_split(
    labels: DataFrame, n_train: Column, order: RandomOrder, seed: Column, run: Sequence[str], row: str
) -> DataFrame:
    counts = labels.groupBy(*run, "label").agg(F.count(F.lit(1)).alias("n"))
    quota = class_quota(counts, run, n_train)
    bucket, keys = order.columns(F.col(row), seed)
    return first_in_group(labels, [*run, "label"], bucket, keys, quota)


def stratified_split(
    labels: DataFrame,
    test_size: float = 0.2,
    seed: int = 42,
    order: RandomOrder = HASHED,
    run: Sequence[str] = RUN,
    row: str = "row_idx",
) -> DataFrame:
    """Valid examples into `train` and `test`, class shares kept to the row.

    The test part has ceil(test_size * n) rows. Rows are compared with a limit
    per class and never ranked.
    """
    n_train = F.col("n_total") - F.ceil(F.col("n_total") * F.lit(test_size))
    valid = valid_only(labels).select(*run, row, "label")
    placed = _quota_split(valid, n_train, order, F.lit(seed), run, row)
    part = F.when(F.col("chosen"), "train").otherwise("test")
    return placed.select(*run, row, "label", part.alias("part"))


def train_fractions(
    split: DataFrame,
    fractions: Sequence[float],
    seeds: Sequence[int],
    order: RandomOrder = HASHED,
    run: Sequence[str] = RUN,
    row: str = "row_idx",
) -> DataFrame:
    """Stratified subsets of the training part for every fraction and seed; the test part stays.

    Takes `(run, row, label, part)`; a fraction of 1.0 is the whole split.
    """
    grid = F.explode(F.array(*[F.struct(F.lit(float(f)).alias("frac"), F.lit(int(s)).alias("seed"))
                               for f in fractions for s in seeds]))
    spread = split.select(*run, row, "label", "part", grid.alias("_g")).select(
        *run, row, "label", "part", "_g.frac", "_g.seed"
    )
    group = [*run, "frac", "seed"]
    n_train = F.floor(F.col("n_total") * F.col("frac"))
    placed = _quota_split(spread.filter(F.col("part") == "train"), n_train, order, F.col("seed"), group, row)
    chosen = placed.filter("chosen")
    columns = [*run, row, "label", "part", "frac", "seed"]
    return chosen.select(*columns).unionByName(spread.filter(F.col("part") == "test").select(*columns))


def balanced_samples(
    labels: DataFrame,
    per_class: int,
    seeds: Sequence[int],
    test_size: float = 0.2,
    order: RandomOrder = HASHED,
    run: Sequence[str] = RUN,
    row: str = "row_idx",
) -> DataFrame:
    """`per_class` examples of each class per run and seed, then a stratified split of them.

    A class that does not have more than `per_class` examples raises.
    """
    valid = valid_only(labels).select(*run, row, "label")
    spread = valid.select("*", F.explode(F.lit([int(s) for s in seeds])).alias("seed"))
    group = [*run, "seed"]
    counts = spread.groupBy(*group, "label").agg(F.count(F.lit(1)).alias("_n"))
    bucket, keys = order.columns(F.col(row), F.col("seed"))
    # both classes have the same size, so the quota is the same for both up to one row
    total = 2 * per_class
    n_train = total - _ceil(test_size * total)
    scarce = F.raise_error(F.lit(f"a class has no more than {per_class} examples"))
    picked = counts.select(*group, "label", F.when(F.col("_n") <= per_class, scarce).otherwise(F.lit(per_class)).alias("quota"))
    sample = first_in_group(spread, [*group, "label"], bucket, keys, picked).filter("chosen").drop("chosen")
    train = F.when(F.col("label") == 0, n_train - n_train // 2).otherwise(n_train // 2)
    split = first_in_group(sample, [*group, "label"], bucket, keys, picked.select(*group, "label", train.alias("quota")))
    return split.select(*group, row, "label", F.when(F.col("chosen"), "train").otherwise("test").alias("part"))


def _ceil(x: float) -> int:
    return int(-(-x // 1))


def split_statistics(split: DataFrame, run: Sequence[str] = RUN) -> DataFrame:
    """Class counts and their ratio for train, test and the total, from one grouping-sets aggregate."""
    rolled = split.groupingSets([[*run, "part"], list(run)], *run, "part").agg(
        F.count_if(F.col("label") == 0).alias("n_correct"),
        F.count_if(F.col("label") == 1).alias("n_incorrect"),
        F.count(F.lit(1)).alias("n_total"),
    )
    return rolled.select(
        *run,
        F.coalesce("part", F.lit("total")).alias("part"),
        "n_correct",
        "n_incorrect",
        "n_total",
        F.round(F.try_divide(F.col("n_incorrect"), F.col("n_correct")), 3).alias("ratio"),
    )


def length_order(df: DataFrame, field: str, row: str = "row_idx", run: Sequence[str] = (), chunk: int = 1 << 20) -> DataFrame:
    """Global position by descending text length, ties by row; `(row -> pos)` is also the inverse.

    Lengths are the buckets; a length shared by many rows is cut further by
    chunks of the row index, so no task ever ranks more than `chunk` rows.
    """
    sized = df.select(*run, row, F.length(field).alias("length"))
    buckets = [-F.col("length"), F.floor(F.col(row) / F.lit(chunk))]
    ranked = rank_in_group(sized, run, buckets, [F.col(row)], "_rank")
    return ranked.select(*run, row, "length", (F.col("_rank") - 1).alias("pos"))


# ---------------------------------------------------------------- perturbation

Uniform = Callable[[Sequence[Column], int], Column]


def hashed_uniform(keys: Sequence[Column], stream: int) -> Column:
    """A uniform number strictly between 0 and 1 from a hash of keys and a stream number."""
    top = F.shiftrightunsigned(F.xxhash64(*keys, F.lit(stream)), 11)
    return (top + 0.5) / F.lit(float(1 << 53))


def perturb(
    diags: DataFrame,
    stds: Sequence[float | None],
    repeats: int,
    diag: str = "lap_diag",
    uniform: Uniform = hashed_uniform,
    low: float = 0.5,
    high: float = 1.0,
    example: Sequence[str] = EXAMPLE,
) -> DataFrame:
    """Gaussian noise on a random share of the cells of every example.

    Per (std, repeat): the share is uniform in `low..high`, exactly
    `int(total * share)` cells are hit, each with N(0, std^2). std None leaves
    the values as they are.

    Heads are gathered once per example; the settings multiply rows only after
    that shuffle and everything else is row-local. The cells that are hit are
    those whose random key is at most the m-th smallest of the example. Gives
    `(example, std, rep, fraction, l2, heads)` with `heads` an array of
    `(layer, head, values, noise)`.
    """
    gathered = diags.groupBy(*example).agg(
        F.array_sort(F.collect_list(F.struct("layer", "head", F.col(diag).alias("values")))).alias("_heads")
    )
    grid = F.explode(F.array(*[F.struct(F.lit(s).cast("double").alias("std"), F.lit(r).alias("rep"))
                               for s in stds for r in range(repeats)]))
    items = gathered.select(*example, "_heads", grid.alias("_g")).select(*example, "_heads", "_g.std", "_g.rep")
    whole = [*[F.col(c) for c in example], F.coalesce(F.col("std"), F.lit(0.0)), F.col("rep")]

    def cell(h: Column, k: Column) -> list[Column]:
        return [*whole, h["layer"], h["head"], k]

    def key(h: Column, k: Column) -> Column:
        return F.struct(
            uniform(cell(h, k), 1).alias("u"), h["layer"].alias("layer"), h["head"].alias("head"), k.alias("k")
        )

    def normal(h: Column, k: Column) -> Column:
        return F.sqrt(-2.0 * F.ln(uniform(cell(h, k), 2))) * F.cos(F.lit(6.283185307179586) * uniform(cell(h, k), 3))

    keys = F.flatten(F.transform("_heads", lambda h: F.transform(h["values"], lambda v, k: key(h, k))))
    marked = items.withColumn("_keys", F.sort_array(keys)).withColumn(
        "fraction", F.when(F.col("std").isNull(), 0.0).otherwise(F.lit(low) + F.lit(high - low) * uniform(whole, 0))
    )
    cutoff = F.get("_keys", F.floor(F.size("_keys") * F.col("fraction")).cast("int") - 1)
    marked = marked.withColumn("_cutoff", cutoff).drop("_keys")

    def noise(h: Column, k: Column) -> Column:
        hit = F.col("_cutoff").isNotNull() & (key(h, k) <= F.col("_cutoff"))
        return F.when(hit, normal(h, k) * F.col("std")).otherwise(0.0)

    heads = F.transform(
        "_heads",
        lambda h: F.struct(
            h["layer"].alias("layer"),
            h["head"].alias("head"),
            h["values"].alias("values"),
            F.transform(h["values"], lambda v, k: noise(h, k)).alias("noise"),
        ),
    )
    done = marked.withColumn("heads", heads)
    squares = F.aggregate(
        "heads", F.lit(0.0), lambda acc, h: acc + F.aggregate(h["noise"], F.lit(0.0), lambda a, x: a + x * x)
    )
    return done.select(*example, "std", "rep", "fraction", F.sqrt(squares).alias("l2"), "heads")


def perturbation_size(items: DataFrame, run: Sequence[str] = RUN) -> DataFrame:
    """Mean L2 norm of the noise and mean share of cells hit, per run, std and repeat."""
    return items.groupBy(*run, "std", "rep").agg(
        F.avg("l2").alias("avg_diff_l2_norm"), F.avg("fraction").alias("avg_perturbation_fraction")
    )


def perturbed_diagonals(items: DataFrame, example: Sequence[str] = EXAMPLE) -> DataFrame:
    """Perturbed values as one array per head, std and repeat."""
    heads = items.select(*example, "std", "rep", F.inline("heads"))
    noisy = F.zip_with("values", "noise", lambda v, e: v + e)
    return heads.select(*example, "layer", "head", "std", "rep", noisy.alias("lap_diag"))


def perturbation_summary(sizes: DataFrame) -> DataFrame:
    """Mean, extremes and deviation of the share of perturbed cells, over perturbed runs only."""
    share = "avg_perturbation_fraction"
    return sizes.filter(F.col("std").isNotNull()).agg(
        F.avg(share).alias("mean"), F.min(share).alias("min"), F.max(share).alias("max"), F.stddev_samp(share).alias("std")
    )

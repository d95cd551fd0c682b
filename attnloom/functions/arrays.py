"""Column functions over arrays: padding ranges, matrix rows, logs, top-k, statistics.

An array used several times inside one lambda is always passed in as the
*argument* of the higher-order function, so Spark evaluates it once per row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: quantiles of the per-head statistics
QUANTILES = (0.01, 0.05, 0.25, 0.5, 0.95, 0.99)
STAT_NAMES = ("mean", "std", "q01", "q05", "q25", "q50", "q95", "q99")


def first_kept(tokens: Column, pad: Column | int) -> Column:
    """0-based index of the first token that is not padding; 0 if there is none."""
    pad = pad if isinstance(pad, Column) else F.lit(pad)
    at = F.array_position(F.transform(tokens, lambda t: t != pad), True)
    return F.greatest(at - 1, F.lit(0)).cast("int")


def last_kept(tokens: Column, pad: Column | int) -> Column:
    """0-based index of the last token that is not padding; the last index if there is none."""
    return F.size(tokens) - 1 - first_kept(F.reverse(tokens), pad)


def edge_padding_mask(tokens: Column, pad: int) -> Column:
    """True where padding touches the left or right end; interior padding stays False."""
    bounds = F.array(first_kept(tokens, pad), last_kept(tokens, pad))
    inside = F.flatten(
        F.transform(F.array(bounds), lambda b: F.transform(F.sequence(F.lit(0), F.size(tokens) - 1),
                                                           lambda i: (i < b[0]) | (i > b[1])))
    )
    return F.when(F.size(tokens) == 0, F.array().cast("array<boolean>")).otherwise(inside)


def cut(values: Column, first: Column, last: Column) -> Column:
    """Elements `first..last`, both 0-based and inclusive."""
    return F.slice(values, first + 1, last - first + 1)


def diagonal(rows: Column) -> Column:
    """A[i][i] of a matrix held as an array of rows."""
    return F.transform(rows, lambda row, i: F.get(row, i))


def column_sums(rows: Column) -> Column:
    """Sum over rows for every column; rows may be ragged (missing entries are zero)."""
    zeros = F.array_repeat(F.lit(0.0), F.size(rows))
    return F.aggregate(
        rows,
        zeros,
        lambda acc, row: F.zip_with(acc, row, lambda a, b: a + F.coalesce(b.cast("double"), F.lit(0.0))),
    )


def log_or_inf(x: Column) -> Column:
    """Natural log with IEEE results: -inf at 0 and NaN below, where Spark's `ln` gives NULL."""
    return F.when(x == 0, F.lit(float("-inf"))).when(x < 0, F.lit(float("nan"))).otherwise(F.ln(x))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def mean(values: Column) -> Column:
    return total(values) / F.size(values)


def mean_log(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + log_or_inf(x)) / F.size(values)


def top_k(values: Column, k: int) -> Column:
    """The k largest, descending. Fewer than k values is an error: padding would change the features."""
    return first_k(F.sort_array(values, asc=False), k)


def first_k(descending: Column, k: int) -> Column:
    """`top_k` of an array that is sorted already."""
    short = F.size(descending) < k
    return F.when(short, F.raise_error(F.lit(f"sequence shorter than top-k {k}"))).otherwise(F.slice(descending, 1, k))


def describe(descending: Column) -> Column:
    """mean, sample std and six linear-interpolation quantiles of an array sorted descending.

    A single value has no sample deviation: NaN, as in IEEE arithmetic.
    """

    def stats(v: Column) -> Column:
        n = F.size(v)
        mu = mean(v)
        squares = F.aggregate(
            v,
            F.struct(F.lit(0.0).alias("sum"), F.lit(0.0).alias("m2"), F.lit(0).alias("n")),
            _welford,
            lambda acc: acc["m2"],
        )
        std = F.when(n > 1, F.sqrt(squares / (n - 1))).otherwise(F.lit(float("nan")))

        def quantile(p: float) -> Column:
            # position counted from the smallest; the array runs from the largest
            pos = (n - 1) * F.lit(p)
            lo = F.floor(pos).cast("int")
            hi = F.ceil(pos).cast("int")
            at_lo, at_hi = F.get(v, n - 1 - lo), F.get(v, n - 1 - hi)
            return at_lo + (at_hi - at_lo) * (pos - lo)

        return F.array(mu, std, *[quantile(p) for p in QUANTILES])

    return F.get(F.transform(F.array(descending), stats), F.lit(0))


def _welford(acc: Column, x: Column) -> Column:
    n = acc["n"] + 1
    mean_before = F.when(acc["n"] == 0, F.lit(0.0)).otherwise(acc["sum"] / acc["n"])
    mean_after = (acc["sum"] + x) / n
    return F.struct(
        (acc["sum"] + x).alias("sum"),
        F.when(acc["n"] == 0, F.lit(0.0)).otherwise(acc["m2"] + (x - mean_before) * (x - mean_after)).alias("m2"),
        n.alias("n"),
    )


def last_true(mask: Column) -> Column:
    """0-based index of the last true element; the last index if none is true."""
    at = F.array_position(F.reverse(mask), True)
    return F.size(mask) - 1 - F.greatest(at - 1, F.lit(0)).cast("int")


def rounded(x: Column, digits: int = 6) -> Column:
    """Round without producing negative zero."""
    return F.when(F.abs(x) < 0.5 * 10**-digits, F.lit(0.0)).otherwise(F.round(x, digits))


def members(values: Column, allowed: Sequence[int]) -> Column:
    """Element-wise membership in a fixed vocabulary."""
    vocabulary = F.lit(list(allowed))
    return F.transform(values, lambda x: F.array_contains(vocabulary, x))

"""Exact ranks and running totals inside groups that may be arbitrarily large.

A plain window over a group sorts the whole group in one task. Here every
group is cut into buckets whose order agrees with the wanted order: bucket
totals give each bucket its starting offset (a small window over buckets), and
a second window runs inside one bucket only. The result is exact whatever the
bucket sizes are; the buckets only decide how evenly the work spreads.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

BUCKET = "_bucket"
COARSE = 32
ACCURACY = 10_000  # entries of a quantile sketch


def running_totals(
    df: DataFrame, group: Sequence[str], bucket: Sequence[str], order: Sequence[Column], sums: Sequence[str]
) -> DataFrame:
    """Add `below_<c>`, the sum of `c` over all rows of the group that come strictly before,
    and `all_<c>`, its sum over the whole group."""
    group, bucket = list(group), list(bucket)
    offsets = _offsets(df, group, bucket, sums)
    inside = Window.partitionBy(*group, *bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    joined = df.join(offsets, [*group, *bucket])
    return joined.select(
        *df.columns,
        *[
            (F.col(f"_before_{c}") + F.coalesce(F.sum(c).over(inside), F.lit(0))).alias(f"below_{c}")
            for c in sums
        ],
        *[f"all_{c}" for c in sums],
    )


def _offsets(df: DataFrame, group: list[str], bucket: list[str], sums: Sequence[str]) -> DataFrame:
    """Sum before each bucket and over the whole group.

    Nested buckets are handled level by level, so a window holds the children
    of one parent bucket and never all buckets of a group.
    """
    totals = df.groupBy(*group, *bucket).agg(*[F.sum(c).alias(f"_total_{c}") for c in sums])
    offsets = None
    for depth in range(1, len(bucket) + 1):
        parent, level = [*group, *bucket[: depth - 1]], bucket[:depth]
        at_level = totals
        if depth < len(bucket):
            at_level = totals.groupBy(*group, *level).agg(*[F.sum(f"_total_{c}").alias(f"_total_{c}") for c in sums])
        siblings = Window.partitionBy(*parent)
        earlier = siblings.orderBy(bucket[depth - 1]).rowsBetween(Window.unboundedPreceding, -1)
        before = [F.coalesce(F.sum(f"_total_{c}").over(earlier), F.lit(0)).alias(f"_before_{c}") for c in sums]
        if offsets is None:
            whole = [F.sum(f"_total_{c}").over(siblings).alias(f"all_{c}") for c in sums]
            offsets = at_level.select(*group, *level, *before, *whole)
        else:
            inner = at_level.select(*group, *level, *[b.alias(f"_inner_{c}") for b, c in zip(before, sums)])
            offsets = inner.join(offsets, parent).select(
                *group,
                *level,
                *[(F.col(f"_before_{c}") + F.col(f"_inner_{c}")).alias(f"_before_{c}") for c in sums],
                *[f"all_{c}" for c in sums],
            )
    return offsets


def rank_in_group(
    df: DataFrame, group: Sequence[str], bucket: Column | Sequence[Column], order: Sequence[Column], name: str
) -> DataFrame:
    """Add a 1-based exact rank. `bucket` must not decrease along `order`."""
    buckets = [bucket] if isinstance(bucket, Column) else list(bucket)
    names = [f"{BUCKET}{i}" for i in range(len(buckets))]
    tagged = df.select("*", *[b.alias(n) for b, n in zip(buckets, names)], F.lit(1).cast("long").alias("_one"))
    ranked = running_totals(tagged, group, names, order, ["_one"])
    return ranked.withColumn(name, F.col("below__one") + 1).drop(*names, "_one", "below__one", "all__one")


def first_in_group(
    df: DataFrame, group: Sequence[str], bucket: Column, order: Sequence[Column], quota: DataFrame
) -> DataFrame:
    """Add `chosen`: the row is among the first `quota` of its group along `order`, which no two rows share.

    Rows are not ranked. Counts per bucket tell in which bucket of a group the
    quota is reached; only rows of that bucket are sorted, to find the last one
    chosen. Every row is then compared with its group's limit. `bucket` must not
    decrease along `order`; groups without a quota have no chosen rows.
    """
    group = list(group)
    order = list(order)
    counts = df.groupBy(*group, bucket.alias(BUCKET)).agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*group).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    reached = counts.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).join(quota.select(*group, "quota"), group)
    reached = reached.withColumn("_inside", (F.col("_before") < F.col("quota")) & (F.col("_before") + F.col("_n") > F.col("quota")))
    # whole buckets up to `_full`, and of `_edge` the first `_need` rows
    limits = reached.groupBy(*group).agg(
        F.max(F.when(F.col("_before") + F.col("_n") <= F.col("quota"), F.col(BUCKET))).alias("_full"),
        F.max(F.when(F.col("_inside"), F.col(BUCKET))).alias("_edge"),
        F.max(F.when(F.col("_inside"), F.col("quota") - F.col("_before"))).alias("_need"),
    )
    limits = cut_lineage(limits)
    place = F.struct(*[c.alias(f"_o{i}") for i, c in enumerate(order)])
    edge_rows = df.join(limits.filter("_edge is not null"), group).filter(bucket == F.col("_edge"))
    sorted_ = Window.partitionBy(*group).orderBy(*order)
    last = edge_rows.withColumn("_rank", F.row_number().over(sorted_)).filter(F.col("_rank") == F.col("_need")).select(*group, place.alias("_last"))
    bounded = df.join(limits.join(last, group, "left"), group, "left")
    chosen = (bucket <= F.col("_full")) | ((bucket == F.col("_edge")) & (place <= F.col("_last")))
    return bounded.withColumn("chosen", F.coalesce(chosen, F.lit(False))).drop("_full", "_edge", "_need", "_last")


def value_buckets(df: DataFrame, group: Sequence[str], value: str, buckets: int = 1024, rows: int = 4096) -> DataFrame:
    """Add `_bucket`, an integer that never decreases with `value` inside the group.

    Boundaries come from a quantile sketch, merged across tasks and of bounded
    size; a group has one bucket per `rows` rows and `buckets` at most. They are
    stored, so that they are the same on every evaluation.
    """
    if not group:
        return value_buckets(df.withColumn("_all", F.lit(0)), ["_all"], value, buckets, rows).drop("_all")
    group = list(group)
    steps = [i / buckets for i in range(1, buckets)]
    sketched = df.groupBy(*group).agg(F.percentile_approx(value, steps, ACCURACY).alias("_sketch"), F.count(F.lit(1)).alias("_n"))
    stride = F.greatest(F.ceil(F.lit(float(buckets) * rows) / F.col("_n")), F.lit(1))
    bounds = cut_lineage(
        sketched.select(*group, F.array_distinct(F.filter("_sketch", lambda _, i: (i + 1) % stride == 0)).alias("_bounds"))
        .withColumn("_coarse", F.filter("_bounds", lambda _, i: i % COARSE == 0))
    )

    tagged = df.join(bounds, group, "left")
    v = F.col(value)
    block = F.size(F.filter("_coarse", lambda b: b <= v))
    tagged = tagged.withColumn("_block", block)
    start = (F.col("_block") - 1) * COARSE
    fine = start + F.size(F.filter(F.slice("_bounds", start + 1, COARSE), lambda b: b <= v))
    bucket = F.when(F.col("_block") > 0, fine).otherwise(0)
    return tagged.withColumn(BUCKET, F.coalesce(bucket, F.lit(0)).cast("int")).drop("_bounds", "_coarse", "_block")


def hash_bucket(hashed: Column, bits: int = 16) -> Column:
    """The top bits of a 64-bit hash: even buckets in the order of the hash itself."""
    return F.shiftright(hashed, 64 - bits)

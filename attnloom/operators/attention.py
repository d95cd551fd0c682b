"""Attention maps as weighted graphs.

Two storage forms are supported.

*Matrix form*, one row per head of one example with `w ARRAY<ARRAY<DOUBLE>>`
(rows may stop at the diagonal). Everything except the cross-layer Laplacian
is then row-local: no shuffle at all.

*Edge form*, one row per weight `(…, q, k, n, w)`, or *step form*, one row per
query row. These suit sequences whose n x n map is too large for one row; the
sums over queries become partial aggregates before a single shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..schema import EXAMPLE, HEAD
from .joins import enforced

ROW_SUM_TOLERANCE = 1e-2  # fixed value: allowed gap between a row sum and 1


# ---------------------------------------------------------------- stacking and padding


def stack_steps(steps: DataFrame, head: Sequence[str] = HEAD, example: Sequence[str] = EXAMPLE) -> DataFrame:
    """Stack decoding steps into one square map per head, keys padded with zeros on the right.

    The steps of a head are disjoint and complete, so the position of a query
    row is simply its place in (gen_step, q_in_step) order. The shuffle is by
    example, which also serves a following join with the tokens of the example.
    """
    ordered = F.array_sort(F.collect_list(F.struct("gen_step", "q_in_step", "weights")))
    stacked = steps.repartition(*example).groupBy(*head).agg(ordered.alias("_rows"))
    n = F.size("_rows")
    w = F.transform(
        "_rows",
        lambda r: F.concat(
            r["weights"].cast("array<double>"), F.array_repeat(F.lit(0.0), n - F.size(r["weights"]))
        ),
    )
    return stacked.select(*head, n.alias("n"), w.alias("w"))


def token_range(tokens: DataFrame, pad: int, example: Sequence[str] = EXAMPLE) -> DataFrame:
    """First and last position to keep; the last token id never had an attention row."""
    ids = F.slice("token_ids", 1, F.size("token_ids") - 1)
    cut = tokens.select(*example, ids.alias("_ids"))
    return cut.select(*example, A.first_kept("_ids", pad).alias("first"), A.last_kept("_ids", pad).alias("last"))


def strip_padding(
    matrices: DataFrame, tokens: DataFrame, pad: int, check: bool = True, example: Sequence[str] = EXAMPLE
) -> DataFrame:
    """Drop edge padding from rows and columns; with `check`, rows that do not sum to 1 raise.

    Maps that carry `first` and `last` already (see `token_range`) are cut
    without a join, which spares the shuffle of a large table of maps.
    """
    joined = matrices
    if not {"first", "last"} <= set(matrices.columns):
        joined = matrices.join(token_range(tokens, pad, example), list(example))
    first, last = F.col("first"), F.col("last")
    w = F.transform(A.cut(F.col("w"), first, last), lambda row: A.cut(row, first, last))
    stripped = joined.withColumn("w", w).withColumn("n", last - first + 1).drop("first", "last")
    return checked_rows(stripped) if check else stripped


def row_sum_error(w: Column) -> Column:
    """Largest distance of a row sum from 1."""
    return F.array_max(F.transform(w, lambda row: F.abs(A.total(row) - 1)))


def checked_rows(matrices: DataFrame, tolerance: float = ROW_SUM_TOLERANCE) -> DataFrame:
    """`matrices`, raising for rows that do not sum to 1, also where nothing reads them."""
    return enforced(matrices, row_sum_error(F.col("w")) > tolerance, f"attention rows do not sum to 1 within {tolerance}")


def strip_padding_edges(
    edges: DataFrame, tokens: DataFrame, pad: int, example: Sequence[str] = EXAMPLE
) -> DataFrame:
    """Edge form of `strip_padding`: a filter and a shift of both indices."""
    kept = edges.join(token_range(tokens, pad, example), list(example)).filter(
        F.col("q").between(F.col("first"), F.col("last")) & F.col("k").between(F.col("first"), F.col("last"))
    )
    return (
        kept.withColumn("q", F.col("q") - F.col("first"))
        .withColumn("k", F.col("k") - F.col("first"))
        .withColumn("n", F.col("last") - F.col("first") + 1)
        .drop("first", "last")
    )


def to_edges(matrices: DataFrame, head: Sequence[str] = HEAD) -> DataFrame:
    """Matrix form to edge form; zero weights stay, the caller filters if only edges matter."""
    rows = matrices.select(*head, F.size("w").alias("n"), F.posexplode("w").alias("q", "_row"))
    return rows.select(*head, "q", "n", F.posexplode("_row").alias("k", "w"))


# ---------------------------------------------------------------- diagonals


def diagonals(matrices: DataFrame, vertical_weight: float | None = None, head: Sequence[str] = HEAD) -> DataFrame:
    """Attention diagonal and Laplacian diagonal of every head, fused, without a shuffle.

    Laplacian diagonal of token k: mean attention it receives from itself and
    later tokens, minus its self-loop. With `vertical_weight` every layer but
    the first gets one more incoming edge of that weight.
    """
    both = matrices.select(*head, A.diagonal(F.col("w")).alias("attn_diag"), A.column_sums(F.col("w")).alias("_sum"))
    n = F.size("attn_diag")
    extra = F.lit(0) if vertical_weight is None else F.when(F.col("layer") > 0, 1).otherwise(0)
    weight = 0.0 if vertical_weight is None else float(vertical_weight)
    lap = F.transform(
        F.arrays_zip("_sum", "attn_diag"),
        lambda t, k: (t["_sum"] + extra * F.lit(weight)) / (n - k + extra) - t["attn_diag"],
    )
    return both.select(*head, "attn_diag", lap.alias("lap_diag"))


def diagonals_from_edges(
    edges: DataFrame, vertical_weight: float | None = None, head: Sequence[str] = HEAD
) -> DataFrame:
    """Edge form of `diagonals`: one row per (head, k), one shuffle after partial sums."""
    per_token = edges.groupBy(*head, "k").agg(
        F.sum("w").alias("_sum"),
        F.sum(F.when(F.col("q") == F.col("k"), F.col("w"))).alias("attn"),
        F.max("n").alias("n"),
    )
    extra = F.lit(0) if vertical_weight is None else F.when(F.col("layer") > 0, 1).otherwise(0)
    weight = 0.0 if vertical_weight is None else float(vertical_weight)
    lap = (F.col("_sum") + extra * F.lit(weight)) / (F.col("n") - F.col("k") + extra) - F.col("attn")
    return per_token.select(*head, "k", "n", "attn", lap.alias("lap"))


def steps_to_edges(steps: DataFrame, head: Sequence[str] = HEAD, example: Sequence[str] = EXAMPLE) -> DataFrame:
    """Query rows to edges without building a matrix.

    The offset of a step is the height of all earlier steps of the example, a
    small table; the wide rows themselves are not sorted or grouped.
    """
    heights = steps.groupBy(*example, "gen_step").agg((F.max("q_in_step") + 1).alias("_height"))
    earlier = Window.partitionBy(*example).orderBy("gen_step").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(*example)
    offsets = heights.select(
        *example,
        "gen_step",
        F.coalesce(F.sum("_height").over(earlier), F.lit(0)).cast("int").alias("_offset"),
        F.sum("_height").over(every).cast("int").alias("n"),
    )
    joined = steps.join(offsets, [*example, "gen_step"])
    return joined.select(
        *head,
        (F.col("_offset") + F.col("q_in_step")).alias("q"),
        "n",
        F.posexplode("weights").alias("k", "w"),
    ).withColumn("w", F.col("w").cast("double"))


def pack_diagonals(per_token: DataFrame, head: Sequence[str] = HEAD) -> DataFrame:
    """Per-token rows to one array per head."""
    packed = per_token.groupBy(*head).agg(F.array_sort(F.collect_list(F.struct("k", "attn", "lap"))).alias("_t"))
    return packed.select(
        *head,
        F.transform("_t", lambda t: t["attn"]).alias("attn_diag"),
        F.transform("_t", lambda t: t["lap"]).alias("lap_diag"),
    )


# ---------------------------------------------------------------- Laplacians across layers


def refined_diagonal(matrices: DataFrame, head: Sequence[str] = HEAD) -> DataFrame:
    """Laplacian diagonal where the self-loop of the next layer is an upward edge of this one."""
    by_layer = Window.partitionBy(*[c for c in head if c != "layer"]).orderBy("layer")
    parts = matrices.select(*head, A.diagonal(F.col("w")).alias("_d"), A.column_sums(F.col("w")).alias("_s"))
    linked = parts.select(
        "*",
        F.lead("_d").over(by_layer).alias("_up"),
        F.lag("layer").over(by_layer).isNull().alias("_first"),
    )
    n = F.size("_d")
    # arrays_zip of a missing array is NULL, so the last layer zips with its own diagonal instead
    linked = linked.withColumn("_last", F.col("_up").isNull()).withColumn("_up", F.coalesce("_up", "_d"))
    is_last = F.col("_last")
    lap = F.transform(
        F.arrays_zip("_s", "_d", "_up"),
        lambda t, k: F.when(F.col("_first"), (t["_s"] + t["_up"]) / (n - k + 1) - t["_d"])
        .when(is_last & (k == n - 1), F.lit(0.0))
        .when(is_last, (t["_s"] - t["_d"]) / (n - k - 1))
        .otherwise((t["_s"] - t["_d"] + t["_up"]) / (n - k)),
    )
    lap = F.when(
        F.col("_first") & is_last, F.raise_error(F.lit("the refined Laplacian needs at least two layers"))
    ).otherwise(lap)
    return linked.select(*head, lap.alias("lap_diag_refined"))


def full_laplacian(edges: DataFrame, head: Sequence[str] = HEAD) -> DataFrame:
    """Sparse entries `(example, head, r, c, value)` of degree minus adjacency over all layers.

    Node `layer * n + token`. From the second layer on a self-loop becomes the
    edge to the same token one layer below. The degree of a node is the mean
    weight of its non-zero incoming column. Only diagonal entries need a
    shuffle; off-diagonal entries are single edges with the sign turned. An
    example with a single layer raises.
    """
    graph = [c for c in head if c != "layer"]
    loop = F.col("q") == F.col("k")
    row = F.col("layer") * F.col("n") + F.col("q")
    column = F.when(loop & (F.col("layer") > 0), (F.col("layer") - 1) * F.col("n") + F.col("k")).otherwise(
        F.col("layer") * F.col("n") + F.col("k")
    )
    adjacency = edges.filter(F.col("w") != 0).select(*graph, row.alias("r"), column.alias("c"), "w", "layer")
    off_diagonal = adjacency.filter(F.col("r") != F.col("c")).select(*graph, "r", "c", (-F.col("w")).alias("value"))
    diagonal = adjacency.groupBy(*graph, "c").agg(
        (F.avg("w") - F.coalesce(F.sum(F.when(F.col("r") == F.col("c"), F.col("w"))), F.lit(0.0))).alias("value"),
        F.min("layer").alias("_low"), F.max("layer").alias("_high"),
    )
    entries = off_diagonal.unionByName(diagonal.select(*graph, F.col("c").alias("r"), "c", "value"))
    # adds no rows: the generated id only keeps the optimizer from dropping the check, which reads the sums once more and no edges
    layers = diagonal.groupBy(*graph).agg(F.min("_low").alias("_low"), F.max("_high").alias("_high"))
    single = F.raise_error(F.lit("the full Laplacian needs at least two layers"))
    guard = layers.filter(F.when(F.col("_low") == F.col("_high"), single).otherwise(F.monotonically_increasing_id() < 0))
    return entries.unionByName(guard.select(*graph), allowMissingColumns=True)


def require_layers(df: DataFrame, minimum: int = 2, head: Sequence[str] = HEAD) -> DataFrame:
    """Raise if any example of the table has fewer layers than `minimum`."""
    graph = [c for c in head if c != "layer"]
    counts = df.groupBy(*graph).agg(F.count_distinct("layer").alias("_layers"))
    guard = F.when(F.col("_layers") < minimum, F.raise_error(F.lit(f"fewer than {minimum} layers"))).otherwise(True)
    return df.join(counts.filter(guard).drop("_layers"), graph)

"""Spectral features of the diagonals and their flattening into vectors.

All maps are triangular, so a diagonal holds the eigenvalues of its matrix.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..schema import EXAMPLE, HEAD, LAYER, RUN

TOP_K = (5, 10, 25, 50, 100)  # fixed values: candidate numbers of eigenvalues


def log_det(diags: DataFrame, diag: str = "attn_diag", head: Sequence[str] = HEAD) -> DataFrame:
    """Mean log of the diagonal per head."""
    return diags.select(*head, A.mean_log(F.col(diag)).alias("log_det"))


def top_k(diags: DataFrame, k: int, diag: str, head: Sequence[str] = HEAD) -> DataFrame:
    """The k largest values of each head, descending."""
    return diags.select(*head, A.top_k(F.col(diag), k).alias("vals"))


def top_k_stats(diags: DataFrame, k: int, diag: str = "lap_diag", head: Sequence[str] = HEAD) -> DataFrame:
    """Mean, deviation and quantiles of the k largest values, over all layers."""
    return top_k(diags, k, diag, head).select(*head, A.describe(F.col("vals")).alias("stats"))


def eligible_top_k(
    diags: DataFrame, candidates: Sequence[int] = TOP_K, diag: str = "attn_diag", run: Sequence[str] = RUN
) -> DataFrame:
    """Candidates no larger than the shortest sequence of the run."""
    shortest = diags.groupBy(*run).agg(F.min(F.size(diag)).alias("min_len"))
    return shortest.select(*run, "min_len", F.explode(F.lit(list(candidates))).alias("top_k")).filter(
        F.col("top_k") <= F.col("min_len")
    )


def attention_score(diags: DataFrame, diag: str = "attn_diag", layer: Sequence[str] = LAYER) -> DataFrame:
    """Minus the log-determinants summed over heads, per layer.

    Heads are summed in order, so the score does not depend on how Spark merges
    partial sums and equal inputs give equal scores.
    """
    return _summed_heads(log_det(diags, diag, [*layer, "head"]), layer)


def _summed_heads(log_dets: DataFrame, layer: Sequence[str]) -> DataFrame:
    heads = log_dets.groupBy(*layer).agg(
        F.array_sort(F.collect_list(F.struct("head", "log_det"))).alias("_heads")
    )
    summed = F.aggregate("_heads", F.lit(0.0), lambda acc, h: acc + h["log_det"])
    return heads.select(*layer, (-summed).alias("attn_score"))


def attention_score_with_all(diags: DataFrame, diag: str = "attn_diag", example: Sequence[str] = EXAMPLE) -> DataFrame:
    """Per-layer scores plus their mean under `layer = 'all'`; one shuffle by example."""
    layer = [*example, "layer"]
    # reduce to one number per head before the shuffle that serves both levels
    log_dets = log_det(diags, diag, [*layer, "head"]).repartition(*example)
    per_layer = _summed_heads(log_dets, layer)
    packed = per_layer.groupBy(*example).agg(
        F.array_sort(F.collect_list(F.struct("layer", "attn_score"))).alias("_layers")
    )
    mean = F.aggregate("_layers", F.lit(0.0), lambda acc, s: acc + s["attn_score"]) / F.size("_layers")
    rows = F.concat(
        F.transform(
            "_layers",
            lambda s: F.struct(s["layer"].cast("string").alias("layer"), s["attn_score"].alias("attn_score")),
        ),
        F.array(F.struct(F.lit("all").alias("layer"), mean.alias("attn_score"))),
    )
    return packed.select(*example, F.inline(rows))


def flatten_features(
    per_head: DataFrame, values: str, layer: int | None = None, example: Sequence[str] = EXAMPLE
) -> DataFrame:
    """One vector per example, layer-major then head; `layer` picks a single layer."""
    if layer is not None:
        per_head = per_head.filter(F.col("layer") == layer)
    as_array = F.col(values) if dict(per_head.dtypes)[values].startswith("array") else F.array(values)
    ordered = F.array_sort(F.collect_list(F.struct("layer", "head", as_array.alias("v"))))
    flat = per_head.groupBy(*example).agg(ordered.alias("_heads"))
    return flat.select(*example, F.flatten(F.transform("_heads", lambda h: h["v"])).alias("features"))


def flatten_per_layer(per_head: DataFrame, values: str, example: Sequence[str] = EXAMPLE) -> DataFrame:
    """`flatten_features` for every layer at once: one vector per (example, layer)."""
    as_array = F.col(values) if dict(per_head.dtypes)[values].startswith("array") else F.array(values)
    ordered = F.array_sort(F.collect_list(F.struct("head", as_array.alias("v"))))
    flat = per_head.groupBy(*example, "layer").agg(ordered.alias("_heads"))
    return flat.select(*example, "layer", F.flatten(F.transform("_heads", lambda h: h["v"])).alias("features"))

"""Feature tables of whole sweeps: every (probe, layer, top_k) of every run in one table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..operators import attention, hidden, joins
from ..schema import EXAMPLE, HEAD
from ..sources.catalog import Catalog

PROBE = ["run_id", "probe", "layer", "top_k"]


def extract_diagonals(catalog: Catalog, steps: DataFrame, tokens: DataFrame, pad: int) -> DataFrame:
    """Both diagonals of all heads, stored once and reused afterwards."""
    def build() -> DataFrame:
        stripped = attention.strip_padding(attention.stack_steps(steps), tokens, pad)
        return attention.diagonals(stripped)

    return catalog.read_or_build("diagonals", build)


def load_inputs(catalog: Catalog, runs: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Diagonals and labelled split of several runs, by partition pruning."""
    labels, split = catalog.read("labels", runs), catalog.read("split", runs)
    labelled = split.select(*EXAMPLE, "part").join(labels.select(*EXAMPLE, "label"), EXAMPLE)
    return catalog.read("diagonals", runs), labelled


def spectral_features(
    diags: DataFrame, top_ks: Sequence[int], per_layer: bool = True, all_layers: bool = True,
    families: Sequence[str] = ("attn_log_det", "attn_eigval_topk", "laplacian_eigval_topk"),
    longest: str | None = None,
) -> DataFrame:
    """`(run_id, row_idx, probe, layer, top_k, features)` for all spectral probes, from one scan.

    top_k is 0 for log-determinants, which have none. With `longest`, a column
    of `diags`, a row has no features of a larger k. A head is sorted once and
    reduced to the values of every family before the only shuffle, which is by
    example; the vectors per layer and over all layers are both built from it.
    """
    def variant(family: str, k: int, values: Column) -> Column:
        return F.struct(F.lit(family).alias("family"), F.lit(k).alias("top_k"), values.alias("vals"))

    def fits(k: int) -> Column:
        return F.lit(True) if longest is None else F.lit(k) <= F.col("_most")

    variants = []
    if "attn_log_det" in families:
        variants.append(variant("attn_log_det", 0, F.array(A.mean_log(F.col("attn_diag")))))
    for family, column in (("attn_eigval_topk", "_attn"), ("laplacian_eigval_topk", "_lap")):
        if family in families:
            variants += [variant(family, k, F.when(fits(k), A.first_k(F.col(column), k))) for k in top_ks]
    most = F.lit(None).cast("int") if longest is None else F.col(longest)
    heads = diags.select(
        *HEAD, "attn_diag", most.alias("_most"),
        F.sort_array("attn_diag", asc=False).alias("_attn"), F.sort_array("lap_diag", asc=False).alias("_lap"),
    ).select(*HEAD, F.inline(F.filter(F.array(*variants), lambda v: v["vals"].isNotNull())))
    group = [*EXAMPLE, "family", "top_k"]
    layers = heads.repartition(*EXAMPLE).groupBy(*group, "layer").agg(
        F.array_sort(F.collect_list(F.struct("head", "vals"))).alias("_heads")
    ).select(*group, "layer", F.flatten(F.transform("_heads", lambda h: h["vals"])).alias("features"))

    def named(df: DataFrame, suffix: str, layer) -> DataFrame:
        return df.select(
            *EXAMPLE, F.concat("family", F.lit(suffix)).alias("probe"), layer.cast("string").alias("layer"), "top_k", "features"
        )

    tables = []
    if per_layer:
        tables.append(named(layers, "_per_layer", F.col("layer")))
    if all_layers:
        joined = layers.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct("layer", "features"))).alias("_layers"))
        flat = joined.select(*group, F.flatten(F.transform("_layers", lambda part: part["features"])).alias("features"))
        tables.append(named(flat, "_all_layers", F.lit("all")))
    return joins.concat_rows(*tables)


def hidden_features(selected: DataFrame, per_layer: bool = True, all_layers: bool = True) -> DataFrame:
    """`(run_id, row_idx, probe, layer, top_k, features)` for both reference tokens."""
    token = F.concat(F.lit("hidden_state_last_"), F.col("which"), F.lit("_token"))
    tables = []
    if per_layer:
        tables.append(
            selected.select(
                *EXAMPLE, F.concat(token, F.lit("_per_layer")).alias("probe"), F.col("layer").cast("string").alias("layer"),
                F.lit(0).alias("top_k"), F.col("vec").cast("array<double>").alias("features"),
            )
        )
    if all_layers:
        tables.append(
            hidden.token_features(selected).select(
                *EXAMPLE, F.concat(token, F.lit("_all_layers")).alias("probe"), F.lit("all").alias("layer"),
                F.lit(0).alias("top_k"), "features",
            )
        )
    return joins.concat_rows(*tables)


def labelled(features: DataFrame, split: DataFrame, row: Sequence[str] = EXAMPLE) -> DataFrame:
    """Attach label and part; `split` is `(row, label, part, …)` and may repeat examples."""
    return features.join(split, list(row))

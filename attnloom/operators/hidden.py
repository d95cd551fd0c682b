"""Hidden states: regrouping by layer, layer choice, and the two reference tokens."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..schema import EXAMPLE


def token_masks(
    tokens: DataFrame, special_ids: Sequence[int], added_ids: Sequence[int]
) -> DataFrame:
    """Mark special tokens and tokens that were added to the vocabulary."""
    return tokens.withColumn("special_mask", A.members(F.col("token_ids"), special_ids)).withColumn(
        "added_mask", A.members(F.col("token_ids"), added_ids)
    )


def states_by_layer(steps: DataFrame, concat: bool = True, example: Sequence[str] = EXAMPLE) -> DataFrame:
    """Per-step states to per-layer sequences; `concat=False` keeps the step and its own index.

    One layer of one example is a single sequence, so the window is bounded by
    the context length.
    """
    if not concat:
        return steps
    order = Window.partitionBy(*example, "layer").orderBy("gen_step", "idx_in_step")
    return steps.withColumn("tok_idx", F.row_number().over(order) - 1).drop("gen_step", "idx_in_step")


def select_layer(states: DataFrame, layer: str | int, run: Sequence[str] = ("run_id",)) -> DataFrame:
    """`'all'`, `'last'` (highest layer of the run) or one layer index."""
    if layer == "all":
        return states
    if layer == "last":
        top = states.groupBy(*run).agg(F.max("layer").alias("layer"))
        return states.join(top, [*run, "layer"])
    return states.filter(F.col("layer") == int(layer))


def last_token_positions(tokens: DataFrame, example: Sequence[str] = EXAMPLE) -> DataFrame:
    """State index of the last ordinary token of the input and of the generated part.

    A part without any ordinary token falls back to its last position.
    """
    ordinary = F.zip_with("special_mask", "added_mask", lambda s, a: ~(s | a))
    shifted = tokens.select(*example, (F.col("input_length") - 1).alias("_in"), F.slice(ordinary, 2, F.size(ordinary)).alias("_ok"))
    generated = F.slice("_ok", F.col("_in") + 1, F.size("_ok") - F.col("_in"))
    return shifted.select(
        *example,
        A.last_true(F.slice("_ok", 1, F.col("_in"))).alias("last_input_token_idx"),
        (F.col("_in") + A.last_true(generated)).alias("last_generated_token_idx"),
    )


def select_last_tokens(
    states: DataFrame, tokens: DataFrame, layer: str | int = "all", example: Sequence[str] = EXAMPLE
) -> DataFrame:
    """States of both reference tokens for the chosen layers: `which` is `input` or `generated`.

    The two positions per example are the small side; the join keeps two rows
    per layer out of the whole sequence.
    """
    where = last_token_positions(tokens, example).select(
        *example,
        F.inline(
            F.array(
                F.struct(F.lit("input").alias("which"), F.col("last_input_token_idx").alias("tok_idx")),
                F.struct(F.lit("generated").alias("which"), F.col("last_generated_token_idx").alias("tok_idx")),
            )
        ),
    )
    chosen = select_layer(states, layer, [c for c in example if c != "row_idx"])
    return chosen.join(where, [*example, "tok_idx"])


def token_features(selected: DataFrame, example: Sequence[str] = EXAMPLE) -> DataFrame:
    """All layers of a reference token as one vector, layer-major."""
    ordered = F.array_sort(F.collect_list(F.struct("layer", F.col("vec").cast("array<double>").alias("v"))))
    flat = selected.groupBy(*example, "which").agg(ordered.alias("_layers"))
    return flat.select(*example, "which", F.flatten(F.transform("_layers", lambda h: h["v"])).alias("features"))

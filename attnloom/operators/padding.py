"""Padding of token sequences and of hidden states."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..schema import EXAMPLE


def pad_token(pad_id: int | None, eos_id: int) -> int:
    """Padding id of a tokenizer, or its end-of-sequence id if it has none."""
    return eos_id if pad_id is None else pad_id


def pad_token_for_states(pad_id: int | None, eos_id: int) -> int:
    """As `pad_token`, but an id of 0 also counts as missing; hidden states follow this rule."""
    return pad_id or eos_id


def strip_edge_padding(tokens: DataFrame, pad: int, example: Sequence[str] = EXAMPLE) -> DataFrame:
    """Remove padding at both ends only; a row of nothing but padding stays whole."""
    bounds = tokens.select(
        *example, "token_ids", A.first_kept("token_ids", pad).alias("first"), A.last_kept("token_ids", pad).alias("last")
    )
    return bounds.select(
        *example, "first", "last", A.cut(F.col("token_ids"), F.col("first"), F.col("last")).alias("token_ids")
    )


def strip_all_padding(tokens: DataFrame, pad: int, example: Sequence[str] = EXAMPLE) -> DataFrame:
    """Positions that keep a hidden state once every pad, also an interior one, is gone.

    Hidden state i belongs to token i+1, so the ids are shifted by one first.
    Gives the kept state positions, their ids and the index of the last input
    token after removal.
    """
    shifted = tokens.select(*example, "input_length", F.slice("token_ids", 2, F.size("token_ids") - 1).alias("_ids"))
    marked = F.transform("_ids", lambda t, i: F.struct(i.alias("tok_idx"), t.alias("token_id")))
    kept = F.filter(marked, lambda s: s["token_id"] != pad)
    pads_in_input = F.size(F.filter(F.slice("_ids", 1, F.col("input_length")), lambda t: t == pad))
    return shifted.select(
        *example,
        kept.alias("kept"),
        (F.col("input_length") - pads_in_input - 1).alias("last_input_idx"),
    )


def strip_hidden_state_edges(
    states: DataFrame, ranges: DataFrame, example: Sequence[str] = EXAMPLE
) -> DataFrame:
    """Hidden states within `first..last` of their example (see `attention.token_range`), renumbered from 0.

    Padding inside the range stays.
    """
    kept = states.join(ranges, list(example)).filter(F.col("tok_idx").between(F.col("first"), F.col("last")))
    return kept.withColumn("tok_idx", F.col("tok_idx") - F.col("first")).drop("first", "last")


def strip_hidden_states(
    states: DataFrame, tokens: DataFrame, pad: int, example: Sequence[str] = EXAMPLE
) -> DataFrame:
    """Hidden states without padding, positions renumbered from 0; the row number needs no window."""
    kept = strip_all_padding(tokens, pad, example)
    where = kept.select(*example, "last_input_idx", F.posexplode("kept").alias("new_idx", "_kept")).select(
        *example, "last_input_idx", "new_idx", F.col("_kept.tok_idx").alias("tok_idx"), F.col("_kept.token_id").alias("token_id")
    )
    joined = states.join(where, [*example, "tok_idx"])
    return joined.drop("tok_idx").withColumnRenamed("new_idx", "tok_idx")

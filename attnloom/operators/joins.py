"""Alignment of tables by key: strict and loose zips, merges, concatenations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import EXAMPLE


def enforced(df: DataFrame, wrong: Column, message: str) -> DataFrame:
    """`df`, raising if `wrong` holds in any row.

    The check is a filter that also reads a generated id. The optimizer neither
    drops it with unread columns nor merges or moves it past other filters, so
    it runs under `count()` and before later filters can turn the join one-sided.
    """
    return df.filter(F.when(wrong, F.raise_error(F.lit(message))).otherwise(F.monotonically_increasing_id() >= 0))


def zip_strict(left: DataFrame, right: DataFrame, on: Sequence[str] = EXAMPLE) -> DataFrame:
    """Join two tables that must hold exactly the same keys; any key missing on a side raises.

    One full join carries both the result and the check.
    """
    on = list(on)
    both = left.withColumn("_l", F.lit(True)).join(right.withColumn("_r", F.lit(True)), on, "full")
    unmatched = F.col("_l").isNull() | F.col("_r").isNull()
    return enforced(both, unmatched, "tables differ in their keys").drop("_l", "_r")


def zip_shortest(left: DataFrame, right: DataFrame, on: Sequence[str] = EXAMPLE) -> DataFrame:
    """Keys present on both sides only."""
    return left.join(right, list(on))


def merge(left: DataFrame, right: DataFrame, on: Sequence[str] = EXAMPLE) -> DataFrame:
    """Columns of both sides; where a name clashes the right side wins."""
    on = list(on)
    clash = [c for c in left.columns if c in right.columns and c not in on]
    return left.drop(*clash).join(right, on)


def concat_columns(first: DataFrame, *others: DataFrame, on: Sequence[str] = EXAMPLE) -> DataFrame:
    """All rows of all tables side by side; a key missing somewhere leaves NULLs."""
    result = first
    for other in others:
        result = result.join(other, list(on), "full")
    return result


def answers_with_gold(answers: DataFrame, gold: DataFrame, on: Sequence[str] = EXAMPLE) -> DataFrame:
    """Right join answers (`gold`) to the reference table (`answer`); differing gold text raises."""
    joined = answers.join(gold, list(on), "right")
    wrong = ~F.col("gold").eqNullSafe(F.col("answer"))
    return enforced(joined, wrong, "gold answers and model answers are in different order").drop("answer")


def gather(features: DataFrame, labels: DataFrame, split: DataFrame, on: Sequence[str] = EXAMPLE) -> DataFrame:
    """Features of the examples in the split, with label and part."""
    on = list(on)
    return features.join(split.select(*on, "part").join(labels.select(*on, "label"), on), on)


def concat_rows(*tables: DataFrame) -> DataFrame:
    """Stack tables by column name; columns missing in one become NULL."""
    result = tables[0]
    for table in tables[1:]:
        result = result.unionByName(table, allowMissingColumns=True)
    return result

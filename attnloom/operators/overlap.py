"""Text overlap between predictions and one or more gold answers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..schema import EXAMPLE, RUN


def _f1(overlap: Column, predicted: Column, gold: Column) -> Column:
    return F.coalesce(F.try_divide(2.0 * overlap, predicted + gold), F.lit(0.0))


def squad_metrics(answers: DataFrame, example: Sequence[str] = EXAMPLE) -> DataFrame:
    """Best token F1 and exact match over the gold answers, on normalised text.

    Two empty texts match fully. Bags are compared inside the row: no shuffle.
    """
    base = answers.select(
        *example,
        X.normalize_answer(F.col("prediction")).alias("_p"),
        F.transform("gold", X.normalize_answer).alias("_g"),
    )
    tokens = base.select(
        "*",
        F.exists("_g", lambda g: g == F.col("_p")).alias("_exact"),
        X.words(F.col("_p")).alias("_pt"),
        F.transform("_g", X.words).alias("_gt"),
    )
    counted = tokens.withColumn("_same", X.bag_overlaps("_p", "_g"))

    def score(same: Column, g: Column) -> Column:
        both_empty = (F.size("_pt") == 0) & (F.size(g) == 0)
        return F.when(both_empty, 1.0).otherwise(_f1(same, F.size("_pt"), F.size(g)))

    return counted.select(
        *example,
        F.array_max(F.zip_with("_same", "_gt", score)).alias("squad_f1"),
        F.col("_exact").cast("double").alias("squad_exact"),
    )


def _best(scores: Column, name: str) -> list[Column]:
    best = F.array_max(scores)
    return [best["f"].alias(f"{name}_fmeasure"), best["p"].alias(f"{name}_precision"), best["r"].alias(f"{name}_recall")]


def _scores(overlap: Column, predicted: Column, gold: Column) -> Column:
    return F.struct(
        _f1(overlap, predicted, gold).alias("f"),
        F.coalesce(F.try_divide(overlap, predicted), F.lit(0.0)).alias("p"),
        F.coalesce(F.try_divide(overlap, gold), F.lit(0.0)).alias("r"),
    )


def rouge_n(answers: DataFrame, n: int, example: Sequence[str] = EXAMPLE) -> DataFrame:
    """n-gram overlap, best gold answer by F-measure."""
    counted = _rouge_texts(answers, example).withColumn("_same", X.bag_overlaps("_p", "_g", n))
    return _rouge_scores(counted, n, f"rouge{n}", example)


def rouge_l(answers: DataFrame, example: Sequence[str] = EXAMPLE) -> DataFrame:
    """Longest common subsequence, best gold answer by F-measure."""
    matched = _rouge_texts(answers, example).withColumn("_same", X.lcs_lengths("_p", "_g"))
    return _rouge_scores(matched, 1, "rougeL", example)


def _rouge_texts(answers: DataFrame, example: Sequence[str]) -> DataFrame:
    return answers.select(
        *example, X.rouge_text(F.col("prediction")).alias("_p"), F.transform("gold", X.rouge_text).alias("_g")
    )


def _rouge_scores(same: DataFrame, n: int, name: str, example: Sequence[str]) -> DataFrame:
    count = F.transform("_g", lambda g: X.ngram_count(g, n))
    sized = same.select(*example, "_same", X.ngram_count(F.col("_p"), n).alias("_p"), count.alias("_g"))
    scores = F.zip_with("_same", "_g", lambda same, g: _scores(same, F.col("_p"), g))
    return sized.select(*example, scores.alias("_s")).select(*example, *_best(F.col("_s"), name))


def qa_metrics(answers: DataFrame, example: Sequence[str] = EXAMPLE) -> DataFrame:
    """All per-example overlap metrics side by side."""
    from .joins import merge

    result = squad_metrics(answers, example)
    for other in (rouge_n(answers, 1, example), rouge_n(answers, 2, example), rouge_l(answers, example)):
        result = merge(result, other, example)
    return result


def reduced(metrics: DataFrame, run: Sequence[str] = RUN, example: Sequence[str] = EXAMPLE) -> DataFrame:
    """Mean of every metric per run."""
    names = [c for c in metrics.columns if c not in example]
    return metrics.groupBy(*run).agg(*[F.avg(c).alias(c) for c in names])

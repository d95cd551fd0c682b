"""ROC-AUC, average precision and thresholded metrics for many groups in one job."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .ordering import BUCKET, running_totals, value_buckets


def score_counts(df: DataFrame, group: Sequence[str], label: str, score: str) -> DataFrame:
    """Positives and negatives per distinct score: ties and hot scores shrink before the shuffle."""
    return df.groupBy(*group, F.col(score).alias("score")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg")
    )


def ranking_metrics(
    df: DataFrame, group: Sequence[str], label: str, score: str, single_class: str = "raise"
) -> DataFrame:
    """Tie-aware ROC-AUC and stepwise average precision per group.

    A group with one class has no AUC: `single_class='raise'` stops, `'null'`
    gives NULL. Running counts are exact and spread over buckets of the score,
    so one dominant group does not end up in one task. The input is read once,
    for the counts per distinct score; the rest works on these.
    """
    group = list(group)
    counts = cut_lineage(score_counts(df, group, label, score))
    placed = running_totals(
        value_buckets(counts, group, "score"), group, [BUCKET], [F.col("score")], ["pos", "neg"]
    )
    joined = placed.withColumnRenamed("all_pos", "n_pos").withColumnRenamed("all_neg", "n_neg")
    hits = F.col("n_pos") - F.col("below_pos")
    false_hits = F.col("n_neg") - F.col("below_neg")
    pairs = F.col("pos") * (F.col("below_neg") + F.col("neg") / 2)
    gains = F.col("pos") * F.try_divide(hits, hits + false_hits)
    scored = joined.groupBy(*group, "n_pos", "n_neg").agg(F.sum(pairs).alias("_pairs"), F.sum(gains).alias("_gains"))
    one_class = (F.col("n_pos") == 0) | (F.col("n_neg") == 0)
    missing = (
        F.raise_error(F.lit("ROC-AUC needs both classes")).cast("double")
        if single_class == "raise"
        else F.lit(None).cast("double")
    )
    return scored.select(
        *group,
        "n_pos",
        "n_neg",
        F.when(one_class, missing)
        .otherwise(F.try_divide(F.col("_pairs"), F.col("n_pos") * F.col("n_neg")))
        .alias("auc"),
        F.coalesce(F.try_divide(F.col("_gains"), F.col("n_pos")), F.lit(0.0)).alias("average_precision"),
    )


def threshold_metrics(df: DataFrame, group: Sequence[str], label: str, prediction: str) -> DataFrame:
    """Precision, recall and F1 of class 1; an empty denominator gives 0."""
    hit = (F.col(label) == 1) & (F.col(prediction) == 1)
    counts = df.groupBy(*group).agg(
        F.count_if(hit).alias("tp"),
        F.count_if((F.col(label) != 1) & (F.col(prediction) == 1)).alias("fp"),
        F.count_if((F.col(label) == 1) & (F.col(prediction) != 1)).alias("fn"),
    )

    def ratio(a, b):
        return F.coalesce(F.try_divide(a, b), F.lit(0.0))

    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.select(
        *group,
        "tp",
        "fp",
        "fn",
        ratio(tp, tp + fp).alias("precision"),
        ratio(tp, tp + fn).alias("recall"),
        ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
    )


def probe_metrics(
    predictions: DataFrame,
    group: Sequence[str],
    label: str = "label",
    score: str = "p1",
    prediction: str = "pred",
    single_class: str = "raise",
) -> DataFrame:
    """All five metrics of scored predictions, one row per group."""
    ranked = ranking_metrics(predictions, group, label, score, single_class)
    return ranked.join(threshold_metrics(predictions, group, label, prediction).drop("tp", "fp", "fn"), list(group))


def score_only_metrics(df: DataFrame, group: Sequence[str], label: str, score: str) -> DataFrame:
    """Metrics of a raw score: there is no threshold, so precision, recall and F1 are NULL."""
    none = F.lit(None).cast("double")
    return ranking_metrics(df, group, label, score).select(
        "*",
        none.alias("precision"),
        none.alias("recall"),
        none.alias("f1"),
        F.lit(0).alias("trainable_params"),
    )

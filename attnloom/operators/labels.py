"""From verdicts and metrics to labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import CORRECT, EXAMPLE, INCORRECT, INVALID, RUN
from .joins import zip_shortest

# fixed values: label thresholds
EXACT_ENOUGH = 0.99
TOO_CLOSE = 0.75
# fixed values: how a final answer is announced, and what is removed from it
FINAL_ANSWER = r"The final answer is ((-?[$0-9.,]{2,})|(-?[0-9]+))"
IGNORED = (r",", r"\$", r"(?s).*#### ", r"\.$")
GOLD_MARK = "####"


def judge_labels(judge: DataFrame, metrics: DataFrame, example: Sequence[str] = EXAMPLE) -> DataFrame:
    """0 correct, 1 incorrect, -1 invalid; overlap overrules the judge, doubt invalidates."""
    f1, rouge, verdict = F.col("squad_f1"), F.col("rougeL_fmeasure"), F.col("verdict")
    label = (
        F.when((f1 >= EXACT_ENOUGH) | (rouge >= EXACT_ENOUGH), CORRECT)
        .when((verdict == "incorrect") & (rouge >= TOO_CLOSE), INVALID)
        .when(verdict == "correct", CORRECT)
        .when(verdict == "incorrect", INCORRECT)
        .otherwise(INVALID)
    )
    joined = zip_shortest(
        judge.select(*example, "verdict"), metrics.select(*example, "squad_f1", "rougeL_fmeasure"), example
    )
    return with_valid(joined.select(*example, label.alias("label")))


def with_valid(labels: DataFrame) -> DataFrame:
    return labels.withColumn("valid", F.col("label") != INVALID)


def valid_only(df: DataFrame) -> DataFrame:
    return df.filter(F.col("label").isin(CORRECT, INCORRECT))


def exact_answer(gold: Column) -> Column:
    """Text after the first mark, trimmed; empty if there is no mark."""
    at = F.instr(gold, GOLD_MARK)
    after = F.substring(gold, at + len(GOLD_MARK), F.length(gold))
    return F.when(at == 0, "").otherwise(_strip(after))


def final_answer(prediction: Column) -> Column:
    """Announced number without separators, currency and closing dot; NULL if none is announced."""
    found = F.regexp_extract(prediction, FINAL_ANSWER, 1)
    cleaned = found
    for pattern in IGNORED:
        cleaned = F.regexp_replace(cleaned, pattern, "")
    return F.when(found != "", _strip(cleaned))


def _strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def exact_match_labels(answers: DataFrame, example: Sequence[str] = EXAMPLE) -> DataFrame:
    """Labels from `prediction` and `answer` by comparing final numbers."""
    final, exact = final_answer(F.col("prediction")), exact_answer(F.col("answer"))
    found = answers.select(*example, final.alias("final_answer"), exact.alias("exact_answer"))
    label = F.when(F.col("final_answer").isNull(), INVALID).otherwise(
        (F.col("final_answer") != F.col("exact_answer")).cast("int")
    )
    return with_valid(found.withColumn("label", label))


def label_summary(labels: DataFrame, run: Sequence[str] = RUN) -> DataFrame:
    """Counts of missing, wrong and right answers and the accuracy over valid ones."""
    label = F.col("label")
    return labels.groupBy(*run).agg(
        F.count_if(label == INVALID).alias("n_missing"),
        F.count_if(label == INCORRECT).alias("n_incorrect"),
        F.count_if(label == CORRECT).alias("n_correct"),
        F.avg(F.when(label != INVALID, (label == CORRECT).cast("double"))).alias("accuracy"),
    )

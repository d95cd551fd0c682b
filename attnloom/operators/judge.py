"""Judge requests, their cache, and the handling of verdicts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..schema import EXAMPLE, RUN
from ..sources.prompts import JudgePrompt


def messages(prompt: JudgePrompt, question: Column, prediction: Column, gold: Column) -> Column:
    """Chat messages of one judgement; the system message comes first if the prompt has one."""
    content = X.fill_double_braces(
        prompt.content,
        **{
            prompt.question_key: question,
            prompt.predicted_answer_key: prediction,
            prompt.gold_answer_key: gold,
        },
    )
    user = F.struct(F.lit("user").alias("role"), content.alias("content"))
    if prompt.system_prompt is None:
        return F.array(user)
    return F.array(F.struct(F.lit("system").alias("role"), F.lit(prompt.system_prompt).alias("content")), user)


def judge_requests(answers: DataFrame, prompt: JudgePrompt, example: Sequence[str] = EXAMPLE) -> DataFrame:
    """One request per answer, all gold answers in one prompt, with a key of its full text."""
    gold = X.render_list(F.col("gold"))
    asked = answers.select(
        *example, messages(prompt, F.col("question"), F.col("prediction"), gold).alias("messages")
    )
    return asked.withColumn("request_key", request_key(F.col("messages")))


def judge_requests_per_gold(answers: DataFrame, prompt: JudgePrompt, example: Sequence[str] = EXAMPLE) -> DataFrame:
    """One request per (answer, gold answer)."""
    single = answers.select(*example, "question", "prediction", F.posexplode("gold").alias("gold_idx", "_gold"))
    asked = single.select(
        *example,
        "gold_idx",
        messages(prompt, F.col("question"), F.col("prediction"), F.col("_gold")).alias("messages"),
    )
    return asked.withColumn("request_key", request_key(F.col("messages")))


def request_key(asked: Column) -> Column:
    flat = F.array_join(F.transform(asked, lambda m: F.concat(m["role"], F.lit("\u001f"), m["content"])), "\u001e")
    return F.sha2(flat, 256)


def uncached(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """Distinct requests the cache cannot answer. Copies collapse before the anti-join."""
    distinct = requests.select("request_key", "messages").groupBy("request_key").agg(
        F.any_value("messages").alias("messages")
    )
    return distinct.join(cache.select("request_key"), "request_key", "left_anti")


def fill_from_cache(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """Verdict of every request that the cache holds, NULL otherwise."""
    return requests.join(cache.select("request_key", "verdict"), "request_key", "left")


def combined(verdicts: Column, priority: Sequence[str]) -> Column:
    """First verdict of the priority list that occurs; NULL if none does."""
    return F.get(F.filter(F.lit(list(priority)), lambda p: F.array_contains(verdicts, p)), F.lit(0))


def combine_verdicts(
    verdicts: DataFrame, priority: Sequence[str], example: Sequence[str] = EXAMPLE, verdict: str = "verdict"
) -> DataFrame:
    """One verdict per example out of one per gold answer.

    Presence flags merge in the map-side aggregate: no list of verdicts is built.
    """
    flags = [F.max(F.when(F.col(verdict) == p, F.lit(p))).alias(f"_v{i}") for i, p in enumerate(priority)]
    seen = verdicts.groupBy(*example).agg(*flags)
    return seen.select(*example, F.coalesce(*[F.col(f"_v{i}") for i in range(len(priority))]).alias("verdict"))


def usage_summary(judge: DataFrame, run: Sequence[str] = RUN) -> DataFrame:
    """Calls, tokens and a map of finish reasons per run; two partial aggregates."""
    per_reason = judge.groupBy(*run, "finish_reason").agg(
        F.count(F.lit(1)).alias("calls"),
        F.sum("usage.input_tokens").alias("input_tokens"),
        F.sum("usage.output_tokens").alias("output_tokens"),
        F.sum("usage.cache_read").alias("cached"),
    )
    return per_reason.groupBy(*run).agg(
        F.sum("calls").alias("total_api_calls"),
        F.sum("input_tokens").alias("total_input_tokens"),
        F.sum("output_tokens").alias("total_output_tokens"),
        F.sum("cached").alias("total_cached_input_tokens"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("finish_reason", "calls")))).alias(
            "finish_reason_counts"
        ),
    )


def verdict_columns(judge: DataFrame, keys: Sequence[str] | None = None, example: Sequence[str] = EXAMPLE) -> DataFrame:
    """One column per judge, named `llm_judge_<llm>_<prompt>`.

    Without `keys` the judges present are listed first; there are as many as
    judge configurations, so that list is small.
    """
    name = F.concat_ws("_", F.lit("llm_judge"), F.replace(F.col("judge_llm"), F.lit("-"), F.lit("_")), F.col("judge_prompt"))
    named = judge.select(*example, name.alias("judge_key"), "verdict")
    if keys is None:
        keys = sorted(r[0] for r in named.select("judge_key").distinct().collect())
    return named.groupBy(*example).pivot("judge_key", list(keys)).agg(F.max("verdict"))


def judge_key(judge_llm: str | None, judge_prompt: str | None) -> str | None:
    """Column name of one judge; giving only one of the two names is an error."""
    if (judge_llm is None) != (judge_prompt is None):
        raise ValueError("give both the judge and its prompt, or neither")
    return None if judge_llm is None else f"llm_judge_{judge_llm.replace('-', '_')}_{judge_prompt}"

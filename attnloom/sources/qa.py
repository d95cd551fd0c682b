"""Question-answering datasets: readers, flattening, prompt messages.

`SOURCES` maps a dataset name to its reader. Datasets that are published on a
hub are read from a local copy in parquet or JSON; downloading is no Spark work.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from .prompts import QaPrompt

# published layouts of the nested files; giving the schema avoids an inference pass
_COQA_TEXT = "array<struct<input_text:string,turn_id:int>>"
COQA_SCHEMA = (
    "data array<struct<id:string,story:string,"
    "questions:array<struct<input_text:string,turn_id:int>>,"
    "answers:array<struct<input_text:string,span_start:int>>,"
    f"additional_answers:struct<`0`:{_COQA_TEXT},`1`:{_COQA_TEXT},`2`:{_COQA_TEXT}>>>"
)
SQUAD_SCHEMA = (
    "data array<struct<paragraphs:array<struct<context:string,"
    "qas:array<struct<id:string,question:string,is_impossible:boolean,"
    "answers:array<struct<text:string,answer_start:int>>>>>>>>"
)


def flatten_conversations(conversations: DataFrame) -> DataFrame:
    """One row per question of a conversation `(sample_idx, id, story, questions, answers, additional_answers)`.

    Questions, answers and the three extra answer lists pair by position. The
    prompt text is the story followed by the question.
    """
    extra = F.transform(
        F.arrays_zip(
            F.col("additional_answers.0").alias("a"),
            F.col("additional_answers.1").alias("b"),
            F.col("additional_answers.2").alias("c"),
        ),
        lambda z: F.array(z["a"]["input_text"], z["b"]["input_text"], z["c"]["input_text"]),
    )
    paired = conversations.select(
        "sample_idx",
        "id",
        "story",
        F.posexplode(
            F.arrays_zip(
                F.col("questions").alias("q"), F.col("answers").alias("a"), extra.alias("extra")
            )
        ).alias("question_index", "_t"),
    )
    return paired.select(
        "sample_idx",
        F.concat_ws("_", "id", F.col("question_index").cast("string")).alias("id"),
        "story",
        F.concat("story", F.lit(" Q: "), F.col("_t.q.input_text"), F.lit(" A:")).alias("question"),
        F.col("_t.a.input_text").alias("answer"),
        F.col("_t.extra").alias("additional_answers"),
    )


def flatten_articles(articles: DataFrame) -> DataFrame:
    """One row per answerable question of an article `(paragraphs)`.

    `answer_info` is the first answer, `answer` the distinct answer texts in order.
    """
    paragraphs = articles.select(F.posexplode("paragraphs").alias("sample_idx", "_p"))
    questions = paragraphs.select(
        "sample_idx", F.col("_p.context").alias("context"), F.posexplode("_p.qas").alias("question_idx", "_q")
    ).filter(~F.col("_q.is_impossible"))
    return questions.select(
        "sample_idx",
        "question_idx",
        F.col("_q.id").alias("id"),
        "context",
        F.col("_q.question").alias("question"),
        F.get(F.col("_q.answers"), F.lit(0)).alias("answer_info"),
        F.array_sort(F.array_distinct(F.transform("_q.answers", lambda a: a["text"]))).alias("answer"),
    )


def first_per_key(df: DataFrame, key: str, order: str) -> DataFrame:
    """The earliest row of every key.

    A minimum of (order, row) merges before the shuffle, so copies of one key
    never gather in a task.
    """
    rest = [c for c in df.columns if c != key]
    first = df.groupBy(key).agg(F.min_by(F.struct(*rest), order).alias("_first"))
    return first.select(key, "_first.*").select(*df.columns)


def gold_list(answer: Column, data_type: T.DataType) -> Column:
    """One gold answer or several, always as an array."""
    return answer if isinstance(data_type, T.ArrayType) else F.array(answer)


# ---------------------------------------------------------------- readers


@dataclass(frozen=True)
class QaDataset:
    """Where a dataset lies and which part is read."""

    name: str
    path: str
    subset: str | None = None
    test_split_name: str | None = None
    max_answer_tokens: int = 50
    target_column_name: str = "answer"


# fixed values: default subset, test split and answer budget of every dataset
DEFAULTS = {
    "coqa": dict(subset=None, test_split_name=None, max_answer_tokens=40),
    "gsm8k": dict(subset="main", test_split_name="test", max_answer_tokens=512),
    "halueval_qa": dict(subset=None, test_split_name=None, max_answer_tokens=120),
    "nq_open": dict(subset=None, test_split_name="validation", max_answer_tokens=50),
    "squad_v2": dict(subset=None, test_split_name=None, max_answer_tokens=43),
    "trivia_qa": dict(subset="rc.nocontext", test_split_name="validation", max_answer_tokens=80),
    "truthful_qa": dict(subset="generation", test_split_name="validation", max_answer_tokens=35),
}


def dataset(name: str, path: str) -> QaDataset:
    short = name.split("/")[-1]
    if short not in DEFAULTS:
        raise ValueError(f"unknown dataset: {name}")
    return QaDataset(short, path, **DEFAULTS[short])


def _columnar(spark: SparkSession, config: QaDataset, split: str | None) -> DataFrame:
    """A local copy laid out as `path/[subset=…/]split=…`; the partition filter prunes the scan."""
    reader = spark.read.json if config.path.endswith((".json", ".jsonl")) else spark.read.parquet
    df = reader(config.path)
    for column, value in (("subset", config.subset), ("split", split)):
        if value is not None:
            if column not in df.columns:
                if column == "subset":  # a copy without the column holds the configured subset alone
                    continue
                raise ValueError(f"{config.path} has no column {column} to select {value!r} by")
            df = df.filter(F.col(column) == value)
    return df


def _no_split(config: QaDataset, split: str | None) -> None:
    if split is not None:
        raise ValueError(f"{config.name} has no splits")


def _coqa(spark: SparkSession, config: QaDataset, split: str | None) -> DataFrame:
    _no_split(config, split)
    raw = spark.read.schema(COQA_SCHEMA).json(config.path, multiLine=True)
    return flatten_conversations(raw.select(F.posexplode("data").alias("sample_idx", "_d")).select("sample_idx", "_d.*"))


def _squad(spark: SparkSession, config: QaDataset, split: str | None) -> DataFrame:
    _no_split(config, split)
    raw = spark.read.schema(SQUAD_SCHEMA).json(config.path, multiLine=True)
    return flatten_articles(raw.select(F.explode("data").alias("_d")).select("_d.*"))


def _halueval(spark: SparkSession, config: QaDataset, split: str | None) -> DataFrame:
    raw = spark.read.schema("question string, right_answer string").json(config.path)
    return raw.withColumnRenamed("right_answer", "answer")


def _trivia(spark: SparkSession, config: QaDataset, split: str | None) -> DataFrame:
    """First row per question; the source order is the `row_idx` column of the local copy."""
    df = _columnar(spark, config, split)
    kept = first_per_key(df.select("row_idx", "question_id", "question", "answer"), "question_id", "row_idx")
    return kept.select("row_idx", "question_id", "question", F.col("answer.aliases").alias("answer"))


def _truthful(spark: SparkSession, config: QaDataset, split: str | None) -> DataFrame:
    if config.subset != "generation" or split != "validation":
        raise ValueError("truthful_qa is used with subset 'generation' and split 'validation'")
    return _columnar(spark, config, split).withColumnRenamed("correct_answers", "answer")


SOURCES: dict[str, Callable[[SparkSession, QaDataset, str | None], DataFrame]] = {
    "coqa": _coqa,
    "gsm8k": _columnar,
    "halueval_qa": _halueval,
    "nq_open": _columnar,
    "squad_v2": _squad,
    "trivia_qa": _trivia,
    "truthful_qa": _truthful,
}


def read_dataset(spark: SparkSession, config: QaDataset, split: str | None = None, default_split: bool = False) -> DataFrame:
    """Rows of a dataset; with `default_split` a missing split means the test split of the dataset."""
    if config.name not in SOURCES:
        raise ValueError(f"unknown dataset: {config.name}")
    if split is None and default_split:
        split = config.test_split_name
    return SOURCES[config.name](spark, config, split)


# ---------------------------------------------------------------- prompts


def prompt_messages(prompt: QaPrompt, question: Column) -> Column:
    """One user message with the question filled in."""
    if prompt.context_key is not None:
        raise ValueError("prompts with a context are not supported")
    content = X.fill_braces(prompt.content, **{prompt.question_key: question})
    return F.array(F.struct(F.lit("user").alias("role"), content.alias("content")))


def format_questions(df: DataFrame, prompt: QaPrompt) -> DataFrame:
    return df.withColumn("messages", prompt_messages(prompt, F.col(prompt.question_key)))


def prepare_dataset(
    spark: SparkSession, config: QaDataset, prompt: QaPrompt, split: str | None = None, return_raw: bool = False
):
    """Read and format a dataset; `return_raw` also gives the rows before formatting."""
    raw = read_dataset(spark, config, split)
    formatted = format_questions(raw, prompt)
    return (raw, formatted) if return_raw else formatted


def token_stats(texts: DataFrame, text: str, run: list[str], tokens: Callable[[Column], Column] | None = None) -> DataFrame:
    """Longest, shortest, mean and median token count; tokens default to whitespace pieces."""
    count = F.size(tokens(F.col(text)) if tokens else F.split(F.col(text), r"\s+"))
    sized = texts.select(*run, count.alias("_n"))
    return sized.groupBy(*run).agg(
        F.max("_n").alias("max_tokens"),
        F.min("_n").alias("min_tokens"),
        F.avg("_n").alias("mean_tokens"),
        F.percentile("_n", F.lit(0.5)).alias("median_tokens"),
    )


def answer_token_stats(qa: DataFrame, run: list[str], tokens: Callable[[Column], Column] | None = None) -> DataFrame:
    """`token_stats` over every gold answer of every question."""
    return token_stats(qa.select(*run, F.explode("answer").alias("_text")), "_text", run, tokens)

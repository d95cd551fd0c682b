"""Artefact tables of all runs, and the choice of what a run stores.

One parquet table per artefact, partitioned by `run_id` (wide activation
tables also by `layer`), so reading one run or one layer prunes partitions.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import attention, hidden, joins, judge, padding
from ..schema import EXAMPLE, RUN

# fixed values: artefacts of a run and their partition columns
ARTEFACTS = {
    "answers": ["run_id"],
    "metrics": ["run_id"],
    "judge": ["run_id"],
    "labels": ["run_id"],
    "split": ["run_id"],
    "tokens": ["run_id"],
    "attentions": ["run_id", "layer"],
    "hidden_states": ["run_id", "layer"],
    "diagonals": ["run_id"],
    "hidden_features": ["run_id"],
    "probe_results": ["run_id"],
    "probe_predictions": ["run_id"],
}
# fixed values: stored-feature modes and the tables each one writes
STORED_FEATURES = {
    "attentions": ("tokens", "attentions"),
    "attention_diags": ("tokens", "diagonals"),
    "hidden_states": ("tokens", "hidden_states"),
    "attention_with_hidden_states": ("tokens", "attentions", "hidden_states"),
    "hidden_states_for_last_input_last_gen_tokens": ("tokens", "hidden_features"),
    "attention_diags_and_hidden_states_for_last_input_last_gen_tokens": ("tokens", "diagonals", "hidden_features"),
}


class EmptyArtefact(ValueError):
    """An artefact holds no rows for the wanted runs."""


@dataclass(frozen=True)
class Catalog:
    spark: SparkSession
    root: str

    def path(self, artefact: str) -> str:
        if artefact not in ARTEFACTS:
            raise ValueError(f"unknown artefact: {artefact}")
        return f"{self.root.rstrip('/')}/{artefact}"

    def exists(self, artefact: str) -> bool:
        try:
            self.spark.read.parquet(self.path(artefact))
        except AnalysisException:
            return False
        return True

    def write(self, artefact: str, df: DataFrame, overwrite: bool = False) -> None:
        """Write a table; existing data is refused unless `overwrite`.

        Rows are rebalanced by partition: small runs share a task, and the
        rows of a run that dominates are split over as many tasks as its size
        asks for.
        """
        present = [k for k in ARTEFACTS[artefact] if k in df.columns]
        mode = "overwrite" if overwrite else "errorifexists"
        balanced = df.hint("rebalance", *[F.col(k) for k in present])
        balanced.write.mode(mode).partitionBy(*present).parquet(self.path(artefact))

    def append_new(self, artefact: str, df: DataFrame, key: Sequence[str]) -> None:
        """Append one row per key that is not stored yet; only the runs of `df` are looked up."""
        if self.exists(artefact):
            runs = [r[0] for r in df.select("run_id").distinct().collect()]
            df = df.join(self.read(artefact, runs).select(*key), list(key), "left_anti")
        df = df.dropDuplicates(list(key))
        present = [k for k in ARTEFACTS[artefact] if k in df.columns]
        df.write.mode("append").partitionBy(*present).parquet(self.path(artefact))

    def read(
        self, artefact: str, runs: Sequence[str] | None = None, layer: int | None = None,
        schema: T.StructType | None = None, required: bool = False,
    ) -> DataFrame:
        """A table, cut to runs and to one layer by partition pruning."""
        reader = self.spark.read.schema(schema) if schema is not None else self.spark.read
        df = reader.parquet(self.path(artefact))
        if runs is not None:
            df = df.filter(F.col("run_id").isin(list(runs)))
        if layer is not None:
            df = df.filter(F.col("layer") == layer)
        if required and df.isEmpty():
            raise EmptyArtefact(f"no rows in {artefact} for {runs}")
        return df

    def read_or_build(self, artefact: str, build) -> DataFrame:
        """The stored table, or the result of `build()` stored and read back."""
        if not self.exists(artefact):
            self.write(artefact, build())
        return self.read(artefact)

    def storage_report(self, artefact: str) -> DataFrame:
        """Number of data files and gigabytes; file contents are not read."""
        files = (
            self.spark.read.format("binaryFile")
            .option("recursiveFileLookup", "true")
            .option("pathGlobFilter", "*.parquet")
            .load(self.path(artefact))
        )
        return files.agg(F.count(F.lit(1)).alias("files"), (F.coalesce(F.sum("length"), F.lit(0)) * 1e-9).alias("gigabytes"))

    def write_stored_features(self, mode: str, tables: dict[str, DataFrame]) -> list[str]:
        """Write exactly the tables the stored-feature mode asks for."""
        if mode not in STORED_FEATURES:
            raise ValueError(f"unknown stored features: {mode}")
        wanted = STORED_FEATURES[mode]
        missing = [t for t in wanted if t not in tables]
        if missing:
            raise ValueError(f"{mode} needs {missing}")
        for name in wanted:
            self.write(name, tables[name])
        return list(wanted)


def outputs_needed(mode: str) -> dict[str, bool]:
    """Which model outputs a stored-feature mode needs."""
    if mode not in STORED_FEATURES:
        raise ValueError(f"unknown stored features: {mode}")
    return {"output_attentions": "attention" in mode, "output_hidden_states": "hidden_states" in mode}


def json_table(spark: SparkSession, path: str, schema: T.StructType | str, lines: bool | None = None) -> DataFrame:
    """Rows of JSON arrays, or of JSON lines (by default for paths ending in .jsonl), under a known schema.

    Only lines can be split over tasks. Malformed rows raise.
    """
    lines = path.endswith(".jsonl") if lines is None else lines
    return spark.read.schema(schema).json(path, multiLine=not lines, mode="FAILFAST")


def qa_metrics_table(
    answers: DataFrame, metrics: DataFrame, judges: DataFrame,
    judge_llm: str | None = None, judge_prompt: str | None = None,
    keys: Sequence[str] | None = None, example: Sequence[str] = EXAMPLE,
) -> DataFrame:
    """Answers, metrics and one verdict column per judge; unmatched rows stay with NULLs."""
    one = judge.judge_key(judge_llm, judge_prompt)
    columns = judge.verdict_columns(judges, [one] if one else keys, example)
    return joins.concat_columns(answers, metrics, columns, on=example)


def qa_with_metrics(qa: DataFrame, qa_metrics: DataFrame, example: Sequence[str] = EXAMPLE) -> DataFrame:
    """Questions beside their metrics, by key; the raw answer column is dropped."""
    return qa.join(qa_metrics.drop("answers"), list(example))


def load_hidden_states(
    store: Catalog, runs: Sequence[str] | None = None, layer: str | int | None = None,
    remove_padding: bool = False, pad: int | None = None, example: Sequence[str] = EXAMPLE,
) -> DataFrame:
    """Stored hidden states with the input length of their example; nothing stored is an error.

    `layer` selects the two reference tokens of `'all'`, `'last'` or one layer.
    Selection refers to original positions, so it excludes removing padding,
    which takes padding at both ends only, as for attention maps.
    """
    if remove_padding and layer is not None:
        raise NotImplementedError("removing padding is not supported together with a selection")
    states = store.read("hidden_states", runs, layer if isinstance(layer, int) else None, required=True)
    tokens = store.read("tokens", runs)
    if remove_padding:
        states = padding.strip_hidden_state_edges(states, attention.token_range(tokens, pad, example), example)
    lengths = tokens.select(*example, "input_length")
    if layer is None:
        return states.join(lengths, list(example))
    return hidden.select_last_tokens(states, tokens, layer, example).join(lengths, list(example))


def single_layer_dataset(
    states: DataFrame, answers: DataFrame, metrics: DataFrame, judges: DataFrame, labels: DataFrame,
    layer: int, valid: bool = False, example: Sequence[str] = EXAMPLE,
    tokens: DataFrame | None = None, remove_padding: bool = False, pad: int | None = None,
) -> DataFrame:
    """Hidden states of one layer with everything known about each example.

    With `tokens` each row also has `gen_tokens` and `last_input_token_idx` of
    its example. `remove_padding` leaves out the states and tokens of all pads,
    numbers the states anew and moves the last input position accordingly.

    The narrow tables are joined first; the wide states meet one side only, and
    which of them stay is then decided row by row.
    """
    if remove_padding and tokens is None:
        raise ValueError("padding is found by tokens")
    facts = joins.zip_strict(answers, metrics, example)
    facts = joins.zip_strict(facts, judges.select(*example, "verdict"), example)
    facts = joins.zip_strict(facts, labels.select(*example, "label"), example)
    if valid:
        facts = facts.filter(F.col("label").isin(0, 1))
    if remove_padding:
        kept = padding.strip_all_padding(tokens, pad, example)
        kept = kept.select(
            *example, F.col("kept")["token_id"].alias("gen_tokens"), F.col("last_input_idx").alias("last_input_token_idx"), F.col("kept")["tok_idx"].alias("_places")
        )
        facts = facts.join(kept, list(example))
    elif tokens is not None:
        facts = facts.join(tokens.select(*example, F.col("token_ids").alias("gen_tokens"), (F.col("input_length") - 1).alias("last_input_token_idx")), list(example))
    joined = hidden.select_layer(states, layer).join(facts, list(example))
    if not remove_padding:
        return joined
    place = F.array_position("_places", F.col("tok_idx").cast(T.IntegerType()))
    return joined.filter(place > 0).withColumn("tok_idx", (place - 1).cast("int")).drop("_places")


def shard_stats(tokens: DataFrame, mask: str = "attention_mask", run: Sequence[str] = RUN) -> DataFrame:
    """Mean share of padding, number of tokens and input width per run."""
    pads = F.aggregate(mask, F.lit(0), lambda acc, m: acc + F.when(m, 0).otherwise(1))
    sized = tokens.select(*run, pads.alias("_pads"), F.size(mask).alias("_n"))
    return sized.groupBy(*run).agg(
        (F.sum("_pads") / F.sum("_n")).alias("padding_share"),
        F.sum("_n").alias("n_tokens"),
        F.max("_n").alias("input_size"),
    )

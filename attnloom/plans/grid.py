"""Experiment grids and run configuration."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.catalog import STORED_FEATURES, outputs_needed
from ..sources.qa import DEFAULTS

# fixed values: the experiment grids
LLMS = (
    "llama_3.1_8b_instruct",
    "llama_3.2_3b_instruct",
    "phi_3.5_mini_instruct",
    "mistral_nemo_2407",
    "mistral_small_24b_instruct_2501",
)
CONTEXT_SIZES = {llm: 32_000 if llm == "mistral_small_24b_instruct_2501" else 128_000 for llm in LLMS}
DATASET_PROMPTS = (
    ("nq_open", "short_few_shot_sep"),
    ("halueval_qa", "short_few_shot_sep"),
    ("trivia_qa", "short_few_shot_sep"),
    ("squad_v2", "short_few_shot_sep"),
    ("truthful_qa", "short_few_shot_sep"),
    ("coqa", "short_few_shot_sep"),
    ("gsm8k", "gsm8k"),
)
TEMPERATURES = ("temp_0.1", "temp_1.0")
SEEDS = (42,)
RESERVED = ("return_dict_in_generate", "output_attentions", "output_hidden_states")


@dataclass(frozen=True)
class RunConfig:
    """What one run generates and stores. Unknown arguments are refused by the constructor."""

    dataset: str
    llm: str
    prompt: str
    stored_features: str
    context_size: int
    max_answer_tokens: int
    random_seed: int
    batch_size: int = 1
    split: str | None = None
    generation: Mapping = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.stored_features not in STORED_FEATURES:
            raise ValueError(f"unknown stored features: {self.stored_features}")
        clash = [k for k in RESERVED if k in self.generation]
        if clash:
            raise ValueError(f"set by the stored features, not by hand: {clash}")

    @property
    def generation_config(self) -> dict:
        return {**self.generation, "return_dict_in_generate": True, **outputs_needed(self.stored_features)}

    @property
    def max_input_length(self) -> int:
        return self.context_size - self.max_answer_tokens


def runs_grid(
    spark: SparkSession,
    llms: Sequence[str] = LLMS,
    dataset_prompts: Sequence[tuple[str, str]] = DATASET_PROMPTS,
    temperatures: Sequence[str] = TEMPERATURES,
    seeds: Sequence[int] = SEEDS,
    stored_features: str = "attention_diags",
) -> DataFrame:
    """The `runs` dimension: every combination, with its name, folder and derived limits."""
    def listed(values, name):
        return F.explode(F.array(*[F.lit(v) for v in values])).alias(name)

    pairs = F.explode(F.array(*[F.struct(F.lit(d).alias("dataset"), F.lit(p).alias("prompt")) for d, p in dataset_prompts]))
    grid = spark.range(1).select(listed(llms, "llm"))
    grid = grid.select("*", pairs.alias("_p")).select("llm", "_p.*")
    grid = grid.select("*", listed(temperatures, "temp")).select("*", listed(seeds, "seed"))
    budget = F.create_map(*[F.lit(x) for n, c in DEFAULTS.items() for x in (n, c["max_answer_tokens"])])
    context = F.create_map(*[F.lit(x) for n, c in CONTEXT_SIZES.items() for x in (n, c)])
    name = F.concat_ws("__", "temp", F.concat(F.lit("prompt_qa_"), "prompt"), F.concat(F.lit("seed_"), F.col("seed").cast("string")))
    flags = outputs_needed(stored_features)
    return grid.select(
        F.concat_ws("/", "dataset", "llm", name).alias("run_id"),
        name.alias("run_name"),
        "dataset",
        "llm",
        "prompt",
        "temp",
        "seed",
        (F.try_element_at(context, F.col("llm")) - F.try_element_at(budget, F.col("dataset"))).alias("max_input_length"),
        F.lit(stored_features).alias("stored_features"),
        *[F.lit(v).alias(k) for k, v in flags.items()],
    )

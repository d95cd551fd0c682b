"""Run metadata, stored probe results and display names."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: how a run is named and what a results file is called
RUN_SEPARATOR = "__"
NUMBER = r"-?\d+\.\d+|-?\d+"
PCA_FILE = r"attn_vs_laplacian_pca_(\d+)_results"
RESULT_RECORD = (
    "struct<metadata:struct<trainable_params:bigint,random_seed:bigint,max_iter:bigint,pca_dim:int,"
    "layer_idx:string,top_eigval:int>,metrics:map<string,double>,"
    "train_preds:array<double>,test_preds:array<double>,"
    "train_proba:array<array<double>>,test_proba:array<array<double>>>"
)

# fixed values: display names
LLM_NAMES = {
    "meta-llama/Meta-Llama-3.1-8B-Instruct": "Llama3.1-8B",
    "meta-llama/Llama-3.2-3B-Instruct": "Llama3.2-3B",
    "microsoft/Phi-3.5-mini-instruct": "Phi3.5",
    "mistralai/Mistral-Nemo-Instruct-2407": "Mistral-Nemo",
    "mistralai/Mistral-Small-24B-Instruct-2501": "Mistral-Small-24B",
}
DATASET_NAMES = {
    "coqa": "CoQA",
    "halueval_qa": "HaluevalQA",
    "google-research-datasets/nq_open": "NQOpen",
    "nq_open": "NQOpen",
    "squad_v2": "SQuADv2",
    "trivia_qa": "TriviaQA",
    "truthful_qa": "TruthfulQA",
    "gsm8k": "GSM8K",
}
PROBE_NAMES = {
    "hidden_state_last_input_token_per_layer": "HiddenStateLastInputToken",
    "hidden_state_last_generated_token_per_layer": "HiddenStateLastGeneratedToken",
    "attn_log_det_per_layer": "AttnLogDet",
    "attn_eigval_topk_per_layer": "AttnEigval",
    "laplacian_eigval_topk_per_layer": "LapEigval",
    "hidden_state_last_input_token_all_layers": "HiddenStateLastInputToken (all layers)",
    "hidden_state_last_generated_token_all_layers": "HiddenStateLastGeneratedToken (all layers)",
    "attn_log_det_all_layers": "AttnLogDet (all layers)",
    "attn_eigval_topk_all_layers": "AttnEigval (all layers)",
    "laplacian_eigval_topk_all_layers": "LapEigval (all layers)",
}
METRIC_NAMES = {"auc": "AUROC", "average_precision": "AP"}


def display_name(column: Column, names: dict[str, str]) -> Column:
    """Display name, or the value itself if it has none."""
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.coalesce(F.try_element_at(table, column), column)


def run_metadata(df: DataFrame, name: str) -> DataFrame:
    """Add `temp`, `prompt`, `seed` from `temp__prompt__seed`.

    A number in the temperature is printed with three decimals; a name that
    does not have three parts raises.
    """
    parts = F.split(F.col(name), RUN_SEPARATOR)
    wrong = F.raise_error(F.concat(F.lit("run name without three parts: "), F.col(name)))
    checked = F.when(F.size(parts) == 3, parts).otherwise(wrong)
    split = df.withColumn("_parts", checked)
    number = F.regexp_extract(F.col("_parts")[0], NUMBER, 0)
    temp = F.when(number == "", F.col("_parts")[0]).otherwise(F.format_string("%.3f", number.try_cast("double")))
    return split.select(
        *df.columns, temp.alias("temp"), F.col("_parts")[1].alias("prompt"), F.col("_parts")[2].alias("seed")
    )


def configured_pca_dim(file_name: Column) -> Column:
    found = F.regexp_extract(file_name, PCA_FILE, 1)
    return F.when(found != "", found.cast("int"))


def run_path_to_results(path: Column) -> Column:
    """`…/activations/<run>` to `…/results/<run>`."""
    return F.regexp_replace(path, "/activations/", "/results/")


def results_path_to_run(path: Column) -> Column:
    """`…/results/<run>` to `…/activations/<run>`."""
    return F.regexp_replace(path, "/results/", "/activations/")


def flatten_results(
    raw: DataFrame, body: str = "value", return_preds: bool = False, keep: Sequence[str] = (), ignore_errors: bool = False
) -> DataFrame:
    """JSON text `{probe: record | [records]}` to one row per record.

    Text that does not parse raises, or gives no rows with `ignore_errors`.
    """
    mode = {"mode": "PERMISSIVE" if ignore_errors else "FAILFAST"}
    probes = raw.select(*keep, F.explode(F.from_json(F.col(body), "map<string,string>", mode)).alias("probe", "_body"))
    many = F.from_json("_body", f"array<{RESULT_RECORD}>", mode)
    one = F.array(F.from_json("_body", RESULT_RECORD, mode))
    records = probes.select(
        *keep, "probe", F.explode(F.when(F.col("_body").startswith("["), many).otherwise(one)).alias("_r")
    )
    preds = [F.col(f"_r.{c}") for c in ("train_preds", "test_preds", "train_proba", "test_proba")] if return_preds else []
    return records.select(*keep, "probe", "_r.metadata.*", F.col("_r.metrics").alias("metrics"), *preds)


def load_results(
    spark: SparkSession,
    root: str,
    file_name: str,
    runs: DataFrame,
    modified_after: str | None = None,
    return_preds: bool = False,
    ignore_errors: bool = False,
    identity: Sequence[str] = ("run_name",),
) -> DataFrame:
    """All result files of that name under a folder, with the metadata of their run.

    `runs` has the columns of `identity` and the configuration columns. `identity`
    names the last folders of a file's path, outermost first, so with
    `("dataset", "llm", "run_name")` runs of one name in several folders stay
    apart. Two runs of one identity raise. Files older than `modified_after`
    are skipped by the scan. A file whose run is unknown raises, or is left out
    with `ignore_errors`; so does a file that does not parse.
    """
    identity = list(identity)
    reader = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", file_name)
    if modified_after is not None:
        reader = reader.option("modifiedAfter", modified_after)
    folders = F.split(F.col("_metadata.file_path"), "/")
    raw = reader.text(root, wholetext=True).select(
        "value",
        *[F.element_at(folders, i - len(identity) - 1).alias(name) for i, name in enumerate(identity)],
        configured_pca_dim(F.col("_metadata.file_name")).alias("configured_pca_dim"),
    )
    flat = flatten_results(raw, "value", return_preds, [*identity, "configured_pca_dim"], ignore_errors)
    facts = F.struct(*[c for c in runs.columns if c not in identity], F.lit(True).alias("_known"))
    listed = runs.groupBy(*identity).agg(F.count(F.lit(1)).alias("_n"), F.first(facts).alias("_facts"))
    twice = F.raise_error(F.concat(F.lit("several runs are named "), F.concat_ws("/", *identity)))
    unique = listed.select(*identity, F.when(F.col("_n") > 1, twice).otherwise(F.col("_facts")).alias("_facts"))
    runs = unique.select(*identity, "_facts.*")
    if ignore_errors:
        known = flat.join(runs, identity).drop("_known")
    else:
        joined = flat.join(runs, identity, "left")
        unknown = F.raise_error(F.concat(F.lit("no configuration for run "), F.col("run_name")))
        name = F.when(F.col("_known").isNull(), unknown).otherwise(F.col("run_name"))
        known = joined.withColumn("run_name", name).drop("_known")
    return run_metadata(known, "run_name")

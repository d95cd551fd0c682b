import json
import os

import pytest
from pyspark.sql import functions as F

from attnloom.operators import joins, judge
from attnloom.plans import grid
from attnloom.sources import catalog, qa, results
from attnloom.sources.prompts import QA_PROMPTS

EX = "run_id string, row_idx long"


@pytest.fixture
def coqa_file(tmp_path):
    text = lambda *t: [{"input_text": x, "turn_id": i} for i, x in enumerate(t)]
    body = {
        "data": [
            {
                "id": "s1", "story": "Once.", "questions": text("who", "what"),
                "answers": [{"input_text": "me", "span_start": 0}, {"input_text": "that", "span_start": 3}],
                "additional_answers": {"0": text("a0", "a1"), "1": text("b0", "b1"), "2": text("c0", "c1")},
            }
        ]
    }
    path = tmp_path / "coqa.json"
    path.write_text(json.dumps(body, indent=1))
    return str(path)


def test_coqa(spark, coqa_file):
    rows = qa.read_dataset(spark, qa.dataset("coqa", coqa_file)).orderBy("id").collect()
    assert [r["id"] for r in rows] == ["s1_0", "s1_1"]
    assert rows[1]["question"] == "Once. Q: what A:" and rows[1]["answer"] == "that"
    assert rows[1]["additional_answers"] == ["a1", "b1", "c1"] and rows[0]["sample_idx"] == 0
    with pytest.raises(ValueError, match="no splits"):
        qa.read_dataset(spark, qa.dataset("coqa", coqa_file), "train")
    raw, formatted = qa.prepare_dataset(spark, qa.dataset("coqa", coqa_file), QA_PROMPTS["short_zero_shot"], return_raw=True)
    assert "messages" not in raw.columns and formatted.count() == 2


def test_squad(spark, tmp_path):
    def question(i, impossible, *texts):
        return {"id": i, "question": f"q{i}", "is_impossible": impossible, "answers": [{"text": t, "answer_start": 1} for t in texts]}

    body = {"data": [{"paragraphs": [{"context": "c", "qas": [question("1", False, "b", "a", "b"), question("2", True), question("3", False, "z")]}]}]}
    path = tmp_path / "squad.json"
    path.write_text(json.dumps(body))
    rows = {r["id"]: r for r in qa.read_dataset(spark, qa.dataset("squad_v2", str(path))).collect()}
    assert set(rows) == {"1", "3"}
    assert rows["1"]["answer"] == ["a", "b"] and rows["1"]["answer_info"]["text"] == "b"
    assert rows["3"]["question_idx"] == 2


def test_halueval(spark, tmp_path):
    path = tmp_path / "qa.json"
    path.write_text('{"question": "q", "right_answer": "r", "knowledge": "k"}\n')
    df = qa.read_dataset(spark, qa.dataset("halueval_qa", str(path)))
    assert df.columns == ["question", "answer"] and df.first()["answer"] == "r"


def test_columnar_sources(spark, tmp_path):
    trivia = spark.createDataFrame(
        [(0, "x", "first", (["a", "b"],), "validation"), (1, "x", "second", (["c"],), "validation"), (2, "y", "other", (["d"],), "train")],
        "row_idx long, question_id string, question string, answer struct<aliases:array<string>>, split string",
    )
    path = str(tmp_path / "trivia")
    trivia.repartition(3).write.partitionBy("split").parquet(path)
    config = qa.dataset("trivia_qa", path)
    rows = qa.read_dataset(spark, config, default_split=True).collect()
    assert [(r["question"], r["answer"]) for r in rows] == [("first", ["a", "b"])]
    assert qa.read_dataset(spark, config).count() == 2
    plan = qa.read_dataset(spark, config, "train")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(split" in plan

    truthful = str(tmp_path / "truthful")
    spark.createDataFrame([("q", ["a"], "validation")], "question string, correct_answers array<string>, split string").write.partitionBy("split").parquet(truthful)
    assert qa.read_dataset(spark, qa.dataset("truthful_qa", truthful), "validation").first()["answer"] == ["a"]
    with pytest.raises(ValueError):
        qa.read_dataset(spark, qa.dataset("truthful_qa", truthful), "train")
    assert qa.read_dataset(spark, qa.dataset("google-research-datasets/nq_open", truthful), "validation").count() == 1
    with pytest.raises(ValueError, match="unknown dataset"):
        qa.dataset("other", path)


def test_gold_list_and_token_stats(spark):
    df = spark.createDataFrame([("r", ["one two", "three"]), ("r", ["a b c d"])], "run_id string, answer array<string>")
    row = qa.answer_token_stats(df, ["run_id"]).first()
    assert (row["max_tokens"], row["min_tokens"], row["median_tokens"]) == (4, 1, 2.0)
    assert row["mean_tokens"] == pytest.approx(7 / 3)
    single = df.select(F.lit("x").alias("a"))
    assert single.select(qa.gold_list(F.col("a"), single.schema["a"].dataType)).first()[0] == ["x"]


def test_catalog(spark, tmp_path):
    store = catalog.Catalog(spark, str(tmp_path / "store"))
    states = spark.createDataFrame([("a", i, l, 0, [1.0]) for i in range(4) for l in range(2)], EX + ", layer int, tok_idx int, vec array<float>")
    assert not store.exists("hidden_states")
    store.write("hidden_states", states)
    with pytest.raises(Exception, match="already exists"):
        store.write("hidden_states", states)
    one = store.read("hidden_states", ["a"], layer=1)
    assert one.count() == 4
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "(layer#" in plan and "= 1)], PushedFilters: []" in plan
    with pytest.raises(catalog.EmptyArtefact):
        store.read("hidden_states", ["zzz"], required=True)
    report = store.storage_report("hidden_states").first()
    assert report["files"] >= 2 and report["gigabytes"] > 0
    store.append_new("hidden_states", states.withColumn("row_idx", F.col("row_idx") + 2), ["run_id", "row_idx", "layer"])
    assert store.read("hidden_states").count() == 12
    with pytest.raises(ValueError, match="unknown artefact"):
        store.path("other")
    calls = []

    def build():
        calls.append(1)
        return states.select("run_id", "row_idx").distinct()

    assert store.read_or_build("split", build).count() == 4 and store.read_or_build("split", build).count() == 4
    assert calls == [1]


def test_stored_features(spark, tmp_path):
    df = spark.createDataFrame([("a", 1)], EX)
    store = catalog.Catalog(spark, str(tmp_path / "features"))
    written = store.write_stored_features("attention_diags", {"tokens": df, "diagonals": df, "attentions": df})
    assert written == ["tokens", "diagonals"] and not store.exists("attentions")
    with pytest.raises(ValueError, match="needs"):
        store.write_stored_features("hidden_states", {"tokens": df})
    with pytest.raises(ValueError, match="unknown stored features"):
        store.write_stored_features("everything", {})


@pytest.mark.parametrize(
    "mode,attention,states",
    [
        ("attentions", True, False), ("attention_diags", True, False), ("hidden_states", False, True),
        ("attention_with_hidden_states", True, True), ("hidden_states_for_last_input_last_gen_tokens", False, True),
        ("attention_diags_and_hidden_states_for_last_input_last_gen_tokens", True, True),
    ],
)
def test_run_config(mode, attention, states):
    config = grid.RunConfig("d", "l", "p", mode, 2048, 128, 42)
    assert config.generation_config == {
        "return_dict_in_generate": True, "output_attentions": attention, "output_hidden_states": states,
    }
    assert config.max_input_length == 1920


def test_run_config_refuses_reserved_and_unknown():
    for key in grid.RESERVED:
        with pytest.raises(ValueError, match="not by hand"):
            grid.RunConfig("d", "l", "p", "attentions", 1, 1, 1, generation={key: False})
    with pytest.raises(ValueError, match="unknown stored features"):
        grid.RunConfig("d", "l", "p", "x", 1, 1, 1)
    with pytest.raises(TypeError):
        grid.RunConfig("d", "l", "p", "attentions", 1, 1, 1, surprise=1)


def test_runs_grid(spark):
    runs = grid.runs_grid(spark)
    rows = runs.collect()
    assert len(rows) == 70 == len({r["run_id"] for r in rows})
    row = next(r for r in rows if r["dataset"] == "gsm8k" and r["llm"].startswith("mistral_small") and r["temp"] == "temp_0.1")
    assert row["run_name"] == "temp_0.1__prompt_qa_gsm8k__seed_42" and row["max_input_length"] == 32_000 - 512
    parsed = results.run_metadata(runs.select("run_name"), "run_name").filter(F.col("run_name") == row["run_name"]).first()
    assert (parsed["temp"], parsed["prompt"], parsed["seed"]) == ("0.100", "prompt_qa_gsm8k", "seed_42")


def test_run_metadata(spark):
    df = spark.createDataFrame([("temp_-1.25__p__s",), ("greedy__p__s",), ("t2__p__s",)], "n string")
    assert [r["temp"] for r in results.run_metadata(df, "n").collect()] == ["-1.250", "greedy", "2.000"]
    with pytest.raises(Exception, match="three parts"):
        results.run_metadata(spark.createDataFrame([("a__b",)], "n string"), "n").collect()


def test_names_and_paths(spark):
    df = spark.createDataFrame([("squad_v2",), ("mine",)], "d string")
    assert [r[0] for r in df.select(results.display_name(F.col("d"), results.DATASET_NAMES)).collect()] == ["SQuADv2", "mine"]
    paths = spark.createDataFrame([("/x/data/activations/a/b/c",)], "p string")
    there = paths.select(results.run_path_to_results(F.col("p")).alias("p"))
    assert there.first()[0] == "/x/data/results/a/b/c"
    assert there.select(results.results_path_to_run(F.col("p"))).first()[0] == "/x/data/activations/a/b/c"
    files = spark.createDataFrame([("attn_vs_laplacian_pca_512_results.json",), ("attn_vs_laplacian_results.json",)], "f string")
    assert [r[0] for r in files.select(results.configured_pca_dim(F.col("f"))).collect()] == [512, None]


def test_load_results(spark, tmp_path):
    def record(layer, auc):
        return {"metadata": {"trainable_params": 3, "layer_idx": layer}, "metrics": {"test_auc": auc}, "test_preds": [1, 0]}

    for run, body in (("temp_0.1__p__seed_1", {"per_layer": [record(0, 0.5), record(1, 0.6)]}), ("temp_1__p__seed_1", {"all": record("all", 0.7)})):
        folder = tmp_path / "deep" / run
        folder.mkdir(parents=True)
        (folder / "attn_vs_laplacian_pca_8_results.json").write_text(json.dumps(body))
        (folder / "ignored.json").write_text("{}")
    runs = spark.createDataFrame([("temp_0.1__p__seed_1", "coqa")], "run_name string, dataset string")
    args = (spark, str(tmp_path), "attn_vs_laplacian_pca_8_results.json")
    with pytest.raises(Exception, match="no configuration"):
        results.load_results(*args, runs).collect()
    some = results.load_results(*args, runs, ignore_errors=True).collect()
    assert sorted((r["layer_idx"], r["metrics"]["test_auc"]) for r in some) == [("0", 0.5), ("1", 0.6)]
    assert some[0]["temp"] == "0.100" and some[0]["configured_pca_dim"] == 8 and "test_preds" not in some[0]
    both = runs.union(spark.createDataFrame([("temp_1__p__seed_1", "gsm8k")], runs.schema))
    rows = results.load_results(*args, both, return_preds=True).collect()
    assert len(rows) == 3 and all(r["test_preds"] == [1.0, 0.0] for r in rows)
    old = tmp_path / "deep" / "temp_1__p__seed_1" / "attn_vs_laplacian_pca_8_results.json"
    os.utime(old, (1_000_000_000, 1_000_000_000))
    assert results.load_results(*args, both, modified_after="2020-01-01T00:00:00").count() == 2


def test_results_of_one_run_name_in_several_folders(spark, tmp_path):
    name = "temp_0.1__p__seed_1"
    places = [("coqa", "llama"), ("coqa", "phi"), ("gsm8k", "llama")]
    for n, (dataset, llm) in enumerate(places):
        folder = tmp_path / dataset / llm / name
        folder.mkdir(parents=True)
        (folder / "res.json").write_text(json.dumps({"all": {"metadata": {"layer_idx": "all"}, "metrics": {"auc": n / 10}}}))
    runs = spark.createDataFrame([(d, m, name, d + m) for d, m in places], "dataset string, llm string, run_name string, config string")
    args = (spark, str(tmp_path), "res.json")
    found = results.load_results(*args, runs, identity=("dataset", "llm", "run_name")).collect()
    assert sorted((r["dataset"], r["llm"], r["config"], r["metrics"]["auc"]) for r in found) == [
        (d, m, d + m, n / 10) for n, (d, m) in enumerate(places)
    ]
    with pytest.raises(Exception, match="several runs"):
        results.load_results(*args, runs).collect()
    (tmp_path / "coqa" / "phi" / name / "res.json").write_text('{"all": [')
    with pytest.raises(Exception):  # noqa: B017
        results.load_results(*args, runs, identity=("dataset", "llm", "run_name")).collect()
    assert results.load_results(*args, runs, ignore_errors=True, identity=("dataset", "llm", "run_name")).count() == 2


def test_strict_checks_survive_pruning_and_filters(spark):
    a = spark.createDataFrame([("r", 0, "x"), ("r", 1, "y")], EX + ", a string")
    b = spark.createDataFrame([("r", 0, 1)], EX + ", label int")
    both = joins.zip_strict(a, b)
    for df in (both, both.select("a"), both.filter("label in (0, 1)")):
        with pytest.raises(Exception, match="differ in their keys"):
            df.count()
    gold = spark.createDataFrame([("r", 0, "g"), ("r", 1, "g")], EX + ", answer string")
    with pytest.raises(Exception, match="different order"):
        joins.answers_with_gold(a.withColumn("gold", F.lit("h")), gold).count()


def test_joins(spark):
    a = spark.createDataFrame([("r", 0, "x"), ("r", 1, "y")], EX + ", a string")
    b = spark.createDataFrame([("r", 0, "u"), ("r", 1, "v")], EX + ", b string")
    assert joins.zip_strict(a, b).count() == 2
    with pytest.raises(Exception, match="differ in their keys"):
        joins.zip_strict(a, b.filter("row_idx = 0")).collect()
    with pytest.raises(Exception, match="differ in their keys"):
        joins.zip_strict(a.filter("row_idx = 0"), b).collect()
    assert joins.zip_shortest(a, b.filter("row_idx = 0")).count() == 1
    assert joins.concat_columns(a, b.filter("row_idx = 0")).filter("b IS NULL").count() == 1
    clash = joins.merge(a, b.withColumnRenamed("b", "a")).collect()
    assert {r["a"] for r in clash} == {"u", "v"}
    gold = spark.createDataFrame([("r", 0, "g"), ("r", 1, "g")], EX + ", answer string")
    assert joins.answers_with_gold(a.withColumn("gold", F.lit("g")), gold).count() == 2
    with pytest.raises(Exception, match="different order"):
        joins.answers_with_gold(a.withColumn("gold", F.lit("h")), gold).collect()
    assert joins.concat_rows(a, b).filter("a IS NULL").count() == 2


def test_qa_metrics_table(spark):
    answers = spark.createDataFrame([("r", 0, "p"), ("r", 1, "p")], EX + ", prediction string")
    metrics = spark.createDataFrame([("r", 0, 0.5)], EX + ", squad_f1 double")
    judged = spark.createDataFrame([("r", 0, "gpt-4o", "e", "correct"), ("r", 1, "m", "e", "refuse")], EX + ", judge_llm string, judge_prompt string, verdict string")
    every = catalog.qa_metrics_table(answers, metrics, judged)
    assert {"llm_judge_gpt_4o_e", "llm_judge_m_e"} <= set(every.columns) and every.count() == 2
    one = catalog.qa_metrics_table(answers, metrics, judged, "m", "e")
    assert "llm_judge_m_e" in one.columns and "llm_judge_gpt_4o_e" not in one.columns
    with pytest.raises(ValueError, match="neither"):
        judge.judge_key("m", None)


def test_single_layer_with_tokens(spark):
    states = spark.createDataFrame([("r", i, l, t, [float(10 * i + t)]) for i in range(2) for l in range(2) for t in range(4)], "run_id string, row_idx long, layer int, tok_idx int, vec array<double>")
    facts = [spark.createDataFrame([("r", i, v) for i, v in enumerate(values)], f"run_id string, row_idx long, {name}") for name, values in (
        ("prediction string", "ab"), ("squad_f1 double", [0.0, 1.0]), ("verdict string", "cd"), ("label int", [0, 1]))]
    tokens = spark.createDataFrame([("r", 0, [0, 5, 0, 6, 7], 3), ("r", 1, [4, 5, 6, 7, 0], 3)], "run_id string, row_idx long, token_ids array<int>, input_length int")
    plain = catalog.single_layer_dataset(states, *facts, layer=1, tokens=tokens).collect()
    assert len(plain) == 8 and {(r["row_idx"], tuple(r["gen_tokens"]), r["last_input_token_idx"]) for r in plain} == {(0, (0, 5, 0, 6, 7), 2), (1, (4, 5, 6, 7, 0), 2)}
    cut = catalog.single_layer_dataset(states, *facts, layer=1, tokens=tokens, remove_padding=True, pad=0).collect()
    # state i belongs to token i + 1; of the first three of these the pads move the last input position
    assert {(r["row_idx"], r["tok_idx"], r["vec"][0]) for r in cut} == {(0, 0, 0.0), (0, 1, 2.0), (0, 2, 3.0), (1, 0, 10.0), (1, 1, 11.0), (1, 2, 12.0)}
    assert {(r["row_idx"], tuple(r["gen_tokens"]), r["last_input_token_idx"]) for r in cut} == {(0, (5, 6, 7), 1), (1, (5, 6, 7), 2)}
    with pytest.raises(ValueError, match="padding"):
        catalog.single_layer_dataset(states, *facts, layer=1, remove_padding=True, pad=0)

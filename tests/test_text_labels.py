import random
import re
import tracemalloc
from collections import Counter

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from attnloom.functions import text as X
from attnloom.operators import judge, labels, overlap
from attnloom.sources.prompts import JUDGE_PROMPTS, QA_PROMPTS
from attnloom.sources import qa

ANSWERS = "run_id string, row_idx long, question string, prediction string, gold array<string>"


def brute_lcs(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abcd"), max_size=70), st.lists(st.sampled_from("abcd"), max_size=70))
def test_lcs(a, b):
    assert X._lcs(a, b) == brute_lcs(a, b)


def python_normalize(s):
    s = "".join(c for c in s.lower() if c not in '!"#$%&\'()*+,-./:;<=>?@[\\]^_`{|}~')
    return " ".join(re.sub(r"\b(a|an|the)\b", " ", s).split())


TEXTS = ["The cat, a dog & an owl!", "  A  ", "l’a bannière", "ça va à la mer", "the-theme then An apple\n", "", "3.5% of the U.S."]


def test_normalize_matches_the_public_definition(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string").select("t", X.normalize_answer(F.col("t")).alias("n"))
    assert {r["t"]: r["n"] for r in df.collect()} == {t: python_normalize(t) for t in TEXTS}


def test_squad_metrics_against_counters(spark):
    rng = random.Random(4)
    vocabulary = ["red", "The", "blue,", "a", "cat", "dog!"]
    rows = []
    for i in range(60):
        text = lambda: " ".join(rng.choices(vocabulary, k=rng.randint(0, 9)))
        rows.append(("r", i, "q", text(), [text() for _ in range(rng.randint(1, 3))]))
    got = {r["row_idx"]: (r["squad_f1"], r["squad_exact"]) for r in overlap.squad_metrics(spark.createDataFrame(rows, ANSWERS)).collect()}
    for _, i, _, pred, golds in rows:
        best = 0.0
        for g in golds:
            p, t = python_normalize(pred).split(), python_normalize(g).split()
            same = sum((Counter(p) & Counter(t)).values())
            best = max(best, 1.0 if not p and not t else 2 * same / (len(p) + len(t)))
        assert got[i][0] == pytest.approx(best)
        assert got[i][1] == float(any(python_normalize(pred) == python_normalize(g) for g in golds))


class _Session:
    """Takes a function instead of making it a UDF."""

    @staticmethod
    def arrow_udf(kind):
        return lambda function: function


def test_overlaps_hold_few_tokens_as_objects(monkeypatch):
    """A batch of 10,000 rows is compared a few rows at a time, also with null texts, no texts, slices and 2-grams."""
    chance = random.Random(3)
    monkeypatch.setattr(X.F, "arrow_udf", _Session.arrow_udf)

    def text(n):
        return " ".join(["", "a"][chance.randrange(2) :] + [f"t{chance.randrange(9)}" for _ in range(chance.randrange(n))])

    left = [None, "", "a b a"] + [text(30) for _ in range(600)] + [" ".join(f"long{k}" for k in range(40000))]
    right = [["b", None], [""], ["a a b", None, ""]] + [[text(30) for _ in range(chance.randrange(4))] for _ in range(600)] + [["long7 long8"]]
    columns = pa.array(["x"] + left).slice(1), pa.array([["x"]] + right).slice(1)

    def grams(t, n):
        w = (t or "").split()
        return Counter(tuple(w[k : k + n]) for k in range(len(w) - n + 1))

    for n in (1, 2):
        got = X.bag_overlaps(*columns, n)
        assert got.type == pa.list_(pa.int32())
        assert got.to_pylist() == [[(grams(a, n) & grams(b, n)).total() for b in many] for a, many in zip(left, right)]
    got = X.lcs_lengths.func(columns[0].slice(3), columns[1].slice(3)).to_pylist()
    assert got == [[X._lcs(a.split(), b.split()) for b in many] for a, many in zip(left[3:], right[3:])]
    short = " ".join(f"t{k}" for k in range(60))
    batch = pa.array([short] * 10000), pa.array([[short, short]] * 10000)
    tracemalloc.start()
    try:
        assert X.bag_overlaps(*batch, 2).to_pylist() == [[59, 59]] * 10000
        assert tracemalloc.get_traced_memory()[1] < 8 << 20
    finally:
        tracemalloc.stop()


def test_overlaps_send_texts_and_no_arrays_of_tokens(spark):
    """The Python workers get one copy of the text, whatever the n-grams."""
    df = spark.createDataFrame([("r", 0, "q", "the a b", ["a b"])], ANSWERS)
    for metric in (overlap.rouge_n(df, 2), overlap.rouge_l(df), overlap.squad_metrics(df)):
        plan = metric._jdf.queryExecution().executedPlan().toString()
        assert "ArrowEvalPython" in plan and "array_join" not in plan
        udf = re.search(r"ArrowEvalPython \[\w+\((_p#\d+), (_g#\d+)\)", plan)
        assert udf, plan


def test_rouge(spark):
    rows = [
        ("r", 0, "q", "police killed the gunman", ["the gunman police killed", "police kill the gunman"]),
        ("r", 1, "q", "", ["x"]),
        ("r", 2, "q", "one", ["one two one"]),
    ]
    df = spark.createDataFrame(rows, ANSWERS)
    l = {r["row_idx"]: r["rougeL_fmeasure"] for r in overlap.rouge_l(df).collect()}
    assert l == pytest.approx({0: 0.75, 1: 0.0, 2: 0.5})
    two = {r["row_idx"]: r["rouge2_fmeasure"] for r in overlap.rouge_n(df, 2).collect()}
    assert two == pytest.approx({0: 2 / 3, 1: 0.0, 2: 0.0})
    everything = overlap.qa_metrics(df)
    assert {"squad_f1", "rouge1_fmeasure", "rouge2_recall", "rougeL_precision"} <= set(everything.columns)
    means = overlap.reduced(everything).first()
    assert means["rougeL_fmeasure"] == pytest.approx(1.25 / 3)


@pytest.mark.parametrize("value", ["plain", "it's", 'say "x"', "both ' and \"", "back\\slash", "line\nbreak\ttab\r"])
def test_quote_python(spark, value):
    assert spark.createDataFrame([(value,)], "t string").select(X.quote_python(F.col("t"))).first()[0] == repr(value)


def test_render_list(spark):
    values = ["a", "it's"]
    assert spark.createDataFrame([(values,)], "t array<string>").select(X.render_list(F.col("t"))).first()[0] == str(values)


def test_prompts(spark):
    question = "why {question} {{gold_answer}}?"
    df = spark.createDataFrame([("r", 0, question)], "run_id string, row_idx long, question string")
    for prompt in QA_PROMPTS.values():
        message = qa.format_questions(df, prompt).first()["messages"]
        assert [m["role"] for m in message] == ["user"]
        assert message[0]["content"] == prompt.content.format(question=question)
    with pytest.raises(ValueError):
        qa.prompt_messages(QA_PROMPTS["gsm8k"].__class__("{question}", context_key="context"), F.col("question"))
    with pytest.raises(ValueError, match="no value"):
        X.fill_braces("{other}", question=F.lit("x"))


def test_judge_requests(spark):
    df = spark.createDataFrame([("r", 0, "q {{gold_answer}}", "p", ["g1", "g2"])], ANSWERS)
    asked = judge.judge_requests(df, JUDGE_PROMPTS["qa_eval"]).first()
    assert [m["role"] for m in asked["messages"]] == ["system", "user"]
    content = asked["messages"][1]["content"]
    assert "Question: 'q {{gold_answer}}'" in content and "Gold Answer '['g1', 'g2']'" in content
    assert content.endswith("Assessment:")
    one = judge.judge_requests(df, JUDGE_PROMPTS["qa_orgad_et_al_eval"]).first()["messages"]
    assert len(one) == 1 and one[0]["content"].endswith("Correctness:")
    per_gold = judge.judge_requests_per_gold(df, JUDGE_PROMPTS["qa_multi_answers_eval_short"])
    assert per_gold.count() == 2
    assert JUDGE_PROMPTS["qa_eval"].unknown_priorities(("correct", "partial_correct", "incorrect", "not_known")) == ["refuse"]


def test_cache_and_usage(spark):
    requests = spark.createDataFrame([(i, k) for i, k in enumerate("aabbc")], "row_idx int, request_key string").withColumn(
        "messages", F.array(F.struct(F.lit("user").alias("role"), F.col("request_key").alias("content")))
    )
    cache = spark.createDataFrame([("a", "correct")], "request_key string, verdict string")
    assert sorted(r["request_key"] for r in judge.uncached(requests, cache).collect()) == ["b", "c"]
    filled = {r["row_idx"]: r["verdict"] for r in judge.fill_from_cache(requests, cache).collect()}
    assert filled == {0: "correct", 1: "correct", 2: None, 3: None, 4: None}
    usage = spark.createDataFrame(
        [("r", (10, 1, 2), "stop"), ("r", (5, 1, 0), "length"), ("r", (1, 1, 0), "stop")],
        "run_id string, usage struct<input_tokens:long,output_tokens:long,cache_read:long>, finish_reason string",
    )
    row = judge.usage_summary(usage).first()
    assert row["total_api_calls"] == 3 and row["total_input_tokens"] == 16 and row["total_cached_input_tokens"] == 2
    assert row["finish_reason_counts"] == {"stop": 2, "length": 1}


def test_verdict_priority(spark):
    rows = [("r", 0, v) for v in ("correct", "refuse", "incorrect")] + [("r", 1, "unclear")]
    df = spark.createDataFrame(rows, "run_id string, row_idx long, verdict string")
    first = {r["row_idx"]: r["verdict"] for r in judge.combine_verdicts(df, ("correct", "incorrect", "refuse")).collect()}
    assert first == {0: "correct", 1: None}
    other = {r["row_idx"]: r["verdict"] for r in judge.combine_verdicts(df, ("refuse", "correct", "incorrect")).collect()}
    assert other[0] == "refuse"
    arrays = df.groupBy("row_idx").agg(F.collect_list("verdict").alias("v"))
    same = {r[0]: r[1] for r in arrays.select("row_idx", judge.combined(F.col("v"), ("correct", "incorrect", "refuse"))).collect()}
    assert same == first


def test_label_rule(spark):
    cases = [
        (0.99, 0.0, "incorrect", 0), (0.0, 0.995, "refuse", 0), (0.5, 0.75, "incorrect", -1), (0.5, 0.74, "incorrect", 1),
        (0.1, 0.8, "correct", 0), (0.1, 0.1, "correct", 0), (0.1, 0.1, "refuse", -1), (0.1, 0.1, None, -1),
    ]
    judged = spark.createDataFrame([("r", i, c[2]) for i, c in enumerate(cases)], "run_id string, row_idx long, verdict string")
    measured = spark.createDataFrame(
        [("r", i, c[0], c[1]) for i, c in enumerate(cases)], "run_id string, row_idx long, squad_f1 double, rougeL_fmeasure double"
    )
    got = {r["row_idx"]: (r["label"], r["valid"]) for r in labels.judge_labels(judged, measured).collect()}
    assert got == {i: (c[3], c[3] != -1) for i, c in enumerate(cases)}


def test_maths_answers(spark):
    def python_final(text):
        match = re.search(labels.FINAL_ANSWER, text)
        if not match:
            return None
        found = match.group(1)
        for pattern in labels.IGNORED:
            found = re.sub(pattern, "", found)
        return found.strip()

    texts = [
        "The final answer is $1,200.", "The final answer is 7", "The final answer is -3.5.", "nothing", "The final answer is x",
        "a The final answer is 12 and The final answer is 13", "The final answer is ..", "The final answer is $5",
    ]
    df = spark.createDataFrame([(t, "x #### 12 #### 3 ") for t in texts], "prediction string, answer string")
    rows = df.select("prediction", labels.final_answer(F.col("prediction")).alias("f"), labels.exact_answer(F.col("answer")).alias("e")).collect()
    for r in rows:
        assert r["f"] == python_final(r["prediction"]), r["prediction"]
        assert r["e"] == "12 #### 3"
    assert spark.sql("SELECT 'no mark' a").select(labels.exact_answer(F.col("a"))).first()[0] == ""

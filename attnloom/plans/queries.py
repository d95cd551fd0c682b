"""Registered queries: operators over the model tables, flattened to scalar rows."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..operators import attention as G
from ..operators import hidden, joins, judge, labels, metrics, overlap, padding, pca, probe, sampling, spectral
from ..schema import EXAMPLE, HEAD, RUN
from ..session import cut_lineage, scratch_path
from ..sources import catalog, qa, results
from ..sources.prompts import JUDGE_PROMPTS, QA_PROMPTS
from ..streaming import features as stream
from . import features, studies
from . import views as V

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _r(name: str, alias: str | None = None):
    return A.rounded(F.col(name)).alias(alias or name)


# ---------------------------------------------------------------- attention maps


@query
def attn_score_auc_by_layer(spark, sf):
    """AUC of the attention score per run and layer, over valid labels."""
    scores = spectral.attention_score(G.diagonals(V.attention(spark, sf)))
    scored = scores.join(labels.valid_only(V.labels(spark, sf)), EXAMPLE)
    ranked = metrics.ranking_metrics(scored, ["run_id", "layer"], "label", "attn_score")
    return ranked.select("run_id", "layer", "n_pos", "n_neg", _r("auc"))


@query
def attn_score_eval(spark, sf):
    """AUC and AP of the attention score per layer and over all layers, on both parts of the split."""
    scores = spectral.attention_score_with_all(G.diagonals(V.attention(spark, sf)))
    lab = V.labels(spark, sf)
    split = sampling.stratified_split(lab, order=V.ARITHMETIC)
    scored = scores.join(split, EXAMPLE)
    ranked = metrics.score_only_metrics(scored, ["run_id", "layer", "part"], "label", "attn_score")
    return ranked.select("run_id", "layer", "part", "n_pos", "n_neg", _r("auc"), _r("average_precision"))


@query
def attn_diag(spark, sf):
    d = G.diagonals(V.attention(spark, sf))
    return d.select(*HEAD, F.posexplode("attn_diag").alias("k", "w")).select(*HEAD, "k", _r("w"))


@query
def lap_diag(spark, sf):
    d = G.diagonals(V.attention(spark, sf))
    return d.select(*HEAD, F.posexplode("lap_diag").alias("k", "w")).select(*HEAD, "k", _r("w", "lap"))


@query
def lap_diag_vertical(spark, sf):
    d = G.diagonals(V.attention(spark, sf), vertical_weight=1.0)
    return d.select(*HEAD, F.posexplode("lap_diag").alias("k", "w")).select(*HEAD, "k", _r("w", "lap"))


@query
def diagonals_from_steps(spark, sf):
    """Both diagonals from decoding steps in edge form, one aggregate."""
    d = G.diagonals_from_edges(G.steps_to_edges(V.attention_steps(spark, sf)))
    return d.select(*HEAD, "k", _r("attn"), _r("lap"))


@query
def lap_diag_refined(spark, sf):
    d = G.refined_diagonal(V.attention(spark, sf))
    return d.select(*HEAD, F.posexplode("lap_diag_refined").alias("k", "w")).select(*HEAD, "k", _r("w", "lap"))


@query
def full_laplacian_edges(spark, sf):
    edges = G.full_laplacian(G.to_edges(V.attention(spark, sf)))
    return edges.select(*EXAMPLE, "head", "r", "c", _r("value"))


@query
def attn_log_det(spark, sf):
    return spectral.log_det(G.diagonals(V.attention(spark, sf))).select(*HEAD, _r("log_det"))


@query
def attn_log_det_features(spark, sf):
    """Log-determinants of all layers as one vector per example."""
    flat = spectral.flatten_features(spectral.log_det(G.diagonals(V.attention(spark, sf))), "log_det")
    return flat.select(*EXAMPLE, F.posexplode("features").alias("pos", "v")).select(*EXAMPLE, "pos", _r("v"))


@query
def attn_topk(spark, sf):
    flat = spectral.flatten_features(spectral.top_k(G.diagonals(V.attention(spark, sf)), 2, "attn_diag"), "vals")
    return flat.select(*EXAMPLE, F.posexplode("features").alias("pos", "v")).select(*EXAMPLE, "pos", _r("v"))


@query
def lap_topk(spark, sf):
    flat = spectral.flatten_per_layer(spectral.top_k(G.diagonals(V.attention(spark, sf)), 2, "lap_diag"), "vals")
    return flat.select(*EXAMPLE, "layer", F.posexplode("features").alias("pos", "v")).select(
        *EXAMPLE, "layer", "pos", _r("v")
    )


@query
def lap_topk_stats(spark, sf):
    stats = spectral.top_k_stats(G.diagonals(V.attention(spark, sf)), 2)
    named = [A.rounded(F.get(F.col("stats"), F.lit(i))).alias(n) for i, n in enumerate(A.STAT_NAMES)]
    return stats.select(*HEAD, *named)


@query
def eligible_topk(spark, sf):
    return spectral.eligible_top_k(G.diagonals(V.attention(spark, sf)), candidates=(1, 2, 3, 4, 5))


# ---------------------------------------------------------------- padding and stacking


@query
def strip_edge_padding(spark, sf):
    s = padding.strip_edge_padding(V.tokens(spark, sf), 0)
    return s.select(
        *EXAMPLE, "first", "last", F.array_join(F.transform("token_ids", lambda t: t.cast("string")), " ").alias("ids")
    )


@query
def strip_all_padding(spark, sf):
    s = padding.strip_all_padding(V.tokens(spark, sf), 0)
    return s.select(
        *EXAMPLE,
        "last_input_idx",
        F.size("kept").alias("n_kept"),
        F.array_join(F.transform("kept", lambda t: t["token_id"].cast("string")), " ").alias("ids"),
    )


@query
def strip_hidden_states(spark, sf):
    """Hidden states without padding, renumbered; token ids below 5 play the pad."""
    toks = V.state_tokens(spark, sf).withColumn(
        "token_ids", F.transform("token_ids", lambda t: F.when(t % 5 == 0, 0).otherwise(t))
    )
    s = padding.strip_hidden_states(V.hidden_states(spark, sf), toks, 0)
    return s.select(*EXAMPLE, "layer", "tok_idx", "token_id", "last_input_idx", F.posexplode("vec").alias("dim", "v")).select(
        *EXAMPLE, "layer", "tok_idx", "token_id", "last_input_idx", "dim", A.rounded(F.col("v").cast("double")).alias("v")
    )


@query
def strip_attention_padding(spark, sf):
    matrices, toks = V.padded_attention(spark, sf)
    edges = G.to_edges(G.strip_padding(matrices, toks, 0)).filter(F.col("w") != 0)
    return edges.select(*HEAD, "q", "k", "n", _r("w"))


@query
def strip_attention_padding_edges(spark, sf):
    matrices, toks = V.padded_attention(spark, sf)
    edges = G.strip_padding_edges(G.to_edges(matrices), toks, 0).filter(F.col("w") != 0)
    return edges.select(*HEAD, "q", "k", "n", _r("w"))


@query
def stack_attention(spark, sf):
    return G.to_edges(G.stack_steps(V.attention_steps(spark, sf))).select(*HEAD, "q", "k", "n", _r("w"))


# ---------------------------------------------------------------- hidden states


def _vectors(df: DataFrame, *keys: str) -> DataFrame:
    wide = df.select(*keys, F.posexplode("vec").alias("dim", "v"))
    return wide.select(*keys, "dim", A.rounded(F.col("v").cast("double")).alias("v"))


@query
def layer_states(spark, sf):
    """States stored per decoding step, put back into one sequence per layer."""
    step = F.greatest(F.col("tok_idx") - 2, F.lit(0))
    steps = V.hidden_states(spark, sf).select(
        *EXAMPLE, "layer", step.alias("gen_step"), (F.col("tok_idx") - step).alias("idx_in_step"), "vec"
    )
    return _vectors(hidden.states_by_layer(steps), *EXAMPLE, "layer", "tok_idx")


@query
def select_last_token_states(spark, sf):
    toks = hidden.token_masks(V.state_tokens(spark, sf), V.SPECIAL_IDS, V.ADDED_IDS)
    chosen = hidden.select_last_tokens(V.hidden_states(spark, sf), toks)
    return _vectors(chosen, *EXAMPLE, "layer", "which", "tok_idx")


@query
def last_layer_features(spark, sf):
    """Feature vectors of both reference tokens from the last layer only."""
    toks = hidden.token_masks(V.state_tokens(spark, sf), V.SPECIAL_IDS, V.ADDED_IDS)
    flat = hidden.token_features(hidden.select_last_tokens(V.hidden_states(spark, sf), toks, "last"))
    return _vectors(flat.withColumnRenamed("features", "vec"), *EXAMPLE, "which")


@query
def token_masks(spark, sf):
    toks = hidden.token_masks(V.state_tokens(spark, sf), V.SPECIAL_IDS, V.ADDED_IDS)
    zipped = F.arrays_zip("token_ids", "special_mask", "added_mask")
    return toks.select(*EXAMPLE, F.posexplode(zipped).alias("pos", "t")).select(
        *EXAMPLE,
        "pos",
        F.col("t.token_ids").alias("token_id"),
        F.col("t.special_mask").alias("is_special"),
        F.col("t.added_mask").alias("is_added"),
    )


@query
def single_layer_dataset(spark, sf):
    """Hidden states of layer 1 with answers, metrics, verdict and label of the same example."""
    lab = V.labels(spark, sf)
    ans = lab.select(*EXAMPLE, F.concat(F.lit("p"), F.col("row_idx").cast("string")).alias("prediction"))
    met = lab.select(*EXAMPLE, (F.col("row_idx") % 7 / 7).alias("squad_f1"))
    jud = lab.select(*EXAMPLE, F.when(F.col("label") == 1, "incorrect").otherwise("correct").alias("verdict"))
    one = catalog.single_layer_dataset(V.hidden_states(spark, sf), ans, met, jud, lab, layer=1, valid=True)
    return one.select(
        *EXAMPLE, "layer", "tok_idx", "prediction", _r("squad_f1"), "verdict", "label",
        A.rounded(A.total(F.transform("vec", lambda x: x.cast("double")))).alias("vec_sum"),
    )


@query
def single_layer_stripped(spark, sf):
    """States of layer 1 without padding, with the kept tokens and the last input position; ids below 5 play the pad."""
    lab = V.labels(spark, sf)
    ans = lab.select(*EXAMPLE, F.concat(F.lit("p"), F.col("row_idx").cast("string")).alias("prediction"))
    met = lab.select(*EXAMPLE, (F.col("row_idx") % 7 / 7).alias("squad_f1"))
    jud = lab.select(*EXAMPLE, F.when(F.col("label") == 1, "incorrect").otherwise("correct").alias("verdict"))
    toks = V.state_tokens(spark, sf).withColumn("token_ids", F.transform("token_ids", lambda t: F.when(t % 5 == 0, 0).otherwise(t)))
    one = catalog.single_layer_dataset(V.hidden_states(spark, sf), ans, met, jud, lab, layer=1, valid=True, tokens=toks, remove_padding=True, pad=0)
    return one.select(
        *EXAMPLE, "layer", "tok_idx", "label", F.array_join(F.col("gen_tokens").cast("array<string>"), ",").alias("gen_tokens"),
        F.col("last_input_token_idx").cast("int").alias("last_input_token_idx"),
        A.rounded(A.total(F.transform("vec", lambda x: x.cast("double")))).alias("vec_sum"),
    )


# ---------------------------------------------------------------- ranking metrics


@query
def size_study_summary(spark, sf):
    """Mean and deviation over seeds of the AUC on shares of the examples, summed up as in the size study."""
    cells = F.explode(F.array(*[F.struct(F.lit(f).alias("frac"), F.lit(s).alias("seed")) for f in (0.5, 1.0) for s in (0, 1, 2)])).alias("c")
    scored = V.scores(spark, sf).select("run_id", "row_idx", "label", "score", cells).select("run_id", "row_idx", "label", "score", "c.*")
    drawn = scored.filter((F.col("frac") == 1.0) | ((F.col("row_idx") + F.col("seed")) % 3 < 2))
    auc = metrics.ranking_metrics(drawn, ["run_id", "frac", "seed"], "label", "score", single_class="null")
    return studies.size_summary(auc.select("run_id", F.lit("score").alias("probe"), "frac", F.col("auc").alias("test_auc")))


@query
def halueval_questions(spark, sf):
    """JSON lines of another layout written from documents, read as a question set and formatted as prompts."""
    root = scratch_path(spark, "halueval")
    docs = V.table(spark, sf, "documents").filter("text is not null")
    lines = docs.select(F.col("lang").alias("knowledge"), F.substring("text", 1, 60).alias("question"), F.col("source").alias("right_answer"), F.lit("x").alias("hallucinated_answer"))
    lines.write.json(root)
    shaped = qa.prepare_dataset(spark, qa.dataset("halueval_qa", root), QA_PROMPTS["short_zero_shot"])
    return shaped.select("question", "answer", F.size("messages").alias("n_messages"), F.col("messages")[0]["content"].alias("content"))


@query
def nq_open_default_split(spark, sf):
    """A columnar question set partitioned by split, read without naming one: the default split is pruned to."""
    root = scratch_path(spark, "nq-open")
    items = V.table(spark, sf, "benchmark").filter("text is not null")
    rows = items.select("item_id", F.substring("text", 1, 40).alias("question"), F.array(F.substring("text", 1, 5)).alias("answer"),
                        F.when(F.col("item_id") % 3 == 0, "validation").otherwise("train").alias("split"))
    rows.write.partitionBy("split").parquet(root)
    read = qa.read_dataset(spark, qa.dataset("nq_open", root), default_split=True)
    return read.select("item_id", "question", F.col("answer")[0].alias("first_answer"), "split")


@query
def stored_answers_json(spark, sf):
    """Answers written as JSON lines and read back under their schema."""
    root = scratch_path(spark, "answers")
    docs = V.table(spark, sf, "documents").select(F.col("doc_id").alias("row_idx"), F.col("source").alias("prediction"), F.array("lang", "source").alias("gold"))
    docs.write.json(f"{root}/answers.jsonl")
    read = catalog.json_table(spark, f"{root}/answers.jsonl", "row_idx long, prediction string, gold array<string>")
    return read.select("row_idx", "prediction", F.array_join("gold", "|").alias("gold"))


@query
def score_auc_ap(spark, sf):
    ranked = metrics.ranking_metrics(V.scores(spark, sf), RUN, "label", "score", single_class="null")
    return ranked.select("run_id", "n_pos", "n_neg", _r("auc"), _r("average_precision"))


@query
def confusion_metrics(spark, sf):
    m = metrics.threshold_metrics(V.scores(spark, sf), RUN, "label", "pred")
    return m.select("run_id", "tp", "fp", "fn", _r("precision"), _r("recall"), _r("f1"))


# ---------------------------------------------------------------- questions, answers, judges


@query
def qa_prompts(spark, sf):
    """Chat messages of every question under every question prompt."""
    asked = V.user_turns(spark, sf).select(*EXAMPLE, "question")
    parts = [
        qa.format_questions(asked, prompt).select(*EXAMPLE, F.lit(name).alias("prompt"), F.inline("messages"))
        for name, prompt in QA_PROMPTS.items()
    ]
    return joins.concat_rows(*parts)


@query
def judge_messages(spark, sf):
    """Judge requests after a strict zip of questions and answers."""
    ans = V.answers(spark, sf)
    zipped = joins.zip_strict(ans.select(*EXAMPLE, "question"), ans.select(*EXAMPLE, "prediction", "gold"))
    parts = [
        judge.judge_requests(zipped, JUDGE_PROMPTS[name]).select(
            *EXAMPLE, F.lit(name).alias("judge_prompt"), "request_key", F.posexplode("messages").alias("pos", "m")
        ).select(*EXAMPLE, "judge_prompt", "request_key", "pos", "m.role", "m.content")
        for name in ("qa_eval", "qa_orgad_et_al_eval")
    ]
    return joins.concat_rows(*parts)


@query
def judge_requests_per_gold(spark, sf):
    asked = judge.judge_requests_per_gold(V.answers(spark, sf), JUDGE_PROMPTS["qa_multi_answers_eval_short"])
    return asked.select(*EXAMPLE, "gold_idx", "request_key", F.col("messages")[0]["content"].alias("content"))


@query
def combine_verdicts(spark, sf):
    """One verdict out of one per gold answer."""
    per_gold = V.answers(spark, sf).select(*EXAMPLE, F.posexplode("gold").alias("gold_idx", "_g"))
    choice = F.expr("((row_idx + gold_idx) div 2) % 4")
    verdict = F.when(choice == 0, "correct").when(choice == 2, "refuse").when(choice == 3, "unclear").otherwise("incorrect")
    return judge.combine_verdicts(per_gold.withColumn("verdict", verdict), ("correct", "incorrect", "refuse"))


def _cache(spark, sf, requests):
    """Requests about long predictions are answered already."""
    long_ones = V.answers(spark, sf).filter(F.length("prediction") > 800).select(*EXAMPLE)
    verdict = V.judge(spark, sf).select(*EXAMPLE, "verdict")
    known = requests.join(long_ones, EXAMPLE).join(verdict, EXAMPLE)
    return known.groupBy("request_key").agg(F.max("verdict").alias("verdict"))


@query
def uncached_judge_requests(spark, sf):
    requests = judge.judge_requests(V.answers(spark, sf), JUDGE_PROMPTS["qa_eval"])
    left = judge.uncached(requests, _cache(spark, sf, requests))
    return left.select("request_key", F.size("messages").alias("n_messages"))


@query
def cached_judge_verdicts(spark, sf):
    requests = judge.judge_requests(V.answers(spark, sf), JUDGE_PROMPTS["qa_eval"])
    return judge.fill_from_cache(requests, _cache(spark, sf, requests)).select(*EXAMPLE, "request_key", "verdict")


@query
def judge_usage(spark, sf):
    u = judge.usage_summary(V.judge(spark, sf))
    counts = F.col("finish_reason_counts")
    return u.select(
        "run_id", "total_api_calls", "total_input_tokens", "total_output_tokens", "total_cached_input_tokens",
        F.coalesce(F.try_element_at(counts, F.lit("stop")), F.lit(0)).alias("n_stop"),
        F.coalesce(F.try_element_at(counts, F.lit("length")), F.lit(0)).alias("n_length"),
    )


@query
def squad_f1(spark, sf):
    m = overlap.squad_metrics(V.answers(spark, sf))
    return m.select(*EXAMPLE, _r("squad_f1"), "squad_exact")


@query
def rouge_l(spark, sf):
    m = overlap.rouge_l(V.answers(spark, sf))
    return m.select(*EXAMPLE, _r("rougeL_fmeasure"))


@query
def rouge_n(spark, sf):
    one, two = (overlap.rouge_n(V.answers(spark, sf), n) for n in (1, 2))
    return joins.merge(one, two).select(*EXAMPLE, _r("rouge1_fmeasure"), _r("rouge2_fmeasure"))


@query
def qa_metrics_reduced(spark, sf):
    ans = V.answers(spark, sf)
    both = joins.merge(overlap.squad_metrics(ans), overlap.rouge_l(ans).select(*EXAMPLE, "rougeL_fmeasure"))
    means = overlap.reduced(both)
    return means.select("run_id", _r("squad_f1"), _r("squad_exact"), _r("rougeL_fmeasure"))


@query
def labels_judge(spark, sf):
    ans = V.answers(spark, sf)
    both = joins.merge(overlap.squad_metrics(ans), overlap.rouge_l(ans))
    return labels.judge_labels(V.verdicts(ans), both)


@query
def labels_gsm8k(spark, sf):
    """Labels of maths answers after a right join to the gold table with its equality check."""
    aligned = joins.answers_with_gold(V.maths_answers(spark, sf), V.maths_gold(spark, sf))
    return labels.exact_match_labels(aligned.withColumnRenamed("gold", "answer"))


@query
def gsm8k_accuracy(spark, sf):
    aligned = joins.answers_with_gold(V.maths_answers(spark, sf), V.maths_gold(spark, sf))
    s = labels.label_summary(labels.exact_match_labels(aligned.withColumnRenamed("gold", "answer")))
    return s.select("run_id", "n_missing", "n_incorrect", "n_correct", _r("accuracy"))


# ---------------------------------------------------------------- sampling


@query
def stratified_split(spark, sf):
    return sampling.stratified_split(V.labels(spark, sf), order=V.ARITHMETIC)


@query
def split_stats(spark, sf):
    return sampling.split_statistics(sampling.stratified_split(V.labels(spark, sf), order=V.ARITHMETIC))


@query
def train_fraction(spark, sf):
    split = sampling.stratified_split(V.labels(spark, sf), order=V.ARITHMETIC)
    return sampling.train_fractions(split, (0.1, 0.5, 1.0), (42, 123), order=V.ARITHMETIC)


@query
def balanced_sample(spark, sf):
    return sampling.balanced_samples(V.labels(spark, sf), 40, (42, 123, 456), order=V.ARITHMETIC)


@query
def length_sort(spark, sf):
    d = V.table(spark, sf, "documents").select(F.col("doc_id").alias("row_idx"), "text")
    return sampling.length_order(d, "text")


PERTURBATION_STDS = (1e-3, 1e-1, None)


@query
def perturbation_l2(spark, sf):
    items = sampling.perturb(
        G.diagonals(V.attention(spark, sf)), PERTURBATION_STDS, 2, uniform=V.arithmetic_uniform
    )
    sizes = sampling.perturbation_size(items)
    return sizes.select("run_id", "std", "rep", _r("avg_diff_l2_norm"), _r("avg_perturbation_fraction"))


@query
def perturbation_stats(spark, sf):
    """Spread of the share of perturbed cells over all perturbed settings."""
    items = sampling.perturb(
        G.diagonals(V.attention(spark, sf)), PERTURBATION_STDS, 2, uniform=V.arithmetic_uniform
    )
    summary = sampling.perturbation_summary(sampling.perturbation_size(items))
    return summary.select(*[A.rounded(F.col(c), 5).alias(c) for c in ("mean", "min", "max", "std")])


# ---------------------------------------------------------------- sources


@query
def flatten_coqa(spark, sf):
    """Nested conversations with three extra answer lists, flattened to questions."""
    a = V.answers(spark, sf).select("conv_id", "turn", "question", "prediction")
    turns = F.array_sort(F.collect_list(F.struct("turn", "question", "prediction")))
    nested = a.groupBy("conv_id").agg(turns.alias("t"))

    def texts(f):
        return F.transform("t", lambda x: F.struct(f(x).alias("input_text")))

    conversations = nested.select(
        F.col("conv_id").alias("sample_idx"),
        F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("id"),
        F.col("t")[0]["question"].alias("story"),
        texts(lambda x: x["question"]).alias("questions"),
        texts(lambda x: x["prediction"]).alias("answers"),
        F.struct(
            texts(lambda x: F.concat(F.lit("+"), x["prediction"])).alias("0"),
            texts(lambda x: F.lower(x["prediction"])).alias("1"),
            texts(lambda x: F.reverse(x["question"])).alias("2"),
        ).alias("additional_answers"),
    )
    flat = qa.flatten_conversations(conversations)
    return flat.select("sample_idx", "id", "story", "question", "answer", F.array_join("additional_answers", "|").alias("additional"))


@query
def flatten_squad(spark, sf):
    """Nested articles flattened to answerable questions with distinct answers."""
    a = V.answers(spark, sf)
    gold = F.transform(F.array_append("gold", F.get("gold", F.lit(0))), lambda g: F.struct(g.alias("text"), F.length(g).alias("answer_start")))
    qa_struct = F.struct(
        F.concat(F.lit("q"), F.col("row_idx").cast("string")).alias("id"),
        "question",
        (F.length("question") > F.length("prediction")).alias("is_impossible"),
        gold.alias("answers"),
    )
    paragraph = F.struct("turn", F.struct(F.col("prediction").alias("context"), F.array(qa_struct).alias("qas")).alias("p"))
    nested = a.groupBy("conv_id").agg(F.array_sort(F.collect_list(paragraph)).alias("t"))
    flat = qa.flatten_articles(nested.select(F.transform("t", lambda x: x["p"]).alias("paragraphs")))
    return flat.select(
        "sample_idx", "question_idx", "id", "context", "question",
        F.col("answer_info.text").alias("first_text"), F.col("answer_info.answer_start").alias("answer_start"),
        F.array_join("answer", "|").alias("answers"),
    )


@query
def first_wins_dedup(spark, sf):
    o = V.table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderpriority", "o_totalprice")
    return qa.first_per_key(o, "o_custkey", "o_orderkey").withColumn("o_totalprice", A.rounded(F.col("o_totalprice"), 2))


@query
def metrics_pivot(spark, sf):
    """Questions, metrics and one verdict column per judge; questions without a reply stay."""
    ans = V.answers(spark, sf)
    first = V.verdicts(ans).select(*EXAMPLE, "judge_llm", "judge_prompt", "verdict")
    second = first.withColumn("judge_prompt", F.lit("qa_orgad_et_al_eval")).withColumn(
        "verdict", F.when(F.col("verdict") == "refuse", "incorrect").otherwise(F.col("verdict"))
    )
    keys = ("llm_judge_gpt_4o_mini_qa_eval", "llm_judge_gpt_4o_mini_qa_orgad_et_al_eval")
    wide = catalog.qa_metrics_table(
        V.user_turns(spark, sf).select(*EXAMPLE, "question"),
        overlap.squad_metrics(ans),
        first.unionByName(second),
        keys=keys,
    )
    return wide.select(*EXAMPLE, "question", _r("squad_f1"), *keys)


@query
def qa_with_metrics(spark, sf):
    ans = V.answers(spark, sf)
    m = overlap.squad_metrics(ans).withColumn("answers", F.lit("raw"))
    both = catalog.qa_with_metrics(V.user_turns(spark, sf).select(*EXAMPLE, "question"), m)
    return both.select(*EXAMPLE, "question", _r("squad_f1"), "squad_exact")


@query
def run_metadata(spark, sf):
    """Temperature, prompt and seed out of run names, counted."""
    li = V.table(spark, sf, "lineitem")
    temp = F.when(F.col("l_returnflag") == "R", "greedy").otherwise(F.concat(F.lit("temp_"), F.col("l_discount").cast("string")))
    name = F.concat_ws(
        "__", temp, F.concat(F.lit("prompt_qa_"), F.lower("l_linestatus")), F.concat(F.lit("seed_"), F.col("l_linenumber").cast("string"))
    )
    named = li.groupBy(name.alias("run_name")).agg(F.count(F.lit(1)).alias("n"))
    return results.run_metadata(named, "run_name")


@query
def token_stats(spark, sf):
    d = V.table(spark, sf, "documents").select(F.col("lang").alias("run_id"), "text")
    s = qa.token_stats(d, "text", RUN)
    return s.select("run_id", "max_tokens", "min_tokens", _r("mean_tokens"), _r("median_tokens"))


@query
def shard_stats(spark, sf):
    t = V.tokens(spark, sf).withColumn("attention_mask", F.transform("token_ids", lambda x: x != 0))
    s = catalog.shard_stats(t)
    return s.select("run_id", _r("padding_share"), "n_tokens", "input_size")


@query
def display_names(spark, sf):
    """Documents per source under display names of datasets; unnamed sources keep their own."""
    d = V.table(spark, sf, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    key = F.when(F.col("lang") == "en", "coqa").when(F.col("lang") == "de", "gsm8k").otherwise(F.col("lang"))
    return d.select(results.display_name(key, results.DATASET_NAMES).alias("dataset"), "n")


# ---------------------------------------------------------------- probes and studies


def _split(spark, sf) -> DataFrame:
    return sampling.stratified_split(V.labels(spark, sf))


def _metric_rows(results_df: DataFrame, *keys: str) -> DataFrame:
    names = [f"{part}_{m}" for part in ("train", "test") for m in probe.METRICS]
    return results_df.select(*keys, "trainable_params", "n_train", "converged", *[_r(n) for n in names])


@query
def probe_lr(spark, sf):
    """All-layer log-determinant probe of every run."""
    table = features.spectral_features(G.diagonals(V.attention(spark, sf)), [], per_layer=False, families=("attn_log_det",))
    fitted, _ = probe.run_probes(features.labelled(table, _split(spark, sf)), features.PROBE)
    return _metric_rows(fitted, *features.PROBE)


@query
def probe_sweep(spark, sf):
    """Every spectral probe per layer and over all layers, with PCA."""
    fitted, _ = studies.spectral_probes(G.diagonals(V.attention(spark, sf)), _split(spark, sf), (1, 2), pca_dim=4)
    return _metric_rows(fitted, *features.PROBE, "pca_dim")


@query
def probe_hidden_states(spark, sf):
    toks = hidden.token_masks(V.state_tokens(spark, sf), V.SPECIAL_IDS, V.ADDED_IDS)
    chosen = hidden.select_last_tokens(V.hidden_states(spark, sf), toks)
    fitted, _ = studies.hidden_probes(chosen, _split(spark, sf), pca_dim=6)
    return _metric_rows(fitted, *features.PROBE, "pca_dim")


@query
def probe_generalization(spark, sf):
    """Probes of every run on the test rows of every run, spectral features."""
    table = features.spectral_features(G.diagonals(V.attention(spark, sf)), [2], per_layer=False)
    m = studies.generalization(table, _split(spark, sf), runs=(0, 1, 2, 3))
    return m.select("probe", "train_run", "test_run", "n_pos", "n_neg", *[_r(c) for c in probe.METRICS])


@query
def probe_generalization_hidden(spark, sf):
    """Probes of every run on the test rows of every run, hidden states of both tokens."""
    toks = hidden.token_masks(V.state_tokens(spark, sf), V.SPECIAL_IDS, V.ADDED_IDS)
    chosen = hidden.select_last_tokens(V.hidden_states(spark, sf), toks)
    table = features.hidden_features(chosen, per_layer=False)
    m = studies.generalization(table, _split(spark, sf), runs=(0, 1, 2, 3), pca_dim=8)
    return m.select("probe", "train_run", "test_run", "n_pos", "n_neg", *[_r(c) for c in probe.METRICS])


@query
def probe_temperature(spark, sf):
    """Balanced resamples of every run; each run stands for one temperature."""
    fitted = studies.temperature_study(
        G.diagonals(V.attention(spark, sf)), V.labels(spark, sf), top_k=2, per_class=40, seeds=(42, 123, 456)
    )
    return _metric_rows(fitted, "run_id", "probe", "seed")


@query
def probe_train_size(spark, sf):
    fitted = studies.size_study(
        G.diagonals(V.attention(spark, sf)), _split(spark, sf), top_k=2, fractions=(0.2, 0.5, 1.0), seeds=(42, 123), pca_dim=4
    )
    return _metric_rows(fitted, "run_id", "probe", "frac", "seed")


@query
def probe_perturbation(spark, sf):
    fitted = studies.perturbation_study(
        G.diagonals(V.attention(spark, sf)), _split(spark, sf), ks=(1, 2), stds=(1e-3, 1e-1, None), repeats=2, pca_dim=4
    )
    return _metric_rows(fitted, "run_id", "top_k", "std", "rep")


def _single_feature(spark, sf) -> DataFrame:
    """The attention score over all layers as the only feature of a probe."""
    scores = spectral.attention_score_with_all(G.diagonals(V.attention(spark, sf))).filter(F.col("layer") == "all")
    return scores.select(*EXAMPLE, F.lit("attn_score").alias("probe"), F.array("attn_score").alias("features"))


@query
def probe_single_feature(spark, sf):
    """A one-feature probe per run: fitted coefficients and the metrics of both parts."""
    rows = features.labelled(_single_feature(spark, sf), _split_arithmetic(spark, sf))
    models = cut_lineage(probe.fit_probes(rows, RUN))
    scored = cut_lineage(probe.score(rows, models, RUN))
    measured = metrics.probe_metrics(scored, ["run_id", "part"]).join(models, RUN)
    return measured.select(
        "run_id", "part", "n_train", "trainable_params", A.rounded(F.col("coef")[0], 5).alias("coef"),
        A.rounded(F.col("intercept"), 5).alias("intercept"), *[_r(m) for m in probe.METRICS],
    )


WIDE = 1500  # features, more than the training rows of a run and more than a tile


@query
def probe_wide_features(spark, sf):
    """Probes with more features than rows: the attention score spread over WIDE equal columns, fitted on their components.

    The penalty is invariant under rotation, so the norm of the coefficients, the
    intercept and the metrics are those of the one feature behind them.
    """
    one = features.labelled(_single_feature(spark, sf), _split_arithmetic(spark, sf))
    rows = one.withColumn("features", F.array_repeat(F.col("features")[0] / math.sqrt(WIDE), WIDE))
    models = probe.fit_probes(rows, RUN, pca_dim=8)
    scored = cut_lineage(probe.score(rows, models, RUN))
    measured = metrics.probe_metrics(scored, ["run_id", "part"]).join(models, RUN)
    norm = F.aggregate("coef", F.lit(0.0), lambda acc, c: acc + c / math.sqrt(WIDE))
    return measured.select(
        "run_id", "part", "n_train", "trainable_params", "rank", A.rounded(norm, 5).alias("coef"),
        A.rounded(F.col("intercept"), 5).alias("intercept"), *[_r(m) for m in probe.METRICS],
    )


@query
def probe_transfer(spark, sf):
    """One-feature probes of every run measured on the test rows of every run."""
    m = studies.generalization(_single_feature(spark, sf), _split_arithmetic(spark, sf), runs=(0, 1, 2, 3))
    return m.select("train_run", "test_run", "n_pos", "n_neg", *[_r(c) for c in probe.METRICS])


@query
def pca_variance(spark, sf):
    """Variance along both principal axes of the two per-layer scores, training rows only."""
    scores = spectral.attention_score(G.diagonals(V.attention(spark, sf)))
    pairs = scores.groupBy(*EXAMPLE).agg(F.array_sort(F.collect_list(F.struct("layer", "attn_score"))).alias("_s"))
    two = pairs.select(*EXAMPLE, F.transform("_s", lambda x: x["attn_score"]).alias("features"))
    fitted = pca.fit_pca(features.labelled(two, _split_arithmetic(spark, sf)), RUN, EXAMPLE, 2)
    return pca.explained_variance(fitted, RUN).select("run_id", "pca_dim", "component", _r("variance"))


# ---------------------------------------------------------------- streaming and stored results


@query
def stream_attn_features(spark, sf):
    """Shards written to files, streamed in several micro-batches with one shard sent twice."""
    root = scratch_path(spark, "stream")
    maps = V.attention(spark, sf).select(*HEAD, "w")
    maps.repartition(4, *EXAMPLE).write.parquet(f"{root}/shards")
    maps.filter(F.col("layer") == 0).write.mode("append").parquet(f"{root}/shards")
    stream.run_available(spark, f"{root}/shards", f"{root}/features", f"{root}/checkpoint", maps.schema, files_per_batch=2)
    stored = spark.read.parquet(f"{root}/features")
    zipped = F.arrays_zip("attn_diag", "lap_diag")
    return stored.select(*HEAD, _r("log_det"), F.posexplode(zipped).alias("k", "t")).select(
        *HEAD, "log_det", "k", A.rounded(F.col("t.attn_diag")).alias("attn"), A.rounded(F.col("t.lap_diag")).alias("lap")
    )


@query
def stored_diagonals(spark, sf):
    """Decoding steps to stored diagonals through the catalog, read back run by run partition."""
    store = catalog.Catalog(spark, scratch_path(spark, "catalog"))
    steps = V.attention_steps(spark, sf)
    ids = F.array_repeat(F.lit(7), F.col("n") + 1)
    toks = V.embeddings(spark, sf).select(*EXAMPLE, ids.alias("token_ids"))
    features.extract_diagonals(store, steps, toks, pad=0)
    store.write("labels", V.labels(spark, sf))
    store.write("split", _split(spark, sf).select(*EXAMPLE, "part"))
    diags, labelled = features.load_inputs(store, [0, 1, 2, 3])
    counted = diags.join(labelled, EXAMPLE).select(*EXAMPLE, "layer", "head", "label", A.total(F.col("lap_diag")).alias("lap_sum"))
    return counted.select(*EXAMPLE, "layer", "head", "label", _r("lap_sum"))


@query
def hidden_states_scan(spark, sf):
    """Hidden states stored by run and layer, loaded back with the two reference tokens selected."""
    store = catalog.Catalog(spark, scratch_path(spark, "states"))
    toks = hidden.token_masks(V.state_tokens(spark, sf), V.SPECIAL_IDS, V.ADDED_IDS)
    store.write_stored_features("hidden_states", {"tokens": toks, "hidden_states": V.hidden_states(spark, sf)})
    chosen = catalog.load_hidden_states(store, layer="all")
    summed = A.total(F.transform("vec", lambda x: x.cast("double")))
    return chosen.select(*EXAMPLE, "layer", "which", "tok_idx", "input_length", A.rounded(summed).alias("vec_sum"))


@query
def probe_results_scan(spark, sf):
    """Result files of every run written as JSON, then scanned recursively with run metadata."""
    root = scratch_path(spark, "results")
    measured = studies.attention_score_probe(G.diagonals(V.attention(spark, sf)), _split_arithmetic(spark, sf))
    record = F.struct(
        F.struct(F.lit(0).alias("trainable_params"), F.col("layer").alias("layer_idx")).alias("metadata"),
        F.create_map(F.lit("auc"), F.col("auc"), F.lit("average_precision"), F.col("average_precision")).alias("metrics"),
    )
    name = F.concat(F.lit("temp_0."), F.col("run_id").cast("string"), F.lit("__prompt_qa_short__seed_42"))
    bodies = measured.filter(F.col("part") == "test").groupBy(name.alias("run_name")).agg(
        F.to_json(F.create_map(F.lit("attn_score"), F.collect_list(record))).alias("value")
    )
    bodies.write.partitionBy("run_name").text(root)
    runs = bodies.select("run_name", F.concat(F.lit("set_"), F.substring("run_name", 8, 1)).alias("dataset"))
    # partition folders are called run_name=<name>
    listed = runs.withColumn("run_name", F.concat(F.lit("run_name="), "run_name"))
    flat = results.load_results(spark, root, "*.txt", listed)
    return flat.select(
        "probe", "dataset", "temp", "seed", "trainable_params", "layer_idx", "configured_pca_dim",
        A.rounded(F.col("metrics")["auc"]).alias("auc"), A.rounded(F.col("metrics")["average_precision"]).alias("ap"),
    )


def _split_arithmetic(spark, sf) -> DataFrame:
    return sampling.stratified_split(V.labels(spark, sf), order=V.ARITHMETIC)

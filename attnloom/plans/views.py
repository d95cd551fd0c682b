"""The model tables of the registered queries, derived from the given tables.

Embeddings stand in for activations, conversations for answers, orders for
maths answers, documents for token sequences. Every view covers its whole
table; lengths and labels differ between rows so that ragged cases occur.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import arrays as A
from ..operators.sampling import RandomOrder

LAYERS, HEADS, SIDE = 2, 2, 4


_SCHEMAS: dict[str, T.StructType] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table; its footer is read for the schema once per path and not on every use."""
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


def _int(column: Column) -> Column:
    return column.cast("int")


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(
        _int(F.expr("(vec_id div 3) % 4")).alias("run_id"),
        F.col("vec_id").alias("row_idx"),
        (_int(F.col("vec_id") % 3) + 2).alias("n"),
        "embedding",
        "label",
    )


def attention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matrix form: causal softmax maps, 2 layers x 2 heads, 2 to 4 tokens."""
    e = embeddings(spark, sf_dir)
    heads = e.select(
        "run_id", "row_idx", "n", "embedding", F.explode(F.sequence(F.lit(0), F.lit(LAYERS * HEADS - 1))).alias("_lh")
    ).select(
        "run_id",
        "row_idx",
        _int(F.expr(f"_lh div {HEADS}")).alias("layer"),
        _int(F.col("_lh") % HEADS).alias("head"),
        "n",
        "embedding",
    )
    start = F.col("layer") * (HEADS * SIDE * SIDE) + F.col("head") * (SIDE * SIDE)
    weights = F.transform(
        F.sequence(F.lit(0), F.col("n") - 1),
        lambda q: F.transform(
            F.slice("embedding", start + q * SIDE + 1, q + 1), lambda x: F.exp(x.cast("double"))
        ),
    )
    w = F.transform(weights, lambda row: F.transform(row, lambda x: x / A.total(row)))
    return heads.select("run_id", "row_idx", "layer", "head", "n", w.alias("w"))


def attention_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decoding steps: two input tokens in step 0, then one token per step."""
    rows = attention(spark, sf_dir).select("run_id", "row_idx", "layer", "head", F.posexplode("w").alias("q", "_row"))
    step = F.greatest(F.col("q") - 1, F.lit(0))
    width = F.greatest(F.col("q") + 1, F.lit(2))
    padded = F.concat("_row", F.array_repeat(F.lit(0.0), width - F.size("_row")))
    return rows.select(
        "run_id", "row_idx", "layer", "head",
        step.alias("gen_step"),
        F.when(F.col("q") < 2, F.col("q")).otherwise(0).alias("q_in_step"),
        padded.alias("weights"),
    )


def padded_attention(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Maps inside a padded sequence, and the token ids that tell where the padding is.

    `row_idx % 3` pads on the left, `row_idx % 2` on the right; a padded row
    attends to itself.
    """
    maps = attention(spark, sf_dir)
    left, right = _int(F.col("row_idx") % 3), _int(F.col("row_idx") % 2)
    size = F.col("n") + left + right

    def one(q: Column) -> Column:
        inner = F.get(F.col("w"), q - left)
        pad_row = F.transform(F.sequence(F.lit(0), size - 1), lambda k: (k == q).cast("double"))
        filled = F.concat(
            F.array_repeat(F.lit(0.0), left), inner, F.array_repeat(F.lit(0.0), size - left - F.size(inner))
        )
        return F.when((q >= left) & (q < left + F.col("n")), filled).otherwise(pad_row)

    w = F.transform(F.sequence(F.lit(0), size - 1), one)
    matrices = maps.select("run_id", "row_idx", "layer", "head", size.alias("n"), w.alias("w"))
    e = embeddings(spark, sf_dir)
    ids = F.concat(
        F.array_repeat(F.lit(0), left), F.array_repeat(F.lit(7), F.col("n")), F.array_repeat(F.lit(0), right), F.array(F.lit(9))
    )
    return matrices, e.select("run_id", "row_idx", ids.alias("token_ids"))


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("row_idx") % 17 == 0, -1).when(F.col("label") < 5, 0).otherwise(1)
    return embeddings(spark, sf_dir).select("run_id", "row_idx", label.alias("label"))


def hidden_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2 layers x 4 tokens x 8 dimensions."""
    e = embeddings(spark, sf_dir).select(
        "run_id", "row_idx", "embedding", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("_lt")
    )
    return e.select(
        "run_id",
        "row_idx",
        _int(F.expr("_lt div 4")).alias("layer"),
        _int(F.col("_lt") % 4).alias("tok_idx"),
        F.slice("embedding", F.col("_lt") * 8 + 1, 8).alias("vec"),
    )


SPECIAL_IDS = tuple(range(0, 35, 5))
ADDED_IDS = tuple(range(0, 35, 7))


def state_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five token ids for the four hidden states; three of them are input."""
    ids = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda t: _int((F.col("row_idx") + t) % 35))
    return embeddings(spark, sf_dir).select("run_id", "row_idx", ids.alias("token_ids"), F.lit(3).alias("input_length"))


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents as token ids with padding at both ends and sometimes inside."""
    d = table(spark, sf_dir, "documents")
    ids = F.transform(F.split("text", r"\s+"), lambda w: F.length(w) % 10 + 1)
    punched = F.transform(ids, lambda t, i: F.when((i == 3) & (F.col("doc_id") % 2 == 0), 0).otherwise(t))
    padded = F.concat(
        F.array_repeat(F.lit(0), _int(F.col("doc_id") % 3)), punched, F.array_repeat(F.lit(0), _int(F.col("doc_id") % 4))
    )
    blank = F.transform(padded, lambda t: F.lit(0))
    return d.select(
        F.col("lang").alias("run_id"),
        F.col("doc_id").alias("row_idx"),
        F.when(F.col("doc_id") % 50 == 0, blank).otherwise(padded).alias("token_ids"),
    ).withColumn("input_length", _int(F.expr("size(token_ids) div 2")))


def user_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").filter(F.col("role") == "user")
    return c.select(
        _int(F.col("conv_id") % 2).alias("run_id"),
        (F.col("conv_id") * 100 + F.col("turn")).alias("row_idx"),
        "conv_id",
        "turn",
        F.col("text").alias("question"),
    )


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns with the reply that follows, and one or two gold answers."""
    replies = table(spark, sf_dir, "conversations").filter(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("prediction")
    )
    joined = user_turns(spark, sf_dir).join(replies, ["conv_id", "turn"])
    pieces = F.split("prediction", " ")
    half = F.array_join(F.slice(pieces, 1, F.expr("size(split(prediction, ' ')) div 2")), " ")
    kind = F.col("row_idx") % 5
    gold = (
        F.when(kind == 0, F.array(F.lower("prediction")))
        .when(kind == 1, F.array(half, F.col("question")))
        .otherwise(F.array("question"))
    )
    return joined.select("run_id", "row_idx", "conv_id", "turn", "question", "prediction", gold.alias("gold"))


def judge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts(answers(spark, sf_dir))


def verdicts(answered: DataFrame) -> DataFrame:
    choice = F.expr("(row_idx div 2) % 4")
    verdict = F.when(choice == 0, "correct").when(choice == 2, "refuse").otherwise("incorrect")
    usage = F.struct(
        F.length("question").cast("long").alias("input_tokens"),
        F.lit(1).cast("long").alias("output_tokens"),
        (F.col("row_idx") % 3).alias("cache_read"),
    )
    return answered.select(
        "run_id",
        "row_idx",
        F.lit("gpt-4o-mini").alias("judge_llm"),
        F.lit("qa_eval").alias("judge_prompt"),
        verdict.alias("verdict"),
        usage.alias("usage"),
        F.when(F.col("row_idx") % 11 == 0, "length").otherwise("stop").alias("finish_reason"),
    )


def maths_gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(
        _int(F.col("o_custkey") % 2).alias("run_id"),
        F.col("o_orderkey").alias("row_idx"),
        F.concat(F.lit("Steps #### "), F.floor("o_totalprice").cast("string")).alias("answer"),
    )


def maths_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    value = F.floor("o_totalprice")
    kind = F.col("o_orderkey") % 4
    prediction = (
        F.when(kind == 0, F.concat(F.lit("The final answer is "), value.cast("string"), F.lit(".")))
        .when(kind == 1, F.concat(F.lit("So we add. The final answer is $"), F.format_number(value, 0), F.lit(".")))
        .when(kind == 2, F.concat(F.lit("The final answer is "), (value + 1).cast("string")))
        .otherwise("I cannot tell.")
    )
    return o.select(
        _int(F.col("o_custkey") % 2).alias("run_id"),
        F.col("o_orderkey").alias("row_idx"),
        prediction.alias("prediction"),
        F.concat(F.lit("Steps #### "), F.floor("o_totalprice").cast("string")).alias("gold"),
    )


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores with many ties: 20 values, two labels per document."""
    d, l = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    joined = d.select("doc_id", "lang", "n_chars").join(l, "doc_id")
    return joined.select(
        F.col("lang").alias("run_id"),
        F.col("doc_id").alias("row_idx"),
        (1 - F.col("quality")).alias("label"),
        ((F.col("n_chars") % 20) / 20.0).alias("score"),
        F.col("toxic").alias("pred"),
    )


# an order of examples that a second engine can compute as well
ARITHMETIC = RandomOrder(
    key=lambda row, seed: (row * 7919 + seed) % 10007,
    bucket=lambda value: F.floor(value / 16),
)


def arithmetic_uniform(keys, stream: int) -> Column:
    """A number in (0, 1) from a linear congruence of (run, row, std, rep[, layer, head, k])."""
    factors = (31, 7919, 104729, 1299709, 15485863, 32452843, 49979687)
    whole = [keys[0], keys[1], F.round(keys[2] * 100000).cast("long"), *keys[3:]]
    mixed = F.lit(stream * 67867967).cast("long")
    for key, factor in zip(whole, factors):
        mixed = mixed + key.cast("long") * factor
    return (mixed % 10007 + 0.5) / 10007.0

"""Keys and table schemas.

All alignment is by key, never by position: an example is `(run_id, row_idx)`,
one attention head of one example is `(run_id, row_idx, layer, head)`.
"""

from __future__ import annotations

from pyspark.sql import types as T

RUN = ["run_id"]
EXAMPLE = ["run_id", "row_idx"]
LAYER = [*EXAMPLE, "layer"]
HEAD = [*LAYER, "head"]

# fixed values: label codes
CORRECT, INCORRECT, INVALID = 0, 1, -1

_example = [T.StructField("run_id", T.StringType(), False), T.StructField("row_idx", T.LongType(), False)]
_head = [*_example, T.StructField("layer", T.IntegerType(), False), T.StructField("head", T.IntegerType(), False)]

MESSAGE = T.StructType([T.StructField("role", T.StringType()), T.StructField("content", T.StringType())])

QA = T.StructType(
    [
        *_example,
        T.StructField("id", T.StringType()),
        T.StructField("question", T.StringType()),
        T.StructField("context", T.StringType()),
        T.StructField("gold", T.ArrayType(T.StringType())),
    ]
)
ANSWERS = T.StructType(
    [
        *_example,
        T.StructField("prediction", T.StringType()),
        T.StructField("gold", T.ArrayType(T.StringType())),
    ]
)
JUDGE_USAGE = T.StructType(
    [
        T.StructField("input_tokens", T.LongType()),
        T.StructField("output_tokens", T.LongType()),
        T.StructField("cache_read", T.LongType()),
    ]
)
JUDGE = T.StructType(
    [
        *_example,
        T.StructField("judge_llm", T.StringType()),
        T.StructField("judge_prompt", T.StringType()),
        T.StructField("verdict", T.StringType()),
        T.StructField("usage", JUDGE_USAGE),
        T.StructField("finish_reason", T.StringType()),
    ]
)
# one decoding step of one head: a query row of attention weights
ATTENTION_STEP = T.StructType(
    [
        *_head,
        T.StructField("gen_step", T.IntegerType(), False),
        T.StructField("q_in_step", T.IntegerType(), False),
        T.StructField("weights", T.ArrayType(T.FloatType())),
    ]
)
# one head of one example: its rows, lower-triangular or padded with zeros
ATTENTION_MATRIX = T.StructType([*_head, T.StructField("w", T.ArrayType(T.ArrayType(T.DoubleType())))])
DIAGONALS = T.StructType(
    [
        *_head,
        T.StructField("attn_diag", T.ArrayType(T.DoubleType())),
        T.StructField("lap_diag", T.ArrayType(T.DoubleType())),
    ]
)
HIDDEN_STATE = T.StructType(
    [
        *_example,
        T.StructField("layer", T.IntegerType(), False),
        T.StructField("tok_idx", T.IntegerType(), False),
        T.StructField("vec", T.ArrayType(T.FloatType())),
    ]
)
TOKENS = T.StructType(
    [
        *_example,
        T.StructField("token_ids", T.ArrayType(T.IntegerType())),
        T.StructField("special_mask", T.ArrayType(T.BooleanType())),
        T.StructField("added_mask", T.ArrayType(T.BooleanType())),
        T.StructField("input_length", T.IntegerType()),
    ]
)
LABELS = T.StructType([*_example, T.StructField("label", T.IntegerType()), T.StructField("valid", T.BooleanType())])
SPLIT = T.StructType([*_example, T.StructField("part", T.StringType())])

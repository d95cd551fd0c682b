import pytest
from pyspark.sql import functions as F

from attnloom.functions import arrays as A
from attnloom.operators import attention, hidden, padding

TOKENS = "run_id string, row_idx long, token_ids array<int>"


@pytest.mark.parametrize(
    "ids,pad,want",
    [
        ([1, 2, 3, 0, 0], 0, [1, 2, 3]),
        ([0, 0, 1, 2, 3], 0, [1, 2, 3]),
        ([1, 2, 0, 0, 3], 0, [1, 2, 0, 0, 3]),
        ([5, 6, 7, 8, 8], 8, [5, 6, 7]),
        ([8, 5, 6, 7, 8], 8, [5, 6, 7]),
        ([0, 0, 0], 0, [0, 0, 0]),
    ],
)
def test_strip_edge_padding(spark, ids, pad, want):
    df = spark.createDataFrame([("r", 0, ids)], TOKENS)
    once = padding.strip_edge_padding(df, pad)
    assert once.first()["token_ids"] == want
    if any(t != pad for t in ids):
        assert padding.strip_edge_padding(once, pad).first()["token_ids"] == want


@pytest.mark.parametrize(
    "ids,want",
    [([0, 0, 1, 0, 0], "TTFTT"), ([0, 1, 0, 1, 0], "TFFFT"), ([1, 1, 0, 2, 0], "FFFFT"), ([0, 0, 1, 2, 3], "TTFFF")],
)
def test_edge_padding_mask(spark, ids, want):
    df = spark.createDataFrame([(ids,)], "t array<int>")
    assert df.select(A.edge_padding_mask(F.col("t"), 0)).first()[0] == [c == "T" for c in want]


def test_pad_token_rules():
    assert padding.pad_token(None, 9) == 9 and padding.pad_token(0, 9) == 0
    assert padding.pad_token_for_states(None, 9) == 9 and padding.pad_token_for_states(0, 9) == 9


@pytest.fixture
def shard(spark):
    states = spark.createDataFrame(
        [("r", 0, l, t, [float(10 * (l + 1) + t)] * 3) for l in range(2) for t in range(6)],
        "run_id string, row_idx long, layer int, tok_idx int, vec array<float>",
    )
    flags = lambda bits: [b == 1 for b in bits]
    tokens = spark.createDataFrame(
        [("r", 0, flags([1, 0, 1, 0, 0, 0, 1]), flags([1, 0, 1, 0, 1, 0, 1]), 4)],
        "run_id string, row_idx long, special_mask array<boolean>, added_mask array<boolean>, input_length int",
    )
    return states, tokens


def test_select_last_tokens(shard):
    states, tokens = shard
    got = {(r["which"], r["layer"]): (r["tok_idx"], r["vec"][0]) for r in hidden.select_last_tokens(states, tokens).collect()}
    assert got == {
        ("input", 0): (2, 12.0), ("input", 1): (2, 22.0), ("generated", 0): (4, 14.0), ("generated", 1): (4, 24.0),
    }
    assert hidden.select_last_tokens(states, tokens, "last").select("layer").distinct().collect()[0][0] == 1
    assert hidden.select_last_tokens(states, tokens, 0).count() == 2
    flat = {r["which"]: r["features"] for r in hidden.token_features(hidden.select_last_tokens(states, tokens)).collect()}
    assert flat["input"] == [12.0] * 3 + [22.0] * 3


def test_shards_concatenate(shard):
    states, tokens = shard
    second = [df.withColumn("row_idx", F.lit(1).cast("long")) for df in shard]
    both = hidden.select_last_tokens(states.unionByName(second[0]), tokens.unionByName(second[1]))
    assert both.groupBy("which", "layer").count().select("count").distinct().collect()[0][0] == 2


def test_no_ordinary_token_falls_back_to_last_position(spark):
    tokens = spark.createDataFrame(
        [("r", 0, [True] * 6, [False] * 6, 3)],
        "run_id string, row_idx long, special_mask array<boolean>, added_mask array<boolean>, input_length int",
    )
    row = hidden.last_token_positions(tokens).first()
    assert (row["last_input_token_idx"], row["last_generated_token_idx"]) == (1, 4)


def test_strip_hidden_states(spark):
    tokens = spark.createDataFrame([("r", 0, [9, 0, 4, 0, 5, 0], 3)], TOKENS + ", input_length int")
    states = spark.createDataFrame(
        [("r", 0, 0, t, [float(t)]) for t in range(5)], "run_id string, row_idx long, layer int, tok_idx int, vec array<float>"
    )
    rows = sorted((r["tok_idx"], r["token_id"], r["vec"][0], r["last_input_idx"]) for r in padding.strip_hidden_states(states, tokens, 0).collect())
    # shifted ids are 0 4 0 5 0: states 1 and 3 stay; two pads lie in the first three
    assert rows == [(0, 4, 1.0, 0), (1, 5, 3.0, 0)]


def test_states_by_layer(spark):
    steps = spark.createDataFrame(
        [("r", 0, 0, s, i, [float(10 * s + i)]) for s, n in ((0, 3), (1, 1), (2, 1)) for i in range(n)],
        "run_id string, row_idx long, layer int, gen_step int, idx_in_step int, vec array<float>",
    )
    got = {r["tok_idx"]: r["vec"][0] for r in hidden.states_by_layer(steps).collect()}
    assert got == {0: 0.0, 1: 1.0, 2: 2.0, 3: 10.0, 4: 20.0}
    assert "gen_step" in hidden.states_by_layer(steps, concat=False).columns


def test_strip_hidden_state_edges_keeps_interior_padding(spark):
    tokens = spark.createDataFrame([("r", 0, [0, 7, 0, 8, 9])], TOKENS)
    states = spark.createDataFrame([("r", 0, i, [float(i)]) for i in range(4)], "run_id string, row_idx long, tok_idx int, vec array<double>")
    kept = padding.strip_hidden_state_edges(states, attention.token_range(tokens, 0)).collect()
    assert sorted((r["tok_idx"], r["vec"][0]) for r in kept) == [(0, 1.0), (1, 2.0), (2, 3.0)]

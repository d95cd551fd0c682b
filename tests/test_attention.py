import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from attnloom.operators import attention as G
from attnloom.operators import spectral
from attnloom.schema import HEAD

SCHEMA = "run_id string, row_idx long, layer int, head int, w array<array<double>>"


def matrices(spark, layers, row=0):
    """`layers[layer][head]` is a square map."""
    rows = [
        ("r", row, l, h, [[float(x) for x in line] for line in m])
        for l, heads in enumerate(layers)
        for h, m in enumerate(heads)
    ]
    return spark.createDataFrame(rows, SCHEMA)


def by_head(df, column):
    return {(r["layer"], r["head"]): r[column] for r in df.collect()}


LAYERS = [
    [[[1.0, 0, 0], [1.0, 1, 0], [1.0, 1, 1]], [[1.0, 0, 0], [0.0, 2, 0], [0.0, 0, 3]]],
    [[[1.0, 0, 0], [2.0, 1, 0], [3.0, 2, 1]], [[10.0, 0, 0], [20.0, 10, 0], [30.0, 20, 10]]],
    [[[1.0, 0, 0], [2.0, 1, 0], [3.0, 2, 1]], [[100.0, 0, 0], [100.0, 100, 0], [100.0, 100, 100]]],
]
PLAIN = {
    (0, 0): [0, 0, 0],
    (0, 1): [1 / 3 - 1, 2 / 2 - 2, 0],
    (1, 0): [6 / 3 - 1, 3 / 2 - 1, 0],
    (1, 1): [10, 5, 0],
    (2, 0): [1, 0.5, 0],
    (2, 1): [0, 0, 0],
}
VERTICAL = {
    (0, 0): [0, 0, 0],
    (0, 1): [1 / 3 - 1, -1, 0],
    (1, 0): [7 / 4 - 1, 4 / 3 - 1, 0],
    (1, 1): [61 / 4 - 10, 31 / 3 - 10, 11 / 2 - 10],
    (2, 0): [7 / 4 - 1, 4 / 3 - 1, 0],
    (2, 1): [301 / 4 - 100, 201 / 3 - 100, 101 / 2 - 100],
}


@pytest.mark.parametrize("weight,expected", [(None, PLAIN), (1.0, VERTICAL)])
def test_laplacian_diagonal(spark, weight, expected):
    maps = matrices(spark, LAYERS)
    found = by_head(G.diagonals(maps, weight), "lap_diag")
    edges = by_head(G.pack_diagonals(G.diagonals_from_edges(G.to_edges(maps), weight)), "lap_diag")
    for key, values in expected.items():
        assert found[key] == pytest.approx(values)
        assert edges[key] == pytest.approx(values)


def test_log_det(spark):
    for power in (1, 2, 3):
        ones = [[math.exp(power)] * 3] * 3
        d = G.diagonals(matrices(spark, [[ones] * 4, [ones] * 4]))
        assert set(round(v, 9) for v in by_head(spectral.log_det(d), "log_det").values()) == {float(power)}


def test_log_of_zero_is_minus_infinity(spark):
    d = G.diagonals(matrices(spark, [[[[0.0, 0], [1.0, 0.5]]]]))
    assert spectral.log_det(d).first()["log_det"] == float("-inf")


HALF = [[1.0, 0.0], [0.5, 0.5]]


def test_refined_diagonal(spark):
    found = by_head(G.refined_diagonal(matrices(spark, [[HALF] * 3, [HALF] * 3])), "lap_diag_refined")
    for head in range(3):
        assert found[(0, head)] == pytest.approx([2.5 / 3 - 1, 0.0])
        assert found[(1, head)] == pytest.approx([0.5, 0.0])


def test_refined_diagonal_against_numpy(spark):
    rng = np.random.default_rng(3)
    layers = [np.tril(rng.random((5, 5))) for _ in range(4)]
    found = by_head(G.refined_diagonal(matrices(spark, [[m.tolist()] for m in layers])), "lap_diag_refined")
    n, k = 5, np.arange(5)
    for i, a in enumerate(layers):
        s, d = a.sum(0), a.diagonal()
        if i == 0:
            want = (s + layers[1].diagonal()) / (n - k + 1) - d
        elif i == 3:
            want = np.append((s - d)[:-1] / (n - k - 1)[:-1], 0.0)
        else:
            want = (s - d + layers[i + 1].diagonal()) / (n - k)
        assert found[(i, 0)] == pytest.approx(want.tolist())


def test_refined_needs_two_layers(spark):
    with pytest.raises(Exception, match="two layers"):
        G.refined_diagonal(matrices(spark, [[HALF]])).collect()


def test_full_laplacian(spark):
    edges = G.full_laplacian(G.to_edges(matrices(spark, [[HALF] * 3, [HALF] * 3])))
    want = np.array(
        [
            [2.5 / 3 - 1, 0, 0, 0],
            [-0.5, 0, 0, 0],
            [-1.0, 0, 0.5, 0],
            [0, -0.5, -0.5, 0],
        ]
    )
    rows = edges.collect()
    for head in range(3):
        dense = np.zeros((4, 4))
        for r in rows:
            if r["head"] == head:
                dense[r["r"], r["c"]] = r["value"]
        assert np.allclose(dense, want)


def test_full_laplacian_needs_two_layers(spark):
    one = G.full_laplacian(G.to_edges(matrices(spark, [[HALF]])))
    with pytest.raises(Exception, match="two layers"):
        one.collect()
    with pytest.raises(Exception, match="two layers"):
        one.count()


def test_require_layers(spark):
    with pytest.raises(Exception, match="fewer than 2 layers"):
        G.require_layers(matrices(spark, [[HALF]])).collect()
    assert G.require_layers(matrices(spark, [[HALF], [HALF]])).count() == 2


def steps_frame(spark, steps):
    """`steps[step][layer][head]` holds query rows."""
    rows = [
        ("r", 0, l, h, s, q, [float(x) for x in row])
        for s, layers in enumerate(steps)
        for l, heads in enumerate(layers)
        for h, m in enumerate(heads)
        for q, row in enumerate(m)
    ]
    return spark.createDataFrame(
        rows, "run_id string, row_idx long, layer int, head int, gen_step int, q_in_step int, weights array<float>"
    )


def test_stack_steps(spark):
    rng = np.random.default_rng(0)
    shapes = [(8, 8), (1, 9), (1, 10)]
    steps = [[[rng.random(s).astype(np.float32) for _ in range(2)] for _ in range(2)] for s in shapes]
    frame = steps_frame(spark, steps)
    stacked = by_head(G.stack_steps(frame), "w")
    edges = {
        (r["layer"], r["head"], r["q"], r["k"]): r["w"] for r in G.steps_to_edges(frame).collect()
    }
    for l in range(2):
        for h in range(2):
            want = np.vstack([np.pad(s[l][h], ((0, 0), (0, 10 - s[l][h].shape[1]))) for s in steps])
            assert np.allclose(np.array(stacked[(l, h)]), want)
            assert all(np.isclose(edges.get((l, h, q, k), 0.0), want[q, k]) for q in range(10) for k in range(10))


def test_strip_padding_without_padding_changes_nothing(spark):
    rng = np.random.default_rng(1)
    maps = np.tril(np.exp(rng.normal(size=(2, 4, 3, 3))))
    maps /= maps.sum(-1, keepdims=True)
    frame = matrices(spark, maps.tolist())
    tokens = spark.createDataFrame([("r", 0, [1, 1, 1, 1])], "run_id string, row_idx long, token_ids array<int>")
    out = by_head(G.strip_padding(frame, tokens, 0), "w")
    for l in range(2):
        for h in range(4):
            assert np.allclose(out[(l, h)], maps[l, h])


def test_strip_padding_cuts_both_ends_and_checks_rows(spark):
    inner = [[1.0, 0.0], [0.25, 0.75]]
    padded = [[1.0, 0, 0, 0], [0, 1.0, 0, 0], [0, 0.25, 0.75, 0], [0, 0, 0, 1.0]]
    tokens = spark.createDataFrame([("r", 0, [0, 5, 5, 0, 5])], "run_id string, row_idx long, token_ids array<int>")
    assert by_head(G.strip_padding(matrices(spark, [[padded]]), tokens, 0), "w")[(0, 0)] == inner
    leaky = [[1.0, 0, 0, 0], [0.5, 0.5, 0, 0], [0, 0.25, 0.75, 0], [0, 0, 0, 1.0]]
    with pytest.raises(Exception, match="do not sum to 1"):
        G.strip_padding(matrices(spark, [[leaky]]), tokens, 0).collect()
    assert G.strip_padding(matrices(spark, [[leaky]]), tokens, 0, check=False).count() == 1


def test_top_k_needs_enough_tokens(spark):
    d = G.diagonals(matrices(spark, LAYERS))
    assert by_head(spectral.top_k(d, 2, "attn_diag"), "vals")[(0, 1)] == [3.0, 2.0]
    with pytest.raises(Exception, match="shorter than top-k"):
        spectral.top_k(d, 4, "attn_diag").collect()


@pytest.mark.parametrize("k", [1, 2, 7, 20])
def test_stats_against_numpy(spark, k):
    rng = np.random.default_rng(k)
    values = rng.normal(size=25).tolist()
    d = spark.createDataFrame([("r", 0, 0, 0, values)], "run_id string, row_idx long, layer int, head int, lap_diag array<double>")
    stats = spectral.top_k_stats(d, k).first()["stats"]
    top = np.sort(values)[::-1][:k]
    want = [top.mean(), top.std(ddof=1) if k > 1 else float("nan"), *np.quantile(top, [0.01, 0.05, 0.25, 0.5, 0.95, 0.99])]
    assert stats == pytest.approx(want, nan_ok=True)


def test_flatten_is_layer_major(spark):
    rows = [("r", 0, l, h, [float(100 * l + 10 * h + i) for i in range(2)]) for h in (1, 0) for l in (1, 0)]
    d = spark.createDataFrame(rows, "run_id string, row_idx long, layer int, head int, vals array<double>")
    flat = spectral.flatten_features(d, "vals").first()["features"]
    assert flat == [0.0, 1.0, 10.0, 11.0, 100.0, 101.0, 110.0, 111.0]
    assert spectral.flatten_features(d, "vals", layer=1).first()["features"] == flat[4:]


def test_eligible_top_k_and_scores(spark):
    d = G.diagonals(matrices(spark, LAYERS))
    assert [r["top_k"] for r in spectral.eligible_top_k(d, (2, 3, 5)).collect()] == [2, 3]
    scores = {r["layer"]: r["attn_score"] for r in spectral.attention_score_with_all(d).collect()}
    per_layer = [-(np.log([1, 1, 1]).mean() + np.log([1, 2, 3]).mean()), -np.log(10), -np.log(100)]
    assert [scores[str(i)] for i in range(3)] == pytest.approx(per_layer)
    assert scores["all"] == pytest.approx(np.mean(per_layer))


def test_matrix_form_has_no_shuffle(spark):
    plan = spectral.log_det(G.diagonals(matrices(spark, LAYERS)))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_diagonal_identity(spark):
    """Without self-loops the refined column sums lose exactly the diagonal."""
    edges = G.to_edges(matrices(spark, LAYERS))
    full = G.full_laplacian(edges).filter("r = c and r < 3")
    plain = G.diagonals_from_edges(edges.filter(F.col("layer") == 0).filter("w <> 0").withColumn("n", F.lit(3)))
    assert full.count() == plain.count()
    assert HEAD == ["run_id", "row_idx", "layer", "head"]

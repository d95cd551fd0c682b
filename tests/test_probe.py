import numpy as np
import pytest
from pyspark.sql import functions as F

from attnloom.operators import blocks, pca, probe
from attnloom.plans import studies

KEYS = ["run_id", "probe"]
SCHEMA = "run_id string, probe string, row_idx long, label int, part string, features array<double>"


def reference_fit(x, y):
    """Gradient descent with line search on the same objective, written independently."""
    n = len(y)
    s = np.where(y == 1, n / (2 * y.sum()), n / (2 * (n - y.sum())))
    w = np.zeros(x.shape[1] + 1)
    ones = np.column_stack([x, np.ones(n)])

    def loss(w):
        z = ones @ w
        return s @ (np.log1p(np.exp(-np.abs(z))) + np.maximum(z, 0) - y * z) + 0.5 * w[:-1] @ w[:-1]

    def gradient(w):
        p = 1 / (1 + np.exp(-(ones @ w)))
        return ones.T @ (s * (p - y)) + np.append(w[:-1], 0)

    step = 1.0
    for _ in range(20000):
        g = gradient(w)
        if np.abs(g).max() < 1e-9:
            break
        while loss(w - step * g) > loss(w) - 0.5 * step * g @ g and step > 1e-14:
            step /= 2
        w = w - step * g
        step *= 1.5
    return w


def make(spark, shapes, seed=0):
    """`shapes[(run, probe)] = (n, d)`; every fifth row is a test row."""
    rng = np.random.default_rng(seed)
    rows, data = [], {}
    for (run, name), (n, d) in shapes.items():
        x = rng.normal(size=(n, d)) * rng.uniform(0.3, 2.0, size=d)
        y = (x @ rng.normal(size=d) + rng.normal(size=n) * 2 > 0.4).astype(int)
        y[:4] = [0, 1, 0, 1]
        part = np.where(np.arange(n) % 5 == 4, "test", "train")
        data[(run, name)] = (x, y, part)
        rows += [(run, name, i, int(y[i]), str(part[i]), x[i].tolist()) for i in range(n)]
    return spark.createDataFrame(rows, SCHEMA), data


SHAPES = {("a", "p"): (120, 3), ("b", "p"): (90, 5), ("a", "q"): (60, 2)}


@pytest.fixture(scope="module")
def sweep(spark):
    df, data = make(spark, SHAPES)
    return df.persist(), data


def check(models, data):
    for r in models.collect():
        x, y, part = data[(r["run_id"], r["probe"])]
        want = reference_fit(x[part == "train"], y[part == "train"])
        assert r["coef"] == pytest.approx(want[:-1].tolist(), abs=1e-5)
        assert r["intercept"] == pytest.approx(want[-1], abs=1e-5)
        assert r["trainable_params"] == x.shape[1] + 1 and r["converged"] and r["iterations"] < 30


@pytest.fixture
def small_tiles(monkeypatch):
    monkeypatch.setattr(blocks, "TILE", 16)
    monkeypatch.setattr(blocks, "FAN_BYTES", 1)  # two parts at a time


def test_probes_of_one_tile(sweep):
    df, data = sweep
    check(probe.fit_probes(df, KEYS), data)


def test_probes_of_many_tiles(sweep, small_tiles):
    df, data = sweep
    check(probe.fit_probes(df, KEYS), data)


def test_columns_of_many_tiles(spark, small_tiles):
    df, data = make(spark, {("a", "p"): (90, 20), ("b", "p"): (12, 3)}, seed=8)
    check(probe.fit_probes(df, KEYS), data)


@pytest.mark.parametrize("tile", [16, 1024])
@pytest.mark.parametrize("shape", [(30, 80), (120, 7)])
def test_both_shapes_by_the_same_way(spark, monkeypatch, tile, shape):
    """More features than rows, and fewer, without PCA and with more components than there are directions."""
    monkeypatch.setattr(blocks, "TILE", tile)
    df, data = make(spark, {("a", "p"): shape}, seed=3)
    x, y, part = data[("a", "p")]
    train = part == "train"
    want = reference_fit(x[train], y[train])
    for dim in (None, 500):
        r = probe.fit_probes(df, KEYS, pca_dim=dim).first()
        assert r["coef"] == pytest.approx(want[:-1].tolist(), abs=1e-6) and r["intercept"] == pytest.approx(want[-1], abs=1e-6)
        assert r["converged"] and r["n_train"] == train.sum()
        if dim or shape[1] > shape[0]:
            assert r["rank"] == min(train.sum() - 1, shape[1])  # centred rows lose one direction
        assert r["pca_dim"] == (dim and min(shape[1], train.sum()))


@pytest.mark.parametrize("tile", [8, 1024])
@pytest.mark.parametrize("shape", [(150, 6), (20, 50)])
def test_pca_then_regression(spark, monkeypatch, tile, shape):
    monkeypatch.setattr(blocks, "TILE", tile)
    df, data = make(spark, {("a", "p"): shape, ("b", "p"): (100, 6)}, seed=5)
    for r in probe.fit_probes(df, KEYS, pca_dim=3).collect():
        x, y, part = data[(r["run_id"], r["probe"])]
        train = part == "train"
        mean = x[train].mean(0)
        axes = np.linalg.svd(x[train] - mean, full_matrices=False)[2][:3]
        want = reference_fit((x[train] - mean) @ axes.T, y[train])
        assert r["coef"] == pytest.approx((axes.T @ want[:-1]).tolist(), abs=1e-6)
        z = x @ np.array(r["coef"]) + r["intercept"]
        assert np.allclose(z, (x - mean) @ axes.T @ want[:-1] + want[-1], atol=1e-5)
        assert r["pca_dim"] == 3 and r["trainable_params"] == 4 and r["converged"]


def test_rank_of_repeated_columns(spark, small_tiles):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(60, 4))
    rows = [("a", "p", i, int(i % 2), "train", [*base[i].tolist(), *base[i].tolist(), 3.0]) for i in range(60)]
    r = probe.fit_probes(spark.createDataFrame(rows, SCHEMA), KEYS, pca_dim=6).first()
    assert r["rank"] == 4 and r["pca_dim"] == 6 and r["converged"] and np.isfinite(r["coef"]).all()


@pytest.mark.parametrize("tile", [16, 1024])
def test_pca_variance(spark, monkeypatch, tile):
    monkeypatch.setattr(blocks, "TILE", tile)
    df, data = make(spark, {("a", "p"): (120, 3), ("b", "p"): (25, 40)}, seed=6)
    shifted = df.withColumn("features", F.transform("features", lambda v: v + 1e6))
    found = pca.fit_pca(shifted, KEYS, ["run_id", "row_idx"], 10)
    for (run, _), (x, y, part) in data.items():
        x = x[part == "train"] + 1e6
        want = np.linalg.svd(x - x.mean(0), compute_uv=False)[:10] ** 2 / (len(x) - 1)
        got = [r["variance"] for r in pca.explained_variance(found, KEYS).filter(F.col("run_id") == run).orderBy("component").collect()]
        assert got == pytest.approx(want.tolist(), rel=1e-6)


def test_clamp():
    assert pca.clamp_dim(None, 5, 5) is None
    assert pca.clamp_dim(512, 100, 30) == 30 and pca.clamp_dim(512, 20, 30) == 20 and pca.clamp_dim(4, 20, 30) == 4


def test_one_class_is_refused(spark):
    df = spark.createDataFrame([("a", "p", i, 1, "train", [float(i)]) for i in range(5)], SCHEMA)
    with pytest.raises(Exception, match="both classes"):
        probe.fit_probes(df, KEYS).collect()


def test_results_and_scores(sweep):
    df, data = sweep
    results, predictions = probe.run_probes(df, KEYS)
    assert predictions.count() == df.count()
    rows = {(r["run_id"], r["probe"]): r for r in results.collect()}
    assert set(rows) == set(data)
    scored = predictions.filter("run_id = 'b'").collect()
    test = [(r["label"], r["p1"], r["pred"]) for r in scored if r["part"] == "test"]
    pos = [p for y, p, _ in test if y == 1]
    neg = [p for y, p, _ in test if y == 0]
    auc = np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])
    assert rows[("b", "p")]["test_auc"] == pytest.approx(auc)
    hits = sum(1 for y, _, c in test if y == c == 1)
    assert rows[("b", "p")]["test_recall"] == pytest.approx(hits / len(pos))
    assert all(c == int(p > 0.5) for _, p, c in test)


def test_generalization_scores_every_pair(spark):
    df, data = make(spark, {("a", "p"): (80, 3), ("b", "p"): (90, 3)}, seed=9)
    split = df.select("run_id", "row_idx", "label", "part")
    got = {(r["train_run"], r["test_run"]): r["auc"] for r in studies.generalization(df.drop("label", "part"), split, ["a", "b"]).collect()}
    assert set(got) == {(x, y) for x in "ab" for y in "ab"}
    xa, ya, pa = data[("a", "p")]
    w = reference_fit(xa[pa == "train"], ya[pa == "train"])
    xb, yb, pb = data[("b", "p")]
    z, y = xb[pb == "test"] @ w[:-1], yb[pb == "test"]
    auc = np.mean([(p > n) + 0.5 * (p == n) for p in z[y == 1] for n in z[y == 0]])
    assert got[("a", "b")] == pytest.approx(auc)


def test_size_summary(spark):
    df = spark.createDataFrame(
        [("r", "p", 0.5, 0.8), ("r", "p", 0.5, 0.9)], "run_id string, probe string, frac double, test_auc double"
    )
    row = studies.size_summary(df).first()
    assert (row["mean"], row["std"]) == (0.85, 0.0707)


def test_every_run_keeps_the_k_it_is_long_enough_for(spark):
    rows = [(run, 0, 0, 0, [1.0 / (i + 1) for i in range(n)], [float(i) for i in range(n)]) for run, n in (("long", 60), ("short", 6))]
    diags = spark.createDataFrame(rows, "run_id string, row_idx long, layer int, head int, attn_diag array<double>, lap_diag array<double>")
    table = studies.spectral_table(diags).filter("top_k > 0").select("run_id", "probe", "top_k", F.size("features").alias("n")).collect()
    assert {(r["run_id"], r["top_k"]) for r in table} == {("long", k) for k in (5, 10, 25, 50)} | {("short", 5)}
    assert all(r["n"] == r["top_k"] for r in table) and len(table) == 5 * 4


def test_scoring_refuses_other_widths(spark):
    rows = spark.createDataFrame([("p", 0, [1.0, 2.0])], "probe string, row_idx long, features array<double>")
    models = spark.createDataFrame([("p", [1.0], 0.0)], "probe string, coef array<double>, intercept double")
    with pytest.raises(Exception, match="differ in width"):
        probe.score(rows, models, ["probe"]).select("p1").collect()


def test_each_k_of_the_perturbation_study_has_its_own_noise(spark):
    rows = [("r", i, 0, h, [0.1] * 4, [float(i % 3), 1.0, 2.0, float(i % 2)]) for i in range(24) for h in range(2)]
    diags = spark.createDataFrame(rows, "run_id string, row_idx long, layer int, head int, attn_diag array<double>, lap_diag array<double>")
    split = spark.createDataFrame([("r", i, i % 2, "test" if i % 4 > 1 else "train") for i in range(24)], "run_id string, row_idx long, label int, part string")
    got = studies.perturbation_study(diags, split, ks=(1, 2), stds=(0.1, None), repeats=2, pca_dim=None).collect()
    assert sorted((r["top_k"], r["std"], r["rep"]) for r in got) == [(k, s, r) for k in (1, 2) for s in (0.0, 0.1) for r in (0, 1)]
    assert len({r["avg_diff_l2_norm"] for r in got if r["std"] > 0}) == 4


def test_each_model_scores_each_row(spark):
    rows = spark.createDataFrame([("p", i, [float(i), 1.0]) for i in range(50)] + [("q", 0, [1.0, 1.0])], "probe string, row_idx long, features array<double>")
    models = spark.createDataFrame([("p", m, [float(m), 0.5], 0.1 * m) for m in range(3)], "probe string, model int, coef array<double>, intercept double")
    scored = probe.score_each(rows, models, ["probe"], ["model"], ["row_idx"])
    got = {(r["row_idx"], r["model"]): r["p1"] for r in scored.collect()}
    assert len(got) == 150
    for (i, m), p in got.items():
        assert p == pytest.approx(1 / (1 + np.exp(-(i * m + 0.5 + 0.1 * m))))
    plan = scored._jdf.queryExecution().optimizedPlan().toString()
    join = plan.index("Join")
    assert "features" not in plan[:join].split("Generate", 1)[0]  # vectors end before rows multiply
    wrong = models.withColumn("coef", F.slice("coef", 1, 1))
    with pytest.raises(Exception, match="differ in width"):
        probe.score_each(rows, wrong, ["probe"], ["model"], ["row_idx"]).collect()


@pytest.mark.parametrize("tile", [16, 1024])
@pytest.mark.parametrize("dim", [None, 3])
def test_samples_equal_probes_of_their_own(spark, monkeypatch, tile, dim):
    """Samples of one copy of the rows, wide and tall ones mixed, against a table with a copy per sample."""
    monkeypatch.setattr(blocks, "TILE", tile)
    df, _ = make(spark, {("a", "p"): (70, 18), ("b", "p"): (60, 5)}, seed=12)
    inside = [F.lit(True), F.col("row_idx") % 3 != 0, F.col("row_idx") < 14, F.col("row_idx") % 2 == 0]
    cells = F.filter(F.array(*[F.when(c, F.struct(F.lit(j).alias("sample"), "part")) for j, c in enumerate(inside)]), lambda m: m.isNotNull())
    once = df.withColumn("members", cells).drop("part")
    copied = df.withColumn("m", F.explode(cells)).withColumn("sample", F.col("m.sample")).drop("m")
    got = {(r["run_id"], r["sample"]): r for r in probe.fit_probes(once, KEYS, pca_dim=dim, samples=4).collect()}
    want = probe.fit_probes(copied, [*KEYS, "sample"], pca_dim=dim).collect()
    assert len(got) == len(want) == 8
    for r in want:
        own = got[r["run_id"], r["sample"]]
        assert own["coef"] == pytest.approx(r["coef"], abs=1e-6) and own["intercept"] == pytest.approx(r["intercept"], abs=1e-6)
        assert (own["n_train"], own["pca_dim"], own["rank"], own["converged"]) == (r["n_train"], r["pca_dim"], r["rank"], True)


def test_sample_results_equal_probes_of_their_own(spark):
    df, _ = make(spark, {("a", "p"): (90, 4)}, seed=13)
    cells = F.filter(F.array(*[F.when(F.col("row_idx") % m != 1, F.struct(F.lit(j).alias("sample"), "part")) for j, m in enumerate((7, 2))]), lambda m: m.isNotNull())
    once = df.withColumn("members", cells).drop("part")
    copied = df.withColumn("m", F.explode(cells)).withColumn("sample", F.col("m.sample")).drop("m")
    results, predictions = probe.run_probes(once, KEYS, samples=2)
    want, expected = probe.run_probes(copied, [*KEYS, "sample"])
    assert predictions.count() == expected.count()
    names = ["sample", "n_train", *[f"{p}_{m}" for p in ("train", "test") for m in probe.METRICS]]
    for a, b in zip(results.select(names).orderBy("sample").collect(), want.select(names).orderBy("sample").collect(), strict=True):
        assert tuple(a) == pytest.approx(tuple(b))

import numpy as np
import pytest
from pyspark.sql import functions as F

from attnloom.operators import metrics, ordering


def brute_auc(y, s):
    pos, neg = s[y == 1], s[y == 0]
    return np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])


def brute_ap(y, s):
    ap, last = 0.0, 0.0
    for t in sorted(set(s), reverse=True):
        hit = s >= t
        tp = (y[hit] == 1).sum()
        recall = tp / (y == 1).sum()
        ap += (recall - last) * tp / hit.sum()
        last = recall
    return ap


def frame(spark, groups):
    rows = [(g, int(y), float(s)) for g, (ys, ss) in groups.items() for y, s in zip(ys, ss)]
    return spark.createDataFrame(rows, "g string, label int, score double")


@pytest.mark.parametrize("rows", [1, 30, 4096])
def test_ranking_metrics_against_brute_force(spark, monkeypatch, rows):
    rng = np.random.default_rng(5)
    groups = {}
    for g, n, digits in (("hot", 900, 2), ("mid", 200, 1), ("tiny", 12, 3)):
        groups[g] = (np.append(rng.integers(0, 2, n - 2), [0, 1]), np.round(rng.normal(size=n), digits))
    original = ordering.value_buckets
    monkeypatch.setattr(
        metrics, "value_buckets", lambda df, group, value: original(df, group, value, buckets=200, rows=rows)
    )
    got = {r["g"]: r for r in metrics.ranking_metrics(frame(spark, groups), ["g"], "label", "score").collect()}
    for g, (y, s) in groups.items():
        assert got[g]["auc"] == pytest.approx(brute_auc(y, s))
        assert got[g]["average_precision"] == pytest.approx(brute_ap(y, s))


def test_auc_does_not_change_under_monotone_maps(spark):
    rng = np.random.default_rng(8)
    y, s = rng.integers(0, 2, 300), rng.normal(size=300)
    df = frame(spark, {"a": (y, s)})
    plain = metrics.ranking_metrics(df, ["g"], "label", "score").first()
    mapped = metrics.ranking_metrics(df.withColumn("score", F.exp("score") * 3 + 1), ["g"], "label", "score").first()
    assert plain["auc"] == pytest.approx(mapped["auc"]) and plain["average_precision"] == pytest.approx(mapped["average_precision"])


def test_single_class(spark):
    df = frame(spark, {"a": ([1, 1], [0.1, 0.2])})
    with pytest.raises(Exception, match="both classes"):
        metrics.ranking_metrics(df, ["g"], "label", "score").collect()
    assert metrics.ranking_metrics(df, ["g"], "label", "score", "null").first()["auc"] is None


def test_threshold_metrics(spark):
    df = spark.createDataFrame([("a", 1, 1), ("a", 1, 0), ("a", 0, 1), ("a", 0, 0), ("b", 0, 0)], "g string, label int, pred int")
    got = {r["g"]: (r["precision"], r["recall"], r["f1"]) for r in metrics.threshold_metrics(df, ["g"], "label", "pred").collect()}
    assert got == {"a": (0.5, 0.5, 0.5), "b": (0.0, 0.0, 0.0)}


def test_buckets_follow_the_value(spark):
    df = spark.range(5000).select(F.lit("g").alias("g"), F.rand(7).alias("v")).persist()
    rows = sorted((r["v"], r["_bucket"]) for r in ordering.value_buckets(df, ["g"], "v", buckets=300, rows=10).collect())
    buckets = [b for _, b in rows]
    assert buckets == sorted(buckets) and len(set(buckets)) > 100
    sizes = np.bincount(buckets)
    assert sizes.max() < 200  # the work spreads


def test_value_buckets_bounds_are_inclusive_of_equal_values(spark):
    df = spark.createDataFrame([("g", float(v)) for v in (1, 1, 2, 3, 3, 3)], "g string, v double")
    got = ordering.value_buckets(df, ["g"], "v", rows=1).collect()
    assert len({(r["v"], r["_bucket"]) for r in got}) == 3


def test_rank_in_hot_group(spark):
    df = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, "cold").otherwise("hot").alias("g"), F.col("id"), (F.hash("id") % 50).alias("v")
    )
    ranked = ordering.rank_in_group(df, ["g"], F.floor(F.col("v") / 7), [F.col("v"), F.col("id")], "rank").collect()
    for g in ("hot", "cold"):
        rows = sorted((r["v"], r["id"], r["rank"]) for r in ranked if r["g"] == g)
        assert [r[2] for r in rows] == list(range(1, len(rows) + 1))


@pytest.mark.parametrize("buckets", [1, 7, 1000])
def test_first_in_group(spark, buckets):
    df = spark.range(600).select(F.when(F.col("id") % 3 == 0, "cold").otherwise("hot").alias("g"), "id", (F.hash("id") % 40).alias("v"))
    quota = spark.createDataFrame([("hot", 133), ("cold", 0)], "g string, quota long")
    by = F.floor((F.col("v") + 40) * buckets / 81)
    rows = ordering.first_in_group(df, ["g"], by, [F.col("v"), F.col("id")], quota).collect()
    for g, n in (("hot", 133), ("cold", 0)):
        own = sorted((r["v"], r["id"], r["chosen"]) for r in rows if r["g"] == g)
        assert [r[2] for r in own] == [i < n for i in range(len(own))]
    whole = spark.createDataFrame([("hot", 400)], "g string, quota long")
    got = ordering.first_in_group(df, ["g"], by, [F.col("v"), F.col("id")], whole).collect()
    assert all(r["chosen"] == (r["g"] == "hot") for r in got) and len(got) == 600


def test_no_value_is_ranked_in_a_split(spark):
    from attnloom.operators import sampling

    labels = spark.range(500).select(F.lit("r").alias("run_id"), F.col("id").alias("row_idx"), (F.col("id") % 2).cast("int").alias("label"))
    plan = sampling.stratified_split(labels)._jdf.queryExecution().executedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window" in line and "row_number" in line]
    assert len(windows) <= 1  # only rows of the bucket in which the quota is reached


def test_counts_are_the_only_read_of_the_input(spark, tmp_path):
    path = str(tmp_path / "scores")
    spark.createDataFrame([("a", i % 2, float(i)) for i in range(20)], "g string, label int, score double").write.parquet(path)
    done = metrics.ranking_metrics(spark.read.parquet(path), ["g"], "label", "score")
    assert "FileScan" not in done._jdf.queryExecution().executedPlan().toString()

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from attnloom.operators import sampling


def labels_frame(spark, n=500, share=0.3, invalid=20):
    return spark.range(n).select(
        F.lit("r").alias("run_id"), F.col("id").alias("row_idx"),
        F.when(F.col("id") < invalid, -1).when(F.col("id") < invalid + int(share * n), 1).otherwise(0).alias("label"),
    )


@pytest.mark.parametrize("test_size,n", [(0.2, 500), (0.25, 333), (0.1, 41)])
def test_split_is_exact_and_disjoint(spark, test_size, n):
    split = sampling.stratified_split(labels_frame(spark, n, invalid=5), test_size).collect()
    valid = n - 5
    assert len(split) == valid == len({r["row_idx"] for r in split})
    test = [r for r in split if r["part"] == "test"]
    assert len(test) == math.ceil(test_size * valid)
    ones = sum(r["label"] for r in split)
    train_ones = sum(r["label"] for r in split if r["part"] == "train")
    assert abs(train_ones - (valid - len(test)) * ones / valid) < 1


def test_split_does_not_depend_on_partitioning(spark):
    base = labels_frame(spark)
    a = {r["row_idx"]: r["part"] for r in sampling.stratified_split(base.repartition(7)).collect()}
    b = {r["row_idx"]: r["part"] for r in sampling.stratified_split(base.coalesce(1)).collect()}
    other = {r["row_idx"]: r["part"] for r in sampling.stratified_split(base, seed=1).collect()}
    assert a == b and a != other


def test_split_statistics(spark):
    split = sampling.stratified_split(labels_frame(spark))
    rows = {r["part"]: r for r in sampling.split_statistics(split).collect()}
    assert set(rows) == {"train", "test", "total"}
    for c in ("n_correct", "n_incorrect", "n_total"):
        assert rows["train"][c] + rows["test"][c] == rows["total"][c]
    assert rows["total"]["ratio"] == round(150 / 330, 3)


def test_train_fractions(spark):
    split = sampling.stratified_split(labels_frame(spark))
    n_train = split.filter("part = 'train'").count()
    got = sampling.train_fractions(split, (0.1, 0.5, 1.0), (1, 2))
    sizes = {(r["frac"], r["seed"], r["part"]): r["count"] for r in got.groupBy("frac", "seed", "part").count().collect()}
    for f in (0.1, 0.5, 1.0):
        for s in (1, 2):
            assert sizes[(f, s, "train")] == math.floor(n_train * f)
            assert sizes[(f, s, "test")] == split.count() - n_train
    whole = got.filter("frac = 1.0 AND seed = 1 AND part = 'train'").select("row_idx").exceptAll(
        split.filter("part = 'train'").select("row_idx")
    )
    assert whole.count() == 0


def test_balanced_samples(spark):
    got = sampling.balanced_samples(labels_frame(spark), 100, (1, 2))
    counts = {(r["seed"], r["label"], r["part"]): r["count"] for r in got.groupBy("seed", "label", "part").count().collect()}
    for s in (1, 2):
        for label in (0, 1):
            assert counts[(s, label, "train")] == 80 and counts[(s, label, "test")] == 20
    one = {r["row_idx"] for r in got.filter("seed = 1").collect()}
    two = {r["row_idx"] for r in got.filter("seed = 2").collect()}
    assert len(one) == 200 and one != two
    with pytest.raises(Exception, match="no more than 150"):
        sampling.balanced_samples(labels_frame(spark), 150, (1,)).collect()


def test_length_order_and_its_inverse(spark):
    texts = ["a", "bb", "ccc", "ddd", "eeee"]
    df = spark.createDataFrame(list(enumerate(texts)), "row_idx long, text string")
    for chunk in (1, 2, 1 << 20):
        pos = {r["row_idx"]: r["pos"] for r in sampling.length_order(df, "text", chunk=chunk).collect()}
        assert [pos[i] for i in range(5)] == [4, 3, 1, 2, 0]
        assert [texts[i] for i in sorted(pos, key=pos.get)] == ["eeee", "ccc", "ddd", "bb", "a"]


def test_perturbation(spark):
    rng = np.random.default_rng(2)
    rows = [("r", i, l, h, rng.normal(size=10 + i).tolist()) for i in range(40) for l in range(2) for h in range(2)]
    diags = spark.createDataFrame(rows, "run_id string, row_idx long, layer int, head int, lap_diag array<double>")
    items = sampling.perturb(diags, (0.1, 10.0, None), 2).persist()
    cells = items.select("row_idx", "std", "rep", "fraction", F.inline("heads")).select(
        "row_idx", "std", "rep", "fraction", F.explode("noise").alias("noise")
    )
    per_item = cells.groupBy("row_idx", "std", "rep").agg(
        F.count("*").alias("n"), F.count_if(F.col("noise") != 0).alias("hit"), F.max("fraction").alias("f")
    ).collect()
    for r in per_item:
        if r["std"] is None:
            assert r["hit"] == 0 and r["f"] == 0
        else:
            assert 0.5 <= r["f"] <= 1 and r["hit"] == int(r["n"] * r["f"])
    spread = cells.filter("noise != 0").groupBy("std").agg(F.stddev("noise").alias("s"), F.avg("noise").alias("m")).collect()
    for r in spread:
        assert r["s"] == pytest.approx(r["std"], rel=0.06) and abs(r["m"]) < 0.1 * r["std"]
    by_hand = np.sqrt(sum(r["noise"] ** 2 for r in cells.filter("row_idx = 3 AND std = 10 AND rep = 1").collect()))
    assert items.filter("row_idx = 3 AND std = 10 AND rep = 1").first()["l2"] == pytest.approx(by_hand)
    sizes = sampling.perturbation_size(items)
    assert sizes.count() == 6
    assert sizes.filter("std IS NULL").first()["avg_diff_l2_norm"] == 0
    summary = sampling.perturbation_summary(sizes).first()
    assert summary["min"] <= summary["mean"] <= summary["max"]
    packed = sampling.perturbed_diagonals(items).filter("std IS NULL AND rep = 0").collect()
    original = {r[1:4]: r[4] for r in rows}
    assert all(original[(r["row_idx"], r["layer"], r["head"])] == pytest.approx(r["lap_diag"]) for r in packed)
    items.unpersist()

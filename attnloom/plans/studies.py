"""Probe sweeps and ablation studies over many runs at once.

Each study builds one feature table whose key holds everything that varies,
then calls the batched fit once: the number of Spark jobs does not grow with
the number of runs, seeds, fractions or noise levels.
"""

from __future__ import annotations

import itertools
from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..operators import metrics, probe, sampling, spectral
from ..schema import EXAMPLE
from ..session import cut_lineage
from . import features as S

# fixed values: grids of the studies
FRACTIONS = (0.01, 0.05, 0.1, 0.2, 0.3, 0.5, 0.75, 1.0)
FRACTION_SEEDS = (42, 123, 420)
SAMPLE_SEEDS = (42, 123, 456, 789, 1000, 1234, 5678, 9101, 1122, 1345)
SAMPLES_PER_CLASS = 1000
PERTURBATION_STDS = (1e-5, 1e-4, 1e-3, 1e-2, 1e-1, None)
PERTURBATION_KS = (5, 10, 20, 50, 100)
PERTURBATION_REPEATS = 5
STUDY_TOP_K = 100
STUDY_PCA = 512


def spectral_table(diags: DataFrame, top_ks: Sequence[int] | None = None, per_layer: bool = True) -> DataFrame:
    """Features of `spectral_probes`: of the given k, or of every candidate a run is long enough for."""
    if top_ks is not None:
        return S.spectral_features(diags, top_ks, per_layer)
    shortest = diags.groupBy("run_id").agg(F.min(F.size("attn_diag")).alias("_shortest"))
    return S.spectral_features(diags.join(shortest, "run_id"), spectral.TOP_K, per_layer, longest="_shortest")


def spectral_probes(
    diags: DataFrame, split: DataFrame, top_ks: Sequence[int] | None = None, pca_dim: int | None = STUDY_PCA,
    all_layers_only: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """Log-determinant, attention and Laplacian probes, per layer and over all layers.

    Without `top_ks` a run uses the candidates no longer than its own shortest
    sequence, whatever the lengths of other runs.
    """
    table = spectral_table(diags, top_ks, per_layer=not all_layers_only)
    return probe.run_probes(S.labelled(table, split), S.PROBE, EXAMPLE, pca_dim)


def hidden_probes(selected: DataFrame, split: DataFrame, pca_dim: int | None = STUDY_PCA) -> tuple[DataFrame, DataFrame]:
    """Probes on the last input and the last generated token, per layer and over all layers."""
    return probe.run_probes(S.labelled(S.hidden_features(selected), split), S.PROBE, EXAMPLE, pca_dim)


def attention_score_probe(diags: DataFrame, split: DataFrame) -> DataFrame:
    """AUC of the raw attention score per run, layer (or all) and part; nothing is trained."""
    scored = spectral.attention_score_with_all(diags).join(split, EXAMPLE)
    return metrics.score_only_metrics(scored, ["run_id", "layer", "part"], "label", "attn_score")


def generalization(
    features: DataFrame, split: DataFrame, runs: Sequence, pca_dim: int | None = None
) -> DataFrame:
    """Every run's probe on the test rows of every run.

    `features` has one row per example and `probe`. A test row meets the stacked
    models of all runs in one join; its vector is not repeated per model.
    """
    labelled = S.labelled(features, split).persist(StorageLevel.MEMORY_AND_DISK)
    train_side = labelled.filter((F.col("part") == "train") & F.col("run_id").isin(list(runs))).withColumnRenamed("run_id", "train_run")
    models = probe.fit_probes(train_side, ["probe", "train_run"], ["train_run", "row_idx"], pca_dim)
    test_rows = labelled.filter(F.col("part") == "test").withColumnRenamed("run_id", "test_run")
    scored = cut_lineage(probe.score_each(test_rows, models, ["probe"], ["train_run"], ["test_run", "row_idx"]))
    labelled.unpersist()
    return metrics.probe_metrics(scored, ["probe", "train_run", "test_run"])


def _all_layers(diags: DataFrame, top_k: int, families: Sequence[str]) -> DataFrame:
    return S.spectral_features(diags, [top_k], per_layer=False, families=families)


def _resampled(table: DataFrame, samples: DataFrame, grid: dict[str, list], pca_dim: int | None) -> DataFrame:
    """Probes of every cell of `grid`, from one copy of each feature vector.

    `samples` has a narrow row per example and cell it is in. An example carries
    the list of its cells, at most as long as the grid.
    """
    cells = list(itertools.product(*grid.values()))
    values = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(grid, cell)]) for cell in cells])
    place = (F.array_position(values, F.struct(*[F.col(n) for n in grid])) - 1).cast("int")
    members = samples.groupBy(*EXAMPLE, "label").agg(F.collect_list(F.struct(place.alias("sample"), "part")).alias("members"))
    results, _ = probe.run_probes(table.join(members, EXAMPLE), ["run_id", "probe"], EXAMPLE, pca_dim, samples=len(cells))
    cell = F.element_at(values, F.col("sample") + 1)
    return results.select("*", *[cell[n].alias(n) for n in grid]).drop("sample")


def temperature_study(
    diags: DataFrame, labels: DataFrame, top_k: int = STUDY_TOP_K, per_class: int = SAMPLES_PER_CLASS,
    seeds: Sequence[int] = SAMPLE_SEEDS, pca_dim: int | None = None, order: sampling.RandomOrder = sampling.HASHED,
) -> DataFrame:
    """Three probes on balanced resamples of every run (one run per temperature)."""
    samples = sampling.balanced_samples(labels, per_class, seeds, order=order)
    table = _all_layers(diags, top_k, ("attn_log_det", "attn_eigval_topk", "laplacian_eigval_topk"))
    return _resampled(table, samples, {"seed": list(seeds)}, pca_dim)


def size_study(
    diags: DataFrame, split: DataFrame, top_k: int = STUDY_TOP_K, fractions: Sequence[float] = FRACTIONS,
    seeds: Sequence[int] = FRACTION_SEEDS, pca_dim: int | None = STUDY_PCA, order: sampling.RandomOrder = sampling.HASHED,
) -> DataFrame:
    """Attention and Laplacian probes on growing shares of the training part."""
    samples = sampling.train_fractions(split, fractions, seeds, order)
    table = _all_layers(diags, top_k, ("attn_eigval_topk", "laplacian_eigval_topk"))
    return _resampled(table, samples, {"frac": [float(f) for f in fractions], "seed": list(seeds)}, pca_dim)


def size_summary(results: DataFrame) -> DataFrame:
    """Mean and deviation of the test AUC over seeds, to four digits."""
    return results.groupBy("run_id", "probe", "frac").agg(
        F.round(F.avg("test_auc"), 4).alias("mean"), F.round(F.stddev_samp("test_auc"), 4).alias("std")
    )


def perturbation_study(
    diags: DataFrame, split: DataFrame, ks: Sequence[int] = PERTURBATION_KS,
    stds: Sequence[float | None] = PERTURBATION_STDS, repeats: int = PERTURBATION_REPEATS,
    pca_dim: int | None = STUDY_PCA, uniform: sampling.Uniform = sampling.hashed_uniform,
) -> DataFrame:
    """Laplacian probes on noisy diagonals, with the size of the noise beside the metrics.

    Every (k, std, repeat) draws its own noise, so the results of two k are
    independent. std 0 in the result stands for unchanged diagonals.
    """
    # one draw per k and repeat: draw = position of k * repeats + repeat
    items = sampling.perturb(diags, stds, repeats * len(ks), uniform=uniform)
    top_k = F.element_at(F.array(*[F.lit(k) for k in ks]), F.floor(F.col("rep") / repeats).cast("int") + 1).alias("top_k")
    rep = (F.col("rep") % repeats).alias("rep")
    noisy = sampling.perturbed_diagonals(items).withColumn("std", F.coalesce("std", F.lit(0.0)))
    item = ["run_id", "row_idx", "std", "rep"]
    ranked = noisy.select(*item, "layer", "head", F.sort_array("lap_diag", asc=False).alias("_lap"))
    drawn = ranked.select("run_id", "row_idx", "std", top_k, rep, "layer", "head", "_lap")
    values = F.coalesce(*[F.when(F.col("top_k") == k, A.first_k(F.col("_lap"), k)) for k in ks]).alias("vals")
    per_head = drawn.select(*item, "top_k", "layer", "head", values)
    table = spectral.flatten_features(per_head, "vals", example=[*item, "top_k"])
    results, _ = probe.run_probes(table.join(split, EXAMPLE), ["run_id", "top_k", "std", "rep"], EXAMPLE, pca_dim)
    sizes = sampling.perturbation_size(items).withColumn("std", F.coalesce("std", F.lit(0.0)))
    sizes = sizes.withColumn("top_k", top_k).withColumn("rep", rep)
    return results.join(sizes, ["run_id", "top_k", "std", "rep"])

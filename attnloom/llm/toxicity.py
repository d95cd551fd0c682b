"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are the distinct hashes of its words, of the first few bytes
of longer words (compounds are rarely seen twice), of word pairs and of pairs
with one word between, in BUCKETS places. The learner keeps per coordinate the
sums of the proximal form, so each has its own rate, and L1 leaves most weights
at zero: the model is a few thousand (place, weight) pairs, sent to all tasks.

Fitting takes a bounded sample of labelled rows, about MOST_ROWS of each class
chosen by hash and at most MOST_PLACES places in all, in one task. Scoring reads
every text whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType, StructField, StructType

from .common import free_name, read_table, slices, small_join, sparing, stored
from .hashing import SIGNS, scramble, words_and_stems

BUCKETS = 1 << 20
MOST_ROWS, MOST_PLACES = 6000, 1 << 26
#: Bytes of text whose features are held at once.
SLICE = 1 << 19
EPOCHS, RATE, SMOOTH, L1, L2 = 6, 0.5, 1.0, 4.0, 0.1
STEMS = (4, 5, 6)
_NEXT, _SKIP = np.uint64(0x9FB21C651E98DF25), np.uint64(0xC2B2AE3D27D4EB4F)


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, place) of each word, stem, word pair and skip pair, repeats included."""
    hashes, first, stems = words_and_stems(column, SIGNS, STEMS)
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    found = [(row, hashes), *((row[at], of) for at, of in stems)]
    for gap, factor in ((1, _NEXT), (2, _SKIP)):
        same = row[gap:] == row[:-gap]
        found.append((row[gap:][same], scramble(hashes[:-gap] * factor + hashes[gap:])[same]))
    return np.concatenate([r for r, _ in found]), (np.concatenate([h for _, h in found]) >> np.uint64(44)).astype(np.int64)


class Ftrl:
    """Per-coordinate FTRL-proximal for 0/1 features; the last place is the intercept, free of L1."""

    def __init__(self, places: int = BUCKETS) -> None:
        self.z, self.n = np.zeros(places + 1), np.zeros(places + 1)

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        z = self.z[at]
        shrunk = np.sign(z) * np.maximum(np.abs(z) - L1, 0)
        return -shrunk / ((SMOOTH + np.sqrt(self.n[at])) / RATE + L2)

    def learn(self, at: np.ndarray, label: int) -> None:
        w = self.weights(at)
        w[-1] = -self.z[-1] / ((SMOOTH + math.sqrt(self.n[-1])) / RATE)
        gradient = 1 / (1 + math.exp(-min(max(w.sum(), -35.0), 35.0))) - label
        grown = self.n[at] + gradient * gradient
        self.z[at] += gradient - (np.sqrt(grown) - np.sqrt(self.n[at])) / RATE * w
        self.n[at] = grown

    def model(self) -> tuple[np.ndarray, np.ndarray, float]:
        w = self.weights(slice(None, -1))
        at = np.flatnonzero(w)
        return at, w[at], float(-self.z[-1] / ((SMOOTH + math.sqrt(self.n[-1])) / RATE))


@sparing
def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Labelled rows (doc_id, mix, toxic, text) with the distinct places of their features, as bytes, instead of the text."""
    for batch in batches:
        for part in slices(batch, "text", SLICE):
            row, place = features(part.column(3))
            pairs = np.unique(row * BUCKETS + place)
            cuts = np.searchsorted(pairs, np.arange(1, part.num_rows) * BUCKETS)
            own = [(p % BUCKETS).astype("<i4").tobytes() for p in np.split(pairs, cuts)]
            yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(own, pa.binary())], ["doc_id", "mix", "toxic", "places"])


@sparing
def _fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Weights from rows (toxic, places) in their order, as far as MOST_PLACES reach."""
    examples, labels, held = [], [], 0
    for batch in batches:
        for label, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            own = np.frombuffer(data, "<i4")
            held += len(own)
            if held <= MOST_PLACES:
                examples.append(own)
                labels.append(label)
    if not examples:
        return
    learner, last = Ftrl(), np.array([BUCKETS], np.int32)
    for _ in range(EPOCHS):
        for own, label in zip(examples, labels, strict=True):
            learner.learn(np.concatenate([own, last]), label)
    at, w, bias = learner.model()
    yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(w, bias))], ["place", "weight"])


def held_out(doc_id: Column | str) -> Column:
    """crc32 of the id as text modulo 5 is 0; false for a null id."""
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Places and weights (place -1: intercept), learned only from rows that are not held out.

    Labels that are null or of null ids are not used; of repeated labels the
    larger counts; of the texts of a repeated id the one whose places are first
    in byte order is learned. Without both classes the model is empty, or an intercept of
    the only class.
    """
    known = labels.filter("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = stored(known.filter(~held_out("doc_id")).withColumn("mix", F.xxhash64("doc_id")), "toxic-labels")
    totals = {int(r[0]): int(r[1]) for r in known.groupBy("toxic").count().collect()}
    if len(totals) < 2:
        only = 30.0 if totals.get(1) else -30.0
        return np.array([-1]), np.array([only])
    # a share by hash that leaves about MOST_ROWS of each class
    share = F.when(F.col("toxic") == 1, min(1.0, MOST_ROWS / totals[1])).otherwise(min(1.0, MOST_ROWS / totals[0]))
    picked = stored(known.filter((F.pmod(F.col("mix"), F.lit(1 << 20)) / (1 << 20)) < share), "toxic-sample")
    rows = small_join(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), picked, "doc_id").select("doc_id", "mix", "toxic", "text")
    rows = rows.mapInArrow(_places, StructType([*rows.schema.fields[:3], StructField("places", BinaryType())]))
    # one row per id, before the rows meet, so that copies of an id do not
    rows = stored(rows.groupBy("mix", "doc_id", "toxic").agg(F.min("places").alias("places")), "toxic-examples")
    ordered = rows.coalesce(1).sortWithinPartitions("mix", "doc_id").select("toxic", "places")
    model = stored(ordered.mapInArrow(_fit, "place long, weight double"), "toxic-model").toPandas()
    if not len(model):
        return np.array([-1]), np.array([-30.0])
    return model["place"].to_numpy(), model["weight"].to_numpy()


def with_scores(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], column: str) -> DataFrame:
    """`docs` with the probability of label 1 of each whole text; null and empty texts get that of the intercept."""
    at, w = model
    bias, at, w = float(w[at == -1].sum()), at[at >= 0], w[at >= 0]

    @sparing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense = np.zeros(BUCKETS)
        dense[at] = w
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                row, place = features(part.column(part.schema.get_field_index("text")))
                used = dense[place] != 0
                pairs = np.unique(row[used] * BUCKETS + place[used])
                total = bias + np.bincount(pairs // BUCKETS, weights=dense[pairs % BUCKETS], minlength=part.num_rows)
                score = 1 / (1 + np.exp(-np.clip(total, -35, 35)))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(score)], [*part.schema.names, column])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(column, DoubleType())]))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of `docs` (doc_id, text), repeated rows included.

    Only the text enters a score. An empty table gives no rows; other columns are ignored.
    """
    docs = docs.select("doc_id", "text")
    scored = with_scores(docs, fit(docs, labels), "score")
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of `docs`, all columns, whose score stays under 0.5; repeated rows, null and empty texts and an empty table as in `toxicity`."""
    score = free_name(docs, "score")
    return with_scores(docs, fit(docs, labels), score).filter(F.col(score) < 0.5).drop(score)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))

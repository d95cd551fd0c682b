"""Incremental feature extraction over arriving attention shards.

In matrix form every feature of a head depends on its own row only, so the same
functions serve batch and stream. Repeated heads are dropped by a keyed state
store: a batch looks up its own keys and reads nothing that is stored, so its
cost does not grow with history. The file sink commits a batch once, also when it
is replayed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import arrays as A
from ..operators import attention
from ..schema import HEAD

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def head_features(matrices: DataFrame) -> DataFrame:
    """Diagonals and log-determinant of every head; works on batch and streaming tables."""
    d = attention.diagonals(matrices)
    return d.select(*HEAD, "attn_diag", "lap_diag", A.mean_log(F.col("attn_diag")).alias("log_det"))


def read_shards(
    spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int | None = None
) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def first_of_each(
    features: DataFrame, key: Sequence[str] = HEAD, arrival: str | None = None, delay: str = "1 day"
) -> DataFrame:
    """A stream with one row per key.

    The state holds keys, spread by their hash. With `arrival`, a time column of
    the stream, a key is forgotten once it is `delay` older than the newest row,
    which bounds the state; repeats have to come within that time.
    """
    if arrival is None:
        return features.dropDuplicates(list(key))
    return features.withWatermark(arrival, delay).dropDuplicatesWithinWatermark(list(key))


def run_available(
    spark: SparkSession, source: str, target: str, checkpoint: str, schema: T.StructType, files_per_batch: int | None = None,
    run: str = "run_id",
) -> None:
    """Process every shard that is there and stop; a later call goes on where this one ended."""
    features = first_of_each(head_features(read_shards(spark, source, schema, files_per_batch)))
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)  # keys beyond memory go to disk
    try:
        query = (
            features.writeStream.format("parquet")
            .partitionBy(run)
            .option("path", target)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)

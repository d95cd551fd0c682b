"""Helpers shared by the operators: stored steps, joins on hot keys, Arrow batches."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path, shared_dir

WORD = "[^\\x20\\x09-\\x0D]+"
HOT_KEYS, HOT_ROWS = 64, 1000
#: How this Python worker lets go of what tasks of one operator remember for the next of their kind.
FORGET: list[Callable[[], None]] = []


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, label: str) -> DataFrame:
    """`df` written to the shared folder and read back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def removed(*steps: DataFrame) -> None:
    """Delete the folders of `stored` steps that no later step reads, so that disk holds only steps in use.

    Call it when everything derived from them is stored itself: a lost executor
    then needs none of them again. Folders outside the shared one stay. Spark
    deletes the shuffle files of finished steps once the driver has collected
    them as garbage, which it is asked to do here, as a driver with memory to
    spare leaves them on the executors' disks.
    """
    for step in steps:
        spark = step.sparkSession
        jvm = spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(shared_dir(spark)).toUri().getPath()
        for folder in {name.rpartition("/")[0] for name in step.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI.create(folder))
            if path.getParent().toUri().getPath() == root:
                path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    gc.collect()
    if steps:
        steps[0].sparkSession.sparkContext._jvm.System.gc()


def spread_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Join on `key`, of which `right` has few rows per value while one value may hold a third of `left`.

    The at most HOT_KEYS most frequent values of `left` (of HOT_ROWS rows or
    more) go by a broadcast of their `right` rows, everything else by an
    ordinary join. No other value can hold more than 1 / HOT_KEYS of the rows.
    """
    top = left.filter(F.col(key).isNotNull()).groupBy(key).count().filter(F.col("count") >= HOT_ROWS)
    hot = [r[0] for r in top.orderBy(F.desc("count"), key).limit(HOT_KEYS).collect()]
    if not hot:
        return left.join(right, key, how)
    is_hot = F.col(key).isin(hot)
    cold = left.filter(~F.coalesce(is_hot, F.lit(False))).join(right.filter(~is_hot), key, how)
    return cold.unionByName(left.filter(is_hot).join(F.broadcast(right.filter(is_hot)), key, how))


def small_join(left: DataFrame, right: DataFrame, on: list[str] | str, how: str = "inner", rows: int = 200_000) -> DataFrame:
    """Join that broadcasts `right` when its counted rows stay within `rows`; `right` should be stored."""
    return left.join(F.broadcast(right) if right.count() <= rows else right, on, how)


def _spare(run: Callable, batches: Iterator[pa.RecordBatch], forget: bool) -> Iterator[pa.RecordBatch]:
    for let_go in FORGET if forget else ():
        let_go()
    try:
        yield from run(batches)
    finally:
        pa.default_memory_pool().release_unused()


def sparing(run: Callable, forget: bool = True) -> Callable:
    """`run` of a mapInArrow, in a worker that holds no more than it needs.

    Workers outlive their tasks and share an executor's memory with its heap. So
    what other operators remember there goes first (`forget`), and memory that
    Arrow has freed goes back to the system when the task ends.
    """

    @wraps(run)
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _spare(run, batches, forget)

    return task


def texts(column: pa.Array) -> pa.Array:
    """Null texts as empty, with 64-bit offsets."""
    return pc.fill_null(column.cast(pa.large_string()), "")


def slices(batch: pa.RecordBatch, text: str, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Runs of whole rows with about `limit` bytes of text each, so that working memory stays bounded."""
    sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0).to_pylist()
    start = held = 0
    for i, n in enumerate(sizes):
        if held and held + n > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < batch.num_rows:
        yield batch.slice(start)


def free_name(df: DataFrame, name: str) -> str:
    """`name`, with underscores behind it until `df` has no such column in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))

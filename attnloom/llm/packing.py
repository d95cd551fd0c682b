"""Best-fit packing with certified bin counts.

Documents become token ids with an end id; longer ones are cut into pieces of
CAPACITY, the first piece shorter. Full pieces are sequences of their own. The
other pieces are dealt by hash to partitions of about GROUP pieces, each packed
by best-fit decreasing. Dual-feasible functions give a lower bound of the bins
of each partition: where it is met, the partition is certified and done. The
others release the pieces of bins that are not full; these are dealt anew, so
that partitions with gaps exchange documents, and packed again. A new packing
replaces the old one only if it takes fewer bins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, slices, sparing, stored
from .encoding import encoder, tokenizer_path

CAPACITY, END_ID = 1024, 2
GROUP, ROUNDS = 20_000, 3
PIECE = "key long, doc_id long, piece int, start long, length long, ids binary"


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """key, doc_id, piece, start, length, ids (little-endian unsigned 32-bit) of every document, stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer)
        key = TaskContext.get().partitionId() << 33
        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                rows = []
                texts = [t or "" for t in part.column("text").to_pylist()]
                for doc, ids in zip(part.column("doc_id").to_pylist(), own.encode(texts), strict=True):
                    ids = np.append(ids, END_ID).astype("<u4")
                    stops = range((len(ids) - 1) % capacity + 1, len(ids) + 1, capacity)
                    start = 0
                    for k, stop in enumerate(stops):
                        rows.append((key, doc, k, start, stop - start, ids[start:stop].tobytes()))
                        start, key = stop, key + 1
                columns = list(zip(*rows, strict=True))
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["key", "doc_id", "piece", "start", "length", "ids"])

    return stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(sparing(run, forget=False), PIECE), "pieces")


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin and offset of each length by best-fit decreasing, and the number of bins."""
    order = np.argsort(-lengths, kind="stable")
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_rooms = bins = 0
    bin_of, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    for i, n in zip(order.tolist(), lengths[order].tolist(), strict=True):
        fitting = open_rooms >> n
        if fitting:
            gap = n + (fitting & -fitting).bit_length() - 1
            b = room[gap].pop()
            if not room[gap]:
                open_rooms ^= 1 << gap
        else:
            gap, b, bins = capacity, bins, bins + 1
        bin_of[i], offset[i] = b, capacity - gap
        left = gap - n
        if left:
            room[left].append(b)
            open_rooms |= 1 << left
    return bin_of, offset, bins


def least_bins(lengths: np.ndarray, capacity: int) -> int:
    """Lower bound of the bins by two families of dual-feasible functions.

    For each k up to half the capacity, lengths over capacity - k count as whole
    bins and those under k as nothing. For each k up to 32, a length x counts
    floor((k + 1) x / capacity) / k bins, or its own share where (k + 1) x is a
    multiple of the capacity.
    """
    if not len(lengths):
        return 0
    count = np.bincount(lengths, minlength=capacity + 1)
    weight = count * np.arange(capacity + 1)
    counts, weights = np.cumsum(count), np.cumsum(weight)
    k = np.arange(0, capacity // 2 + 1)
    below = np.where(k > 0, weights[k - 1], 0)
    best = int(np.ceil(((counts[-1] - counts[capacity - k]) * capacity + weights[capacity - k] - below) / capacity).max())
    x = np.arange(capacity + 1)
    for k in range(1, 33):
        scaled = (k + 1) * x
        # in units of 1 / (capacity * k) bins, so that all is whole numbers
        value = np.where(scaled % capacity == 0, x * k, scaled // capacity * capacity)
        best = max(best, -(-int((count * value).sum()) // (capacity * k)))
    return best


def _packer(level: int, capacity: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("key", ignore_index=True)
        lengths = rows["length"].to_numpy()
        bin_of, offset, bins = best_fit(lengths, capacity)
        filled = np.bincount(bin_of, weights=lengths, minlength=bins)
        done = (filled[bin_of] == capacity) | (bins == least_bins(lengths, capacity))
        sequence = (level << 56) + (int(rows["part"].iloc[0]) << 20) + bin_of
        return pd.DataFrame({"key": rows["key"], "length": lengths, "sequence_id": sequence, "offset": offset, "settled": done})

    return run


def pack(items: DataFrame, capacity: int = CAPACITY, group: int = GROUP, rounds: int = ROUNDS) -> DataFrame:
    """key, sequence_id, offset for every item (key, length up to `capacity`), gapless in each sequence."""
    full = items.filter(F.col("length") == capacity)
    placed = full.select("key", (-1 - F.col("key")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    left, before = items.filter(F.col("length") < capacity).select("key", "length"), None
    for level in range(1, rounds + 1):
        parts = max(1, -(-left.count() // group))
        dealt = left.select("key", "length", F.pmod(F.xxhash64("key", F.lit(level)), F.lit(parts)).alias("part"))
        packed = stored(dealt.groupBy("part").applyInPandas(_packer(level, capacity), "key long, length long, sequence_id long, offset long, settled boolean"), "packed")
        if before is not None and packed.select("sequence_id").distinct().count() >= before.select("sequence_id").distinct().count():
            break
        before = packed.filter("not settled")
        placed = placed.unionByName(packed.filter("settled").select("key", "sequence_id", "offset"))
        left = before.select("key", "length")
        if parts == 1 or before.isEmpty():
            break
    return placed.unionByName(before.select("key", "sequence_id", "offset"))


def packed_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, ids: Column | None = None) -> DataFrame:
    """Per piece of every row of `docs` (doc_id, text): doc_id, piece, start, length, ids, sequence_id, offset.

    `ids` may be an expression of the ids that stands in their place, so that
    the ids themselves are not moved. A null or empty text is its end id alone. Rows with repeated or null ids are
    packed each for itself. An empty table gives no rows; other columns are ignored.
    """
    cut = pieces(docs, tokenizer, capacity)
    places = pack(cut.select("key", "length"), capacity)
    shown = cut.select("key", "doc_id", "piece", "start", "length", F.col("ids") if ids is None else ids)
    return shown.join(places, "key").drop("key")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_documents(read_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), ids=F.crc32("ids").alias("ids_crc32"))

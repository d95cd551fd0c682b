"""Token ids in flat binary files, memory-mapped.

A part holds documents in ascending doc_id order and consists of
`<part>.ids` (unsigned integers, 16 bits where the vocabulary allows, else 32,
little endian), `<part>.offsets` (64-bit, one more than documents, in ids from
the start of the part) and `<part>.docs` (64-bit doc_ids). `parts.parquet` names
the parts in order with their base: the ids of all earlier parts, by prefix sums.
Global offset of a document = base + its offset.

A task writes to names of its own attempt and renames last, so repeated or
speculative attempts leave whole files. Files go through Arrow's file systems;
where the folder is local they are memory-mapped for reading.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import scratch_path
from .common import read_table, slices, stored
from .encoding import encoder, tokenizer_path

END_ID = 2


def _place(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder) if ":" in folder else (fs.LocalFileSystem(), folder)


def _writer(folder: str, tokenizer: str, width: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer)
        system, path = _place(folder)
        part, attempt = f"part-{TaskContext.get().partitionId():07d}", uuid.uuid4().hex
        least, ids_file = None, None
        docs: list[int] = []
        sizes: list[int] = []
        for batch in batches:
            for rows in slices(batch, "text", 2 << 20):
                if ids_file is None:
                    system.create_dir(path, recursive=True)
                    ids_file = system.open_output_stream(f"{path}/{attempt}.ids")
                    least = rows.column("doc_id")[0].as_py()
                docs += rows.column("doc_id").to_pylist()
                for ids in own.encode([t or "" for t in rows.column("text").to_pylist()]):
                    ids_file.write(np.append(ids, END_ID).astype(width).tobytes())
                    sizes.append(len(ids) + 1)
        if ids_file is None:
            return
        ids_file.close()
        offsets = np.zeros(len(sizes) + 1, "<i8")
        np.cumsum(sizes, out=offsets[1:])
        for kind, values in (("offsets", offsets), ("docs", np.array(docs, "<i8"))):
            with system.open_output_stream(f"{path}/{attempt}.{kind}") as out:
                out.write(values.tobytes())
        for kind in ("ids", "offsets", "docs"):
            system.move(f"{path}/{attempt}.{kind}", f"{path}/{part}.{kind}")
        columns = [[part], [least], [len(sizes)], [int(offsets[-1])]]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["part", "least", "docs", "ids"])

    return run


def _width(tokenizer: str) -> str:
    return "<u2" if encoder(tokenizer).tokenizer.get_vocab_size() <= 1 << 16 else "<u4"


def write_token_files(docs: DataFrame, folder: str, tokenizer: str) -> DataFrame:
    """Write all rows of `docs` (doc_id, text) that have a doc_id, in its order; returns the stored list of parts.

    part, least (first doc_id), docs, ids, width, base. Rows of one doc_id lie in
    the order of their texts, null first. Null and empty texts are an end id.
    Rows without a doc_id have no place in the order and are not written; other
    columns are ignored; an empty table gives no parts.
    """
    width = _width(tokenizer)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id is not null")
    # rows of one id never part, as the range is by id alone
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    parts = stored(ordered.mapInArrow(_writer(folder, tokenizer, width), "part string, least long, docs long, ids long"), "parts")
    before = Window.orderBy("least").rowsBetween(Window.unboundedPreceding, -1)
    return stored(parts.withColumns({"width": F.lit(width), "base": F.coalesce(F.sum("ids").over(before), F.lit(0))}), "part-bases")


def _bytes(system: fs.FileSystem, path: str) -> memoryview:
    if isinstance(system, fs.LocalFileSystem):
        if not system.get_file_info(path).size:
            return memoryview(b"")
        return memoryview(pa.memory_map(path).read_buffer())
    with system.open_input_file(path) as f:
        return memoryview(f.read())


def open_part(folder: str, part: str, width: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """doc_ids, offsets and ids of one part, as views of the mapped files."""
    system, path = _place(folder)
    of = {k: _bytes(system, f"{path}/{part}.{k}") for k in ("docs", "offsets", "ids")}
    return np.frombuffer(of["docs"], "<i8"), np.frombuffer(of["offsets"], "<i8"), np.frombuffer(of["ids"], width)


def _reader(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                docs, offsets, ids = open_part(folder, row["part"], row["width"])
                for at in range(0, len(docs), 5000):
                    own = slice(at, at + 5000)
                    crc = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(offsets[:-1][own], offsets[1:][own], strict=True)]
                    columns = [docs[own], offsets[:-1][own] + row["base"], np.diff(offsets)[own], np.array(crc, np.int64)]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return run


def read_token_files(parts: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files; one task per part."""
    count = max(1, parts.count())
    each = parts.repartitionByRange(count, "least")
    return each.mapInArrow(_reader(folder), "doc_id long, start long, n_tokens long, ids_crc32 long")


def op5_token_id_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "token-files")
    parts = write_token_files(read_table(spark, sf_dir, "documents"), folder, tokenizer_path("word_bpe_49k.json"))
    return read_token_files(parts, folder)

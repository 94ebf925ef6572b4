"""Token ids of a corpus in files of range-coded blocks, in ascending order of document ids.

A file is what one task writes: a table part of (file, block, first, n_tokens, data). `data` is the
whole block in bytes: coded ids, an index of its documents and a checksum. Documents are never
divided, so every block can be read by itself.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .packing import batches_of
from .range_coder import pack_block, unpack_block
from .tokens import encoder

#: Ids of a block, unless one document has more.
BLOCK = 1 << 20
_BLOCKS = "file int, block int, first bigint, n_tokens bigint, data binary"
_COUNT = struct.Struct("<QI")


def _index(first: int, ids: list[int | None], lengths: list[int]) -> bytes:
    known = np.array([i is not None for i in ids], np.uint8)
    return _COUNT.pack(first, len(ids)) + np.array([i or 0 for i in ids], "<i8").tobytes() + known.tobytes() + np.array(lengths, "<u4").tobytes()


def _from_index(index: bytes) -> tuple[int, list[int | None], np.ndarray]:
    first, n = _COUNT.unpack_from(index)
    ids = np.frombuffer(index, "<i8", n, _COUNT.size).tolist()
    known = np.frombuffer(index, np.uint8, n, _COUNT.size + 8 * n)
    return first, [i if k else None for i, k in zip(ids, known)], np.frombuffer(index, "<u4", n, _COUNT.size + 9 * n)


def write(docs: DataFrame, path: str, tokenizer: str, vocabulary: int, end_id: int, id_col: str = "doc_id", text: str = "text") -> None:
    """Writes the ids of every whole text, each followed by `end_id`, in ascending order of the ids.

    Null ids come first; equal ids follow each other, equal rows too; null texts are empty. An empty
    table makes a table without blocks. Rows are dealt to tasks by id and text, so rows that share an
    id need not meet in one task.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    order = [F.col("id").asc_nulls_first(), F.xxhash64("body")]
    rows = docs.select(F.col(id_col).cast("long").alias("id"), body.alias("body")).repartitionByRange(*order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, known = TaskContext.get().partitionId(), encoder(tokenizer, blanks=False)
        end = end_id.to_bytes(4, "little")
        ids: list[int | None] = []
        parts: list[bytes] = []
        block = first = held = 0

        def made() -> pa.RecordBatch:
            data = pack_block(np.frombuffer(b"".join(parts), "<u4"), _index(first, ids, [len(p) // 4 for p in parts]), vocabulary)
            return pa.RecordBatch.from_arrays([pa.array([file], pa.int32()), pa.array([block], pa.int32()), pa.array([first]), pa.array([held]), pa.array([data], pa.binary())], names=["file", "block", "first", "n_tokens", "data"])

        for b in batches:
            at = 0
            own = b.column(0).to_pylist()
            for texts in batches_of(b.column(1).to_pylist()):
                for coded in known.encode(texts):
                    coded += end
                    if parts and held + len(coded) // 4 > BLOCK:
                        yield made()
                        block, first, held = block + 1, first + held, 0
                        ids.clear()
                        parts.clear()
                    ids.append(own[at])
                    parts.append(coded)
                    held += len(coded) // 4
                    at += 1
        if parts:
            yield made()

    rows.mapInArrow(run, _BLOCKS).write.parquet(path)


def read(spark: SparkSession, path: str, id_col: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """Per document: id, start (ids of all documents before it), n_tokens, ids_crc32 and, if wanted, ids.

    A damaged block ends the job with an error.
    """
    blocks = spark.read.parquet(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids, index = unpack_block(data)
                first, own, lengths = _from_index(index)
                ends = np.cumsum(lengths, dtype=np.int64)
                starts = ends - lengths
                raw = memoryview(ids.astype("<u4").tobytes())
                crcs = [zlib.crc32(raw[4 * s : 4 * e]) for s, e in zip(starts.tolist(), ends.tolist())]
                cols = [pa.array(own, pa.int64()), pa.array([file] * len(own), pa.int32()), pa.array(first + starts), pa.array(lengths.astype(np.int64)), pa.array(crcs, pa.int64())]
                if with_ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(np.append(starts, ends[-1]).astype(np.int32)), pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(cols, names=["id", "file", "at", "n_tokens", "ids_crc32", *["ids"] * with_ids])

    schema = "id bigint, file int, at bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids
    found = blocks.select("file", "data").mapInArrow(run, schema)
    sizes = blocks.groupBy("file").agg(F.sum("n_tokens").alias("n"))
    # One row for each task that wrote.
    before = sizes.select("file", F.expr("sum(n) OVER (ORDER BY file) - n").alias("before"))
    return found.join(F.broadcast(before), "file").select(F.col("id").alias(id_col), (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)

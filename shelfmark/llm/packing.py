"""Sum-of-squares packing of tokenised documents into sequences.

A piece goes where the sum, over all gaps, of the squared number of open sequences with that gap
becomes smallest. Counts of many different gaps stay small, so that for almost every length an open
sequence with a matching gap is at hand.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import materialize
from .tokens import encoder

CAPACITY = 2048
#: Pieces that one task places. Each group leaves a few sequences partly empty.
GROUP = 100_000
#: Texts, and their characters, that are encoded at a time.
TEXTS, CHARS = 500, 4 << 20
#: Pieces that a worker remembers: far fewer than it could, since other stages have filled the executor before.
CACHE = 300_000

_PIECES = "piece int, start bigint, length bigint, ids_crc32 bigint"
_PLACES = "sequence_id bigint, offset bigint"


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """Start and length of the pieces of n tokens; only the first may be shorter than `capacity`."""
    first = n % capacity or min(n, capacity)
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def batches_of(texts: list[str]) -> Iterator[list[str]]:
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t)
        if len(part) >= TEXTS or size >= CHARS:
            yield part
            part, size = [], 0
    if part:
        yield part


def parts_of(texts: pa.Array) -> Iterator[list[str]]:
    """As `batches_of`, but no more than TEXTS texts of a column are Python strings at a time."""
    for at in range(0, len(texts), TEXTS):
        yield from batches_of(texts.slice(at, TEXTS).to_pylist())


def pieces(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = CAPACITY, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece of every whole text's ids and `end_id`: id, piece, start, length, ids_crc32."""
    taken = docs.select(id_col, F.coalesce(F.col(text), F.lit("")).alias("__text"))
    schema = T.StructType([taken.schema[0], *T._parse_datatype_string(_PIECES).fields])
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = encoder(tokenizer, True, CACHE)
        for b in batches:
            rows, at = [], 0
            for part in parts_of(b.column(1)):
                for ids in known.encode(part):
                    ids += end
                    rows += [(at, k, s, n, zlib.crc32(ids[4 * s : 4 * (s + n)])) for k, (s, n) in enumerate(cut(len(ids) // 4, capacity))]
                    at += 1
            cols = [list(c) for c in zip(*rows)] or [[]] * 5
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(cols[0], pa.int32())), pa.array(cols[1], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[2:])], names=schema.names)

    return taken.mapInArrow(run, schema)


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of every length, placed in the given order."""
    open_at: list[list[int]] = [[] for _ in range(capacity + 1)]
    counts = np.zeros(capacity + 1, np.int64)
    sequence, offset, made = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), 0
    none = np.iinfo(np.int64).max
    for i, s in enumerate(lengths.tolist()):
        gap = capacity
        if s < capacity:
            here = counts[s:capacity]
            # The change of the sum for every gap from s on; a filled sequence leaves the sum.
            change = np.where(here > 0, 2 * (counts[: capacity - s] - here + 1), none)
            if here[0]:
                change[0] = 1 - 2 * here[0]
            best = int(change.argmin())
            if change[best] <= 2 * counts[capacity - s] + 1:
                gap = s + best
        if gap == capacity:
            at, made = made, made + 1
        else:
            at = open_at[gap].pop()
            counts[gap] -= 1
        sequence[i], offset[i] = at, capacity - gap
        if left := gap - s:
            open_at[left].append(at)
            counts[left] += 1
    return sequence, offset


def order(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """Long pieces first, the longest foremost; the short ones, which fill gaps, shuffled after them."""
    long = np.flatnonzero(lengths >= capacity // 8)
    short = np.random.default_rng(0).permutation(np.flatnonzero(lengths < capacity // 8))
    return np.concatenate([long[np.argsort(-lengths[long], kind="stable")], short])


def pack(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = CAPACITY, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Every piece with its sequence_id and its offset there; no sequence is longer than `capacity`.

    Null and empty texts are one piece of `end_id`; each of repeated rows is packed. Pieces are dealt
    evenly, whatever their ids, to groups of about GROUP that are packed apart; a sequence never
    holds pieces of two groups. An empty table gives an empty table.
    """
    cuts = materialize(pieces(docs, tokenizer, end_id, capacity, id_col, text))
    groups = max(1, -(-cuts.count() // GROUP))
    dealt = cuts.withColumn("__group", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)))
    schema = T.StructType([*cuts.schema.fields, *T._parse_datatype_string(_PLACES).fields])

    def place(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop(columns="__group").iloc[order(rows["length"].to_numpy(), capacity)]
        sequence, offset = sum_of_squares(rows["length"].to_numpy(), capacity)
        return rows.assign(sequence_id=(key[0] << 32) + sequence, offset=offset)

    return dealt.groupBy("__group").applyInPandas(place, schema)

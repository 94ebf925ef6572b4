"""Removal of byte strings that earlier documents hold as well, by a sparse suffix sort.

Every string of `length` bytes holds the smallest hash of its stretches of GRAM bytes, its anchor,
and equal strings have theirs at the same place. So only suffixes at anchors are brought together, by
anchor, with the bytes that strings around the anchor can reach, its context:

1. Equal contexts need no sorting: all but those of the smallest document are covered whole.
2. Different contexts of an anchor that several documents have are sorted from the anchor on, with
   comparisons by prefix hashes. Strings that begin a bytes before the anchor are equal if their
   suffixes stand in one run with a long enough common beginning and their last a bytes before the
   anchor are equal; equal strings found so are compared byte by byte.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import _CLEANUP, materialize, tables_removed
from ..storage import shuffles_dropped as _dropping_shuffles
from .suffix_sort import Hashes, mergesort

LENGTH = 50
GRAM = 16
#: Bytes of a text that are hashed at a time.
STEP = 1 << 20
#: Contexts of one task that are sorted at a time, and contexts of an anchor above which its strings are
#: brought together one by one instead.
SORTED, CROWD = 20_000, 20_000
#: Rows of one batch that share a context from which on most of them need not meet the others.
HOT = 8
_LAST = (1 << 63) - 1

_SPANS = "doc bigint, tag int, start int, end int"
#: `place` is tag, whether the row is known to be covered, and the byte in the text: 31, 1 and 31 bits.
_ANCHORS = "key bigint, context bigint, doc bigint, place bigint"
_MARKS = "key bigint, doc bigint, tag int, at int, covered int"
_TEXTS = "key bigint, doc bigint, tag int, at int, before int, bytes binary"


def _slide(values: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (minimum or maximum) of every `width` neighbours."""
    w = 1
    while 2 * w <= width:
        values = pick(values[:-w], values[w:])
        w *= 2
    return pick(values[: len(values) - (width - w)], values[width - w :]) if width > w else values


def anchors(text: bytes, length: int, gram: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places, hashes and context hashes of the anchors of a text; one may come twice where steps meet."""
    n, reach = len(text), length - gram
    for step in range(0, n - length + 1, STEP):
        base = max(0, step - reach)
        part = Hashes(text[base : min(n, step + STEP + 2 * length)])
        # Strings that begin in this step, and the grams in them.
        first, last = step - base, min(step + STEP, n - length + 1) - base
        at = np.arange(first, last + reach)
        h = part.of(at, at + gram)
        least = _slide(h, reach + 1, np.minimum)
        edge = np.zeros(reach, np.uint64)
        anchor = np.flatnonzero(_slide(np.concatenate([edge, least, edge]), reach + 1, np.maximum) == h)
        place = at[anchor]
        low, high = np.maximum(place - reach, -base), np.minimum(place + length, n - base)
        low = np.maximum(low, 0)
        context = part.of(low, high) ^ ((high - low).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        yield place + base, h[anchor], context


def _slices(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The same rows in parts, so that few are Python objects at a time."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def _ids(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return tuple(batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))


def _batch(schema: str, *columns: np.ndarray) -> pa.RecordBatch:
    fields = [f.split() for f in schema.split(", ")]
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for (_, k), c in zip(fields, columns)], names=[n for n, _ in fields])


def _scan(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """One row for each anchor of every document.

    A context that HOT rows of a batch share would make a hot key. There only the smallest document's
    rows keep the key; the others are known to be covered and are dealt out by document.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches, 512):
            doc, tag = _ids(b)
            own, places, keys, contexts = [], [], [], []
            for i, text in enumerate(b.column(2).to_pylist()):
                for at, key, context in anchors(text, length, gram):
                    own.append(np.full(len(at), i))
                    places.append(at)
                    keys.append(key)
                    contexts.append(context)
            if not own:
                continue
            own, at, key, context = map(np.concatenate, (own, places, keys, contexts))
            d, t, key, context = doc[own], tag[own].astype(np.int64), key.view(np.int64), context.view(np.int64)
            order = np.argsort(context, kind="stable")
            start = np.flatnonzero(np.r_[True, context[order][1:] != context[order][:-1]])
            size = np.diff(np.r_[start, len(order)])
            for s, n in zip(start[size >= HOT].tolist(), size[size >= HOT].tolist()):
                same = order[s : s + n]
                same = same[key[same] == key[same[0]]]
                known = same[d[same] > d[same].min()]
                key[known] = (d[known] * 0x9E3779B1 + at[known]) * 0x85EBCA6B
                at[known] |= 1 << 31
            yield _batch(_ANCHORS, key, context, d, t << 32 | at)

    return docs.mapInArrow(run, _ANCHORS)


def _meet(found: DataFrame) -> DataFrame:
    """Anchors by key: rows whose context a smaller document has (covered), and the smallest document
    of every context of a key that has several, at all its places. Keys are read in order, so a key
    of very many rows needs no more memory than another."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last row of a key whose other contexts, if any, are still to come
        now = (None, None, None)  # key and context of the last row, smallest document of the context
        for b in batches:
            key, context, doc, place = (b.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            n = len(key)
            if not n:
                continue
            new_key = np.r_[key[0] != now[0], key[1:] != key[:-1]]
            new = np.r_[new_key[0] or context[0] != now[1], new_key[1:] | (context[1:] != context[:-1])]
            starts = np.flatnonzero(new)
            run_of = np.cumsum(new) - 1
            least = np.where(run_of < 0, now[2] if now[2] is not None else 0, doc[starts][run_of] if len(starts) else 0)
            covered = ~new & (doc > least) | (place >> 31 & 1).astype(bool)
            cols = (key, doc, (place >> 32).astype(np.int32), (place & ((1 << 31) - 1)).astype(np.int32))
            # The first row of a context counts if its key has another context: the row before or after it.
            follows = new & ~new_key
            leads = np.zeros(n, bool)
            opening = np.flatnonzero(new_key)
            if len(opening):
                group = np.cumsum(new_key) - 1
                several = np.zeros(len(opening), bool)
                several[group[follows & (group >= 0)]] = True
                leads[opening] = several
            if held is not None and (follows & (np.cumsum(new_key) == 0)).any():
                yield _batch(_MARKS, *held, np.zeros(1, np.int32))
                held = None
            take = covered | follows | leads | (~new & (doc == least))
            yield _batch(_MARKS, *(c[take] for c in cols), covered[take].astype(np.int32))
            if len(opening):
                i = opening[-1]
                held = None if leads[i] else [c[i : i + 1].copy() for c in cols]
            now = (key[-1], context[-1], least[-1])

    return found.repartition("key").sortWithinPartitions("key", "context", "doc").mapInArrow(run, _MARKS)


def _contexts(texts: DataFrame, length: int, gram: int) -> DataFrame:
    """The bytes around every anchor of `marks` (array of key, at)."""
    reach = length - gram

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches, 128):
            for doc, tag, text, marks in zip(*(b.column(i).to_pylist() for i in range(4))):
                low = [max(0, m["at"] - reach) for m in marks]
                yield _batch(_TEXTS, [m["key"] for m in marks], [doc] * len(marks), [tag] * len(marks), [m["at"] for m in marks], [m["at"] - x for m, x in zip(marks, low)], [text[x : m["at"] + length] for m, x in zip(marks, low)])

    return texts.mapInArrow(run, _TEXTS)


def covered(key: np.ndarray, doc: np.ndarray, before: np.ndarray, parts: list[bytes], length: int, gram: int) -> np.ndarray:
    """For every context (row; keys ascending) and every a: whether its string that begins a bytes before
    the anchor stands around the same anchor in a smaller document."""
    n, reach = len(key), length - gram
    out = np.zeros((n, reach + 1), bool)
    sizes = np.array([len(p) for p in parts], np.int64)
    hashes = Hashes(b"".join(parts))
    at = np.cumsum(sizes) - sizes + before
    after = sizes - before
    # Equal strings agree in half of what they have besides the anchor, before it or after it.
    half = (reach + 1) // 2
    alike = np.zeros(n, bool)
    for low, high, fits in ((half, 0, before >= half), (0, gram + half, after >= gram + half)):
        i = np.flatnonzero(fits)
        text = hashes.of(at[i] - low, at[i] + high) ^ (key[i].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        _, which, times = np.unique(text, return_inverse=True, return_counts=True)
        alike[i] |= times[which] > 1
    if not alike.any():
        return out
    chosen = np.flatnonzero(alike)
    key, doc, before, at, after = (x[chosen] for x in (key, doc, before, at, after))
    order = mergesort(hashes, at, after, key)
    key, doc, before, at, after = (x[order] for x in (key, doc, before, at, after))
    n = len(key)
    same = np.r_[False, key[1:] == key[:-1]]
    common = np.zeros(n, np.int64)
    common[1:] = hashes.common(at[1:], at[:-1], np.where(same[1:], np.minimum(after[1:], after[:-1]), 0))
    window = np.arange(length)
    best = np.maximum(common, np.r_[common[1:], 0])
    by_doc = np.argsort(doc, kind="stable")
    for a in range(reach + 1):
        run = np.cumsum(~same | (common < length - a))
        # Alone in its run, a string has no equal.
        fits = by_doc[((before >= a) & (best >= length - a))[by_doc]]
        if not len(fits):
            continue
        text = hashes.of(at[fits] - a, at[fits]) ^ (run[fits].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        o = np.argsort(text, kind="stable")
        i, text = fits[o], text[o]
        new = np.r_[True, text[1:] != text[:-1]]
        head = i[np.flatnonzero(new)][np.cumsum(new) - 1]
        later = doc[i] > doc[head]
        i, head = i[later], head[later]
        # Equal hashes are not proof: the bytes decide.
        for s in range(0, len(i), SORTED):
            x, y = i[s : s + SORTED], head[s : s + SORTED]
            equal = (hashes.data[(at[x] - a)[:, None] + window] == hashes.data[(at[y] - a)[:, None] + window]).all(1)
            out[chosen[order[x[equal]]], a] = True
    return out


def _spans_of(hit: np.ndarray, doc: np.ndarray, tag: np.ndarray, at: np.ndarray, length: int) -> pa.RecordBatch:
    """Rows of spans from flags by (context, a): neighbouring a make one span."""
    edges = np.diff(np.pad(hit, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    row, low = np.nonzero(edges == 1)
    high = np.nonzero(edges == -1)[1] - 1
    return _batch(_SPANS, doc[row], tag[row], at[row] - high, at[row] - low + length)


def _sort(contexts: DataFrame, length: int, gram: int) -> DataFrame:
    """Covered spans of contexts, by sorting those of each key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []

        def work(table: pa.Table) -> pa.RecordBatch:
            key, doc, tag, at, before = (table.column(i).to_numpy() for i in range(5))
            hit = covered(key, doc, before.astype(np.int64), table.column(5).to_pylist(), length, gram)
            return _spans_of(hit, doc, tag, at, length)

        for b in batches:
            kept.append(b)
            if sum(x.num_rows for x in kept) >= SORTED:
                table = pa.Table.from_batches(kept)
                key = table.column(0).to_numpy()
                full = int(np.searchsorted(key, key[-1]))
                if full:
                    yield work(table.slice(0, full))
                kept = table.slice(full).combine_chunks().to_batches()
        if kept:
            yield work(pa.Table.from_batches(kept))

    return contexts.repartition("key").sortWithinPartitions("key").mapInArrow(run, _SPANS)


def _crowded(contexts: DataFrame, length: int, gram: int) -> DataFrame:
    """The same for anchors with very many contexts: every string is grouped with its equals."""
    offsets = F.sequence(F.greatest(F.lit(0), length - (F.length("bytes") - F.col("before"))), F.least(F.col("before"), F.lit(length - gram)))
    fits = contexts.where(F.length("bytes") >= length).where(F.greatest(F.lit(0), length - (F.length("bytes") - F.col("before"))) <= F.least(F.col("before"), F.lit(length - gram)))
    strings = fits.select("doc", "tag", "at", F.explode(offsets).alias("a"), "before", "bytes").select("doc", "tag", (F.col("at") - F.col("a")).alias("start"), F.substring("bytes", F.col("before") - F.col("a") + 1, F.lit(length)).alias("string"))
    least = strings.groupBy("string").agg(F.min("doc").alias("least"))
    return strings.join(least, "string").where("doc > least").select("doc", "tag", "start", (F.col("start") + length).cast("int").alias("end"))


def spans(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """Written table of (doc, tag, start, end) that cover all bytes to be removed, with overlaps."""
    long = docs.where(F.length("text") >= length)
    # All but the spans goes as soon as they are written: later joins have the disk to themselves.
    with tables_removed(docs.sparkSession) as paths:
        met = materialize(_meet(_scan(long, length, gram)))
        reach = length - gram
        whole = met.where("covered = 1").select("doc", "tag", F.greatest(F.lit(0), F.col("at") - reach).cast("int").alias("start"), (F.col("at") + length).cast("int").alias("end"))
        marks = met.where("covered = 0").groupBy("doc", "tag").agg(F.collect_list(F.struct("key", "at")).alias("marks"))
        contexts = _contexts(long.join(marks, ["doc", "tag"]).select("doc", "tag", "text", "marks"), length, gram)
        crowds = materialize(met.where("covered = 0").groupBy("key").count().where(F.col("count") > CROWD).select("key"))
        found = whole
        if crowds.isEmpty():
            found = found.unionByName(_sort(contexts, length, gram))
        else:
            found = found.unionByName(_sort(contexts.join(crowds, "key", "left_anti").select(*contexts.columns), length, gram))
            found = found.unionByName(_crowded(contexts.join(crowds, "key", "left_semi"), length, gram))
        found = materialize(found)
        paths.pop()
    return found


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id, n_bytes, n_removed, spans (removed runs as [start, end, ...] in bytes) and kept (binary).

    A byte goes if a string of `length` bytes over it also begins in a document with a smaller id;
    strings are judged on the input as it is. Null texts are empty. Rows of equal ids, or with null
    ids, which count as larger than all others, do not judge each other. A null or short text loses
    nothing; an empty table gives an empty table.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(id_col), F.lit(_LAST)).cast("long").alias("doc"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))
    # Only where ids repeat, texts of one id are told apart by their checksum and length.
    again = not rows.groupBy("doc").count().where("count > 1").isEmpty()
    tag = F.pmod(F.xxhash64("text"), F.lit((1 << 31) - 1)).cast("int") if again else F.lit(0)
    rows = rows.select("id", "doc", tag.alias("tag"), "text")
    with _dropping_shuffles(spark):
        found = spans(rows.select("doc", "tag", "text"), length, gram)
    runs = found.groupBy("doc", "tag").agg(F.collect_list(F.struct("start", "end")).alias("found"))
    joined = rows.join(runs, ["doc", "tag"], "left").select("id", "text", "found")
    schema = T.StructType([T.StructField(id_col, rows.schema["id"].dataType), *T._parse_datatype_string("n_bytes bigint, n_removed bigint, spans array<bigint>, kept binary").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches, 128):
            out = []
            for body, own in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                merged: list[list[int]] = []
                for s, e in sorted((x["start"], min(x["end"], len(body))) for x in own or ()):
                    if merged and s <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], e)
                    else:
                        merged.append([s, e])
                kept, at = [], 0
                for s, e in merged:
                    kept.append(body[at:s])
                    at = e
                out.append((len(body), sum(e - s for s, e in merged), [x for r in merged for x in r], b"".join([*kept, body[at:]])))
            cols = [pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary()))]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], names=schema.names)

    return joined.mapInArrow(run, schema)

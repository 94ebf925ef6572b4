"""Benchmark passages in documents, by Wu-Manber search over words.

The search symbol is a word and the test strings are the windows of the benchmark items. A table of
word pairs says how far the end of a window can move on without passing an occurrence; only where it
says zero is the pair's bucket looked at, and only strings that also begin like the text are compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import materialize

#: Bytes of benchmark text searched for in one pass: what a task holds in tables, some 40 times that.
PASS_BYTES = 4 << 20
WINDOW = 13

#: Letters, digits and all that is not ASCII make words, A-Z as a-z; the rest parts them.
_FOLD = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_FOLD).split()


class Patterns:
    """Test strings of one length in words."""

    def __init__(self, length: int):
        self.length = length
        self.block = min(2, length)
        self.shift: dict[tuple, int] = {}
        #: By last block, then by first: [string, items].
        self.buckets: dict[tuple, dict[tuple, dict[tuple, set]]] = {}

    def add(self, string: tuple[bytes, ...], item: str) -> None:
        m, b = self.length, self.block
        for end in range(b, m + 1):
            block = string[end - b : end]
            self.shift[block] = min(self.shift.get(block, m), m - end)
        self.buckets.setdefault(string[-b:], {}).setdefault(string[:b], {}).setdefault(string, set()).add(item)

    def search(self, words: list[bytes], items: set) -> Iterator[tuple[int, int]]:
        """First and last + 1 word of every occurrence; adds the items that hold it."""
        m, b, n = self.length, self.block, len(words)
        skip, shift, buckets = m - b + 1, self.shift.get, self.buckets
        end = m
        while end <= n:
            block = tuple(words[end - b : end])
            if step := shift(block, skip):
                end += step
                continue
            start = end - m
            if same := buckets[block].get(tuple(words[start : start + b])):
                if found := same.get(tuple(words[start:end])):
                    items |= found
                    yield start, end
            end += 1


def build(benchmark: list[tuple[str, bytes]], window: int) -> list[Patterns]:
    """Tables for all windows of the items; an item of fewer words is one window."""
    tables: dict[int, Patterns] = {}
    for item, text in benchmark:
        if words := words_of(text):
            m = min(window, len(words))
            table = tables.setdefault(m, Patterns(m))
            for i in range(len(words) - m + 1):
                table.add(tuple(words[i : i + m]), item)
    return [tables[m] for m in sorted(tables)]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def scan(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, keep: list[str] | None = None, id_col: str = "item_id", text: str = "text", pass_bytes: int = PASS_BYTES) -> DataFrame:
    """The columns `keep` (all if None) of every row and what benchmark items it holds.

    Adds n_words and n_hit (long; words inside any occurrence), spans (merged word ranges as
    [start, end, ...]), items (sorted ids as strings) and contaminated (n_hit > 0 and at least 5 %
    of the words); columns of these names in the input are replaced. Null and empty texts have no
    words; items without words are never found; repeated items count once; a null id reads "null".
    The benchmark is searched for in passes of `pass_bytes`, so its size is bounded by no memory;
    between passes the rows are written.
    """
    added = [T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("spans", T.ArrayType(T.LongType())), T.StructField("items", T.ArrayType(T.StringType())), T.StructField("contaminated", T.BooleanType())]
    keep = [c for c in (docs.columns if keep is None else keep) if c not in {f.name for f in added}]
    wanted = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("item"), F.col("text").cast("binary").alias("body")).where("body is not null").distinct()
    passes = max(1, -(-(wanted.agg(F.sum(F.length("body"))).first()[0] or 0) // pass_bytes))
    taken = docs.select(*keep, F.col(text).cast("binary").alias("__text"), F.lit(None).cast("array<bigint>").alias("spans"), F.lit(None).cast("array<string>").alias("items"))
    n = len(keep)

    for k in range(passes):
        part = wanted.where(F.pmod(F.xxhash64("item", "body"), F.lit(passes)) == k)
        sent = docs.sparkSession.sparkContext.broadcast([(r.item, bytes(r.body)) for r in part.collect()])
        last = k == passes - 1
        fields = [*taken.schema.fields[:n], *([] if last else [taken.schema["__text"]]), *added]
        schema = T.StructType(fields)

        def run(batches: Iterator[pa.RecordBatch], sent=sent, last=last, names=[f.name for f in fields]) -> Iterator[pa.RecordBatch]:
            tables = build(sent.value, window)
            for b in batches:
                rows = []
                for body, spans, items in zip(*(b.column(n + i).to_pylist() for i in range(3))):
                    words, found = words_of(body), set(items or ())
                    at = merged([*zip((spans or [])[::2], (spans or [])[1::2]), *(x for t in tables for x in t.search(words, found))])
                    hit = sum(e - s for s, e in at)
                    rows.append((len(words), hit, [x for r in at for x in r], sorted(found), hit > 0 and 20 * hit >= len(words)))
                cols = [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.string()), pa.bool_()))]
                yield pa.RecordBatch.from_arrays([*b.columns[: n + (not last)], *cols], names=names)

        taken = taken.mapInArrow(run, schema)
        if not last:
            taken = materialize(taken).select(*keep, "__text", "spans", "items")
    return taken


def keep_clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of `docs` that are not contaminated, with their own columns."""
    own = docs.select(F.struct(*docs.columns).alias("row"), F.col("text"))
    return scan(own, benchmark, window, keep=["row"]).where("not contaminated").select("row.*")

"""Interaction of five document filters in every order, duplicates found by radix tries.

The condition of each filter is one bit of a mask, so all orders follow from the counts of masks.
Four bits come from the text alone. The fifth, a copy of a text with a smaller id, comes from
compressed tries: every batch puts its texts into a small one first, so a text with very many
copies travels once per batch; what is left is range-partitioned by text prefixes, made longer
where too many texts share one, and put whole into one trie per range.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import permutations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import materialize
from .radix_trie import RadixTrie

FILTERS = "ABCDE"
COPY = 1 << FILTERS.index("E")
#: Bytes of texts in one trie, unless a single prefix that cannot be made longer has more.
LIMIT = 16 << 20
#: Bytes of the first prefixes; those with more than LIMIT bytes of texts grow by STEP.
PREFIX, STEP = 16, 8
#: Most ranges; beyond them a range fills several tries one after the other.
RANGES = 20_000
#: Bytes of a text whose words are taken at a time.
PART = 1 << 20
_UPPER = bytes(set(range(256)) - set(range(ord("A"), ord("Z") + 1)))
_LATER = bytes(range(0x80, 0xC0))
_SIGN = re.compile(rb"[#$%&*|]")
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def _words(text: bytes) -> tuple[int, int]:
    """Words and distinct words."""
    if len(text) <= PART:
        found = text.split()
        return len(found), len(set(found))
    total, distinct, at = 0, set(), 0
    while at < len(text):
        cut = _SPACE.search(text, at + PART)
        end = cut.start() if cut else len(text)
        found = text[at:end].split()
        total, at = total + len(found), end
        distinct.update(found)
    return total, len(distinct)


def conditions(text: bytes) -> int:
    """Bits of the filters A to D that the UTF-8 text fails."""
    words, distinct = _words(text)
    capitals = len(text.translate(None, _UPPER))
    points = len(text.translate(None, _LATER))
    failed = (words < 200, 100 * distinct < 50 * words, 100 * capitals > 3 * points, _SIGN.search(text) is not None)
    return sum(1 << i for i, f in enumerate(failed) if f)


def _first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, part, mask, rows, text): one with its text for the least id of each text of a batch."""
    for batch in batches:
        at = 0
        sizes = batch.column(2).fill_null(b"")
        while at < batch.num_rows:
            trie, held, taken, end = RadixTrie(), [], 0, at
            while end < batch.num_rows and taken < LIMIT:
                text, ident = sizes[end].as_py(), batch.column(0)[end].as_py()
                terminal = None if ident is None else trie.insert(text, ident)
                held.append((ident, batch.column(1)[end].as_py() or "", text, terminal))
                taken, end = taken + len(text), end + 1
            made, masks = {}, {}
            for ident, part, text, terminal in held:
                name = id(terminal) if terminal is not None else None
                mask = masks.get(name) if name else None
                if mask is None:
                    mask = conditions(text)
                    if name:
                        masks[name] = mask
                copy = terminal is not None and ident > terminal.least
                key = (ident, part, mask | COPY if copy else mask, None if copy or terminal is None else text)
                made[key] = made.get(key, 0) + 1
            rows = [(*k[:3], n, k[3]) for k, n in made.items()]
            columns = list(zip(*rows, strict=True))
            kinds = [batch.schema.field(0).type, pa.string(), pa.int32(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["id", "part", "mask", "rows", "text"])
            at = end


def _second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, part, mask, rows) of a range in the order of its prefixes, copies marked."""
    trie, held, taken, last = RadixTrie(), [], 0, None
    kinds = None

    def drained() -> pa.RecordBatch:
        masks = [(ident, part, mask | COPY if ident > t.least else mask, rows) for ident, part, mask, rows, t in held]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*masks), kinds)], names=["id", "part", "mask", "rows"])

    for batch in batches:
        kinds = [batch.schema.field(i).type for i in range(4)]
        for i in range(batch.num_rows):
            prefix = batch.column(5)[i].as_py()
            if held and taken >= LIMIT and prefix != last:
                yield drained()
                trie, held, taken = RadixTrie(), [], 0
            ident, text, last = batch.column(0)[i].as_py(), batch.column(4)[i].as_py(), prefix
            held.append((ident, *(batch.column(c)[i].as_py() for c in (1, 2, 3)), trie.insert(text, ident)))
            taken += len(text)
    if held:
        yield drained()


def _prefixed(texts: DataFrame) -> DataFrame:
    """`texts` with `prefix`: the shortest of growing prefixes that not too many bytes of texts share.

    Equal texts have equal prefixes. The hashes of crowded prefixes, fewer than all bytes divided by
    LIMIT, are broadcast; a collision only makes a prefix longer than needed.
    """
    depth = PREFIX
    texts = texts.withColumn("prefix", F.substring("text", 1, depth))
    while True:
        longer = texts.where(F.length("text") > F.length("prefix")).where(F.length("prefix") == depth)
        crowded = longer.groupBy(F.xxhash64("prefix").alias("h")).agg(F.sum(F.length("text").cast("long")).alias("bytes"), F.count("*").alias("n"))
        crowded = materialize(crowded.where((F.col("bytes") > LIMIT) & (F.col("n") > 1)).select("h"))
        if crowded.isEmpty():
            return texts
        depth *= STEP
        again = texts.withColumn("h", F.when(F.length("prefix") == depth // STEP, F.xxhash64("prefix")))
        texts = again.join(F.broadcast(crowded.withColumn("grow", F.lit(True))), "h", "left").select(
            *[c for c in texts.columns if c != "prefix"], F.when(F.col("grow"), F.substring("text", 1, depth)).otherwise(F.col("prefix")).alias("prefix")
        )


def masks(docs: DataFrame, id_col: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """(id, part, mask, rows): how many rows of each id and part fail which filters, bit 0 for A."""
    taken = docs.select(F.col(id_col).alias("id"), F.col(part).cast("string").alias("part"), F.col(text).cast("binary").alias("text"))
    kind = taken.schema["id"].dataType
    slim = [T.StructField("id", kind), T.StructField("part", T.StringType()), T.StructField("mask", T.IntegerType()), T.StructField("rows", T.LongType())]
    first = materialize(taken.mapInArrow(_first, T.StructType([*slim, T.StructField("text", T.BinaryType())])))
    open_ = first.where("text is not null")
    size = open_.agg(F.sum(F.length("text").cast("long"))).first()[0] or 0
    ranged = _prefixed(open_).repartitionByRange(min(RANGES, 1 + size // LIMIT), "prefix").sortWithinPartitions("prefix")
    found = ranged.select("id", "part", "mask", "rows", "text", "prefix").mapInArrow(_second, T.StructType(slim))
    return first.where("text is null").drop("text").unionByName(found).groupBy("id", "part", "mask").agg(F.sum("rows").alias("rows"))


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """Counts of documents for every part, every order of the filters and every step of it.

    (part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
    shapley). A row is good or toxic if any row of `labels(<id>, quality, toxic)` of its id says 1.
    A null text is empty; a null part is the empty string; a row without id is nobody's copy, has no
    copies and no label; of rows with equal id and text none is a copy because of the other; other
    columns do not matter; an empty table gives an empty table.
    """
    marked = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic")
    )
    rows = materialize(masks(docs, id_col, text, part))
    known = rows.where("id is not null").join(marked, "id", "left")
    sums = [F.sum("rows").alias("n"), F.sum(F.when(F.col("good"), F.col("rows")).otherwise(0)).alias("good"), F.sum(F.when(F.col("toxic"), F.col("rows")).otherwise(0)).alias("toxic")]
    unknown = rows.where("id is null").withColumn("good", F.lit(False)).withColumn("toxic", F.lit(False))
    cells = materialize(known.unionByName(unknown).groupBy("part", "mask").agg(*sums))

    orders = F.split(F.lit(",".join("".join(o) for o in permutations(FILTERS))), ",")
    each = cells.select("*", F.explode(orders).alias("filter_order")).select("*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))
    earlier = F.expr("substring(filter_order, 1, step - 1)")
    each = each.withColumns(
        {
            "bit": sum(F.when(F.expr("substring(filter_order, step, 1)") == f, 1 << i).otherwise(0) for i, f in enumerate(FILTERS)),
            "before": sum(F.when(earlier.contains(f), 1 << i).otherwise(0) for i, f in enumerate(FILTERS)),
        }
    )
    fails = F.col("mask").bitwiseAND(F.col("bit")) != 0
    here = F.col("mask").bitwiseAND(F.col("before")) == 0
    total = lambda cond, of: F.sum(F.when(cond, F.col(of)).otherwise(0))
    counted = each.groupBy("part", "filter_order", "step", "bit").agg(
        total(here & ~fails, "n").alias("kept"),
        total(here & fails, "n").alias("removed"),
        total(~here & fails, "n").alias("redundant"),
        total(F.col("mask") == F.col("bit"), "n").alias("unique_fails"),
        total(here & fails, "good").alias("good_lost"),
        total(here & fails, "toxic").alias("toxic_lost"),
    )
    shares = each.where(here & fails).groupBy("part", "bit").agg(F.sum("n").alias("shapley"))
    return counted.join(shares, ["part", "bit"], "left").withColumn("shapley", F.coalesce("shapley", F.lit(0).cast("long"))).drop("bit")

"""SimHash near-duplicates by covering locality-sensitive hashing.

Every bit of a fingerprint is dealt one of the 2^(r+1) - 1 nonzero vectors of r + 1 bits. The mask
of a nonzero vector v keeps the bits whose vector has an odd product with v. The vectors of r
differing bits span at most r dimensions, so some v is orthogonal to all of them and its mask hides
all differences: any two fingerprints within the radius agree under at least one mask.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import materialize
from .components import components

BITS = 64
SEED = 42
#: Fingerprints of a bucket that are compared with each other; larger buckets are divided further.
BUCKET = 64
#: Parts of the bits that a mask hides; larger buckets are divided by all but `radius` of them.
PARTS = 7
#: Shingles hashed at a time, so that a very long text needs no more memory than a short one.
STEP = 1 << 15


def masks(radius: int) -> list[int]:
    """Bit masks of the covering code: at least one hides any `radius` differing bits."""
    vectors = range(1, 1 << (radius + 1))
    dealt = [1 + i % len(vectors) for i in range(BITS)]
    return [sum(1 << i for i, m in enumerate(dealt) if (m & v).bit_count() & 1) for v in vectors]


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def fingerprint(text: bytes | None, words: int) -> int:
    """Signed 64-bit SimHash of one UTF-8 text; 0 without words."""
    found = (text or b"").lower().split()
    if not found:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(found) <= words:
        return _signed(digest(b" ".join(found), SEED))
    ones, n, join = np.zeros(BITS, np.int64), len(found) - words + 1, b" ".join
    for at in range(0, n, STEP):
        part = found[at : min(at + STEP, n) + words - 1]
        hashes = np.array([digest(join(s), SEED) for s in zip(*(part[i:] for i in range(words)))], "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def fingerprint_of(hashes: np.ndarray) -> int:
    """Signed 64-bit SimHash of hashes that are at hand; 0 of none."""
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), STEP):
        part = np.ascontiguousarray(hashes[at : at + STEP], "<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def with_fingerprints(docs: DataFrame, words: int = 3, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` (all if None) of every row, and `fingerprint` (long) of its whole text.

    A-Z count as a-z; words are runs of anything but ASCII white space; a text of fewer words than a
    shingle is one shingle. Texts that are null, empty or blank get 0. A column `fingerprint` of the
    input is replaced.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c != "fingerprint"]
    taken = docs.select(*keep, F.col(text).cast("binary").alias("__text"))
    schema = T.StructType([*taken.schema.fields[:-1], T.StructField("fingerprint", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [fingerprint(x.as_py(), words) for x in b.column(len(keep))]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(found, pa.int64())], names=[*keep, "fingerprint"])

    return taken.mapInArrow(run, schema)


def links(prints: DataFrame, radius: int = 2) -> DataFrame:
    """Pairs (a < b) of the distinct values of `prints.fingerprint` that differ in 1 to `radius` bits.

    A bucket holds the fingerprints that are equal under one mask. Small ones are compared at once.
    A large one is divided by the bits that its mask hides, cut into PARTS parts: two fingerprints
    within the radius agree in all parts but `radius`, and few are left under each such choice,
    however large the bucket is. So no pair is lost and no bucket is compared as a whole.
    """
    cover = masks(radius)
    tables = F.array(*[F.struct(F.lit(t).alias("mask"), F.col("fingerprint").bitwiseAND(F.lit(_signed(m))).alias("key")) for t, m in enumerate(cover)])
    keyed = prints.select("fingerprint", F.explode(tables).alias("t")).select("fingerprint", "t.mask", "t.key")
    sizes = keyed.groupBy("mask", "key").count().where("count > 1")
    crowded = materialize(keyed.join(sizes, ["mask", "key"]))

    finer = []
    for t, m in enumerate(cover):
        hidden = [i for i in range(BITS) if not m >> i & 1]
        for out in combinations(range(PARTS), radius):
            kept = sum(1 << i for j, i in enumerate(hidden) if j % PARTS not in out)
            finer.append((t, _signed(m | kept)))
    choices = F.array(*[F.array(*[F.col("fingerprint").bitwiseAND(F.lit(k)) for t, k in finer if t == x]) for x in range(len(cover))])
    small = crowded.where(F.col("count") <= BUCKET).select("fingerprint", "mask", F.lit(-1).alias("choice"), "key")
    large = crowded.where(F.col("count") > BUCKET).select("fingerprint", "mask", F.posexplode(choices[F.col("mask")]).alias("choice", "key"))

    buckets = small.unionByName(large).groupBy("mask", "choice", "key").agg(F.sort_array(F.collect_list("fingerprint")).alias("f")).where(F.size("f") > 1)
    near = buckets.select(
        F.explode("f").alias("a"), "f"
    ).select("a", F.explode(F.filter("f", lambda x: (x > F.col("a")) & (F.bit_count(x.bitwiseXOR(F.col("a"))) <= radius))).alias("b"))
    return near.distinct()


def near_duplicates(docs: DataFrame, words: int = 3, radius: int = 2, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id, fingerprint (long) and component_id for every row: the smallest id that links lead to.

    Rows link if their fingerprints differ in at most `radius` bits. Equal fingerprints are one node,
    so a group of copies costs one row. Rows without words have fingerprint 0 and link like any
    other. A null id never becomes a component_id unless a component has no other; repeated rows
    each get their row; an empty table gives an empty table.
    """
    prints = materialize(with_fingerprints(docs, words, text, [id_col]))
    nodes = materialize(prints.groupBy("fingerprint").agg(F.min(id_col).alias("first")))
    roots = materialize(components(links(nodes, radius))).withColumnRenamed("node", "fingerprint")
    rooted = nodes.join(roots, "fingerprint")
    firsts = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    moved = rooted.join(firsts, "root").select("fingerprint", "component_id")
    named = nodes.join(moved, "fingerprint", "left").select("fingerprint", F.coalesce("component_id", "first").alias("component_id"))
    return prints.join(named, "fingerprint").select(id_col, "fingerprint", "component_id")


def keep_first(docs: DataFrame, words: int = 3, radius: int = 2, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of every component, that of the smallest id, with all columns of `docs`.

    Of rows with equal id and fingerprint one stays. Where all ids of a component are null, one of
    its rows stays for each fingerprint.
    """
    found = materialize(near_duplicates(docs, words, radius, id_col, text))
    keep = found.where(F.col(id_col).eqNullSafe(F.col("component_id"))).groupBy(id_col, "fingerprint").count()
    keep = keep.select(F.col(id_col).alias("__id"), F.col("fingerprint").alias("__f"), F.col("count").alias("__rows"))
    taken = with_fingerprints(docs, words, text).join(keep, F.col(id_col).eqNullSafe(F.col("__id")) & (F.col("fingerprint") == F.col("__f")))
    once = taken.where("__rows = 1").select(*docs.columns)
    if keep.where("__rows > 1").isEmpty():
        return once
    again = taken.where("__rows > 1").dropDuplicates(["__id", "__f"]).select(*docs.columns)
    return once.unionByName(again)

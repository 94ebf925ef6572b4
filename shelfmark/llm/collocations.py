"""Frequent phrases of two to four words, scored by how firmly their parts belong together.

Phrases are counted in two passes over the texts, in each task by a HAT-trie whose subtrees leave as
sorted runs, which meet by first words. The second pass counts phrases of three and four words of
which all pairs of neighbours are frequent, as a filter of fixed size tells: a pair it lets through by
chance costs work only, since counts are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import materialize
from . import hat_trie
from .hat_trie import WORDS, HatTrie, Words, packed, unpacked

#: Bytes of texts whose words are numbered at a time.
CHUNK = 2 << 20
#: Words of 64 bits of the filter of frequent pairs, a power of two: 8 MB.
FILTER = 1 << 20
#: Parts of a first word's phrases that are merged apart.
PARTS = 16
#: Words that a task numbers before it starts anew; those of one more portion still have ids.
VOCABULARY = 1 << 18
#: Rows of a batch that a run is handed on in.
ROWS = 1 << 16
_ENDS = b".,;:!?\n\x0b\x0c\r"
_TABLE = bytes(ord(".") if c in _ENDS else 32 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))
_ENTRY = "lang string, prefix long, phrase string, n long"


def _cut(texts: list[bytes]) -> Iterator[bytes]:
    """The texts as pieces parted by '.', in portions that end between words."""
    held, size = [], 0
    for text in texts:
        text = text.translate(_TABLE) + b"."
        at = 0
        while len(text) - at > CHUNK:
            end = text.find(b" ", at + CHUNK)
            stop = text.find(b".", at + CHUNK, end if end >= 0 else len(text))
            end = stop if stop >= 0 else end
            if end < 0:
                break
            yield b"".join([*held, text[at:end]])
            held, size, at = [], 0, end
        held.append(text[at:])
        size += len(text) - at
        if size >= CHUNK:
            yield b"".join(held)
            held, size = [], 0
    if held:
        yield b"".join(held)


def _ids(portion: bytes, words: Words) -> np.ndarray:
    found = portion.replace(b".", b" . ").split()
    return np.fromiter(map(words.__getitem__, found), np.int64, len(found))


def _rotated(h, by: int):
    return (h << np.uint64(by)) | (h >> np.uint64(64 - by))


def _pair_hash(lang: str, hashes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    of_lang = np.uint64(xxhash.xxh64_intdigest(lang, 42))
    return hashes[a] ^ _rotated(hashes[b], 21) ^ _rotated(of_lang, 42)


def _pair_hash_column(lang: Column, a: Column, b: Column) -> Column:
    """As `_pair_hash`: Spark's xxhash64 has the same seed."""
    turn = lambda h, by: F.shiftleft(h, by).bitwiseOR(F.shiftrightunsigned(h, 64 - by))
    return F.xxhash64(a).bitwiseXOR(turn(F.xxhash64(b), 21)).bitwiseXOR(turn(F.xxhash64(lang), 42))


class Hashes:
    """64-bit hashes of a task's words by id, made once each."""

    def __init__(self):
        self.of = np.zeros(1, np.uint64)

    def upto(self, words: Words) -> np.ndarray:
        if len(words.names) > len(self.of):
            new = [xxhash.xxh64_intdigest(w, 42) for w in words.names[len(self.of) :]]
            self.of = np.r_[self.of, np.array(new, np.uint64)]
        return self.of


def _runs(subtrees, words: Words, hashes: Hashes) -> Iterator[pa.RecordBatch]:
    """Subtrees as runs (lang, prefix, phrase, n), sorted by the ids of their words.

    `prefix` stands for the first word and for one of PARTS parts of its followers.
    """
    names, marks = pa.array(words.names, pa.binary()), hashes.upto(words)
    for lang, first, rest, counts in subtrees:
        by = np.lexsort((rest, first))
        counts = counts[by]
        ids = unpacked(first[by], rest[by])
        prefix = (marks[ids[0]] & np.uint64((1 << 63) - PARTS)) | (marks[ids[1]] % np.uint64(PARTS))
        for at in range(0, len(counts), ROWS):
            # A word that is not there is null, and nulls are left out of the phrase.
            texts = [names.take(pa.array(i[at : at + ROWS], mask=i[at : at + ROWS] == 0)) for i in ids if i.any()]
            phrase = pc.binary_join_element_wise(*texts, b" ", null_handling="skip").cast(pa.string())
            n = len(phrase)
            columns = [pa.array([lang] * n), pa.array(prefix[at : at + n].view(np.int64)), phrase, pa.array(counts[at : at + n])]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "prefix", "phrase", "n"])


def _counted(lengths: tuple[int, ...], frequent):
    """Function of batches (lang, text) that gives runs of phrases of these lengths.

    `frequent` is None or a broadcast filter that every pair of neighbours has to pass.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, words, hashes = HatTrie(), Words(), Hashes()

        for batch in batches:
            by_lang: dict[str, list[bytes]] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if text:
                    by_lang.setdefault(lang, []).append(text)
            for lang, texts in by_lang.items():
                before = np.zeros(WORDS - 1, np.int64)
                for portion in _cut(texts):
                    ids = np.r_[before, _ids(portion, words)]
                    before = ids[-(WORDS - 1) :]
                    good = None
                    if frequent is not None:
                        h = _pair_hash(lang, hashes.upto(words), ids[:-1], ids[1:])
                        good = (ids[:-1] > 0) & (ids[1:] > 0)
                        for slot, bit in ((h, h >> np.uint64(20)), (h >> np.uint64(26), h >> np.uint64(46))):
                            good &= (frequent.value[(slot & np.uint64(FILTER - 1)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1) == 1
                    firsts, rests = [], []
                    for k in lengths:
                        # Phrases whose last word is new in this portion.
                        n = len(ids) - (WORDS - 1)
                        cols = [ids[WORDS - k + i : WORDS - k + i + n] for i in range(k)]
                        ok = np.logical_and.reduce([c > 0 for c in cols])
                        if good is not None:
                            ok &= np.logical_and.reduce([good[WORDS - k + i : WORDS - k + i + n] for i in range(k - 1)])
                        firsts.append(cols[0][ok])
                        rests.append(packed([c[ok] for c in cols]))
                    trie.add(lang, np.concatenate(firsts), np.concatenate(rests))
                    if trie.entries > hat_trie.ENTRIES:
                        yield from _runs(trie.spill(hat_trie.ENTRIES // 2), words, hashes)
                    if len(words.names) > VOCABULARY:
                        yield from _runs(trie.spill(-1), words, hashes)
                        last = [words.names[i] for i in before]
                        trie, words, hashes = HatTrie(), Words(), Hashes()
                        before = np.array([words[w] for w in last])
        yield from _runs(trie.spill(-1), words, hashes)

    return run


def _merged(texts: DataFrame, lengths: tuple[int, ...], frequent, least: int) -> DataFrame:
    """(lang, phrase, n) of the phrases of these lengths that occur `least` times or more."""
    runs = texts.mapInArrow(_counted(lengths, frequent), _ENTRY)
    return runs.repartition("lang", "prefix").groupBy("lang", "prefix", "phrase").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("lang", "phrase", "n")


def _filter(pairs: DataFrame):
    """Broadcast bits of the frequent pairs of words, at most FILTER numbers."""
    words = F.split("phrase", " ")
    h = pairs.select(_pair_hash_column(F.col("lang"), words[0], words[1]).alias("h"))
    slot = lambda by: F.shiftrightunsigned("h", by).bitwiseAND(F.lit(FILTER - 1))
    bit = lambda by: F.expr(f"shiftleft(1L, cast(shiftrightunsigned(h, {by}) & 63 as int))")
    both = F.array(F.struct(slot(0).alias("slot"), bit(20).alias("bit")), F.struct(slot(26).alias("slot"), bit(46).alias("bit")))
    set_ = h.select(F.explode(both).alias("s")).groupBy("s.slot").agg(F.bit_or("s.bit").alias("bits")).toArrow()
    out = np.zeros(FILTER, np.uint64)
    out[set_["slot"].to_numpy()] = set_["bits"].to_numpy().view(np.uint64)
    return pairs.sparkSession.sparkContext.broadcast(out)


def collocations(docs: DataFrame, least: int = 30, top: int = 2000, cover: int = 80, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first `top` phrases of every language.

    A-Z count as a-z; texts are divided into pieces at . , ; : ! ? and line ends, pieces into words at
    spaces and tabs. A phrase of two to four words with `a` >= `least` occurrences is scored by its
    weakest cut, floor(2000000 a / (l + r)), and left out if a longer such phrase holds it in at least
    `cover` % of its occurrences. `n` is the number of all words of the language. A null text has no
    words, a null language is `und`; a language without such phrases gives no row; repeated rows count
    again; other columns do not matter; an empty table gives an empty table.
    """
    texts = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).cast("binary").alias("text"))
    spark = docs.sparkSession
    short = materialize(_merged(texts, (1, 2), None, 1).withColumn("words", F.size(F.split("phrase", " "))).where((F.col("words") == 1) | (F.col("n") >= least)))
    totals = materialize(short.where("words = 1").groupBy("lang").agg(F.sum("n").alias("n_words")))
    often = short.where(F.col("n") >= least)
    long = _merged(texts, tuple(range(3, WORDS + 1)), _filter(often.where("words = 2")), least)
    counts = materialize(often.unionByName(long.withColumn("words", F.size(F.split("phrase", " ")))))

    wide = F.split("phrase", " ")
    candidates = counts.where("words > 1").select("lang", "phrase", F.col("n").alias("a"), "words", wide.alias("w"))
    cut = candidates.select("*", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cut = cut.select("lang", "phrase", "a", "k", F.expr("array_join(slice(w, 1, k), ' ')").alias("left"), F.expr("array_join(slice(w, k + 1, words), ' ')").alias("right"))
    known = counts.select("lang", "phrase", "n")
    sides = cut.join(known.toDF("lang", "left", "l"), ["lang", "left"]).join(known.toDF("lang", "right", "r"), ["lang", "right"])
    scored = sides.withColumn("score", F.expr("cast((cast(2000000 as decimal(20,0)) * a) div (cast(l as decimal(20,0)) + r) as bigint)"))
    weakest = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("s"))

    inner = candidates.where("words > 2").select("lang", "a", "words", "w", F.explode(F.sequence(F.lit(2), F.col("words") - 1)).alias("m"))
    inner = inner.select("lang", "a", "w", "m", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("m") + 1)).alias("at"))
    inside = inner.groupBy("lang", F.expr("array_join(slice(w, at, m), ' ')").alias("phrase")).agg(F.max("a").alias("longer"))
    hidden = F.expr(f"cast(100 as decimal(20,0)) * longer >= cast({int(cover)} as decimal(20,0)) * a")
    kept = weakest.join(inside, ["lang", "phrase"], "left").where(~F.coalesce(hidden, F.lit(False)))
    flat = kept.select("lang", "phrase", "a", "s.l", "s.r", "s.score")

    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    # The first of every part of a language hold the first of the language.
    parts = F.pmod(F.xxhash64("phrase"), F.lit(PARTS))
    some = flat.withColumn("part", parts).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    first = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return first.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", F.col("n_words").alias("n"), "score")

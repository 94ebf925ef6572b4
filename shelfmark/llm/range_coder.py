"""Blocks of token ids under an adaptive context-mixing range coder.

A block is coded as many interleaved lanes, each a run of its ids, that share one model; a step
codes one id of every lane with array operations. Three predictors compete for each id: the last id
seen after the same two ids, the last seen after the same one, and the frequencies of all ids. Their
weights are learned for every pair of confidences that the first two can have. Model and coder start
anew in every block, and its checksum covers header, index and coded words.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np

MAGIC = b"SMT1"
LANES = 8192
#: Confidence levels of a predictor, contexts of order 2, bits of the weights' total.
LEVELS, SLOTS, BITS = 8, 1 << 18, 12
#: Added to an id's frequency when seen; frequencies are halved above LIMIT; steps between updates.
GAIN, LIMIT, EVERY = 16, 1 << 19, 4
TOP, BOTTOM, WORD = np.uint64(1 << 48), np.uint64(1 << 42), np.uint64(16)
_HEAD = struct.Struct("<4sIIIIII")


class Model:
    """Predictions that encoder and decoder make alike."""

    def __init__(self, vocabulary: int, decoding: bool = False):
        self.decoding = decoding
        self.counts = np.zeros(vocabulary, np.int64)
        self.seen: list[np.ndarray] = []
        # Of each context the id that followed last, times LEVELS, and how often in a row it did.
        self.after1, self.after2 = np.zeros(vocabulary, np.int32), np.zeros(SLOTS, np.int32)
        self.weights = np.tile(np.array([2, 2, 12], np.int64), (2 * LEVELS * LEVELS, 1))
        self._frequencies()
        self._shares()

    def _frequencies(self) -> None:
        if self.seen:
            self.counts += GAIN * np.bincount(np.concatenate(self.seen), minlength=len(self.counts))
            self.seen.clear()
            if self.counts.sum() > LIMIT:
                self.counts >>= 1
        self.below = np.concatenate([[0], np.cumsum(self.counts + 1)]).astype(np.uint64)
        self.total = self.below[-1]
        if self.decoding:
            # Which id each part of the total belongs to.
            self.symbols = np.repeat(np.arange(len(self.counts), dtype=np.int32), self.counts + 1)

    def _shares(self) -> None:
        """Per context the bounds of the three predictors in a total of 2^BITS, none of them empty."""
        whole = 1 << BITS
        parts = 1 + self.weights[:, :2] * (whole - 3) // self.weights.sum(1, keepdims=True)
        bounds = np.zeros((len(parts), 4), np.uint64)
        bounds[:, 1], bounds[:, 2], bounds[:, 3] = parts[:, 0], parts.sum(1), whole
        self.bounds = bounds.reshape(-1)

    def look(self, last: np.ndarray, before: np.ndarray) -> None:
        """Predictions after the ids `before`, `last` of every lane."""
        self.last = last.copy()
        self.slot = ((before * 0x9E3779B1 + last * 0x85EBCA6B) >> 7) & (SLOTS - 1)
        one, two = self.after1.take(last), self.after2.take(self.slot)
        self.guess1, self.guess2 = one // LEVELS, two // LEVELS
        self.level1, self.level2 = one % LEVELS, two % LEVELS
        self.context = 2 * (LEVELS * self.level2 + self.level1) + (self.guess1 == self.guess2)

    def learn(self, ids: np.ndarray, chosen: np.ndarray, step: int) -> None:
        """What came; where lanes share a context, the last lane's id stays."""
        base = (ids * LEVELS).astype(np.int32)
        self.after1[self.last] = base + (ids == self.guess1) * np.minimum(self.level1 + 1, LEVELS - 1)
        self.after2[self.slot] = base + (ids == self.guess2) * np.minimum(self.level2 + 1, LEVELS - 1)
        self.weights += np.bincount(3 * self.context + chosen, minlength=self.weights.size).reshape(-1, 3)
        if self.weights.max() > 1 << 16:
            self.weights = (self.weights + 1) >> 1
        self._shares()
        self.seen.append(ids)
        if step % EVERY == EVERY - 1:
            self._frequencies()


def _lanes(n: int) -> tuple[int, int]:
    """Lanes of a block of n ids, and ids in each but the last."""
    lanes = max(1, min(LANES, n // 64))
    steps = -(-n // lanes)
    return -(-n // steps), steps


def _active(n: int, steps: int, step: int) -> int:
    return (n - step + steps - 1) // steps


def encode(ids: np.ndarray, vocabulary: int) -> tuple[np.ndarray, np.ndarray]:
    """Words (uint16) of all lanes, one lane after the other, and their numbers."""
    n = len(ids)
    lanes, steps = _lanes(n)
    rows = np.zeros(lanes * steps, np.int64)
    rows[:n] = ids
    rows = np.ascontiguousarray(rows.reshape(lanes, steps).T)
    model = Model(vocabulary)
    low, size = np.zeros(lanes, np.uint64), np.full(lanes, (1 << 64) - 1, np.uint64)
    last, before = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)
    out_lane, out_word = [], []
    for step in range(steps):
        k = _active(n, steps, step)
        x, lo, sz = rows[step, :k], low[:k], size[:k]
        model.look(last[:k], before[:k])
        chosen = np.where(x == model.guess2, 0, np.where(x == model.guess1, 1, 2))
        part = sz >> np.uint64(BITS)
        bound = 4 * model.context + chosen
        start = model.bounds.take(bound)
        lo += part * start
        sz[:] = part * (model.bounds.take(bound + 1) - start)
        rest = np.flatnonzero(chosen == 2)
        y = x[rest]
        part = sz[rest] // model.total
        start = model.below[y]
        lo[rest] += part * start
        sz[rest] = part * (model.below[y + 1] - start)
        for ready, words in _settled(lo, sz):
            out_lane.append(ready)
            out_word.append(words)
        before[:k] = last[:k]
        last[:k] = x
        model.learn(x, chosen, step)
    # Two more words name a number inside the interval; a decoder reads zeros after them.
    end = ((low + np.uint64((1 << 32) - 1)) >> np.uint64(32)).astype(np.uint64)
    every = np.arange(lanes)
    out_lane += [every, every]
    out_word += [(end >> WORD).astype(np.uint16), (end & np.uint64(0xFFFF)).astype(np.uint16)]
    lane, word = np.concatenate(out_lane), np.concatenate(out_word)
    return word[np.argsort(lane, kind="stable")], np.bincount(lane, minlength=lanes)


def _settled(low: np.ndarray, size: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Shifts out the first 16 bits of all lanes where they are settled, until no lane has any.

    An interval that is small but astride of two such values is cut to settle it.
    """
    lanes, lo, sz = None, low, size
    while True:
        settled = (lo ^ (lo + sz)) < TOP
        small = sz < BOTTOM
        astride = small & ~settled
        if astride.any():
            sz[astride] = -lo[astride] & (BOTTOM - np.uint64(1))
        now = np.flatnonzero(settled | small)
        if lanes is not None:
            # The others of these lanes are done.
            low[lanes], size[lanes] = lo, sz
        if not len(now):
            return
        lanes = now if lanes is None else lanes[now]
        lo, sz = lo[now], sz[now]
        yield lanes, (lo >> np.uint64(48)).astype(np.uint16)
        lo, sz = lo << WORD, sz << WORD


def decode(words: np.ndarray, counts: np.ndarray, n: int, vocabulary: int) -> np.ndarray:
    """The n ids (uint32) of a block."""
    lanes, steps = _lanes(n)
    begin = np.concatenate([[0], np.cumsum(counts)])
    padded = np.concatenate([words.astype(np.uint64), np.zeros(1, np.uint64)])
    nothing = len(words)

    def take(which: np.ndarray) -> np.ndarray:
        i = at[which]
        at[which] = i + 1
        return padded[np.where(i < begin[which + 1], i, nothing)]

    at = begin[:-1].copy()
    every = np.arange(lanes)
    code = np.zeros(lanes, np.uint64)
    for _ in range(4):
        code = code << WORD | take(every)
    model = Model(vocabulary, decoding=True)
    low, size = np.zeros(lanes, np.uint64), np.full(lanes, (1 << 64) - 1, np.uint64)
    last, before = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)
    rows = np.zeros((steps, lanes), np.uint32)
    for step in range(steps):
        k = _active(n, steps, step)
        lo, sz, cd = low[:k], size[:k], code[:k]
        model.look(last[:k], before[:k])
        part = sz >> np.uint64(BITS)
        value = (cd - lo) // part
        first = 4 * model.context
        chosen = (value >= model.bounds.take(first + 1)).astype(np.int64) + (value >= model.bounds.take(first + 2))
        bound = 4 * model.context + chosen
        start = model.bounds.take(bound)
        lo += part * start
        sz[:] = part * (model.bounds.take(bound + 1) - start)
        x = np.where(chosen == 0, model.guess2, model.guess1)
        rest = np.flatnonzero(chosen == 2)
        part = sz[rest] // model.total
        value = np.minimum((cd[rest] - lo[rest]) // part, model.total - np.uint64(1))
        y = model.symbols[value.astype(np.int64)]
        start = model.below[y]
        lo[rest] += part * start
        sz[rest] = part * (model.below[y + 1] - start)
        x[rest] = y
        for ready, _ in _settled(lo, sz):
            cd[ready] = cd[ready] << WORD | take(ready)
        rows[step, :k] = x
        before[:k] = last[:k]
        last[:k] = x
        model.learn(x, chosen, step)
    return np.ascontiguousarray(rows.T).reshape(-1)[:n]


def pack_block(ids: np.ndarray, index: bytes, vocabulary: int) -> bytes:
    """One block: header, index, words per lane, words, checksum of all of it."""
    words, counts = encode(ids, vocabulary)
    head = _HEAD.pack(MAGIC, vocabulary, len(ids), len(index), len(counts), len(words), zlib.crc32(ids.astype("<u4").tobytes()))
    body = head + index + counts.astype("<u4").tobytes() + words.astype("<u2").tobytes()
    return body + struct.pack("<I", zlib.crc32(body))


def unpack_block(block: bytes) -> tuple[np.ndarray, bytes]:
    """Ids (uint32) and index of a block; ValueError if a byte of it has changed."""
    magic, vocabulary, n, size, lanes, words, ids_crc = _HEAD.unpack_from(block)
    if magic != MAGIC or len(block) != _HEAD.size + size + 4 * lanes + 2 * words + 4 or zlib.crc32(block[:-4]) != struct.unpack("<I", block[-4:])[0]:
        raise ValueError("a block of token ids is damaged")
    at = _HEAD.size + size
    counts = np.frombuffer(block, "<u4", lanes, at).astype(np.int64)
    ids = decode(np.frombuffer(block, "<u2", words, at + 4 * lanes), counts, n, vocabulary)
    if zlib.crc32(ids.astype("<u4").tobytes()) != ids_crc:
        raise ValueError("a block of token ids is damaged")
    return ids, block[_HEAD.size : at]

"""Token ids of whole texts, by the `tokenizers` library.

A text is cut where the vocabulary's own splitting always cuts it, and the library encodes each
different piece once per worker, so a worker pays for its vocabulary rather than for its words.
Pieces of plain texts are cut, found and replaced by their ids with array operations.
"""

from __future__ import annotations

import re
from functools import cache

import numpy as np
from tokenizers import Tokenizer

#: Pieces remembered by a worker; then it starts afresh.
CACHE = 2_000_000
#: Bytes of the pieces that are found by array operations; longer ones are looked up one by one.
WIDTH = 24

#: Bytes that plain texts do not have: control characters but newline, and those that begin white space
#: outside ASCII. Every other character of several bytes is no white space.
_RARE = bytes([*range(10), *range(11, 32), 127, 0xC2, 0xE1, 0xE2, 0xE3, 0xEF])
_SOLID = np.array([b > 32 for b in range(256)])
_ALNUM = np.array([b < 128 and chr(b).isalnum() for b in range(256)])
#: A blank before one of these may belong to a longer run of white space: no cut there.
_RUN = re.compile(" (?=[\\s\\x00-\\x20\\x7f-\\xa0\\u1680\\u180e\\u2000-\\u200f\\u2028-\\u202f\\u205f-\\u206f\\u3000\\ufeff]|$)")

#: Byte-level vocabularies write printable bytes as themselves, the others from U+0100 on.
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTES = {b: b for b in _PRINTED} | {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _PRINTED)}

_LOW = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xBF58476D1CE4E5B9], np.uint64)


@cache
def encoder(path: str, blanks: bool, cache: int = CACHE) -> Encoder:
    """The encoder of this process, kept for its next tasks."""
    return Encoder(path, blanks, cache)


class Pieces:
    """Ids of pieces of up to WIDTH bytes, in an open hash table of arrays."""

    def __init__(self):
        self.used, self.ids_used = 0, 0
        self.words = np.zeros((3, 1 << 12), np.uint64)
        self.first, self.size = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)
        self.ids = np.zeros(1 << 14, "<u4")
        self.slots = np.full(1 << 14, -1, np.int32)

    @staticmethod
    def hashes(words: np.ndarray) -> np.ndarray:
        h = words[0] * _MIX[0] + words[1] * _MIX[1] + words[2] * _MIX[2]
        h ^= h >> np.uint64(32)
        h *= _MIX[3]
        return h ^ (h >> np.uint64(29))

    def find(self, words: np.ndarray) -> np.ndarray:
        """Number of each piece; -1 for those not known."""
        last = len(self.slots) - 1
        at = (self.hashes(words) & np.uint64(last)).astype(np.int64)
        out = self.slots[at]
        todo = np.flatnonzero((out >= 0) & ~self._same(out, words))
        while len(todo):
            at[todo] = (at[todo] + 1) & last
            found = self.slots[at[todo]]
            out[todo] = found
            todo = todo[(found >= 0) & ~self._same(found, words[:, todo])]
        return out

    def _same(self, found: np.ndarray, words: np.ndarray) -> np.ndarray:
        return (self.words[0][found] == words[0]) & (self.words[1][found] == words[1]) & (self.words[2][found] == words[2])

    def add(self, words: np.ndarray, ids: list[list[int]]) -> None:
        """Enters different pieces that are not known yet."""
        n, sizes = len(ids), np.array([len(i) for i in ids], np.int64)
        while self.used + n > len(self.first):
            self.words = np.concatenate([self.words, np.zeros_like(self.words)], axis=1)
            self.first, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.first, self.size))
        while self.ids_used + sizes.sum() > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        new = slice(self.used, self.used + n)
        self.words[:, new] = words
        self.size[new] = sizes
        self.first[new] = self.ids_used + np.cumsum(sizes) - sizes
        self.ids[self.ids_used : self.ids_used + sizes.sum()] = [x for i in ids for x in i]
        self.used, self.ids_used = self.used + n, self.ids_used + int(sizes.sum())
        if 2 * self.used > len(self.slots):
            # At most half full, so that a search always ends.
            self.slots = np.full(1 << (4 * self.used).bit_length(), -1, np.int32)
            self._enter(np.arange(self.used, dtype=np.int32))
        else:
            self._enter(np.arange(new.start, new.stop, dtype=np.int32))

    def _enter(self, numbers: np.ndarray) -> None:
        last = len(self.slots) - 1
        at = (self.hashes(self.words[:, numbers]) & np.uint64(last)).astype(np.int64)
        while len(numbers):
            free = self.slots[at] < 0
            self.slots[at[free]] = numbers[free]
            # Of several that want one place the last has it; the others go on.
            left = self.slots[at] != numbers
            numbers, at = numbers[left], (at[left] + 1) & last


class Encoder:
    """Ids of a text as little-endian unsigned 32-bit integers.

    `blanks` says whether the vocabulary keeps a blank at the head of the next piece (byte-level) or
    drops white space (word ends). Strings of special tokens in a text are encoded as the library
    does by default.
    """

    def __init__(self, path: str, blanks: bool, cache: int = CACHE):
        self.tokenizer = Tokenizer.from_file(path)
        self.blanks, self.cache = blanks, cache
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.table = Pieces()
        self.known: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        if self.table.used > self.cache:
            self.table = Pieces()
        if len(self.known) > self.cache:
            self.known.clear()
        raw = [t.encode() for t in texts]
        plain = [len(b.translate(None, _RARE)) == len(b) and not any(x in t for x in self.special) for t, b in zip(texts, raw)]
        fast = iter(self._plain([b for b, p in zip(raw, plain) if p]))
        other = iter(self._other([t for t, p in zip(texts, plain) if not p]))
        return [next(fast) if p else next(other) for p in plain]

    def _plain(self, texts: list[bytes]) -> list[bytes]:
        """Plain texts, cut before single blanks, around single newlines, and before commas and full
        stops that follow a letter or digit."""
        if not texts:
            return []
        data = np.frombuffer(b"".join(texts) + bytes(WIDTH + 8), np.uint8)
        ends = np.cumsum([len(t) for t in texts])
        n, begins = int(ends[-1]), np.append(0, ends[:-1])
        full = begins < ends
        body = data[:n]
        solid = _SOLID[body]
        after, before = np.append(solid[1:], False)[:n], np.append(False, solid[:-1])[:n]
        alnum = np.append(False, _ALNUM[body[:-1]])[:n]
        after[ends[full] - 1] = before[begins[full]] = alnum[begins[full]] = False
        line = (body == 10) & before
        cut = line | (body == 32) & before & after | ((body == 44) | (body == 46)) & alnum
        cut[1:] |= (line & after)[:-1]
        cut[begins[full]] = True
        start = np.flatnonzero(cut)
        size = np.diff(np.append(start, n))

        view = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
        words = np.empty((3, len(start)), np.uint64)
        for k in range(3):
            words[k] = view[np.minimum(start + 8 * k, n)] & _LOW[np.clip(size - 8 * k, 0, 8)]
        long = np.flatnonzero(size > WIDTH)
        found = self.table.find(words)
        found[long] = -2
        new = np.flatnonzero(found == -1)
        if len(new):
            _, one = np.unique(self.table.hashes(words[:, new]), return_index=True)
            one = new[one]
            self._learn(words[:, one], [bytes(data[s : s + z]).decode() for s, z in zip(start[one].tolist(), size[one].tolist())])
            found[new] = self.table.find(words[:, new])
            if (found[new] < 0).any():
                # Different pieces with one hash: the rest one by one.
                found[new[found[new] < 0]] = -2
                long = np.flatnonzero(found == -2)

        count, first = self.table.size[found], self.table.first[found]
        pool = self.table.ids
        if len(long):
            extra = [np.frombuffer(self._piece(bytes(data[s : s + z]).decode()), "<u4") for s, z in zip(start[long].tolist(), size[long].tolist())]
            count[long] = [len(e) for e in extra]
            first[long] = self.table.ids_used + np.cumsum(count[long]) - count[long]
            pool = np.concatenate([pool[: self.table.ids_used], *extra])
        to = np.cumsum(count)
        total = int(to[-1]) if len(to) else 0
        ids = pool[np.repeat(first - (to - count), count) + np.arange(total)].tobytes()
        # Ids before each text's end, from the pieces before it.
        bound = 4 * np.append(0, to)[np.append(0, np.searchsorted(start, ends))]
        return [ids[a:b] for a, b in zip(bound[:-1].tolist(), bound[1:].tolist())]

    def _learn(self, words: np.ndarray, pieces: list[str]) -> None:
        tokenize = self.tokenizer.model.tokenize
        ids: list = [None if (w := self._word(p)) is None else [t.id for t in tokenize(w)] for p in pieces]
        rest = [i for i, x in enumerate(ids) if x is None]
        for i, e in zip(rest, self.tokenizer.encode_batch_fast([pieces[i] for i in rest], add_special_tokens=False)):
            ids[i] = e.ids
        self.table.add(words, ids)

    def _word(self, piece: str) -> str | None:
        """What the model itself is given for a piece of letters alone, which nothing divides further."""
        word = piece[1:] if piece[:1] == " " else piece
        if not self.blanks:
            if not word or max(word) > "ɏ":
                return None
            piece = word = word.lower()
        if not word.isalpha():
            return None
        return piece.encode().decode("latin-1").translate(_BYTES)

    def _piece(self, piece: str) -> bytes:
        if (ids := self.known.get(piece)) is None:
            ids = self.known[piece] = self._whole([piece])[0]
        return ids

    def _other(self, texts: list[str]) -> list[bytes]:
        """Other texts, cut before blanks between words, or whole where that might part them wrongly."""
        out = []
        for t in texts:
            if any(s in t for s in self.special) or (self.blanks and _RUN.search(t)):
                out.append(self._whole([t])[0])
                continue
            if self.blanks:
                first, *rest = t.split(" ")
                pieces = [first, *(f" {p}" for p in rest)]
            else:
                pieces = [p.decode() for p in t.encode().split()]
            new = list(set(pieces) - self.known.keys())
            self.known.update(zip(new, self._whole(new)))
            out.append(b"".join(map(self.known.__getitem__, pieces)))
        return out

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

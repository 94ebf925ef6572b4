"""Phrase counts in a burstable trie: hash containers below a shallow trie of word ids.

A phrase of up to four words is a path of word ids. Below its first words a container is a hash table
from the ids that are left to a count; a container with too many entries bursts into one container
for each next word. Whole subtrees leave as sorted runs when all containers together hold too much.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

WORDS = 4
#: Bits of a word id; ids are numbers from 1 in the order in which a task meets words.
BITS = 21
_LOW = (1 << BITS) - 1
#: Entries of a container before it bursts.
BURST = 4096
#: Most levels of words above the containers.
DEPTH = 2
#: Entries of all containers before the largest subtrees leave, until half of them are gone.
ENTRIES = 1 << 19


class Words(dict):
    """Ids of words; id 0 stands for the end of a piece."""

    def __init__(self):
        super().__init__({b".": 0})
        self.names = [b"."]

    def __missing__(self, word: bytes) -> int:
        self[word] = found = len(self.names)
        self.names.append(word)
        return found


def packed(ids: list[np.ndarray]) -> np.ndarray:
    """Ids after the first of a phrase as one number, the next word on top; 0 where there is none."""
    out = np.zeros(len(ids[0]), np.int64)
    for k in range(1, WORDS):
        out <<= BITS
        if k < len(ids):
            out |= ids[k]
    return out


class Node(dict):
    """A container that has burst: containers, or nodes, by the next word."""


class HatTrie:
    """Counts under a group and a first word: a container, or a node once it has burst."""

    def __init__(self):
        self.groups: dict[str, dict[int, dict]] = {}
        self.entries = 0

    def add(self, group: str, first: np.ndarray, rest: np.ndarray) -> None:
        """Count phrases given by first ids and packed rests."""
        if not len(first):
            return
        low = BITS * (WORDS - 2)
        if not (rest & ((1 << low) - 1)).any():
            # Phrases of two words at most fit into one number.
            key, counts = np.unique(first << BITS | rest >> low, return_counts=True)
            first, rest = key >> BITS, (key & _LOW) << low
        else:
            by = np.lexsort((rest, first))
            first, rest = first[by], rest[by]
            new = np.flatnonzero(np.r_[True, (first[1:] != first[:-1]) | (rest[1:] != rest[:-1])])
            counts = np.diff(np.r_[new, len(first)])
            first, rest = first[new], rest[new]
        cuts = np.flatnonzero(np.r_[True, first[1:] != first[:-1]])
        top, rest, counts = self.groups.setdefault(group, {}), rest.tolist(), counts.tolist()
        before = 0
        for word, start, end in zip(first[cuts].tolist(), cuts.tolist(), [*cuts[1:].tolist(), len(rest)]):
            box = top.get(word)
            if box is None:
                box = top[word] = {}
            if type(box) is Node:
                self._down(box, rest[start:end], counts[start:end], 1)
                continue
            before = len(box)
            for r, c in zip(rest[start:end], counts[start:end]):
                box[r] = box.get(r, 0) + c
            self.entries += len(box) - before
            if len(box) > BURST:
                top[word] = self._burst(box, 1)

    def _burst(self, box: dict[int, int], level: int) -> Node:
        node, shift = Node(), BITS * (WORDS - 1 - level)
        for r, c in box.items():
            node.setdefault(r >> shift & _LOW, {})[r] = c
        return node

    def _down(self, node: Node, rest: list[int], counts: list[int], level: int) -> None:
        """Counts of sorted rests below a node of this level."""
        shift, low = BITS * (WORDS - 1 - level), 0
        while low < len(rest):
            word, high = rest[low] >> shift & _LOW, low
            while high < len(rest) and rest[high] >> shift & _LOW == word:
                high += 1
            box = node.get(word)
            if box is None:
                box = node[word] = {}
            if type(box) is Node:
                self._down(box, rest[low:high], counts[low:high], level + 1)
            else:
                before = len(box)
                for r, c in zip(rest[low:high], counts[low:high]):
                    box[r] = box.get(r, 0) + c
                self.entries += len(box) - before
                if len(box) > BURST and level < DEPTH:
                    node[word] = self._burst(box, level + 1)
            low = high

    def spill(self, keep: int) -> Iterator[tuple[str, np.ndarray, np.ndarray, np.ndarray]]:
        """Take whole subtrees out, the largest first, until at most `keep` entries are left.

        Gives (group, first ids, packed rests, counts), all subtrees of a group together.
        """
        sizes = sorted(((_size(box), group, word) for group, top in self.groups.items() for word, box in top.items()), key=lambda x: -x[0])
        chosen: dict[str, list[int]] = {}
        for size, group, word in sizes:
            if self.entries <= keep:
                break
            chosen.setdefault(group, []).append(word)
            self.entries -= size
        for group, words in chosen.items():
            rests, counts, lengths = [], [], []
            for word in words:
                before = len(rests)
                _gather(self.groups[group].pop(word), rests, counts)
                lengths.append(len(rests) - before)
            yield group, np.repeat(np.array(words, np.int64), lengths), np.array(rests, np.int64), np.array(counts, np.int64)


def _size(box: dict) -> int:
    return sum(map(_size, box.values())) if type(box) is Node else len(box)


def _gather(box: dict, rests: list[int], counts: list[int]) -> None:
    if type(box) is Node:
        for inner in box.values():
            _gather(inner, rests, counts)
    else:
        rests.extend(box)
        counts.extend(box.values())


def unpacked(first: np.ndarray, rest: np.ndarray) -> list[np.ndarray]:
    """Ids of all words of phrases, by place; 0 where a phrase has ended."""
    return [first, *(rest >> BITS * k & _LOW for k in range(WORDS - 2, -1, -1))]

"""A compressed trie of whole byte strings whose terminals hold the least id of their text."""

from __future__ import annotations


class Node:
    """`label` leads here from the parent; `least` is set where a text ends."""

    __slots__ = ("label", "children", "least")

    def __init__(self, label: bytes, children: dict[int, Node] | None = None, least=None):
        self.label, self.children, self.least = label, children, least


def shared(label: bytes, text: bytes, at: int) -> int:
    """How many bytes `label` and `text[at:]` begin with in common, by halving compared slices."""
    low, high = 0, min(len(label), len(text) - at)
    while low < high:
        mid = (low + high + 1) // 2
        if label[low:mid] == text[at + low : at + mid]:
            low = mid
        else:
            high = mid - 1
    return low


class RadixTrie:
    """Texts are never hashed as a whole: a terminal is reached only by comparing every byte."""

    def __init__(self):
        self.root = Node(b"")

    def insert(self, text: bytes, ident) -> Node:
        """The terminal of `text`, its least id lowered to `ident`."""
        node, at = self.root, 0
        while at < len(text):
            if node.children is None:
                node.children = {}
            child = node.children.get(text[at])
            if child is None:
                child = node.children[text[at]] = Node(text[at:])
                node, at = child, len(text)
            elif text.startswith(child.label, at):
                node, at = child, at + len(child.label)
            else:
                n = shared(child.label, text, at)
                fork = Node(child.label[:n], {child.label[n]: child})
                child.label = child.label[n:]
                node.children[text[at]] = fork
                node, at = fork, at + n
        if node.least is None or ident < node.least:
            node.least = ident
        return node

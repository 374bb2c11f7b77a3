"""Deep-shallow suffix sorting of chosen positions, with longest common prefixes.

Shallow: multikey quicksort on eight-byte words (three-way partitions by a pivot, the equal part goes one word
deeper) down to SHALLOW bytes. Deep: the suffixes
that still agree are put into blind tries, which store only branching depths and bytes; a search runs blindly to
a leaf, one comparison with that leaf finds the true depth of divergence, and the walk of the trie gives the
order and the common prefixes of neighbours.
"""

from __future__ import annotations

import numpy as np

SHALLOW = 24


def common(a: bytes, b: bytes) -> int:
    """Length of the common prefix, by halving."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n  # a[:low] agrees, a[:high] doesn't
    while high - low > 1:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


class BlindTrie:
    """Nodes are [depth, {next byte: child}]; leaves are lists of equal suffixes. The end of a suffix is byte -1."""

    def __init__(self, texts: list[bytes]):
        self.texts, self.root = texts, None

    def insert(self, i: int) -> None:
        text = self.texts[i]
        if self.root is None:
            self.root = [i]
            return
        node = self.root
        while isinstance(node, tuple):  # blind: follow known bytes, else any child
            depth, children = node
            node = children.get(text[depth] if depth < len(text) else -1) or next(iter(children.values()))
        other = self.texts[node[0]]
        split = common(text, other)
        if split == len(text) == len(other):
            node.append(i)
            return
        mine, theirs = (t[split] if split < len(t) else -1 for t in (text, other))
        above, key, node = None, -1, self.root
        while isinstance(node, tuple) and node[0] < split:
            above, key = node, text[node[0]] if node[0] < len(text) else -1
            node = node[1][key]
        if isinstance(node, tuple) and node[0] == split:
            node[1][mine] = [i]
            return
        new = (split, {theirs: node, mine: [i]})
        if above is None:
            self.root = new
        else:
            above[1][key] = new

    def walk(self) -> tuple[list[int], list[int]]:
        """Order, and common prefix of each with the one before it (the first: 0)."""
        order: list[int] = []
        lcp: list[int] = []
        todo = [(self.root, 0)]
        while todo:
            node, depth = todo.pop()
            if isinstance(node, tuple):
                keys = sorted(node[1])
                todo += [(node[1][k], node[0]) for k in reversed(keys[1:])]
                todo.append((node[1][keys[0]], depth))
            else:
                order += node
                lcp += [depth] + [len(self.texts[node[0]])] * (len(node) - 1)
        return order, lcp


def multikey_quicksort(words: np.ndarray) -> list[np.ndarray]:
    """words: one row of numbers a string -> row numbers in order, in groups of equal rows."""
    depth_of_all = words.shape[1]
    groups, todo = [], [(np.arange(len(words)), 0)]
    while todo:
        rows, depth = todo.pop()
        if len(rows) <= 1 or depth == depth_of_all:
            if len(rows):
                groups.append(rows)
            continue
        word = words[rows, depth]
        if (word == word[0]).all():
            todo.append((rows, depth + 1))
            continue
        pivot = sorted((word[0], word[len(word) // 2], word[-1]))[1]
        less, more = word < pivot, word > pivot
        todo += [(rows[more], depth), (rows[~less & ~more], depth + 1), (rows[less], depth)]
    return groups


def deep_shallow(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(order, lcp with the neighbour before) of byte strings."""
    padded = b"".join(t[:SHALLOW].ljust(SHALLOW, b"\0") for t in texts)
    groups = multikey_quicksort(np.frombuffer(padded, ">u8").reshape(len(texts), SHALLOW // 8).astype(np.uint64))
    out: list[int] = []
    lcp: list[int] = []
    for g in groups:
        if len(g) == 1:
            own, common_here = [int(g[0])], [0]
        else:
            trie = BlindTrie(texts)
            for i in g.tolist():
                trie.insert(i)
            own, common_here = trie.walk()
        if out:
            common_here[0] = common(texts[out[-1]], texts[own[0]])
        out += own
        lcp += common_here
    return np.array(out, np.int64), np.array(lcp, np.int64)

"""Signature trees: which sets of a block can have a Jaccard similarity of `percent` or more.

A set's signature is a bitmap of its elements, as wide as its size asks for. A node holds the OR of its members'
bitmaps, their least and greatest size, and the greatest excess of size over set bits. Two sets have at most
popcount(A & B) + min(excess A, excess B) elements in common, and no more than either has; a pair of nodes whose
possible overlap is too small for their least sizes is pruned with everything below it, as is a pair whose members
are all linked already. Two trees are descended together, one level at a time.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

FANOUT = 8
SLICE_BYTES = 8 << 20


def width_of(n: int) -> int:
    """Bits of a signature for n elements: a power of two between 2n and 4n, 64 at least."""
    return max(64, 2 << max(0, int(n) - 1).bit_length())


def signature(numbers: np.ndarray) -> np.ndarray:
    width = width_of(len(numbers))
    bits = np.zeros(width, dtype=np.uint8)
    bits[(numbers & np.uint64(width - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").view(np.uint64)


def fold(bits: np.ndarray, words: int) -> np.ndarray:
    """Signatures (one a row) cut to fewer words; elements keep their place modulo the width."""
    while bits.shape[1] > words:
        half = bits.shape[1] // 2
        bits = bits[:, :half] | bits[:, half:]
    return bits


@dataclass
class Level:
    bits: np.ndarray
    least: np.ndarray
    most: np.ndarray
    excess: np.ndarray
    linked: np.ndarray  # the one component of all members, or -1


def build(bits: np.ndarray, sizes: np.ndarray, component: np.ndarray) -> list[Level]:
    """Levels from the leaves up to a single root. Members that are alike should stand next to each other."""
    counted = np.bitwise_count(bits).sum(axis=1).astype(np.int64)
    levels = [Level(bits, sizes, sizes, sizes - counted, component)]
    while len(levels[-1].least) > 1:
        low = levels[-1]
        starts = np.arange(0, len(low.least), FANOUT)
        first, last = np.minimum.reduceat(low.linked, starts), np.maximum.reduceat(low.linked, starts)
        levels.append(Level(
            np.bitwise_or.reduceat(low.bits, starts, axis=0), np.minimum.reduceat(low.least, starts),
            np.maximum.reduceat(low.most, starts), np.maximum.reduceat(low.excess, starts), np.where(first == last, first, -1),
        ))
    return levels


def _possible(a: Level, b: Level, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs of nodes can hold a link that is not yet known."""
    words = a.bits.shape[1]
    keep = np.empty(len(i), dtype=bool)
    step = max(1, SLICE_BYTES // (8 * words))
    for s in range(0, len(i), step):
        x, y = i[s : s + step], j[s : s + step]
        shared = np.bitwise_count(a.bits[x] & b.bits[y]).sum(axis=1).astype(np.int64) + np.minimum(a.excess[x], b.excess[y])
        overlap = np.minimum(shared, np.minimum(a.most[x], b.most[y]))
        keep[s : s + step] = overlap * (100 + percent) >= percent * (a.least[x] + b.least[y])
    return keep & ~((a.linked[i] >= 0) & (a.linked[i] == b.linked[j]))


def descend(one: list[Level], two: list[Level], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of leaves of two trees, or of one tree with itself, that no node pair above them pruned."""
    same = one is two
    height = max(len(one), len(two)) - 1
    i = j = np.zeros(1, dtype=np.int64)
    for h in range(height, -1, -1):
        a, b = (t[min(h, len(t) - 1)] for t in (one, two))
        keep = _possible(a, b, i, j, percent)
        i, j = i[keep], j[keep]
        if h == 0 or len(i) == 0:
            break

        def below(tree: list[Level], nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            if h > len(tree) - 1:
                return nodes[:, None], np.ones((len(nodes), 1), dtype=bool)
            children = nodes[:, None] * FANOUT + np.arange(FANOUT)
            return children, children < len(tree[h - 1].least)

        (x, x_there), (y, y_there) = below(one, i), below(two, j)
        both = x_there[:, :, None] & y_there[:, None, :]
        i = np.broadcast_to(x[:, :, None], both.shape)[both]
        j = np.broadcast_to(y[:, None, :], both.shape)[both]
        if same:
            i, j = i[i <= j], j[i <= j]
    if same:
        i, j = i[i < j], j[i < j]
    return i, j


def candidates(
    signatures: list[np.ndarray], sizes: np.ndarray, component: np.ndarray, order: np.ndarray, percent: int
) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of members that can be linked and are not in one component. Every width of signature has its own tree;
    sets whose widths differ by more than one step differ too much in size. `order` puts like members together."""
    words = np.array([len(s) for s in signatures])
    trees: dict[int, tuple[np.ndarray, list[Level]]] = {}
    for w in np.unique(words):
        own = np.flatnonzero(words == w)
        own = own[np.argsort(order[own], kind="stable")]
        bits = np.stack([signatures[k] for k in own])
        trees[int(w)] = (own, build(bits, sizes[own], component[own]))
    found = []
    for w, (own, tree) in trees.items():
        i, j = descend(tree, tree, percent)
        found.append((own[i], own[j]))
        if 2 * w in trees:
            wide, levels = trees[2 * w]
            narrow = build(fold(levels[0].bits, w), sizes[wide], component[wide])
            i, j = descend(tree, narrow, percent)
            found.append((own[i], wide[j]))
    return tuple(np.concatenate(x) if found else np.zeros(0, dtype=np.int64) for x in zip(*found))  # type: ignore[return-value]


def possible_pairs(one: list[bytes], two: list[bytes], n_one: np.ndarray, n_two: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs of sets, given by the bytes of their signatures and their sizes, can be linked."""
    keep = np.zeros(len(one), dtype=bool)
    words = np.array([(len(a) // 8, len(b) // 8) for a, b in zip(one, two)], dtype=np.int64).reshape(-1, 2)
    for pair in np.unique(words, axis=0):
        own = np.flatnonzero((words == pair).all(axis=1))
        step = max(1, SLICE_BYTES // (8 * int(pair.max())))
        for s in range(0, len(own), step):
            at = own[s : s + step]
            a, b = (
                fold(np.frombuffer(b"".join([side[k] for k in at.tolist()]), dtype=np.uint64).reshape(len(at), w), int(pair.min()))
                for side, w in ((one, pair[0]), (two, pair[1]))
            )
            n, m = n_one[at], n_two[at]
            excess = [size - np.bitwise_count(bits).sum(axis=1).astype(np.int64) for size, bits in ((n, a), (m, b))]
            shared = np.bitwise_count(a & b).sum(axis=1).astype(np.int64) + np.minimum(*excess)
            keep[at] = np.minimum(shared, np.minimum(n, m)) * (100 + percent) >= percent * (n + m)
    return keep


class Links:
    """Union-find over the members of a block."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def root(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def join(self, x: int, y: int) -> None:
        x, y = sorted((self.root(x), self.root(y)))
        self.parent[y] = x


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union, for ascending distinct numbers."""
    if len(a) == 0 or len(b) == 0:
        return False
    place = np.minimum(np.searchsorted(a, b), len(a) - 1)
    common = int((a[place] == b).sum())
    return 100 * common >= percent * (len(a) + len(b) - common)


def link_block(sets: list[np.ndarray], percent: int) -> list[int]:
    """For every set of a block, the first member it is connected with by links inside the block."""
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    order = np.argsort(np.argsort(np.array([s[0] if len(s) else 0 for s in sets], dtype=np.uint64), kind="stable"))
    none = np.arange(len(sets))  # every member is its own component
    i, j = candidates([signature(s) for s in sets], sizes, none, order, percent)
    links = Links(len(sets))
    for x, y in zip(i.tolist(), j.tolist()):
        if links.root(x) != links.root(y) and linked(sets[x], sets[y], percent):
            links.join(x, y)
    return [links.root(x) for x in range(len(sets))]

"""Gray-order hierarchical index over 64-bit fingerprints.

Fingerprints are sorted by their rank in the reflected Gray code, so neighbours differ in few
bits. Groups of ``FAN`` neighbours form a node; a node holds the bits on which all below it agree
(mask and pattern), less the bits that a node above it already holds. A query walks down with the
differences it has gathered so far and drops a whole group as soon as they exceed the limit.
"""

from __future__ import annotations

import numpy as np

FAN = 8
_U = np.uint64
_ALL = _U(0xFFFFFFFFFFFFFFFF)


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Position of each word in Gray-code order (inverse of ``r ^ (r >> 1)``)."""
    x = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> _U(s)
    return x


class GrayIndex:
    """``levels[0]`` is the top; each level has masks and patterns; ``codes`` are the leaves."""

    def __init__(self, codes: np.ndarray, must: int = 0):
        """``codes``: distinct uint64 values, in any order. On the bits of ``must`` a leaf has to
        equal the query (codes are sorted by those bits first, so they lead the upper nodes)."""
        self.must = _U(must)
        self.order = np.lexsort((gray_rank(codes & ~self.must), codes & self.must))
        self.codes = codes[self.order]
        agree, value, levels = np.full(len(codes), _ALL), self.codes, []
        while len(agree) > 1:
            at = np.arange(0, len(agree), FAN)
            ones = np.bitwise_and.reduceat(value & agree, at)
            zeros = np.bitwise_and.reduceat(~value & agree, at)
            levels.append((agree, value))
            agree, value = ones | zeros, ones
        levels.append((agree, value))
        levels.reverse()
        self.levels = []
        above = np.zeros(1, _U)
        for i, (m, v) in enumerate(levels):
            up = above if i == 0 else np.repeat(above, FAN)[:len(m)]
            self.levels.append((m & ~up, v & m & ~up))
            above = m
        self.n = len(codes)

    def search(self, queries: np.ndarray, limit: int, mine=None, low=None, high=None):
        """All (query number, leaf number, distance) with distance <= limit. With ``mine`` (a
        label per query) and the labels ``low``/``high`` per node and level, groups whose leaves
        all have the query's own label are left out: they can't add a new link."""
        q = np.arange(len(queries))
        node = np.zeros(len(queries), np.int64)
        far = np.zeros(len(queries), np.uint8)
        if not self.n:
            return q[:0], node[:0], far[:0]
        for i, (mask, pattern) in enumerate(self.levels):
            if i:
                size = len(mask)
                first = node * FAN
                fan = np.minimum(FAN, size - first)
                q, far = np.repeat(q, fan), np.repeat(far, fan)
                step = np.arange(len(q)) - np.repeat(np.cumsum(fan) - fan, fan)
                node = np.repeat(first, fan) + step
            differ = (queries[q] ^ pattern[node]) & mask[node]
            far = far + np.bitwise_count(differ)
            keep = (far <= limit) & (differ & self.must == 0)
            if mine is not None:
                own = mine[q]
                keep &= ~((low[i][node] == own) & (high[i][node] == own))
            q, node, far = q[keep], node[keep], far[keep]
        return q, node, far

    def spans(self, label: np.ndarray):
        """Smallest and largest leaf label below each node, level by level."""
        low, high = [label], [label]
        for _ in range(len(self.levels) - 1):
            at = np.arange(0, len(low[-1]), FAN)
            low.append(np.minimum.reduceat(low[-1], at))
            high.append(np.maximum.reduceat(high[-1], at))
        return low[::-1], high[::-1]


def _join(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after linking the classes ``a[i]`` and ``b[i]``; a label is the class's smallest
    leaf number."""
    pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
    root = {}

    def find(x):
        while root.get(x, x) != x:
            root[x] = root.get(root[x], root[x])
            x = root[x]
        return x

    for x, y in pairs.tolist():
        x, y = find(x), find(y)
        if x != y:
            root[max(x, y)] = min(x, y)
    if not root:
        return label
    to = np.arange(len(label))
    for x in root:
        to[x] = find(x)
    return to[label]


def classes(codes: np.ndarray, limit: int, must: int = 0, block: int = 256) -> np.ndarray:
    """For distinct codes: a label per code, equal exactly for codes that chains of links (at
    most ``limit`` differing bits each, none in ``must``) connect. Queries go in blocks in Gray order; between
    blocks the labels are renewed, so a dense class is soon skipped group by group."""
    index = GrayIndex(codes, must)
    label = np.arange(index.n)
    for s in range(0, index.n, block):
        e = min(index.n, s + block)
        low, high = index.spans(label)
        q, leaf, _ = index.search(index.codes[s:e], limit, label[s:e], low, high)
        a, b = label[s + q], label[leaf]
        new = a != b
        if new.any():
            label = _join(label, a[new], b[new])
    out = np.empty(index.n, np.int64)
    out[index.order] = label
    return out


def links_between(left: np.ndarray, right: np.ndarray, limit: int, block: int = 2048):
    """A spanning set of links between two lists of distinct codes: (left number, right number)
    pairs whose classes equal those of all links between the lists."""
    index = GrayIndex(right)
    n = len(right)
    label = np.arange(n + len(left))  # leaves first, then the left codes
    out_a, out_b = [], []
    for s in range(0, len(left), block):
        e = min(len(left), s + block)
        low, high = index.spans(label[:n])
        q, leaf, _ = index.search(left[s:e], limit, label[n + s:n + e], low, high)
        a, b = label[n + s + q], label[leaf]
        new = np.flatnonzero(a != b)
        if len(new):
            pair = np.unique(np.stack([a[new], b[new]], axis=1), axis=0, return_index=True)[1]
            out_a.append(s + q[new[pair]])
            out_b.append(index.order[leaf[new[pair]]])
            label = _join(label, a[new], b[new])
    if not out_a:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(out_a), np.concatenate(out_b)

"""Signature trees over sets of hashes, and the search for links within a group by traversing a tree against itself."""

from __future__ import annotations

import numpy as np

#: Sets in a leaf, children of a node, and bounds of the bitmaps' width.
LEAF, FAN = 32, 8
NARROW, WIDE = 64, 32768


def width_for(n: float) -> int:
    """Bits of a bitmap for n elements: a power of two, at least 1.5 each within the bounds."""
    return int(2 ** np.ceil(np.log2(np.clip(1.5 * n, NARROW, WIDE))))


def bitmap(s: np.ndarray, width: int) -> np.ndarray:
    marks = np.zeros(width, np.uint8)
    marks[(s >> np.uint64(20)) & np.uint64(width - 1)] = 1
    return np.packbits(marks)


def folded(marks: bytes, width: int) -> np.ndarray:
    """A bitmap at a smaller width."""
    return np.bitwise_or.reduce(np.frombuffer(marks, np.uint8).reshape(-1, width // 8))


class SignatureTree:
    """Nodes hold the OR of their sets' bitmaps, the range of set sizes, and the most elements that a set's bitmap doesn't tell apart.

    Sets that are alike should stand together. Without the sets themselves, pairs that the bitmaps
    allow are joined.
    """

    def __init__(self, n: np.ndarray, bits: np.ndarray, sets: list[np.ndarray] | None = None):
        self.sets = sets
        slack = n - np.bitwise_count(bits).sum(1).astype(np.int64)
        self.leaf = (bits, n, slack)
        self.levels = []
        low, high = np.arange(0, len(n), LEAF), np.minimum(np.arange(LEAF, len(n) + LEAF, LEAF), len(n))
        below, step = (bits, n, n, slack), LEAF
        while True:
            at = np.arange(0, len(below[1]), step)
            below = (np.bitwise_or.reduceat(below[0], at), np.minimum.reduceat(below[1], at), np.maximum.reduceat(below[2], at), np.maximum.reduceat(below[3], at))
            self.levels.append((*below, low, high))
            if len(at) == 1:
                break
            step = FAN
            low, high = low[::FAN], np.r_[low[FAN::FAN], len(n)]

    def may_link(self, level: int, i: int, j: int, p: int) -> bool:
        """Whether the greatest overlap that the two nodes allow is enough for any pair of theirs."""
        bits, least, most, slack, _, _ = self.levels[level]
        common = int(np.bitwise_count(bits[i] & bits[j]).sum())
        overlap = min(most[i], most[j], slack[i] + common, slack[j] + common)
        return (100 + p) * overlap >= p * (least[i] + least[j])

    def components(self, p: int, labels: np.ndarray) -> np.ndarray:
        """Joins labels of sets whose 100 * overlap >= p * union; pairs with equal labels already are skipped, whole node pairs of them too."""
        labels = labels.copy()
        top = len(self.levels) - 1
        stack = [(top, 0, 0)]
        while stack:
            level, i, j = stack.pop()
            low, high = self.levels[level][4:]
            one = labels[low[i]]
            if (labels[low[i] : high[i]] == one).all() and (labels[low[j] : high[j]] == one).all():
                continue
            if i != j and not self.may_link(level, i, j, p):
                continue
            if level == 0:
                self._leaves(range(low[i], high[i]), range(low[j], high[j]), p, labels)
                continue
            width = len(self.levels[level - 1][1])
            left, right = range(i * FAN, min((i + 1) * FAN, width)), range(j * FAN, min((j + 1) * FAN, width))
            stack += [(level - 1, a, b) for a in left for b in right if i != j or a <= b][::-1]
        return labels

    def _leaves(self, left: range, right: range, p: int, labels: np.ndarray) -> None:
        bits, n, slack = self.leaf
        a, b = slice(left.start, left.stop), slice(right.start, right.stop)
        common = np.bitwise_count(bits[a][:, None, :] & bits[b][None, :, :]).sum(2).astype(np.int64)
        overlap = np.minimum(np.minimum(n[a][:, None], n[b][None, :]), np.minimum(slack[a][:, None], slack[b][None, :]) + common)
        open_ = ((100 + p) * overlap >= p * (n[a][:, None] + n[b][None, :])) & (labels[a][:, None] != labels[b][None, :])
        if left.start == right.start:
            open_ = np.triu(open_, 1)
        for x, y in zip(*np.nonzero(open_)):
            x, y = left.start + x, right.start + y
            if labels[x] != labels[y] and (self.sets is None or linked(self.sets[x], self.sets[y], p)):
                old, new = max(labels[x], labels[y]), min(labels[x], labels[y])
                labels[labels == old] = new


def linked(x: np.ndarray, y: np.ndarray, p: int) -> bool:
    """x and y sorted and distinct."""
    both = np.sort(np.concatenate([x, y]), kind="stable")
    overlap = int(np.count_nonzero(both[1:] == both[:-1]))
    return 100 * overlap >= p * (len(x) + len(y) - overlap)


def join_group(ids: np.ndarray, sets: list[np.ndarray], p: int, labels: np.ndarray | None = None) -> np.ndarray:
    """Label of each set: the smallest label that it reaches by links within the group; at first its own id, or what is given."""
    order = sorted(range(len(sets)), key=lambda k: (int(sets[k][0]), len(sets[k])))
    start = (ids if labels is None else labels)[order]
    n = np.array([len(sets[k]) for k in order], np.int64)
    width = width_for(2.5 * np.median(n))
    bits = np.stack([bitmap(sets[k], width) for k in order]).view(np.uint64)
    out = np.empty(len(sets), np.int64)
    out[order] = SignatureTree(n, bits, [sets[k] for k in order]).components(p, start.astype(np.int64))
    return out


def may_join(ids: np.ndarray, sizes: np.ndarray, maps: list[bytes], p: int) -> np.ndarray:
    """Label of each bitmap: the smallest id that it reaches by pairs whose bitmaps and sizes allow a link."""
    order = sorted(range(len(maps)), key=lambda k: maps[k])
    width = 8 * min(map(len, maps))
    bits = np.stack([folded(maps[k], width) for k in order]).view(np.uint64)
    out = np.empty(len(maps), np.int64)
    out[order] = SignatureTree(sizes[order], bits).components(p, ids[order].astype(np.int64))
    return out

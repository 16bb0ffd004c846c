"""Cover trees over blocks of vectors, and Lloyd's assignment by a vector tree and a centroid tree at once."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

from .vectors import squared

#: A node with more children than that isn't split: its vectors lie too far from each other for a tree to help.
MAX_CHILDREN = 64


@dataclass
class CoverTree:
    """Nodes breadth first; node i holds the vectors order[low[i]:high[i]], its children are nodes child[i] to last[i].

    A node's center is one of its vectors (and the center of its first child); all its vectors lie within radius. The
    centers of its children lie within the power of two that covers the node, and more than half of it from each other.
    """

    order: np.ndarray
    low: np.ndarray
    high: np.ndarray
    center: np.ndarray
    radius: np.ndarray
    child: np.ndarray
    last: np.ndarray

    def encoded(self) -> tuple[bytes, bytes, bytes]:
        whole = np.stack([self.low, self.high, self.center, self.child, self.last]).astype("<i4")
        return self.order.astype("<i4").tobytes(), whole.tobytes(), self.radius.astype("<f8").tobytes()

    @classmethod
    def decoded(cls, order: bytes, whole: bytes, radius: bytes) -> CoverTree:
        low, high, center, child, last = np.frombuffer(whole, "<i4").reshape(5, -1)
        return cls(np.frombuffer(order, "<i4"), low, high, center, np.frombuffer(radius, "<f8"), child, last)


def distances(x: np.ndarray, to: np.ndarray) -> np.ndarray:
    return np.sqrt(squared(x, to[None])[:, 0].astype(float))


def cover_tree(x: np.ndarray, leaf: int = 32) -> CoverTree:
    """A tree over the rows of x. Nodes of up to `leaf` rows, of equal rows, or of rows all far apart, are leaves."""
    order = np.arange(len(x))
    low, high, center, radius, child, last = [0], [len(x)], [0], [], [], []
    at = 0
    while at < len(low):
        mine = order[low[at] : high[at]]
        far = distances(x[mine], x[center[at]])
        radius.append(float(far.max(initial=0.0)) * (1 + 1e-12))
        kids, near = [center[at]], np.zeros(len(mine), dtype=np.int64)
        if len(mine) > leaf and radius[at] > 0:
            apart = 2.0 ** (math.ceil(math.log2(radius[at])) - 1)
            while far[worst := far.argmax()] > apart and len(kids) <= MAX_CHILDREN:
                here = distances(x[mine], x[mine[worst]])
                near[here < far] = len(kids)
                far = np.minimum(far, here)
                kids.append(int(mine[worst]))
        child.append(len(low))
        if 1 < len(kids) <= MAX_CHILDREN:
            dealt = np.argsort(near, kind="stable")
            order[low[at] : high[at]] = mine[dealt]
            ends = low[at] + np.cumsum(np.bincount(near, minlength=len(kids)))
            low += [low[at], *ends[:-1].tolist()]
            high += ends.tolist()
            center += kids
        last.append(len(low))
        at += 1
    return CoverTree(order, *(np.array(v, dtype=np.int64) for v in (low, high, center)), np.array(radius), np.array(child, dtype=np.int64), np.array(last, dtype=np.int64))


def nearest(x: np.ndarray, tree: CoverTree, centroids: np.ndarray, over: CoverTree) -> tuple[np.ndarray, int]:
    """For each row of x its nearest row of centroids (of equally near ones the first), and how many distances were computed.

    Pairs of a node of vectors and a node of centroids are met from both roots down. Every vector of a node has a centroid
    within the least distance of centers plus the node's radius; centroid nodes that lie farther for all of the node's
    vectors are dropped, and single centroids also if the node lies wholly on another one's side. A node left with one
    centroid is settled as a whole; at leaves the centroids left are compared exactly. Bounds must fail by more than
    rounding, so that ties always reach that comparison.
    """
    out, computed = np.zeros(len(x), dtype=np.int64), 0
    if not len(x):
        return out, computed
    between = np.sqrt(squared(centroids, centroids).astype(float))
    is_leaf = over.child == over.last
    pending = [(0, np.array([0]))]
    while pending:
        node, with_ = pending.pop()
        r, bottom = tree.radius[node], tree.child[node] == tree.last[node]
        far = distances(centroids[over.center[with_]], x[tree.center[node]])
        computed += len(with_)
        while True:
            slack = 1e-6 * (1.0 + far.min() + r)
            keep = far - over.radius[with_] - r <= far.min() + r + slack
            best = int(over.center[with_[far.argmin()]])
            side = (far * far - far.min() ** 2) <= 2 * (r + slack) * between[best, over.center[with_]] + slack
            keep &= side | (over.radius[with_] > 0)
            with_, far = with_[keep], far[keep]
            split = ~is_leaf[with_] & (bottom | (over.radius[with_] > r))
            if not split.any():
                break
            kids = np.concatenate([np.arange(over.child[q], over.last[q]) for q in with_[split]])
            with_, far = np.concatenate([with_[~split], kids]), np.concatenate([far[~split], distances(centroids[over.center[kids]], x[tree.center[node]])])
            computed += len(kids)
        mine = tree.order[tree.low[node] : tree.high[node]]
        if len(with_) == 1 and over.radius[with_[0]] == 0:
            out[mine] = over.order[over.low[with_[0]] : over.high[with_[0]]].min()  # one place, of the centroids there the first
        elif bottom:
            some = np.sort(np.concatenate([over.order[over.low[q] : over.high[q]] for q in with_]))
            out[mine] = some[squared(x[mine], centroids[some]).argmin(axis=1)]
            computed += len(mine) * len(some)
        else:
            pending += [(kid, with_) for kid in range(tree.child[node], tree.last[node])]
    return out, computed

"""Repeated windows by a suffix array, sorted in two stages.

A suffix is of type S if it is smaller than its successor (the suffix a byte later), else of type L. Only the S
suffixes are sorted directly. The L suffixes are induced: buckets by first byte are scanned upwards, in each the L
suffixes before the S ones, and the predecessor of each suffix met, if it is of type L, goes to the end of its own
bucket's L part. Common prefixes of neighbours in the array then tell which windows repeat.
"""

from __future__ import annotations

import numpy as np


def suffix_array(parts: list[bytes], starts: list[int], depth: int) -> tuple[bytes, np.ndarray, list[int]]:
    """Sorts, to a depth in bytes, the suffixes of each part that begin among its first `starts` bytes.

    Returns the parts joined, each with an end mark (one byte), where each part begins in it, and the suffixes in order.
    Suffixes after the first `starts` bytes of a part are in the array too as far as others are induced from them.
    """
    joined = b"".join([x for part in parts for x in (part, b"\0")])
    sizes = np.array([len(p) for p in parts])
    bases = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    marks = bases + sizes
    data = np.frombuffer(joined, np.uint8).astype(np.int16)
    data[marks] = -1  # below all bytes
    step = np.diff(data, append=np.int16(-1))
    # Of equal neighbours the next that differs decides.
    index = np.where(step != 0, np.arange(len(step)), len(step))
    index = np.minimum.accumulate(index[::-1])[::-1]
    kind_s = step[np.minimum(index, len(step) - 1)] > 0
    kind_s[marks] = True
    # Wanted: the first `starts`, and from there on up to the next S suffix, the end mark at the latest.
    next_s = np.minimum.accumulate(np.where(kind_s, np.arange(len(step)), len(step))[::-1])[::-1]
    wanted = np.zeros(len(step) + 1, dtype=np.int32)
    np.add.at(wanted, bases, 1)
    np.add.at(wanted, next_s[np.minimum(bases + np.array(starts), marks)] + 1, -1)
    wanted = np.cumsum(wanted[:-1]) > 0
    is_l = (wanted & ~kind_s).tobytes()

    ends = np.flatnonzero(wanted & kind_s & (data < 0)).tolist()
    direct = np.flatnonzero(wanted & kind_s & (data >= 0)).tolist()
    if direct:
        direct.sort(key=_slices(joined, marks, direct, depth).__getitem__)
    large: list[list[int]] = [[] for _ in range(256)]
    small: list[list[int]] = [[] for _ in range(256)]
    for g in direct:
        small[joined[g]].append(g)
    for g in ends:
        if g and is_l[g - 1]:
            large[joined[g - 1]].append(g - 1)
    order: list[int] = []
    for byte in range(256):
        for part in (large[byte], small[byte]):
            for g in part:  # the L part grows while it is scanned
                if g and is_l[g - 1]:
                    large[joined[g - 1]].append(g - 1)
            order += part
    return joined, bases, order


def _slices(joined: bytes, marks: np.ndarray, places: list[int], depth: int) -> dict[int, bytes]:
    """What follows each place, to the depth, but not beyond its part."""
    ends = marks[np.searchsorted(marks, places)].tolist()
    return {g: joined[g : min(g + depth, e)] for g, e in zip(places, ends)}


def common_prefixes(joined: bytes, array: np.ndarray, most: int) -> np.ndarray:
    """How many bytes each suffix has in common with the one before it in the array, up to `most`; 0 for the first."""
    out = np.zeros(len(array), dtype=np.int64)
    words = np.ndarray(len(joined), "<u8", joined + bytes(8), strides=(1,))  # the eight bytes from each place on
    a, b, open_ = array[:-1], array[1:], np.arange(1, len(array))
    for at in range(0, most, 8):
        ends = len(joined) - 1
        x, y = words[np.minimum(a + at, ends)], words[np.minimum(b + at, ends)]
        same = x == y
        differ = x[~same] ^ y[~same]
        lowest = differ & (~differ + np.uint64(1))
        out[open_[~same]] = at + np.log2(lowest.astype(float)).astype(np.int64) // 8
        a, b, open_ = a[same], b[same], open_[same]
        if not len(open_):
            break
    out[open_] = most
    return np.minimum(out, most)


def repeated(parts: list[bytes], window: int) -> list[np.ndarray]:
    """For each part, which of its windows occur once more, in it or in another part."""
    counts = [max(0, len(p) - window + 1) for p in parts]
    joined, bases, order = suffix_array(parts, counts, window)
    flags = np.zeros(len(joined) + 1, dtype=bool)
    is_window = np.zeros(len(joined) + 1, dtype=bool)
    for base, n in zip(bases.tolist(), counts):
        is_window[base : base + n] = True
    array = np.array(order, dtype=np.int64)
    array = array[is_window[array]]  # each has a whole window before its part's end mark
    twice = np.flatnonzero(common_prefixes(joined, array, window) >= window)
    flags[array[twice]] = True
    flags[array[twice - 1]] = True
    return [flags[base : base + n] for base, n in zip(bases.tolist(), counts)]

"""Windows of a text that may repeat: runs of windows with the same least gram hash.

Equal windows have equal grams, so equal least hashes: a window can only repeat one with the same key. Neighbouring
windows mostly share their least gram, so a run of them is written once, with its key and a hash of its whole text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash

GRAM, MAX_RUN = 16, 256
_RANDOM = np.random.default_rng(20_240_229).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _gram_hashes(data: np.ndarray, level: int = 0) -> np.ndarray:
    """A 64-bit hash of the GRAM bytes from each position on, by doubling; another order of grams for each level."""
    h, size, odd = _RANDOM[data], 1, 0x9E3779B97F4A7C15
    while size < GRAM:
        h = h[:-size] * np.uint64(odd) + h[size:]
        odd = (odd * odd + 2) % (1 << 64)
        size *= 2
    h += np.array(level, dtype=np.uint64) * np.array(0x94D049BB133111EB, dtype=np.uint64)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def _least(h: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` neighbours, by doubling."""
    m, size = h, 1
    while size * 2 <= width:
        m = np.minimum(m[:-size], m[size:])
        size *= 2
    return np.minimum(m[: len(h) - width + 1], m[width - size :]) if width > size else m


def _more_than_once(h: np.ndarray, key: np.ndarray, width: int, begin: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """For each run, whether its least gram hash is met twice in it: only then can two of its own windows be equal."""
    # A gram is the least of some window if it is as low as the highest of the least ones around it.
    edge = np.zeros(width - 1, dtype=key.dtype)
    highest = ~_least(~np.concatenate([edge, key, edge]), width)
    places = np.flatnonzero(h == highest)
    value, low, high = h[places], np.searchsorted(places, begin), np.searchsorted(places, stop + width - 1)
    times, wanted, k = np.zeros(len(begin), dtype=np.int32), key[begin], 0
    while len(open_ := np.flatnonzero((low + k < high) & (times < 2))):
        times[open_] += value[low[open_] + k] == wanted[open_]
        k += 1
    return times > 1


def _first_gram_again(h: np.ndarray, begin: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """For each run, whether two of its windows begin with the same gram."""
    n = stop - begin
    run = np.repeat(np.arange(len(begin)), n)
    value = h[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin, n)]
    order = np.lexsort((value, run))
    twice = (run[order][1:] == run[order][:-1]) & (value[order][1:] == value[order][:-1])
    out = np.zeros(len(begin), dtype=bool)
    out[run[order][1:][twice]] = True
    return out


def runs(texts: list[bytes], window: int, level: int = 0, longest: int = MAX_RUN) -> Iterator[tuple[np.ndarray, ...]]:
    """Arrays (text number, first window, windows, key, hash of the run's text, whether it may repeat in itself), for some texts at a time.

    From level 1 on, a window's key is the least gram hashes of its first and of its last part, together: a half of the
    window at level 1, a quarter at level 2, and so on. So windows that lie partly in a frequent passage soon have keys
    of their own. The grams' hashes are others at each level. No run has more than `longest` windows.
    """
    at = 0
    while at < len(texts):
        upto, size = at, 0
        while upto < len(texts) and (size < (1 << 20) or upto == at):
            size += len(texts[upto])
            upto += 1
        yield _runs(texts[at:upto], at, window, level, longest)
        at = upto


def _runs(texts: list[bytes], first: int, window: int, level: int, longest: int) -> tuple[np.ndarray, ...]:
    none = np.zeros(0, dtype=np.int64)
    numbers = [i for i, t in enumerate(texts) if len(t) >= window]
    if not numbers:
        return none, none, none, none.view(np.uint64), none.view(np.uint64), none.astype(bool)
    joined = b"".join(texts[i] for i in numbers)
    ends = np.cumsum([len(texts[i]) for i in numbers])
    starts = np.concatenate([[0], ends[:-1]])
    grams, width = _gram_hashes(np.frombuffer(joined, np.uint8), level), window - GRAM + 1
    key = _least(grams, width)
    if level and (part := window >> level) >= GRAM:
        ends_least = _least(grams, part - GRAM + 1)
        key = ends_least[: len(key)] * np.uint64(0x9E3779B97F4A7C15) ^ ends_least[window - part :][: len(key)]
    new = np.empty(len(key), dtype=bool)
    new[0] = True
    np.not_equal(key[1:], key[:-1], out=new[1:])
    new[starts] = True
    begin = np.flatnonzero(new)
    stop = np.concatenate([begin[1:], [len(key)]])
    text = np.searchsorted(starts, begin, "right") - 1
    stop = np.minimum(stop, ends[text] - window + 1)
    ok = stop > begin
    begin, stop, text = begin[ok], stop[ok], text[ok]
    pieces = (stop - begin + longest - 1) // longest
    if (pieces > 1).any():
        within = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        text, last = np.repeat(text, pieces), np.repeat(stop, pieces)
        begin = np.repeat(begin, pieces) + within * longest
        stop = np.minimum(begin + longest, last)
    view, digest = memoryview(joined), xxhash.xxh3_64_intdigest
    whole = np.fromiter((digest(view[a:b]) for a, b in zip(begin.tolist(), (stop + window - 1).tolist())), dtype=np.uint64, count=len(begin))
    return first + np.array(numbers)[text], begin - starts[text], stop - begin, key[begin], whole, _first_gram_again(grams, begin, stop) if level else _more_than_once(grams, key, width, begin, stop)

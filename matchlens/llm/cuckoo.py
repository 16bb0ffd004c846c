"""A cuckoo filter over 64-bit hashes: four slots a bucket, 16-bit tags, insertions and deletions."""

from __future__ import annotations

import numpy as np

SLOTS, MASK64 = 4, (1 << 64) - 1


def _mix(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class CuckooFilter:
    """Never says no to a hash that was inserted and not deleted; hashes that didn't fit are kept in `rest`, whole."""

    def __init__(self, buckets: int, slots: np.ndarray | None = None, rest: list[int] | None = None):
        self.buckets = buckets
        self.slots = np.zeros((buckets, SLOTS), dtype=np.uint16) if slots is None else slots
        self.rest = list(rest or [])

    @classmethod
    def sized(cls, keys: int) -> CuckooFilter:
        return cls(1 << max(4, int(np.ceil(np.log2(max(1, keys) / (SLOTS * 0.85))))))

    def places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h = _mix(np.asarray(hashes).view(np.uint64) if np.asarray(hashes).dtype == np.int64 else np.asarray(hashes, dtype=np.uint64))
        tag = (h >> np.uint64(48)).astype(np.uint16)
        tag[tag == 0] = 1
        first = (h & np.uint64(self.buckets - 1)).astype(np.int64)
        return tag, first, self.other(tag, first)

    def other(self, tag: np.ndarray, place: np.ndarray) -> np.ndarray:
        return place ^ (_mix(tag.astype(np.uint64)) & np.uint64(self.buckets - 1)).astype(np.int64)

    def insert(self, hashes: np.ndarray, kicks: int = 200) -> None:
        tags, firsts, others = self.places(hashes)
        for h, tag, a, b in zip(np.asarray(hashes).tolist(), tags.tolist(), firsts.tolist(), others.tolist()):
            for place in (a, b):
                free = np.flatnonzero(self.slots[place] == 0)
                if len(free):
                    self.slots[place, free[0]] = tag
                    break
            else:
                self._kick(h, tag, a, kicks)

    def _kick(self, h: int, tag: int, place: int, kicks: int) -> None:
        path = []
        for k in range(kicks):
            slot = (k * 7 + tag) % SLOTS
            path.append((place, slot, int(self.slots[place, slot])))
            self.slots[place, slot], tag = tag, int(self.slots[place, slot])
            place = int(self.other(np.array([tag], dtype=np.uint16), np.array([place]))[0])
            free = np.flatnonzero(self.slots[place] == 0)
            if len(free):
                self.slots[place, free[0]] = tag
                return
        for place, slot, was in reversed(path):
            self.slots[place, slot] = was
        self.rest.append(h)

    def delete(self, hashes: np.ndarray) -> None:
        """Takes out hashes that were inserted, each once."""
        tags, firsts, others = self.places(hashes)
        for h, tag, a, b in zip(np.asarray(hashes).tolist(), tags.tolist(), firsts.tolist(), others.tolist()):
            if h in self.rest:
                self.rest.remove(h)
                continue
            for place in (a, b):
                held = np.flatnonzero(self.slots[place] == tag)
                if len(held):
                    self.slots[place, held[0]] = 0
                    break

    def contains(self, hashes: np.ndarray) -> np.ndarray:
        tags, firsts, others = self.places(hashes)
        found = (self.slots[firsts] == tags[:, None]).any(axis=1) | (self.slots[others] == tags[:, None]).any(axis=1)
        return found | np.isin(hashes, self.rest) if self.rest else found

    def to_bytes(self) -> bytes:
        return np.array([self.buckets], dtype="<i8").tobytes() + self.slots.astype("<u2").tobytes() + np.array(self.rest, dtype="<i8").tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> CuckooFilter:
        buckets = int(np.frombuffer(data, "<i8", 1)[0])
        slots = np.frombuffer(data, "<u2", buckets * SLOTS, 8).reshape(buckets, SLOTS).copy()
        return cls(buckets, slots, np.frombuffer(data[8 + 2 * SLOTS * buckets :], "<i8").tolist())

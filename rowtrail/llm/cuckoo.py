"""A cuckoo filter on numpy arrays: 16-bit fingerprints, four slots a bucket, insert and delete."""

from __future__ import annotations

import numpy as np

from rowtrail.llm.common import mix64

SLOTS = 4
KICKS = 500


class CuckooFilter:
    """Approximate set of 64-bit hashes: no false negatives, deletions of inserted hashes allowed."""

    def __init__(self, slots: np.ndarray):
        self.slots = slots

    @classmethod
    def sized(cls, n: int) -> "CuckooFilter":
        buckets = 1 << max(1, int(np.ceil(np.log2(max(1, n) / (SLOTS * 0.8)))))
        return cls(np.zeros((buckets, SLOTS), np.uint16))

    @classmethod
    def of(cls, hashes: np.ndarray, room: int | None = None) -> "CuckooFilter":
        """A filter that holds all hashes; grows until every one has a place."""
        room = max(room or 0, len(hashes))
        while True:
            made = cls.sized(room)
            if made.insert_all(hashes):
                return made
            room *= 2

    @classmethod
    def from_bytes(cls, data: bytes) -> "CuckooFilter":
        return cls(np.frombuffer(data, np.uint16).reshape(-1, SLOTS).copy())

    def to_bytes(self) -> bytes:
        return self.slots.tobytes()

    def _places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h = mix64(np.asarray(hashes, np.uint64))
        mask = np.uint64(len(self.slots) - 1)
        mark = (h >> np.uint64(48)).astype(np.uint16)
        mark[mark == 0] = 1
        first = h & mask
        return mark, first, first ^ (mix64(mark.astype(np.uint64)) & mask)

    def _other(self, place: int, mark: int) -> int:
        return place ^ int(mix64(np.array([mark], np.uint64))[0] & np.uint64(len(self.slots) - 1))

    def insert_all(self, hashes: np.ndarray) -> bool:
        """Insert an array: whole arrays go to free slots of the first, then of the second bucket; only the rest kicks."""
        hashes = np.asarray(hashes, np.uint64)
        mark, first, second = self._places(hashes)
        left = np.arange(len(hashes))
        for places in (first, second):
            order = left[np.argsort(places[left], kind="stable")]
            bucket = places[order].astype(np.int64)
            start = np.flatnonzero(np.diff(bucket, prepend=-1))
            turn = np.arange(len(order)) - np.repeat(start, np.diff(np.append(start, len(order))))
            taken = (self.slots[bucket] != 0).sum(axis=1)  # slots fill from the left, but deletions leave holes
            fits = turn < SLOTS - taken
            hole = np.argsort(self.slots[bucket[fits]] != 0, axis=1, kind="stable")
            self.slots[bucket[fits], hole[np.arange(int(fits.sum())), turn[fits]]] = mark[order[fits]]
            left = order[~fits]
        return all(self.insert(h) for h in hashes[left])

    def insert(self, value: int) -> bool:
        mark, a, b = (int(x[0]) for x in self._places(np.array([value], np.uint64)))
        for place in (a, b):
            free = np.flatnonzero(self.slots[place] == 0)
            if len(free):
                self.slots[place, free[0]] = mark
                return True
        place = a
        for kick in range(KICKS):
            slot = (kick + mark) % SLOTS
            mark, self.slots[place, slot] = int(self.slots[place, slot]), mark
            place = self._other(place, mark)
            free = np.flatnonzero(self.slots[place] == 0)
            if len(free):
                self.slots[place, free[0]] = mark
                return True
        return False

    def delete(self, value: int) -> bool:
        mark, a, b = (int(x[0]) for x in self._places(np.array([value], np.uint64)))
        for place in (a, b):
            there = np.flatnonzero(self.slots[place] == mark)
            if len(there):
                self.slots[place, there[0]] = 0
                return True
        return False

    def contains(self, hashes: np.ndarray) -> np.ndarray:
        mark, a, b = self._places(hashes)
        return ((self.slots[a] == mark[:, None]) | (self.slots[b] == mark[:, None])).any(axis=1)

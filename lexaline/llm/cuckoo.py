"""A cuckoo filter over 64-bit hashes, in NumPy: bulk insertion, lookup and deletion."""

from __future__ import annotations

import numpy as np

SLOTS, KICKS = 4, 500


def _mix(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


class CuckooFilter:
    """Buckets of four 16-bit fingerprints, 0 for a free slot; keys are distinct 64-bit hashes.

    It never denies a key that it holds.  It doubles, from the keys that its owner's exact table has,
    when an insertion finds no room.
    """

    def __init__(self, buckets: int = 16, table: np.ndarray | None = None):
        self.buckets = buckets
        self.table = np.zeros((buckets, SLOTS), np.uint16) if table is None else table

    @classmethod
    def of(cls, keys: np.ndarray) -> CuckooFilter:
        buckets = 16
        while buckets * SLOTS * 0.85 < len(keys):
            buckets *= 2
        while True:
            made = cls(buckets)
            if made.insert(keys):
                return made
            buckets *= 2

    @classmethod
    def from_bytes(cls, blob: bytes) -> CuckooFilter:
        table = np.frombuffer(blob, np.uint16).reshape(-1, SLOTS).copy()
        return cls(len(table), table)

    def to_bytes(self) -> bytes:
        return self.table.tobytes()

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h = _mix(keys)
        mark = ((h >> np.uint64(48)) % np.uint64(65535) + np.uint64(1)).astype(np.uint16)
        first = (h & np.uint64(self.buckets - 1)).astype(np.int64)
        return mark, first, self._other(first, mark)

    def _other(self, bucket: np.ndarray, mark: np.ndarray) -> np.ndarray:
        return bucket ^ (_mix(mark) & np.uint64(self.buckets - 1)).astype(np.int64)

    def contains(self, keys: np.ndarray) -> np.ndarray:
        mark, a, b = self._places(keys)
        return (self.table[a] == mark[:, None]).any(1) | (self.table[b] == mark[:, None]).any(1)

    def _place(self, mark: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        """Put marks in free slots of their buckets; which of them found one."""
        order = np.argsort(bucket, kind="stable")
        b = bucket[order]
        rank = np.arange(len(b)) - np.searchsorted(b, b)
        free = self.table[b] == 0
        slot = np.cumsum(free, 1) == (rank + 1)[:, None]
        slot &= free
        fits = slot.any(1)
        self.table[b[fits], slot[fits].argmax(1)] = mark[order][fits]
        put = np.zeros(len(b), bool)
        put[order[fits]] = True
        return put

    def insert(self, keys: np.ndarray) -> bool:
        """Add distinct keys that are not held yet; False if there is no room, and then the filter is of no use."""
        mark, a, b = self._places(keys)
        left = ~self._place(mark, a)
        mark, at = mark[left], b[left]
        for turn in range(KICKS):
            left = ~self._place(mark, at)
            mark, at = mark[left], at[left]
            if not len(mark):
                return True
            # one mark for each full bucket turns another out, and that one goes to its other bucket
            at_once, first = np.unique(at, return_index=True)
            rest = np.setdiff1d(np.arange(len(at)), first)
            slot = (turn + at_once) % SLOTS
            out = self.table[at_once, slot].copy()
            self.table[at_once, slot] = mark[first]
            mark, at = np.concatenate((out, mark[rest])), np.concatenate((self._other(at_once, out), at[rest]))
        return False

    def delete(self, keys: np.ndarray) -> None:
        """Take out keys that are held."""
        for mark, a, b in zip(*self._places(keys), strict=True):
            for bucket in (a, b):
                slot = np.flatnonzero(self.table[bucket] == mark)
                if len(slot):
                    self.table[bucket, slot[0]] = 0
                    break

"""Minimal perfect hash over 128-bit keys: levels of collision-free bits plus ranks.

Every level is a bit array over the keys left; a key that alone hits its bit settles
there, the others go on.  A key's slot is the number of set bits before its own.  Stored
fingerprints turn away keys that were never put in.
"""

from __future__ import annotations

import io

import numpy as np

from .words import mix

LOAD = 2


def _place(h1: np.ndarray, h2: np.ndarray, level: int, size: int) -> np.ndarray:
    seed = np.uint64((0x9E3779B97F4A7C15 * (level + 1)) & ((1 << 64) - 1))
    return (mix(h1 ^ mix(h2 + seed)) % np.uint64(size)).astype(np.int64)


def _fingerprint(h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    return (mix(h2 ^ (h1 << np.uint64(1))) >> np.uint64(32)).astype(np.uint32)


class PerfectHash:
    """``slots(h1, h2)``: the slot of every key, -1 where the fingerprint differs."""

    def __init__(self, sizes: np.ndarray, bits: np.ndarray, prints: np.ndarray):
        self.sizes, self.bits, self.prints = sizes, bits, prints
        words = np.unpackbits(bits, bitorder="little").reshape(-1, 64).sum(axis=1)
        self.before = np.concatenate(([0], np.cumsum(words)))

    @classmethod
    def build(cls, h1: np.ndarray, h2: np.ndarray) -> PerfectHash:
        """Keys must differ from each other."""
        left = np.arange(len(h1))
        sizes, parts = [], []
        while len(left):
            size = -(-LOAD * len(left) // 64) * 64
            place = _place(h1[left], h2[left], len(sizes), size)
            hits = np.bincount(place, minlength=size)
            parts.append(hits == 1)
            sizes.append(size)
            left = left[hits[place] != 1]
            if len(sizes) > 200:
                raise ValueError("keys repeat")
        flags = np.concatenate(parts) if parts else np.zeros(0, bool)
        out = cls(np.array(sizes, np.int64), np.packbits(flags, bitorder="little"),
                  np.zeros(len(h1), np.uint32))
        out.prints[out._slots(h1, h2)] = _fingerprint(h1, h2)
        return out

    def _slots(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        slot = np.full(len(h1), -1, np.int64)
        left = np.arange(len(h1))
        base = 0
        for level, size in enumerate(self.sizes):
            at = base + _place(h1[left], h2[left], level, int(size))
            found = (self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
            mine, place = left[found], at[found]
            word = place >> 6
            inside = self.bits.reshape(-1, 8)[word].copy().view("<u8").ravel()
            below = inside & ((np.uint64(1) << (place & 63).astype(np.uint64)) - np.uint64(1))
            slot[mine] = self.before[word] + np.bitwise_count(below)
            left = left[~found]
            base += int(size)
        return slot

    def slots(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        slot = self._slots(h1, h2)
        known = slot >= 0
        known[known] = self.prints[slot[known]] == _fingerprint(h1[known], h2[known])
        return np.where(known, slot, -1)

    def dump(self, **columns: np.ndarray) -> bytes:
        out = io.BytesIO()
        np.savez(out, sizes=self.sizes, bits=self.bits, prints=self.prints, **columns)
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes) -> tuple[PerfectHash, dict[str, np.ndarray]]:
        with np.load(io.BytesIO(data)) as z:
            columns = {k: z[k] for k in z.files if k not in ("sizes", "bits", "prints")}
            return cls(z["sizes"], z["bits"], z["prints"]), columns

"""A minimal perfect hash over 32-byte digests, built and asked by numpy in whole arrays.

Levels of bit arrays, as published by Limasset, Rizk, Chikhi and Peterlongo (2017): at each level every key that is left
hashes to a bit; keys that are alone at theirs are placed, the others go on to the next level. A key's slot is the number of
set bits before its own, over all levels, so n keys have the slots 0 to n - 1. What is left after the last level is kept
as a sorted list.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

import numpy as np

#: Odd constants of a 64-bit finaliser (fixed values).
MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
STEP = 0x9E3779B97F4A7C15


def words(digests: np.ndarray | bytes) -> np.ndarray:
    """[n, 4] unsigned integers of n digests laid end to end; their order is that of the bytes."""
    return np.frombuffer(digests, ">u8").reshape(-1, 4).astype(np.uint64)


def mixed(keys: np.ndarray, level: int) -> np.ndarray:
    """A hash of all 256 bits of each key, another one at each level."""
    with np.errstate(over="ignore"):
        x = np.full(len(keys), np.uint64((level + 1) * STEP & (1 << 64) - 1))
        for c in range(4):
            x = (x ^ keys[:, c]) * np.uint64(MIX[0])
            x ^= x >> np.uint64(29)
        x *= np.uint64(MIX[1])
        return x ^ (x >> np.uint64(32))


@dataclass
class PerfectHash:
    """``levels``: the sizes in bits and the packed bit arrays; ``rest``: sorted keys that no level placed."""

    levels: list[tuple[int, np.ndarray]] = field(default_factory=list)
    rest: np.ndarray = field(default_factory=lambda: np.zeros((0, 4), np.uint64))

    @classmethod
    def of(cls, keys: np.ndarray, *, roomy: float = 2.0, most: int = 40) -> PerfectHash:
        """Over distinct keys [n, 4]; a level has ``roomy`` bits a key that is left, and there are at most ``most`` levels."""
        made = cls()
        for level in range(most):
            if not len(keys):
                break
            size = max(64, int(roomy * len(keys)))
            at = (mixed(keys, level) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            made.levels.append((size, np.packbits(alone, bitorder="little")))
            keys = keys[~alone[at]]
        if len(keys):
            made.rest = keys[np.lexsort(keys.T[::-1])]
        return made

    def __len__(self) -> int:
        return sum(int(np.unpackbits(b, count=n, bitorder="little").sum()) for n, b in self.levels) + len(self.rest)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, -1 for some of those that the hash was not built over; the others of these share slots with members."""
        out, left, first = np.full(len(keys), -1, np.int64), np.arange(len(keys)), 0
        for level, (size, packed) in enumerate(self.levels):
            bits = np.unpackbits(packed, count=size, bitorder="little")
            before = np.cumsum(bits, dtype=np.int64) - bits
            at = (mixed(keys[left], level) % np.uint64(size)).astype(np.int64)
            here = bits[at] == 1
            out[left[here]] = first + before[at[here]]
            left, first = left[~here], first + int(before[-1] + bits[-1])
        if len(self.rest) and len(left):
            place = {tuple(k): i for i, k in enumerate(self.rest.tolist())}
            for i in left:
                out[i] = first + place[k] if (k := tuple(keys[i].tolist())) in place else -1
        return out

    def dumps(self) -> bytes:
        parts = [struct.pack("<II", len(self.levels), len(self.rest))]
        parts += [struct.pack("<Q", n) + b.tobytes() for n, b in self.levels]
        return b"".join([*parts, self.rest.astype("<u8").tobytes()])

    @classmethod
    def loads(cls, data: bytes) -> PerfectHash:
        (n_levels, n_rest), at, made = struct.unpack_from("<II", data), 8, cls()
        for _ in range(n_levels):
            (size,) = struct.unpack_from("<Q", data, at)
            made.levels.append((size, np.frombuffer(data, np.uint8, -(-size // 8), at + 8)))
            at += 8 + -(-size // 8)
        made.rest = np.frombuffer(data, "<u8", 4 * n_rest, at).reshape(-1, 4)
        return made

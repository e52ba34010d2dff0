"""Minimal perfect hash of distinct 64-bit keys, level by level: at each level the keys that hash to a slot alone stay there, the others go on to the next; a key's number is the rank of its slot. About three to four bits a key."""

import numpy as np

from tidings.llm.kernels import mix

GAMMA = 1.6


def _slot(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    return (mix(keys + np.uint64((level + 1) * 0xD6E8FEB86659FD93 % 2**64)) % np.uint64(size)).astype(np.int64)


def fingerprint(keys: np.ndarray) -> np.ndarray:
    return (mix(keys ^ np.uint64(0xA5A5A5A5DEADBEEF)) >> np.uint64(32)).astype(np.uint32)


def build(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bits a level, packed bits of all levels) for distinct uint64 keys."""
    sizes, bits, left, level = [], [], keys, 0
    while len(left):
        size = int(GAMMA * len(left)) // 64 * 64 + 64
        slots = _slot(left, level, size)
        alone = np.bincount(slots, minlength=size) == 1
        sizes.append(size)
        bits.append(np.packbits(alone, bitorder="little"))
        left = left[~alone[slots]]
        level += 1
    return np.array(sizes, np.int64), np.concatenate(bits) if bits else np.zeros(0, np.uint8)


class Lookup:
    """Numbers of keys; a few steps a key. Keys that were not among those of build() get any number or -1: fingerprints tell."""

    def __init__(self, sizes: np.ndarray, bits: np.ndarray):
        self.sizes, self.base = sizes, np.concatenate([[0], np.cumsum(sizes)])
        self.on = np.unpackbits(bits, bitorder="little").astype(bool) if len(bits) else np.zeros(0, bool)
        self.rank = np.cumsum(self.on) - 1

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        out, open_ = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, size in enumerate(self.sizes.tolist()):
            if not len(open_):
                break
            at = self.base[level] + _slot(keys[open_], level, size)
            hit = self.on[at]
            out[open_[hit]] = self.rank[at[hit]]
            open_ = open_[~hit]
        return out

"""Hashes of words and runs of words, in numpy."""

from __future__ import annotations

import hashlib

import numpy as np
import xxhash

_B1, _B2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


class WordHashes(dict):
    """Hash of a word, remembered; forgets all when it grows past its bound."""

    BOUND = 1 << 17

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.BOUND:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(30))


def windows(h: np.ndarray, size: int, base: np.uint64 = _B1) -> np.ndarray:
    """Hash of each run of size consecutive word hashes (none if too few)."""
    n = len(h) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        out, have, block, width, power = None, 0, h, 1, base
        left = size
        while left:
            if left & 1:
                if out is None:
                    out, have = block, width
                else:  # out covers the first `have` words; append the block that follows
                    m = min(len(out), len(block) - have)
                    out, have = out[:m] * power + block[have : have + m], have + width
            left >>= 1
            if left:
                m = len(block) - width
                block, width, power = block[:m] * power + block[width : width + m], width * 2, power * power
        return mixed(out[:n])


def windows2(h: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    return windows(h, size, _B1), windows(mixed(h ^ _B2), size, _B2)


def shingle_set(words: list[bytes], k: int, memo: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of runs of k words; fewer words make one run."""
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < k:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=1)], np.uint64)
    return np.unique(windows(memo.of(words), k))


def set_id(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()

"""Language-model scoring with an Elias-Fano n-gram trie.

The model holds every word, and every pair and triple seen at least ``least``
times in the training documents, in tries sharded by context (``lmshards``).

A level is a monotone Elias-Fano sequence of word ids, each range of siblings
raised by the last value of the range before, so that a child is found by a
successor search relative to its context; pointers to children are Elias-Fano
too. Probabilities are interpolated with absolute discounting and quantised to 16
bits, rounded down, so that the probabilities of a context never add up to more
than one. Workers map a trie's file into memory. The last level of backing off is
the exact smoothed word distribution over all training words.

Defined results: a null or empty text is the end token alone; a null doc_id
hashes as empty text; repeated rows count and are scored each; without training
tokens every word has probability one; an empty table gives an empty result;
extra columns are ignored.
"""

from __future__ import annotations

import os
import tempfile

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod_col, small_batches

END = b""
DISCOUNT = 0.75
_ZERO_AT = np.full((256, 8), 8, np.int8)  # place of the r-th zero of a byte
_ONE_AT = np.full((256, 8), 8, np.int8)
for _b in range(256):
    for _k, _table in ((0, _ZERO_AT), (1, _ONE_AT)):
        _at = [i for i in range(8) if (_b >> i) & 1 == _k]
        _table[_b, : len(_at)] = _at
_ONES = np.array([bin(b).count("1") for b in range(256)], np.int64)


class EliasFano:
    """A monotone sequence in about 2 + log2(universe / n) bits a value. Queries
    take arrays. high: unary buckets, one byte of the bit vector a step; ones:
    ones before each byte of it."""

    def __init__(self, low: np.ndarray, high: np.ndarray, ones: np.ndarray, shift: int, n: int):
        self.low, self.high, self.ones, self.shift, self.n = low, high, ones, shift, n
        self.zeros = None

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.int64)
        n = len(values)
        top = int(values[-1]) if n else 0
        shift = 16 if top >> 16 >= n else 8 if top >> 8 >= n or n == 0 else 0
        while top >> shift > 8 * max(n, 1) + 64:
            shift += 8
        low = (values & ((1 << shift) - 1)).astype(np.uint8 if shift <= 8 else np.uint16 if shift <= 16 else np.uint32)
        bits = np.zeros(n + (top >> shift) + 2, np.uint8)
        bits[(values >> shift) + np.arange(n)] = 1
        high = np.packbits(bits, bitorder="little")
        ones = np.concatenate([[0], np.cumsum(_ONES[high])]).astype(np.uint32)
        return cls(low, high, ones, shift, n)

    def parts(self) -> list[np.ndarray]:
        return [np.array([self.shift, self.n], np.int64), self.low, self.high, self.ones]

    def access(self, i: np.ndarray) -> np.ndarray:
        byte = np.searchsorted(self.ones, i, "right") - 1
        at = byte * 8 + _ONE_AT[self.high[byte], i - self.ones[byte]]
        return (at - i << self.shift) | self.low[i]

    def _bucket(self, h: np.ndarray) -> np.ndarray:
        """Number of values whose high part is under h."""
        if self.zeros is None:
            self.zeros = np.arange(len(self.ones), dtype=np.int64) * 8 - self.ones
        j = h - 1  # the zero that ends bucket h - 1
        last = self.zeros[-1]
        inside = np.clip(j, 0, last - 1)
        byte = np.searchsorted(self.zeros, inside, "right") - 1
        at = byte * 8 + _ZERO_AT[self.high[byte], inside - self.zeros[byte]]
        return np.where(j < 0, 0, np.where(j >= last, self.n, np.minimum(at - inside, self.n)))

    def find(self, x: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Index of x among the values lo..hi, or -1: the successor of x, if it equals x."""
        h = x >> self.shift
        a, b = np.maximum(self._bucket(h), lo), np.minimum(self._bucket(h + 1), hi)
        want = x & ((1 << self.shift) - 1)
        low = self.low if self.n else np.zeros(1, np.uint8)
        top = max(0, self.n - 1)
        while (b - a > 1).any():
            mid = (a + b) >> 1
            right = (low[np.minimum(mid, top)] <= want) & (b - a > 1)
            a, b = np.where(right, mid, a), np.where(right | (b - a <= 1), b, mid)
        hit = (a < b) & (low[np.minimum(a, top)] == want)
        return np.where(hit, a, -1)


class Level:
    """Children of one level: values, pointers from the level above, codes."""

    def __init__(self, values: EliasFano, pointers: EliasFano, prob: np.ndarray, back: np.ndarray):
        self.values, self.pointers, self.prob, self.back = values, pointers, prob, back
        self.plain = None

    @classmethod
    def of(cls, parent: np.ndarray, word: np.ndarray, parents: int, prob: np.ndarray, back: np.ndarray) -> Level:
        """Rows sorted by (parent, word)."""
        ptr = np.searchsorted(parent, np.arange(parents + 1))
        last = np.flatnonzero(np.append(parent[1:] != parent[:-1], True)) if len(parent) else np.empty(0, int)
        steps = word[last] + 1
        base = np.concatenate([[0], np.cumsum(steps)])[:-1] if len(last) else steps
        group = np.cumsum(np.append(False, parent[1:] != parent[:-1])) if len(parent) else np.empty(0, int)
        return cls(EliasFano.of(word + base[group] + 0 if len(parent) else word), EliasFano.of(ptr), prob, back)

    def ranges(self, parent: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First child, end and what the children's values were raised by."""
        lo, hi = self.pointers.access(parent), self.pointers.access(parent + 1)
        return lo, hi, np.where(lo > 0, self.values.access(np.maximum(lo - 1, 0)) + 1, 0) if self.values.n else lo

    def decode(self) -> None:
        """Keeps the ranges of all parents as plain numbers: for a level with few of them."""
        self.plain = self.ranges(np.arange(self.pointers.n - 1))

    def find(self, parent: np.ndarray, word: np.ndarray) -> np.ndarray:
        lo, hi, base = (x[parent] for x in self.plain) if self.plain else self.ranges(parent)
        out, some = np.full(len(parent), -1), np.flatnonzero(lo < hi)
        out[some] = self.values.find(word[some] + base[some], lo[some], hi[some])
        return out


SCALE = 4096.0  # codes a power of ten


def coded(p: np.ndarray) -> np.ndarray:
    """log10 of probabilities as 16-bit codes, rounded down."""
    return np.clip(np.ceil(-np.log10(np.maximum(p, 1e-15)) * SCALE - 1e-9), 0, 65535).astype(np.uint16)


def decoded(code: np.ndarray) -> np.ndarray:
    return code.astype(float) / -SCALE


class Trie:
    """Pairs and triples over ids 0..M-1."""

    def __init__(self, words: int, levels: list[Level], back1: np.ndarray):
        self.words, self.levels, self.back1 = words, levels, back1

    def to_bytes(self) -> bytes:
        parts = [np.array([self.words, len(self.levels)], np.int64), self.back1]
        for v in self.levels:
            parts += [*v.values.parts(), *v.pointers.parts(), v.prob, v.back]
        head = np.array([x for p in parts for x in ("iuf".index(p.dtype.kind) * 16 + p.dtype.itemsize, len(p))], np.int64)
        out = np.array([len(parts)], np.int64).tobytes() + head.tobytes()
        for p in parts:
            out += p.tobytes() + bytes(-p.nbytes % 8)
        return out

    @classmethod
    def from_buffer(cls, raw: np.ndarray) -> Trie:
        n = int(raw[:8].view(np.int64)[0])
        head = raw[8 : 8 + 16 * n].view(np.int64).reshape(n, 2)
        at, parts = 8 + 16 * n, []
        for kind, size in head.tolist():
            dtype = np.dtype(f"{'iuf'[kind // 16]}{kind % 16}")
            parts.append(raw[at : at + size * dtype.itemsize].view(dtype))
            at += size * dtype.itemsize + -(size * dtype.itemsize) % 8
        words, levels = parts[0].tolist()
        it = iter(parts[1:])
        back1 = next(it)

        def sequence() -> EliasFano:
            shift, length = next(it).tolist()
            return EliasFano(next(it), next(it), next(it), shift, length)

        return cls(words, [Level(sequence(), sequence(), next(it), next(it)) for _ in range(levels)], back1)

    @classmethod
    def mapped(cls, blob: bytes) -> Trie:
        """Over a memory-mapped file, whose name is given up at once."""
        fd, path = tempfile.mkstemp(prefix="trie")
        with os.fdopen(fd, "wb") as f:
            f.write(blob)
        raw = np.memmap(path, np.uint8, "r")
        os.unlink(path)
        return cls.from_buffer(raw)

    def pairs(self, u: np.ndarray, w: np.ndarray, log1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in the pair level or -1, log10 P(w | u)); u may be -1 (no context),
        w may be -1 (outside the vocabulary, its log1 is 0 and is added later)."""
        at, out = np.full(len(w), -1), log1.copy()
        told = np.flatnonzero(u >= 0)
        out[told] += decoded(self.back1[u[told]])
        both = told[w[told] >= 0]
        found = self.levels[0].find(u[both], w[both])
        hit = found >= 0
        both, found = both[hit], found[hit]
        at[both], out[both] = found, decoded(self.levels[0].prob[found])
        return at, out

    def given(self, ctx: np.ndarray, w: np.ndarray, p2: np.ndarray) -> np.ndarray:
        """log10 P(w | pair), where ctx is the pair's place or -1, from log10 P(w | u)."""
        out = p2.copy()
        has = np.flatnonzero(ctx >= 0)
        out[has] += decoded(self.levels[0].back[ctx[has]])
        known = has[w[has] >= 0]
        found = self.levels[1].find(ctx[known], w[known])
        hit = found >= 0
        out[known[hit]] = decoded(self.levels[1].prob[found[hit]])
        return out


def tokens(text: str | None) -> list[bytes]:
    w = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    w.append(END)
    return w


def _place(keys: np.ndarray, x: np.ndarray) -> np.ndarray:
    if not len(keys):
        return np.full(len(x), -1)
    at = np.minimum(np.searchsorted(keys, x), len(keys) - 1)
    return np.where(keys[at] == x, at, -1)


def build_trie(counts: np.ndarray, mass: float, m: int, pairs: tuple[np.ndarray, np.ndarray], triples: tuple[np.ndarray, np.ndarray]) -> Trie:
    """counts: of the ids, as contexts; the begin counts as often as the end."""
    p1 = (counts[: m - 1] + 0.1) / mass
    u, w = pairs[0] // m, pairs[0] % m
    share = (pairs[1] - DISCOUNT) / counts[u] if len(u) else np.empty(0)
    back1 = coded(1 - np.bincount(u, share, minlength=m)) if len(u) else np.zeros(m, np.uint16)
    low = 10 ** decoded(back1)
    p2 = share + low[u] * p1[w]
    at, x = triples[0] // m, triples[0] % m
    share3 = (triples[1] - DISCOUNT) / pairs[1][at] if len(at) else np.empty(0)
    back2 = coded(1 - np.bincount(at, share3, minlength=len(u))) if len(at) else np.zeros(len(u), np.uint16)
    first = Level.of(u, w, m, coded(p2), back2)
    under = _place(pairs[0], w[at] * m + x) if len(at) else at
    p3 = share3 + 10 ** decoded(back2[at]) * 10 ** decoded(first.prob[under]) if len(at) else share3
    return Trie(m, [first, Level.of(at, x, len(u), coded(p3), np.zeros(0, np.uint16))], back1)


def lm_scores(docs: DataFrame, held_of: int = 10, least: int = 2) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), a row for each row of docs."""
    from .lmshards import whole_scores

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    small_batches(docs.sparkSession)
    return whole_scores(docs.withColumn("held_out", crc_mod_col(F.col("doc_id"), held_of) == 0), least)

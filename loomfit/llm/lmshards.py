"""The whole n-gram model in tries sharded by context.

Documents are dealt into spans by hash, and a span's texts are read once: its tokens
then travel as one row. A span asks for each of its distinct words once and gets an id and the count over all training documents; then it asks
for each of its distinct triples (t, u, w) once, with its own training count. All
triples around a context word u go to one shard, which holds all that a score
after u needs: it sums the counts, builds its trie of every pair and triple seen
at least ``least`` times, and answers with the codes a and b of
P(w | t, u) = a + b P(w). So there is no bound on words or n-grams, and neither
the driver nor a broadcast holds any of the model. Words are told apart by 64-bit
hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import parallelism, written
from .lm import Trie, _place, build_trie, tokens
from .shingles import WordHashes, mixed

BEGIN, NONE = 2**32 - 1, 2**32 - 2  # ids of the begin, and of nothing before it
NO_ID = -(2**63)  # stands for a null doc_id inside a span's row
SPAN = 1 << 24  # characters a span
MISS = 65535  # code of a where the trie has neither triple nor pair
ASK = "span int, shard int, n long, a binary, b binary, c binary, counts binary"
TOLD = "span int, shard int, kind int, a binary, b binary, total long, known long"
HELD = "doc_ids binary, held binary, sizes binary"


def squeezed(x: np.ndarray) -> bytes:
    """Whole numbers as compressed planes of bytes: high bytes and runs take little room."""
    planes = np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.dtype.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def stretched(blob: bytes, dtype: str) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    return np.ascontiguousarray(planes.reshape(np.dtype(dtype).itemsize, -1).T).view(dtype).ravel()


class _Span:
    """A span's distinct words (hashes), and for each token the place of its word."""

    def __init__(self, words: np.ndarray, w: np.ndarray, sizes: np.ndarray, held: np.ndarray):
        self.words, self.w, self.sizes, self.held = words, w, sizes, held
        self.first = np.cumsum(sizes) - sizes

    @classmethod
    def of_texts(cls, table: pa.Table) -> _Span:
        memo, hashes, sizes = WordHashes(), [], []
        for batch in table.to_batches(max_chunksize=512):
            for text in batch.column("text").to_pylist():
                h = memo.of(tokens(text))
                hashes.append(h)
                sizes.append(len(h))
        words, w, n = np.unique(np.concatenate(hashes), return_inverse=True, return_counts=True)
        order = np.argsort(-n, kind="stable")  # frequent words get small places
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        return cls(words[order], place[w], np.array(sizes, np.int64), table.column("held_out").to_numpy(zero_copy_only=False))

    @classmethod
    def of_row(cls, table: pa.Table) -> _Span:
        """From the one row that `_take_in` made."""
        of = lambda c, t: np.frombuffer(table.column(c)[0].as_py(), t)
        w = stretched(table.column("b")[0].as_py(), "<u4").astype(np.int64)
        return cls(of("a", "<u8"), w, of("sizes", "<i8"), of("held", "?"))

    def trained(self) -> np.ndarray:
        return np.repeat(~self.held, self.sizes).astype(float)

    def word_shard(self, shards: int) -> np.ndarray:
        return (mixed(self.words) % np.uint64(shards)).astype(np.int64)

    def triples(self, ids: np.ndarray, shards: int) -> None:
        """Sets ask (t, u, w, shard: ids of distinct triples, by shard) and at: where each token's triple is."""
        n = len(self.words)
        u = np.append(n, self.w[:-1])
        u[self.first] = n
        t = np.append(n + 1, u[:-1])
        t[self.first] = n + 1
        k = n + 2
        both, at = (None, u * k + t) if k < 1 << 21 else np.unique(u * k + t, return_inverse=True)
        keys, at = np.unique(at * k + self.w, return_inverse=True)
        pair, w = keys // k, keys % k
        pair = pair if both is None else both[pair]
        ids = np.append(ids, [BEGIN, NONE])
        u = ids[pair // k]
        shard = u % shards
        order = np.argsort(shard, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.ask, self.at = (ids[pair % k][order], u[order], ids[w][order], shard[order]), place[at]


def _runs(shard: np.ndarray):
    """(shard, from, to) of a sorted array's runs."""
    held, lo = np.unique(shard, return_index=True)
    return zip(held.tolist(), lo.tolist(), [*lo[1:].tolist(), len(shard)])


def _asked(span: int, shard: np.ndarray, columns: list[np.ndarray], counts: np.ndarray) -> pa.Table:
    rows = [(span, s, hi - lo, *[squeezed(c[lo:hi]) for c in columns], *[b""] * (3 - len(columns)), squeezed(counts[lo:hi].astype("<u4"))) for s, lo, hi in _runs(shard)]
    types = [pa.int32(), pa.int32(), pa.int64(), *[pa.binary()] * 4]
    return pa.Table.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows), types)], ["span", "shard", "n", "a", "b", "c", "counts"])


def _take_in(shards: int):
    """Reads a span's texts, once: a row (shard -1) that holds its tokens, and its words for each shard."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        span = _Span.of_texts(table)
        shard = span.word_shard(shards)
        order = np.argsort(shard, kind="stable")
        counts = np.bincount(span.w, span.trained(), len(span.words))
        asked = _asked(key[0].as_py(), shard[order], [span.words[order]], counts[order])
        for name in ("doc_ids", "held", "sizes"):
            asked = asked.append_column(name, pa.nulls(len(asked), pa.binary()))
        ids = table.column("doc_id").combine_chunks()
        ids = ids.fill_null(NO_ID).to_numpy()
        own = (key[0].as_py(), -1, len(span.w), span.words.tobytes(), squeezed(span.w.astype("<u4")), None, None, ids.tobytes(), span.held.tobytes(), span.sizes.tobytes())
        return pa.concat_tables([pa.Table.from_arrays([pa.array([v], t) for v, t in zip(own, asked.schema.types)], schema=asked.schema), asked])

    return run


def _joined(table: pa.Table, name: str, dtype: str) -> np.ndarray:
    return np.concatenate([np.empty(0, dtype), *(stretched(x, dtype) for x in table.column(name).to_pylist())])


def _told(table: pa.Table, kind: int, shard: int, a: np.ndarray, b: np.ndarray, total: int = 0, known: int = 0) -> pa.Table:
    """Answers to every row of table; the sums stand in the first."""
    ends = np.cumsum(table.column("n").to_numpy())
    cut = lambda x: pa.array([squeezed(x[lo:hi]) for lo, hi in zip([0, *ends[:-1].tolist()], ends.tolist())], pa.binary())
    n = len(ends)
    once = lambda x: pa.array([x] + [0] * (n - 1), pa.int64())
    same = lambda x: pa.array([x] * n, pa.int32())
    return pa.Table.from_arrays([table.column("span").combine_chunks(), same(shard), same(kind), cut(a), cut(b), once(total), once(known)], ["span", "shard", "kind", "a", "b", "total", "known"])


def _tell_words(shards: int):
    """Ids, which name the shard of the word too, and counts."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        shard = key[0].as_py()
        words, at = np.unique(_joined(table, "a", "<u8"), return_inverse=True)
        counts = np.bincount(at, _joined(table, "counts", "<u4"), len(words)).astype(np.int64)
        if len(words) * shards >= NONE:
            raise ValueError("more distinct words than ids")
        return _told(table, 1, shard, (at * shards + shard).astype("<u4"), counts[at].astype("<u4"), int(counts.sum()), int((counts > 0).sum()))

    return run


def _take_words(span: _Span, told: pa.Table, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, counts) of the span's words."""
    told = told.sort_by("shard")
    order = np.argsort(span.word_shard(shards), kind="stable")
    ids, counts = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
    ids[order], counts[order] = _joined(told, "a", "<u4"), _joined(told, "b", "<u4")
    return ids, counts


def _ask_triples(shards: int):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table, told: pa.Table) -> pa.Table:
        span = _Span.of_row(table)
        span.triples(_take_words(span, told, shards)[0], shards)
        t, u, w, shard = span.ask
        counts = np.bincount(span.at, span.trained(), len(u))
        return _asked(key[0].as_py(), shard, [x.astype("<u4") for x in (t, u, w)], counts)

    return run


def _summed(keys: np.ndarray, c: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    keys, at = np.unique(keys, return_inverse=True)
    c = np.bincount(at, c, len(keys)).astype(np.int64)
    return keys[c >= least], c[c >= least]


def shard_trie(t: np.ndarray, u: np.ndarray, w: np.ndarray, c: np.ndarray, k: int, none: int, least: int) -> Trie:
    """Of all triples around the contexts u; ids under k. Its codes leave P(w) out."""
    own = np.bincount(u, c, k)
    some, before = c > 0, (c > 0) & (t != none)
    keys, counts = zip(_summed(u[some] * k + w[some], c[some], least), _summed(t[before] * k + u[before], c[before], least))
    pairs, at = np.unique(np.concatenate(keys), return_index=True)
    sums = np.concatenate(counts)[at]
    place = _place(pairs, t[before] * k + u[before])
    ok = place >= 0
    triples = _summed(place[ok] * k + w[before][ok], c[before][ok], least)
    return build_trie(np.where(own > 0, own, 1e30), np.inf, k, (pairs, sums), triples)


def _tell_triples(least: int):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        asked = [_joined(table, x, "<u4") for x in "abc"]
        ids, at = np.unique(np.concatenate([*asked, np.array([BEGIN, NONE], "<u4")]), return_inverse=True)
        none, k = int(np.searchsorted(ids, NONE)), len(ids) + 1
        n = len(asked[0])
        t, u, w = at[:n], at[n : 2 * n], at[2 * n : 3 * n]
        trie = Trie.mapped(shard_trie(t, u, w, _joined(table, "counts", "<u4").astype(np.int64), k, none, least).to_bytes())
        a, b = np.empty(n, "<u2"), np.empty(n, "<u2")
        for lo in range(0, n, 1 << 18):
            s = slice(lo, lo + (1 << 18))
            ctx = np.full(len(t[s]), -1)
            inside = np.flatnonzero(t[s] != none)
            ctx[inside] = trie.levels[0].find(t[s][inside], u[s][inside])
            _, p2 = trie.pairs(u[s], w[s], np.full(len(ctx), -np.inf))
            a[s] = np.clip(np.rint(trie.given(ctx, w[s], p2) * -4096), 0, MISS)
            back = np.zeros(len(ctx), np.int64)
            back[ctx >= 0] = trie.levels[0].back[ctx[ctx >= 0]]
            b[s] = np.minimum(back + trie.back1[u[s]], MISS)
        return _told(table, 2, key[0].as_py(), a, b)

    return run


def _score(shards: int, mass: float):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table, told: pa.Table) -> pa.Table:
        span = _Span.of_row(table)
        kind = told.column("kind").to_numpy()
        ids, counts = _take_words(span, told.filter(pa.array(kind == 1)), shards)
        span.triples(ids, shards)
        codes = told.filter(pa.array(kind == 2)).sort_by("shard")
        a, b = _joined(codes, "a", "<u2")[span.at], _joined(codes, "b", "<u2")[span.at]
        p1 = ((counts + 0.1) / mass)[span.w]
        p = np.where(a < MISS, 10 ** (a / -4096.0), 0) + 10 ** (b / -4096.0) * p1
        add = lambda x: pa.array(np.add.reduceat(x, span.first))
        ids = np.frombuffer(table.column("doc_ids")[0].as_py(), "<i8")
        return pa.Table.from_arrays([pa.array(ids, mask=ids == NO_ID), pa.array(span.held), pa.array(span.sizes), add((counts > 0).astype(np.int64)[span.w]), add(np.log10(p1)), add(np.log10(p))], ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    return run


def whole_scores(docs: DataFrame, least: int) -> DataFrame:
    """docs(doc_id, text, held_out): the columns of lm_scores."""
    shards = parallelism(docs.sparkSession)
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    spans = max(shards, -(-chars // SPAN))
    docs = docs.withColumn("span", F.pmod(F.xxhash64("doc_id", "text"), F.lit(spans)).cast("int"))
    # texts are read and shuffled once; later steps take each span's tokens from its row
    taken = written(docs.groupBy("span").applyInArrow(_take_in(shards), f"{ASK}, {HELD}").withColumn("own", F.col("shard") < 0), "spans", "own")
    own, asked = taken.where("own").drop("own"), taken.where("not own").select("span", "shard", "n", "a", "counts")
    words = written(asked.groupBy("shard").applyInArrow(_tell_words(shards), TOLD), "words")
    sums = words.agg(F.sum("total"), F.sum("known")).first()
    total, known = int(sums[0] or 0), int(sums[1] or 0)
    asked = own.groupBy("span").cogroup(words.groupBy("span")).applyInArrow(_ask_triples(shards), ASK)
    told = words.union(written(asked.groupBy("shard").applyInArrow(_tell_triples(least), TOLD), "triples"))
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    out = own.groupBy("span").cogroup(told.groupBy("span")).applyInArrow(_score(shards, total + 0.1 * (known + 1)), schema)
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")

"""Byte-level BPE encoding and decoding with Spark higher-order functions.

The rank file becomes one literal: an array of small maps, addressed by crc32 of
a piece, so that a look-up costs the same for any vocabulary. A word is a string
of hex pieces ``<48><65>``; ``aggregate`` folds merges over it, each step joining
every occurrence, left to right, of the pair of least rank. (A merged piece ranks
above its parts, so this gives the same pieces as joining one pair at a time.)
Decoding concatenates the binary pieces of the ids.

The fold costs about half a millisecond a word, so it is run on the ``dictionary``
most frequent distinct words of all documents only (at most 48 bytes each, so the
table sent to the workers has a fixed bound). Whole texts are then encoded in
Arrow batches: words of the dictionary are looked up, any other word is merged
where it stands by the same ranks. The dictionary never changes a result.
``Bpe.encode`` and ``Bpe.decode`` are the same as column expressions throughout.

Defined results: a null or empty text has no ids and decodes to no bytes; every
row is encoded by itself, so null or repeated doc_ids, ties and extra columns do
not matter; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import heapq
import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lean, small_batches, top_levels, written

#: Java spells the public pattern's \s (any Unicode white space) as a property.
_WS = r"\p{IsWhite_Space}"


def java_pattern(pattern: str) -> str:
    return pattern.replace(r"[^\s", "[^" + _WS).replace(r"(?!\S)", r"(?!\P{IsWhite_Space})").replace(r"\s", _WS)


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def _bucketed(entries: dict[str, int]) -> list[dict[str, int]]:
    n = 1 << max(4, len(entries).bit_length() - 2)
    maps: list[dict] = [{} for _ in range(n)]
    for k, v in entries.items():
        maps[zlib.crc32(k.encode()) % n][k] = v
    return maps


def _look(table: tuple[Column, int], key: Column) -> Column:
    lit, n = table
    return F.element_at(F.get(lit, (F.crc32(key.cast("binary")) % n).cast("int")), key)


def _let(value: Column, body) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


class Bpe:
    """Column expressions for one rank file."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.pattern = java_pattern(pattern)
        self.maps = _bucketed({k.hex().upper(): v for k, v in ranks.items()})
        by_id = [""] * (max(ranks.values()) + 1)
        for k, v in ranks.items():
            by_id[v] = k.hex()
        self.pieces = " ".join(by_id)

    def words(self, text: Column) -> Column:
        return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(self.pattern), 0)

    @staticmethod
    def _parts(state: Column) -> Column:
        return F.split(F.substring(state, 2, F.length(state) - 2), "><")

    def fold(self, word: Column) -> Column:
        """ids of one match of the pattern. The rank map stands in the plan once."""
        table = F.from_json(F.lit(json.dumps(self.maps, separators=(",", ":"))), "array<map<string,int>>")
        return _let(table, lambda t: self._fold(word, (t, len(self.maps))))

    def _fold(self, word: Column, ranks: tuple[Column, int]) -> Column:
        whole = F.hex(word.cast("binary"))

        def merge(acc: Column, _: Column) -> Column:
            def least(p: Column) -> Column:
                ranked = F.transform(F.slice(p, 1, F.size(p) - 1), lambda x, i: F.struct(_look(ranks, F.concat(x, F.get(p, i + 1))).alias("r"), x.alias("x"), F.get(p, i + 1).alias("y")))
                return F.array_min(F.filter(ranked, lambda t: t["r"].isNotNull()))

            def joined(m: Column) -> Column:
                new = F.replace(acc["s"], F.concat(F.lit("<"), m["x"], F.lit("><"), m["y"], F.lit(">")), F.concat(F.lit("<"), m["x"], m["y"], F.lit(">")))
                return F.struct(F.coalesce(new, acc["s"]).alias("s"), m.isNotNull().alias("more"))

            return F.when(acc["more"], _let(_let(self._parts(acc["s"]), least), joined)).otherwise(acc)

        start = F.struct(F.regexp_replace(whole, "(..)", "<$1>").alias("s"), (F.length(whole) > 2).alias("more"))
        steps = F.sequence(F.lit(1), F.greatest(F.length(whole) / 2 - 1, F.lit(1)).cast("int"))
        folded = F.aggregate(steps, start, merge, lambda acc: F.transform(self._parts(acc["s"]), lambda p: _look(ranks, p)))
        known = _look(ranks, whole)
        return F.when(known.isNotNull(), F.array(known)).otherwise(folded)

    def encode(self, text: Column) -> Column:
        return F.flatten(F.transform(self.words(text), self.fold))

    def decode(self, ids: Column) -> Column:
        pieces = F.split(F.lit(self.pieces), " ")
        return F.unhex(F.array_join(F.transform(ids, lambda i: F.get(pieces, i)), ""))

    def dictionary(self, docs: DataFrame, most: int, longest: int = 48) -> dict[str, list[int]]:
        """The most frequent distinct words of all documents (whole levels of equal
        counts, from the top) and their ids."""
        word = docs.select(F.explode(self.words(F.col("text"))).alias("word"))
        counts = word.groupBy("word").count().where((F.col("count") > 1) & (F.length(F.col("word").cast("binary")) <= longest) & (F.length("word") > 1))
        top = top_levels(written(counts, "words"), "count", most)
        # here the rank map is a literal table of one row, as a literal in the plan would be
        # copied into every description that the driver keeps; its size is the rank file's
        spark = docs.sparkSession
        literal = spark.createDataFrame([(1, self.maps)], "one int, ranks array<map<string,int>>")
        dealt = top.repartition(4 * spark.sparkContext.defaultParallelism).withColumn("one", F.lit(1)).join(F.broadcast(literal), "one")
        rows = dealt.select("word", self._fold(F.col("word"), (F.col("ranks"), len(self.maps))).alias("ids")).collect()
        return {r["word"]: r["ids"] for r in rows}


def merge_word(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """ids of one match of the pattern: pairs of least rank are joined first,
    leftmost first; a heap keeps long words from growing quadratic."""
    known = ranks.get(word)
    if known is not None:
        return [known]
    n = len(word)
    if n <= 24:
        return _merge_short(word, ranks)
    end = list(range(1, n + 1))  # a part is word[i:end[i]]; end[i] = 0: joined into its left
    left = list(range(-1, n - 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)

    def offer(i: int) -> None:
        if end[i] < n and (r := ranks.get(word[i : end[end[i]]])) is not None:
            heapq.heappush(heap, (r, i, end[end[i]]))

    while heap:
        _, i, stop = heapq.heappop(heap)
        if not end[i] or end[i] >= stop or end[end[i]] != stop:
            continue
        j = end[i]
        end[i], end[j] = stop, 0
        if stop < n:
            left[stop] = i
        offer(i)
        if left[i] >= 0:
            offer(left[i])
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : end[i]]])
        i = end[i]
    return out


def _merge_short(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    get, none = ranks.get, 1 << 40
    parts = [word[i : i + 1] for i in range(len(word))]
    pairs = [get(word[i : i + 2], none) for i in range(len(word) - 1)]
    while pairs and (least := min(pairs)) < none:
        i = pairs.index(least)
        new = parts[i] = parts[i] + parts.pop(i + 1)
        del pairs[i]
        if i < len(pairs):
            pairs[i] = get(new + parts[i + 1], none)
        if i:
            pairs[i - 1] = get(parts[i - 1] + new, none)
    return [ranks[p] for p in parts]


def packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}i", *ids)


#: Code points of a text from which its matches are taken one by one.
LONG = 1 << 16


class _Memo(dict):
    """Packed ids of words, in two generations: when the young one is full it becomes
    the old one, and words in use come back from there."""

    BOUND = 1 << 17
    _known: tuple[int, _Memo] | None = None

    def __init__(self, ranks, dictionary):
        super().__init__()
        self.ranks, self.kept, self.old = ranks, dictionary, {}

    @classmethod
    def of_worker(cls, ranks, dictionary) -> _Memo:
        """The memo that this process has for these ranks from tasks before, or a new one."""
        mark = hash(frozenset(ranks.items()))
        if cls._known is None or cls._known[0] != mark:
            cls._known = mark, cls(ranks, dictionary)
        return cls._known[1]

    def __missing__(self, word: str) -> bytes:
        if len(self) >= self.BOUND:
            self.old = None
            self.old = dict(self)
            self.clear()
        ids = self.old.get(word) or self.kept.get(word)
        if ids is None:
            ids = packed(merge_word(word.encode("utf-8", "surrogatepass"), self.ranks))
        self[word] = ids
        return ids


def joined(pieces: pa.Array, ids: pa.Array, ends: np.ndarray) -> pa.Array:
    """Decoded bytes of lists of ids that end at the given places: taken pieces lie
    one after the other in one buffer, which is cut at the ends of the lists."""
    if not len(ids):
        return pa.array([b""] * (len(ends) - 1), pa.binary())
    _, offsets, data = pieces.take(ids).buffers()
    cuts = np.frombuffer(offsets, "<i4", len(ids) + 1)[ends]
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(cuts), data])


def _encoder(ranks: dict[bytes, int], pattern: str, dictionary: dict[str, list[int]], rows: int = 512):
    # the regex module's own \s may differ from Unicode White_Space
    spelt = pattern.replace(r"(?!\S)", r"(?!\P{White_Space})").replace(r"\s", r"\p{White_Space}")
    kept = {w: packed(ids) for w, ids in dictionary.items()}

    def code(text: str, memo: _Memo, find: regex.Pattern) -> bytes:
        # the matches of a long text are never all held at once
        found = find.findall(text) if len(text) <= LONG else (m.group() for m in find.finditer(text))
        return b"".join(map(memo.__getitem__, found))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, find = _Memo.of_worker(ranks, kept), regex.compile(spelt)
        by_id = [b""] * (max(ranks.values(), default=0) + 1)
        for k, v in ranks.items():
            by_id[v] = k
        pieces = pa.array(by_id, pa.binary())
        for whole in batches:
            for lo in range(0, whole.num_rows, rows):
                b = whole.slice(lo, rows)
                codes = [code(t, memo, find) if t else b"" for t in b.column("text").to_pylist()]
                ends = np.cumsum([0, *(len(c) // 4 for c in codes)], dtype=np.int32)
                flat = pa.array(np.frombuffer(b"".join(codes), "<i4"))
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.ListArray.from_arrays(pa.array(ends), flat), joined(pieces, flat, ends)], ["doc_id", "ids", "decoded"])

    return run


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, dictionary: int = 1 << 14) -> DataFrame:
    """(doc_id, ids, decoded binary), a row for each row of docs."""
    ranks = load_ranks(ranks_path)
    bpe = Bpe(ranks, pattern)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    small_batches(docs.sparkSession)
    known = bpe.dictionary(docs, dictionary) if dictionary else {}
    return docs.mapInArrow(lean(_encoder(ranks, pattern, known)), "doc_id long, ids array<int>, decoded binary")

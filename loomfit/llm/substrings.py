"""Substring dedup over difference-cover anchors.

A window is ``size`` consecutive words. Runs of ``ANCHOR`` words are hashed only
at positions whose residue modulo ``PERIOD`` lies in a difference cover, so two
equal windows, whatever their positions, share an anchor at one same offset
below PERIOD. Anchors that two different texts hold mark where windows can
repeat; from those anchors the match is extended to whole windows, which alone
are hashed (128 bits) and settled by their smallest doc_id. No pairs are made:
a passage in any number of documents costs one aggregated row a task, and is
joined back by hash and share of the documents, so its rows meet in no one task.

Whole copies are settled by the hash of the text: each loses all its windows to
the smallest doc_id of its class.

Defined results: a null or empty text has no words; a null doc_id loses and
takes nothing; repeated rows of one doc_id are judged alike and never against
each other; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import words, written
from .shingles import WordHashes, windows, windows2

#: Shares of the documents by hash; as many as a long has bits.
SHARES = 64
PERIOD, COVER = 31, (1, 5, 11, 24, 25, 27)
_IN_COVER = np.isin(np.arange(PERIOD), COVER)


def anchors(h: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the anchors of a text's word hashes."""
    a = windows(h, size - PERIOD + 1)
    at = np.flatnonzero(_IN_COVER[np.arange(len(a)) % PERIOD])
    return at, a[at].view(np.int64)


def _ids(n: list[int]) -> np.ndarray:
    return np.repeat(np.arange(len(n)), n)


def _emit_anchors(size: int, positions: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHashes()
        for b in batches:
            ats, hs, n = [], [], []
            for text in b.column("text").to_pylist():
                w = words(text)
                at, h = anchors(memo.of(w), size) if len(w) >= size else (np.empty(0, int), np.empty(0, np.int64))
                ats.append(at)
                hs.append(h)
                n.append(len(at))
            if not n:
                continue
            of = pa.array(_ids(n))
            cols = [pa.array(np.concatenate(hs), pa.int64()), b.column("t").take(of), b.column("s").take(of)]
            names = ["h", "t", "s"]
            if positions:
                cols += [b.column("doc_id").take(of), pa.array(np.concatenate(ats).astype(np.int32))]
                names += ["doc_id", "at"]
            yield pa.RecordBatch.from_arrays(cols, names)

    return run


def _emit_windows(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHashes()
        for b in batches:
            n, ps, hs, gs = [], [], [], []
            for text, ats in zip(b.column("text").to_pylist(), b.column("ats").to_pylist()):
                h, g = windows2(memo.of(words(text)), size)
                near = np.zeros(len(h) + PERIOD + 1, int)
                at = np.asarray(ats)
                np.add.at(near, np.maximum(at - PERIOD + 1, 0), 1)
                np.add.at(near, np.minimum(at + 1, len(near) - 1), -1)
                p = np.flatnonzero(np.cumsum(near)[: len(h)] > 0)
                n.append(len(p))
                ps.append(p)
                hs.append(h[p])
                gs.append(g[p])
            if not n:
                continue
            of = pa.array(_ids(n))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (hs, gs)] + [b.column(c).take(of) for c in ("doc_id", "t", "s")] + [pa.array(np.concatenate(ps).astype(np.int32))], ["h", "g", "doc_id", "t", "s", "at"])

    return run


def _cut(size: int, keep_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, lost, sha, kept = [], [], [], []
            for text, copy, ats in zip(*(b.column(c).to_pylist() for c in ("text", "copy", "ats"))):
                w = words(text)
                if copy and len(w) >= size:
                    left = []
                elif ats:
                    edge = np.zeros(len(w) + 1, int)
                    np.add.at(edge, np.asarray(ats), 1)
                    np.add.at(edge, np.asarray(ats) + size, -1)
                    left = [w[i] for i in np.flatnonzero(np.cumsum(edge)[:-1] == 0)]
                else:
                    left = w
                out = b" ".join(left)
                n.append(len(w))
                lost.append(len(w) - len(left))
                sha.append(hashlib.sha256(out).hexdigest())
                kept.append(out.decode("utf-8", "surrogatepass") if keep_text else None)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(lost, pa.int64()), pa.array(sha, pa.string())] + ([pa.array(kept, pa.string())] if keep_text else []), ["doc_id", "n_words", "n_removed", "kept_sha256"] + ["kept"] * keep_text)

    return run


def _spots() -> Column:
    """Aggregate: which shares `s` of the documents hold a key, a bit each."""
    return F.bit_or(F.expr("shiftleft(1L, int(s))")).alias("spots")


def _each_spot(keys: DataFrame) -> DataFrame:
    """A row for each share that holds a key, so that a join by key and share deals the
    rows of a key that very many documents hold over SHARES tasks."""
    held = F.filter(F.sequence(F.lit(0), F.lit(SHARES - 1)), lambda s: F.getbit("spots", s) == 1)
    return keys.withColumn("s", F.explode(held.cast("array<tinyint>"))).drop("spots")


def drop_repeats(docs: DataFrame, size: int = 50, keep_text: bool = True) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256[, kept]), a row for each row of docs.

    A word goes if a window that covers it also starts in a document of smaller doc_id.
    """
    if size < PERIOD + 2:
        raise ValueError(f"windows need at least {PERIOD + 2} words")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    docs = docs.withColumn("t", F.xxhash64("text")).withColumn("s", F.pmod(F.xxhash64("doc_id"), F.lit(SHARES)).cast("tinyint"))
    live = docs.where("doc_id is not null and text is not null")
    # a text that is another's copy holds no anchor "in a different text"
    shared = live.select("text", "t", "s").mapInArrow(_emit_anchors(size, False), "h long, t long, s byte")
    shared = shared.groupBy("h").agg(F.min("t").alias("lo"), F.max("t").alias("hi"), _spots()).where("lo <> hi").select("h", "spots")
    shared = _each_spot(written(shared, "shared"))
    marked = live.mapInArrow(_emit_anchors(size, True), "h long, t long, s byte, doc_id long, at int").join(shared, ["h", "s"])
    marked = written(marked.groupBy("doc_id", "t").agg(F.collect_set("at").alias("ats")), "marked")

    prints = live.select("doc_id", "t", "s", F.md5("text").alias("m"))
    first = prints.groupBy("m").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("last"), _spots()).where("rep < last")
    copies = prints.join(_each_spot(first.select("m", "rep", "spots")), ["m", "s"], "left")
    judged = written(copies.select("doc_id", "t", F.coalesce(F.col("doc_id") > F.col("rep"), F.lit(False)).alias("copy")).distinct(), "judged")
    ask = marked.join(judged.where("not copy").select("doc_id", "t"), ["doc_id", "t"])
    held = live.join(ask, ["doc_id", "t"]).select("text", "doc_id", "t", "s", "ats")
    held = written(held.mapInArrow(_emit_windows(size), "h long, g long, doc_id long, t long, s byte, at int"), "windows")
    least = held.groupBy("h", "g").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), _spots()).where("lo < hi").select("h", "g", "lo", "spots")
    least = _each_spot(written(least, "least"))
    lost = held.join(least, ["h", "g", "s"]).where("doc_id > lo").groupBy("doc_id", "t").agg(F.collect_set("at").alias("ats"))
    facts = written(judged.join(lost, ["doc_id", "t"], "left").where("copy or ats is not null"), "facts")
    final = docs.join(facts, ["doc_id", "t"], "left").select("doc_id", "text", "copy", "ats")
    return final.mapInArrow(_cut(size, keep_text), "doc_id long, n_words long, n_removed long, kept_sha256 string" + (", kept string" if keep_text else ""))

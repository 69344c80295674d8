"""Line dedup over levelled sorted runs of line hashes.

A run is a written table (h, g, n_docs, last_doc) sorted by hash; ``LineRuns``
keeps runs in levels, and ``fanout`` runs of a level are compacted into one of
the next, so a key is rewritten a logarithmic number of times. A new batch is
anti-joined against the runs (both sides sorted by hash, so Spark merges them)
and adds its own run. ``drop_lines`` takes its batches by falling doc_id: the
keys of a batch that no earlier run holds have their last document in it.

Defined results: a null or empty text is one empty line and stays as it is; a
null doc_id counts as one document below all others; rows that share a doc_id
are one document; keys under ``min_chars`` code points always stay; an empty
table gives an empty result; other columns pass through, whatever their names:
``cut_lines`` keeps the row in a struct, and ``drop_lines`` raises ValueError if
the input already has one of the three columns that it adds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, written

BLANK = " \t\n\x0b\x0c\r"
_NULL_ID = -(2**63)


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(BLANK)))


def _hash(line: Column) -> Column:
    key = line_key(line)
    return F.struct(F.xxhash64(key).alias("h"), F.xxhash64(F.lit(7), key).alias("g"))


def _doc(docs: DataFrame) -> Column:
    return F.coalesce(docs["doc_id"].cast("long"), F.lit(_NULL_ID))


def falling(docs: DataFrame, batches: int) -> Column:
    """Batch of a document: about as many documents in each, the largest doc_id in the first."""
    shares = [i / batches for i in range(1, batches)]
    bounds = docs.agg(F.percentile_approx(_doc(docs), shares, 1000)).first()[0] if shares else None
    return sum((F.when(_doc(docs) < b, 1).otherwise(0) for b in sorted(set(bounds or []))), F.lit(0))


def line_hashes(docs: DataFrame, min_chars: int, batch: Column) -> DataFrame:
    """(batch, doc_id, part, h, g): a row for each row of docs and long line key. part
    is a hash of the text, which keeps apart the many rows that may share a null id."""
    lines = F.filter(F.array_distinct(lines_of(F.col("text"))), lambda x: F.length(x) >= min_chars)
    keys = F.array_distinct(F.transform(F.filter(lines, lambda x: F.length(line_key(x)) >= min_chars), _hash))
    return docs.select(batch.cast("int").alias("batch"), _doc(docs).alias("doc_id"), F.xxhash64("text").alias("part"), F.inline(keys))


class LineRuns:
    """Levelled sorted runs of line hashes, in the shared folder."""

    def __init__(self, fanout: int = 4):
        self.fanout, self.levels = fanout, {}

    def runs(self) -> list[DataFrame]:
        return [r for level in self.levels.values() for r in level]

    def unseen(self, keys: DataFrame) -> DataFrame:
        """Rows of keys(h, g, ...) whose key no run of now holds."""
        for run in self.runs():
            keys = keys.join(run.select("h", "g").hint("merge"), ["h", "g"], "left_anti")
        return keys

    def add(self, keys: DataFrame) -> DataFrame:
        """Adds the run of a batch keys(doc_id, h, g) of documents not yet added, and
        returns those of its rows whose key no run before it holds."""
        own = keys.select("h", "g", "doc_id").distinct().groupBy("h", "g").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("last_doc"))
        run = written(own.sortWithinPartitions("h", "g"), "run0")
        fresh = self.unseen(run)
        self._put(0, run)
        return fresh

    def _put(self, level: int, run: DataFrame) -> None:
        held = self.levels.setdefault(level, [])
        held.append(run)
        if len(held) >= self.fanout:
            self.levels[level] = []
            self._put(level + 1, written(merged(held).sortWithinPartitions("h", "g"), f"run{level + 1}"))

    def total(self) -> DataFrame:
        return merged(self.runs())


def merged(runs: list[DataFrame]) -> DataFrame:
    rows = runs[0]
    for r in runs[1:]:
        rows = rows.union(r)
    return rows.groupBy("h", "g").agg(F.sum("n_docs").alias("n_docs"), F.max("last_doc").alias("last_doc"))


def cut_lines(docs: DataFrame, min_docs: int = 3, min_chars: int = 20, batches: int = 4) -> DataFrame:
    """(row, text, n_lines, n_dropped): the row of docs as a struct, and its text with
    the lines that stay.

    Keys found in at least min_docs documents lose their lines except in the
    largest doc_id that holds them.
    """
    hashes = written(line_hashes(docs.select("doc_id", "text"), min_chars, falling(docs, batches)), "lines", "batch")
    store, last = LineRuns(), None
    for b in range(batches):
        fresh = store.add(hashes.where(F.col("batch") == b)).select("h", "g", "last_doc")
        last = fresh if last is None else last.union(fresh)
    common = written(store.total().where(F.col("n_docs") >= min_docs).select("h", "g").join(last, ["h", "g"]), "common")
    lost = hashes.join(common, ["h", "g"]).where("doc_id < last_doc")
    lost = lost.groupBy("doc_id", "part").agg(F.collect_set(F.struct("h", "g")).alias("lost"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    id_, text = F.coalesce(F.col("row.doc_id").cast("long"), F.lit(_NULL_ID)), F.col("row.text")
    both = rows.select("row", id_.alias("doc_id"), F.xxhash64(text).alias("part")).join(lost, ["doc_id", "part"], "left")
    lines, any_lost = lines_of(text), F.col("lost").isNotNull()
    stay = F.filter(lines, lambda x: ~((F.length(x) >= min_chars) & F.array_contains(F.col("lost"), _hash(x))))
    both = both.select("row", "lost", F.when(any_lost, stay).alias("kept"), F.size(lines).cast("long").alias("n_lines"))
    return both.select(
        "row",
        F.when(any_lost, F.array_join("kept", "\n")).otherwise(text).alias("text"),
        "n_lines",
        F.when(any_lost, F.col("n_lines") - F.size("kept")).otherwise(F.lit(0)).cast("long").alias("n_dropped"),
    )


ADDED = {"_text": "text", "_n_lines": "n_lines", "_n_dropped": "n_dropped"}


def drop_lines(docs: DataFrame, min_docs: int = 3, min_chars: int = 20, batches: int = 4) -> DataFrame:
    """All columns of docs, with _text (lines that stay), _n_lines, _n_dropped."""
    if clash := set(ADDED) & set(docs.columns):
        raise ValueError(f"the input already has {sorted(clash)}")
    cut = cut_lines(docs, min_docs, min_chars, batches)
    return cut.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns], *[F.col(v).alias(k) for k, v in ADDED.items()])


def dedup_increment(docs: DataFrame, store: LineRuns, min_chars: int = 20) -> DataFrame:
    """The first-come form: (doc_id, h, g) of lines of a new batch that no
    earlier batch had; the batch is then added to the runs."""
    keys = written(line_hashes(docs, min_chars, F.lit(0)).select("doc_id", "h", "g").distinct(), "batch")
    fresh = written(store.unseen(keys), "fresh")
    store.add(keys)
    return fresh

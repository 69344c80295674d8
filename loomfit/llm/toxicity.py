"""Toxicity from the nearest labelled examples under exact TF-IDF cosine.

Terms are runs of letters, digits and other non-ASCII bytes of the whole text, a
to z in lower case, told apart by 64-bit hashes. Every term of every labelled
example is indexed: weight (1 + ln count) * (ln((1 + N) / (1 + df)) + 1), with N
and df over all documents, vectors of length one over the terms that some
example holds (no other term can add to a cosine). Weights have single
precision, so a cosine is right to about six digits.

The index is cut into blocks of examples that are alike. A term in many examples
knows its largest weight in each block. A search first adds up the terms in few
examples, then reads blocks by falling bound: what a block has so far and the
largest weights of the other terms. Blocks that cannot reach the k-th cosine found
so far are passed over, and the result stays exact.

Neighbours vote with a power of their cosine; leave-one-out votes of the examples
calibrate the score (isotonic steps). Labels come from at most ``sample`` labelled
rows, which bounds the index that every worker gets; documents, terms and
neighbours searched have no bound. Only text enters a score.

Defined results: a null or empty text has no terms, no neighbours and the score
of a vote that knows nothing; label rows with a null label are ignored, repeated
ones count as their largest; of label rows that share a doc_id the smallest text
is the example; examples of equal term counts are one, with the smallest doc_id
and the largest label; without labels every score is 0; ties among neighbours go
to the smaller doc_id; rows of docs are scored each by its own text, whatever
their doc_id; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod_col, hashed_sample, lean, small_batches, written
from .shingles import WordHashes

_BREAK = bytes(c if chr(c).isalnum() or c >= 128 else 32 for c in range(256))
BLOCK = 64  # examples of a block
SHRINK = 50.0  # likelihood ratio that chance alone reaches now and then
SLICE = 1 << 15  # terms whose document counts go together


def terms_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().translate(_BREAK).split() if text else []


def counted(text: str | None, memo: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct terms, sorted, and how often each occurs."""
    return np.unique(memo.of(terms_of(text)), return_counts=True)


def placed(vocabulary: np.ndarray, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the known terms in the vocabulary, and which terms are known."""
    if not len(vocabulary) or not len(terms):
        return np.empty(0, np.int64), np.zeros(len(terms), bool)
    at = np.minimum(np.searchsorted(vocabulary, terms), len(vocabulary) - 1)
    known = vocabulary[at] == terms
    return at[known], known


class BlockMaxIndex:
    """Unit vectors by term, in blocks of like examples. A term in few examples is a
    list of postings; one in many has a row of weights in each block, and the
    largest of them."""

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], width: int, many: int | None = None):
        """vectors: ascending terms under width and their weights; a term in more
        than `many` examples has block maxima."""
        self.n = n = len(vectors)
        sizes = np.array([len(t) for t, _ in vectors], np.int64)
        term = np.concatenate([np.asarray(t, np.int64) for t, _ in vectors]) if n else np.empty(0, np.int64)
        weight = np.concatenate([np.asarray(w, np.float32) for _, w in vectors]) if n else np.empty(0, np.float32)
        held = np.bincount(term, minlength=width)
        common = held > (max(BLOCK, n // 32) if many is None else many)
        owner = np.repeat(np.arange(n), sizes)
        # examples by their heaviest common term and its weight, so that like ones meet in a block
        lead, mass = np.full(n, -1), np.zeros(n)
        at = np.flatnonzero(common[term])
        top = at[np.lexsort((-weight[at], owner[at]))]
        first = np.append(True, owner[top][1:] != owner[top][:-1])[: len(top)]
        lead[owner[top][first]], mass[owner[top][first]] = term[top][first], weight[top][first]
        self.order = np.lexsort((mass, lead))
        self.place = np.empty(n, np.int64)
        self.place[self.order] = np.arange(n)
        self.slot = np.where(common, np.cumsum(common) - 1, -1)
        self.held = np.where(common, 0, held)
        self.start = np.cumsum(self.held) - self.held
        some = np.flatnonzero(~common[term])
        by = some[np.argsort(term[some], kind="stable")]
        self.at, self.weight = self.place[owner[by]].astype(np.uint32), weight[by]
        self.blocks = -(-n // BLOCK)
        some = np.flatnonzero(common[term])
        self.dense = (self.slot[term[some]].astype(np.uint32), self.place[owner[some]].astype(np.uint32), weight[some])
        self._fill()
        self.read = [0, 0]  # blocks read and blocks in all, of common terms

    def _fill(self) -> None:
        slot, at, weight = self.dense
        self.rows = np.zeros((int(self.slot.max(initial=-1)) + 1, self.blocks * BLOCK), np.float32)
        self.rows[slot, at] = weight
        self.rows = self.rows.reshape(len(self.rows), self.blocks, BLOCK)
        self.tops = self.rows.max(2, initial=0)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("rows", "tops")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._fill()

    def nearest(self, terms: np.ndarray, q: np.ndarray, k: int, skip: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """(example, cosine) of the k largest positive cosines, ties (to six digits)
        to the smaller example."""
        if not self.n or not len(terms):
            return np.empty(0, np.int64), np.empty(0)
        n, slot = self.held[terms], self.slot[terms]
        ends = np.cumsum(n)
        at = np.repeat(self.start[terms] - ends + n, n) + np.arange(int(ends[-1]))
        score = np.bincount(self.at[at], self.weight[at] * np.repeat(q, n), self.blocks * BLOCK).astype(float).reshape(self.blocks, BLOCK)
        if skip >= 0:
            score[divmod(int(self.place[skip]), BLOCK)] = -np.inf
        f = slot[slot >= 0]
        qf = q[slot >= 0].astype(np.float32)
        bound = score.max(1) + qf @ self.tops[f] + 1e-6
        todo = np.argsort(-bound, kind="stable")
        floor, near, cos = 0.0, np.empty(0, np.int64), np.empty(0)
        self.read[1] += self.blocks
        for wave in (max(2, self.blocks // 16), max(2, self.blocks // 4), self.blocks):  # the floor rises as blocks are read
            live, todo = todo[:wave], todo[wave:]
            live = live[bound[live] >= floor]
            if not len(live):
                break
            self.read[0] += len(live)
            got = (score[live].ravel() + qf @ self.rows[f[:, None], live].reshape(len(f), len(live) * BLOCK)) if len(f) else score[live].ravel()
            hit = np.flatnonzero(got > max(0.0, floor - 1e-6))
            near, cos = np.concatenate([near, (live[:, None] * BLOCK + np.arange(BLOCK)).ravel()[hit]]), np.concatenate([cos, got[hit]])
            if len(cos) > k:
                floor = float(np.partition(cos, -k)[-k]) - 1e-6
                near, cos = near[cos >= floor], cos[cos >= floor]
        example = self.order[near]
        by = np.lexsort((example, -np.round(cos, 6)))[:k]
        return example[by], cos[by]


class Votes:
    """Labelled examples, their index and the calibration of their votes."""

    POWER = 4

    def __init__(self, vocabulary: np.ndarray, idf: np.ndarray, vectors: list, labels: np.ndarray, ids: np.ndarray, k: int = 15):
        """vectors: ascending places in the vocabulary and counts, by rising ids."""
        self.vocabulary, self.k, self.labels, self.ids = vocabulary, k, labels, ids
        self.idf = idf * evidence([t for t, _ in vectors], labels, len(vocabulary))
        self.prior = float(labels.mean()) if len(labels) else 0.0
        units = [(t, self._unit(t, c)) for t, c in vectors]
        self.index = BlockMaxIndex(units, len(vocabulary))
        own = np.array([self._vote(t, w, i)[0] for i, (t, w) in enumerate(units)])
        self.steps = isotonic(own, labels) if len(labels) else None

    def _unit(self, t: np.ndarray, counts: np.ndarray) -> np.ndarray:
        w = (1 + np.log(counts)) * self.idf[t]
        return w / np.sqrt((w * w).sum()) if len(w) else w

    def _vote(self, t: np.ndarray, w: np.ndarray, skip: int = -1):
        near, cos = self.index.nearest(t, w, self.k, skip)
        weight = (cos / cos[0]) ** self.POWER * cos[0] if len(cos) else cos  # the nearest counts as its cosine
        return (weight @ self.labels[near] + self.prior * 0.1) / (weight.sum() + 0.1), near, cos

    def score(self, terms: np.ndarray, counts: np.ndarray) -> tuple[float, list[int], list[float]]:
        """(calibrated score, evidence: nearest doc_ids, their cosines) of hashes and counts."""
        if self.steps is None:
            return self.prior, [], []
        t, known = placed(self.vocabulary, terms)
        vote, near, cos = self._vote(t, self._unit(t, counts[known]))
        x, p = self.steps
        return float(np.interp(vote, x, p)), self.ids[near[:3]].tolist(), [round(float(c), 6) for c in cos[:3]]


def evidence(sets: list[np.ndarray], labels: np.ndarray, width: int) -> np.ndarray:
    """How well each term's presence tells the labels apart: the likelihood ratio G of
    presence against label, shrunk smoothly to G^2 / (G + SHRINK) and never 0."""
    n, pos = len(labels), float(labels.sum())
    if not 0 < pos < n:
        return np.ones(width)
    term, label = np.concatenate(sets), np.repeat(labels, [len(t) for t in sets])
    held, with_label = np.bincount(term, minlength=width).astype(float), np.bincount(term, label, width)

    def part(a, total, share):  # a ln(a / expected), 0 at a = 0
        return np.where(a > 0, a * np.log(np.maximum(a, 1e-9) / np.maximum(total * share, 1e-9)), 0.0)

    g = 2 * (part(with_label, held, pos / n) + part(held - with_label, held, 1 - pos / n) + part(pos - with_label, n - held, pos / n) + part(n - held - (pos - with_label), n - held, 1 - pos / n))
    g = np.maximum(g, 1e-3)
    return g * g / (g + SHRINK)


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Points of a rising step function (pool adjacent violators), shrunk a little from 0 and 1."""
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []
    for a, b in zip(x[order], y[order]):
        blocks.append([a, b, 1.0])
        while len(blocks) > 1 and blocks[-2][1] >= blocks[-1][1]:
            a2, b2, n2 = blocks.pop()
            a1, b1, n1 = blocks[-1]
            n = n1 + n2
            blocks[-1] = [(a1 * n1 + a2 * n2) / n, (b1 * n1 + b2 * n2) / n, n]
    at, p, n = (np.array(v) for v in zip(*blocks))
    return at, (p * n + 0.5) / (n + 1)


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    memo = WordHashes()
    for b in batches:
        made = [counted(x, memo) for x in b.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("toxic"), pa.array([t.tobytes() for t, _ in made], pa.binary()), pa.array([c.astype("<u4").tobytes() for _, c in made], pa.binary())], ["doc_id", "toxic", "terms", "counts"])


def _vocabulary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    terms = [np.frombuffer(x, "<u8") for b in batches for x in b.column("terms").to_pylist()]
    yield pa.RecordBatch.from_arrays([pa.array([np.unique(np.concatenate([np.empty(0, np.uint64), *terms])).tobytes()], pa.binary())], ["blob"])


def _frequencies(vocabulary):
    """In how many documents of a task each known term is, by slices; slice -1 counts the documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, known = WordHashes(), np.frombuffer(vocabulary.value, "<u8")
        held, n = np.zeros(len(known), np.uint32), 0
        for b in batches:
            n += b.num_rows
            for lo in range(0, b.num_rows, 256):
                sets = [np.unique(memo.of(terms_of(x))) for x in b.column("text").slice(lo, 256).to_pylist()]
                at, _ = placed(known, np.concatenate(sets))
                held += np.bincount(at, minlength=len(known)).astype(np.uint32)
        parts = [np.array([n], np.uint32), *(held[lo : lo + SLICE] for lo in range(0, len(held), SLICE))]
        some = [i for i, x in enumerate(parts) if x.any()]
        yield pa.RecordBatch.from_arrays([pa.array([i - 1 for i in some], pa.int32()), pa.array([parts[i].astype("<u4").tobytes() for i in some], pa.binary())], ["slice", "counts"])

    return run


def _summed(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = 0
    for b in batches:
        for x in b.column("counts").to_pylist():
            total = total + np.frombuffer(x, "<u4").astype("<i8")
    yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["slice", "counts"])


def _index(vocabulary, idf, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.frombuffer(vocabulary.value, "<u8")
        rows = sorted(r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("doc_id", "toxic", "terms", "counts"))))
        alike: dict[tuple[bytes, bytes], list] = {}
        for doc_id, toxic, t, c in rows:
            one = alike.setdefault((t, c), [doc_id, toxic])
            one[1] = max(one[1], toxic)
        vectors = [(placed(known, np.frombuffer(t, "<u8"))[0], np.frombuffer(c, "<u4").astype(float)) for t, c in alike]
        labels, ids = np.array([x[1] for x in alike.values()], float), np.array([x[0] for x in alike.values()], np.int64)
        blob = pickle.dumps(Votes(known, np.frombuffer(idf.value), vectors, labels, ids, k), protocol=5)
        yield pa.RecordBatch.from_arrays([pa.array([blob], pa.binary())], ["blob"])

    return run


def _score(votes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, model = WordHashes(), pickle.loads(votes.value)
        for b in batches:
            out = [model.score(*counted(x, memo)) for x in b.column("text").to_pylist()]
            s = np.array([x[0] for x in out], float)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(s), pa.array((s >= 0.5).astype(np.int32)), pa.array([x[1] for x in out], pa.list_(pa.int64())), pa.array([x[2] for x in out], pa.list_(pa.float64()))], ["doc_id", "held_out", "score", "predicted", "evidence", "cosines"])

    return run


def toxicity_scores(docs: DataFrame, labels: DataFrame, sample: int = 5000, held_of: int = 5, k: int = 15) -> DataFrame:
    """(doc_id, held_out, score, predicted, evidence, cosines), a row for each row of docs."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    marks = labels.where("toxic is not null and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "toxic").where(crc_mod_col(F.col("doc_id"), held_of) != 0)
    marks = marks.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    marks = F.broadcast(hashed_sample(marks, sample, "doc_id"))  # two numbers a row, at most `sample` rows
    seen = docs.join(marks, "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))
    seen = written(seen.mapInArrow(lean(_examples), "doc_id long, toxic int, terms binary, counts binary"), "examples")

    def alone(df: DataFrame, run) -> bytes:  # the examples are bounded by `sample`, so one task may hold them
        return bytes(df.repartition(1).mapInArrow(lean(run), "blob binary").first()[0])

    vocabulary = spark.sparkContext.broadcast(alone(seen, _vocabulary))
    held = docs.mapInArrow(lean(_frequencies(vocabulary)), "slice int, counts binary").groupBy("slice").applyInArrow(_summed, "slice int, counts binary").collect()
    df = np.zeros(len(vocabulary.value) // 8)
    for r in held:
        if r["slice"] >= 0:
            df[r["slice"] * SLICE : (r["slice"] + 1) * SLICE] = np.frombuffer(r["counts"], "<i8")
    n = next((int(np.frombuffer(r["counts"], "<i8")[0]) for r in held if r["slice"] < 0), 0)
    idf = spark.sparkContext.broadcast((np.log((1 + n) / (1 + df)) + 1).tobytes())
    votes = spark.sparkContext.broadcast(alone(seen, _index(vocabulary, idf, k)))
    return docs.withColumn("held_out", crc_mod_col(F.col("doc_id"), held_of) == 0).mapInArrow(lean(_score(votes)), "doc_id long, held_out boolean, score double, predicted int, evidence array<long>, cosines array<double>")

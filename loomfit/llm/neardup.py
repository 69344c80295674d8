"""MinHash near-dedup with sequential Bayesian verification.

1. One pass makes each document's shingle set, its fingerprint and a MinHash
   signature. Equal sets form a class at once, so copies cost nothing further.
2. Bands of the signature are buckets. Every bucket compares its members with
   one of them (a star): the member whose own buckets hold most rows. Copies of
   one original differ more from each other than from it, so the original lies
   in the largest buckets and is the centre of most of them; a large group then
   costs a few pairs a member.
3. Once more every bucket compares those not yet joined with its hub, the member
   that has most links.
4. Pairs in one bucket that are still in different components are compared in
   bounded blocks, in the first band they share, first by signature and then by
   sets of 32-bit hashes; of the pairs that join two components one is enough,
   so a block gives a few pairs for each component, whatever its size.
5. Comparing reads the signature in batches and drops a pair as soon as its
   posterior chance of reaching the threshold is under ``miss``; every pair
   that survives is confirmed on the full shingle sets.

With 32 bands of 4 a pair at similarity 0.8 has no common bucket with
probability 5e-8.

Defined results: a document without words, or with a null text, has an empty
set and no links; a null doc_id has no links and a null component; rows that
share a doc_id are one document; an empty table gives an empty result; ties
are impossible, since a component is named by its smallest doc_id; extra
columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, lean, written
from .shingles import WordHashes, set_id, shingle_set

BANDS, ROWS, BATCH = 32, 4, 32
HASHES = BANDS * ROWS
_rng = np.random.default_rng(20240501)
_A = _rng.integers(1, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_C = _rng.integers(0, 2**63, HASHES, dtype=np.uint64)


def signature(s: np.ndarray) -> np.ndarray:
    low = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(s), 1024):
            np.minimum(low, (s[at : at + 1024, None] * _A + _C).min(0), out=low)
    return (low >> np.uint64(32)).astype("<u4")


def least_matches(threshold: float, miss: float) -> list[tuple[int, int]]:
    """(hashes compared, fewest matches to go on): under a uniform prior, m of n
    matches leave a chance P(Binomial(n + 1, threshold) <= m) of similarity >= threshold."""
    out = []
    for n in range(BATCH, HASHES + 1, BATCH):
        total, m = 0.0, -1
        while total < miss and m < n:
            m += 1
            total += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append((n, m))
    return out


def likely(a: np.ndarray, b: np.ndarray, steps: list[tuple[int, int]]) -> np.ndarray:
    """Which rows of two signature matrices stay after sequential pruning."""
    alive, count, before = np.arange(len(a)), np.zeros(len(a), int), 0
    for n, least in steps:
        count = count + (a[alive, before:n] == b[alive, before:n]).sum(1)
        alive, count, before = alive[count >= least], count[count >= least], n
    return alive


def _signed(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHashes()
        for b in batches:
            n, ids, sigs = [], [], []
            for text in b.column("text").to_pylist():
                s = shingle_set(text.encode("utf-8", "surrogatepass").lower().split() if text else [], k, memo)
                n.append(len(s))
                ids.append(set_id(s))
                sigs.append(signature(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids, pa.binary()), pa.array(sigs, pa.binary())], ["doc_id", "n_shingles", "set_id", "sig"])

    return run


def _sets(k: int, small: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHashes()
        for b in batches:
            sets = [shingle_set(t.encode("utf-8", "surrogatepass").lower().split() if t else [], k, memo) for t in b.column("text").to_pylist()]
            kept = [(_small(s) if small else s).tobytes() for s in sets]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([set_id(s) for s in sets], pa.binary()), pa.array(kept, pa.binary())], ["doc_id", "set_id", "set"])

    return run


def _matrix(col: pa.Array, dtype: str, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), dtype).reshape(-1, width)


def _prune(threshold: float, miss: float):
    steps = least_matches(threshold, miss)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x, y = _matrix(b.column("sa"), "<u4", HASHES), _matrix(b.column("sb"), "<u4", HASHES)
                at = likely(x, y, steps)
                yield pa.RecordBatch.from_arrays([b.column("a").take(pa.array(at)), b.column("b").take(pa.array(at)), pa.array((x[at] == y[at]).sum(1), pa.int64())], ["a", "b", "m"])

    return run


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for i, (x, y) in enumerate(zip(b.column("xa").to_pylist(), b.column("xb").to_pylist())):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(x) + len(y) - len(np.union1d(x, y))
                if 100 * both >= percent * (len(x) + len(y) - both):
                    keep.append(i)
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("a").take(at), b.column("b").take(at)], ["a", "b"])

    return run


def _small(s: np.ndarray) -> np.ndarray:
    return np.unique((s >> np.uint64(32)).astype("<u4"))


class _Joined(dict):
    """Components that a cell has joined."""

    def root(self, c: int) -> int:
        while (up := self.get(c, c)) != c:
            c = up
        return c


def _cells(percent: int, miss: float):
    """Rows sorted by (key, qb, tb); within a cell every query row is compared
    with every target row of another component."""
    steps = least_matches(percent / 100, miss)

    def settle(qi, qc, qset, ti, tc, tsets, joined, out_a, out_b):
        """Candidates of one query row, likeliest first. Small sets lose or merge an
        element at most rarely: a sure link joins its component, doubtful ones all go out."""
        for t, c, s in zip(ti, tc, tsets):
            mine, other = joined.root(qc), joined.root(c)
            if mine == other:
                continue
            both = len(np.intersect1d(qset, s, assume_unique=True))
            slack = 100 * both - percent * (len(qset) + len(s) - both)
            if slack >= -600:
                out_a.append(min(qi, t))
                out_b.append(max(qi, t))
                if slack >= 600:
                    joined[max(mine, other)] = min(mine, other)

    def cell(q, t, band):
        qs, ts = _matrix(q["sig"], "<u4", HASHES), _matrix(t["sig"], "<u4", HASHES)
        qi, ti, qc, tc = (np.asarray(x) for x in (q["rep"], t["rep"], q["comp"], t["comp"]))
        # a residual pair is compared once; a pair with the majority always
        want = (qc[:, None] != tc[None]) & (np.asarray(t["major"])[None] | (ti[None] > qi[:, None]))
        n, least = steps[0]
        out_a, out_b, joined = [], [], _Joined()
        for i in np.flatnonzero(want.any(1)):
            js = np.flatnonzero(want[i])
            js = js[(ts[js, :n] == qs[i, :n]).sum(1) >= least]
            js = js[likely(ts[js], np.broadcast_to(qs[i], (len(js), HASHES)), steps)]
            same = ts[js] == qs[i]
            here = same.reshape(-1, BANDS, ROWS).all(2).argmax(1) == band
            js = js[here][np.argsort(-same[here].sum(1), kind="stable")]
            if len(js):
                own = np.frombuffer(q["set"][int(i)].as_py(), "<u4")
                sets = (np.frombuffer(t["set"][j].as_py(), "<u4") for j in js.tolist())
                settle(int(qi[i]), int(qc[i]), own, ti[js].tolist(), tc[js].tolist(), sets, joined, out_a, out_b)
        return out_a, out_b

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for b in _then_end(batches):
            table = pa.Table.from_batches([x for x in (rest, b) if x is not None]).combine_chunks() if b is not None or rest is not None else None
            if table is None or not table.num_rows:
                continue
            key = np.stack([np.asarray(table.column(c)) for c in ("key", "qb", "tb")], 1)
            cuts = np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1
            bounds = [0, *cuts.tolist(), *([table.num_rows] if b is None else [])]
            a_out, b_out = [], []
            for lo, hi in zip(bounds, bounds[1:]):
                part = table.slice(lo, hi - lo)
                ask = np.asarray(part.column("query"))
                if ask.any() and not ask.all():
                    side = [{c: part.column(c).combine_chunks().take(pa.array(np.flatnonzero(w))) for c in ("rep", "comp", "major", "sig", "set")} for w in (ask, ~ask)]
                    for s in side:
                        s["major"] = np.asarray(s["major"].to_numpy(zero_copy_only=False), bool)
                        s["rep"], s["comp"] = s["rep"].to_numpy(), s["comp"].to_numpy()
                    x, y = cell(*side, part.column("band")[0].as_py())
                    a_out += x
                    b_out += y
            last = table.slice(bounds[-1])
            rest = last.combine_chunks().to_batches()[0] if last.num_rows else None
            yield pa.RecordBatch.from_arrays([pa.array(a_out, pa.int64()), pa.array(b_out, pa.int64())], ["a", "b"])

    return run


def _then_end(batches):
    yield from batches
    yield None


def _sets_of(ids: DataFrame, docs: DataFrame, classes: DataFrame, k: int, small: bool = False) -> DataFrame:
    """(doc_id, set) of representatives ids(doc_id)."""
    need = classes.select(F.col("rep").alias("doc_id"), "set_id").join(ids, "doc_id")
    texts = docs.join(need.select("doc_id"), "doc_id", "left_semi")
    sets = texts.mapInArrow(lean(_sets(k, small)), "doc_id long, set_id binary, set binary")
    return written(sets.join(need, ["doc_id", "set_id"], "left_semi").dropDuplicates(["doc_id"]).select("doc_id", "set"), "sets")


def _verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame, k: int, percent: int) -> DataFrame:
    """pairs(a, b) whose full sets reach the threshold."""
    ids = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
    sets = _sets_of(ids, docs, classes, k)
    both = pairs.select("a", "b").join(sets.select(F.col("doc_id").alias("a"), F.col("set").alias("xa")), "a").join(sets.select(F.col("doc_id").alias("b"), F.col("set").alias("xb")), "b")
    return written(both.select("a", "b", "xa", "xb").mapInArrow(lean(_confirm(percent)), "a long, b long"), "verified")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, miss: float = 1e-6, block: int = 256) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), a row for each row of docs."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    t = percent / 100
    signed = written(docs.mapInArrow(lean(_signed(k)), "doc_id long, n_shingles long, set_id binary, sig binary"), "signed")
    full = signed.where("n_shingles > 0 and doc_id is not null")
    classes = written(full.groupBy("set_id").agg(F.min("doc_id").alias("rep"), F.first("sig").alias("sig")), "classes")
    # a doc_id whose rows have different sets joins their classes
    own = full.select("doc_id", "set_id").join(classes.select("set_id", "rep"), "set_id").select("doc_id", "rep").distinct()
    several = own.groupBy("doc_id").agg(F.min("rep").alias("a"), F.count("*").alias("n")).where("n > 1")
    same = written(own.join(several, "doc_id").where("rep <> a").select("a", F.col("rep").alias("b")), "same")

    bands = F.posexplode(F.array(*[F.xxhash64(F.lit(i), F.substring("sig", i * ROWS * 4 + 1, ROWS * 4)) for i in range(BANDS)]))
    banded = classes.select("rep", bands.alias("band", "key"))
    crowds = banded.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    members = written(banded.join(crowds, "key"), "members")
    weights = members.groupBy("rep").agg(F.sum("n").alias("w"))
    stars = members.join(weights, "rep").groupBy("key").agg(F.max(F.struct("w", (-F.col("rep")).alias("nr"))).alias("c"))
    centred = members.join(stars.select("key", (-F.col("c.nr")).alias("center")), "key")
    pairs = centred.where("rep <> center").select(F.least("rep", "center").alias("a"), F.greatest("rep", "center").alias("b"), "rep").groupBy("a", "b").agg(F.min("rep").alias("rep"))
    sigs = classes.select("rep", "sig")

    def alike(pairs: DataFrame) -> DataFrame:
        """(a, b, m): pairs that survive pruning and their equal hashes."""
        both = pairs.join(sigs.select(F.col("rep").alias("a"), F.col("sig").alias("sa")), "a").join(sigs.select(F.col("rep").alias("b"), F.col("sig").alias("sb")), "b")
        return written(both.select("a", "b", "sa", "sb").mapInArrow(_prune(t, miss), "a long, b long, m long"), "close")

    def ends(pairs: DataFrame, *more: str) -> DataFrame:
        return pairs.select(F.col("a").alias("x"), "a", "b", *more).union(pairs.select(F.col("b").alias("x"), "a", "b", *more))

    # each document first tries its likeliest partner only
    likeliest = ends(alike(pairs.select("a", "b")), "m").groupBy("x").agg(F.max(F.struct("m", (-F.col("a")).alias("na"), (-F.col("b")).alias("nb"))).alias("p"))
    tried = written(likeliest.select((-F.col("p.na")).alias("a"), (-F.col("p.nb")).alias("b")).distinct(), "tried")
    sure = _verified(tried, docs, classes, k, percent)
    found = components(sure.union(same))
    degree = ends(sure).groupBy(F.col("x").alias("rep")).agg(F.count("*").alias("d"))
    held = members.select("key", "rep").join(found.select(F.col("id").alias("rep"), "component_id"), "rep", "left").join(degree, "rep", "left")
    held = written(held.select("key", "rep", F.coalesce("component_id", "rep").alias("comp"), F.coalesce("d", F.lit(0)).alias("d")), "held")
    hub = held.groupBy("key").agg(F.max(F.struct("d", (-F.col("rep")).alias("nr"), "comp")).alias("h"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi and h.d > 0")
    rays = held.join(hub.select("key", (-F.col("h.nr")).alias("hub"), F.col("h.comp").alias("hub_comp")), "key").where("comp <> hub_comp")
    rays = rays.select(F.least("rep", "hub").alias("a"), F.greatest("rep", "hub").alias("b")).distinct().join(tried, ["a", "b"], "left_anti")
    new = written(alike(rays).select("a", "b"), "rays")
    tried = tried.union(new)
    sure = sure.union(_verified(new, docs, classes, k, percent))
    found = components(sure.union(same))

    # what one bucket holds but no link has joined yet
    held = members.join(found.select(F.col("id").alias("rep"), "component_id"), "rep", "left").select("key", "band", "rep", F.coalesce("component_id", "rep").alias("comp"))
    sizes = held.groupBy("key", "comp").agg(F.count("*").alias("n"))
    sizes = sizes.groupBy("key").agg(F.sum("n").alias("n"), F.count("*").alias("comps"), F.max(F.struct("n", "comp")).alias("top")).where("comps > 1")
    open_ = written(held.join(sizes.select("key", F.col("n").alias("rows"), (F.col("n") - F.col("top.n")).alias("left"), F.col("top.comp").alias("top")), "key"), "open")
    small = _sets_of(open_.select(F.col("rep").alias("doc_id")).distinct(), docs, classes, k, small=True)
    open_ = open_.join(sigs, "rep").join(small.withColumnRenamed("doc_id", "rep"), "rep").withColumn("major", F.col("comp") == F.col("top"))
    nq, nt = F.ceil(F.col("left") / block).cast("int"), F.ceil(F.col("rows") / (4 * block)).cast("int")
    row = ("key", "band", "rep", "comp", "major", "sig", "set")
    asks = open_.where("not major").select(*row, F.pmod(F.xxhash64("rep"), nq).cast("int").alias("qb"), F.explode(F.sequence(F.lit(0), nt - 1)).alias("tb"), F.lit(True).alias("query"))
    targets = open_.select(*row, F.explode(F.sequence(F.lit(0), nq - 1)).alias("qb"), F.pmod(F.xxhash64("rep"), nt).cast("int").alias("tb"), F.lit(False).alias("query"))
    cells = asks.unionByName(targets).repartition("key", "qb", "tb").sortWithinPartitions("key", "qb", "tb")
    more = written(cells.mapInArrow(lean(_cells(percent, miss)), "a long, b long").distinct(), "more").join(tried, ["a", "b"], "left_anti")
    links = _verified(written(more, "cross"), docs, classes, k, percent).union(found.select(F.col("id").alias("a"), F.col("component_id").alias("b")))
    found = components(links)

    named = written(classes.join(found.select(F.col("id").alias("rep"), "component_id"), "rep", "left").select("set_id", F.coalesce("component_id", "rep").alias("component_id")), "named")
    out = signed.select("doc_id", "n_shingles", "set_id").join(named, "set_id", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))

"""Approximate nearest neighbours over balanced posting lists.

Centroids are trained on at most ``sample`` distinct vectors by halving the longest
list again and again. A vector goes to the list of its nearest centroid and, near a
boundary, to further ones; lists that stay long are cut into parts of bounded
length. Centroids are searched through an in-memory neighbour graph. A query
reads its nearest lists up to a ratio of distances; each part is compared by
matrix products in blocks, then the best are measured exactly in double
precision on the original vectors.

Equal vectors are indexed once, with the ``top + 1`` smallest ids: no query can
need more of them, so any number of copies costs one entry and results are whole.

Defined results: vectors that are null, empty, all zero, hold a null, NaN or an
infinity, or whose length differs from the commonest one (ties: the shorter)
take no part, as do null ids; rows that repeat an id with another vector are
separate candidates; ties go to the smaller id; fewer candidates give fewer
rows; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import hashed_sample, written


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, v array<double>) of the rows that take part."""
    v = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v")).where("vec_id is not null and v is not null and size(v) > 0")
    fine = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0)
    v = v.where(F.coalesce(fine, F.lit(False)))
    size = v.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return v.where(F.size("v") == (size["d"] if size else 0)).withColumn("v", F.transform("v", lambda x: x + F.lit(0.0)))  # -0 becomes 0


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] - 2 * a @ b.T + (b * b).sum(1)[None], 0)


def _halves(x: np.ndarray, rounds: int = 6) -> np.ndarray:
    """Two means, started at two far rows; at the middle row if they'd be too uneven."""
    a = x[((x - x[0]) ** 2).sum(1).argmax()]
    b = x[((x - a) ** 2).sum(1).argmax()]
    for _ in range(rounds):
        side = ((x - a) ** 2).sum(1) > ((x - b) ** 2).sum(1)
        if side.all() or not side.any():
            break
        a, b = x[~side].mean(0), x[side].mean(0)
    if not len(x) // 5 <= side.sum() <= len(x) - len(x) // 5 or side.all() or not side.any():
        order = np.argsort(x @ (b - a), kind="stable")
        side = np.zeros(len(x), bool)
        side[order[len(x) // 2 :]] = True
    return side


def train_centroids(x: np.ndarray, k: int) -> np.ndarray:
    """The longest list is halved until there are k, so that lists stay of like length."""
    lists = [(-len(x), 0, np.arange(len(x)))]
    while len(lists) < k and -lists[0][0] > 1:
        _, at, rows = heapq.heappop(lists)
        side = _halves(x[rows])
        for i, part in enumerate((rows[~side], rows[side])):
            heapq.heappush(lists, (-len(part), 2 * at + 1 + i, part))
    return np.stack([x[rows].mean(0) for _, _, rows in lists])


class CentroidGraph:
    """Best-first search over a neighbour graph of centroids, a batch at a time."""

    def __init__(self, c: np.ndarray, degree: int = 24):
        self.c, k = c, len(c)
        d = distances(c, c)
        near = np.argsort(d, axis=1, kind="stable")[:, 1 : degree + 1]
        far = np.random.default_rng(1).integers(0, k, (k, 4))  # long edges keep the graph connected
        ring = (np.arange(k)[:, None] + 1) % k
        self.edges = np.hstack([near, far, ring])
        # entries lie far from each other, so that every close group of centroids has one
        spread, gap = [0], d[0].copy()
        for _ in range(min(k, max(16, 4 * int(k**0.5))) - 1):
            spread.append(int(gap.argmax()))
            gap = np.minimum(gap, d[spread[-1]])
        self.entry = np.unique(spread)

    def search(self, q: np.ndarray, want: int) -> tuple[np.ndarray, np.ndarray]:
        """(lists, distances) of about the `want` nearest centroids, nearest first."""
        k, width = len(self.c), min(len(self.c), max(want, 32))
        ids, dist = np.empty((len(q), width), int), np.empty((len(q), width))
        for i, v in enumerate(q):
            seen = np.zeros(k, bool)
            seen[self.entry] = True
            pool, d = self.entry, ((self.c[self.entry] - v) ** 2).sum(1)
            order = np.argsort(d, kind="stable")[:width]
            pool, d = pool[order], d[order]
            opened = np.zeros(k, bool)
            while True:
                todo = pool[~opened[pool]][:8]
                if not len(todo):
                    break
                opened[todo] = True
                new = np.unique(self.edges[todo])
                new = new[~seen[new]]
                seen[new] = True
                pool, d = np.concatenate([pool, new]), np.concatenate([d, ((self.c[new] - v) ** 2).sum(1)])
                order = np.argsort(d, kind="stable")[:width]
                pool, d = pool[order], d[order]
            if len(pool) < width:
                rest = np.flatnonzero(~seen)
                pool, d = np.concatenate([pool, rest])[:width], np.concatenate([d, ((self.c[rest] - v) ** 2).sum(1)])[:width]
                order = np.argsort(d, kind="stable")
                pool, d = pool[order], d[order]
            ids[i], dist[i] = pool, d
        return ids[:, :want], np.sqrt(dist[:, :want])


def _choose(graph: CentroidGraph, want: int, ratio: float, lengths: np.ndarray | None = None, need: int = 0):
    """Lists within the ratio of the nearest one's distance and, if lengths are given,
    as many further ones as hold `need` rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            q = b.column("v").flatten().to_numpy().reshape(b.num_rows, -1)
            lists, dist = graph.search(q, min(want, len(graph.c)))
            keep = dist <= ratio * dist[:, :1] + 1e-12
            chosen = [row[k] for row, k in zip(lists, keep)]
            if lengths is not None:
                held = np.cumsum(lengths[lists], axis=1)
                for i in np.flatnonzero(np.where(keep, lengths[lists], 0).sum(1) < need):
                    if held[i, -1] >= need:
                        chosen[i] = lists[i, : np.searchsorted(held[i], need) + 1]
                    else:  # lists may be short or empty; then all are ranked
                        every = np.argsort(((graph.c - q[i]) ** 2).sum(1), kind="stable")
                        chosen[i] = every[: np.searchsorted(np.cumsum(lengths[every]), need) + 1]
            of = pa.array(np.repeat(np.arange(len(q)), [len(x) for x in chosen]))
            yield pa.RecordBatch.from_arrays([b.column("vec_id").take(of), b.column("v").take(of), pa.array(np.concatenate(chosen).astype(np.int32))], ["vec_id", "v", "list"])

    return run


class _Best:
    """The top + 1 entries of each query among all cells of a task; ties to the smaller entry."""

    def __init__(self, top: int, hold: int = 1 << 19):
        self.m, self.hold, self.parts, self.size = top + 1, hold, [], 0

    def _kept(self, q: np.ndarray, entry: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, ...]:
        order = np.lexsort((entry, score, q))
        q, entry, score = q[order], entry[order], score[order]
        new = np.append(True, (q[1:] != q[:-1]) | (entry[1:] != entry[:-1]))  # an entry may stand in several lists
        q, entry, score = q[new], entry[new], score[new]
        start = np.flatnonzero(np.append(True, q[1:] != q[:-1]))
        place = np.arange(len(q)) - np.repeat(start, np.diff(np.append(start, len(q))))
        return q[place < self.m], entry[place < self.m], score[place < self.m]

    def add(self, ids: np.ndarray, q: np.ndarray, entries: np.ndarray, x: np.ndarray) -> None:
        d = distances(q, x)
        m = min(self.m, len(x))
        far = np.partition(d, m - 1, axis=1)[:, m - 1 : m]
        row, col = np.nonzero(d <= far + 1e-9 * (1 + far))  # products round; these are measured exactly
        score = np.concatenate([np.sqrt(((q[row[i : i + 65536]] - x[col[i : i + 65536]]) ** 2).sum(1)) for i in range(0, len(row), 65536)])
        self.parts.append(self._kept(ids[row], entries[col], score))
        self.size += len(self.parts[-1][0])

    def batch(self, last: bool) -> pa.RecordBatch | None:
        """What is due: all at the end, or when so many queries are held that memory asks for it."""
        if not self.parts or not last and self.size < self.hold:
            return None
        q, entry, score = self._kept(*(np.concatenate(x) for x in zip(*self.parts)))
        self.parts, self.size = [(q, entry, score)], len(q)
        if not last and self.size < self.hold // 2:
            return None
        self.parts, self.size = [], 0
        return pa.RecordBatch.from_arrays([pa.array(q), pa.array(entry), pa.array(score)], ["query_id", "entry", "score"])


def _compare(top: int):
    """Rows sorted by (list, part, qpart); each cell holds bounded queries and entries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest, best = None, _Best(top)
        for b in _then_end(batches):
            parts = [x for x in (rest, b) if x is not None]
            if parts and (t := pa.Table.from_batches(parts).combine_chunks()).num_rows:
                key = np.stack([np.asarray(t.column(c)) for c in ("list", "part", "qpart")], 1)
                cuts = np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1
                bounds = [0, *cuts.tolist(), *([t.num_rows] if b is None else [])]
                for lo, hi in zip(bounds, bounds[1:]):
                    ask = np.asarray(t.column("query").slice(lo, hi - lo))
                    if ask.all() or not ask.any():
                        continue
                    ids = np.asarray(t.column("vec_id").slice(lo, hi - lo))
                    v = t.column("v").slice(lo, hi - lo).combine_chunks()
                    v = v.flatten().to_numpy().reshape(hi - lo, -1)
                    best.add(ids[ask], v[ask], ids[~ask], v[~ask])
                tail = t.slice(bounds[-1])
                rest = tail.combine_chunks().to_batches()[0] if tail.num_rows else None
            if (out := best.batch(b is None)) is not None:
                yield out

    return run


def _then_end(batches):
    yield from batches
    yield None


def nearest(vectors: DataFrame, queries_where, top: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", sample: int = 20000, list_size: int = 128, replicas: int = 4, replica_ratio: float = 1.15, probes: float = 2.0, ratio: float = 1.5, block: int = 1024) -> DataFrame:
    """(query_id, rank, vec_id, score): the `top` nearest found for each row of
    vectors for which the expression queries_where holds.

    A query may read probes * k^0.7 of k lists (a falling share of them); the ratio
    of distances prunes below that, but never below lists that hold enough rows for
    `top` results.
    """
    schema = "query_id long, rank int, vec_id long, score double"
    rows = written(usable(vectors, id_col, vec_col), "vectors")
    every = Window.partitionBy("v", "salt").orderBy("vec_id")
    ids = rows.distinct().withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(8)))
    ids = ids.withColumn("r", F.row_number().over(every)).where(F.col("r") <= top + 1)
    ids = ids.withColumn("r", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).where(F.col("r") <= top + 1)
    entries = written(ids.groupBy("v").agg(F.min("vec_id").alias("entry"), F.sort_array(F.collect_list("vec_id")).alias("ids")), "entries")
    # an id may carry several vectors, so entries get a key of their own
    entries = written(entries.orderBy("entry", "v").select(F.monotonically_increasing_id().alias("entry"), "ids", "v"), "entries")  # smaller ids, smaller key
    n = entries.count()
    if n == 0:
        return vectors.sparkSession.createDataFrame([], schema)
    x = np.array([r["v"] for r in hashed_sample(entries.select("v"), sample, "v").collect()])
    k = max(1, min(n // list_size, len(x) // 8))
    graph = CentroidGraph(train_centroids(x, k))
    placed = written(entries.select(F.col("entry").alias("vec_id"), "v").mapInArrow(_choose(graph, replicas, replica_ratio), "vec_id long, v array<double>, list int"), "lists")
    asked = rows.where(queries_where).withColumn("q", F.monotonically_increasing_id())
    asked = written(asked.select("q", "vec_id", "v"), "queries")
    lengths = placed.groupBy("list").count()  # a row a list, at most sample / 8
    held = np.zeros(k, np.int64)
    for r in lengths.collect():
        held[r["list"]] = r["count"]
    # an entry stands in `replicas` lists at most, so this many rows hold top + 1 entries
    need = replicas * (top + 1)
    reads = written(asked.select(F.col("q").alias("vec_id"), "v").mapInArrow(_choose(graph, max(1, int(np.ceil(probes * k**0.7))), ratio, held, need), "vec_id long, v array<double>, list int"), "reads")
    lengths = lengths.select("list", F.ceil(F.col("count") / block).cast("int").alias("parts"))
    askers = reads.groupBy("list").agg(F.ceil(F.count("*") / block).cast("int").alias("qparts"))
    cut = F.broadcast(written(lengths.join(askers, "list"), "cut"))  # one row a list, at most sample / 8
    left = placed.join(cut, "list").select("list", F.pmod(F.xxhash64("vec_id"), "parts").cast("int").alias("part"), F.explode(F.sequence(F.lit(0), F.col("qparts") - 1)).alias("qpart"), "vec_id", "v", F.lit(False).alias("query"))
    right = reads.join(cut, "list").select("list", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.pmod(F.xxhash64("vec_id"), "qparts").cast("int").alias("qpart"), "vec_id", "v", F.lit(True).alias("query"))
    cells = left.unionByName(right).repartition("list", "part", "qpart").sortWithinPartitions("list", "part", "qpart")
    found = cells.mapInArrow(_compare(top), "query_id long, entry long, score double")
    found = found.groupBy("query_id", "entry").agg(F.min("score").alias("score"))
    found = found.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "entry"))).where(F.col("r") <= top + 1)
    named = found.join(asked.select(F.col("q").alias("query_id"), F.col("vec_id").alias("own"), F.col("v").alias("qv")), "query_id").join(entries.select("entry", "ids", F.col("v").alias("ev")), "entry")
    each = named.select("query_id", "own", F.explode("ids").alias("vec_id"), "score", (F.col("qv") == F.col("ev")).alias("same"))
    each = each.where(~((F.col("own") == F.col("vec_id")) & F.col("same")))
    best = each.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))).where(F.col("rank") <= top)
    return best.select(F.col("own").alias("query_id"), "rank", "vec_id", "score")

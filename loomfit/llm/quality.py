"""Quality classifier by co-training of a text view and a page-metadata view.

Each view has its own logistic regression. In each round a view labels the
unlabelled documents of which it is confident and hands them to the other view.
Each view is calibrated on labelled rows kept out of training, and a last
logistic regression combines the two calibrated views. Training runs in one task
over at most ``sample`` labelled and as many unlabelled rows (features of
fixed width); every document is then scored in one pass without a shuffle.

Defined results: a null or empty text has all-zero text features; null metadata
is a value of its own; label rows with a null label are ignored and repeated
ones count as their largest; without labels of both kinds every document gets
the share of good labels (1 if there is none); an empty table gives an empty
result; extra columns pass through ``keep_good``.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hashed_sample, lean, small_batches

TEXT_WIDTH, META_WIDTH = 262, 160
_GOOD = frozenset(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789 .,;:'-\n") | frozenset(range(128, 256))


def text_features(text: str | None) -> np.ndarray:
    out = np.zeros(TEXT_WIDTH, np.float32)
    raw = text.encode("utf-8", "surrogatepass") if text else b""
    if not raw:
        return out
    count = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    out[:256] = np.sqrt(count / len(raw))
    w = raw.split()
    lines = raw.split(b"\n")
    odd = sum(int(count[c]) for c in range(256) if c not in _GOOD)
    out[256:] = (odd / len(raw), len(set(w)) / max(1, len(w)), len(raw) / max(1, len(w)) / 10, np.log1p(len(w)) / 10, len(set(lines)) / len(lines), len(w) / len(lines) / 100)
    return out


def meta_features(lang, source, n_chars) -> np.ndarray:
    out = np.zeros(META_WIDTH, np.float32)
    h = lambda kind, v, n: zlib.crc32(f"{kind}={v}".encode("utf-8", "surrogatepass")) % n
    out[h("l", lang, 32)] = 1
    out[32 + h("s", source, 96)] = 1
    out[128 + (min(30, int(2 * np.log2(1 + max(0, n_chars)))) if n_chars is not None else 31)] = 1
    return out


class Logistic:
    def __init__(self, width: int):
        self.w, self.mean, self.scale = np.zeros(width + 1), np.zeros(width), np.ones(width)

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, ridge: float = 1.0, steps: int = 12) -> Logistic:
        x = np.asarray(x, float)
        self.mean, self.scale = x.mean(0), np.maximum(x.std(0), 1e-3)
        z = np.hstack([(x - self.mean) / self.scale, np.ones((len(x), 1))])
        weight = np.ones(len(x)) if weight is None else weight
        pull = np.full(z.shape[1], ridge)
        pull[-1] = 1e-6
        w = np.zeros(z.shape[1])
        for _ in range(steps):  # Newton steps
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            h = (z * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ z + np.diag(pull)
            step = np.linalg.solve(h, z.T @ (weight * (y - p)) - pull * w)
            w += np.clip(step, -3, 3)
            if np.abs(step).max() < 1e-6:
                break
        self.w = w
        return self

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.clip(((np.asarray(x, float) - self.mean) / self.scale) @ self.w[:-1] + self.w[-1], -30, 30)


class Model:
    """Two calibrated views and their combination; prior where nothing was learnt."""

    def __init__(self, prior: float, views=(), calibrations=(), last=None):
        self.prior, self.views, self.calibrations, self.last = prior, views, calibrations, last

    def scores(self, xs: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
        if not self.views:
            p = np.full(len(xs[0]), self.prior)
            return p, [p, p]
        z = [c.logit(v.logit(x)[:, None]) for v, c, x in zip(self.views, self.calibrations, xs)]
        return 1 / (1 + np.exp(-self.last.logit(np.stack(z, 1)))), [1 / (1 + np.exp(-q)) for q in z]


def co_train(x: list[np.ndarray], y: np.ndarray, pool: list[np.ndarray], rounds: int = 4, confident: float = 0.97, share: float = 0.1) -> Model:
    """x: the two views of labelled rows; pool: those of unlabelled ones."""
    if len(y) == 0 or y.min() == y.max() or len(y) < 20:
        return Model(float(y.mean()) if len(y) else 1.0)
    held = np.arange(len(y)) % 5 == 0
    if len(set(y[held])) < 2 or len(set(y[~held])) < 2:
        held = np.zeros(len(y), bool)
    fit, check = (~held, held) if held.any() else (~held, ~held)
    views: list[Logistic] = [Logistic(v.shape[1]) for v in x]
    given: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0, int), np.empty(0)) for _ in x]  # what the other view has labelled
    for r in range(rounds + 1):
        for v in (0, 1):
            at, label = given[v]
            xs, ys = np.vstack([x[v][fit], pool[v][at]]), np.concatenate([y[fit], label])
            views[v].fit(xs, ys, np.concatenate([np.ones(fit.sum()), np.full(len(at), 0.3)]))
        if r == rounds or not len(pool[0]):
            break
        most = max(1, int(share * (r + 1) * len(pool[0])))
        for v in (0, 1):
            p = 1 / (1 + np.exp(-views[v].logit(pool[v])))
            sure = np.flatnonzero(np.maximum(p, 1 - p) >= confident)
            sure = sure[np.argsort(-np.abs(p[sure] - 0.5), kind="stable")[:most]]
            given[1 - v] = (sure, (p[sure] > 0.5).astype(float))
    calibrations = [Logistic(1).fit(views[v].logit(x[v][check])[:, None], y[check], ridge=0.1) for v in (0, 1)]
    z = np.stack([calibrations[v].logit(views[v].logit(x[v][check])[:, None]) for v in (0, 1)], 1)
    return Model(float(y.mean()), views, calibrations, Logistic(2).fit(z, y[check], ridge=0.1))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        t = [text_features(x).tobytes() for x in b.column("text").to_pylist()]
        m = [meta_features(*x).tobytes() for x in zip(*(b.column(c).to_pylist() for c in ("lang", "source", "n_chars")))]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("quality"), pa.array(t, pa.binary()), pa.array(m, pa.binary())], ["doc_id", "quality", "t", "m"])


def _views(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), F.col("n_chars").cast("long").alias("n_chars"))


def train(docs: DataFrame, labels: DataFrame, sample: int = 8000) -> Model:
    small_batches(docs.sparkSession)
    marks = labels.where("quality is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").cast("double").alias("quality"))
    marks = hashed_sample(marks, sample, "doc_id")
    # rows of two numbers, at most 2 * sample of them: safe to broadcast
    pool = docs.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct()
    pool = hashed_sample(pool, sample, "doc_id", seed=3)
    asked = marks.unionByName(pool.withColumn("quality", F.lit(None).cast("double"))).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    got = _views(docs).join(F.broadcast(asked), "doc_id").mapInArrow(lean(_features), "doc_id long, quality double, t binary, m binary")
    # one row a doc_id, however many rows share it
    got = got.groupBy("doc_id").agg(F.max("quality").alias("quality"), F.min(F.struct("t", "m")).alias("f")).select("doc_id", "quality", "f.t", "f.m")
    # the bounded sample is trained on in one task, so the driver only gets the model
    return pickle.loads(got.repartition(1).mapInArrow(lean(_trained), "model binary").first()[0])


def _trained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("quality", pa.float64()), ("t", pa.binary()), ("m", pa.binary())])
    got = pa.Table.from_batches([b.cast(schema) for b in batches], schema).sort_by([("doc_id", "ascending"), ("t", "ascending")])
    y = got.column("quality").to_numpy().astype(float)
    x = [np.frombuffer(b"".join(got.column(c).to_pylist()), np.float32).reshape(-1, n) for c, n in (("t", TEXT_WIDTH), ("m", META_WIDTH))]
    del got
    known = ~np.isnan(y)
    model = co_train([v[known] for v in x], y[known], [v[~known] for v in x])
    yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])


def _score(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 1024):
                part = b.slice(lo, 1024)
                t = np.stack([text_features(x) for x in part.column("text").to_pylist()])
                m = np.stack([meta_features(*x) for x in zip(*(part.column(c).to_pylist() for c in ("lang", "source", "n_chars")))])
                p, (pt, pm) = model.scores([t, m])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(p), pa.array(pt), pa.array(pm)], ["doc_id", "score", "text_score", "meta_score"])

    return run


def quality_scores(docs: DataFrame, labels: DataFrame, sample: int = 8000, reject: float = 0.5) -> DataFrame:
    """(doc_id, score, text_score, meta_score, kept), a row for each row of docs."""
    model = train(docs, labels, sample)
    out = _views(docs).mapInArrow(lean(_score(model)), "doc_id long, score double, text_score double, meta_score double")
    return out.withColumn("kept", F.col("score") >= reject)


def keep_good(docs: DataFrame, labels: DataFrame, sample: int = 8000, reject: float = 0.5) -> DataFrame:
    """The rows of docs that the classifier does not reject, all columns as they are."""
    model = train(docs, labels, sample)
    names = docs.columns
    packed = docs.select(*[F.col(f"`{c}`") for c in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 1024):
                part = b.slice(lo, 1024)
                t = np.stack([text_features(x) for x in part.column("text").to_pylist()])
                m = np.stack([meta_features(*x) for x in zip(*(part.column(c).to_pylist() for c in ("lang", "source", "n_chars")))])
                yield part.filter(pa.array(model.scores([t, m])[0] >= reject))

    return packed.mapInArrow(lean(run), packed.schema)

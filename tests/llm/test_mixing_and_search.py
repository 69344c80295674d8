import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomfit.llm import ann, mixing
from loomfit.llm.queries import QUERIES

from . import cases

# --- mixing


def water(sizes, weights, most=3):
    """Targets by repeated sharing of the excess."""
    total, open_ = float(sum(sizes)), list(range(len(sizes)))
    target = [0.0] * len(sizes)
    while open_:
        left = total - sum(target[i] for i in range(len(sizes)) if i not in open_)
        level = left / sum(weights[i] for i in open_)
        full = [i for i in open_ if weights[i] * level > most * sizes[i]]
        for i in open_:
            target[i] = most * sizes[i] if i in full else weights[i] * level
        if not full:
            break
        open_ = [i for i in open_ if i not in full]
    return target


def check_mix(rows, out):
    by_source = {}
    for i, text, source in rows:
        by_source.setdefault(source, 0)
        by_source[source] += len(cases.words(text))
    names = sorted((s for s in by_source if s is not None)) + [None] * (None in by_source)
    sizes = [by_source[s] for s in names]
    want = dict(zip(names, water(sizes, [(1, 2, 3)[i % 3] for i in range(len(names))])))
    taken = dict.fromkeys(names, 0)
    for r in out:
        assert r.source_size == by_source[r.source] and r.target == pytest.approx(want[r.source])
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
        if r.taken:
            assert all(0 <= p <= 1 for p in r.positions) and len(r.positions) >= -(-r.taken // r.size)
    assert all(abs(taken[s] - want[s]) <= 0.5 for s in names)


def test_mix_against_repeated_sharing(spark):
    rng = random.Random(7)
    rows = [(i, cases.prose(rng, rng.randrange(0, 60)), rng.choice(["hot"] * 6 + ["b", "a", "Z", None, "é"])) for i in range(400)]
    rows += [(None, "x y z", "b"), (3, "again", "hot"), (3, "again", "hot"), (900, None, "empty"), (901, "", "empty")]
    check_mix(rows, mixing.mix_sources(cases.docs(spark, rows)).collect())


def test_small_sources_stop_at_three_passes(spark):
    rows = [(i, "a b c d", "a") for i in range(50)] + [(100 + i, "p q", s) for i, s in enumerate("bcd")]
    check_mix(rows, mixing.mix_sources(cases.docs(spark, rows)).collect())


def test_mix_edges_and_reruns(spark):
    assert mixing.mix_sources(cases.docs(spark, [])).collect() == []
    nothing = mixing.mix_sources(cases.docs(spark, [(1, None), (2, "")])).collect()
    assert [(r.size, r.target, r.taken) for r in nothing] == [(0, 0.0, 0)] * 2
    d = cases.docs(spark, [(i, cases.prose(random.Random(i), i % 17), f"s{i % 4}") for i in range(200)])
    a, b = (sorted((r.doc_id, r.taken, tuple(r.positions or ())) for r in mixing.mix_sources(x).collect()) for x in (d, d.repartition(7)))
    assert a == b


def test_positions_follow_the_schedule(spark):
    """An early source is used up with falling density, a late one with rising."""
    rows = [(i, "w " * 5, "abc"[i % 3]) for i in range(1500)]
    order = mixing.training_order(mixing.mix_sources(cases.docs(spark, rows)))
    got = {s: np.sort([r.position for r in order.where(F.col("source") == s).collect()]) for s in "abc"}
    n = {s: len(v) for s, v in got.items()}
    assert np.allclose(got["a"], 1 - np.sqrt(1 - np.arange(n["a"]) / n["a"]), atol=0.02)
    assert np.allclose(got["b"], np.arange(n["b"]) / n["b"], atol=0.02)
    assert np.allclose(got["c"], np.sqrt(np.arange(n["c"]) / n["c"]), atol=0.02)
    at = [r.position for r in order.collect()]
    assert at == sorted(at)


def test_inverse_of_a_broken_line(spark):
    knots = ((0.0, 1.0), (0.5, 3.0), (1.0, 0.0))
    u = np.linspace(0, 0.999, 50)
    t = [r[0] for r in spark.createDataFrame([(float(v),) for v in u], "u double").select(mixing.when_demanded(F.col("u"), knots)).collect()]
    grid = np.linspace(0, 1, 200001)
    w = np.interp(grid, *zip(*knots))
    cum = np.concatenate([[0], np.cumsum((w[1:] + w[:-1]) / 2)])
    assert np.allclose(t, np.interp(u, cum / cum[-1], grid), atol=1e-4)
    with pytest.raises(ValueError):
        mixing.when_demanded(F.lit(0.1), ((0.0, 0.0), (1.0, 0.0)))


# --- nearest neighbours


def vectors(spark, v, ids=None):
    return spark.createDataFrame([(int(i), None if x is None else [None if c is None else float(c) for c in x]) for i, x in zip(ids if ids is not None else range(len(v)), v)], "vec_id long, embedding array<double>").withColumn("list", F.lit("x")).withColumn("v", F.lit(0))


def exact(v, queries, top=10):
    v = np.asarray(v)
    out = {}
    for q in queries:
        d = np.sqrt(((v - v[q]) ** 2).sum(1))
        near = [i for i in np.lexsort((np.arange(len(v)), d)) if i != q][:top]
        out[q] = [(i, d[i]) for i in near]
    return out


def test_recall_and_exact_scores(spark):
    rng = np.random.default_rng(0)
    v = rng.normal(size=(40, 16))[rng.integers(0, 40, 3000)] + 0.4 * rng.normal(size=(3000, 16))
    out = ann.nearest(vectors(spark, v), F.col("vec_id") % 100 == 0).collect()
    want = exact(v, range(0, 3000, 100))
    hit = 0
    for q, near in want.items():
        got = sorted((r.rank, r.vec_id, r.score) for r in out if r.query_id == q)
        assert [r[0] for r in got] == list(range(1, 11)) and q not in {r[1] for r in got}
        assert all(s == pytest.approx(float(np.sqrt(((v[q] - v[i]) ** 2).sum())), rel=1e-12) for _, i, s in got)
        assert [r[2] for r in got] == sorted(r[2] for r in got)
        hit += len({r[1] for r in got} & {i for i, _ in near})
    assert hit / (10 * len(want)) >= 0.9


def test_recall_over_hundreds_of_lists(spark):
    """Tight groups of many sizes: few lists are read, and each query has all its rows."""
    rng = np.random.default_rng(3)
    of = np.concatenate([np.arange(60), rng.choice(60, 25540, p=np.arange(1, 61) ** 2 / np.sum(np.arange(1, 61) ** 2))])
    v = rng.normal(size=(60, 16))[of] + 0.02 * rng.normal(size=(25600, 16))
    out = ann.nearest(vectors(spark, v), F.col("vec_id") % 200 == 0, list_size=64).collect()  # 400 lists
    want = exact(v, range(0, 25600, 200))
    found = {q: {r.vec_id for r in out if r.query_id == q} for q in want}
    share = [len(found[q] & {i for i, _ in near}) / 10 for q, near in want.items()]
    assert all(len(f) == 10 for f in found.values()) and np.mean(share) >= 0.9 and min(share) >= 0.5


def test_short_lists_are_filled_up(spark):
    v = np.vstack([np.eye(8) * (i + 1) for i in range(4)])  # lists of one or two rows
    out = ann.nearest(vectors(spark, v), F.col("vec_id") % 10 == 0, list_size=1, ratio=1.0, probes=0.1, replicas=1).collect()
    assert {q: sum(r.query_id == q for r in out) for q in (0, 10, 20, 30)} == {0: 10, 10: 10, 20: 10, 30: 10}


def test_copies_ties_and_vectors_that_take_no_part(spark):
    good = [[1.0, 0.0]] * 40 + [[0.0, 1.0], [3.0, 0.0], [0.0, 2.0]]
    bad = [None, [], [0.0, 0.0], [1.0, None], [float("nan"), 1.0], [float("inf"), 1.0], [1.0, 2.0, 3.0]]
    out = ann.nearest(vectors(spark, good + bad), F.col("vec_id").isin(0, 25, 42, 43, 45)).collect()
    by = {q: [(r.vec_id, round(r.score, 6)) for r in sorted(out, key=lambda r: r.rank) if r.query_id == q] for q in {r.query_id for r in out}}
    assert set(by) == {0, 25, 42}
    assert by[0] == [(i, 0.0) for i in range(1, 11)] and by[25] == [(i, 0.0) for i in range(10)]
    assert by[42][0] == (40, 1.0) and [i for i, _ in by[42][1:]] == list(range(9))


def test_fewer_candidates_and_empty_tables(spark):
    out = ann.nearest(vectors(spark, [[1.0], [2.0], [4.0]]), F.col("vec_id") == 0).collect()
    assert [(r.rank, r.vec_id, r.score) for r in sorted(out)] == [(1, 1, 1.0), (2, 2, 3.0)]
    assert ann.nearest(vectors(spark, [[1.0]]), F.col("vec_id") == 0).collect() == []
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert ann.nearest(empty, F.col("vec_id") == 0).collect() == []


def test_an_id_with_two_vectors(spark):
    out = ann.nearest(vectors(spark, [[1.0, 1.0], [1.0, 1.0], [2.0, 1.0], [2.0, 1.0]], [0, 0, 0, 5]), F.col("vec_id") == 0).collect()
    assert all(r.vec_id in (0, 5) for r in out) and any(r.vec_id == 0 and r.score == 1 for r in out)


def test_graph_search_finds_the_nearest_lists():
    rng = np.random.default_rng(2)
    c = rng.normal(size=(300, 8))
    graph = ann.CentroidGraph(c)
    q = rng.normal(size=(50, 8))
    ids, d = graph.search(q, 5)
    want = np.argsort(((q[:, None] - c) ** 2).sum(2), 1)[:, :5]
    assert np.mean([len(set(a) & set(b)) / 5 for a, b in zip(ids, want)]) > 0.9 and (np.diff(d, axis=1) >= 0).all()


def test_balance_evens_out_lists():
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(size=(900, 4)) * 0.05, rng.normal(size=(100, 4)) * 3])
    c = ann.train_centroids(x, 20)
    assert c.shape == (20, 4) and np.bincount(ann.distances(x, c).argmin(1), minlength=20).max() < 150
    assert ann.train_centroids(np.zeros((3, 2)), 3).shape == (3, 2)


# --- registered queries


def test_every_dealt_operator_is_registered():
    assert sorted(int(q[2:].split("_")[0]) for q in QUERIES) == list(range(1, 11))

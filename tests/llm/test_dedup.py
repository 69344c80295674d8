import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomfit.llm import lines as ln
from loomfit.llm import neardup as nd
from loomfit.llm import substrings as sb
from loomfit.llm.common import components
from loomfit.llm.shingles import WordHashes, windows

from . import cases


def key(r):
    return str(tuple(r))


@pytest.mark.parametrize("k", [4, 5])
def test_near_duplicates_equal_brute_force(spark, k):
    rows = [r for r in cases.awkward() if r[0] is not None]
    got = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in nd.near_duplicates(cases.docs(spark, rows), k=k).collect()}
    want = {(i, n, c, i == c) for i, (n, c) in cases.near_duplicates(rows, k).items()}
    assert got == want


def test_near_duplicates_of_rows_without_id(spark):
    rows = [(None, "a b c d e f"), (None, "a b c d e f"), (3, "a b c d e f")]
    out = nd.near_duplicates(cases.docs(spark, rows)).collect()
    assert sorted((str(r.doc_id), str(r.component_id), r.kept) for r in out) == [("3", "3", True), ("None", "None", True), ("None", "None", True)]
    assert nd.near_duplicates(cases.docs(spark, [])).collect() == []


def test_a_large_group_of_near_copies(spark):
    """A third of all rows are variants of one text; copies differ more from each other than from it."""
    rng = random.Random(2)
    base = [f"w{rng.randrange(10**6)}" for _ in range(200)]
    rows = [(i, cases.prose(rng, 60, 10**6)) for i in range(1000, 1400)]
    for i in range(200):
        w = list(base)
        for _ in range(3 if i else 0):
            w[rng.randrange(200)] = f"v{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    got = {r.doc_id: r.component_id for r in nd.near_duplicates(cases.docs(spark, rows), k=4, block=16).collect()}
    assert got == {i: c for i, (_, c) in cases.near_duplicates(rows, 4).items()}


def test_a_chain_is_one_component(spark):
    """Each text is like the next one only."""
    rng = random.Random(3)
    w = [f"w{i}" for i in range(100)]
    rows = []
    for i in range(40):
        rows.append((i, " ".join(w)))
        w = list(w)
        w[rng.randrange(100)] = f"n{i}"
    got = {r.doc_id: r.component_id for r in nd.near_duplicates(cases.docs(spark, rows), k=4).collect()}
    assert got == {i: c for i, (_, c) in cases.near_duplicates(rows, 4).items()}


def test_pruning_misses_no_more_than_asked():
    """The bound drops pairs of similarity 0.8 about as rarely as the miss probability."""
    rng = np.random.default_rng(0)
    steps = nd.least_matches(0.8, 1e-6)
    same = rng.random((100_000, nd.HASHES)) < 0.8
    a = np.zeros(same.shape, np.uint32)
    assert len(nd.likely(a, (~same).astype(np.uint32), steps)) >= 99_990
    far = rng.random((10_000, nd.HASHES)) < 0.2
    assert len(nd.likely(a[:10_000], (~far).astype(np.uint32), steps)) < 10


def test_components_against_union_find(spark):
    rng = random.Random(1)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 460)]
    label = {v: v for p in pairs for v in p}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for a, b in pairs:
        x, y = root(a), root(b)
        label[max(x, y)] = min(x, y)
    got = {r.id: r.component_id for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {i: root(i) for p in pairs if p[0] != p[1] for i in p}


def test_window_hashes_agree_wherever_they_stand():
    w = [bytes([65 + i % 7]) for i in range(60)] + [b"x"] * 40
    h = WordHashes().of(w)
    for size in (1, 4, 5, 20, 50):
        got = windows(h, size)
        want: dict = {}
        for i in range(len(w) - size + 1):
            assert want.setdefault(tuple(w[i : i + size]), got[i]) == got[i]
        assert len(set(want.values())) == len(want)
    assert len(windows(h[:3], 4)) == 0


def test_substrings_equal_brute_force(spark):
    rows = cases.awkward()
    got = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in sb.drop_repeats(cases.docs(spark, rows)).collect()), key=key)
    assert got == sorted(cases.drop_repeats(rows), key=key)
    assert sb.drop_repeats(cases.docs(spark, [])).collect() == []


def test_substrings_of_smaller_windows_and_kept_texts(spark):
    rng = random.Random(9)
    part = cases.prose(rng, 45)
    rows = [(i, f"{cases.prose(rng, rng.randrange(0, 60))} {part} {cases.prose(rng, 20)}") for i in range(30)] + [(99, "p q " * 100)]
    out = sb.drop_repeats(cases.docs(spark, rows), size=34).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in out), key=key) == sorted(cases.drop_repeats(rows, 34), key=key)
    assert all(hashlib.sha256(r.kept.encode()).hexdigest() == r.kept_sha256 for r in out)
    with pytest.raises(ValueError):
        sb.drop_repeats(cases.docs(spark, rows), size=20)


def test_a_text_and_a_passage_that_many_documents_hold(spark):
    rng = random.Random(4)
    whole, part = cases.prose(rng, 70), cases.prose(rng, 55)
    rows = [(i, whole if i % 3 == 0 else f"{cases.prose(rng, 9)} {part} {cases.prose(rng, 9)}") for i in rng.sample(range(-400, 400), 300)]
    out = sb.drop_repeats(cases.docs(spark, rows), keep_text=False)
    got = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in out.collect()), key=key)
    assert got == sorted(cases.drop_repeats(rows), key=key)
    shares = {tuple(r) for r in sb._each_spot(spark.range(130).selectExpr("id % 2 as h", "cast(id % 64 as tinyint) as s").groupBy("h").agg(sb._spots())).collect()}
    assert shares == {(i % 2, i % 64) for i in range(130)}


def test_every_shift_shares_an_anchor():
    """Two equal windows, at any two places, share an aligned anchor."""
    held = [set(np.flatnonzero(sb._IN_COVER[(np.arange(sb.PERIOD) + p) % sb.PERIOD])) for p in range(sb.PERIOD)]
    assert all(a & b for a in held for b in held)


def test_lines_equal_brute_force(spark):
    rows = cases.awkward()
    out = ln.drop_lines(cases.docs(spark, rows))
    got = sorted(((r.doc_id, r._n_lines, r._n_dropped, hashlib.sha256((r._text or "").encode()).hexdigest()) for r in out.collect()), key=key)
    assert got == sorted(cases.drop_lines(rows), key=key)
    assert out.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"]
    assert ln.drop_lines(cases.docs(spark, [])).collect() == []


def test_lines_of_rows_with_any_column_names(spark):
    rows = cases.awkward()
    names = ["_kept", "_lost", "_doc", "lost", "kept", "part", "row", "n_lines", "h", "a.b"]
    docs = cases.docs(spark, rows).select("doc_id", "text", "source", *[F.lit(1).alias(c) for c in names])
    out = ln.drop_lines(docs)
    assert out.columns == ["doc_id", "text", "source", *names, "_text", "_n_lines", "_n_dropped"] and out.count() == len(rows)
    with pytest.raises(ValueError):
        ln.drop_lines(out)
    again = ln.cut_lines(out)
    assert again.columns == ["row", "text", "n_lines", "n_dropped"] and again.count() == len(rows)


def test_runs_are_compacted_and_merged(spark):
    store = ln.LineRuns(fanout=2)
    lines = [f"line number {i} of the whole corpus" for i in range(6)]
    seen = 0
    for b in range(5):
        batch = cases.docs(spark, [(10 * b + j, "\n".join(lines[: b + 1])) for j in range(2)])
        fresh = ln.dedup_increment(batch, store)
        assert fresh.select("h", "g").distinct().count() == 1 and fresh.count() == 2  # one new line, in two documents
        seen += 1
    assert len(store.runs()) == 2 and set(k for k, v in store.levels.items() if v) == {0, 2}
    total = {r.n_docs: r.last_doc for r in store.total().collect()}
    assert total == {2 * (5 - b): 41 for b in range(5)}


def test_the_same_lines_under_any_number_of_batches(spark):
    rows = cases.awkward()
    a, b = (ln.drop_lines(cases.docs(spark, rows), batches=n).agg(F.sum(F.xxhash64("doc_id", "_text", "_n_dropped").cast("decimal(38,0)"))).first()[0] for n in (1, 7))
    assert a == b


def test_each_batch_of_lines_is_anti_joined_against_the_runs(spark, monkeypatch):
    line = "a line that several documents share"
    rows = [(i, f"{line}\nline of document {i} alone, number {i}") for i in range(40)]
    asked, plain = [], ln.LineRuns.unseen

    def unseen(self, keys):
        asked.append((len(self.runs()), plain(self, keys)))
        return asked[-1][1]

    monkeypatch.setattr(ln.LineRuns, "unseen", unseen)
    out = {r.doc_id: r._n_dropped for r in ln.drop_lines(cases.docs(spark, rows)).collect()}
    assert out == {i: int(i < 39) for i in range(40)}
    assert [n for n, _ in asked] == [0, 1, 2, 3]
    owners = [[r.last_doc for r in f.collect()] for _, f in asked]
    assert sorted(sum(owners, [])) == [*range(39), 39, 39]  # each key in one batch only, the shared one in the first
    assert all(min(a) > max(b) for a, b in zip(owners, owners[1:]))

import math
import pickle
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomfit.llm import common, lm, quality, toxicity

from . import cases


def near(a, b):
    return a == pytest.approx(b, rel=1e-9, abs=1e-9)


# --- language model


def base_scores(rows):
    c = Counter(t for i, text, *_ in rows if cases.crc(i, 10) for t in lm.tokens(text))
    n, v = sum(c.values()), len(c)
    return {(i, text): (len(t := lm.tokens(text)), sum(x in c for x in t), n, sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in t)) for i, text, *_ in rows}


def test_scores_against_plain_counts(spark):
    rows = cases.awkward()
    out = lm.lm_scores(cases.docs(spark, rows)).collect()
    want = base_scores(rows)
    assert len(out) == len(rows)
    by_id = {i: t for i, t in rows if i not in (50, None)}
    for r in out:
        if r.doc_id in by_id:
            n, known, total, base = want[r.doc_id, by_id[r.doc_id]]
            assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, total) and near(r.base_score, base)
            assert r.held_out == (cases.crc(r.doc_id, 10) == 0)
            assert r.score < 0 and math.isfinite(r.score)
    assert lm.lm_scores(cases.docs(spark, [])).collect() == []


def test_a_model_of_order_three_beats_words(spark):
    rng = random.Random(4)
    step = {f"w{i}": [f"w{rng.randrange(200)}" for _ in range(3)] for i in range(200)}
    rows = []
    for i in range(300):
        w = ["w0"]
        for _ in range(60):
            w.append(rng.choice(step[w[-1]]))
        rows.append((i, " ".join(w)))
    out = lm.lm_scores(cases.docs(spark, rows)).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert out[0] > out[1] + 1000


def test_probabilities_of_a_context_add_up_to_one_at_most():
    texts = [["<s>", *lm.tokens(cases.prose(random.Random(i), 40, 12))] for i in range(40)]
    names = sorted({w for t in texts for w in t[1:]})
    ids = {w: i for i, w in enumerate(names)} | {"<s>": len(names)}
    m = len(ids)
    runs = [[ids[w] for w in t] for t in texts]
    counts = np.bincount([w for r in runs for w in r], minlength=m).astype(float)
    mass = counts[: m - 1].sum() + 0.1 * m
    pairs, c2 = np.unique([u * m + w for r in runs for u, w in zip(r, r[1:])], return_counts=True)
    at = {p: i for i, p in enumerate(pairs.tolist())}
    triples, c3 = np.unique([at[t * m + u] * m + w for r in runs for t, u, w in zip(r, r[1:], r[2:])], return_counts=True)
    trie = lm.Trie.mapped(lm.build_trie(counts, mass, m, (pairs, c2), (triples, c3)).to_bytes())
    w = np.arange(m - 1)
    log1 = np.log10((counts[w] + 0.1) / mass)
    for t, u in [(-1, m - 1), (m - 1, 0), (0, 1), (1, 0), (3, 4)]:
        ctx = trie.levels[0].find(np.array([t]), np.array([u])) if t >= 0 else np.array([-1])
        _, p2 = trie.pairs(np.full(len(w), u), w, log1)
        p = 10 ** trie.given(np.repeat(ctx, len(w)), w, p2)
        assert 0.9 < p.sum() <= 1 + 1e-9


def test_elias_fano_finds_every_value():
    rng = np.random.default_rng(1)
    for n, top in ((0, 1), (1, 5), (1000, 1200), (1000, 10**7), (5000, 10**10)):
        v = np.sort(rng.choice(top, n, replace=n > top)) if n else np.empty(0, int)
        e = lm.EliasFano.of(v)
        assert (e.access(np.arange(n)) == v).all()
        if n:
            u = np.unique(v)
            e = lm.EliasFano.of(u)
            at = e.find(u, np.zeros(len(u), int), np.full(len(u), len(u)))
            assert (at == np.arange(len(u))).all()
            missing = np.setdiff1d(rng.integers(0, top, 200), u)
            assert (e.find(missing, np.zeros(len(missing), int), np.full(len(missing), len(u))) == -1).all()


def test_codes_round_down():
    p = np.array([1.0, 0.5, 1e-3, 1e-12])
    assert (10 ** lm.decoded(lm.coded(p)) <= p * (1 + 1e-9)).all()


# --- quality


def labelled(spark, n=600, seed=1):
    rng = random.Random(seed)
    rows, marks = [], []
    for i in range(n):
        good = i % 3 > 0
        text = cases.prose(rng, rng.randrange(20, 80)) + "." if good else "".join(rng.choice("#$%&*@{}[]<>|~^") for _ in range(rng.randrange(40, 300)))
        rows.append((i, text, "books" if good and rng.random() < 0.9 else "dump"))
        if i % 2:
            marks.append((i, int(good)))
    return cases.docs(spark, rows), spark.createDataFrame(marks, "doc_id long, quality int"), rows


def test_quality_on_held_out_rows(spark):
    docs, labels, rows = labelled(spark)
    out = {r.doc_id: r for r in quality.quality_scores(docs, labels).collect()}
    right = [out[i].kept == (i % 3 > 0) for i, *_ in rows if i % 2 == 0]
    assert sum(right) / len(right) > 0.97
    assert all(0 <= v <= 1 for r in out.values() for v in (r.score, r.text_score, r.meta_score))
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.select("doc_id").collect()} == {i for i, r in out.items() if r.kept}


def test_quality_edges(spark):
    docs, labels, _ = labelled(spark, 60)
    odd = cases.docs(spark, cases.awkward())
    assert quality.quality_scores(odd, labels).count() == len(cases.awkward())  # no label of these rows is known
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in quality.quality_scores(odd, none).collect()} == {1.0}
    assert quality.keep_good(odd, none).count() == odd.count()
    one = spark.createDataFrame([(1, 0), (1, None), (None, 1)], "doc_id long, quality int")
    assert {r.score for r in quality.quality_scores(odd, one).collect()} == {0.0}
    assert quality.quality_scores(cases.docs(spark, []), labels).collect() == []


def test_views_teach_each_other():
    """Few labels, two views: co-training beats the text view trained alone."""
    rng = np.random.default_rng(0)
    y = rng.integers(0, 2, 3000).astype(float)
    views = [np.where(y[:, None] > 0, 1.0, -1.0) * 0.35 + rng.normal(size=(3000, 12)) for _ in range(2)]
    model = quality.co_train([v[:60] for v in views], y[:60], [v[60:2000] for v in views], confident=0.9, share=0.3)
    p, parts = model.scores([v[2000:] for v in views])
    alone = quality.Logistic(12).fit(views[0][:60], y[:60]).logit(views[0][2000:]) > 0
    assert ((p > 0.5) == y[2000:]).mean() > (alone == y[2000:]).mean()


# --- toxicity


def toxic_docs(spark, n=500, seed=2):
    rng = random.Random(seed)
    rows, marks = [], []
    for i in range(n):
        bad = i % 4 == 0
        w = cases.prose(rng, 40).split()
        if bad:
            for _ in range(4):
                w[rng.randrange(40)] = rng.choice(["vile", "scum", "rotten", "wretch"])
        rows.append((i, " ".join(w)))
        marks.append((i, int(bad)))
    return cases.docs(spark, rows), spark.createDataFrame(marks, "doc_id long, toxic int")


def test_toxicity_on_held_out_rows(spark):
    docs, labels = toxic_docs(spark)
    out = toxicity.toxicity_scores(docs, labels).collect()
    held = [r for r in out if r.held_out]
    assert len(out) == 500 and all(r.held_out == (cases.crc(r.doc_id, 5) == 0) for r in out)
    assert sum(r.predicted == (r.doc_id % 4 == 0) for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in out)


def test_labels_of_held_out_rows_never_count(spark):
    docs, labels = toxic_docs(spark)
    lied = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (sorted((r.doc_id, r.score) for r in toxicity.toxicity_scores(docs, m).collect()) for m in (labels, lied))
    assert a == b


def test_toxicity_edges(spark):
    _, labels = toxic_docs(spark, 60)
    odd = cases.docs(spark, cases.awkward())
    out = toxicity.toxicity_scores(odd, labels).collect()
    assert len(out) == len(cases.awkward()) and all(0 <= r.score <= 1 for r in out)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.score for r in toxicity.toxicity_scores(odd, none).collect()} == {0.0}
    same = spark.createDataFrame([(6, 1), (7, 1), (6, None), (None, 0)], "doc_id long, toxic int")
    assert all(0 <= r.score <= 1 for r in toxicity.toxicity_scores(odd, same).collect())
    assert toxicity.toxicity_scores(cases.docs(spark, []), labels).collect() == []


@pytest.mark.parametrize("many", [20, None, 10**6])
def test_block_max_search_is_exact(many):
    rng = np.random.default_rng(3)
    vectors = []
    for i in range(700):
        t = np.sort(rng.choice(60, rng.integers(1, 12), replace=False)) if i % 3 else np.array([i % 6, 50])  # a third are alike
        w = rng.random(len(t)) + 0.05
        vectors.append((t, (w / np.sqrt((w * w).sum())).astype(np.float32).astype(float)))
    index = pickle.loads(pickle.dumps(toxicity.BlockMaxIndex(vectors, 60, many)))
    dense = np.zeros((700, 60))
    for i, (t, w) in enumerate(vectors):
        dense[i, t] = w
    for i in range(0, 700, 7):
        cos = dense @ dense[i]
        cos[i] = 0
        at = np.flatnonzero(cos > 0)
        want = at[np.lexsort((at, -np.round(cos[at], 6)))][:10]
        got, score = index.nearest(*vectors[i], 10, skip=i)
        assert np.allclose(score, cos[want], atol=2e-6) and np.allclose(cos[got], cos[want], atol=2e-6)
    assert many != 20 or index.read[0] < index.read[1]  # blocks were passed over


def test_neighbours_are_those_of_brute_force_over_whole_texts(spark):
    docs, labels = toxic_docs(spark, 160)
    rows = [(r.doc_id, r.text) for r in docs.collect()] + [(900, None), (901, ""), (902, "no known term at all"), (903, "vile vile scum " * 400)]
    mark = {r.doc_id: r.toxic for r in labels.collect()}
    out = {r.doc_id: r for r in toxicity.toxicity_scores(cases.docs(spark, rows), labels).collect()}
    tf = {i: Counter(toxicity.terms_of(t)) for i, t in rows}
    seen = sorted(i for i in mark if cases.crc(i, 5))
    known = {w for i in seen for w in tf[i]}
    n, pos = len(seen), sum(mark[i] for i in seen)
    weight = {}
    for w in known:
        df = sum(w in c for c in tf.values())
        cells = {(a, b): sum((w in tf[i]) == a and mark[i] == b for i in seen) for a in (True, False) for b in (0, 1)}
        g = 2 * sum(c * math.log(c / ((cells[a, 0] + cells[a, 1]) * (pos if b else n - pos) / n)) for (a, b), c in cells.items() if c)
        g = max(g, 1e-3)
        weight[w] = (math.log((1 + len(rows)) / (1 + df)) + 1) * g * g / (g + toxicity.SHRINK)

    def unit(i):
        v = {w: (1 + math.log(c)) * weight[w] for w, c in tf[i].items() if w in weight}
        length = math.sqrt(sum(x * x for x in v.values()))
        return {w: x / length for w, x in v.items()}

    units = {i: unit(i) for i in seen}
    assert len(out) == len(rows)
    for i, _ in rows:
        q = unit(i)
        cos = sorted((sum(x * u.get(w, 0) for w, x in q.items()) for u in units.values()), reverse=True)[:3]
        assert out[i].cosines == pytest.approx([c for c in cos if c > 0], abs=5e-6), i
    assert out[903].predicted == 1 and out[900].evidence == [] and out[900].score == out[901].score


def test_equal_texts_with_different_labels_give_one_answer(spark):
    rows = [(i, f"same words here {i % 3}") for i in range(60)]
    labels = spark.createDataFrame([(i, int(i % 6 == 0)) for i in range(60)], "doc_id long, toxic int")
    a, b = (sorted((r.doc_id, r.score, tuple(r.evidence)) for r in toxicity.toxicity_scores(cases.docs(spark, rows).repartition(n), labels).collect()) for n in (1, 5))
    assert a == b


def test_isotonic_steps_rise():
    rng = np.random.default_rng(5)
    x = rng.random(300)
    at, p = toxicity.isotonic(x, (rng.random(300) < x).astype(float))
    assert (np.diff(at) > 0).all() and (p > 0).all() and (p < 1).all()


# --- bounded choices


def test_samples_by_hash_are_the_same_with_and_without_the_cut(spark):
    df = spark.range(20000).withColumnRenamed("id", "doc_id")
    got = [r.doc_id for r in common.hashed_sample(df, 300, "doc_id", seed=3).collect()]
    want = [r.doc_id for r in df.orderBy(F.xxhash64(F.lit(3), "doc_id"), "doc_id").limit(300).collect()]
    assert got == want
    assert common.hashed_sample(df.limit(5), 300, "doc_id").count() == 5
    assert common.hashed_sample(df.limit(0), 300, "doc_id").count() == 0


def test_top_levels_take_about_as_many_as_asked(spark):
    df = spark.createDataFrame([(f"k{i}", c) for i, c in enumerate([5] * 3 + [4] * 2 + [2] * 10 + [10**6, 3000])], "k string, c long")
    got = sorted(r.c for r in common.top_levels(df, "c", 7).collect())
    assert got == [4, 4, 5, 5, 5, 3000, 10**6]
    assert common.top_levels(df, "c", 100).count() == 17 and common.top_levels(df, "c", 0).count() == 0
    assert common.top_levels(df.limit(0), "c", 5).count() == 0
    flat = spark.range(70000).select("id", F.lit(1).alias("c"))  # one level that does not fit
    assert 64000 < common.top_levels(flat, "c", 65536).count() < 67000


def test_batch_bounds_only_shrink(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    old = spark.conf.get(key)
    try:
        for start, want in (("64m", str(4 << 20)), ("1m", "1m")):
            spark.conf.set(key, start)
            common.small_batches(spark)
            assert spark.conf.get(key) == want
    finally:
        spark.conf.set(key, old)


def test_the_whole_model_holds_every_ngram(spark):
    """Against plain counts; words of more than 64 bytes are in too."""
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choice(["a", "b", "c", "long" * 30, f"x{rng.randrange(60)}"]) for _ in range(rng.randrange(1, 60)))) for i in range(120)]
    rows += [(200, None), (201, ""), (202, rows[3][1]), (203, "never before seen words")]
    out = {r.doc_id: r for r in lm.lm_scores(cases.docs(spark, rows)).collect()}
    one, two, three, after, pair_after = Counter(), Counter(), Counter(), Counter(), Counter()
    for i, text in rows:
        w = lm.tokens(text)
        if cases.crc(i, 10):
            one.update(w)
            for t, u, x in zip([None, "<s>", *w], ["<s>", *w], w):
                two[u, x] += 1
                three[t, u, x] += 1
    total, d = sum(one.values()), 0.75
    mass = total + 0.1 * (len(one) + 1)
    pairs, triples = ({k: c for k, c in x.items() if c >= 2 and k[0] is not None} for x in (two, three))
    for (u, _), c in two.items():
        after[u] += c
    left1, left2 = Counter(), Counter()
    for (u, x), c in pairs.items():
        left1[u] += (c - d) / after[u]
    for (t, u, x), c in triples.items():
        left2[t, u] += (c - d) / two[t, u]

    def p(t, u, x):
        p2 = max(0, two[u, x] - d) / after[u] * ((u, x) in pairs) if after[u] else 0
        p2 += (1 - left1[u]) * (one[x] + 0.1) / mass
        return (three[t, u, x] - d) / two[t, u] + (1 - left2[t, u]) * p2 if (t, u, x) in triples else (1 - left2[t, u]) * p2

    assert len(out) == len(rows)
    for i, text in rows:
        w = lm.tokens(text)
        want = sum(math.log10(p(*x)) for x in zip([None, "<s>", *w], ["<s>", *w], w))
        assert out[i].score == pytest.approx(want, abs=0.002 * len(w)), i
        assert out[i].base_score == pytest.approx(sum(math.log10((one[x] + 0.1) / mass) for x in w), rel=1e-9)

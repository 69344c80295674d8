import base64
import hashlib
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from loomfit.llm import queries as q
from loomfit.llm.common import read
from loomfit.llm.quality import quality_scores

from ..oracle import assert_same, connect
from . import cases

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def rows():
    return duckdb.sql(f"select doc_id, text, source from '{SF}/documents.parquet'").fetchall()


@pytest.mark.parametrize("name", sorted(q.ORACLES))
def test_queries_match_their_sql(spark, name):
    assert_same(q.QUERIES[name](spark, SF), connect(SF), q.ORACLES[name])


def test_op3_against_the_library(spark, rows):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = set()
    for i, text, _ in rows:
        ids = enc.encode_ordinary(text or "")
        want.add((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert {tuple(r) for r in q.op3_bpe(spark, SF).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()} == want


def test_op2_recall_on_the_given_vectors(spark):
    v = np.array([r[0] for r in duckdb.sql(f"select embedding from '{SF}/embeddings.parquet' order by vec_id").fetchall()], float)
    out = q.op2_nearest(spark, SF).collect()
    hit = total = 0
    for i in range(0, len(v), 100):
        d = ((v - v[i]) ** 2).sum(1)
        near = [j for j in np.argsort(d, kind="stable") if j != i][:10]
        hit += len(set(near) & {r.vec_id for r in out if r.query_id == i})
        total += 10
    assert hit / total >= 0.9


def test_op6_and_op10_on_held_out_labels(spark):
    labels = {r[0]: r[1:] for r in duckdb.sql(f"select doc_id, quality, toxic from '{SF}/labels.parquet'").fetchall()}
    tox = {r.doc_id: r for r in q.op10_toxicity(spark, SF).collect()}
    held = [i for i in labels if i in tox and tox[i].held_out]
    assert sum(tox[i].predicted == labels[i][1] for i in held) / len(held) > 0.9
    assert q.op6_quality(spark, SF).count() == len(tox)
    docs, marks = read(spark, SF, "documents"), read(spark, SF, "labels")
    good = {r.doc_id: r.kept for r in quality_scores(docs, marks.where("crc32(cast(doc_id as string)) % 2 = 0")).collect()}
    known = [i for i in labels if i in good and cases.crc(i, 2)]  # rows whose labels it never saw
    assert len(known) > 100 and sum(good[i] == bool(labels[i][0]) for i in known) / len(known) > 0.85


def test_op8_beats_the_word_model_on_held_out_rows(spark):
    out = [r for r in q.op8_lm_scores(spark, SF).collect() if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


def test_op7_equals_a_plain_decoder(spark, rows):
    """Every column of every row, from tables made by rule one sample at a time."""
    got = {r.doc_id: r for r in q.op7_telephony(spark, SF).collect()}
    tables = {c: np.array([one(b) for b in range(256)], "<i2") for c, one in (("mulaw", cases.mulaw), ("alaw", cases.alaw))}
    codecs = set()
    for i, text, _ in rows:
        raw = (text or "").encode()
        pay = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        codec = ("mulaw", "alaw")[zlib.crc32(raw) % 2]
        codecs.add(codec)
        pcm = tables[codec][np.frombuffer(pay, np.uint8)].astype(np.int64)
        fine = np.empty(2 * len(pcm), "<i2")
        fine[::2], fine[1::2] = pcm, (pcm + np.append(pcm[1:], pcm[-1])) // 2
        zero = int(((pcm[1:] < 0) != (pcm[:-1] < 0)).sum())
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(pay), hashlib.sha256(pay).hexdigest(), zlib.crc32(pay[-64:]))
        assert r.feature.startswith(f"codec={codec};rms={int((pcm * pcm).mean() ** 0.5)};peak={np.abs(pcm).max()};zc={zero};pcm16000={zlib.crc32(fine.tobytes()):08x};")
        assert bytes(r.pcm) == fine.tobytes() and r.media_bytes == len(pay) + 58
    assert len(got) == len(rows) and codecs == {"mulaw", "alaw"}


# --- pipeline


def plain(df):
    return [tuple(r) for r in df.collect()]


def test_stages_against_brute_force(spark, tmp_path):
    src = [(i, t, "abc"[j % 3]) for j, (i, t) in enumerate(cases.awkward()) if i not in (50, None)]
    docs = cases.docs(spark, src).select("doc_id", "text", "lang", "source", "n_chars")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    stages = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "near_dedup", "mixing", "bpe"]

    first = stages["quality"](spark, docs, str(tmp_path))
    assert sorted(plain(first), key=str) == sorted(plain(docs), key=str)  # nothing was learnt, so nothing is rejected

    cut = stages["line_dedup"](spark, docs, str(tmp_path))
    want = {i: s for (i, *_), (_, _, _, s) in zip(src, cases.drop_lines(src))}
    assert {r.doc_id: hashlib.sha256((r.text or "").encode()).hexdigest() for r in cut.collect()} == want
    assert all(r.text is None or r.n_chars == len(r.text) for r in cut.collect()) and cut.columns == docs.columns

    few = stages["near_dedup"](spark, docs, str(tmp_path))
    kept = {i for i, (_, c) in cases.near_duplicates(src, 5).items() if i == c}
    assert sorted(r.doc_id for r in few.collect()) == sorted(kept) and few.columns == docs.columns

    mixed = stages["mixing"](spark, few, str(tmp_path))
    assert mixed.columns == docs.columns and mixed.count() > 0
    text = {r.doc_id: r.text for r in few.collect()}
    assert all(r.text == text[r.doc_id] for r in mixed.collect())

    out = stages["bpe"](spark, mixed, str(tmp_path)).collect()
    assert len(out) == mixed.count()
    assert all(r.decoded_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest() for r in out)


def test_pipeline_on_the_given_tables(spark, rows):
    out = corpus_pipeline.run(spark, SF)
    assert 0 < out.count() and {r.doc_id for r in out.select("doc_id").collect()} <= {r[0] for r in rows}


def test_pipeline_of_an_empty_table(spark, tmp_path):
    empty = cases.docs(spark, []).select("doc_id", "text", "lang", "source", "n_chars")
    empty.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []

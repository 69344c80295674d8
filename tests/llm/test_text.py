import base64
import hashlib
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from loomfit.llm import bpe, media

from . import cases

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


TEXTS = ["Hello world", "", None, " leading  and   many spaces ", "tab\tnew\nline\r\n\n x", "don't we'll I'VE", "naïve café ünïcode 漢字仮名 🙂🙂", "a b c\u0085d\u001cx", "<|endoftext|> plain", "x" * 500, "1234567 8.9", "\x00\x01", "Ωmega straße", "!!!???---"]


def test_bpe_equals_the_library(spark, reference):
    rows = list(enumerate(TEXTS + [t for _, t in cases.awkward()]))
    out = {r.doc_id: r for r in bpe.encode_documents(cases.docs(spark, rows), RANKS, public_tokenizers.PATTERN, dictionary=64).collect()}
    for i, t in rows:
        assert list(out[i].ids) == reference.encode_ordinary(t or ""), t
        assert bytes(out[i].decoded) == (t or "").encode()
    assert bpe.encode_documents(cases.docs(spark, []), RANKS, public_tokenizers.PATTERN).collect() == []


def test_the_dictionary_changes_nothing(spark):
    d = cases.docs(spark, cases.awkward())
    a, b = (sorted((str(r.doc_id), list(r.ids)) for r in bpe.encode_documents(d, RANKS, public_tokenizers.PATTERN, dictionary=n).collect()) for n in (0, 200))
    assert a == b


def test_column_form(spark, reference):
    b = bpe.Bpe(bpe.load_ranks(RANKS), public_tokenizers.PATTERN)
    texts = [t for t in TEXTS if t is None or len(t) < 60]
    d = cases.docs(spark, list(enumerate(texts)))
    out = d.select("doc_id", b.encode(d.text).alias("ids"))
    for r in out.select("doc_id", "ids", b.decode(out.ids).alias("back")).collect():
        assert list(r.ids) == reference.encode_ordinary(texts[r.doc_id] or ""), texts[r.doc_id]
        assert bytes(r.back) == (texts[r.doc_id] or "").encode()


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_merging_words(text):
    ranks = test_merging_words.ranks
    ref = test_merging_words.ref
    got = []
    for w in ref._pat_str_words(text) if hasattr(ref, "_pat_str_words") else __import__("regex").findall(public_tokenizers.PATTERN, text):
        got += bpe.merge_word(w.encode(), ranks)
    assert got == ref.encode_ordinary(text)


test_merging_words.ranks = bpe.load_ranks(RANKS)
test_merging_words.ref = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=test_merging_words.ranks, special_tokens={})


def test_long_words_by_the_heap(reference):
    for w in ("abab" * 200, "x" * 999, "mississippi" * 30):
        assert bpe.merge_word(w.encode(), test_merging_words.ranks) == reference.encode_ordinary(w)


def test_the_memo_forgets_and_still_agrees():
    m = bpe._Memo(test_merging_words.ranks, {})
    m.BOUND = 8
    for i in range(100):
        w = f"word{i % 30}"
        assert m[w] == bpe.packed(bpe.merge_word(w.encode(), test_merging_words.ranks))
        assert len(m) <= 8


# --- telephony


@pytest.mark.parametrize("codec", ["mulaw", "alaw"])
def test_telephony_round_trip(spark, codec):
    rows = cases.awkward()
    out = media.telephony(cases.docs(spark, rows), codecs=(codec,)).collect()
    assert len(out) == len(rows)
    by = {}
    for doc_id, text in rows:
        raw = (text or "").encode()
        payload = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        by[hashlib.sha256(payload).hexdigest()] = (len(raw), payload)
    for r in out:
        n, payload = by[r.payload_sha256]
        assert (r.n_bytes, r.payload_bytes, r.tail_crc32) == (n, len(payload), zlib.crc32(payload[-64:])) or r.payload_bytes == 64
        kind, got = media.from_wav(bytes(r.media))
        assert kind == codec and got == payload and len(r.media) == r.media_bytes and hashlib.sha256(bytes(r.media)).hexdigest() == r.media_sha256
        assert len(r.pcm) == 4 * len(payload)
    same = [r for r in out if r.doc_id in (6, 7)]
    assert same[0].feature == same[1].feature
    assert media.telephony(cases.docs(spark, [])).collect() == []


def test_mulaw_and_alaw_tables():
    mu, a = media.mulaw_table(), media.alaw_table()
    assert mu.tolist() == [cases.mulaw(b) for b in range(256)] and a.tolist() == [cases.alaw(b) for b in range(256)]
    assert mu[0] == -32124 and mu[0x80] == 32124 and mu[0xFF] == 0 and mu[0x7F] == 0
    assert a[0x55] == -8 and a[0xD5] == 8 and a[0x2A] == -32256 and a[0xAA] == 32256
    assert len(set(mu.tolist())) == 255 and len(set(a.tolist())) == 256


def adpcm_slow(block):
    value, index = struct.unpack_from("<hB", block)
    index, out = min(index, 88), [value]
    for byte in block[4:]:
        for nib in (byte & 15, byte >> 4):
            step = int(media._STEPS[index])
            d = (step >> 3) + (step if nib & 4 else 0) + (step >> 1 if nib & 2 else 0) + (step >> 2 if nib & 1 else 0)
            value = max(-32768, min(32767, value - d if nib & 8 else value + d))
            index = max(0, min(88, index + [-1, -1, -1, -1, 2, 4, 6, 8][nib & 7]))
            out.append(value)
    return out


def test_adpcm_over_blocks_equals_one_at_a_time():
    raw = np.random.default_rng(1).integers(0, 256, (50, 64), dtype=np.uint8)
    got = media.adpcm_decode(raw)
    assert got.shape == (50, 121)
    assert all(got[i].tolist() == adpcm_slow(raw[i].tobytes()) for i in range(50))


def test_slabs_do_not_change_checksums(monkeypatch):
    rng = np.random.default_rng(2)
    payloads = [rng.integers(0, 256, 64 * n, dtype=np.uint8).tobytes() for n in (1, 5, 300, 2, 70)]
    whole = media.adpcm_crcs(payloads)
    monkeypatch.setattr(media, "SLAB", 64)
    assert media.adpcm_crcs(payloads) == whole
    assert whole[0] == zlib.crc32(np.array(adpcm_slow(payloads[0]), "<i2").tobytes())


def test_resampling():
    assert media.resample(np.array([0, 10, -10], "<i2")).tolist() == [0, 5, 10, 0, -10, -10]
    assert media.resample(np.array([3], "<i2"), 1).tolist() == [3]


def test_matches_of_long_texts_are_taken_one_by_one(spark, monkeypatch):
    import public_tokenizers

    from loomfit.llm import bpe as module

    texts = [(1, "some Words, and 12345 figures\n\n  more " * 40), (2, ""), (3, None), (4, "short")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    ask = lambda: sorted((r.doc_id, tuple(r.ids), bytes(r.decoded)) for r in module.encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, dictionary=0).collect())
    whole = ask()
    assert [d for _, _, d in whole] == [(t or "").encode() for _, t in texts]
    encode = module._encoder(module.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN, {})
    monkeypatch.setattr(module, "LONG", 3)
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"doc_id": [i for i, _ in texts], "text": [t for _, t in texts]})
    got = [r for b in encode([batch]) for r in b.to_pylist()]
    assert sorted((r["doc_id"], tuple(r["ids"]), r["decoded"]) for r in got) == whole

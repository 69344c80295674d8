"""Documents with every awkward trait, and brute-force results of the operators."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, t string, h long, g double, size string, rep int, key string, ats string, list string, list_ int, word string, c string, row string, batch string, v string"


def docs(spark, rows):
    """rows: (doc_id, text[, source]); columns that clash with inner names hold junk."""
    out = []
    for r in rows:
        doc_id, text, source = (*r, "web")[:3]
        out.append((doc_id, text, "en", source, None if text is None else len(text), "x", 7, 0.5, "s", 3, "k", "a", "l", 1, "w", "c", "r", "b", "v"))
    return spark.createDataFrame(out, SCHEMA)


def prose(rng: random.Random, n: int, vocabulary: int = 400) -> str:
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def awkward(seed: int = 5) -> list[tuple]:
    """Nulls, empty and very long texts, exact and near copies, shared lines and passages."""
    rng = random.Random(seed)
    base = [prose(rng, 120) for _ in range(6)]
    passage = prose(rng, 70)
    line = "A line that many documents share, word for word"
    rows = [(1, None), (2, ""), (3, "  \n\t "), (4, "one two three"), (5, "ONE two  three"), (6, base[0]), (7, base[0]), (8, base[0].upper()), (None, base[0]), (9, prose(rng, 30000))]
    for i, b in enumerate(base):
        w = b.split()
        w[5] = "changed"
        rows.append((20 + i, " ".join(w)))
        rows.append((30 + i, prose(rng, 40) + " " + passage + " " + prose(rng, 40)))
        rows.append((40 + i, f"{prose(rng, 8)}\n{line}\n  {line.upper()} \nend {i}"))
    rows += [(50, passage), (50, passage), (51, None), (52, "z " * 200), (53, "z " * 120), (54, "naïve café — ünïcode 漢字   x"), (60, "a\x00b \x1f c"), (61, "\n\n\n")]
    return rows


def words(text) -> list[bytes]:
    return WORD.findall((text or "").encode())


def lower(text) -> bytes:
    return (text or "").encode().lower()


def near_duplicates(rows, k):
    sets: dict = {}
    for doc_id, text, *_ in rows:
        w = WORD.findall(lower(text))
        sets[doc_id] = frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()
    ids = sorted(sets)
    label = {i: i for i in ids}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                label[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in ids}


def drop_repeats(rows, size=50):
    first: dict = {}
    for doc_id, text, *_ in rows:
        w = words(text)
        for i in range(len(w) - size + 1):
            key = tuple(w[i : i + size])
            if doc_id is not None and (key not in first or doc_id < first[key]):
                first[key] = doc_id
    out = []
    for doc_id, text, *_ in rows:
        w = words(text)
        gone = set()
        for i in range(len(w) - size + 1):
            if doc_id is not None and first[tuple(w[i : i + size])] < doc_id:
                gone.update(range(i, i + size))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((doc_id, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return out


def drop_lines(rows, min_docs=3, min_chars=20):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    held: dict = {}
    for doc_id, text, *_ in rows:
        for x in (text or "").split("\n"):
            held.setdefault(key(x), set()).add(-(2**63) if doc_id is None else doc_id)
    out = []
    for doc_id, text, *_ in rows:
        lines = (text or "").split("\n")
        own = -(2**63) if doc_id is None else doc_id
        kept = [x for x in lines if not (len(key(x)) >= min_chars and len(held[key(x)]) >= min_docs and own < max(held[key(x)]))]
        out.append((doc_id, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return out


def crc(doc_id, m):
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % m


def mulaw(code: int) -> int:
    """One mu-law sample: sign, exponent and mantissa of the inverted byte."""
    code ^= 0xFF
    size = ((2 * (code & 15) + 33) << (code >> 4 & 7)) - 33
    return 4 * (-size if code & 0x80 else size)


def alaw(code: int) -> int:
    """One A-law sample: every second bit is inverted; the sign bit marks positive values."""
    code ^= 0x55
    exponent, mantissa = code >> 4 & 7, code & 15
    size = 2 * mantissa + 1 if exponent == 0 else (2 * mantissa + 33) << (exponent - 1)
    return 8 * (size if code & 0x80 else -size)

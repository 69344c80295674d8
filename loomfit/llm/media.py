"""Telephony audio columns: mu-law and A-law by look-up tables, IMA ADPCM in numpy.

A text's bytes are stored as the 8-bit samples of a G.711 WAV file, mu-law or A-law
by the crc32 of the text; a stored sample is one byte of the payload, so nothing is
lost. Files are a column of a table in the shared folder. Read back, samples are
expanded by a table of 256 entries, measured, and resampled to PCM, a column of the
result. ADPCM blocks of 64 bytes are decoded side by side: one numpy step for each
nibble position over all blocks of a slab.

Defined results: a null or empty text is 64 zero bytes; equal texts give equal
values; a text of any length is measured whole, in slabs, and only its samples, its
PCM and the resampled PCM are held at once; rows are independent,
so null or repeated ids do not matter; an empty table gives an empty result;
extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, small_batches, written

UNIT, RATE = 64, 8000
FORMATS = {"mulaw": 7, "alaw": 6}
SLAB = 1 << 16  # ADPCM blocks decoded at once


def mulaw_table() -> np.ndarray:
    u = ~np.arange(256, dtype=np.uint8)
    mag = (((u & 0x0F).astype(np.int32) << 3) + 0x84) << ((u & 0x70) >> 4).astype(np.int32)
    return np.where(u & 0x80, 0x84 - mag, mag - 0x84).astype("<i2")


def alaw_table() -> np.ndarray:
    a = np.arange(256, dtype=np.int32) ^ 0x55
    seg, mag = (a & 0x70) >> 4, ((a & 0x0F) << 4) + 8
    mag = np.where(seg > 0, (mag + 0x100) << np.maximum(seg - 1, 0), mag)
    return np.where(a & 0x80, mag, -mag).astype("<i2")


TABLES = {"mulaw": mulaw_table(), "alaw": alaw_table()}
_STEPS = np.array([7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767], np.int32)
_MOVE = np.array([-1, -1, -1, -1, 2, 4, 6, 8] * 2, np.int32)
#: Change of the predictor for each step index and nibble.
_DELTA = np.array([[(-1 if n & 8 else 1) * ((s >> 3) + (s if n & 4 else 0) + (s >> 1 if n & 2 else 0) + (s >> 2 if n & 1 else 0)) for n in range(16)] for s in _STEPS.tolist()], np.int32)


def adpcm_decode(blocks: np.ndarray) -> np.ndarray:
    """IMA ADPCM, mono: (n, width) uint8 blocks, each a predictor (int16), a step
    index and a spare byte, then nibbles, low one first. (n, 1 + 2 (width - 4)) int16."""
    n, width = blocks.shape
    out = np.empty((1 + 2 * (width - 4), n), "<i2")
    value = np.ascontiguousarray(blocks[:, :2]).view("<i2")[:, 0].astype(np.int32)
    index = np.minimum(blocks[:, 2], 88).astype(np.int32)
    out[0] = value
    for k in range(width - 4):
        byte = blocks[:, 4 + k]
        for half, nib in enumerate((byte & 15, byte >> 4)):
            value = np.clip(value + _DELTA[index, nib], -32768, 32767)
            index = np.clip(index + _MOVE[nib], 0, 88)
            out[1 + 2 * k + half] = value
    return np.ascontiguousarray(out.T)


def resample(pcm: np.ndarray, up: int = 2) -> np.ndarray:
    """Whole-number upsampling by straight lines between samples."""
    if up == 1 or len(pcm) == 0:
        return pcm
    x = pcm.astype(np.int32)
    nxt = np.append(x[1:], x[-1])
    return ((x[:, None] * up + (nxt - x)[:, None] * np.arange(up, dtype=np.int32)) // up).astype("<i2").ravel()


def padded(raw: bytes) -> bytes:
    return raw + bytes(-len(raw) % UNIT or (0 if raw else UNIT))


def to_wav(samples: bytes, codec: str) -> bytes:
    fmt = struct.pack("<4sIHHIIHHH", b"fmt ", 18, FORMATS[codec], 1, RATE, RATE, 1, 8, 0)
    fact = struct.pack("<4sII", b"fact", 4, len(samples))
    body = b"WAVE" + fmt + fact + struct.pack("<4sI", b"data", len(samples)) + samples + bytes(len(samples) % 2)
    return struct.pack("<4sI", b"RIFF", len(body)) + body


def from_wav(wav: bytes) -> tuple[str, bytes]:
    """(codec, stored samples) of a G.711 WAV file."""
    at, codec, data = 12, "", b""
    while at + 8 <= len(wav):
        name, size = struct.unpack_from("<4sI", wav, at)
        if name == b"fmt ":
            code = struct.unpack_from("<H", wav, at + 8)[0]
            codec = next((k for k, v in FORMATS.items() if v == code), "")
        elif name == b"data":
            data = wav[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    if not codec:
        raise ValueError("not a G.711 WAV file")
    return codec, data


def adpcm_crcs(payloads: list[bytes]) -> list[int]:
    """crc32 of each payload's PCM when its bytes are read as ADPCM blocks."""
    crcs, ends = [0] * len(payloads), np.cumsum([len(p) // UNIT for p in payloads]).tolist()
    blocks = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, UNIT)
    doc = 0
    for lo in range(0, len(blocks), SLAB):
        pcm = adpcm_decode(blocks[lo : lo + SLAB])
        at = 0
        while at < len(pcm):
            stop = min(ends[doc] - lo, len(pcm))
            crcs[doc] = zlib.crc32(pcm[at:stop], crcs[doc])
            at = stop
            if lo + at >= ends[doc]:
                doc += 1
    return crcs


def _stored(codecs: tuple[str, ...]):
    """Texts as WAV files; equal texts have the same codec."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                raw = [t.encode("utf-8", "surrogatepass") if t else b"" for t in part.column("text").to_pylist()]
                wav = [to_wav(padded(x), codecs[zlib.crc32(x) % len(codecs)]) for x in raw]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(map(len, raw), pa.int64()), pa.array(wav, pa.binary())], ["doc_id", "n_bytes", "media"])

    return run


def _feature(codec: str, samples: np.ndarray, up: int) -> tuple[str, bytes]:
    """Measures of the expanded samples, taken in slabs, and the resampled PCM."""
    energy, peak, zero, before = 0, 0, 0, None
    pcm = TABLES[codec][samples]
    for lo in range(0, len(pcm), SLAB):
        x = pcm[lo : lo + SLAB].astype(np.int64)
        energy += int((x * x).sum())
        peak = max(peak, int(np.abs(x).max()))
        sign = x < 0
        zero += int((sign[1:] != sign[:-1]).sum()) + (before is not None and before != sign[0])
        before = sign[-1]
    fine = resample(pcm, up).tobytes()
    return f"codec={codec};rms={int((energy / len(pcm)) ** 0.5)};peak={peak};zc={int(zero)};pcm{RATE * up}={zlib.crc32(fine):08x}", fine


def _measured(up: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            files = b.column("media")
            at = 0
            while at < len(files):
                first, total, read, rows = at, 0, [], []
                while at < len(files) and (total < SLAB * UNIT // 4 or not read):
                    wav = files[at].as_py()
                    codec, got = from_wav(wav)
                    feature, fine = _feature(codec, np.frombuffer(got, np.uint8), up)
                    rows.append((len(got), hashlib.sha256(got).hexdigest(), zlib.crc32(got[-UNIT:]), len(wav), hashlib.sha256(wav).hexdigest(), feature, fine))
                    read.append(got)
                    total += len(got)
                    at += 1
                cols = list(zip(*rows))
                cols[5] = [f"{f};adpcm={c:08x}" for f, c in zip(cols[5], adpcm_crcs(read))]
                types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]
                same = [b.column(c).slice(first, at - first) for c in ("doc_id", "n_bytes", "media")]
                yield pa.RecordBatch.from_arrays([*same, *[pa.array(c, t) for c, t in zip(cols, types)]], ["doc_id", "n_bytes", "media", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "pcm"])

    return run


def telephony(docs: DataFrame, codecs: tuple[str, ...] = ("mulaw", "alaw"), up: int = 2) -> DataFrame:
    """A row for each row of docs: the stored WAV file, its digests, a feature string
    and its resampled PCM. Files are written as a table to the shared folder; what is
    measured comes from reading that table."""
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    stored = written(docs.mapInArrow(lean(_stored(codecs)), "doc_id long, n_bytes long, media binary"), "media")
    schema = "doc_id long, n_bytes long, media binary, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, pcm binary"
    return stored.mapInArrow(lean(_measured(up)), schema)

"""Telephony audio: mu-law, A-law and IMA ADPCM in WAVE containers, to and from linear PCM.

Mu-law and A-law expand by lookup tables of 256 entries, each built from the codec's segment
rule. ADPCM is sequential within a block and independent between blocks: all blocks of a batch
are decoded together, one numpy step per sample position. Decoded samples are resampled to the
store rate by linear interpolation and stored as 16-bit PCM.

One narrow pass; a row's result depends on its own bytes alone, so equal inputs give equal
values and retried tasks repeat themselves. A task holds the samples of a few megabytes.

Defined results: a null payload reads as empty, stores an empty data chunk and has zero
features; an unknown or damaged container, or one of several channels, gives null samples; other columns pass through.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .words import chunks, small_batches, with_field

RATE, STORE_RATE = 8000, 16000
#: WAVE format tags, and the ADPCM index and step rules of the IMA recommendation.
PCM, ALAW, MULAW, IMA = 1, 6, 7, 17
INDEX_SHIFT = np.array([-1, -1, -1, -1, 2, 4, 6, 8] * 2, np.int32)
STEPS = np.array([
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230,
    253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327,
    3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
], np.int32)
BLOCK = 192


def _mulaw_table() -> np.ndarray:
    code = ~np.arange(256, dtype=np.int32) & 0xFF
    size = (((code & 15) << 3) + 132 << (code >> 4 & 7)) - 132
    return np.where(code & 128, -size, size).astype(np.int16)


def _alaw_table() -> np.ndarray:
    code = np.arange(256, dtype=np.int32) ^ 0x55
    segment, low = code >> 4 & 7, (code & 15) << 4
    size = np.where(segment == 0, low + 8, low + 264 << np.maximum(segment - 1, 0))
    return np.where(code & 128, size, -size).astype(np.int16)


TABLES = {MULAW: _mulaw_table(), ALAW: _alaw_table()}


def container(tag: int, data: bytes, rate: int = RATE) -> bytes:
    """A one-channel WAVE file around `data`."""
    bits, align = {PCM: (16, 2), ALAW: (8, 1), MULAW: (8, 1), IMA: (4, BLOCK)}[tag]
    per_block = 2 * (BLOCK - 4) + 1
    speed = rate * align // per_block if tag == IMA else rate * align
    extra = struct.pack("<HH", 2, per_block) if tag == IMA else b"" if tag == PCM else struct.pack("<H", 0)
    form = struct.pack("<HHIIHH", tag, 1, rate, speed, align, bits) + extra
    body = b"WAVE" + b"fmt " + struct.pack("<I", len(form)) + form + b"data" + struct.pack("<I", len(data)) + data + b"\0" * (len(data) % 2)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def read_container(media: bytes | None) -> tuple[int, int, memoryview, int, int] | None:
    """Format tag, rate, data chunk, bytes a block and bits a sample; None if it is not a one-channel WAVE file of a
    known format with both chunks."""
    if not media or len(media) < 12 or media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        return None
    view, at, form = memoryview(media), 12, None
    while at + 8 <= len(media):
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if at + 8 + size > len(media):
            return None
        if name == b"fmt " and size >= 16:
            form = struct.unpack_from("<HHIIHH", media, at + 8)
        if name == b"data":
            if not form or form[1] != 1:
                return None
            tag, rate, align, bits = form[0], form[2], form[4], form[5]
            known = (tag == PCM and bits in (8, 16, 24, 32)) or (tag in TABLES and bits == 8) or (tag == IMA and bits == 4 and align > 4)
            return (tag, rate, view[at + 8 : at + 8 + size], align, bits) if known else None
        at += 8 + size + size % 2
    return None


def decode_adpcm(blocks: np.ndarray) -> np.ndarray:
    """Samples of ADPCM blocks given as rows of bytes: 2 * (row length - 4) + 1 per block."""
    n, size = blocks.shape
    value = blocks[:, :2].copy().view("<i2")[:, 0].astype(np.int32)
    index = np.minimum(blocks[:, 2], len(STEPS) - 1).astype(np.int32)
    codes = np.empty((2 * (size - 4), n), np.uint8)
    codes[0::2], codes[1::2] = (blocks[:, 4:] & 15).T, (blocks[:, 4:] >> 4).T
    out = np.empty((2 * (size - 4) + 1, n), np.int16)
    out[0] = value
    for k, code in enumerate(codes):
        step = STEPS[index]
        change = step >> 3
        change += np.where(code & 4, step, 0)
        change += np.where(code & 2, step >> 1, 0)
        change += np.where(code & 1, step >> 2, 0)
        value += np.where(code & 8, -change, change)
        np.clip(value, -32768, 32767, out=value)
        index += INDEX_SHIFT[code]
        np.clip(index, 0, len(STEPS) - 1, out=index)
        out[k + 1] = value
    return out.T


def decode(media: list[bytes | None]) -> list[np.ndarray | None]:
    """Linear 16-bit samples of each file; ADPCM blocks of one size are decoded together for all files. A last block
    that is cut short counts as far as it goes; with less than its 4-byte header it has no samples."""
    read = [read_container(m) for m in media]
    out: list[np.ndarray | None] = [None] * len(read)
    by_size: dict[int, list[tuple[int, np.ndarray]]] = {}
    for i, r in enumerate(read):
        if r is None:
            continue
        tag, _, data, align, bits = r
        if tag == PCM:
            out[i] = linear(data, bits)
        elif tag == IMA:
            out[i] = np.zeros(0, np.int16)
            whole, rest = divmod(len(data), align)
            for size, blocks in ((align, data[: whole * align]), (rest, data[whole * align :])):
                if size >= 4 and len(blocks):
                    by_size.setdefault(size, []).append((i, np.frombuffer(blocks, np.uint8).reshape(-1, size)))
        else:
            out[i] = TABLES[tag][np.frombuffer(data, np.uint8)]
    ends: dict[int, np.ndarray] = {}
    for size, ima in by_size.items():
        samples = decode_adpcm(np.concatenate([b for _, b in ima]))
        for (i, _), part in zip(ima, np.split(samples, np.cumsum([len(b) for _, b in ima])[:-1])):
            if size == read[i][3]:
                out[i] = part.reshape(-1)
            else:
                ends[i] = part.reshape(-1)
    for i, end in ends.items():
        out[i] = np.concatenate([out[i], end])
    return out


def linear(data, bits: int) -> np.ndarray:
    """PCM of 8 (unsigned), 16, 24 or 32 bits as 16-bit samples: the upper bits stay; a last sample cut short goes."""
    if bits == 8:
        return ((np.frombuffer(data, np.uint8).astype(np.int16) - 128) << 8).astype("<i2")
    step = bits // 8
    upper = np.frombuffer(data[: len(data) // step * step], np.uint8).reshape(-1, step)[:, -2:]
    return np.ascontiguousarray(upper).view("<i2")[:, 0]


def resample(samples: np.ndarray, rate: int, to: int) -> np.ndarray:
    """Linear interpolation; rounds to the nearest sample value."""
    if rate == to or not len(samples):
        return samples.astype("<i2")
    if to == 2 * rate:
        x = samples.astype(np.int32)
        out = np.empty(2 * len(x), np.int32)
        out[0::2] = x
        out[1:-1:2] = (x[:-1] + x[1:]) >> 1
        out[-1] = x[-1]
        return out.astype("<i2")
    n = int(len(samples) * to / rate)
    return np.rint(np.interp(np.arange(n) * (rate / to), np.arange(len(samples)), samples)).astype("<i2")


def expand(media: DataFrame, media_col: str = "media", out_col: str = "pcm", to: int = STORE_RATE) -> DataFrame:
    """`media` with each file decoded, resampled to `to` and stored as a 16-bit PCM file in `out_col`."""
    media = media.drop(out_col)
    schema = with_field(media.schema, (out_col, "binary"))

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                files = part.column(media_col).to_pylist()
                made = [None if s is None else container(PCM, resample(s, read_container(m)[1], to).tobytes(), to) for m, s in zip(files, decode(files))]
                yield part.append_column(out_col, pa.array(made, pa.binary()))

    return media.mapInArrow(run, schema)


def _feature(tag: int, samples: np.ndarray, stored: np.ndarray) -> str:
    """Digest of the resampled PCM, mean level, root mean square, peak and zero crossings, as integers."""
    if not len(samples):
        return f"{tag}:0:0:0:0:0:0"
    x = samples.astype(np.int64)
    return f"{tag}:{zlib.crc32(stored.tobytes())}:{len(stored)}:{int(x.sum()) // len(x)}:{int((x * x).sum() // len(x))}:{int(np.abs(x).max())}:{int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))}"


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_media: bool = True) -> DataFrame:
    """Each text's UTF-8 bytes, filled up with spaces to a positive multiple of 192, as a telephony file whose
    format follows from the bytes (crc32 mod 3: mu-law, A-law, ADPCM); then what is read back from that file."""
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"

    def run(batches):
        for batch in chunks(batches, text_col):
            raw = [(t or "").encode() for t in batch.column(text_col).to_pylist()]
            filled = [r + b" " * (-len(r) % BLOCK if r else BLOCK) for r in raw]
            media = [container((MULAW, ALAW, IMA)[zlib.crc32(p) % 3], p) for p in filled]
            back = [read_container(m) for m in media]
            cols: list[list] = [[] for _ in range(7)]
            for r, m, (tag, rate, data, *_), samples in zip(raw, media, back, decode(media)):
                row = (len(r), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-16:]), len(m), hashlib.sha256(m).hexdigest(), _feature(tag, samples, resample(samples, rate, STORE_RATE)))
                for c, v in zip(cols, row):
                    c.append(v)
            arrays = [batch.column(id_col), *(pa.array(c, pa.string() if k in (2, 5, 6) else pa.int64()) for k, c in enumerate(cols))]
            if with_media:
                arrays.append(pa.array(media, pa.binary()))
            yield pa.RecordBatch.from_arrays(arrays, names)

    names = [id_col, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"] + ["media"] * with_media
    return docs.select(id_col, text_col).mapInArrow(run, schema + ", media binary" * with_media)


def op9_telephony(spark, sf_dir: str) -> DataFrame:
    return store_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_media=False)

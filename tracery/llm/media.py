"""Telephony audio in binary columns: mu-law, A-law and IMA ADPCM in WAV, expanded to PCM and resampled.

mu-law and A-law samples are expanded by lookup tables. ADPCM is decoded for all blocks of a batch at
once: one numpy step takes sample t of every block. `encode_media` stores bytes as they are, so the
stored form gives them back; `decode_media` stores 16-bit PCM at twice the rate.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged, text_chunks

RATE, BLOCK = 8000, 192
#: WAV format tags.
MULAW, ALAW, ADPCM = 7, 6, 17
NAMES = {MULAW: "mulaw", ALAW: "alaw", ADPCM: "adpcm"}
#: The step sizes and index changes of IMA ADPCM.
STEPS = [7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767]
MOVES = [-1, -1, -1, -1, 2, 4, 6, 8]


def mulaw_table() -> np.ndarray:
    u = ~np.arange(256, dtype=np.int32) & 255
    size = (((u & 15) << 3) + 132 << ((u >> 4) & 7)) - 132
    return np.where(u & 128, -size, size).astype(np.int16)


def alaw_table() -> np.ndarray:
    a = np.arange(256, dtype=np.int32) ^ 0x55
    exponent, size = (a >> 4) & 7, ((a & 15) << 4) + 8
    size = np.where(exponent > 0, (size + 256) << np.maximum(exponent - 1, 0), size)
    return np.where(a & 128, size, -size).astype(np.int16)


def adpcm_tables() -> tuple[np.ndarray, np.ndarray]:
    """For 16 * index + nibble: the change of the sample, and 16 * the next index."""
    step, nibble = np.array(STEPS)[:, None], np.arange(16)[None, :]
    change = (step >> 3) + (step >> 2) * (nibble & 1) + (step >> 1) * (nibble >> 1 & 1) + step * (nibble >> 2 & 1)
    after = np.clip(np.arange(89)[:, None] + np.array(MOVES)[nibble & 7], 0, 88) * 16
    return np.where(nibble & 8, -change, change).astype(np.int32).ravel(), after.astype(np.int32).ravel()


def decode_adpcm(blocks: np.ndarray) -> np.ndarray:
    """(n, BLOCK) bytes -> (n, samples) PCM. An index over 88 in a block's head counts as 88."""
    change, after = adpcm_tables()
    sample = blocks[:, :2].copy().view("<i2")[:, 0].astype(np.int32)
    at = np.minimum(blocks[:, 2], 88).astype(np.int32) * 16
    body = np.ascontiguousarray(blocks[:, 4:].T)
    out = np.empty((1 + 2 * len(body), len(blocks)), np.int16)
    out[0] = sample
    for t, byte in enumerate(body):
        for half, nibble in enumerate((byte & 15, byte >> 4)):
            at += nibble
            sample += change[at]
            np.minimum(sample, 32767, out=sample)
            np.maximum(sample, -32768, out=sample)
            out[1 + 2 * t + half] = sample
            at = after[at]
    return out.T


def wav(codec: int, payload: bytes) -> bytes:
    """The payload in a WAV file; ADPCM payloads are a multiple of BLOCK."""
    if codec == ADPCM:
        per_block = 2 * (BLOCK - 4) + 1
        form = struct.pack("<HHIIHHHH", codec, 1, RATE, RATE * BLOCK // per_block, BLOCK, 4, 2, per_block)
        samples = len(payload) // BLOCK * per_block
    else:
        form, samples = struct.pack("<HHIIHHH", codec, 1, RATE, RATE, 1, 8, 0), len(payload)
    body = b"WAVEfmt " + struct.pack("<I", len(form)) + form + b"fact" + struct.pack("<II", 4, samples) + b"data" + struct.pack("<I", len(payload)) + payload + b"\0" * (len(payload) % 2)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def read_wav(media: bytes) -> tuple[int, bytes]:
    """Format tag and data of a WAV file; ValueError if it isn't one."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, codec = 12, 0
    while at + 8 <= len(media):
        kind, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if kind == b"fmt ":
            codec = struct.unpack_from("<H", media, at + 8)[0]
        elif kind == b"data":
            return codec, media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no data chunk")


def decode_all(found: list[tuple[int, bytes]]) -> list[np.ndarray]:
    """PCM of each (codec, data); the ADPCM blocks of all of them are decoded together."""
    tables, out = {MULAW: mulaw_table(), ALAW: alaw_table()}, [np.empty(0, np.int16)] * len(found)
    for i, (codec, data) in enumerate(found):
        if codec in tables:
            out[i] = tables[codec][np.frombuffer(data, np.uint8)]
    if own := [i for i, (codec, data) in enumerate(found) if codec == ADPCM and len(data) >= BLOCK]:
        sizes = [len(found[i][1]) // BLOCK for i in own]
        blocks = np.frombuffer(b"".join(found[i][1][: n * BLOCK] for i, n in zip(own, sizes, strict=True)), np.uint8)
        pcm = decode_adpcm(blocks.reshape(-1, BLOCK))
        for i, part in zip(own, np.split(pcm, np.cumsum(sizes)[:-1]), strict=True):
            out[i] = np.ascontiguousarray(part).ravel()
    return out


def twice(pcm: np.ndarray) -> np.ndarray:
    """Resampled to twice the rate by a half-band filter of integers, so that every machine gets the same samples."""
    if not len(pcm):
        return pcm
    x = np.pad(pcm, (2, 3), mode="edge").astype(np.int32)
    n = len(pcm)
    mid = (150 * (x[2 : n + 2] + x[3 : n + 3]) - 25 * (x[1 : n + 1] + x[4 : n + 4]) + 3 * (x[:n] + x[5 : n + 5]) + 128) >> 8
    out = np.empty(2 * n, np.int16)
    out[::2] = pcm
    out[1::2] = np.clip(mid, -32768, 32767)
    return out


def feature(codec: int, pcm: np.ndarray, wide: np.ndarray) -> str:
    level = float(np.sqrt(np.mean(np.square(pcm, dtype=np.float64)))) if len(pcm) else 0.0
    crossings = int(np.count_nonzero(np.diff(np.signbit(pcm)))) if len(pcm) else 0
    peak = int(np.abs(pcm.astype(np.int32)).max()) if len(pcm) else 0
    return f"{NAMES[codec]} samples={len(pcm)} rms={level:.3f} peak={peak} crossings={crossings} pcm16k={zlib.crc32(wide.tobytes()):08x}"


def payload_of(data: bytes) -> bytes:
    """Spaces are appended up to a positive multiple of BLOCK."""
    return data.ljust(max(BLOCK, -(-len(data) // BLOCK) * BLOCK), b" ")


def codec_of(payload: bytes) -> int:
    """A third of payloads goes to each codec, by content, so that equal payloads are stored alike."""
    return (MULAW, ALAW, ADPCM)[zlib.crc32(payload) % 3]


def encode_media(df: DataFrame, id_col: str, bytes_col: str, codec: int | None = None) -> DataFrame:
    """(id, media): each value of a binary column as one WAV file. Null is stored as an empty value, padded.

    codec: MULAW, ALAW or ADPCM; by default chosen by content.
    """

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_chunks(batches, "data"):
            payloads = [payload_of(x or b"") for x in part.column("data").to_pylist()]
            media = pa.array([wav(codec or codec_of(x), x) for x in payloads], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column("id"), media], ["id", "media"])

    chosen = df.select(F.col(id_col).alias("id"), F.col(bytes_col).cast("binary").alias("data"))
    return chosen.mapInArrow(rows, f"id {chosen.schema['id'].dataType.simpleString()}, media binary")


def decode_media(df: DataFrame, id_col: str, media_col: str) -> DataFrame:
    """(id, codec, rate, payload, pcm, feature): the stored samples, and 16-bit little-endian PCM at 16 kHz. A null or a value that is no such WAV file gives nulls."""

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_chunks(batches, "data"):
            found: list[tuple[int, bytes]] = []
            for x in part.column("data").to_pylist():
                try:
                    found.append(read_wav(x or b""))
                except (ValueError, struct.error):
                    found.append((0, b""))
            pcm = decode_all(found)
            wide = [twice(x) for x in pcm]
            known = [c in NAMES for c, _ in found]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("id"),
                    pa.array([NAMES.get(c) for c, _ in found], pa.string()),
                    pa.array([2 * RATE if k else None for k in known], pa.int32()),
                    pa.array([x if k else None for (_, x), k in zip(found, known, strict=True)], pa.binary()),
                    pa.array([w.tobytes() if k else None for w, k in zip(wide, known, strict=True)], pa.binary()),
                    pa.array([feature(c, p, w) if k else None for (c, _), p, w, k in zip(found, pcm, wide, known, strict=True)], pa.string()),
                ],
                ["id", "codec", "rate", "payload", "pcm", "feature"],
            )

    chosen = df.select(F.col(id_col).alias("id"), F.col(media_col).cast("binary").alias("data"))
    return chosen.mapInArrow(rows, f"id {chosen.schema['id'].dataType.simpleString()}, codec string, rate int, payload binary, pcm binary, feature string")


def store_texts(docs: DataFrame) -> DataFrame:
    """Each text as UTF-8 bytes, encoded to a WAV file, written to the shared folder, read from there and decoded: digests of what is stored and read.

    Null texts count as empty. Rows are independent: no shuffle, repeated rows give repeated results.
    """
    data = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    stored = staged(encode_media(docs.select(F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.length(data).cast("long").alias("n_bytes")).alias("id"), data.alias("data")), "id", "data"))
    file = F.struct("id.*", F.length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"))
    read = decode_media(stored.select(file.alias("id"), "media"), "id", "media")
    payload = F.col("payload")
    return read.select(
        "id.doc_id", "id.n_bytes", F.length(payload).cast("long").alias("payload_bytes"), F.sha2(payload, 256).alias("payload_sha256"),
        F.crc32(F.substring(payload, -16, 16)).alias("tail_crc32"), "id.media_bytes", "id.media_sha256", "feature",
    )

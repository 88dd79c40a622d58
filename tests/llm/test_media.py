import hashlib
import zlib

import numpy as np
from pyspark.sql import functions as F

from tracery.llm import media


def slow_adpcm(block):
    """One sample after the other."""
    value, index, out = int.from_bytes(block[:2], "little", signed=True), min(block[2], 88), []
    out.append(value)
    for byte in block[4:]:
        for code in (byte & 15, byte >> 4):
            step = media.STEPS[index]
            change = (step >> 3) + (step if code & 4 else 0) + (step >> 1 if code & 2 else 0) + (step >> 2 if code & 1 else 0)
            value = max(-32768, min(32767, value - change if code & 8 else value + change))
            index = max(0, min(88, index + media.MOVES[code & 7]))
            out.append(value)
    return out


def test_adpcm_across_blocks_is_the_sequential_decoder():
    blocks = np.random.default_rng(3).integers(0, 256, (7, media.BLOCK), dtype=np.uint8)
    assert media.decode_adpcm(blocks).tolist() == [slow_adpcm(bytes(b)) for b in blocks]


def test_companding_tables():
    mu, a = media.mulaw_table(), media.alaw_table()
    assert (mu[0], mu[0x80], mu[0xFF], mu[0x7F]) == (-32124, 32124, 0, 0)
    assert (a[0xD5], a[0x55], a[0xAA], a[0x2A]) == (8, -8, 32256, -32256)
    assert len(set(a.tolist())) == 256


def test_twice_keeps_samples_and_constants():
    pcm = np.array([100, 100, 100, 100], np.int16)
    assert media.twice(pcm).tolist() == [100] * 8
    assert media.twice(np.empty(0, np.int16)).tolist() == []


def slow_mulaw(byte):
    byte = ~byte & 255
    size = (((byte & 15) * 2 + 33) << (byte >> 4 & 7)) - 33
    return 4 * (-size if byte & 128 else size)


def slow_alaw(byte):
    byte ^= 0x55
    exponent, size = byte >> 4 & 7, (byte & 15) * 16 + 8
    if exponent:
        size = (size + 256) << (exponent - 1)
    return size if byte & 128 else -size


def by_hand(payload):
    """The WAV file of a payload and what is told of its samples, one byte after the other."""
    codec = (7, 6, 17)[zlib.crc32(payload) % 3]
    n = lambda x, size: x.to_bytes(size, "little")
    if codec == 17:
        pcm = [x for i in range(0, len(payload), 192) for x in slow_adpcm(payload[i : i + 192])]
        form = n(17, 2) + n(1, 2) + n(8000, 4) + n(8000 * 192 // 377, 4) + n(192, 2) + n(4, 2) + n(2, 2) + n(377, 2)
    else:
        pcm = [(slow_mulaw if codec == 7 else slow_alaw)(b) for b in payload]
        form = n(codec, 2) + n(1, 2) + n(8000, 4) + n(8000, 4) + n(1, 2) + n(8, 2) + n(0, 2)
    body = b"WAVEfmt " + n(len(form), 4) + form + b"fact" + n(4, 4) + n(len(pcm), 4) + b"data" + n(len(payload), 4) + payload
    at, wide = lambda i: pcm[min(max(i, 0), len(pcm) - 1)], []
    for i, x in enumerate(pcm):
        between = (150 * (x + at(i + 1)) - 25 * (at(i - 1) + at(i + 2)) + 3 * (at(i - 2) + at(i + 3)) + 128) >> 8
        wide += [x, max(-32768, min(32767, between))]
    raw = b"".join(x.to_bytes(2, "little", signed=True) for x in wide)
    rms = (sum(x * x for x in pcm) / len(pcm)) ** 0.5
    turns = sum((a < 0) != (b < 0) for a, b in zip(pcm, pcm[1:]))
    name = {7: "mulaw", 6: "alaw", 17: "adpcm"}[codec]
    return b"RIFF" + n(len(body), 4) + body, f"{name} samples={len(pcm)} rms={rms:.3f} peak={max(map(abs, pcm))} crossings={turns} pcm16k={zlib.crc32(raw):08x}"


def test_store_texts_reads_back_what_it_stored(spark, sf):
    docs = spark.createDataFrame([(1, None, 5), (2, "", 6), (3, "é" * 96, 7), (4, "x" * 200_001, 8), (4, "x" * 200_001, 8), (None, "a", 9)], "doc_id long, text string, media_bytes int")
    texts = {1: "", 2: "", 3: "é" * 96, 4: "x" * 200_001, None: "a"}
    rows = media.store_texts(docs).collect()
    assert len(rows) == 6 and media.store_texts(docs.limit(0)).count() == 0
    whole = spark.read.parquet(f"{sf}/documents.parquet")
    told, all_texts = media.store_texts(whole).collect(), {r.doc_id: r.text for r in whole.collect()}
    assert len(told) == len(all_texts)
    for r, text in [*((r, texts[r.doc_id]) for r in rows), *((r, all_texts[r.doc_id]) for r in told)]:
        text = text.encode()
        padded = text + b" " * ((-len(text)) % 192 or (192 if not text else 0))
        assert (r.n_bytes, r.payload_bytes) == (len(text), len(padded))
        assert r.payload_sha256 == hashlib.sha256(padded).hexdigest() and r.tail_crc32 == zlib.crc32(padded[-16:])
        file, said = by_hand(padded)
        assert (r.media_bytes, r.media_sha256, r.feature) == (len(file), hashlib.sha256(file).hexdigest(), said)


def test_general_interface_round_trip(spark):
    df = spark.createDataFrame([(str(i), bytes([i % 256] * i)) for i in (0, 1, 191, 192, 500)] + [("n", None)], "id string, data binary")
    for codec in media.NAMES:
        stored = media.encode_media(df, "id", "data", codec)
        back = {r.id: media.read_wav(bytes(r.media)) for r in stored.collect()}
        assert all(back[r.id] == (codec, media.payload_of(bytes(r.data or b""))) for r in df.collect())
        out = media.decode_media(stored, "id", "media").collect()
        assert all(r.rate == 16000 and r.codec == media.NAMES[codec] and len(r.pcm) > 0 for r in out)
    broken = df.select("id", F.lit(b"no audio").alias("media"))
    assert all(r.pcm is None and r.codec is None for r in media.decode_media(broken, "id", "media").collect())

"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts n-grams of 1 to 3 characters of all labelled texts: each task adds up a matrix of
languages by buckets, tasks' sums meet in one aggregation by (language, bucket). The matrix of log
probabilities has a fixed size and is broadcast; a batch of texts is scored by gathering its rows at
the n-grams' buckets and adding them up for each text.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keeping, text_chunks

#: N-grams fall into 2**BITS buckets, for any number of languages; more than MAX_LANGS are refused. So the matrix (float32) has 32 MB at most.
BITS, MAX_LANGS = 15, 256
_LETTER = re.compile(r"[^\W\d_]")


def grams(texts: list[str], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams, n = 1..3, and the number of them in each text.

    Texts are lower-cased; a-z and all characters from U+00C0 on count as letters, every run of others as one
    space, and each text stands between two spaces.
    """
    lowered = [f" {x.lower()} " for x in texts]
    codes = np.frombuffer("".join(lowered).encode("utf-32-le"), dtype=np.uint32)
    if not len(codes):
        return np.empty(0, np.int64), np.zeros(0, np.int64)
    ends = np.cumsum([len(x) for x in lowered])
    owner_start = np.concatenate(([0], ends[:-1]))
    letter = (codes >= 192) | ((codes >= 97) & (codes <= 122))
    codes = np.where(letter, codes, np.uint32(32))
    keep = letter.copy()
    keep[0] = True
    keep[1:] |= letter[:-1]  # of a run of others, the first
    keep[owner_start] = True
    codes, place = codes[keep], np.flatnonzero(keep)
    starts = np.searchsorted(place, owner_start)
    n = np.diff(np.append(starts, len(codes)))
    a = codes * np.uint32(0x9E3779B1)
    second, third = np.full((2, len(codes)), 32, np.uint32)
    second[:-1], third[:-2] = codes[1:], codes[2:]
    third[starts + n - 1] = 32  # the last window of a text would reach the next one's first letter
    b = (a ^ (a >> np.uint32(15))) * np.uint32(0x85EBCA77) + second * np.uint32(0x9E3779B1)
    c = (b ^ (b >> np.uint32(13))) * np.uint32(0xC2B2AE3D) + third * np.uint32(0x9E3779B1)
    shift = np.uint32(32 - bits)
    hashed = np.empty((len(codes), 3), np.int64)
    for k, x in enumerate((a, b, c)):
        x = x ^ (x >> np.uint32(16)) ^ np.uint32(k * 0x27D4EB2F)
        hashed[:, k] = (x * np.uint32(0x27D4EB2F)) >> shift
    return hashed.ravel(), n * 3


def train(labelled: DataFrame, bits: int = BITS, smoothing: float = 0.1) -> tuple[list[str], np.ndarray]:
    """Languages in order and their (bucket, language) log probabilities, from columns text and lang.

    Rows without text or lang teach nothing; without any other row there are no languages. Priors are
    equal: how often a language stands in the sample says nothing about a new text.
    """
    usable = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    langs = sorted(r[0] for r in usable.select("lang").distinct().limit(MAX_LANGS + 1).collect())
    if len(langs) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages")
    index = {x: i for i, x in enumerate(langs)}

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(index), 1 << bits), np.int64)
        for part in text_chunks(batches):
            texts, own = part.column("text").to_pylist(), np.array([index[x] for x in part.column("lang").to_pylist()])
            hashed, n = grams(texts, bits)
            sums += np.bincount(np.repeat(own << bits, n) + hashed, minlength=sums.size).reshape(sums.shape)
        for i in range(len(index)):
            at = np.flatnonzero(sums[i])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), i, np.int32)), pa.array(at.astype(np.int32)), pa.array(sums[i][at])], ["lang", "bucket", "n"])

    if not langs:
        return [], np.zeros((1 << bits, 0), np.float32)
    totals = usable.select("text", "lang").mapInArrow(count, "lang int, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    counts = np.full((len(langs), 1 << bits), smoothing)
    np.add.at(counts, (totals["lang"].to_numpy(), totals["bucket"].to_numpy()), totals["n"].to_numpy())
    return langs, np.ascontiguousarray(np.log(counts / counts.sum(1, keepdims=True)).T.astype(np.float32))


def score(texts: list[str | None], langs: list[str], logs: np.ndarray) -> tuple[list[str], np.ndarray]:
    """The likeliest language of each text and its posterior probability; `und` with 0 for null, no letter, or no languages."""
    bits = int(logs.shape[0]).bit_length() - 1
    known = [bool(x) and bool(langs) and _LETTER.search(x) is not None for x in texts]
    best, sure = ["und"] * len(texts), np.zeros(len(texts))
    own = [i for i, k in enumerate(known) if k]
    if own:
        hashed, n = grams([texts[i] for i in own], bits)
        ends = np.cumsum(n)
        total = np.empty((len(own), len(langs)))
        for j in range(len(langs)):
            total[:, j] = np.add.reduceat(np.take(logs[:, j], hashed), ends - n, dtype=np.float64)
        top = total.argmax(1)
        total -= total.max(1, keepdims=True)
        sure[own] = 1 / np.exp(total).sum(1)
        for i, j in zip(own, top, strict=True):
            best[i] = langs[j]
    return best, sure


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray], *keep: Column) -> DataFrame:
    """The columns `keep`, lang_pred and score of every row, from its whole text alone. A kept column of either name gets an underscore after it."""
    langs, logs = model
    sent = docs.sparkSession.sparkContext.broadcast((langs, logs))
    chosen, kept = keeping(docs, keep, {"__text": F.col("text").cast("string")}, ["lang_pred", "score"])

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, logs = sent.value
        logs = np.asfortranarray(logs)
        for part in text_chunks(batches, "__text"):
            best, sure = score(part.column("__text").to_pylist(), langs, logs)
            yield pa.RecordBatch.from_arrays([*(part.column(k) for k in kept), pa.array(best, pa.string()), pa.array(sure)], [*kept, "lang_pred", "score"])

    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[:-1])
    return chosen.mapInArrow(rows, f"{shape}, lang_pred string, score double")


def held_out() -> Column:
    """True for the documents that training never sees: crc32 of the id's text leaves 2 modulo 4."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2


def predict_documents(docs: DataFrame) -> DataFrame:
    """Learns from the documents that aren't held out and predicts all of them.

    A null doc_id counts as not held out. Repeated rows each count and each get a result.
    """
    out = F.coalesce(held_out(), F.lit(False))
    model = train(docs.where(~out).select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")))
    return identify(docs, model, F.col("doc_id").cast("long").alias("doc_id"), out.alias("held_out"))

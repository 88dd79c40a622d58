"""Helpers that several operators share: bounded text batches, vectorised word hashes, tables in the shared folder."""

from __future__ import annotations

import hashlib
import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A task holds about so many bytes of text as Python objects at once, or one text if it is longer.
CHUNK_BYTES = 1 << 20


def text_chunks(batches: Iterable[pa.RecordBatch], text: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts Arrow batches into slices of about `limit` bytes of text; a slice has one row at least."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        total, start = np.cumsum(sizes, dtype=np.int64), 0
        while start < batch.num_rows:
            before = total[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(total, before + limit, side="right")))
            yield batch.slice(start, end - start)
            start = end


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


_BASE = 0x9E3779B97F4A7C15
#: Words of more bytes than this get another hash: modulo 2**64 any polynomial is alike on two words of 1,024 bytes that are easily told.
LONG_WORD = 256
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def powers(n: int, base: int = _BASE) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.full(max(n, 1), base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words `[^\\x20\\x09-\\x0D]+` of all texts in order, and each text's number of words.

    A word's hash is that of its bytes alone: a polynomial over them, taken from prefix sums, then mixed; BLAKE2 for long words.
    """
    blob = np.frombuffer(b"\n".join([*texts, b""]), dtype=np.uint8)
    if not len(blob):
        return np.empty(0, np.uint64), np.zeros(len(texts), np.int64)
    space = _SPACE[blob]
    edge = np.flatnonzero(np.diff(space, prepend=True))  # a word's first byte, then the space after it, and so on
    start, end = edge[::2], edge[1::2]
    ends = np.cumsum([len(t) + 1 for t in texts])
    n_words = np.diff(np.searchsorted(start, ends), prepend=0)
    up = powers(len(blob) + 1)
    sums = np.zeros(len(blob) + 1, np.uint64)
    np.cumsum((blob.astype(np.uint64) + np.uint64(1)) * up[: len(blob)], out=sums[1:])
    down = powers(len(blob) + 1, pow(_BASE, -1, 1 << 64))
    out = mix64((sums[end] - sums[start]) * down[start])
    for i in np.flatnonzero(end - start > LONG_WORD).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(blob[start[i] : end[i]], digest_size=8).digest(), "little")
    return out, n_words


def ascii_lower(text: str | None) -> bytes:
    """UTF-8 of the text with A-Z lower-cased and nothing else changed; null is empty."""
    return (text or "").encode().lower()


def apart(columns: list[str], results: Iterable[str]) -> list[str]:
    """The names of kept columns, with underscores after those that results or columns before them have already."""
    out, used = [], {x.lower() for x in results}
    for c in columns:
        while c.lower() in used:
            c += "_"
        used.add(c.lower())
        out.append(c)
    return out


def keeping(df: DataFrame, keep: tuple[Column, ...], own: dict[str, Column], results: Iterable[str]) -> tuple[DataFrame, list[str]]:
    """The kept columns and those of `own`, and the kept ones' names; a kept column with the name of another one or of a result gets an underscore after it."""
    chosen = df.select(*keep, *(c.alias(n) for n, c in own.items()))
    kept = apart(chosen.columns[: len(chosen.columns) - len(own)], [*own, *results])
    return chosen.toDF(*kept, *own), kept


def shared_folder(spark: SparkSession) -> str:
    """A new folder, by name, under spark.checkpoint.dir; where that is unset on a local master (tests), under a temporary one that is then set."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not re.fullmatch(r"local(\[.*\])?", spark.conf.get("spark.master", None) or ""):
            raise ValueError("spark.checkpoint.dir names no folder that all machines share")
        top = tempfile.mkdtemp(prefix="tracery-")
        spark.conf.set("spark.checkpoint.dir", top)
    return f"{top.rstrip('/')}/tracery-{uuid.uuid4().hex}"


def staged(df: DataFrame, folder: str | None = None) -> DataFrame:
    """Writes the rows as Parquet to the shared folder and reads them again: lineage ends there, and lost executors cost nothing that is before."""
    spark = df.sparkSession
    path = folder or shared_folder(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def splitting_join(left: DataFrame, right: DataFrame, *names: str, how: str = "inner") -> DataFrame:
    """Joins on columns that both sides have, as one struct: then an aggregated side is shuffled anew, and between two plain shuffles Spark can split a key with very many rows."""
    other = right.withColumnsRenamed({n: f"__{n}" for n in names})
    key = lambda prefix: F.struct(*(F.col(prefix + n).alias(f"k{i}") for i, n in enumerate(names)))
    return left.join(other, key("") == key("__"), how).drop(*(f"__{n}" for n in names))

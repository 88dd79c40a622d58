"""Document fingerprints from closed syncmers.

A k-mer of characters is a closed syncmer if the least of its s-mers (by hash) is its first or its last.
That depends on the k-mer alone, not on its neighbours, so the same passage has the same anchors in every
text. A text's fingerprint is all its anchors with their places; the likeness of two is the share of anchors
that lie in a passage which both have: two anchors or more, equally far apart. It is exact at any length.
What is printed of a fingerprint are its SKETCH least anchors, in the order in which they first occur;
`anchors` returns all of them with their places.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keeping, mix64, text_chunks

K, S = 16, 5
#: So many anchors of a fingerprint are printed.
SKETCH = 64
#: A range of documents has about so many bytes of text at most.
PART_BYTES = 1 << 28
#: Characters that are hashed at once; texts are put together up to it.
WINDOW = 1 << 18
_MULTIPLIER = 0x9E3779B97F4A7C15


def closed_syncmers(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the closed syncmers of an array of code points."""
    n = len(codes) - K + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    codes = codes.astype(np.uint64)
    small = codes[: len(codes) - S + 1].copy()
    for j in range(1, S):
        small *= np.uint64(_MULTIPLIER)
        small += codes[j : len(codes) - S + 1 + j]
    small = mix64(small)
    span = K - S + 1  # s-mers of a k-mer
    least, width = small, 1
    while 2 * width <= span:
        least, width = np.minimum(least[: len(least) - width], least[width:]), 2 * width
    least = np.minimum(least[:n], least[span - width : span - width + n])
    at = np.flatnonzero((small[:n] == least) | (small[span - 1 : span - 1 + n] == least))
    hashed = small[at]
    for j in (*range(S, span - 1, S), span - 1):  # s-mers that cover the k-mer
        hashed = mix64(hashed * np.uint64(_MULTIPLIER) + small[at + j])
    return at, hashed


def whole(codes: np.ndarray) -> np.ndarray:
    """The one anchor of a text too short for any: a hash of all of it."""
    out = len(codes) + 1
    for c in codes.tolist():
        out = int(mix64(np.array([(out * _MULTIPLIER + c) % (1 << 64)], np.uint64))[0])
    return np.array([out], np.uint64)


def sketch(places: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """The least distinct hashes, 32 bits each, in the order of their first places."""
    short = (hashes >> np.uint64(32)).astype(np.uint32)
    values, first = np.unique(short, return_index=True)
    return values[:SKETCH][np.argsort(first[:SKETCH])]


def anchors_of(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Places and hashes of all anchors of each text, one of the whole text if it is too short for any.

    Texts are hashed together, a window of them at a time; a longer text is cut into windows that overlap by K - 1.
    """
    out, group, size = [], [], 0
    for text in [*texts, None]:
        if group and (text is None or size + len(text) > WINDOW):
            codes = np.frombuffer("".join(group).encode("utf-32-le"), np.uint32)
            at, hashed = [], []
            for start in range(0, max(len(codes), 1), WINDOW):
                places, found = closed_syncmers(codes[start : start + WINDOW + K - 1])
                at.append(places + start)
                hashed.append(found)
            at, hashed = np.concatenate(at), np.concatenate(hashed)
            end = np.cumsum([len(x) for x in group])
            begin = end - [len(x) for x in group]
            low, high = np.searchsorted(at, begin), np.searchsorted(at, np.maximum(end - K + 1, begin))
            out += [(at[a:b] - s, hashed[a:b]) if b > a or e == s else (np.zeros(1, np.int64), whole(codes[s:e])) for a, b, s, e in zip(low, high, begin, end, strict=True)]
            group, size = [], 0
        if text is not None:
            group.append(text)
            size += len(text)
    return out


class Steps(NamedTuple):
    """A hash of each anchor with the next one and the distance between them (of a lone anchor itself), and these hashes sorted; n: anchors."""

    n: int
    hashes: np.ndarray
    in_order: np.ndarray


def steps(places: np.ndarray, hashes: np.ndarray) -> Steps:
    own = hashes if len(hashes) < 2 else mix64(hashes[:-1] * np.uint64(_MULTIPLIER) + mix64(hashes[1:] + np.diff(places).astype(np.uint64)))
    return Steps(len(hashes), own, np.sort(own))


def placed(a: Steps, b: Steps) -> int:
    """How many anchors of one text lie in a step of the other."""
    at = np.minimum(np.searchsorted(b.in_order, a.hashes), len(b.in_order) - 1)
    hit = b.in_order[at] == a.hashes
    return int(hit.sum()) if a.n < 2 else int(np.count_nonzero(np.append(hit, False) | np.append(False, hit)))


def likeness(a: Steps, b: Steps) -> float:
    """Share of the anchors of two texts (of both together) that lie in a passage of two anchors or more, equally far apart, that both have."""
    if not a.n or not b.n:
        return 1.0 if a.n == b.n else 0.0
    return (placed(a, b) + placed(b, a)) / (a.n + b.n)


def told(values: np.ndarray) -> str:
    return values.astype(">u4").tobytes().hex()


def anchors(df: DataFrame, text_col: str, *keep: Column) -> DataFrame:
    """The columns `keep` with place (of its first character, from 0) and anchor (hash) of every closed syncmer of every text, copies included.

    A kept column of either name gets an underscore after it.
    """
    chosen, kept = keeping(df, keep, {"__text": F.col(text_col).cast("string")}, ["place", "anchor"])

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_chunks(batches, "__text"):
            got = [closed_syncmers(np.frombuffer((t or "").encode("utf-32-le"), np.uint32)) for t in part.column("__text").to_pylist()]
            row = pa.array(np.repeat(np.arange(len(got)), [len(p) for p, _ in got]))
            place, value = np.concatenate([p for p, _ in got]), np.concatenate([h for _, h in got])
            yield pa.RecordBatch.from_arrays([*(part.column(i).take(row) for i in range(len(kept))), pa.array(place), pa.array(value.view(np.int64))], [*kept, "place", "anchor"])

    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[:-1])
    return chosen.mapInArrow(rows, f"{shape}, place long, anchor long")


def with_next(docs: DataFrame, parts: int) -> DataFrame:
    """bin, doc_id, text, guest: documents dealt to ranges of doc_id, each range sorted and ended by a guest, the first document of the next.

    The order is that of doc_id, null first, then of the text's hash and the text; the last range's guest is the
    first document of all. Ranges come from quantiles of the ids, `parts` or one for each PART_BYTES of text; an id
    that fills several of them (null too) is cut by the text's hash. Only bounds and guests' ids are sent about.
    """
    spark = docs.sparkSession
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size = own.agg(F.sum(F.octet_length("text")), F.count(F.lit(1)), F.count("doc_id")).first()
    parts = max(parts, -(-(size[0] or 0) // PART_BYTES))
    none = round(parts * (1 - size[2] / max(size[1], 1)))  # ranges of rows without an id
    parts -= none
    bounds = own.agg(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)], max(10_000, parts))).first()[0] if parts > 1 else []
    turn = F.xxhash64("text")
    part_of = lambda n: F.floor((turn / F.lit(2.0**64) + 0.5) * n)
    if bounds:
        cuts, leaps = F.array(*map(F.lit, bounds)), F.array(*(F.lit(1 << i) for i in reversed(range(len(bounds).bit_length()))))

        def search(holds) -> Column:
            """How many bounds hold, by halving."""
            return F.aggregate(leaps, F.lit(0), lambda n, leap: F.when(holds(F.get(cuts, n + leap - 1)), n + leap).otherwise(n))

        own = own.withColumns({"under": search(lambda b: b < F.col("doc_id")), "upto": search(lambda b: b <= F.col("doc_id"))})
        place = F.when(F.col("upto") > F.col("under"), F.col("under") + 1 + F.least(part_of(F.col("upto") - F.col("under")), F.col("upto") - F.col("under") - 1)).otherwise(F.col("upto"))
    else:
        place = F.lit(0)
    unknown = F.least(part_of(F.lit(none)), F.lit(max(none - 1, 0)))
    own = own.select("doc_id", "text", F.when(F.col("doc_id").isNull(), unknown).otherwise(none + place).cast("int").alias("bin"))
    least = F.min(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id")).alias("least")
    first = own.groupBy("bin").agg(least).orderBy("bin").collect()
    if not first:
        return own.withColumn("guest", F.lit(False))
    filled = [r["bin"] for r in first]
    guests = spark.createDataFrame([(before, r["bin"], r["least"]["doc_id"]) for before, r in zip([filled[-1], *filled], first, strict=False)], "to int, bin int, g_id long")
    ends = own.join(F.broadcast(guests), (own["bin"] == guests["bin"]) & own["doc_id"].eqNullSafe(guests["g_id"]))
    ends = ends.groupBy("to").agg(F.min(F.struct("doc_id", turn.alias("turn"), "text")).alias("g"))
    both = own.select("bin", "doc_id", "text", F.lit(False).alias("guest")).unionByName(ends.select(F.col("to").alias("bin"), "g.doc_id", "g.text", F.lit(True).alias("guest")))
    return both.repartitionById(none + parts, "bin").sortWithinPartitions("bin", "guest", "doc_id", turn, "text")


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and its edited text, and the likeness of its own to the edited text's and the next document's.

    The edited text has its last quarter replaced by the beginning of the next document's text (ascending
    doc_id; after the last comes the first; equal ids in the order of their texts' hashes). Null texts count
    as empty; two empty texts are alike (1), an empty and another one aren't (0). A single document follows itself.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting = None  # the last document, until its successor is known
        for part in text_chunks(batches):
            queue = [] if waiting is None else [waiting]
            queue += [(b, i, t or "", g) for b, i, t, g in zip(*(part.column(c).to_pylist() for c in ("bin", "doc_id", "text", "guest")), strict=True)]
            pairs = [(x, y) for x, y in zip(queue, queue[1:], strict=False) if not x[3] and x[0] == y[0]]
            waiting = queue[-1]
            if not pairs:
                continue
            texts, n = [x[2] for x, _ in pairs], len(pairs)
            cuts = [len(t) // 4 for t in texts]
            edited = [t[: len(t) - c] + y[2][:c] for t, c, (_, y) in zip(texts, cuts, pairs, strict=True)]
            extra = [i for i in range(n) if i == n - 1 or pairs[i][1] is not pairs[i + 1][0]]  # others are followed by a text that has its turn here too
            every = anchors_of([*texts, *edited, *(pairs[i][1][2] for i in extra)])
            walks = [steps(*x) for x in every]
            later = dict(zip(extra, walks[2 * n :], strict=True))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([x[1] for x, _ in pairs], pa.int64()),
                    pa.array([len(t) for t in texts], pa.int64()),
                    pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited]),
                    pa.array([told(sketch(*x)) for x in every[:n]]),
                    pa.array([told(sketch(*x)) for x in every[n : 2 * n]]),
                    pa.array([likeness(a, b) for a, b in zip(walks[:n], walks[n : 2 * n], strict=True)]),
                    pa.array([likeness(walks[i], later[i] if i in later else walks[i + 1]) for i in range(n)]),
                ],
                ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )

    return with_next(docs, parts).mapInArrow(rows, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")

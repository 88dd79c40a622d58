"""Periodic runs of words, and texts without their repetitions.

A run is a stretch of words with a smallest period q, at least `copies` times q (and LEAST words) long, that no
neighbouring word extends. All runs of a text are found from its suffixes: they are put in order by prefix
doubling; adjacent ones have longest common prefixes (LCP). In descending order of LCP, as Kruskal's algorithm
takes edges, classes of suffixes are united, each class with its positions in order. Two positions that become
neighbours at a distance within the LCP that unites their classes are a word and its next copy, and seed a run:
between them no suffix shares as much, so the distance is the smallest period, and the LCP tells how far it goes.

Python's loop sees only suffixes that share as many words as a run needs, texts without runs never reach it.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keeping, mix64, text_chunks, word_hashes

#: A run has so many words at least, and so many copies of its period.
LEAST, COPIES = 24, 3


class Run(NamedTuple):
    start: int
    period: int
    length: int


def doubled(codes: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The order of all suffixes, and ranks by their first 1, 2, 4, ... codes: equal ranks are equal windows.

    Each text ends in a code that no other place has. Only suffixes that another one still equals are put in order anew.
    """
    n = len(codes)
    order = np.argsort(codes, kind="stable")
    slots, keys, size, levels = np.arange(n), codes[order], 1, []
    rank = np.empty(n, np.int32)
    while True:
        fresh = np.append(True, keys[1:] != keys[:-1])
        begin = np.maximum.accumulate(np.where(fresh, np.arange(len(slots)), 0))
        rank[order[slots]] = slots[begin]
        levels.append(rank.copy())
        shared = ~fresh | np.append(~fresh[1:], False)
        slots = slots[shared]
        if not len(slots):
            return order, levels
        place = order[slots]
        keys = rank[place].astype(np.int64) * n + rank[place + size]
        turn = np.argsort(keys, kind="stable")
        order[slots], keys, size = place[turn], keys[turn], size * 2


def common_prefixes(order: np.ndarray, levels: list[np.ndarray], least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of suffixes next to each other in order that share `least` codes or more: both places and the LCP."""
    level = min(least.bit_length() - 1, len(levels) - 1)
    near = np.flatnonzero(levels[level][order[1:]] == levels[level][order[:-1]])
    a, b = order[near].astype(np.int64), order[near + 1].astype(np.int64)
    lcp = np.zeros(len(near), np.int64)
    for i in reversed(range(len(levels))):
        lcp += (levels[i][a + lcp] == levels[i][b + lcp]).astype(np.int64) << i
    enough = lcp >= least
    return a[enough], b[enough], lcp[enough]


def seeds(a: list[int], b: list[int], lcp: list[int]) -> Iterator[tuple[int, int, int]]:
    """Kruskal by descending LCP over ordered sets of positions: place, distance to the new neighbour, and LCP, where the distance is within the LCP."""
    parent: dict[int, int] = {}
    held: dict[int, list[int]] = {}

    def root(x: int) -> int:
        top = x
        while (up := parent.setdefault(top, top)) != top:
            top = up
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    for x, y, shared in zip(a, b, lcp, strict=True):
        one, two = root(x), root(y)
        few, many = held.pop(one, [one]), held.pop(two, [two])
        if len(few) > len(many):
            few, many, one, two = many, few, two, one
        parent[one] = two
        held[two] = many
        i = 0
        while i < len(few):  # a block of `few` that falls between two positions of `many` is put in at once
            at = bisect_left(many, few[i])
            j = bisect_left(few, many[at], i) if at < len(many) else len(few)
            if at and few[i] - many[at - 1] <= shared:
                yield many[at - 1], few[i] - many[at - 1], shared
            if at < len(many) and many[at] - few[j - 1] <= shared:
                yield few[j - 1], many[at] - few[j - 1], shared
            many[at:at] = few[i:j]
            i = j


def runs_of(words: list[np.ndarray], least: int = LEAST, copies: int = COPIES) -> list[list[Run]]:
    """All runs of each text, given the hashes of its words, by start, then period.

    copies is 2 at least. A text of fewer than `least` words has no run.
    """
    if copies < 2:
        raise ValueError("a run has two copies of its period at least")
    found: list[list[Run]] = [[] for _ in words]
    own = [i for i, w in enumerate(words) if len(w) >= max(least, copies)]
    if not own:
        return found
    # A run of period q has an LCP of its length less q: of these the least is that of the longest period that `least` words still bound.
    shared = max(least - least // copies, copies - 1)
    sizes = np.array([len(words[i]) + 1 for i in own])
    ends = np.cumsum(sizes)
    told = np.zeros(ends[-1], np.uint64)
    inside = np.ones(ends[-1], bool)
    inside[ends - 1] = False
    told[inside] = mix64(np.concatenate([words[i] for i in own]) + mix64(np.repeat(np.arange(len(own)), sizes - 1).astype(np.uint64)))
    codes = np.empty(ends[-1], np.int64)
    codes[inside] = np.unique(told[inside], return_inverse=True)[1]
    codes[~inside] = ends[-1] + np.arange(len(own))
    a, b, lcp = common_prefixes(*doubled(codes), shared)
    turn = np.argsort(-lcp, kind="stable")
    begin = ends - sizes
    for place, period, lcp_ in seeds(a[turn].tolist(), b[turn].tolist(), lcp[turn].tolist()):
        if lcp_ < (copies - 1) * period or period + lcp_ < least:
            continue
        text = int(np.searchsorted(ends, place, side="right"))
        start = place - int(begin[text])
        if start == 0 or codes[place - 1] != codes[place - 1 + period]:
            found[own[text]].append(Run(start, period, period + lcp_))
    for x in found:
        x.sort()
    return found


def kept_words(n: int, runs: list[Run]) -> np.ndarray:
    """Whether each word stays: those of a run go after its first period."""
    edge = np.zeros(n + 1, np.int64)
    for r in runs:
        edge[r.start + r.period] += 1
        edge[r.start + r.length] -= 1
    return np.cumsum(edge[:n]) == 0


def strongest(runs: list[Run]) -> Run | None:
    """The run with most copies of its period, compared exactly; of ties that with the least start, then period."""
    best = None
    for r in runs:
        if best is None or r.length * best.period > best.length * r.period:
            best = r
    return best


def encoded(text: str | None) -> bytes:
    return (text or "").encode()


def runs(docs: DataFrame, text_col: str, *keep: Column, least: int = LEAST, copies: int = COPIES) -> DataFrame:
    """The columns `keep` with start, period and length (in words, from 0) of every run of every text; texts without runs have no row.

    A kept column of one of these names gets an underscore after it.
    """
    names = ["start", "period", "length"]
    chosen, kept = keeping(docs, keep, {"__text": F.col(text_col).cast("string")}, names)

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_chunks(batches, "__text"):
            hashed, n = word_hashes([encoded(t) for t in part.column("__text").to_pylist()])
            got = runs_of(np.split(hashed, np.cumsum(n)[:-1]), least, copies)
            row = pa.array(np.repeat(np.arange(len(got)), [len(x) for x in got]))
            flat = np.array([r for x in got for r in x], np.int64).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([*(part.column(i).take(row) for i in range(len(kept))), *(pa.array(flat[:, i]) for i in range(3))], [*kept, *names])

    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[:-1])
    return chosen.mapInArrow(rows, f"{shape}, start long, period long, length long")


def collapsed(docs: DataFrame, text_col: str, least: int = LEAST, copies: int = COPIES) -> DataFrame:
    """The same rows, each text without the repetitions of its runs; a text without runs stays as it is, null too."""
    chosen = docs.select(F.struct("*").alias("row"), F.col(text_col).cast("string").alias("__text"))

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_chunks(batches, "__text"):
            texts = part.column("__text").to_pylist()
            hashed, n = word_hashes([encoded(t) for t in texts])
            got = runs_of(np.split(hashed, np.cumsum(n)[:-1]), least, copies)
            for i in (i for i, x in enumerate(got) if x):
                words = encoded(texts[i]).split()
                texts[i] = b" ".join(words[j] for j in np.flatnonzero(kept_words(len(words), got[i]))).decode()
            yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(texts, pa.string())], ["row", "__text"])

    shape = chosen.schema["row"].dataType.simpleString()
    whole = chosen.mapInArrow(rows, f"row {shape}, __text string")
    return whole.select(*(F.col("__text").alias(c) if c == text_col else F.col(f"row.`{c}`") for c in docs.columns))


def planted(doc_id: int | None, n: int) -> np.ndarray | None:
    """Which original word stands at each place of a document whose words are made periodic from some place on; None for the others."""
    if doc_id is None or not n:
        return None
    g, rest = divmod(zlib.crc32(str(doc_id).encode()), 10)
    if rest:
        return None
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    place = np.arange(n)
    return np.where(place < a, place, a + (place - a) % p)


def run_documents(docs: DataFrame, listed: tuple[str, str, str] = ("start", "period", "length")) -> DataFrame:
    """Runs of every document, whose words are first made periodic where its id says so, and its text without their repetitions.

    Null texts count as empty; rows without an id are left as they are. Repeated rows each get a result. runs_sha256 tells each run's fields in the order of `listed`.
    """
    if sorted(listed) != sorted(Run._fields):
        raise ValueError("listed names each field of a run once")
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_chunks(batches):
            ids, texts = part.column("doc_id").to_pylist(), [encoded(t) for t in part.column("text").to_pylist()]
            hashed, n = word_hashes(texts)
            hashes = np.split(hashed, np.cumsum(n)[:-1])
            moved = [planted(i, len(h)) for i, h in zip(ids, hashes, strict=True)]
            got = runs_of([h if m is None else h[m] for h, m in zip(hashes, moved, strict=True)])
            best = [strongest(x) for x in got]
            told, short = [], []
            for text, move, own in zip(texts, moved, got, strict=True):
                words = text.split()
                if move is not None or own:
                    stay = np.flatnonzero(kept_words(len(words), own))
                    words = [words[j] for j in (stay if move is None else move[stay]).tolist()]
                short.append(hashlib.sha256(b" ".join(words)).hexdigest())
                told.append(hashlib.sha256("".join(",".join(str(getattr(r, f)) for f in listed) + "\n" for r in own).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    pa.array([len(x) for x in got], pa.int64()),
                    *(pa.array([None if r is None else r[k] for r in best], pa.int64()) for k in range(3)),
                    pa.array([None if r is None else 1000 * r.length // r.period for r in best], pa.int64()),
                    pa.array(told),
                    pa.array(short),
                ],
                ["doc_id", "n_runs", "start", "period", "length", "exponent_milli", "runs_sha256", "collapsed_sha256"],
            )

    return chosen.mapInArrow(rows, "doc_id long, n_runs long, start long, period long, length long, exponent_milli long, runs_sha256 string, collapsed_sha256 string")

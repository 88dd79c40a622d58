"""Quality classifier: ordinal regression with a cumulative link on graded ratings.

All thresholds share one vector of weights of hashed text features; P(grade >= g) = logistic(score - threshold_g)
with ordered thresholds. The expected grade is the sum of these tail probabilities; documents are selected by
the tail at a grade. The model learns from a bounded sample of labelled rows (SAMPLE rows in the mean, chosen by
hash, so that reruns agree); scoring is one pass over all texts without a shuffle.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keeping, text_chunks

BITS = 16
#: The mean number of labelled rows that a model learns from, whatever the number there is.
SAMPLE = 8000
#: And of characters: longer texts make a smaller sample, so that its features fit the driver.
SAMPLE_CHARS = 1 << 27
GRADES = 16
STEPS = 250
RATE = 0.3
RIDGE = 1e-4
_EDGE = ".,;:!?*#$%&|\"'()[]{}<>-_=+/\\"


class Model(NamedTuple):
    """thresholds: one for each grade from 1 on, ascending; none if nothing could be learnt."""

    weights: np.ndarray
    thresholds: np.ndarray


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and values: words without edge punctuation, shapes of odd word ends, and how far words repeat.

    Values grow with the logarithm of the counts and are damped by the fourth root of the sum of squares, so
    that neither a long text nor a short one outweighs the rest. A text without words has no features.
    """
    words, found = Counter(text.split()), Counter()
    for word, n in words.items():
        found[word.strip(_EDGE).lower()] += n
        end = word[-3:]
        if not (end.isalpha() and end.islower()):
            found["\1" + "".join("a" if c.islower() else "A" if c.isupper() else "0" if c.isdigit() else c for c in end)] += n
    if words:
        found[f"\2{10 * len(words) // sum(words.values())}"] = 5
    at = np.fromiter((zlib.crc32(k.encode()) & ((1 << BITS) - 1) for k in found), np.int32, len(found))
    value = np.log1p(np.fromiter(found.values(), np.float64, len(found)))
    return at, (value / max(np.square(value).sum(), 1e-9) ** 0.25).astype(np.float32)


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def learn(at: list[np.ndarray], value: list[np.ndarray], grade: np.ndarray) -> Model:
    """Full-batch gradient steps on the mean log loss of the observed grades, with a ridge on the weights."""
    n, k = len(grade), int(grade.max()) + 1 if len(grade) else 0
    weights, cuts = np.zeros(1 << BITS), np.linspace(-1, 1, max(k - 1, 0))
    if k < 2 or len(set(grade.tolist())) < 2:
        return Model(weights.astype(np.float32), np.empty(0))
    owner, at, value = np.repeat(np.arange(n), [len(x) for x in at]), np.concatenate(at), np.concatenate(value).astype(np.float64)
    first, second = np.zeros(len(weights) + k - 1), np.zeros(len(weights) + k - 1)
    for step in range(1, STEPS + 1):
        score = np.bincount(owner, value * weights[at], minlength=n)
        edge = np.concatenate(([-np.inf], cuts, [np.inf]))
        high, low = logistic(edge[grade + 1] - score), logistic(edge[grade] - score)
        high, low = np.where(grade == k - 1, 1.0, high), np.where(grade == 0, 0.0, low)
        p, up, down = np.maximum(high - low, 1e-12), high * (1 - high), low * (1 - low)
        slope = np.append(
            np.bincount(at, value * ((up - down) / p)[owner], minlength=len(weights)) / n + RIDGE * weights,
            [(np.where(grade == j + 1, down, 0) / p - np.where(grade == j, up, 0) / p).sum() / n for j in range(k - 1)],
        )
        first, second = 0.9 * first + 0.1 * slope, 0.999 * second + 0.001 * slope**2
        move = RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        weights, cuts = weights - move[: len(weights)], np.sort(cuts - move[len(weights) :])
    return Model(weights.astype(np.float32), cuts)


def tails(model: Model, texts: list[str | None]) -> np.ndarray:
    """(texts, grades from 1 on): P(grade >= g). Null counts as empty."""
    score = np.array([float(model.weights[at] @ value) for at, value in (features(t or "") for t in texts)])
    return logistic(score[:, None] - model.thresholds[None, :])


def fit(labelled: DataFrame, sample: int = SAMPLE) -> Model:
    """From columns text, grade (0 to GRADES - 1) and key, which seeds the choice of the sample.

    Rows without text or grade teach nothing, other grades are refused. With fewer than two grades nothing is learnt.
    """
    usable = labelled.where(F.col("text").isNotNull() & F.col("grade").isNotNull())
    n, low, high, chars = usable.agg(F.count(F.lit(1)), F.min("grade"), F.max("grade"), F.sum(F.length("text"))).first()
    if n and not 0 <= low <= high < GRADES:
        raise ValueError(f"grades from {low} to {high}: they are 0 to {GRADES - 1}")
    share = min(1.0, sample / max(n, 1), SAMPLE_CHARS / max(chars or 0, 1))
    chosen = usable.where(F.pmod(F.xxhash64("key", F.lit(10)), F.lit(1 << 30)) < int(share * (1 << 30)))

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_chunks(batches):
            got = [features(t) for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("key"), part.column("grade"), pa.array([a.tobytes() for a, _ in got], pa.binary()), pa.array([v.tobytes() for _, v in got], pa.binary())], ["key", "grade", "at", "value"])

    found = chosen.select(F.col("key").cast("string").alias("key"), F.col("grade").cast("int").alias("grade"), "text").mapInArrow(rows, "key string, grade int, at binary, value binary").collect()
    found.sort(key=lambda r: (r.key or "", r.grade, bytes(r.at), bytes(r.value)))  # the same order, and so the same sums, at every run
    return learn([np.frombuffer(r.at, np.int32) for r in found], [np.frombuffer(r.value, np.float32) for r in found], np.array([r.grade for r in found], np.int64))


def rate(docs: DataFrame, model: Model, *keep: Column, at_least: int | None = None) -> DataFrame:
    """The columns `keep`, expected_grade and tail_prob = P(grade >= at_least), by default of the highest grade.

    Both are null if nothing could be learnt. A kept column of either name gets an underscore after it.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at_least = at_least or len(model.thresholds)
    chosen, kept = keeping(docs, keep, {"__text": F.col("text").cast("string")}, ["expected_grade", "tail_prob"])

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_chunks(batches, "__text"):
            p = tails(sent.value, part.column("__text").to_pylist())
            none = not p.shape[1]
            mean = pa.nulls(len(p), pa.float64()) if none else pa.array(p.sum(1))
            tail = pa.nulls(len(p), pa.float64()) if none else pa.array(p[:, at_least - 1])
            yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(kept))), mean, tail], [*kept, "expected_grade", "tail_prob"])

    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[:-1])
    return chosen.mapInArrow(rows, f"{shape}, expected_grade double, tail_prob double")


def graded(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents with the grade of their label: 0 toxic, 1 clean but poor, 2 clean and sound. Rows without both ratings have none.

    Toxic words are few in a text, so that grade is at the end of the scale, where nothing bounds their weights from below.
    """
    both = F.col("quality").isNotNull() & F.col("toxic").isNotNull()
    rated = labels.select(F.col("doc_id").cast("long").alias("key"), F.when(both, F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).otherwise(2)).alias("grade"))
    return docs.select(F.col("doc_id").cast("long").alias("key"), F.col("text").cast("string").alias("text")).join(rated, "key")


def model_of(docs: DataFrame, labels: DataFrame) -> Model:
    """The sample is drawn from the labels before their texts are fetched, so that only bounded rows meet the documents."""
    rated = labels.where(F.col("quality").isNotNull() & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
    n = rated.count()
    few = rated.where(F.pmod(F.xxhash64(F.col("doc_id").cast("long"), F.lit(11)), F.lit(1 << 30)) < int(min(1.0, SAMPLE / max(n, 1)) * (1 << 30)))
    return fit(graded(docs, F.broadcast(few)), sample=1 << 60)


#: Documents are kept from this probability of the highest grade on.
KEEP_FROM = 0.5


def rate_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Expected grade, P(highest grade) and whether it is kept, for every document; without a model all are kept."""
    out = rate(docs, model_of(docs, labels), F.col("doc_id").cast("long").alias("doc_id"))
    return out.withColumn("kept", F.coalesce(F.col("tail_prob") >= KEEP_FROM, F.lit(True)))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents whose tail probability reaches KEEP_FROM, with their own columns only."""
    rated = rate(docs, model_of(docs, labels), F.struct("*").alias("row"))
    return rated.where(F.coalesce(F.col("tail_prob") >= KEEP_FROM, F.lit(True))).select("row.*")

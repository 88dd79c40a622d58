import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tracery.llm import syncmers
from tracery.llm.common import mix64


def brute(text):
    """Places of k-mers whose least s-mer is at an edge."""
    def small(i):
        h = 0
        for c in text[i : i + syncmers.S]:
            h = (h * syncmers._MULTIPLIER + ord(c)) % (1 << 64)
        return int(mix64(np.array([h], np.uint64))[0])

    out = []
    for i in range(len(text) - syncmers.K + 1):
        own = [small(i + j) for j in range(syncmers.K - syncmers.S + 1)]
        if min(own) in (own[0], own[-1]):
            out.append(i)
    return out


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="abcdé \U0001f600", max_size=80))
def test_places_against_definition(text):
    at, _ = syncmers.closed_syncmers(np.frombuffer(text.encode("utf-32-le"), np.uint32))
    assert at.tolist() == brute(text)


def test_anchors_need_no_context():
    rng = np.random.default_rng(1)
    passage = "".join(map(chr, rng.integers(97, 123, 200)))
    codes = lambda t: np.frombuffer(t.encode("utf-32-le"), np.uint32)
    at, h = syncmers.closed_syncmers(codes(passage))
    at2, h2 = syncmers.closed_syncmers(codes("xyz" * 9 + passage + "qq" * 7))
    assert set(zip((at + 27).tolist(), h.tolist(), strict=True)) <= set(zip(at2.tolist(), h2.tolist(), strict=True))
    assert 0.1 < len(at) / 185 < 0.3  # about 2 in K - S + 2


def test_sketches_do_not_depend_on_neighbours(monkeypatch):
    rng = np.random.default_rng(2)
    texts = ["".join(map(chr, rng.integers(97, 101, n))) for n in (0, 3, 15, 16, 40, 500, 1, 3000)]
    sketches = lambda own: [syncmers.sketch(*x).tolist() for x in syncmers.anchors_of(own)]
    one = [sketches([t])[0] for t in texts]
    assert sketches(texts) == one
    monkeypatch.setattr(syncmers, "WINDOW", 64)
    assert sketches(texts) == one
    assert one[0] == [] and len(one[1]) == 1 and len(one[7]) <= syncmers.SKETCH


def shared(a, b):
    """Likeness by the definition: anchors that stand in a pair of neighbours, equally far apart, that the other text has too."""
    def walk(text):
        at = brute(text)
        if not at:
            return [(text,)] if text else [], [0] if text else []
        own = [text[p : p + syncmers.K] for p in at]
        return [(x, y, q - p) for x, y, p, q in zip(own, own[1:], at, at[1:])] if len(at) > 1 else [(own[0],)], at

    (x, at), (y, bt) = walk(a), walk(b)
    if not at or not bt:
        return 1.0 if len(at) == len(bt) else 0.0

    def count(own, n, other):
        if n < 2:
            return sum(s in other for s in own)
        return len({j for i, s in enumerate(own) if s in other for j in (i, i + 1)})

    return (count(x, len(at), set(y)) + count(y, len(bt), set(x))) / (len(at) + len(bt))


def anchors_told(text):
    return syncmers.told(syncmers.sketch(*syncmers.anchors_of([text])[0]))


@pytest.mark.parametrize("parts", ["1", "4", "7"])
def test_fingerprint_documents(spark, sf, parts):
    words = ["salt", "pepper", "grain of", "rice and", "more", "oil, then", "water"]
    text = lambda k: " ".join(words[(k * i * i + i) % 7] for i in range(5 + 9 * k))
    rows = [(5, "b" * 7, 0.0), (2, None, 0.0), (9, "long " * 40_000, 0.0), (2, "dup", 0.0), (2, "dup", 0.0), (None, "null id", 0.0), (-3, "é\U0001f600x" * 30, 0.0), (7, "", 0.0)]
    rows += [(6, text(k), 0.0) for k in range(14)] + [(None, text(k), 0.0) for k in range(9)]  # an id, and none, with a large share of all rows
    own = spark.createDataFrame(rows, "doc_id long, text string, near_next double")
    real = spark.read.parquet(f"{sf}/documents.parquet")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        for docs in (own, real):
            got = sorted(map(tuple, syncmers.fingerprint_documents(docs).collect()), key=str)
            order = docs.selectExpr("doc_id", "text").withColumn("h", F.xxhash64("text")).orderBy("doc_id", "h", "text").collect()
            texts, want = [r.text or "" for r in order], []
            for r, x, y in zip(order, texts, texts[1:] + texts[:1], strict=True):
                c = len(x) // 4
                edited = x[: len(x) - c] + y[:c]
                near = [syncmers.likeness(*(syncmers.steps(*z) for z in syncmers.anchors_of([x, other]))) for other in (edited, y)]
                if len(x) + len(y) < 1500:
                    assert near == [shared(x, edited), shared(x, y)]
                want.append((r.doc_id, len(x), hashlib.sha256(edited.encode()).hexdigest(), anchors_told(x), anchors_told(edited), *near))
            assert got == sorted(want, key=str)
        one = syncmers.fingerprint_documents(own.limit(1)).first()
        assert one.near_next == 1.0
        assert syncmers.fingerprint_documents(own.limit(0)).count() == 0
        if parts == "7":
            bins = {(r.doc_id, r.bin) for r in syncmers.with_next(own, 7).where("not guest").collect()}
            assert sum(i == 6 for i, _ in bins) > 1 and sum(i is None for i, _ in bins) > 1  # they are split
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_anchors_keep_columns(spark):
    df = spark.createDataFrame([(1, "abcdefghijklmnopqrstuvwxyz" * 3, "q"), (2, None, "r")], "doc_id long, text string, anchor string")
    out = syncmers.anchors(df, "text", df["doc_id"], df["anchor"])
    assert out.columns == ["doc_id", "anchor_", "place", "anchor"] and {(r.doc_id, r.anchor_) for r in out.collect()} == {(1, "q")}


def test_a_short_passage_of_long_texts_is_matched(spark):
    rng = np.random.default_rng(5)
    text = lambda n: "".join(map(chr, rng.integers(97, 123, n)))
    passage = text(300)
    a, b = text(70_000) + passage + text(50_000), text(10_000) + passage + text(110_000)
    rows = spark.createDataFrame([(1, a), (2, b)], "doc_id long, text string")
    got = {r.doc_id: r for r in syncmers.fingerprint_documents(rows).collect()}
    at = lambda t: set(brute(t))
    places = {t: [p + t.index(passage) for p in at(passage)] for t in (a, b)}
    n = sum(len(syncmers.anchors_of([t])[0][0]) for t in (a, b))
    assert got[1].near_next == got[2].near_next == sum(map(len, places.values())) / n > 0
    assert 0.70 < got[1].near_edited < 0.76


def test_matching_keeps_to_places():
    rng = np.random.default_rng(6)
    parts = ["".join(map(chr, rng.integers(97, 123, 200))) for _ in range(4)]
    of = lambda t: syncmers.anchors_of([t])[0]
    near = lambda a, b: syncmers.likeness(syncmers.steps(*a), syncmers.steps(*b))
    a = of("".join(parts))
    assert near(a, a) == 1.0 and near(a, of("".join(parts[::-1]))) > 0.85  # passages may move
    torn = (a[0] * 2 + np.arange(len(a[0])), a[1])  # the same anchors at other distances
    assert near(a, torn) == 0.0 and np.array_equal(syncmers.sketch(*a), syncmers.sketch(*torn))
    assert near(of(""), of("")) == 1.0 and near(of(""), of("x")) == 0.0 and near(of("x"), of("x")) == 1.0
    assert near(of("long " * 40_000), of("long " * 30_000)) == 1.0

import hashlib
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tracery.llm import queries, repeats
from tracery.llm.common import word_hashes

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def brute(words, least=24, copies=3):
    """Every maximal stretch of every period from the definition; a stretch that a shorter period has too isn't that period's."""
    codes = np.unique(hashes(words), return_inverse=True)[1]
    n, out = len(words), {}
    for q in range(1, n // copies + 1):
        same = np.concatenate(([False], codes[q:] == codes[:-q], [False]))
        edge = np.flatnonzero(same[1:] != same[:-1])
        for i, j in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            length = j - i + q
            if length >= max(least, copies * q) and not any((codes[i : i + length - p] == codes[i + p : i + length]).all() for p in range(1, q)):
                out[i, q] = length
    return sorted((i, q, length) for (i, q), length in out.items())


def hashes(words):
    return np.array([zlib.crc32(repr(w).encode()) for w in words], np.uint64)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=40), max_size=4), st.sampled_from([(4, 2), (5, 3), (2, 2), (9, 3)]))
def test_small_alphabets(texts, bounds):
    got = repeats.runs_of([hashes(t) for t in texts], *bounds)
    assert [list(map(tuple, x)) for x in got] == [brute(t, *bounds) for t in texts]


@settings(max_examples=120, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 5), min_size=1, max_size=9), st.integers(1, 9)), max_size=7))
def test_planted_powers(parts):
    words = [w for unit, times in parts for w in unit * times]
    assert list(map(tuple, repeats.runs_of([hashes(words)])[0])) == brute(words)


def test_one_word_many_times_and_nested_runs():
    assert repeats.runs_of([hashes(["a"] * 100_000)])[0] == [(0, 1, 100_000)]
    inner = ["x"] * 30 + ["y"]
    assert list(map(tuple, repeats.runs_of([hashes(inner * 5)])[0])) == brute(inner * 5)
    with pytest.raises(ValueError, match="copies"):
        repeats.runs_of([hashes("ab")], copies=1)


def definition(doc_id, text):
    """The row of a document from the contract, in plain Python."""
    words = WORD.findall((text or "").encode())
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute(words)
    gone = {k for i, q, length in runs for k in range(i + q, i + length)}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    best = min(runs, key=lambda r: (-(10**12 * r[2] // r[1]), r[0], r[1])) if runs else (None, None, None)
    milli = 1000 * best[2] // best[1] if runs else None
    return (doc_id, len(runs), best[0], best[1], best[2], milli, sha("".join(f"{i},{q},{m}\n" for i, q, m in runs).encode()), sha(b" ".join(w for k, w in enumerate(words) if k not in gone)))


def test_the_query_against_the_definition(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r.doc_id: tuple(r) for r in repeats.run_documents(docs).collect()}
    texts = docs.select("doc_id", "text").collect()
    assert len(got) == len(texts) and sum(r[1] for r in got.values()) > 5
    for r in texts:
        if len(r.text) < 9000:
            assert got[r.doc_id] == definition(r.doc_id, r.text)


def test_edges(spark):
    ids = [i for i in range(200) if zlib.crc32(str(i).encode()) % 10 == 0][:3]
    rows = [(ids[0], None), (ids[1], ""), (ids[2], "one"), (None, "a b " * 20), (7, "a b " * 20), (7, "a b " * 20), (8, "Ä é\x0bx " * 9), (9, " \n"), (10, "  " * 30), (11, "long " * 60_000)]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, start int")
    out = repeats.run_documents(docs)
    assert out.columns == ["doc_id", "n_runs", "start", "period", "length", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    got = [tuple(r) for r in out.collect()]
    key = lambda r: (r[0] is None, r[0] or 0)
    assert sorted(got, key=key)[:-2] == [definition(i, t) for i, t in sorted(rows, key=key)[:-2]]
    assert repeats.run_documents(docs.limit(0)).count() == 0
    listed = repeats.runs(docs, "text", F.col("doc_id"), F.col("start"))
    assert listed.columns == ["doc_id", "start_", "start", "period", "length"]
    assert {tuple(r) for r in listed.where("doc_id = 7").collect()} == {(7, 1, 0, 2, 40)} and listed.where("doc_id = 7").count() == 2
    short = {r.doc_id: r.text for r in repeats.collapsed(docs, "text").where("doc_id is not null").collect()}
    assert short[7] == "a b" and short[ids[0]] is None and short[9] == " \n" and short[11] == "long" and short[8] == "Ä é x"


def test_the_query_tells_start_length_period(spark, sf):
    told = "start,length,period\n"
    by_contract = lambda rows: hashlib.sha256("".join(told.replace("start", str(i)).replace("length", str(m)).replace("period", str(q)) for i, q, m in rows).encode()).hexdigest()
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    listed = {}
    for r in repeats.runs(docs.where("crc32(cast(cast(doc_id as string) as binary)) % 10 <> 0"), "text", F.col("doc_id")).collect():
        listed.setdefault(r.doc_id, []).append((r.start, r.period, r.length))
    out = queries.op13_periodic_runs(spark, sf)
    assert out.columns[2:5] == ["start", "length", "period"]
    got = {r.doc_id: r.runs_sha256 for r in out.collect()}
    assert listed and all(got[i] == by_contract(sorted(x)) for i, x in listed.items())


def test_long_words_that_a_polynomial_takes_for_each_other():
    word = "a"
    for _ in range(11):
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    hashed, _ = word_hashes([f"{word} {other} {word}".encode()])
    assert hashed[0] == hashed[2] != hashed[1]

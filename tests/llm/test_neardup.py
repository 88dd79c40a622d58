import random
import re
from fractions import Fraction
from math import comb

import numpy as np
import pytest

from tracery.llm import neardup
from tracery.llm.components import components


def brute_sets(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    """rows: (doc_id, text). -> doc_id -> (n, component)."""
    sets = [brute_sets(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    by = {}
    for i, s in enumerate(sets):
        for x in s:
            by.setdefault(x, []).append(i)
    pairs = {(i, j) for own in by.values() for a, i in enumerate(own) for j in own[:a]}
    for i, j in pairs:
        both = len(sets[i] & sets[j])
        if 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
            up[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), d), d)
    return {d: (len(sets[i]), least[root(i)]) for i, (d, _) in enumerate(rows)}


def edited(words, rng, k):
    words = list(words)
    for _ in range(k):
        words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
    return " ".join(words)


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(250)] + [(500 + i, 501 + i) for i in range(60)] + [(1000, 1000 + i) for i in range(50)] + [(None, 3), (7, 7)]
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None:
            a, b = root(a), root(b)
            up[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in list(up) if root(x) != x}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_registers():
    rng = np.random.default_rng(1)
    h = np.unique(rng.integers(0, 2**64, 3000, dtype=np.uint64))
    sketch = neardup.registers(h)
    for b in range(0, neardup.REGISTERS, 37):
        own = [int(x) for x in h if int(x) >> 55 == b]
        if own:
            bits = format(min(own) & ((1 << 55) - 1), "055b")
            zeros = len(bits) - len(bits.lstrip("0"))
            assert sketch[b] == (zeros << 10 | int((bits[zeros + 1 :] + "0" * 10)[:10], 2)) + 1
        else:
            assert sketch[b] == 0
    few = h[:40]
    assert neardup.buckets_for(40) == 8 and neardup.buckets_for(2) == 1 and neardup.buckets_for(10**6) == 512
    many = neardup.registers(few, 8)
    assert (many > 0).mean() > 0.95 and (many[:8] != many[8:16]).all()
    assert all((neardup.registers(few[::-1].copy(), b) == neardup.registers(few, b)).all() for b in (1, 8, 512))
    other = np.unique(np.concatenate((h[:2000], rng.integers(0, 2**64, 1000, dtype=np.uint64))))
    likely, used = neardup.estimates(sketch, neardup.registers(other)[None, :], len(h), np.array([len(other)]))
    assert abs(likely[0] - 0.5) < 0.12 and used[0] > 500
    far, _ = neardup.estimates(sketch, neardup.registers(np.unique(rng.integers(0, 2**64, 3000, dtype=np.uint64)))[None, :], len(h), np.array([3000]))
    assert far[0] < 0.02


@pytest.mark.parametrize(("block", "band"), [(4096, 1 << 14), (5, 1 << 14), (2, 3)])
def test_against_brute_force(spark, monkeypatch, block, band):
    monkeypatch.setattr(neardup, "BLOCK_CLASSES", block)
    monkeypatch.setattr(neardup, "BAND_CLASSES", band)
    monkeypatch.setattr(neardup, "SAMPLED", 64 if band > 3 else 1)
    rng = random.Random(9)
    rows, i = [], 0
    for n in (3, 8, 12, 30, 90, 300, 900):
        for _ in range(3):
            base = [f"b{rng.randrange(10**6)}" for _ in range(n)]
            for k in (0, 0, 1, 1, 2, 3, 5, 9):
                rows.append((i * 7 % 1009, edited(base, rng, min(k, n // 10 + 1))))
                i += 1
    rows += [(2000, None), (2001, ""), (2002, " \t\n"), (2003, "One TWO three"), (2004, "one two THREE"), (2005, "é É"), (2006, "É É"), (2007, "x " * 60_000)]
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, n_shingles int")
    want = brute(rows)
    got = neardup.dedup_documents(docs)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()} == want
    twice = neardup.dedup_documents(docs.union(docs).union(spark.createDataFrame([(None, "one two three", 0)], docs.schema))).collect()
    assert len(twice) == 2 * len(rows) + 1 and {(r.doc_id, r.component_id) for r in twice if r.doc_id is not None} == {(d, c) for d, (_, c) in want.items()}
    kept = neardup.keep_one(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {c for _, c in want.values()}
    assert neardup.dedup_documents(docs.limit(0)).count() == 0


def test_against_brute_force_on_tables(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.dedup_documents(docs).collect()}
    assert got == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_rows_without_an_id_are_copies_too(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(None, text, 1), (None, text, 1), (7, "other words " * 9, 2), (None, "other words " * 9, 2), (None, "", 3), (None, None, 4), (None, " ", 5), (None, "one two", 6), (3, "", 7), (3, "", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, root int")
    assert sorted(r.root for r in neardup.keep_one(docs).collect()) == [1, 2, 3, 4, 5, 6, 7]


def test_large_groups_in_small_blocks(spark, monkeypatch):
    """One group of near copies that spans many blocks, and one whose chain leaves the first class behind."""
    monkeypatch.setattr(neardup, "BLOCK_CLASSES", 8)
    rng = random.Random(3)
    base = [f"b{i}" for i in range(200)]
    rows = [(i, edited(base, rng, 1)) for i in range(80)]
    chain = [f"c{i}" for i in range(120)]
    for i in range(60):
        chain[(i * 2) % 120] = f"d{i}"
        rows.append((1000 + i, " ".join(chain)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.dedup_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)


def test_pruning_follows_the_threshold():
    assert (neardup.least_alike(80), neardup.least_alike(85)) == (42, 45)
    for percent in (80, 85):
        # The chance that a pair at the threshold has fewer bits alike, in exact fractions.
        least, p = neardup.least_alike(percent, 512), (1 + Fraction(percent, 100)) / 2
        below = lambda n: sum(comb(512, k) * p**k * (1 - p) ** (512 - k) for k in range(n))  # noqa: E731, B023
        assert below(least) <= Fraction(3, 10**8) < below(least + 1)
    with pytest.raises(ValueError):
        neardup.least_alike(60)


def test_alike_links_span_what_is_alike():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**64, (6, 8), dtype=np.uint64)
    signs = base[rng.integers(0, 6, 90)]
    signs ^= np.uint64(1) << rng.integers(0, 64, signs.shape, dtype=np.uint64)
    alike = lambda i, j: 512 - int(np.bitwise_count(signs[i] ^ signs[j]).sum()) >= 437
    for side in (None, np.arange(90) % 2):
        up = list(range(90))

        def root(i):
            while up[i] != i:
                i = up[i]
            return i

        for i in range(90):
            for j in range(i):
                if alike(i, j) and (side is None or side[i] != side[j]):
                    up[root(i)] = root(j)
        want = [root(i) for i in range(90)]
        found = neardup.alike_links(signs, side, 437)
        assert len(found) == 90 - len(set(want)) and all(alike(i, j) and (side is None or side[i] != side[j]) for i, j in found)
        up = list(range(90))
        for i, j in found:
            up[root(i)] = root(j)
        assert len({(a, root(i)) for i, a in enumerate(want)}) == len(set(want))


@pytest.mark.parametrize("block", [4096, 64])
def test_pages_of_one_template_send_no_texts(spark, monkeypatch, block):
    """Many pages that share half of their shingles fall into loose clusters, but not into clusters; the few near copies among them are found."""
    monkeypatch.setattr(neardup, "BLOCK_SIGNATURES", block)
    rng = random.Random(5)
    shared = " ".join(f"t{i}" for i in range(420))
    pages = [(i, f"{shared} " + " ".join(f"p{rng.randrange(10**7)}" for _ in range(180))) for i in range(240)]
    copies = [(1000 + i, edited(pages[i * 16][1].split(" "), rng, 3)) for i in range(12)]
    docs = spark.createDataFrame(pages + copies, "doc_id long, text string")
    classes = neardup.sets_of(docs).where("set_key is not null")
    assert components(neardup.candidates(classes, 85)).count() > 120
    near = neardup.clusters_of(classes, 85)
    assert 12 <= near.count() <= 60
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.dedup_documents(docs).collect()}
    assert got == brute(pages + copies)

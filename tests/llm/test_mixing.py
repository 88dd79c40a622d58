import math
import re
from collections import defaultdict

import pytest

from tracery.llm import mixing


def brute_targets(sizes, share=1.5, passes=2):
    """Pours words in one source at a time until it is full."""
    weights, full, left = [(3, 1, 2)[i % 3] for i in range(len(sizes))], set(i for i, n in enumerate(sizes) if not n), share * sum(sizes)
    out = [0.0] * len(sizes)
    while left > 1e-9 and len(full) < len(sizes):
        open_ = [i for i in range(len(sizes)) if i not in full]
        level = min((passes * sizes[i] - out[i]) / weights[i] for i in open_)
        level = min(level, left / sum(weights[i] for i in open_))
        for i in open_:
            out[i] += level * weights[i]
            left -= level * weights[i]
            if passes * sizes[i] - out[i] < 1e-9:
                full.add(i)
    return out


@pytest.mark.parametrize("sizes", [[10, 10, 10], [1, 100, 5, 7], [0, 4], [5], [0, 0], [], [1000, 1, 1, 1, 50, 2]])
def test_targets(sizes):
    weights = [(3, 1, 2)[i % 3] for i in range(len(sizes))]
    assert mixing.targets(sizes, weights) == pytest.approx(brute_targets(sizes))


def check(docs, slack=0):
    out = mixing.mix_documents(docs)
    rows, again = out.collect(), out.collect()
    texts = docs.select("doc_id", "text", "source").collect()
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.taken)
    assert sorted(rows, key=key) == sorted(again, key=key) and len(rows) == len(texts)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    per = defaultdict(int)
    for r in texts:
        per[r.source] += size(r.text)
    names = sorted(per, key=lambda s: (s is None, s or ""))
    goal = dict(zip(names, brute_targets([per[s] for s in names]), strict=True))
    assert sorted(r["size"] for r in rows) == sorted(size(r.text) for r in texts)
    assert all(0 <= r.taken <= 2 * r["size"] for r in rows)
    if len({r.doc_id for r in texts}) == len(texts):
        source, took = {r.doc_id: r.source for r in texts}, defaultdict(int)
        for r in rows:
            took[source[r.doc_id]] += r.taken
            assert r.source_size == per[source[r.doc_id]] and r.target == pytest.approx(goal[source[r.doc_id]])
        assert all(abs(took[s] - goal[s]) <= 1 + max(1, goal[s] / mixing.PACKETS) for s in names)
        assert sum(took.values()) == math.floor(sum(goal.values()) + 1e-6)
    return rows


def test_mix_edges(spark):
    rows = [(1, "a b c", "s1", 1), (2, None, "s1", 1), (3, "", None, 1), (4, "x " * 50_000, "s2", 1), (5, "u v", None, 1), (6, "w w q", "é", 1), (7, "k " * 900, "s1", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size int")
    check(docs)
    check(docs.union(docs).union(spark.createDataFrame([(None, "m n", "s1", 1)], docs.schema)))
    check(docs.where("doc_id in (2, 3)"))
    assert mixing.mix_documents(docs.limit(0)).count() == 0


def test_mix_on_tables(spark, sf, monkeypatch):
    monkeypatch.setattr(mixing, "SLOT_ROWS", 3)
    check(spark.read.parquet(f"{sf}/documents.parquet"))


def test_mixed_is_the_mix(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got, plan = mixing.mixed(docs).collect(), {r.doc_id: r for r in mixing.mix_documents(docs).collect()}
    words, whole = defaultdict(int), {r.doc_id: r.text for r in docs.collect()}
    for r in got:
        words[r.doc_id] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text))
        assert whole[r.doc_id].startswith(r.text) and r.n_chars == len(r.text)
    assert all(words[i] == r.taken for i, r in plan.items())


def merged_by_hand(docs, budget):
    """Serves packet after packet in the order of finish times, from the queues as schedule made them, until the budget is used up."""
    queue = []
    for r in docs:
        q = max(int(r["target"] // mixing.PACKETS), 1)
        for i in range(max(-(-r["size"] // q), 1)):
            end = min((i + 1) * q, r["size"])
            if r["target"] > 0 and r["size"] > 0:
                queue.append(((r["served"] + end) / r["target"], r["no"], r["epoch"], r["turn"], r["tie"], i, end - i * q, r["id"]))
    took = defaultdict(int)
    for *_, words, i in sorted(queue):
        took[i] += min(words, budget)
        budget -= min(words, budget)
    return took


@pytest.mark.parametrize("budget", [0, 1, 700, 4_321, None, 10**9])
def test_the_merged_order_is_cut_at_the_budget(spark, sf, monkeypatch, budget):
    """The cut takes words away: of smaller budgets every source gets its share of the time, not its target."""
    monkeypatch.setattr(mixing, "SORTED", 40)
    seen = []
    inner = mixing.cut
    monkeypatch.setattr(mixing, "cut", lambda queued, words: seen.append((queued, words)) or inner(queued, words))
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = mixing.schedule(docs, docs["doc_id"].alias("id"), budget=budget).collect()
    took = defaultdict(int)
    for r in rows:
        took[r.id] += r.taken
    queued, budget = seen[0]
    want = merged_by_hand([r.asDict() | {"id": r.row.id} for r in queued.collect()], budget)
    assert {i: n for i, n in took.items() if n} == {i: n for i, n in want.items() if n}
    assert sum(took.values()) == min(budget, sum(r["size"] for r in rows))


def test_equal_rows_are_mixed_each(spark):
    docs = spark.createDataFrame([(1, "a b c d", "s", 7, {"k": 1})] * 3 + [(2, "e f", "t", 3, {"k": 2}), (None, None, None, None, None)], "doc_id long, text string, source string, n_chars long, m map<string,int>")
    n = lambda rows: sum(len(r.text.split()) for r in rows)
    assert n(mixing.mixed(docs).collect()) == sum(r.taken for r in mixing.mix_documents(docs).collect()) == 21


def test_maps_at_any_depth(spark):
    docs = spark.createDataFrame(
        [(1, "a b c d", "s", 7, {"m": {"k": 1}, "n": 1}, [{"a": [1]}])] * 2 + [(1, "a b c d", "s", 7, {"m": {"k": 2}, "n": 1}, [{"a": [1]}]), (2, "e f", "t", 3, None, None)],
        "doc_id long, text string, source string, n_chars long, x struct<m:map<string,int>,n:int>, y array<map<string,array<int>>>",
    )
    rows = mixing.mixed(docs).collect()
    assert {r.doc_id for r in rows} == {1, 2} and sorted({r.x.m["k"] for r in rows if r.doc_id == 1}) == [1, 2] and mixing.mixed(docs).columns == docs.columns

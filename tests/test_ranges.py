"""Evidence ranges: what a digest tells, whatever blocks a session is cut into."""

import pytest
from pyspark.sql import functions as F

from tracery.operators import ranges

SHAPE = "session_id string, ordinal long, role string, content string"


@pytest.mark.parametrize("block", [2, 3, 4096])
def test_changed_moved_and_lost_messages_are_told(spark, monkeypatch, block):
    monkeypatch.setattr(ranges, "BLOCK", block)
    rows = [(s, i, "user", f"{s}{i}") for s in "ab" for i in range(8)] + [("n", 0, "user", None), ("n", 1, "user", "-"), ("n", 2, "user", "")]
    frame = lambda r: spark.createDataFrame(r, SHAPE)
    spans = spark.createDataFrame([("whole", "a", 0, 7), ("mid", "a", 2, 5), ("one", "a", 3, 3), ("end", "a", 5, 7), ("past", "a", 6, 8), ("back", "a", 5, 4), ("minus", "a", -1, 2), ("none", "z", 0, 1), ("other", "b", 2, 5), ("nulls", "n", 0, 2)], "entry string, session_id string, first long, last long")
    kept = ranges.range_digests(spans, frame(rows), ["role", "content"]).withColumnRenamed("digest", "kept").drop("n")
    verdicts = lambda r: {x.entry: x.verdict for x in ranges.evidence_verdicts(kept, frame(r), ["role", "content"]).collect()}
    same = verdicts(rows[::-1])
    assert same == {"whole": "intact", "mid": "intact", "one": "intact", "end": "intact", "past": "missing", "back": "invalid", "minus": "invalid", "none": "missing", "other": "intact", "nulls": "intact"}
    told = lambda r: {k: v for k, v in verdicts(r).items() if v != same[k]}
    change = lambda f: [f(x) for x in rows if f(x)]
    assert told(change(lambda x: ("a", 4, "user", "new") if x[:2] == ("a", 4) else x)) == {"whole": "changed", "mid": "changed"}
    assert told(change(lambda x: None if x[:2] == ("a", 4) else x)) == {"whole": "gap", "mid": "gap"}
    assert told(change(lambda x: None if x[:2] == ("a", 7) else x)) == {"whole": "missing", "end": "missing"}
    swap = {2: 3, 3: 2}
    assert told(change(lambda x: (x[0], swap.get(x[1], x[1]), *x[2:]) if x[0] == "a" else x)) == {"whole": "changed", "mid": "changed", "one": "changed"}
    assert told(change(lambda x: ("n", 0, "user", "-") if x[:2] == ("n", 0) else x)) == {"nulls": "changed"}
    assert ranges.evidence_verdicts(kept.limit(0), frame(rows), ["content"]).count() == 0
    assert set(ranges.evidence_verdicts(kept, frame(rows).where(F.lit(False)), ["content"]).select("verdict").distinct().toPandas()["verdict"]) == {"missing", "invalid"}


def test_calls_are_dealt_to_tasks_of_bounded_size(spark, sf, monkeypatch):
    from tracery.sources import tables

    monkeypatch.setattr(tables, "TASK_ROWS", 500)
    lines = tables.read(spark, sf, "lineitem")
    dealt = tables.lens(spark, sf).calls
    assert dealt.rdd.getNumPartitions() == -(-lines.count() // 500) > 4
    monkeypatch.undo()
    assert sorted(map(tuple, dealt.collect())) == sorted(map(tuple, tables.lens(spark, sf).calls.collect()))

import random

from pyspark.sql import functions as F

from tracery.functions import blocks
from tracery.operators import coach, text


def plan(df):
    return df._jdf.queryExecution().toString()


def test_vectors_meet_in_blocks_as_they_meet_in_place(spark, monkeypatch):
    monkeypatch.setattr(blocks.in_blocks, "__defaults__", (4,))
    draw = random.Random(1)
    rows = [(i, [float(draw.randint(-3, 3)) for _ in range(3)] + [1.0]) for i in range(20)]
    vectors = spark.createDataFrame([*rows, *((i + 20, x) for i, x in rows), (40, None)], "vec_id long, embedding array<float>")
    asked = vectors.where("vec_id % 3 = 0")
    far, near = text.semantic(vectors, asked, few=False), text.semantic(vectors, asked)
    assert "CartesianProduct" not in plan(far)
    key = lambda df: sorted(map(tuple, df.select("query", "vec_id", "similarity", "rank").collect()), key=str)
    assert key(far) == key(near) and far.count() == 14 * 5
    zero = vectors.limit(3).unionByName(spark.createDataFrame([(50, [0.0] * 4)], vectors.schema))
    assert [r.vec_id for r in text.semantic(zero, zero.limit(1), k=1, few=False).collect()] == [50]
    assert text.semantic(vectors, asked.limit(0), few=False).count() == text.semantic(vectors.limit(0), asked, few=False).count() == 0


def test_entries_meet_queries_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(blocks.in_blocks, "__defaults__", (4,))
    draw = random.Random(2)
    say = lambda n: " ".join(draw.choice(["the", "tree", "x_1", "fix", "parser", "bug", "run", "ü"]) for _ in range(n))
    entries = [(f"e{i}", say(6), "evidence", i % 4 / 4) for i in range(25)] + [("f1", "fix bug", "evidence", None), ("none", "zz", "zz", 0.5)]
    queries = [(f"q{i}", say(4)) for i in range(9)] + [("empty", "?")]
    e = spark.createDataFrame(entries, "key string, text string, evidence string, confidence double")
    q = spark.createDataFrame(queries, "query string, text string")
    out = coach.rank_entries(q, e)
    # Before, the pairs of queries and entries were grouped, and shuffled for that.
    assert "FlatMapCoGroupsInArrow" in plan(out)
    told = lambda df: df.select(F.col(df.columns[0]).alias("k"), F.explode(coach.words(F.col("text"))).alias("w")).collect()
    words, asked = {}, {}
    for into, df in ((words, e.select("key", F.concat_ws(" ", "text", "evidence").alias("text"))), (asked, q)):
        for k, w in told(df):
            into.setdefault(k, set()).add(w)
    from math import log

    n, df_of = len(entries), lambda w: sum(w in x for x in words.values())
    idf = lambda w: log(1 + (n - df_of(w) + 0.5) / (df_of(w) + 0.5)) + 1 + (2 if set(w) & set("_0123456789") else 0)
    want = []
    for k, own in asked.items():
        scored = [(None if c is None else round(sum(map(idf, own & words[key])) + 0.1 * c, 6), key) for key, _, _, c in entries if own & words[key]]
        scored.sort(key=lambda x: (x[0] is None, -(x[0] or 0), x[1]))
        want += [(k, key, s, i) for i, (s, key) in enumerate(scored[:5], 1)]
    assert sorted(map(tuple, out.select("query", "key", "score", "rank").collect())) == sorted(want)


def test_phrases_are_of_three_to_five_words(spark):
    got = spark.createDataFrame([("parser bug login form tree parser bug login",), ("parser bug",), (None,)], "text string").select(coach.phrases(F.col("text")).alias("p")).collect()
    assert len(got[0].p) == 6 + 5 + 4 - 1 and {(x.p, x.n) for x in got[0].p} >= {("parser bug login", 3), ("bug login form tree parser", 5)} and got[1].p == []

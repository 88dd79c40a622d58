import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracery.llm import toxicity as tox


def patterns(text):
    return [[tox.PATTERNS[p] if p < tox.LATE else "target" for p in m.patterns] for m in tox.matches([text], tox.known())[2]]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("What an idiot.", [["insult"]]),
        ("You are an idiot.", [["insult+aimed"]]),
        ("You, of all the many people here, idiot.", [["insult"]]),
        ("An idiot is what you are.", [["insult", "target"]]),
        ("He is not an idiot.", [["insult+negated+aimed"]]),
        ("Not that it matters to him, idiot!", [["insult+aimed"]]),
        ("The witness said she was a moron; scum.", [["insult+reported+aimed"], ["insult"]]),
        ("She wrote that it isn't stupid", [["insult+negated+reported"]]),
        ("I will kill you tonight", [["threat", "target"]]),
        ("Not. Idiot", [["insult"]]),
        ("nothing here\nidiotic", []),
        ("Du bist kein Dummkopf", [["insult+negated+aimed"]]),
        ("IDIOT idiot's idiot", [["insult", "insult"]]),
    ],
)
def test_clauses(text, want):
    assert patterns(text) == want


def plain_events(text, lexicon):
    """Labels and weights of a text's matches word by word, from the description of the grammar."""
    held = {int(h): (int(k), float(w)) for h, k, w in zip(*lexicon, strict=True)}
    out = []
    for clause in re.split(r"[.!?;:\n\r]", tox.lowered(text)):
        said, negated, target, hit = False, 0, 0, 0
        for word in re.findall(r"[^\W\d_]+(?:['’][^\W\d_]+)*", clause):
            own = [held[h] for h in (tox.word_hash(word), *(int(tox.tokens(word).hashes(np.array([0]), k)[0]) for k in tox.STEMS if len(word) > k)) if h in held]
            kind, weight = (own and max(own, key=lambda x: x[1])) or (tox.OTHER, 0.0)
            match = kind in (tox.INSULT, tox.THREAT)
            if match:
                out.append(((kind == tox.THREAT) + 2 * (negated > 0) + 4 * said + 8 * (target > 0), weight))
            elif kind == tox.TARGET and hit:
                out.append((16, 1.0))
            said |= kind == tox.REPORT
            negated = 3 if kind == tox.NEGATION else max(negated - 1, 0)
            target = 4 if kind == tox.TARGET else max(target - 1, 0)
            hit = 4 if match else 0 if kind == tox.TARGET else max(hit - 1, 0)
    return out


def plain_score(text, model):
    events = plain_events(text or "", model.lexicon)
    x = [sum(w for k, w in events if k == i) for i in range(17)]
    x.append(100 * sum(x[:16]) / (len(re.findall(r"[^\W\d_]+(?:['’][^\W\d_]+)*", tox.lowered(text or ""))) + 10))
    return 1 / (1 + np.exp(-(model.bias + sum(w * np.log1p(v) for w, v in zip(model.weights, x, strict=True)))))


def test_the_machine_against_words_one_by_one():
    rng = np.random.default_rng(3)
    vocabulary = ["idiot", "scum", "kill", "you", "they", "not", "never", "said", "called", "green", "trees", "grow", ".", "\n", "isn't"]
    texts = [" ".join(rng.choice(vocabulary, rng.integers(0, 60))) for _ in range(300)]
    lexicon = tox.known()
    _, events, _ = tox.matches(texts, lexicon)
    for i, text in enumerate(texts):
        assert [(k, w) for t, k, w in events if t == i] == plain_events(text, lexicon)


def test_long_texts_are_cut_at_clauses(monkeypatch):
    text = "You are an idiot. Green trees said nothing; scum! " * 40
    want = tox.matches([text, "scum"], tox.known())
    monkeypatch.setattr(tox, "PIECE", 64)
    got = tox.matches([text, "scum"], tox.known())
    assert (got[0] == want[0]).all() and got[1] == want[1] and got[2] == want[2]
    assert all(text[m.start : m.end].split()[-1] in ("idiot", "scum") for m in want[2] if m.text == 0)
    assert list("".join(p for _, p in tox.pieces("x" * 300))) == ["x"] * 300


def test_stems_are_learnt_and_odd_words_are_not(spark):
    """A made-up language: stems with other endings in toxic texts; words of one copied toxic text must not do."""
    rng = np.random.default_rng(8)
    word = lambda: "".join(rng.choice(["ba", "de", "ki", "lo", "mu"], 3))
    rows = []
    for i in range(900):
        said = [word() for _ in range(40)]
        if i % 6 == 0:
            for _ in range(5):
                said[int(rng.integers(0, 40))] = "zarkon" + rng.choice(["ba", "de", "ki", "lo", "mu"])
        rows.append((i, " ".join(said), int(i % 6 == 0)))
    rows += [(1000 + i, "this zarkonba text with peculiar syllables zarkonde zarkonmu", 1) for i in range(50)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    got = {r.doc_id: r for r in tox.score_documents(docs, labels).collect()}
    assert np.mean([got[i].predicted == y for i, _, y in rows]) > 0.99
    extra = spark.createDataFrame([(1, "a text with peculiar syllables " + " ".join(word() for _ in range(40)))], "doc_id long, text string")
    assert tox.score(extra, tox.model_of(docs, labels), F.col("doc_id")).first().score < 0.3


def test_the_query_against_plain_python(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = tox.model_of(docs, labels)
    got = {r.doc_id: r for r in tox.score_documents(docs, labels).collect()}
    rows = docs.collect()
    assert len(got) == len(rows)
    for r in rows:
        assert got[r.doc_id].score == pytest.approx(plain_score(r.text, model), abs=1e-9)
        assert got[r.doc_id].predicted == (got[r.doc_id].score >= 0.5) and got[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)


def test_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rows = tox.score_documents(docs, labels).where("held_out").join(labels, "doc_id").select("predicted", "toxic").collect()
    caught = np.mean([r.predicted for r in rows if r.toxic == 1])
    assert caught > 0.85 and np.mean([r.predicted for r in rows if r.toxic == 0]) < 0.01


def test_labels_of_held_out_rows_teach_nothing(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    turned = labels.withColumn("toxic", F.when(tox.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (sorted(map(tuple, tox.score_documents(docs, x).select("doc_id", "score").collect())) for x in (labels, turned))
    assert a == b


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, "you idiot " * 30_000), (3, "you idiot"), (3, "you idiot"), (None, "scum"), (4, "İdiot ßtupid 1234 __"), (5, "😀 fine".encode("utf-16", "surrogatepass").decode("utf-16"))]
    docs = spark.createDataFrame([(i, t, 0.5) for i, t in rows], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, 1), (2, None), (None, 1), (3, 1), (5, 0), (5, 0), (99, 0), (4, 7)], "doc_id long, toxic int")
    out = tox.score_documents(docs, labels)
    got = out.collect()
    assert out.columns == ["doc_id", "held_out", "score", "predicted"] and len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert all(r.predicted == 1 for r in got if r.doc_id == 3) and all(r.predicted == 0 for r in got if r.doc_id in (1, 2, 5))
    bare = tox.score_documents(docs, labels.limit(0)).collect()
    assert all(r.predicted == 1 for r in bare if r.doc_id == 3)
    assert tox.score_documents(docs.limit(0), labels).count() == 0
    model = tox.Model(tox.known(), *tox.prior())
    kept = tox.score(docs, model, F.col("doc_id"), F.col("score"))
    assert kept.columns == ["doc_id", "score_", "score"]
    told = tox.clauses(docs, model, F.col("doc_id"), F.col("score"), F.lit(1).alias("weight"))
    assert told.columns == ["doc_id", "score", "weight_", "start", "end", "patterns", "weight"]
    assert [tuple(r) for r in told.where("doc_id is null").collect()] == [(None, 0.5, 1, 0, 4, ["insult"], tox.PRIOR_WEIGHT)]

import math
import zlib
from collections import Counter

import pytest

from tracery.llm import langid


def test_grams_stay_in_their_text():
    both, n = langid.grams(["Ab, c!", "", "xyz"], 12)
    ends = n.cumsum()
    for i, text in enumerate(["Ab, c!", "", "xyz"]):
        own, _ = langid.grams([text], 12)
        assert both[ends[i] - n[i] : ends[i]].tolist() == own.tolist()
    assert langid.grams(["a--- b"], 12)[0].tolist() == langid.grams(["A b"], 12)[0].tolist()


def test_model_is_naive_bayes_over_all_rows(spark):
    rows = [("aaa bbb", "x"), ("aaa", "x"), ("ccc ddd", "y"), (None, "y"), ("aaa", None)] * 3
    langs, logs = langid.train(spark.createDataFrame(rows, "text string, lang string").repartition(4), bits=12)
    assert langs == ["x", "y"]
    for j, lang in enumerate(langs):
        counts = Counter()
        for text, own in rows:
            if text and own == lang:
                counts.update(langid.grams([text], 12)[0].tolist())
        total = sum(counts.values()) + 0.1 * (1 << 12)
        for bucket in list(counts)[:20] + [0, 5]:
            assert math.isclose(logs[bucket, j], math.log((counts[bucket] + 0.1) / total), rel_tol=1e-5)
    best, sure = langid.score(["aaa bbb", "ddd", "...", None, ""], langs, logs)
    assert best == ["x", "y", "und", "und", "und"] and sure[0] > 0.9 and sure[2] == 0


def test_predict_documents_edges(spark):
    rows = [(i, "the cat and the dog", "en", 1) for i in range(20)] + [(i, "der hund und die katze", "de", 1) for i in range(20, 40)]
    rows += [(40, None, "en", 1), (41, "", None, 1), (42, "123 !", "de", 1), (None, "und die katze", None, 1), (43, "the cat " * 50_000, None, 1), (43, "the cat " * 50_000, None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    out = {r.doc_id: r for r in langid.predict_documents(docs).collect()}
    assert out[40].lang_pred == out[41].lang_pred == out[42].lang_pred == "und"
    assert out[None].lang_pred == "de" and out[43].lang_pred == "en" and out[0].lang_pred == "en"
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in out.items() if i is not None)
    empty = langid.predict_documents(docs.limit(0))
    assert empty.count() == 0 and empty.columns == ["doc_id", "held_out", "lang_pred", "score"]
    unlabelled = langid.predict_documents(docs.selectExpr("doc_id", "text", "cast(null as string) lang"))
    assert {r.lang_pred for r in unlabelled.collect()} == {"und"}


def test_predictions_against_plain_python(spark, sf):
    """Every prediction of the query from counts that are kept in dicts."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = docs.collect()
    counts, size = {}, 1 << langid.BITS
    for r in rows:
        if r.lang is not None and r.text is not None and zlib.crc32(str(r.doc_id).encode()) % 4 != 2:
            counts.setdefault(r.lang, Counter()).update(langid.grams([r.text], langid.BITS)[0].tolist())
    total = {lang: sum(c.values()) + 0.1 * size for lang, c in counts.items()}
    got = {r.doc_id: r for r in langid.predict_documents(docs).collect()}
    for r in rows:
        own = langid.grams([r.text], langid.BITS)[0].tolist()
        logs = {lang: sum(math.log((c[b] + 0.1) / total[lang]) for b in own) for lang, c in counts.items()}
        best = max(sorted(logs), key=logs.get)
        assert got[r.doc_id].lang_pred == best
        assert math.isclose(got[r.doc_id].score, 1 / sum(math.exp(x - logs[best]) for x in logs.values()), rel_tol=1e-2)


def test_clashing_names_and_too_many_languages(spark, monkeypatch):
    docs = spark.createDataFrame([("aa", "x", 1), ("bb", "y", 2), (None, "z", 3)], "text string, lang string, score int")
    model = langid.train(docs)
    out = langid.identify(docs, model, docs["score"], docs["lang"])
    assert out.columns == ["score_", "lang", "lang_pred", "score"] and {r.score_ for r in out.collect()} == {1, 2, 3}
    monkeypatch.setattr(langid, "MAX_LANGS", 1)
    with pytest.raises(ValueError, match="languages"):
        langid.train(docs)


def test_held_out_accuracy(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = langid.predict_documents(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(out) > 20 and sum(r.lang == r.lang_pred for r in out) / len(out) > 0.97

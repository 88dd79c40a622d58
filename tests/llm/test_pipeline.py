import re
from collections import Counter, defaultdict

import corpus_pipeline
from tracery.llm import mixing, pieces, quality
from tracery.llm.common import shared_folder

from .test_mixing import brute_targets
from .test_neardup import brute_sets
from .test_secrets import brute as brute_secrets


def test_stages_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, labels = docs.columns, spark.read.parquet(f"{sf}/labels.parquet")
    folder, got = shared_folder(spark), [docs.collect()]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
        got.append(docs.collect())
        assert docs.columns == columns or i == 4
    first, good, unique, masked, mix, coded = got
    model = quality.model_of(spark.createDataFrame(first, "doc_id long, text string, lang string, source string, n_chars long"), labels)
    assert {r.doc_id for r in good} == {r.doc_id for r, p in zip(first, quality.tails(model, [r.text for r in first]), strict=True) if p[-1] >= 0.5}
    sets = {r.doc_id: brute_sets(r.text) for r in good}
    by = defaultdict(set)
    for i, s in sets.items():
        for x in s:
            by[x].add(i)
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for own in by.values():
        for i in own:
            for j in own:
                if i < j:
                    both = len(sets[i] & sets[j])
                    if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                        a, b = root(i), root(j)
                        up[max(a, b)] = min(a, b)
    assert sorted(r.doc_id for r in unique) == sorted({root(i) for i in sets})
    was = {r.doc_id: r for r in unique}
    assert len(masked) == len(unique)
    for r in masked:
        spans = brute_secrets(was[r.doc_id].text)
        assert (r.text == was[r.doc_id].text) == (not spans) and not brute_secrets(r.text) and r.n_chars == len(r.text)
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    size, taken = Counter(), Counter()
    for r in masked:
        size[r.source] += words(r.text)
    for r in mix:
        taken[r.source] += words(r.text)
    names = sorted(size)
    for s, goal in zip(names, brute_targets([size[s] for s in names]), strict=True):
        assert abs(taken[s] - goal) <= 1 + max(1, goal / mixing.PACKETS)
    assert len(coded) == sum(2 if r.text else 1 for r in mix) and all(r.decodes for r in coded)
    assert len({(r.doc_id, r.repeat, r.sample) for r in coded}) == len(coded)
    drawn = defaultdict(dict)
    for r in coded:
        drawn[r.doc_id, r.sample][r.repeat] = r.ids_sha256
    twice = [x for x in drawn.values() if len(x) == 2]
    assert twice and sum(len(set(x.values())) == 2 for x in twice) > 0.9 * len(twice)  # each pass is sampled anew
    vocabulary = pieces.load()
    texts = {(r.doc_id, r.text) for r in mix}
    assert {(r.doc_id, pieces.decode(r.ids, vocabulary)) for r in coded} == texts


def test_run_gives_the_last_stage(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    assert out.count() > 0 and "ids" in out.columns
    assert len(corpus_pipeline.STAGES) == 5

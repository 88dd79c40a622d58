import math
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tracery.llm import pieces

TOY = [("▁", -3.0), ("a", -2.0), ("b", -2.5), ("ab", -3.0), ("▁a", -3.2), ("ba", -3.5), ("aa", -4.0), ("▁ab", -5.0)]


REAL = []


@pytest.fixture(scope="module")
def toy():
    return pieces.vocabulary([(256 + i, t, p) for i, (t, p) in enumerate(TOY)], list(range(256)), -9.0, 256 + len(TOY))


@pytest.fixture(scope="module")
def real():
    return pieces.load()


def brute(text, vocabulary):
    """Every segmentation (ids) and its log probability, normalised."""
    s = pieces.SPACE + text.replace(" ", pieces.SPACE)
    table = {t: (256 + i, p) for i, (t, p) in enumerate(TOY)}
    out = {}

    def go(i, ids, log):
        if i == len(s):
            out[tuple(ids)] = log
            return
        for n in range(1, 4):
            if s[i : i + n] in table and i + n <= len(s):
                j, p = table[s[i : i + n]]
                go(i + n, [*ids, j], log + p)
        if s[i] not in table:
            own = list(s[i].encode())
            go(i + 1, ids + own, log - 9.0 * len(own))

    go(0, [], 0.0)
    total = math.log(sum(map(math.exp, out.values())))
    return {k: v - total for k, v in out.items()}


@pytest.mark.parametrize("text", ["ab", "aba ba", "a\nbé", "  aab", "z"])
def test_all_segmentations_come_out_in_order(toy, text):
    want = brute(text, toy)
    got = pieces.sample([text], [7], toy, k=len(want) + 3)[0]
    assert {tuple(g[0].tolist()) for g in got} == set(want) and len(got) == len(want)
    assert all(math.isclose(g[1], want[tuple(g[0].tolist())], abs_tol=1e-9) for g in got)
    scores = [g[2] for g in got]
    assert scores == sorted(scores, reverse=True) and all(g[3] == 0.0 for g in got)


def test_draws_follow_sampling_without_replacement(toy):
    text, n = "aba ba", 6000
    p = {k: math.exp(v) for k, v in brute(text, toy).items()}
    got = pieces.sample([text] * n, [k * 2654435761 for k in range(n)], toy, k=2)
    first, second = Counter(tuple(g[0][0].tolist()) for g in got), Counter(tuple(g[1][0].tolist()) for g in got)
    for own, expected in ((first, p), (second, {b: sum(p[a] * p[b] / (1 - p[a]) for a in p if a != b) for b in p})):
        chi2 = sum((own[x] - n * e) ** 2 / (n * e) for x, e in expected.items())
        df = len(p) - 1
        assert chi2 < df + 4 * math.sqrt(2 * df)
    # Inclusion: the mean of 1 / inclusion over the drawn is 1 for each segmentation.
    weight = Counter()
    for g in got:
        for ids, _, _, log_inclusion in g:
            weight[tuple(ids.tolist())] += 1 / math.exp(log_inclusion)
    common = max(p, key=p.get)
    assert abs(weight[common] / n - 1) < 0.1


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=5))
def test_round_trip_and_independence_of_the_batch(texts):
    real = REAL[0] if REAL else REAL.append(pieces.load()) or REAL[0]
    together = pieces.sample(texts, list(range(len(texts))), real, k=3)
    for i, text in enumerate(texts):
        alone = pieces.sample([text], [i], real, k=3)[0]
        assert [(a[0].tolist(), a[2]) for a in alone] == [(b[0].tolist(), b[2]) for b in together[i]]
        assert len({tuple(a[0].tolist()) for a in alone}) == len(alone)
        assert all(pieces.decode(a[0].tolist(), real) == text for a in alone)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab \n▁é🙂", max_size=12), max_size=6))
def test_units_are_those_of_the_pattern(texts):
    import re

    cut = re.compile("\n|▁+[^▁\n]*|[^▁\n]+")
    want = [cut.findall("▁" + t.replace("▁", pieces.MARK).replace(" ", "▁")) if t else [] for t in texts]
    got = pieces.units_of(texts)
    ends = [*got.start.tolist(), len(got.codes)]
    flat = ["".join(map(chr, got.codes[a:b].tolist())) for a, b in zip(ends, ends[1:])]
    assert flat == [u for own in want for u in own] and got.n.tolist() == list(map(len, want))
    assert [flat[i] for i in got.own[got.unit].tolist()] == flat and len(got.own) == len(set(flat))


def test_units_with_one_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(pieces, "mix64", lambda x: x & np.uint64(1))
    got = pieces.units_of(["a bb a", "bb\na"])
    assert len(got.own) == 3 + 1 and got.unit[0] == got.unit[2]


def test_what_spells_another_text_is_told(real):
    ids = [x[0][0] for x in pieces.sample(["one", "two", ""], [1, 2, 3], real, k=1)]
    assert pieces.spell(ids, ["one", "two", ""], real) == [True] * 3
    assert pieces.spell(ids, ["one", "twp", ""], real) == [True, False, True]
    assert pieces.spell(ids[:2], ["onet", "wo"], real) == [False, False]


def test_vocabulary_has_no_piece_across_a_word_start(real):
    import re

    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    plain = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
    assert all(re.fullmatch("▁*[^▁\n]*", p) for p in plain)
    hashes = np.concatenate([p.hashes[p.ids >= 0] for p in real.by_length])
    assert len(set(hashes.tolist())) == len(plain)


def test_segment_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = pieces.segment_documents(docs).collect()
    assert len(rows) == 2 * docs.count() and all(r.decodes and r.log_prob < 0 and r.log_inclusion <= 0 for r in rows)
    odd = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "▁ ▁", "x"), (4, "word " * 60_000, "x"), (4, "word " * 60_000, "x"), (None, "q", "x"), (5, "x" * 30_000, "x")], "doc_id long, text string, ids string")
    got = pieces.segment_documents(odd, with_ids=True).collect()
    assert all(r.decodes for r in got) and sum(r.doc_id == 4 for r in got) == 4
    assert [(r["n_pieces"], r["sample"]) for r in got if r.doc_id in (1, 2)] == [(0, 0), (0, 0)]
    assert pieces.segment_documents(odd.limit(0)).count() == 0


def test_the_pipelines_encoding_takes_little_memory(sf):
    """Texts of 4 MB: the arrays of one chunk at a time, and the same segmentations as with the larger chunk."""
    import tracemalloc

    import corpus_pipeline
    import pyarrow as pa
    import pyarrow.parquet as pq

    from tracery.llm.common import text_chunks

    texts = [t for t in pq.read_table(f"{sf}/documents.parquet").column("text").to_pylist() if t]
    vocabulary, turned = pieces.load(), [t[i:] + t[:i] for i in range(1, 60) for t in texts]
    size = np.cumsum([len(t.encode()) for t in turned])
    batch = pa.RecordBatch.from_pydict({"text": turned[: int(np.searchsorted(size, 4 << 20))]})

    def run(chunk):
        out, at = [], 0
        tracemalloc.start()
        try:
            for p in text_chunks([batch], limit=chunk):
                found = pieces.sample(p.column("text").to_pylist(), list(range(at, at + p.num_rows)), vocabulary)
                out, at = out + [hash(tuple((ids.tobytes(), *rest) for ids, *rest in own)) for own in found], at + p.num_rows
            return out, tracemalloc.get_traced_memory()[1]
        finally:
            tracemalloc.stop()

    (few, less), (many, more) = run(corpus_pipeline.ENCODED_AT_ONCE), run(pieces.CHUNK)
    assert few == many and len(few) == batch.num_rows and size[len(few) - 1] > 3 << 20
    assert less < 90e6 and 2 * less < more

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from tests.compare import connection, difference
from tracery.llm import merkle


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree(nodes):
    """All levels of a tree, from the contract."""
    levels = [list(nodes)]
    while len(levels[-1]) > 1:
        levels.append([H(*levels[-1][i : i + 2]) for i in range(0, len(levels[-1]), 2)])
    return levels


def proof(levels, at):
    out = []
    for level in levels[:-1]:
        out.append((at ^ 1 < at, level[at ^ 1]) if at ^ 1 < len(level) else None)
        at //= 2
    return out


def leaf(r, more=0):
    told = lambda x: "-" if x is None else f"{len(str(x).encode())}:{x}"
    return H(*(told(x) for x in (r.doc_id, r.source, r.lang, None if r.n_chars is None else r.n_chars + more, r.text)))


def definition(rows):
    langs = sorted({r.lang for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    own = {k: sorted((r for r in rows if r.lang == k), key=lambda r: (r.doc_id is not None, r.doc_id or 0, leaf(r))) for k in langs}
    trees = {k: tree([leaf(r) for r in own[k]]) for k in langs}
    top = tree([trees[k][-1][0] for k in langs])
    out = []
    for j, k in enumerate(langs):
        for i, r in enumerate(own[k]):
            path = proof(trees[k], i) + proof(top, j)
            node = leaf(r, 1 if r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 7 == 0 else 0)
            for step in path:
                node = H(node) if step is None else H(step[1], node) if step[0] else H(node, step[1])
            out.append((r.doc_id, trees[k][0][i], trees[k][-1][0], top[-1][0], H(*(s[1] for s in path if s)), node, node == top[-1][0]))
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [1, 2, 10])
def test_the_query_against_the_definition(spark, sf, monkeypatch, block):
    """Small superblocks make many rounds, with a last node alone at several levels."""
    monkeypatch.setattr(merkle, "BLOCK", block)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = sorted((tuple(r) for r in merkle.prove_documents(docs).collect()), key=str)
    assert got == definition(docs.collect())
    assert {r[6] for r in got} == {True, False} and sum(not r[6] for r in got) == sum(zlib.crc32(str(r[0]).encode()) % 7 == 0 for r in got)


def test_the_query_against_its_sql(spark, sf):
    assert difference(merkle.prove_documents(spark.read.parquet(f"{sf}/documents.parquet")), connection(sf), merkle.oracle()) is None


def test_edges(spark, monkeypatch):
    monkeypatch.setattr(merkle, "BLOCK", 2)
    rows = [(i, f"text {i}", None if i % 5 == 0 else ["en", "é", "", "z" * 50][i % 4], f"s{i % 3}" if i % 6 else None, i if i % 4 else None) for i in range(40)]
    rows += [(None, "lost", "en", "s", 4), (None, None, None, None, None), (7, "long " * 50_000, "en", "s", 9), (3, "same", "lone", "s", 4)] + [(8, "same", "en", "s", 4)] * 9
    docs = spark.createDataFrame([(*r, "kept", b"x") for r in rows], "doc_id long, text string, lang string, source string, n_chars int, tree string, node binary").repartition(5)
    out = merkle.prove_documents(docs)
    assert out.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    got = sorted((tuple(r) for r in out.collect()), key=str)
    assert got == definition(docs.collect())
    assert merkle.prove_documents(docs.limit(0)).collect() == []
    one = docs.where("text = 'lost'")
    assert [tuple(r) for r in merkle.prove_documents(one).collect()] == definition(one.collect())


def test_proofs_tell_what_changed(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = docs.select(F.col("lang").alias("tree"), F.col("doc_id").alias("id"), merkle.row_digest(F.col("text")).alias("leaf"), F.lit(None).cast("binary").alias("claimed"))
    got = merkle.manifest(rows, with_proofs=True).collect()
    for r in got:
        assert r.folded_root == r.root == merkle.folded(r.leaf, bytes(r.proof)) and r.proof_sha256 == merkle.digest(merkle.siblings(bytes(r.proof)))
        assert merkle.folded(H(r.leaf), bytes(r.proof)) != r.root

"""Merkle manifest of a data set: a tree of hashes for each language, a tree of their roots above, a proof for each row.

Rows are hashed where they are read; from then on only digests move. A tree's leaves are put in order by ranges
and numbered by what stands before in lower ranges, then cut into superblocks of 2**BLOCK nodes. Superblocks are
reduced to one node each, those nodes to superblocks of superblocks, and so on up to the root. On the way down,
superblocks and the path of outer nodes that each of them needs are cogrouped by superblock: one call of
applyInPandas finishes the local reduction, joins the local proofs to the outer ones and folds them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

#: Two nodes become one; a superblock holds 2**BLOCK of them.
BLOCK = 10
#: A step of a proof in bytes: which side the sibling stands on (0: there is none, 1: left, 2: right), and its digest.
STEP = 33
_NONE = b"\0" * STEP


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def depth_of(n: int) -> int:
    """Levels that a superblock of a tree with n nodes is reduced by."""
    return min(BLOCK, (n - 1).bit_length())


def reduced(nodes: list[str], depth: int) -> list[list[str]]:
    """All levels above nodes that stand next to each other, the first of them at an even place; the last node may be alone."""
    levels = [nodes]
    for _ in range(depth):
        below = levels[-1]
        levels.append([digest("".join(below[i : i + 2])) for i in range(0, len(below), 2)])
    return levels


def steps(levels: list[list[str]], at: int) -> bytes:
    """The proof of node `at`, up to the top of its superblock."""
    out = []
    for level in levels[:-1]:
        other = at ^ 1
        out.append((b"\2" if other > at else b"\1") + bytes.fromhex(level[other]) if other < len(level) else _NONE)
        at >>= 1
    return b"".join(out)


def siblings(proof: bytes) -> str:
    """The hexadecimal digests in a proof, one after the other."""
    return "".join(proof[i + 1 : i + STEP].hex() for i in range(0, len(proof), STEP) if proof[i])


def folded(node: str, proof: bytes) -> str:
    """The root that a node and its proof lead to."""
    for i in range(0, len(proof), STEP):
        other = proof[i + 1 : i + STEP].hex()
        node = digest(node if not proof[i] else other + node if proof[i] == 1 else node + other)
    return node


def row_digest(*columns: Column) -> Column:
    """SHA-256 of the columns' texts, each with its length in bytes before it; null is a dash. Runs in the JVM."""
    return F.unhex(F.sha2(F.concat(*(F.when(c.isNull(), "-").otherwise(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string"))) for c in columns)), 256))


def numbered(nodes: DataFrame, *order: str) -> DataFrame:
    """nodes with pos, the number of rows of the same tree before a row in `order`, and n, those of its tree. Null comes first.

    Rows go to ranges of (tree, order), a tree of very many rows to many of them; pos is what the range's rows and those of lower ranges tell.
    """
    placed = nodes.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order)
    placed = staged(placed.withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.shiftright("at", 33)))
    counts = placed.groupBy("tree", "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("rows"))
    whole = Window.partitionBy("tree")
    before = F.coalesce(F.sum("rows").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("tree", "part", (before - F.col("first")).alias("shift"), F.sum("rows").over(whole).alias("n"))
    return placed.join(counts, ["tree", "part"]).withColumn("pos", F.col("at") + F.col("shift")).drop("at", "part", "shift")


def raised(nodes: DataFrame) -> DataFrame:
    """One node for each superblock of nodes (columns tree, pos, n, node)."""

    def top(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
        n = int(own["n"].iloc[0])
        levels = reduced([x.hex() for x in own.sort_values("pos")["node"]], depth_of(n))
        return pd.DataFrame({"tree": [key[0]], "pos": [key[1]], "n": [-(-n // (1 << BLOCK))], "node": [bytes.fromhex(levels[-1][0])]})

    return nodes.select("tree", "pos", "n", "node").groupBy("tree", F.shiftright("pos", BLOCK).alias("block")).applyInPandas(top, "tree string, pos long, n long, node binary")


def risen(nodes: DataFrame) -> list[DataFrame]:
    """nodes and the levels of superblocks above them, up to one node for each tree; two levels at least."""
    levels, most = [nodes], nodes.agg(F.max("n")).first()[0] or 1
    while most > 1 or len(levels) < 2:
        levels.append(staged(raised(levels[-1])))
        most = -(-most // (1 << BLOCK))
    return levels


def _together(nodes: DataFrame, outer: DataFrame, fill, shape: str) -> DataFrame:
    """fill(nodes of a superblock in order, its levels, its outer proof, its root's row) for every superblock."""

    def one(own: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("pos")
        levels = reduced([x.hex() for x in own["node"]], depth_of(int(own["n"].iloc[0])))
        return fill(own, levels, bytes(above["proof"].iloc[0]), above.iloc[0])

    block = nodes.groupBy("tree", F.shiftright("pos", BLOCK).alias("block"))
    return block.cogroup(outer.groupBy("tree", F.col("pos").alias("block"))).applyInPandas(one, shape)


def lowered(nodes: DataFrame, outer: DataFrame, keep: Iterable[str] = ()) -> DataFrame:
    """tree, pos, proof, subroot and `keep` (text columns) of nodes, given tree, pos, proof and subroot of their superblocks."""
    keep = list(keep)

    def fill(own: pd.DataFrame, levels: list[list[str]], proof: bytes, above: pd.Series) -> pd.DataFrame:
        out = own[["tree", "pos", *keep]].copy()
        out["proof"] = [steps(levels, i) + proof for i in range(len(own))]
        out["subroot"] = [above["subroot"]] * len(own)
        return out

    return _together(nodes, outer, fill, ", ".join(["tree string, pos long", *(f"{c} string" for c in keep), "proof binary, subroot binary"]))


def manifest(rows: DataFrame, with_proofs: bool = False) -> DataFrame:
    """id, leaf, subroot, root, proof_sha256 and folded_root (hexadecimal), and proof, of rows with columns tree, id, leaf, claimed.

    tree (text; null comes first) says which tree a row's digest `leaf` is in; leaves stand by id (a number, null
    first), then by digest; equal rows each have a place. folded_root is what `claimed`, a digest to be checked (null:
    the leaf), and the leaf's proof lead to. proof (binary, else null): steps of STEP bytes. Without rows there is no row.
    """
    spark = rows.sparkSession
    own = rows.select(F.coalesce(F.concat(F.lit("1"), F.col("tree")), F.lit("0")).alias("tree"), F.col("id").cast("long").alias("id"), F.col("leaf").alias("node"), "claimed")
    # The number of a row as it was read tells equal ones apart, so that very many of them are no single key.
    leaves = staged(numbered(staged(own.withColumn("turn", F.monotonically_increasing_id())), "id", "node", "turn"))
    levels = risen(leaves.withColumn("id", F.col("id").cast("string")))
    shape = "id string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, proof binary"
    roots = levels[-1].select(F.lit("").alias("tree"), F.col("tree").alias("own"), "node")
    tops = risen(staged(numbered(roots, "own")))
    last = tops[-1].first()
    if last is None:
        return spark.createDataFrame([], shape).withColumn("id", F.col("id").cast("long"))
    root = bytes(last["node"]).hex()
    outer = spark.createDataFrame([("", 0, b"", b"")], "tree string, pos long, proof binary, subroot binary")
    for i in reversed(range(len(tops) - 1)):
        outer = staged(lowered(tops[i], outer, ["own"] if i == 0 else []))
    outer = levels[-1].join(outer.select(F.col("own").alias("tree"), "proof"), "tree").select("tree", "pos", "proof", F.col("node").alias("subroot"))
    for nodes in reversed(levels[1:-1]):
        outer = staged(lowered(nodes, outer))

    def fill(own: pd.DataFrame, levels: list[list[str]], proof: bytes, above: pd.Series) -> pd.DataFrame:
        after, ends = siblings(proof), {}  # what the outer proof leads to, for each top of the superblock that folding meets
        out = []
        for i, (known, claimed, leaf) in enumerate(zip(own["id"], own["claimed"], levels[0], strict=True)):
            inner = steps(levels, i)
            top = folded(claimed.hex() if claimed is not None else leaf, inner)
            if top not in ends:
                ends[top] = folded(top, proof)
            out.append((known, leaf, bytes(above["subroot"]).hex(), root, digest(siblings(inner) + after), ends[top], inner + proof if with_proofs else None))
        return pd.DataFrame(out, columns=["id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "proof"])

    return _together(levels[0], outer, fill, shape).withColumn("id", F.col("id").cast("long"))


def prove_documents(docs: DataFrame) -> DataFrame:
    """Leaf, roots and proof of every document, by language, and whether it still leads to the root after tampering.

    Tampering adds 1 to n_chars where 7 divides the unsigned crc32 of the decimal id; rows without an id or n_chars stay as they are.
    """
    c = {x: F.col(x) for x in ("doc_id", "source", "lang", "n_chars", "text")}
    meddled = (F.crc32(c["doc_id"].cast("string").cast("binary")) % 7 == 0) & c["n_chars"].isNotNull()
    rows = docs.select(
        c["lang"].cast("string").alias("tree"),
        c["doc_id"].cast("long").alias("id"),
        row_digest(*c.values()).alias("leaf"),
        F.when(meddled, row_digest(c["doc_id"], c["source"], c["lang"], c["n_chars"] + 1, c["text"])).alias("claimed"),
    )
    out = manifest(rows).withColumn("verified", F.col("folded_root") == F.col("root"))
    return out.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def oracle() -> str:
    """DuckDB's SQL for prove_documents."""
    told = lambda *cs: "sha256(" + " || ".join(f"CASE WHEN {x} IS NULL THEN '-' ELSE strlen(CAST({x} AS VARCHAR)) || ':' || CAST({x} AS VARCHAR) END" for x in cs) + ")"
    up = "SELECT tree, level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(d, '' ORDER BY pos)) FROM {0} WHERE n > 1 GROUP BY tree, level, pos // 2, n"
    return f"""
    WITH RECURSIVE polynomial AS (
      SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) ORDER BY i) AS t FROM range(256) r(i)),
    own AS (
      SELECT coalesce('1' || lang, '0') AS tree, doc_id, {told("doc_id", "source", "lang", "n_chars", "text")} AS d,
        {told("doc_id", "source", "lang", "(n_chars + 1)", "text")} AS other, n_chars,
        xor(list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)),
          lambda c, b: xor(c >> 8, t[CAST((xor(c, b) & 255) + 1 AS INTEGER)]), 4294967295), 4294967295) AS crc FROM documents CROSS JOIN polynomial),
    leaves AS (
      SELECT tree, doc_id, d, CASE WHEN crc % 7 = 0 AND n_chars IS NOT NULL THEN other ELSE d END AS claimed,
        row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, d) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM own),
    low(tree, level, pos, n, d) AS (SELECT tree, 0, pos, n, d FROM leaves UNION ALL {up.format("low")}),
    subroots AS (SELECT tree, level AS height, d, row_number() OVER (ORDER BY tree) - 1 AS place, count(*) OVER () AS trees FROM low WHERE n = 1),
    high(tree, level, pos, n, d) AS (SELECT '', 0, place, trees, d FROM subroots UNION ALL {up.format("high")}),
    root AS (SELECT d, level AS height FROM high WHERE n = 1),
    steps AS (
      SELECT l.tree, l.pos, u.level AS step, xor(l.pos >> u.level, 1) < (l.pos >> u.level) AS before, s.d AS sibling
      FROM leaves l JOIN (SELECT DISTINCT tree, level FROM low WHERE n > 1) u ON u.tree = l.tree
      LEFT JOIN low s ON s.tree = l.tree AND s.level = u.level AND s.pos = xor(l.pos >> u.level, 1)
      UNION ALL
      SELECT l.tree, l.pos, r.height + u.level, xor(r.place >> u.level, 1) < (r.place >> u.level), s.d
      FROM leaves l JOIN subroots r ON r.tree = l.tree CROSS JOIN (SELECT DISTINCT level FROM high WHERE n > 1) u
      LEFT JOIN high s ON s.level = u.level AND s.pos = xor(r.place >> u.level, 1)),
    proofs AS (SELECT tree, pos, sha256(coalesce(string_agg(sibling, '' ORDER BY step), '')) AS proof_sha256 FROM steps GROUP BY tree, pos),
    folds(tree, pos, step, d) AS (
      SELECT tree, pos, 0, claimed FROM leaves UNION ALL
      SELECT f.tree, f.pos, f.step + 1, sha256(CASE WHEN s.sibling IS NULL THEN f.d WHEN s.before THEN s.sibling || f.d ELSE f.d || s.sibling END)
      FROM folds f JOIN steps s ON s.tree = f.tree AND s.pos = f.pos AND s.step = f.step),
    ends AS (SELECT tree, pos, arg_max(d, step) AS folded_root FROM folds GROUP BY tree, pos)
    SELECT l.doc_id, l.d AS leaf, r.d AS subroot, t.d AS root, coalesce(p.proof_sha256, sha256('')) AS proof_sha256, e.folded_root, e.folded_root = t.d AS verified
    FROM leaves l JOIN subroots r ON r.tree = l.tree CROSS JOIN root t JOIN ends e ON e.tree = l.tree AND e.pos = l.pos
    LEFT JOIN proofs p ON p.tree = l.tree AND p.pos = l.pos"""

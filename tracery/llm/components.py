"""Connected components of an edge table by alternating stars.

Each round links every node's greater neighbours, then all its neighbours, to its least one; the edges end as
stars whose centres are the components' least nodes. Minima are aggregated before they are shuffled and joined
back in such a way that Spark can split a node with very many edges. Every round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_folder, splitting_join, staged

ROUNDS = 60


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """edges: columns u, v with u > v. Large star: neighbours above u go to the least of u and its neighbours; small star: u and those below it do."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    if small:
        moved = splitting_join(edges, least, "u").select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("e"))
    else:
        # A node's least neighbour is below it, or else it is the least itself; those above it are the u of edges to it.
        moved = splitting_join(edges, least.withColumnRenamed("u", "v"), "v", how="left").select(F.struct("u", F.coalesce("m", "v").alias("m")).alias("e"))
    return moved.select("e.u", F.col("e.m").alias("v")).where("u > v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root: the least node of its component, for every node of edges (columns a, b of one sortable type), the roots themselves left out.

    Null ends and loops link nothing.
    """
    spark, folder = edges.sparkSession, shared_folder(edges.sparkSession)
    now = staged(edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{folder}/0")
    mark = lambda df: tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    before = mark(now)
    for i in range(1, ROUNDS):
        if not before[0]:
            break
        now = staged(_star(_star(now, small=False), small=True), f"{folder}/{i}")
        after = mark(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components are not done after {ROUNDS} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))

"""Two tables in blocks, each block of the one beside each block of the other in a task of its own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: So many rows of either table make a block.
ROWS = 8192


def in_blocks(left: DataFrame, right: DataFrame, keys: tuple[str, str], run: Callable, schema: str, rows: int = ROWS) -> DataFrame:
    """The rows of run(block of left, block of right), Arrow tables of about `rows` rows each, for every pair of blocks; blocks are dealt by the keys' hashes.

    A block may be empty. What a task holds is bounded by `rows`, however large the tables are; each table is shuffled once for every block of the other.
    """
    n, m = (max(1, -(-df.count() // rows)) for df in (left, right))
    own = lambda key, of: F.pmod(F.xxhash64(F.col(key)), F.lit(of)).cast("int")
    every = lambda of: F.explode(F.sequence(F.lit(0), F.lit(of - 1)))
    a = left.withColumn("__i", own(keys[0], n)).withColumn("__j", every(m))
    b = right.withColumn("__j", own(keys[1], m)).withColumn("__i", every(n))

    return a.groupBy("__i", "__j").cogroup(b.groupBy("__i", "__j")).applyInArrow(lambda x, y: run(x, y), schema)

"""Evidence that an entry keeps of the messages it was drawn from: digests of ranges, and what has become of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Sums run within blocks of so many ordinals, and over the blocks of a session, so that a long session is no single task.
BLOCK = 4096


def message_print(fields: list[str]) -> tuple[Column, Column]:
    """Two 48-bit numbers of a message: its ordinal is part of them, so sums over a range tell its order."""
    text = F.concat_ws("|", F.col("ordinal").cast("string"), *(F.coalesce(F.concat(F.lit("+"), F.col(c).cast("string")), F.lit("-")) for c in fields))
    h = F.sha2(text.cast("binary"), 256)
    part = lambda at: F.conv(F.substring(h, at, 12), 16, 10).cast("decimal(38,0)")
    return part(1), part(13)


def prefix_prints(messages: DataFrame, fields: list[str]) -> DataFrame:
    """session_id, ordinal, n, a, b: of each message, the number of messages up to it in its session and the sums of their prints."""
    a, b = message_print(fields)
    rows = messages.select("session_id", "ordinal", F.floor(F.col("ordinal") / BLOCK).alias("block"), F.lit(1).cast("long").alias("n"), a.alias("a"), b.alias("b"))
    sums = ["n", "a", "b"]
    upto = Window.partitionBy("session_id", "block").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("session_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy("session_id", "block").agg(*(F.sum(c).alias(c) for c in sums))
    blocks = blocks.select("session_id", "block", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"b_{c}") for c in sums))
    return rows.join(blocks, ["session_id", "block"]).select("session_id", "ordinal", *((F.sum(c).over(upto) + F.col(f"b_{c}")).alias(c) for c in sums))


def range_digests(ranges: DataFrame, messages: DataFrame, fields: list[str]) -> DataFrame:
    """Adds n and digest to ranges (entry, session_id, first, last; ordinals): how many messages stand there and the digest of all, null if first or last doesn't exist.

    A range is the difference of two prefixes, so no range's messages are gathered, however many ranges overlap.
    """
    prints = prefix_prints(messages, fields)
    a, b = message_print(fields)
    low = messages.select("session_id", F.col("ordinal").alias("first"), a.alias("own_a"), b.alias("own_b")).join(prints.select("session_id", F.col("ordinal").alias("first"), *(F.col(c).alias(f"low_{c}") for c in ("n", "a", "b"))), ["session_id", "first"])
    high = prints.select("session_id", F.col("ordinal").alias("last"), *(F.col(c).alias(f"high_{c}") for c in ("n", "a", "b")))
    both = ranges.join(low, ["session_id", "first"], "left").join(high, ["session_id", "last"], "left")
    n = F.col("high_n") - F.col("low_n") + 1
    total = lambda c: (F.col(f"high_{c}") - F.col(f"low_{c}") + F.col(f"own_{c}")).cast("string")
    return both.select(*ranges.columns, n.alias("n"), F.when(n.isNotNull(), F.sha2(F.concat_ws(":", n.cast("string"), total("a"), total("b")).cast("binary"), 256)).alias("digest"))


def evidence_verdicts(entries: DataFrame, messages: DataFrame, fields: list[str]) -> DataFrame:
    """entry, verdict of entries (entry, session_id, first, last, kept: the digest when it was drawn).

    invalid: the range is none; missing: its first or last message isn't there; gap: some message between them isn't; changed: one was
    changed, moved or put in another's place; else intact.
    """
    own = range_digests(entries, messages, fields)
    valid = (F.col("first") >= 0) & (F.col("last") >= F.col("first"))
    verdict = F.when(~F.coalesce(valid, F.lit(False)), "invalid").when(F.col("n").isNull(), "missing").when(F.col("n") != F.col("last") - F.col("first") + 1, "gap").when(~F.col("digest").eqNullSafe(F.col("kept")), "changed").otherwise("intact")
    return own.select("entry", verdict.alias("verdict"))

"""Mixing sources to target weights by weighted fair queueing.

Each source's documents stand in a queue in shuffled order, each pass over them shuffled anew. A document is
served in packets; a packet's virtual finish time is the source's cumulative words up to its end, divided by the
source's target. The packets of all queues are merged by that time, and the merged order is cut at the total
budget; nothing else decides what is taken. A packet is a thousandth of its source's target at most, so every
source ends as near to its target.

Running sums never need a source in one task: a queue is cut into slots by the leading bits of the shuffle
hash, the merged order into ranges of time; the sums of slots and ranges are added up first, and only the
rows of the range in which the budget ends are put in order.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType

from .common import staged

#: Weights of the sources in order, repeated.
WEIGHTS = (3, 1, 2)
#: The mix has so many times the words of all sources; no document is taken more than PASSES times.
SHARE, PASSES = 1.5, 2
#: A slot of a queue has about so many documents.
SLOT_ROWS = 2_000
#: A source's target has about so many packets.
PACKETS = 1000
#: The range in which the budget ends is narrowed until it has no more packets than this, or all of them finish at once.
SORTED = 1_000_000
#: The plan of sources is made on the driver; a table of more sources is refused.
MAX_SOURCES = 1_000_000
SEED = 5
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: list[int], weights: list[float], share: float = SHARE, passes: int = PASSES) -> list[float]:
    """Words of each source: share x all words by weight, none above passes x its size, the excess going to the others by weight."""
    size, weight = np.array(sizes, float), np.array(weights, float)
    out, open_, left = np.zeros(len(size)), size > 0, share * size.sum()
    while open_.any() and left > 0:
        part = left * weight / weight[open_].sum()
        full = open_ & (part >= passes * size)
        if not full.any():
            out[open_] = part[open_]
            break
        out[full] = passes * size[full]
        left -= out[full].sum()
        open_ &= ~full
    return out.tolist()


def plan(sized: DataFrame, share: float, passes: int, weights: tuple) -> DataFrame:
    """source, source_size, source_docs, target, no: one row for each source, null last; no numbers them."""
    spark = sized.sparkSession
    found = sized.groupBy("source").agg(F.sum("size").alias("n"), F.count(F.lit(1)).alias("docs")).limit(MAX_SOURCES + 1).collect()
    if len(found) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    found.sort(key=lambda r: (r.source is None, (r.source or "").encode()))  # UTF-8 sorts by code point
    goal = targets([r.n for r in found], [weights[i % len(weights)] for i in range(len(found))], share, passes)
    return spark.createDataFrame([(r.source, r.n, r.docs, t, i) for i, (r, t) in enumerate(zip(found, goal, strict=True))], "source string, source_size long, source_docs long, target double, no int")


def packet(rows: DataFrame) -> tuple[Column, Column]:
    """Words of a packet and number of packets of a document (one at least)."""
    words = F.greatest(F.floor(F.col("target") / PACKETS), F.lit(1)).cast("long")
    return words, F.greatest(F.ceil(F.col("size") / words), F.lit(1)).cast("int")


def schedule(docs: DataFrame, *keep: Column, share: float = SHARE, passes: int = PASSES, weights: tuple = WEIGHTS, seed: int = SEED, budget: int | None = None) -> DataFrame:
    """The columns `keep` with size, source_size, target, epoch (from 0), start and finish (virtual times) and taken words.

    One row for each document and pass; those that the mix does not reach take 0. Needs doc_id, text and source.
    budget: words of the mix, by default the sum of the targets. `keep` should be keys, not texts, as it is written
    to the shared folder twice. Null texts have no words; a source without words has target 0. Repeated rows are
    documents of their own: ties of the shuffle hash are in the order of the text's hash, and rows that are equal in
    all of it are alike.
    """
    sized = docs.select(F.struct(*keep).alias("row"), F.col("source").cast("string").alias("source"), n_words(F.col("text").cast("string")).alias("size"), F.xxhash64("doc_id", "text", F.lit(seed)).alias("tie"))
    sized = staged(sized)  # words are counted once
    sources = plan(sized.select("source", "size"), share, passes, weights)
    rows = sized.join(sources, sized["source"].eqNullSafe(sources["source"])).drop(sources["source"])
    rows = rows.withColumn("epoch", F.explode(F.array(*(F.lit(i) for i in range(passes)))))
    turn = F.xxhash64("tie", "epoch", F.lit(seed)).bitwiseAND(F.lit((1 << 62) - 1))
    slots = F.greatest(F.ceil(F.col("source_docs") / SLOT_ROWS), F.lit(1))
    rows = rows.withColumn("turn", turn).withColumn("slot", F.floor(F.col("turn").cast("double") / float(1 << 62) * slots).cast("long"))
    queue, order = ["no", "epoch", "slot"], ["turn", "tie", "size"]
    sums = rows.groupBy(*queue).agg(F.sum("size").alias("words"))
    before = sums.select(*queue, (F.sum("words").over(Window.partitionBy("no").orderBy("epoch", "slot")) - F.col("words")).alias("before"))
    within = F.sum("size").over(Window.partitionBy(*queue).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size")
    queued = rows.withColumn("within", within).join(before, queue).withColumn("served", F.col("before") + F.col("within"))
    queued = staged(queued.select("row", "size", "source_size", "target", "no", "epoch", "served", "turn", "tie"))
    if budget is None:
        budget = math.floor(sources.agg(F.sum("target")).first()[0] or 0)
    out = queued.withColumn("taken", taken(queued, cut(queued, budget)))
    time = lambda at: F.when(F.col("target") > 0, at / F.col("target")).otherwise(F.lit(float("inf")))
    return out.select("row.*", "size", "source_size", "target", "epoch", time(F.col("served")).alias("start"), time(F.col("served") + F.col("size")).alias("finish"), "taken")


#: The merged order: of the same finish time, packets stand by source, pass and place in the queue.
MERGED = ("finish", "no", "epoch", "turn", "tie", "i")


def finish_of(i: Column, words: Column) -> Column:
    """When packet i of a row of schedule's queues is done, as words of its size."""
    return (F.col("served") + F.least((i + 1) * words, F.col("size"))) / F.col("target")


def cut(queued: DataFrame, budget: int) -> dict | None:
    """The packet in which the budget ends, and `left`, the words of it that are still taken; None if all packets fit.

    The merged order is cut into ranges of finish time, as many as the shuffle has partitions; their sums tell in which
    the budget ends. That range is cut again until its packets are few, and only these are sorted.
    """
    ranges = max(int(queued.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2)
    words, n = packet(queued)
    one = queued.where("target > 0 and size > 0").withColumn("q", words).withColumn("i", F.explode(F.sequence(F.lit(0), n - 1)))
    own = F.least(F.col("q"), F.col("size") - F.col("i") * F.col("q"))
    packets = one.select(finish_of(F.col("i"), F.col("q")).alias("finish"), *MERGED[1:], own.alias("words"))
    before, low, high = 0, 0.0, packets.agg(F.max("finish")).first()[0]
    while high is not None:
        width = (high - low) / ranges or 1.0
        number = F.least(F.floor((F.col("finish") - low) / width), F.lit(ranges - 1))
        inside = packets.where(F.col("finish").between(low, high))
        sums = inside.groupBy(number.alias("range")).agg(F.sum("words").alias("words"), F.count(F.lit(1)).alias("n"), F.min("finish").alias("low"), F.max("finish").alias("high")).collect()
        for r in sorted(sums, key=lambda r: r.range):
            if before + r.words > budget:
                break
            before += r.words
        else:
            return None
        low, high = r.low, r.high
        if r.n <= SORTED or low == high:
            upto = F.sum("words").over(Window.orderBy(*MERGED).rowsBetween(Window.unboundedPreceding, Window.currentRow))
            row = packets.where(F.col("finish").between(low, high)).withColumn("upto", upto + before).where(F.col("upto") > budget).orderBy(*MERGED).first()
            return {k: row[k] for k in MERGED} | {"left": budget - (row["upto"] - row["words"])}
    return None


def taken(queued: DataFrame, last: dict | None) -> Column:
    """Words of a row's packets before the last one of the mix, with what is left for that one."""
    if last is None:
        return F.when(F.col("target") > 0, F.col("size")).otherwise(F.lit(0).cast("long"))
    words, n = packet(queued)
    at = lambda i: F.struct(finish_of(i, words).alias("finish"), "no", "epoch", "turn", "tie", i.alias("i"))
    end = F.struct(F.lit(last["finish"]).alias("finish"), F.lit(last["no"]).alias("no"), F.lit(last["epoch"]).alias("epoch"), F.lit(last["turn"]).alias("turn"), F.lit(last["tie"]).alias("tie"), F.lit(last["i"]).alias("i"))
    full = F.size(F.filter(F.sequence(F.lit(0), n - 1), lambda i: at(i) < end))
    part = F.least(full * words, F.col("size")) + F.when((full < n) & (at(full) == end), F.lit(last["left"])).otherwise(0)
    some = F.when(at(n - 1) < end, F.col("size")).when(at(F.lit(0)) > end, 0).otherwise(part)
    return F.when((F.col("target") > 0) & (F.col("size") > 0), some).otherwise(0).cast("long")


def copy_key() -> Column:
    """Tells rows with one doc_id apart, unless they are equal."""
    return F.xxhash64("text", "source")


def mix_documents(docs: DataFrame) -> DataFrame:
    """Words that the mix takes of each document, repeats counted. Rows with one doc_id are told apart by text and source; equal rows share their words as evenly as whole numbers go."""
    rows = schedule(docs, F.col("doc_id").cast("long").alias("doc_id"), copy_key().alias("copy"))
    one = rows.groupBy("doc_id", "copy").agg(F.first("size").alias("size"), F.first("source_size").alias("source_size"), F.first("target").alias("target"), F.sum("taken").alias("taken"), F.count_if(F.col("epoch") == 0).alias("n"))
    each = one.withColumn("i", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))))
    part = F.floor(F.col("taken") / F.col("n")) + F.when(F.col("i") <= F.col("taken") % F.col("n"), 1).otherwise(0)
    return each.select("doc_id", "size", "source_size", "target", part.cast("long").alias("taken"))


def has_map(kind: DataType) -> bool:
    """Whether a type is a map or holds one at any depth; such values have no hash."""
    if isinstance(kind, StructType):
        return any(has_map(f.dataType) for f in kind.fields)
    return isinstance(kind, MapType) or (isinstance(kind, ArrayType) and has_map(kind.elementType))


def mixed(docs: DataFrame) -> DataFrame:
    """The mix itself, in its order: a document's row once for each pass that takes words of it.

    Of a document in which the budget ends, the text is cut after the last word taken, and n_chars is set anew. Rows
    that are equal throughout are documents of their own, as in mix_documents.
    """
    own = [F.when(F.col(f"`{f.name}`").isNull(), F.lit(None)).otherwise(F.to_json(F.struct(F.col(f"`{f.name}`").alias("x")))) if has_map(f.dataType) else F.col(f"`{f.name}`") for f in docs.schema.fields]
    keyed = docs.withColumns({"__a": F.xxhash64(*own), "__b": F.xxhash64(*own, F.lit(1))})  # 128 bits, which the join has in common with what it joins
    rows = schedule(keyed, F.col("__a").alias("a"), F.col("__b").alias("b")).where("taken > 0")
    rows = rows.select(F.col("a").alias("__a"), F.col("b").alias("__b"), F.col("size").alias("__size"), F.col("taken").alias("__taken"), F.col("finish").alias("__finish"))
    both = keyed.dropDuplicates(["__a", "__b"]).join(rows, ["__a", "__b"])  # equal rows have a row each on the right
    prefix = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(rf"[\x20\x09-\x0D]*{WORD}"), F.lit(0)), F.lit(1), F.col("__taken").cast("int")), "")
    whole = F.col("__taken") == F.col("__size")
    text = F.when(whole, F.col("text")).otherwise(prefix)
    out = both.withColumn("text", text).withColumn("n_chars", F.when(whole, F.col("n_chars")).otherwise(F.length("text").cast("long")))
    return out.orderBy("__finish", "__a", "__b").select(*docs.columns)

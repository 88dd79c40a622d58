"""Transcripts as a stream (S1): files of lines that grow, each line taken once and numbered within its transcript.

A transcript arrives in segments, each a text file under transcript=<name>/offset=<first byte>/. Segments may come late, twice, or
overlap what was there before; the last line of a segment may be cut off, and comes whole with the next one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ingest import LOG, TREE

_PATH = r"transcript=([^/]+)/offset=(\d+)/"


def lines_stream(spark: SparkSession, path: str, files: int = 1000) -> DataFrame:
    """file, segment (its first byte), source (its path), n (a line's place in its segment) and value, from at most `files` new segments for each batch.

    A segment is what a writer appended at once, so it is read as one row and cut at line feeds. What is after the last one, maybe nothing, is its last line.
    """
    rows = spark.readStream.option("wholetext", True).option("maxFilesPerTrigger", files).text(f"{path}/transcript=*/offset=*")
    where = F.url_decode(F.col("_metadata.file_path"))
    part = lambda i: F.regexp_extract(where, _PATH, i)
    return rows.select(part(1).alias("file"), part(2).cast("long").alias("segment"), where.alias("source"), F.posexplode(F.split("value", "\n")).alias("n", "value"))


def numbered(rows: DataFrame, is_turn: Column, model: Column) -> DataFrame:
    """file, line_at (its first byte), ordinal, carried and value of the lines of lines_stream for which is_turn holds.

    ordinal counts a transcript's turns in order of their bytes, whatever batches they came in; carried is the last `model` that is not null
    among the lines up to a turn. The state of a transcript is the byte that it is read up to, the next ordinal and the model; lines
    that came before their predecessors wait there too. A last line of a segment that is no whole JSON is left for the next segment.
    """

    def take(key, frames, state):
        import json

        import pandas as pd

        def whole(text: str) -> bool:
            try:
                json.loads(text)
            except ValueError:
                return False
            return True

        until, ordinal, carried, waiting = state.get if state.exists else (0, 0, None, "[]")
        lines = {at: (size, turn, name, text) for at, size, turn, name, text in json.loads(waiting)}
        came = pd.concat(list(frames)).sort_values(["segment", "source", "n"])
        for (segment, _), own in came.groupby(["segment", "source"], sort=True):
            at, last = int(segment), len(own) - 1
            for i, text, turn, name in zip(range(last + 1), own["value"], own["is_turn"], own["model"], strict=True):
                size = len(text.encode()) + 1
                if at >= until and (i < last or whole(text)):
                    lines[at] = (size, bool(turn), name if isinstance(name, str) else None, text)
                at += size
        out = []
        while until in lines:
            size, turn, name, text = lines.pop(until)
            carried = name if name is not None else carried
            if turn:
                out.append((key[0], until, ordinal, carried, text))
                ordinal += 1
            until += size
        state.update((until, ordinal, carried, json.dumps([[at, *x] for at, x in sorted(lines.items()) if at >= until])))
        yield pd.DataFrame(out, columns=["file", "line_at", "ordinal", "carried", "value"]).astype({"line_at": "int64", "ordinal": "int64"})

    own = rows.select("file", "segment", "source", "n", "value", F.coalesce(is_turn, F.lit(False)).alias("is_turn"), model.alias("model"))
    return own.groupBy("file").applyInPandasWithState(take, "file string, line_at long, ordinal long, carried string, value string", "until long, ordinal long, carried string, waiting string", "append", "NoTimeout")


def uuid_tree(rows: DataFrame) -> DataFrame:
    """The messages of lines in the uuid-tree format, as ingest.uuid_tree finds them in whole files."""
    j = F.from_json("value", TREE)
    found = numbered(rows, j["type"].isin("user", "assistant") & j["message"]["role"].isNotNull(), F.lit(None).cast("string")).withColumn("j", j)
    return found.select("file", "ordinal", F.col("j.message.role").alias("role"), F.col("j.message.content").alias("content"), F.coalesce("j.message.model", F.lit("")).alias("model"), F.coalesce("j.isMeta", F.lit(False)).alias("is_system"), F.col("j.uuid").alias("uuid"), F.col("j.parentUuid").alias("parent_uuid"), F.try_to_timestamp("j.timestamp").alias("ts"), F.coalesce("j.message.usage.output_tokens", F.lit(0)).alias("output_tokens"))


def event_log(rows: DataFrame) -> DataFrame:
    """The messages of event logs, assistants with the model of the last turn_context before them. The tokens of a turn are told by the line after it, so they are left to the batch."""
    j = F.from_json("value", LOG)
    found = numbered(rows, j["type"] == "response_item", F.when(j["type"] == "turn_context", j["payload"]["model"])).withColumn("j", j)
    return found.select("file", "ordinal", F.col("j.payload.role").alias("role"), F.col("j.payload.text").alias("content"), F.when(F.col("j.payload.role") == "assistant", F.coalesce("carried", F.lit(""))).otherwise("").alias("model"))


def segments(lines: DataFrame, bytes_each: int, again: int = 0) -> DataFrame:
    """transcript, offset, value: lines (file, line_no, value) as segments of about so many bytes, a row each; each but the first also repeats the `again` lines before it."""
    from pyspark.sql import Window

    order = Window.partitionBy("file").orderBy("line_no")
    rows = lines.withColumn("at", F.coalesce(F.sum(F.octet_length("value") + 1).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rows = rows.withColumn("no", F.floor(F.col("at") / bytes_each))
    # A line stands in its own segment and in those of the next `again` lines; at a transcript's end there are fewer of these.
    own = F.array_distinct(F.array_compact(F.array("no", *(F.lead("no", k).over(order) for k in range(1, again + 1)))))
    rows = rows.withColumn("own", own)
    held = rows.withColumn("no", F.explode("own")).groupBy("file", "no").agg(F.array_sort(F.collect_list(F.struct("at", "value"))).alias("x"))
    return held.select(F.col("file").alias("transcript"), F.col("x")[0]["at"].alias("offset"), F.array_join(F.transform("x", lambda x: x["value"]), "\n").alias("value"))


def written_in_segments(lines: DataFrame, path: str, bytes_each: int, again: int = 0) -> None:
    """Writes `segments` as text files. Each is a row of its own, as the writer sorts rows anew by their folders, which keeps no order within one once it spills."""
    segments(lines, bytes_each, again).write.partitionBy("transcript", "offset").option("lineSep", "\n").text(path)

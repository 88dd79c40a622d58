"""Streams that keep state over batches and restarts, against what the batch operators find in the whole."""

import os
import random
import shutil

from pyspark.sql import functions as F

from tracery.operators import ingest, maintain
from tracery.plans import catalog
from tracery.streaming import mirror, transcripts

from .compare import connection, difference


def put(folder, file, offset, data):
    path = f"{folder}/transcript={file}/offset={offset}"
    os.makedirs(path, exist_ok=True)
    with open(f"{path}/{len(os.listdir(path))}.txt", "wb") as f:
        f.write(data)


def taken(spark, operator, lines, state, out, files=1000):
    """Runs the stream over what is there and returns all that it has appended so far."""

    def keep(batch, no):
        batch.write.mode("overwrite").parquet(f"{out}/batch={no}")

    operator(transcripts.lines_stream(spark, lines, files)).writeStream.foreachBatch(keep).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).drop("batch")


def line(i, role, text, model=""):
    return f'{{"type":"{role}","uuid":"u{i}","message":{{"role":"{role}","model":"{model}","content":"{text}","usage":{{"output_tokens":{i}}}}}}}\n'.encode()


def whole(spark, tmp_path, data):
    """What ingest.uuid_tree finds in the whole files."""
    tmp_path.mkdir()
    for name, text in data.items():
        with open(f"{tmp_path}/{name}.jsonl", "wb") as f:
            f.write(text)
    rows = ingest.uuid_tree(ingest.lines(spark, str(tmp_path))).withColumn("file", F.regexp_extract("file", r"([^/]+)\.jsonl", 1))
    return sorted(map(str, rows.collect()))


def test_transcripts_in_pieces(spark, tmp_path):
    """Segments cut anywhere, also within a line or a character, late, twice and overlapping, over restarts of the stream."""
    rng = random.Random(5)
    data = {f: b"".join(line(i, rng.choice(["user", "assistant", "summary"]), f"é {f} {i}" * rng.randrange(1, 5)) + (b"\n" if i % 7 == 0 else b"") for i in range(40)) for f in ("a", "b", "c")}
    want = whole(spark, tmp_path / "whole", data)
    lines, state, out = (str(tmp_path / x) for x in ("lines", "state", "out"))
    segments = []
    for name, text in data.items():
        before = 0
        for end in [*sorted(rng.sample(range(1, len(text)), 9)), len(text)]:
            # A writer that stopped anywhere goes on from the line that it had begun, or from one before.
            start = text.rfind(b"\n", 0, before) + 1
            start = text.rfind(b"\n", 0, max(start - rng.choice([0, 300]), 0)) + 1
            segments.append((name, start, text[start:end]))
            before = end
    rng.shuffle(segments)
    third = len(segments) // 3
    for part in (segments[:third], segments[third : 2 * third], segments[2 * third :] + segments[:4]):
        for s in part:
            put(lines, *s)
        got = taken(spark, transcripts.uuid_tree, lines, state, out, files=3)
    assert sorted(map(str, got.select("file", "ordinal", "role", "content", "model", "is_system", "uuid", "parent_uuid", "ts", "output_tokens").collect())) == want and len(want) > 60


def test_models_are_carried_over_batches(spark, tmp_path):
    log = ['{"type":"turn_context","payload":{"model":"m1"}}', '{"type":"response_item","payload":{"role":"assistant","text":"a"}}', '{"type":"response_item","payload":{"role":"user","text":"b"}}', '{"type":"response_item","payload":{"role":"assistant","text":"c"}}', '{"type":"turn_context","payload":{"model":"m2"}}', '{"type":"response_item","payload":{"role":"assistant","text":"d"}}']
    at = 0
    lines, state, out = (str(tmp_path / x) for x in ("lines", "state", "out"))
    for text in log:
        put(lines, "x", at, text.encode() + b"\n")
        at += len(text) + 1
        got = taken(spark, transcripts.event_log, lines, state, out)
    assert sorted(tuple(r) for r in got.collect()) == [("x", 0, "assistant", "a", "m1"), ("x", 1, "user", "b", ""), ("x", 2, "assistant", "c", "m1"), ("x", 3, "assistant", "d", "m2")]


FIELDS = ["id", "text"]


def rows_of(spark, path):
    return sorted(tuple(r) for r in spark.read.parquet(f"{path}/messages").select("session_id", "id", "text").collect())


def files_of(path):
    return {f"{d}/{f}": os.stat(f"{d}/{f}").st_mtime_ns for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}


def test_a_mirror_replaces_only_what_changed(spark, tmp_path):
    path = str(tmp_path / "mirror")
    df = lambda rows: spark.createDataFrame(rows, "session_id string, id long, text string")
    scope = ~F.col("text").startswith("secret")
    put_ = lambda rows, gone=None: mirror.upsert(df(rows), path, "id", FIELDS, scope, gone and df(gone), buckets=8)
    put_([(f"s{i}", i * 10 + k, f"t{k}") for i in range(40) for k in range(3)])
    first = files_of(path)
    assert len(rows_of(spark, path)) == 120
    # The same rows again, and rows that are there already: nothing is written.
    put_([("s3", 30, "t0"), ("s7", 71, "t1")])
    put_([])
    assert files_of(path) == first
    put_([("s3", 30, "other"), ("s3", 99, "more"), ("new", 1, "x")])
    now = files_of(path)
    touched = {r.b for r in df([("s3", 0, ""), ("new", 0, "")]).selectExpr("cast(pmod(xxhash64(session_id), 8) as int) as b").collect()}
    assert {f for f in now if now[f] != first.get(f)} and all(int(f.split("bucket=")[1].split("/")[0]) in touched for f in {*now, *first} if now.get(f) != first.get(f))
    want = sorted([(f"s{i}", i * 10 + k, f"t{k}") for i in range(40) for k in range(3) if (i, k) != (3, 0)] + [("s3", 30, "other"), ("s3", 99, "more"), ("new", 1, "x")])
    assert rows_of(spark, path) == want
    # A session that leaves the scope and one that is deleted disappear with their prints, also from a bucket of their own.
    put_([("s5", 51, "secret plan")], [("s6", 0, "")])
    want = [r for r in want if r[0] not in ("s5", "s6")]
    assert rows_of(spark, path) == want
    prints = {r.session_id: r.fingerprint for r in spark.read.parquet(f"{path}/fingerprints").collect()}
    assert prints == {r.session_id: r.fingerprint for r in maintain.fingerprints(df(want), FIELDS).collect()}
    put_([], [(s, 0, "") for s in {r[0] for r in want}])
    assert rows_of(spark, path) == [] and spark.read.parquet(f"{path}/fingerprints").count() == 0


def test_a_mirror_batch_that_is_run_again(spark, tmp_path, monkeypatch):
    """The batch fails after the messages were replaced and before the fingerprints were; the stream is started anew."""
    source, path, state = (str(tmp_path / x) for x in ("in", "mirror", "state"))
    schema = "session_id string, id long, text string"
    write = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
    stream = lambda: mirror.keep(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source), path, state, "id", FIELDS, F.lit(True), buckets=4)
    write([(f"s{i}", i, "a") for i in range(20)])
    stream().awaitTermination()
    write([("s1", 1, "b"), ("s2", 100, "c")])
    real, calls = mirror._replace, []

    def failing(rows, to):
        if to.endswith("fingerprints"):
            raise RuntimeError("lost")
        real(rows, to)
        calls.append(to)

    monkeypatch.setattr(mirror, "_replace", failing)
    try:
        stream().awaitTermination()
        raise AssertionError("the batch was to fail")
    except Exception as e:
        assert "lost" in str(e) and calls
    monkeypatch.setattr(mirror, "_replace", real)
    stream().awaitTermination()
    want = sorted([(f"s{i}", i, "b" if i == 1 else "a") for i in range(20)] + [("s2", 100, "c")])
    assert rows_of(spark, path) == want
    prints = {r.session_id: r.fingerprint for r in spark.read.parquet(f"{path}/fingerprints").collect()}
    assert prints == {r.session_id: r.fingerprint for r in maintain.fingerprints(spark.createDataFrame(want, schema), FIELDS).collect()}
    shutil.rmtree(state)


def test_archive_prints_tell_any_part(spark):
    df = lambda rows: spark.createDataFrame(rows, "session_id long, a string, b long")
    base = {"messages": [(1, "x", 1), (1, "y", 2), (2, "x", 1)], "calls": [(1, "c", 1)], "findings": [(2, None, None)], "usage": [(3, "u", 5)], "pins": []}
    prints = lambda parts: {r.session_id: r.fingerprint for r in maintain.archive_fingerprints({k: (df(v), ["a", "b"]) for k, v in parts.items()}).collect()}
    first = prints(base)
    assert set(first) == {"1", "2", "3"} and prints({k: v[::-1] for k, v in reversed(base.items())}) == first
    for part, rows, session in [("messages", [(1, "x", 1), (1, "y", 3), (2, "x", 1)], "1"), ("calls", [], "1"), ("findings", [(2, "-", None)], None), ("usage", [(3, "u", 5)] * 2, "3"), ("pins", [(2, "p", 1)], "2")]:
        other = prints(base | {part: rows})
        assert {s for s in {*first, *other} if first.get(s) != other.get(s)} == ({session} if session else set())
    assert prints(base | {"calls": [], "pins": [(1, "c", 1)]})["1"] != first["1"]


def test_a_segment_is_one_row_whatever_order_its_lines_come_in(spark, tmp_path):
    said = [f"line {i} " + "x" * (i % 7) for i in range(40)]
    lines = spark.createDataFrame([("t", i, x) for i, x in enumerate(said)][::-1], "file string, line_no long, value string").repartition(4)
    rows = sorted(transcripts.segments(lines, 100, again=2).collect(), key=lambda r: r.offset)
    whole = "".join(x + "\n" for x in said)
    assert len(rows) > 3 and all(whole[r.offset :].startswith(r.value + "\n") for r in rows)
    assert all(a.offset + len(a.value) + 1 > b.offset for a, b in zip(rows, rows[1:], strict=False))
    transcripts.written_in_segments(lines, f"{tmp_path}/l", 100, again=2)
    files = {int(p.parent.name.split("=")[1]): p.read_text() for p in tmp_path.glob("l/*/*/part-*")}
    assert files == {r.offset: r.value + "\n" for r in rows}


def test_segments_have_no_gap_at_a_transcripts_end(spark, tmp_path):
    """Before, a transcript's last line but one wasn't repeated where the last one is a segment of its own, so that one came in its place."""
    said = {f"t{n}": [line(i, "user", f"{i} " + "x" * (i * 37 % 60)).decode()[:-1] for i in range(n)] for n in range(1, 24)}
    rows = transcripts.segments(spark.createDataFrame([(f, i, x) for f, lines in said.items() for i, x in enumerate(lines)], "file string, line_no long, value string"), 400, again=2).collect()
    lone = 0
    for name, lines in said.items():
        starts = [sum(len(x) + 1 for x in lines[:i]) for i in range(len(lines))]
        first = {at // 400: i for i, at in reversed(list(enumerate(starts)))}
        last = {at // 400: i for i, at in enumerate(starts)}
        assert sorted((r.offset, r.value) for r in rows if r.transcript == name) == sorted((starts[max(0, first[no] - 2)], "\n".join(lines[max(0, first[no] - 2) : last[no] + 1])) for no in first)
        lone += len(first) > 1 and first[max(first)] == len(lines) - 1
    assert lone > 3
    lines = spark.createDataFrame([(f, i, x) for f, own in said.items() for i, x in enumerate(own)], "file string, line_no long, value string")
    transcripts.written_in_segments(lines, f"{tmp_path}/l", 400, again=2)
    got = taken(spark, transcripts.uuid_tree, f"{tmp_path}/l", f"{tmp_path}/state", f"{tmp_path}/out").select("file", "ordinal", "uuid").collect()
    assert sorted(map(tuple, got)) == sorted((f, i, f"u{i}") for f, own in said.items() for i in range(len(own)))


def test_transcripts_of_shifted_sessions_are_those_of_the_sql(spark, sf, tmp_path):
    """Before, sessions were put in transcripts by division of floats, rounded down below zero."""
    for name in os.listdir(sf):
        os.symlink(f"{sf}/{name}", f"{tmp_path}/{name}")
    os.remove(f"{tmp_path}/conversations.parquet")
    rows = spark.read.parquet(f"{sf}/conversations.parquet")
    rows.withColumn("conv_id", F.col("conv_id") - 60).unionByName(rows.withColumn("conv_id", F.col("conv_id") + 2**53 + 41)).coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    con = connection(str(tmp_path))
    assert difference(catalog.queries()["stream_transcripts"](spark, str(tmp_path)), con, catalog.oracles()["stream_transcripts"]) is None

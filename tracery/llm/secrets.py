"""Secret scans over an incremental ledger of blobs.

Every version of every text is content-addressed. The ledger (Parquet) holds, for each blob, the rules it
was scanned with, by name and version, and the spans that they found. A run scans only pairs of blob and
rule version that the ledger lacks, appends them to it, and joins the findings back to all paths that
hold the blob. Each map task sends a blob's text once at most, so copies cost no shuffle.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keeping, shared_folder, staged, text_chunks


class Rule(NamedTuple):
    """needs: one of these strings stands in any text with a match. keep: of a match, whether it counts."""

    name: str
    version: int
    pattern: str
    needs: tuple[str, ...] = ()
    keep: Callable[[re.Match], bool] = lambda m: True
    flags: int = re.ASCII


#: The first three are the base; spans are told in this order where they start alike.
RULES = [
    Rule("assign", 1, r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", (":", "="), lambda m: len(m[2]) >= 12, re.ASCII | re.IGNORECASE),
    Rule("access", 1, r"AKIA[A-Z0-9]+", ("AKIA",), lambda m: len(m[0]) >= 18),
    Rule("hex", 1, r"[0-9a-f]{16,}"),
    # A whole block; one that is cut off goes on to the end of the text.
    Rule("pem", 2, r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:[\s\S]*?-----END [A-Z ]*PRIVATE KEY-----|[\s\S]*)", ("-----BEGIN ",)),
    Rule("github", 1, r"gh[pousr]_[A-Za-z0-9]{36,}", ("ghp_", "gho_", "ghu_", "ghs_", "ghr_")),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", ("eyJ",)),
]
BASE = ("assign", "access", "hex")
SPANS = "array<struct<start:int,kind_no:int,kind:string,end:int>>"
LEDGER = f"blob string, rules array<string>, spans {SPANS}"
#: A task remembers so many blobs that it has sent, or scanned; beyond them it starts anew.
SEEN = 1 << 20


def find(text: str, rules: list[tuple[int, Rule]], compiled: dict[str, re.Pattern]) -> list[tuple[int, int, str, int]]:
    """(start, kind_no, kind, end) of each match that counts, in order; code points, end exclusive."""
    out = []
    for no, rule in rules:
        if not rule.needs or any(x in text for x in rule.needs):
            out += [(m.start(), no, rule.name, m.end()) for m in compiled[rule.name].finditer(text) if rule.keep(m)]
    return sorted(out)


def once_in_a_task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Content-addresses texts and passes on each blob's first row in the task."""
    seen: set[bytes] = set()
    for part in text_chunks(batches):
        blobs, texts = [], []
        for text in part.column("text").to_pylist():
            own = hashlib.sha256((text or "").encode())
            if own.digest() not in seen:
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(own.digest())
                blobs.append(own.hexdigest())
                texts.append(text or "")
        yield pa.RecordBatch.from_arrays([pa.array(blobs, pa.string()), pa.array(texts, pa.string())], ["blob", "text"])


def scan(rules: list[Rule]) -> Callable:
    """Scans each blob with the rules that it lacks; a blob that came from several map tasks is scanned once (or again, with the same spans, after SEEN others)."""
    tags = {f"{r.name}@{r.version}": (i, r) for i, r in enumerate(rules)}

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = {r.name: re.compile(r.pattern, r.flags) for r in rules}
        kind, done = pa.struct([("start", pa.int32()), ("kind_no", pa.int32()), ("kind", pa.string()), ("end", pa.int32())]), set()
        for part in text_chunks(batches):
            out: tuple[list, list, list] = ([], [], [])
            for blob, text, known in zip(*(part.column(c).to_pylist() for c in ("blob", "text", "known")), strict=True):
                lacks = [t for t in tags if t not in (known or ())]
                if lacks and blob not in done:
                    if len(done) >= SEEN:
                        done.clear()
                    done.add(blob)
                    spans = [dict(zip(("start", "kind_no", "kind", "end"), s, strict=True)) for s in find(text, [tags[t] for t in lacks], compiled)]
                    for column, value in zip(out, (blob, lacks, spans), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.list_(pa.string())), pa.array(out[2], pa.list_(kind))], ["blob", "rules", "spans"])

    return rows


def read_ledger(spark, path: str) -> DataFrame:
    try:
        return spark.read.schema(LEDGER).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LEDGER)  # the first run


def blob_of(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def scan_versions(versions: DataFrame, text_col: str, *keep: Column, ledger: str | None = None, rules: list[Rule] | None = None) -> DataFrame:
    """The columns `keep` of every row (its path, revision, text or what else), its blob, and all spans found in it.

    ledger: folder of the ledger, read and then appended to; a new one in the shared folder by default. If two runs
    append the same pair at once, its spans are still told once. Null texts count as empty. Equal texts share a blob;
    repeated rows are all returned. A kept column called blob or spans gets an underscore after its name.
    """
    rules, spark = rules or RULES, versions.sparkSession
    ledger = ledger or shared_folder(spark)
    text = F.col(text_col).cast("string")
    known = read_ledger(spark, ledger).select("blob", F.explode("rules").alias("rule")).groupBy("blob").agg(F.collect_set("rule").alias("known"))
    sent = versions.select(text.alias("text")).mapInArrow(once_in_a_task, "blob string, text string").repartition("blob")
    sent.join(known, "blob", "left").select("blob", "text", "known").mapInArrow(scan(rules), LEDGER).write.mode("append").parquet(ledger)
    found = read_ledger(spark, ledger).where(F.size("spans") > 0)
    current = F.array(*(F.struct(F.lit(r.name).alias("kind"), F.lit(f"{r.name}@{r.version}").alias("tag")) for r in rules))
    live = F.transform(F.filter(current, lambda c: F.array_contains(F.col("rules"), c["tag"])), lambda c: c["kind"])
    found = found.withColumn("spans", F.filter("spans", lambda s: F.array_contains(live, s["kind"])))
    found = found.groupBy("blob").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("spans")))).alias("spans"))
    found = staged(found)  # else the join follows an aggregation, and Spark can't split a blob with very many paths
    paths, kept = keeping(versions, keep, {"blob": blob_of(text)}, ["spans"])
    # Shuffled at every size, so that a small table costs what a large one does.
    return paths.join(found.hint("merge"), "blob", "left").select(*(f"`{c}`" for c in kept), "blob", F.coalesce("spans", F.array().cast(SPANS)).alias("spans"))


def told(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def scan_documents(docs: DataFrame) -> DataFrame:
    """Counts and digests of the base spans, and all spans, for every document."""
    out = scan_versions(docs, "text", F.col("doc_id").cast("long").alias("doc_id"))
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return out.select("doc_id", *(count(k) for k in BASE), F.sha2(told(base).cast("binary"), 256).alias("base_sha256"), told(F.col("spans")).alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """The documents with each secret replaced by its kind in brackets; overlapping spans become one. n_chars follows the text, null stays null."""
    found = scan_versions(docs, "text", F.struct("*").alias("row"))
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(acc, s):
        gap = F.when(s["start"] >= acc["at"], F.concat(F.substring(F.col("row.text"), acc["at"] + 1, s["start"] - acc["at"]), F.lit("["), F.upper(s["kind"]), F.lit("]"))).otherwise(F.lit(""))
        return F.struct(F.concat(acc["out"], gap).alias("out"), F.greatest(acc["at"], s["end"]).alias("at"))

    def close(acc):
        return F.concat(acc["out"], F.substring(F.col("row.text"), acc["at"] + 1, F.length("row.text")))

    hit = F.size("spans") > 0
    text = F.when(hit, F.aggregate("spans", start, step, close)).otherwise(F.col("row.text"))
    found = found.withColumn("text", text)
    n_chars = F.when(hit, F.length("text").cast("long")).otherwise(F.col("row.n_chars"))
    return found.select(*({"text": F.col("text"), "n_chars": n_chars}.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns))

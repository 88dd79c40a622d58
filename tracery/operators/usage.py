"""Token usage and cost: rows, snapshot survivors, deduplication across sessions, pricing, allocation, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import per_million
from ..sources.tables import Tables

#: Tokens of one row are clamped to this.
MAX_TOKENS = 2_000_000
#: Microdollars per million tokens: model, input, output, cache creation, cache read; and above so many input tokens, by tier.
RATES = [("m0", 3_000_000, 15_000_000, 3_750_000, 300_000), ("m1", 800_000, 4_000_000, 1_000_000, 80_000)]
TIERS = [("m0", 900, 6_000_000, 22_500_000, 7_500_000, 600_000)]
COUNTS = ("input_tokens", "output_tokens", "cache_creation", "cache_read")


def clamp(tokens: Column) -> Column:
    return F.least(F.greatest(tokens.cast("long"), F.lit(0)), F.lit(MAX_TOKENS))


def usage_rows(t: Tables) -> DataFrame:
    """Assistant messages with a model, counters clamped."""
    return t.messages.where((F.col("role") == "assistant") & (F.col("model") != "")).withColumns({c: clamp(F.col(c)) for c in COUNTS})


def snapshots(rows: DataFrame) -> DataFrame:
    """Of rows with one message and request id: the one with most output (then the latest), told as of the session that had it first."""
    keyed = rows.where("message_id <> '' and request_id <> ''")
    one = Window.partitionBy("message_id", "request_id")
    first = one.orderBy("ts", "session_id", "ordinal")
    names = ("session_id", "project", "agent", "machine", "branch", "is_automated", "user_id")
    keyed = keyed.withColumns({f"first_{c}": F.first(c).over(first) for c in names})
    keyed = keyed.withColumn("turn", F.row_number().over(one.orderBy(F.desc("output_tokens"), F.desc("ts"), F.desc("event_id")))).where("turn = 1")
    keyed = keyed.withColumns({c: F.col(f"first_{c}") for c in names}).drop("turn", *(f"first_{c}" for c in names))
    return keyed.unionByName(rows.where("message_id = '' or request_id = ''"))


def dedup(rows: DataFrame) -> DataFrame:
    """Of rows with one token (message and request id, else agent and source id) the first by time, session, ordinal stays; rows without one all stay."""
    token = F.when((F.col("message_id") != "") & (F.col("request_id") != ""), F.concat_ws("|", F.lit("r"), "message_id", "request_id")).when(F.col("source_uuid") != "", F.concat_ws("|", F.lit("u"), "agent", "source_uuid"))
    rows = rows.withColumn("token", token)
    order = Window.partitionBy("token").orderBy("ts", "session_id", "ordinal")
    kept = rows.where("token is not null").withColumn("turn", F.row_number().over(order)).where("turn = 1").drop("turn")
    return kept.unionByName(rows.where("token is null")).drop("token")


def price(rows: DataFrame, rates: list[tuple] | None = None, tiers: list[tuple] | None = None) -> DataFrame:
    """Adds priced, cost and savings in microdollars (P1, P2). A row of more input than a tier's bound has that tier's rates; unpriced rows cost 0."""
    names, spark = ("r_input", "r_output", "r_creation", "r_read"), rows.sparkSession
    card = spark.createDataFrame(rates or RATES, "model string, r_input long, r_output long, r_creation long, r_read long")
    above = spark.createDataFrame(tiers if tiers is not None else TIERS, "model string, above long, t_input long, t_output long, t_creation long, t_read long")
    total = F.col("input_tokens") + F.col("cache_read") + F.col("cache_creation")
    rows = rows.join(F.broadcast(card), "model", "left")  # a rate card has one row for each model and tier
    bands = above.groupBy("model").agg(F.sort_array(F.collect_list(F.struct("above", "t_input", "t_output", "t_creation", "t_read")), asc=False).alias("bands"))
    rows = rows.join(F.broadcast(bands), "model", "left").withColumn("band", F.try_element_at(F.filter("bands", lambda b: b["above"] < total), F.lit(1)))
    rows = rows.withColumns({n: F.coalesce(F.col(f"band.t_{n[2:]}"), F.col(n)) for n in names})
    cost = per_million(*((F.col(c), F.col(n)) for c, n in zip(COUNTS, ("r_input", "r_output", "r_creation", "r_read"), strict=True)))
    saved = per_million((F.col("cache_read"), F.col("r_input") - F.col("r_read")), (F.col("cache_creation"), F.col("r_input") - F.col("r_creation")))
    return rows.withColumns({"priced": F.col("r_input").isNotNull(), "cost": F.coalesce(cost, F.lit(0)), "savings": F.coalesce(saved, F.lit(0))}).drop("bands", "band", *names)


def survivors(t: Tables) -> DataFrame:
    """What every cost report counts: rows, snapshot survivors, deduplicated, priced."""
    return price(dedup(snapshots(usage_rows(t)))).withColumn("date", F.to_date("ts"))


def sums() -> list[Column]:
    return [F.sum(c).alias(c) for c in (*COUNTS, "cost", "savings")]



def daily(t: Tables) -> DataFrame:
    """Tokens, cost and sessions by day and model."""
    return survivors(t).groupBy("date", "model").agg(*sums(), F.count_distinct("session_id").alias("sessions")).withColumn("date", F.date_format("date", "yyyy-MM-dd"))


def breakdowns(t: Tables) -> DataFrame:
    """Daily tokens and cost by project, agent, machine and model, in one pass over the rows."""
    sides = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(k).alias("label")) for k in ("project", "agent", "machine", "model"))))
    return survivors(t).withColumn("side", sides).groupBy(F.date_format("date", "yyyy-MM-dd").alias("date"), "side.kind", "side.label").agg(F.sum("output_tokens").alias("output_tokens"), F.sum("cost").alias("cost"))


def summary(t: Tables) -> DataFrame:
    """Totals with the cache hit rate reads / (reads + input)."""
    hit = F.sum("cache_read") / (F.sum("cache_read") + F.sum("input_tokens"))
    return survivors(t).agg(*sums(), F.round(hit, 6).alias("hit_rate"), F.count_distinct("session_id").alias("sessions"))


def pairwise(t: Tables, left: str = "m0", right: str = "m1") -> DataFrame:
    """Two models side by side: cost, output, sessions, the difference and the cost of a session (U8)."""
    rows = survivors(t).where(F.col("model").isin(left, right))
    side = lambda m, f: f(F.when(F.col("model") == m, F.col("cost")))
    n = lambda m: F.count_distinct(F.when(F.col("model") == m, F.col("session_id")))
    out = rows.agg(side(left, F.sum).alias("left_cost"), side(right, F.sum).alias("right_cost"), n(left).alias("left_sessions"), n(right).alias("right_sessions"))
    per = lambda s: F.round(F.col(f"{s}_cost") / F.col(f"{s}_sessions"), 6).alias(f"{s}_per_session")
    return out.select("*", (F.col("right_cost") - F.col("left_cost")).alias("delta_cost"), per("left"), per("right"))


def top_sessions(t: Tables, limit: int = 20) -> DataFrame:
    """Sessions of the greatest cost, ties by id."""
    return survivors(t).groupBy("session_id", "project", "agent").agg(F.sum("cost").alias("cost"), F.sum("output_tokens").alias("output_tokens")).orderBy(F.desc("cost"), "session_id").limit(limit)


def session_counts(t: Tables) -> DataFrame:
    """Distinct sessions among surviving rows: all, by project, by agent."""
    sides = F.explode(F.array(F.struct(F.lit("all").alias("kind"), F.lit("").alias("label")), *(F.struct(F.lit(k).alias("kind"), F.col(k).alias("label")) for k in ("project", "agent"))))
    return survivors(t).withColumn("side", sides).groupBy("side.kind", "side.label").agg(F.count_distinct("session_id").alias("sessions"))


def matching_sessions(t: Tables) -> DataFrame:
    """Sessions with an assistant message, whether it has tokens or not."""
    return t.messages.where("role = 'assistant'").agg(F.count_distinct("session_id").alias("sessions"))


def per_session(t: Tables) -> DataFrame:
    """Cost of each session, null unless all its rows are priced; models and unpriced models."""
    listed = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    out = survivors(t).groupBy("session_id").agg(F.bool_and("priced").alias("has_cost"), F.sum("cost").alias("total"), listed("model").alias("models"), listed(F.when(~F.col("priced"), F.col("model"))).alias("unpriced"), F.sum("output_tokens").alias("output_tokens"))
    return out.withColumn("cost", F.when(F.col("has_cost"), F.col("total"))).drop("total")


def session_models(t: Tables) -> DataFrame:
    """Tokens and cost of each session and model."""
    return survivors(t).groupBy("session_id", "model").agg(*sums())


def allocate(rows: DataFrame, total: str, weight: str, *order: str, within: str) -> DataFrame:
    """Adds `share`: each group's total dealt by weight, floored; the rest goes to the last row of positive weight, all-zero weights share alike."""
    own = Window.partitionBy(within)
    w = F.greatest(F.col(weight), F.lit(0)).cast("decimal(19,0)")
    rows = rows.withColumn("w", w).withColumn("w", F.when(F.sum("w").over(own) == 0, F.lit(1).cast("decimal(19,0)")).otherwise(F.col("w")))
    part = F.floor(F.col(total).cast("decimal(18,0)") * F.col("w") / F.sum("w").over(own)).cast("long")
    rows = rows.withColumn("share", part)
    last = F.row_number().over(own.orderBy((F.col("w") > 0).desc(), *(F.desc(c) for c in order))) == 1
    return rows.withColumn("share", F.col("share") + F.when(last, F.col(total) - F.sum("share").over(own)).otherwise(0)).drop("w")


def allocated(t: Tables, totals: DataFrame) -> DataFrame:
    """Each session's reported total (session_id, total in microdollars) dealt to its models by estimated cost (P3); sessions without a total have no row."""
    parts = session_models(t).select("session_id", "model", "cost").join(totals.select("session_id", "total"), "session_id")
    return allocate(parts, "total", "cost", "model", within="session_id").select("session_id", "model", "total", "share")


def provenance(t: Tables) -> DataFrame:
    """Models used and how they are priced."""
    return survivors(t).groupBy("model").agg(F.count(F.lit(1)).alias("rows"), F.bool_or("priced").alias("priced"), F.max(F.when(~F.col("priced"), "unpriced").otherwise("computed")).alias("source"))


def resolve_models(names: DataFrame, keys: DataFrame) -> DataFrame:
    """model -> matched key: exact, then dots as dashes, then case folded, then without a trailing date; a stage with several keys matches none."""
    forms = [lambda c: c, lambda c: F.replace(c, F.lit("."), F.lit("-")), lambda c: F.lower(F.replace(c, F.lit("."), F.lit("-"))), lambda c: F.regexp_replace(F.lower(F.replace(c, F.lit("."), F.lit("-"))), r"-\d{8}$", "")]
    out = names.select("model").distinct()
    for i, form in enumerate(forms):
        own = keys.select(form(F.col("key")).alias("form"), "key").distinct().groupBy("form").agg(F.min("key").alias(f"k{i}"), F.count(F.lit(1)).alias("n")).where("n = 1").drop("n")
        out = out.join(own, form(F.col("model")) == F.col("form"), "left").drop("form")
    return out.select("model", F.coalesce(*(f"k{i}" for i in range(len(forms)))).alias("key"))


#: Sources whose rows are one request each; the source of reported costs that don't count; microdollars for a web search.
REQUEST_SOURCES, ESTIMATED_COST, SEARCH_FEE = ("message",), "copilot-reported", 10_000
UNION = [
    "session_id", "ordinal", "source", "ts", "model", *COUNTS, "reasoning_tokens", "web_searches", "reported", "cost_source", "message_id", "request_id", "source_uuid", "dedup_key",
    "project", "agent", "machine", "branch", "is_automated", "user_message_count",
]


def union_rows(messages: DataFrame, events: DataFrame, standalone: DataFrame, sessions: DataFrame) -> DataFrame:
    """Assistant messages, usage events and billing rows without a session, in the columns UNION.

    messages: session_id, ordinal, role, model, ts, counters, web_searches, message_id, request_id, source_uuid. events: session_id, ordinal (or null), source, model,
    counters, reasoning_tokens, reported, cost_source, ts, dedup_key. standalone: ts, model, counters, dedup_key, is_automated. A row without a time has its session's start.
    Counters are clamped; those of a whole session are only kept from being negative.
    """
    none, long_ = lambda kind: F.lit(None).cast(kind), lambda n: F.lit(n).cast("long")
    own = sessions.select("session_id", "started_at", "project", "agent", "machine", "branch", "is_automated", "user_message_count")
    said = messages.where("role = 'assistant' and model <> ''").select(
        "session_id", F.col("ordinal").cast("long").alias("ordinal"), F.lit("message").alias("source"), "ts", "model", *(clamp(F.col(c)).alias(c) for c in COUNTS), long_(0).alias("reasoning_tokens"), F.greatest(F.coalesce("web_searches", F.lit(0)), F.lit(0)).cast("long").alias("web_searches"),
        none("long").alias("reported"), F.lit("").alias("cost_source"), "message_id", "request_id", "source_uuid", F.lit("").alias("dedup_key"))
    floor = lambda c: F.when(F.col("source") == "session", F.greatest(F.col(c).cast("long"), F.lit(0))).otherwise(clamp(F.col(c)))
    told = events.where("model <> ''").select(
        "session_id", F.col("ordinal").cast("long").alias("ordinal"), "source", "ts", "model", *(floor(c).alias(c) for c in COUNTS), F.col("reasoning_tokens").cast("long").alias("reasoning_tokens"), long_(0).alias("web_searches"),
        F.col("reported").cast("long").alias("reported"), "cost_source", *(F.lit("").alias(c) for c in ("message_id", "request_id", "source_uuid")), "dedup_key")
    with_session = said.unionByName(told).join(own, "session_id").withColumn("ts", F.coalesce("ts", "started_at")).drop("started_at")
    billed = standalone.where("model <> ''").select(
        F.lit("").alias("session_id"), none("long").alias("ordinal"), F.lit("billing").alias("source"), "ts", "model", *(clamp(F.col(c)).alias(c) for c in COUNTS), long_(0).alias("reasoning_tokens"), long_(0).alias("web_searches"),
        none("long").alias("reported"), F.lit("").alias("cost_source"), *(F.lit("").alias(c) for c in ("message_id", "request_id", "source_uuid")), "dedup_key",
        F.lit("").alias("project"), F.lit("cursor").alias("agent"), F.lit("").alias("machine"), F.lit("").alias("branch"), "is_automated", long_(0).alias("user_message_count"))
    return with_session.select(*UNION).unionByName(billed.select(*UNION))


def surviving_snapshots(rows: DataFrame) -> DataFrame:
    """Of rows with one message and request id the one with most output (then the latest), told as of the session that had it first, with the most web searches of them."""
    names = ("session_id", "project", "agent", "machine", "branch", "is_automated", "user_message_count")
    one, at = Window.partitionBy("message_id", "request_id"), F.coalesce("ordinal", F.lit(-1))
    keyed = rows.where("message_id <> '' and request_id <> ''").withColumn("at", at)
    keyed = keyed.withColumns({"owner": F.first(F.struct(*names)).over(one.orderBy(F.asc_nulls_last("ts"), "session_id", "at")), "most": F.max("web_searches").over(one)})
    turn = F.row_number().over(one.orderBy(F.desc("output_tokens"), F.desc_nulls_last("ts"), F.desc("session_id"), F.desc("at")))
    keyed = keyed.withColumn("turn", turn).where("turn = 1").withColumns({n: F.col(f"owner.{n}") for n in names} | {"web_searches": F.col("most")})
    return keyed.select(*rows.columns).unionByName(rows.where("message_id = '' or request_id = ''"))


def one_of_each(rows: DataFrame) -> DataFrame:
    """Of rows with one token the first by time, session and ordinal: message and request id, else (of messages) agent and source id, else the row's own key."""
    token = F.when((F.col("message_id") != "") & (F.col("request_id") != ""), F.concat_ws("|", F.lit("r"), "message_id", "request_id")).when((F.col("source") == "message") & (F.col("agent") != "") & (F.col("source_uuid") != ""), F.concat_ws("|", F.lit("u"), "agent", "source_uuid")).when(F.col("dedup_key") != "", F.concat_ws("|", F.lit("k"), "dedup_key"))
    rows = rows.withColumn("token", token)
    order = Window.partitionBy("token").orderBy(F.asc_nulls_last("ts"), "session_id", F.coalesce("ordinal", F.lit(-1)), *COUNTS)
    kept = rows.where("token is not null").withColumn("turn", F.row_number().over(order)).where("turn = 1").drop("turn")
    return kept.unionByName(rows.where("token is null")).drop("token")


def usage_filter(rows: DataFrame, models: list[str] | None = None, not_models: list[str] | None = None, agents: list[str] | None = None, not_agents: list[str] | None = None, projects: list[str] | None = None, not_projects: list[str] | None = None,
                 machines: list[str] | None = None, branches: list[tuple[str, str]] | None = None, min_user: int = 0, one_shots: bool = True, scope: str = "all", active: DataFrame | None = None) -> DataFrame:
    """Surviving rows of these models and sessions (F13): filtered after snapshots are chosen, by the session that a snapshot belongs to.

    Rows without a session have no project, machine, branch or messages: a filter on these leaves them out. active: sessions (session_id) that count.
    """
    c = F.col
    for column, wanted, unwanted in (("model", models, not_models), ("agent", agents, not_agents), ("project", projects, not_projects), ("machine", machines, None)):
        rows = rows.where(c(column).isin(wanted)) if wanted else rows
        rows = rows.where(~c(column).isin(unwanted)) if unwanted else rows
    if projects or not_projects or machines or branches is not None or min_user or not one_shots or active is not None:
        rows = rows.where("session_id <> ''")
    if branches is not None:
        pairs = rows.sparkSession.createDataFrame(branches, "project string, branch string")
        rows = rows.join(pairs, ["project", "branch"], "left_semi")
    rows = rows.where(c("user_message_count") >= min_user) if min_user else rows
    if not one_shots:
        rows = rows.where((c("user_message_count") > 1) | (F.lit(scope != "human") & c("is_automated")))
    rows = rows if scope == "all" else rows.where(c("is_automated") == (scope == "automated"))
    return rows if active is None else rows.join(active.select("session_id"), "session_id", "left_semi")


def priced(rows: DataFrame) -> DataFrame:
    """Adds cost and savings (P1, P2): a reported cost wins (unless it is an estimate), else tokens by rate and a fee for each web search; reasoning is billed where there is no output.

    Only a row of one request, or of one message, has a tier by its input; what an aggregate holds has the base rates.
    """
    billed = F.when(F.col("output_tokens") == 0, F.coalesce("reasoning_tokens", F.lit(0))).otherwise(F.col("output_tokens"))
    scoped = F.col("source").isin(*REQUEST_SOURCES) | F.col("ordinal").isNotNull()
    rows = rows.withColumns({"told_output": F.col("output_tokens"), "output_tokens": billed})
    tiered, flat = price(rows.where(scoped)), price(rows.where(~scoped), tiers=[("", 0, 0, 0, 0, 0)])
    out = tiered.unionByName(flat).withColumn("output_tokens", F.col("told_output")).drop("told_output")
    own = F.col("reported").isNotNull() & (F.col("cost_source") != ESTIMATED_COST)
    return out.withColumn("cost", F.when(own, F.col("reported")).otherwise(F.col("cost") + SEARCH_FEE * F.col("web_searches")))


def cache_spend(t: Tables) -> DataFrame:
    """What was spent, what it would have cost without a cache, what that saved, and the share of input that came from it."""
    rows = survivors(t)
    read, all_ = F.sum("cache_read"), F.sum(F.col("input_tokens") + F.col("cache_read") + F.col("cache_creation"))
    return rows.agg(F.sum("cost").alias("spent"), (F.sum("cost") + F.sum("savings")).alias("uncached"), F.sum("savings").alias("saved"), F.round(read / all_, 6).alias("hit_rate"))


def compare_sides(rows: DataFrame, left: dict, right: dict) -> DataFrame:
    """Two sides of surviving, priced rows, each given by lists of models, agents, projects and machines (any that is absent holds all): rows, sessions, tokens, cost, cost of a session; and the differences (U8)."""
    def side(lists: dict) -> Column:
        out = F.lit(True)
        for column, values in lists.items():
            out = out & F.col(column).isin(values)
        return out

    aggs = []
    for name, own in (("left", side(left)), ("right", side(right))):
        aggs += [F.count_if(own).alias(f"{name}_rows"), F.count_distinct(F.when(own, F.col("session_id"))).alias(f"{name}_sessions"), F.sum(F.when(own, F.col("output_tokens")).otherwise(0)).alias(f"{name}_output"), F.sum(F.when(own, F.col("cost")).otherwise(0)).alias(f"{name}_cost")]
    one = rows.agg(*aggs)
    per = lambda s: F.round(F.col(f"{s}_cost") / F.nullif(F.col(f"{s}_sessions"), F.lit(0)), 6).alias(f"{s}_per_session")
    return one.select("*", *((F.col(f"right_{c}") - F.col(f"left_{c}")).alias(f"delta_{c}") for c in ("sessions", "output", "cost")), per("left"), per("right"))

"""URL filters: host and path rules, then a tree of path templates for each host.

Paths are first generalised to shapes: what holds a digit becomes a wildcard. Shapes are counted, and the
tree is made of the counts, level by level from the host: a branch becomes a wildcard if it is one of many
small ones, or if its share of good labels doesn't differ from all its siblings' (chi-square at 5 %); so
branches that are alike are merged. A template is rejected if its smoothed purity (share of good labels,
shrunk to its host's, which is shrunk to that of all) is below LEAST. All of it is DataFrame operations; the
one wide table, the pages, is aggregated before any shuffle and joined to the templates at the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import splitting_join, staged

#: Levels that the oracle's SQL has. The tree itself goes down to the deepest path.
DEPTH = 4
#: A branch is one of many small ones if it has more than so many siblings, and under 1 / so many of their pages.
FANOUT = 16
#: Labels that a prior counts for; the quantile of chi-square; the least purity of a template.
PRIOR, CHI2, LEAST = 10.0, 3.84, 0.5
#: Verdicts by host and path of the query: the longest that fits wins over the tree.
RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
HOST, PATH, VARIABLE, NUMBER = "^([^/?#]*)", "^[^/?#]*([^?#]*)", "[^/.]*[0-9][^/.]*", "([0-9]+)[^0-9/]*/?$"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Both empty for a null url and one without ://."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    return F.coalesce(F.translate(F.regexp_extract(rest, HOST, 1), UPPER, LOWER), F.lit("")), F.coalesce(F.regexp_extract(rest, PATH, 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, as text, and its verdict; nulls if none does. rules are a short list, tried in turn."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, text in sorted(rules, key=lambda r: len(r[1])):
        own_host, own_path = text[: text.index("/")], text[text.index("/") :]
        fits = ((host == own_host) | host.endswith(f".{own_host}")) & path.startswith(own_path)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


def templates(shapes: DataFrame) -> DataFrame:
    """host, shape, template, purity for each (host, shape) of columns host, shape, n, labelled, good."""
    parts = F.split("shape", "/")
    # Each level reads the tree twice: it is written in between, else the plan doubles with every level.
    tree = staged(shapes.withColumn("parts", parts).withColumn("t", F.col("parts")[0]))
    kept = ("host", "shape", "t", "labelled", "good")
    done, live, level = tree.where(F.size("parts") <= 1).select(*kept), tree.where(F.size("parts") > 1), 1
    while live.take(1):
        live = live.withColumn("part", F.element_at("parts", level + 1))
        branch = live.groupBy("host", "t", "part").agg(*(F.sum(c).cast("double").alias(f"b_{c}") for c in ("n", "labelled", "good")), F.count(F.lit(1)).alias("b_shapes"))
        above = branch.groupBy("host", "t").agg(*(F.sum(f"b_{c}").alias(f"u_{c}") for c in ("n", "labelled", "good", "shapes")), F.count(F.lit(1)).alias("siblings"))
        small = (F.col("siblings") > FANOUT) & (F.col("b_n") * FANOUT < F.col("u_n"))
        mean = F.col("u_good") / F.greatest(F.col("u_labelled"), F.lit(1.0))
        off = F.col("b_good") - F.col("b_labelled") * mean
        alike = off * off <= CHI2 * F.col("b_labelled") * mean * (1 - mean) + 1e-9
        own = F.when((F.col("siblings") > 1) & (small | alike), F.lit("*")).otherwise(F.col("part"))
        branch = splitting_join(branch, above, "host", "t").select("host", "t", "part", own.alias("own"), (F.col("u_shapes") == 1).alias("alone"))
        # A shape that is alone has no siblings further down either: the rest of it is its template's.
        rest = F.array_join(F.slice("parts", level + 1, F.size("parts")), "/")
        grown = F.concat("t", F.lit("/"), F.when(F.col("alone"), rest).otherwise(F.col("own")))
        tree = staged(splitting_join(live, branch, "host", "t", "part").withColumn("t", grown).drop("part", "own"))
        level += 1
        ended = F.col("alone") | (F.size("parts") <= level)
        done, live = done.unionByName(tree.where(ended).select(*kept)), tree.where(~ended).drop("alone")
    tree = done.withColumnRenamed("t", "template")
    purest = lambda good, n, prior: (good + PRIOR * prior) / (n + PRIOR)
    whole = tree.agg(((F.coalesce(F.sum("good"), F.lit(0)) + 1.0) / (F.coalesce(F.sum("labelled"), F.lit(0)) + 2.0)).alias("base"))
    hosts = tree.groupBy("host").agg(F.sum("good").alias("h_good"), F.sum("labelled").alias("h_labelled")).join(F.broadcast(whole))
    hosts = hosts.select("host", purest(F.col("h_good"), F.col("h_labelled"), F.col("base")).alias("h_purity"))
    own = tree.groupBy("host", "template").agg(F.sum("good").alias("t_good"), F.sum("labelled").alias("t_labelled")).join(hosts, "host")
    own = own.select("host", "template", purest(F.col("t_good"), F.col("t_labelled"), F.col("h_purity")).alias("purity"))
    return tree.select("host", "shape", "template").join(own, ["host", "template"])


def judge(pages: DataFrame, labelled: DataFrame, *keep: Column, rules: list[tuple[str, str]] | None = None) -> DataFrame:
    """The columns `keep` with host, path, rule, verdict and template of every row of pages (column url).

    labelled: url and good (boolean), rows without either teach nothing; a url counts as often as it stands
    there. Without labels no template is rejected. Repeated rows are all returned.
    """
    def shaped(df: DataFrame, *more: Column) -> DataFrame:
        host, path = host_and_path(F.col("url").cast("string"))
        return df.select(*more, host.alias("host"), path.alias("path")).withColumn("shape", F.regexp_replace("path", VARIABLE, "*"))

    rows = shaped(pages, F.struct(*keep).alias("row"))
    taught = shaped(labelled.where(F.col("url").isNotNull() & F.col("good").isNotNull()), F.col("good"))
    counted = rows.groupBy("host", "shape").agg(F.count(F.lit(1)).alias("n"))
    known = taught.groupBy("host", "shape").agg(F.count(F.lit(1)).alias("labelled"), F.count_if("good").alias("good"))
    shapes = counted.join(known, ["host", "shape"], "full").na.fill(0, ["n", "labelled", "good"])
    tree = templates(shapes)
    out = rows.join(tree, ["host", "shape"], "left")
    rule, said = rule_of(F.col("host"), F.col("path"), rules if rules is not None else RULES)
    judged = F.when(F.col("purity") < LEAST, F.lit("block")).otherwise(F.lit("allow"))
    return out.select("row.*", "host", "path", rule.alias("rule"), F.coalesce(said, judged).alias("verdict"), "template")


def page_labels(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """url, good: pages whose path ends in the number of a rated document; good if it is sound and not toxic. Of several ratings the worst counts."""
    rated = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & F.col("toxic").isNotNull())
    rated = rated.groupBy(F.col("doc_id").cast("long").alias("number")).agg(F.min(((F.col("quality") > 0) & (F.col("toxic") == 0)).cast("int")).alias("good"))
    path = host_and_path(F.col("url").cast("string"))[1]
    numbered = pages.select("url", F.regexp_extract(path, NUMBER, 1).try_cast("long").alias("number"))
    return numbered.where("number is not null").join(rated, "number").select("url", (F.col("good") == 1).alias("good"))


def judge_pages(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """The verdict on the url of every page; the ratings of the documents that urls name teach the tree."""
    return judge(pages, page_labels(pages, labels), F.col("page_id").cast("long").alias("page_id"))


def oracle() -> str:
    """judge_pages in DuckDB's SQL."""
    ctes = [
        f"p AS (SELECT page_id, translate(regexp_extract(rest, '{HOST}', 1), '{UPPER}', '{LOWER}') AS host, regexp_extract(rest, '{PATH}', 1) AS path FROM (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages))",
        f"q AS (SELECT *, regexp_replace(path, '{VARIABLE}', '*', 'g') AS shape, try_cast(nullif(regexp_extract(path, '{NUMBER}', 1), '') AS BIGINT) AS number FROM p)",
        "r AS (SELECT doc_id, min(CASE WHEN quality > 0 AND toxic = 0 THEN 1 ELSE 0 END) AS good FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL GROUP BY 1)",
        "t0 AS (SELECT host, shape, string_split(shape, '/') AS parts, string_split(shape, '/')[1] AS t, count(*) AS n, count(r.good) AS labelled, coalesce(sum(r.good), 0) AS good FROM q LEFT JOIN r ON q.number = r.doc_id GROUP BY 1, 2)",
    ]
    for k in range(1, DEPTH + 1):
        mean = "(u_good / greatest(u_labelled, 1.0))"
        off = f"(b_good - b_labelled * {mean})"
        ctes += [
            f"b{k} AS (SELECT *, sum(b_n) OVER w AS u_n, sum(b_labelled) OVER w AS u_labelled, sum(b_good) OVER w AS u_good, count(*) OVER w AS siblings FROM (SELECT host, t, parts[{k + 1}] AS part, sum(n)::DOUBLE AS b_n, sum(labelled)::DOUBLE AS b_labelled, sum(good)::DOUBLE AS b_good FROM t{k - 1} WHERE len(parts) > {k} GROUP BY 1, 2, 3) WINDOW w AS (PARTITION BY host, t))",
            f"t{k} AS (SELECT a.host, a.shape, a.parts, a.n, a.labelled, a.good, CASE WHEN b.part IS NULL THEN a.t ELSE a.t || '/' || CASE WHEN siblings > 1 AND ((siblings > {FANOUT} AND b_n * {FANOUT} < u_n) OR {off} * {off} <= {CHI2} * b_labelled * {mean} * (1 - {mean}) + 1e-9) THEN '*' ELSE b.part END END AS t FROM t{k - 1} a LEFT JOIN b{k} b ON a.host = b.host AND a.t = b.t AND a.parts[{k + 1}] = b.part AND len(a.parts) > {k})",
        ]
    ctes += [
        f"tree AS (SELECT host, shape, labelled, good, t || CASE WHEN len(parts) > {DEPTH + 1} THEN '/' || array_to_string(parts[{DEPTH + 2}:], '/') ELSE '' END AS template FROM t{DEPTH})",
        f"h AS (SELECT host, (sum(good) + {PRIOR} * (SELECT (coalesce(sum(good), 0) + 1.0) / (coalesce(sum(labelled), 0) + 2.0) FROM tree)) / (sum(labelled) + {PRIOR}) AS h_purity FROM tree GROUP BY 1)",
        f"o AS (SELECT tree.host, template, (sum(good) + {PRIOR} * any_value(h_purity)) / (sum(labelled) + {PRIOR}) AS purity FROM tree JOIN h ON tree.host = h.host GROUP BY 1, 2)",
    ]
    own = sorted(RULES, key=lambda r: -len(r[1]))
    fits = lambda t: f"(host = '{t[: t.index('/')]}' OR host LIKE '%.{t[: t.index('/')]}') AND starts_with(path, '{t[t.index('/') :]}')"
    rule = " ".join(f"WHEN {fits(t)} THEN '{t}'" for _, t in own)
    said = " ".join(f"WHEN {fits(t)} THEN '{v}'" for v, t in own)
    return f"WITH {', '.join(ctes)} SELECT page_id, host, path, CASE {rule} END AS rule, CASE {said} WHEN purity < {LEAST} THEN 'block' ELSE 'allow' END AS verdict, template FROM (SELECT q.page_id, q.host, q.path, tree.template, o.purity FROM q JOIN tree ON q.host = tree.host AND q.shape = tree.shape JOIN o ON o.host = tree.host AND o.template = tree.template)"

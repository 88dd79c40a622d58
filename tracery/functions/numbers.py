"""Numbers as the archive's reports count them: nearest-rank percentiles, integer medians, half-away rounding, money."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import staged


def half_away(x: Column, places: int = 0) -> Column:
    """Rounds the double itself, halves away from zero; SQL's round works on its decimal form."""
    scale = 10**places
    return F.signum(x) * F.floor(F.abs(x) * scale + 0.5) / scale


def ranked(df: DataFrame, value: str, *keys: str) -> DataFrame:
    """Adds rank (from 0) and n within the keys, nulls of the value left out."""
    own = Window.partitionBy(*keys)
    return df.where(F.col(value).isNotNull()).withColumn("rank", F.row_number().over(own.orderBy(value)) - 1).withColumn("n", F.count(F.lit(1)).over(own))


def percentile(value: str, p: float) -> Column:
    """Over ranked rows: the value at rank min(floor(n * p), n - 1)."""
    return F.max(F.when(F.col("rank") == F.least(F.floor(F.col("n") * p), F.col("n") - 1), F.col(value)))


def median(value: str) -> Column:
    """Over ranked rows of whole numbers: the middle one, or the middle pair's whole mean."""
    low = F.max(F.when(F.col("rank") == F.floor((F.col("n") - 1) / 2), F.col(value)))
    high = F.max(F.when(F.col("rank") == F.floor(F.col("n") / 2), F.col(value)))
    return F.floor((low + high) / 2).cast("long")


def per_million(*parts: tuple[Column, Column]) -> Column:
    """Sum of tokens x microdollars per million tokens, rounded once, halves away from zero."""
    total = sum((t.cast("decimal(20,0)") * r.cast("decimal(17,0)") for t, r in parts[1:]), parts[0][0].cast("decimal(20,0)") * parts[0][1].cast("decimal(17,0)"))
    return F.round(total.cast("decimal(38,0)") / F.lit(1000000).cast("decimal(7,0)"), 0).cast("long")


def bucket(x: Column, edges: list[tuple[float, str]], top: str, closed: bool = False) -> Column:
    """The label of the first edge that x is below (or at, if closed)."""
    out = None
    for edge, label in edges:
        test = x <= edge if closed else x < edge
        out = F.when(test, label) if out is None else out.when(test, label)
    return out.otherwise(top)


def place_among(x: Column, bounds: list, at: bool = True) -> Column:
    """How many of the ascending bounds (a list of bounded length) are at most x, or below x; found by halving."""
    if not bounds:
        return F.lit(0)
    all_, leaps = F.array(*map(F.lit, bounds)), F.array(*(F.lit(1 << i) for i in reversed(range(len(bounds).bit_length()))))
    holds = lambda b: b <= x if at else b < x
    return F.aggregate(leaps, F.lit(0), lambda n, leap: F.when(holds(F.get(all_, n + leap - 1)), n + leap).otherwise(n))


def counted(df: DataFrame, value: str, *keys: str) -> DataFrame:
    """Distinct values of each key with their number of rows, the rows before them and all rows: ranks without a row for each row.

    Rows are counted by value before anything is put in order, so a key with very many rows has no more than its distinct values in a task.
    """
    n = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("copies"))
    own = Window.partitionBy(*keys)
    upto = F.sum("copies").over(own.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    return n.withColumn("before", upto - F.col("copies")).withColumn("n", F.sum("copies").over(own))


def at_rank(value: str, rank: Column) -> Column:
    """Over counted rows: the value of the row with this rank (from 0)."""
    return F.max(F.when((F.col("before") <= rank) & (rank < F.col("before") + F.col("copies")), F.col(value)))


def counted_percentile(value: str, p: float) -> Column:
    """Over counted rows: the value at rank min(floor(n * p), n - 1)."""
    return at_rank(value, F.least(F.floor(F.col("n") * p), F.col("n") - 1))


def counted_median(value: str) -> Column:
    """Over counted rows of whole numbers: the middle one, or the middle pair's whole mean."""
    return F.floor((at_rank(value, F.floor((F.col("n") - 1) / 2)) + at_rank(value, F.floor(F.col("n") / 2))) / 2).cast("long")


#: How far from a percentile's place its value is looked for, as a share of the rows; the accuracy of the bounds is ten times finer.
BAND = 0.0005


def exact_percentile(df: DataFrame, value: str, p: float, *keys: str) -> DataFrame:
    """keys, value, n: for each key the value at rank min(floor(n * p), n - 1), exactly.

    Approximate percentiles on both sides bound where it is; what is below is counted, and only the rows between the bounds are put in order.
    """
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("v"))
    ends = F.percentile_approx("v", [max(p - BAND, 0.0), min(p + BAND, 1.0)], int(10 / BAND))
    bounds = rows.groupBy(*keys).agg(ends.alias("ends"), F.count(F.lit(1)).alias("n"))
    bounds = staged(bounds.select(*(F.col(k).alias(f"k_{k}") for k in keys), F.col("ends")[0].alias("low"), F.col("ends")[1].alias("high"), "n"))
    same = [F.col(k).eqNullSafe(F.col(f"k_{k}")) for k in keys]
    near = rows.join(bounds, same if same else None) if keys else rows.join(F.broadcast(bounds))  # without keys there is one row
    below = near.groupBy(*keys).agg(F.count_if(F.col("v") < F.col("low")).alias("below"))
    band = near.where(F.col("v").between(F.col("low"), F.col("high"))).withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy("v")) - 1)
    found = band.join(below.select(*(F.col(k).alias(f"b_{k}") for k in keys), "below"), [F.col(k).eqNullSafe(F.col(f"b_{k}")) for k in keys]) if keys else band.join(F.broadcast(below))
    at = F.least(F.floor(F.col("n") * p), F.col("n") - 1)
    return found.where(F.col("below") + F.col("rank") == at).select(*keys, F.col("v").alias(value), "n")

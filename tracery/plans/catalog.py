"""All queries of the engine by name, and their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import LENS_SQL, lens
from . import advice, billing, evidence, found, intake, job, mixes, ranges, reports, rollups, search, selections, signals, timing, upkeep

FAMILIES = [reports.QUERIES, signals.QUERIES, search.LENS_QUERIES, upkeep.LENS_QUERIES, intake.LENS_QUERIES, advice.QUERIES, ranges.QUERIES, job.QUERIES, billing.QUERIES, mixes.QUERIES, evidence.QUERIES, selections.QUERIES, found.QUERIES, rollups.QUERIES, timing.QUERIES]
TABLES = [search.TABLE_QUERIES, found.TABLE_QUERIES, {name: (query, sql and LENS_SQL + sql) for name, (query, sql) in upkeep.STREAM_QUERIES.items()}]


def _over_lens(operator: Callable) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: operator(lens(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {name: _over_lens(operator) for family in FAMILIES for name, (operator, _) in family.items()}
    return found | {name: query for family in TABLES for name, (query, _) in family.items()}


def oracles() -> dict[str, str]:
    found = {name: LENS_SQL + sql for family in FAMILIES for name, (_, sql) in family.items() if sql}
    return found | {name: sql for family in TABLES for name, (_, sql) in family.items() if sql}

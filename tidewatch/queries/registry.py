"""All queries of the library with the SQL that gives the same rows, where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidewatch.queries import discovery, durable, landed, more, queues, reporting, scans, settled, shredding, streams, telemetry, valuation

ALL = valuation.QUERIES | discovery.QUERIES | scans.QUERIES | telemetry.QUERIES | shredding.QUERIES | more.QUERIES | streams.QUERIES | queues.QUERIES | landed.QUERIES | durable.QUERIES | settled.QUERIES | reporting.QUERIES


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, (f, _) in ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: text for name, (_, text) in ALL.items() if text}

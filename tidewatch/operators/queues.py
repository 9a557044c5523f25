"""Queues of work and their summaries: one pass of conditional aggregates each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.operators import schedule
from tidewatch.operators.reorg import dimension


def _now(as_of: str):
    return F.lit(as_of).cast("timestamp")


def work_kinds(work: DataFrame, as_of: str) -> DataFrame:
    """(kind, total, due) of work items (kind, due_at)."""
    return work.groupBy("kind").agg(F.count("*").alias("total"), F.count_if(F.col("due_at") <= _now(as_of)).alias("due"))


def work_kinds_wide(work: DataFrame, as_of: str, kinds: list[str]) -> DataFrame:
    """One row with <kind>_total and <kind>_due for each of the kinds, 0 where there is none."""
    own = lambda k: F.col("kind") == k
    return work.agg(*(c for k in kinds for c in (F.count_if(own(k)).alias(f"{k}_total"), F.count_if(own(k) & (F.col("due_at") <= _now(as_of))).alias(f"{k}_due"))))


def _log_due(as_of: str):
    """(recent, history): whether either clock of a task of token histories is due; a null time never is."""
    due = lambda c: F.coalesce(F.col(c) <= _now(as_of), F.lit(False))
    return due("recent_due_at"), due("history_due_at") & F.col("completed_at").isNull()


def log_queue(tasks: DataFrame, hidden: DataFrame, as_of: str) -> DataFrame:
    """Per chain what waits in the queue of token histories, by its two clocks and four lanes.

    tasks: as for schedule.log_lanes(), with next_block, history_limited and last_error; hidden: (chain,
    address) of contracts that are not canonical, which don't count.  A task in several lanes counts in
    each; due counts it once.
    """
    rows = tasks.join(hidden.select("chain", "address"), ["chain", "address"], "left_anti")
    recent, past = _log_due(as_of)
    tried, calm = F.col("recent_failures") > 0, F.col("history_failures") == 0
    return rows.groupBy("chain").agg(
        F.count("*").alias("total"),
        F.count_if(recent | past).alias("due"),
        F.count_if(recent & ~tried).alias("recent_due"),
        F.count_if(past & calm & (F.col("priority") >= 50)).alias("high_value_due"),
        F.count_if((recent & tried) | (past & ~calm)).alias("retry_due"),
        F.count_if(past & calm & (F.col("priority") < 50)).alias("history_due"),
        F.count("last_error").alias("failed"),
        F.count_if(F.col("completed_at").isNull() | F.col("history_limited")).alias("partial"),
        F.coalesce(F.unix_seconds(_now(as_of)) - F.unix_seconds(F.min(F.when(recent | past, F.col("updated_at")))), F.lit(0)).alias("oldest_age_sec"),
        F.min("next_block").alias("next_block"),
    )


def due_count(tasks: DataFrame, hidden: DataFrame, as_of: str) -> DataFrame:
    """How many tasks of token histories are due by either clock; those of hidden contracts don't count."""
    recent, past = _log_due(as_of)
    return tasks.where(recent | past).join(hidden.select("chain", "address"), ["chain", "address"], "left_anti").agg(F.count("*").alias("due"))


def error_histogram(rows: DataFrame) -> DataFrame:
    return rows.where("last_error is not null").groupBy("chain", "last_error").agg(F.count("*").alias("n"))


def lane_rates(minutes: DataFrame, as_of: str, seconds: int = 3600) -> DataFrame:
    """Windows completed, links found and retries that succeeded, of each lane of each chain in the minutes since `seconds` before as_of."""
    since = F.date_trunc("minute", _now(as_of) - F.make_interval(secs=F.lit(seconds)))
    recent = minutes.where((F.col("minute") >= since) & (F.col("minute") <= _now(as_of)))
    return recent.groupBy("chain", "lane").agg(*(F.sum(c).alias(c) for c in ("completed", "links", "retry_success")))


def balance_queue(state: DataFrame, as_of: str) -> DataFrame:
    """Addresses with a chain to read: all that are due, those due for an error, the planned rest, and the oldest one's age.

    An address counts once; it is due for an error if any of its due chains has one.
    """
    due = state.where(F.coalesce(F.col("next_retry_at") <= _now(as_of), F.lit(True)))
    own = due.groupBy("address").agg(F.max(F.col("status").isin("rpc_error", "partial", "timeout").cast("int")).alias("failed"), F.min("next_retry_at").alias("since"))
    return own.agg(
        F.count("*").alias("due"), F.count_if(F.col("failed") == 1).alias("error_due"), F.count_if(F.col("failed") == 0).alias("planned"),
        F.max(F.unix_seconds(_now(as_of)) - F.unix_seconds("since")).alias("oldest_age_seconds"),
    )


def never_scanned(contracts: DataFrame, state: DataFrame, caps: DataFrame) -> DataFrame:
    """(address, first_seen) of canonical contracts that have neither a state nor a cap."""
    rows = contracts.where("canonical = 1").join(state.select("address").distinct(), "address", "left_anti").join(caps.select("address").distinct(), "address", "left_anti")
    return rows.groupBy("address").agg(F.min("first_seen").alias("first_seen"))


def earliest_due(work: DataFrame) -> DataFrame:
    return work.groupBy("chain", "address").agg(F.min("due_at").alias("due_at"))


def pending_first(contracts: DataFrame, limit: int) -> DataFrame:
    """Contracts to check, never checked ones first, then the newest."""
    return contracts.orderBy(F.col("last_checked_at").isNull().desc(), F.col("created_block").desc_nulls_last(), "chain", "address").limit(limit)


def streak_grows(scans: DataFrame) -> DataFrame:
    """scans (failed_tokens, deferred_tokens) with grows: whether a token failed that was not put off on purpose."""
    return scans.withColumn("grows", F.size(F.array_except("failed_tokens", "deferred_tokens")) > 0)


def latest_nonzero(contracts: DataFrame, scans: DataFrame) -> DataFrame:
    """Contracts with their latest scan, those that hold something."""
    last = schedule.latest_by_id(scans).where("total_usd > 0")
    return contracts.join(last, "address")


def estimates_with_scans(estimates: DataFrame, scans: DataFrame) -> DataFrame:
    """Estimates with older_scan: whether they were made for another scan than the latest one."""
    last = schedule.latest_by_id(scans).select("address", F.col("id").alias("latest_id"))
    return estimates.join(last, "address", "left").withColumn("older_scan", ~F.col("scan_id").eqNullSafe(F.col("latest_id")))


def report_order(rows: DataFrame) -> DataFrame:
    return rows.orderBy(F.desc("total_usd"), "address")


def token_order(rows: DataFrame) -> DataFrame:
    """Tokens by value, unknown values last."""
    return rows.orderBy("address", F.coalesce("usd_value", F.lit(-1.0)).desc(), "token")


def seed_tasks(contracts: DataFrame, discoveries: DataFrame, chains: DataFrame, tasks: DataFrame, min_usd: float = 150_000.0) -> DataFrame:
    """New tasks (chain, address, first_block, next_block, history_limited, priority) of canonical contracts that are worth min_usd.

    contracts: (chain, address, created_block, canonical, last_total_usd); chains: (chain, start_block,
    last_indexed).  A task begins at the contract's creation, else at its first known observation, else
    where its chain was read to, but not before the chain's start; contracts that have a task keep it.
    """
    seen = discoveries.groupBy("chain", "address").agg(F.min("observed_block").alias("observed"))
    rows = contracts.where((F.col("canonical") == 1) & (F.col("last_total_usd") >= min_usd)).withColumn("address", F.lower("address"))
    rows = rows.join(tasks.select("chain", "address"), ["chain", "address"], "left_anti").join(dimension(chains), "chain").join(seen, ["chain", "address"], "left")
    first = F.coalesce("created_block", "observed", "last_indexed")
    start = F.when(first.isNotNull() & F.col("start_block").isNotNull(), F.greatest("start_block", first))
    return rows.select("chain", "address", start.alias("first_block"), start.alias("next_block"), F.col("created_block").isNull().alias("history_limited"), F.lit(50).alias("priority")).where("first_block is not null")


def task_priorities(tasks: DataFrame, contracts: DataFrame, min_usd: float = 150_000.0) -> DataFrame:
    """tasks with priority: 100 until their recent blocks are read, then 50 for valuable addresses and 10 for others."""
    rich = contracts.groupBy("address").agg(F.max("last_total_usd").alias("__usd"))
    value = F.when(~F.col("recent_complete"), 100).when(F.coalesce("__usd", F.lit(0.0)) >= min_usd, 50).otherwise(10)
    return tasks.join(rich, "address", "left").withColumn("priority", value).select(*tasks.columns)


def keyed(df: DataFrame, order: list[str], **equal: str) -> DataFrame:
    """Rows whose columns have the given values, in order: tokens of a chain, discoveries of a source, parts of a scan."""
    for name, value in equal.items():
        df = df.where(F.col(name) == F.lit(value))
    return df.orderBy(*order)

"""Reports over scans, chains and tokens as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.operators import schedule, telemetry
from tidewatch.operators.reorg import dimension


def hidden_addresses(contracts: DataFrame) -> DataFrame:
    """Addresses all of whose contracts are non-canonical."""
    return contracts.groupBy("address").agg(F.max("canonical").alias("c")).where("c = 0").select("address")


def select_report(scans: DataFrame, kind: str, min_usd: float, hidden: DataFrame | None = None) -> DataFrame:
    """Latest scans of a report; qualifying goes by the total alone, the others by the stored status too."""
    rows = schedule.latest_by_time(scans)
    if hidden is not None:
        rows = rows.join(hidden, "address", "left_anti")
    over = F.coalesce("total_usd", F.lit(0.0)) >= min_usd
    if kind == "qualifying":
        return rows.where(over)
    if kind in ("below", "incomplete"):
        return rows.where(~over & (F.col("status") == kind))
    raise ValueError(f"no such report: {kind}")


def status_counts(scans: DataFrame) -> DataFrame:
    return schedule.latest_by_id(scans).groupBy("status").agg(F.count("*").alias("n"))


def coverage_histogram(scans: DataFrame) -> DataFrame:
    """How many latest scans cover c of t networks."""
    label = F.concat_ws("/", "coverage", "total_networks")
    return schedule.latest_by_id(scans).groupBy(label.alias("coverage")).agg(F.count("*").alias("n"))


def histogram_map(histogram: DataFrame) -> DataFrame:
    return histogram.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("coverage", "n")))).alias("coverage_json"))


def contract_counts(contracts: DataFrame) -> DataFrame:
    """Contracts of each chain by the status of their last scan."""
    return contracts.groupBy("chain").agg(
        F.count("*").alias("contracts"),
        F.count_if(F.col("last_status").isNull()).alias("unchecked"),
        *(F.count_if(F.col("last_status") == s).alias(s) for s in ("qualifying", "below", "incomplete")),
    )


def report_rows(latest: DataFrame, parts: DataFrame, sources: DataFrame) -> DataFrame:
    """A row an address with its networks as ordered text; children are summed before they are joined."""
    p = parts.groupBy("address").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chain", "status"))), lambda x: F.concat_ws(":", x["chain"], x["status"])), ", ").alias("networks"),
        F.sum("total_usd").alias("parts_usd"),
    )
    s = sources.groupBy("address").agg(F.array_join(F.array_sort(F.collect_set("source")), ", ").alias("sources"))
    return latest.join(p, "address", "left").join(s, "address", "left")


#: Columns of the full report, in order.
FULL_REPORT = (
    "address total_usd coverage status networks_with_code network_balances tokens discovery_sources first_seen last_seen checked notes "
    "estimate_usd estimate_lower_usd estimate_upper_usd estimate_status estimate_coverage estimate_checked estimate_parts estimate_notes"
).split()


def money(v: Column) -> Column:
    return F.concat(F.lit("$"), F.format_number(F.coalesce(v, F.lit(0.0)), 2))


def _texts(rows: DataFrame, key: str, order: list[Column], texts: dict[str, Column], *more: Column) -> DataFrame:
    """(key, names of texts, more): the texts of each key in order, with "; " between them, and further aggregates in the same pass."""
    marks = [o.alias(f"o{i}") for i, o in enumerate(order)]
    own = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*marks, *(t.alias(f"t_{n}") for n, t in texts.items())))).alias("__x"), *more)
    joined = [F.array_join(F.col(f"__x.t_{n}"), "; ").alias(n) for n in texts]  # a field of an array of rows is the array of its values
    return own.select(key, *joined, *(c for c in own.columns if c not in (key, "__x")))


def full_report(latest: DataFrame, parts: DataFrame, tokens: DataFrame, sources: DataFrame, estimates: DataFrame, chains: DataFrame, tokens_info: DataFrame) -> DataFrame:
    """FULL_REPORT of latest scans (id, address, total_usd, coverage, total_networks, status, scanned_at, note).

    parts (scan_id, chain, status, has_code, total_usd, observed_native_usd, excluded_usd): those with
    code are listed by chain; tokens (scan_id, chain, token, raw_amount, amount, usd_value, priced,
    valuation) by chain, then value, unpriced ones last; sources (address, chain, source,
    observed_block, observed_tx, first_seen_at) by when they were seen; estimates (address, ...,
    scan_id, chain_parts, token_parts) never change status or total, and say if they are of an older
    scan; chains (chain, display_name, lifecycle) and tokens_info (chain, token, symbol) give names.
    Children become one row an address or scan before they are joined.
    """
    names = dimension(chains.select("chain", "display_name", "lifecycle"))
    p = parts.where("has_code = 1").join(names, "chain", "left")
    shut = F.coalesce("excluded_usd", F.lit(0.0))
    detail = F.when(shut != 0, F.concat(F.lit(", observed native="), money(F.col("observed_native_usd")), F.lit(", excluded="), money(shut))).otherwise("")
    balance = F.concat("chain", F.lit("="), money(F.col("total_usd")), F.lit(" ("), "status", detail, F.lit("; lifecycle="), F.coalesce("lifecycle", F.lit("unknown")), F.lit(")"))
    networks = _texts(p, "scan_id", [F.col("chain")], {"networks_with_code": F.coalesce("display_name", "chain"), "network_balances": balance})
    own = tokens.join(latest.select(F.col("id").alias("scan_id")), "scan_id", "left_semi")
    t = own.join(tokens_info.select("chain", "token", "symbol"), ["chain", "token"], "left")
    label = F.coalesce(F.nullif("symbol", F.lit("")), F.substring("token", 1, 10))
    note = F.coalesce("valuation", F.lit("included"))
    odd = note != "included"
    value = F.when(F.col("priced") == 1, F.concat(money(F.col("usd_value")), F.when(odd, F.concat(F.lit(" ("), note, F.lit(")"))).otherwise("")))
    bare = F.concat(F.coalesce(F.col("amount").cast("string"), "raw_amount"), F.lit(" (unpriced"), F.when(odd, F.concat(F.lit(", "), note)).otherwise(""), F.lit(")"))
    held = _texts(t, "scan_id", [F.col("chain"), -F.coalesce("usd_value", F.lit(-1.0)), F.col("token")], {"tokens": F.concat("chain", F.lit(":"), label, F.lit("="), F.coalesce(value, bare))})
    seen = F.concat_ws(":", "chain", "source", F.coalesce(F.col("observed_block").cast("string"), F.lit("None")), F.coalesce("observed_tx", F.lit("")))
    times = F.min("first_seen_at").alias("first_seen"), F.max("first_seen_at").alias("last_seen")
    found = _texts(sources, "address", [F.col("first_seen_at"), F.col("chain"), F.col("source")], {"discovery_sources": seen}, *times)
    part = F.array_join(F.transform(F.filter("chain_parts", lambda x: x["has_code"] == 1), lambda x: F.concat(x["chain"], F.lit("=$"), x["estimated_usd"])), "; ")
    token = lambda x: F.concat(x["chain"], F.lit(":"), x["symbol"], F.lit("="), x["amount"], F.when(x["priced"], F.concat(F.lit(" ($"), F.regexp_replace(F.format_number(x["usd_value"], 2), ",", ""), F.lit(")"))).otherwise(" (unpriced)"))
    texts = F.substring(F.concat(part, F.lit(" | "), F.array_join(F.transform("token_parts", token), "; ")), 1, 32_000)  # as long as a cell of a sheet can be
    e = estimates.select(
        "address", F.col("estimated_usd").alias("estimate_usd"), F.col("lower_usd").alias("estimate_lower_usd"), F.col("upper_usd").alias("estimate_upper_usd"), F.col("status").alias("estimate_status"),
        F.concat_ws("/", "coverage", "total_networks").alias("estimate_coverage"), F.col("checked_at").alias("estimate_checked"), texts.alias("estimate_parts"), F.col("note").alias("__note"), "uncertainty", F.col("scan_id").alias("__scan"),
    )
    rows = latest
    for child in (networks, held):
        rows = rows.join(child.withColumnRenamed("scan_id", "id"), "id", "left")
    for child in (found, e):
        rows = rows.join(child, "address", "left")
    about = F.when(F.col("estimate_status").isNotNull(), F.concat(F.coalesce("__note", F.lit("")), F.lit("; assumed deviation="), F.format_string("%.0f%%", F.col("uncertainty") * 100), F.when(~F.col("__scan").eqNullSafe(F.col("id")), "; relates to an older RPC scan").otherwise("")))
    rows = rows.withColumns({"coverage": F.concat_ws("/", "coverage", "total_networks"), "total_usd": F.coalesce("total_usd", F.lit(0.0)), "checked": F.col("scanned_at"), "notes": F.col("note"), "estimate_notes": about})
    return rows.withColumns({c: F.coalesce(c, F.lit("")) for c in ("networks_with_code", "network_balances", "tokens", "discovery_sources")}).select(FULL_REPORT)


def evidence_json(anomalies: DataFrame, threshold: float) -> DataFrame:
    return anomalies.withColumn("evidence_json", F.to_json(F.struct(F.lit(threshold).alias("threshold_usd"), "chain", "token")))


def monitoring_snapshot(scans: DataFrame, contracts: DataFrame) -> DataFrame:
    latest = schedule.latest_by_id(scans).agg(*(F.count_if(F.col("status") == s).alias(s) for s in ("qualifying", "below", "incomplete")))
    own = contracts.agg(F.countDistinct("address").alias("addresses"), F.count("*").alias("instances"))
    return own.crossJoin(latest)  # one row each


def network_report(samples: DataFrame, attempts: DataFrame, gaps: DataFrame) -> DataFrame:
    """Per chain: its last sample, its dominant failure and its gaps."""
    last = telemetry.latest_samples(samples.where("role = 'live'"), ["chain"])
    fail = telemetry.dominant_failure(attempts).select("chain", "error_class", F.col("n").alias("failures"))
    return last.join(fail, "chain", "left").join(gaps, "chain", "left")


def endpoint_health(endpoints: DataFrame, as_of: str) -> DataFrame:
    """Endpoints that are out of use and for how many seconds more; a permanent error has no end."""
    now = F.unix_seconds(F.lit(as_of).cast("timestamp"))
    until = F.greatest(F.unix_seconds(F.col("cooldown_until").cast("timestamp")), F.unix_seconds(F.col("circuit_until").cast("timestamp")))
    left = F.greatest(until - now, F.lit(0))
    return endpoints.withColumn("remaining_seconds", F.when(F.col("permanent_error").isNull(), left)).where(F.col("permanent_error").isNotNull() | (left > 0))


def fleet_totals(gaps: DataFrame, queues: DataFrame) -> DataFrame:
    """One row over all chains: open gaps, blocks left in them, alerts, and the sums of the queue classes."""
    g = gaps.agg(F.coalesce(F.sum("open_gaps"), F.lit(0)).alias("open_gaps"), F.coalesce(F.sum("remaining_blocks"), F.lit(0)).alias("remaining_blocks"), F.coalesce(F.sum("alerts"), F.lit(0)).alias("alerts"))
    names = ["total", "due", "recent_due", "high_value_due", "retry_due", "history_due", "failed", "partial"]
    q = queues.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in names))
    return g.crossJoin(q)  # one row each


def status_report(scans: DataFrame, contracts: DataFrame, gaps: DataFrame, queues: DataFrame, network: DataFrame | None = None) -> DataFrame:
    """One row: what is found, by status, and what waits; with the summary of the object network (sui.network_summary()), too."""
    rows = monitoring_snapshot(scans, contracts).crossJoin(fleet_totals(gaps, queues))  # one row each
    return rows if network is None else rows.crossJoin(network.select(*(F.col(c).alias(f"sui_{c}") for c in network.columns)))


def period_report(samples: DataFrame, resources: DataFrame, as_of: str, seconds: int) -> DataFrame:
    """Per chain: blocks gained and scans done, requests and errors in the seconds before as_of, and its last lag, with the machine's load.

    Counters count last minus first by id, and never under 0.  Cursors go on over restarts; scans begin
    at 0 with each run (run_id), so their growth counts only where the first and the last sample are of
    one run.
    """
    until = F.lit(as_of).cast("timestamp")
    inside = (F.col("ts") > until - F.make_interval(secs=F.lit(seconds))) & (F.col("ts") <= until)
    s = samples.where(inside).groupBy("chain").agg(
        F.min_by(F.struct("cursor_block", "scans", "run_id"), "id").alias("a"), F.max_by(F.struct("cursor_block", "scans", "run_id"), "id").alias("b"),
        F.sum("rpc_requests").alias("requests"), F.sum("rpc_errors").alias("errors"), F.max_by(F.col("safe_head") - F.col("cursor_block"), F.struct("ts", "id")).alias("lag_blocks"),
    )
    grown = lambda c: F.greatest(F.col(f"b.{c}") - F.col(f"a.{c}"), F.lit(0))
    s = s.select("chain", grown("cursor_block").alias("blocks"), F.when(F.col("a.run_id") == F.col("b.run_id"), grown("scans")).alias("scans"), "requests", "errors", "lag_blocks")
    machine = resources.where(inside).agg(F.avg("cpu_percent").alias("cpu_percent"), F.max("load1").alias("load1"), F.avg("ram_percent").alias("ram_percent"))
    return s.crossJoin(machine)  # one row


def network_overview(samples: DataFrame, attempts: DataFrame, gaps: DataFrame, queues: DataFrame) -> DataFrame:
    """network_report with the queue of each chain and the slowest stage of its work by mean time."""
    stages = attempts.groupBy("chain", "workload").agg(F.avg("ms").alias("mean_ms"))
    slow = stages.groupBy("chain").agg(F.max_by(F.struct("workload", "mean_ms"), F.struct("mean_ms", "workload")).alias("s")).select("chain", F.col("s.workload").alias("slowest_stage"), F.col("s.mean_ms").alias("slowest_ms"))
    q = queues.select("chain", F.col("total").alias("tasks"), "due", "retry_due", "failed", "partial")
    return network_report(samples, attempts, gaps).join(q, "chain", "left").join(slow, "chain", "left")


def contracts_per_source(discoveries: DataFrame) -> DataFrame:
    """Distinct addresses and instances of each source."""
    return discoveries.groupBy("source").agg(F.countDistinct("address").alias("addresses"), F.count("*").alias("instances"))

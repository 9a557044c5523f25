"""Latest scans, reports and what is due next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.operators import reports, schedule
from tidewatch.plans.fixtures import AS_OF, sql, view

BY_TIME = ", l AS (SELECT * FROM fx_scans QUALIFY row_number() OVER (PARTITION BY address ORDER BY scanned_at DESC, id DESC) = 1)"
BY_ID = ", l AS (SELECT * FROM fx_scans QUALIFY row_number() OVER (PARTITION BY address ORDER BY id DESC) = 1)"


def _scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "fx_scans")


def latest_scans_by_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schedule.latest_by_time(_scans(spark, sf_dir)).drop("scanned_at")


def latest_scans_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schedule.latest_by_id(_scans(spark, sf_dir)).drop("scanned_at")


def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.status_counts(_scans(spark, sf_dir))


def coverage_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.coverage_histogram(_scans(spark, sf_dir))


def select_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three reports in one; addresses divisible by ten have no canonical contract and are hidden."""
    scans = _scans(spark, sf_dir)
    contracts = scans.select("address", F.when(F.col("address") % 10 == 0, 0).otherwise(1).alias("canonical")).where("address % 3 <> 0")
    hidden = reports.hidden_addresses(contracts)
    parts = [reports.select_report(scans, k, 400_000.0, hidden).select("address", "id", "total_usd", F.lit(k).alias("kind")) for k in ("qualifying", "below", "incomplete")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


SELECT_REPORTS = sql("fx_scans", body=BY_TIME + """
SELECT address, id, total_usd, CASE WHEN total_usd >= 400000 THEN 'qualifying' ELSE status END AS kind FROM l
WHERE NOT (address % 10 = 0 AND address % 3 <> 0) AND (total_usd >= 400000 OR status IN ('below', 'incomplete'))""")


def report_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    scans = _scans(spark, sf_dir)
    latest = schedule.latest_by_time(scans).select("address", "id", "total_usd")
    parts = scans.select("address", F.concat(F.lit("c"), F.col("id") % 5).alias("chain"), "status", "total_usd").distinct()
    sources = scans.select("address", F.when(F.col("id") % 2 == 0, "direct_deploy").otherwise("active_call").alias("source"))
    return reports.report_rows(latest, parts, sources).withColumn("parts_usd", F.round("parts_usd", 2))


REPORT_ROWS = sql("fx_scans", body=BY_TIME + """,
p AS (SELECT DISTINCT address, concat('c', CAST(id % 5 AS STRING)) AS chain, status, total_usd FROM fx_scans),
a AS (SELECT address, string_agg(concat(chain, ':', status), ', ' ORDER BY chain, status) AS networks, round(sum(total_usd), 2) AS parts_usd FROM p GROUP BY address),
s AS (SELECT address, string_agg(source, ', ' ORDER BY source) AS sources FROM (SELECT DISTINCT address, CASE WHEN id % 2 = 0 THEN 'direct_deploy' ELSE 'active_call' END AS source FROM fx_scans) GROUP BY address)
SELECT l.address, l.id, l.total_usd, a.networks, a.parts_usd, s.sources FROM l LEFT JOIN a ON a.address = l.address LEFT JOIN s ON s.address = l.address""")


def recheck_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = schedule.recheck_at(schedule.latest_by_id(_scans(spark, sf_dir)), 400_000.0)
    return out.select("address", "id", "delay_seconds", (F.col("due_at") <= F.lit(AS_OF).cast("timestamp")).alias("due"))


RECHECK = BY_ID + """, r AS (SELECT *, CAST(CASE WHEN status = 'incomplete' THEN 1800 WHEN total_usd >= 400000 THEN 86400 WHEN total_usd >= 150000 THEN 259200 WHEN total_usd > 0 THEN 2592000 ELSE 7776000 END AS BIGINT) AS delay_seconds FROM l)"""
RECHECK_DUE = sql("fx_scans", body=RECHECK + f" SELECT address, id, delay_seconds, scanned_at + to_seconds(delay_seconds) <= TIMESTAMP '{AS_OF}' AS due FROM r")


def pending_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New addresses (too few scans), valuable ones and the rest, first 60."""
    scans = _scans(spark, sf_dir)
    due = schedule.recheck_at(schedule.latest_by_id(scans), 400_000.0).select("address", "total_usd", F.unix_seconds("due_at").alias("due_at")).where(F.col("due_at") <= F.unix_seconds(F.lit(AS_OF).cast("timestamp")))
    new = scans.groupBy("address").agg(F.count("*").alias("n"), F.min(F.unix_seconds("scanned_at")).alias("due_at")).where("n % 9 = 0")
    return schedule.pending_tiers(new, due.where("total_usd >= 400000"), due, 60)


PENDING = sql("fx_scans", body=RECHECK + f""",
d AS (SELECT address, total_usd, CAST(epoch(scanned_at) AS BIGINT) + delay_seconds AS due_at FROM r WHERE CAST(epoch(scanned_at) AS BIGINT) + delay_seconds <= CAST(epoch(TIMESTAMP '{AS_OF}') AS BIGINT)),
n AS (SELECT address, min(CAST(floor(epoch(scanned_at)) AS BIGINT)) AS due_at FROM fx_scans GROUP BY address HAVING count(*) % 9 = 0),
u AS (SELECT address, 1 AS tier, due_at FROM n UNION ALL SELECT address, 2, due_at FROM d WHERE total_usd >= 400000 UNION ALL SELECT address, 3, due_at FROM d)
SELECT address, tier, due_at FROM u QUALIFY row_number() OVER (PARTITION BY address ORDER BY tier, due_at) = 1 ORDER BY tier, due_at, address LIMIT 60""").replace("CAST(epoch(scanned_at) AS BIGINT)", "CAST(floor(epoch(scanned_at)) AS BIGINT)")


def recheck_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    scans = _scans(spark, sf_dir).where("status = 'incomplete'")
    state = schedule.latest_by_id(scans).select("address", F.col("scanned_at").alias("due_at"))
    out = schedule.apply_cap(state, schedule.capped_addresses(scans, 8))
    return out.select("address", "work", (F.year("due_at") == 9999).alias("never"))


RECHECK_CAPS = sql("fx_scans", body=""", c AS (SELECT address, count(*) AS n FROM fx_scans WHERE status = 'incomplete' GROUP BY address)
SELECT address, CASE WHEN n >= 8 THEN 'capped' ELSE 'open' END AS work, n >= 8 AS never FROM c""")


def log_tasks(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Tasks of token histories, and the contracts that are not canonical."""
    return view(spark, sf_dir, "fx_log_tasks"), view(spark, sf_dir, "fx_log_contracts").where("canonical = 0").select("chain", "address")


def log_work(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places in the four lanes of work on token histories, in either order of lanes and with history at rest."""
    tasks, hidden = log_tasks(spark, sf_dir)
    out = None
    for turn, options in (("recent", {}), ("history", {"prefer_history": True}), ("rest", {"allow_history": False})):
        rows = schedule.rank_log_work(tasks, hidden, AS_OF, **options).select(F.lit(turn).alias("turn"), "chain", "address", "lane", "lane_rank", "work", "place")
        out = rows if out is None else out.unionByName(rows)
    return out


LANES = f""", t AS (SELECT *, coalesce(recent_due_at <= TIMESTAMP '{AS_OF}', false) AS rd, coalesce(history_due_at <= TIMESTAMP '{AS_OF}', false) AND completed_at IS NULL AS hd FROM fx_log_tasks k
  WHERE NOT EXISTS (SELECT 1 FROM fx_log_contracts c WHERE c.chain = k.chain AND c.address = k.address AND c.canonical = 0)),
n AS (SELECT chain, address, 'recent' AS lane, 'recent' AS work, -priority AS w, recent_due_at AS a, recent_updated_at AS b FROM t WHERE rd AND recent_failures = 0
  UNION ALL SELECT chain, address, 'high_value', 'history', -priority, history_due_at, history_updated_at FROM t WHERE hd AND priority >= 50 AND history_failures = 0
  UNION ALL SELECT chain, address, 'retry', CASE WHEN recent_failures > 0 AND rd THEN 'recent' ELSE 'history' END, -priority, updated_at, NULL FROM t WHERE (rd AND recent_failures > 0) OR (hd AND history_failures > 0)
  UNION ALL SELECT chain, address, 'historical', 'history', 0, history_due_at, history_updated_at FROM t WHERE hd AND priority < 50 AND history_failures = 0),
o AS (SELECT * FROM (VALUES ('recent', 'recent', 1), ('recent', 'high_value', 2), ('recent', 'retry', 3), ('recent', 'historical', 4), ('history', 'historical', 1), ('history', 'high_value', 2), ('history', 'recent', 3), ('history', 'retry', 4), ('rest', 'recent', 1), ('rest', 'retry', 2)) v(turn, lane, lane_rank)),
p AS (SELECT *, row_number() OVER (PARTITION BY lane ORDER BY w, a NULLS FIRST, b NULLS FIRST, chain, address) AS place FROM n)"""
LOG_WORK = sql("fx_log_tasks", "fx_log_contracts", body=LANES + " SELECT o.turn, p.chain, p.address, p.lane, o.lane_rank, p.work, p.place FROM p JOIN o ON o.lane = p.lane")


def next_log_task(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next task of each turn."""
    tasks, hidden = log_tasks(spark, sf_dir)
    out = None
    for turn, options in (("recent", {}), ("history", {"prefer_history": True}), ("rest", {"allow_history": False})):
        rows = schedule.next_log_task(tasks, hidden, AS_OF, **options).select(F.lit(turn).alias("turn"), "chain", "address", "lane", "work")
        out = rows if out is None else out.unionByName(rows)
    return out


NEXT_LOG_TASK = sql("fx_log_tasks", "fx_log_contracts", body=LANES + " SELECT o.turn, p.chain, p.address, p.lane, p.work FROM p JOIN o ON o.lane = p.lane WHERE place = 1 QUALIFY row_number() OVER (PARTITION BY turn ORDER BY lane_rank) = 1")


def failure_streaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = schedule.failure_streaks(view(spark, sf_dir, "fx_attempts"), ["endpoint"], F.col("error_class") != "ok", ["id"], chunk_seconds=100)
    return out.select("id", "endpoint", "streak")


FAILURE_STREAKS = sql("fx_attempts", body=""", i AS (SELECT *, sum(CASE WHEN error_class = 'ok' THEN 1 ELSE 0 END) OVER (PARTITION BY endpoint ORDER BY id ROWS UNBOUNDED PRECEDING) AS g FROM fx_attempts)
SELECT id, endpoint, CAST(sum(CASE WHEN error_class <> 'ok' THEN 1 ELSE 0 END) OVER (PARTITION BY endpoint, g ORDER BY id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS streak FROM i""")


def estimate_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    scans = _scans(spark, sf_dir)
    made = scans.where("address % 4 = 0").groupBy("address").agg(F.max("scanned_at").alias("estimated_at"))
    return schedule.estimate_candidates(schedule.latest_by_id(scans), made, AS_OF, 3 * 86400).select("address", "id")


ESTIMATE_CANDIDATES = sql("fx_scans", body=BY_ID + f" SELECT address, id FROM l WHERE status = 'incomplete' AND floor(epoch(TIMESTAMP '{AS_OF}')) - floor(epoch(scanned_at)) >= 259200 AND (address % 4 <> 0 OR scanned_at > (SELECT max(scanned_at) FROM fx_scans s WHERE s.address = l.address))")


def monitoring_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.monitoring_snapshot(_scans(spark, sf_dir), view(spark, sf_dir, "fx_code").where("has_code = 1"))


MONITORING = sql("fx_scans", "fx_code", body=BY_ID + """
SELECT (SELECT count(DISTINCT address) FROM fx_code WHERE has_code = 1) AS addresses, (SELECT count(*) FROM fx_code WHERE has_code = 1) AS instances,
  count(*) FILTER (WHERE status = 'qualifying') AS qualifying, count(*) FILTER (WHERE status = 'below') AS below, count(*) FILTER (WHERE status = 'incomplete') AS incomplete FROM l""")

QUERIES = {
    "latest_scans_by_time": (latest_scans_by_time, sql("fx_scans", body=BY_TIME + " SELECT id, address, total_usd, status, coverage, total_networks FROM l")),
    "latest_scans_by_id": (latest_scans_by_id, sql("fx_scans", body=BY_ID + " SELECT id, address, total_usd, status, coverage, total_networks FROM l")),
    "status_counts": (status_counts, sql("fx_scans", body=BY_ID + " SELECT status, count(*) AS n FROM l GROUP BY status")),
    "coverage_histogram": (coverage_histogram, sql("fx_scans", body=BY_ID + " SELECT concat_ws('/', CAST(coverage AS STRING), CAST(total_networks AS STRING)) AS coverage, count(*) AS n FROM l GROUP BY 1")),
    "select_reports": (select_reports, SELECT_REPORTS),
    "report_rows": (report_rows, REPORT_ROWS),
    "recheck_due": (recheck_due, RECHECK_DUE),
    "pending_tiers": (pending_tiers, PENDING),
    "recheck_caps": (recheck_caps, RECHECK_CAPS),
    "log_work": (log_work, LOG_WORK),
    "next_log_task": (next_log_task, NEXT_LOG_TASK),
    "failure_streaks": (failure_streaks, FAILURE_STREAKS),
    "estimate_candidates": (estimate_candidates, ESTIMATE_CANDIDATES),
    "monitoring_snapshot": (monitoring_snapshot, MONITORING),
}

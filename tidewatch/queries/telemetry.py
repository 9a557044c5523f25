"""Roll-ups, rates, thresholds and incidents over telemetry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions import scalars as S
from tidewatch.operators import hash_tree
from tidewatch.operators import telemetry as T
from tidewatch.plans.fixtures import sql, view
from tidewatch.streaming.incidents import Threshold


def _attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "fx_attempts")


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "fx_samples")


def _resources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "fx_resources").withColumn("day", F.to_date("ts"))


def r(c: str, digits: int = 6) -> Column:
    return F.round(F.col(c), digits).alias(c)


def rpc_minutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = T.minute_rollup(_attempts(spark, sf_dir), "ts", ["chain", "workload"], "ms")
    return out.select(F.unix_seconds("minute").alias("minute"), "chain", "workload", "n", r("total"), r("longest"))


RPC_MINUTES = sql("fx_attempts", body=" SELECT CAST(epoch(date_trunc('minute', ts)) AS BIGINT) AS minute, chain, workload, count(*) AS n, round(sum(ms), 6) AS total, round(max(ms), 6) AS longest FROM fx_attempts GROUP BY 1, 2, 3")


def stage_minutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The slowest workload of each chain."""
    out = T.slowest_stage(T.minute_rollup(_attempts(spark, sf_dir), "ts", ["chain", "workload"], "ms"))
    return out.select("chain", "workload", r("mean_ms"))


STAGE_MINUTES = sql("fx_attempts", body=", m AS (SELECT chain, workload, sum(ms) / count(*) AS mean_ms FROM fx_attempts GROUP BY 1, 2) SELECT chain, workload, round(mean_ms, 6) AS mean_ms FROM m QUALIFY row_number() OVER (PARTITION BY chain ORDER BY mean_ms DESC, workload DESC) = 1")


def top_failure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.dominant_failure(_attempts(spark, sf_dir))


TOP_FAILURE = sql("fx_attempts", body=", n AS (SELECT chain, workload, endpoint, error_class, count(*) AS n FROM fx_attempts WHERE error_class <> 'ok' GROUP BY 1, 2, 3, 4) SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY chain ORDER BY n DESC, workload, endpoint, error_class) = 1")


def latency_interp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.latency(_attempts(spark, sf_dir), ["endpoint"]).select("endpoint", "requests", "errors", r("p50"), r("p95"))


LATENCY_INTERP = sql("fx_attempts", body=" SELECT endpoint, count(*) AS requests, count(*) FILTER (WHERE error_class <> 'ok') AS errors, round(quantile_cont(ms, 0.5), 6) AS p50, round(quantile_cont(ms, 0.95), 6) AS p95 FROM fx_attempts GROUP BY endpoint")


def latency_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.nearest_rank(_attempts(spark, sf_dir), ["endpoint"], "ms").select("endpoint", r("nearest"))


LATENCY_NEAREST = sql("fx_attempts", body=", s AS (SELECT endpoint, ms, row_number() OVER (PARTITION BY endpoint ORDER BY ms) - 1 AS i, count(*) OVER (PARTITION BY endpoint) AS n FROM fx_attempts) SELECT endpoint, round(ms, 6) AS nearest FROM s WHERE i = CAST(round_even((n - 1) * CAST(0.95 AS DOUBLE), 0) AS INT)")


def latency_disc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _attempts(spark, sf_dir).groupBy("endpoint").agg(F.expr("percentile_disc(0.95) within group (order by ms)").alias("p95"))
    return out.select("endpoint", r("p95"))


LATENCY_DISC = sql("fx_attempts", body=" SELECT endpoint, round(quantile_disc(ms, 0.95), 6) AS p95 FROM fx_attempts GROUP BY endpoint")


def latency_ewma(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Smoothed latency of each endpoint and day."""
    out = T.ewma(_attempts(spark, sf_dir).withColumn("day", F.date_format("ts", "yyyy-MM-dd")), ["endpoint", "day"], ["id"], "ms", chunk_seconds=100)
    return out.select("endpoint", "day", r("ewma"))


LATENCY_EWMA = sql("fx_attempts", body=", l AS (SELECT endpoint, strftime(ts, '%Y-%m-%d') AS day, list(ms ORDER BY id) AS xs FROM fx_attempts GROUP BY 1, 2) SELECT endpoint, day, round(list_reduce(xs, lambda a, x: a * CAST(0.8 AS DOUBLE) + x * (1 - CAST(0.8 AS DOUBLE))), 6) AS ewma FROM l")


def error_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.error_totals(_samples(spark, sf_dir))


ERROR_TYPES = sql("fx_samples", body=", k AS (SELECT unnest(json_keys(errors_json)) AS kind, errors_json FROM fx_samples) SELECT kind, CAST(sum(CAST(json_extract_string(errors_json, concat('$.', kind)) AS BIGINT)) AS BIGINT) AS n FROM k GROUP BY kind")


def top_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.top_errors(_samples(spark, sf_dir), ["chain", "active_rpc"])


TOP_ERRORS = sql("fx_samples", body=", k AS (SELECT chain, active_rpc, unnest(json_keys(errors_json)) AS kind, errors_json FROM fx_samples) SELECT chain, active_rpc, kind, CAST(sum(CAST(json_extract_string(errors_json, concat('$.', kind)) AS BIGINT)) AS BIGINT) AS n FROM k GROUP BY 1, 2, 3 ORDER BY n DESC, chain, active_rpc, kind LIMIT 15")


def rate_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests of the last hour at each second with any, of the fleet and of each chain."""
    return T.rate_budget(_attempts(spark, sf_dir), 18, 5, 3600)


RATE_BUDGET = sql("fx_attempts", body=""", c AS (SELECT CAST(floor(epoch(ts)) AS BIGINT) AS s, chain, count(*) AS n FROM fx_attempts GROUP BY 1, 2), f AS (SELECT s, sum(n) AS n FROM c GROUP BY s),
u AS (SELECT s, CAST(sum(n) OVER (ORDER BY s RANGE BETWEEN 3599 PRECEDING AND CURRENT ROW) AS BIGINT) AS used FROM f),
o AS (SELECT *, CAST(sum(n) OVER (PARTITION BY chain ORDER BY s RANGE BETWEEN 3599 PRECEDING AND CURRENT ROW) AS BIGINT) AS chain_used FROM c)
SELECT o.s, o.chain, o.n, o.chain_used, u.used, u.used > 18 OR o.chain_used > 5 AS over FROM o JOIN u ON u.s = o.s""")


def latest_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.latest_samples(_samples(spark, sf_dir), ["chain", "role"]).drop("ts", "errors_json", "run_id", "scans")


LATEST_SAMPLES = sql("fx_samples", body=" SELECT chain, role, id, active_rpc, cursor_block, safe_head, rpc_requests, rpc_errors FROM fx_samples QUALIFY row_number() OVER (PARTITION BY chain, role ORDER BY id DESC) = 1")


def blocks_per_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.rates(_samples(spark, sf_dir), ["chain", "role"], "cursor_block").select("id", F.round("rate", 4).alias("rate"))


BLOCKS_PER_HOUR = sql("fx_samples", body=""", l AS (SELECT id, cursor_block, epoch_us(ts) / 1e6 AS t, lag(cursor_block) OVER w AS c0, lag(epoch_us(ts) / 1e6) OVER w AS t0 FROM fx_samples WINDOW w AS (PARTITION BY chain, role ORDER BY id))
SELECT id, round(CASE WHEN t - t0 > 0 THEN greatest(CAST(0 AS DOUBLE), (cursor_block - c0) * CAST(3600 AS DOUBLE) / (t - t0)) END, 4) AS rate FROM l""")


def baseline_stall(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _samples(spark, sf_dir).withColumn("cursor_block", F.when(F.col("chain") < "e", F.lit(7).cast("bigint")).otherwise(F.col("cursor_block")))
    return T.stalls(rows, ["chain", "role"])


BASELINE_STALL = sql("fx_samples", body=""", s AS (SELECT id, ts, chain, role, active_rpc, safe_head, CASE WHEN chain < 'e' THEN 7 ELSE cursor_block END AS cursor_block FROM fx_samples),
l AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY chain, role ORDER BY id DESC) = 1),
b AS (SELECT s.* FROM s JOIN l ON l.chain = s.chain AND l.role = s.role AND epoch_us(l.ts) - epoch_us(s.ts) >= 900000000 QUALIFY row_number() OVER (PARTITION BY s.chain, s.role ORDER BY s.id DESC) = 1)
SELECT l.chain, l.role, l.cursor_block AS last_cursor, b.cursor_block AS base_cursor, l.active_rpc <> 'none' AND coalesce(l.cursor_block = b.cursor_block AND l.safe_head > b.safe_head, false) AS stalled FROM l LEFT JOIN b ON b.chain = l.chain AND b.role = l.role""")


def outages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.outages(_samples(spark, sf_dir), ["chain"], 86400, 3600).select("id", "chain", "n", "outage")


OUTAGES = sql("fx_samples", body=""", d AS (SELECT id, chain, epoch_us(ts) AS t FROM fx_samples WHERE active_rpc = 'none'),
w AS (SELECT *, count(*) OVER x AS n, t - min(t) OVER x AS span FROM d WINDOW x AS (PARTITION BY chain ORDER BY t RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW))
SELECT id, chain, n, n >= 2 AND span >= 3600000000 AS outage FROM w""")


def sustained_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CPU above 30 for an hour, over midnight too."""
    out = T.sustained(_resources(spark, sf_dir), F.col("cpu_percent"), F.lit(30.0), 3600, 1800)
    return out.select("id", F.round(F.col("span") * 1e6).cast("bigint").alias("span_us"), "sustained")


SUSTAINED_LOAD = sql("fx_resources", body=""", w AS (SELECT id, min(CASE WHEN cpu_percent > 30 THEN 1 ELSE 0 END) OVER x AS low, epoch_us(ts) - min(epoch_us(ts)) OVER x AS span FROM fx_resources WHERE cpu_percent IS NOT NULL
  WINDOW x AS (ORDER BY epoch_us(ts) RANGE BETWEEN 3600000000 PRECEDING AND CURRENT ROW))
SELECT id, span AS span_us, low = 1 AND span >= 1800000000 AS sustained FROM w""")


def load_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples of each day whose load was above 0.3 of the cores for half an hour."""
    rows = _resources(spark, sf_dir)
    out = T.sustained(rows, F.col("load1"), F.col("cpu_cores") * 0.3, 1800, 900)
    return out.groupBy(F.date_format("day", "yyyy-MM-dd").alias("day")).agg(F.count_if("sustained").alias("n"))


LOAD_AVERAGE = sql("fx_resources", body=""", w AS (SELECT strftime(ts, '%Y-%m-%d') AS day, min(CASE WHEN load1 > cpu_cores * CAST(0.3 AS DOUBLE) THEN 1 ELSE 0 END) OVER x AS low, (epoch_us(ts) - min(epoch_us(ts)) OVER x) / 1e6 AS span FROM fx_resources WHERE load1 IS NOT NULL
  WINDOW x AS (ORDER BY epoch_us(ts) RANGE BETWEEN 1800000000 PRECEDING AND CURRENT ROW))
SELECT day, count(*) FILTER (WHERE low = 1 AND span >= 900) AS n FROM w GROUP BY day""")

#: What opens and closes the incidents of a host.
RULE = Threshold(above=25.0, window=3600, least_span=900, below=45.0, calm_window=1800, calm_span=600)


def host() -> Column:
    """One of a fleet of three hosts."""
    return F.concat(F.lit("h"), (F.col("id") % 3).cast("string")).alias("host")


def incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CPU incidents of each host: open when the load was high for an hour, closed when it was low for half an hour; they run over midnight."""
    rows = _resources(spark, sf_dir).select("id", "ts", "cpu_percent", host())
    rows = T.sustained(rows, F.col("cpu_percent"), F.lit(RULE.above), RULE.window, RULE.least_span, ["host"])
    rows = T.held(rows, F.col("cpu_percent") < RULE.below, RULE.calm_window, RULE.calm_span, ["host"], "calm")
    out = T.incidents(rows, ["host"], F.col("sustained"), F.col("calm"), ["ts", "id"])
    return out.select("host", F.unix_micros("opened_at").alias("opened_at"), F.unix_micros("closed_at").alias("closed_at"), "repeats")


INCIDENTS = sql("fx_resources", body=""", r AS (SELECT concat('h', CAST(id % 3 AS STRING)) AS host, id, cpu_percent, epoch_us(ts) AS t FROM fx_resources WHERE cpu_percent IS NOT NULL),
k AS (SELECT *, min(CASE WHEN cpu_percent > 25 THEN 1 ELSE 0 END) OVER x = 1 AND t - min(t) OVER x >= 900000000 AS high, min(CASE WHEN cpu_percent < 45 THEN 1 ELSE 0 END) OVER y = 1 AND t - min(t) OVER y >= 600000000 AS calm
  FROM r WINDOW x AS (PARTITION BY host ORDER BY t RANGE BETWEEN 3600000000 PRECEDING AND CURRENT ROW), y AS (PARTITION BY host ORDER BY t RANGE BETWEEN 1800000000 PRECEDING AND CURRENT ROW)),
f AS (SELECT host, id, t, CASE WHEN calm THEN 1 ELSE 0 END AS c, CASE WHEN high AND NOT calm THEN 1 ELSE 0 END AS o FROM k),
e AS (SELECT *, coalesce(sum(c) OVER (PARTITION BY host ORDER BY t, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS epoch_ FROM f WHERE c + o > 0)
SELECT host, min(CASE WHEN o = 1 THEN t END) AS opened_at, max(CASE WHEN c = 1 THEN t END) AS closed_at, CAST(sum(o) AS BIGINT) AS repeats FROM e GROUP BY host, epoch_ HAVING sum(o) > 0""")


def still_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples of each chain and role whose cursor moves once in 200 samples, and some of which have no endpoint."""
    return _samples(spark, sf_dir).withColumn("cursor_block", F.floor(F.col("id") / 200) * 2000)


def stall_incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stalled cursors of each chain and role until they move."""
    return T.stall_incidents(still_samples(spark, sf_dir), ["chain", "role"])


STALLS = """, s AS (SELECT chain, role, active_rpc, safe_head, CAST(floor(id / 200) AS BIGINT) * 2000 AS cursor, epoch_us(ts) AS t FROM fx_samples),
b AS (SELECT *, last_value(safe_head) OVER (PARTITION BY chain, role, cursor ORDER BY t RANGE BETWEEN UNBOUNDED PRECEDING AND 900000000 PRECEDING) AS base FROM s),
i AS (SELECT chain, role, cursor, min(t) AS first, min(CASE WHEN active_rpc <> 'none' AND safe_head > base THEN t END) AS opened_at, count(*) FILTER (WHERE active_rpc <> 'none' AND safe_head > base) AS repeats FROM b GROUP BY ALL),
n AS (SELECT *, lead(first) OVER (PARTITION BY chain, role ORDER BY cursor) AS closed_at FROM i)"""
STALL_INCIDENTS = sql("fx_samples", body=STALLS + " SELECT chain, role, opened_at, closed_at, repeats FROM n WHERE opened_at IS NOT NULL")


def load_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States of the load governor in each day, from samples as backlog."""
    s = _samples(spark, sf_dir).withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    series = s.select(
        "day", "ts", (F.col("rpc_requests") * 60).alias("pending"), (F.col("rpc_errors") * 100).alias("oldest_sec"), F.col("rpc_errors").alias("wait_sec"),
        F.col("rpc_requests").alias("rpc_attempts"), "rpc_errors", (F.col("rpc_requests") * 100).alias("rpc_p95_ms"),
    )
    return T.load_states(series, ["day"]).groupBy("day", "state", "live", "backfill").agg(F.count("*").alias("n"))


#: The governor sample by sample; a day's samples are numbered and followed one after the other.
LOAD_STATES = sql("fx_samples", body=""", s AS (SELECT strftime(ts, '%Y-%m-%d') AS day, id, epoch_us(ts) / 1e6 AS t, CAST(floor(epoch(ts)) AS BIGINT) AS sec, rpc_requests * 60 AS pending, rpc_errors * 100 AS oldest, rpc_errors AS wait,
  rpc_requests >= 50 AS enough, rpc_errors / rpc_requests AS share, rpc_requests * 100 AS p95 FROM fx_samples),
m AS (SELECT *, enough AND (share >= 0.20 OR p95 >= 15000) AS bad, enough AND share >= 0.35 AS severe, enough AND share < 0.10 AND p95 < 8000 AS healthy FROM s),
r AS (SELECT *, coalesce(max(CASE WHEN NOT bad THEN t END) OVER w, -1) AS rb, coalesce(max(CASE WHEN NOT severe THEN t END) OVER w, -1) AS rs, coalesce(max(CASE WHEN NOT healthy THEN t END) OVER w, -1) AS rh FROM m WINDOW w AS (PARTITION BY day ORDER BY t ROWS UNBOUNDED PRECEDING)),
e AS (SELECT *, CASE WHEN (bad AND t - min(CASE WHEN bad THEN t END) OVER (PARTITION BY day, rb ORDER BY t ROWS UNBOUNDED PRECEDING) >= 120) OR (severe AND t - min(CASE WHEN severe THEN t END) OVER (PARTITION BY day, rs ORDER BY t ROWS UNBOUNDED PRECEDING) >= 60) THEN 1
  WHEN healthy AND t - min(CASE WHEN healthy THEN t END) OVER (PARTITION BY day, rh ORDER BY t ROWS UNBOUNDED PRECEDING) >= 600 THEN 0 END AS ev FROM r),
p AS (SELECT *, coalesce(last_value(ev IGNORE NULLS) OVER (PARTITION BY day ORDER BY t ROWS UNBOUNDED PRECEDING), 0) = 1 AS pressure, row_number() OVER (PARTITION BY day ORDER BY t, pending, oldest, wait) AS n FROM e),
f AS (SELECT day, n, sec, pressure, pending >= 20000 OR oldest >= 21600 AS critical, pending >= 5000 OR oldest >= 3600 OR wait >= 30 OR pressure AS drain, pending < 5000 AND oldest < 3600 AS b1, pending < 2000 AND oldest < 1800 AND wait < 15 AS b2 FROM p),
g AS (
  WITH RECURSIVE z AS (
    SELECT day, CAST(0 AS BIGINT) AS n, 'normal' AS state, CAST(NULL AS BIGINT) AS since, CAST(NULL AS BOOLEAN) AS pressure FROM (SELECT DISTINCT day FROM f)
    UNION ALL
    SELECT day, n, CASE WHEN critical THEN 'balance_only' WHEN old = 'balance_only' THEN CASE WHEN ripe THEN 'drain' ELSE old END WHEN drain THEN 'drain' WHEN old = 'drain' AND NOT ripe THEN 'drain' ELSE 'normal' END, CASE WHEN ripe THEN NULL ELSE s1 END, pressure
    FROM (SELECT *, s1 IS NOT NULL AND sec - s1 >= 600 AS ripe FROM (
      SELECT f.*, z.state AS old, CASE WHEN NOT critical AND ((z.state = 'balance_only' AND b1) OR (z.state = 'drain' AND NOT drain AND b2)) THEN coalesce(z.since, f.sec) END AS s1 FROM z JOIN f ON f.day = z.day AND f.n = z.n + 1))
  ) SELECT * FROM z WHERE n > 0)
SELECT day, state, CAST(CASE state WHEN 'balance_only' THEN 0 WHEN 'drain' THEN 3 ELSE 6 END AS INT) AS live, CAST(CASE state WHEN 'normal' THEN 3 ELSE 0 END AS INT) AS backfill, count(*) AS n FROM g GROUP BY ALL""")


def resource_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = T.metric_stats(_resources(spark, sf_dir), ["cpu_percent", "load1", "ram_percent"])
    return out.select("metric", r("current"), r("average"), r("peak"), r("p95"))


RESOURCE_STATS = sql("fx_resources", body=", x AS (SELECT id, 'cpu_percent' AS metric, cpu_percent AS v FROM fx_resources UNION ALL SELECT id, 'load1', load1 FROM fx_resources UNION ALL SELECT id, 'ram_percent', ram_percent FROM fx_resources) SELECT metric, round(arg_max(v, id), 6) AS current, round(avg(v), 6) AS average, round(max(v), 6) AS peak, round(quantile_cont(v, 0.95), 6) AS p95 FROM x WHERE v IS NOT NULL GROUP BY metric")


def period_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = T.period_change(_resources(spark, sf_dir), "cpu_percent", "ts", "2024-01-15 00:00:00")
    return out.select(r("before"), r("after"), r("change"))


PERIOD_CHANGE = sql("fx_resources", body=", x AS (SELECT avg(CASE WHEN ts < TIMESTAMP '2024-01-15 00:00:00' THEN cpu_percent END) AS b, avg(CASE WHEN ts >= TIMESTAMP '2024-01-15 00:00:00' THEN cpu_percent END) AS a FROM fx_resources) SELECT round(b, 6) AS before, round(a, 6) AS after, round(a - b, 6) AS change FROM x")


def counter_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.counter_growth(_samples(spark, sf_dir).where("id % 1000 < 650 or chain <> 'click'"), ["chain", "role"], ["cursor_block", "rpc_requests"], per_run=["scans"])


COUNTER_GROWTH = sql("fx_samples", body=""" SELECT chain, role, greatest(arg_max(cursor_block, id) - arg_min(cursor_block, id), 0) AS cursor_block, greatest(arg_max(rpc_requests, id) - arg_min(rpc_requests, id), 0) AS rpc_requests,
  CASE WHEN arg_max(run_id, id) = arg_min(run_id, id) THEN greatest(arg_max(scans, id) - arg_min(scans, id), 0) END AS scans FROM fx_samples WHERE id % 1000 < 650 OR chain <> 'click' GROUP BY 1, 2""")


def notifications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which stalls are still to be told of, and which recoveries."""
    rows = stall_incidents(spark, sf_dir)
    told = rows.withColumn("open_notified_at", F.when(F.col("repeats") % 3 != 0, F.col("opened_at"))).withColumn("recovery_notified_at", F.when(F.col("repeats") % 5 == 0, F.col("closed_at")))
    return T.pending_notifications(told).select("chain", "role", "opened_at", "tell")


NOTIFICATIONS = sql("fx_samples", body=STALLS + """, t AS (SELECT *, repeats % 3 <> 0 AS told, repeats % 5 = 0 AND closed_at IS NOT NULL AS ended FROM n WHERE opened_at IS NOT NULL)
SELECT chain, role, opened_at, CASE WHEN closed_at IS NULL THEN 'open' ELSE 'recovery' END AS tell FROM t WHERE (closed_at IS NULL AND NOT told) OR (closed_at IS NOT NULL AND told AND NOT ended)""")


def error_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.error_rate(_samples(spark, sf_dir), ["chain", "active_rpc"]).withColumn("rate", F.round("rate", 8))


ERROR_RATE = sql("fx_samples", body=" SELECT chain, active_rpc, CAST(sum(rpc_requests) AS BIGINT) AS requests, CAST(sum(rpc_errors) AS BIGINT) AS errors, round(sum(rpc_errors) / sum(rpc_requests), 8) AS rate, sum(rpc_requests) >= 50 AND sum(rpc_errors) / sum(rpc_requests) > 0.2 AS alert FROM fx_samples GROUP BY 1, 2")


def invariant_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes between two copies of the code table, one of which lost and changed rows."""
    code = view(spark, sf_dir, "fx_code").select("chain", "address", "has_code")
    after = code.where("chain <> 'c3'").withColumn("has_code", F.when(F.col("chain") == "c1", F.lit(0)).otherwise(F.col("has_code")))
    return T.invariant_diff(code, after, ["chain", "address"])


INVARIANT_DIFF = sql("fx_code", body=" SELECT chain, address, CASE WHEN chain = 'c3' THEN 'lost' ELSE 'changed' END AS change FROM fx_code WHERE chain = 'c3' OR (chain = 'c1' AND coalesce(has_code, -1) <> 0)")


def _tree_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _samples(spark, sf_dir).select("id", "chain", "role", "active_rpc", "cursor_block", "rpc_requests")


def fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Root of the hash tree of all samples, two digits deep."""
    return hash_tree.root(_tree_rows(spark, sf_dir), ["id"], 2)


def _text(columns: str) -> str:
    return "concat_ws('|', " + ", ".join(f"coalesce(concat(CAST(length(CAST({c} AS STRING)) AS STRING), ':', CAST({c} AS STRING)), '-')" for c in columns.split()) + ")"


FINGERPRINT = sql("fx_samples", body=f""", h AS (SELECT substr(sha256({_text("id")}), 1, 2) AS node, sha256({_text("id chain role active_rpc cursor_block rpc_requests")}) AS r FROM fx_samples),
l AS (SELECT node, count(*) AS rows, sum(CAST(concat('0x', substr(r, 1, 15)) AS HUGEINT)) AS a, sum(CAST(concat('0x', substr(r, 17, 15)) AS HUGEINT)) AS b FROM h GROUP BY node),
d2 AS (SELECT node, rows, sha256(concat_ws('|', node, CAST(rows AS STRING), CAST(CAST(a AS HUGEINT) AS STRING), CAST(CAST(b AS HUGEINT) AS STRING))) AS digest FROM l),
d1 AS (SELECT substr(node, 1, 1) AS up, sum(rows) AS rows, sha256(concat_ws('|', substr(node, 1, 1), string_agg(digest, '|' ORDER BY node))) AS digest FROM d2 GROUP BY substr(node, 1, 1))
SELECT CAST(sum(rows) AS BIGINT) AS rows, sha256(concat_ws('|', '', string_agg(digest, '|' ORDER BY up))) AS digest FROM d1""")


def tree_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples that a second copy lost, changed or added, found through the leaves that differ."""
    rows = _tree_rows(spark, sf_dir).withColumn("copy", F.lit("first"))  # part of the key: an added id may be one that a sample has
    k = F.col("id")
    after = rows.where(k % 97 != 5).withColumn("active_rpc", F.when(k % 101 == 7, None).otherwise(F.col("active_rpc")))
    after = after.unionByName(rows.where(k % 89 == 3).withColumns({"id": k + 1_000_000, "copy": F.lit("second")}))
    return hash_tree.changes(rows, after, ["copy", "id"], 2).drop("copy")


TREE_CHANGES = sql("fx_samples", body=" SELECT id, CASE WHEN id % 97 = 5 THEN 'lost' ELSE 'changed' END AS change FROM fx_samples WHERE id % 97 = 5 OR id % 101 = 7 UNION ALL SELECT id + 1000000, 'new' FROM fx_samples WHERE id % 89 = 3")


def retry_delays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delay of each scan by status, value and streak."""
    s = view(spark, sf_dir, "fx_scans")
    status = F.when(F.col("coverage") % 5 == 0, "rpc_error").when(F.col("coverage") % 5 == 1, "price_missing").when(F.col("coverage") % 5 == 2, "anomalous_balance").otherwise("complete")
    code = F.when(F.col("id") % 6 == 0, 0).otherwise(1)
    return s.select("id", S.retry_delay(status, code, F.col("total_usd"), 400_000.0, F.col("id") % 8).alias("delay_seconds"))


RETRY_DELAYS = sql("fx_scans", body=""" SELECT id, CASE WHEN coverage % 5 = 0 THEN CASE least(greatest(id % 8 - 1, 0), 4) WHEN 0 THEN 1800 WHEN 1 THEN 7200 WHEN 2 THEN 28800 WHEN 3 THEN 86400 ELSE 259200 END
  WHEN coverage % 5 = 1 THEN 2592000 WHEN coverage % 5 = 2 THEN 86400 WHEN id % 6 = 0 THEN 7776000 WHEN total_usd >= 400000 THEN 86400 WHEN total_usd >= 150000 THEN 259200 WHEN total_usd > 0 THEN 2592000 ELSE 7776000 END AS delay_seconds FROM fx_scans""")

QUERIES = {
    "rpc_minutes": (rpc_minutes, RPC_MINUTES),
    "stage_minutes": (stage_minutes, STAGE_MINUTES),
    "top_failure": (top_failure, TOP_FAILURE),
    "latency_interp": (latency_interp, LATENCY_INTERP),
    "latency_nearest": (latency_nearest, LATENCY_NEAREST),
    "latency_disc": (latency_disc, LATENCY_DISC),
    "latency_ewma": (latency_ewma, LATENCY_EWMA),
    "error_types": (error_types, ERROR_TYPES),
    "top_errors": (top_errors, TOP_ERRORS),
    "rate_budget": (rate_budget, RATE_BUDGET),
    "latest_samples": (latest_samples, LATEST_SAMPLES),
    "blocks_per_hour": (blocks_per_hour, BLOCKS_PER_HOUR),
    "baseline_stall": (baseline_stall, BASELINE_STALL),
    "outages": (outages, OUTAGES),
    "sustained_load": (sustained_load, SUSTAINED_LOAD),
    "load_average": (load_average, LOAD_AVERAGE),
    "incidents": (incidents, INCIDENTS),
    "stall_incidents": (stall_incidents, STALL_INCIDENTS),
    "load_states": (load_states, LOAD_STATES),
    "resource_stats": (resource_stats, RESOURCE_STATS),
    "period_change": (period_change, PERIOD_CHANGE),
    "counter_growth": (counter_growth, COUNTER_GROWTH),
    "notifications": (notifications, NOTIFICATIONS),
    "error_rate": (error_rate, ERROR_RATE),
    "invariant_diff": (invariant_diff, INVARIANT_DIFF),
    "fingerprint": (fingerprint, FINGERPRINT),
    "tree_changes": (tree_changes, TREE_CHANGES),
    "retry_delays": (retry_delays, RETRY_DELAYS),
}

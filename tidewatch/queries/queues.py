"""Queues, histories, revaluations and reports over derived state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions import scalars as S
from tidewatch.operators import discovery, history, merge, queues, reorg, reports, revalue, schedule, sui, valuation
from tidewatch.plans.fixtures import AS_OF, sql, view
from tidewatch.queries import discovery as found
from tidewatch.queries import scans
from tidewatch.queries import valuation as worth

DAY = "2024-01-30 00:00:00"
HEAD = 1500


def work(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples as work items."""
    return view(spark, sf_dir, "fx_samples").select("chain", F.col("role").alias("kind"), F.col("cursor_block").alias("address"), F.col("ts").alias("due_at"))


def work_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queues.work_kinds(work(spark, sf_dir), DAY)


WORK_KINDS = sql("fx_samples", body=f" SELECT role AS kind, count(*) AS total, count(*) FILTER (WHERE ts <= TIMESTAMP '{DAY}') AS due FROM fx_samples GROUP BY role")


def work_kinds_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queues.work_kinds_wide(work(spark, sf_dir), DAY, ["live", "backfill", "none"])


WORK_WIDE = sql("fx_samples", body=" SELECT " + ", ".join(f"count(*) FILTER (WHERE role = '{k}') AS {k}_total, count(*) FILTER (WHERE role = '{k}' AND ts <= TIMESTAMP '{DAY}') AS {k}_due" for k in ("live", "backfill", "none")) + " FROM fx_samples")


def earliest_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "fx_attempts").select("chain", F.col("endpoint").alias("address"), F.col("ts").alias("due_at"))
    return queues.earliest_due(rows).select("chain", "address", F.unix_micros("due_at").alias("due_at"))


EARLIEST = sql("fx_attempts", body=" SELECT chain, endpoint AS address, epoch_us(min(ts)) AS due_at FROM fx_attempts GROUP BY 1, 2")


def log_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queues.log_queue(*scans.log_tasks(spark, sf_dir), AS_OF)


LOG_VIEWS = ("fx_log_tasks", "fx_log_contracts")
QUEUE = f""", lt AS (SELECT *, coalesce(recent_due_at <= TIMESTAMP '{AS_OF}', false) AS rd, coalesce(history_due_at <= TIMESTAMP '{AS_OF}', false) AND completed_at IS NULL AS hd FROM fx_log_tasks k
  WHERE NOT EXISTS (SELECT 1 FROM fx_log_contracts c WHERE c.chain = k.chain AND c.address = k.address AND c.canonical = 0)),
lq AS (SELECT chain, count(*) AS total, count(*) FILTER (WHERE rd OR hd) AS due, count(*) FILTER (WHERE rd AND recent_failures = 0) AS recent_due, count(*) FILTER (WHERE hd AND priority >= 50 AND history_failures = 0) AS high_value_due,
  count(*) FILTER (WHERE (rd AND recent_failures > 0) OR (hd AND history_failures > 0)) AS retry_due, count(*) FILTER (WHERE hd AND priority < 50 AND history_failures = 0) AS history_due, count(last_error) AS failed,
  count(*) FILTER (WHERE completed_at IS NULL OR history_limited) AS partial, CAST(coalesce(epoch(TIMESTAMP '{AS_OF}') - epoch(min(CASE WHEN rd OR hd THEN updated_at END)), 0) AS BIGINT) AS oldest_age_sec, min(next_block) AS next_block
FROM lt GROUP BY chain)"""
LOG_QUEUE = sql(*LOG_VIEWS, body=QUEUE + " SELECT * FROM lq")


def due_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queues.due_count(*scans.log_tasks(spark, sf_dir), AS_OF)


DUE_TASKS = sql(*LOG_VIEWS, body=QUEUE + " SELECT CAST(sum(due) AS BIGINT) AS due FROM lq")


def error_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queues.error_histogram(scans.log_tasks(spark, sf_dir)[0])


def lane_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queues.lane_rates(view(spark, sf_dir, "fx_log_minutes"), DAY, 86400)


LANE_RATES = sql("fx_log_minutes", body=f" SELECT chain, lane, CAST(sum(completed) AS BIGINT) AS completed, CAST(sum(links) AS BIGINT) AS links, CAST(sum(retry_success) AS BIGINT) AS retry_success FROM fx_log_minutes WHERE minute >= TIMESTAMP '2024-01-29 00:00:00' AND minute <= TIMESTAMP '{DAY}' GROUP BY 1, 2")


def balance_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = view(spark, sf_dir, "fx_code").select("chain", "address", F.when(F.col("has_code").isNull(), "rpc_error").otherwise("complete").alias("status"), F.col("checked_at").alias("next_retry_at"))
    return queues.balance_queue(state, "2024-01-31 00:00:00")


BALANCE_QUEUE = sql("fx_code", body=""", d AS (SELECT address, max(CASE WHEN has_code IS NULL THEN 1 ELSE 0 END) AS f, min(checked_at) AS since FROM fx_code WHERE checked_at <= TIMESTAMP '2024-01-31 00:00:00' GROUP BY address)
SELECT count(*) AS due, count(*) FILTER (WHERE f = 1) AS error_due, count(*) FILTER (WHERE f = 0) AS planned, CAST(max(epoch(TIMESTAMP '2024-01-31 00:00:00') - epoch(since)) AS BIGINT) AS oldest_age_seconds FROM d""")


def never_scanned(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = found._calls(spark, sf_dir).select("address", F.col("created_block").alias("first_seen"), F.lit(1).alias("canonical"))
    return queues.never_scanned(c, view(spark, sf_dir, "fx_balances").where("chain = 'c1' and token < '0x02'").select("address"), view(spark, sf_dir, "fx_policies").where("asset < '0x02'").select("address"))


NEVER = sql("fx_tx", "fx_balances", "fx_policies", body=" SELECT to_addr AS address, min(block_number) AS first_seen FROM fx_tx t WHERE to_addr IS NOT NULL AND NOT EXISTS (SELECT 1 FROM fx_balances b WHERE b.chain = 'c1' AND b.token < '0x02' AND b.address = t.to_addr) AND NOT EXISTS (SELECT 1 FROM fx_policies p WHERE p.asset < '0x02' AND p.address = t.to_addr) GROUP BY 1")


def seed_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks of valuable contracts that have none; half of the contracts have a known creation, some only calls."""
    contracts, (old, _) = view(spark, sf_dir, "fx_log_contracts"), scans.log_tasks(spark, sf_dir)
    seen = contracts.where("address < '0x9'").select("chain", "address", F.when(F.col("address") > "0x2", F.length("address") * 7).cast("bigint").alias("observed_block"))
    return queues.seed_tasks(contracts, seen, view(spark, sf_dir, "fx_log_chains"), old)


SEED = sql(*LOG_VIEWS, "fx_log_chains", body=""", s AS (SELECT c.chain, c.address, c.created_block, greatest(h.start_block, coalesce(c.created_block, CASE WHEN c.address < '0x9' AND c.address > '0x2' THEN 294 END, h.last_indexed)) AS f, h.start_block IS NOT NULL AND coalesce(c.created_block, CASE WHEN c.address < '0x9' AND c.address > '0x2' THEN 294 END, h.last_indexed) IS NOT NULL AS ok
  FROM fx_log_contracts c JOIN fx_log_chains h ON h.chain = c.chain WHERE c.canonical = 1 AND c.last_total_usd >= 150000 AND NOT EXISTS (SELECT 1 FROM fx_log_tasks t WHERE t.chain = c.chain AND t.address = c.address))
SELECT chain, address, f AS first_block, f AS next_block, created_block IS NULL AS history_limited, 50 AS priority FROM s WHERE ok""")


def task_priorities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queues.task_priorities(scans.log_tasks(spark, sf_dir)[0], view(spark, sf_dir, "fx_log_contracts")).select("chain", "address", "priority")


PRIORITIES = sql(*LOG_VIEWS, body=" SELECT t.chain, t.address, CASE WHEN NOT recent_complete THEN 100 WHEN coalesce((SELECT max(last_total_usd) FROM fx_log_contracts c WHERE c.address = t.address), 0) >= 150000 THEN 50 ELSE 10 END AS priority FROM fx_log_tasks t")


def discoveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First calls of each address, some of them known as deployments."""
    return found.first_calls(spark, sf_dir).select("chain", "address", F.when(F.col("address") < "0x9", "direct_deploy").otherwise("active_call").alias("source"), "observed_block")


def history_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.history_start(discoveries(spark, sf_dir))


FOUND = ", f AS (SELECT chain, to_addr AS address, min(block_number) AS b FROM fx_tx WHERE to_addr IS NOT NULL GROUP BY 1, 2)"
HISTORY_START = sql("fx_tx", body=FOUND + " SELECT chain, address, b AS start_block, address >= '0x9' AS history_limited FROM f")


def merge_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Old tasks that began later or earlier than what is known now."""
    starts = history.history_start(discoveries(spark, sf_dir))
    old = starts.where("chain <> 'c3'").select("chain", "address", (F.col("start_block") + F.when(F.col("start_block") % 2 == 0, 5).otherwise(-1)).alias("start_block"), F.lit(900).cast("bigint").alias("next_block"), F.lit(True).alias("history_limited"), F.lit(True).alias("completed"))
    return history.merge_history(old, starts)


MERGE_HISTORY = sql("fx_tx", body=FOUND + """ SELECT chain, address, CASE WHEN chain = 'c3' OR b % 2 = 0 THEN b ELSE b - 1 END AS start_block, CASE WHEN chain = 'c3' OR b % 2 = 0 THEN b ELSE 900 END AS next_block,
  address >= '0x9' AS history_limited, chain <> 'c3' AND b % 2 <> 0 AS completed FROM f""")


def log_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the scanned ranges of each chain's blocks prove for the contracts first called there.

    Blocks with transactions to a contract's own kind (by its address) were scanned, in ranges of 8.
    """
    starts = history.history_start(discoveries(spark, sf_dir)).withColumn("kind", F.substring("address", 3, 1))
    tx = view(spark, sf_dir, "fx_tx").select("chain", F.floor(F.col("block_number") / 8).alias("k"), F.substring("tx_hash", 1, 1).alias("kind")).distinct()
    ranges = tx.select("chain", "kind", (F.col("k") * 8).alias("from_block"), (F.col("k") * 8 + 7).alias("to_block"))
    heads = view(spark, sf_dir, "fx_tx").groupBy("chain").agg((F.max("block_number") / 4).cast("bigint").alias("head"))
    read = history.covered_to(starts, ranges, ("chain", "kind")).drop("kind").withColumn("recent_from", F.when(F.col("address") < "0xb", 0))
    return history.promoted(read, heads, 40).select("chain", "address", "next_block", "coverage")


LOG_COVERAGE = sql("fx_tx", body=FOUND + """,
k AS (SELECT DISTINCT chain, CAST(floor(block_number / 8) AS BIGINT) AS k, substr(tx_hash, 1, 1) AS kind FROM fx_tx),
h AS (SELECT chain, CAST(floor(max(block_number) / 4) AS BIGINT) AS head FROM fx_tx GROUP BY chain),
r AS (SELECT f.chain, f.address, f.b, k.k FROM f JOIN k ON k.chain = f.chain AND k.kind = substr(f.address, 3, 1) AND k.k * 8 + 7 >= f.b),
n AS (SELECT *, k - row_number() OVER (PARTITION BY chain, address ORDER BY k) AS g, min(k) OVER (PARTITION BY chain, address) AS k0 FROM r),
e AS (SELECT chain, address, b, CASE WHEN min(k0) * 8 > b THEN b ELSE max(k) * 8 + 8 END AS nb FROM n WHERE g = k0 - 1 GROUP BY 1, 2, 3),
x AS (SELECT f.chain, f.address, f.b, coalesce(e.nb, f.b) AS nb, h.head FROM f JOIN h ON h.chain = f.chain LEFT JOIN e ON e.chain = f.chain AND e.address = f.address)
SELECT chain, address, nb AS next_block, CASE WHEN nb > head AND address < '0x9' THEN 'verified' WHEN address >= '0x9' AND (nb > head OR (address < '0xb' AND 0 <= head - 39)) THEN 'history_unknown' WHEN address < '0xb' AND 0 <= head - 39 THEN 'recent_only' ELSE 'historical_pending' END AS coverage FROM x""")


def merge_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New coverage over states of which some are verified and some unknown, with new links of some chains."""
    before = F.when(F.col("address") < "0x5", "verified").when(F.col("address") < "0x7", None).otherwise("historical_pending")
    state = view(spark, sf_dir, "fx_code").select("chain", "address", before.alias("coverage"), F.lit("2024-03-01 00:00:00").cast("timestamp").alias("next_retry_at"))
    links = found.token_links(spark, sf_dir).where("first_block % 5 = 0 and token < '0x4'")
    cover = valuation.history_coverage(view(spark, sf_dir, "fx_history")).withColumnRenamed("history", "coverage")
    out = history.merge_coverage(state, cover, links, AS_OF)
    return out.select("chain", "address", "coverage", (F.col("next_retry_at") == F.lit(AS_OF).cast("timestamp")).alias("due"))


MERGE_COVERAGE = sql("fx_code", "fx_history", "fx_logs", body=f""", links AS ({found.LINKS}),
s AS (SELECT c.chain, c.address, CASE WHEN c.address < '0x5' THEN 'verified' WHEN c.address >= '0x7' THEN 'historical_pending' END AS old, h.address IS NOT NULL AS task,
  CASE WHEN h.history_limited THEN 'history_unknown' WHEN h.history_completed_at IS NULL THEN 'historical_pending' WHEN h.overdue THEN 'recent_only' ELSE 'verified' END AS new,
  EXISTS (SELECT 1 FROM links l WHERE l.chain = c.chain AND l.contract = c.address AND l.first_block % 5 = 0 AND l.token < '0x4') AS due
FROM fx_code c LEFT JOIN fx_history h ON h.chain = c.chain AND h.address = c.address)
SELECT chain, address, due, CASE WHEN NOT task OR coalesce(old, '') = 'verified' OR (due AND new = 'verified') OR (new = 'historical_pending' AND old IS NOT NULL) THEN old ELSE new END AS coverage FROM s""")


def merge_discoveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored discoveries of which some are not canonical and some have no block, and new ones, some without a block or later."""
    rows = discoveries(spark, sf_dir)
    b = F.col("observed_block")
    old = rows.where("chain <> 'c4'").select("chain", "address", "source", F.when(b % 5 == 0, None).otherwise(b - 3).alias("observed_block"), F.when(b % 2 == 0, 0).otherwise(1).alias("canonical"))
    new = rows.where("chain <> 'c0'").withColumn("observed_block", F.when(b % 7 == 0, None).when(b % 3 == 0, b - 6).otherwise(b))
    return merge.merge_discoveries(old, new.unionByName(new.withColumn("observed_block", F.lit(None).cast("bigint"))))


MERGE_DISCOVERIES = sql("fx_tx", body=FOUND + """, m AS (SELECT chain, address, b, chain <> 'c4' AS has_old, CASE WHEN b % 5 <> 0 THEN b - 3 END AS ob, CASE WHEN b % 2 = 0 THEN 0 ELSE 1 END AS oc, chain <> 'c0' AS has_new, CASE WHEN b % 7 = 0 THEN NULL WHEN b % 3 = 0 THEN b - 6 ELSE b END AS nb FROM f),
t AS (SELECT *, NOT has_old OR (has_new AND nb IS NOT NULL AND (oc = 0 OR coalesce(ob > nb, false))) AS take FROM m)
SELECT chain, address, CASE WHEN address < '0x9' THEN 'direct_deploy' ELSE 'active_call' END AS source, CASE WHEN take THEN nb ELSE ob END AS observed_block, CAST(CASE WHEN take THEN 1 ELSE oc END AS INT) AS canonical FROM t""")


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return worth.parts(spark, sf_dir)


def partial_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts summed again after every token of some addresses was lost."""
    state = worth.valued_keys(spark, sf_dir, "token >= '0x4'")
    out = worth.plain(revalue.partial_totals(state, worth.compact(parts(spark, sf_dir))))
    return out.select("address", "chain", *(worth.cents(c) for c in ("native_usd", "tokens_usd", "total_usd", "excluded_usd")), "status")


PARTIAL_TOTALS = sql(*worth.VIEWS, body=worth.VALUED + """,
t AS (SELECT address, chain, coalesce(sum(CASE WHEN raw_amount IS NOT NULL AND valuation = 'included' THEN usd_value END), 0.0) AS tok, coalesce(sum(CASE WHEN raw_amount IS NOT NULL AND valuation <> 'included' THEN usd_value END), 0.0) AS exc,
  max(CASE WHEN raw_amount IS NULL THEN 1 ELSE 0 END) AS f, max(CASE WHEN raw_amount IS NOT NULL AND valuation IN ('quarantine', 'anomalous_balance') THEN 1 ELSE 0 END) AS a, max(CASE WHEN raw_amount IS NOT NULL AND usd_value IS NULL THEN 1 ELSE 0 END) AS u
  FROM valued_tokens WHERE token >= '0x4' GROUP BY 1, 2)
SELECT p.address, p.chain, round(p.native_usd, 2) AS native_usd, round(coalesce(tok, 0.0), 2) AS tokens_usd, round(p.native_usd + coalesce(tok, 0.0), 2) AS total_usd, round(coalesce(exc, 0.0), 2) AS excluded_usd,
  CASE WHEN f = 1 THEN 'partial' WHEN a = 1 THEN 'anomalous_balance' WHEN u = 1 THEN 'price_missing' ELSE 'complete' END AS status FROM parts p LEFT JOIN t ON t.address = p.address AND t.chain = p.chain""")


def revalue_native(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = parts(spark, sf_dir).select("address", "chain", F.lit(1000.0).alias("native_seen_usd"), "tokens_usd")
    return revalue.revalue_native(rows, view(spark, sf_dir, "fx_policies")).select("address", "chain", worth.cents("native_usd"), worth.cents("total_usd"))


REVALUE_NATIVE = sql(*worth.VIEWS, body=worth.VALUED + """, r AS (SELECT p.address, p.chain, p.total_usd - p.native_usd AS tok, CASE WHEN q.policy = 'exclude_from_total' THEN 0.0 ELSE 1000.0 END AS nat FROM parts p LEFT JOIN fx_policies q ON q.chain = p.chain AND q.address = p.address AND q.asset = 'native')
SELECT address, chain, CAST(nat AS DOUBLE) AS native_usd, round(nat + tok, 2) AS total_usd FROM r""")


def revalue_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored values judged again by a lower bound; the register has them with their first time."""
    def state(only: str) -> DataFrame:
        rows = worth.valued_keys(spark, sf_dir, f"raw_amount is not null and {only}").drop("policy")
        return rows.withColumn("valuation", F.when(S.unpacked(F.col("token")) < "0x2", "stale").otherwise(F.lit("included")))

    known = state("chain = 'c1' and token > '0xe'").select("chain", "address", "token", F.lit(1.0).alias("usd_value"), F.lit("2024-01-01 00:00:00").cast("timestamp").alias("detected_at"))
    new, register = revalue.revalue_outliers(state("true"), worth.keyed(spark, sf_dir, "fx_policies"), 40_000.0, known, AS_OF)
    r = register.select("chain", "address", "token", F.unix_seconds("detected_at").alias("detected_at"))
    return worth.plain(new.select("chain", "address", "token", "valuation").join(r, ["chain", "address", "token"], "left"))


REVALUE_OUTLIERS = sql(*worth.VIEWS, body=worth.VALUED + f""", s AS (SELECT chain, address, token, CASE WHEN token < '0x2' THEN 'stale' WHEN policy IN ('exclude_from_total', 'quarantine') THEN policy
  WHEN usd_value >= 40000 AND coalesce(policy, '') <> 'include_verified' THEN 'anomalous_balance' ELSE 'included' END AS valuation FROM valued_tokens WHERE raw_amount IS NOT NULL)
SELECT *, CAST(CASE WHEN chain = 'c1' AND token > '0xe' THEN epoch(TIMESTAMP '2024-01-01 00:00:00') WHEN valuation = 'anomalous_balance' THEN epoch(TIMESTAMP '{AS_OF}') END AS BIGINT) AS detected_at FROM s""")


def single_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code and native balances read again over chain states."""
    code = view(spark, sf_dir, "fx_code")
    state = code.join(parts(spark, sf_dir).select("chain", "address", "native_usd", "tokens_usd", "total_usd"), ["chain", "address"], "left").select("chain", "address", "has_code", "native_usd", "tokens_usd", "total_usd")
    state = revalue.merge_code(state, code.select("chain", "address", (1 - F.col("has_code")).alias("has_code")))
    prices = valuation.prices_as_of(view(spark, sf_dir, "fx_native_prices"), AS_OF, keys=worth.KEYS)
    out = revalue.merge_native(state, view(spark, sf_dir, "fx_native").where("chain <> 'c0'"), prices, view(spark, sf_dir, "fx_policies"), worth.ANOMALY_USD)
    return out.select("chain", "address", "has_code", worth.cents("native_usd"), worth.cents("total_usd"))


SINGLE_FACTS = sql(*worth.VIEWS, body=worth.VALUED + f""",
c AS (SELECT c.chain, c.address, c.has_code, p.native_usd, p.total_usd - p.native_usd AS tok, coalesce(p.total_usd, 0.0) > 0 AS rich FROM fx_code c LEFT JOIN parts p ON p.chain = c.chain AND p.address = c.address),
n AS (SELECT n.chain, n.address, CASE WHEN CAST(n.raw_amount AS DOUBLE) = 0 THEN 0.0 WHEN q.policy IN ('exclude_from_total', 'quarantine') OR (coalesce(q.policy, '') <> 'include_verified' AND u.usd_value >= {worth.ANOMALY_USD}) THEN 0.0 ELSE u.usd_value END AS usd
  FROM fx_native n LEFT JOIN native_usd u ON u.chain = n.chain AND u.address = n.address LEFT JOIN fx_policies q ON q.chain = n.chain AND q.address = n.address AND q.asset = 'native' WHERE n.raw_amount IS NOT NULL AND n.chain <> 'c0')
SELECT c.chain, c.address, CAST(CASE WHEN c.has_code IS NULL THEN NULL WHEN c.has_code = 1 AND c.rich THEN 1 ELSE 1 - c.has_code END AS INT) AS has_code,
  round(coalesce(n.usd, c.native_usd), 2) AS native_usd, round(coalesce(n.usd, c.native_usd, 0.0) + coalesce(c.tok, 0.0), 2) AS total_usd FROM c LEFT JOIN n ON n.chain = c.chain AND n.address = c.address""")


def provider_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Balances as a provider's answer, some malformed: the tokens it names, with links from block 0 counted, and decimals read later."""
    rows = view(spark, sf_dir, "fx_balances").select("chain", F.upper(F.substring("address", 3, 40)).alias("a"), "token").select("chain", F.concat(F.lit("0x"), "a").alias("address"), F.when(F.col("token") < "0xf", F.col("token")).otherwise("0xbad").alias("token"), F.lit("T").alias("symbol"))
    tokens, links = revalue.provider_tokens(rows)
    tokens = revalue.merge_decimals(tokens, view(spark, sf_dir, "fx_tokens").select("chain", "token", F.when(F.col("token") < "0x7", F.lit(99)).otherwise(F.col("decimals")).alias("decimals")))
    n = links.groupBy("chain", "token").agg(F.count("*").alias("links"), F.max("last_block").alias("last_block"))
    return tokens.join(n, ["chain", "token"]).select("chain", "token", "decimals", "source", "links", "last_block")


PROVIDER = sql("fx_balances", "fx_tokens", body=""" SELECT b.chain, b.token, CASE WHEN b.token >= '0x7' THEN max(t.decimals) END AS decimals, 'provider' AS source, count(DISTINCT b.address) AS links, CAST(0 AS BIGINT) AS last_block
FROM fx_balances b LEFT JOIN fx_tokens t ON t.chain = b.chain AND t.token = b.token WHERE b.token < '0xf' GROUP BY 1, 2""")


def scans_appended(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contracts with the newest of the scans of the last days, and whether an estimate is older."""
    rows = view(spark, sf_dir, "fx_scans")
    own = rows.select("address").distinct().select("address", F.lit("old").alias("last_status"), F.lit(1.0).cast("double").alias("last_total_usd"), F.lit(None).cast("timestamp").alias("last_checked_at"))
    out = revalue.append_scans(own, rows.where(F.col("scanned_at") >= F.lit("2024-01-28").cast("timestamp")))
    first = rows.select("address", F.col("id").alias("scan_id"), F.col("scanned_at").alias("estimated_at"))
    estimates = revalue.merge_estimates(first.where("scan_id % 3 = 0"), first.where("scan_id % 3 = 1"))
    older = queues.estimates_with_scans(estimates, rows).select("address", "scan_id", "older_scan")
    return out.join(older, "address", "left").select("address", "last_status", "last_total_usd", "scan_id", "older_scan")


SCANS_APPENDED = sql("fx_scans", body=""", n AS (SELECT * FROM fx_scans WHERE scanned_at >= TIMESTAMP '2024-01-28 00:00:00' QUALIFY row_number() OVER (PARTITION BY address ORDER BY id DESC) = 1),
e AS (SELECT address, id AS scan_id FROM fx_scans WHERE id % 3 IN (0, 1) QUALIFY row_number() OVER (PARTITION BY address ORDER BY scanned_at DESC, id DESC) = 1), l AS (SELECT address, max(id) AS id FROM fx_scans GROUP BY address)
SELECT a.address, coalesce(n.status, 'old') AS last_status, coalesce(n.total_usd, 1.0) AS last_total_usd, e.scan_id, CASE WHEN e.scan_id IS NOT NULL THEN e.scan_id <> a.id END AS older_scan FROM l a LEFT JOIN n ON n.address = a.address LEFT JOIN e ON e.address = a.address""")


def latest_nonzero(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "fx_scans")
    return queues.latest_nonzero(rows.select("address").distinct().where("address % 4 <> 0"), rows).select("address", "id", "total_usd")


LATEST_NONZERO = sql("fx_scans", body=", l AS (SELECT * FROM fx_scans QUALIFY row_number() OVER (PARTITION BY address ORDER BY id DESC) = 1) SELECT address, id, total_usd FROM l WHERE total_usd > 0 AND address % 4 <> 0")


def streaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which addresses' failed tokens are not all put off."""
    b = view(spark, sf_dir, "fx_balances")
    rows = b.groupBy("address", "chain").agg(F.collect_set(F.when(F.col("raw_amount").isNull(), F.col("token"))).alias("failed_tokens"), F.collect_set(F.when(F.col("token") < "0x8", F.col("token"))).alias("deferred_tokens"))
    return queues.streak_grows(rows).select("address", "chain", "grows")


STREAKS = sql("fx_balances", body=" SELECT address, chain, coalesce(max(CASE WHEN raw_amount IS NULL AND token >= '0x8' THEN 1 ELSE 0 END), 0) = 1 AS grows FROM fx_balances GROUP BY 1, 2")


def projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    k = F.col("s_suppkey")
    return t.select(
        F.concat(F.lit("p"), k.cast("string")).alias("project_key"), F.col("s_acctbal").cast("double").alias("indexed_tvl"), F.when(k % 7 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("k"), (k % 50).cast("string")))).alias("packages"),
        F.when(k % 5 == 0, "incomplete").otherwise("below").alias("status"), F.lit("included").alias("valuation"), F.lit(True).alias("complete"), F.when(k % 3 == 0, F.lit("2024-01-31 23:00:00")).otherwise(F.lit(AS_OF)).cast("timestamp").alias("seen_at"),
    )


def project_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A snapshot that lacks every fourth project, one that is empty, and the outlier rule on top."""
    stored = projects(spark, sf_dir)
    snapshot = stored.where("cast(substr(project_key, 2) as int) % 4 <> 0").withColumn("indexed_tvl", F.col("indexed_tvl") + 1)
    out = sui.sync_projects(sui.sync_projects(stored, snapshot, AS_OF), snapshot.limit(0), AS_OF)
    policies = stored.where("cast(substr(project_key, 2) as int) % 3 = 0").select("project_key", F.lit("include_verified").alias("policy"))
    out = sui.quarantine_projects(out, policies, 5000.0)
    return out.select("project_key", F.round("indexed_tvl", 2).alias("indexed_tvl"), "status", "valuation", "complete")


PROJECT_SYNC = """WITH t AS (SELECT s_suppkey AS k, s_acctbal + CASE WHEN s_suppkey % 4 <> 0 THEN 1 ELSE 0 END AS v FROM supplier), o AS (SELECT *, v >= 5000 AND k % 3 <> 0 AS bad FROM t)
SELECT concat('p', CAST(k AS STRING)) AS project_key, round(v, 2) AS indexed_tvl, CASE WHEN bad OR k % 5 = 0 THEN 'incomplete' ELSE 'below' END AS status, CASE WHEN bad THEN 'anomalous_balance' ELSE 'included' END AS valuation, k % 4 <> 0 AS complete FROM o"""


def package_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packages by project after a snapshot of some projects moved theirs, with their last scan."""
    stored = projects(spark, sf_dir)
    old = stored.select(F.explode("packages").alias("package_id"), "project_key")
    snapshot = stored.where("status = 'incomplete'").withColumn("packages", F.array(F.lit("moved")))
    last = view(spark, sf_dir, "fx_scans").select(F.concat(F.lit("k"), (F.col("id") % 60).cast("string")).alias("package_id"), "scanned_at", "total_usd", "status")
    return sui.package_report(sui.package_projects(old, snapshot), last).select("package_id", "project_key", "total_usd", "status")


PACKAGE_MAPPING = sql("fx_scans", body=""", m AS (SELECT concat('k', CAST(s_suppkey % 50 AS STRING)) AS package_id, concat('p', CAST(s_suppkey AS STRING)) AS project_key FROM supplier WHERE s_suppkey % 5 <> 0 AND s_suppkey % 7 <> 0
  UNION ALL SELECT 'moved', concat('p', CAST(s_suppkey AS STRING)) FROM supplier WHERE s_suppkey % 5 = 0),
l AS (SELECT concat('k', CAST(id % 60 AS STRING)) AS package_id, total_usd, status FROM fx_scans QUALIFY row_number() OVER (PARTITION BY id % 60 ORDER BY scanned_at DESC) = 1)
SELECT m.package_id, m.project_key, l.total_usd, l.status FROM m LEFT JOIN l ON l.package_id = m.package_id""")


def project_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = projects(spark, sf_dir).withColumn("first_seen", F.col("seen_at"))
    out = sui.status_summary(rows, AS_OF, "2024-01-31 23:30:00", 5000.0)
    return out.select("now", "projects", "new", F.round("indexed_tvl", 2).alias("indexed_tvl"))


PROJECT_STATUS = """WITH t AS (SELECT s_acctbal AS v, s_suppkey % 3 <> 0 AS fresh, CASE WHEN s_suppkey % 5 = 0 OR s_suppkey % 7 = 0 OR s_suppkey % 3 = 0 THEN 'incomplete' WHEN s_acctbal >= 5000 THEN 'qualifying' ELSE 'below' END AS now FROM supplier)
SELECT now, count(*) AS projects, count(*) FILTER (WHERE fresh) AS new, round(sum(v), 2) AS indexed_tvl FROM t GROUP BY now"""


def pool_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/part.parquet").select((F.col("p_partkey") % 2).alias("object_exists"), F.when(F.col("p_partkey") % 3 == 0, "x").alias("project_key"), F.col("p_retailprice").alias("liquidity_usd"))
    return sui.pool_summary(p).withColumn("liquidity_usd", F.round("liquidity_usd", 2))


POOL_SUMMARY = "SELECT count(*) AS pools, count(*) FILTER (WHERE p_partkey % 2 = 1) AS verified, count(*) FILTER (WHERE p_partkey % 3 = 0) AS with_project, round(sum(p_retailprice), 2) AS liquidity_usd FROM part"


def gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found.gap_summary(spark, sf_dir)


def fleet_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.fleet_totals(gaps(spark, sf_dir), log_queue(spark, sf_dir))


FLEET = "CAST((SELECT coalesce(sum({0}), 0) FROM {1}) AS BIGINT) AS {0}"
_SUMS = ", ".join([*(FLEET.format(c, "gs") for c in ("open_gaps", "remaining_blocks", "alerts")), *(FLEET.format(c, "lq") for c in ("total", "due", "recent_due", "high_value_due", "retry_due", "history_due", "failed", "partial"))])
_WAITING = found.GAPS + QUEUE
_REPORT_VIEWS = ("fx_tx", *LOG_VIEWS, "fx_code", "fx_scans")
FLEET_TOTALS = sql(*_REPORT_VIEWS, body=_WAITING + " SELECT " + _SUMS)


def status_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = view(spark, sf_dir, "fx_code").where("has_code = 1")
    return reports.status_report(view(spark, sf_dir, "fx_scans"), code, gaps(spark, sf_dir), log_queue(spark, sf_dir))


#: The tables of the status report and its columns.
STATUS_TABLES = _WAITING + ", ls AS (SELECT status FROM fx_scans QUALIFY row_number() OVER (PARTITION BY address ORDER BY id DESC) = 1)"
STATUS_COLUMNS = "(SELECT count(DISTINCT address) FROM fx_code WHERE has_code = 1) AS addresses, (SELECT count(*) FROM fx_code WHERE has_code = 1) AS instances, " + ", ".join(f"(SELECT count(*) FROM ls WHERE status = '{s}') AS {s}" for s in ("qualifying", "below", "incomplete")) + ", " + _SUMS
STATUS_REPORT = sql(*_REPORT_VIEWS, body=STATUS_TABLES + " SELECT " + STATUS_COLUMNS)


def period_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = reports.period_report(view(spark, sf_dir, "fx_samples"), view(spark, sf_dir, "fx_resources"), DAY, 86400 * 5)
    return out.withColumns({c: F.round(c, 4) for c in ("cpu_percent", "load1", "ram_percent")})


PERIOD_REPORT = sql("fx_samples", "fx_resources", body=f""", s AS (SELECT * FROM fx_samples WHERE ts > TIMESTAMP '2024-01-25 00:00:00' AND ts <= TIMESTAMP '{DAY}'), r AS (SELECT * FROM fx_resources WHERE ts > TIMESTAMP '2024-01-25 00:00:00' AND ts <= TIMESTAMP '{DAY}')
SELECT chain, greatest(arg_max(cursor_block, id) - arg_min(cursor_block, id), 0) AS blocks, CASE WHEN arg_max(run_id, id) = arg_min(run_id, id) THEN greatest(arg_max(scans, id) - arg_min(scans, id), 0) END AS scans, CAST(sum(rpc_requests) AS BIGINT) AS requests, CAST(sum(rpc_errors) AS BIGINT) AS errors, arg_max(safe_head - cursor_block, ts) AS lag_blocks,
  (SELECT round(avg(cpu_percent), 4) FROM r) AS cpu_percent, (SELECT round(max(load1), 4) FROM r) AS load1, (SELECT round(avg(ram_percent), 4) FROM r) AS ram_percent FROM s GROUP BY chain""")


def network_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = view(spark, sf_dir, "fx_samples").withColumn("chain", F.concat(F.lit("c"), (F.col("id") % 5).cast("string")))
    out = reports.network_overview(samples, view(spark, sf_dir, "fx_attempts"), gaps(spark, sf_dir), log_queue(spark, sf_dir))
    return out.select("chain", "id", "open_gaps", "tasks", "due", "retry_due", "slowest_stage", F.round("slowest_ms", 4).alias("slowest_ms"))


NETWORK_OVERVIEW = sql(*_REPORT_VIEWS, "fx_samples", "fx_attempts", body=_WAITING + """,
ss AS (SELECT concat('c', CAST(id % 5 AS STRING)) AS chain, id FROM fx_samples WHERE role = 'live' QUALIFY row_number() OVER (PARTITION BY id % 5 ORDER BY ts DESC, id DESC) = 1),
sl AS (SELECT chain, workload, avg(ms) AS m FROM fx_attempts GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY chain ORDER BY avg(ms) DESC, workload DESC) = 1)
SELECT ss.chain, ss.id, gs.open_gaps, lq.total AS tasks, lq.due, lq.retry_due, sl.workload AS slowest_stage, round(sl.m, 4) AS slowest_ms FROM ss LEFT JOIN gs ON gs.chain = ss.chain LEFT JOIN lq ON lq.chain = ss.chain LEFT JOIN sl ON sl.chain = ss.chain""")


def contracts_per_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.contracts_per_source(discoveries(spark, sf_dir))


PER_SOURCE = sql("fx_tx", body=FOUND + " SELECT CASE WHEN address < '0x9' THEN 'direct_deploy' ELSE 'active_call' END AS source, count(DISTINCT address) AS addresses, count(*) AS instances FROM f GROUP BY 1")

QUERIES = {
    "work_kinds": (work_kinds, WORK_KINDS),
    "work_kinds_wide": (work_kinds_wide, WORK_WIDE),
    "earliest_due": (earliest_due, EARLIEST),
    "log_queue": (log_queue, LOG_QUEUE),
    "due_tasks": (due_tasks, DUE_TASKS),
    "error_histogram": (error_histogram, sql("fx_log_tasks", body=" SELECT chain, last_error, count(*) AS n FROM fx_log_tasks WHERE last_error IS NOT NULL GROUP BY 1, 2")),
    "lane_rates": (lane_rates, LANE_RATES),
    "balance_queue": (balance_queue, BALANCE_QUEUE),
    "never_scanned": (never_scanned, NEVER),
    "seed_tasks": (seed_tasks, SEED),
    "task_priorities": (task_priorities, PRIORITIES),
    "history_start": (history_start, HISTORY_START),
    "merge_history": (merge_history, MERGE_HISTORY),
    "log_coverage": (log_coverage, LOG_COVERAGE),
    "merge_coverage": (merge_coverage, MERGE_COVERAGE),
    "merge_discoveries": (merge_discoveries, MERGE_DISCOVERIES),
    "partial_totals": (partial_totals, PARTIAL_TOTALS),
    "revalue_native": (revalue_native, REVALUE_NATIVE),
    "revalue_outliers": (revalue_outliers, REVALUE_OUTLIERS),
    "single_facts": (single_facts, SINGLE_FACTS),
    "provider_found": (provider_found, PROVIDER),
    "scans_appended": (scans_appended, SCANS_APPENDED),
    "latest_nonzero": (latest_nonzero, LATEST_NONZERO),
    "streaks": (streaks, STREAKS),
    "project_sync": (project_sync, PROJECT_SYNC),
    "package_mapping": (package_mapping, PACKAGE_MAPPING),
    "project_status": (project_status, PROJECT_STATUS),
    "pool_summary": (pool_summary, POOL_SUMMARY),
    "fleet_totals": (fleet_totals, FLEET_TOTALS),
    "status_report": (status_report, STATUS_REPORT),
    "period_report": (period_report, PERIOD_REPORT),
    "network_overview": (network_overview, NETWORK_OVERVIEW),
    "contracts_per_source": (contracts_per_source, PER_SOURCE),
}

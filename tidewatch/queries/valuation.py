"""Liquidity of addresses and what it is made of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions import scalars as S
from tidewatch.operators import schedule, valuation
from tidewatch.plans.fixtures import AS_OF, sql, view

MIN_USD, ANOMALY_USD = 2_000_000.0, 90_000.0


KEYS = ("chain", "token")


PACKED = ("address", "token", "asset")


def compact(rows: DataFrame) -> DataFrame:
    """rows with addresses as bytes, so that joins shuffle half as much."""
    return rows.withColumns({c: S.packed(F.col(c)) for c in PACKED if c in rows.columns})


def plain(rows: DataFrame) -> DataFrame:
    """rows of compact() with texts again."""
    return rows.withColumns({c: S.unpacked(F.col(c)) for c in PACKED if c in rows.columns})


def keyed(spark: SparkSession, sf_dir: str, name: str, only: str = "true") -> DataFrame:
    return compact(view(spark, sf_dir, name).where(only))


def valued_keys(spark: SparkSession, sf_dir: str, only: str = "true") -> DataFrame:
    """Valued tokens of the balances that only asks for, compact."""
    prices = valuation.prices_as_of(keyed(spark, sf_dir, "fx_prices"), AS_OF, keys=KEYS)
    return valuation.value_tokens(keyed(spark, sf_dir, "fx_balances", only), keyed(spark, sf_dir, "fx_tokens"), prices, keyed(spark, sf_dir, "fx_policies"), ANOMALY_USD)


def valued_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain(valued_keys(spark, sf_dir))


def valued_native(spark: SparkSession, sf_dir: str) -> DataFrame:
    prices = valuation.prices_as_of(view(spark, sf_dir, "fx_native_prices"), AS_OF, keys=KEYS)
    return valuation.value_native(view(spark, sf_dir, "fx_native"), prices, view(spark, sf_dir, "fx_policies"), ANOMALY_USD)


def valued(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens and native balances together."""
    return valued_tokens(spark, sf_dir).unionByName(valued_native(spark, sf_dir), allowMissingColumns=True)


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of chains; rows are dealt by compact addresses, and the tokens' names are only asked whether they are native."""
    rows = valued_keys(spark, sf_dir).unionByName(compact(valued_native(spark, sf_dir)), allowMissingColumns=True)
    return plain(valuation.chain_parts(rows.withColumn("token", S.unpacked(F.col("token")))))


#: Valued balances and parts of chains, as SQL.
VALUED = f""",
price AS (SELECT chain, token, price FROM fx_prices WHERE price > 0 AND ts <= TIMESTAMP '{AS_OF}' AND ts >= TIMESTAMP '2024-01-31 23:58:00'),
usd AS (
  SELECT b.chain, b.address, b.token, b.raw_amount, p.policy,
    CASE t.decimals WHEN 6 THEN CAST(b.raw_amount AS DOUBLE) / 1000000.0 WHEN 7 THEN CAST(b.raw_amount AS DOUBLE) / 10000000.0 END * CAST(price.price AS DOUBLE) AS usd_value
  FROM fx_balances b LEFT JOIN fx_tokens t ON t.chain = b.chain AND t.token = b.token LEFT JOIN price ON price.chain = b.chain AND price.token = b.token
    LEFT JOIN fx_policies p ON p.chain = b.chain AND p.address = b.address AND p.asset = b.token
  WHERE b.raw_amount IS NULL OR CAST(b.raw_amount AS DOUBLE) > 0
),
valued_tokens AS (
  SELECT *, CASE WHEN policy IN ('exclude_from_total', 'quarantine') THEN policy
    WHEN usd_value >= {ANOMALY_USD} AND coalesce(policy, '') <> 'include_verified' THEN 'anomalous_balance' ELSE 'included' END AS valuation FROM usd
),
native_usd AS (
  SELECT n.chain, n.address, n.token, n.raw_amount, p.policy, CAST(n.raw_amount AS DOUBLE) / 1000000000000000000.0 * CAST(np.price AS DOUBLE) AS usd_value
  FROM fx_native n LEFT JOIN fx_native_prices np ON np.chain = n.chain LEFT JOIN fx_policies p ON p.chain = n.chain AND p.address = n.address AND p.asset = 'native'
  WHERE n.raw_amount IS NULL OR CAST(n.raw_amount AS DOUBLE) > 0
),
valued AS (
  SELECT * FROM valued_tokens UNION ALL
  SELECT *, CASE WHEN policy IN ('exclude_from_total', 'quarantine') THEN policy
    WHEN usd_value >= {ANOMALY_USD} AND coalesce(policy, '') NOT IN ('include', 'include_verified') THEN 'anomalous_balance' ELSE 'included' END AS valuation FROM native_usd
),
parts AS (
  SELECT address, chain,
    coalesce(sum(CASE WHEN raw_amount IS NOT NULL AND valuation = 'included' AND token = 'native' THEN usd_value END), 0.0) AS native_usd,
    coalesce(sum(CASE WHEN raw_amount IS NOT NULL AND valuation = 'included' THEN usd_value END), 0.0) AS total_usd,
    coalesce(sum(CASE WHEN raw_amount IS NOT NULL AND valuation <> 'included' THEN usd_value END), 0.0) AS excluded_usd,
    CASE WHEN max(CASE WHEN raw_amount IS NULL THEN 1 ELSE 0 END) = 1 THEN 'partial'
      WHEN max(CASE WHEN raw_amount IS NOT NULL AND valuation IN ('quarantine', 'anomalous_balance') THEN 1 ELSE 0 END) = 1 THEN 'anomalous_balance'
      WHEN max(CASE WHEN raw_amount IS NOT NULL AND usd_value IS NULL THEN 1 ELSE 0 END) = 1 THEN 'price_missing' ELSE 'complete' END AS status
  FROM valued GROUP BY address, chain
)"""
VIEWS = ("fx_balances", "fx_tokens", "fx_prices", "fx_policies", "fx_code", "fx_native", "fx_native_prices", "fx_history")


def cents(c: str) -> Column:
    return F.round(F.col(c), 2).alias(c)


def address_liquidity(spark: SparkSession, sf_dir: str) -> DataFrame:
    history = valuation.history_coverage(view(spark, sf_dir, "fx_history"))
    out = valuation.classify_addresses(parts(spark, sf_dir), view(spark, sf_dir, "fx_code"), history, MIN_USD)
    return out.select("address", cents("total_usd"), cents("excluded_usd"), "coverage", "parts", "status")


ADDRESS_LIQUIDITY = sql(*VIEWS, body=VALUED + f"""
SELECT p.address, round(sum(p.total_usd), 2) AS total_usd, round(sum(p.excluded_usd), 2) AS excluded_usd,
  count(c.has_code) AS coverage, count(*) AS parts,
  CASE WHEN sum(p.total_usd) >= {MIN_USD} THEN 'qualifying' WHEN min(CASE WHEN p.status = 'complete' AND (h.address IS NULL OR (NOT h.history_limited AND h.history_completed_at IS NOT NULL AND NOT h.overdue)) THEN 1 ELSE 0 END) = 1 THEN 'below' ELSE 'incomplete' END AS status
FROM parts p LEFT JOIN fx_code c ON c.chain = p.chain AND c.address = p.address LEFT JOIN fx_history h ON h.chain = p.chain AND h.address = p.address GROUP BY p.address""")


def chain_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = parts(spark, sf_dir)
    return out.select("address", "chain", cents("native_usd"), cents("total_usd"), cents("excluded_usd"), "status")


CHAIN_PARTS = sql(*VIEWS, body=VALUED + " SELECT address, chain, round(native_usd, 2) AS native_usd, round(total_usd, 2) AS total_usd, round(excluded_usd, 2) AS excluded_usd, status FROM parts")


def chain_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = view(spark, sf_dir, "fx_code")
    known = parts(spark, sf_dir).join(code.select("chain", "address", "has_code"), ["chain", "address"], "left")
    out = valuation.address_chain_matrix(code, code, known)
    return out.select("address", "chain", "status", "note")


CHAIN_MATRIX = sql(*VIEWS, body=VALUED + """,
grid AS (SELECT a.address, c.chain FROM (SELECT DISTINCT address FROM fx_code) a CROSS JOIN (SELECT DISTINCT chain FROM fx_code) c)
SELECT g.address, g.chain, coalesce(p.status, 'rpc_error') AS status, CASE WHEN p.address IS NULL OR c.has_code IS NULL THEN 'not_checked' END AS note
FROM grid g LEFT JOIN parts p ON p.address = g.address AND p.chain = g.chain LEFT JOIN fx_code c ON c.address = g.address AND c.chain = g.chain""")


def anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values shut out now, merged into a register of those known before, which keep their first time."""
    rows = valued_keys(spark, sf_dir).unionByName(compact(valued_native(spark, sf_dir)), allowMissingColumns=True).where("raw_amount is not null").withColumn("detected_at", F.lit(AS_OF).cast("timestamp"))
    known = keyed(spark, sf_dir, "fx_balances", "token < '0x4' and raw_amount is not null").select("chain", "address", "token", F.lit(1.0).alias("usd_value"), F.lit("2024-01-01 00:00:00").cast("timestamp").alias("detected_at"))
    return plain(valuation.anomalies(rows, known)).select("chain", "address", "token", cents("usd_value"), F.unix_seconds("detected_at").alias("detected_at"))


ANOMALIES = sql(*VIEWS, body=VALUED + f""",
a AS (SELECT chain, address, token, usd_value FROM valued WHERE valuation = 'anomalous_balance' AND raw_amount IS NOT NULL),
k AS (SELECT chain, address, token FROM fx_balances WHERE token < '0x4' AND raw_amount IS NOT NULL)
SELECT coalesce(a.chain, k.chain) AS chain, coalesce(a.address, k.address) AS address, coalesce(a.token, k.token) AS token, round(coalesce(a.usd_value, 1.0), 2) AS usd_value,
  CAST(epoch(CASE WHEN k.token IS NOT NULL THEN TIMESTAMP '2024-01-01 00:00:00' ELSE TIMESTAMP '{AS_OF}' END) AS BIGINT) AS detected_at
FROM a FULL OUTER JOIN k ON k.chain = a.chain AND k.address = a.address AND k.token = a.token""")


def excluded_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays outside totals by both rules: all that is not included, or the listed statuses."""
    state = valued(spark, sf_dir).where("raw_amount is not null").withColumn("valuation", F.when(F.col("usd_value") < 1000, "stale").otherwise(F.col("valuation")))
    a = valuation.excluded_usd(state, True).withColumnRenamed("excluded_usd", "with_stale")
    b = valuation.excluded_usd(state, False).withColumnRenamed("excluded_usd", "listed")
    return a.join(b, ["address", "chain"]).select("address", "chain", cents("with_stale"), cents("listed"))


EXCLUDED_RULES = sql(*VIEWS, body=VALUED + """,
s AS (SELECT address, chain, usd_value, CASE WHEN usd_value < 1000 THEN 'stale' ELSE valuation END AS valuation FROM valued WHERE raw_amount IS NOT NULL)
SELECT address, chain, round(coalesce(sum(CASE WHEN valuation <> 'included' THEN usd_value END), 0.0), 2) AS with_stale,
  round(coalesce(sum(CASE WHEN valuation IN ('anomalous_balance', 'quarantine', 'exclude_from_total') THEN usd_value END), 0.0), 2) AS listed
FROM s GROUP BY address, chain""")


def repriced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored amounts under doubled prices of half the tokens; what has no new price keeps its value."""
    state = valued_keys(spark, sf_dir).where("raw_amount is not null").drop("policy")
    new = valuation.prices_as_of(keyed(spark, sf_dir, "fx_prices", "token < '0x8'"), AS_OF, keys=KEYS).select("chain", "token", (F.col("price") * 2).alias("price"))
    out = valuation.reprice(state, new, keyed(spark, sf_dir, "fx_policies"), ANOMALY_USD)
    out = out.groupBy("address", "chain").agg(F.round(F.coalesce(F.sum(F.when(F.col("valuation") == "included", F.col("usd_value"))), F.lit(0.0)), 2).alias("total_usd"), F.count_if(F.col("valuation") == "anomalous_balance").alias("anomalies"))
    return plain(out)


REPRICED = sql(*VIEWS, body=VALUED + f""",
r AS (SELECT *, CASE WHEN token < '0x8' AND usd_value IS NOT NULL THEN 2 * usd_value ELSE usd_value END AS new_usd FROM valued_tokens WHERE raw_amount IS NOT NULL),
v AS (SELECT *, CASE WHEN policy IN ('exclude_from_total', 'quarantine') THEN policy
  WHEN new_usd >= {ANOMALY_USD} AND coalesce(policy, '') <> 'include_verified' THEN 'anomalous_balance' ELSE 'included' END AS v2 FROM r)
SELECT address, chain, round(coalesce(sum(CASE WHEN v2 = 'included' THEN new_usd END), 0.0), 2) AS total_usd,
  count(*) FILTER (WHERE v2 = 'anomalous_balance') AS anomalies FROM v GROUP BY address, chain""")


def token_state_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Old token state with a new read of some chains: c0 read whole, others by token, failures stale."""
    state = valued_keys(spark, sf_dir).where("raw_amount is not null").select("address", "chain", "token", "raw_amount", "valuation")
    new = keyed(spark, sf_dir, "fx_balances", "token < '0x4'").select("address", "chain", "token", "raw_amount", F.lit("included").alias("valuation"))
    final = new.where("chain = 'c0'").select("address", "chain")
    out = plain(valuation.token_state_merge(state, new, final))
    return out.select("address", "chain", "token", "valuation", "raw_amount")


TOKEN_STATE_MERGE = sql(*VIEWS, body=VALUED + """,
o AS (SELECT address, chain, token, valuation, raw_amount FROM valued_tokens WHERE raw_amount IS NOT NULL),
n AS (SELECT address, chain, token, raw_amount FROM fx_balances WHERE token < '0x4'),
f AS (SELECT DISTINCT address, chain FROM n WHERE chain = 'c0'),
kept AS (
  SELECT o.address, o.chain, o.token, o.raw_amount, CASE WHEN x.token IS NOT NULL THEN 'stale' ELSE o.valuation END AS valuation
  FROM o LEFT JOIN (SELECT DISTINCT address, chain, token FROM n WHERE raw_amount IS NULL) x USING (address, chain, token)
  WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.address = o.address AND f.chain = o.chain)
    AND NOT EXISTS (SELECT 1 FROM n WHERE n.raw_amount IS NOT NULL AND n.address = o.address AND n.chain = o.chain AND n.token = o.token)
)
SELECT address, chain, token, valuation, raw_amount FROM kept UNION ALL SELECT address, chain, token, 'included', raw_amount FROM n WHERE raw_amount IS NOT NULL""")


def partial_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = view(spark, sf_dir, "fx_balances").where("raw_amount is not null and length(raw_amount) > 7").withColumn("failures", F.lit(1))
    new = view(spark, sf_dir, "fx_balances").where("token < '0x8'").select("address", "chain", "token", "raw_amount")
    out = valuation.partial_refresh(old, new)
    return out.groupBy("chain", "failures").agg(F.count("*").alias("n"))


PARTIAL_REFRESH = sql("fx_balances", body="""
, o AS (SELECT address, chain, token, raw_amount FROM fx_balances WHERE raw_amount IS NOT NULL AND length(raw_amount) > 7),
n AS (SELECT address, chain, token, raw_amount AS new_raw, 1 AS seen FROM fx_balances WHERE token < '0x8'),
j AS (SELECT coalesce(o.chain, n.chain) AS chain, o.token AS old_token, raw_amount, new_raw, seen FROM o FULL OUTER JOIN n ON o.address = n.address AND o.chain = n.chain AND o.token = n.token)
SELECT chain, CAST(CASE WHEN seen = 1 AND new_raw IS NULL THEN CASE WHEN old_token IS NULL THEN 1 ELSE 2 END WHEN seen = 1 THEN 0 ELSE 1 END AS INT) AS failures, count(*) AS n
FROM j WHERE (raw_amount IS NOT NULL OR new_raw IS NOT NULL) AND NOT (seen IS NOT NULL AND new_raw IS NOT NULL AND CAST(new_raw AS DOUBLE) = 0)
GROUP BY 1, 2""")


def _scan_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = view(spark, sf_dir, "fx_scans")
    return s.select(F.col("id").alias("scan_id"), F.when(F.col("coverage") > 15, "rpc_error").when(F.col("coverage") > 8, "absent").otherwise("complete").alias("status")).where("scan_id % 13 <> 0")


def reclassify(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = valuation.reclassify(schedule.latest_by_id(view(spark, sf_dir, "fx_scans")), _scan_parts(spark, sf_dir), 400_000.0)
    return out.select("id", "address", "total_usd", "old_status", "status")


RECLASSIFY = sql("fx_scans", body="""
, l AS (SELECT * FROM fx_scans QUALIFY row_number() OVER (PARTITION BY address ORDER BY id DESC) = 1)
SELECT id, address, total_usd, status AS old_status,
  CASE WHEN total_usd >= 400000 THEN 'qualifying' WHEN id % 13 <> 0 AND coverage <= 15 THEN 'below' ELSE 'incomplete' END AS status FROM l""")


def estimate_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Estimates of suppliers' addresses: their code on each chain and a provider's number."""
    code = view(spark, sf_dir, "fx_code")
    worth = view(spark, sf_dir, "fx_balances").groupBy("address", "chain").agg(F.count("raw_amount").alias("n"))
    parts = code.join(worth, ["address", "chain"], "left").select("address", "chain", "has_code", (F.col("n") * 100).cast("string").alias("provider_usd"), F.lit(False).alias("price_missing"))
    out = valuation.estimate(parts.where("has_code is not null"), 30_000.0)
    return out.select("address", cents("estimated_usd"), cents("lower_usd"), cents("upper_usd"), "coverage", "total_networks", "status")


ESTIMATE_BAND = sql("fx_code", "fx_balances", body="""
, w AS (SELECT address, chain, count(raw_amount) AS n FROM fx_balances GROUP BY address, chain),
p AS (SELECT c.address, CASE WHEN c.has_code = 0 THEN 0.0 ELSE CAST(100 * w.n AS DOUBLE) END AS amount FROM fx_code c LEFT JOIN w ON w.address = c.address AND w.chain = c.chain WHERE c.has_code IS NOT NULL),
g AS (SELECT address, sum(amount) AS v, count(amount) AS coverage, count(*) AS total_networks, max(CASE WHEN amount IS NULL THEN 1 ELSE 0 END) AS missing FROM p GROUP BY address)
SELECT address, round(v, 2) AS estimated_usd, round(v / (1 + CAST(0.1 AS DOUBLE)), 2) AS lower_usd, round(CASE WHEN missing = 0 THEN v / (1 - CAST(0.1 AS DOUBLE)) END, 2) AS upper_usd, coverage, total_networks,
  CASE WHEN missing = 1 THEN 'incomplete' WHEN v >= 33000 THEN 'estimated_above' WHEN v >= 27000 THEN 'near_threshold' ELSE 'estimated_below' END AS status FROM g""")

QUERIES = {
    "address_liquidity": (address_liquidity, ADDRESS_LIQUIDITY),
    "chain_parts": (chain_parts, CHAIN_PARTS),
    "chain_matrix": (chain_matrix, CHAIN_MATRIX),
    "anomalies": (anomalies, ANOMALIES),
    "excluded_rules": (excluded_rules, EXCLUDED_RULES),
    "repriced": (repriced, REPRICED),
    "token_state_merge": (token_state_merge, TOKEN_STATE_MERGE),
    "partial_refresh": (partial_refresh, PARTIAL_REFRESH),
    "reclassify": (reclassify, RECLASSIFY),
    "estimate_band": (estimate_band, ESTIMATE_BAND),
}

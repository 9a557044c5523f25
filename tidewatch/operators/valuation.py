"""Valuation: balances with prices as of a time and policies, to parts of chains and classes of addresses."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions import scalars as S


def prices_as_of(prices: DataFrame, as_of: str, ttl_seconds: int = 120, keys: tuple[str, ...] = ("token",)) -> DataFrame:
    """The last usable price of each key not later than as_of and at most ttl_seconds old.

    Null, non-finite and non-positive prices are no observations.
    """
    now = F.lit(as_of).cast("timestamp")
    good = prices.where(S.finite(F.col("price").cast("double")) & (F.col("price") > 0) & (F.col("ts").cast("timestamp") <= now))
    last = good.groupBy(*keys).agg(F.max(F.struct(F.col("ts").cast("timestamp").alias("ts"), F.col("price").cast("double").alias("price"))).alias("p"))
    return last.where(F.unix_seconds(now) - F.unix_seconds("p.ts") <= ttl_seconds).select(*keys, "p.price")


def price_history(observations: DataFrame, prices: DataFrame, ttl_seconds: int = 120, keys: tuple[str, ...] = ("token",), chunk_seconds: int = 3600) -> DataFrame:
    """observations (keys, ts) each with the last usable price at its own time, null where that is older than ttl_seconds.

    Keys are not null.  Time is cut into chunks no shorter than the time to live, and each chunk also
    gets the last price of the chunk before: what is older can't be fresh any more.  So a token with a
    third of all observations is as many groups as there are chunks.
    """
    long = max(chunk_seconds, ttl_seconds)
    chunk = F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / long)
    good = prices.where(S.finite(F.col("price").cast("double")) & (F.col("price") > 0)).select(*keys, F.col("ts").cast("timestamp").alias("ts"), chunk.alias("__c"), F.struct(F.col("ts").cast("timestamp").alias("ts"), F.col("price").cast("double").alias("price")).alias("__p"))
    last = good.groupBy(*keys, "__c").agg(F.max("__p").alias("__p")).select(*keys, F.col("__p.ts").alias("ts"), (F.col("__c") + 1).alias("__c"), "__p")
    known = good.unionByName(last).withColumn("__obs", F.lit(0))
    asked = observations.withColumns({"__c": chunk, "__obs": F.lit(1), "__p": F.lit(None).cast("struct<ts:timestamp,price:double>")})
    w = Window.partitionBy(*keys, "__c").orderBy(F.col("ts").cast("timestamp"), F.col("__obs")).rowsBetween(Window.unboundedPreceding, 0)
    both = asked.unionByName(known, allowMissingColumns=True).withColumn("__last", F.last("__p", ignorenulls=True).over(w))
    fresh = F.unix_seconds(F.col("ts").cast("timestamp")) - F.unix_seconds("__last.ts") <= ttl_seconds
    return both.where("__obs = 1").withColumn("price", F.when(fresh, F.col("__last.price"))).drop("__obs", "__p", "__last", "__c")


def value_tokens(balances: DataFrame, tokens: DataFrame, prices: DataFrame, policies: DataFrame, anomaly_usd: float) -> DataFrame:
    """A row a positive or failed token balance with amount, price, usd_value, valuation and policy.

    A null raw_amount is a failed read: its value is unknown, never 0.  An address of a token means
    another token on each chain, so tokens and prices have one row a chain and token, and policies one
    a chain, address and asset.
    """
    rows = balances.where(F.col("raw_amount").isNull() | S.raw_positive(F.col("raw_amount")))
    rows = rows.join(tokens.select("chain", "token", "decimals"), ["chain", "token"], "left").join(prices.select("chain", "token", "price"), ["chain", "token"], "left").join(by_asset(policies), ["chain", "address", "token"], "left")
    usd = S.scale_amount(F.col("raw_amount"), F.col("decimals")) * F.col("price")
    return (
        rows.withColumn("amount", S.scale_amount(F.col("raw_amount"), F.col("decimals")))
        .withColumn("usd_raw", usd)
        .withColumn("valuation", S.token_valuation(F.col("usd_raw"), F.col("policy"), anomaly_usd))
        .withColumn("usd_value", F.when(S.finite(F.col("usd_raw")), F.col("usd_raw")))
        .drop("usd_raw")
    )


def by_asset(policies: DataFrame) -> DataFrame:
    """Policies under the name of the asset that they are for: a token's address, or native."""
    return policies.select("chain", "address", F.col("asset").alias("token"), "policy")


def value_native(balances: DataFrame, prices: DataFrame, policies: DataFrame, anomaly_usd: float, retry: bool = False) -> DataFrame:
    """Native balances (chain, address, token = native, raw_amount in units of 10**-18), valued like tokens but by their own policy rule."""
    rows = balances.where(F.col("raw_amount").isNull() | S.raw_positive(F.col("raw_amount")))
    rows = rows.join(prices.select("chain", "token", "price"), ["chain", "token"], "left").join(by_asset(policies), ["chain", "address", "token"], "left")
    amount = S.scale_amount(F.col("raw_amount"), F.lit(18))
    rows = rows.withColumn("amount", amount).withColumn("usd_raw", amount * F.col("price"))
    return rows.withColumn("valuation", S.native_valuation(F.col("usd_raw"), F.col("policy"), anomaly_usd, retry)).withColumn("usd_value", F.when(S.finite(F.col("usd_raw")), F.col("usd_raw"))).drop("usd_raw")


def chain_parts(valued: DataFrame) -> DataFrame:
    """(address, chain, native_usd, tokens_usd, total_usd, excluded_usd, status) from valued balances, native ones among them."""
    read = F.col("raw_amount").isNotNull()
    included = F.col("valuation") == "included"
    counted = lambda c: F.coalesce(F.sum(F.when(read & included & c, F.col("usd_value"))), F.lit(0.0))
    native = F.col("token") == "native"
    out = valued.groupBy("address", "chain").agg(
        counted(native).alias("native_usd"),
        counted(~native).alias("tokens_usd"),
        F.coalesce(F.sum(F.when(read & included, F.col("usd_value"))), F.lit(0.0)).alias("total_usd"),
        F.coalesce(F.sum(F.when(read & ~included, F.col("usd_value"))), F.lit(0.0)).alias("excluded_usd"),
        F.max((~read).cast("int")).alias("failed"),
        F.max((read & F.col("valuation").isin("quarantine", "anomalous_balance")).cast("int")).alias("anomaly"),
        F.max((read & F.col("usd_value").isNull()).cast("int")).alias("unpriced"),
    )
    return out.withColumn("status", S.chain_status(F.col("failed") == 1, F.col("anomaly") == 1, F.col("unpriced") == 1)).drop("failed", "anomaly", "unpriced")


def history_coverage(tasks: DataFrame) -> DataFrame:
    """(chain, address, history): how much of an address's token history on a chain was read; without a task all of it counts as read."""
    return tasks.select("chain", "address", S.coverage_state(F.col("history_completed_at"), F.col("history_limited"), F.col("overdue")).alias("history"))


def classify_addresses(parts: DataFrame, code: DataFrame, history: DataFrame, min_usd: float) -> DataFrame:
    """One row an address: total, excluded, coverage (parts whose code is known), parts, status.

    An address is below only if each part is complete and its token history (chain, address, history)
    verified: what was never read proves nothing.
    """
    known = parts.join(code.select("chain", "address", "has_code"), ["chain", "address"], "left").join(history, ["chain", "address"], "left")
    out = known.groupBy("address").agg(
        F.sum("total_usd").alias("total_usd"),
        F.sum("excluded_usd").alias("excluded_usd"),
        F.count("has_code").alias("coverage"),
        F.count("*").alias("parts"),
        F.min((F.col("status").isin("complete", "absent") & (F.coalesce("history", F.lit("verified")) == "verified")).cast("int")).alias("verified"),
    )
    return out.withColumn("status", S.address_status(F.col("total_usd"), F.col("parts"), F.col("verified") == 1, min_usd)).drop("verified")


def address_chain_matrix(addresses: DataFrame, chains: DataFrame, state: DataFrame) -> DataFrame:
    """Every address on every chain with its state; where there is none rpc_error, not checked."""
    grid = addresses.select("address").distinct().crossJoin(F.broadcast(chains.select("chain").distinct()))  # chains: a small dimension
    return grid.join(state, ["address", "chain"], "left").withColumn("status", F.coalesce("status", F.lit("rpc_error"))).withColumn("note", F.when(F.col("has_code").isNull(), "not_checked"))


def reclassify(latest: DataFrame, parts: DataFrame, min_usd: float) -> DataFrame:
    """Latest scans (id, address, total_usd, status) under a new threshold; coverage state plays no part here."""
    p = parts.groupBy("scan_id").agg(F.count("*").alias("n"), F.sum(F.when(~F.col("status").isin("complete", "absent"), 1).otherwise(0)).alias("open"))
    rows = latest.join(p, latest["id"] == p["scan_id"], "left")
    status = F.when(F.coalesce("total_usd", F.lit(0.0)) >= min_usd, "qualifying").when((F.coalesce("n", F.lit(0)) > 0) & (F.col("open") == 0), "below").otherwise("incomplete")
    return rows.select("id", "address", "total_usd", F.col("status").alias("old_status"), status.alias("status"))


def reprice(state: DataFrame, prices: DataFrame, policies: DataFrame, anomaly_usd: float) -> DataFrame:
    """Stored amounts under new prices; rows without a new price keep their value."""
    # policies first: rows that were valued are dealt by their keys already
    rows = state.join(by_asset(policies), ["chain", "address", "token"], "left").join(prices.select("chain", "token", F.col("price").alias("new_price")), ["chain", "token"], "left")
    usd = F.col("amount") * F.col("new_price")
    hit = F.col("new_price").isNotNull() & F.col("amount").isNotNull()
    return (
        rows.withColumn("valuation", F.when(hit, S.token_valuation(usd, F.col("policy"), anomaly_usd)).otherwise(F.col("valuation")))
        .withColumn("usd_value", F.when(hit, usd).otherwise(F.col("usd_value")))
        .withColumn("price", F.coalesce("new_price", "price"))
        .drop("new_price", "policy")
    )


def token_state_merge(old: DataFrame, new: DataFrame, final: DataFrame, keys: tuple[str, ...] = ("address", "chain", "token")) -> DataFrame:
    """Token state after a scan.

    Chains listed in final (address, chain) had a complete scan: their old rows are all replaced.
    Elsewhere only the tokens in new are; a failed one (null raw_amount) keeps its old row as stale.
    """
    good = new.where("raw_amount is not null")
    # one join by token for both, next to those that made old, so that its rows stay where they are
    seen = new.groupBy(*keys).agg(F.max(F.col("raw_amount").isNotNull()).alias("__good"), F.max(F.col("raw_amount").isNull()).alias("__failed"))
    kept = old.join(seen, list(keys), "left").where(F.coalesce(~F.col("__good"), F.lit(True)))
    kept = kept.withColumn("valuation", F.when(F.col("__failed"), "stale").otherwise(F.col("valuation"))).select(*old.columns)
    kept = kept.join(final.select("address", "chain").distinct(), ["address", "chain"], "left_anti").select(*old.columns)
    return kept.unionByName(good.select(*kept.columns))


def partial_refresh(old: DataFrame, new: DataFrame, keys: tuple[str, ...] = ("address", "chain", "token")) -> DataFrame:
    """Old values with a partial refresh: a read zero deletes, a read value replaces, a failure keeps the old row and counts up."""
    n = new.select(*keys, F.col("raw_amount").alias("new_raw"), F.lit(True).alias("seen"))
    both = old.join(n, list(keys), "full_outer")
    zero = F.col("seen") & F.col("new_raw").isNotNull() & ~S.raw_positive(F.col("new_raw"))
    both = both.where(~F.coalesce(zero, F.lit(False)) & (F.col("raw_amount").isNotNull() | F.col("new_raw").isNotNull()))
    fails = F.when(F.col("seen") & F.col("new_raw").isNull(), F.coalesce("failures", F.lit(0)) + 1).when(F.col("seen"), 0).otherwise(F.coalesce("failures", F.lit(0)))
    return both.withColumn("failures", fails).withColumn("raw_amount", F.coalesce("new_raw", "raw_amount")).drop("new_raw", "seen")


def anomalies(valued: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Register of shut-out values: first detected_at stays, the rest is the last seen."""
    keys = ["chain", "address", "token"]
    now = valued.where("valuation = 'anomalous_balance'").groupBy(*keys).agg(F.max("usd_value").alias("usd_value"), F.min("detected_at").alias("detected_at"))
    if known is None:
        return now
    old = known.select(*keys, F.col("usd_value").alias("old_usd"), F.col("detected_at").alias("old_at"))
    both = now.join(old, keys, "full_outer")
    return both.select(*keys, F.coalesce("usd_value", "old_usd").alias("usd_value"), F.coalesce("old_at", "detected_at").alias("detected_at"))


def excluded_usd(state: DataFrame, stale_counts: bool) -> DataFrame:
    """Value outside totals per (address, chain): everything not included (with stale), or the listed statuses only."""
    out: Column = F.col("valuation") != "included"
    if not stale_counts:
        out = F.col("valuation").isin("anomalous_balance", "quarantine", "exclude_from_total")
    return state.groupBy("address", "chain").agg(F.coalesce(F.sum(F.when(out, F.col("usd_value"))), F.lit(0.0)).alias("excluded_usd"))


def estimate(parts: DataFrame, threshold: float, uncertainty: str = "0.1") -> DataFrame:
    """Third-party estimate an address with bounds of the true value: v / (1 + u) and v / (1 - u).

    parts: (address, chain, has_code, provider_usd, price_missing).  Chains without code count 0;
    unknown code or no number makes the estimate incomplete, and it then has no upper bound.
    """
    amount = F.when(F.col("has_code") == 0, F.lit(0.0)).when(F.col("has_code") == 1, S.nonneg(F.col("provider_usd")))
    rows = parts.withColumn("amount", amount)
    out = rows.groupBy("address").agg(
        F.sum("amount").alias("estimated_usd"),
        F.count("amount").alias("coverage"),
        F.count("*").alias("total_networks"),
        F.max((F.col("amount").isNull() | F.coalesce("price_missing", F.lit(False))).cast("int")).alias("missing"),
    )
    # decimal division, so that bounds are exact at the threshold; doubles where a value is too large for it
    exact = F.col("estimated_usd").try_cast("decimal(28,8)")
    over = lambda d: F.coalesce((exact / F.lit(d)).cast("double"), F.col("estimated_usd") / float(d))
    lower = over(1 + Decimal(uncertainty))
    upper = F.when(F.col("missing") == 0, over(1 - Decimal(uncertainty)))
    status = F.when(F.col("missing") == 1, "incomplete").when(lower >= threshold, "estimated_above").when(upper >= threshold, "near_threshold").otherwise("estimated_below")
    return out.select("address", "estimated_usd", lower.alias("lower_usd"), upper.alias("upper_usd"), "coverage", "total_networks", status.alias("status"))

"""Revaluations of what was read before: by policy, by outlier, by single facts; all give new snapshots and are idempotent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions import scalars as S
from tidewatch.operators import merge, valuation


def part_status(before: Column, failed: Column, anomaly: Column, unpriced: Column) -> Column:
    """Status of a part after its values changed; what could not be read or is absent stays so."""
    return F.when(before.isin("absent", "rpc_error", "timeout"), before).otherwise(S.chain_status(failed, anomaly, unpriced))


def partial_totals(tokens: DataFrame, parts: DataFrame) -> DataFrame:
    """parts (address, chain, native_usd, status, ...) with tokens_usd, total_usd, excluded_usd and status from the token state."""
    read, included = F.col("raw_amount").isNotNull(), F.col("valuation") == "included"
    own = tokens.groupBy("address", "chain").agg(
        F.coalesce(F.sum(F.when(read & included, F.col("usd_value"))), F.lit(0.0)).alias("tokens_usd"),
        F.coalesce(F.sum(F.when(read & ~included, F.col("usd_value"))), F.lit(0.0)).alias("excluded_usd"),
        F.max((~read | (F.col("valuation") == "stale")).cast("int")).alias("failed"),
        F.max((read & F.col("valuation").isin("quarantine", "anomalous_balance")).cast("int")).alias("anomaly"),
        F.max((read & F.col("usd_value").isNull()).cast("int")).alias("unpriced"),
    )
    rows = parts.drop("tokens_usd", "total_usd", "excluded_usd").join(own, ["address", "chain"], "left")
    yes = lambda c: F.coalesce(F.col(c) == 1, F.lit(False))
    total = F.coalesce("native_usd", F.lit(0.0)) + F.coalesce("tokens_usd", F.lit(0.0))
    rows = rows.withColumns({"tokens_usd": F.coalesce("tokens_usd", F.lit(0.0)), "excluded_usd": F.coalesce("excluded_usd", F.lit(0.0)), "total_usd": total, "status": part_status(F.col("status"), yes("failed"), yes("anomaly"), yes("unpriced"))})
    return rows.drop("failed", "anomaly", "unpriced")


def revalue_native(parts: DataFrame, policies: DataFrame) -> DataFrame:
    """Parts (address, chain, native_seen_usd, tokens_usd) with native_usd and total_usd under the native policies of today.

    native_seen_usd, what was read, is never changed, so that a policy taken back restores the value.  Only
    exclude_from_total takes a value out; settle.excluded_native() carries it through past scans.
    """
    own = policies.where("asset = 'native'").select("chain", "address", "policy")
    rows = parts.join(own, ["chain", "address"], "left")
    out = F.coalesce(F.col("policy") == "exclude_from_total", F.lit(False))
    native = F.when(out, F.lit(0.0)).otherwise(F.coalesce("native_seen_usd", F.lit(0.0)))
    return rows.withColumn("native_usd", native).withColumn("total_usd", native + F.coalesce("tokens_usd", F.lit(0.0))).drop("policy")


def revalue_outliers(state: DataFrame, policies: DataFrame, anomaly_usd: float, known: DataFrame, as_of: str) -> tuple[DataFrame, DataFrame]:
    """(state, register): stored token values judged again by the outlier rule, and those shut out recorded.

    Stale rows stay stale.
    """
    rows = state.join(valuation.by_asset(policies), ["chain", "address", "token"], "left")
    judged = S.token_valuation(F.col("usd_value"), F.col("policy"), anomaly_usd)
    new = rows.withColumn("valuation", F.when(F.col("valuation") == "stale", "stale").otherwise(judged)).drop("policy")
    return new, valuation.anomalies(new.withColumn("detected_at", F.lit(as_of).cast("timestamp")), known)


def merge_code(state: DataFrame, reads: DataFrame) -> DataFrame:
    """Chain states (chain, address, has_code, native_usd, tokens_usd, ...) with code reads: an unknown read keeps the old answer, and "no code" never takes away a value that is known."""
    n = reads.select("chain", "address", F.col("has_code").alias("__new"))
    rows = state.join(n, ["chain", "address"], "left")
    worth = F.coalesce("native_usd", F.lit(0.0)) + F.coalesce("tokens_usd", F.lit(0.0)) > 0
    keep = F.col("__new").isNull() | ((F.col("__new") == 0) & worth)
    return rows.withColumn("has_code", F.when(keep, F.col("has_code")).otherwise(F.col("__new"))).drop("__new")


def merge_native(state: DataFrame, reads: DataFrame, prices: DataFrame, policies: DataFrame, anomaly_usd: float) -> DataFrame:
    """Chain states with native balances read again; a failed read keeps the old value."""
    good = valuation.value_native(reads.where("raw_amount is not null"), prices, policies, anomaly_usd, retry=True)
    zero = reads.where(F.col("raw_amount").isNotNull() & ~S.raw_positive(F.col("raw_amount"))).select("chain", "address", F.lit(0.0).alias("__usd"))
    value = F.when(F.col("valuation") == "included", F.col("usd_value")).otherwise(F.lit(0.0))
    new = good.select("chain", "address", value.alias("__usd")).unionByName(zero)
    rows = state.join(new, ["chain", "address"], "left").withColumn("native_usd", F.coalesce("__usd", "native_usd"))
    return rows.withColumn("total_usd", F.coalesce("native_usd", F.lit(0.0)) + F.coalesce("tokens_usd", F.lit(0.0))).drop("__usd")


def merge_decimals(tokens: DataFrame, reads: DataFrame) -> DataFrame:
    """Tokens with decimals read again; an answer that is no number of decimals keeps the old one."""
    n = reads.select("chain", "token", F.when(F.col("decimals").between(0, 36), F.col("decimals")).alias("__d"))
    return tokens.join(n, ["chain", "token"], "left").withColumn("decimals", F.coalesce("__d", "decimals")).drop("__d")


def provider_tokens(portfolio: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tokens, links) that a provider's answer (chain, address, token, symbol) names: links begin at block 0; malformed addresses are left out."""
    rows = portfolio.select("chain", S.evm_address(F.col("address")).alias("contract"), S.evm_address(F.col("token")).alias("token"), "symbol").where("contract is not null and token is not null")
    tokens = rows.groupBy("chain", "token").agg(F.min("symbol").alias("symbol")).select("chain", "token", "symbol", F.lit(None).cast("int").alias("decimals"), F.lit("provider").alias("source"))
    return tokens, rows.select("chain", "contract", "token", F.lit(0).cast("bigint").alias("first_block"), F.lit(0).cast("bigint").alias("last_block")).distinct()


def merge_estimates(target: DataFrame, delta: DataFrame) -> DataFrame:
    """One estimate an address, the newest by estimated_at."""
    return merge.latest(target.unionByName(delta), ["address"], ["estimated_at", "scan_id"])


def append_scans(contracts: DataFrame, scans: DataFrame) -> DataFrame:
    """Contracts with the status, total and time of the newest of the new scans; others keep what they have."""
    last = merge.latest(scans.select("address", "id", "status", "total_usd", "scanned_at"), ["address"], ["id"])
    n = last.select("address", F.col("status").alias("__s"), F.col("total_usd").alias("__t"), F.col("scanned_at").alias("__at"))
    rows = contracts.join(n, "address", "left")
    new = F.col("__at").isNotNull()
    pairs = {"last_status": "__s", "last_total_usd": "__t", "last_checked_at": "__at"}
    return rows.withColumns({c: F.when(new, F.col(x)).otherwise(F.col(c)) for c, x in pairs.items()}).drop(*pairs.values())

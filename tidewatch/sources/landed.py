"""Landed chain extracts as DataFrames with fixed schemas; malformed fields become null, not errors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions import scalars as S

BLOCKS = "chain string, number string, hash string, parentHash string, timestamp string, transactions array<struct<hash:string,to:string,from:string,blockNumber:string>>"
RECEIPTS = "chain string, tx_hash string, contractAddress string"
LOGS = "chain string, address string, topic0 string, topic2 string, block_number long"
CODE = "chain string, address string, code string, checked_at timestamp"
BALANCES = "chain string, address string, token string, raw string, error string, observed_at timestamp"
PRICES = "price_key string, price double, ts timestamp"
CHAINS = "chain string, chain_id long, llama_chain string, native_coingecko string, confirmations int, lifecycle string"
TOKENS = "chain string, token string, symbol string, decimals int"
PORTFOLIO = "address string, chain_list array<struct<community_id:string,id:string,usd_value:string>>, tokens array<struct<chain:string,id:string,symbol:string,amount:string,raw_amount_str:string,price:string,decimals:int,is_scam:boolean>>"
SUI_TX = "digest string, txStatus string, checkpoint long, timestampMs long, packagesMetadata array<struct<packageId:string,name:string>>"
SUI_PACKAGES = "packageId string, projectName string, project_packages array<string>, checkpoint long"
SUI_PROJECTS = "projectName string, currTvl string, currentTvl string, tvl string, packages array<string>, projectPackages array<string>"
SUI_POOLS = "poolId string, poolAddress string, objectId string, projectId string, projectName string, dexName string, liquidity_usd double"
FRAMES = "range_start long, range_end long, page int, frame int, digest string, checkpoint long, cursor binary, end_reason int"
ATTEMPTS = "ts timestamp, workload string, method string, endpoint string, status int, error string, ms double"


def _read(spark: SparkSession, path: str, schema: str, kind: str | None = None) -> DataFrame:
    kind = kind or ("parquet" if path.rstrip("/").endswith(".parquet") else "json")
    return spark.read.format(kind).schema(schema).load(path)


def chain_dim(spark: SparkSession, path: str, known_ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected): chains whose id is in known_ids (column chain_id)."""
    rows = _read(spark, path, CHAINS)
    return rows.join(F.broadcast(known_ids), "chain_id", "left_semi"), rows.join(F.broadcast(known_ids), "chain_id", "left_anti")


def token_seed(spark: SparkSession, path: str, chains: DataFrame) -> DataFrame:
    rows = _read(spark, path, TOKENS).withColumn("token", F.lower("token")).withColumn("source", F.lit("seed"))
    return rows.join(F.broadcast(chains.select("chain")), "chain", "left_semi")


def read_blocks(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    return _read(spark, path, BLOCKS, kind)


def read_receipts(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    return _read(spark, path, RECEIPTS, kind).withColumnRenamed("contractAddress", "contract_address")


def read_logs(spark: SparkSession, path: str, chain: str, start: int, end: int, bucket: int = 10_000) -> DataFrame:
    """Logs of a chain in a range of blocks, from files partitioned by chain and block_bucket: others are not opened."""
    rows = spark.read.schema(f"{LOGS}, block_bucket long").parquet(path)
    return rows.where((F.col("chain") == chain) & F.col("block_bucket").between(start // bucket, end // bucket) & F.col("block_number").between(start, end)).drop("block_bucket")


def read_code(spark: SparkSession, path: str) -> DataFrame:
    rows = _read(spark, path, CODE)
    return rows.select("chain", S.evm_address(F.col("address")).alias("address"), S.has_bytecode(F.col("code")).alias("has_code"), "checked_at").where("address is not null")


def read_balances(spark: SparkSession, path: str) -> DataFrame:
    """A failed call has an error and no value; a malformed word is a failure too.  raw_amount is exact decimal text, as valuation takes it."""
    rows = _read(spark, path, BALANCES)
    value = F.when(F.col("error").isNull(), S.abi_uint256(F.col("raw")))
    text = F.when(F.col("error").isNull(), S.abi_uint256_text(F.col("raw")))
    amount = F.when(F.col("error").isNull(), S.abi_uint256_decimal(F.col("raw")))
    failure = F.when(F.col("error").isNotNull(), F.col("error")).when(value.isNull(), "malformed")
    return rows.select("chain", S.evm_address(F.col("address")).alias("address"), F.lower("token").alias("token"), text.alias("raw_hex"), amount.alias("raw_amount"), value.alias("raw_value"), failure.alias("error"), "observed_at")


def read_prices(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, PRICES).where(S.finite(F.col("price")) & (F.col("price") > 0))


def read_portfolio(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, PORTFOLIO)


def portfolio_parts(portfolio: DataFrame, chains: DataFrame, code: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(parts, duplicates): a row an address and supported chain with the provider's value and the code status.

    A chain id that an answer gives twice is an error: its rows are in duplicates, its address not in parts.
    """
    items = portfolio.select("address", F.explode("chain_list").alias("c")).select("address", F.col("c.community_id").try_cast("long").alias("chain_id"), F.col("c.usd_value").alias("provider_usd"))
    items = items.where("chain_id is not null")
    twice = items.groupBy("address", "chain_id").agg(F.count("*").alias("n")).where("n > 1")
    good = portfolio.select("address").join(twice.select("address"), "address", "left_anti")
    grid = good.crossJoin(F.broadcast(chains.select("chain", "chain_id")))  # chains: a small dimension
    parts = grid.join(items, ["address", "chain_id"], "left").join(code.select("chain", "address", "has_code"), ["chain", "address"], "left")
    return parts, twice


def read_sui_transactions(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, SUI_TX)


def read_sui_packages(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, SUI_PACKAGES)


def read_sui_raw(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).withColumnRenamed("value", "payload")


def read_sui_projects(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, SUI_PROJECTS)


def read_sui_pools(spark: SparkSession, path: str, min_liquidity: float, limit: int) -> DataFrame:
    rows = _read(spark, path, SUI_POOLS).withColumn("pool_id", S.sui_id(F.coalesce("poolId", "poolAddress", "objectId"))).where("pool_id is not null")
    return rows.where(F.col("liquidity_usd") >= min_liquidity).orderBy(F.desc("liquidity_usd"), "pool_id").limit(limit)


def read_checkpoint_frames(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, FRAMES)


def read_samples(spark: SparkSession, path: str, kind: str, first_day: str | None = None) -> DataFrame:
    """Telemetry of a kind from Parquet partitioned by day; earlier days are not opened."""
    rows = spark.read.parquet(f"{path}/{kind}")
    return rows if first_day is None else rows.where(F.col("day") >= F.lit(first_day).cast("date"))


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def read_rpc_attempts(spark: SparkSession, path: str) -> DataFrame:
    rows = _read(spark, path, ATTEMPTS)
    return rows.withColumn("error_class", F.coalesce(S.classify_error(F.col("status"), F.col("error")), F.lit("ok"))).withColumn("method_group", S.method_group(F.col("method")))

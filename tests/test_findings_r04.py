"""Findings of round 4: steps that failed at size, and results that must not change with them."""

from compare import connect, differences
from conftest import SF
from pyspark.sql import functions as F

from tidewatch.queries import registry


def test_seed_pairs_in_many_tasks(spark):
    """few contracts and seeds make many pairs; Spark must not put them all into one task."""
    from tidewatch.operators import discovery

    chain = F.concat(F.lit("c"), (F.col("id") % 2).cast("string"))
    c = spark.range(400).select(chain.alias("chain"), F.concat(F.lit("a"), "id").alias("address"))
    t = spark.range(500).select(chain.alias("chain"), F.when(F.col("id") != 7, F.concat(F.lit("t"), "id")).alias("token"), F.lit("seed").alias("source"))
    links = spark.createDataFrame([("c1", "a5", "t3", 1, 1), ("c1", "a5", "own", 1, 1), ("c1", "other", "own", 1, 1)], "chain string, contract string, token string, first_block long, last_block long")
    out = discovery.applicable_tokens(c, t, links)
    by_task = out.groupBy(F.spark_partition_id()).count().where("count > 1000").collect()
    assert len(by_task) >= 4  # as many as shuffles have; before, one
    rows = {tuple(r) for r in out.collect()}
    assert out.count() == len(rows) == 2 * 200 * 250 + 1
    assert ("c1", "a5", "own") in rows and ("c1", "a9", None) in rows and ("c0", "a9", None) not in rows


def test_applicable_tokens_twin(spark):
    f, text = registry.queries()["applicable_tokens"], registry.oracle_sql()["applicable_tokens"]
    n, more, less = differences(f(spark, SF), text, connect(SF))
    assert n > 0 and not more and not less


def test_landed_chain_keeps_one_extract(spark, monkeypatch, tmp_path):
    """extracts go when they are counted; only their counts stay."""
    from tidewatch.streaming import jobs

    monkeypatch.setattr(jobs, "scratch", lambda spark, name: f"{tmp_path}/{name}")
    f, text = registry.queries()["landed_chain"], registry.oracle_sql()["landed_chain"]
    n, more, less = differences(f(spark, SF), text, connect(SF))
    assert n > 0 and not more and not less
    left = {x.name for x in tmp_path.iterdir()}
    assert "blocks-counts" in left and not left & {"blocks", "receipts", "code", "balances", "prices", "tokens"}


def test_missing_counts_deal_once(spark):
    """links and observations are dealt by contract and token nowhere but where the two meet."""
    from tidewatch.operators import discovery

    c = spark.createDataFrame([("a", "0xab"), ("a", "0xAB"), ("a", "x"), ("b", "0xab")], "chain string, address string")
    t = spark.createDataFrame([("a", "0x01", "seed"), ("a", "seed", "seed"), ("a", "0x02", "log"), ("b", None, "seed")], "chain string, token string, source string")
    links = spark.createDataFrame([("a", "0xab", "0x02", 1, 1), ("a", "0xab", "0x02", 3, 4), ("a", "x", "0x0", 1, 1)], "chain string, contract string, token string, first_block long, last_block long")
    seen = spark.createDataFrame([("a", "0xab", "0x01"), ("a", "0xab", "0x01"), ("a", "0xAB", "seed"), ("a", "x", "0x0"), ("a", "gone", "0x01")], "chain string, contract string, token string")
    out = discovery.missing_counts(c, t, links, seen)
    deals = [x for x in out._jdf.queryExecution().executedPlan().toString().split("\n") if "Exchange hashpartitioning(chain#" in x and ", contract#" in x and ", token#" in x]
    assert len(deals) <= 2  # before, two more for repeats
    assert {tuple(r) for r in out.collect()} == {("a", "0xab", 2), ("a", "0xAB", 1), ("a", "x", 2), ("b", "0xab", 1)}


def test_prices_are_joined_once(spark, monkeypatch):
    """amounts that get prices are worked out once and landed; rows and sums read them."""
    from tidewatch.operators import settle

    names, own = [], settle.landed
    monkeypatch.setattr(settle, "landed", lambda rows, name: names.append(name) or own(rows, name))
    f, text = registry.queries()["prices_refreshed"], registry.oracle_sql()["prices_refreshed"]
    n, more, less = differences(f(spark, SF), text, connect(SF))
    assert n > 0 and not more and not less
    assert names == ["priced"]


def test_missing_work_twin(spark):
    f, text = registry.queries()["missing_work"], registry.oracle_sql()["missing_work"]
    n, more, less = differences(f(spark, SF), text, connect(SF))
    assert n > 0 and not more and not less

"""Column functions and operators on literal rows."""

import datetime

import pytest
from pyspark.sql import functions as F

from tidewatch.functions import scalars as S
from tidewatch.operators import merge, reorg, sinks, sui, telemetry, valuation
from tidewatch.streaming import jobs

DAY = 86400


def values(spark, rows, schema, *cols):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*cols).collect()]


def test_addresses(spark):
    a = "0x" + "Ab" * 20
    got = values(spark, [(a,), ("0x12",), ("zz" + "0" * 40,), (None,)], "c string", S.evm_address(F.col("c")))
    assert got == [(a.lower(),), (None,), (None,), (None,)]
    got = values(spark, [("0x2",), (" 0XAB ",), ("",), ("0x" + "1" * 65,), ("g",)], "c string", S.sui_id(F.col("c")))
    assert got == [("0x" + "0" * 63 + "2",), ("0x" + "0" * 62 + "ab",), (None,), (None,), (None,)]
    got = values(spark, [("0x2::sui::SUI",), ("0x2::sui",)], "c string", S.coin_type(F.col("c")))
    assert got == [("0x" + "0" * 63 + "2::sui::SUI",), (None,)]


def test_words(spark):
    rows = [("0x" + "f" * 64,), ("0x" + "0" * 62 + "10",), ("0x10",), (None,), ("0x" + "g" * 64,)]
    assert values(spark, rows, "c string", S.abi_uint256(F.col("c"))) == [(float(2**256 - 1),), (16.0,), (None,), (None,), (None,)]
    assert values(spark, rows[:3], "c string", S.abi_uint256_text(F.col("c"))) == [("0x" + "f" * 64,), ("0x10",), (None,)]
    assert values(spark, [("0x10",), ("",), ("0x",), (None,), ("0x" + "f" * 16,), ("zz",)], "c string", S.hex_to_long(F.col("c"))) == [(16,), (0,), (0,), (0,), (None,), (None,)]
    assert values(spark, [("0x6000",), ("0x0000",), ("0x",), ("0x123",), ("6000",), (None,)], "c string", S.has_bytecode(F.col("c"))) == [(1,), (0,), (0,), (None,), (None,), (None,)]
    usdc = "0x" + "20".rjust(64, "0") + "4".rjust(64, "0") + "55534443".ljust(64, "0")
    assert values(spark, [(usdc,), ("0x" + "544f4b".ljust(64, "0"),), ("0x12",), (None,)], "c string", S.abi_string(F.col("c"))) == [("USDC",), ("TOK",), (None,), (None,)]


def test_errors(spark):
    rows = [(429, ""), (None, "Too many requests"), (403, "x"), (200, "block range too wide"), (503, ""), (404, ""), (200, "fine"), (None, None)]
    assert [r[0] for r in values(spark, rows, "s int, b string", S.classify_error(F.col("s"), F.col("b")))] == ["rate_limit", "rate_limit", "auth", "range", "http", "http", None, None]


def test_delays(spark):
    rows = [("rpc_error", 1, 0.0, 1), ("rpc_error", 1, 0.0, 9), ("price_missing", 1, 0.0, 0), ("anomalous_balance", 1, 0.0, 0), ("complete", 0, 9e9, 0), ("complete", 1, 500_000.0, 0), ("complete", 1, 150_000.0, 0), ("complete", None, 1.0, 0), ("complete", 1, None, 0)]
    got = values(spark, rows, "s string, c int, u double, k int", S.retry_delay(F.col("s"), F.col("c"), F.col("u"), 500_000.0, F.col("k")))
    assert [g[0] for g in got] == [1800, 3 * DAY, 30 * DAY, DAY, 90 * DAY, DAY, 3 * DAY, 30 * DAY, 90 * DAY]


def test_valuation_rules(spark):
    rows = [(1.0, None), (90_000.0, None), (90_000.0, "include"), (90_000.0, "include_verified"), (1.0, "quarantine"), (float("nan"), None), (float("inf"), "include_verified"), (None, None)]
    token = values(spark, rows, "u double, p string", S.token_valuation(F.col("u"), F.col("p"), 90_000.0))
    assert [t[0] for t in token] == ["included", "anomalous_balance", "anomalous_balance", "included", "quarantine", "anomalous_balance", "included", "included"]
    native = values(spark, rows[:5], "u double, p string", S.native_valuation(F.col("u"), F.col("p"), 90_000.0), S.native_valuation(F.col("u"), F.col("p"), 90_000.0, retry=True))
    assert native == [("included", "included"), ("anomalous_balance", "anomalous_balance"), ("included", "anomalous_balance"), ("included", "included"), ("quarantine", "quarantine")]


def test_estimate_bounds(spark):
    rows = [("a", "c1", 1, "89999", False), ("b", "c1", 1, "90000", False), ("c", "c1", 1, "100000", False), ("d", "c1", 1, "110000", False), ("e", "c1", None, "5", False), ("f", "c1", 0, "1e9", False), ("g", "c1", 1, "x", False)]
    df = spark.createDataFrame(rows, "address string, chain string, has_code int, provider_usd string, price_missing boolean")
    got = {r.address: r for r in valuation.estimate(df, 100_000.0).collect()}
    assert [got[k].status for k in "abcdefg"] == ["estimated_below", "near_threshold", "near_threshold", "estimated_above", "incomplete", "estimated_below", "incomplete"]
    assert got["e"].upper_usd is None and got["f"].estimated_usd == 0.0


def test_price_history(spark):
    t = lambda s: datetime.datetime(2024, 1, 1, 0, 0, s)
    obs = spark.createDataFrame([("x", t(10)), ("x", t(50)), ("y", t(5))], "token string, ts timestamp")
    prices = spark.createDataFrame([("x", 1.0, t(0)), ("x", 0.0, t(9)), ("x", 2.0, t(10))], "token string, price double, ts timestamp")
    got = {(r.token, r.ts.second): r.price for r in valuation.price_history(obs, prices, 30).collect()}
    assert got == {("x", 10): 2.0, ("x", 50): None, ("y", 5): None}


def test_merge_is_idempotent(spark):
    old = spark.createDataFrame([("x", "a", "A", None, "seed"), ("x", "b", None, 6, "seed"), ("y", "b", None, 9, "seed")], "chain string, token string, symbol string, decimals int, source string")
    new = spark.createDataFrame([("x", "b", "B", None, "log"), ("x", "c", "C", 1, "log")], old.schema)
    once = merge.merge_tokens(old, new)
    twice = merge.merge_tokens(once, new)
    want = {("x", "a", "A", None, "seed"), ("x", "b", "B", 6, "seed"), ("y", "b", None, 9, "seed"), ("x", "c", "C", 1, "log")}
    assert {tuple(r) for r in once.collect()} == want == {tuple(r) for r in twice.collect()}


def test_unknown_creation_never_wins(spark):
    schema = "chain string, address string, created_block long, created_tx string, creator string, canonical int"
    old = spark.createDataFrame([("c", "a", 5, "t5", "x", 1), ("c", "b", None, None, None, 0)], schema)
    new = spark.createDataFrame([("c", "a", None, "t0", "y", 1), ("c", "b", 7, "t7", "z", 1)], schema)
    want = {("a", 5, "t5", "x", 1), ("b", 7, "t7", "z", 1)}
    for f in (merge.merge_contracts, merge.fill_contracts):
        assert {(r.address, r.created_block, r.created_tx, r.creator, r.canonical) for r in f(old, new).collect()} == want
    assert merge.merge_contracts(new, old).where("address = 'a'").first().created_block == 5


def test_discoveries_become_canonical_again(spark):
    schema = "chain string, address string, source string, observed_block long, canonical int"
    old = spark.createDataFrame([("c", "a", "s", 3, 0), ("c", "b", "s", 9, 1)], schema)
    new = spark.createDataFrame([("c", "a", "s", 8, 1), ("c", "b", "s", 4, 1)], schema)
    assert {(r.address, r.observed_block, r.canonical) for r in merge.merge_discoveries(old, new).collect()} == {("a", 8, 1), ("b", 4, 1)}


def test_policies_need_reasons(spark):
    rows = [("include", None), ("include_verified", " "), ("include_verified", "seen"), ("other", "x"), (None, None)]
    good, bad = merge.validated_policies(spark.createDataFrame(rows, "policy string, reason string"))
    assert good.count() == 2 and bad.count() == 3


def test_ancestor_needs_history(spark):
    stored = spark.createDataFrame([("c", n, f"h{n}" if n != 104 else "bad") for n in (100, 101, 103, 104)], "chain string, number long, block_hash string")
    now = spark.createDataFrame([("c", n, f"h{n}") for n in range(100, 106)], "chain string, number long, block_hash string")
    bad = spark.createDataFrame([("c", 104)], "chain string, number long")
    assert reorg.common_ancestor(bad, stored, now).first().ancestor == 103
    hole = stored.where("number <> 103")
    assert reorg.common_ancestor(bad, hole, now).first().ancestor is None


def test_raw_transaction(spark):
    raw = """{"transaction":{"data":{"transaction":{"transactions":[{"MoveCall":{"package":"0xa"}},{"MoveCall":{"package":"0x2"}},{"Publish":{}}]}}},
      "objectChanges":[{"type":"published","packageId":"0xb"},{"type":"created","objectType":"0xa::m::P","objectId":"0x11","owner":{"Shared":{"initial_shared_version":1}}},
      {"type":"created","objectType":"0xa::m::Q","objectId":"0x12","owner":{"ObjectOwner":"0x11"}},{"type":"created","objectType":"0xa::m::R","objectId":"0x13","owner":{"AddressOwner":"0x9"}}]}"""
    r = sui.raw_facts(spark.createDataFrame([(raw,), ("broken",), (None,)], "payload string")).collect()
    assert len(r[0].calls) == 1 and len(r[0].published) == 1 and [o.owner_kind for o in r[0].objects] == ["shared", "object"]
    assert r[1].calls == [] and r[2].objects == []


def test_result_lists(spark):
    """Lists at the top, under a name and nested; entries that are no objects are left out, an empty list gives nothing, no list an error."""
    rows = [('[{"a":1},2,null]',), ('{"data":[{"a":2}]}',), ('{"content":null,"value":{"items":[{"a":3},{"a":4}]}}',), ('{"x":1}',), ('{"content":5}',), ("broken",), (None,), ("[]",), ('{"data":{"content":[]}}',)]
    got = sui.result_items(spark.createDataFrame(rows, "payload string")).select("error", sui.item_field(F.col("item"), "b", "a", kind="int").alias("a")).collect()
    assert sorted((r.error, r.a or 0) for r in got) == [(False, 1), (False, 2), (False, 3), (False, 4), (True, 0), (True, 0), (True, 0), (True, 0)]


def test_load_states(spark):
    t0 = 1_700_000_000
    rows = [("d", t0, 0, 0, 0), ("d", t0 + 60, 6000, 0, 0), ("d", t0 + 120, 100, 0, 0), ("d", t0 + 600, 100, 0, 0), ("d", t0 + 720, 100, 0, 0), ("d", t0 + 780, 30_000, 0, 0), ("d", t0 + 840, 0, 0, 0), ("d", t0 + 1440, 0, 0, 0)]
    df = spark.createDataFrame(rows, "day string, t long, pending long, oldest_sec long, wait_sec long").withColumn("ts", F.timestamp_seconds("t"))
    got = [r.state for r in telemetry.load_states(df, ["day"]).orderBy("ts").collect()]
    assert got == ["normal", "drain", "drain", "drain", "normal", "balance_only", "balance_only", "drain"]


def test_percentile_and_metrics(spark):
    df = spark.createDataFrame([("e", 0.0, "ok"), ("e", 100.0, "ok")], "endpoint string, ms double, error_class string")
    assert telemetry.latency(df, ["endpoint"]).first().p95 == 95.0
    lines = spark.createDataFrame([("# x",), ("node_load1 2.5",), ('node_cpu_seconds_total{cpu="0",mode="idle"} 10',), ("bad",)], "value string")
    got = {r.metric: (r.labels, r.value) for r in telemetry.scrape_metrics(lines).collect()}
    assert got == {"node_load1": (None, 2.5), "node_cpu_seconds_total": ({"cpu": "0", "mode": "idle"}, 10.0)}
    odd = spark.createDataFrame([('x{a="1,2",b="c=d",a="3"} 4',)], "value string")
    assert telemetry.scrape_metrics(odd).first().labels == {"a": "1,2", "b": "c=d"}


def test_snapshots(spark, tmp_path):
    df = spark.createDataFrame([(1, "a")], "k int, v string")
    path = str(tmp_path / "s")
    assert sinks.write_if_changed(df, path, "0") and not sinks.write_if_changed(df, path, "1")
    run = sinks.upsert_batches(path, lambda o, n: merge.merge(o, n, ["k"], {}))
    run(spark.createDataFrame([(1, "b"), (2, "c")], df.schema), 1)
    run(spark.createDataFrame([(1, "zzz")], df.schema), 1)
    assert {tuple(r) for r in sinks.read_snapshot(spark, path).collect()} == {(1, "b"), (2, "c")}


@pytest.mark.parametrize("form", ["dedupe", "minutes"])
def test_streams_equal_batch(spark, tmp_path, form):
    rows = [(datetime.datetime(2024, 1, 1, 0, k % 5, k), f"d{k % 7}", "c", float(k)) for k in range(20)]
    df = spark.createDataFrame(rows, "ts timestamp, digest string, chain string, ms double")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    out = jobs.dedupe_digests(stream) if form == "dedupe" else jobs.minute_counts(stream, "ts", ["chain"], "ms")
    q = out.writeStream.format("memory").queryName(f"t_{form}").outputMode("append" if form == "dedupe" else "update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    got = spark.table(f"t_{form}")
    if form == "dedupe":
        assert got.count() == 7
    else:
        want = {(r.minute, r.n) for r in telemetry.minute_rollup(df, "ts", ["chain"], "ms").collect()}
        assert {(r.minute, r.n) for r in got.collect()} == want


def test_snapshot_after_a_crash(spark, tmp_path, monkeypatch):
    df = spark.createDataFrame([(1, "a")], "k int, v string")
    path = str(tmp_path / "s")
    run = sinks.upsert_batches(path, lambda o, n: merge.merge(o, n, ["k"], {}))
    run(df, 0)
    with monkeypatch.context() as m:
        m.setattr(sinks, "_publish", lambda *a: 1 / 0)  # dies between data and pointer
        with pytest.raises(ZeroDivisionError):
            run(spark.createDataFrame([(2, "b")], df.schema), 1)
    assert {tuple(r) for r in sinks.read_snapshot(spark, path).collect()} == {(1, "a")}
    run(spark.createDataFrame([(2, "b")], df.schema), 1)
    assert {tuple(r) for r in sinks.read_snapshot(spark, path).collect()} == {(1, "a"), (2, "b")}


def test_amount_words(spark):
    words = {0: "0", 1: "1", 10**9: "1000000000", 2**256 - 1: str(2**256 - 1), 10**40 + 7: str(10**40 + 7)}
    df = spark.createDataFrame([(f"0x{k:064x}", v) for k, v in words.items()] + [("0x12", None), (None, None)], "w string, want string")
    assert all(r.got == r.want for r in df.select("want", S.abi_uint256_decimal(F.col("w")).alias("got")).collect())


def test_load_states_under_pressure(spark):
    """Random series against the rules written as a loop."""
    import random

    r = random.Random(6)
    rows, t = [], 1_700_000_000
    for k in range(600):
        t += r.choice([20, 40, 70])
        hot = (k // 40) % 3
        attempts = r.choice([10, 60, 100, 200]) if r.random() < 0.1 else 200
        errors = {0: r.randrange(0, 15), 1: r.randrange(45, 60), 2: r.randrange(60, 120)}[hot]
        rows.append(("d", datetime.datetime.fromtimestamp(t, datetime.timezone.utc), r.choice([100, 100, 100, 6000 if hot else 100, 25000 if k % 97 == 0 else 100]), 10 * r.randrange(100), r.randrange(10), attempts, errors, 1000.0 * r.randrange(1, 7)))
    df = spark.createDataFrame(rows, "day string, ts timestamp, pending long, oldest_sec long, wait_sec long, rpc_attempts long, rpc_errors long, rpc_p95_ms double")
    got = [(x.state, x.live, x.backfill) for x in telemetry.load_states(df, ["day"]).orderBy("ts").collect()]
    want, state, since, pressure = [], "normal", None, False
    began = {"bad": None, "severe": None, "healthy": None}
    for _, ts, pending, oldest, wait, n, e, p95 in rows:
        now, share = ts.timestamp(), e / n
        holds = {"bad": n >= 50 and (share >= 0.2 or p95 >= 15000), "severe": n >= 50 and share >= 0.35, "healthy": n >= 50 and share < 0.1 and p95 < 8000}
        began = {m: (began[m] if began[m] is not None else now) if h else None for m, h in holds.items()}
        lasts = {m: b is not None and now - b >= {"bad": 120, "severe": 60, "healthy": 600}[m] for m, b in began.items()}
        pressure = True if lasts["bad"] or lasts["severe"] else False if lasts["healthy"] else pressure
        calm = pending < 5000 and oldest < 3600 if state == "balance_only" else pending < 2000 and oldest < 1800 and wait < 15
        if pending >= 20000 or oldest >= 21600:
            state, since = "balance_only", None
        elif state == "drain" and (pending >= 5000 or oldest >= 3600 or wait >= 30 or pressure) or state == "normal" and (pending >= 5000 or oldest >= 3600 or wait >= 30 or pressure):
            state, since = "drain", None
        elif state != "normal":
            since = (since if since is not None else now) if calm else None
            if since is not None and now - since >= 600:
                state, since = {"balance_only": "drain", "drain": "normal"}[state], None
        want.append((state, {"normal": 6, "drain": 3, "balance_only": 0}[state], 3 if state == "normal" else 0))
    assert got == want and len({x[0] for x in want}) == 3

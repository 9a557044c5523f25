"""Faults that showed on larger tables, on small ones that have them too."""

import os

import duckdb
import pytest
from compare import TABLES, connect, differences
from conftest import SF

from tidewatch.queries import registry


@pytest.fixture(scope="session")
def far_ids(tmp_path_factory):
    """The smallest tables with events a second time, their ids a million higher."""
    out = str(tmp_path_factory.mktemp("far"))
    for t in TABLES:
        os.symlink(f"{SF}/{t}.parquet", f"{out}/{t}.parquet") if t != "events" else None
    duckdb.sql(f"COPY (SELECT e.* REPLACE (e.event_id + 1000000 * i AS event_id) FROM range(2) r(i), '{SF}/events.parquet' e) TO '{out}/events.parquet' (FORMAT parquet)")
    return out


def test_added_ids_that_exist(spark, far_ids):
    rows, ours, theirs = differences(registry.queries()["tree_changes"](spark, far_ids), registry.oracle_sql()["tree_changes"], connect(far_ids))
    assert rows and not ours and not theirs, (rows, ours[:3], theirs[:3])


def _applicable(spark):
    contracts = spark.createDataFrame([("a", "x"), ("a", "y"), ("a", "y"), ("b", "x"), ("c", "z")], "chain string, address string")
    tokens = spark.createDataFrame([("a", f"t{i}", "seed") for i in (5, 1, 3, 7)] + [("a", "t1", "seed"), ("a", "t2", "transfer_log"), ("b", "t9", "transfer_log")], "chain string, token string, source string")
    links = spark.createDataFrame([("a", "x", "t1"), ("a", "x", "t2"), ("a", "x", "t0"), ("b", "x", "t4"), ("b", "w", "t4")], "chain string, contract string, token string")
    return contracts, tokens, links


def test_applicable_pairs_are_not_shuffled(spark):
    from tidewatch.operators import discovery

    out = discovery.applicable_tokens(*_applicable(spark))
    want = {("a", c, t) for c in "xy" for t in ("t1", "t3", "t5", "t7")} | {("a", "x", "t2"), ("a", "x", "t0"), ("b", "x", "t4")}
    assert sorted(tuple(r) for r in out.collect()) == sorted(want)
    text = out._jdf.queryExecution().optimizedPlan().toString()
    assert text.startswith("Union"), text  # before, all pairs went through a distinct


def test_slices_equal_pairs(spark):
    from pyspark.sql import functions as F
    from tidewatch.operators import discovery

    args = _applicable(spark)
    for size in (1, 3, 20):
        rows = discovery.token_slices(discovery.applicable_tokens(*args), size).groupBy("chain", "contract").agg(F.count_if(~F.col("deferred")), F.count_if("deferred"), F.max(F.when(~F.col("deferred"), F.col("token"))))
        assert sorted(map(tuple, discovery.slice_summary(*args, size).collect())) == sorted(map(tuple, rows.collect()))


def test_missing_counts_equal_pairs(spark):
    from pyspark.sql import functions as F
    from tidewatch.operators import discovery

    args = _applicable(spark)
    seen = spark.createDataFrame([("a", "x", "t1"), ("a", "x", "t1"), ("a", "x", "t0"), ("a", "y", "t9"), ("b", "x", "t4"), ("q", "x", "t4")], "chain string, contract string, token string")
    rows = discovery.missing_work(discovery.applicable_tokens(*args), seen).groupBy("chain", "contract").agg(F.count("*"))
    assert sorted(map(tuple, discovery.missing_counts(*args, seen).collect())) == sorted(map(tuple, rows.collect())) == [("a", "x", 4), ("a", "y", 4)]


def test_numbers_of_ranges_are_not_broadcast(spark):
    out = registry.queries()["range_gate"](spark, SF)
    deep = None  # indent of the broadcast that a line lies under
    for line in out._jdf.queryExecution().executedPlan().toString().splitlines():
        at = len(line) - len(line.lstrip(" :+-*"))
        deep = None if deep is not None and at <= deep else deep
        assert not (deep is not None and "Generate explode(sequence(start" in line), line
        deep = at if deep is None and "BroadcastExchange" in line else deep


def test_holes_of_a_cell_are_one_piece_of_work(spark, tmp_path):
    from tidewatch.streaming import blocks

    path = str(tmp_path)
    archive = spark.createDataFrame([("a", n, f"h{n}") for n in range(64)], "chain string, number bigint, block_hash string")
    blocks.commit(spark, path, archive.where("number % 2 = 0"), "tip", "0")
    bounds = spark.createDataFrame([("a", 0, 63)], blocks.COVERED)
    assert blocks.back_fill(spark, path, archive, bounds, size=64, most=1)  # before, a round for each of 32 holes
    assert not blocks.back_fill(spark, path, archive, bounds, size=64, most=1)
    assert sorted(r.number for r in blocks.committed(spark, path).collect()) == list(range(64))


def test_shared_ranges_are_not_multiplied_by_tasks(spark):
    from tidewatch.operators import history

    ranges = spark.createDataFrame([("a", "k", 8 * i, 8 * i + 7) for i in range(400) if i % 100 != 99] + [("a", "k", 4, 20), ("b", "k", 0, 5)], "chain string, kind string, from_block long, to_block long")
    starts = [0, 3, 791, 792, 799, 800, 1591, 3191, 3192, 5000]
    tasks = spark.createDataFrame([("a", "k", f"x{s}", s) for s in starts] + [("a", "z", "x", 3), ("b", "k", "x", 6), ("b", "k", "y", 5), ("c", "k", "n", None)], "chain string, kind string, address string, start_block long")
    out = history.covered_to(tasks, ranges, ("chain", "kind"), bucket=64)
    want = [("a", "k", f"x{s}", s, n) for s, n in zip(starts, [792, 792, 792, 792, 799, 1592, 1592, 3192, 3192, 5000])] + [("a", "z", "x", 3, 3), ("b", "k", "x", 6, 6), ("b", "k", "y", 5, 6), ("c", "k", "n", None, None)]
    assert sorted(map(str, map(tuple, out.collect()))) == sorted(map(str, want))


def _held(spark):
    cols = "chain string, address string, token string, raw_amount string, amount double, price double, usd_value double, priced int, valuation string"
    return spark.createDataFrame([("a", "x", "t1", "5", 5.0, None, None, 0, "included"), ("a", "x", "t2", "5", 5.0, 400.0, 2000.0, 1, "included"), ("a", "x", "t3", "5", 5.0, 400.0, 2000.0, 1, "included"), ("a", "y", "t2", "5", 5.0, 400.0, 2000.0, 1, "stale"), ("a", "y", "t4", None, None, None, None, 0, None)], cols)


def test_only_large_values_meet_policies(spark):
    from tidewatch.operators import settle

    tokens = _held(spark)
    policies = spark.createDataFrame([("a", "x", "t2", "include_verified"), ("a", "x", "t3", "exclude_from_total"), ("a", "y", "t4", "quarantine")], "chain string, address string, asset string, policy string")
    scans = spark.createDataFrame([(1, "x", 5.0, "old"), (2, "y", 5.0, "old")], "scan_id long, address string, total_usd double, status string")
    cols = "chain string, status string, has_code int, observed_native_usd double, included_native_usd double, tokens_usd double, total_usd double, excluded_usd double, valuation string"
    part = ("a", "complete", 1, 0.0, 0.0, 1.0, 1.0, 0.0, "included")
    parts = spark.createDataFrame([(1, *part), (2, *part)], "scan_id long, " + cols)
    states = spark.createDataFrame([("x", *part, None), ("y", *part, None)], "address string, " + cols + ", next_retry_at timestamp")
    contracts = spark.createDataFrame([("a", "x", 1.0, "old")], "chain string, address string, last_total_usd double, last_status string")
    past = tokens.join(scans.select("scan_id", "address"), "address").drop("address")
    out = settle.quarantined(tokens, states, past, parts, scans, contracts, policies, 1500.0, 30_000.0, "2024-02-01 00:00:00")
    assert sorted(r.valuation or "-" for r in out["tokens"].collect()) == ["-", "exclude_from_total", "included", "included", "stale"]
    assert sorted((r.scan_id, r.tokens_usd, r.excluded_usd) for r in out["scan_parts"].collect()) == [(1, 2000.0, 2000.0), (2, 1.0, 0.0)]
    assert [(r.last_total_usd, r.last_status) for r in out["contracts"].collect()] == [(2000.0, "below")]
    for name in ("tokens", "scan_tokens"):  # before, all rows were joined with policies
        text = out[name]._jdf.queryExecution().optimizedPlan().toString()
        assert text.startswith("Union"), text


def test_only_unpriced_amounts_meet_prices(spark):
    from tidewatch.operators import settle

    tokens = _held(spark)
    states = spark.createDataFrame([("x", "a", "price_missing", 0.0, 1.0, 1.0, 0.0, "verified", None)], "address string, chain string, status string, included_native_usd double, tokens_usd double, total_usd double, excluded_usd double, coverage string, price_retry_at timestamp")
    contracts = spark.createDataFrame([("a", "x", 1.0, "old")], "chain string, address string, last_total_usd double, last_status string")
    prices = spark.createDataFrame([("a", "t1", 10.0), ("a", "t2", 1.0), ("a", "t4", 1.0)], "chain string, token string, price double")
    policies = spark.createDataFrame([], "chain string, address string, asset string, policy string")
    out = settle.refreshed_prices(tokens, states, contracts, states.select("address", "chain"), prices, policies, "2024-02-01 00:00:00", 30_000.0, 1500.0, 1500.0)
    assert sorted((r.address, r.token, r.usd_value) for r in out["tokens"].collect() if r.usd_value) == [("x", "t1", 50.0), ("x", "t2", 2000.0), ("x", "t3", 2000.0), ("y", "t2", 2000.0)]
    assert [(r.status, r.total_usd) for r in out["states"].collect()] == [("complete", 4050.0)]
    text = out["tokens"]._jdf.queryExecution().optimizedPlan().toString()
    assert text.startswith("Union"), text  # before, all rows were joined with due chains, prices and policies


def test_children_of_a_report_are_gathered_once(spark, monkeypatch):
    from tidewatch.operators import reports, sinks
    from tidewatch.queries import reporting

    plans, kinds, real = [], [], sinks.write_reports
    monkeypatch.setattr(reports, "full_report", lambda *a, f=reports.full_report: (plans.append(f(*a)), plans[-1])[1])
    monkeypatch.setattr(sinks, "write_reports", lambda df, k, *a: (kinds.append(k), real(df, k, *a))[1])
    rows = reporting.full_report(spark, SF)
    assert len(plans) == 1 and kinds == [["qualifying", "below", "incomplete"]]  # before, everything was read again for each kind
    assert plans[0]._jdf.queryExecution().optimizedPlan().toString().count("collect_list(") == 3  # networks, tokens, sources; before 4
    assert rows.count() == plans[0].count() > 0


def test_folds_of_dense_samples_are_linear():
    import random
    import time

    from tidewatch.streaming.incidents import SECOND, Stall, Threshold

    def plain(rule, rows):
        """Each sample against all of its window."""
        out, opened, repeats = [], None, 0
        for n, (_, at, _, _, _) in enumerate(rows):
            def all_of(window, span, holds):
                own = [r for r in rows if at - window * SECOND <= r[1] <= at]
                return at - own[0][1] >= span * SECOND and all(holds(r[2]) for r in own)

            if all_of(rule.calm_window, rule.calm_span, lambda v: v < rule.below):
                out += [(opened, at, repeats)] if opened is not None else []
                opened, repeats = None, 0
            elif all_of(rule.window, rule.least_span, lambda v: v > rule.above):
                opened, repeats = at if opened is None else opened, repeats + 1
            if opened is not None and (n + 1 == len(rows) or rows[n + 1][1] != at):
                out.append((opened, None, repeats))
        return out

    fresh = lambda: {"opened_at": None, "repeats": 0, "mark": None, "times": [], "values": [], "others": []}
    r = random.Random(4)
    rule, state = Threshold(above=10, window=60, least_span=30, below=12, calm_window=40, calm_span=20), fresh()
    times = sorted(r.randrange(900) * SECOND for _ in range(400))
    rows = [(i, t, 20.0 if t // (200 * SECOND) % 2 == 0 and r.random() < 0.99 else 5.0, None, None) for i, t in enumerate(times)]
    got = [x for t in sorted(set(times)) for x in rule.fold(state, [g for g in rows if g[1] == t])]
    assert got == plain(rule, rows) and any(x[1] for x in got)
    # 100,000 samples within one window; before, each looked at all that came before it
    for rule, one in ((Threshold(above=10, window=3600, least_span=900, below=5, calm_window=1800, calm_span=600), 20.0), (Stall(), 7)):
        state, begun = fresh(), time.process_time()
        for i in range(100_000):
            list(rule.fold(state, [(i, i * 8000, one, i, True)]))
        assert time.process_time() - begun < 20


def test_dense_frames_equal_plain_windows(spark):
    import random

    from pyspark.sql import Window
    from pyspark.sql import functions as F
    from tidewatch.operators import telemetry

    r = random.Random(5)
    rows = [(i, "ab"[i % 2], 86_400 - 500 + r.randrange(1000), r.choice([None, 1.0, 9.0, 9.0, 9.0, 9.0, 9.0, 9.0, 9.0, 9.0, 9.0])) for i in range(600)]
    df = spark.createDataFrame(rows, "id long, k string, t long, v double").withColumn("ts", F.timestamp_seconds("t")).drop("t")
    at = F.unix_micros("ts")
    w = Window.partitionBy("k").orderBy(at).rangeBetween(-60_000_000, 0)
    own = df.where("v is not null").select("id", ((at - F.min(at).over(w)) / 1e6).alias("span"), ((F.min((F.col("v") > 5).cast("int")).over(w) == 1) & (at - F.min(at).over(w) >= 30_000_000)).alias("sustained"))
    got = telemetry.sustained(df, F.col("v"), F.lit(5.0), 60, 30, ["k"]).select("id", "span", "sustained")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, own.collect()))
    known = F.min(F.when(F.col("v").isNotNull(), at)).over(w)
    own = df.select("id", F.coalesce(F.col("v").isNotNull() & (F.min((F.col("v") > 5).cast("int")).over(w) == 1) & (at - known >= 30_000_000), F.lit(False)).alias("h"))
    got = telemetry.held(df, F.col("v") > 5, 60, 30, ["k"], "h").select("id", "h")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, own.collect()))
    for out in (telemetry.sustained(df, F.col("v"), F.lit(5.0), 60, 30, ["k"]), telemetry.held(df, F.col("v") > 5, 60, 30, ["k"], "h")):
        text = out._jdf.queryExecution().optimizedPlan().toString()
        assert "RangeFrame, -" not in text, text  # a sliding frame adds up all of its rows for each row


def test_cut_comes_from_all_labelled_documents(spark):
    import random

    import numpy as np
    from llm import quality_rules

    r = random.Random(6)
    words = [f"w{i}" for i in range(400)]
    n = 5_400  # of each kind; before, 5,000 of each were looked at
    docs = spark.createDataFrame([(i, i % 2, " ".join(r.sample(words[: 400 if i % 2 else 300], 55))) for i in range(2 * n)], "doc_id long, quality int, text string")
    ratios = quality_rules.fit_ratios(docs, docs.select("doc_id", "quality"), buckets=256)
    scores = {q: [x.ngram_score for x in quality_rules.with_score(docs.where(f"quality = {q}"), ratios).collect()] for q in (0, 1)}
    good, bad = np.percentile(scores[1], 1), np.percentile(scores[0], 95)
    assert quality_rules.fit_threshold(docs, docs.select("doc_id", "quality"), ratios) == pytest.approx(min(good, (good + bad) / 2), abs=1e-12)

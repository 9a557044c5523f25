"""Durable tables, streams and trees on small fixtures: crashes, replays, orders of jobs, and brute force."""

import random

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.operators import hash_tree, intervals, merge, reorg, settle, sinks, tables, telemetry
from tidewatch.streaming import blocks, incidents, jobs


def rows_of(df: DataFrame) -> set:
    return {tuple(r) for r in df.collect()}


def test_correction_is_seen_whole(spark, tmp_path, monkeypatch):
    """A writer that dies between two tables leaves the old version; the next one corrects all of them."""
    path = str(tmp_path / "set")
    old = {"a": spark.range(3).withColumn("v", F.lit(0)), "b": spark.range(3).withColumn("v", F.lit(0)), "c": spark.range(3).withColumn("v", F.lit(0))}
    tables.publish(spark, path, tables.Version(), old)
    raised = lambda t: {n: t[n].withColumn("v", F.col("v") + 1) for n in ("a", "b")}
    real, written = tables.uuid.uuid4, []

    def dies():
        written.append(1)
        if len(written) == 2:
            raise OSError("lost")
        return real()

    monkeypatch.setattr(tables.uuid, "uuid4", dies)
    with pytest.raises(OSError):
        tables.change(spark, path, raised)
    monkeypatch.setattr(tables.uuid, "uuid4", real)
    assert all(rows_of(t) == {(k, 0) for k in range(3)} for t in tables.opened(spark, path).values())
    tables.change(spark, path, raised)
    now = tables.opened(spark, path)
    assert rows_of(now["a"]) == rows_of(now["b"]) == {(k, 1) for k in range(3)} and rows_of(now["c"]) == {(k, 0) for k in range(3)}


def test_two_writers(spark, tmp_path):
    path = str(tmp_path / "set")
    first = tables.publish(spark, path, tables.Version(), {"a": spark.range(1)})
    tables.publish(spark, path, first, {"a": spark.range(2)})
    with pytest.raises(tables.Moved):
        tables.publish(spark, path, first, {"a": spark.range(3)})
    more = lambda t: {"a": t["a"].union(spark.range(9, 10))}
    tables.change(spark, path, more, "w", "1")
    tables.change(spark, path, more, "w", "1")  # the same commit again
    assert sorted(r.id for r in tables.opened(spark, path)["a"].collect()) == [0, 1, 9]


@pytest.mark.parametrize("bucket", [4, 16, 1 << 16])
def test_intervals(spark, bucket):
    r = random.Random(bucket)
    make = lambda n: [(r.choice("xy"), a, a + r.randint(0, 12)) for a in (r.randrange(100) for _ in range(n))]
    a, b = make(12), make(9)
    numbers = lambda rows: {(k, n) for k, s, e in rows for n in range(s, e + 1)}
    frame = lambda rows: spark.createDataFrame(rows, "k string, start_block long, end_block long")
    for f, want in ((intervals.union, numbers(a) | numbers(b)), (intervals.difference, numbers(a) - numbers(b)), (intervals.intersection, numbers(a) & numbers(b))):
        got = [tuple(x) for x in f(frame(a), frame(b), ["k"], bucket).collect()]
        assert numbers(got) == want and sum(e - s + 1 for _, s, e in got) == len(want)
        assert all((k, s - 1) not in want and (k, e + 1) not in want for k, s, e in got)
    pieces = [tuple(x) for x in intervals.cut(frame(a), 5).collect()]
    assert numbers(pieces) == numbers(a) and max(e - s for _, s, e in pieces) < 5


def test_tip_and_back_fill_in_any_order(spark, tmp_path):
    """Back-fill first, then the tip twice, then back-fill: every block once and no hole; numbers that the archive lacks are no blocks."""
    path = str(tmp_path / "t")
    archive = spark.createDataFrame([("c", n, f"h{n}") for n in range(60) if n not in (13, 14)], "chain string, number long, block_hash string")
    bounds = spark.createDataFrame([("c", 0, 39)], "chain string, start_block long, end_block long")
    assert blocks.back_fill(spark, path, archive, bounds, size=8, most=2)
    tip = blocks.tip_batches(path)
    tip(archive.where("number >= 30 and number % 4 <> 0").union(archive.where("number = 35")), 0)
    tip(archive.where("number >= 30 and number % 4 <> 0"), 0)  # the same batch again
    tip(archive.where("number >= 10 and number % 9 = 0"), 1)
    open_ = spark.createDataFrame([("c", 0, None)], "chain string, start_block long, end_block long")
    while blocks.back_fill(spark, path, archive, open_, size=16, most=3):
        pass
    got = [(r.number, r.block_hash) for r in blocks.committed(spark, path).collect()]
    assert sorted(got) == [(n, f"h{n}") for n in range(60) if n not in (13, 14)]
    assert [tuple(r) for r in blocks.covered(spark, path).collect()] == [("c", 0, 59)] and blocks.gaps(spark, path, open_).count() == 0


def test_finished_replay(spark):
    gaps = spark.createDataFrame([("a", "complete", "reorg_replay"), ("a", "reorg_replay", "tip"), ("b", "active", "reorg_replay"), ("b", "reorg_replay", "tip")], "chain string, status string, reason string")
    cursors = spark.createDataFrame([("a", "reorg_replay"), ("b", "reorg_replay"), ("c", "active")], "chain string, status string")
    out = reorg.finished({"gaps": gaps, "cursors": cursors})
    assert rows_of(out["cursors"]) == {("a", "active"), ("b", "reorg_replay"), ("c", "active")}
    assert rows_of(out["gaps"]) == {("a", "complete", "reorg_replay"), ("a", "active", "tip"), ("b", "active", "reorg_replay"), ("b", "reorg_replay", "tip")}


def test_quarantine_keeps_others(spark):
    """Contracts without a discovery, or that were not canonical before, are not made canonical; a creation above the ancestor is forgotten."""
    c = spark.createDataFrame([("x", "dead", 12, "t", "u", 1), ("x", "old", 5, "t", "u", 1), ("x", "none", 12, "t", "u", 0), ("x", "two", 12, "t", "u", 1), ("y", "far", 12, "t", "u", 1)], "chain string, address string, created_block long, created_tx string, creator string, canonical int")
    d = spark.createDataFrame([("x", "dead", "s", 12, 1), ("x", "old", "s", 11, 1), ("x", "two", "s", 12, 1), ("x", "two", "t", 3, 1), ("y", "far", "s", 12, 1)], "chain string, address string, source string, observed_block long, canonical int")
    i = spark.createDataFrame([("x", 10, 20)], "chain string, ancestor long, end long")
    contracts, discoveries = reorg.quarantine(c, d, i)
    assert rows_of(contracts) == {("x", "dead", None, None, None, 0), ("x", "old", 5, "t", "u", 0), ("x", "none", 12, "t", "u", 0), ("x", "two", 12, "t", "u", 1), ("y", "far", 12, "t", "u", 1)}
    assert {(r.address, r.source) for r in discoveries.where("canonical = 0").collect()} == {("dead", "s"), ("old", "s"), ("two", "s")}


def test_hash_tree(spark):
    r = random.Random(4)
    rows = [(k, r.choice(["a", "b", None]), r.random()) for k in range(3000)]
    frame = lambda x: spark.createDataFrame(x, "k long, t string, v double")
    depth = hash_tree.leaf_depth(len(rows), per_leaf=64)
    assert depth == 2 and hash_tree.leaf_depth(10) == 0
    same = frame(r.sample(rows, len(rows))).repartition(7)
    root = lambda df: hash_tree.root(df, ["k"], depth).first()
    assert root(frame(rows)) == root(same)
    other = [(k, None if k == 5 else t, v) for k, t, v in rows if k != 77] + [(9999, "new", 0.0)]
    assert root(frame(other)) != root(frame(rows))
    trees = hash_tree.tree(frame(rows), ["k"], depth), hash_tree.tree(frame(other), ["k"], depth)
    assert 1 <= hash_tree.differing(*trees, depth).count() <= 3
    want = {(77, "lost"), (9999, "new")} | ({(5, "changed")} if rows[5][1] is not None else set())
    assert rows_of(hash_tree.changes(frame(rows), frame(other), ["k"], depth, trees)) == want
    assert hash_tree.changes(frame(rows), same, ["k"], depth).count() == 0 and hash_tree.root(frame([]), ["k"], 2).count() == 0


def test_replayed_stream_batch(spark, tmp_path):
    """A stream that dies after its batch was written runs it again when it is started again, and nothing changes twice."""
    path = str(tmp_path / "s")
    run = sinks.upsert_batches(f"{path}/table", lambda old, new: merge.merge(old, new, ["k"], {"n": "last"}))
    calls = []

    def dies_once(batch, batch_id):
        calls.append(batch_id)
        run(batch, batch_id)
        if len(calls) == 2:
            raise RuntimeError("lost after the batch")

    def start():
        stream = spark.readStream.schema("k long, n long").option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
        q = stream.writeStream.foreachBatch(dies_once).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
        q.awaitTermination()

    for k in range(2):
        spark.createDataFrame([(1, k), (k + 2, k)], "k long, n long").coalesce(1).write.mode("append").parquet(f"{path}/in")
    with pytest.raises(Exception, match="lost after the batch"):
        start()
    start()
    assert calls == [0, 1, 1] and rows_of(sinks.read_snapshot(spark, f"{path}/table")) == {(1, 1), (2, 0), (3, 1)}


def test_incident_folds():
    """The state of a rule after each sample, without a stream."""
    fresh = lambda: {"opened_at": None, "repeats": 0, "mark": None, "times": [], "values": [], "others": []}
    s = 1_000_000
    rule, state = incidents.Threshold(above=10, window=60, least_span=30, below=5, calm_window=40, calm_span=20), fresh()
    feed = lambda t, v, o=None, up=True: list(rule.fold(state, [(t, t * s, v, o, up)]))
    assert feed(0, 20) == [] and feed(20, 20) == [] and feed(30, None) == []
    assert feed(40, 20) == [(40 * s, None, 1)] and feed(50, 8) == [(40 * s, None, 1)]
    assert feed(100, 1) == [(40 * s, None, 1)] and feed(120, 2) == [(40 * s, 120 * s, 1)] and feed(130, 3) == []
    rule, state = incidents.Stall(age=100), fresh()
    assert feed(0, 7, 10) == [] and feed(50, 7, 11) == [] and feed(120, 7, 12) == [(120 * s, None, 1)]
    assert feed(150, 7, 12) == [(120 * s, None, 2)]  # the head at 50 was lower
    assert feed(170, 7, 99, False) == [(120 * s, None, 2)]  # losing the endpoint is no recovery
    assert feed(180, 8, 99) == [(120 * s, 180 * s, 2)] and feed(200, 8, 100) == []


def test_bucket_percentile(spark):
    """Within its error of the exact percentile by nearest rank, for values over ten powers of ten."""
    r = random.Random(7)
    groups = {k: [10 ** r.uniform(-3, 7) for _ in range(r.randint(1, 300))] for k in range(20)} | {99: [0.0, 0.0, 5.0]}
    df = spark.createDataFrame([(k, v) for k, x in groups.items() for v in x], "k long, v double")
    counts = df.groupBy("k", jobs.latency_bucket(F.col("v")).alias("bucket")).agg(F.count("*").alias("n")).groupBy("k").agg(F.collect_list(F.struct("bucket", "n")).alias("c"))
    for row in counts.select("k", jobs.bucket_percentile(F.col("c"), 0.95).alias("p"), jobs.bucket_percentile(F.col("c"), 0.5).alias("m")).collect():
        own = sorted(groups[row.k])
        for got, share in ((row.p, 95), (row.m, 50)):
            exact = own[-(-len(own) * share // 100) - 1]
            assert abs(got - exact) <= 0.0100001 * exact


def test_classes(spark):
    parts = spark.createDataFrame([("a", 10.0, "complete", "verified"), ("a", 5.0, "absent", None), ("b", 1.0, "complete", "history_unknown"), ("c", 99.0, "partial", "verified")], "address string, total_usd double, status string, coverage string")
    assert rows_of(settle.classes(parts, "address", 50.0)) == {("a", 15.0, "below"), ("b", 1.0, "incomplete"), ("c", 99.0, "qualifying")}
    assert rows_of(settle.classes(parts, "address", 50.0, coverage=False)) == {("a", 15.0, "below"), ("b", 1.0, "below"), ("c", 99.0, "qualifying")}


def test_rates_over_chunks(spark):
    """A sample follows the one before it, also over the border of a chunk and over chunks without samples."""
    r = random.Random(2)
    ids = sorted(r.sample(range(400), 60))
    rows = [("k" if i % 3 else "j", i, 1_700_000_000 + 60 * i, i * i) for i in ids]
    df = spark.createDataFrame(rows, "k string, id long, t long, v long").withColumn("ts", F.timestamp_seconds("t"))
    want, last = {}, {}
    for k, i, t, v in rows:
        want[i] = None if k not in last else (v - last[k][1]) * 3600 / (t - last[k][0])
        last[k] = (t, v)
    for chunk in (7, 50, 1000):
        got = telemetry._before(df, ["k"], "id", ["ts", "v"], chunk).collect()
        assert len(got) == 60 and all((x["__b"] is None) == (want[x.id] is None) for x in got)
        assert all(x["__b"] is None or abs((x.v - x["__b"]["v"]) * 3600 / (x.ts - x["__b"]["ts"]).total_seconds() - want[x.id]) < 1e-6 for x in got)
    assert {x.id: x.rate for x in telemetry.rates(df, ["k"], "v").collect()} == {i: None if v is None else pytest.approx(v) for i, v in want.items()}

"""Steps whose cost grew faster than the tables, and results that must not change with them."""

import os

import duckdb
import pytest
from compare import TABLES, connect, differences
from conftest import SF
from pyspark.sql import functions as F

from tidewatch.queries import registry


def _files(folder):
    return [f for f in os.listdir(folder) if f.startswith("part-")]


def test_streamed_parts_keep_their_tasks(spark, tmp_path):
    """A part lands as one file a task, and its files are one batch."""
    from tidewatch.queries import landed

    batches = []
    landed._streamed(spark, str(tmp_path), [spark.range(0, 100, 1, 4), spark.range(100, 130, 1, 3), spark.range(0)], lambda rows, k: batches.append((k, rows.count(), rows.agg(F.min("id")).first()[0])))
    assert len(_files(tmp_path / "in")) >= 7  # before, one a part
    assert batches == [(0, 100, 0), (1, 30, 100), (2, 0, None)]


def test_live_days_keep_their_tasks(spark, monkeypatch):
    """Each day is one batch, of more than one file."""
    from tidewatch.queries import streams
    from tidewatch.streaming import live

    seen, real = [], live.discovery_batches

    def recorded(*args):
        run = real(*args)

        def batch(rows, k):
            seen.append((rows.select(F.to_date("ts")).distinct().count(), rows.select(F.input_file_name()).distinct().count()))
            run(rows, k)

        return batch

    monkeypatch.setattr(streams.live, "discovery_batches", recorded)
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # which would put rows of so small tables into one task
    try:
        streams.live_discovery(spark, SF)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert [days for days, _ in seen] == [1] * 5
    assert min(files for _, files in seen) > 1  # before, one


def _brute(rows, window, keys):
    out = {}
    for r in rows:
        frame = [x for x in rows if all(x[k] == r[k] for k in keys) and ((x["at"] is None and r["at"] is None) or (None not in (x["at"], r["at"]) and r["at"] - window <= x["at"] <= r["at"]))]
        v = [x["v"] for x in frame if x["v"] is not None]
        out[r["id"]] = (min(v, default=None), max(v, default=None), sum(v) if v else None, len(frame))
    return out


@pytest.mark.parametrize("window", [0, 1, 7, 1000])
def test_frames_equal_brute_force(spark, window):
    import random

    from tidewatch.operators import telemetry

    r = random.Random(window)
    rows = [{"id": i, "k": r.choice(["a", "b", None]), "at": r.choice([None, r.randrange(-30, 30)]) if i % 9 == 0 else r.randrange(-30, 30), "v": r.choice([None, 1, 5, 9, 14])} for i in range(150)]
    df = spark.createDataFrame([(x["id"], x["k"], x["at"], x["v"]) for x in rows], "id int, k string, at bigint, v bigint")
    for keys in (["k"], []):
        v = F.col("v")
        out = telemetry._frames(df, keys, F.col("at"), window, lo=("min", v), hi=("max", v), total=("sum", v), n=("count", F.lit(1)))
        assert {x["id"]: (x["lo"], x["hi"], x["total"], x["n"]) for x in out.collect()} == _brute(rows, window, keys)


def test_frames_are_running(spark):
    """No frame slides over the rows of a window."""
    from tidewatch.operators import telemetry

    df = spark.createDataFrame([(1, "a", "none", 3, 4)], "id int, chain string, active_rpc string, c int, p int").withColumn("ts", F.current_timestamp())
    for out in (telemetry.counter_stall(df, ["chain"], "c", "p"), telemetry.growth_alert(df, ["chain"], "c", "p"), telemetry.outages(df, ["chain"]), telemetry.rate_budget(df, 5, 5)):
        text = out._jdf.queryExecution().optimizedPlan().toString()
        assert "RangeFrame, -" not in text and "unboundedpreceding" in text, text  # before, frames began at a time before the row's own


def test_log_files_stay_few(spark, tmp_path, monkeypatch):
    """With ten times as many blocks logs lie in as many files, and the range is the same as in SQL."""
    from tidewatch.queries import landed

    far = tmp_path / "far"
    far.mkdir()
    for t in TABLES:
        os.symlink(f"{SF}/{t}.parquet", far / f"{t}.parquet") if t != "lineitem" else None
    duckdb.sql(f"COPY (SELECT * REPLACE (l_orderkey * 100 AS l_orderkey) FROM '{SF}/lineitem.parquet') TO '{far}/lineitem.parquet' (FORMAT parquet)")
    monkeypatch.setattr(landed.jobs, "scratch", lambda spark, name: str(tmp_path / name))
    rows, ours, theirs = differences(landed.landed_logs(spark, str(far)), registry.oracle_sql()["landed_logs"], connect(str(far)))
    top = connect(str(far)).execute("SELECT max(l_orderkey) // 5 FROM lineitem").fetchone()[0]
    assert top > 20_000
    assert not ours and not theirs, (rows, ours, theirs)
    assert all(len(os.listdir(c)) <= 202 for c in (tmp_path / "logs" / "rows").glob("chain=*"))  # before, one for each 100 blocks


def test_words_of_all_sizes_are_exact(spark):
    """Decimal text of words around each border; short ones go without long arithmetic."""
    from tidewatch.functions import scalars as S

    values = sorted({max(0, min((1 << 256) - 1, (1 << k) + d)) for k in (0, 4, 31, 32, 59, 60, 61, 63, 64, 119, 120, 121, 124, 128, 200, 255, 256) for d in (-1, 0, 1)} | {10**27 + 7, 16**15 * 3})
    df = spark.createDataFrame([(f"0x{v:064x}" if i % 2 else f"0x{v:064X}", str(v)) for i, v in enumerate(values)] + [("0x12", None), ("0x" + "g" * 64, None), (None, None)], "c string, want string")
    bad = df.select("c", "want", S.abi_uint256_decimal(F.col("c")).alias("have")).where("not (have <=> want)").collect()
    assert not bad, bad


def test_short_words_need_no_long_arithmetic(spark):
    """20,000 words of an amount; before, each took the arithmetic of 72 limbs."""
    import time

    from tidewatch.functions import scalars as S

    rows = spark.range(0, 20_000, 1, 2).select(F.concat(F.lit("0x"), F.lpad(F.lower(F.hex("id")), 64, "0")).alias("c")).cache()
    rows.count()
    slow = rows.select(F.concat(F.lit("0x1"), F.substring("c", 4, 63)).alias("c"))

    def took(df):
        began = time.perf_counter()
        df.select(S.abi_uint256_decimal(F.col("c")).alias("x")).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - began

    took(rows), took(slow)
    assert took(rows) < took(slow) / 2

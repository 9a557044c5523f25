"""Steps that shuffled more than they had to, and results that must not change with them."""

import re

from conftest import SF
from pyspark.sql import functions as F

from tidewatch.plans import fixtures


def _exchanges(df):
    """Columns that each shuffle of a plan is dealt by."""
    return re.findall(r"hashpartitioning\(([^)]*)\)", df._jdf.queryExecution().executedPlan().toString())


def _small(spark, tmp_path):
    """The smallest tables with a tenth of the lines twice."""
    import os

    for t in fixtures.BASE:
        if t != "lineitem":
            os.symlink(f"{SF}/{t}.parquet", tmp_path / f"{t}.parquet")
    rows = spark.read.parquet(f"{SF}/lineitem.parquet")
    rows.unionByName(rows.where("l_orderkey % 10 = 3")).write.parquet(str(tmp_path / "lineitem.parquet"))
    return str(tmp_path)


def test_distinct_rows_by_keys(spark, tmp_path, monkeypatch):
    """Views of distinct rows have the rows of their texts and shuffle keys, no texts."""
    folder = _small(spark, tmp_path)
    for name, words in (("fx_tx", "chain|tx_hash|from_addr|to_addr"), ("fx_policies", "chain|address|asset")):
        ours = fixtures.view(spark, folder, name)
        plan = _exchanges(ours)
        assert plan and not any(re.search(words, x) for x in plan), plan  # before, dealt by all their texts
        with monkeypatch.context() as m:
            m.setattr(fixtures, "KEYS", {})
            text = fixtures.view(spark, folder, name)
        assert ours.dtypes == text.dtypes
        a, b = (sorted(map(tuple, x.select(*(F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in x.columns)).collect())) for x in (ours, text))
        assert a and a == b


def test_packed_texts_come_back(spark):
    from tidewatch.functions import scalars as S

    texts = [None, "", "0x", "0xab", "0xAB", "0xabc", "0xab\n", "0xabcd\n", "0x0", "0xzz", "ab", "native", "é", "0x" + "0f" * 20, "0x" + "0F" * 20, "0xabABab", "\x01\xab", "0x é"]
    df = spark.createDataFrame([(x,) for x in texts], "c string").select("c", S.packed(F.col("c")).alias("b")).select("*", S.unpacked(F.col("b")).alias("back"))
    rows = df.collect()
    assert all(r.c == r.back for r in rows), rows
    assert len({bytes(r.b) for r in rows if r.c is not None}) == len(texts) - 1
    assert {len(r.b) for r in rows if r.c and len(r.c) == 42} == {21, 43}


def test_valued_tokens_are_dealt_by_bytes(spark):
    """Joins of balances shuffle bytes of addresses; before, their texts."""
    from tidewatch.queries import valuation

    kinds = dict(valuation.valued_keys(spark, SF).dtypes)
    assert kinds["address"] == kinds["token"] == "binary"
    text = valuation.token_state_merge(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("Join LeftAnti") == 1 and text.count("Join LeftOuter") == 4, text  # before, two and four, with a shuffle of all rows between them


def test_discoveries_and_tokens_are_worked_out_once(spark):
    """What a query asks for many times is read back, not made from lines again."""
    from tidewatch.queries import discovery, settled

    for query in (discovery.reorg_quarantine, settled.tokens_refreshed):
        text = query(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
        assert "l_orderkey" not in text, text  # before, lines were read up to twenty times


def test_rows_without_those_gone(spark):
    from tidewatch.operators import settle

    key = ["chain", "address", "token"]
    rows = spark.createDataFrame([("c0", "0xab", "0xcd", 1), ("c0", "0xab", "0xcd", 2), ("c0", "0xab", "native", 3), ("c1", "0xab", "0xcd", 4), (None, "0xab", "0xcd", 5), ("c0", "0xab", None, 6)], "chain string, address string, token string, n int")
    gone = spark.createDataFrame([("c0", "0xab", "0xcd"), ("c0", "0xab", "0xcd"), (None, "0xab", "0xcd"), ("c0", "0xab", None)], "chain string, address string, token string")
    out = settle._without(rows, gone, key)
    assert out.columns == rows.columns
    assert sorted(r.n for r in out.collect()) == sorted(r.n for r in rows.join(gone, key, "left_anti").collect()) == [3, 4, 5, 6]


def test_tasks_of_first_rows_grow_with_lines(spark, monkeypatch):
    """Both shuffles of refresh_items have as many tasks as its lines ask for; before, as many as any."""
    from compare import connect, differences

    from tidewatch.queries import more, registry

    assert fixtures.tasks_for(spark.range(1001), 100) == 11 and fixtures.tasks_for(spark.range(5), 100) == 4
    monkeypatch.setattr(more, "tasks_for", lambda rows: 9)
    out = more.refresh_items(spark, SF)
    assert {x.split(", ")[-1] for x in _exchanges(out)} == {"9"}
    rows, ours, theirs = differences(out, registry.oracle_sql()["refresh_items"], connect(SF))
    assert rows and not ours and not theirs


def test_ids_are_as_before(spark):
    from tidewatch.functions import scalars as S

    def plainly(c):
        low = F.lower(F.trim(c))
        digits = F.when(F.startswith(low, F.lit("0x")), F.substring(low, 3, 1 << 30)).otherwise(low)
        return F.when(F.length(digits).between(1, 64) & (F.translate(digits, "0123456789abcdef", "") == ""), F.concat(F.lit("0x"), F.lpad(digits, 64, "0")))

    texts = [None, "", " ", "0", "x", "0x", "0X", "0x ", " 0X2 ", "2", "aB", "0xg", "0xé", "é", "0x0x1", "1x", "a b", "0x\n", "0x1\n", "-1", "+1", "0x１", "0x" + "f" * 64, "F" * 64, "0x" + "f" * 65, "0x0" + "f" * 64, "0" * 65, "f" * 66]
    df = spark.createDataFrame([(x,) for x in texts], "c string")
    rows = df.select("c", plainly(F.col("c")).alias("want"), S.sui_id(F.col("c")).alias("one"), F.transform(F.array("c"), S.sui_id)[0].alias("inside")).collect()
    assert all(r.want == r.one == r.inside for r in rows), [r for r in rows if not r.want == r.one == r.inside]

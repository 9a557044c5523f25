"""Places in an order over all rows, without a sorted task a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.operators.reorg import dimension
from tidewatch.streaming.jobs import scratch


def places(rows: DataFrame, keys: list[str], order: list[Column], name: str = "place") -> DataFrame:
    """rows with their place, from 1, in the order of their keys; order ends in unique columns.

    Rows are dealt by ranges of keys and order and written once, sorted; a row's place is its number
    among those of its task and key, on top of what the tasks before hold.  These counts are a row a
    task and key, so a key with a third of all rows is no heavier for a task than others.
    """
    spark = rows.sparkSession
    marks = [f"__o{i}" for i in range(len(order))]
    laid = rows.select("*", *(o.alias(m) for o, m in zip(order, marks)))
    by = [*map(F.col, keys), *(F.col(m).asc_nulls_first() for m in marks)]
    path = scratch(spark, "places")
    laid.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("__at", F.monotonically_increasing_id()).withColumn("__task", F.shiftright("__at", 33)).write.parquet(path)
    laid = spark.read.parquet(path)
    runs = laid.groupBy("__task", *keys).agg(F.min("__at").alias("__begin"), F.count("*").alias("__n"))
    before = Window.partitionBy(*keys).orderBy("__task").rowsBetween(Window.unboundedPreceding, -1)
    shift = F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__begin") + 1
    runs = runs.select("__task", *keys, shift.alias("__shift"))
    return laid.join(dimension(runs), ["__task", *keys]).withColumn(name, F.col("__at") + F.col("__shift")).drop("__task", "__at", "__shift", *marks)

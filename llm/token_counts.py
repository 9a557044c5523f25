"""Exact length histogram: documents by encoded length; suffix sums answer every context limit."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from llm.common import slices
from llm.encoding import default_tokenizer, encoder


def length_counts(df: DataFrame, text_column: str = "text", tokenizer_path: str | None = None) -> DataFrame:
    """(length, n_docs): how many texts have each number of ids.  Null counts as empty, of length 0.

    Every task counts its own texts first; only a row for each length and task is shuffled.  Repeated
    rows count each; whole texts count, however long; an empty table gives no rows; other columns don't
    matter.
    """
    path = tokenizer_path or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, seen = encoder(path), Counter()
        for batch in batches:
            for part in slices(batch, "text"):
                seen.update(np.diff(own.encode_column(part.column("text"))[1]).tolist())
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int64()), pa.array(list(seen.values()), pa.int64())], ["length", "n_docs"])

    counted = df.select(df[text_column].alias("text")).mapInArrow(run, "length long, n_docs long")
    return counted.groupBy("length").agg(F.sum("n_docs").alias("n_docs"))


def length_table(counts: DataFrame, width: int = 1024) -> DataFrame:
    """Cumulative table over (length, n_docs), a row for each length that occurs.

    docs_at_most and tokens_at_most include the length itself; docs_longer are the documents that a
    context limit of this length cuts; truncated_tokens is what is left of all documents at that
    limit; total_docs and total_tokens are for the whole corpus; quantile is the share of documents of
    at most this length.  Sums run within blocks of width lengths and over the blocks, so that no
    task sees all lengths.
    """
    rows = counts.where("n_docs > 0").withColumn("block", F.floor(F.col("length") / width))
    blocks = rows.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum(F.col("n_docs") * F.col("length")).alias("t"))
    order = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = blocks.select(
        "block",
        F.coalesce(F.sum("d").over(order), F.lit(0)).alias("d0"),
        F.coalesce(F.sum("t").over(order), F.lit(0)).alias("t0"),
        F.sum("d").over(whole).alias("total_docs"),
        F.sum("t").over(whole).alias("total_tokens"),
    )
    own = Window.partitionBy("block").orderBy("length").rowsBetween(Window.unboundedPreceding, 0)
    return (
        rows.join(before, "block")
        .withColumn("docs_at_most", F.col("d0") + F.sum("n_docs").over(own))
        .withColumn("tokens_at_most", F.col("t0") + F.sum(F.col("n_docs") * F.col("length")).over(own))
        .withColumn("docs_longer", F.col("total_docs") - F.col("docs_at_most"))
        .withColumn("truncated_tokens", F.col("tokens_at_most") + F.col("length") * F.col("docs_longer"))
        .withColumn("quantile", F.col("docs_at_most") / F.col("total_docs"))
        .select("length", "n_docs", "docs_at_most", "tokens_at_most", "docs_longer", "truncated_tokens", "total_docs", "total_tokens", "quantile")
    )


def at_limits(table: DataFrame, limits: DataFrame) -> DataFrame:
    """Truncated totals for any limits (column context_limit), also between lengths that occur.

    A limit takes the row of the greatest length not above it; below the least length every
    document is cut.  Null limits give null answers.
    """
    w = Window.partitionBy("context_limit")
    low = limits.select("context_limit").distinct().join(F.broadcast(table.agg(F.max("total_docs").alias("n"))))
    near = low.join(table, table["length"] <= low["context_limit"], "left")
    pick = near.withColumn("best", F.max("length").over(w)).where(F.col("best").isNull() | (F.col("length") == F.col("best")))
    longer = F.coalesce("docs_longer", "n")
    return pick.select(
        "context_limit",
        F.coalesce("docs_at_most", F.lit(0)).alias("docs_at_most"),
        F.when(F.col("context_limit").isNotNull(), F.coalesce("tokens_at_most", F.lit(0)) + F.col("context_limit") * longer).alias("truncated_tokens"),
    )


def length_quantile(table: DataFrame, q: float) -> DataFrame:
    """The least length such that at least the share q of documents is not longer: one row, length."""
    return table.where(F.col("docs_at_most") >= F.lit(q) * F.col("total_docs")).agg(F.min("length").alias("length"))

"""Shared helpers: scratch tables in the cluster's shared folder, batch slicing, connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words in this folder: space and U+0009 to U+000D.
WORD_SPACE_RE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Local folders that stand in for the shared one, by application.
_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir, which driver and executors share, as a full address.

    Only where the setting is absent (tests, one machine) a local temporary folder stands in; the
    setting itself is left alone.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        own = spark.sparkContext.applicationId
        if own not in _LOCAL:
            _LOCAL[own] = "file://" + tempfile.mkdtemp(prefix="llm-")
        root = _LOCAL[own]
    return f"{qualified(spark, root).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def qualified(spark: SparkSession, path: str) -> str:
    """path with its file system: a path without one belongs to Spark's default, not to an executor's own disk."""
    own = spark._jvm.org.apache.hadoop.fs.Path(path)
    return own.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(own).toString()


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: cuts lineage and survives lost executors."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    # shuffle files of a finished job go when the driver collects its garbage: now, not when the heap is full
    df.sparkSession._jvm.System.gc()
    return df.sparkSession.read.schema(df.schema).parquet(path)


def gathered(parts: Iterable[DataFrame], name: str) -> DataFrame:
    """Write frames of the same columns one after the other into one shared folder and read it back: shuffle files of each go before the next is worked out."""
    path, last = None, None
    for last in parts:
        path = path or shared_dir(last.sparkSession, name)
        last.write.mode("append").parquet(path)
        last.sparkSession._jvm.System.gc()
    return last.sparkSession.read.schema(last.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Remove the folders of a table that materialize() wrote, when nothing will read it any more."""
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def slices(batch: pa.RecordBatch, column: str, max_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that the texts of a slice hold about max_bytes, at least one row each."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    start = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > max_bytes:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield batch.slice(start)


def components(edges: DataFrame, a: str = "a", b: str = "b", name: str = "components") -> DataFrame:
    """Connected components by alternating large-star and small-star rounds.

    edges: pairs of comparable ids; null ends and loops are ignored.  Returns (id, component_id) for
    every id in a proper edge; component_id is the smallest id reachable.  Each round is written to
    the shared folder; nothing but two numbers a round reaches the driver.
    """
    pairs = (
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") != F.col("v")))
        .distinct()
    )
    pairs = materialize(pairs, name)
    before = None
    while True:
        mark = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == before:
            break
        before = mark
        both = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        near = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(near, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
        pairs = materialize(small.union(near.select("u", "m")).distinct(), name)
    roots = pairs.select(F.col("v").alias("id"), F.col("v").alias("component_id")).distinct()
    return roots.union(pairs.select("u", "v"))

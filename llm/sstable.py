"""Sorted-string-table shards of token ids.

A file is a run of blocks, then a sparse index with one entry a block, a Bloom filter over all keys,
and a footer of fixed size.  Keys rise through the file.  Within a block an entry stores how many
bytes its key shares with the one before, so keys are prefix-compressed; the first entry of a block
has its whole key.  A value is a byte with the width of its ids, 2 or 4, and then the ids as little-endian
unsigned integers of that width: 2 where all of them fit.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from llm.common import qualified, slices
from llm.encoding import default_tokenizer, encoder

MAGIC = b"IDSST\x00\x02\n"
ENTRY = struct.Struct("<III")  # shared key bytes, further key bytes, value bytes
INDEX = struct.Struct("<IQIIQI")  # key bytes, offset, bytes, entries, ids before, crc32
FOOTER = struct.Struct("<QQQIIQQ8s")  # index offset, bloom offset, bloom bytes, probes, blocks, keys, ids, magic


def key_bytes(key: int | str | None) -> bytes:
    """Order-preserving: nulls first, then integers by value, or strings by UTF-8."""
    if key is None:
        return b"\x00"
    if isinstance(key, str):
        return b"\x02" + key.encode()
    return b"\x01" + (key + (1 << 63)).to_bytes(8, "big")


def key_value(key: bytes) -> int | str | None:
    if key[0] == 0:
        return None
    return key[1:].decode() if key[0] == 2 else int.from_bytes(key[1:], "big") - (1 << 63)


def packed(ids: bytes) -> bytes:
    """32-bit ids as a stored value."""
    wide = np.frombuffer(ids, "<u4")
    return b"\x02" + wide.astype("<u2").tobytes() if wide.max(initial=0) <= 0xFFFF else b"\x04" + ids


def unpacked(value: bytes) -> bytes:
    """32-bit ids of a stored value."""
    return value[1:] if value[0] == 4 else np.frombuffer(value, "<u2", offset=1).astype("<u4").tobytes()


def filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


class Writer:
    """Writes one file; keys must rise, equal keys may follow each other."""

    def __init__(self, uri: str, block_bytes: int = 1 << 16, bits_per_key: int = 10):
        self.fs, self.path = filesystem(uri)
        self.fs.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.out = self.fs.open_output_stream(self.path + ".part")
        self.block_bytes, self.bits = block_bytes, bits_per_key
        self.block, self.first, self.entries, self.before = bytearray(), b"", 0, b""
        self.index, self.hashes = bytearray(), []
        self.at = self.ids = self.block_ids = self.blocks = 0

    def add(self, key: bytes, ids: bytes) -> None:
        """ids: little-endian, 32 bits each."""
        value = packed(ids)
        if not self.block:
            self.first, self.before, self.block_ids = key, b"", self.ids
        shared = 0
        for a, b in zip(key, self.before):
            if a != b:
                break
            shared += 1
        self.block += ENTRY.pack(shared, len(key) - shared, len(value)) + key[shared:] + value
        self.entries += 1
        self.before = key
        self.ids += len(ids) // 4
        self.hashes.append(xxhash.xxh3_128_intdigest(key))
        if len(self.block) >= self.block_bytes:
            self._flush()

    def _flush(self) -> None:
        if self.block:
            self.index += INDEX.pack(len(self.first), self.at, len(self.block), self.entries, self.block_ids, zlib.crc32(self.block)) + self.first
            self.out.write(bytes(self.block))
            self.at += len(self.block)
            self.blocks += 1
            self.block, self.entries = bytearray(), 0

    def close(self) -> int:
        """Finish the file and give it its name; returns its bytes."""
        self._flush()
        probes, size = 7, max(64, len(self.hashes) * self.bits)
        bloom = bytearray((size + 7) // 8)
        for h in self.hashes:
            for bit in _bits(h, probes, len(bloom) * 8):
                bloom[bit >> 3] |= 1 << (bit & 7)
        self.out.write(bytes(self.index))
        self.out.write(bytes(bloom))
        self.out.write(FOOTER.pack(self.at, self.at + len(self.index), len(bloom), probes, self.blocks, len(self.hashes), self.ids, MAGIC))
        self.out.close()
        self.fs.move(self.path + ".part", self.path)
        return self.at + len(self.index) + len(bloom) + FOOTER.size


def _bits(h: int, probes: int, size: int) -> Iterator[int]:
    a, b = h & (1 << 64) - 1, h >> 64 | 1
    return ((a + k * b) % size for k in range(probes))


class Reader:
    def __init__(self, uri: str):
        system, path = filesystem(uri)
        self.file = system.open_input_file(path)
        size = self.file.size()
        foot = self.file.read_at(FOOTER.size, size - FOOTER.size)
        index, bloom, bloom_bytes, self.probes, blocks, self.keys, self.ids, magic = FOOTER.unpack(foot)
        if magic != MAGIC:
            raise ValueError(f"{uri} is no table of this format")
        raw = self.file.read_at(bloom - index, index)
        self.bloom = self.file.read_at(bloom_bytes, bloom)
        self.blocks, self.firsts, at = [], [], 0
        for _ in range(blocks):
            n, *entry = INDEX.unpack_from(raw, at)
            self.firsts.append(bytes(raw[at + INDEX.size : at + INDEX.size + n]))
            self.blocks.append(entry)
            at += INDEX.size + n

    def may_hold(self, key: bytes) -> bool:
        return all(self.bloom[b >> 3] >> (b & 7) & 1 for b in _bits(xxhash.xxh3_128_intdigest(key), self.probes, len(self.bloom) * 8))

    def block(self, k: int) -> Iterator[tuple[bytes, int, bytes]]:
        """(key, number of ids in this file before it, its ids) of the entries of block k."""
        offset, size, entries, ids, crc = self.blocks[k]
        raw = self.file.read_at(size, offset)
        if zlib.crc32(raw) != crc:
            raise ValueError(f"block {k} is damaged")
        at, key = 0, b""
        for _ in range(entries):
            shared, more, n = ENTRY.unpack_from(raw, at)
            at += ENTRY.size
            key = key[:shared] + raw[at : at + more]
            value = unpacked(raw[at + more : at + more + n])
            yield key, ids, value
            at += more + n
            ids += len(value) // 4

    def scan(self) -> Iterator[tuple[bytes, int, bytes]]:
        for k in range(len(self.blocks)):
            yield from self.block(k)

    def get(self, key: bytes) -> list[bytes]:
        """ids of all entries of a key: Bloom filter, then binary search in the sparse index, then one block or more."""
        found: list[bytes] = []
        if self.may_hold(key):
            k = max(0, bisect_right(self.firsts, key) - 1)
            while k and self.firsts[k] == key:
                k -= 1  # equal keys can begin in an earlier block
            while k < len(self.blocks) and self.firsts[k] <= key:
                found += [v for at, _, v in self.block(k) if at == key]
                k += 1
        return found


def write_tables(
    df: DataFrame, folder: str, id_column: str = "doc_id", text_column: str = "text", end_id: int | None = 2, tokenizer_path: str | None = None, block_bytes: int = 1 << 16, file_bytes: int = 1 << 30
) -> DataFrame:
    """Encode every text and write it into sorted tables under folder; returns their manifest.

    Rows are dealt by ranges of the id, so file follows file in ascending order; a null id comes
    first; equal ids are ordered by their text and all kept.  A null text is empty; end_id follows
    each document's ids.  Each task attempt writes files of its own names, a new one after about
    file_bytes, and only files of attempts that Spark accepted are in the manifest (folder/manifest,
    Parquet): file, docs, tokens, first_key, last_key, and start, the ids in all files before it.  Whole
    texts count, however long; an empty table gives an empty manifest; other columns don't matter.  A
    folder without a file system belongs to Spark's default one.
    """
    spark, path = df.sparkSession, tokenizer_path or default_tokenizer()
    folder = qualified(spark, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, writer, docs, first, place = encoder(path), None, 0, b"", 0
        tail = b"" if end_id is None else struct.pack("<I", end_id)
        part, uri, key = TaskContext.get().partitionId(), "", b""
        names = ["part", "place", "file", "docs", "tokens", "bytes", "first_key", "last_key"]

        def done() -> pa.RecordBatch:
            size = writer.close()
            return pa.RecordBatch.from_pydict(dict(zip(names, [[part], [place], [uri], [docs], [writer.ids], [size], [first], [key]])))

        for batch in batches:
            for rows in slices(batch, "text"):
                for k, ids in zip(rows.column("id").to_pylist(), own.encode(rows.column("text"))):
                    if writer is not None and writer.at >= file_bytes:
                        yield done()
                        writer, docs, place = None, 0, place + 1
                    key = key_bytes(k)
                    if writer is None:
                        uri, first = f"{folder}/data/{part:06d}-{place:06d}-{uuid.uuid4().hex}.sst", key
                        writer = Writer(uri, block_bytes)
                    writer.add(key, ids + tail)
                    docs += 1
        if writer is not None:
            yield done()

    rows = df.select(df[id_column].alias("id"), df[text_column].alias("text")).repartitionByRange("id").sortWithinPartitions("id", "text")
    made = rows.mapInArrow(run, "part long, place long, file string, docs long, tokens long, bytes long, first_key binary, last_key binary")
    made.write.parquet(f"{folder}/written")
    manifest = spark.read.parquet(f"{folder}/written")
    before = Window.orderBy("part", "place").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    manifest.withColumn("start", F.coalesce(F.sum("tokens").over(before), F.lit(0))).write.parquet(f"{folder}/manifest")
    return spark.read.parquet(f"{folder}/manifest")


def read_tables(spark: SparkSession, folder: str, id_type: str = "long") -> DataFrame:
    """Scan the files back, block by block: (id, start, ids as little-endian bytes)."""
    folder = qualified(spark, folder)
    manifest = spark.read.parquet(f"{folder}/manifest").select("file", "start")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                table = Reader(uri)
                for k in range(len(table.blocks)):
                    keys, at, values = zip(*table.block(k))
                    kind = pa.int64() if id_type == "long" else pa.string()
                    yield pa.RecordBatch.from_arrays([pa.array(map(key_value, keys), kind), pa.array([start + x for x in at], pa.int64()), pa.array(values, pa.binary())], ["id", "start", "ids"])

    files = manifest.repartition(max(1, spark.sparkContext.defaultParallelism * 4), "file")
    return files.mapInArrow(run, f"id {id_type}, start long, ids binary")


def lookup(spark: SparkSession, folder: str, keys: DataFrame, id_type: str = "long") -> DataFrame:
    """Values of the given ids (column id): each goes to the files whose key range holds it, then by binary search."""
    folder = qualified(spark, folder)
    manifest = spark.read.parquet(f"{folder}/manifest").select("file", "first_key", "last_key")
    to_key = F.udf(lambda k: bytearray(key_bytes(k)), "binary")
    asked = keys.select("id").distinct().withColumn("key", to_key("id"))
    held = asked.join(manifest, (F.col("key") >= F.col("first_key")) & (F.col("key") <= F.col("last_key"))).select("file", "id", "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uri, table = None, None
        for batch in batches:
            for row in batch.to_pylist():
                if row["file"] != uri:
                    uri, table = row["file"], Reader(row["file"])
                found = table.get(row["key"])
                if found:
                    kind = pa.int64() if id_type == "long" else pa.string()
                    yield pa.RecordBatch.from_arrays([pa.array([row["id"]] * len(found), kind), pa.array(found, pa.binary())], ["id", "ids"])

    return held.repartition("file").sortWithinPartitions("file").mapInArrow(run, f"id {id_type}, ids binary")

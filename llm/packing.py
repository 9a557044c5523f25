"""Packing documents into windows of tokens by lexical retrieval.

Documents are laid out by a locality key (the least hash of their adjacent token pairs), so similar
ones come to the same shard.  A shard is a run of documents of bounded size with its own inverted
index, weighted by BM25 with document frequencies of the whole corpus.  A seed opens a window; the
index returns the unused documents nearest to it, which fill the window: first those that fit whole,
then the best one left is cut, and its tail seeds the next window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.common import materialize, slices
from llm.encoding import default_tokenizer, encoder

K1, B = 1.2, 0.75


def encode(docs: DataFrame, id_column: str, text_column: str, end_id: int, tokenizer_path: str | None) -> DataFrame:
    """(id, place, ids): ids with the end id, as little-endian bytes of 2 bytes each where all fit, else 4 (wide)."""
    path = tokenizer_path or default_tokenizer()
    id_type = docs.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            for part in slices(batch, "text"):
                place, wide, out = [], [], []
                for raw in own.encode(part.column("text")):
                    ids = np.append(np.frombuffer(raw, "<u4"), np.uint32(end_id))
                    pair = ids[:-1].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + ids[1:] * np.uint64(0xC2B2AE3D27D4EB4F)
                    place.append(int((pair ^ (pair >> np.uint64(29))).min() >> np.uint64(1)) if len(pair) else 0)
                    wide.append(bool(ids.max() > 0xFFFF))
                    out.append(ids.tobytes() if wide[-1] else ids.astype("<u2").tobytes())
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(place, pa.int64()), pa.array(wide), pa.array(out, pa.binary())], ["id", "place", "wide", "ids"])

    rows = docs.select(docs[id_column].alias("id"), docs[text_column].alias("text"))
    return rows.mapInArrow(run, f"id {id_type}, place long, wide boolean, ids binary")


def unpacked(raw: bytes, wide: bool) -> np.ndarray:
    return np.frombuffer(raw, "<u4" if wide else "<u2")


def distinct(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ids, rising, and how often each occurs."""
    s = np.sort(ids, kind="stable")
    first = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
    return s[first].astype(np.int64), np.diff(np.r_[first, len(s)])


def corpus_statistics(encoded: DataFrame) -> tuple[np.ndarray, int, float]:
    """Document frequency by id, documents, mean length: counts over all documents; a row an id and task is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, docs, tokens = np.zeros(1 << 16, np.int64), 0, 0
        for batch in batches:
            for raw, wide in zip(batch.column("ids").to_pylist(), batch.column("wide").to_pylist()):
                ids = unpacked(raw, wide)
                t = distinct(ids)[0]
                if t[-1] >= len(df):
                    df = np.append(df, np.zeros(int(t[-1]) + 1 - len(df), np.int64))
                df[t] += 1
                docs += 1
                tokens += len(ids)
        at = np.flatnonzero(df)
        keys = np.r_[at, -1, -2]
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.r_[df[at], docs, tokens])], ["token", "n"])

    counts = encoded.select("wide", "ids").mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).toArrow()  # at most a row an id of the vocabulary
    token, n = counts["token"].to_numpy(), counts["n"].to_numpy()
    df = np.zeros(max(2, int(token.max(initial=0)) + 1), np.int64)
    df[token[token >= 0]] = n[token >= 0]
    docs, tokens = int(n[token == -1].sum()), int(n[token == -2].sum())
    return df, docs, tokens / max(1, docs)


class Index:
    """BM25 inverted index of a shard: for each token the documents that hold it and their weights."""

    def __init__(self, docs: list[np.ndarray], idf: np.ndarray, mean: float):
        self.terms = []
        doc, token, weight = [], [], []
        for d, ids in enumerate(docs):
            t, tf = distinct(ids)
            w = idf[t]
            heavy = w > 0  # tokens in more than half of all documents weigh nothing
            t, tf, w = t[heavy], tf[heavy], w[heavy]
            self.terms.append(t)
            doc.append(np.full(len(t), d, np.int32))
            token.append(t)
            weight.append(w * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(ids) / mean)))
        token = np.concatenate(token)
        order = np.argsort(token.astype(np.uint16) if not len(token) or token.max() < 1 << 16 else token, kind="stable")
        self.doc, self.weight = np.concatenate(doc)[order], np.concatenate(weight)[order]
        self.start = np.zeros(len(idf) + 1, np.int64)
        np.cumsum(np.bincount(token, minlength=len(idf)), out=self.start[1:])
        self.size = len(docs)

    def scores(self, terms: np.ndarray) -> np.ndarray:
        a, n = self.start[terms], self.start[terms + 1] - self.start[terms]
        total = int(n.sum())
        at = np.repeat(a - (np.cumsum(n) - n), n) + np.arange(total)
        return np.bincount(self.doc[at], self.weight[at], minlength=self.size)


class Packer:
    """Fills windows one after the other; pieces come out as (row, start, length, sequence, offset)."""

    def __init__(self, window: int):
        self.window = window
        self.sequence = 0
        self.open: list[tuple[object, int, int]] = []  # (row, start, length) in the open window
        self.filled = 0
        self.seed: np.ndarray | None = None  # the seed's terms

    def put(self, row: object, start: int, length: int) -> Iterator[tuple[object, int, int, int, int]]:
        self.open.append((row, start, length))
        self.filled += length
        if self.filled == self.window:
            yield from self.close()

    def close(self) -> Iterator[tuple[object, int, int, int, int]]:
        """Cut what is open into sequences whose lengths are powers of two, the largest first: nothing is padded."""
        pieces = self.open[::-1]
        left, self.open, self.filled, self.seed = self.filled, [], 0, None
        while left:
            room = 1 << (min(left, self.window).bit_length() - 1) if left < self.window else self.window
            left -= room
            offset = 0
            while offset < room:
                row, start, length = pieces.pop()
                take = min(length, room - offset)
                yield row, start, take, self.sequence, offset
                offset += take
                if take < length:
                    pieces.append((row, start + take, length - take))
            self.sequence += 1

    def shard(self, rows: list[object], docs: list[np.ndarray], index: Index) -> Iterator[tuple[object, int, int, int, int]]:
        unused = np.ones(len(docs), bool)
        sizes = np.array([len(d) for d in docs])
        at, k = 0, -1  # next document in order; a document whose tail seeds the next window
        start = 0
        while True:
            if k < 0 and not self.open:
                while at < len(docs) and not unused[at]:
                    at += 1
                if at == len(docs):
                    return
                k, start = at, 0
                unused[k] = False
            if k >= 0:
                if not self.open:
                    self.seed = index.terms[k]
                while k >= 0:
                    take = min(self.window - self.filled, int(sizes[k]) - start)
                    yield from self.put(rows[k], start, take)
                    start += take
                    if start == sizes[k]:
                        k = -1
                    elif self.seed is None:
                        self.seed = index.terms[k]
                if not self.open:
                    continue
            # neighbours of the seed fill the rest of the window
            left = np.flatnonzero(unused)
            if not len(left):
                return  # the next shard goes on with this window
            order = left[np.argsort(-index.scores(self.seed)[left], kind="stable")]
            room = self.window - self.filled
            for d in order[sizes[order] <= room].tolist():
                if sizes[d] <= room:
                    unused[d] = False
                    room -= int(sizes[d])
                    yield from self.put(rows[d], 0, int(sizes[d]))
                    if not room:
                        break
            if self.open:
                cut = next((d for d in order.tolist() if unused[d]), -1)
                if cut >= 0:
                    unused[cut] = False
                    k, start = cut, 0


def pack(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", window: int = 1024, end_id: int = 0, tokenizer_path: str | None = None, shard_docs: int = 192, shard_tokens: int = 1 << 20
) -> DataFrame:
    """(id, start, length, ids, doc_tokens, sequence_id, offset): a row for each piece of a document.

    Each document is its ids and end_id; a null or empty text is end_id alone.  Sequences have window
    tokens; what is left at the end of a task's documents becomes sequences whose lengths are powers
    of two, so that nothing is padded.  ids are little-endian unsigned 32-bit integers.  Every row is
    packed, also with a null or repeated id; documents with equal keys are ordered by id, then by
    their ids' bytes.  Whole texts are packed, however long; an empty table gives no rows; other columns
    of docs don't matter.
    """
    encoded = materialize(encode(docs, id_column, text_column, end_id, tokenizer_path), "encoded")
    df, n, mean = corpus_statistics(encoded)
    idf = np.maximum(0, np.log((n - df + 0.5) / (df + 0.5)))
    shared = docs.sparkSession.sparkContext.broadcast((idf, max(mean, 1.0)))
    id_type = docs.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, mean = shared.value
        base, packer = TaskContext.get().partitionId() << 40, Packer(window)
        names = ["id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]

        def out(pieces: list) -> pa.RecordBatch:
            cols = list(zip(*[(r[0], s, n, r[1][s : s + n].astype("<u4").tobytes(), len(r[1]), base + q, o) for r, s, n, q, o in pieces]))
            kinds = [id_arrow, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)

        def shard(rows: list) -> Iterator[pa.RecordBatch]:
            pieces = list(packer.shard(rows, [r[1] for r in rows], Index([r[1] for r in rows], idf, mean)))
            if pieces:
                yield out(pieces)

        rows, size, id_arrow = [], 0, pa.int64()
        for batch in batches:
            id_arrow = batch.column("id").type
            for key, raw, wide in zip(batch.column("id").to_pylist(), batch.column("ids").to_pylist(), batch.column("wide").to_pylist()):
                rows.append((key, unpacked(raw, wide)))
                size += len(rows[-1][1])
                if len(rows) >= shard_docs or size >= shard_tokens:
                    yield from shard(rows)
                    rows, size = [], 0
        if rows:
            yield from shard(rows)
        last = list(packer.close())
        if last:
            yield out(last)

    laid = encoded.repartitionByRange("place", "id").sortWithinPartitions("place", "id", "ids").select("id", "wide", "ids")
    made = laid.mapInArrow(run, f"id {id_type}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
    return made.withColumnRenamed("id", id_column)

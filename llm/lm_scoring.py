"""Cross-entropy difference of documents under matched target and background n-gram models.

Both models share one vocabulary, every word of the corpus, and the same smoothing; they differ only in
the documents counted.  They are class bigrams: each of the most frequent words is a class of its own,
all other words are one class.  A token's probability is that of its class after the class before it,
times, in the class of other words, that of the word within it.  So the bigram tables have a fixed size
that fits a worker, and word counts, which grow with the corpus, stay a table of Spark.  The score of a
document is its loss a token under the target model minus that under the background model: the lower,
the more it is like the target.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.common import discard, materialize, slices

#: Tokens of a chunk: documents of a task that share a list of their distinct words.
CHUNK_TOKENS = 2_000_000
#: Words of a row of such a list.
ROW_WORDS = 10_000


class WordHashes(dict):
    """Signed 64-bit hashes of words; kept while there is room."""

    def __missing__(self, w: str) -> int:
        h = xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass"))
        h -= (h >> 63) << 64
        if len(self) < 400_000:
            self[w] = h
        return h


HASHES = WordHashes()


def words_of(text: str | None) -> list[str]:
    """Words between white space, in lower case."""
    return text.lower().split() if text else []


def hashed(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts one after the other, and how many each text has."""
    own = [words_of(t) for t in texts]
    counts = np.fromiter(map(len, own), np.int64, len(own))
    return np.fromiter((HASHES[w] for ws in own for w in ws), np.int64, int(counts.sum())), counts


@dataclass
class ClassModels:
    """Loss tables of both models over pairs of classes, and what a word's count in the class of other words is divided by."""

    top: np.ndarray  # hashes of the words that are classes of their own, rising
    target: np.ndarray
    background: np.ndarray
    target_total: float
    background_total: float

    @property
    def size(self) -> int:
        return len(self.top) + 2  # class 0: start of a document, 1: other words

    def pairs(self, words: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Flat pair ids (class before, class) of the tokens, and which tokens are other words."""
        now = classes(words, self.top)
        before = np.empty_like(now)
        before[1:] = now[:-1]
        before[(np.cumsum(counts) - counts)[counts > 0]] = 0
        return before * self.size + now, now == 1


def classes(words: np.ndarray, top: np.ndarray) -> np.ndarray:
    if not len(top):
        return np.ones(len(words), np.int64)
    at = np.minimum(np.searchsorted(top, words), len(top) - 1)
    return np.where(top[at] == words, at + 2, 1)


def word_counts(flagged: DataFrame, flush: int = 400_000) -> DataFrame:
    """(word, target, background): for each word's hash its tokens in target documents and in all.

    flagged: (text, target).  A task adds up its own texts first.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter[str], Counter[str]] = Counter(), Counter()

        def out() -> pa.RecordBatch:
            words = list(seen[1])
            columns = [pa.array([HASHES[w] for w in words], pa.int64()), pa.array([seen[0][w] for w in words], pa.int64()), pa.array(list(seen[1].values()), pa.int64())]
            return pa.RecordBatch.from_arrays(columns, ["word", "target", "background"])

        for batch in batches:
            for part in slices(batch, "text"):
                for text, target in zip(part.column("text").to_pylist(), part.column("target").to_pylist()):
                    words = words_of(text)
                    seen[1].update(words)
                    if target:
                        seen[0].update(words)
                if len(seen[1]) > flush:
                    yield out()
                    seen[0].clear(), seen[1].clear()
        yield out()

    rows = flagged.select("text", "target").mapInArrow(run, "word long, target long, background long")
    return rows.groupBy("word").agg(F.sum("target").alias("target"), F.sum("background").alias("background"))


def fit(flagged: DataFrame, words: DataFrame, class_words: int = 1022, weight: float = 8.0) -> ClassModels:
    """Count both models over all rows of flagged (text, target): the background has every document.

    words: what word_counts gives.  The class_words most frequent words (ties: smaller hash) are
    classes of their own.  Each task counts its pairs in one table, and Spark sums the tables: at most
    (class_words + 2)**2 sums reach the driver.  weight is how many observations the unigram model
    counts as when it is mixed into a bigram's counts; unigrams have one observation more for each
    class, and so have words within the class of other words.
    """
    best = words.orderBy(F.desc("background"), "word").limit(class_words).collect()
    top = np.array(sorted(r.word for r in best), np.int64)
    all_words = words.agg(F.count("*"), F.sum("target"), F.sum("background")).first()
    other = all_words[0] - len(best)
    totals = [float((all_words[k] or 0) - sum(r[k] for r in best) + other) for k in (1, 2)]
    size = len(top) + 2
    shared = flagged.sparkSession.sparkContext.broadcast(ClassModels(top, np.empty(0), np.empty(0), *totals))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros((2, size * size), np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                own, counts = hashed(part.column("text").to_pylist())
                pairs, _ = shared.value.pairs(own, counts)
                flag = np.repeat(np.array([bool(x) for x in part.column("target").to_pylist()]), counts)
                table[0] += np.bincount(pairs[flag], minlength=size * size)
                table[1] += np.bincount(pairs, minlength=size * size)
        at = np.flatnonzero(table[1])
        for k in range(0, len(at), 100_000):
            a = at[k : k + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(table[0][a]), pa.array(table[1][a])], ["pair", "target", "background"])

    counted = flagged.select("text", "target").mapInArrow(count, "pair long, target long, background long").groupBy("pair").agg(F.sum("target").alias("target"), F.sum("background").alias("background"))
    seen = counted.toArrow()
    losses = []
    for name in ("target", "background"):
        n = np.zeros(size * size)
        n[seen["pair"].to_numpy()] = seen[name].to_numpy()
        n = n.reshape(size, size)
        uni = n.sum(axis=0) + 1
        uni /= uni.sum()
        losses.append((-np.log((n + weight * uni) / (n.sum(axis=1, keepdims=True) + weight))).astype(np.float32).ravel())
    return ClassModels(top, *losses, *totals)


def class_losses(flagged: DataFrame, models: ClassModels) -> DataFrame:
    """Documents with the sums of their class losses, and the words of the chunks they form.

    Rows of part 0 list the distinct other words of a chunk, from place at on; rows of part 1 are
    documents, whose other words are places in that list (little-endian unsigned 32-bit integers).
    """
    shared = flagged.sparkSession.sparkContext.broadcast(models)
    id_type = flagged.schema["id"].dataType.simpleString()
    names = ["chunk", "part", "at", "words", "id", "n", "target", "background", "other"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, chunk, docs, size = shared.value, TaskContext.get().partitionId() << 32, [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            words, place = np.unique(np.concatenate([d[4] for d in docs]), return_inverse=True)
            place = place.astype("<u4")
            for k in range(0, len(words), ROW_WORDS):
                row = pa.array([words[k : k + ROW_WORDS]], pa.list_(pa.int64()))
                empty = [pa.nulls(1, t) for t in (docs[0][0].type, pa.int64(), pa.float64(), pa.float64(), pa.binary())]
                yield pa.RecordBatch.from_arrays([pa.array([chunk]), pa.array([0], pa.int32()), pa.array([k], pa.int64()), row, *empty], names)
            start = 0
            for ids, n, t, b, other, rare in docs:
                ends = start + np.cumsum(rare)
                places = [place[e - r : e].tobytes() for e, r in zip(ends.tolist(), rare.tolist())]
                start += len(other)
                m = len(ids)
                columns = [pa.array(np.full(m, chunk)), pa.array(np.ones(m, np.int32)), pa.array(np.zeros(m, np.int64)), pa.nulls(m, pa.list_(pa.int64())), ids, pa.array(n), pa.array(t), pa.array(b), pa.array(places, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names)

        for batch in batches:
            for part in slices(batch, "text"):
                words, counts = hashed(part.column("text").to_pylist())
                pairs, other = own.pairs(words, counts)
                ends = np.cumsum(counts)
                sums = [np.r_[0, np.cumsum(t[pairs], dtype=np.float64)] for t in (own.target, own.background)]
                t, b = (s[ends] - s[ends - counts] for s in sums)
                rare = np.r_[0, np.cumsum(other)]
                docs.append((part.column("id"), counts, t, b, words[other], rare[ends] - rare[ends - counts]))
                size += len(words)
                if size >= CHUNK_TOKENS:
                    yield from flush()
                    chunk, docs, size = chunk + 1, [], 0
        if docs:
            yield from flush()

    return flagged.select("id", "text").mapInArrow(run, f"chunk long, part int, at long, words array<long>, id {id_type}, n long, target double, background double, other binary")


def score(flagged: DataFrame, words: DataFrame, models: ClassModels) -> DataFrame:
    """(id, n_tokens, target_loss, background_loss, ce_difference), a row for a row of flagged (id, text, target), which is read once and discarded."""
    summed = materialize(class_losses(flagged, models), "lm_docs")
    discard(flagged)
    lists = summed.where("part = 0").select("chunk", "at", F.posexplode("words").alias("k", "word")).select("chunk", (F.col("at") + F.col("k")).alias("at"), "word")
    loss = lambda c, total: (F.log(F.lit(total)) - F.log(F.col(c) + 1.0)).cast("float")
    # a sort-merge join at every size: distinct words grow with the corpus
    known = lists.join(words.hint("merge"), "word").select("chunk", F.lit(0).alias("part"), "at", loss("target", models.target_total).alias("lt"), loss("background", models.background_total).alias("lb"))
    rows = summed.where("part = 1").select("chunk", "part", "at", "id", "n", "target", "background", "other").unionByName(known, allowMissingColumns=True)
    id_type = flagged.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, tables, held = None, np.zeros((2, 0)), 0
        for batch in batches:
            if not batch.num_rows:
                continue
            chunk, part = batch.column("chunk").to_numpy(), batch.column("part").to_numpy()
            edges = [0, *(np.flatnonzero((chunk[1:] != chunk[:-1]) | (part[1:] != part[:-1])) + 1).tolist(), len(chunk)]
            for a, z in zip(edges, edges[1:]):
                run_ = batch.slice(a, z - a)
                if chunk[a] != now:
                    now, held = chunk[a], 0
                if part[a] == 0:  # sorted by at, so places follow on each other
                    if held + z - a > tables.shape[1]:
                        tables = np.concatenate([tables[:, :held], np.zeros((2, max(held, z - a)))], axis=1)
                    tables[0, held : held + z - a] = run_.column("lt").to_numpy()
                    tables[1, held : held + z - a] = run_.column("lb").to_numpy()
                    held += z - a
                    continue
                raw = run_.column("other")
                size = np.fromiter((len(x) // 4 for x in raw.to_pylist()), np.int64, z - a)
                place = np.frombuffer(b"".join(raw.to_pylist()), "<u4")
                ends, n = np.cumsum(size), run_.column("n").to_numpy()
                out = []
                for k, name in enumerate(("target", "background")):
                    s = np.r_[0, np.cumsum(tables[k][place])]
                    out.append((run_.column(name).to_numpy() + s[ends] - s[ends - size]) / np.maximum(n, 1))
                none = n == 0
                columns = [run_.column("id"), run_.column("n"), *(pa.array(x, pa.float64(), mask=none) for x in (*out, out[0] - out[1]))]
                yield pa.RecordBatch.from_arrays(columns, ["id", "n_tokens", "target_loss", "background_loss", "ce_difference"])

    laid = rows.repartition("chunk").sortWithinPartitions("chunk", "part", "at")
    return laid.mapInArrow(run, f"id {id_type}, n_tokens long, target_loss double, background_loss double, ce_difference double")


def score_documents(docs: DataFrame, trusted: DataFrame, id_column: str = "doc_id", text_column: str = "text", class_words: int = 1022) -> DataFrame:
    """Fit on docs, with the ids in trusted as the target, and score every document.

    Gives (id, n_tokens, target_loss, background_loss, ce_difference), a row for a row.  Losses are
    nats a token; a null, empty or blank text has no tokens and null losses.  Null ids and repeated rows
    are kept; whole texts count, however long; an empty table gives no rows; other columns of docs
    don't matter.  Without any trusted document the target model has smoothing alone, and is uniform.
    """
    ids = trusted.select(F.col(id_column).alias("trusted_id")).where("trusted_id is not null").distinct()
    # a sort-merge join at every size: the trusted ids grow with the corpus
    ids = ids.withColumn("target", F.lit(True)).hint("merge")
    flagged = docs.select(docs[id_column].alias("id"), docs[text_column].alias("text")).join(ids, F.col("id") == F.col("trusted_id"), "left")
    flagged = materialize(flagged.select("id", "text", F.coalesce("target", F.lit(False)).alias("target")), "lm")
    words = materialize(word_counts(flagged), "lm_words")
    return score(flagged, words, fit(flagged, words, class_words)).withColumnRenamed("id", id_column)

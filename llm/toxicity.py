"""Severity of toxic language by cumulative-link ordinal regression over sparse word features.

One weight a word is shared by all grades; ordered thresholds t1 < t2 < ... cut the line:
P(grade >= k) = sigmoid(w . x - t_k), and the expected severity is the sum of these over k.

Labels say only whether a document is toxic.  Grades come from them in the training sample: 0 for
clean documents; toxic ones get 1, or 2 if they have more different words that mark toxic documents
than half of the toxic ones have.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from llm.common import materialize, slices

#: Stripped from both ends of a word.  Fixed value.
EDGES = ".,;:!?\"'()[]{}*#$%&|<>-_…«»„“”‘’"


def features(text: str | None) -> set[str]:
    """Distinct words of a text: cut at white space, lower case, without punctuation at the ends."""
    return {w.strip(EDGES) for w in set(text.lower().split())} - {""} if text else set()


@dataclass
class OrdinalModel:
    weights: dict[str, float]
    thresholds: np.ndarray

    def at_least(self, z: np.ndarray) -> np.ndarray:
        """P(grade >= k) for each value and each grade k from 1."""
        return 1 / (1 + np.exp(-np.clip(z[:, None] - self.thresholds[None, :], -40, 40)))


def fit_ordinal(x: list[np.ndarray], grades: np.ndarray, n_features: int, n_grades: int, l2: float = 0.0003, steps: int = 400, rate: float = 0.05) -> tuple[np.ndarray, np.ndarray]:
    """Weights and rising thresholds by gradient steps (Adam) on the likelihood of the grades; x: feature ids of each row."""
    rows = np.repeat(np.arange(len(x)), [len(r) for r in x])
    cols = np.concatenate([*x, np.empty(0, np.int64)]).astype(np.int64)
    # thresholds are t1, t1 + exp(g2), ...: always in order
    params = np.zeros(n_features + n_grades - 1)
    params[n_features] = 2.0
    m, v = np.zeros_like(params), np.zeros_like(params)
    share = np.bincount(grades, minlength=n_grades) / max(1, len(grades))
    weight = (1 / np.maximum(share, 1e-3))[grades]
    weight = np.sqrt(weight / weight.mean())  # between plain and balanced
    weight /= weight.sum()
    for step in range(1, steps + 1):
        w, gaps = params[:n_features], np.exp(np.clip(params[n_features + 1 :], -5, 5))
        t = params[n_features] + np.r_[0, np.cumsum(gaps)]
        z = np.bincount(rows, w[cols], minlength=len(x))
        edge = np.concatenate([np.full((len(x), 1), np.inf), z[:, None] - t[None, :], np.full((len(x), 1), -np.inf)], axis=1)
        up = 1 / (1 + np.exp(-np.clip(edge, -40, 40)))  # P(grade >= k), k = 0..n
        slope = up * (1 - up)
        i = np.arange(len(x))
        p = np.maximum(up[i, grades] - up[i, grades + 1], 1e-9)
        dz = -weight * (slope[i, grades] - slope[i, grades + 1]) / p
        dt = np.zeros(n_grades - 1)
        np.add.at(dt, grades[grades > 0] - 1, (weight * slope[i, grades] / p)[grades > 0])
        np.add.at(dt, grades[grades < n_grades - 1], -(weight * slope[i, grades + 1] / p)[grades < n_grades - 1])
        grad = np.empty_like(params)
        grad[:n_features] = np.bincount(cols, dz[rows], minlength=n_features) + l2 * w
        grad[n_features] = dt.sum()
        grad[n_features + 1 :] = np.cumsum(dt[::-1])[::-1][1:] * gaps
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        params -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-10)
    return params[:n_features], params[n_features] + np.r_[0, np.cumsum(np.exp(np.clip(params[n_features + 1 :], -5, 5)))]


def surprise(a: str, n: int, b: str, m: int) -> Column:
    """Likelihood ratio statistic of column a of n against b of m, negative if a's share is the smaller one."""
    x, y = F.col(a).cast("double"), F.col(b).cast("double")
    both, neither = (x + y) / (n + m), (n + m - x - y) / (n + m)
    term = lambda seen, expected: F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)
    terms = term(x, n * both) + term(n - x, n * neither) + term(y, m * both) + term(m - y, m * neither)
    return 2 * terms * F.when(x * m >= y * n, 1).otherwise(-1)


def fit(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "toxic", max_rows: int = 6000, max_features: int = 1000) -> OrdinalModel:
    """Fit on at most max_rows labelled documents, half of them toxic where there are as many.

    The sample is the documents of the smallest hashes of their id, so it does not depend on how rows
    lie; of rows that repeat an id the one with the least list of words counts.  Spark counts the
    words.  Of those in five sampled documents or more the features are the ones whose frequencies in
    toxic and clean documents differ by a likelihood ratio statistic over 15, the max_features clearest
    ones; they and which sampled document has which come to the driver.  Where the labels know toxic
    documents only or clean ones only, or none, no document gets a severity.  Whole texts count,
    however long.
    """
    known = labels.where(F.col(label_column).isin(0, 1) & F.col(id_column).isNotNull()).groupBy(F.col(id_column).alias("label_id")).agg(F.max(label_column).alias("label"))
    picked = None
    for value in (0, 1):
        part = known.where(F.col("label") == value).orderBy(F.xxhash64("label_id"), "label_id").limit(max_rows // 2)
        picked = part if picked is None else picked.unionByName(part)
    rows = docs.select(docs[id_column].alias("id"), docs[text_column].alias("text")).join(F.broadcast(picked), F.col("id") == F.col("label_id"))

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                texts = [sorted(features(t)) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(part.column("label").to_pylist(), pa.int64()), pa.array(texts, pa.list_(pa.string()))], ["id", "label", "words"])

    id_type = docs.schema[id_column].dataType.simpleString()
    made = rows.select("id", "label", "text").mapInArrow(words, f"id {id_type}, label long, words array<string>")
    sample = materialize(made.groupBy("id").agg(F.max("label").alias("label"), F.min("words").alias("words")), "severity")
    total = {r.label: r.n for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(total) < 2:
        return OrdinalModel({}, np.array([20.0, 21.0]))
    counts = sample.select("label", F.explode("words").alias("word")).groupBy("word").agg(F.sum("label").alias("toxic"), F.sum(1 - F.col("label")).alias("clean")).where("toxic + clean >= 5")
    counts = counts.withColumn("gain", surprise("toxic", total[1], "clean", total[0])).where("abs(gain) > 15")
    chosen = counts.orderBy(F.abs("gain").desc(), "word").limit(max_features).collect()
    place = {r.word: k for k, r in enumerate(chosen)}
    # words that mark toxic documents: at least ten times as frequent in them
    markers = {r.word for r in chosen if r.gain > 0 and r.toxic / total[1] > 10 * r.clean / total[0]}
    own = sample.select("id", "label", F.array_intersect("words", F.array(*map(F.lit, place)).cast("array<string>")).alias("words")).toPandas().sort_values("id")
    toxic = own.label.to_numpy() == 1
    x = [np.array([place[w] for w in ws], np.int64) for ws in own.words]
    marked = np.array([sum(w in markers for w in ws) for ws in own.words])
    grades = np.where(toxic, 1 + (marked > np.median(marked[toxic])), 0)
    weights, thresholds = fit_ordinal(x, grades, len(chosen), 3)
    return OrdinalModel({w: float(weights[k]) for w, k in place.items()}, thresholds)


def score(docs: DataFrame, model: OrdinalModel, id_column: str = "doc_id", text_column: str = "text", cut: float = 0.5) -> DataFrame:
    """(id, severity, expected_severity, p_toxic, toxic, kept), a row for a row.

    severity is the most probable grade, 0 to 2; p_toxic is P(grade >= 1); toxic: p_toxic >= cut;
    kept is its opposite.  A null or empty text has no features and is kept.  Null ids and repeated
    rows are kept; an empty table gives no rows; other columns of docs don't matter.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    id_type = docs.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        weight = own.weights
        for batch in batches:
            for part in slices(batch, "text"):
                z = np.array([sum(weight[w] for w in features(t) if w in weight) for t in part.column("text").to_pylist()], dtype=float)
                up = own.at_least(z)
                grade = np.argmax(np.c_[np.ones(len(z)), up] - np.c_[up, np.zeros(len(z))], axis=1)
                bad = up[:, 0] >= cut
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.array(grade, pa.int64()), pa.array(up.sum(axis=1)), pa.array(up[:, 0]), pa.array(bad), pa.array(~bad)],
                    ["id", "severity", "expected_severity", "p_toxic", "toxic", "kept"],
                )

    rows = docs.select(docs[id_column].alias("id"), docs[text_column].alias("text"))
    return rows.mapInArrow(run, f"id {id_type}, severity long, expected_severity double, p_toxic double, toxic boolean, kept boolean").withColumnRenamed("id", id_column)


def keep_clean(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """docs without the rows whose text is found toxic; columns, whatever their names, and other rows as they are."""
    model = fit(docs, labels, id_column, text_column)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, own = shared.value.weights, shared.value
        for batch in batches:
            for part in slices(batch, text_column):
                z = np.array([sum(weight[w] for w in features(t) if w in weight) for t in part.column(text_column).to_pylist()], dtype=float)
                yield part.filter(pa.array(own.at_least(z)[:, 0] < 0.5))

    return docs.mapInArrow(run, docs.schema)

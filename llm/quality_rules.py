"""Quality rules: counts over whole texts and a hashed n-gram log-likelihood ratio, all in DataFrame functions.

The ratio compares two multinomials over hashed word unigrams and bigrams: that of trusted documents
and that of the whole corpus.  A document's score is the sum of log ratios of its n-grams divided by
their number; documents under a threshold, set once from the scores of labelled documents, go.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from llm.common import WORD_SPACE_RE

#: Characters that count as symbols.  Fixed value.
SYMBOLS = "#*$%&|<>"

#: Buckets of the hashed n-grams; a power of two.
BUCKETS = 1 << 14

BLANKS = " \t\n\x0b\x0c\r"
#: Repeated windows of a text that are looked for one by one; texts with more of them are sorted whole.
FEW = 32


def words_of(text: Column) -> Column:
    """Words between ASCII white space; null text has none."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, WORD_SPACE_RE))


def with_counts(df: DataFrame, text_column: str = "text") -> DataFrame:
    """df with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed.

    word_chars: code points in words.  n_symbols: characters of SYMBOLS.  n_dup_lines: lines with a
    word that equal an earlier line.  n_repeat_words: words in 3-word windows that occur twice or more
    in the text.  base_failed: under 50 words, or more than half of the words in repeated windows.  A
    null or empty text has no words, all counts 0, and fails.

    Windows are compared by 64-bit hashes: a sorted list of them gives the repeated ones, and their
    places, in order, the words that they cover.  So a text of n words costs n log n at most.
    """
    text = F.coalesce(F.col(text_column), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.length(F.btrim(x, F.lit(BLANKS))) > 0)
    none = "cast(array() as array<int>)"
    windows = "slice(arrays_zip(__words, slice(__words, 2, __n), slice(__words, 3, __n)), 1, greatest(__n - 2, 0))"
    out = (
        df.withColumn("__words", words_of(F.col(text_column)))
        .withColumn("__n", F.size("__words"))
        .withColumn("__h", F.expr(f"transform({windows}, x -> xxhash64(x.`__words`, x.`1`, x.`2`))"))
        .withColumn("__s", F.expr("if(size(array_distinct(__h)) = size(__h), cast(array() as array<bigint>), sort_array(__h))"))
        .withColumn("__d", F.expr("array_distinct(filter(zip_with(slice(__s, 1, greatest(size(__s) - 1, 0)), slice(__s, 2, size(__s)), (a, b) -> if(a = b, a, null)), x -> x is not null))"))
        .withColumn("__lines", lines)
    )
    # places of repeated windows: by their few hashes, or by sorting all hashes with their places
    pairs = "array_sort(transform(__h, (h, i) -> struct(h, i)))"
    near = "zip_with(slice(__p, 1, size(__p) - 1), slice(__p, 2, size(__p)), (a, b) -> if(a.h = b.h, array(a.i, b.i), null))"
    out = out.withColumn("__p", F.expr(f"if(size(__d) > {FEW}, {pairs}, null)"))
    out = out.withColumn("__at", F.expr(f"""case when size(__d) = 0 then {none}
        when size(__d) <= {FEW} then filter(sequence(0, size(__h) - 1), i -> array_contains(__d, get(__h, i)))
        else array_sort(array_distinct(flatten(filter({near}, x -> x is not null)))) end"""))
    covered = F.expr("aggregate(zip_with(slice(__at, 1, greatest(size(__at) - 1, 0)), slice(__at, 2, size(__at)), (a, b) -> least(b - a, 3)), 0, (s, x) -> s + x)")
    counts = {
        "n_words": F.col("__n").cast("long"),
        "word_chars": F.length(F.array_join("__words", "")).cast("long"),
        "n_symbols": F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long"),
        "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
        "n_repeat_words": F.when(F.size("__at") > 0, covered + 3).otherwise(0).cast("long"),
    }
    out = out.withColumns(counts).drop("__h", "__s", "__d", "__p", "__lines", "__at", "__n")
    return out.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def bucket(buckets: int, *words: Column) -> Column:
    """Bucket of a unigram or bigram; buckets is a power of two."""
    return F.xxhash64(*words).bitwiseAND(F.lit(buckets - 1)).cast("int")


def gram_counts(texts: DataFrame, buckets: int) -> DataFrame:
    """(bucket, n) of the hashed word unigrams and bigrams of all rows (text) together."""
    pairs = texts.select(words_of(F.lower("text")).alias("w")).select(F.explode(F.arrays_zip(F.col("w").alias("a"), F.slice("w", F.lit(2), F.size("w")).alias("b"))).alias("x"))
    one, two = bucket(buckets, F.col("x.a")), F.when(F.col("x.b").isNotNull(), bucket(buckets, F.col("x.a"), F.col("x.b")))
    return pairs.select(F.explode(F.array(one, two)).alias("bucket")).where("bucket is not null").groupBy("bucket").agg(F.count("*").alias("n"))


def labelled(docs: DataFrame, labels: DataFrame, qualities: tuple[int, ...], id_column: str, text_column: str) -> DataFrame:
    """(quality, text) of all documents that have one of these quality labels; one with two of them comes twice.

    Ids and labels are broadcast, some 16 bytes each: else all texts of the corpus would be shuffled.
    """
    ids = labels.where(F.col("quality").isin(*qualities)).select(F.col(id_column).alias("__id"), "quality").where("__id is not null").distinct()
    return docs.select(docs[id_column].alias("__id"), docs[text_column].alias("text")).join(F.broadcast(ids), "__id").select("quality", "text")


def fit_ratios(
    docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", buckets: int = BUCKETS, smoothing: float = 1.0
) -> np.ndarray:
    """log(target share / raw share) of each bucket; `buckets` numbers reach the driver, whatever the corpus.

    raw counts the n-grams of all documents, target those of all trusted ones: labelled with quality 1.
    Without trusted documents, or without any document, all ratios are 0.
    """
    raw = gram_counts(docs.select(docs[text_column].alias("text")), buckets).withColumnRenamed("n", "raw")
    target = gram_counts(labelled(docs, labels, (1,), id_column, text_column), buckets).withColumnRenamed("n", "target")
    every = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    rows = every.join(raw, "bucket", "left").join(target, "bucket", "left").select("bucket", (F.coalesce("raw", F.lit(0)) + smoothing).alias("raw"), (F.coalesce("target", F.lit(0)) + smoothing).alias("target"))
    # a table of fixed size in one row
    table = rows.agg(F.array_sort(F.collect_list(F.struct("bucket", "raw", "target"))).alias("t"), F.sum("raw").alias("n_raw"), F.sum("target").alias("n_target"))
    ratio = F.transform("t", lambda x: F.log(x["target"] / F.col("n_target")) - F.log(x["raw"] / F.col("n_raw")))
    nothing = F.col("n_target") == smoothing * buckets
    return np.array(table.select(F.when(nothing, F.transform("t", lambda x: F.lit(0.0))).otherwise(ratio).alias("ratios")).first()[0])


def with_score(rows: DataFrame, ratios: np.ndarray, text_column: str = "text") -> DataFrame:
    """rows with ngram_score: the mean log ratio of the text's word unigrams and bigrams, 0 without any."""
    # a constant, written as one short text: an array of literals takes a call for each of its values
    table, n = F.split(F.lit(",".join(f"{x:.6g}" for x in ratios)), ",").cast("array<double>"), len(ratios)
    ratio = lambda *words: F.get(table, bucket(n, *words))
    out = rows.withColumn("__low", words_of(F.lower(text_column)))
    one = F.aggregate("__low", F.lit(0.0), lambda s, w: s + ratio(w))
    ends = F.zip_with(F.slice("__low", F.lit(1), F.greatest(F.size("__low") - 1, F.lit(0))), F.slice("__low", F.lit(2), F.size("__low")), lambda a, b: ratio(a, b))
    two = F.aggregate(ends, F.lit(0.0), lambda s, x: s + x)
    return out.withColumn("ngram_score", (one + two) / F.greatest(2 * F.size("__low") - 1, F.lit(1))).drop("__low")


def fit_threshold(docs: DataFrame, labels: DataFrame, ratios: np.ndarray, id_column: str = "doc_id", text_column: str = "text", default: float = -0.15) -> float:
    """Where to cut: between the scores of labelled good and bad documents that pass the base rules.

    Halfway between the score that 1 % of the good ones lie under and the one that 5 % of the bad ones
    lie over, but never above the first.  All labelled documents are scored; default stands where one
    kind has none.
    """
    # the row number keeps the optimizer from writing the counts again into the filter
    rows = with_counts(labelled(docs, labels, (0, 1), id_column, text_column)).withColumn("__row", F.monotonically_increasing_id()).where("not base_failed and __row >= 0")
    marks = with_score(rows.select("quality", "text"), ratios).groupBy("quality").agg(F.percentile("ngram_score", F.array(F.lit(0.01), F.lit(0.95))).alias("p")).collect()
    found = {r["quality"]: r["p"] for r in marks}
    if found.get(1) is None or found.get(0) is None:
        return default
    good, bad = found[1][0], found[0][1]
    return min(good, (good + bad) / 2)


def judge(docs: DataFrame, ratios: np.ndarray, text_column: str = "text", threshold: float = -0.15) -> DataFrame:
    """docs with the counts, ngram_score and kept.

    kept: not base_failed, and ngram_score at least threshold (0 is as likely among trusted documents
    as in the corpus).  Repeated rows and null ids are judged like others, whole texts count, an empty
    table gives no rows.  Columns of docs stay, but those that have the name of a result are replaced.
    """
    out = with_score(with_counts(docs, text_column).drop("__words"), ratios, text_column)
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("ngram_score") >= threshold))

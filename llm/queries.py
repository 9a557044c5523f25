"""The queries of this folder: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm import alignment, bpe, line_dedup, lm_scoring, metric_trees, near_dedup, packing, quality_rules, slots, sstable, token_counts, topk, toxicity
from llm.common import shared_dir, table


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return lm_scoring.score_documents(table(spark, sf_dir, "documents"), trusted)


def op2_sstable(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_dir(spark, "op2")
    sstable.write_tables(table(spark, sf_dir, "documents"), folder)

    rows = sstable.read_tables(spark, folder)
    n = (F.octet_length("ids") / 4).cast("long")
    return rows.select(F.col("id").alias("doc_id"), "start", n.alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.topk(vectors.where("vec_id % 50 = 0"), vectors)


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), size=4, percent=80)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels")
    ratios = quality_rules.fit_ratios(docs, labels)
    threshold = quality_rules.fit_threshold(docs, labels, ratios)
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "ngram_score", "kept"]
    return quality_rules.judge(docs.select("doc_id", "text"), ratios, threshold=threshold).select(names)


def op7_length_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.length_table(token_counts.length_counts(table(spark, sf_dir, "documents")))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each document that loses lines: their places, the components and their number."""
    return line_dedup.removed_lines(table(spark, sf_dir, "documents")).withColumn("n_removed", F.size("removed").cast("long"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(table(spark, sf_dir, "documents"))


def op11_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes near equal, by a stored map of slots; virtual_slot, first_shard and next_shard show how the map was edited."""
    text = F.coalesce("text", F.lit(""))
    rows = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    out = slots.assigned(rows, size=F.col("size"), map_folder=shared_dir(spark, "op11-maps"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("place").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "map_version", "first_shard", "next_shard")


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"))


def op13_metric_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = metric_trees.compress(table(spark, sf_dir, "embeddings"))
    out = metric_trees.with_label_errors(coded)
    return out.select(F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(metric_trees.codebook_digest(books)).alias("codebooks_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_lm_scoring, op2_sstable, op3_topk, op4_near_dedup, op5_packing, op6_quality_rules, op7_length_histogram, op8_toxicity, op9_line_dedup, op10_bpe, op11_virtual_slots, op12_alignment, op13_metric_trees)}


def oracle_sql() -> dict[str, str]:
    return {"op3_topk": TOPK_SQL, "op4_near_dedup": NEAR_SQL, "op13_metric_trees": TREES_SQL}


#: The same search, pair by pair.
TOPK_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id,
         CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q)
  WHERE a.vec_id % 50 = 0
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

#: The same links by counting the shingles that two documents share, and all that can be reached by them.
NEAR_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3]) END) AS g FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT c.a, c.b FROM c JOIN n x ON x.doc_id = c.a JOIN n y ON y.doc_id = c.b WHERE 100 * c.c >= 80 * (x.n + y.n - c.c)),
r AS (SELECT doc_id, doc_id AS c FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.c)
SELECT r.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.c) AS component_id, r.doc_id = min(r.c) AS kept FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id
"""

#: Every part against every entry; a round is the same text again.
_ROUND = """, d{r} AS (
  SELECT p.vec_id, p.label, p.part, p.q, c.entry, list_sum(list_transform(list_zip(p.q, c.q), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM p JOIN c{r} c ON c.part = p.part
), a{r} AS (
  SELECT vec_id, any_value(label) AS label, part, any_value(q) AS q, min({{'d': CAST(d AS BIGINT), 'entry': entry}}) AS best FROM d{r} GROUP BY vec_id, part
)"""
_MEANS = """, m{r} AS (
  SELECT part, best.entry AS entry, i, CAST(floor(sum(q[i]) / count(*)) AS BIGINT) AS x FROM a{p}, (SELECT unnest(range(1, 65)) AS i) WHERE i <= len(q) GROUP BY ALL
), c{r} AS (
  SELECT c.part, c.entry, coalesce(m.q, c.q) AS q FROM c{p} c LEFT JOIN (SELECT part, entry, list(x ORDER BY i) AS q FROM m{r} GROUP BY part, entry) m ON m.part = c.part AND m.entry = c.entry
)"""
TREES_SQL = (
    """
WITH v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS (
  SELECT vec_id, label, part, q[1 + part * len(q) // 16 : (part + 1) * len(q) // 16] AS q FROM v, (SELECT unnest(range(16)) AS part)
), c0 AS (
  SELECT part, rank - 1 AS entry, q FROM (SELECT *, row_number() OVER (PARTITION BY part ORDER BY vec_id) AS rank FROM p) WHERE rank <= 64
)"""
    + _ROUND.format(r=0) + _MEANS.format(r=1, p=0) + _ROUND.format(r=1) + _MEANS.format(r=2, p=1) + _ROUND.format(r=2)
    + """, f AS (
  SELECT vec_id, any_value(label) AS label, string_agg(printf('%02x', best.entry), '' ORDER BY part) AS code, CAST(sum(best.d) AS BIGINT) AS error FROM a2 GROUP BY vec_id
), l AS (SELECT label, CAST(sum(error) AS BIGINT) AS label_error FROM f GROUP BY label),
h AS (SELECT sha256(string_agg(array_to_string(q, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM c2)
SELECT f.vec_id, code, error, label_error, codebooks_sha256 FROM f JOIN l ON l.label IS NOT DISTINCT FROM f.label, h
"""
)

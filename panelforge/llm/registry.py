"""The training-data queries: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.llm import alignment, chunking, hard_negatives, language_model, media, mixing, packing, prefix_join, quality, token_tree, toxicity, transcode, warc

BYTE_VOCABULARY = "byte_bpe_50k.json"
WORD_VOCABULARY = "word_bpe_49k.json"
PIECE_MODEL = "piece_bpe_32k.model"


def vocabulary(name: str) -> str:
    """The text of a public tokenizer file, read by the driver."""
    import public_tokenizers

    with open(public_tokenizers.path(name), encoding="utf-8") as f:
        return f.read()


def piece_model(name: str) -> bytes:
    """A public piece model, read by the driver."""
    import public_tokenizers

    with open(public_tokenizers.path(name), "rb") as f:
        return f.read()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_cross_entropy_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    good = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return language_model.score_corpus(docs, good)


def op2_interleaved_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.document_media(table(spark, sf_dir, "documents"))


def op3_edit_aware_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return token_tree.count_edits(docs, token_tree.revision(F.coalesce(F.col("text"), F.lit(""))), vocabulary(BYTE_VOCABULARY))


def op4_streaming_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transcode.digests(transcode.transcode_documents(table(spark, sf_dir, "documents"), vocabulary(BYTE_VOCABULARY)))


def op5_cotraining_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    scored = quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "content_score", "metadata_score", "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def op6_binary_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digests(packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary(WORD_VOCABULARY)))


def op7_merkle_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit a replica: bodies whose length leaves 7 when divided by 50 lost their last character, records that leave 13 are
    missing, and those that leave 23 are there once more under the negative of their id less one."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    rest = F.length("html") % 50
    torn = F.when(rest == 7, F.expr("substring(html, 1, length(html) - 1)")).otherwise(F.col("html"))
    copies = pages.where(rest == 23).select((-F.col("page_id") - 1).alias("page_id"), "url", "html")
    return warc.fixity(pages, pages.where(rest != 13).select("page_id", "url", torn.alias("html")).unionByName(copies))


_RECORD = """'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:record:' || page_id || '>' || chr(13) || chr(10)
         || 'WARC-Target-URI: ' || url || chr(13) || chr(10) || 'WARC-Block-Digest: sha256:' || sha256(body)
         || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: ' || strlen(body)
         || chr(13) || chr(10) || chr(13) || chr(10) || body || chr(13) || chr(10) || chr(13) || chr(10)"""
OP7_SQL = f"""
WITH b AS (SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS body FROM pages),
c AS (
  SELECT page_id, url, CASE WHEN length(body) % 50 = 7 THEN left(body, length(body) - 1) ELSE body END AS body FROM b WHERE length(body) % 50 <> 13
  UNION ALL SELECT -page_id - 1, url, body FROM b WHERE length(body) % 50 = 23),
p AS (SELECT page_id, strlen(r) AS n, sha256(r) AS h, sum(strlen(r)) OVER (ORDER BY page_id ROWS UNBOUNDED PRECEDING) - strlen(r) AS o FROM (SELECT page_id, {_RECORD} AS r FROM b)),
q AS (SELECT page_id, strlen(r) AS n, sha256(r) AS h, sum(strlen(r)) OVER (ORDER BY page_id ROWS UNBOUNDED PRECEDING) - strlen(r) AS o FROM (SELECT page_id, {_RECORD} AS r FROM c))
SELECT coalesce(p.page_id, q.page_id) AS page_id, CAST(p.o AS BIGINT) AS archive_offset, CAST(p.n AS BIGINT) AS length, CAST(q.o AS BIGINT) AS replica_offset,
       p.h AS expected_sha256, q.h AS found_sha256
FROM p FULL JOIN q ON p.page_id = q.page_id WHERE p.h IS DISTINCT FROM q.h
"""


def op8_ftrl_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op9_cdc_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.fingerprint_documents(table(spark, sf_dir, "documents"))


def op10_grouped_prefix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_join.near_duplicates(table(spark, sf_dir, "documents"))


def op11_systematic_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP11_SQL = """
WITH docs AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM docs GROUP BY source),
w AS (SELECT *, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight FROM s),
-- a source is below its stop if, with all of smaller size by weight at their stops, its share of the rest fits
t AS (SELECT a.source, a.source_size, a.weight,
        (SELECT sum(source_size) FROM w) - coalesce(sum(3 * b.source_size) FILTER (b.source_size * a.weight < a.source_size * b.weight), 0) AS rest,
        (SELECT sum(weight) FROM w) - coalesce(sum(b.weight) FILTER (b.source_size * a.weight < a.source_size * b.weight), 0) AS shares
      FROM w a, w b GROUP BY a.source, a.source_size, a.weight),
l AS (SELECT t.source, t.source_size, t.rest * t.weight <= 3 * t.source_size * t.shares AS fits, t.weight FROM t),
o AS (SELECT (SELECT sum(source_size) FROM w) - coalesce(sum(3 * source_size) FILTER (NOT fits), 0) AS rest, sum(weight) FILTER (fits) AS shares FROM l),
q AS (SELECT l.source, l.source_size, CASE WHEN fits THEN o.rest * l.weight ELSE 3 * l.source_size END AS above, CASE WHEN fits THEN o.shares ELSE 1 END AS below,
        CAST('0x' || substr(md5('1:' || coalesce('s' || l.source, 'n')), 1, 8) AS BIGINT) % 1024 AS u FROM l, o),
r AS (SELECT docs.*, q.source_size, q.above, q.below, q.u, row_number() OVER (PARTITION BY docs.source ORDER BY size DESC,
        CAST('0x' || substr(md5(concat(coalesce(CAST(doc_id AS VARCHAR), '-'), '|', coalesce(docs.source, '-'), '|', size)), 1, 8) AS BIGINT) // 2 DESC, doc_id NULLS FIRST) AS k
      FROM docs JOIN q ON docs.source IS NOT DISTINCT FROM q.source)
SELECT doc_id, size, source_size, CAST(above AS DOUBLE) / CAST(below AS DOUBLE) AS target,
       CASE WHEN source_size = 0 THEN 0 ELSE CAST(size * ((CAST(k AS HUGEINT) * above * 1024 + u * below * source_size) // (below * source_size * 1024)
         - (CAST(k - 1 AS HUGEINT) * above * 1024 + u * below * source_size) // (below * source_size * 1024)) AS BIGINT) END AS taken
FROM r
"""


def op12_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align_documents(table(spark, sf_dir, "documents"), vocabulary(BYTE_VOCABULARY), piece_model(PIECE_MODEL))


def op13_pivot_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    shifted = F.when(F.col("id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, relabel=shifted)


OP13_SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
           FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
      FROM v a, v b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5),
n AS (SELECT p.*, s.other AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.other) AS rank
      FROM p JOIN s USING (anchor_id) WHERE NOT s.same AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline  # it imports this module for its tables

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_cross_entropy_difference, op2_interleaved_media, op3_edit_aware_counts, op4_streaming_bpe, op5_cotraining_quality, op6_binary_packing, op7_merkle_audit, op8_ftrl_toxicity, op9_cdc_fingerprints, op10_grouped_prefix_join, op11_systematic_mix, op12_cross_tokenizer_alignment, op13_pivot_hard_negatives, pipeline)
}
ORACLES: dict[str, str] = {"op7_merkle_audit": OP7_SQL, "op11_systematic_mix": OP11_SQL, "op13_pivot_hard_negatives": OP13_SQL}

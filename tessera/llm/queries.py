"""Queries that apply the operators to the given tables, under their contracts."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import align, bpe, decontam, htmldiff, langid, licenses, quality, simhash, tokenscan, topk, toxicity, urlfilter, whitening
from tessera.llm.common import remainder, table
from tessera.session import scratch_path

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document by the multilingual ranks, and their decoding."""
    docs = table(spark, sf_dir, "documents")
    coder = bpe.ByteBpe(spark, RANKS, public_tokenizers.PATTERN)
    coded = docs.select("doc_id", coder.encode(F.col("text")).alias("ids"))
    both = coded.select("doc_id", "ids", coder.decode(F.col("ids")).alias("bytes"))
    n, ids, decoded = bpe.token_digests(both, "ids", "bytes")
    return both.select("doc_id", n.alias("n_tokens"), ids.alias("ids_sha256"), decoded.alias("decoded_sha256"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 13 benchmark words in the documents; n_near counts the items
    with a window whose words all lie within 16 words."""
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    found = decontam.verdicts(decontam.matches(docs, items, width=13, near_width=16))
    return found.select(
        F.col("id").alias("doc_id"),
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"),
        "contaminated",
        F.size("near").cast("long").alias("n_near"),
    )


# The contract's rules, as text: host and path.
URL_RULES = [
    urlfilter.Rule("org", "/", "allow"),
    urlfilter.Rule("example.org", "/es/", "block"),
    urlfilter.Rule("example.org", "/en/1", "block"),
    urlfilter.Rule("com", "/fr/", "allow"),
    urlfilter.Rule("com", "/de/", "block"),
]


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's url."""
    return urlfilter.judge(table(spark, sf_dir, "pages"), URL_RULES)


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    found = htmldiff.main_text(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_lines", "n_shared")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document, found again in flat token files that are written
    from the documents (one id a word, and the document's id in front)."""
    docs = table(spark, sf_dir, "documents")
    path = scratch_path(spark, "token-files")
    tokenscan.write_token_files(docs.select(tokenscan.word_tokens(F.col("doc_id"), F.col("text")).alias("tokens")), path)
    found = tokenscan.count_tokens(spark, path, head=tokenscan.HEAD)
    return found.select(tokenscan.head_id(F.col("head")).alias("doc_id"), (F.col("n_tokens") - tokenscan.HEAD).alias("n_tokens"))


OP5_SQL = r"""
SELECT doc_id, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS BIGINT) AS n_tokens FROM documents
"""


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 best inner products of every hundredth vector with all others."""
    vectors = table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, vectors.where("vec_id % 100 = 0"), k=10)


OP6_SQL = """
WITH v AS (
  SELECT vec_id, [floor(1024 * x::DOUBLE) FOR x IN embedding] AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""


def toxicity_model(spark: SparkSession, sf_dir: str, docs: DataFrame) -> toxicity.Model:
    """Fitted on the labels of ids that may be learnt from."""
    return toxicity.fit(docs, table(spark, sf_dir, "labels"), remainder(F.col("id"), 3) != 1)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score, verdict and offending offsets of every document."""
    docs = table(spark, sf_dir, "documents")
    found = toxicity.tag(F.col("text"), toxicity_model(spark, sf_dir, docs), spark)
    held_out = F.coalesce(remainder(F.col("doc_id"), 3) == 1, F.lit(False))
    scored = docs.select("doc_id", held_out.alias("held_out"), found.alias("found"))
    predicted = (F.col("found.score") >= toxicity.THRESHOLD).cast("int")
    return scored.select("doc_id", "held_out", "found.score", predicted.alias("predicted"), "found.spans")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document: 3-word shingles, 3 bits."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle_words=3, max_bits=3)


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base phrases and license labels of every document."""
    return licenses.scan(table(spark, sf_dir, "documents"))


def language_labels(docs: DataFrame) -> DataFrame:
    """Rows whose language may be learnt from."""
    return docs.where(remainder(F.col("doc_id"), 4) != 2).select(F.col("doc_id").alias("id"), "text", "lang")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document."""
    docs = table(spark, sf_dir, "documents")
    found = langid.predict(F.col("text"), langid.fit(language_labels(docs)), spark)
    held_out = F.coalesce(remainder(F.col("doc_id"), 4) == 2, F.lit(False))
    return docs.select("doc_id", held_out.alias("held_out"), found.alias("found")).select("doc_id", "held_out", "found.lang_pred", "found.score")


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and link statistics of every document under two tokenizers."""
    docs = table(spark, sf_dir, "documents")
    pair = align.Aligner(spark, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    runs = pair.link_runs(docs, "doc_id", "text", {"groups_sha256": ("string", align.group_digests(pair.span))})
    return pair.link_scores(runs).withColumnRenamed("id", "doc_id")


def op12_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and quality verdict of every document."""
    judged = quality.judge(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return judged.select("row.doc_id", "counts.n_words", "counts.word_chars", "counts.n_symbols", "counts.n_dup_lines", "counts.n_repeat_words", "base_failed", "kept", "failed")


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding on the four components of most variance, whitened."""
    vectors = table(spark, sf_dir, "embeddings")
    return whitening.whiten(vectors, whitening.fit(vectors, n_components=4, scale=256))


QUERIES = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_decontamination": op2_decontamination,
    "op3_url_filter": op3_url_filter,
    "op4_html_text": op4_html_text,
    "op5_token_counts": op5_token_counts,
    "op6_topk": op6_topk,
    "op7_toxicity": op7_toxicity,
    "op8_simhash": op8_simhash,
    "op9_licenses": op9_licenses,
    "op10_language_id": op10_language_id,
    "op11_alignment": op11_alignment,
    "op12_quality": op12_quality,
    "op13_whitening": op13_whitening,
}
ORACLE_SQL: dict[str, str] = {"op5_token_counts": OP5_SQL, "op6_topk": OP6_SQL}

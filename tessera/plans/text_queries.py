"""D1-D8, S8 and corpus R6 over the driver's ``documents`` table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import text as X
from tessera.sources.tables import Tables


def chunks(spark: SparkSession, sf: str) -> DataFrame:
    return X.chunk_documents(Tables(spark, sf).documents)


def sentences(spark: SparkSession, sf: str) -> DataFrame:
    return X.document_sentences(Tables(spark, sf).documents)


def sentence_candidates(spark: SparkSession, sf: str) -> DataFrame:
    return X.sentence_candidates(X.chunk_documents(Tables(spark, sf).documents))


def previews(spark: SparkSession, sf: str) -> DataFrame:
    return X.chunk_previews(X.chunk_documents(Tables(spark, sf).documents))


def document_filename() -> F.Column:
    """File name a document would have on disk: '<source>_<lang>_<doc_id>.txt'."""
    return F.concat(F.concat_ws("_", "source", "lang", F.col("doc_id").cast("string")), F.lit(".txt")).alias(
        "filename")


def document_table(spark: SparkSession, sf: str) -> DataFrame:
    docs = Tables(spark, sf).documents.select(document_filename(), "text")
    return X.document_table(docs)


def sentence_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return X.dedup_sentences(X.document_sentences(Tables(spark, sf).documents))


QUERIES = {
    "chunks": chunks,
    "sentences": sentences,
    "sentence_candidates": sentence_candidates,
    "previews": previews,
    "document_table": document_table,
    "sentence_dedup": sentence_dedup,
}

# DuckDB (RE2) has no look-behind: end-of-sentence whitespace is first
# rewritten to a newline, then the text is split on newline runs.
SQL_WORDS = r"list_filter(regexp_split_to_array({t}, '\s+'), lambda w: w <> '')"
SQL_SENTENCES = (
    r"list_filter(list_transform(regexp_split_to_array("
    r"regexp_replace({t}, '([.!?])\s+', '\1' || chr(10), 'g'), '\n+'), "
    r"lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: s <> '')"
)
SQL_CHUNKS = f"""ch_w AS (SELECT doc_id, source, {SQL_WORDS.format(t='text')} AS words FROM documents),
ch_l AS (SELECT doc_id, source,
  list_transform(range(0, len(words), 450), lambda s: array_to_string(words[s + 1:s + 500], ' ')) AS cs
  FROM ch_w),
ch_u AS (SELECT doc_id, source, generate_subscripts(cs, 1) - 1 AS chunk, unnest(cs) AS text FROM ch_l),
chunks AS MATERIALIZED (SELECT doc_id::VARCHAR || '-' || chunk::VARCHAR AS chunk_id, doc_id, source,
  CAST(chunk AS INTEGER) AS chunk, text FROM ch_u)"""
SQL_DOC_SENTENCES = f"""se_l AS (SELECT doc_id, source, {SQL_SENTENCES.format(t='text')} AS ss FROM documents),
doc_sentences AS (SELECT doc_id, source, CAST(generate_subscripts(ss, 1) - 1 AS INTEGER) AS pos,
  unnest(ss) AS sentence FROM se_l)"""
SQL_FOLD = "replace(lower({s}), 'ß', 'ss')"
SQL_TITLE = (
    r"array_to_string(list_transform(string_split({s}, ''), lambda ch, i: CASE WHEN i = 1 OR NOT "
    r"regexp_matches(string_split({s}, '')[i - 1], '[\p{{Lu}}\p{{Ll}}\p{{Lt}}]') THEN upper(ch) "
    r"ELSE lower(ch) END), '')"
)

ORACLE_SQL = {
    "chunks": f"WITH {SQL_CHUNKS} SELECT * FROM chunks",
    "sentences": f"WITH {SQL_DOC_SENTENCES} SELECT * FROM doc_sentences",
    "sentence_candidates": f"""WITH {SQL_CHUNKS},
cl AS (SELECT chunk_id, COALESCE(source, 'unknown') AS source, chunk, {SQL_SENTENCES.format(t='text')} AS ss
  FROM chunks WHERE text IS NOT NULL AND text <> '')
SELECT chunk_id, source, chunk, CAST(generate_subscripts(ss, 1) - 1 AS INTEGER) AS pos, unnest(ss) AS content
FROM cl""",
    "previews": rf"""WITH {SQL_CHUNKS}
SELECT chunk_id, substring(regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g'), 1, 300)
  || '...' AS preview FROM chunks""",
    "document_table": rf"""WITH f AS (SELECT source || '_' || lang || '_' || doc_id::VARCHAR || '.txt' AS filename, text
  FROM documents),
t AS (SELECT filename, replace(replace(filename, '.txt', ''), '_', ' ') AS base, text FROM f)
SELECT filename, {SQL_TITLE.format(s='base')} AS title,
  regexp_replace(text, '^\s+|\s+$', '', 'g') AS content FROM t""",
    "sentence_dedup": f"""WITH {SQL_DOC_SENTENCES},
r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY source, {SQL_FOLD.format(s='sentence')} ORDER BY doc_id, pos) AS rn,
  COUNT(*) OVER (PARTITION BY source, {SQL_FOLD.format(s='sentence')}) AS copies FROM doc_sentences)
SELECT source, doc_id, pos, sentence, copies FROM r WHERE rn = 1""",
}

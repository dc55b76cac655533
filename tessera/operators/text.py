"""Text preparation operators (D1-D8, S8, R6 over a corpus).

All are narrow projections + ``posexplode`` (no shuffle), except the corpus
de-duplication, which is one aggregate with map-side partial combine so
that a sentence repeated across a third of the corpus is reduced per task
before the shuffle instead of landing in one window partition.  (The kept copy
is a struct with a string, so Spark plans it as a sort aggregate.)
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T

CHUNK_SIZE = 500
CHUNK_OVERLAP = 50


def chunk_documents(docs: DataFrame, key="doc_id", text="text", source="source",
                    size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP, keep: tuple = ()) -> DataFrame:
    """D1 + D2 + D4: one row per chunk with id 'key-i', source and 0-based index;
    ``keep`` names further columns that the chunks carry."""
    # words are materialised in their own projection: referenced inside the
    # window lambda they would otherwise be re-split for every chunk.
    return docs.select(
        F.col(key).alias("_key"), F.col(source).alias("source"), T.words(text).alias("_words"), *keep,
    ).select(
        "_key", "source", *keep, F.posexplode(T.word_windows("_words", size, overlap)).alias("chunk", "text"),
    ).select(
        F.concat_ws("-", F.col("_key").cast("string"), F.col("chunk").cast("string")).alias("chunk_id"),
        F.col("_key").alias(key), "source", F.col("chunk").cast("int").alias("chunk"), "text", *keep,
    )


def document_sentences(docs: DataFrame, key="doc_id", text="text", keep=("source",)) -> DataFrame:
    """D6 over raw documents: one row per sentence with its 0-based position."""
    return docs.select(key, *keep, F.posexplode(T.sentences(text)).alias("pos", "sentence"))


def sentence_candidates(chunks: DataFrame, text="text") -> DataFrame:
    """Chunks -> sentence candidates carrying source and chunk; a missing
    source becomes 'unknown' (chunk indexes always exist here); empty chunks
    give no rows."""
    return chunks.filter(F.col(text).isNotNull() & (F.col(text) != "")).select(
        "chunk_id",
        F.coalesce(F.col("source"), F.lit("unknown")).alias("source"),
        "chunk",
        F.posexplode(T.sentences(text)).alias("pos", "content"),
    )


def chunk_previews(chunks: DataFrame, text="text", n: int = 300) -> DataFrame:
    """D8 for every chunk."""
    return chunks.select("chunk_id", T.preview(text, n).alias("preview"))


def document_table(docs: DataFrame, filename="filename", text="text") -> DataFrame:
    """Filename, title from the filename, trimmed content."""
    return docs.select(
        F.col(filename).alias("filename"), T.title_chars(filename).alias("_chars"), F.col(text).alias("_t"),
    ).select("filename", T.python_title_chars("_chars").alias("title"), T.strip_ws("_t").alias("content"))


def dedup_sentences(sents: DataFrame, group="source", order=("doc_id", "pos"), sentence="sentence") -> DataFrame:
    """R6 over a corpus: per group keep the first copy of each case-folded
    sentence (first by ``order``) and count the copies.

    ``min(struct(order..., sentence))`` is an ordinary aggregate, so partial
    aggregation collapses hot duplicates before they are shuffled.
    """
    first = F.min(F.struct(*[F.col(c) for c in order], F.col(sentence).alias("_s")))
    return (
        sents.groupBy(group, T.casefold(sentence).alias("_fold"))
        .agg(first.alias("_first"), F.count(F.lit(1)).alias("copies"))
        .select(group, *[F.col(f"_first.{c}").alias(c) for c in order],
                F.col("_first._s").alias(sentence), "copies")
    )

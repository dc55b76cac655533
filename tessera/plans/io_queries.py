"""S1-S7 sinks/sources, X1 runs and the X2/X3 streams bound to driver tables.

The write-then-read queries write into a fresh folder under the session's
checkpoint root (shared storage) and return the rows read back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import cost as K
from tessera.operators.sessions import run_summary, stage_seconds
from tessera.operators.text import chunk_documents
from tessera.plans.ops_queries import CALLS_SQL, _price, model_calls
from tessera.plans.text_queries import SQL_CHUNKS, document_filename
from tessera.session import scratch_path
from tessera.sources import files as S
from tessera.sources.tables import Tables
from tessera.streaming import jobs as X


def run_sessions(spark: SparkSession, sf: str) -> DataFrame:
    """Each user's events grouped into runs opened by a 'signup' event."""
    ev = Tables(spark, sf).events
    return run_summary(ev, F.col("event_type") == "signup")


def run_stages(spark: SparkSession, sf: str) -> DataFrame:
    """Route and seconds per stage of the same runs."""
    found = stage_seconds(Tables(spark, sf).events, F.col("event_type") == "signup")
    return found.select("user_id", "run_no", "event_type", "n_stages", "seconds", F.array_join("route", ",").alias("route"))


def sink_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """S1 + S3: documents written as one text file each (full refresh, twice),
    read back file by file; text identity checked by length and md5."""
    docs = Tables(spark, sf).documents.select(document_filename(), "text")
    path = scratch_path(spark, "doc-files")
    S.write_documents_as_files(docs, path)
    S.write_documents_as_files(docs, path)  # overwrite: still one copy
    back = S.read_documents_from_files(spark, path)
    return back.select("filename", F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("text_md5"))


def text_folder(spark: SparkSession, sf: str) -> DataFrame:
    """A flat folder of text files (the documents, a line end after each),
    read whole file by file; what comes back is counted."""
    path = scratch_path(spark, "text-folder")
    Tables(spark, sf).documents.select(F.coalesce("text", F.lit("")).alias("text")).write.text(path)
    files = S.read_text_folder(spark, path)
    return files.agg(F.sum(F.length("text")).alias("n_chars"),
                     F.sum(F.regexp_count("text", F.lit("\n"))).cast("long").alias("n_line_ends"))


def chunk_store(spark: SparkSession, sf: str) -> DataFrame:
    """The chunk collection refreshed in full, twice (partitioned by source),
    and its current version read back."""
    path = scratch_path(spark, "chunk-store")
    chunks = chunk_documents(Tables(spark, sf).documents)
    S.refresh_table(chunks, path, partition_by=["source"])
    S.refresh_table(chunks, path, partition_by=["source"])  # full refresh
    back = S.read_refreshed(spark, path, chunks.schema)
    return back.select("chunk_id", "doc_id", "source", "chunk", "text")


def logged_calls(t: Tables) -> DataFrame:
    """The priced calls as log records; a call's time is its place in the
    conversation, in minutes after a fixed day for each conversation."""
    at = F.timestamp_seconds(F.lit(1_767_225_600) + F.col("query") * 3600 + F.col("turn") * 60)
    return K.priced(model_calls(t)).select(
        F.to_timestamp_ntz(F.date_format(at, "yyyy-MM-dd HH:mm:ss")).alias("timestamp"),
        F.col("query").cast("string").alias("query"), "agent", "input_tokens", "output_tokens", "cost_usd",
        "cost_per_1000_queries")


def call_log_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """S5 + S6: priced calls appended to a JSON-lines log in two writes, read
    back with the explicit log schema; malformed lines would be kept apart."""
    calls = logged_calls(Tables(spark, sf))
    path = scratch_path(spark, "call-log")
    assistant = F.coalesce(F.col("agent") == "assistant", F.lit(False))
    S.append_jsonl(calls.filter(~assistant), path)
    S.append_jsonl(calls.filter(assistant), path)
    return S.read_call_log(spark, path).filter("malformed IS NULL").drop("malformed").withColumn(
        "timestamp", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss"))


def _midpoint(df: DataFrame, c: str):
    r = df.agg(F.min(c).alias("lo"), F.max(c).alias("hi")).first()  # one row
    return r["lo"], r["hi"]


def stream_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Documents land in two arrivals; an availableNow file stream chunks
    each arrival incrementally.

    Every tenth later document comes in the first arrival already, in a stale
    version, and every seventh in two versions within the second arrival.  Of the
    earlier ones, the second arrival delivers every eleventh again without text,
    every thirteenth as deleted, and of every seventeenth a version older than the
    one that is there."""
    docs = Tables(spark, sf).documents
    lo, hi = _midpoint(docs, "doc_id")
    mid = (lo + hi) // 2 if lo is not None else 0
    landing, sink, ckpt = (scratch_path(spark, n) for n in ("doc-landing", "chunk-sink", "chunk-ckpt"))
    early = F.coalesce(F.col("doc_id") <= mid, F.lit(False))

    def delivery(rows: DataFrame, number: int, text=None, deleted: bool = False) -> DataFrame:
        rows = rows.withColumn("text", text) if text is not None else rows
        return rows.withColumns({"delivery": F.lit(number).cast("long"), "deleted": F.lit(deleted)})

    def some(rows, modulus: int, rest: int):
        return docs.filter(rows & (F.pmod("doc_id", F.lit(modulus)) == rest))

    stale = F.concat(F.lit("stale "), "text")
    first = delivery(docs.filter(early), 1).unionByName(delivery(some(~early, 10, 0), 1, stale))
    second = delivery(docs.filter(~early), 3)
    for rows in (delivery(some(~early, 7, 3), 2, stale), delivery(some(early, 11, 5), 2, F.lit("")),
                 delivery(some(early, 13, 6), 2, deleted=True), delivery(some(early, 17, 4), 0, stale)):
        second = second.unionByName(rows)
    for part in (first, second):
        part.write.mode("append").parquet(landing)
        X.incremental_chunks(spark, landing, first.schema, sink, ckpt)
    return X.latest_documents(spark, sink).select("chunk_id", "doc_id", "source", "chunk", "text")


def stream_cost(spark: SparkSession, sf: str) -> DataFrame:
    """The call log arrives in two halves of its time span; calls, tokens and
    their price per agent and day are maintained by an update-mode stream."""
    calls = logged_calls(Tables(spark, sf))
    lo, hi = _midpoint(calls, "timestamp")
    mid = lo + (hi - lo) / 2 if lo is not None else None
    landing, sink, ckpt = (scratch_path(spark, n) for n in ("log-landing", "cost-sink", "cost-ckpt"))
    early = F.coalesce(F.col("timestamp") <= F.lit(mid).cast("timestamp_ntz"), F.lit(False))
    for part in (calls.filter(early), calls.filter(~early)):
        S.append_jsonl(part, landing)
        X.windowed_call_cost(spark, landing, sink, ckpt)
    return X.latest_windows(spark, sink).select(
        X.window_day("w.start").alias("day"), "agent", "n_calls", "input_tokens", "output_tokens", "cost_usd")


QUERIES = {
    "run_sessions": run_sessions,
    "run_stages": run_stages,
    "sink_roundtrip": sink_roundtrip,
    "text_folder": text_folder,
    "chunk_store": chunk_store,
    "call_log_roundtrip": call_log_roundtrip,
    "stream_chunks": stream_chunks,
    "stream_cost": stream_cost,
}

CALL_TIME_SQL = "strftime(TIMESTAMP '2026-01-01' + to_hours(query) + to_minutes(turn), '%Y-%m-%d %H:%M:%S')"

ORACLE_SQL = {
    "run_sessions": """WITH e AS (SELECT *, CAST(event_type = 'signup' AS INTEGER) AS o FROM events),
r AS (SELECT *, CAST(SUM(o) OVER (PARTITION BY user_id ORDER BY ts, event_id
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS run_no FROM e)
SELECT user_id, run_no, COUNT(*) AS n_events, run_no > 0 AS opened_by_signup,
  ROUND(date_diff('microsecond', MIN(ts), MAX(ts)) / 1e6, 6) AS elapsed_seconds,
  COUNT(*) FILTER (WHERE event_type = 'purchase') AS n_purchases,
  COUNT(*) FILTER (WHERE event_type = 'error') AS n_errors,
  CAST(ROUND(SUM(CAST(value AS DECIMAL(18,2))), 2) AS DOUBLE) AS total_value
FROM r GROUP BY user_id, run_no""",
    "sink_roundtrip": """SELECT source || '_' || lang || '_' || doc_id::VARCHAR || '.txt' AS filename,
  CAST(length(text) AS BIGINT) AS n_chars, md5(text) AS text_md5 FROM documents""",
    "text_folder": """SELECT CAST(SUM(length(coalesce(text, '')) + 1) AS BIGINT) AS n_chars,
  CAST(SUM(length(text) - length(replace(text, chr(10), ''))) + COUNT(*) AS BIGINT) AS n_line_ends FROM documents""",
    "chunk_store": f"WITH {SQL_CHUNKS} SELECT * FROM chunks",
    "run_stages": """WITH e AS (SELECT *, CAST(event_type = 'signup' AS INTEGER) AS o FROM events),
r AS (SELECT *, CAST(SUM(o) OVER (PARTITION BY user_id ORDER BY ts, event_id
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS run_no FROM e),
g AS (SELECT *, date_diff('microsecond', lag(ts) OVER (PARTITION BY user_id, run_no ORDER BY ts, event_id), ts) AS us
  FROM r),
s AS (SELECT user_id, run_no, event_type, COUNT(*) AS n_stages, ROUND(SUM(us) / 1e6, 6) AS seconds
  FROM g WHERE us IS NOT NULL GROUP BY 1, 2, 3)
SELECT *, string_agg(event_type, ',') OVER (PARTITION BY user_id, run_no ORDER BY event_type
  ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS route FROM s""",
    "call_log_roundtrip": f"""WITH {CALLS_SQL}
SELECT {CALL_TIME_SQL} AS timestamp, query::VARCHAR AS query, agent, input_tokens, output_tokens,
  {_price('input_tokens', 'output_tokens')} FROM calls""",
    "stream_chunks": f"""WITH {SQL_CHUNKS}, m AS (SELECT (MIN(doc_id) + MAX(doc_id)) // 2 AS mid FROM documents)
SELECT chunks.* FROM chunks CROSS JOIN m
WHERE NOT (doc_id <= mid AND (doc_id % 11 = 5 OR doc_id % 13 = 6))""",
    "stream_cost": f"""WITH {CALLS_SQL},
d AS (SELECT substr({CALL_TIME_SQL}, 1, 10) AS day, agent, COUNT(*) AS n_calls,
  CAST(SUM(input_tokens) AS BIGINT) AS input_tokens, CAST(SUM(output_tokens) AS BIGINT) AS output_tokens
  FROM calls GROUP BY 1, 2)
SELECT *, CAST((15 * input_tokens + 90 * output_tokens + 5) // 10 AS DOUBLE) / 1000000.0 AS cost_usd FROM d""",
}

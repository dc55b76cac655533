"""Structured Streaming jobs (X2, X3) over file sources.

Both are incremental and restartable: state and progress live in a
checkpoint folder under shared storage, sinks are written per micro-batch into
``batch_id=<n>`` folders with overwrite, so a replayed batch replaces its own
output (idempotent foreachBatch).  ``availableNow`` processes what has
arrived and stops, which is how a scheduled incremental job runs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators.cost import call_cost, clean_tokens
from tessera.operators.text import chunk_documents
from tessera.sources.files import CALL_LOG_SCHEMA

WATERMARK = "1 day"
WINDOW = "1 day"


def _batch_sink(path: str, transform=None):
    def write(batch: DataFrame, batch_id: int) -> None:
        out = transform(batch) if transform else batch
        out.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return write


def run_available(stream: DataFrame, sink: str, checkpoint: str, transform=None, mode: str = "append") -> None:
    """Process everything that has arrived, then stop."""
    q = (stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
         .foreachBatch(_batch_sink(sink, transform)).trigger(availableNow=True).start())
    q.awaitTermination()


def latest_versions(batch: DataFrame, key: str, sequence: str) -> DataFrame:
    """One row a key: the one delivered last, and among equal numbers the one
    whose columns hash highest, so that every run keeps the same.  Rows without a
    key cannot replace each other and all stay."""
    columns = [F.col(c) for c in batch.columns]
    last = F.max_by(F.struct(*columns), F.struct(F.col(sequence), F.xxhash64(*columns)))
    keyed = batch.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("_k")).agg(last.alias("_row")).select("_row.*")
    return keyed.unionByName(batch.filter(F.col(key).isNull()))


def incremental_chunks(spark: SparkSession, landing: str, schema: T.StructType, sink: str, checkpoint: str,
                       key: str = "doc_id", sequence: str = "delivery", deleted: str = "deleted",
                       max_files: int = 64) -> None:
    """Chunk newly arrived documents (in place of the full refresh).

    A document may be delivered again, with other text, empty, or with ``deleted``
    set; of several deliveries the one with the largest ``sequence`` holds, also
    when an older one arrives later.  Without that column a delivery's number is
    the modification time of its file, without ``deleted`` nothing is deleted.

    Every micro-batch first writes its chunks, then a manifest of (key, sequence,
    deleted).  ``latest_documents`` reads chunks by way of the manifest only, so a
    batch that died between the two is not seen, and a document without chunks is
    still known to be delivered.  Both are overwritten when a batch is replayed.
    ``max_files`` only throttles a micro-batch."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(landing)
    if sequence not in schema.names:
        stream = stream.withColumn(sequence, F.unix_micros(F.col("_metadata.file_modification_time")))
    gone = F.coalesce(F.col(deleted), F.lit(False)) if deleted in schema.names else F.lit(False)

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = latest_versions(batch, key, sequence).withColumn("_gone", gone)
        chunks = chunk_documents(rows.filter(~F.col("_gone")), key=key, keep=(sequence,))
        chunks.write.mode("overwrite").parquet(f"{sink}/chunks/batch_id={batch_id}")
        manifest = rows.select(key, F.col(sequence).alias("sequence"), F.col("_gone").alias("deleted"))
        manifest.write.mode("overwrite").parquet(f"{sink}/manifest/batch_id={batch_id}")

    (stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write)
     .trigger(availableNow=True).start().awaitTermination())


def deliveries(spark: SparkSession, sink: str, key="doc_id") -> DataFrame:
    """The manifest's last entry of every key: (key, sequence, batch_id, deleted)."""
    last = F.max(F.struct("sequence", "batch_id", "deleted")).alias("_last")
    manifest = spark.read.parquet(f"{sink}/manifest")
    return manifest.filter(F.col(key).isNotNull()).groupBy(key).agg(last).select(key, "_last.*")


def latest_documents(spark: SparkSession, sink: str, key="doc_id", sequence="delivery") -> DataFrame:
    """The chunks of every document's latest delivery, and those of all rows
    delivered without a key."""
    chunks = spark.read.parquet(f"{sink}/chunks")
    last = deliveries(spark, sink, key).select(F.col(key).alias("_k"), F.col("sequence").alias("_s"), F.col("batch_id").alias("_b"))
    same = (F.col(key) == F.col("_k")) & F.col(sequence).eqNullSafe(F.col("_s")) & (F.col("batch_id") == F.col("_b"))
    manifest = spark.read.parquet(f"{sink}/manifest")
    without = manifest.filter(F.col(key).isNull()).select("batch_id").distinct()
    unkeyed = chunks.filter(F.col(key).isNull()).join(without, "batch_id", "left_semi")
    return chunks.join(last, same, "left_semi").unionByName(unkeyed).drop(sequence, "batch_id")


def event_instant(ts: str) -> F.Column:
    """Watermarks need TIMESTAMP; a TIMESTAMP_NTZ wall-clock value is mapped
    to the instant with that wall clock in UTC (via epoch micros, not the
    session time zone), so day windows start at wall-clock midnight."""
    micros = F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {ts})")
    return F.timestamp_micros(micros)


def window_day(c: str) -> F.Column:
    """'yyyy-MM-dd' of a window bound, independent of the session time zone."""
    return F.date_format(F.date_from_unix_date(F.floor(F.unix_micros(F.col(c)) / F.lit(86_400_000_000)).cast("int")),
                         "yyyy-MM-dd")


def windowed_call_cost(spark: SparkSession, landing: str, sink: str, checkpoint: str) -> None:
    """Per day and agent, calls, tokens and their price (K1 on the sums),
    from the JSON-lines call log, as an update-mode stream.

    Late-data policy: the watermark trails the largest call time seen by
    ``WATERMARK``; a call older than that when it arrives is dropped and the
    window it belonged to is final.  Malformed lines are no calls.  Each
    micro-batch emits the windows it changed (update mode)."""
    stream = (spark.readStream.schema(CALL_LOG_SCHEMA).option("columnNameOfCorruptRecord", "malformed").json(landing)
              .where("malformed IS NULL").withColumn("_evt", event_instant("timestamp")))
    agg = (
        stream.withWatermark("_evt", WATERMARK)
        .groupBy(F.window("_evt", WINDOW).alias("w"), "agent")
        .agg(F.count(F.lit(1)).alias("n_calls"), F.sum(clean_tokens("input_tokens")).alias("input_tokens"),
             F.sum(clean_tokens("output_tokens")).alias("output_tokens"))
    )
    run_available(agg.withColumn("cost_usd", call_cost("input_tokens", "output_tokens")), sink, checkpoint,
                  mode="update")


def latest_windows(spark: SparkSession, sink: str, kind="agent") -> DataFrame:
    """Upsert view of an update-mode sink: per window and key, the row of the
    latest batch that touched it."""
    df = spark.read.parquet(sink)
    w = Window.partitionBy("w", kind).orderBy(F.desc("batch_id"))
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")

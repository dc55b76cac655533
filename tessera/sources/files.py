"""Sources and sinks S1, S3-S7.

All paths are folders in shared storage (the session's checkpoint root when no
explicit path is given): never a machine-local temp folder on a cluster.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CALL_LOG_SCHEMA = T.StructType([
    T.StructField("timestamp", T.TimestampNTZType()),
    T.StructField("query", T.StringType()),
    T.StructField("agent", T.StringType()),
    T.StructField("input_tokens", T.LongType()),
    T.StructField("output_tokens", T.LongType()),
    T.StructField("cost_usd", T.DoubleType()),
    T.StructField("cost_per_1000_queries", T.DoubleType()),
    T.StructField("malformed", T.StringType()),
])

_LISTED = pa.schema([("filename", pa.string()), ("file", pa.string())])
_READ = pa.schema([("filename", pa.string()), ("value", pa.binary())])
#: Bytes of file contents that a reading task gathers before it hands them on.
READ_BYTES = 16 << 20


def read_text_folder(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """Every ``*.txt`` directly inside ``path`` (not recursive), one row
    per file: (filename, text), ordered by name."""
    df = (spark.read.option("pathGlobFilter", "*.txt").option("recursiveFileLookup", str(recursive).lower())
          .text(path, wholetext=True))
    return df.select(F.col("_metadata.file_name").alias("filename"), F.col("value").alias("text")).orderBy(
        "filename")


def _files_uri(spark: SparkSession, path: str) -> str | None:
    """``path`` as the URI by which tasks open files of their own through
    ``pyarrow.fs``; None where that does not know the store or lacks its library."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    uri = folder.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(folder).toUri().toASCIIString()
    try:
        fs.FileSystem.from_uri(uri)
    except (pa.ArrowInvalid, OSError):
        return None
    return uri


def _disk_name(name: str | None) -> str:
    """A document's name as one file name: what has a meaning in paths, or would
    hide the file, becomes %XX."""
    if name is None:
        return "__HIVE_DEFAULT_PARTITION__"
    return re.sub(r"^[._]|[\x00-\x1f\x7f\"#%'*/:=?\\{\[\]^]", lambda m: f"%{ord(m[0]):02X}", name)


def write_documents_as_files(docs: DataFrame, path: str, filename="filename", text="text") -> None:
    """One text file per document (full refresh), under the document's name.

    Each task writes its documents into a folder of its own below
    ``path/_documents``; what Spark writes to ``path`` is the list of their names
    and files.  A task's part of the list is committed once, so files of attempts
    that failed or ran twice are not listed, and not read.  Rows of one name in a
    task share a file, a line end after each.

    Where only Spark can write to the store, each document gets a
    ``filename=<name>`` folder holding one file."""
    uri = _files_uri(docs.sparkSession, path)
    if uri is None:
        docs.select(filename, text).write.mode("overwrite").partitionBy(filename).text(path)
        return

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(uri)
        folder, last, out = f"_documents/{uuid.uuid4().hex}", None, None
        try:
            for batch in batches:
                listed = []
                for name, value in ((a.as_py(), b.as_py()) for a, b in zip(*batch.columns, strict=True)):
                    if out is None:
                        store.create_dir(f"{root}/{folder}")
                    if out is None or name != last:
                        if out is not None:
                            out.close()
                        file = f"{folder}/{_disk_name(name)}"
                        last, out = name, store.open_output_stream(f"{root}/{file}")
                        listed.append({"filename": name, "file": file})
                    out.write((value or b"") + b"\n")
                yield pa.RecordBatch.from_pylist(listed, _LISTED)
        finally:
            if out is not None:
                out.close()

    name = F.nullif(F.make_valid_utf8(F.col(filename)), F.lit(""))
    rows = docs.select(name.alias("filename"), F.col(text).cast("binary").alias("text"))
    # equal names in a row: a task has one file open
    listed = rows.sortWithinPartitions("filename").mapInArrow(write, "filename string, file string")
    listed.write.mode("overwrite").parquet(path)


def read_documents_from_files(spark: SparkSession, path: str) -> DataFrame:
    """Inverse of ``write_documents_as_files``; the writer's line separator
    after each value is removed again."""
    uri = _files_uri(spark, path)
    if uri is None:
        # an explicit schema: inferred partition values would turn "007" into 7
        df = spark.read.schema("value string, filename string").text(path, wholetext=True)
    else:

        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            store, root = fs.FileSystem.from_uri(uri)
            rows, size = [], 0
            for batch in batches:
                for r in batch.to_pylist():
                    with store.open_input_file(f"{root}/{r['file']}") as f:
                        rows.append({"filename": r["filename"], "value": f.read()})
                    size += len(rows[-1]["value"])
                    if size >= READ_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, _READ)
                        rows, size = [], 0
            yield pa.RecordBatch.from_pylist(rows, _READ)

        # the list is short where the files are long: their number deals them out
        tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
        listed = spark.read.schema("filename string, file string").parquet(path).repartition(tasks, "file")
        df = listed.mapInArrow(read, "filename string, value binary").withColumn("value", F.col("value").cast("string"))
    return df.select("filename",
                     F.regexp_replace("value", r"\n\z", "").alias("text"))


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Drop + create + insert is a full overwrite."""
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


class EmptyCollection(ValueError):
    """The collection was never written, or holds no rows."""


def current_version(spark: SparkSession, path: str) -> str | None:
    """Name of the version that readers of ``path`` get (one row is read)."""
    try:
        names = spark.read.schema("value string").text(f"{path}/versions")
        return names.agg(F.max("value")).head()[0]
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def refresh_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> str:
    """A full refresh that readers see as a whole or not at all.

    The rows go to a version folder of their own; when they are all there, its
    name is added to ``versions``.  A refresh that fails, or is still running,
    changes nothing for readers, and a reader keeps the version it resolved.
    Of two refreshes at once the one with the greater name stays.  Returns the
    version's name."""
    spark = df.sparkSession
    last = current_version(spark, path)
    version = f"{int(last.split('-')[0]) + 1 if last else 1:012d}-{uuid.uuid4().hex}"
    w = df.write.mode("error")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(f"{path}/data/{version}")
    spark.createDataFrame([(version,)], "value string").coalesce(1).write.mode("append").text(f"{path}/versions")
    return version


def read_refreshed(spark: SparkSession, path: str, schema: T.StructType, require_rows: bool = False) -> DataFrame:
    """The collection's current version.  Never written: EmptyCollection.
    ``require_rows``: also where it holds no rows (S7, one row is read)."""
    version = current_version(spark, path)
    if version is None:
        raise EmptyCollection(f"{path} was never written")
    df = spark.read.schema(schema).parquet(f"{path}/data/{version}")  # no inferred partition types
    if require_rows and is_empty(df):
        raise EmptyCollection(f"{path} holds no rows")
    return df


def append_jsonl(df: DataFrame, path: str) -> None:
    """Append one JSON line per row."""
    df.write.mode("append").json(path)


def read_call_log(spark: SparkSession, path: str, schema: T.StructType = CALL_LOG_SCHEMA) -> DataFrame:
    """The call log with an explicit schema (no inference pass).  ISO
    timestamps become TIMESTAMP_NTZ; a line that is no valid JSON object of this
    shape is kept whole in ``malformed``, and is not a call."""
    return spark.read.schema(schema).option("columnNameOfCorruptRecord", "malformed").json(path)


def is_empty(df: DataFrame) -> bool:
    """Where an error is wanted for an empty collection (one row read)."""
    return df.isEmpty()

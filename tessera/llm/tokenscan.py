"""Operator 5: token counts by scanning flat token files for separators.

A flat file is nothing but token ids of a fixed width, little endian, every
document followed by the end-of-document id; there is no index of where
documents start.  The files are cut into blocks of a fixed number of bytes, and
the executors read the blocks by their byte ranges.  A block finds its separators
with one vectorised comparison and reports how many there are and where the last
one is.  A prefix scan over the blocks of a file (a sum of the counts, a maximum
of the last positions) then tells every block which document it starts in and
where that document began, which stitches documents that run over any number of
blocks.  The scan has two levels, blocks within a stretch of ``STRETCH`` blocks
and then the stretches, so that one huge file is not one task's work.

Defined results: two separators in a row are an empty document; tokens after the
last separator of a file are an unfinished document, reported with ``ended``
false (nothing if the file ends with a separator); an empty file has no
documents.  A file whose length is no multiple of the width raises an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import byte_words, col, stored

STRETCH = 1024  # blocks of the lower level of the prefix scan
BLOCK_BYTES = 2 << 20
HEAD = 5  # tokens before a document's own that write its id
WORD_IDS = 65_535  # ids 1.. of the words; 0 ends a document


# ----------------------------------------------------------------- writing


def word_tokens(doc_id: Column, text: Column) -> Column:
    """The document as uint16 ids: HEAD digits of its id, then a hash of every
    word; id 0 never occurs.  (A stand-in for any tokenizer's ids.)"""

    @F.arrow_udf("binary")
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        from zlib import crc32

        for ids, texts in batches:
            out = []
            for i, t in zip(ids.to_pylist(), texts):
                number = 0 if i is None else (i & (1 << 64) - 1) + 1
                head = [number // WORD_IDS**k % WORD_IDS for k in range(HEAD)]
                words = [crc32(w) % WORD_IDS for w in byte_words(t.as_py())]
                out.append((np.array(head + words, np.uint32) + 1).astype("<u2").tobytes())
            yield pa.array(out, pa.binary())

    return run(doc_id.cast("bigint"), text)


def head_id(head: Column) -> Column:
    """The id that ``word_tokens`` wrote into the first HEAD tokens (null: none)."""
    # exact in decimals, then brought back into the range of a signed bigint
    number = sum((((head[k] - 1).cast("decimal(20,0)") * F.lit(str(WORD_IDS**k)).cast("decimal(20,0)")).cast("decimal(38,0)") for k in range(HEAD)), F.lit("0").cast("decimal(38,0)")) - 1
    wrapped = F.when(number >= F.lit(str(1 << 63)).cast("decimal(38,0)"), number - F.lit(str(1 << 64)).cast("decimal(38,0)")).otherwise(number)
    return F.when(number >= 0, wrapped).cast("bigint")


def write_token_files(tokens: DataFrame, path: str, token_col: str = "tokens") -> None:
    """Write binary token runs as flat files, id 0 (two zero bytes) after each.

    Spark's text writer puts the bytes of a string and a line separator one after
    the other, which is the format wanted; a lost task's file is written anew."""
    tokens.select(col(token_col).cast("string").alias("value")).write.option("lineSep", "\x00\x00").option("compression", "none").text(path)


# ---------------------------------------------------------------- scanning


def blocks_of(spark: SparkSession, path: str, block_bytes: int, width: int) -> DataFrame:
    """(file, block, at, size): byte ranges of every file below ``path``; only
    names and lengths are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.col("path").alias("file"), F.col("length").alias("bytes"))
    whole = F.when(F.col("bytes") % width != 0, F.raise_error(F.concat(F.lit("no whole number of tokens: "), "file"))).otherwise(F.col("bytes"))
    files = files.select("file", whole.cast("bigint").alias("bytes")).where("bytes > 0")
    cut = files.select("file", "bytes", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("bytes") - 1) / block_bytes).cast("bigint"))).alias("block"))
    return cut.select("file", "bytes", "block", (F.col("block") * block_bytes).alias("at"), F.least(F.lit(block_bytes).cast("bigint"), F.col("bytes") - F.col("block") * block_bytes).alias("size"))


_BLOCK = pa.schema([
    ("file", pa.string()), ("block", pa.int64()), ("last", pa.bool_()), ("n_end", pa.int64()), ("last_end", pa.int64()),
    ("ends", pa.list_(pa.int64())), ("starts", pa.list_(pa.int64())), ("heads", pa.list_(pa.list_(pa.int64()))), ("tokens", pa.int64()),
])


def count_tokens(spark: SparkSession, path: str, eod: int = 0, width: int = 2, head: int = 0, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(file, document, start, n_tokens, head, ended): every document of the flat
    files, with its place, its number of tokens, and its first ``head`` ids."""
    block_bytes -= block_bytes % width
    if block_bytes <= 0 or width not in (1, 2, 4):
        raise ValueError("blocks must hold tokens of 1, 2 or 4 bytes")
    kind = f"<u{width}"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            for r in batch.to_pylist():
                store, name = fs.FileSystem.from_uri(r["file"])
                with store.open_input_file(name) as f:
                    # the heads of documents that start at the end reach beyond it
                    data = np.frombuffer(f.read_at(min(r["size"] + head * width, r["bytes"] - r["at"]), r["at"]), kind)
                n, first = r["size"] // width, r["at"] // width
                ends = np.flatnonzero(data[:n] == eod)
                starts = np.concatenate([[0], ends + 1]) if r["at"] == 0 else ends + 1
                places = starts[:, None] + np.arange(head)[None, :]
                there = places < len(data)
                heads = data[places[there]].astype(np.int64)
                offsets = np.concatenate([[0], np.cumsum(there.sum(axis=1))]).astype(np.int32)
                row = {"file": r["file"], "block": r["block"], "last": r["at"] + r["size"] == r["bytes"], "n_end": len(ends),
                       "last_end": int(ends[-1]) + first if len(ends) else None, "tokens": r["bytes"] // width}
                lists = {"ends": pa.array(ends + first), "starts": pa.array(starts + first), "heads": pa.ListArray.from_arrays(pa.array(offsets), pa.array(heads))}
                columns = [pa.array([row[f.name]], f.type) if f.name in row else pa.ListArray.from_arrays(pa.array([0, len(lists[f.name])], pa.int32()), lists[f.name]) for f in _BLOCK]
                yield pa.RecordBatch.from_arrays(columns, schema=_BLOCK)

    plan = blocks_of(spark, path, block_bytes, width).repartition("file", "block")
    found = stored(
        plan.mapInArrow(read, "file string, block bigint, last boolean, n_end bigint, last_end bigint, ends array<bigint>, starts array<bigint>, heads array<array<bigint>>, tokens bigint"), "token-blocks"
    )
    found = found.withColumn("stretch", F.floor(F.col("block") / STRETCH))
    before = Window.partitionBy("file").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    stretches = found.groupBy("file", "stretch").agg(F.sum("n_end").alias("n"), F.max("last_end").alias("end"))
    carried = stretches.select("file", "stretch", F.sum("n").over(before).alias("n0"), F.max("end").over(before).alias("end0"))
    inner = Window.partitionBy("file", "stretch").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    placed = found.select("file", "stretch", "block", "n_end", "last_end").select(
        "file", "stretch", "block", F.sum("n_end").over(inner).alias("n1"), F.max("last_end").over(inner).alias("end1")
    )
    zero = F.lit(0).cast("bigint")
    carry = placed.join(carried, ["file", "stretch"]).select(
        "file", "block", (F.coalesce("n0", zero) + F.coalesce("n1", zero)).alias("before"), F.coalesce("end1", "end0", F.lit(-1).cast("bigint")).alias("last_before")
    )
    rows = found.join(carry, ["file", "block"])
    # Documents that end in the block: each starts after the separator before it.
    ended = rows.select("file", "before", "last_before", "ends", F.posexplode("ends").alias("i", "end")).select(
        "file", (F.col("before") + F.col("i")).alias("document"),
        (F.when(F.col("i") == 0, F.col("last_before")).otherwise(F.get("ends", F.col("i") - 1)) + 1).alias("start"), "end", F.lit(True).alias("ended"),
    )
    last_end = F.coalesce("last_end", "last_before")
    open_end = rows.where("last").select("file", (F.col("before") + F.col("n_end")).alias("document"), (last_end + 1).alias("start"), F.col("tokens").alias("end"), F.lit(False).alias("ended")).where("start < end")
    counted = ended.unionByName(open_end).select("file", "document", "start", (F.col("end") - F.col("start")).alias("n_tokens"), "ended")
    if not head:
        return counted.withColumn("head", F.array().cast("array<bigint>"))
    heads = found.select("file", F.explode(F.arrays_zip("starts", "heads")).alias("h")).select("file", F.col("h.starts").alias("start"), F.col("h.heads").alias("head"))
    return counted.join(heads, ["file", "start"])

"""Helpers shared by the operators: words, packed rows, shared tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import scratch_path, ship_package

# Bytes that separate words: everything below 0x80 that is no digit or letter.
# Working on the UTF-8 bytes keeps every character from 0x80 up inside a word.
_KEEP = frozenset(range(0x30, 0x3A)) | frozenset(range(0x61, 0x7B)) | frozenset(range(0x41, 0x5B))
WORD_TABLE = bytes(b if b >= 0x80 or b in _KEEP else 0x20 for b in range(256)).translate(
    bytes.maketrans(bytes(range(0x41, 0x5B)), bytes(range(0x61, 0x7B)))
)


def byte_words(text: str | None) -> list[bytes]:
    """Lower-case A-Z and cut into words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``."""
    return text.encode("utf-8").translate(WORD_TABLE).split() if text else []


def col(name: str) -> Column:
    """A column by its exact name (dots and spaces included)."""
    return F.col("`" + name.replace("`", "``") + "`")


def packed(df: DataFrame, alias: str = "row") -> Column:
    """All columns of ``df`` as one struct, so that new columns cannot clash."""
    return F.struct(*[col(c) for c in df.columns]).alias(alias)


def unpacked(df: DataFrame, alias: str = "row") -> DataFrame:
    return df.select(f"{alias}.*")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once into the shared folder of ``spark.checkpoint.dir`` and
    read it back: cuts the lineage, and survives the loss of executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def remainder(id_column: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus`` (null id: null)."""
    return F.crc32(id_column.cast("string").cast("binary")) % F.lit(modulus)

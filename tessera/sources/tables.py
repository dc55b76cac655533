"""Relational tables by name (parquet)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels",
    "conversations",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Scan one driver table; Catalyst prunes columns and pushes filters."""
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}")
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def discover(spark: SparkSession, sf_dir: str) -> list[str]:
    """Names of the tables that a folder holds (one directory listing by the
    file system of the path)."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(sf_dir)
    found = folder.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(folder)
    names = (f.getPath().getName() for f in found)
    return sorted(n.removesuffix(".parquet") for n in names if n.endswith(".parquet"))


def register_views(spark: SparkSession, sf_dir: str, names=TABLES) -> None:
    """Register every table as a temp view so SQL text can name it."""
    for name in names:
        table(spark, sf_dir, name).createOrReplaceTempView(name)


class Tables:
    """Lazy accessor: ``Tables(spark, sf_dir).orders``."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return table(self.spark, self.sf_dir, name)
        raise AttributeError(name)

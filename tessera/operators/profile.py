"""G5 over growing tables: a profile kept as mergeable sketches, one for each file.

Every data file is read once, when it is new: its rows and nulls are counted and
its distinct values sketched (HyperLogLog).  A table's profile merges the rows of
the files that it has now, so a file that was deleted leaves the profile and
nothing is read again.  Data files are taken as written once: a file that is
replaced must get a new name, as Spark's writers give it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SKETCH_SCHEMA = T.StructType([
    T.StructField("table_name", T.StringType()),
    T.StructField("file", T.StringType()),
    T.StructField("column_position", T.IntegerType()),
    T.StructField("column_name", T.StringType()),
    T.StructField("row_count", T.LongType()),
    T.StructField("null_values", T.LongType()),
    T.StructField("sketch", T.BinaryType()),
])


def _sketchable(field: T.StructField) -> Column:
    """Types without a sketch of their own are sketched by their text."""
    c = F.col(f"`{field.name}`")
    own = isinstance(field.dataType, (T.IntegerType, T.LongType, T.StringType, T.BinaryType))
    return c if own else c.cast("string")


def file_sketches(name: str, df: DataFrame) -> DataFrame:
    """One row for each file and column of a file table: one scan, and only
    counts and sketches are shuffled."""
    fields = df.schema.fields
    file = "_file"
    while file in df.columns:
        file += "_"
    # named as DataFrame.inputFiles names them, which _metadata does not
    agg = df.withColumn(file, F.input_file_name()).groupBy(file).agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.count_if(F.col(f"`{f.name}`").isNull()).alias(f"_n{i}") for i, f in enumerate(fields)],
        *[F.hll_sketch_agg(_sketchable(f)).alias(f"_s{i}") for i, f in enumerate(fields)])
    rows = F.inline(F.array(*[
        F.struct(F.lit(i).alias("column_position"), F.lit(f.name).alias("column_name"), F.col("_rows").alias("row_count"),
                 F.col(f"_n{i}").alias("null_values"), F.col(f"_s{i}").alias("sketch"))
        for i, f in enumerate(fields)]))
    return agg.select(F.lit(name).alias("table_name"), F.col(file).alias("file"), rows)


def update_sketches(spark: SparkSession, path: str, frames: dict[str, DataFrame]) -> int:
    """Sketches the files of ``frames`` (parquet tables by name, without partition
    folders, whose columns are not in the files) that ``path`` does not hold yet; returns their number.  One append for each table, so a
    job that dies leaves whole tables only.  The driver handles file names, which
    Spark's own listing holds there anyway."""
    done = 0
    spark.createDataFrame([], SKETCH_SCHEMA).write.mode("append").parquet(path)  # the folder exists
    for name, df in frames.items():
        known = spark.read.schema(SKETCH_SCHEMA).parquet(path).where(F.col("table_name") == name).select("file").distinct()
        new = sorted(set(df.inputFiles()) - {r["file"] for r in known.collect()})
        if new:
            file_sketches(name, spark.read.schema(df.schema).parquet(*new)).write.mode("append").parquet(path)
        done += len(new)
    return done


def merged_profile(spark: SparkSession, path: str, frames: dict[str, DataFrame]) -> DataFrame:
    """Rows, nulls and estimated distinct values per table and column, from the
    sketches of the files that the tables hold now.  A table without rows in any
    file has no rows here."""
    here = [(name, f) for name, df in frames.items() for f in df.inputFiles()]
    files = spark.createDataFrame(here, "table_name string, file string")
    # a file sketched twice, by two writers at once, counts once
    rows = spark.read.schema(SKETCH_SCHEMA).parquet(path).dropDuplicates(["table_name", "file", "column_position"])
    return rows.join(files, ["table_name", "file"], "left_semi").groupBy("table_name", "column_position", "column_name").agg(
        F.sum("row_count").alias("row_count"), F.sum("null_values").alias("null_values"),
        F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("distinct_estimate"))

"""Versioned refreshes.  G5: a profile from one sketch a file."""

import pytest
from pyspark.sql import functions as F

from tessera.operators import profile as P
from tessera.sources import files as S

SCHEMA = "id long, source string"


def numbers(spark, n):
    return spark.range(n).select("id", (F.col("id") % 3).cast("string").alias("source"))


def ids(spark, path):
    return sorted(r.id for r in S.read_refreshed(spark, path, numbers(spark, 0).schema).collect())


def test_failed_refresh_leaves_the_old_rows(spark, tmp_path):
    path = str(tmp_path / "store")
    with pytest.raises(S.EmptyCollection):
        ids(spark, path)
    S.refresh_table(numbers(spark, 5), path, ["source"])
    bad = numbers(spark, 9).withColumn("id", F.when(F.col("id") == 8, F.raise_error(F.lit("no")).cast("long")).otherwise(F.col("id")))
    with pytest.raises(Exception, match="no"):
        S.refresh_table(bad, path, ["source"])
    assert ids(spark, path) == [0, 1, 2, 3, 4]
    # rows that are all written, but not named yet, are not seen either
    numbers(spark, 7).write.partitionBy("source").parquet(f"{path}/data/000000000009-x")
    assert ids(spark, path) == [0, 1, 2, 3, 4]


def test_reader_keeps_its_version_and_later_ones_win(spark, tmp_path):
    path = str(tmp_path / "store")
    names = [S.refresh_table(numbers(spark, 5), path)]
    before = S.read_refreshed(spark, path, numbers(spark, 0).schema)
    names += [S.refresh_table(numbers(spark, n), path) for n in (3, 0)]
    assert names == sorted(names) and S.current_version(spark, path) == names[-1]
    assert before.count() == 5 and ids(spark, path) == []
    with pytest.raises(S.EmptyCollection):
        S.read_refreshed(spark, path, before.schema, require_rows=True)


def profile(spark, path, table):
    rows = P.merged_profile(spark, path, {"t": spark.read.parquet(table)}).orderBy("column_position").collect()
    return [(r.column_name, r.row_count, r.null_values, r.distinct_estimate) for r in rows]


def test_sketches_grow_by_new_files_and_forget_deleted_ones(spark, tmp_path):
    table, path = str(tmp_path / "t"), str(tmp_path / "sketches")

    def add(first, last):
        rows = spark.range(first, last, 1, 2).select(
            "id", (F.col("id") % 7).cast("double").alias("few. x"), F.when(F.col("id") % 4 == 0, F.col("id")).alias("some"),
            F.array(F.col("id") % 5).alias("list"), F.lit(None).cast("date").alias("none"))
        rows.write.mode("append").parquet(table)
        return P.update_sketches(spark, path, {"t": spark.read.parquet(table)})

    assert add(0, 30000) == 2
    first = set(spark.read.parquet(table).inputFiles())
    assert add(20000, 50000) == 2  # a third of the ids are there already
    assert P.update_sketches(spark, path, {"t": spark.read.parquet(table)}) == 0
    got = {name: rest for name, *rest in profile(spark, path, table)}
    assert {k: v[:2] for k, v in got.items()} == {"id": [60000, 0], "few. x": [60000, 0], "some": [60000, 45000], "list": [60000, 0], "none": [60000, 60000]}
    assert abs(got["id"][2] - 50000) <= 0.05 * 50000 and abs(got["some"][2] - 12500) <= 0.05 * 12500
    assert (got["few. x"][2], got["list"][2], got["none"][2]) == (7, 5, 0)
    # only the later files: the others' sketches no longer count
    later = sorted(set(spark.read.parquet(table).inputFiles()) - first)
    rest = P.merged_profile(spark, path, {"t": spark.read.parquet(*later)}).where("column_name = 'id'").head()
    assert rest.row_count == 30000 and abs(rest.distinct_estimate - 30000) <= 0.05 * 30000

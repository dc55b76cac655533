"""A table of statements against each statement run alone."""

import pytest
from pyspark.sql import functions as F

from tessera.operators import sqlaudit as G
from tessera.operators.statements import run_statements, shaped

STATEMENTS = [
    "SELECT * FROM sales WHERE id = 1", "SELECT * FROM sales WHERE id = 3", "SELECT * FROM sales WHERE id = 99",
    "SELECT * FROM sales WHERE id = 1", "SELECT kind, count(*) FROM sales WHERE kind = 'b' GROUP BY kind",
    "SELECT kind, count(*) FROM sales WHERE kind = 'it' GROUP BY kind",
    "SELECT 10 / (id - 3) AS x FROM sales WHERE id = 1", "SELECT 10 / (id - 3) AS x FROM sales WHERE id = 3",
    "SELECT 10 / (id - 3) AS x FROM sales WHERE id = 4", "SELECT 1 / 0 AS x", "SELECT 1 / 2 AS x",
    "SELECT * FROM sales WHERE amount > 15", "SELECT * FROM sales WHERE amount > 25",
    "SELECT * FROM sales ORDER BY id LIMIT 2", "SELECT kind, sum(amount) FROM sales GROUP BY 1",
    "WITH t AS (SELECT * FROM sales WHERE id = 2) SELECT count(*) FROM t",
    "SELECT * FROM sales WHERE kind = 'it''s'", "SELECT * FROM sales -- 5 of 'them'",
    "SELECT DATE '2024-01-01' AS d, 7 AS n", "SELECT DATE '2024-13-01' AS d, 7 AS n", "SELECT 'a 5' AS a, 5 AS a", "SELECT missing FROM sales WHERE id = 5",
    "SELECT * FROM other WHERE id = 5", "SELECT * FROM parquet.`/tmp`", "SELECT * FROM sales; SELECT 2",
    "DROP TABLE sales", "SELECT round(amount, 1) AS r FROM sales WHERE id = 2", "SELECT * FROM", "", None,
]


@pytest.fixture()
def sales(spark):
    spark.createDataFrame([(i, "abc"[i % 3], i * 10.0) for i in range(1, 6)], "id int, kind string, amount double").createOrReplaceTempView("sales")
    yield
    spark.catalog.dropTempView("sales")


def test_equal_to_each_alone(spark, sales):
    df = spark.createDataFrame(list(enumerate(STATEMENTS)), "k int, sql string")
    got = {r["k"]: (r["status"], r["n_rows"]) for r in run_statements(spark, df).collect()}
    for k, text in enumerate(STATEMENTS):
        alone = G.run_guarded(spark, text)
        assert got[k] == (alone.status, alone.rows.count() if alone.rows is not None else 0), text
    assert got[7][0] == got[9][0] == "ERROR" and got[6][0] == got[8][0] == got[10][0] == "PASSED"


def test_shapes_leave_what_is_no_literal(spark):
    texts = ["SELECT t1.c2 FROM t1 WHERE x = 5 AND y = 'a 7'", "SELECT 1.5, 2e3, 12345678901", "SELECT 1 -- 'x'"]
    df = spark.createDataFrame([(t,) for t in texts], "s string").select(*shaped("s"))
    assert [(r["shape"].replace("\u0001", "?"), r["parameters"]) for r in df.collect()] == [
        ("SELECT t1.c2 FROM t1 WHERE x = ?n AND y = ?s", '["5","\'a 7\'"]'), (texts[1], "[]"), (texts[2], "[]")]


def test_row_limit_and_empty_table(spark, sales):
    df = spark.createDataFrame([(1, "SELECT * FROM sales")], "k int, sql string")
    assert [r["n_rows"] for r in run_statements(spark, df, max_rows=3).collect()] == [3]
    assert run_statements(spark, df.limit(0)).collect() == []
    with pytest.raises(ValueError, match="clash"):
        run_statements(spark, df.withColumn("status", F.lit(1)))


def test_the_judge_stands_once_in_every_plan(spark, sales, monkeypatch):
    """A filter pushed below it repeated its expressions until the driver's heap was full."""
    from pyspark.sql.readwriter import DataFrameWriter

    plans, parquet = [], DataFrameWriter.parquet

    def noted(self, path, *args, **kw):
        plans.append(self._df._jdf.queryExecution().optimizedPlan().toString().count("RLIKE"))
        return parquet(self, path, *args, **kw)

    monkeypatch.setattr(DataFrameWriter, "parquet", noted)
    df = spark.createDataFrame([(i, f"SELECT * FROM sales WHERE id = {i}") for i in range(3)], "k int, sql string")
    assert [r["n_rows"] for r in run_statements(spark, df).orderBy("k").collect()] == [0, 1, 1]
    assert plans and max(plans) < 100

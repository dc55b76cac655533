"""G3 over a table of statements: one job for each shape, not for each row.

A statement's *shape* is its text with plain literals (integers of up to nine
digits, strings without escapes) replaced by parameters.  All statements of a
shape run together: a lateral join of the table of their parameters with the
statement, which Spark turns into ordinary joins and aggregates on the
parameters.  What such a join cannot express runs once for each distinct text:
texts with comments, quoted names or escapes, literals that must be constants
(LIMIT, ordinals, typed literals), and comparisons that would need all pairs of
parameters and rows.

The driver sees one row a shape.  Parameters, results and statements stay in
tables; every statement text and every parameter set is run once, however often
it is repeated.
"""

from __future__ import annotations

import json
import threading
import uuid

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from py4j.protocol import Py4JJavaError

from tessera.operators import sqlaudit as G
from tessera.session import scratch_path

MOST_SHAPES = 10_000  # more are an error: each is a Spark job
# Texts whose literals are not looked for: comments, quoted names, escapes, two
# quotes in a row, typed literals, and ordinals after BY.
VERBATIM = r"""(?is)--|/\*|[`"\\]|''|\b(?:date|timestamp\w*|interval|x|r)\s*'|\bby\s+(?:[^()]*,)?\s*\d"""
LITERAL = r"'[^']*'|(?<![\w.$@'])\d{1,9}(?![\w.])"
STRING, NUMBER = "\u0001s", "\u0001n"
# Errors that name the statement's words, so that all of its shape have them.
OF_THE_SHAPE = ("PARSE_SYNTAX_ERROR", "TABLE_OR_VIEW_NOT_FOUND", "UNRESOLVED_COLUMN", "UNRESOLVED_ROUTINE")
PAIRS = ("BroadcastNestedLoopJoinExec", "CartesianProductExec")
RESULT = "parameters string, status string, reason string, n_rows long"


def shaped(text: str) -> list[Column]:
    """(shape, parameters) of a column of cleaned statements."""
    c = F.col(text)
    plain = ~c.rlike(VERBATIM) & ~c.contains("\u0001")
    # strings first, so that digits within them are no numbers
    marked = F.regexp_replace(F.regexp_replace(c, r"'[^']*'", STRING), LITERAL.split("|")[1], NUMBER)
    found = F.regexp_extract_all(c, F.lit(LITERAL), F.lit(0))
    # the same places in both, or the text stays as it is
    sound = plain & (F.size(found) == F.regexp_count(marked, F.lit("\u0001")))
    return [F.when(sound, marked).otherwise(c).alias("shape"),
            F.to_json(F.when(sound, found).otherwise(F.array().cast("array<string>"))).alias("parameters")]


def _parameter_columns(shape: str) -> tuple[str, list[Column]]:
    """The statement with parameters by name, and their columns."""
    columns, values = [], F.from_json("parameters", "array<string>")
    while "\u0001" in shape:
        at = shape.index("\u0001")
        value = F.get(values, F.lit(len(columns)))
        name = f"_p{len(columns)}"
        if shape.startswith(STRING, at):
            columns.append(F.substring(value, F.lit(2), F.length(value) - 2).alias(name))
        else:
            columns.append(value.cast("int").alias(name))
        shape = f"{shape[:at]}_given.{name}{shape[at + 2:]}"
    return shape, columns


def _written(spark: SparkSession, df: DataFrame, max_seconds: float) -> DataFrame:
    """``df`` run into a table of the shared folder, under the time limit."""
    path, tag = scratch_path(spark, "statements"), f"statements-{uuid.uuid4().hex}"
    late = threading.Timer(max_seconds, spark.sparkContext.cancelJobsWithTag, [tag])
    spark.sparkContext.addJobTag(tag)
    try:
        late.start()
        df.write.parquet(path)
    finally:
        late.cancel()
        spark.sparkContext.removeJobTag(tag)
    return spark.read.schema(df.schema).parquet(path)


def _message(e: Exception) -> str:
    return str(e).split("\n")[0]


def _row(spark: SparkSession, given: DataFrame, status: str, reason: str | None) -> DataFrame:
    return given.select("parameters", F.lit(status).alias("status"), F.lit(reason).alias("reason"), F.lit(0).cast("long").alias("n_rows"))


def _joined(spark: SparkSession, statement: str, columns: list[Column], given: DataFrame, max_rows: int) -> DataFrame | None:
    """The one join of a shape, or None where it cannot take parameters."""
    name = f"_statements_{uuid.uuid4().hex}"
    given.select("parameters", *columns).createOrReplaceTempView(name)
    try:
        # the hash of all columns makes Spark compute every one of them
        df = spark.sql(
            f"SELECT _given.parameters, COUNT(_found.hit) AS n, BIT_XOR(_found.hit) AS digest FROM {name} AS _given "
            f"LEFT JOIN LATERAL (SELECT xxhash64(*) AS hit FROM ({statement}\n)) AS _found ON TRUE GROUP BY _given.parameters")
        nodes = {G._name(node) for node, is_plan in G._tree(df._jdf.queryExecution().sparkPlan()) if is_plan}
    except PySparkException:
        return None
    finally:
        spark.catalog.dropTempView(name)
    if nodes & set(PAIRS):
        return None
    return df.select("parameters", F.lit("PASSED").alias("status"), F.lit(G.REASON_OK).alias("reason"),
                     F.least("n", F.lit(max_rows)).cast("long").alias("n_rows"), "digest")


def _run_shape(spark, shape, given, max_rows, max_seconds, known, part=0) -> list[DataFrame]:
    """Results of a shape's distinct parameter sets.  When the join fails while it
    runs, the sets are halved by a bit of their hash until the failing ones are
    alone: a statement's error is its own."""
    statement, columns = _parameter_columns(shape)
    joined = _joined(spark, statement, columns, given, max_rows)
    if joined is None:
        return _run_texts(spark, shape, given, max_rows, max_seconds, known)
    try:
        return [_written(spark, joined, max_seconds).drop("digest")]
    except (PySparkException, Py4JJavaError) as e:
        if part >= 64 or len(given.limit(2).collect()) < 2:
            return [_row(spark, given, "ERROR", _message(e))]
    bit = F.shiftright(F.xxhash64("parameters"), part).bitwiseAND(F.lit(1))
    halves = [given.filter(bit == b) for b in (0, 1)]
    return [r for half in halves if not half.isEmpty() for r in _run_shape(spark, shape, half, max_rows, max_seconds, known, part + 1)]


def _text(shape: str, parameters: str) -> str:
    for value in json.loads(parameters):
        at = shape.index("\u0001")
        shape = shape[:at] + value + shape[at + 2:]
    return shape


def _run_texts(spark, shape, given, max_rows, max_seconds, known) -> list[DataFrame]:
    """The same, one text after the other."""
    rows = []
    for r in given.toLocalIterator():
        res = G.run_guarded(spark, _text(shape, r["parameters"]), max_rows, known, max_seconds)
        rows.append((r["parameters"], res.status, res.reason, res.rows.count() if res.rows is not None else 0))
    return [spark.createDataFrame(rows, RESULT)]


def run_statements(spark: SparkSession, statements: DataFrame, sql: str = "sql", max_rows: int = G.MAX_ROWS,
                   max_seconds: float = G.MAX_SECONDS, tables: set | None = None) -> DataFrame:
    """G1-G3 for every row of ``statements``: its columns, then cleaned_sql, status
    (PASSED / FAILED / ERROR), reason and n_rows (at most ``max_rows``).

    FAILED statements never run: the word rules judge every row, the tree rules
    (``refused_statement``) every shape.  A statement is ERROR if it does not
    resolve, if any of its rows fails to compute, or if the job of its shape takes
    more than ``max_seconds`` when the statement is alone in it.  A NULL statement
    is FAILED; repeated statements get equal results; an empty table gives an
    empty one.  Names must not clash with the added columns."""
    clash = {"cleaned_sql", "discarded_prefix", "valid", "reason", "status", "n_rows", "shape", "parameters"} & set(statements.columns)
    if clash:
        raise ValueError(f"columns of the statements clash with the result: {sorted(clash)}")
    audited = G.audit(statements, sql)
    judged = audited.select("*", *shaped("cleaned_sql"))
    # filtered once written: pushed below the judge's projections, a filter would
    # repeat their expressions thousands of times in the plan
    distinct = judged.select("shape", "parameters", "valid").distinct()
    path = scratch_path(spark, "statement-parameters")
    distinct.write.parquet(path)
    distinct = spark.read.schema(distinct.schema).parquet(path).filter("valid").drop("valid")
    shapes = distinct.groupBy("shape").agg(F.min("parameters").alias("example")).limit(MOST_SHAPES + 1).collect()
    if len(shapes) > MOST_SHAPES:
        raise ValueError(f"over {MOST_SHAPES} shapes of statements: run fewer at a time")
    known = G.known_tables(spark) if tables is None else {t.lower() for t in tables}
    results = spark.createDataFrame([], "shape string, " + RESULT)
    for shape, example in sorted((r["shape"], _text(r["shape"], r["example"])) for r in shapes):
        given = distinct.filter(F.col("shape") == shape).select("parameters")
        try:
            refused = G.refused_statement(spark, example, known)
            if refused:
                parts = [_row(spark, given, "FAILED", refused)]
            else:
                refused = G.refused_analysis(spark.sql(example))
                parts = [_row(spark, given, "FAILED", refused)] if refused else _run_shape(spark, shape, given, max_rows, max_seconds, known)
        except PySparkException as e:
            if (e.getCondition() or "").startswith(OF_THE_SHAPE):
                parts = [_row(spark, given, "ERROR", _message(e))]
            else:
                parts = _run_texts(spark, shape, given, max_rows, max_seconds, known)
        for part in parts:
            results = results.unionByName(part.select(F.lit(shape).alias("shape"), "*"))
    results = results.withColumnsRenamed({"status": "_status", "reason": "_reason", "n_rows": "_n"})
    out = judged.join(results, ["shape", "parameters"], "left")
    return out.select(*[F.col(c) for c in statements.columns], "cleaned_sql",
                      F.when(F.col("valid"), F.col("_status")).otherwise("FAILED").alias("status"),
                      F.when(F.col("valid"), F.col("_reason")).otherwise(F.col("reason")).alias("reason"),
                      F.coalesce("_n", F.lit(0)).cast("long").alias("n_rows"))

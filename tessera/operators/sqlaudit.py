"""SQL auditing and guarded execution.

G1/G2 are column expressions, so a table of generated statements is cleaned
and judged in one narrow projection.  G3 runs one judged statement through
``spark.sql`` (Catalyst end to end) and keeps at most ``max_rows`` rows;
G5 profiles tables in one aggregate pass per table.
"""

from __future__ import annotations

import threading
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import strip_ws
from tessera.session import scratch_path

# ---------------------------------------------------------------------------
# Judged words (reference order), reasons, run limits.
BLOCKED_WORDS = [
    "ALTER", "ATTACH", "CREATE", "DELETE", "DROP", "INSERT", "PRAGMA", "REPLACE",
    "TRUNCATE", "UPDATE", "VACUUM",
]
# Spark SQL can call JVM methods and run shell scripts from a SELECT; these are
# blocked as well (TRANSFORM is also a harmless function: only with USING).
SPARK_BLOCKED_WORDS = ["REFLECT", "JAVA_METHOD", "TRY_REFLECT"]
SCRIPT_CALL = r"(?is)\b(?:TRANSFORM|MAP|REDUCE)\b.*\bUSING\s*['\"]"
REASON_NOT_SELECT = "Only SELECT or WITH queries are permitted."
REASON_MULTI = "Only one SQL statement is permitted."
REASON_BLOCKED = "Blocked keyword: "
REASON_SCRIPT = "Blocked script call"
REASON_OK = "OK"
MAX_ROWS = 100
MAX_SECONDS = 300.0
PREVIEW_ROWS = 20
FENCE = r"(?is)```(?:sql)?\s*(.*?)```"
LEAD = r"(?is)^(.*?)\b(?:SELECT|WITH)\b"
# ---------------------------------------------------------------------------


def _clean_frame(df: DataFrame, src: str, out: str, prefix_out: str) -> DataFrame:
    """G1 as a chain of projections: each intermediate is a column, so the
    regexes run once per row instead of once per reference in a nested tree."""
    word = r"(?i)\b(?:SELECT|WITH)\b"
    return (
        df.withColumn("_s1", F.coalesce(strip_ws(src), F.lit("")))
        .withColumn("_s2", F.when(F.col("_s1").rlike(FENCE), strip_ws(F.regexp_extract("_s1", FENCE, 1)))
                    .otherwise(F.col("_s1")))
        .withColumn("_hw", F.col("_s2").rlike(word))
        .withColumn(prefix_out, F.when(F.col("_hw"), F.regexp_extract("_s2", LEAD, 1)).otherwise(F.lit("")))
        .withColumn(out, strip_ws(F.regexp_replace(
            F.when(F.col("_hw"), F.substring(F.col("_s2"), F.length(prefix_out) + 1, 1 << 30))
            .otherwise(F.col("_s2")), r";+\z", "")))
        .drop("_s1", "_s2", "_hw")
    )


def audit(df: DataFrame, sql="sql", spark_words: bool = True) -> DataFrame:
    """G1 + G2 over a table of generated statements: cleaned_sql,
    discarded_prefix, valid, reason (the judge cleans once more, as the
    reference's validator does).  A NULL statement is judged like an empty one."""
    x = _clean_frame(df, sql, "cleaned_sql", "discarded_prefix")
    x = _clean_frame(x, "cleaned_sql", "_judged", "_p2")
    s = F.col("_judged")
    words = BLOCKED_WORDS + (SPARK_BLOCKED_WORDS if spark_words else [])
    reason = F.when(~s.rlike(r"(?i)^(?:SELECT|WITH)\b"), F.lit(REASON_NOT_SELECT)).when(
        s.contains(";"), F.lit(REASON_MULTI))
    for w in words:
        reason = reason.when(s.rlike(rf"(?i)\b{w}\b"), F.lit(REASON_BLOCKED + w))
    if spark_words:
        reason = reason.when(s.rlike(SCRIPT_CALL), F.lit(REASON_SCRIPT))
    reason = reason.otherwise(F.lit(REASON_OK))
    return x.withColumn("reason", reason).withColumn("valid", F.col("reason") == REASON_OK).drop("_judged", "_p2")


@dataclass
class GuardedResult:
    status: str  # PASSED / FAILED / ERROR
    reason: str
    sql: str
    columns: list
    rows: DataFrame | None


def _judge_text(spark: SparkSession, text: str | None) -> tuple[str, bool, str]:
    one = spark.range(1).select(F.lit(text).cast("string").alias("sql"))
    r = audit(one).select("cleaned_sql", "valid", "reason").first()
    return r["cleaned_sql"], r["valid"], r["reason"]


# What a statement may consist of.  Parsed: these plan nodes, any expression but
# those refused, relations by one name, and these table functions.
PARSED_NODES = frozenset(
    "UnresolvedWith GlobalLimit LocalLimit Offset Sort Project Filter Aggregate Join LateralJoin SubqueryAlias "
    "UnresolvedSubqueryColumnAliases UnresolvedRelation Distinct Union Except Intersect OneRowRelation LocalRelation "
    "UnresolvedInlineTable UnresolvedTableValuedFunction UnresolvedTVFAliases UnresolvedHaving WithWindowDefinition "
    "Window Generate Pivot Unpivot Sample UnresolvedHint".split())
TABLE_FUNCTIONS = frozenset("range explode explode_outer posexplode posexplode_outer inline inline_outer stack".split())
REFUSED_EXPRESSIONS = frozenset("ExpressionWithUnresolvedIdentifier CallMethodViaReflection NamedParameter PosParameter".split())
REFUSED_FUNCTIONS = frozenset(w.lower() for w in SPARK_BLOCKED_WORDS)
SUBQUERIES = frozenset("ScalarSubquery Exists ListQuery LateralSubquery FunctionTableSubqueryArgumentExpression".split())
# Analysed: a tree whose leaves are views (their inside is their owner's
# business), references to the statement's own WITH tables, or rows given as text.
ANALYSED_LEAVES = frozenset("View CTERelationRef OneRowRelation LocalRelation Range".split())
REASON_RELATION = "Only known tables can be read"
REASON_NODE = "Not a plain query: "


def _each(seq):
    it = seq.iterator()
    while it.hasNext():
        yield it.next()


def _name(node) -> str:
    return node.getClass().getSimpleName().rstrip("$")


def _tree(plan, enter=lambda node: True):
    """(node, is it a plan) of a plan, its expressions and the plans within them."""
    stack = [(plan, True)]
    while stack:
        node, is_plan = stack.pop()
        yield node, is_plan
        if is_plan and not enter(node):
            continue
        stack += [(x, is_plan) for x in _each(node.children())]
        if is_plan:
            stack += [(x, False) for x in _each(node.expressions())]
            # WITH tables; the plans of subqueries are reached by their expressions
            stack += [(x, True) for x in _each(node.innerChildren()) if _name(node) == "UnresolvedWith"]
        elif _name(node) in SUBQUERIES:
            stack.append((node.plan(), True))


def refused_statement(spark: SparkSession, sql: str, tables: set) -> str | None:
    """Why the parsed statement may not run, or None.  Parsing runs nothing.

    Relations must be a WITH table of the statement or one of ``tables``, by a
    single name: a path or a format in front of one is never a known table."""
    nodes = list(_tree(spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)))
    own = {x.alias().lower() for node, is_plan in nodes if is_plan and _name(node) == "UnresolvedWith" for x in _each(node.innerChildren())}
    for node, is_plan in nodes:
        name = _name(node)
        if is_plan and name not in PARSED_NODES:
            return REASON_NODE + name
        if name == "UnresolvedRelation":
            parts = [str(x) for x in _each(node.multipartIdentifier())]
            if len(parts) != 1 or parts[0].lower() not in own | tables:
                return f"{REASON_RELATION}: {'.'.join(parts)}"
        if name == "UnresolvedTableValuedFunction" and ".".join(str(x) for x in _each(node.name())).lower() not in TABLE_FUNCTIONS:
            return REASON_NODE + name
        if not is_plan and (name in REFUSED_EXPRESSIONS or (name == "UnresolvedFunction" and str(list(_each(node.nameParts()))[-1]).lower() in REFUSED_FUNCTIONS)):
            return REASON_NODE + name
    return None


def refused_analysis(df: DataFrame) -> str | None:
    """The same once names are resolved: what does the statement read?"""
    for node, is_plan in _tree(df._jdf.queryExecution().analyzed(), enter=lambda n: _name(n) != "View"):
        name = _name(node)
        if is_plan and name not in ANALYSED_LEAVES and not node.children().nonEmpty():
            return f"{REASON_RELATION}: {name}"
        if name in REFUSED_EXPRESSIONS or name == "ScriptTransformation":
            return REASON_NODE + name
    return None


def known_tables(spark: SparkSession) -> set:
    """The session's temporary views."""
    return {t.name.lower() for t in spark.catalog.listTables() if t.isTemporary}


def run_guarded(spark: SparkSession, text: str | None, max_rows: int = MAX_ROWS, tables: set | None = None,
                max_seconds: float = MAX_SECONDS) -> GuardedResult:
    """Clean, judge and run one statement.

    FAILED statements never run: those that the word rules reject, and those
    whose parsed or analysed tree holds anything but a query over ``tables`` (the
    session's temporary views unless given).  The others run into a table in the
    shared folder, at most ``max_rows`` rows, so that a statement that fails at any
    point, or runs for more than ``max_seconds``, reports ERROR with its message
    and no rows.
    """
    sql, valid, reason = _judge_text(spark, text)
    if not valid:
        return GuardedResult("FAILED", reason, sql, [], None)
    tag = f"guarded-{uuid.uuid4().hex}"
    late = threading.Timer(max_seconds, spark.sparkContext.cancelJobsWithTag, [tag])
    try:
        known = known_tables(spark) if tables is None else {t.lower() for t in tables}
        refused = refused_statement(spark, sql, known)
        if refused:
            return GuardedResult("FAILED", refused, sql, [], None)
        df = spark.sql(sql)
        refused = refused_analysis(df)
        if refused:
            return GuardedResult("FAILED", refused, sql, [], None)
        # columns may have equal names, which a table cannot
        named = df.limit(max_rows).toDF(*[f"c{i}" for i in range(len(df.columns))])
        ordered = named.select(F.struct("*").alias("row"), F.monotonically_increasing_id().alias("place"))
        path = scratch_path(spark, "guarded")
        spark.sparkContext.addJobTag(tag)
        late.start()
        ordered.coalesce(1).write.parquet(path)
        back = spark.read.schema(ordered.schema).parquet(path).orderBy("place").select("row.*")
        return GuardedResult("PASSED", REASON_OK, sql, df.columns, back.toDF(*df.columns))
    except Exception as e:  # analysis and run-time failures alike
        return GuardedResult("ERROR", str(e).split("\n")[0], sql, [], None)
    finally:
        late.cancel()
        spark.sparkContext.removeJobTag(tag)


def explanation_rows(df: DataFrame, n: int = PREVIEW_ROWS) -> DataFrame:
    """The first rows handed to the explanation step."""
    return df.limit(n)


def profile_tables(frames: dict, exact: dict | None = None) -> DataFrame:
    """Per table and column, rows, nulls and distinct values; one aggregate
    and so one scan for each table.

    ``distinct_values`` is exact, for the columns that ``exact`` names ({table:
    [columns]}), and NULL for the others; ``distinct_estimate`` is a HyperLogLog
    estimate for those.
    """
    stats = None
    for name, df in frames.items():
        named = set((exact or {}).get(name, ()))
        cols = df.columns
        agg = df.agg(
            F.count(F.lit(1)).alias("_rows"),
            *[F.count_if(F.col(c).isNull()).alias(f"_n{i}") for i, c in enumerate(cols)],
            *[(F.count_distinct(F.col(c)) if c in named else F.approx_count_distinct(F.col(c))).alias(f"_d{i}")
              for i, c in enumerate(cols)])
        rows = F.inline(F.array(*[
            F.struct(F.lit(i).alias("column_position"), F.lit(c).alias("column_name"),
                     F.col("_rows").alias("row_count"), F.col(f"_n{i}").alias("null_values"),
                     (F.col(f"_d{i}") if c in named else F.lit(None)).cast("long").alias("distinct_values"),
                     F.col(f"_d{i}").cast("long").alias("distinct_estimate"))
            for i, c in enumerate(cols)]))
        part = agg.select(F.lit(name).alias("table_name"), rows)
        stats = part if stats is None else stats.unionByName(part)
    return stats


def profile(df: DataFrame, table: str, exact: list | None = None) -> DataFrame:
    """G5 for one table (see ``profile_tables``)."""
    return profile_tables({table: df}, {table: exact or []})

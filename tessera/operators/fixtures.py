"""The reference's own small tables, generated with Spark expressions.

These are parameter-driven generators (a few dozen rows).  They back the golden
tests of A1-A5; the registered queries run the same operators over tables
derived from the driver data (``tessera.plans.derived``).

Rounding: the reference rounds with Python's ``round`` (half-even), so
revenue/orders/margins use ``bround``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Generator parameters that must equal the reference's.
# Revenue by region: (base revenue, base orders, base gross margin %).
REVENUE_REGIONS = [
    ("North", 420000, 280, 41.0),
    ("East", 380000, 250, 39.5),
    ("South", 310000, 210, 37.8),
    ("West", 350000, 230, 40.2),
]
REVENUE_YEAR = 2025
REVENUE_MONTHLY_GROWTH = 0.03
MARGIN_MONTHLY_STEP = 0.15
# Customer churn: opening customers, then churned and new customers per month.
CHURN_START = 1200
CHURNED_PER_MONTH = [24, 22, 26, 25, 28, 30, 31, 29, 34, 35, 33, 38]
NEW_PER_MONTH = [70, 65, 72, 80, 78, 85, 90, 88, 95, 100, 97, 105]
# Employee satisfaction by department: (satisfaction, manager effectiveness,
# workload balance, learning access, monthly one-on-one completion,
# learning time target met).
SATISFACTION_DEPARTMENTS = [
    ("Customer Success", [80, 78, 76, 72, 84, 74]),
    ("Consulting", [78, 77, 74, 70, 81, 71]),
    ("Operations", [74, 73, 79, 68, 78, 67]),
    ("Sales", [72, 70, 71, 65, 75, 63]),
]
SATISFACTION_QUARTER_CHANGES = [
    [0, 0, 0, 0, 0, 0],
    [2, 2, 3, 3, 4, 3],
    [1, 1, 2, 4, 6, 5],
    [3, 4, 5, 7, 8, 8],
]
INDUSTRY_BENCHMARK_PCT = 75
# Sales and customer success by region: (revenue, qualified opportunities,
# won deals, renewal, customer satisfaction, implementation on time, handoff
# within 2 business days, success plan within 10 business days, at-risk plan).
SALES_REGIONS = [
    ("North", [950000, 110, 32, 88, 84, 89, 87, 85, 83]),
    ("East", [820000, 96, 28, 86, 82, 87, 82, 80, 78]),
    ("South", [700000, 88, 24, 84, 80, 85, 76, 74, 72]),
    ("West", [780000, 92, 26, 85, 81, 86, 80, 78, 76]),
]
SALES_QUARTER_FACTORS = [1.00, 1.10, 1.18, 1.32]
# ---------------------------------------------------------------------------

SATISFACTION_COLUMNS = [
    "satisfaction_pct", "manager_effectiveness_pct", "workload_balance_pct",
    "learning_access_pct", "monthly_one_on_one_completion_pct", "learning_time_target_met_pct",
]


def roll_forward(df: DataFrame, order: str, start_col: str | None = None, start: int | None = None,
                 churned="churned_customers", new="new_customers") -> DataFrame:
    """ending = beginning - churned + new; next beginning = this ending.

    Expressed as running sums of (new - churned) over the period order, so
    there is no sequential loop.  The window is unpartitioned: callers pass
    one row per period.
    """
    s = F.col(start_col) if start_col else F.lit(start)
    w_before = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    w_upto = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    delta = F.col(new) - F.col(churned)
    return df.select(
        "*",
        (s + F.coalesce(F.sum(delta).over(w_before), F.lit(0))).cast("long").alias("beginning_customers"),
        (s + F.sum(delta).over(w_upto)).cast("long").alias("ending_customers"),
    )


def regional_revenue(spark: SparkSession) -> DataFrame:
    """12 months x 4 regions."""
    regions = spark.createDataFrame(REVENUE_REGIONS, "region string, base_rev long, base_orders long, base_margin double")
    m = F.col("m")
    growth = F.lit(1.0) + F.lit(REVENUE_MONTHLY_GROWTH) * (m - 1)
    return (
        regions.select("*", F.explode(F.sequence(F.lit(1), F.lit(12))).alias("m"))
        .select(
            F.format_string(f"{REVENUE_YEAR}-%02d", m).alias("month"),
            F.concat(F.lit("Q"), (F.floor((m - 1) / 3) + 1).cast("string")).alias("quarter"),
            "region",
            F.bround(F.col("base_rev") * growth, 0).alias("revenue_usd"),
            F.bround(F.col("base_orders") * growth, 0).cast("long").alias("orders"),
            F.bround(F.col("base_margin") + F.lit(MARGIN_MONTHLY_STEP) * (m - 1), 2).alias("gross_margin_pct"),
        )
    )


def customer_churn(spark: SparkSession) -> DataFrame:
    """monthly roll-forward from the opening count."""
    base = spark.createDataFrame(
        [(CHURNED_PER_MONTH, NEW_PER_MONTH)], "churned array<int>, new array<int>"
    ).select(F.posexplode(F.arrays_zip("churned", "new")).alias("i", "z"))
    months = base.select(
        F.format_string(f"{REVENUE_YEAR}-%02d", F.col("i") + 1).alias("month"),
        F.col("z.churned").alias("churned_customers"),
        F.col("z.new").alias("new_customers"),
    )
    return roll_forward(months, order="month", start=CHURN_START).select(
        "month", "beginning_customers", "churned_customers", "new_customers", "ending_customers")


def employee_satisfaction(spark: SparkSession) -> DataFrame:
    """4 quarters x 4 departments, base + per-quarter change, benchmark 75."""
    depts = spark.createDataFrame(SATISFACTION_DEPARTMENTS, "department string, base array<int>")
    changes = F.array(*[F.array(*[F.lit(v) for v in row]) for row in SATISFACTION_QUARTER_CHANGES])
    rows = depts.select("department", "base", F.posexplode(changes).alias("qi", "chg"))
    values = F.zip_with("base", "chg", lambda b, c: b + c)
    return rows.select(
        F.concat(F.lit("Q"), (F.col("qi") + 1).cast("string")).alias("quarter"),
        "department",
        values.alias("_v"),
    ).select(
        "quarter", "department",
        F.col("_v")[0].cast("double").alias("satisfaction_pct"),
        F.lit(float(INDUSTRY_BENCHMARK_PCT)).alias("industry_benchmark_pct"),
        *[F.col("_v")[i].cast("double").alias(c) for i, c in enumerate(SATISFACTION_COLUMNS) if i > 0],
    )


def sales_customer_success(spark: SparkSession) -> DataFrame:
    """4 quarters x 4 regions; volumes x factor, rates +1 or +2 per quarter."""
    regions = spark.createDataFrame(SALES_REGIONS, "region string, v array<long>")
    factors = F.array(*[F.lit(f) for f in SALES_QUARTER_FACTORS])
    rows = regions.select("region", "v", F.posexplode(factors).alias("qi", "factor"))
    v = F.col("v")
    step = F.col("qi")
    return rows.select(
        F.concat(F.lit("Q"), (step + 1).cast("string")).alias("quarter"),
        "region",
        F.bround(v[0] * F.col("factor"), 0).alias("sales_revenue_usd"),
        F.bround(v[1] * F.col("factor"), 0).cast("long").alias("qualified_opportunities"),
        F.bround(v[2] * F.col("factor"), 0).cast("long").alias("won_deals"),
        (v[3] + step).cast("double").alias("renewal_rate_pct"),
        (v[4] + step).cast("double").alias("customer_satisfaction_pct"),
        (v[5] + step).cast("double").alias("implementation_on_time_pct"),
        (v[6] + 2 * step).cast("double").alias("handoff_within_2_business_days_pct"),
        (v[7] + 2 * step).cast("double").alias("success_plan_within_10_business_days_pct"),
        (v[8] + 2 * step).cast("double").alias("at_risk_action_plan_pct"),
    )

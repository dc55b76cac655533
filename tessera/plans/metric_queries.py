"""A1-A5 and M1-M13 bound to the driver tables, with their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.columns import month_text
from tessera.operators import metrics as M
from tessera.plans import derived as D
from tessera.plans.derived import line_units
from tessera.plans.sqltext import (CUSTOMER_CHURN, DOCUMENT_QUALITY, REGIONAL_REVENUE,
                                   SALES_CUSTOMER_SUCCESS, pct)
from tessera.sources.tables import Tables

SCS_INDICATORS = (
    "renewal_rate_pct", "customer_satisfaction_pct", "implementation_on_time_pct",
    "handoff_within_2_business_days_pct", "success_plan_within_10_business_days_pct",
    "at_risk_action_plan_pct",
)
TREND_INDICATORS = tuple(i for i in SCS_INDICATORS if i != "customer_satisfaction_pct")


def monthly_revenue(spark: SparkSession, sf: str) -> DataFrame:
    t = Tables(spark, sf)
    rev = t.orders.select(month_text("o_orderdate").alias("month"), F.col("o_totalprice").alias("revenue_usd"))
    return M.monthly_revenue(rev)


def weighted_churn(spark: SparkSession, sf: str) -> DataFrame:
    return M.weighted_churn(D.customer_churn(Tables(spark, sf)))


def weighted_churn_period(spark: SparkSession, sf: str) -> DataFrame:
    """M2 over a chosen span of periods."""
    return M.weighted_churn(D.customer_churn(Tables(spark, sf)), first="1996-Q1", last="1997-Q2")


def customer_rollforward(spark: SparkSession, sf: str) -> DataFrame:
    return M.churn_rollforward(D.customer_churn(Tables(spark, sf)))


def q4_region(spark: SparkSession, sf: str) -> DataFrame:
    return M.quarter_by_region(D.regional_revenue(Tables(spark, sf)), "Q4")


def benchmark_gap(spark: SparkSession, sf: str) -> DataFrame:
    """A4: the Q4 rows."""
    return M.benchmark_gap(D.document_quality(Tables(spark, sf)), quarter="quarter", quarter_value="Q4")


def region_scorecard(spark: SparkSession, sf: str) -> DataFrame:
    return M.sales_scorecard(D.sales_customer_success(Tables(spark, sf)))


def weighted_margin(spark: SparkSession, sf: str) -> DataFrame:
    return M.weighted_margin(D.regional_revenue(Tables(spark, sf)), keys=("region",))


def revenue_growth(spark: SparkSession, sf: str) -> DataFrame:
    return M.revenue_growth(D.regional_revenue(Tables(spark, sf)), segment="region", period="month")


def order_productivity(spark: SparkSession, sf: str) -> DataFrame:
    return M.order_productivity(D.regional_revenue(Tables(spark, sf)), keys=("region",))


def largest_gap(spark: SparkSession, sf: str) -> DataFrame:
    scs = D.sales_customer_success(Tables(spark, sf))
    return M.largest_gap(scs, key="region", period="quarter", benchmark=None, indicators=SCS_INDICATORS)


def trend_agreement(spark: SparkSession, sf: str) -> DataFrame:
    scs = D.sales_customer_success(Tables(spark, sf))
    return M.trend_agreement(scs, key="region", period="quarter", value="customer_satisfaction_pct",
                             indicators=TREND_INDICATORS)


def growth_at_risk(spark: SparkSession, sf: str) -> DataFrame:
    return M.growth_at_risk(D.sales_customer_success(Tables(spark, sf)))


def top_part(spark: SparkSession, sf: str) -> DataFrame:
    """Aggregate lineitem by part (partial agg), take the top one, then
    look up its name."""
    t = Tables(spark, sf)
    per_part = t.lineitem.groupBy("l_partkey").agg(F.sum(line_units()).alias("_rev"))
    best = M.top_member(per_part, "l_partkey", "_rev", 1)
    return (
        t.part.select("p_partkey", "p_name")
        .join(best, F.col("p_partkey") == F.col("l_partkey"))
        .select("p_partkey", "p_name", F.round(F.col("_rev").cast("decimal(20,0)") / 1_000_000, 2)
                .cast("double").alias("total_revenue_usd"))
    )


def segment_rollup(spark: SparkSession, sf: str) -> DataFrame:
    scs = D.sales_customer_success(Tables(spark, sf))
    return M.segment_rollup(scs, segment="region", period="quarter", revenue="sales_revenue_usd",
                            orders="qualified_opportunities")


QUERIES = {
    "monthly_revenue": monthly_revenue,
    "weighted_churn": weighted_churn,
    "weighted_churn_period": weighted_churn_period,
    "customer_rollforward": customer_rollforward,
    "q4_region": q4_region,
    "benchmark_gap": benchmark_gap,
    "region_scorecard": region_scorecard,
    "weighted_margin": weighted_margin,
    "revenue_growth": revenue_growth,
    "order_productivity": order_productivity,
    "largest_gap": largest_gap,
    "trend_agreement": trend_agreement,
    "growth_at_risk": growth_at_risk,
    "top_part": top_part,
    "segment_rollup": segment_rollup,
}

_SCS_AVG = ", ".join(
    f"ROUND(AVG({src}), 2) AS {dst}" for src, dst in M.SCORECARD_AVERAGES
)

ORACLE_SQL = {
    "monthly_revenue": """
SELECT strftime(o_orderdate, '%Y-%m') AS month,
  CAST(ROUND(SUM(CAST(o_totalprice AS DECIMAL(38,4))), 2) AS DOUBLE) AS total_revenue_usd
FROM orders GROUP BY 1 ORDER BY 1""",
    "weighted_churn": f"""
WITH {CUSTOMER_CHURN}
SELECT {pct('SUM(churned_customers)', 'SUM(beginning_customers)')} AS churn_rate_pct,
  ROUND(AVG({pct('churned_customers', 'beginning_customers', None)}), 2) AS mean_period_churn_pct,
  COUNT(*) AS periods
FROM churn""",
    "customer_rollforward": f"""
WITH {CUSTOMER_CHURN}
SELECT month, beginning_customers, churned_customers, new_customers, ending_customers,
  {pct('churned_customers', 'beginning_customers')} AS churn_rate_pct,
  CAST(new_customers - churned_customers AS BIGINT) AS net_customer_change,
  ending_customers = COALESCE(LEAD(beginning_customers) OVER (ORDER BY month), ending_customers)
    AS ending_matches_next
FROM churn""",
    "q4_region": f"""
WITH {REGIONAL_REVENUE}
SELECT region, CAST(SUM(revenue_usd) AS DOUBLE) AS q4_revenue_usd, CAST(SUM(orders) AS BIGINT) AS q4_orders,
  ROUND(AVG(gross_margin_pct), 2) AS q4_average_margin_pct
FROM rr WHERE quarter = 'Q4' GROUP BY region ORDER BY q4_revenue_usd DESC""",
    "benchmark_gap": f"""
WITH {DOCUMENT_QUALITY}
SELECT department, satisfaction_pct, industry_benchmark_pct,
  ROUND(satisfaction_pct - industry_benchmark_pct, 2) AS benchmark_gap_pct,
  manager_effectiveness_pct, workload_balance_pct, learning_access_pct,
  CASE WHEN ROUND(satisfaction_pct - industry_benchmark_pct, 2) > 0 THEN 'above'
       WHEN ROUND(satisfaction_pct - industry_benchmark_pct, 2) < 0 THEN 'below' ELSE 'at' END
    AS benchmark_position
FROM dq WHERE quarter = 'Q4' ORDER BY benchmark_gap_pct DESC""",
    "weighted_churn_period": f"""
WITH {CUSTOMER_CHURN}
SELECT {pct('SUM(churned_customers)', 'SUM(beginning_customers)')} AS churn_rate_pct,
  ROUND(AVG({pct('churned_customers', 'beginning_customers', None)}), 2) AS mean_period_churn_pct,
  COUNT(*) AS periods
FROM churn WHERE month BETWEEN '1996-Q1' AND '1997-Q2'""",
    "region_scorecard": f"""
WITH {SALES_CUSTOMER_SUCCESS}
SELECT region, CAST(SUM(sales_revenue_usd) AS DOUBLE) AS annual_sales_revenue_usd,
  CAST(SUM(won_deals) AS BIGINT) AS won_deals,
  CAST(SUM(qualified_opportunities) AS BIGINT) AS qualified_opportunities,
  {pct('SUM(won_deals)', 'SUM(qualified_opportunities)')} AS win_rate_pct,
  {_SCS_AVG}
FROM scs GROUP BY region ORDER BY annual_sales_revenue_usd DESC""",
    "weighted_margin": f"""
WITH {REGIONAL_REVENUE}
SELECT region,
  ROUND(SUM(CAST(revenue_usd AS DOUBLE) * gross_margin_pct) / NULLIF(SUM(CAST(revenue_usd AS DOUBLE)), 0.0), 4)
    AS weighted_margin_pct,
  ROUND(AVG(gross_margin_pct), 4) AS plain_margin_pct,
  CAST(ROUND(SUM(revenue_usd), 2) AS DOUBLE) AS revenue_usd
FROM rr GROUP BY region""",
    "revenue_growth": f"""
WITH {REGIONAL_REVENUE},
g AS (SELECT region, month, revenue_usd AS rev,
        LAG(revenue_usd) OVER (PARTITION BY region ORDER BY month) AS prev FROM rr)
SELECT region, month, CAST(ROUND(rev, 2) AS DOUBLE) AS revenue_usd,
  CAST(ROUND(prev, 2) AS DOUBLE) AS prev_revenue_usd, {pct('rev - prev', 'prev')} AS growth_pct
FROM g""",
    "order_productivity": f"""
WITH {REGIONAL_REVENUE}
SELECT region, CAST(ROUND(SUM(revenue_usd), 2) AS DOUBLE) AS revenue_usd,
  CAST(SUM(orders) AS BIGINT) AS orders,
  ROUND(CAST(SUM(revenue_usd) AS DOUBLE) / NULLIF(CAST(SUM(orders) AS DOUBLE), 0.0), 2) AS revenue_per_order
FROM rr GROUP BY region""",
    "largest_gap": f"""
WITH {SALES_CUSTOMER_SUCCESS},
long AS (
  UNPIVOT (SELECT region, quarter, {', '.join(SCS_INDICATORS)} FROM scs)
  ON {', '.join(SCS_INDICATORS)} INTO NAME indicator VALUE value),
scored AS (
  SELECT region, quarter, indicator, ROUND(value, 4) AS value,
    ROUND(AVG(value) OVER (PARTITION BY quarter, indicator), 4) AS benchmark_pct,
    ROUND(AVG(value) OVER (PARTITION BY quarter, indicator) - value, 4) AS gap_pct
  FROM long),
ranked AS (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY region, quarter ORDER BY gap_pct DESC, indicator) AS rn FROM scored)
SELECT region, quarter, indicator, value, benchmark_pct, gap_pct FROM ranked WHERE rn = 1""",
    "trend_agreement": f"""
WITH {SALES_CUSTOMER_SUCCESS},
steps AS (
  SELECT region, quarter,
    sign(customer_satisfaction_pct - LAG(customer_satisfaction_pct) OVER w) AS dv,
    {', '.join(f'sign({i} - LAG({i}) OVER w) AS {i}' for i in TREND_INDICATORS)}
  FROM scs WINDOW w AS (PARTITION BY region ORDER BY quarter)),
long AS (
  UNPIVOT (SELECT * FROM steps WHERE dv IS NOT NULL)
  ON {', '.join(TREND_INDICATORS)} INTO NAME indicator VALUE di)
SELECT region, indicator, COUNT(*) AS period_pairs, COUNT(*) FILTER (WHERE di = dv) AS agreeing_pairs
FROM long GROUP BY region, indicator""",
    "growth_at_risk": f"""
WITH {SALES_CUSTOMER_SUCCESS},
b AS (
  SELECT region, quarter, CAST(sales_revenue_usd AS DOUBLE) AS rev, renewal_rate_pct AS ren,
    customer_satisfaction_pct AS sat, {pct('won_deals', 'qualified_opportunities', None)} AS win
  FROM scs),
f AS (
  SELECT region, quarter, ROUND(rev, 2) AS revenue_usd, ROUND(win, 2) AS win_rate_pct,
    rev >= 1.0 * AVG(rev) OVER (PARTITION BY quarter) AS high_revenue,
    (ren < LAG(ren) OVER (PARTITION BY region ORDER BY quarter))
      OR (sat < LAG(sat) OVER (PARTITION BY region ORDER BY quarter)) AS falling_retention,
    win >= AVG(win) OVER (PARTITION BY quarter) AS high_win_rate,
    sat < AVG(sat) OVER (PARTITION BY quarter) AS low_satisfaction
  FROM b)
SELECT *, high_revenue AND COALESCE(falling_retention, false) AS growth_at_risk,
  high_win_rate AND low_satisfaction AS win_without_satisfaction
FROM f""",
    "top_part": """
WITH per_part AS (
  SELECT l_partkey,
    SUM(CAST(l_extendedprice AS DECIMAL(15,2)) * (1 - CAST(l_discount AS DECIMAL(15,2)))) AS rev
  FROM lineitem GROUP BY l_partkey),
best AS (SELECT * FROM per_part ORDER BY rev DESC, l_partkey LIMIT 1)
SELECT p_partkey, p_name, CAST(ROUND(rev, 2) AS DOUBLE) AS total_revenue_usd
FROM part JOIN best ON p_partkey = l_partkey""",
    "segment_rollup": f"""
WITH {SALES_CUSTOMER_SUCCESS}
SELECT region, quarter, CAST(ROUND(SUM(sales_revenue_usd), 2) AS DOUBLE) AS revenue_usd,
  CAST(SUM(qualified_opportunities) AS BIGINT) AS orders,
  {pct('SUM(won_deals)', 'SUM(qualified_opportunities)')} AS win_rate_pct,
  CAST(GROUPING(region, quarter) AS BIGINT) AS grouping_level
FROM scs GROUP BY ROLLUP (region, quarter)""",
}

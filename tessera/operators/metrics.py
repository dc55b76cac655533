"""Shipped analytics A1-A5 and dictionary metrics M1-M13.

Every function takes frames in the shape of the reference's five tables
(``regional_revenue``, ``customer_churn``, ``employee_satisfaction``,
``sales_customer_success``) -- column names are parameters -- and returns a
frame.  ``tessera.plans.derived`` builds those shapes from the driver tables;
``tessera.operators.fixtures`` builds the reference's own small tables.

Aggregates run as hash aggregates with map-side partial combine, so a hot key
(one region holding a third of the rows) is pre-reduced before the shuffle.
Windows only ever run over already aggregated rows (periods x segments).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.columns import pct, to_double


# --- A1-A5: the reference's shipped example queries -------------------------

def monthly_revenue(df: DataFrame, month="month", revenue="revenue_usd") -> DataFrame:
    """A1: ROUND(SUM(revenue),2) by month, ordered by month."""
    return (
        df.groupBy(month)
        .agg(to_double(F.round(F.sum(F.col(revenue).cast("decimal(18,4)")), 2)).alias("total_revenue_usd"))
        .orderBy(month)
    )


def weighted_churn(df: DataFrame, churned="churned_customers", beginning="beginning_customers",
                   period="month", first=None, last=None) -> DataFrame:
    """A2 + M2: ratio of sums (weighted) beside the plain mean of period rates,
    over the periods from ``first`` to ``last`` (both included; None: open)."""
    if first is not None:
        df = df.filter(F.col(period) >= first)
    if last is not None:
        df = df.filter(F.col(period) <= last)
    return df.agg(
        pct(F.sum(churned), F.sum(beginning)).alias("churn_rate_pct"),
        F.round(F.avg(pct(churned, beginning, None)), 2).alias("mean_period_churn_pct"),
        F.count(F.lit(1)).alias("periods"),
    )


def quarter_by_region(
    df: DataFrame, quarter_value="Q4", quarter="quarter", region="region",
    revenue="revenue_usd", orders="orders", margin="gross_margin_pct",
) -> DataFrame:
    """A3: filter one quarter, sum revenue and orders, mean margin, revenue desc."""
    return (
        df.filter(F.col(quarter) == quarter_value)
        .groupBy(region)
        .agg(
            to_double(F.sum(F.col(revenue).cast("decimal(38,4)"))).alias("q4_revenue_usd"),
            F.sum(orders).cast("long").alias("q4_orders"),
            F.round(F.avg(margin), 2).alias("q4_average_margin_pct"),
        )
        .orderBy(F.desc("q4_revenue_usd"), region)
    )


def benchmark_gap(
    df: DataFrame, key="department", value="satisfaction_pct",
    benchmark="industry_benchmark_pct", indicators=("manager_effectiveness_pct",
    "workload_balance_pct", "learning_access_pct"), quarter=None, quarter_value="Q4",
) -> DataFrame:
    """A4 + M8: value - benchmark, indicators alongside, gap descending.

    M8 adds ``benchmark_position`` (above / at / below).
    """
    if quarter is not None:
        df = df.filter(F.col(quarter) == quarter_value)
    gap = F.round(F.col(value) - F.col(benchmark), 2)
    return (
        df.select(
            key, value, benchmark, gap.alias("benchmark_gap_pct"), *indicators,
            F.when(gap > 0, "above").when(gap < 0, "below").otherwise("at").alias("benchmark_position"),
        )
        .orderBy(F.desc("benchmark_gap_pct"), key)
    )


# The scorecard's source and output column names.
SCORECARD_AVERAGES = (
    ("renewal_rate_pct", "renewal_rate_pct"),
    ("customer_satisfaction_pct", "customer_satisfaction_pct"),
    ("handoff_within_2_business_days_pct", "handoff_timeliness_pct"),
    ("success_plan_within_10_business_days_pct", "success_plan_timeliness_pct"),
    ("at_risk_action_plan_pct", "at_risk_action_plan_pct"),
)


def sales_scorecard(
    df: DataFrame, region="region", revenue="sales_revenue_usd", won="won_deals",
    qualified="qualified_opportunities", averages=SCORECARD_AVERAGES,
) -> DataFrame:
    """A5 + M7: one pass: revenue, win rate as ratio of sums, five averages."""
    return (
        df.groupBy(region)
        .agg(
            to_double(F.sum(F.col(revenue).cast("decimal(38,2)"))).alias("annual_sales_revenue_usd"),
            F.sum(won).cast("long").alias("won_deals"),
            F.sum(qualified).cast("long").alias("qualified_opportunities"),
            pct(F.sum(won), F.sum(qualified)).alias("win_rate_pct"),
            *[F.round(F.avg(src), 2).alias(dst) for src, dst in averages],
        )
        .orderBy(F.desc("annual_sales_revenue_usd"), region)
    )


# --- M1-M13: metrics the data dictionary defines ------------------------------

def churn_rollforward(df: DataFrame, period="month", churned="churned_customers",
                      new="new_customers", beginning="beginning_customers",
                      ending="ending_customers") -> DataFrame:
    """M1 gross churn rate and M3 net change per period, plus the roll-forward
    invariant: this period's ending equals the next period's beginning.

    The window is unpartitioned but runs over one row per period.
    """
    w = Window.orderBy(period)
    return df.select(
        period, beginning, churned, new, ending,
        pct(churned, beginning).alias("churn_rate_pct"),
        (F.col(new) - F.col(churned)).cast("long").alias("net_customer_change"),
        (F.col(ending) == F.coalesce(F.lead(beginning).over(w), F.col(ending))).alias("ending_matches_next"),
    )


def weighted_margin(df: DataFrame, keys=("region",), revenue="revenue_usd", margin="gross_margin_pct") -> DataFrame:
    """M4: revenue-weighted margin sum(rev*margin)/sum(rev) beside the plain mean."""
    rev = F.col(revenue).cast("double")
    return df.groupBy(*keys).agg(
        F.round(F.sum(rev * F.col(margin)) / F.nullif(F.sum(rev), F.lit(0.0)), 4).alias("weighted_margin_pct"),
        F.round(F.avg(margin), 4).alias("plain_margin_pct"),
        to_double(F.sum(F.col(revenue).cast("decimal(38,4)")), 2).alias("revenue_usd"),
    )


def revenue_growth(df: DataFrame, segment="region", period="month", revenue="revenue_usd") -> DataFrame:
    """M5: period-over-period growth per segment (lag over the period order)."""
    per = df.groupBy(segment, period).agg(F.sum(F.col(revenue).cast("decimal(38,4)")).alias("_rev"))
    w = Window.partitionBy(segment).orderBy(period)
    prev = F.lag("_rev").over(w)
    return per.select(
        segment, period,
        to_double("_rev", 2).alias("revenue_usd"),
        to_double(prev, 2).alias("prev_revenue_usd"),
        pct(F.col("_rev") - prev, prev).alias("growth_pct"),
    )


def order_productivity(df: DataFrame, keys=("region",), revenue="revenue_usd", orders="orders") -> DataFrame:
    """M6: revenue per order as sum/sum."""
    return df.groupBy(*keys).agg(
        to_double(F.sum(F.col(revenue).cast("decimal(38,4)")), 2).alias("revenue_usd"),
        F.sum(orders).cast("long").alias("orders"),
        F.round(F.sum(F.col(revenue).cast("decimal(38,4)")).cast("double")
                / F.nullif(F.sum(orders).cast("double"), F.lit(0.0)), 2).alias("revenue_per_order"),
    )


def largest_gap(df: DataFrame, key="department", period="quarter", benchmark="industry_benchmark_pct",
                indicators=("manager_effectiveness_pct", "workload_balance_pct", "learning_access_pct",
                            "monthly_one_on_one_completion_pct", "learning_time_target_met_pct")) -> DataFrame:
    """M9: unpivot the indicators, gap = benchmark - indicator, keep the largest
    per (key, period), ties broken by indicator name.

    ``benchmark`` names one benchmark column (the reference's fixed 75) or is
    None: then each indicator's benchmark is its mean across keys in the period
    (a window over already aggregated rows).
    """
    ids = [key, period] + ([benchmark] if benchmark else [])
    long = df.select(*ids, *[F.col(i).cast("double").alias(i) for i in indicators]).unpivot(
        ids, list(indicators), "indicator", "value")
    bench = (F.col(benchmark).cast("double") if benchmark
             else F.avg("value").over(Window.partitionBy(period, "indicator")))
    scored = long.select(key, period, "indicator", F.round("value", 4).alias("value"),
                         F.round(bench, 4).alias("benchmark_pct"),
                         F.round(bench - F.col("value"), 4).alias("gap_pct"))
    w = Window.partitionBy(key, period).orderBy(F.desc("gap_pct"), "indicator")
    return scored.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def trend_agreement(df: DataFrame, key="department", period="quarter", value="satisfaction_pct",
                    indicators=("manager_effectiveness_pct", "workload_balance_pct", "learning_access_pct")) -> DataFrame:
    """Between consecutive periods, does each indicator move the same way
    as the headline value?  Counts agreeing period pairs per key and indicator."""
    w = Window.partitionBy(key).orderBy(period)
    d_value = F.signum(F.col(value) - F.lag(value).over(w))
    steps = df.select(key, period, d_value.alias("_dv"),
                      *[F.signum(F.col(i) - F.lag(i).over(w)).alias(i) for i in indicators])
    long = steps.filter(F.col("_dv").isNotNull()).unpivot([key, period, "_dv"], list(indicators), "indicator", "_di")
    return long.groupBy(key, "indicator").agg(
        F.count(F.lit(1)).alias("period_pairs"),
        F.count_if(F.col("_di") == F.col("_dv")).alias("agreeing_pairs"),
    )


def growth_at_risk(df: DataFrame, key="region", period="quarter", revenue="sales_revenue_usd",
                   renewal="renewal_rate_pct", satisfaction="customer_satisfaction_pct",
                   won="won_deals", qualified="qualified_opportunities",
                   revenue_share=1.0) -> DataFrame:
    """High revenue with falling renewal or satisfaction; high win rate
    with low satisfaction.  "High" / "low" compare with the period mean across
    keys (``revenue_share`` scales the revenue bar)."""
    w = Window.partitionBy(key).orderBy(period)
    wp = Window.partitionBy(period)
    rev = F.col(revenue).cast("double")
    win = pct(won, qualified, None)
    base = df.select(
        key, period, rev.alias("_rev"), F.col(renewal).cast("double").alias("_ren"),
        F.col(satisfaction).cast("double").alias("_sat"), win.alias("_win"),
    )
    flagged = base.select(
        key, period,
        F.round("_rev", 2).alias("revenue_usd"),
        F.round("_win", 2).alias("win_rate_pct"),
        (F.col("_rev") >= F.lit(revenue_share) * F.avg("_rev").over(wp)).alias("high_revenue"),
        ((F.col("_ren") < F.lag("_ren").over(w)) | (F.col("_sat") < F.lag("_sat").over(w))).alias("falling_retention"),
        (F.col("_win") >= F.avg("_win").over(wp)).alias("high_win_rate"),
        (F.col("_sat") < F.avg("_sat").over(wp)).alias("low_satisfaction"),
    )
    return flagged.select(
        "*",
        (F.col("high_revenue") & F.coalesce(F.col("falling_retention"), F.lit(False))).alias("growth_at_risk"),
        (F.col("high_win_rate") & F.col("low_satisfaction")).alias("win_without_satisfaction"),
    )


def top_member(df: DataFrame, key: str, value: str, n: int = 1) -> DataFrame:
    """Highest-value member(s); ties broken by key so the answer is stable."""
    return df.orderBy(F.desc(value), F.asc(key)).limit(n)


def segment_rollup(df: DataFrame, segment="region", period="quarter", revenue="revenue_usd",
                   orders="orders", won="won_deals", qualified="qualified_opportunities") -> DataFrame:
    """Several measures per (segment, period) with ROLLUP totals."""
    return df.rollup(segment, period).agg(
        to_double(F.sum(F.col(revenue).cast("decimal(38,4)")), 2).alias("revenue_usd"),
        F.sum(orders).cast("long").alias("orders"),
        pct(F.sum(won), F.sum(qualified)).alias("win_rate_pct"),
        F.grouping_id().alias("grouping_level"),
    )

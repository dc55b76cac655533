"""Reference-shaped tables derived from the driver tables.

The reference's five SQLite tables are not in the test data, so each is built
here from the TPC-H-like tables with a fixed, documented mapping (README,
"Table bindings").  All of them reduce the large tables first (lineitem to one
row per order with a map-side partial aggregate); how the dimension tables
are joined is left to the planner, which knows their sizes.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.columns import month_text, pct, quarter_index, quarter_label_from_index, ratio
from tessera.sources.tables import Tables


def customer_region(t: Tables) -> DataFrame:
    """custkey -> region name."""
    geo = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        "n_nationkey", F.col("r_name").alias("region"))
    return (
        t.customer.select("c_custkey", "c_nationkey")
        .join(geo, F.col("c_nationkey") == F.col("n_nationkey"))
        .select("c_custkey", "region")
    )


def line_units() -> F.Column:
    """l_extendedprice * (1 - l_discount) as an integer of 1e-6 USD: cents times
    (10,000 - hundredths of a percent).  A discount that is finer than a
    hundredth of a percent raises an error instead of being rounded away."""
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    return cents * (F.lit(10_000) - discount_bps())


def discount_bps() -> F.Column:
    """l_discount in hundredths of a percent, checked to be whole."""
    exact = F.col("l_discount") * 10_000
    whole = F.round(exact)
    return F.when(F.abs(exact - whole) > 1e-6, F.raise_error(F.lit("discount finer than 0.01 percent"))).otherwise(
        whole).cast("long")


def lines_per_order(t: Tables) -> DataFrame:
    """lineitem reduced to one row per order (partial aggregate before shuffle).

    Per line, revenue is exact integer arithmetic (``line_units``), so the hot
    loop never touches 38-digit decimals; the per-order sum is converted to
    DECIMAL once.  ANSI mode turns any 64-bit overflow into an error, never a
    wrong sum.
    """
    return t.lineitem.groupBy("l_orderkey").agg(
        F.sum(line_units()).alias("_units"),
        F.sum(discount_bps()).alias("discount_bps_sum"),
        F.count(F.lit(1)).alias("lines"),
        F.count_if(F.col("l_returnflag") == "R").alias("returned_lines"),
        F.count_if(F.col("l_linestatus") == "F").alias("closed_lines"),
        F.count_if(F.col("l_quantity") <= 25).alias("small_lines"),
    ).withColumn("line_revenue", F.col("_units").cast("decimal(20,0)") * F.lit(Decimal("0.000001"))).drop("_units")


def orders_enriched(t: Tables, how: str = "inner") -> DataFrame:
    """orders + region + per-order line aggregates.  ``inner``: orders with
    lines, of customers with a region; ``left``: every order, with null region
    or line measures where there are none."""
    o = t.orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice",
                        "o_orderdate", "o_orderpriority")
    return (
        o.join(lines_per_order(t), F.col("l_orderkey") == F.col("o_orderkey"), how)
        .join(customer_region(t), F.col("o_custkey") == F.col("c_custkey"), how)
    )


def regional_revenue(t: Tables) -> DataFrame:
    """Shape of ``regional_revenue``: one row per (month, region).

    revenue_usd = sum of line revenue (exact decimal), orders = orders with
    lines, gross_margin_pct = mean line discount in percent (margin stand-in).
    """
    x = orders_enriched(t)
    return (
        x.groupBy(month_text("o_orderdate").alias("month"),
                  F.concat(F.lit("Q"), F.quarter("o_orderdate").cast("string")).alias("quarter"),
                  "region")
        .agg(
            F.sum("line_revenue").alias("revenue_usd"),
            F.count(F.lit(1)).alias("orders"),
            ratio(F.sum("discount_bps_sum"), F.sum("lines") * 100).alias("gross_margin_pct"),
        )
    )


def sales_customer_success(t: Tables) -> DataFrame:
    """Shape of ``sales_customer_success``: one row per (quarter, region) of all
    orders, with or without lines."""
    x = orders_enriched(t, "left")
    qidx = quarter_index("o_orderdate")
    return (
        x.groupBy(quarter_label_from_index(qidx).alias("quarter"), "region")
        .agg(
            F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("sales_revenue_usd"),
            F.count(F.lit(1)).alias("qualified_opportunities"),
            F.count_if(F.col("o_orderstatus") == "F").alias("won_deals"),
            pct(F.sum(F.col("lines") - F.col("returned_lines")), F.sum("lines"), None).alias("renewal_rate_pct"),
            pct(F.sum("closed_lines"), F.sum("lines"), None).alias("customer_satisfaction_pct"),
            pct(F.sum("small_lines"), F.sum("lines"), None).alias("implementation_on_time_pct"),
            pct(F.count_if(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")), F.count(F.lit(1)), None)
            .alias("handoff_within_2_business_days_pct"),
            pct(F.count_if(F.col("o_orderstatus") != "P"), F.count(F.lit(1)), None)
            .alias("success_plan_within_10_business_days_pct"),
            pct(F.count_if(F.col("o_orderpriority") == "1-URGENT"), F.count(F.lit(1)), None)
            .alias("at_risk_action_plan_pct"),
        )
    )


def active_customer_periods(t: Tables) -> DataFrame:
    """(customer, quarter index) pairs with at least one order; deduplicated by
    a hash aggregate (partial combine absorbs a customer with many orders)."""
    return t.orders.select(F.col("o_custkey").alias("cust"), quarter_index("o_orderdate").alias("qidx")).distinct()


def customer_churn(t: Tables) -> DataFrame:
    """Shape of ``customer_churn`` with quarters as periods.

    churned(q) = active in q and not in q+1; new(q) = active in q+1 and not in
    q.  One pass: the distinct (customer, quarter) pairs look at the customer's
    quarter before and after (a window over at most as many rows as there are
    quarters).  The last quarter has no successor and is left out.
    beginning/ending come from the F2 roll-forward.
    """
    w = Window.partitionBy("cust").orderBy("qidx")
    seen = active_customer_periods(t).select(
        "qidx", F.lead("qidx").over(w).alias("after"), F.lag("qidx").over(w).alias("before"))
    stays = F.coalesce(F.col("after") == F.col("qidx") + 1, F.lit(False))
    came = ~F.coalesce(F.col("before") == F.col("qidx") - 1, F.lit(False))
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    facts = seen.select(F.inline(F.array(
        F.struct("qidx", one.alias("a"), (~stays).cast("long").alias("c"), none.alias("n")),
        F.struct((F.col("qidx") - 1).alias("qidx"), none.alias("a"), none.alias("c"), came.cast("long").alias("n")))))
    moves = facts.groupBy("qidx").agg(
        F.sum("a").alias("active"), F.sum("c").alias("churned_customers"), F.sum("n").alias("new_customers"))
    # ~one row per quarter from here on: the unpartitioned windows are tiny.
    span = Window.partitionBy()
    bounded = moves.select(
        "*", F.min(F.when(F.col("active") > 0, F.col("qidx"))).over(span).alias("_first"),
        F.max(F.when(F.col("active") > 0, F.col("qidx"))).over(span).alias("_last"),
    ).filter((F.col("qidx") >= F.col("_first")) & (F.col("qidx") < F.col("_last")))
    start = F.first(F.when(F.col("qidx") == F.col("_first"), F.col("active")), ignorenulls=True).over(span)
    from tessera.operators.fixtures import roll_forward

    return roll_forward(
        bounded.select(quarter_label_from_index("qidx").alias("month"), "qidx",
                       "churned_customers", "new_customers", start.alias("_start"), "active"),
        order="qidx", start_col="_start",
    ).select("month", "beginning_customers", "churned_customers", "new_customers",
             "ending_customers", F.col("active").alias("active_customers"))


def document_quality(t: Tables) -> DataFrame:
    """Shape of ``employee_satisfaction`` with sources as departments.

    satisfaction = % of labelled documents with quality 1, benchmark = the
    same share over all sources of the quarter; the indicators are further
    per-source shares.  A document's quarter is its id modulo 4.
    """
    j = t.labels.select("doc_id", "quality", "toxic").join(
        t.documents.select("doc_id", "source", "lang", "n_chars"), "doc_id")
    quarter = F.concat(F.lit("Q"), (F.col("doc_id") % 4 + 1).cast("string"))
    per = j.groupBy(F.col("source").alias("department"), quarter.alias("quarter")).agg(
        F.sum("quality").alias("_good"),
        F.count(F.lit(1)).alias("labelled_docs"),
        pct(F.count(F.lit(1)) - F.sum("toxic"), F.count(F.lit(1)), 2).alias("manager_effectiveness_pct"),
        pct(F.count_if(F.col("lang") == "en"), F.count(F.lit(1)), 2).alias("workload_balance_pct"),
        pct(F.count_if(F.col("n_chars") >= 1000), F.count(F.lit(1)), 2).alias("learning_access_pct"),
    )
    span = Window.partitionBy("quarter")  # one row for each source
    return per.select(
        "department", "quarter", "labelled_docs",
        pct("_good", "labelled_docs", 2).alias("satisfaction_pct"),
        pct(F.sum("_good").over(span), F.sum("labelled_docs").over(span), 2).alias("industry_benchmark_pct"),
        "manager_effectiveness_pct", "workload_balance_pct", "learning_access_pct",
    )

"""F1-F4 generators and A1-A5 / M-metrics on them against FIXTURES.md goldens."""

from tessera.operators import fixtures as FX
from tessera.operators import metrics as M


def _rows(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.collect()]


def test_f1_and_a1_monthly_revenue(spark):
    rr = FX.regional_revenue(spark)
    assert rr.count() == 48
    got = _rows(M.monthly_revenue(rr), "month", "total_revenue_usd")
    expected = [1460000, 1503800, 1547600, 1591400, 1635200, 1679000, 1722800, 1766600,
                1810400, 1854200, 1898000, 1941800]
    assert got == [(f"2025-{i + 1:02d}", float(v)) for i, v in enumerate(expected)]


def test_f2_rollforward_and_a2(spark):
    churn = FX.customer_churn(spark)
    ending = [r["ending_customers"] for r in churn.orderBy("month").collect()]
    assert ending == [1246, 1289, 1335, 1390, 1440, 1495, 1554, 1613, 1674, 1739, 1803, 1870]
    w = M.weighted_churn(churn).first()
    assert w["churn_rate_pct"] == 2.0
    assert w["periods"] == 12
    rf = M.churn_rollforward(churn).collect()
    assert all(r["ending_matches_next"] for r in rf)
    first = [r for r in rf if r["month"] == "2025-01"][0]
    assert first["net_customer_change"] == 46 and first["churn_rate_pct"] == 2.0


def test_a3_q4_by_region(spark):
    got = _rows(M.quarter_by_region(FX.regional_revenue(spark)), "region", "q4_revenue_usd",
                "q4_orders", "q4_average_margin_pct")
    assert got == [
        ("North", 1638000.0, 1092, 42.5),
        ("East", 1482000.0, 975, 41.0),
        ("West", 1365000.0, 897, 41.7),
        ("South", 1209000.0, 819, 39.3),
    ]


def test_a4_benchmark_gap(spark):
    got = _rows(M.benchmark_gap(FX.employee_satisfaction(spark), quarter="quarter"),
                "department", "satisfaction_pct", "benchmark_gap_pct", "manager_effectiveness_pct",
                "workload_balance_pct", "learning_access_pct", "benchmark_position")
    assert got == [
        ("Customer Success", 83.0, 8.0, 82.0, 81.0, 79.0, "above"),
        ("Consulting", 81.0, 6.0, 81.0, 79.0, 77.0, "above"),
        ("Operations", 77.0, 2.0, 77.0, 84.0, 75.0, "above"),
        ("Sales", 75.0, 0.0, 74.0, 76.0, 72.0, "at"),
    ]


def test_a5_scorecard(spark):
    got = _rows(M.sales_scorecard(FX.sales_customer_success(spark)), "region", "annual_sales_revenue_usd",
                "won_deals", "qualified_opportunities", "win_rate_pct", "renewal_rate_pct",
                "customer_satisfaction_pct", "handoff_timeliness_pct", "success_plan_timeliness_pct",
                "at_risk_action_plan_pct")
    assert got == [
        ("North", 4370000.0, 147, 506, 29.05, 89.5, 85.5, 90.0, 88.0, 86.0),
        ("East", 3772000.0, 129, 442, 29.19, 87.5, 83.5, 85.0, 83.0, 81.0),
        ("West", 3588000.0, 120, 423, 28.37, 86.5, 82.5, 83.0, 81.0, 79.0),
        ("South", 3220000.0, 110, 405, 27.16, 85.5, 81.5, 79.0, 77.0, 75.0),
    ]


def test_m9_m10_m11_on_fixtures(spark):
    sat = FX.employee_satisfaction(spark)
    gap = {(r["department"], r["quarter"]): r for r in M.largest_gap(sat).collect()}
    # Sales Q1: benchmark 75, indicators 70 71 65 75 63 -> largest gap learning_time (12)
    r = gap[("Sales", "Q1")]
    assert r["indicator"] == "learning_time_target_met_pct" and r["gap_pct"] == 12.0
    agree = M.trend_agreement(sat).collect()
    assert {r["period_pairs"] for r in agree} == {3}
    risk = M.growth_at_risk(FX.sales_customer_success(spark)).collect()
    assert len(risk) == 16
    assert not any(r["growth_at_risk"] for r in risk)  # renewal and satisfaction only rise


def test_m12_top_member_ties_by_key(spark):
    df = spark.createDataFrame([(3, 10.0), (1, 10.0), (2, 5.0)], "k int, v double")
    assert M.top_member(df, "k", "v").first()["k"] == 1


def test_m13_rollup_levels(spark):
    out = M.segment_rollup(FX.sales_customer_success(spark), segment="region", period="quarter",
                           revenue="sales_revenue_usd", orders="qualified_opportunities").collect()
    levels = sorted({r["grouping_level"] for r in out})
    assert levels == [0, 1, 3]
    total = [r for r in out if r["grouping_level"] == 3][0]
    assert total["revenue_usd"] == 4370000.0 + 3772000.0 + 3588000.0 + 3220000.0


def test_m4_m5_m6_on_f1_against_python(spark):
    rows = [r.asDict() for r in FX.regional_revenue(spark).collect()]
    north = sorted((r for r in rows if r["region"] == "North"), key=lambda r: r["month"])
    # M4: revenue-weighted margin beside the plain mean
    wm = {r["region"]: r for r in M.weighted_margin(FX.regional_revenue(spark)).collect()}["North"]
    rev = [r["revenue_usd"] for r in north]
    mar = [r["gross_margin_pct"] for r in north]
    assert wm["weighted_margin_pct"] == round(sum(a * b for a, b in zip(rev, mar)) / sum(rev), 4)
    assert wm["plain_margin_pct"] == round(sum(mar) / len(mar), 4)
    # M5: month over month growth per region
    g = {(r["region"], r["month"]): r for r in M.revenue_growth(FX.regional_revenue(spark)).collect()}
    assert g[("North", "2025-01")]["growth_pct"] is None
    assert g[("North", "2025-02")]["growth_pct"] == round(100 * (rev[1] - rev[0]) / rev[0], 2)
    # M6: revenue per order as a ratio of sums
    op = {r["region"]: r for r in M.order_productivity(FX.regional_revenue(spark)).collect()}["North"]
    assert op["revenue_per_order"] == round(sum(rev) / sum(r["orders"] for r in north), 2)

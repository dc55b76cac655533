"""Shared DuckDB SQL fragments for the oracle statements.

The oracle is an independent formulation of each query in DuckDB's dialect;
these fragments mirror the derived tables of ``tessera.plans.derived``.
"""

from __future__ import annotations


def pct(num: str, den: str, digits: int | None = 2) -> str:
    v = f"(100.0::DOUBLE * CAST({num} AS DOUBLE) / NULLIF(CAST({den} AS DOUBLE), 0.0))"
    return f"ROUND({v}, {digits})" if digits is not None else v


QLABEL = "((qidx // 4)::VARCHAR || '-Q' || (qidx % 4 + 1)::VARCHAR)"
QIDX = "(year(o_orderdate) * 4 + quarter(o_orderdate) - 1)"

CUSTOMER_REGION = """cr AS (
  SELECT c_custkey, r_name AS region
  FROM customer JOIN nation ON c_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey)"""

LINES_PER_ORDER = """lpo AS (
  SELECT l_orderkey,
    SUM(CAST(l_extendedprice AS DECIMAL(15,2)) * (1 - CAST(l_discount AS DECIMAL(15,8)))) AS line_revenue,
    SUM(CAST(l_discount AS DECIMAL(15,8))) * 100 AS discount_pct_sum,
    COUNT(*) AS lines,
    COUNT(*) FILTER (WHERE l_returnflag = 'R') AS returned_lines,
    COUNT(*) FILTER (WHERE l_linestatus = 'F') AS closed_lines,
    COUNT(*) FILTER (WHERE l_quantity <= 25) AS small_lines
  FROM lineitem GROUP BY l_orderkey)"""

ORDERS_ENRICHED = f"""{CUSTOMER_REGION},
{LINES_PER_ORDER},
oe AS (
  SELECT * FROM lpo JOIN orders ON l_orderkey = o_orderkey JOIN cr ON o_custkey = c_custkey)"""

REGIONAL_REVENUE = f"""{ORDERS_ENRICHED},
rr AS (
  SELECT strftime(o_orderdate, '%Y-%m') AS month, 'Q' || quarter(o_orderdate)::VARCHAR AS quarter, region,
    SUM(line_revenue) AS revenue_usd, COUNT(*) AS orders,
    CAST(SUM(discount_pct_sum) AS DOUBLE) / NULLIF(CAST(SUM(lines) AS DOUBLE), 0.0) AS gross_margin_pct
  FROM oe GROUP BY 1, 2, 3)"""

SALES_CUSTOMER_SUCCESS = f"""{ORDERS_ENRICHED},
oq AS (SELECT o.*, cr.region, lpo.lines, lpo.returned_lines, lpo.closed_lines, lpo.small_lines, {QIDX} AS qidx
  FROM orders o LEFT JOIN lpo ON lpo.l_orderkey = o.o_orderkey LEFT JOIN cr ON cr.c_custkey = o.o_custkey),
scs AS (
  SELECT {QLABEL} AS quarter, region,
    SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS sales_revenue_usd,
    COUNT(*) AS qualified_opportunities,
    COUNT(*) FILTER (WHERE o_orderstatus = 'F') AS won_deals,
    {pct('SUM(lines - returned_lines)', 'SUM(lines)', None)} AS renewal_rate_pct,
    {pct('SUM(closed_lines)', 'SUM(lines)', None)} AS customer_satisfaction_pct,
    {pct('SUM(small_lines)', 'SUM(lines)', None)} AS implementation_on_time_pct,
    {pct("COUNT(*) FILTER (WHERE o_orderpriority IN ('1-URGENT', '2-HIGH'))", 'COUNT(*)', None)}
      AS handoff_within_2_business_days_pct,
    {pct("COUNT(*) FILTER (WHERE o_orderstatus <> 'P')", 'COUNT(*)', None)}
      AS success_plan_within_10_business_days_pct,
    {pct("COUNT(*) FILTER (WHERE o_orderpriority = '1-URGENT')", 'COUNT(*)', None)} AS at_risk_action_plan_pct
  FROM oq GROUP BY qidx, region)"""

CUSTOMER_CHURN = f"""act AS (SELECT DISTINCT o_custkey AS cust, {QIDX} AS qidx FROM orders),
moves AS (
  SELECT COALESCE(c.qidx, n.qidx - 1) AS qidx,
    COUNT(c.cust) AS active,
    COUNT(*) FILTER (WHERE c.cust IS NOT NULL AND n.cust IS NULL) AS churned_customers,
    COUNT(*) FILTER (WHERE c.cust IS NULL AND n.cust IS NOT NULL) AS new_customers
  FROM act c FULL OUTER JOIN act n ON n.cust = c.cust AND n.qidx = c.qidx + 1
  GROUP BY 1),
bounds AS (SELECT MIN(qidx) FILTER (WHERE active > 0) AS f, MAX(qidx) FILTER (WHERE active > 0) AS l FROM moves),
opening AS (SELECT m.active AS start FROM moves m, bounds b WHERE m.qidx = b.f),
churn AS (
  SELECT {QLABEL} AS month, qidx, churned_customers, new_customers, active,
    CAST(start + COALESCE(SUM(new_customers - churned_customers) OVER (
      ORDER BY qidx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS beginning_customers,
    CAST(start + SUM(new_customers - churned_customers) OVER (
      ORDER BY qidx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS ending_customers
  FROM moves, bounds, opening WHERE qidx >= f AND qidx < l)"""

DOCUMENT_QUALITY = f"""j AS (
  SELECT l.doc_id, quality, toxic, source, lang, n_chars
  FROM labels l JOIN documents d ON l.doc_id = d.doc_id),
per AS (
  SELECT source AS department, 'Q' || (doc_id % 4 + 1)::VARCHAR AS quarter, SUM(quality) AS good, COUNT(*) AS labelled_docs,
    {pct('COUNT(*) - SUM(toxic)', 'COUNT(*)')} AS manager_effectiveness_pct,
    {pct("COUNT(*) FILTER (WHERE lang = 'en')", 'COUNT(*)')} AS workload_balance_pct,
    {pct('COUNT(*) FILTER (WHERE n_chars >= 1000)', 'COUNT(*)')} AS learning_access_pct
  FROM j GROUP BY 1, 2),
dq AS (
  SELECT department, quarter, labelled_docs, {pct('good', 'labelled_docs')} AS satisfaction_pct,
    {pct('SUM(good) OVER (PARTITION BY quarter)', 'SUM(labelled_docs) OVER (PARTITION BY quarter)')} AS industry_benchmark_pct,
    manager_effectiveness_pct, workload_balance_pct, learning_access_pct
  FROM per)"""

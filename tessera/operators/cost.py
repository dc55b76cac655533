"""Token-cost accounting (K1-K5).

Prices are exact: 0.0015 USD / 1000 input tokens and 0.009 USD / 1000 output
tokens make ``15*in + 90*out`` the cost in units of 1e-7 USD, an integer.
Rounding is done on that integer (half up), so no engine-specific float
rounding can leak in.  The reference rounds the binary double instead; the
two differ only on exact sixth-decimal ties (see README).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.columns import col

# ---------------------------------------------------------------------------
# Prices per 1000 tokens and the log's rounding.
COST_PER_1K_INPUT = 0.0015
COST_PER_1K_OUTPUT = 0.009
COST_DIGITS = 6
PER_1000_DIGITS = 2
TOTAL_AGENT = "TOTAL"
# ---------------------------------------------------------------------------
_IN_UNITS, _OUT_UNITS = 15, 90  # prices in 1e-7 USD per token


def clean_tokens(c) -> Column:
    """K4: missing or NULL token count -> 0, as bigint."""
    return F.coalesce(col(c).cast("long"), F.lit(0).cast("long"))


def _units(inp, out) -> Column:
    return F.lit(_IN_UNITS).cast("long") * col(inp) + F.lit(_OUT_UNITS).cast("long") * col(out)


def call_cost(inp, out) -> Column:
    """K1: cost in USD rounded half-up to 6 decimals."""
    return F.floor((_units(inp, out) + 5) / 10).cast("double") / F.lit(1e6)


def cost_per_1000(inp, out) -> Column:
    """K2: unrounded cost x 1000, rounded half-up to 2 decimals."""
    return F.floor((_units(inp, out) + 50) / 100).cast("double") / F.lit(100.0)


def priced(df: DataFrame, inp="input_tokens", out="output_tokens") -> DataFrame:
    i, o = clean_tokens(inp), clean_tokens(out)
    return df.withColumn(inp, i).withColumn(out, o).select(
        "*", call_cost(inp, out).alias("cost_usd"), cost_per_1000(inp, out).alias("cost_per_1000_queries"))


def with_totals(calls: DataFrame, query="query", agent="agent", inp="input_tokens",
                out="output_tokens") -> DataFrame:
    """K3: per question, sum the (cleaned) tokens of its calls and price the
    sums, as an extra row with agent 'TOTAL' beside the detail rows.

    One pass over the calls: both groupings come from one aggregate (combined
    before the shuffle), in which equal detail rows are counted and given back.
    """
    one = calls.select(query, agent, clean_tokens(inp).alias(inp), clean_tokens(out).alias(out),
                       clean_tokens(inp).alias("_i"), clean_tokens(out).alias("_o"))
    keys = [query, agent, inp, out]
    both = one.groupingSets([keys, [query]], *keys).agg(
        F.grouping_id().alias("_g"), F.count(F.lit(1)).alias("_n"), F.sum("_i").alias("_i"), F.sum("_o").alias("_o"))
    total = F.col("_g") > 0
    rows = both.select(
        query, F.when(total, F.lit(TOTAL_AGENT)).otherwise(F.col(agent)).alias(agent),
        F.when(total, F.col("_i")).otherwise(F.col(inp)).alias(inp),
        F.when(total, F.col("_o")).otherwise(F.col(out)).alias(out),
        F.explode(F.sequence(F.lit(1).cast("long"), F.when(total, F.lit(1).cast("long")).otherwise(F.col("_n")))).alias("_k"))
    return priced(rows.drop("_k"), inp, out)


def two_call_tokens(status, gen, exp) -> Column:
    """K5: a SQL answer's tokens = generation + explanation; a blocked or failed
    statement has only the generation call."""
    return clean_tokens(gen) + F.when(col(status) == "PASSED", clean_tokens(exp)).otherwise(0)

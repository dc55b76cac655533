"""Group a user's events into runs; an opening event starts a new run.

The run number is a running count of opening events in time order.  A plain
``Window.partitionBy(user)`` would put a hot user (a third of all events) in
one task, so the prefix sum is split in two phases:

1. count openings per (user, time bucket) and take the prefix over each user's
   buckets -- one row per bucket, small;
2. a running count inside each (user, bucket) window plus that offset.

Run statistics are then ordinary aggregates (partial combine before shuffle).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def number_runs(events: DataFrame, opens: Column, key="user_id", ts="ts", tie="event_id",
                bucket: str = "hour") -> DataFrame:
    """Adds ``run_no`` (0 = events before the first opening event)."""
    e = events.select("*", opens.cast("int").alias("_open"), F.date_trunc(bucket, F.col(ts)).alias("_b"))
    per_bucket = e.groupBy(key, "_b").agg(F.sum("_open").alias("_nb"))
    before = Window.partitionBy(key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_bucket.select(key, "_b", F.coalesce(F.sum("_nb").over(before), F.lit(0)).alias("_off"))
    inside = Window.partitionBy(key, "_b").orderBy(ts, tie).rowsBetween(Window.unboundedPreceding,
                                                                        Window.currentRow)
    # null users and times are groups of their own: they keep their rows
    offsets = offsets.select(F.col(key).alias("_k"), F.col("_b").alias("_kb"), "_off")
    return (
        e.join(offsets, F.col(key).eqNullSafe(F.col("_k")) & F.col("_b").eqNullSafe(F.col("_kb")))
        .withColumn("run_no", (F.col("_off") + F.sum("_open").over(inside)).cast("long"))
        .drop("_open", "_b", "_off", "_k", "_kb")
    )


def run_summary(events: DataFrame, opens: Column, key="user_id", ts="ts", tie="event_id",
                kind="event_type", value="value", bucket: str = "hour") -> DataFrame:
    """Per (user, run): events, whether an opening event started it, elapsed
    seconds from first to last event, purchases, errors and total value."""
    runs = number_runs(events, opens, key, ts, tie, bucket)
    micros = F.expr(f"timestampdiff(MICROSECOND, min({ts}), max({ts}))")
    return runs.groupBy(key, "run_no").agg(
        F.count(F.lit(1)).alias("n_events"),
        (F.col("run_no") > 0).alias("opened_by_signup"),
        F.round(micros / F.lit(1e6), 6).alias("elapsed_seconds"),
        F.count_if(F.col(kind) == "purchase").alias("n_purchases"),
        F.count_if(F.col(kind) == "error").alias("n_errors"),
        F.round(F.sum(F.col(value).cast("decimal(18,2)")), 2).cast("double").alias("total_value"),
    )


def stage_seconds(events: DataFrame, opens: Column, key="user_id", ts="ts", tie="event_id", kind="event_type",
                  bucket: str = "hour") -> DataFrame:
    """Per (user, run): the route, the sorted kinds of events after the opening
    one, and the seconds of each kind, a stage lasting from the event before it
    in the run.  The gaps come from a window over (user, bucket), and an event
    that is first in its bucket takes the last time of the buckets before."""
    runs = number_runs(events, opens, key, ts, tie, bucket).withColumn("_b", F.date_trunc(bucket, F.col(ts)))
    inside = Window.partitionBy(key, "_b", "run_no").orderBy(ts, tie)
    order = Window.partitionBy(key, "run_no").orderBy("_b")
    last = runs.groupBy(key, "run_no", "_b").agg(F.max(ts).alias("_last"))
    carried = last.select(F.col(key).alias("_k"), F.col("run_no").alias("_r"), F.col("_b").alias("_kb"),
                          F.lag("_last").over(order).alias("_before"))
    met = runs.withColumn("_near", F.lag(ts).over(inside)).join(
        carried, F.col(key).eqNullSafe(F.col("_k")) & F.col("run_no").eqNullSafe(F.col("_r"))
        & F.col("_b").eqNullSafe(F.col("_kb")))
    prev = F.coalesce("_near", "_before")
    gap = F.expr(f"timestampdiff(MICROSECOND, _p, {ts})")
    steps = met.withColumn("_p", prev).where("_p IS NOT NULL").select(key, "run_no", kind, gap.alias("_us"))
    per = steps.groupBy(key, "run_no", kind).agg(F.count(F.lit(1)).alias("n_stages"),
                                                 F.round(F.sum("_us") / F.lit(1e6), 6).alias("seconds"))
    route = F.array_sort(F.collect_set(kind)).alias("route")  # at most as many as there are kinds
    routes = per.groupBy(F.col(key).alias("_k"), F.col("run_no").alias("_r")).agg(route)
    return per.join(routes, F.col(key).eqNullSafe(F.col("_k")) & (F.col("run_no") == F.col("_r"))).drop("_k", "_r")

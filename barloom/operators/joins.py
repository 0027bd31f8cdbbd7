"""As-of joins and small join helpers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def asof(left: DataFrame, right: DataFrame, by: list[str], left_time: str, right_time: str, columns: list[str],
         strict: bool = False, forward: bool = False, bucket: str | None = None) -> DataFrame:
    """Left rows with ``columns`` of the nearest right row at or before (after) the left time.

    Both sides are laid in one time-ordered sequence per key and the latest right row is carried
    along, so every key is read once. ``strict`` excludes equal times. ``bucket`` (a trunc unit
    such as "month") cuts long keys: the carry between buckets comes from one row per bucket.
    """
    right_rank, left_rank = (1, 0) if strict else (0, 1)
    l = left.select(F.col(left_time).alias("_t"), F.lit(left_rank).alias("_o"), *by,
                    F.struct(*left.columns).alias("_l"))
    r = right.where(F.col(right_time).isNotNull()).select(
        F.col(right_time).alias("_t"), F.lit(right_rank).alias("_o"), *by,
        F.struct(*(F.col(c) for c in columns)).alias("_r"))
    rows = l.unionByName(r, allowMissingColumns=True)
    time = F.col("_t").desc() if forward else F.col("_t").asc()
    keys = list(by)
    carry = F.lit(None)
    if bucket is not None:
        rows = rows.withColumn("_b", F.trunc(F.col("_t").cast("date"), bucket))
        pick = F.min_by if forward else F.max_by
        ends = r.withColumn("_b", F.trunc(F.col("_t").cast("date"), bucket)).groupBy(*by, "_b").agg(
            pick("_r", "_t").alias("_end"))
        spans = rows.select(*by, "_b").distinct().join(ends, [*by, "_b"], "left")
        turn = F.col("_b").desc() if forward else F.col("_b").asc()
        seen = Window.partitionBy(*by).orderBy(turn).rowsBetween(Window.unboundedPreceding, -1)
        spans = spans.select(*by, "_b", F.last("_end", ignorenulls=True).over(seen).alias("_carry"))
        rows = rows.join(spans, [*by, "_b"])
        keys, carry = [*by, "_b"], F.col("_carry")
    order = Window.partitionBy(*keys).orderBy(time, F.col("_o"))
    latest = F.coalesce(F.last("_r", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)), carry) \
        if bucket is not None else F.last("_r", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    found = rows.withColumn("_m", latest).where(F.col("_l").isNotNull())
    return found.select("_l.*", *(F.col("_m")[c].alias(c) for c in columns))


def next_trading_day(calendar: DataFrame, dates: DataFrame, date: str, name: str = "next_day") -> DataFrame:
    """First trading day strictly after each date, else NULL."""
    days = calendar.select(F.col("trade_date").alias(name)).distinct()
    marked = days.withColumn("_k", F.lit(0))
    return asof(dates.withColumn("_k", F.lit(0)), marked, ["_k"], date, name, [name], strict=True, forward=True).drop("_k")


def inside_interval(rows: DataFrame, intervals: DataFrame, key: str, time: str, start: str, end: str) -> DataFrame:
    """Interval join on a shared key: rows whose time lies in [start, end] (open end allowed)."""
    cond = (rows[key] == intervals[key]) & (rows[time] >= intervals[start]) & (
        intervals[end].isNull() | (rows[time] <= intervals[end]))
    return rows.join(intervals, cond).drop(intervals[key])

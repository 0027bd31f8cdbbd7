"""Parameter grids evaluated as data, rolling windows and comparisons."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barloom.operators.portfolio import YEAR_DAYS, breakout_signals, long_only_returns, strategy_metrics
from barloom.session import materialise


def grid(spark: SparkSession, axes: dict[str, float | tuple[float, float, float] | DataFrame]) -> DataFrame:
    """Cartesian product of fixed values, (start, end, step) ranges and the distinct values of one-column tables, with a ``param_id``.

    The product is the grid itself: its size is the caller's choice.
    """
    out = spark.range(1)
    for name, spec in axes.items():
        if isinstance(spec, DataFrame):
            found = spec.select(F.col(spec.columns[0]).cast("double").alias(name)).where(F.col(name).isNotNull()).distinct()
            out = out.join(found)
            continue
        if isinstance(spec, tuple):
            start, end, step = spec
            if step <= 0 or end < start:
                raise ValueError(f"bad range for {name}")
            values = [start + k * step for k in range(int(math.floor((end - start) / step + 1e-9)) + 1)]
        else:
            values = [spec]
        out = out.withColumn(name, F.explode(F.array(*map(F.lit, values))))
    return out.drop("id").withColumn("param_id", F.row_number().over(Window.orderBy(*axes)))


def breakout_sweep(bars: DataFrame, params: DataFrame, max_positions: int, cost_rate: float,
                   target: str = "annual_return") -> DataFrame:
    """Channel-breakout metrics of every (entry, exit) setting, best first.

    The settings multiply the panel (their number is the caller's), so all of them run in one
    plan; channels are taken from a collected tail because the window length varies per row.
    """
    longest = params.agg(F.max(F.greatest("entry", "exit")).cast("int")).first()[0]
    back = Window.partitionBy("vt_symbol").orderBy("datetime").rowsBetween(-longest, -1)
    panel = bars.select("datetime", "vt_symbol", "close",
                        F.collect_list("high").over(back).alias("highs"), F.collect_list("low").over(back).alias("lows"))

    def channel(values: str, n: str, pick) -> Column:
        size = F.col(n).cast("int")
        return F.when(F.size(values) >= size, pick(F.slice(values, F.greatest(F.size(values) - size + 1, F.lit(1)), size)))

    crossed = panel.crossJoin(F.broadcast(params)).select(
        "param_id", "datetime", "vt_symbol", "close",
        channel("highs", "entry", F.array_max).alias("entry_channel"), channel("lows", "exit", F.array_min).alias("exit_channel"))
    daily = long_only_returns(breakout_signals(crossed, ["param_id"]), max_positions, cost_rate, ["param_id"])
    return params.join(strategy_metrics(daily, by=["param_id"]), "param_id").orderBy(F.col(target).desc(), "param_id")


def rolling_windows(periods: DataFrame, size: int, step: int) -> DataFrame:
    """Windows of ``size`` periods every ``step``, the last one aligned to the end.

    ``periods`` is (rebalance_date); the result is (window_id, start, end).
    """
    order = Window.orderBy("rebalance_date")
    p = periods.select("rebalance_date").distinct().withColumn("_i", F.row_number().over(order) - 1)
    total = p.agg(F.count(F.lit(1)).alias("_n"))
    p = p.crossJoin(F.broadcast(total))
    last = F.col("_n") - size
    starts = p.where((last >= 0) & (((F.col("_i") % step == 0) & (F.col("_i") <= last)) | (F.col("_i") == last)))
    ends = p.select((F.col("_i") - size + 1).alias("_i"), F.col("rebalance_date").alias("end"))
    return starts.select("_i", F.col("rebalance_date").alias("start")).join(ends, "_i").select(
        F.row_number().over(Window.orderBy("start")).alias("window_id"), "start", "end")


#: Rows of a curve that are summed up as one block.
BLOCK_ROWS = 64


def _places(rows: DataFrame, windows: DataFrame, by: list[str]) -> DataFrame:
    """For each curve and window the numbers of the first and last row inside: a running count over dates and bounds in one order."""
    groups = rows.select(*by).distinct() if by else None
    bounds = windows.select("window_id", "start", "end") if groups is None else windows.select("window_id", "start", "end").join(groups)
    none = F.lit(None).cast(windows.schema["window_id"].dataType)
    # a start comes before a row of its date, an end after it
    marks = rows.select(*by, F.col("datetime").cast("timestamp").alias("at"), F.lit(1).alias("kind"), none.alias("window_id"))
    for kind, name in ((0, "start"), (2, "end")):
        marks = marks.unionByName(bounds.select(*by, F.col(name).cast("timestamp").alias("at"), F.lit(kind).alias("kind"), "window_id"))
    order = Window.partitionBy(*by).orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    counted = marks.withColumn("passed", F.sum((F.col("kind") == 1).cast("long")).over(order)).where("kind <> 1")
    spans = counted.groupBy(*by, "window_id").agg(F.max(F.when(F.col("kind") == 0, F.col("passed"))).alias("lo"), (F.max(F.when(F.col("kind") == 2, F.col("passed"))) - 1).alias("hi"))
    return spans.where("lo <= hi")


def window_metrics(nav: DataFrame, windows: DataFrame, by: list[str] = [], block: int = BLOCK_ROWS) -> DataFrame:
    """NAV metrics inside every window (window_id, start, end), one row for each curve ``by`` and window with any row.

    Windows overlap, so they don't read their rows one by one: a curve is summed up in blocks (counts, sums of returns and their squares,
    extremes and the largest fall), and a window joins whole blocks, and single rows at its ends only, by their numbers.
    """
    seq = Window.partitionBy(*by).orderBy("datetime")
    rows = nav.select(*by, "datetime", "nav", (F.row_number().over(seq) - 1).cast("long").alias("i"), (F.try_divide("nav", F.lag("nav").over(seq)) - 1).alias("r"))
    rows = materialise(rows.withColumn("b", F.floor(F.col("i") / block)), "curves")  # read for places, blocks and ends
    inside = Window.partitionBy(*by, "b").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    names = ["n", "first", "last", "returns", "total", "squares", "high", "low", "fall"]
    blocks = rows.withColumn("d", F.try_divide("nav", F.max("nav").over(inside)) - 1).groupBy(*by, "b").agg(
        F.count("nav").alias("n"), F.min_by("nav", "i").alias("first"), F.max_by("nav", "i").alias("last"), F.count("r").alias("returns"), F.sum("r").alias("total"),
        F.sum(F.col("r") * F.col("r")).alias("squares"), F.max("nav").alias("high"), F.min("nav").alias("low"), F.min("d").alias("fall"))
    # the first row of a window is always a single one, as its return does not count
    spans = _places(rows, windows, by).withColumns({"f": F.floor(F.col("lo") / block) + 1, "l": F.floor((F.col("hi") + 1) / block) - 1})
    tail = F.greatest(F.col("f"), F.col("l") + 1) * block
    none = F.array().cast("array<long>")
    single = F.concat(F.sequence("lo", F.least(F.col("hi"), F.col("f") * block - 1)), F.when(tail <= F.col("hi"), F.sequence(tail, F.col("hi"))).otherwise(none))
    ends = spans.select(*by, "window_id", "lo", F.explode(single).alias("i")).join(rows.drop("b"), [*by, "i"])
    r = F.when(F.col("i") > F.col("lo"), F.col("r"))
    zero = F.when(F.col("nav").isNotNull(), F.lit(0.0))
    ends = ends.select(*by, "window_id", F.col("i").alias("at"), F.col("nav").isNotNull().cast("long").alias("n"), F.col("nav").alias("first"), F.col("nav").alias("last"),
                       r.isNotNull().cast("long").alias("returns"), r.alias("total"), (r * r).alias("squares"), F.col("nav").alias("high"), F.col("nav").alias("low"), zero.alias("fall"))
    whole = spans.where("f <= l").select(*by, "window_id", F.explode(F.sequence("f", "l")).alias("b")).join(blocks, [*by, "b"])
    parts = ends.unionByName(whole.select(*by, "window_id", (F.col("b") * block).alias("at"), *names))
    earlier = Window.partitionBy(*by, "window_id").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("fall", F.least("fall", F.try_divide("low", F.max("high").over(earlier)) - 1))
    sums = parts.groupBy(*by, "window_id").agg(
        F.sum("n").alias("n"), (F.max_by("last", "at") / F.min_by("first", "at")).alias("growth"), F.min("fall").alias("fall"), (F.sum("total") / F.sum("returns")).alias("mean"),
        (F.sum("squares") / F.sum("returns")).alias("square"))
    spread = F.sqrt(F.greatest(F.col("square") - F.col("mean") * F.col("mean"), F.lit(0.0)))
    enough = F.col("n") >= 2

    def or_zero(x: Column) -> Column:
        return F.coalesce(F.when(enough, x), F.lit(0.0))

    found = sums.select(
        *by, "window_id", "n", or_zero(F.col("growth") - 1).alias("total_return"),
        or_zero(F.pow("growth", YEAR_DAYS / (F.col("n") - F.when(enough, 1).otherwise(0))) - 1).alias("annual_return"),
        or_zero(F.least("fall", F.lit(0.0))).alias("max_drawdown"), or_zero(F.try_divide("mean", spread) * math.sqrt(YEAR_DAYS)).alias("sharpe"))
    return windows.join(found, "window_id")


def compare_groups(metrics: DataFrame, base: str, other: str, group: str = "group", key: str = "window_id") -> DataFrame:
    """Differences of the other group's metrics to the base group's per window."""
    names = ["total_return", "annual_return", "max_drawdown", "sharpe"]
    return metrics.groupBy(key).agg(*(
        (F.max(F.when(F.col(group) == other, F.col(n))) - F.max(F.when(F.col(group) == base, F.col(n)))).alias(f"d_{n}") for n in names))


def marginal_contributions(metrics: DataFrame, order: str, value: str) -> DataFrame:
    """Change of a metric from each step of an ordered series of settings to the next."""
    return metrics.withColumn("contribution", F.col(value) - F.lag(value).over(Window.orderBy(order)))

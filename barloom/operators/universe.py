"""Universe layers and point-in-time tables."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barloom.functions import algebra as A
from barloom.functions.algebra import field
from barloom.functions.scalars import compact_date
from barloom.operators.evaluate import evaluate


@dataclass(frozen=True)
class UniverseConfig:
    """Thresholds; the defaults are fixed values of the published rules."""

    min_listed_days: int = 120
    min_price: float = 2.0
    min_turnover: float = 20_000_000.0
    turnover_window: int = 20
    buy_ratio: float = 0.01
    sell_ratio: float = 0.01


def first_reason(rules: Sequence[tuple[str, Column]], otherwise: str | None = None) -> Column:
    """Name of the first rule whose condition holds."""
    out = None
    for name, failed in rules:
        out = F.when(failed, name) if out is None else out.when(failed, name)
    return out if otherwise is None else out.otherwise(otherwise)


def _no(rule: Column) -> Column:
    return F.coalesce(rule, F.lit(False))


def symbol_master(symbols: DataFrame, bars: DataFrame) -> DataFrame:
    """Effective listing interval: list date or first bar, delisting after 2090 means none."""
    first = bars.groupBy("vt_symbol").agg(F.min("datetime").cast("date").alias("first_bar"))
    delist = compact_date(F.col("delist_date"))
    return symbols.join(first, "vt_symbol", "left").withColumns({
        "effective_list_date": F.coalesce(compact_date(F.col("list_date")), F.col("first_bar")),
        "effective_delist_date": F.when(~(delist > F.lit("2090-01-01").cast("date")), delist),
    }).where(F.col("effective_list_date").isNotNull()).drop("first_bar")


def daily_universe(symbols: DataFrame, calendar: DataFrame, bars: DataFrame) -> DataFrame:
    """One row per trading date and listed symbol.

    The interval is turned into calendar ordinals, so each symbol explodes to its own dates
    and no pair outside an interval is ever formed.
    """
    span = bars.agg(F.min("datetime").cast("date").alias("_a"), F.max("datetime").cast("date").alias("_b"))
    days = calendar.select(F.col("trade_date").cast("date").alias("datetime")).distinct()
    days = days.crossJoin(F.broadcast(span)).where("datetime BETWEEN _a AND _b").select("datetime")
    days = days.withColumn("_k", F.row_number().over(Window.orderBy("datetime")))
    master = symbol_master(symbols, bars)
    # calendar ordinals of the interval ends: as-of lookups over (date, kind) marks
    marks = master.select(F.col("effective_list_date").alias("_d")).union(
        master.select("effective_delist_date")).where("_d IS NOT NULL").distinct()
    both = days.select(F.col("datetime").alias("_d"), "_k").unionByName(
        marks.withColumn("_k", F.lit(None).cast("int")))
    order = Window.orderBy("_d").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    spot = both.select("_d", F.max("_k").over(order).alias("_at"), F.col("_k").isNotNull().alias("_is_day")).groupBy("_d").agg(
        F.max("_at").alias("_upto"), F.max("_is_day").alias("_is_day"))
    spot = spot.withColumn("_upto", F.coalesce("_upto", F.lit(0)))
    top = days.agg(F.max("_k").alias("_top"))
    listed = (
        master.join(spot.select(F.col("_d").alias("effective_list_date"), F.col("_upto").alias("_l"),
                                F.col("_is_day").alias("_ld")), "effective_list_date")
        .join(spot.select(F.col("_d").alias("effective_delist_date"), F.col("_upto").alias("_e")),
              "effective_delist_date", "left")
        .crossJoin(F.broadcast(top))
        .withColumn("_from", F.when(F.col("_ld"), F.col("_l")).otherwise(F.col("_l") + 1))
        .withColumn("_to", F.coalesce("_e", "_top"))
        .where("_from <= _to")
        .withColumn("_k", F.explode(F.sequence("_from", "_to")))
    )
    return listed.join(days, "_k").withColumn("in_universe", F.lit(True)).select(
        "datetime", *symbols.columns, "effective_list_date", "effective_delist_date", "in_universe")


def daily_status(universe: DataFrame, bars: DataFrame, config: UniverseConfig = UniverseConfig()) -> DataFrame:
    """Special-treatment, suspension, age, price and liquidity flags with the first failing rule."""
    measured = evaluate(bars, {
        "bar_listed_days": A.ordinal(), "avg_turnover": A.ts_mean(field("turnover"), config.turnover_window)})
    c = F.col
    df = universe.join(measured, ["datetime", "vt_symbol"], "left")
    missing = c("close").isNull()
    df = df.withColumns({
        "is_st": _no(c("name").contains("ST")),
        "is_suspended": (F.coalesce("volume", F.lit(0)) <= 0) | (F.coalesce("turnover", F.lit(0)) <= 0) | missing,
        "listed_days": F.coalesce("bar_listed_days", F.lit(0)).cast("long"),
        "price_ok": _no(c("close") >= config.min_price),
        "liquidity_ok": _no(c("avg_turnover") >= config.min_turnover),
    })
    rules = [("not_in_universe", ~c("in_universe")), ("st", c("is_st")),
             ("suspended_or_missing_bar", c("is_suspended")),
             ("listed_days", c("listed_days") < config.min_listed_days),
             ("low_price", ~c("price_ok")), ("low_turnover", ~c("liquidity_ok"))]
    df = df.withColumn("status_reason", first_reason(rules, "ok"))
    return df.withColumn("tradable", c("status_reason") == "ok")


def universe_layers(status: DataFrame, config: UniverseConfig = UniverseConfig()) -> dict[str, DataFrame]:
    """Research, tradable and execution layers, each with a flag and a reason."""
    inside = status.where("in_universe")
    keys = ["datetime", "vt_symbol"]
    money = F.coalesce("turnover", F.lit(0.0))
    can = F.col("tradable") & (money * config.buy_ratio > 0) & (money * config.sell_ratio > 0)
    return {
        "research": inside.select(*keys, F.lit(True).alias("in_research"), F.lit("ok").alias("research_reason")),
        "tradable": inside.select(*keys, F.col("tradable").alias("in_tradable"),
                                  F.col("status_reason").alias("tradable_reason")),
        "execution": inside.select(*keys, can.alias("in_execution"),
                                   F.when(can, "ok").otherwise(F.col("status_reason")).alias("execution_reason")),
    }


def basic_filters(bars: DataFrame, config: UniverseConfig = UniverseConfig()) -> DataFrame:
    """Tradability flags on bars; absent optional columns get defaults."""
    for name in ("is_st", "is_suspended"):
        if name not in bars.columns:
            bars = bars.withColumn(name, F.lit(False))
    if "turnover" not in bars.columns:
        bars = bars.withColumn("turnover", F.col("close") * F.col("volume"))
    df = evaluate(bars, {"listed_days": A.ordinal(),
                         "avg_turnover": A.ts_mean(field("turnover"), config.turnover_window)})
    c = F.col
    reason = first_reason([
        ("st", c("is_st")), ("suspended", c("is_suspended")), ("listed_days", c("listed_days") < config.min_listed_days),
        ("low_price", c("close") < config.min_price), ("low_turnover", c("avg_turnover") < config.min_turnover)], "ok")
    return df.withColumn("reason", reason).withColumn("tradable", c("reason") == "ok")


def tradable_symbols(filtered: DataFrame, date: str) -> DataFrame:
    return filtered.where((F.col("datetime") == F.lit(date).cast("date")) & F.col("tradable")).select(
        "vt_symbol").orderBy("vt_symbol")


def tradable_calendar(bars: DataFrame, master: DataFrame, config: UniverseConfig = UniverseConfig()) -> DataFrame:
    """Bars with the master snapshot: age, limits, tradable flag and reason."""
    df = evaluate(bars, {"listed_days": A.ordinal(),
                         "avg_turnover_20": A.ts_mean(field("turnover"), config.turnover_window)})
    c = F.col
    df = df.join(master, "vt_symbol", "left").withColumns({
        "is_st": _no(c("name").contains("ST")), "is_suspended": c("turnover") <= 0,
        "is_limit_up": _no(c("close") >= c("limit_up")), "is_limit_down": _no(c("close") <= c("limit_down"))})
    reason = first_reason([
        ("st", c("is_st")), ("suspended", c("is_suspended")), ("listed_days", c("listed_days") < config.min_listed_days),
        ("low_price", c("close") < config.min_price),
        ("low_turnover", c("avg_turnover_20") < config.min_turnover)], "ok")
    return df.withColumn("reason", reason).withColumn("tradable", c("reason") == "ok").select(
        "datetime", "vt_symbol", "name", "board", "listed_days", "is_st", "is_suspended", "is_limit_up",
        "is_limit_down", "turnover", "avg_turnover_20", "tradable", "reason")


def sample_universe(bars: DataFrame, symbols: DataFrame) -> DataFrame:
    """Distinct (date, symbol) with a flag for symbols of the list (a semi-join, not a literal list)."""
    listed = symbols.select("vt_symbol").distinct().withColumn("_in", F.lit(True))
    return bars.select("datetime", "vt_symbol").distinct().join(listed, "vt_symbol", "left").select(
        "datetime", "vt_symbol", F.coalesce("_in", F.lit(False)).alias("in_universe"))


def adjust_factors(raw: DataFrame, adjusted: DataFrame) -> DataFrame:
    keys = ["datetime", "vt_symbol"]
    joined = raw.select(*keys, F.col("close").alias("raw_close")).join(
        adjusted.select(*keys, F.col("close").alias("adjusted_close")), keys)
    return joined.where(F.col("raw_close") != 0).withColumns({
        "adjust_factor": F.col("adjusted_close") / F.col("raw_close"),
        "source": F.lit("adjusted_over_raw"), "pit_status": F.lit("derived_from_adjusted_bars")})


def corporate_actions(factors: DataFrame, threshold: float) -> DataFrame:
    """Candidate dates: the factor moved by at least the threshold."""
    df = evaluate(factors, {"previous_factor": A.ts_delay(field("adjust_factor"), 1),
                            "factor_change": A.pct_change(field("adjust_factor"), 1)}, keep=["adjust_factor"])
    return df.where(F.abs("factor_change") >= threshold).withColumns({
        "source": F.lit("adjust_factor_change"), "pit_status": F.lit("candidate_from_factor_change")})


def limit_status(raw: DataFrame, instruments: DataFrame) -> DataFrame:
    snap = instruments.select("vt_symbol", F.col("limit_up").cast("double").alias("limit_up_snapshot"),
                              F.col("limit_down").cast("double").alias("limit_down_snapshot"))
    return raw.select("datetime", "vt_symbol", "close").join(snap, "vt_symbol", "left").withColumns({
        "is_limit_up": _no(F.col("close") >= F.col("limit_up_snapshot")),
        "is_limit_down": _no(F.col("close") <= F.col("limit_down_snapshot")),
        "source": F.lit("instrument_master_snapshot"), "pit_status": F.lit("snapshot_based")})


def suspension_daily(raw: DataFrame, status: DataFrame | None = None) -> DataFrame:
    """From the status table, else from zero volume or turnover (missing counts as suspended)."""
    if status is not None and "is_suspended" in status.columns:
        reason = F.col("status_reason") if "status_reason" in status.columns else F.lit(None).cast("string")
        return status.select("datetime", "vt_symbol", "is_suspended", reason.alias("reason"),
                             F.lit("daily_status").alias("source"),
                             F.lit("derived_from_daily_status").alias("pit_status"))
    stopped = F.coalesce((F.col("volume") <= 0) | (F.col("turnover") <= 0), F.lit(True))
    return raw.select("datetime", "vt_symbol", stopped.alias("is_suspended"),
                      F.when(stopped, "zero_volume_or_turnover").alias("reason"),
                      F.lit("raw_bars_zero_volume_rule").alias("source"), F.lit("approximation").alias("pit_status"))


def st_daily(raw: DataFrame, instruments: DataFrame, status: DataFrame | None = None) -> DataFrame:
    if status is not None and "is_st" in status.columns:
        name = F.col("name") if "name" in status.columns else F.lit(None).cast("string")
        return status.select("datetime", "vt_symbol", "is_st", name.alias("name_snapshot"),
                             F.lit("daily_status").alias("source"),
                             F.lit("derived_from_daily_status").alias("pit_status"))
    snap = instruments.select("vt_symbol", F.col("name").alias("name_snapshot"))
    return raw.select("datetime", "vt_symbol").join(snap, "vt_symbol", "left").withColumns({
        "is_st": _no(F.col("name_snapshot").contains("ST")),
        "source": F.lit("instrument_master_snapshot"), "pit_status": F.lit("snapshot_based")})


def universe_summary(status: DataFrame) -> DataFrame:
    """Rows, symbols, dates and counts per reason in one long table (name, value)."""
    head = status.agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("vt_symbol").alias("symbols"),
        F.count_distinct("datetime").alias("dates"), F.count_if("tradable").alias("tradable"))
    tall = head.select(F.explode(F.array(*(
        F.struct(F.lit(n).alias("name"), F.col(n).alias("value")) for n in head.columns))).alias("r")).select("r.*")
    reasons = status.groupBy(F.concat(F.lit("reason:"), F.col("status_reason")).alias("name")).agg(
        F.count(F.lit(1)).alias("value"))
    return tall.unionByName(reasons)

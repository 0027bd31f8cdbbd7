"""Screening pipeline: industry momentum and breadth, stock filters, scoring, selection.

Rebalance dates are a column: every period is computed in the same plan, nothing loops over
dates. Only the calendar (one row per trading date) and tables derived from it are broadcast.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barloom.functions import algebra as A
from barloom.functions.algebra import field
from barloom.operators.dataset import query_by_time
from barloom.operators.evaluate import evaluate
from barloom.operators.evaluation import _pct_rank, period_ends
from barloom.operators.universe import first_reason
from barloom.session import materialise

# calendars above this many rows are joined without a broadcast hint
CALENDAR_ROWS = 1_000_000


@dataclass(frozen=True)
class ScreeningConfig:
    """Parameters of a screening run; the defaults are fixed values of the published strategy."""

    mode: str = "none"
    rebalance: str = "weekly"
    start: str | None = None
    end: str | None = None
    momentum_window: int = 20
    confirm_window: int = 5
    breadth_window: int = 20
    breadth_min: float = 0.60
    rank_gate: int = 5
    top_industries: int = 3
    min_members: int = 5
    max_streak: int = 0
    trend_filters: bool = False
    ma_windows: tuple[int, int, int] = (20, 60, 120)
    slope_lag: int = 5
    bias_max: float = 0.25
    min_bars: int = 252
    high_window: int = 252
    near_high_min: float = 0.80
    volume_short: int = 20
    volume_long: int = 60
    volume_cap: float = 3.0
    weights: tuple[float, float, float] = (-0.40, 0.35, -0.25)
    volatility_window: int = 20
    volatility_weight: float = 0.0
    illiquidity_window: int = 20
    illiquidity_weight: float = 0.0
    min_turnover: float = 0.0
    min_price: float = 0.0
    max_volatility: float = 0.0
    per_industry_min: int = 6
    per_industry_max: int = 10
    global_top: int = 30
    max_per_industry: int = 0
    suspect_drop: float = -0.15


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= CALENDAR_ROWS else df


def calendar(bars: DataFrame) -> tuple[DataFrame, int]:
    """Trading dates with their ordinal ``k`` (one row per date), and how many there are."""
    dates = bars.select("datetime").distinct()
    rows = dates.count()
    return dates.withColumn("k", F.row_number().over(Window.orderBy("datetime")) - 1), rows


def rebalance_dates(bars: DataFrame, config: ScreeningConfig) -> DataFrame:
    """Last trading date per period inside the configured range; the last period is dropped."""
    ends = period_ends(bars, config.rebalance).select("datetime")
    return query_by_time(ends, config.start, config.end).withColumnRenamed("datetime", "rebalance_date")


def window_dates(bars: DataFrame, rebalances: DataFrame, window: int) -> tuple[DataFrame, int]:
    """(rebalance_date, datetime, pos): the last window+1 trading dates of every rebalance date.

    Rebalance dates with a shorter history have no rows.
    """
    days, rows = calendar(bars)
    ends = rebalances.join(_small(days, rows), F.col("rebalance_date") == F.col("datetime")).select(
        "rebalance_date", F.col("k").alias("end_k")).where(F.col("end_k") >= window)
    spread = ends.select("rebalance_date", F.posexplode(
        F.sequence(F.col("end_k") - window, F.col("end_k"))).alias("pos", "k"))
    return spread.join(_small(days, rows), "k").select("rebalance_date", "datetime", "pos"), rows * (window + 1)


def window_returns(bars: DataFrame, rebalances: DataFrame, window: int) -> DataFrame:
    """Daily and running returns inside every window, for symbols trading on both end dates."""
    dates, rows = window_dates(bars, rebalances, window)
    inside = bars.select("vt_symbol", "datetime", "close").join(_small(dates, rows), "datetime")
    own = Window.partitionBy("vt_symbol", "rebalance_date")
    order = own.orderBy("pos")
    return (
        inside.withColumns({
            "_first": F.min("pos").over(own), "_last": F.max("pos").over(own),
            "daily_return": F.try_divide(F.col("close"), F.lag("close").over(order)) - 1,
            "running_return": F.try_divide(F.col("close"), F.first("close").over(order)) - 1})
        .where((F.col("_first") == 0) & (F.col("_last") == window))
        .select("rebalance_date", "vt_symbol", "datetime", "pos", "daily_return", "running_return")
    )


def industry_momentum(returns: DataFrame, industries: DataFrame) -> DataFrame:
    """Compounded equal-weight return per rebalance date and industry."""
    daily = returns.where(F.col("daily_return").isNotNull()).join(industries, "vt_symbol").groupBy(
        "rebalance_date", "industry", "datetime").agg(F.avg("daily_return").alias("r"))
    return daily.groupBy("rebalance_date", "industry").agg((F.product(F.col("r") + 1) - 1).alias("momentum"))


def market_momentum(returns: DataFrame) -> DataFrame:
    """Compounded equal-weight return of all symbols per rebalance date."""
    daily = returns.where(F.col("daily_return").isNotNull()).groupBy("rebalance_date", "datetime").agg(
        F.avg("daily_return").alias("r"))
    return daily.groupBy("rebalance_date").agg((F.product(F.col("r") + 1) - 1).alias("momentum"))


def whole_window_return(returns: DataFrame, window: int, name: str) -> DataFrame:
    return returns.where(F.col("pos") == window).select(
        "rebalance_date", "vt_symbol", F.col("running_return").alias(name))


def industry_breadth(returns: DataFrame, industries: DataFrame, window: int) -> DataFrame:
    """Share of members that rose over the window, and the member count."""
    return whole_window_return(returns, window, "cum").join(industries, "vt_symbol").groupBy(
        "rebalance_date", "industry").agg(
        F.avg((F.col("cum") > 0).cast("double")).alias("breadth"),
        F.count(F.lit(1)).cast("int").alias("member_count"))


def industry_snapshot(bars: DataFrame, industries: DataFrame, rebalances: DataFrame,
                      config: ScreeningConfig) -> DataFrame:
    """Ranks in two windows, gates, the chosen industries and their streak, for all periods."""
    longest = max(config.momentum_window, config.confirm_window, config.breadth_window)
    days, rows = calendar(bars)
    usable = rebalances.join(
        _small(days, rows), F.col("rebalance_date") == F.col("datetime")).where(F.col("k") >= longest).select("rebalance_date")
    keys = ["rebalance_date", "industry"]
    main = window_returns(bars, usable, config.momentum_window)
    confirm = window_returns(bars, usable, config.confirm_window)
    wide = main if config.breadth_window == config.momentum_window else window_returns(
        bars, usable, config.breadth_window)
    snap = (
        industry_momentum(main, industries).withColumnRenamed("momentum", "mom_main")
        .join(industry_momentum(confirm, industries).withColumnRenamed("momentum", "mom_confirm"), keys, "full")
        .join(industry_breadth(wide, industries, config.breadth_window), keys, "left")
    )
    eligible = F.coalesce(F.col("member_count"), F.lit(0)) >= config.min_members
    snap = snap.withColumn("_ok", eligible)

    def rank(x: str) -> Column:
        order = Window.partitionBy("rebalance_date", "_ok").orderBy(F.col(x).desc_nulls_last(), "industry")
        return F.when(F.col("_ok") & F.col(x).isNotNull(), F.row_number().over(order))

    snap = snap.withColumns({"rank_main": rank("mom_main"), "rank_confirm": rank("mom_confirm")})
    passes = (F.col("rank_main") <= config.rank_gate) & (F.col("rank_confirm") <= config.rank_gate)
    snap = snap.withColumn("reject_reason", first_reason([
        ("member_count", ~F.col("_ok")), ("rank_gate", ~F.coalesce(passes, F.lit(False))),
        ("breadth", ~F.coalesce(F.col("breadth") >= config.breadth_min, F.lit(False)))]))
    snap = snap.withColumn("_open", F.col("reject_reason").isNull())
    place = F.row_number().over(Window.partitionBy("rebalance_date", "_open").orderBy(
        F.col("mom_main").desc_nulls_last(), "industry"))
    snap = snap.withColumn("selected", F.col("_open") & (place <= config.top_industries))
    snap = snap.withColumn("reject_reason", F.when(
        F.col("_open") & ~F.col("selected"), "rank_gate").otherwise(F.col("reject_reason")))
    return freshness(snap.drop("_ok", "_open"), usable, config)


def freshness(snap: DataFrame, periods: DataFrame, config: ScreeningConfig) -> DataFrame:
    """Consecutive periods as a chosen industry; beyond the cap the industry is dropped as stale.

    The count ignores the dropping itself, so runs of consecutive periods are enough.
    """
    numbered = periods.select("rebalance_date").distinct().withColumn(
        "_p", F.row_number().over(Window.orderBy("rebalance_date")))
    order = Window.partitionBy("industry", "selected").orderBy("rebalance_date")
    snap = snap.join(F.broadcast(numbered), "rebalance_date")
    snap = snap.withColumn("_run", F.col("_p") - F.row_number().over(order))
    inside = Window.partitionBy("industry", "selected", "_run").orderBy("rebalance_date")
    snap = snap.withColumn("industry_streak", F.when(F.col("selected"), F.row_number().over(inside)))
    if config.max_streak > 0:
        stale = F.coalesce(F.col("industry_streak") > config.max_streak, F.lit(False))
        snap = snap.withColumns({"selected": F.col("selected") & ~stale,
                                 "reject_reason": F.when(stale, "stale").otherwise(F.col("reject_reason"))})
    return snap.drop("_p", "_run")


def price_features(bars: DataFrame, rebalances: DataFrame, config: ScreeningConfig) -> DataFrame:
    """Features of every symbol's latest bar at or before each rebalance date."""
    c, t = field("close"), field("turnover")
    ret = A.pct_change(c, 1)
    short, mid, long = config.ma_windows
    daily = evaluate(bars, {
        "listed_bars": A.ordinal(), "ma_short": A.ts_mean(c, short), "ma_mid": A.ts_mean(c, mid),
        "ma_long": A.ts_mean(c, long), "ma_short_lag": A.ts_mean(A.ts_delay(c, config.slope_lag), short),
        "high_max": A.ts_max(field("high"), config.high_window),
        "turnover_short": A.ts_mean(t, config.volume_short), "turnover_long": A.ts_mean(t, config.volume_long),
        "volatility": A.ts_std_samp(ret, config.volatility_window),
        "illiq": A.ts_mean(abs(ret) / A.where(t > 0.0, t, None), config.illiquidity_window),
    }, keep=["close"])
    # the first rebalance date that sees a bar; bars after the last one are not seen
    ends = rebalances.select("rebalance_date").distinct()
    numbered = ends.withColumn("_p", F.row_number().over(Window.orderBy("rebalance_date")))
    days, rows = calendar(bars)
    marks = days.select("datetime").join(
        _small(numbered, rows), F.col("datetime") == F.col("rebalance_date"), "left")
    ahead = Window.orderBy("datetime").rowsBetween(0, Window.unboundedFollowing)
    seen = marks.select("datetime", F.first("_p", ignorenulls=True).over(ahead).alias("_p")).where("_p IS NOT NULL")
    names = [n for n in daily.columns if n not in ("vt_symbol", "datetime")]
    latest = daily.join(_small(seen, rows), "datetime").groupBy("vt_symbol", "_p").agg(
        F.max_by(F.struct(*names), "datetime").alias("row"))
    last = numbered.agg(F.max("_p").alias("_end"))
    until = F.coalesce(F.lead("_p").over(Window.partitionBy("vt_symbol").orderBy("_p")) - 1, F.col("_end"))
    held = latest.crossJoin(F.broadcast(last)).withColumn("_to", until).select(
        "vt_symbol", "row.*", F.explode(F.sequence("_p", "_to")).alias("_p"))
    return held.join(_small(numbered, rows), "_p").drop("_p")


def apply_filters(features: DataFrame, universe: DataFrame, config: ScreeningConfig) -> DataFrame:
    """Filter flags and the first failing rule; a missing value fails its filter."""
    def hold(rule: Column) -> Column:
        return F.coalesce(rule, F.lit(False))

    tradable = universe.select(F.col("datetime").alias("rebalance_date"), "vt_symbol",
                               F.col("in_execution").alias("filter_tradable"))
    df = features.join(tradable, ["rebalance_date", "vt_symbol"], "left")
    c = F.col
    always = F.lit(True)
    trend = config.trend_filters
    df = df.withColumn("near_high", F.try_divide("close", "high_max")).withColumns({
        "filter_tradable": hold(c("filter_tradable")),
        "filter_history": c("listed_bars") >= config.min_bars,
        "filter_ma": hold((c("ma_short") > c("ma_mid")) & (c("ma_mid") > c("ma_long"))
                          & (c("ma_short") > c("ma_short_lag"))) if trend else always,
        "filter_bias": hold(F.try_divide("close", "ma_short") - 1 <= config.bias_max) if trend else always,
        "filter_high": hold(c("near_high") >= config.near_high_min) if trend else always,
        "filter_liquidity": hold(c("turnover_short") >= config.min_turnover) if config.min_turnover > 0 else always,
        "filter_price": hold(c("close") >= config.min_price) if config.min_price > 0 else always,
        "filter_volatility": hold(c("volatility") <= config.max_volatility) if config.max_volatility > 0 else always,
    })
    return df.withColumn("reject_reason", first_reason([
        ("insufficient_history", ~c("filter_history")), ("not_tradable", ~c("filter_tradable")),
        ("ma_align", ~c("filter_ma")), ("bias", ~c("filter_bias")), ("nh_min", ~c("filter_high")),
        ("low_turnover", ~c("filter_liquidity")), ("low_price", ~c("filter_price")),
        ("high_volatility", ~c("filter_volatility"))]))


def scoring_factors(filtered: DataFrame, bars: DataFrame, rebalances: DataFrame, reference: DataFrame,
                    on: list[str], config: ScreeningConfig) -> DataFrame:
    """Strength against the reference momentum, capped turnover ratio; rejected rows are blanked."""
    keys = ["rebalance_date", "vt_symbol"]
    main, confirm = config.momentum_window, config.confirm_window
    df = (
        filtered
        .join(whole_window_return(window_returns(bars, rebalances, main), main, "cum_main"), keys, "left")
        .join(whole_window_return(window_returns(bars, rebalances, confirm), confirm, "cum_confirm"), keys, "left")
        .join(reference.withColumnRenamed("momentum", "_mom"), on, "left")
        .withColumns({
            "strength": F.col("cum_main") - F.col("_mom"),
            "vol_ratio": F.least(F.try_divide("turnover_short", "turnover_long"), F.lit(config.volume_cap))})
    )
    df = df.withColumn("vol_ratio", F.when(
        F.col("turnover_short").isNotNull() & F.col("turnover_long").isNotNull(), F.col("vol_ratio")))
    needed = ["strength", "near_high", "vol_ratio", "cum_confirm"]
    needed += ["volatility"] if config.volatility_weight else []
    needed += ["illiq"] if config.illiquidity_weight else []
    missing = F.greatest(*(F.col(n).isNull() for n in needed))
    df = df.withColumn("reject_reason", F.when(
        F.col("reject_reason").isNull() & missing, "missing_factor").otherwise(F.col("reject_reason")))
    kept = F.col("reject_reason").isNull()
    blank = ["strength", "near_high", "vol_ratio", "volatility", "illiq", "cum_confirm"]
    return df.withColumns({n: F.when(kept, F.col(n)) for n in blank}).drop("_mom", "cum_main")


def rank_and_score(factors: DataFrame, config: ScreeningConfig) -> DataFrame:
    """Percentile ranks among surviving rows of a date; volume ranks only among rising names."""
    df = factors.withColumns({
        "_in": F.col("reject_reason").isNull(),
        "_up": F.coalesce(F.col("cum_confirm") > 0, F.lit(False))})
    by, rising = ["rebalance_date", "_in"], ["rebalance_date", "_in", "_up"]
    inside = F.col("_in")

    def ranked(x: str) -> Column:
        return F.when(inside, _pct_rank(x, by))

    df = df.withColumns({
        "rank_rs": ranked("strength"), "rank_nh": ranked("near_high"),
        "rank_vol": F.when(inside, F.when(F.col("_up"), _pct_rank("vol_ratio", rising)).otherwise(0.5)),
        "rank_vola": ranked("volatility") if config.volatility_weight else F.lit(None).cast("double"),
        "rank_illiq": ranked("illiq") if config.illiquidity_weight else F.lit(None).cast("double")})
    score = sum(w * F.col(c) for w, c in zip(config.weights, ("rank_rs", "rank_nh", "rank_vol")))
    if config.volatility_weight:
        score = score + config.volatility_weight * F.col("rank_vola")
    if config.illiquidity_weight:
        score = score + config.illiquidity_weight * F.col("rank_illiq")
    return df.withColumn("score", score).drop("_in", "_up")


def _order(by: list[str]) -> Window:
    return Window.partitionBy(*by).orderBy(F.col("score").desc_nulls_last(), "vt_symbol")


def select_per_industry(scored: DataFrame, config: ScreeningConfig) -> DataFrame:
    kept = F.col("reject_reason").isNull()
    df = scored.withColumn("_in", kept)
    rank = F.when(kept, F.row_number().over(_order(["rebalance_date", "industry", "_in"])))
    df = df.withColumn("industry_rank", rank).drop("_in")
    return df.withColumn("selected", F.coalesce(F.col("industry_rank") <= config.per_industry_max, F.lit(False)))


def select_global(scored: DataFrame, config: ScreeningConfig) -> DataFrame:
    """Best names of the whole pool, at most ``max_per_industry`` of one industry if that is set."""
    kept = F.col("reject_reason").isNull()
    df = scored.withColumn("_in", kept)
    df = df.withColumn("industry_rank", F.when(kept, F.row_number().over(_order(["rebalance_date", "_in"]))))
    chosen = F.col("industry_rank")
    if config.max_per_industry > 0:
        own = F.row_number().over(_order(["rebalance_date", "industry", "_in"]))
        df = df.withColumn("_able", kept & (own <= config.max_per_industry))
        df = df.withColumn("_place", F.when(
            F.col("_able"), F.row_number().over(_order(["rebalance_date", "_able"]))))
        chosen = F.col("_place")
    df = df.withColumn("selected", F.coalesce(chosen <= config.global_top, F.lit(False)))
    return df.drop("_in", "_able", "_place")


def stock_snapshot(bars: DataFrame, industries: DataFrame, universe: DataFrame, rebalances: DataFrame,
                   config: ScreeningConfig, snapshot: DataFrame | None = None) -> DataFrame:
    """Scored stocks of all periods; with ``snapshot`` given, only inside its chosen industries."""
    features = price_features(bars, rebalances, config)
    if snapshot is not None:
        chosen = snapshot.where("selected").select("rebalance_date", "industry", F.col("mom_main").alias("momentum"))
        features = features.join(industries, "vt_symbol").join(
            chosen.select("rebalance_date", "industry"), ["rebalance_date", "industry"], "left_semi")
        reference, on = chosen, ["rebalance_date", "industry"]
    else:
        features = features.join(industries, "vt_symbol", "left").fillna("unknown", ["industry"])
        reference = market_momentum(window_returns(bars, rebalances, config.momentum_window))
        features = features.join(reference.select("rebalance_date"), "rebalance_date", "left_semi")
        on = ["rebalance_date"]
    filtered = apply_filters(features, universe, config)
    scored = rank_and_score(scoring_factors(filtered, bars, rebalances, reference, on, config), config)
    return select_per_industry(scored, config) if snapshot is not None else select_global(scored, config)


def run_screening(bars: DataFrame, industries: DataFrame, universe: DataFrame,
                  config: ScreeningConfig) -> dict[str, DataFrame]:
    """All outputs of a run: industry_signals, stock_signals, selection, events.

    Modes: ``none`` screens the whole market, ``select`` inside the chosen industries,
    ``regime`` the whole market but only in periods with a chosen industry.
    """
    dates = rebalance_dates(bars, config)
    out: dict[str, DataFrame] = {}
    if config.mode == "none":
        stocks = stock_snapshot(bars, industries, universe, dates, config)
        streaks = None
    else:
        # small (periods x industries) and read by every later step
        snap = materialise(industry_snapshot(bars, industries, dates, config), "industry-signals")
        active = snap.where("selected").select("rebalance_date").distinct()
        stocks = stock_snapshot(bars, industries, universe, active, config,
                                snap if config.mode == "select" else None)
        out["industry_signals"] = snap
        streaks = snap.select("rebalance_date", "industry", "industry_streak")
    stocks = materialise(stocks, "stock-signals")
    picked = stocks.where("selected").select("rebalance_date", "vt_symbol", "industry", "score", "industry_rank")
    picked = picked.withColumn("industry_streak", F.lit(None).cast("int")) if streaks is None else picked.join(
        streaks, ["rebalance_date", "industry"], "left")
    out.update(stock_signals=stocks, selection=picked)
    out["events"] = quality_events(bars, dates, out, config)
    return out


def quality_events(bars: DataFrame, dates: DataFrame, out: dict[str, DataFrame],
                   config: ScreeningConfig) -> DataFrame:
    """Periods skipped for short history, without a chosen industry, or with too few names."""
    def event(df: DataFrame, kind: str, industry: Column, value: Column) -> DataFrame:
        return df.select(F.lit(kind).alias("type"), F.col("rebalance_date"),
                         industry.cast("string").alias("industry"), value.cast("long").alias("value"))

    nothing = F.lit(None)
    days, rows = calendar(bars)
    need = max(config.momentum_window, config.confirm_window, config.breadth_window) \
        if config.mode != "none" else config.momentum_window
    placed = dates.join(_small(days, rows), F.col("rebalance_date") == F.col("datetime"))
    events = event(placed.where(F.col("k") < need), "insufficient_history", nothing, F.col("k") + 1)
    snap = out.get("industry_signals")
    if snap is not None:
        chosen = snap.groupBy("rebalance_date").agg(F.count_if("selected").alias("n"))
        events = events.unionByName(event(chosen.where("n = 0"), "no_industry", nothing, F.col("n")))
        stale = snap.where("reject_reason = 'stale'")
        events = events.unionByName(event(stale, "stale_industry", F.col("industry"), F.col("industry_streak")))
    if config.mode == "select":
        few = out["stock_signals"].where("selected").groupBy("rebalance_date", "industry").agg(
            F.count(F.lit(1)).alias("n")).where(F.col("n") < config.per_industry_min)
        events = events.unionByName(event(few, "below_minimum", F.col("industry"), F.col("n")))
    return events


def industry_map(sectors: DataFrame, prefix: str) -> tuple[DataFrame, DataFrame]:
    """One industry per symbol (first by name) and the symbols that had several."""
    found = sectors.where(F.col("sector").startswith(prefix)).groupBy("vt_symbol").agg(
        F.min("sector").alias("industry"), F.count_distinct("sector").alias("n"))
    return found.select("vt_symbol", "industry"), found.where("n > 1")


def suspect_drops(bars: DataFrame, threshold: float = -0.15) -> DataFrame:
    """All day returns below the threshold."""
    daily = evaluate(bars, {"ret": A.pct_change(field("close"), 1)}, keep=["close"])
    return daily.where(F.col("ret") < threshold)


def leaders_pool(*members: DataFrame) -> DataFrame:
    """Distinct symbols of several member tables."""
    out = members[0].select("vt_symbol")
    for m in members[1:]:
        out = out.union(m.select("vt_symbol"))
    return out.distinct()

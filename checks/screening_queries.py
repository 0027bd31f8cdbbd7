"""Queries for the screening pipeline, universe tables and data quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.operators import quality as Q
from barloom.operators import universe as V
from barloom.plans import screening as R
from barloom.session import materialise
from checks.panels import (MEMBERS_SQL, UNIVERSE_SQL, bars, bars_sql, dealt, members, present, present_sql, spread, table,
                           universe)
from checks.registry import add
from checks.study_queries import ENDS_SQL, _pct

CFG = R.ScreeningConfig(
    mode="select", rebalance="monthly", start="1996-01-01", momentum_window=4, confirm_window=2, breadth_window=4,
    breadth_min=0.4, rank_gate=3, top_industries=2, min_members=4, max_streak=2, trend_filters=True,
    ma_windows=(3, 6, 9), slope_lag=2, bias_max=0.9, min_bars=20, high_window=26, near_high_min=0.2, volume_short=4,
    volume_long=8, volatility_window=6, volatility_weight=0.1, illiquidity_window=5, illiquidity_weight=-0.1,
    min_turnover=1000.0, min_price=500.0, max_volatility=50.0, per_industry_max=3, global_top=8, max_per_industry=2)
FREE = R.ScreeningConfig(**{**CFG.__dict__, "mode": "none"})
REGIME = R.ScreeningConfig(**{**CFG.__dict__, "mode": "regime", "breadth_window": 3, "max_per_industry": 0})


def inputs(spark, sf):
    # a run reads the bars many times: they are stored once, as they would be in a lake
    b = materialise(bars(spark, sf, "week"), "bars")
    return b, members(spark, sf), universe(b)


def window_sql(name, w):
    return f"""{name} AS MATERIALIZED (SELECT * FROM (SELECT rebalance_date, vt_symbol, b.datetime, c.k - e.k + {w} AS pos,
  close / lag(close) OVER o - 1 AS daily_return, close / first_value(close) OVER o - 1 AS running_return,
  min(c.k - e.k + {w}) OVER p AS lo, max(c.k - e.k + {w}) OVER p AS hi
  FROM reb r JOIN cal e ON e.datetime = r.rebalance_date JOIN cal c ON c.k BETWEEN e.k - {w} AND e.k
  JOIN bars b ON b.datetime = c.datetime WHERE e.k >= {w} AND (SELECT bool_and(true)) IS NOT NULL
  WINDOW o AS (PARTITION BY rebalance_date, vt_symbol ORDER BY b.datetime), p AS (PARTITION BY rebalance_date, vt_symbol))
  WHERE lo = 0 AND hi = {w})""".replace(" AND (SELECT bool_and(true)) IS NOT NULL", "")


def mom_sql(name, src):
    return f"""{name} AS (SELECT rebalance_date, industry, product(r + 1) - 1 AS mom FROM (SELECT rebalance_date, industry, datetime,
  avg(daily_return) AS r FROM {src} JOIN members USING (vt_symbol) WHERE daily_return IS NOT NULL GROUP BY ALL) GROUP BY ALL)"""


def base_sql(cfg):
    longest = max(cfg.momentum_window, cfg.confirm_window, cfg.breadth_window)
    return f"""WITH {bars_sql('week')}, {MEMBERS_SQL}, {UNIVERSE_SQL}, {ENDS_SQL},
  cal AS MATERIALIZED (SELECT datetime, row_number() OVER (ORDER BY datetime) - 1 AS k FROM (SELECT DISTINCT datetime FROM bars)),
  reb0 AS (SELECT datetime AS rebalance_date FROM ends WHERE datetime >= DATE '1996-01-01'),
  reb AS (SELECT rebalance_date FROM reb0 JOIN cal ON rebalance_date = datetime WHERE k >= {longest}),
  {window_sql('wm', cfg.momentum_window)}, {window_sql('wc', cfg.confirm_window)}, {window_sql('wb', cfg.breadth_window)}"""


def snap_sql(cfg):
    g, top = cfg.rank_gate, cfg.top_industries
    return f"""{base_sql(cfg)}, {mom_sql('mm', 'wm')}, {mom_sql('mc', 'wc')},
  br AS (SELECT rebalance_date, industry, avg((running_return > 0)::INT) AS breadth, count(*) AS member_count FROM wb
  JOIN members USING (vt_symbol) WHERE pos = {cfg.breadth_window} GROUP BY ALL),
  s0 AS (SELECT rebalance_date, industry, mm.mom AS mom_main, mc.mom AS mom_confirm, breadth, member_count,
  coalesce(member_count, 0) >= {cfg.min_members} AS ok FROM mm FULL JOIN mc USING (rebalance_date, industry)
  LEFT JOIN br USING (rebalance_date, industry)),
  s1 AS (SELECT *, CASE WHEN ok AND mom_main IS NOT NULL THEN row_number() OVER (PARTITION BY rebalance_date, ok ORDER BY mom_main DESC NULLS LAST, industry) END AS rank_main,
  CASE WHEN ok AND mom_confirm IS NOT NULL THEN row_number() OVER (PARTITION BY rebalance_date, ok ORDER BY mom_confirm DESC NULLS LAST, industry) END AS rank_confirm FROM s0),
  s2 AS (SELECT *, CASE WHEN NOT ok THEN 'member_count' WHEN NOT coalesce(rank_main <= {g} AND rank_confirm <= {g}, false) THEN 'rank_gate'
  WHEN NOT coalesce(breadth >= {cfg.breadth_min}, false) THEN 'breadth' END AS why FROM s1),
  s3 AS (SELECT *, why IS NULL AND row_number() OVER (PARTITION BY rebalance_date, why IS NULL ORDER BY mom_main DESC NULLS LAST, industry) <= {top} AS sel FROM s2),
  pp AS (SELECT rebalance_date, row_number() OVER (ORDER BY rebalance_date) AS p FROM reb),
  s4 AS (SELECT *, p - row_number() OVER (PARTITION BY industry, sel ORDER BY rebalance_date) AS run FROM s3 JOIN pp USING (rebalance_date)),
  s5 AS (SELECT *, CASE WHEN sel THEN row_number() OVER (PARTITION BY industry, sel, run ORDER BY rebalance_date) END AS industry_streak FROM s4),
  snap AS MATERIALIZED (SELECT rebalance_date, industry, mom_main, mom_confirm, breadth, member_count, rank_main, rank_confirm,
  sel AND NOT coalesce(industry_streak > {cfg.max_streak} AND {cfg.max_streak} > 0, false) AS selected, industry_streak,
  CASE WHEN coalesce(industry_streak > {cfg.max_streak} AND {cfg.max_streak} > 0, false) THEN 'stale' WHEN why IS NULL AND NOT sel THEN 'rank_gate' ELSE why END AS reject_reason FROM s5)"""


def feature_sql(cfg, periods):
    a, b, c = cfg.ma_windows
    def w(n):
        return f"(PARTITION BY vt_symbol ORDER BY datetime ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"""d0 AS (SELECT *, close / lag(close) OVER s - 1 AS ret, lag(close, {cfg.slope_lag}) OVER s AS old, row_number() OVER s AS listed_bars
  FROM bars WINDOW s AS (PARTITION BY vt_symbol ORDER BY datetime)),
  d1 AS MATERIALIZED (SELECT vt_symbol, datetime, close, listed_bars, avg(close) OVER {w(a)} AS ma_short, avg(close) OVER {w(b)} AS ma_mid,
  avg(close) OVER {w(c)} AS ma_long, avg(old) OVER {w(a)} AS ma_short_lag, max(high) OVER {w(cfg.high_window)} AS high_max,
  avg(turnover) OVER {w(cfg.volume_short)} AS turnover_short, avg(turnover) OVER {w(cfg.volume_long)} AS turnover_long,
  stddev_samp(ret) OVER {w(cfg.volatility_window)} AS volatility,
  avg(abs(ret) / CASE WHEN turnover > 0 THEN turnover END) OVER {w(cfg.illiquidity_window)} AS illiq FROM d0),
  feat AS MATERIALIZED (SELECT {periods}.rebalance_date, d1.* EXCLUDE (datetime) FROM {periods} JOIN d1 ON d1.datetime <= {periods}.rebalance_date
  QUALIFY row_number() OVER (PARTITION BY {periods}.rebalance_date, vt_symbol ORDER BY d1.datetime DESC) = 1)"""


def stock_sql(cfg):
    select_mode = cfg.mode == "select"
    head = base_sql(cfg) if cfg.mode == "none" else snap_sql(cfg)
    if cfg.mode == "none":
        head += f""", act AS (SELECT rebalance_date FROM reb0 JOIN cal ON rebalance_date = datetime WHERE k >= {cfg.momentum_window})"""
    else:
        head += ", act AS (SELECT DISTINCT rebalance_date FROM snap WHERE selected)"
    market = """mk AS (SELECT rebalance_date, product(r + 1) - 1 AS mom FROM (SELECT rebalance_date, datetime, avg(daily_return) AS r
  FROM wm WHERE daily_return IS NOT NULL GROUP BY ALL) GROUP BY ALL)"""
    join = ("JOIN members m USING (vt_symbol) JOIN snap sn ON sn.rebalance_date = feat.rebalance_date AND sn.industry = m.industry AND sn.selected"
            if select_mode else "LEFT JOIN members m USING (vt_symbol) JOIN mk ON mk.rebalance_date = feat.rebalance_date")
    mom = "sn.mom_main" if select_mode else "mk.mom"
    score = "-0.4 * rank_rs + 0.35 * rank_nh - 0.25 * rank_vol + 0.1 * rank_vola - 0.1 * rank_illiq"
    own = "PARTITION BY rebalance_date, industry, kept ORDER BY score DESC NULLS LAST, vt_symbol"
    whole = "PARTITION BY rebalance_date, kept ORDER BY score DESC NULLS LAST, vt_symbol"
    if select_mode:
        tail = f"""z AS (SELECT *, CASE WHEN kept THEN row_number() OVER ({own}) END AS industry_rank FROM y),
  stocks AS (SELECT *, coalesce(industry_rank <= {cfg.per_industry_max}, false) AS selected FROM z)"""
    elif cfg.max_per_industry:
        tail = f"""z0 AS (SELECT *, CASE WHEN kept THEN row_number() OVER ({whole}) END AS industry_rank,
  kept AND row_number() OVER ({own}) <= {cfg.max_per_industry} AS able FROM y),
  z AS (SELECT *, CASE WHEN able THEN row_number() OVER (PARTITION BY rebalance_date, able ORDER BY score DESC NULLS LAST, vt_symbol) END AS place FROM z0),
  stocks AS (SELECT *, coalesce(place <= {cfg.global_top}, false) AS selected FROM z)"""
    else:
        tail = f"""z AS (SELECT *, CASE WHEN kept THEN row_number() OVER ({whole}) END AS industry_rank FROM y),
  stocks AS (SELECT *, coalesce(industry_rank <= {cfg.global_top}, false) AS selected FROM z)"""
    return f"""{head}, {feature_sql(cfg, 'act')}, {market},
  f1 AS (SELECT feat.*, coalesce(m.industry, 'unknown') AS industry, {mom} AS mom, coalesce(u.in_execution, false) AS tr,
  close / high_max AS near_high, cm.running_return AS cum_main, cc.running_return AS cum_confirm,
  least(turnover_short / nullif(turnover_long, 0), 3.0) AS vol_ratio
  FROM feat {join} LEFT JOIN universe u ON u.datetime = feat.rebalance_date AND u.vt_symbol = feat.vt_symbol
  LEFT JOIN wm cm ON cm.rebalance_date = feat.rebalance_date AND cm.vt_symbol = feat.vt_symbol AND cm.pos = {cfg.momentum_window}
  LEFT JOIN wc cc ON cc.rebalance_date = feat.rebalance_date AND cc.vt_symbol = feat.vt_symbol AND cc.pos = {cfg.confirm_window}),
  f2 AS (SELECT *, cum_main - mom AS strength, CASE WHEN listed_bars < {cfg.min_bars} THEN 'insufficient_history' WHEN NOT tr THEN 'not_tradable'
  WHEN NOT coalesce(ma_short > ma_mid AND ma_mid > ma_long AND ma_short > ma_short_lag, false) THEN 'ma_align'
  WHEN NOT coalesce(close / ma_short - 1 <= {cfg.bias_max}, false) THEN 'bias' WHEN NOT coalesce(near_high >= {cfg.near_high_min}, false) THEN 'nh_min'
  WHEN NOT coalesce(turnover_short >= {cfg.min_turnover}, false) THEN 'low_turnover' WHEN NOT coalesce(close >= {cfg.min_price}, false) THEN 'low_price'
  WHEN NOT coalesce(volatility <= {cfg.max_volatility}, false) THEN 'high_volatility' END AS why FROM f1),
  f3 AS (SELECT *, CASE WHEN why IS NULL AND (strength IS NULL OR near_high IS NULL OR vol_ratio IS NULL OR cum_confirm IS NULL OR volatility IS NULL OR illiq IS NULL)
  THEN 'missing_factor' ELSE why END AS reject_reason FROM f2),
  x AS (SELECT *, reject_reason IS NULL AS kept, coalesce(cum_confirm > 0, false) AS up FROM f3),
  x2 AS (SELECT rebalance_date, vt_symbol, industry, reject_reason, kept, CASE WHEN kept THEN {_pct('strength', 'rebalance_date, kept')} END AS rank_rs,
  CASE WHEN kept THEN {_pct('near_high', 'rebalance_date, kept')} END AS rank_nh,
  CASE WHEN kept THEN CASE WHEN up THEN {_pct('vol_ratio', 'rebalance_date, kept, up')} ELSE 0.5 END END AS rank_vol,
  CASE WHEN kept THEN {_pct('volatility', 'rebalance_date, kept')} END AS rank_vola,
  CASE WHEN kept THEN {_pct('illiq', 'rebalance_date, kept')} END AS rank_illiq FROM x),
  y AS (SELECT *, {score} AS score FROM x2), {tail}"""


SNAP_TEXT, SNAP_INT, SNAP_NUM = ["rebalance_date", "industry", "reject_reason"], [
    "member_count", "rank_main", "rank_confirm", "selected", "industry_streak"], ["mom_main", "mom_confirm", "breadth"]


def nullable(df, text, whole, rounded):
    """Integers that may be missing are shown as doubles on both sides."""
    return present(df, text, (), [*whole, *rounded])


add("screen_rebalance_dates", lambda spark, sf: present(R.rebalance_dates(bars(spark, sf, "week"), CFG), ["rebalance_date"]),
    f"{base_sql(CFG)} SELECT rebalance_date::VARCHAR AS rebalance_date FROM reb0")
add("screen_window_dates", lambda spark, sf: present(R.window_dates(
    bars(spark, sf, "week"), R.rebalance_dates(bars(spark, sf, "week"), CFG), 4)[0], ["rebalance_date", "datetime"], ["pos"]),
    f"{base_sql(CFG)} SELECT rebalance_date::VARCHAR AS rebalance_date, c.datetime::VARCHAR AS datetime, (c.k - e.k + 4)::BIGINT AS pos "
    "FROM reb0 JOIN cal e ON e.datetime = rebalance_date JOIN cal c ON c.k BETWEEN e.k - 4 AND e.k WHERE e.k >= 4")
add("screen_window_returns", lambda spark, sf: present(R.window_returns(
    bars(spark, sf, "week"), R.rebalance_dates(bars(spark, sf, "week"), CFG), 4),
    ["rebalance_date", "vt_symbol", "datetime"], ["pos"], ["daily_return", "running_return"]),
    f"{base_sql(CFG)} " + present_sql("wm", ["rebalance_date", "vt_symbol", "datetime"], ["pos"], ["daily_return", "running_return"]))


def returns(spark, sf):
    b, m, _ = inputs(spark, sf)
    return R.window_returns(b, R.rebalance_dates(b, CFG), 4), m


add("screen_industry_momentum", lambda spark, sf: present(R.industry_momentum(*returns(spark, sf)), ["rebalance_date", "industry"], (), ["momentum"]),
    f"{base_sql(CFG)}, {mom_sql('mm', 'wm')}, r AS (SELECT rebalance_date, industry, mom AS momentum FROM mm) "
    + present_sql("r", ["rebalance_date", "industry"], (), ["momentum"]))
add("screen_industry_breadth", lambda spark, sf: present(R.industry_breadth(*returns(spark, sf), 4), ["rebalance_date", "industry"], ["member_count"], ["breadth"]),
    f"""{base_sql(CFG)}, r AS (SELECT rebalance_date, industry, avg((running_return > 0)::INT) AS breadth, count(*) AS member_count FROM wm
  JOIN members USING (vt_symbol) WHERE pos = 4 GROUP BY ALL) """ + present_sql("r", ["rebalance_date", "industry"], ["member_count"], ["breadth"]))
add("screen_market_momentum", lambda spark, sf: present(R.market_momentum(returns(spark, sf)[0]), ["rebalance_date"], (), ["momentum"]),
    f"""{base_sql(CFG)}, r AS (SELECT rebalance_date, product(r + 1) - 1 AS momentum FROM (SELECT rebalance_date, datetime, avg(daily_return) AS r
  FROM wm WHERE daily_return IS NOT NULL GROUP BY ALL) GROUP BY ALL) """ + present_sql("r", ["rebalance_date"], (), ["momentum"]))
add("screen_industry_snapshot", lambda spark, sf: nullable(R.industry_snapshot(
    *inputs(spark, sf)[:2], R.rebalance_dates(bars(spark, sf, "week"), CFG), CFG), SNAP_TEXT, SNAP_INT, SNAP_NUM),
    snap_sql(CFG) + " " + present_sql("snap", SNAP_TEXT, (), [*SNAP_INT, *SNAP_NUM]))
add("screen_price_features", lambda spark, sf: present(R.price_features(
    bars(spark, sf, "week"), R.rebalance_dates(bars(spark, sf, "week"), CFG), CFG), ["rebalance_date", "vt_symbol"], ["listed_bars"],
    ["close", "ma_short", "ma_long", "ma_short_lag", "high_max", "turnover_short", "volatility", "illiq"]),
    f"{base_sql(CFG)}, {feature_sql(CFG, 'reb0')} " + present_sql("feat", ["rebalance_date", "vt_symbol"], ["listed_bars"],
    ["close", "ma_short", "ma_long", "ma_short_lag", "high_max", "turnover_short", "volatility", "illiq"]))
ST_TEXT, ST_NUM = ["rebalance_date", "vt_symbol", "industry", "reject_reason"], [
    "selected", "industry_rank", "rank_rs", "rank_nh", "rank_vol", "rank_vola", "rank_illiq", "score"]
for tag, cfg in (("select", CFG), ("none", FREE), ("regime", REGIME)):
    add(f"screen_stocks_{tag}", lambda spark, sf, cfg=cfg: present(
        R.run_screening(*inputs(spark, sf), cfg)["stock_signals"], ST_TEXT, (), ST_NUM),
        stock_sql(cfg) + " " + present_sql("stocks", ST_TEXT, (), ST_NUM))
SEL = ["rebalance_date", "vt_symbol", "industry"]
add("screen_selection", lambda spark, sf: present(R.run_screening(*inputs(spark, sf), CFG)["selection"], SEL, ["industry_rank", "industry_streak"], ["score"]),
    stock_sql(CFG) + ", r AS (SELECT stocks.* , snap.industry_streak FROM stocks JOIN snap USING (rebalance_date, industry) WHERE stocks.selected) "
    + present_sql("r", SEL, ["industry_rank", "industry_streak"], ["score"]))
add("screen_events", lambda spark, sf: present(R.run_screening(*inputs(spark, sf), CFG)["events"], ["type", "rebalance_date", "industry"], ["value"]),
    stock_sql(CFG) + f""", ev AS (SELECT 'insufficient_history' AS type, rebalance_date, NULL::VARCHAR AS industry, k + 1 AS value
  FROM reb0 JOIN cal ON rebalance_date = datetime WHERE k < 4 UNION ALL SELECT 'no_industry', rebalance_date, NULL, 0 FROM snap GROUP BY rebalance_date
  HAVING NOT bool_or(selected) UNION ALL SELECT 'stale_industry', rebalance_date, industry, industry_streak FROM snap WHERE reject_reason = 'stale'
  UNION ALL SELECT 'below_minimum', rebalance_date, industry, count(*) FROM stocks WHERE selected GROUP BY ALL HAVING count(*) < {CFG.per_industry_min}) """
    + present_sql("ev", ["type", "rebalance_date", "industry"], ["value"]))
add("suspect_drops", lambda spark, sf: present(R.suspect_drops(bars(spark, sf)), ["vt_symbol", "datetime"], (), ["ret"]),
    f"""WITH {bars_sql()}, r AS (SELECT vt_symbol, datetime, ret FROM (SELECT *, close / lag(close) OVER (PARTITION BY vt_symbol ORDER BY datetime) - 1 AS ret
  FROM bars) WHERE ret < -0.15) """ + present_sql("r", ["vt_symbol", "datetime"], (), ["ret"]))
SECT = ("(SELECT s_suppkey || '.SUP' AS vt_symbol, 'GICS1' || n_name AS sector FROM supplier JOIN nation ON s_nationkey = n_nationkey UNION ALL "
        "SELECT s_suppkey || '.SUP', 'GICS1' || r_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey "
        "UNION ALL SELECT s_suppkey || '.SUP', 'SW1' || n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey)")


def sectors(spark, sf):
    s = table(spark, sf, "supplier").join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(
        table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    sym = F.concat(F.col("s_suppkey").cast("string"), F.lit(".SUP")).alias("vt_symbol")
    parts = [s.select(sym, F.concat(F.lit(p), n).alias("sector")) for p, n in (("GICS1", "n_name"), ("GICS1", "r_name"), ("SW1", "n_name"))]
    return parts[0].union(parts[1]).union(parts[2])


add("industry_map", lambda spark, sf: R.industry_map(sectors(spark, sf), "GICS1")[0],
    f"SELECT vt_symbol, min(sector) AS industry FROM {SECT} WHERE sector LIKE 'GICS1%' GROUP BY 1")
add("leaders_pool", lambda spark, sf: R.leaders_pool(sectors(spark, sf).where("sector LIKE 'SW1A%'"), sectors(spark, sf).where("sector LIKE 'GICS1E%'")),
    f"SELECT vt_symbol FROM {SECT} WHERE sector LIKE 'SW1A%' UNION SELECT vt_symbol FROM {SECT} WHERE sector LIKE 'GICS1E%'")

# --- universe and point-in-time tables ---------------------------------------------------
UCFG = V.UniverseConfig(min_listed_days=20, min_price=600.0, min_turnover=20000.0, turnover_window=8)


def master(spark, sf):
    s = table(spark, sf, "supplier")
    key = F.col("s_suppkey")
    return s.select(
        F.concat(key.cast("string"), F.lit(".SUP")).alias("vt_symbol"),
        F.when(key % 9 == 0, F.concat(F.lit("*ST "), "s_name")).otherwise(F.col("s_name")).alias("name"),
        F.when(key % 2 == 0, "main").otherwise("star").alias("board"), F.lit("SUP").alias("exchange"),
        F.when(key % 5 == 0, "0").when(key % 5 == 1, F.concat(F.lit("1996"), F.lpad((key % 12 + 1).cast("string"), 2, "0"), F.lit("15")))
        .otherwise("19950101").alias("list_date"),
        F.when(key % 7 == 0, "20000315").otherwise("99990101").alias("delist_date"),
        (F.col("s_acctbal") + 1000.0).alias("limit_up"), (F.col("s_acctbal") / 2).alias("limit_down"))


MASTER_SQL = """master AS MATERIALIZED (SELECT s_suppkey || '.SUP' AS vt_symbol, CASE WHEN s_suppkey % 9 = 0 THEN '*ST ' || s_name ELSE s_name END AS name,
  CASE WHEN s_suppkey % 2 = 0 THEN 'main' ELSE 'star' END AS board, CASE WHEN s_suppkey % 5 = 0 THEN NULL WHEN s_suppkey % 5 = 1
  THEN make_date(1996, (s_suppkey % 12 + 1)::INT, 15) ELSE DATE '1995-01-01' END AS ld,
  CASE WHEN s_suppkey % 7 = 0 THEN DATE '2000-03-15' END AS dd, s_acctbal + 1000.0 AS limit_up, s_acctbal / 2 AS limit_down FROM supplier)"""
UNI_SQL = """m2 AS (SELECT master.*, coalesce(ld, f) AS el FROM master LEFT JOIN (SELECT vt_symbol, min(datetime) AS f FROM bars GROUP BY 1) USING (vt_symbol)),
  uni AS MATERIALIZED (SELECT c.datetime, m2.* FROM (SELECT DISTINCT datetime FROM bars) c JOIN m2 ON el <= c.datetime AND (dd IS NULL OR c.datetime <= dd))"""


def uni(spark, sf):
    b = bars(spark, sf, "week")
    return V.daily_universe(master(spark, sf), b.select(F.col("datetime").alias("trade_date")), b)


K2 = ["datetime", "vt_symbol"]
add("universe_daily", lambda spark, sf: present(uni(spark, sf), [*K2, "name", "board", "effective_list_date", "effective_delist_date"]),
    f"WITH {bars_sql('week')}, {MASTER_SQL}, {UNI_SQL}, r AS (SELECT *, el AS effective_list_date, dd AS effective_delist_date FROM uni) "
    + present_sql("r", [*K2, "name", "board", "effective_list_date", "effective_delist_date"]))
STAT_SQL = f"""WITH {bars_sql('week')}, {MASTER_SQL}, {UNI_SQL}, mb AS (SELECT *, row_number() OVER (PARTITION BY vt_symbol ORDER BY datetime) AS n,
  avg(turnover) OVER (PARTITION BY vt_symbol ORDER BY datetime ROWS 7 PRECEDING) AS avt FROM bars),
  st AS MATERIALIZED (SELECT uni.datetime, uni.vt_symbol, name, coalesce(n, 0) AS listed_days, turnover, close, name LIKE '%ST%' AS is_st,
  close IS NULL OR volume <= 0 AS is_suspended, CASE WHEN name LIKE '%ST%' THEN 'st' WHEN close IS NULL OR volume <= 0 THEN 'suspended_or_missing_bar'
  WHEN coalesce(n, 0) < 20 THEN 'listed_days' WHEN NOT coalesce(close >= 600, false) THEN 'low_price'
  WHEN NOT coalesce(avt >= 20000, false) THEN 'low_turnover' ELSE 'ok' END AS status_reason FROM uni LEFT JOIN mb USING (datetime, vt_symbol))"""


def status(spark, sf):
    return V.daily_status(uni(spark, sf), bars(spark, sf, "week"), UCFG)


add("universe_status", lambda spark, sf: present(status(spark, sf), [*K2, "status_reason"], ["listed_days", "is_st", "is_suspended"]),
    STAT_SQL + " " + present_sql("st", [*K2, "status_reason"], ["listed_days", "is_st", "is_suspended"]))
for layer, flag, sql in (("research", "in_research", "true"), ("tradable", "in_tradable", "status_reason = 'ok'"),
                         ("execution", "in_execution", "status_reason = 'ok' AND turnover > 0")):
    reason = f"{layer}_reason"
    add(f"universe_{layer}", lambda spark, sf, a=layer, b=flag: present(V.universe_layers(status(spark, sf), UCFG)[a], [*K2, f"{a}_reason"], [b]),
        f"{STAT_SQL}, r AS (SELECT datetime, vt_symbol, {sql} AS {flag}, {'status_reason' if layer != 'research' else chr(39) + 'ok' + chr(39)} AS {reason} FROM st) "
        + present_sql("r", [*K2, reason], [flag]))
FILT = ("CASE WHEN n < 20 THEN 'listed_days' WHEN close < 600 THEN 'low_price' WHEN avt < 20000 THEN 'low_turnover' ELSE 'ok' END")
add("universe_basic_filters", lambda spark, sf: present(V.basic_filters(bars(spark, sf, "week"), UCFG), [*K2, "reason"], ["tradable", "listed_days"]),
    f"{STAT_SQL}, r AS (SELECT *, {FILT} AS reason, {FILT} = 'ok' AS tradable, n AS listed_days FROM mb) " + present_sql("r", [*K2, "reason"], ["tradable", "listed_days"]))
add("universe_tradable_symbols", lambda spark, sf: V.tradable_symbols(V.basic_filters(bars(spark, sf, "week"), UCFG), "1999-06-07"),
    f"{STAT_SQL} SELECT vt_symbol FROM mb WHERE datetime = DATE '1999-06-07' AND {FILT} = 'ok'")
add("universe_tradable_calendar", lambda spark, sf: present(V.tradable_calendar(bars(spark, sf, "week"), master(spark, sf).drop("exchange"), UCFG),
    [*K2, "name", "board", "reason"], ["is_st", "is_limit_up", "is_limit_down", "tradable"], ["avg_turnover_20"]),
    f"""{STAT_SQL}, r0 AS (SELECT mb.*, name, board, name LIKE '%ST%' AS is_st, close >= limit_up AS is_limit_up, close <= limit_down AS is_limit_down,
  avt AS avg_turnover_20, CASE WHEN name LIKE '%ST%' THEN 'st' ELSE {FILT} END AS reason FROM mb JOIN master USING (vt_symbol)), r AS (SELECT *, reason = 'ok' AS tradable FROM r0) """
    + present_sql("r", [*K2, "name", "board", "reason"], ["is_st", "is_limit_up", "is_limit_down", "tradable"], ["avg_turnover_20"]))
add("universe_sample", lambda spark, sf: present(V.sample_universe(bars(spark, sf, "week"), master(spark, sf).where("board = 'main'")), K2, ["in_universe"]),
    f"WITH {bars_sql('week')}, r AS (SELECT datetime, vt_symbol, split_part(vt_symbol, '.', 1)::INT % 2 = 0 AS in_universe FROM bars) " + present_sql("r", K2, ["in_universe"]))
add("universe_summary", lambda spark, sf: V.universe_summary(status(spark, sf)),
    STAT_SQL + """ SELECT 'rows' AS name, count(*)::BIGINT AS value FROM st UNION ALL SELECT 'symbols', count(DISTINCT vt_symbol) FROM st
  UNION ALL SELECT 'dates', count(DISTINCT datetime) FROM st UNION ALL SELECT 'tradable', count(*) FROM st WHERE status_reason = 'ok'
  UNION ALL SELECT 'reason:' || status_reason, count(*) FROM st GROUP BY 1""")


def adjusted(spark, sf, b=None):
    """Adjusted bars: a factor that steps up once a year for every third symbol."""
    b = bars(spark, sf, "week") if b is None else b
    key = F.split_part("vt_symbol", F.lit("."), F.lit(1)).cast("int")
    step = F.when(key % 3 == 0, 1.0 + 0.25 * (F.year("datetime") - 1995)).otherwise(1.0)
    return b.where("volume <> 7").withColumns({n: F.col(n) * step for n in ("open", "high", "low", "close")})


ADJ_SQL = """adj AS MATERIALIZED (SELECT datetime, vt_symbol, open * s AS open, high * s AS high, low * s AS low, close * s AS close, volume, turnover FROM
  (SELECT *, CASE WHEN split_part(vt_symbol, '.', 1)::INT % 3 = 0 THEN 1.0::DOUBLE + 0.25::DOUBLE * (year(datetime) - 1995) ELSE 1.0::DOUBLE END AS s
  FROM bars WHERE volume <> 7))"""
FAC_SQL = f"WITH {bars_sql('week')}, {ADJ_SQL}, fac AS (SELECT bars.datetime, bars.vt_symbol, bars.close AS raw_close, adj.close AS adjusted_close, adj.close / bars.close AS adjust_factor FROM bars JOIN adj USING (datetime, vt_symbol) WHERE bars.close <> 0)"
add("pit_adjust_factors", lambda spark, sf: present(V.adjust_factors(bars(spark, sf, "week"), adjusted(spark, sf)), K2, (), ["raw_close", "adjusted_close", "adjust_factor"]),
    FAC_SQL + " " + present_sql("fac", K2, (), ["raw_close", "adjusted_close", "adjust_factor"]))
add("pit_corporate_actions", lambda spark, sf: present(V.corporate_actions(V.adjust_factors(bars(spark, sf, "week"), adjusted(spark, sf)), 0.02), K2, (), ["previous_factor", "factor_change"]),
    FAC_SQL + """, r AS (SELECT * FROM (SELECT *, lag(adjust_factor) OVER (PARTITION BY vt_symbol ORDER BY datetime) AS previous_factor,
  adjust_factor / lag(adjust_factor) OVER (PARTITION BY vt_symbol ORDER BY datetime) - 1 AS factor_change FROM fac) WHERE abs(factor_change) >= 0.02) """
    + present_sql("r", K2, (), ["previous_factor", "factor_change"]))
add("pit_limit_status", lambda spark, sf: present(V.limit_status(bars(spark, sf, "week"), master(spark, sf)), K2, ["is_limit_up", "is_limit_down"]),
    f"WITH {bars_sql('week')}, {MASTER_SQL}, r AS (SELECT datetime, vt_symbol, close >= limit_up AS is_limit_up, close <= limit_down AS is_limit_down FROM bars JOIN master USING (vt_symbol)) "
    + present_sql("r", K2, ["is_limit_up", "is_limit_down"]))
add("pit_suspension", lambda spark, sf: present(V.suspension_daily(bars(spark, sf, "week").withColumn("volume", F.when(F.col("volume") > 3, F.col("volume") - 5))), [*K2, "reason"], ["is_suspended"]),
    f"""WITH {bars_sql('week')}, r AS (SELECT datetime, vt_symbol, coalesce(v <= 0, true) AS is_suspended, CASE WHEN coalesce(v <= 0, true) THEN 'zero_volume_or_turnover' END AS reason
  FROM (SELECT *, CASE WHEN volume > 3 THEN volume - 5 END AS v FROM bars)) """ + present_sql("r", [*K2, "reason"], ["is_suspended"]))
add("pit_suspension_from_status", lambda spark, sf: present(V.suspension_daily(bars(spark, sf, "week"), status(spark, sf)), [*K2, "reason"], ["is_suspended"]),
    STAT_SQL + ", r AS (SELECT *, status_reason AS reason FROM st) " + present_sql("r", [*K2, "reason"], ["is_suspended"]))
add("pit_st_daily", lambda spark, sf: present(V.st_daily(bars(spark, sf, "week"), master(spark, sf)), [*K2, "name_snapshot"], ["is_st"]),
    f"WITH {bars_sql('week')}, {MASTER_SQL}, r AS (SELECT datetime, vt_symbol, name AS name_snapshot, name LIKE '%ST%' AS is_st FROM bars JOIN master USING (vt_symbol)) "
    + present_sql("r", [*K2, "name_snapshot"], ["is_st"]))

# --- quality -----------------------------------------------------------------------------
COUNTS = ["rows", "symbols", "bad_ohlc", "null_close", "null_volume", "non_positive_close", "duplicate_keys"]


def dirty(spark, sf):
    """Bars with planted faults: missing and negative closes, broken highs, repeated keys."""
    b = bars(spark, sf)
    b = b.withColumns({"close": F.when(F.col("volume") == 11, F.lit(None)).when(F.col("volume") == 12, -F.col("close")).otherwise(F.col("close")),
                       "high": F.when(F.col("volume") == 13, F.col("low") - 1).otherwise(F.col("high"))})
    return spread(b.unionByName(b.where("volume = 14")), dealt(spark, sf)[0], "datetime", "vt_symbol")


DIRTY_SQL = f"""WITH {bars_sql()}, dirty0 AS (SELECT * REPLACE (CASE WHEN volume = 11 THEN NULL WHEN volume = 12 THEN -close ELSE close END AS close,
  CASE WHEN volume = 13 THEN low - 1 ELSE high END AS high) FROM bars), dirty AS (SELECT * FROM dirty0 UNION ALL SELECT * FROM dirty0 WHERE volume = 14),
  qc AS (SELECT count(*) AS rows, count(DISTINCT vt_symbol) AS symbols, count_if(high < greatest(open, close, low) OR low > least(open, close, high)) AS bad_ohlc,
  count_if(close IS NULL) AS null_close, count_if(volume IS NULL) AS null_volume, count_if(close <= 0) AS non_positive_close,
  (SELECT count(*) FROM (SELECT 1 FROM dirty GROUP BY datetime, vt_symbol HAVING count(*) > 1)) AS duplicate_keys FROM dirty)"""
add("quality_price_counters", lambda spark, sf: present(Q.price_counters(dirty(spark, sf)), ["start", "end"], COUNTS),
    DIRTY_SQL + """, r AS (SELECT *, (SELECT min(datetime) FROM dirty) AS "start", (SELECT max(datetime) FROM dirty) AS "end" FROM qc) SELECT "start"::VARCHAR AS "start", "end"::VARCHAR AS "end", """
    + present_sql("r", (), COUNTS).removeprefix("SELECT "))
add("quality_price_checks", lambda spark, sf: Q.price_checks(dirty(spark, sf), "raw").select("name", "status", "observed"),
    DIRTY_SQL + """ SELECT name, CASE WHEN v > 0 THEN 'fail' ELSE 'pass' END AS status, v::VARCHAR AS observed FROM qc, LATERAL (VALUES ('unique_keys', duplicate_keys),
  ('ohlc_order', bad_ohlc), ('prices_present', null_close), ('prices_positive', non_positive_close)) t(name, v)""")
add("quality_duplicates", lambda spark, sf: present(Q.duplicate_keys(dirty(spark, sf)), K2, ["n"]),
    DIRTY_SQL + " SELECT datetime::VARCHAR AS datetime, vt_symbol, count(*)::BIGINT AS n FROM dirty GROUP BY datetime, vt_symbol HAVING count(*) > 1")
add("quality_unordered", lambda spark, sf: Q.unordered_rows(table(spark, sf, "events").select(
    F.col("user_id").alias("vt_symbol"), F.col("ts").alias("datetime"), F.col("event_id")), "event_id").select("event_id"),
    "SELECT event_id FROM (SELECT event_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM events) WHERE ts <= b")
add("quality_data_summary", lambda spark, sf: present(Q.data_summary(bars(spark, sf)), ["start", "end"], ["rows", "symbols", "min_rows", "max_rows"]),
    f"""WITH {bars_sql()}, s AS (SELECT vt_symbol, count(*) AS n, min(datetime) AS a, max(datetime) AS b FROM bars GROUP BY 1)
  SELECT sum(n)::BIGINT AS rows, count(*)::BIGINT AS symbols, min(a)::VARCHAR AS "start", max(b)::VARCHAR AS "end", min(n)::BIGINT AS min_rows, max(n)::BIGINT AS max_rows FROM s""")
add("quality_symbol_summary", lambda spark, sf: present(Q.symbol_summary(bars(spark, sf)), ["vt_symbol", "start", "end"], ["rows"]),
    f'WITH {bars_sql()} SELECT vt_symbol, min(datetime)::VARCHAR AS "start", max(datetime)::VARCHAR AS "end", count(*)::BIGINT AS rows FROM bars GROUP BY 1')
COV_SQL = f"WITH {bars_sql('week')}, {ADJ_SQL}"
add("quality_coverage", lambda spark, sf: present(Q.key_coverage(bars(spark, sf, "week"), adjusted(spark, sf)), (), ["keys", "matched"], ["coverage"]),
    COV_SQL + ", r AS (SELECT count(*) AS keys, count(adj.close) AS matched, count(adj.close) / count(*) AS coverage FROM bars LEFT JOIN adj USING (datetime, vt_symbol)) "
    + present_sql("r", (), ["keys", "matched"], ["coverage"]))
add("quality_adjusted_consistency", lambda spark, sf: Q.adjusted_consistency(bars(spark, sf, "week"), adjusted(spark, sf)).select("name", "severity", "status"),
    COV_SQL + """ SELECT 'key_coverage' AS name, 'warning' AS severity, CASE WHEN count(adj.close) / count(*) < 0.99 THEN 'fail' ELSE 'pass' END AS status
  FROM bars LEFT JOIN adj USING (datetime, vt_symbol) UNION ALL SELECT 'turnover_match', 'warning', 'pass'""")
add("quality_adjusted_verification", lambda spark, sf: present(Q.adjusted_verification(bars(spark, sf, "week"), adjusted(spark, sf)), (), ["joined", "turnover_mismatch", "ratio_drops"], ["coverage"]),
    FAC_SQL + """, r AS (SELECT (SELECT count(*) FROM fac) / (SELECT count(*) FROM bars) AS coverage, count(*) AS joined, 0 AS turnover_mismatch,
  count_if(adjust_factor / p - 1 < -0.001) AS ratio_drops FROM (SELECT *, lag(adjust_factor) OVER (PARTITION BY vt_symbol ORDER BY datetime) AS p FROM fac)) """
    + present_sql("r", (), ["joined", "turnover_mismatch", "ratio_drops"], ["coverage"]))
add("quality_expected_date", lambda spark, sf: present(Q.expected_trade_date(bars(spark, sf).select(F.col("datetime").alias("trade_date")), "2000-02-29"), ["expected"], ["covers"]),
    f"WITH {bars_sql()} SELECT max(CASE WHEN datetime <= DATE '2000-02-29' THEN datetime END)::VARCHAR AS expected, (max(datetime) >= DATE '2000-02-29')::BIGINT AS covers FROM bars")
add("quality_freshness", lambda spark, sf: present(Q.freshness(bars(spark, sf)), ["start", "end"], ["rows", "symbols", "latest_symbols"]),
    f"""WITH {bars_sql()} SELECT min(datetime)::VARCHAR AS "start", max(datetime)::VARCHAR AS "end", count(*)::BIGINT AS rows, count(DISTINCT vt_symbol)::BIGINT AS symbols,
  (SELECT count(DISTINCT vt_symbol) FROM bars WHERE datetime = (SELECT max(datetime) FROM bars))::BIGINT AS latest_symbols FROM bars""")


def second(spark, sf, b=None):
    """Second price source: scaled, with a few wrong rows and missing rows."""
    b = bars(spark, sf, "week") if b is None else b
    key = F.split_part("vt_symbol", F.lit("."), F.lit(1)).cast("int")
    return b.where("volume <> 9").select(*K2, (F.col("close") * F.when(key % 4 == 0, 100.0).when(key % 4 == 1, 1.5).otherwise(1.0)
        * F.when(F.col("volume") == 10, 1.2).otherwise(1.0)).alias("close"))


CMP_SQL = f"""WITH {bars_sql('week')}, {ADJ_SQL}, sec AS (SELECT datetime, vt_symbol, close * (CASE WHEN split_part(vt_symbol, '.', 1)::INT % 4 = 0 THEN 100.0::DOUBLE WHEN
  split_part(vt_symbol, '.', 1)::INT % 4 = 1 THEN 1.5::DOUBLE ELSE 1.0::DOUBLE END) * (CASE WHEN volume = 10 THEN 1.2::DOUBLE ELSE 1.0::DOUBLE END) AS close_b FROM bars WHERE volume <> 9),
  rec AS (SELECT datetime, vt_symbol, close AS close_a FROM bars WHERE datetime IN (SELECT DISTINCT datetime FROM bars ORDER BY datetime DESC LIMIT 52)),
  j AS (SELECT * FROM rec JOIN sec USING (datetime, vt_symbol)), sc AS (SELECT vt_symbol, median(close_b / close_a) AS source_scale FROM j GROUP BY 1),
  cmp0 AS (SELECT *, abs(close_a - close_b) / greatest(abs(close_a), 1) AS relative_diff, abs(close_a - close_b / source_scale) / greatest(abs(close_a), 1) AS normalized_diff
  FROM j JOIN sc USING (vt_symbol)), act AS (SELECT datetime, vt_symbol, true AS near FROM bars WHERE volume = 15),
  cmp AS MATERIALIZED (SELECT *, CASE WHEN relative_diff > 0.02 THEN CASE WHEN near THEN 'corporate_action' WHEN abs(close_b / close_a) > 50 OR abs(close_b / close_a) < 0.02
  OR (normalized_diff <= 0.02 AND abs(source_scale - 1) > 0.02) THEN 'unit_mismatch' ELSE 'unknown' END END AS suspected_reason FROM cmp0 LEFT JOIN act USING (datetime, vt_symbol))"""


def compared(spark, sf):
    return Q.compare_sources(bars(spark, sf, "week"), second(spark, sf), 52, actions=bars(spark, sf, "week").where("volume = 15"))


add("reconcile_rows", lambda spark, sf: present(compared(spark, sf), [*K2, "suspected_reason"], (), ["relative_diff", "normalized_diff", "source_scale"]),
    CMP_SQL + " " + present_sql("cmp", [*K2, "suspected_reason"], (), ["relative_diff", "normalized_diff", "source_scale"]))
RS = ["checked_rows", "joined_rows", "diff_rows", "normalized_diff_rows", "unknown_symbols"]
add("reconcile_summary", lambda spark, sf: present(Q.reconciliation_summary(bars(spark, sf, "week"), compared(spark, sf), 52), ["status"], RS),
    CMP_SQL + """, r0 AS (SELECT (SELECT count(*) FROM rec) AS checked_rows, count(*) AS joined_rows, count_if(relative_diff > 0.02) AS diff_rows, count_if(normalized_diff > 0.02) AS normalized_diff_rows,
  count(DISTINCT CASE WHEN suspected_reason = 'unknown' THEN vt_symbol END) AS unknown_symbols FROM cmp), r AS (SELECT *, CASE WHEN joined_rows / checked_rows >= 0.99 AND normalized_diff_rows = 0 THEN 'pass' ELSE 'fail' END AS status FROM r0) """
    + present_sql("r", ["status"], RS))
add("reconcile_reasons", lambda spark, sf: present(compared(spark, sf).where("suspected_reason IS NOT NULL").groupBy("suspected_reason").agg(F.count(F.lit(1)).alias("n")), ["suspected_reason"], ["n"]),
    CMP_SQL + " SELECT suspected_reason, count(*)::BIGINT AS n FROM cmp WHERE suspected_reason IS NOT NULL GROUP BY 1")
add("reconcile_unknown_symbols", lambda spark, sf: present(Q.unknown_symbols(compared(spark, sf)), ["vt_symbol", "first_datetime", "last_datetime"], ["unknown_rows"], ["max_normalized_diff"]),
    CMP_SQL + """, r AS (SELECT vt_symbol, count(*) AS unknown_rows, max(normalized_diff) AS max_normalized_diff, min(datetime) AS first_datetime, max(datetime) AS last_datetime
  FROM cmp WHERE suspected_reason = 'unknown' GROUP BY 1) """ + present_sql("r", ["vt_symbol", "first_datetime", "last_datetime"], ["unknown_rows"], ["max_normalized_diff"]))
add("reconcile_top_symbols", lambda spark, sf: present(Q.top_symbols(compared(spark, sf)), ["vt_symbol"], ["diff_rows"], ["max_relative_diff"]),
    CMP_SQL + """, r AS (SELECT vt_symbol, count(*) AS diff_rows, round(max(relative_diff), 6) AS max_relative_diff FROM cmp WHERE suspected_reason IS NOT NULL
  GROUP BY 1 ORDER BY 2 DESC, 3 DESC, 1 LIMIT 20) """ + present_sql("r", ["vt_symbol"], ["diff_rows"], ["max_relative_diff"]))
add("quarantine_counts", lambda spark, sf: Q.quarantine(universe(bars(spark, sf, "week")), Q.unknown_symbols(compared(spark, sf)))[1],
    CMP_SQL + """, un AS (SELECT DISTINCT vt_symbol FROM cmp WHERE suspected_reason = 'unknown'), k AS (SELECT * FROM bars ANTI JOIN un USING (vt_symbol))
  SELECT (SELECT count(*) FROM bars) AS rows_before, (SELECT count(DISTINCT vt_symbol) FROM bars) AS symbols_before, (SELECT count(*) FROM k) AS rows_after, (SELECT count(DISTINCT vt_symbol) FROM k) AS symbols_after""")
add("quarantine_unknown_in_universe", lambda spark, sf: Q.unknown_in_universe(Q.unknown_symbols(compared(spark, sf)), universe(bars(spark, sf, "week"))),
    CMP_SQL + " SELECT DISTINCT vt_symbol FROM cmp WHERE suspected_reason = 'unknown' AND vt_symbol IN (SELECT vt_symbol FROM bars WHERE volume > 20)")
FRAMES = ("raw", "adjusted", "calendar", "second_source", "universe")


def gate(spark, sf):
    # the checks read the bars some twenty times: they are stored once, as they would be in a lake
    b = materialise(bars(spark, sf, "week"), "bars")
    frames = {"raw": b, "adjusted": adjusted(spark, sf, b), "calendar": b.select(F.col("datetime").alias("trade_date")), "second_source": second(spark, sf, b),
              "universe": universe(b)}
    return Q.data_gate(frames, ["raw", "adjusted", "master"], ["second_source", "benchmark"], "research", "2001-06-30", 52)


GATE_SQL = CMP_SQL + """, chk(name, dataset, severity, status) AS (VALUES ('dataset_exists', 'raw', 'blocking', 'pass'), ('dataset_exists', 'adjusted', 'blocking', 'pass'),
  ('dataset_exists', 'master', 'blocking', 'fail'), ('dataset_exists', 'second_source', 'warning', 'pass'), ('dataset_exists', 'benchmark', 'warning', 'fail')
  UNION ALL SELECT n, d, 'blocking', 'pass' FROM (VALUES ('unique_keys'), ('ohlc_order'), ('prices_present'), ('prices_positive')) t(n), (VALUES ('raw'), ('adjusted')) u(d)
  UNION ALL SELECT 'key_coverage', 'adjusted', 'warning', CASE WHEN (SELECT count(*) FROM adj) / (SELECT count(*) FROM bars) < 0.99 THEN 'fail' ELSE 'pass' END
  UNION ALL SELECT 'turnover_match', 'adjusted', 'warning', 'pass'
  UNION ALL SELECT 'source_comparison', 'adjusted', 'warning', 'fail'
  UNION ALL SELECT 'calendar_coverage', 'calendar', 'warning', CASE WHEN max(datetime) >= DATE '2001-06-30' THEN 'pass' ELSE 'fail' END FROM bars
  UNION ALL SELECT 'latest_date', d, 'warning', 'pass' FROM (VALUES ('raw'), ('universe')) u(d))"""
add("quality_gate", lambda spark, sf: gate(spark, sf).select("name", "dataset", "severity", "status"), GATE_SQL + " SELECT * FROM chk")
add("quality_gate_status", lambda spark, sf: present(Q.gate_status(gate(spark, sf)), ["status"], ["failed"]),
    GATE_SQL + " SELECT 'fail' AS status, count(*)::BIGINT AS failed FROM chk WHERE status = 'fail'")
add("quality_common_date", lambda spark, sf: present(Q.common_date({"daily": bars(spark, sf), "weekly": bars(spark, sf, "week")}), ["dataset", "latest", "common"], ["blocks"]),
    f"""WITH {bars_sql()}, {bars_sql('week', 'wk')}, l AS (SELECT 'daily' AS dataset, max(datetime) AS latest FROM bars UNION ALL SELECT 'weekly', max(datetime) FROM wk)
  SELECT dataset, latest::VARCHAR AS latest, (SELECT min(latest) FROM l)::VARCHAR AS common, (latest < (SELECT max(latest) FROM l))::BIGINT AS blocks FROM l""")
add("quality_snapshot_age", lambda spark, sf: Q.snapshot_age_check(bars(spark, sf), "datetime", "2002-01-31", "raw", "paper").select("name", "severity", "status", "observed"),
    f"""WITH {bars_sql()}, a AS (SELECT DATE '2002-01-31' - max(datetime) AS age FROM bars) SELECT 'snapshot_age' AS name, 'blocking' AS severity,
  CASE WHEN age BETWEEN 0 AND 7 THEN 'pass' ELSE 'fail' END AS status, age::VARCHAR AS observed FROM a""")
add("quality_dataset_profile", lambda spark, sf: Q.dataset_profile(status(spark, sf), "status_reason"),
    STAT_SQL + """ SELECT 'rows' AS name, count(*)::BIGINT AS value FROM st UNION ALL SELECT 'symbols', count(DISTINCT vt_symbol) FROM st UNION ALL SELECT 'st_names', count(DISTINCT CASE WHEN is_st THEN vt_symbol END) FROM st
  UNION ALL SELECT 'zero_volume', 0 UNION ALL SELECT 'reason:' || status_reason, count(*) FROM st GROUP BY 1""")

"""Queries for dataset preparation, processors and factor evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.functions import algebra as A
from barloom.functions.algebra import field
from barloom.operators import dataset as D
from barloom.operators import evaluation as E
from barloom.operators import processors as P
from barloom.operators.evaluate import evaluate
from checks.panels import (MEMBERS_SQL, UNIVERSE_SQL, bars, bars_sql, dealt, members, panel_sizes, present, present_sql, table,
                           universe)
from checks.registry import add
from checks.sqltext import factor_sql, steady

c, v = field("close"), field("volume")
KEYS = ["vt_symbol", "datetime"]
FEATS = {"f1": A.ts_mean(c, 5) / c, "f2": A.pct_change(v, 2), "label": A.ts_delay(c, -3) / A.ts_delay(c, -1) - 1}
SEG = {"train": ("1995-01-01", "1998-12-31"), "valid": ("19990101", "19991231"), "test": ("2000-01-01", "2001-12-31")}
FEAT_SQL, FEAT = factor_sql("bars", FEATS, KEYS)
WITH = f"WITH {bars_sql('week')}, {FEAT_SQL}"
COLS = ["f1", "f2", "label"]


def stage(spark, sf):
    ds = D.Dataset(bars(spark, sf, "week"), SEG)
    ds.add_feature("f1", FEATS["f1"])
    ds.add_feature("f2", FEATS["f2"])
    ds.set_label(FEATS["label"])
    ds.prepare()
    return ds


def add_processor(name, step, sql, cols=COLS):
    add(name, lambda spark, sf: present(stage(spark, sf).stages["raw"].transform(step), KEYS, (), cols),
        f"{WITH} {sql}")


MEM = "(SELECT DISTINCT datetime AS trade_date, vt_symbol FROM bars WHERE volume > 20)"
IV_SQL = f"""comp AS (SELECT * FROM {MEM}), days AS (SELECT trade_date, row_number() OVER (ORDER BY trade_date) AS d
  FROM (SELECT DISTINCT trade_date FROM comp)),
iv AS (SELECT vt_symbol, min(trade_date) AS "start", max(trade_date) AS "end" FROM (SELECT vt_symbol, trade_date,
  d - row_number() OVER (PARTITION BY vt_symbol ORDER BY trade_date) AS g FROM comp JOIN days USING (trade_date))
  GROUP BY vt_symbol, g)"""


def components(spark, sf):
    return bars(spark, sf, "week").where("volume > 20").select(F.col("datetime").alias("trade_date"), "vt_symbol")


def prepared(spark, sf):
    ds = D.Dataset(bars(spark, sf, "week"), SEG)
    ds.add_feature("f1", FEATS["f1"])
    ds.add_feature("gap", F.col("high") - F.col("low"))
    ds.add_feature("ext", result=bars(spark, sf, "week").where("volume > 50").select(
        "datetime", "vt_symbol", F.col("turnover").alias("data")))
    ds.set_label(FEATS["label"])
    return present(ds.prepare(D.membership_intervals(components(spark, sf))), KEYS, (), ["f1", "gap", "ext", "label"])


add("dataset_prepare", prepared, f"""{WITH}, {IV_SQL} , p AS (SELECT vt_symbol, datetime, f1, high - low AS gap,
  CASE WHEN volume > 50 THEN turnover END AS ext, label FROM {FEAT} JOIN bars b USING (vt_symbol, datetime)
  WHERE EXISTS (SELECT 1 FROM iv WHERE iv.vt_symbol = b.vt_symbol AND datetime BETWEEN "start" AND "end"))
""" + present_sql("p", KEYS, (), ["f1", "gap", "ext", "label"]))


def processed(spark, sf):
    ds = stage(spark, sf)
    ds.add_processor("infer", lambda df: P.cs_rank_norm(df, ["f1", "f2"]))
    ds.add_processor("learn", P.drop_na)
    ds.process()
    out = None
    for st in ("raw", "infer", "learn"):
        for seg in SEG:
            part = ds.fetch(st, seg).groupBy().agg(
                F.count(F.lit(1)).alias("n"), F.count("f2").alias("n2"), F.avg("f1").alias("m"))
            part = part.withColumns({"stage": F.lit(st), "segment": F.lit(seg)})
            out = part if out is None else out.unionByName(part)
    return present(out, ["stage", "segment"], ["n", "n2"], ["m"])


def _rank_sql(x):
    return (f"CASE WHEN {x} IS NOT NULL THEN ((rank() OVER (PARTITION BY datetime ORDER BY {steady(x)} NULLS LAST) + "
            f"(count(*) OVER (PARTITION BY datetime, {steady(x)}) - 1) / 2.0::DOUBLE) / "
            f"count(*) OVER (PARTITION BY datetime) - 0.5) * 3.46 END AS {x}")


SEGS_SQL = ("segs(segment, a, b) AS (VALUES ('train', DATE '1995-01-01', DATE '1998-12-31'), "
            "('valid', DATE '1999-01-01', DATE '1999-12-31'), ('test', DATE '2000-01-01', DATE '2001-12-31'))")
add("dataset_stages", processed, f"""{WITH}, inf AS (SELECT vt_symbol, datetime, {_rank_sql('f1')}, {_rank_sql('f2')}
 FROM {FEAT}), {SEGS_SQL}, allst AS (SELECT 'raw' AS stage, datetime, f1, f2 FROM {FEAT} UNION ALL
 SELECT 'infer', datetime, f1, f2 FROM inf UNION ALL SELECT 'learn', datetime, f1, f2 FROM inf
 WHERE f1 IS NOT NULL AND f2 IS NOT NULL),
 r AS (SELECT stage, segment, count(*) AS n, count(f2) AS n2, avg(f1) AS m FROM allst JOIN segs ON datetime BETWEEN a AND b
 GROUP BY 1, 2) """ + present_sql("r", ["stage", "segment"], ["n", "n2"], ["m"]))

add_processor("proc_drop_na", P.drop_na, present_sql(f"{FEAT} WHERE f1 IS NOT NULL AND f2 IS NOT NULL", KEYS, (), COLS))
add_processor("proc_fill_na", lambda df: P.fill_na(df, -1.5), f""", r AS (SELECT vt_symbol, datetime,
  {', '.join(f'coalesce({x}, -1.5) AS {x}' for x in COLS)} FROM {FEAT}) """ + present_sql("r", KEYS, (), COLS))
add_processor("proc_fill_na_features", lambda df: P.fill_na(df, 2.0, False), f""", r AS (SELECT vt_symbol, datetime,
  coalesce(f1, 2.0) AS f1, coalesce(f2, 2.0) AS f2, label FROM {FEAT}) """ + present_sql("r", KEYS, (), COLS))
add_processor("proc_cs_norm_robust", lambda df: P.cs_norm(df, "robust"), f""", a AS (SELECT vt_symbol, datetime, label,
  f1 - median(f1) OVER (PARTITION BY datetime) AS f1, f2 - median(f2) OVER (PARTITION BY datetime) AS f2 FROM {FEAT}),
  b AS (SELECT vt_symbol, datetime, label, {', '.join(f'{x} / nullif(median(abs({x})) OVER (PARTITION BY datetime), 0) / 1.4826 AS {x}' for x in ('f1', 'f2'))} FROM a),
  r AS (SELECT vt_symbol, datetime, label, {', '.join(f'CASE WHEN {x} IS NOT NULL THEN greatest(-3, least(3, {x})) END AS {x}' for x in ('f1', 'f2'))} FROM b)
""" + present_sql("r", KEYS, (), COLS))
add_processor("proc_cs_norm_zscore", lambda df: P.cs_norm(df, "zscore"), f""", r AS (SELECT vt_symbol, datetime, label,
  {', '.join(f'({x} - avg({x}) OVER (PARTITION BY datetime)) / nullif(stddev_samp({x}) OVER (PARTITION BY datetime), 0) AS {x}' for x in ('f1', 'f2'))}
  FROM {FEAT}) """ + present_sql("r", KEYS, (), COLS))
add_processor("proc_cs_rank_norm", lambda df: P.cs_rank_norm(df, ["f1", "f2"]),
              f", r AS (SELECT vt_symbol, datetime, {_rank_sql('f1')}, {_rank_sql('f2')}, label FROM {FEAT}) "
              + present_sql("r", KEYS, (), COLS))
add_processor("proc_cs_fill_na", lambda df: P.cs_fill_na(df), f""", r AS (SELECT vt_symbol, datetime, label,
  coalesce(f1, avg(f1) OVER (PARTITION BY datetime)) AS f1, coalesce(f2, avg(f2) OVER (PARTITION BY datetime)) AS f2
  FROM {FEAT}) """ + present_sql("r", KEYS, (), COLS))
add_processor("proc_replace_inf", lambda df: P.replace_inf(df.withColumn(
    "f2", F.when(F.col("f2") > 5, F.lit(float("inf"))).otherwise(F.col("f2")))),
    f""", r AS (SELECT vt_symbol, datetime, label, f1, CASE WHEN f2 > 5 THEN
  avg(CASE WHEN f2 <= 5 THEN f2 END) OVER (PARTITION BY vt_symbol) ELSE f2 END AS f2 FROM {FEAT}) """
    + present_sql("r", KEYS, (), COLS))
FIT = "datetime BETWEEN DATE '1995-01-01' AND DATE '1998-12-31'"
add_processor("proc_ts_norm", lambda df: P.ts_norm(df, *SEG["train"]), f""", m AS (SELECT
  {', '.join(f'avg({x}) AS m_{x}, stddev_pop({x}) AS s_{x}' for x in COLS)} FROM {FEAT} WHERE {FIT}),
  r AS (SELECT vt_symbol, datetime, {', '.join(f'CASE WHEN s_{x} = 0 THEN {x} ELSE ({x} - m_{x}) / s_{x} END AS {x}' for x in COLS)}
  FROM {FEAT}, m) """ + present_sql("r", KEYS, (), COLS))
add_processor("proc_robust_zscore", lambda df: P.robust_zscore(df, *SEG["train"]), f""", m AS (SELECT median(f1) AS m_f1,
  median(f2) AS m_f2 FROM {FEAT} WHERE {FIT}), s AS (SELECT median(abs(f1 - m_f1)) AS s_f1, median(abs(f2 - m_f2)) AS s_f2
  FROM {FEAT}, m WHERE {FIT}), r AS (SELECT vt_symbol, datetime, label, {', '.join(f'CASE WHEN {x} IS NOT NULL THEN greatest(-3, least(3, ({x} - m_{x}) / ((s_{x} + 1e-12) * 1.4826))) END AS {x}' for x in ('f1', 'f2'))}
  FROM {FEAT}, m, s) """ + present_sql("r", KEYS, (), COLS))
add_processor("proc_drop_feature", lambda df: P.drop_feature(df, ["f2"]), present_sql(FEAT, KEYS, (), ["f1", "label"]),
              ["f1", "label"])
add("membership_intervals", lambda spark, sf: present(D.membership_intervals(components(spark, sf)), ["vt_symbol", "start", "end"]),
    f"WITH {bars_sql('week')}, {IV_SQL} SELECT vt_symbol, \"start\"::VARCHAR AS \"start\", \"end\"::VARCHAR AS \"end\" FROM iv")


def analysis(spark, sf):
    panel = bars(spark, sf, "week")
    return present(D.factor_analysis(panel, evaluate(panel, {"f1": FEATS["f1"]}, keep=[]), "f1"),
                   KEYS, ["quantile"], ["f1", "fwd_1", "fwd_5", "fwd_10"])


add("dataset_factor_analysis", analysis, f"""{WITH}, r AS (SELECT vt_symbol, datetime, f1,
  ntile(10) OVER (PARTITION BY datetime ORDER BY f1, vt_symbol) AS quantile,
  {', '.join(f'lead(close, {n}) OVER s / close - 1 AS fwd_{n}' for n in (1, 5, 10))}
  FROM {FEAT} JOIN bars USING (vt_symbol, datetime) WHERE f1 IS NOT NULL WINDOW s AS (PARTITION BY vt_symbol ORDER BY datetime))
""" + present_sql("r", KEYS, ["quantile"], ["f1", "fwd_1", "fwd_5", "fwd_10"]))

# --- factor evaluation -------------------------------------------------------------------
HIGH, LISTED, NAMES = 52, 52, 5
STOCK = {**E.stock_features(HIGH), **E.lottery_features(), **E.technical_features()}
STOCK_SQL, STOCK_T = factor_sql("bars", STOCK, ["vt_symbol", "datetime", "close"])
ENDS_SQL = """k AS (SELECT strftime(datetime, '%Y-%m') AS period, max(datetime) AS datetime FROM bars GROUP BY 1),
 ends AS (SELECT period, datetime, row_number() OVER (ORDER BY datetime) - 1 AS pidx FROM k
 WHERE datetime < (SELECT max(datetime) FROM k))"""


def stock(spark, sf):
    parts, whole = dealt(spark, sf)
    return evaluate(bars(spark, sf, "week"), STOCK, keep=["close"], sizes=panel_sizes(spark, sf, "week"), parts=parts if whole else 0)


add("eval_stock_features", lambda spark, sf: present(stock(spark, sf), KEYS, (), list(STOCK)),
    f"WITH {bars_sql('week')}, {STOCK_SQL} " + present_sql(STOCK_T, KEYS, (), list(STOCK)))
for freq, key in (("monthly", "strftime(datetime, '%Y-%m')"), ("weekly", "strftime(datetime, '%G-W%V')")):
    add(f"eval_period_ends_{freq}", lambda spark, sf, freq=freq: present(
        E.period_ends(bars(spark, sf), freq), ["period", "datetime"], ["pidx"]),
        f"WITH {bars_sql()}, {ENDS_SQL.replace(chr(39).join(['strftime(datetime, ', '%Y-%m', ')']), key)} "
        + present_sql("ends", ["period", "datetime"], ["pidx"]))


def pool(spark, sf):
    panel = bars(spark, sf, "week")
    return E.snapshot(evaluate(panel, STOCK, keep=["close"]), E.period_ends(panel, "monthly"), universe(panel), LISTED)


POOL_SQL = f"""WITH {bars_sql('week')}, {UNIVERSE_SQL}, {STOCK_SQL}, {ENDS_SQL}, snap AS (SELECT *,
  CASE WHEN lead(pidx) OVER s = pidx + 1 THEN lead(close) OVER s / close - 1 END AS fwd_ret
  FROM {STOCK_T} JOIN ends USING (datetime) WINDOW s AS (PARTITION BY vt_symbol ORDER BY pidx)),
  pool AS MATERIALIZED (SELECT snap.* FROM snap JOIN universe USING (datetime, vt_symbol)
  WHERE in_execution AND fwd_ret IS NOT NULL AND listed_bars >= {LISTED})"""
add("eval_snapshot", lambda spark, sf: present(pool(spark, sf), KEYS, ["pidx"], ["fwd_ret", "ret_20", "nh"]),
    POOL_SQL + present_sql("pool", KEYS, ["pidx"], ["fwd_ret", "ret_20", "nh"]))
add("eval_trend_ok", lambda spark, sf: present(stock(spark, sf).withColumn("trend_ok", E.trend_ok()), KEYS, ["trend_ok"]),
    f"""WITH {bars_sql('week')}, {STOCK_SQL}, r AS (SELECT vt_symbol, datetime, coalesce(ma_short > ma_mid AND ma_mid > ma_long
    AND ma_short > ma_short_lag AND close / ma_short - 1 <= 0.25 AND nh >= 0.75, false) AS trend_ok FROM {STOCK_T}) """
    + present_sql("r", KEYS, ["trend_ok"]))


def _avg_rank(x, part):
    return (f"(rank() OVER (PARTITION BY {part} ORDER BY {x} NULLS LAST) + "
            f"(count(*) OVER (PARTITION BY {part}, {x}) - 1) / 2.0::DOUBLE)")


def _pct(x, part):
    return f"CASE WHEN {x} IS NOT NULL THEN {_avg_rank(x, part)} / count({x}) OVER (PARTITION BY {part}) END"


add("eval_composite_score", lambda spark, sf: present(
    E.composite_score(pool(spark, sf), "ret_60", "nh", "vol_ratio", "ret_5"), KEYS, (), ["rank_rs", "rank_nh", "rank_vol", "score"]),
    f"""{POOL_SQL}, p AS (SELECT *, coalesce(ret_5 > 0, false) AS rising FROM pool), r AS (SELECT vt_symbol, datetime,
  {_pct('ret_60', 'datetime')} AS rank_rs, {_pct('nh', 'datetime')} AS rank_nh, CASE WHEN rising THEN
  {_pct('vol_ratio', 'datetime, rising')} ELSE 0.5 END AS rank_vol FROM p), q AS (SELECT *,
  0.5 * rank_rs + 0.3 * rank_nh + 0.2 * rank_vol AS score FROM r) """
    + present_sql("q", KEYS, (), ["rank_rs", "rank_nh", "rank_vol", "score"]))


def ic_sql(x, y="fwd_ret", source="pool"):
    return f"""ic AS (SELECT datetime, count(*) AS n, corr(rx, ry) AS ic FROM (SELECT datetime, {_avg_rank(x, 'datetime')} AS rx,
  {_avg_rank(y, 'datetime')} AS ry FROM {source} WHERE {x} IS NOT NULL AND {y} IS NOT NULL) GROUP BY 1 HAVING count(*) >= {NAMES})"""


SUM = ("count({0}) AS n_periods, avg({0}) AS {1}, avg({0}) / nullif(stddev_samp({0}), 0) AS {2}, avg({0}) / "
       "nullif(stddev_samp({0}), 0) * sqrt(count({0})) AS {3}, avg(({0} > 0)::INT) AS pct_positive")
IC_COLS = ["ic_mean", "icir", "t_stat", "pct_positive"]
add("eval_rank_ic", lambda spark, sf: present(E.rank_ic(pool(spark, sf), "ret_20", min_names=NAMES), ["datetime"], ["n"], ["ic"]),
    f"{POOL_SQL}, {ic_sql('ret_20')} " + present_sql("ic", ["datetime"], ["n"], ["ic"]))
add("eval_ic_summary", lambda spark, sf: present(
    E.ic_summary(E.rank_ic(pool(spark, sf), "nh", min_names=NAMES)), (), ["n_periods"], IC_COLS),
    f"{POOL_SQL}, {ic_sql('nh')}, r AS (SELECT {SUM.format('ic', 'ic_mean', 'icir', 't_stat')} FROM ic) "
    + present_sql("r", (), ["n_periods"], IC_COLS))
Q_SQL = """qq AS (SELECT *, floor((row_number() OVER (PARTITION BY datetime ORDER BY {x}, {tie}) - 1) * {k} /
  count(*) OVER (PARTITION BY datetime))::INT AS q FROM {src} WHERE {x} IS NOT NULL AND fwd_ret IS NOT NULL)"""
QR_SQL = """qm AS (SELECT datetime, q, avg(fwd_ret) AS q_ret FROM qq GROUP BY 1, 2), qr AS (SELECT q, avg(q_ret) AS mean_ret,
  stddev_samp(q_ret) AS std_ret, count(*) AS n, avg(q_ret) / nullif(stddev_samp(q_ret), 0) * sqrt(count(*)) AS t_stat
  FROM qm GROUP BY q), qf AS (SELECT *, NOT coalesce(bool_or(mean_ret < prev) OVER (), false) AS monotone FROM
  (SELECT *, lag(mean_ret) OVER (ORDER BY q) AS prev FROM qr))"""
QC = ["mean_ret", "std_ret", "t_stat"]
add("eval_quantile_returns", lambda spark, sf: present(E.quantile_returns(pool(spark, sf), "ret_5", 3), (), ["q", "n", "monotone"], QC),
    f"{POOL_SQL}, {Q_SQL.format(x='ret_5', tie='vt_symbol', k=3, src='pool')}, {QR_SQL} " + present_sql("qf", (), ["q", "n", "monotone"], QC))
SP_SQL = """sp AS (SELECT datetime, avg(CASE WHEN q = {top} THEN fwd_ret END) - avg(CASE WHEN q = 0 THEN fwd_ret END) AS spread
  FROM qq GROUP BY 1), ss AS (SELECT count(spread) AS n_periods, avg(spread) AS spread_mean,
  avg(spread) / nullif(stddev_samp(spread), 0) * sqrt(count(spread)) AS spread_t, avg(spread) * {ppy} AS spread_ann FROM sp)"""
SC = ["spread_mean", "spread_t", "spread_ann"]
add("eval_spread", lambda spark, sf: present(E.spread_summary(E.spread_series(pool(spark, sf), "max_20", 5), 12), (), ["n_periods"], SC),
    f"{POOL_SQL}, {Q_SQL.format(x='max_20', tie='vt_symbol', k=5, src='pool')}, {SP_SQL.format(top=4, ppy=12)} "
    + present_sql("ss", (), ["n_periods"], SC))
add("eval_factor_correlation", lambda spark, sf: present(
    E.factor_correlation(pool(spark, sf), "ret_5", "ret_20", NAMES), (), ["n_periods"], ["mean_corr"]),
    f"{POOL_SQL}, {ic_sql('ret_5', 'ret_20')}, r AS (SELECT count(ic) AS n_periods, avg(ic) AS mean_corr FROM ic) "
    + present_sql("r", (), ["n_periods"], ["mean_corr"]))
EV = ["hit_share", "hit_mean", "miss_mean", "diff_ann", "diff_t", "pct_positive", "median_hits"]
for flag in ("gold_10", "dead_10", "bottom_div", "top_div"):
    add(f"eval_event_{flag}", lambda spark, sf, flag=flag: present(E.event_study(pool(spark, sf), flag, 12), (), ["n_periods"], EV),
        f"""{POOL_SQL}, e AS (SELECT datetime, avg(CASE WHEN {flag} = 1 THEN fwd_ret END) AS hit, avg(CASE WHEN {flag} = 0 THEN fwd_ret END) AS miss,
  count(CASE WHEN {flag} = 1 THEN 1 END) AS nh FROM pool GROUP BY 1), d AS (SELECT *, hit - miss AS diff FROM e),
  r AS (SELECT (SELECT avg({flag}) FROM pool) AS hit_share, count(diff) AS n_periods,
  avg(CASE WHEN diff IS NOT NULL THEN hit END) AS hit_mean, avg(CASE WHEN diff IS NOT NULL THEN miss END) AS miss_mean,
  coalesce(avg(diff), 0) * 12 AS diff_ann, avg(diff) / nullif(stddev_samp(diff), 0) * sqrt(count(diff)) AS diff_t,
  avg((diff > 0)::INT) AS pct_positive, median(CASE WHEN nh > 0 THEN nh END) AS median_hits FROM d) """
        + present_sql("r", (), ["n_periods"], EV))
WEIGHTS = {"ret_20": -0.4, "nh": 0.35, "vol_ratio": -0.25, "amihud_20": 0.0}
HL = ["weight", "ic_mean", "ratio", "t_stat", "pct_positive"]
H_SQL = " UNION ALL ".join(f"SELECT '{n}' AS factor, {w} AS weight, datetime, {n} AS value, fwd_ret FROM pool" for n, w in WEIGHTS.items())
add("eval_factor_health", lambda spark, sf: present(
    E.factor_health(pool(spark, sf), WEIGHTS, 12, NAMES), ["factor", "start", "end", "status"], ["n_periods"], HL),
    f"""{POOL_SQL}, st AS ({H_SQL}), ic AS (SELECT factor, weight, datetime, corr(rx, ry) AS ic FROM (SELECT factor, weight, datetime,
  {_avg_rank('value', 'factor, datetime')} AS rx, {_avg_rank('fwd_ret', 'factor, datetime')} AS ry FROM st
  WHERE value IS NOT NULL AND fwd_ret IS NOT NULL) GROUP BY ALL HAVING count(*) >= {NAMES}),
  t AS (SELECT * FROM ic QUALIFY row_number() OVER (PARTITION BY factor ORDER BY datetime DESC) <= 12),
  r AS (SELECT factor, weight, {SUM.format('ic', 'ic_mean', 'ratio', 't_stat')}, min(datetime) AS "start", max(datetime) AS "end"
  FROM t GROUP BY ALL), h AS (SELECT *, CASE WHEN sign(weight) = sign(ic_mean) OR weight = 0 THEN 'ok' ELSE 'flipped' END AS status FROM r)
  SELECT factor, "start"::VARCHAR AS "start", "end"::VARCHAR AS "end", status, """
    + present_sql("h", (), ["n_periods"], HL).removeprefix("SELECT "))

RET_SQL = "ret AS (SELECT *, close / lag(close) OVER (PARTITION BY vt_symbol ORDER BY datetime) - 1 AS ret FROM bars)"
IDX_SQL = f"""{RET_SQL}, ind AS (SELECT industry, datetime, avg(ret) AS ind_ret, count(*) AS n_members FROM ret JOIN members
  USING (vt_symbol) WHERE ret IS NOT NULL GROUP BY 1, 2), idx AS (SELECT *, product(ind_ret + 1) OVER
  (PARTITION BY industry ORDER BY datetime) AS idx FROM ind)"""


def index(spark, sf):
    return E.industry_index(bars(spark, sf, "week"), members(spark, sf))


add("eval_industry_momentum", lambda spark, sf: present(E.industry_momentum(index(spark, sf)), ["industry", "datetime"], ["n_members"],
    ["ind_ret", "ind_mom_20", "ind_mom_60"]), f"""WITH {bars_sql('week')}, {MEMBERS_SQL}, {IDX_SQL}, r AS (SELECT *,
  idx / lag(idx, 20) OVER w - 1 AS ind_mom_20, idx / lag(idx, 60) OVER w - 1 AS ind_mom_60 FROM idx
  WINDOW w AS (PARTITION BY industry ORDER BY datetime)) """
    + present_sql("r", ["industry", "datetime"], ["n_members"], ["ind_ret", "ind_mom_20", "ind_mom_60"]))
TAB_SQL = f"""WITH {bars_sql('week')}, {MEMBERS_SQL}, {IDX_SQL}, {ENDS_SQL}, mo AS (SELECT *, idx / lag(idx, 20) OVER
  (PARTITION BY industry ORDER BY datetime) - 1 AS momentum FROM idx), sn AS (SELECT mo.*, lead(idx) OVER (PARTITION BY industry
  ORDER BY datetime) / idx - 1 AS fwd_ret FROM mo SEMI JOIN ends USING (datetime)), tab AS (SELECT datetime, industry, momentum,
  fwd_ret FROM sn WHERE momentum IS NOT NULL AND fwd_ret IS NOT NULL AND n_members >= 5)"""


def tab(spark, sf):
    return E.industry_momentum_table(index(spark, sf), E.period_ends(bars(spark, sf, "week"), "monthly"), 20, 5)


add("eval_industry_table", lambda spark, sf: present(tab(spark, sf), ["industry", "datetime"], (), ["momentum", "fwd_ret"]),
    TAB_SQL + present_sql("tab", ["industry", "datetime"], (), ["momentum", "fwd_ret"]))
add("eval_industry_quantiles", lambda spark, sf: present(E.quantile_returns(tab(spark, sf), "momentum", 2, tie="industry"),
    (), ["q", "n", "monotone"], QC),
    f"{TAB_SQL}, {Q_SQL.format(x='momentum', tie='industry', k=2, src='tab')}, {QR_SQL} " + present_sql("qf", (), ["q", "n", "monotone"], QC))
RO = ["nh_breadth", "ind_mom", "vol_share_chg", "rank_velocity"]
add("eval_rotation", lambda spark, sf: present(E.rotation_features(bars(spark, sf, "week"), members(spark, sf), high_window=HIGH),
    ["industry", "datetime"], ["n_members"], RO), f"""WITH {bars_sql('week')}, {MEMBERS_SQL}, {RET_SQL}, s AS (SELECT *,
  CASE WHEN count(high) OVER w = {HIGH} THEN (close >= 0.95 * max(high) OVER w)::INT END AS nh FROM ret
  WINDOW w AS (PARTITION BY vt_symbol ORDER BY datetime ROWS BETWEEN {HIGH - 1} PRECEDING AND CURRENT ROW)),
  i AS (SELECT industry, datetime, avg(ret) AS ind_ret, sum(turnover) AS t, avg(nh) AS nh_breadth, count(*) AS n_members
  FROM s JOIN members USING (vt_symbol) GROUP BY 1, 2), m AS (SELECT datetime, sum(t) AS mt FROM i GROUP BY 1),
  d AS (SELECT i.*, t / mt AS share, product(coalesce(ind_ret, 0) + 1) OVER (PARTITION BY industry ORDER BY datetime) AS idx
  FROM i JOIN m USING (datetime) WHERE n_members >= 5), e AS (SELECT *, idx / lag(idx, 60) OVER w - 1 AS ind_mom,
  CASE WHEN count(share) OVER w20 = 20 THEN avg(share) OVER w20 END / CASE WHEN count(share) OVER w60 = 60 THEN avg(share) OVER w60 END AS vol_share_chg
  FROM d WINDOW w AS (PARTITION BY industry ORDER BY datetime), w20 AS (PARTITION BY industry ORDER BY datetime ROWS 19 PRECEDING),
  w60 AS (PARTITION BY industry ORDER BY datetime ROWS 59 PRECEDING)),
  f AS (SELECT *, {_pct('ind_mom', 'datetime')} AS p FROM e), r AS (SELECT *, p - lag(p, 20) OVER
  (PARTITION BY industry ORDER BY datetime) AS rank_velocity FROM f) """
    + present_sql("r", ["industry", "datetime"], ["n_members"], RO))


def sized(spark, sf):
    shares = table(spark, sf, "supplier").select(
        F.concat(F.col("s_suppkey").cast("string"), F.lit(".SUP")).alias("vt_symbol"),
        F.col("s_acctbal").alias("outstanding_share"))
    panel = bars(spark, sf, "week").join(shares, "vt_symbol", "left").withColumn(
        "turnover_rate", F.try_divide("volume", "outstanding_share"))
    return evaluate(panel, E.size_features(), keep=[])


SIZE_SQL, SIZE_T = factor_sql("sized", E.size_features(), KEYS)
add("eval_size_turnover", lambda spark, sf: present(sized(spark, sf), KEYS, (), ["size", "turnover_rate_20"]),
    f"""WITH {bars_sql('week')}, sized AS (SELECT bars.*, s_acctbal AS outstanding_share, volume / nullif(s_acctbal, 0) AS turnover_rate
  FROM bars LEFT JOIN supplier ON s_suppkey || '.SUP' = vt_symbol), {SIZE_SQL} """ + present_sql(SIZE_T, KEYS, (), ["size", "turnover_rate_20"]))

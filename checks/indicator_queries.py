"""Queries for the technical indicators."""

from __future__ import annotations

from barloom.functions import algebra as A
from barloom.functions import indicators as K
from barloom.functions.algebra import field
from barloom.operators.folds import kama, sar
from checks.panels import bars, bars_sql, present, present_sql
from checks.registry import add, add_factors

c = field("close")

SETS = {
    "sma": {"sma": K.sma(10)}, "ema": {"ema": K.ema(10)}, "wma": {"wma": K.wma(10)},
    "apo": {"apo": K.apo(5, 12), "apo_ema": K.apo(5, 12, K.EXPONENTIAL)},
    "cmo": {"cmo": K.cmo(14)}, "mom": {"mom": K.mom(10)},
    "ppo": {"ppo": K.ppo(5, 12), "ppo_wma": K.ppo(5, 12, K.WEIGHTED)},
    "roc": {"roc": K.roc(10)}, "rocr": {"rocr": K.rocr(10)}, "rocp": {"rocp": K.rocp(10)},
    "rocr_100": {"rocr_100": K.rocr_100(10)}, "trix": {"trix": K.trix(5)}, "std": {"std": K.std(10, 2.0)},
    "obv": {"obv": K.obv()}, "cci": {"cci": K.cci(14)}, "trange": {"trange": K.trange()},
    "boll": K.boll(20, 2.0), "keltner": K.keltner(14, 1.5), "donchian": K.donchian(20),
    "natr": {"natr": K.natr(14)}, "atr": {"atr": K.atr(14)}, "macd": K.macd(12, 26, 9), "rsi": {"rsi": K.rsi(14)},
    "plus_dm": {"plus_dm": K.plus_dm(14)}, "minus_dm": {"minus_dm": K.minus_dm(14)},
    "plus_di": {"plus_di": K.plus_di(14)}, "minus_di": {"minus_di": K.minus_di(14)},
    "dx": {"dx": K.dx(14)}, "adx": {"adx": K.adx(14)}, "adxr": {"adxr": K.adxr(14)},
    "willr": {"willr": K.willr(14)}, "ultosc": {"ultosc": K.ultosc(7, 14, 28)},
    "aroon": K.aroon(14), "aroonosc": {"aroonosc": K.aroonosc(14)}, "mfi": {"mfi": K.mfi(14)},
    "ad": {"ad": K.ad()}, "adosc": {"adosc": K.adosc(3, 10)}, "bop": {"bop": K.bop()},
    "stoch": K.stoch(9, 3, 0, 3, 0),
    "ewm_mean": {"ewm_span": A.ewm_mean(c, 2.0 / 13), "ewm_alpha": A.ewm_mean(c, 1.0 / 14)},
    "donchian_shifted": K.channel_breakout(20, 10), "atr_simple": K.simple_range(20),
    "ta_rsi_atr": {"ta_rsi": K.rsi(6), "ta_atr": K.atr(6)},
}
for name, factors in SETS.items():
    add_factors(f"ind_{name}", factors, "week")


KEYS = ["vt_symbol", "datetime"]
add("ind_kama", lambda spark, sf: present(kama(bars(spark, sf, "week"), 10), KEYS, (), ["kama"]), f"""
WITH RECURSIVE {bars_sql("week")},
p AS (SELECT vt_symbol, datetime, close, row_number() OVER s AS i, lag(close, 1) OVER s AS c1, lag(close, 10) OVER s AS c10
      FROM bars WINDOW s AS (PARTITION BY vt_symbol ORDER BY datetime)),
q AS MATERIALIZED (SELECT *, sum(abs(close - c1)) OVER (PARTITION BY vt_symbol ORDER BY datetime
      ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS travel FROM p),
r AS MATERIALIZED (SELECT *, pow((CASE WHEN travel <= close - c10 OR travel = 0 THEN 1.0
      ELSE abs((close - c10) / travel) END) * (2.0/3 - 2.0/31) + 2.0/31, 2) AS speed FROM q),
k AS (SELECT vt_symbol, i, close AS y FROM r WHERE i = 10
      UNION ALL SELECT r.vt_symbol, r.i, k.y + r.speed * (r.close - k.y) FROM k JOIN r
      ON r.vt_symbol = k.vt_symbol AND r.i = k.i + 1),
f AS (SELECT r.vt_symbol, r.datetime, CASE WHEN r.i > 10 THEN k.y END AS kama FROM r LEFT JOIN k USING (vt_symbol, i))
""" + present_sql("f", KEYS, (), ["kama"]))
# the parabolic stop as a recursion over the rows of each instrument
SAR_SQL = f"""
WITH RECURSIVE {bars_sql("week")},
p AS MATERIALIZED (SELECT vt_symbol, datetime, high AS h, low AS l, row_number() OVER s AS i, lag(high) OVER s AS h1, lag(low) OVER s AS l1
      FROM bars WINDOW s AS (PARTITION BY vt_symbol ORDER BY datetime)),
q AS MATERIALIZED (SELECT *, CASE WHEN i = 2 THEN h ELSE h1 END AS bh, CASE WHEN i = 2 THEN l ELSE l1 END AS bl FROM p),
start AS (SELECT vt_symbol, NOT (l1 - l > 0 AND h - h1 < l1 - l) AS up, h, l, h1, l1 FROM p WHERE i = 2),
k AS (SELECT vt_symbol, 1 AS i, up, CASE WHEN up THEN h ELSE l END AS extreme, CASE WHEN up THEN l1 ELSE h1 END AS stop, 0.02::DOUBLE AS speed, NULL::DOUBLE AS shown FROM start
      UNION ALL
      SELECT vt_symbol, i, CASE WHEN flip THEN NOT up ELSE up END, far, CASE
          WHEN flip AND up THEN greatest(shown + pace * (far - shown), bh, h) WHEN flip THEN least(shown + pace * (far - shown), bl, l)
          WHEN up THEN least(shown + pace * (far - shown), bl, l) ELSE greatest(shown + pace * (far - shown), bh, h) END, pace, shown
      FROM (SELECT *, CASE WHEN flip AND up THEN greatest(extreme, bh, h) WHEN flip THEN least(extreme, bl, l) ELSE stop END AS shown,
                CASE WHEN flip THEN 0.02 WHEN further THEN least(speed + 0.02, 0.2) ELSE speed END AS pace,
                CASE WHEN flip AND up OR further AND NOT up THEN l WHEN flip OR further THEN h ELSE extreme END AS far
            FROM (SELECT k.vt_symbol, q.i, up, extreme, stop, speed, h, l, bh, bl, CASE WHEN up THEN l <= stop ELSE h >= stop END AS flip,
                      CASE WHEN up THEN l > stop AND h > extreme ELSE h < stop AND l < extreme END AS further
                  FROM k JOIN q ON q.vt_symbol = k.vt_symbol AND q.i = k.i + 1))),
f AS (SELECT p.vt_symbol, p.datetime, k.shown AS sar FROM p LEFT JOIN k ON k.vt_symbol = p.vt_symbol AND k.i = p.i AND p.i > 1)
"""
add("ind_sar", lambda spark, sf: present(sar(bars(spark, sf, "week"), 0.02, 0.2), KEYS, (), ["sar"]), SAR_SQL + present_sql("f", KEYS, (), ["sar"]))

"""The flagship query: how well a few factors rank the next month's returns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions import algebra as A
from barloom.functions.algebra import field
from barloom.operators import evaluation as E
from barloom.operators.evaluate import evaluate
from barloom.plans.factors158 import factors158
from checks.panels import bars, bars_sql, present, present_sql
from checks.registry import add
from checks.sqltext import factor_sql
from checks.study_queries import ENDS_SQL, ic_sql

LIBRARY = factors158()
FACTORS = {"ma_5": LIBRARY["ma_5"], "std_5": LIBRARY["std_5"], "rsv_5": LIBRARY["rsv_5"], "rank_roc_5": A.cs_rank(LIBRARY["roc_5"])}
LISTED = A.ordinal() - 1.0
NUMBERS = ["ic_mean", "icir", "t_stat", "pct_positive", "spread_mean"]


def factor_report(spark: SparkSession, sf: str) -> DataFrame:
    panel = bars(spark, sf, "week")
    features = evaluate(panel, {**FACTORS, "listed_bars": LISTED}, keep=["close"])
    pool = E.snapshot(features, E.period_ends(panel, "monthly"), None, 0)

    def row(name: str) -> DataFrame:
        ic = E.ic_summary(E.rank_ic(pool, name, min_names=5))
        spread = E.spread_summary(E.spread_series(pool, name, 3), 12).select("spread_mean")
        return ic.crossJoin(spread).withColumn("factor", F.lit(name))

    return present(reduce(DataFrame.unionByName, map(row, FACTORS)), ["factor"], ["n_periods"], NUMBERS)


CTES, LAST = factor_sql("bars", {**FACTORS, "listed_bars": LISTED}, ["vt_symbol", "datetime", "close"])
HEAD = f"""WITH {bars_sql('week')}, {CTES}, {ENDS_SQL}, pool AS MATERIALIZED (SELECT * FROM (SELECT *, CASE WHEN lead(pidx) OVER s = pidx + 1 THEN lead(close) OVER s / close - 1 END AS fwd_ret
  FROM {LAST} JOIN ends USING (datetime) WINDOW s AS (PARTITION BY vt_symbol ORDER BY pidx)) WHERE fwd_ret IS NOT NULL)"""
PARTS = [f"""{ic_sql(n).replace('ic AS', f'ic_{n} AS', 1)}, q_{n} AS (SELECT *, floor((row_number() OVER (PARTITION BY datetime ORDER BY {n}, vt_symbol) - 1) * 3 / count(*) OVER (PARTITION BY datetime)) AS q FROM pool WHERE {n} IS NOT NULL),
  r_{n} AS (SELECT '{n}' AS factor, count(ic) AS n_periods, avg(ic) AS ic_mean, avg(ic) / stddev_samp(ic) AS icir, avg(ic) / stddev_samp(ic) * sqrt(count(ic)) AS t_stat, avg((ic > 0)::INT) AS pct_positive,
  (SELECT avg(s) FROM (SELECT avg(CASE WHEN q = 2 THEN fwd_ret END) - avg(CASE WHEN q = 0 THEN fwd_ret END) AS s FROM q_{n} GROUP BY datetime)) AS spread_mean FROM ic_{n})""" for n in FACTORS]
UNION = " UNION ALL ".join(f"SELECT * FROM r_{n}" for n in FACTORS)
add("flagship_factor_report", factor_report, f"{HEAD}, {', '.join(PARTS)}, r AS ({UNION}) " + present_sql("r", ["factor"], ["n_periods"], NUMBERS))

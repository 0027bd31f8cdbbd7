"""Headline queries at one scale; prints one JSON line.

The bar tables are stored once up front, as a lake would hold them, and every query is timed
from plan construction to a full write into the no-op sink.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from barloom.functions import algebra as A  # noqa: E402
from barloom.functions import indicators as K  # noqa: E402
from barloom.functions.algebra import field  # noqa: E402
from barloom.operators import evaluation as E  # noqa: E402
from barloom.operators import portfolio as B  # noqa: E402
from barloom.operators import sweeps as W  # noqa: E402
from barloom.operators import universe as V  # noqa: E402
from barloom.operators.evaluate import evaluate  # noqa: E402
from barloom.plans import screening as R  # noqa: E402
from barloom.plans.factors101 import factors101  # noqa: E402
from barloom.plans.factors158 import factors158  # noqa: E402
from barloom.session import get_session, materialise  # noqa: E402
from barloom.streaming import bars as Z  # noqa: E402
from checks.lake_queries import ticks  # noqa: E402
from checks.panels import bars, members, universe  # noqa: E402
from checks.screening_queries import master  # noqa: E402


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = get_session("bench", f"local[{cpus}]", cpus)
    spark.sparkContext.setLogLevel("ERROR")
    day, week = materialise(bars(spark, sf), "bars"), materialise(bars(spark, sf, "week"), "bars")
    groups, ok = members(spark, sf), universe(week)
    indicators = {"ema": K.ema(12), "rsi": K.rsi(14), "atr": K.atr(14), "adx": K.adx(14), **K.macd(12, 26, 9),
                  **K.boll(20, 2.0), "cci": K.cci(14), **K.stoch(9, 3, 0, 3, 0), "obv": K.obv()}
    stock = {**E.stock_features(52), **E.lottery_features()}

    def pool():
        return E.snapshot(evaluate(week, stock, keep=["close"]), E.period_ends(week, "monthly"), ok, 52)

    def backtest():
        channels = evaluate(week, K.channel_breakout(20, 10), keep=["close"])
        return B.strategy_metrics(B.long_only_returns(B.breakout_signals(channels), 20, 0.001))

    def status():
        listed = V.daily_universe(master(spark, sf), week.select(F.col("datetime").alias("trade_date")), week)
        return V.daily_status(listed, week)

    config = R.ScreeningConfig(rebalance="monthly", min_bars=52, high_window=52)
    queries = {
        "bars_from_lineitem": lambda: bars(spark, sf),
        "factors_158": lambda: evaluate(day, factors158(), keep=[]),
        "factors_101": lambda: evaluate(week, factors101(), keep=[]),
        "cross_section": lambda: evaluate(day, {"r": A.cs_rank(field("close")), "z": A.cs_scale(field("volume"))}, keep=[]),
        "indicators": lambda: evaluate(day, indicators, keep=[]),
        "rank_ic": lambda: E.ic_summary(E.rank_ic(pool(), "ret_20", min_names=5)),
        "screening": lambda: R.run_screening(week, groups, ok, config)["selection"],
        "breakout_backtest": backtest,
        "param_sweep": lambda: W.breakout_sweep(week, W.grid(spark, {"entry": (10.0, 20.0, 5.0), "exit": (5.0, 10.0, 5.0)}), 20, 0.001),
        "universe_status": status,
        "tick_bars": lambda: Z.tick_bars(ticks(spark, sf)),
    }
    only = sys.argv[1:]
    times = {}
    for name, build in queries.items():
        if only and name not in only:
            continue
        start = time.time()
        build().write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 2)
        print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline queries, total wall clock", "value": round(sum(times.values()), 2), "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf.rstrip("/"))}))


if __name__ == "__main__":
    main()

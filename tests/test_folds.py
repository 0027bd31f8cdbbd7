import glob

import numpy as np
import pandas as pd
import pytest

from barloom.operators.folds import kama, sar
from barloom.session import work_dir
from barloom.streaming.state import TODAY_EXCHANGES, roll_up


@pytest.fixture(scope="module")
def walks(spark):
    rng = np.random.default_rng(5)
    rows = []
    for s in "ABC":
        c = 50 + np.cumsum(rng.normal(size=200))
        spread = np.abs(rng.normal(size=200))
        rows += [(pd.Timestamp("2024-01-01") + pd.Timedelta(days=d), s, float(c[d] + spread[d]), float(c[d] - spread[d]), float(c[d])) for d in range(200)]
    pdf = pd.DataFrame(rows, columns=["datetime", "vt_symbol", "high", "low", "close"])
    return spark.createDataFrame(pdf), pdf


def test_adaptive_average(walks):
    df, pdf = walks
    got = kama(df, 10).toPandas().sort_values(["vt_symbol", "datetime"]).kama.to_numpy()
    want = []
    for _, g in pdf.groupby("vt_symbol"):
        c, level = g.close.to_numpy(), None
        for t in range(len(c)):
            if t < 10:
                want.append(np.nan)
                level = c[t]
                continue
            net, travel = c[t] - c[t - 10], np.abs(np.diff(c[t - 10: t + 1])).sum()
            ratio = 1.0 if travel <= net or travel == 0 else abs(net / travel)
            level += (ratio * (2 / 3 - 2 / 31) + 2 / 31) ** 2 * (c[t] - level)
            want.append(level)
    assert np.allclose(got, want, equal_nan=True)


def plain_sar(h, lo, a, top):
    out, long = [None], not (lo[0] - lo[1] > 0 and h[1] - h[0] < lo[0] - lo[1])
    ep, stop, af = (h[1], lo[0], a) if long else (lo[1], h[0], a)
    for t in range(1, len(h)):
        p = max(t - 1, 1)
        if long and lo[t] <= stop:
            long, stop = False, max(ep, h[p], h[t])
            out.append(stop)
            af, ep = a, lo[t]
            stop = max(stop + af * (ep - stop), h[p], h[t])
        elif long:
            out.append(stop)
            if h[t] > ep:
                ep, af = h[t], min(af + a, top)
            stop = min(stop + af * (ep - stop), lo[p], lo[t])
        elif h[t] >= stop:
            long, stop = True, min(ep, lo[p], lo[t])
            out.append(stop)
            af, ep = a, h[t]
            stop = min(stop + af * (ep - stop), lo[p], lo[t])
        else:
            out.append(stop)
            if lo[t] < ep:
                ep, af = lo[t], min(af + a, top)
            stop = max(stop + af * (ep - stop), h[p], h[t])
    return out


def test_parabolic_stop(walks):
    df, pdf = walks
    got = sar(df, 0.02, 0.2).toPandas().sort_values(["vt_symbol", "datetime"]).sar
    want = [v for _, g in pdf.groupby("vt_symbol") for v in plain_sar(g.high.tolist(), g.low.tolist(), 0.02, 0.2)]
    assert np.allclose(got.astype(float), np.array(want, dtype=float), equal_nan=True)


def test_position_roll_up(spark):
    rng = np.random.default_rng(9)
    rows = [(f"S{rng.integers(3)}", i, ["long", "short"][rng.integers(2)], ["open", "open", "close", "close_today", "close_yesterday"][rng.integers(5)],
             ["SHFE", "CFFEX"][rng.integers(2)], float(rng.integers(1, 9))) for i in range(300)]
    df = spark.createDataFrame(rows, "vt_symbol string, seq long, direction string, offset string, exchange string, volume double")
    got = {r["seq"]: (r["long_yd"], r["long_td"], r["short_yd"], r["short_td"]) for r in roll_up(df, ["seq"]).collect()}
    state = {}
    for s, i, d, off, ex, v in rows:
        p = state.setdefault(s, {"long": [0.0, 0.0], "short": [0.0, 0.0]})
        if off == "open":
            p[d][1] += v
        else:
            q = p["short" if d == "long" else "long"]
            if off == "close_today":
                q[1] -= v
            elif off == "close_yesterday" or ex in TODAY_EXCHANGES:
                q[0] -= v
            else:
                q[1] -= v
                if q[1] < 0:
                    q[0], q[1] = q[0] + q[1], 0.0
        assert got[i] == (*p["long"], *p["short"])


def test_split_position_roll_up(spark):
    rng = np.random.default_rng(11)
    rows = [(f"S{rng.integers(3)}", (pd.Timestamp("2024-01-01") + pd.Timedelta(hours=i // 2)).to_pydatetime(), i, ["long", "short"][rng.integers(2)], ["open", "open", "close", "close_today", "close_yesterday"][rng.integers(5)],
             ["SHFE", "CFFEX"][rng.integers(2)], float(rng.integers(1, 9))) for i in range(300)]
    df = spark.createDataFrame(rows, "vt_symbol string, datetime timestamp, seq long, direction string, offset string, exchange string, volume double")
    whole = roll_up(df, ["datetime", "seq"]).collect()
    tables = set(glob.glob(f"{work_dir(spark).removeprefix('file:')}/history-*"))
    split = roll_up(df, ["datetime", "seq"], long_history=16)
    assert sorted(split.collect()) == sorted(whole)
    assert len(set(glob.glob(f"{work_dir(spark).removeprefix('file:')}/history-*")) - tables) == 1  # the running sums' table went

import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.functions import algebra as A
from barloom.functions import indicators as K
from barloom.functions.algebra import field
from barloom.operators import evaluate as E
from barloom.operators.evaluate import Layers, evaluate
from barloom.plans.factors101 import factors101
from barloom.plans.factors158 import factors158
from barloom.session import work_dir

x, y = field("x"), field("y")


@pytest.fixture(scope="module")
def tiny(frame):
    return frame("datetime date, vt_symbol string, x double, y double", [
        (f"2024-01-0{i + 1}", "A", float(a), float(b)) for i, (a, b) in enumerate(zip([1, 3, 2, 4], [2, 2, 3, 1]))])


@pytest.fixture(scope="module")
def noisy(spark):
    rng = np.random.default_rng(3)
    rows = []
    for s in range(7):
        level = 10.0
        for d in range(60):
            level *= 1 + rng.normal() / 50
            rows.append((pd.Timestamp("2024-01-01") + pd.Timedelta(days=d), f"S{s}", level, float(rng.integers(0, 6)) if d % 11 else None))
    return spark.createDataFrame(pd.DataFrame(rows, columns=["datetime", "vt_symbol", "x", "y"]).astype({"y": "float64"})).replace(float("nan"), None)


def test_arithmetic_and_delay(tiny, column):
    out = evaluate(tiny, {"a": x + y * 2, "d": A.ts_delay(x, 1), "f": A.ts_delay(x, -1), "g": x > y})
    assert column(out, "a") == [5, 7, 8, 6]
    assert column(out, "d") == [None, 1, 3, 2]
    assert column(out, "f") == [3, 2, 4, None]
    assert column(out, "g") == [0, 1, 0, 1]


def test_full_windows_and_partial_windows(tiny, column):
    out = evaluate(tiny, {"s": A.ts_sum(x, 3), "m": A.ts_mean(x, 3), "r": A.ts_rank(x, 3), "i": A.ts_argmax(x, 3),
                          "w": A.ts_decay_linear(x, 3), "p": A.ts_product(x, 2), "q": A.ts_quantile(x, 3, 0.5)})
    assert column(out, "s") == [None, None, 6, 9]
    assert column(out, "m") == [1, 2, 2, 3]
    assert column(out, "r") == [None, None, 4 / 6, 1.0]
    assert column(out, "i") == [None, None, 2, 3]
    assert column(out, "w") == pytest.approx([None, None, (3 * 1 + 2 * 3 + 2) / 6, (3 * 3 + 2 * 2 + 4) / 6])
    assert column(out, "p") == [None, 3, 6, 8]
    assert column(out, "q") == [None, None, 2, 3]


def test_division_by_zero_and_sign_preserving_powers(tiny, column):
    z = x - x
    out = evaluate(tiny, {"d": x / z, "p": A.pow1(x - 3, 2.0), "q": A.pow2(x - 3, field("y")), "s": A.sign(A.ts_delay(x, 1))})
    assert column(out, "d") == [None] * 4
    assert column(out, "p") == [-4, 0, -1, 1]
    assert column(out, "q") == [-4, 0, -1, 1]
    assert column(out, "s") == [0, 1, 1, 1]


MIX = {"a": A.cs_rank(A.ts_mean(x, 5)), "b": A.ts_corr(A.cs_rank(y), x, 6), "c": A.ts_argmin(y, 4), "d": A.cs_scale(x),
       "e": A.ts_rank(A.cs_rank(x), 7), "f": A.ts_delay(A.ts_max(x, 3), -2), "g": A.cs_std(y), "h": A.cs_rank(y),
       "i": A.cs_rank(x), "j": A.cs_rank(A.ts_delta(x, 2)), "k": A.ts_sum(y, 9)}


def same(a, b):
    keys = ["vt_symbol", "datetime"]
    pd.testing.assert_frame_equal(a.toPandas().sort_values(keys, ignore_index=True), b.toPandas().sort_values(keys, ignore_index=True))


def test_cut_histories_and_wide_dates_give_the_same_result(noisy):
    plain = evaluate(noisy, MIX, keep=[])
    same(plain, evaluate(noisy, MIX, keep=[], long_history=12))
    same(plain, evaluate(noisy, MIX, keep=[], wide_date=3))
    same(plain, evaluate(noisy, MIX, keep=[], long_history=20, wide_date=2))


some_x = A.where(x > y, x, None)
RUNNING = {"a": A.ema(x, 5), "b": A.wilder(some_x, 4), "c": A.run_sum(some_x), "d": A.run_max(x), "e": A.run_count(some_x), "f": A.first_value(some_x),
           "g": A.fill_forward(some_x), "h": A.ewm_mean(x, 0.2), "i": A.cs_rank(A.ema(x, 3)), "j": A.ts_mean(A.ema(A.ts_delta(y, 2), 3), 4),
           "k": A.ts_corr(A.cs_rank(x), A.ema(y, 3), 6), "l": A.last_before(some_x), "m": A.ts_count(some_x, 5), "n": A.ema(A.ema(x, 4), 4), "o": A.run_product(1.0 + x / 1e4)}


@pytest.mark.parametrize("limit", [8])
def test_running_terms_carry_over_the_pieces_of_a_history(noisy, limit):
    keys = ["vt_symbol", "datetime"]
    plain, cut = (evaluate(noisy, RUNNING, keep=[], long_history=n).toPandas().sort_values(keys, ignore_index=True) for n in (10**6, limit))
    assert plain["a"].notna().sum() > 50
    pd.testing.assert_frame_equal(plain, cut, rtol=1e-9)


def test_input_order_does_not_matter(noisy):
    same(evaluate(noisy, MIX, keep=[]), evaluate(noisy.orderBy("x"), MIX, keep=[]))


def test_hot_date_ties_are_ranked_exactly(spark):
    pdf = pd.DataFrame({"datetime": pd.Timestamp("2024-01-01"), "vt_symbol": [f"S{i}" for i in range(3000)],
                        "x": [1.0 if i % 3 == 0 else float(i % 500) for i in range(3000)]})
    out = evaluate(spark.createDataFrame(pdf), {"r": A.cs_rank(x)}, wide_date=100).toPandas()
    expected = pdf.set_index("vt_symbol").x.rank()
    assert np.allclose(out.set_index("vt_symbol").r.sort_index(), expected.sort_index())


def test_exponential_averages_match_a_loop(noisy):
    out = evaluate(noisy, {"e": A.ema(x, 5), "w": A.wilder(x, 14), "m": A.ewm_mean(x, 0.3)}, keep=["x"]).toPandas()
    for _, g in out.sort_values("datetime").groupby("vt_symbol"):
        for name, n, alpha in (("e", 5, 2 / 6), ("w", 14, 1 / 14)):
            level = g.x.iloc[:n].mean()
            expected = [np.nan] * (n - 1) + [level]
            for v in g.x.iloc[n:]:
                level += alpha * (v - level)
                expected.append(level)
            assert np.allclose(g[name], expected, equal_nan=True, rtol=1e-12)
        assert np.allclose(g.m, g.x.ewm(alpha=0.3).mean(), rtol=1e-12)


def test_shared_terms_and_few_exchanges(noisy):
    close = {n: field(n) for n in ("open", "high", "low", "close", "volume", "vwap")}
    assert len(factors158()) == 159 and len(factors101()) == 83 and close
    assert max(k[0] for k in Layers(factors158()).groups) == 0
    panel = noisy.selectExpr("datetime", "vt_symbol", "x open", "x high", "x low", "x close", "y volume", "x vwap")
    out = evaluate(panel, factors158(), keep=[], sizes=(60, 7))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_all_101_factors_on_an_extreme_panel(spark):
    rng = np.random.default_rng(42)
    rows = []
    for s in range(12):
        close = 10 * np.cumprod(1 + rng.normal(size=80) / 50)
        for d in range(80):
            c = 1e-10 if d == 60 else float(close[d])
            rows.append((pd.Timestamp("2024-01-01") + pd.Timedelta(days=d), f"S{s}", c * 0.99, c * 1.02, c * 0.97, None if d == 50 else c,
                         0.0 if d == 70 else float(rng.integers(1, 1000)), c * 1.001))
    pdf = pd.DataFrame(rows, columns=["datetime", "vt_symbol", "open", "high", "low", "close", "volume", "vwap"])
    df = spark.createDataFrame(pdf).replace(float("nan"), None)
    out = evaluate(df, factors101(with_label=False), keep=[]).toPandas()
    assert len(out) == len(rows) and out.shape[1] == 84


def test_channels_and_true_range(frame, column):
    bars = frame("datetime date, vt_symbol string, open double, high double, low double, close double, volume double", [
        (f"2024-01-0{i + 1}", "A", c, c + 1, c - 1, c, 1.0) for i, c in enumerate([10.0, 11.0, 12.0, 13.0, 14.0])])
    out = evaluate(bars, {**K.channel_breakout(2, 2), **K.simple_range(2)})
    assert column(out, "entry_channel") == [None, None, 12, 13, 14]
    assert column(out, "exit_channel") == [None, None, 9, 10, 11]
    assert column(out, "true_range") == [2] * 5
    assert column(out, "atr_simple") == [None, 2, 2, 2, 2]


def test_rank_ic_on_wide_dates(noisy):
    from barloom.operators.evaluation import rank_ic

    pool = evaluate(noisy, {"f": A.ts_delta(x, 3), "fwd_ret": A.ts_delay(x, -1) / x - 1})
    plain = rank_ic(pool, "f", min_names=3).toPandas().sort_values("datetime", ignore_index=True)
    import barloom.operators.evaluate as module
    wide = rank_ic(pool, "f", min_names=3, widest=module.WIDE_DATE + 1).toPandas().sort_values("datetime", ignore_index=True)
    pd.testing.assert_frame_equal(plain, wide)
    expected = pool.toPandas().dropna(subset=["f", "fwd_ret"]).groupby("datetime")[["f", "fwd_ret"]].apply(lambda g: g.f.rank().corr(g.fwd_ret.rank()))
    assert np.allclose(plain.ic, expected.sort_index())


def test_repeated_keys_rank_alike_at_every_count_of_ranks(frame):
    from barloom.operators.evaluate import evaluate

    df = frame("datetime date, vt_symbol string, close double, volume double",
               [("2024-01-01", "A", 1.0, 4.0), ("2024-01-01", "A", 3.0, 4.0), ("2024-01-01", "B", 2.0, 1.0), ("2024-01-01", "C", 2.0, 2.0), ("2024-01-01", "C", 2.0, 2.0)])
    terms = {f"r{k}": A.cs_rank(A.field(c) * float(m)) for k, (c, m) in enumerate((("close", 1), ("close", 2), ("volume", 1), ("volume", 3)))}
    few, many = (sorted(str((r["close"], r["r0"], r["r1"], r["r2"])) for r in evaluate(df, dict(list(terms.items())[:n]), keep=["close"]).collect()) for n in (3, 4))
    assert few == many and len(many) == 5


def test_user_operator_per_date_on_both_paths(noisy):
    with pytest.raises(ValueError, match="grouped"):
        A.register("cs_no_form", A.DATE, 1, lambda w, x: F.max(x).over(w.day))
    assert "cs_no_form" not in A.OPERATORS
    A.register_functions({"cs_top_share": {"kind": A.DATE, "arity": 1, "build": lambda w, x, k: F.max(x).over(w.day) / k, "grouped": lambda x, k: F.max(x) / k}})
    terms = {"u": A.call("cs_top_share", x, 4.0), "v": A.ts_mean(A.call("cs_top_share", A.cs_rank(x), 2.0), 3), "m": A.cs_mean(x)}
    same(evaluate(noisy, terms, keep=[]), evaluate(noisy, terms, keep=[], wide_date=3))


def test_correlation_of_values_a_last_bit_apart(frame, column):
    """A mean that rounds to a value: never beyond what the deviations of the same window allow."""
    rows = [("A", "2024-01-01", 1.0, 100.0), ("A", "2024-01-02", 2.0, np.nextafter(100.0, 0)), ("B", "2024-01-01", 1.0, 100.0), ("B", "2024-01-02", 2.0, np.nextafter(100.0, 200))]
    df = frame("vt_symbol string, datetime date, a double, b double", [(s, d, a, float(b)) for s, d, a, b in rows])
    out = evaluate(df, {"r": A.ts_corr(field("a"), field("b"), 5), "q": A.ts_corr(field("b"), field("a"), 5)}, keep=[])
    assert all(v is None or abs(v) <= 1.5 for n in ("r", "q") for v in column(out, n))


def test_long_history_leaves_one_table(spark, frame, column):
    """Each layer's table goes once the next one is written, and block sums carry over pieces."""
    df = frame("vt_symbol string, datetime date, x double", [("A", f"20{10 + k // 12:02d}-{k % 12 + 1:02d}-01", float(k % 7)) for k in range(60)])
    want = column(evaluate(df, {"e": A.ema(A.ema(field("x"), 3), 4)}, keep=[]), "e")

    def tables():
        return {n for n in os.listdir(work_dir(spark)) if n.startswith("history-")}
    before = tables()
    out = evaluate(df, {"e": A.ema(A.ema(field("x"), 3), 4)}, keep=[], sizes=(10**9, 1), long_history=10)
    assert len(tables() - before) == 1
    got = column(out, "e")
    assert [v is None for v in got] == [v is None for v in want] and np.allclose([v for v in got if v is not None], [v for v in want if v is not None])


def test_long_history_stores_few_columns_and_no_old_exchanges(spark, noisy, monkeypatch):
    """Row-wise columns are made again instead of stored, and a layer's exchanges leave no files once its table is written."""
    widths, rows_of = [], E.carried
    monkeypatch.setattr(E, "carried", lambda rows, *more: (widths.append(len(rows.columns)), rows_of(rows, *more))[1])
    terms = {"e": A.ema(A.ema(x, 3), 4), "h": A.ewm_mean(x, 0.2)}

    def files():
        return spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().size()
    before = files()
    out = evaluate(noisy, terms, keep=[], sizes=(10**9, 1), long_history=16)
    assert files() <= before and max(widths) <= 12
    keys = ["vt_symbol", "datetime"]
    want = evaluate(noisy, terms, keep=[]).toPandas().sort_values(keys, ignore_index=True)
    pd.testing.assert_frame_equal(out.toPandas().sort_values(keys, ignore_index=True), want, rtol=1e-9)


def test_averages_of_short_histories_sort_once(spark, column):
    """Where an instrument's weights fit one block, its rows are not sorted by block; longer ones keep their blocks."""
    alpha = 2.0 / 3
    most = A.one_block(alpha)
    for rows, sorts in ((most, 1), (most + 1, 3)):
        df = spark.range(rows).selectExpr("'A' AS vt_symbol", "date_add(date'2020-01-01', int(id)) AS datetime", "if(id % 5 = 3, null, 1e150 * (1 + id % 7)) AS x").repartition(2)
        out = evaluate(df, {"e": A.smooth(field("x"), alpha, 1, False)}, keep=[])
        assert out._jdf.queryExecution().sparkPlan().toString().count("Sort [") + out._jdf.queryExecution().executedPlan().toString().count("Sort [") == sorts
        value, want = None, []
        for k in range(rows):
            if k % 5 != 3:
                now = 1e150 * (1 + k % 7)
                value = now if value is None else value + alpha * (now - value)
            want.append(value)
        assert np.allclose(column(out, "e"), want, rtol=1e-12, atol=0)


def test_ts_rank_collects_its_window_once(tiny, column):
    out = evaluate(tiny, {"r": A.ts_rank(x, 3)}, keep=[])
    assert out._jdf.queryExecution().sparkPlan().toString().count("collect_list(") == 1
    assert column(out, "r") == [None, None, 4 / 6, 1.0]

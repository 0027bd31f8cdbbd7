"""Rolled windows: the same bits as Spark's frames, over batches smaller than windows and instruments."""

import datetime as dt

import numpy as np
import pytest

from barloom.functions import algebra as A
from barloom.functions.algebra import field
from barloom.operators import evaluate as E
from checks import panels

x, y, k = field("x"), field("y"), field("k")
LONG = 12
FACTORS = {
    "cov": A.call("win_cov", x, y, LONG), "std": A.ts_std(x, LONG), "corr": A.ts_corr(x, y, LONG), "slope": A.ts_slope(x, LONG),
    "plain_slope": A.call("win_slope", x, LONG), "rsquare": A.ts_rsquare(y, 5), "resi": A.ts_resi(y, 5), "rank": A.ts_rank(y, 9),
    "high": A.ts_argmax(y, LONG), "low": A.ts_argmin(y, LONG), "since_high": A.ts_since_high(x, 4), "since_low": A.ts_since_low(y, 4),
    "any_high": A.call("win_argmax", y, 4), "any_low": A.call("win_last_low", y, 4), "std_int": A.ts_std(k, 6),
    # terms that read rolled ones: sums, means, extremes, delays and counts follow, looking ahead needs a new exchange
    "sum": A.ts_sum(A.ts_std(x, LONG), 5), "mean": A.ts_mean(A.ts_rank(y, 9), 3), "top": A.ts_max(A.ts_std(x, 3), 4),
    "bottom": A.ts_min(A.ts_corr(x, y, 3), 4), "late": A.ts_delay(A.ts_std(x, LONG), 3), "ahead": A.ts_delay(A.ts_std(x, LONG), -2),
    "flags": A.ts_sum(A.ts_std(x, 3) > A.ts_std(y, 3), 4), "ranked": A.ts_corr(A.cs_rank(A.ts_std(x, 4)), A.cs_rank(y), 5),
    "decay": A.ts_decay_linear(A.ts_rank(x, 5), 6),
}


@pytest.fixture(scope="module")
def panel(spark):
    rng = np.random.default_rng(5)
    rows = []
    for s, days in enumerate((70, 1, 3, 40, 11, 12)):
        for d in range(days):
            a = None if s == 3 and d % 7 == 2 else float(rng.normal() * 10.0 ** rng.integers(-3, 4))
            # few values, so that windows have ties and are constant
            b = None if rng.random() < 0.05 else float(rng.integers(0, 3)) if s != 4 else 0.1 + 1e-16 * float(rng.integers(0, 3))
            rows.append((f"S{s}", dt.date(2024, 1, 1) + dt.timedelta(d), a, b, int(rng.integers(0, 4))))
    return spark.createDataFrame(rows, "vt_symbol string, datetime date, x double, y double, k int")


def _rows(spark, df, monkeypatch, limit, **more):
    monkeypatch.setattr(E, "ROLLED_ROWS", limit)
    out = E.evaluate(df, FACTORS, keep=[], **more)
    text = out._jdf.queryExecution().optimizedPlan().toString()
    return {(r["vt_symbol"], r["datetime"]): tuple(map(repr, r)) for r in out.collect()}, "MapInArrow" in text, out.dtypes


@pytest.mark.parametrize("batch", [5, 10_000])
@pytest.mark.parametrize("more", [{}, {"long_history": 30}])
def test_rolled_windows_equal_frames(spark, panel, monkeypatch, batch, more):
    want, arrow, kinds = _rows(spark, panel, monkeypatch, 10**9, **more)
    assert not arrow
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got, arrow, same = _rows(spark, panel, monkeypatch, 1, **more)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert arrow and kinds == same
    assert got == want


def test_costly_windows_of_the_library_are_rolled(spark):
    from checks.factor_queries import LIBRARY

    bars = panels.bars(spark, "/root/testdata/sf0.001")
    for group, rolled in (("cord", True), ("beta", True), ("imxd", True), ("roc", False)):
        out = E.evaluate(bars, {n: f for n, f in LIBRARY.items() if n.startswith(f"{group}_")}, keep=[])
        assert ("MapInArrow" in out._jdf.queryExecution().optimizedPlan().toString()) == rolled


def test_bars_of_more_than_a_task_keep_their_partitions(spark, monkeypatch):
    monkeypatch.setattr(panels, "LINES_OF_TASK", 2000)
    assert panels.bars(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() == 4


def test_stock_features_take_their_sizes_from_the_lines(spark, monkeypatch):
    from checks import study_queries

    def measure(*_):
        raise AssertionError("bars were aggregated for their sizes alone")

    monkeypatch.setattr(E, "measure", measure)
    assert study_queries.stock(spark, "/root/testdata/sf0.001").count() > 0

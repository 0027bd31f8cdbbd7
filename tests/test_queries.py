"""Registered queries: shape of the contract, and a sample compared with SQL at the smallest scale."""

import duckdb
import pytest

import __spark_entry__ as entry
from checks import registry
from checks.compare import TABLES, differ

SF = "/root/testdata/sf0.001"
SAMPLE = ("ts_rank ts_decay_linear cs_rank f158_corr f101_alpha29 ind_macd ind_adx ind_kama dataset_prepare eval_factor_health eval_rotation "
          "screen_stocks_none screen_stocks_select universe_status quality_gate reconcile_rows contract_pnl daily_statistics value_positions "
          "param_sweep asof_bucketed stream_tick_bars bars_session_day store_save_load_bars lake_manifest_versions wide_date_rank").split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def test_contract():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(registry.QUERIES) - set(registry.SQL) <= {"model_trees_predict"}


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns and df.count() > 0


@pytest.mark.parametrize("name", SAMPLE)
def test_matches_sql(spark, con, name):
    got = entry.queries()[name](spark, SF).toPandas()
    assert differ(got, con.execute(entry.oracle_sql()[name]).fetchdf()) == ""


@pytest.mark.parametrize("name", ["group_pivot_close_all", "no_signal_month_ends_all", "rebalance_periods_all"])
def test_whole_tables_match_sql(spark, con, name):
    got = entry.queries()[name](spark, SF).toPandas()
    assert differ(got, con.execute(entry.oracle_sql()[name]).fetchdf()) == ""
    if name == "group_pivot_close_all":
        assert set(got["vt_symbol"]) == {f"{k}.SUP" for (k,) in con.execute("SELECT DISTINCT l_suppkey FROM lineitem").fetchall()}

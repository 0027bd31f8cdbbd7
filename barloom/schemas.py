"""Fixed schemas of published tables."""

from __future__ import annotations

from pyspark.sql import types as T


def struct(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)


BARS = struct("symbol string, exchange string, datetime timestamp_ntz, interval string, open double, high double, "
              "low double, close double, volume double, turnover double, open_interest double")
TICKS = struct("symbol string, exchange string, datetime timestamp_ntz, last_price double, volume double, "
               "turnover double, open_interest double, high_price double, low_price double, "
               "book array<struct<bid_price:double,bid_volume:double,ask_price:double,ask_volume:double>>")
COMPONENTS = struct("index_symbol string, trade_date date, vt_symbol string")
SETTINGS = struct("vt_symbol string, long_rate double, short_rate double, size double, pricetick double")
SIGNALS = struct("datetime date, vt_symbol string, signal double")
TRADES = struct("signal_date date, planned_date date, executed_date date, vt_symbol string, industry string, side string, "
                "status string, reason string, exec_price_raw double, exec_price_adj double, shares bigint, "
                "gross_amount double, commission double, stamp_tax double, slippage_cost double, defer_days int")
POSITIONS = struct("datetime date, vt_symbol string, industry string, shares bigint, cost_amount double, "
                   "market_value double, weight double, is_frozen boolean")
CHECKS = struct("name string, dataset string, severity string, status string, observed string, expected string")
REPORTS = struct("vt_symbol string, report_type string, report_date string, announce_date string, payload_json string")
VERSIONS = struct("version string, dataset string, rows bigint, columns int, date_min date, date_max date, "
                  "symbols bigint, bytes bigint, content_hash string")
ORDERS = struct("id string, symbol string, side string, quantity double, price double, status string, time string, "
                "traded_quantity double, message string")


def empty(spark, schema: T.StructType):
    """An empty table of a published schema, as the start of a union."""
    return spark.createDataFrame([], schema)

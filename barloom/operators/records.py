"""Broker records as columns: positions, orders and trades whose fields come under several names and as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.scalars import number_of, order_status, side_of


def _given(df: DataFrame, *names: str) -> list[Column]:
    return [F.col(n) for n in names if n in df.columns]


def text_of(df: DataFrame, *names: str) -> Column:
    """The first of the named fields that holds any text; empty if there is none."""
    return F.coalesce(*[F.when(c.cast("string") != "", c.cast("string")) for c in _given(df, *names)], F.lit(""))


def real_of(df: DataFrame, *names: str) -> Column:
    """The first readable number of the named fields; 0 if there is none."""
    return F.coalesce(*[number_of(c.cast("string")) for c in _given(df, *names)], F.lit(0.0))


def whole_of(df: DataFrame, *names: str) -> Column:
    """The same as a whole number, towards zero."""
    return real_of(df, *names).cast("long")


def positions(records: DataFrame, order: str) -> DataFrame:
    """One row a symbol, by its last record in ``order``; records without a symbol are passed over."""
    df = records.withColumn("_symbol", F.upper(text_of(records, "symbol"))).where("_symbol <> ''")
    price, profit = real_of(df, "avg_price", "cost_price"), real_of(df, "profit", "position_profit")
    quantity, available = whole_of(df, "quantity"), whole_of(df, "available_quantity", "quantity")
    found = F.struct(quantity.alias("quantity"), available.alias("available_quantity"), F.greatest(quantity - available, F.lit(0)).alias("frozen_quantity"),
                     price.alias("avg_price"), price.alias("cost_price"), real_of(df, "market_value").alias("market_value"), profit.alias("profit"), profit.alias("position_profit"))
    return df.groupBy(F.col("_symbol").alias("symbol")).agg(F.max_by(found, F.struct(F.col(order), found)).alias("_r")).select("symbol", "_r.*")


def orders(records: DataFrame) -> DataFrame:
    quantity, traded = whole_of(records, "quantity"), whole_of(records, "traded_quantity")
    return records.select(
        text_of(records, "id", "order_id").alias("id"), text_of(records, "sysid").alias("sysid"), F.upper(text_of(records, "symbol")).alias("symbol"),
        side_of(text_of(records, "side", "action")).alias("side"), quantity.alias("quantity"), real_of(records, "price").alias("price"),
        order_status(text_of(records, "status"), quantity, traded).alias("status"), text_of(records, "time").alias("time"), traded.alias("traded_quantity"),
        text_of(records, "message").alias("message"))


def trades(records: DataFrame) -> DataFrame:
    name = text_of(records, "trade_id", "id", "order_id")
    return records.select(
        name.alias("id"), name.alias("trade_id"), text_of(records, "order_id").alias("order_id"), F.upper(text_of(records, "symbol")).alias("symbol"),
        side_of(text_of(records, "side", "action")).alias("side"), whole_of(records, "quantity").alias("quantity"), real_of(records, "price").alias("price"),
        real_of(records, "amount").alias("amount"), text_of(records, "time", "timestamp").alias("time"))

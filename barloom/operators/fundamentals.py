"""Point-in-time factors from financial reports: known only from their announcement on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barloom.functions.scalars import compact_date, json_number
from barloom.operators.joins import asof


def report_field(reports: DataFrame, report_type: str, payload_name: str, name: str) -> DataFrame:
    """One payload field of one report type, per (symbol, report date)."""
    return reports.where(F.col("report_type") == report_type).select(
        "vt_symbol", "report_date", "announce_date", json_number(F.col("payload_json"), payload_name).alias(name))


def pit_factors(profit: DataFrame, cash: DataFrame, assets: DataFrame, ratios: DataFrame, quarters: int = 4,
                include_current: bool = True) -> DataFrame:
    """Surprise, accruals, return on equity and profit growth by announcement date.

    Surprise is the profit against the mean and deviation of ``quarters`` reports; the current
    one is part of them unless ``include_current`` is off.
    """
    on = ["vt_symbol", "report_date"]
    base = profit.join(cash.select(*on, "operating_cf"), on, "left").join(
        assets.select(*on, "total_assets"), on, "left").join(
        ratios.withColumn("report_date", F.replace("report_date", F.lit("-"), F.lit(""))), on, "left")
    base = base.withColumn("announce_date", compact_date(F.col("announce_date"))).where("announce_date IS NOT NULL")
    order = Window.partitionBy("vt_symbol").orderBy("announce_date", "report_date")
    w = order.rowsBetween(1 - quarters, 0) if include_current else order.rowsBetween(-quarters, -1)
    full = F.count("net_profit").over(w) == quarters
    mean, dev = F.avg("net_profit").over(w), F.stddev_samp("net_profit").over(w)
    base = base.withColumns({"_m": F.when(full, mean), "_d": F.when(full, dev)})
    return base.select(
        "vt_symbol", "report_date", "announce_date",
        F.when(F.col("_d") > 0, (F.col("net_profit") - F.col("_m")) / F.col("_d")).alias("sue"), "roe", "ni_yoy",
        F.when(F.col("total_assets") > 0, (F.col("net_profit") - F.col("operating_cf")) / F.col("total_assets")).alias("acc"))


def attach_to_dates(rows: DataFrame, factors: DataFrame, columns: list[str], strict: bool = False) -> DataFrame:
    """Latest announced values at each (date, symbol) row."""
    return asof(rows, factors, ["vt_symbol"], "datetime", "announce_date", ["announce_date", *columns], strict)


def book_to_market(rows: DataFrame, books: DataFrame, announcements: DataFrame) -> DataFrame:
    """Price over book value per share, positive books only, known by announcement date."""
    on = ["vt_symbol", "report_date"]
    ann = announcements.select(*on, compact_date(F.col("announce_date")).alias("announce_date")).dropDuplicates(on)
    b = books.withColumn("report_date", F.replace("report_date", F.lit("-"), F.lit(""))).join(ann, on).where(
        (F.col("bvps") > 0) & F.col("announce_date").isNotNull())
    out = attach_to_dates(rows, b, ["bvps"])
    return out.withColumn("pb", F.try_divide("close", "bvps"))

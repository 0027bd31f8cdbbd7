"""Row-level helpers that are not part of the factor algebra."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _ticks(x: Column, tick: float) -> Column:
    return F.try_divide(x.cast("decimal(20,8)"), F.lit(tick).cast("decimal(20,8)"))


def round_to(x: Column, tick: float) -> Column:
    """Nearest multiple of the tick in decimals, halves to even."""
    return (F.bround(_ticks(x, tick), 0) * F.lit(tick).cast("decimal(20,8)")).cast("double")


def nearest_to(x: Column, tick: float) -> Column:
    """Nearest multiple of the tick in doubles, halves away from zero."""
    y = x * F.lit(1.0 / tick) if tick < 1 else x / F.lit(float(tick))
    down = F.floor(F.abs(y)).cast("double")
    whole = F.signum(y) * (down + F.when(F.abs(y) - down >= 0.5, 1.0).otherwise(0.0))
    return whole / F.lit(1.0 / tick) if tick < 1 else whole * F.lit(float(tick))


def floor_to(x: Column, tick: float) -> Column:
    return (F.floor(_ticks(x, tick)) * F.lit(tick).cast("decimal(20,8)")).cast("double")


def ceil_to(x: Column, tick: float) -> Column:
    return (F.ceil(_ticks(x, tick)) * F.lit(tick).cast("decimal(20,8)")).cast("double")


def digits(x: Column) -> Column:
    """Number of decimals of the shortest text of the number."""
    text = F.rtrim(x.cast("decimal(30,12)").cast("string"), F.lit("0"))
    return F.length(F.substring_index(text, ".", -1))


def make_symbol(symbol: Column, exchange: Column) -> Column:
    return F.concat_ws(".", symbol, exchange)


def split_symbol(vt_symbol: Column) -> tuple[Column, Column]:
    """Text before and after the last dot."""
    exchange = F.substring_index(vt_symbol, ".", -1)
    return F.regexp_extract(vt_symbol, r"^(.*)\.[^.]*$", 1), exchange


def json_number(payload: Column, name: str) -> Column:
    """A payload field as double; ``--``, empty and unreadable text are NULL."""
    return F.get_json_object(payload, f"$['{name}']").try_cast("double")


def compact_date(text: Column) -> Column:
    """``YYYYMMDD`` text to a date; empty, zero and unreadable text are NULL."""
    clean = F.trim(text.cast("string"))
    return F.when(~clean.isin("", "0", "00000000"), F.try_to_timestamp(clean, F.lit("yyyyMMdd"))).cast("date")


def exchange_suffix(code: Column) -> Column:
    """Six-digit code to a symbol with its exchange; suffixed codes are kept, others are NULL."""
    # fixed values: first digits listed in Shanghai, known suffixes
    clean = F.upper(F.trim(code))
    return (
        F.when(clean.rlike(r"^[569]\d{5}$"), F.concat(clean, F.lit(".SH")))
        .when(clean.rlike(r"^\d{6}$"), F.concat(clean, F.lit(".SZ")))
        .when(clean.rlike(r"^\d{6}\.(SH|SZ|BJ)$"), clean))


def board(symbol: Column) -> Column:
    """Board from the suffix or the code's prefix."""
    # fixed values: code prefixes of the boards
    return (
        F.when(symbol.endswith(".BJ"), "bj").when(symbol.startswith("688"), "star")
        .when(symbol.rlike("^30[01]"), "chinext").otherwise("main"))


def number_of(*candidates: Column) -> Column:
    """First readable number among differently named fields."""
    return F.coalesce(*(c.try_cast("double") for c in candidates))


def side_of(text: Column) -> Column:
    """Order side from free text; everything that is not a sale is a purchase."""
    low = F.lower(F.coalesce(text.cast("string"), F.lit("")))
    return F.when(low.contains("sell") | low.contains("卖"), "sell").otherwise("buy")


def order_status(text: Column, quantity: Column, traded: Column) -> Column:
    """Order status from code, text and quantities, first match wins."""
    # fixed values: status codes and words
    low = F.lower(F.coalesce(text.cast("string"), F.lit("")))
    return (
        F.when(low.isin("56", "failed") | low.rlike("reject|废|拒"), "rejected")
        .when((low == "54") | low.rlike("cancel|撤"), "cancelled")
        .when((quantity > 0) & (traded >= quantity), "executed")
        .when(traded > 0, "partial")
        .when(low.isin("55", "executed") | low.rlike("done|filled|已成"), "executed")
        .otherwise("pending"))


def row_min(*columns: Column) -> Column:
    return F.least(*columns)


def row_max(*columns: Column) -> Column:
    return F.greatest(*columns)


def row_sum(*columns: Column) -> Column:
    """Sum over columns, missing ignored."""
    total = F.lit(0.0)
    for c in columns:
        total = total + F.coalesce(c.cast("double"), F.lit(0.0))
    return total

"""Data quality: price checks, consistency, freshness, the gate, reconciliation, quarantine."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


KEYS = ["datetime", "vt_symbol"]
PRICES = ("open", "high", "low", "close")
CHECK_COLUMNS = ["name", "dataset", "severity", "status", "observed", "expected"]
BLOCKING, WARNING = "blocking", "warning"
MODES = ("research", "paper", "live")


class DataQualityError(ValueError):
    """Raised with every failed check."""


def require_columns(df: DataFrame, names: list[str] | set[str]) -> DataFrame:
    absent = sorted(set(names) - set(df.columns))
    if absent:
        raise DataQualityError(f"missing columns: {absent}")
    return df


def duplicate_keys(df: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def price_counters(df: DataFrame) -> DataFrame:
    """One row of quality counters over the whole table, in one aggregation."""
    c = F.col
    numeric = [n for n in (*PRICES, "volume", "turnover") if n in df.columns]
    bad = (c("high") < F.greatest("open", "close", "low")) | (c("low") > F.least("open", "close", "high"))
    counters = [F.count(F.lit(1)).alias("rows"), F.count_distinct("vt_symbol").alias("symbols"),
                F.min("datetime").alias("start"), F.max("datetime").alias("end"),
                F.count_if(bad).alias("bad_ohlc")]
    for n in numeric:
        counters += [F.count_if(c(n).isNull()).alias(f"null_{n}"), F.count_if(F.isnan(c(n))).alias(f"nan_{n}")]
    for n in PRICES:
        counters.append(F.count_if(c(n) <= 0).alias(f"non_positive_{n}"))
    extra = duplicate_keys(df).agg(F.count(F.lit(1)).alias("duplicate_keys"))
    return df.agg(*counters).crossJoin(extra)


def unordered_rows(df: DataFrame, row_id: str) -> DataFrame:
    """Rows whose time is not after the symbol's previous row, by an input row number."""
    before = F.lag("datetime").over(Window.partitionBy("vt_symbol").orderBy(row_id))
    return df.withColumn("_b", before).where(F.col("datetime") <= F.col("_b")).drop("_b")


def symbol_summary(df: DataFrame) -> DataFrame:
    return df.groupBy("vt_symbol").agg(
        F.count(F.lit(1)).alias("rows"), F.min("datetime").alias("start"), F.max("datetime").alias("end"))


def data_summary(df: DataFrame) -> DataFrame:
    """Rows, symbols, range, and fewest/most rows of a symbol (two-level aggregation)."""
    return symbol_summary(df).agg(
        F.sum("rows").alias("rows"), F.count(F.lit(1)).alias("symbols"), F.min("start").alias("start"),
        F.max("end").alias("end"), F.min("rows").alias("min_rows"), F.max("rows").alias("max_rows"))


def check(df: DataFrame, name: str, dataset: str, severity: str, failed: Column, observed: Column,
          expected: str) -> DataFrame:
    """Check row from a one-row aggregate."""
    return df.select(
        F.lit(name).alias("name"), F.lit(dataset).alias("dataset"), F.lit(severity).alias("severity"),
        F.when(failed, "fail").otherwise("pass").alias("status"), observed.cast("string").alias("observed"),
        F.lit(expected).alias("expected"))


def _severity(mode: str) -> str:
    """Research runs are only warned where paper and live runs are blocked."""
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode}")
    return WARNING if mode == "research" else BLOCKING


def price_checks(df: DataFrame, dataset: str) -> DataFrame:
    found = price_counters(df)
    c = F.col
    nulls = reduce(lambda a, b: a + b, (c(f"null_{n}") + c(f"nan_{n}") for n in PRICES))
    low = reduce(lambda a, b: a + b, (c(f"non_positive_{n}") for n in PRICES))
    rules = [("unique_keys", c("duplicate_keys")), ("ohlc_order", c("bad_ohlc")),
             ("prices_present", nulls), ("prices_positive", low)]
    # all rules from one row, so that the table is aggregated once
    found = found.select(F.explode(F.array(*(F.struct(F.lit(n).alias("name"), v.cast("long").alias("value")) for n, v in rules))).alias("r")).select("r.*")
    return found.select("name", F.lit(dataset).alias("dataset"), F.lit(BLOCKING).alias("severity"),
                        F.when(F.col("value") > 0, "fail").otherwise("pass").alias("status"), F.col("value").cast("string").alias("observed"),
                        F.lit("0").alias("expected"))


def key_coverage(base: DataFrame, other: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Matched distinct keys over keys of the base."""
    found = other.select(*keys).distinct().withColumn("_m", F.lit(1))
    return base.select(*keys).distinct().join(found, keys, "left").agg(
        F.count(F.lit(1)).alias("keys"), F.count("_m").alias("matched"),
        F.try_divide(F.count("_m").cast("double"), F.count(F.lit(1))).alias("coverage"))


def adjusted_consistency(raw: DataFrame, adjusted: DataFrame, mode: str = "research", coverage_min: float = 0.99,
                         turnover_gap: float = 0.001) -> DataFrame:
    cover = check(key_coverage(raw, adjusted), "key_coverage", "adjusted", _severity(mode),
                  F.col("coverage") < coverage_min, F.round("coverage", 6), f">= {coverage_min}")
    pairs = raw.select(*KEYS, F.col("turnover").alias("a")).join(
        adjusted.select(*KEYS, F.col("turnover").alias("b")), KEYS)
    gap = F.try_divide(F.abs(F.col("a") - F.col("b")), F.greatest(F.abs("a"), F.lit(1.0)))
    gaps = pairs.agg(F.count_if(gap > turnover_gap).alias("n"))
    return cover.unionByName(check(gaps, "turnover_match", "adjusted", _severity(mode), F.col("n") > 0, F.col("n"), "0"))


def adjusted_verification(raw: DataFrame, adjusted: DataFrame, fall: float = 0.001, gap: float = 0.001) -> DataFrame:
    """Coverage, turnover mismatches, and falls of the adjusted/raw ratio beyond the slack."""
    pairs = raw.select(*KEYS, F.col("close").alias("rc"), F.col("turnover").alias("rt")).join(
        adjusted.select(*KEYS, F.col("close").alias("ac"), F.col("turnover").alias("at")), KEYS)
    pairs = pairs.withColumn("ratio", F.try_divide("ac", "rc"))
    before = F.lag("ratio").over(Window.partitionBy("vt_symbol").orderBy("datetime"))
    pairs = pairs.withColumn("drop", F.try_divide("ratio", before) - 1 < -fall)
    mismatch = F.try_divide(F.abs(F.col("rt") - F.col("at")), F.greatest(F.abs("rt"), F.lit(1.0))) > gap
    found = pairs.agg(F.count(F.lit(1)).alias("joined"), F.count_if(mismatch).alias("turnover_mismatch"),
                      F.count_if("drop").alias("ratio_drops"))
    return key_coverage(raw, adjusted).select("coverage").crossJoin(found)


def expected_trade_date(calendar: DataFrame, as_of: str) -> DataFrame:
    """Latest calendar date at or before ``as_of``, and whether the calendar reaches it."""
    day = F.lit(as_of).cast("date")
    return calendar.agg(F.max(F.when(F.col("trade_date") <= day, F.col("trade_date"))).alias("expected"),
                        (F.max("trade_date") >= day).alias("covers"))


def freshness(df: DataFrame, date: str = "datetime", symbol: str = "vt_symbol") -> DataFrame:
    """Range, rows, and symbols on the latest day."""
    top = df.agg(F.min(date).alias("start"), F.max(date).alias("end"), F.count(F.lit(1)).alias("rows"),
                 F.count_distinct(symbol).alias("symbols"))
    # per date first: the latest day is one group among the daily aggregates
    per_day = df.groupBy(date).agg(F.count_distinct(symbol).alias("n"))
    return top.crossJoin(per_day.agg(F.max_by("n", date).alias("latest_symbols")))


def freshness_check(df: DataFrame, calendar: DataFrame, as_of: str, dataset: str, mode: str) -> DataFrame:
    row = df.agg(F.max("datetime").cast("date").alias("latest")).crossJoin(expected_trade_date(calendar, as_of))
    late = F.coalesce(F.col("latest") < F.col("expected"), F.lit(True))
    return check(row, "latest_date", dataset, _severity(mode), late, F.col("latest"), as_of)


def calendar_check(calendar: DataFrame, as_of: str, mode: str) -> DataFrame:
    row = expected_trade_date(calendar, as_of)
    return check(row, "calendar_coverage", "calendar", _severity(mode), ~F.coalesce("covers", F.lit(False)),
                 F.col("covers"), f">= {as_of}")


def snapshot_age_check(df: DataFrame, snapshot_date: str, as_of: str, dataset: str, mode: str, max_days: int = 7) -> DataFrame:
    row = df.agg(F.datediff(F.lit(as_of).cast("date"), F.max(snapshot_date).cast("date")).alias("age"))
    stale = ~F.coalesce(F.col("age").between(0, max_days), F.lit(False))
    return check(row, "snapshot_age", dataset, _severity(mode), stale, F.col("age"), f"0..{max_days}")


def announce_check(reports: DataFrame, mode: str, max_null: float = 0.01) -> DataFrame:
    row = reports.agg(F.avg(F.col("announce_date").isNull().cast("double")).alias("share"))
    return check(row, "announce_date_coverage", "reports", _severity(mode), F.coalesce(F.col("share") > max_null, F.lit(True)),
                 F.round("share", 6), f"<= {max_null}")


def data_gate(frames: dict[str, DataFrame], required: list[str], auxiliary: list[str], mode: str, as_of: str,
              recent_days: int = 252) -> DataFrame:
    """All check rows of a lake: presence, prices, consistency, sources, freshness."""
    spark = next(iter(frames.values())).sparkSession
    presence = [(n, BLOCKING) for n in required] + [(n, _severity(mode)) for n in auxiliary]
    rows = [("dataset_exists", n, s, "pass" if n in frames else "fail", None, None) for n, s in presence]
    out = [spark.createDataFrame(rows, ", ".join(f"{c} string" for c in CHECK_COLUMNS))]
    raw, adjusted, calendar = (frames.get(n) for n in ("raw", "adjusted", "calendar"))
    out += [price_checks(frames[n], n) for n in ("raw", "adjusted") if n in frames]
    if raw is not None and adjusted is not None:
        out.append(adjusted_consistency(raw, adjusted, mode))
    if adjusted is not None and "second_source" in frames:
        out.append(source_check(adjusted, frames["second_source"], recent_days, mode))
    if calendar is not None:
        out.append(calendar_check(calendar, as_of, mode))
        out += [freshness_check(frames[n], calendar, as_of, n, mode)
                for n in ("raw", "universe", "benchmark") if n in frames]
    if "reports" in frames:
        out.append(announce_check(frames["reports"], mode))
    return reduce(DataFrame.unionByName, out)


def gate_status(checks: DataFrame) -> DataFrame:
    """fail if a blocking check failed, warning if another one did, else pass."""
    failed = F.col("status") == "fail"
    level = F.max(F.when(failed & (F.col("severity") == BLOCKING), 2).when(failed, 1).otherwise(0))
    return checks.agg(level.alias("level"), F.count_if(failed).alias("failed")).select(
        F.element_at(F.array(*map(F.lit, ("pass", "warning", "fail"))), F.col("level") + 1).alias("status"), "failed")


def require_pass(checks: DataFrame) -> None:
    """Raise with all blocking failures (the check table has a handful of rows)."""
    bad = checks.where((F.col("status") == "fail") & (F.col("severity") == BLOCKING)).collect()
    if bad:
        raise DataQualityError("; ".join(f"{r['dataset']}: {r['name']} ({r['observed']})" for r in bad))


def recent_window(df: DataFrame, days: int) -> DataFrame:
    """Rows of the latest ``days`` distinct dates."""
    dates = df.select("datetime").distinct().orderBy(F.col("datetime").desc()).limit(days)
    return df.join(F.broadcast(dates), "datetime", "left_semi")


def compare_sources(primary: DataFrame, other: DataFrame, recent_days: int, threshold: float = 0.02,
                    actions: DataFrame | None = None) -> DataFrame:
    """Row-wise differences of two price sources with the symbol's median scale taken out."""
    a = recent_window(primary.select(*KEYS, F.col("close").cast("double").alias("close_a")), recent_days)
    b = other.select(*KEYS, F.col("close").cast("double").alias("close_b"))
    joined = a.join(b, KEYS)
    c = F.col
    base = F.greatest(F.abs("close_a"), F.lit(1.0))
    usable = (F.abs("close_a") > 1e-12) & (F.abs("close_b") > 1e-12)
    scales = joined.where(usable).groupBy("vt_symbol").agg(
        F.median(c("close_b") / c("close_a")).alias("source_scale"))
    joined = joined.join(scales, "vt_symbol", "left").withColumns({
        "relative_diff": F.abs(c("close_a") - c("close_b")) / base,
        "normalized_diff": F.abs(c("close_a") - F.try_divide("close_b", "source_scale")) / base})
    ratio = F.abs(F.try_divide("close_b", "close_a"))
    unit = (ratio > 50) | (ratio < 0.02) | (
        (c("normalized_diff") <= 0.02) & (F.abs(c("source_scale") - 1) > 0.02))
    reason = F.when(F.coalesce(unit, F.lit(False)), "unit_mismatch").otherwise("unknown")
    if actions is not None:
        joined = joined.join(actions.select(*KEYS).distinct().withColumn("_near", F.lit(True)), KEYS, "left")
        reason = F.when(c("_near"), "corporate_action").otherwise(reason)
    return joined.withColumn("suspected_reason", F.when(c("relative_diff") > threshold, reason)).drop("_near")


def reconciliation_summary(primary: DataFrame, compared: DataFrame, recent_days: int, threshold: float = 0.02,
                           coverage_min: float = 0.99) -> DataFrame:
    keys = recent_window(primary, recent_days).select(*KEYS).distinct().agg(F.count(F.lit(1)).alias("checked_rows"))
    unknown = F.when(F.col("suspected_reason") == "unknown", F.col("vt_symbol"))
    found = compared.agg(
        F.count(F.lit(1)).alias("joined_rows"), F.count_if(F.col("relative_diff") > threshold).alias("diff_rows"),
        F.count_if(F.col("normalized_diff") > threshold).alias("normalized_diff_rows"),
        F.count_distinct(unknown).alias("unknown_symbols"))
    coverage = F.col("joined_rows") / F.greatest("checked_rows", F.lit(1))
    ok = (coverage >= coverage_min) & (F.col("normalized_diff_rows") == 0)
    return keys.crossJoin(found).withColumns({
        "coverage": F.round(coverage, 6),
        "diff_ratio": F.round(F.col("diff_rows") / F.greatest("joined_rows", F.lit(1)), 6),
        "status": F.when(ok, "pass").otherwise("fail")})


def source_check(primary: DataFrame, other: DataFrame, recent_days: int, mode: str) -> DataFrame:
    row = reconciliation_summary(primary, compare_sources(primary, other, recent_days), recent_days)
    return check(row, "source_comparison", "adjusted", _severity(mode), F.col("status") == "fail",
                 F.col("normalized_diff_rows"), "0")


def unknown_symbols(compared: DataFrame) -> DataFrame:
    return compared.where("suspected_reason = 'unknown'").groupBy("vt_symbol").agg(
        F.count(F.lit(1)).alias("unknown_rows"), F.max("normalized_diff").alias("max_normalized_diff"),
        F.min("datetime").alias("first_datetime"), F.max("datetime").alias("last_datetime")).withColumn(
        "quarantine_reason", F.lit("unknown_price_diff"))


def top_symbols(compared: DataFrame, k: int = 20) -> DataFrame:
    """Report: symbols with most differing rows (ties by larger difference, then name)."""
    return compared.where("suspected_reason IS NOT NULL").groupBy("vt_symbol").agg(
        F.count(F.lit(1)).alias("diff_rows"), F.round(F.max("relative_diff"), 6).alias("max_relative_diff")).orderBy(
        F.col("diff_rows").desc(), F.col("max_relative_diff").desc(), "vt_symbol").limit(k)


def quarantine(universe: DataFrame, blocked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Universe without the blocked symbols, and rows/symbols before and after."""
    names = blocked.select("vt_symbol").distinct()
    kept = universe.join(names, "vt_symbol", "left_anti")

    def size(df: DataFrame, tag: str) -> DataFrame:
        return df.agg(F.count(F.lit(1)).alias(f"rows_{tag}"), F.count_distinct("vt_symbol").alias(f"symbols_{tag}"))

    return kept, size(universe, "before").crossJoin(size(kept, "after"))


def unknown_in_universe(unknown: DataFrame, universe: DataFrame) -> DataFrame:
    live = universe.where("in_execution").select("vt_symbol").distinct()
    return unknown.select("vt_symbol").distinct().join(live, "vt_symbol", "left_semi")


def common_date(frames: dict[str, DataFrame], date: str = "datetime") -> DataFrame:
    """Each dataset's latest date, the common (smallest) one, and whether a dataset lags the newest."""
    latest = reduce(DataFrame.unionByName, (
        df.agg(F.max(date).cast("date").alias("latest")).withColumn("dataset", F.lit(n)) for n, df in frames.items()))
    whole = Window.partitionBy()
    return latest.withColumns({"common": F.min("latest").over(whole), "newest": F.max("latest").over(whole)}).withColumn(
        "blocks", F.col("latest") < F.col("newest"))


def dataset_profile(df: DataFrame, reason: str | None = None) -> DataFrame:
    """Rows, symbols, special-treatment names, zero-volume rows and reason counts (name, value)."""
    cols = df.columns
    head = [F.count(F.lit(1)).alias("rows"), F.count_distinct("vt_symbol").alias("symbols")]
    head += [F.count_distinct(F.when(F.col("name").contains("ST"), F.col("vt_symbol"))).alias("st_names")] if "name" in cols else []
    head += [F.count_if(F.col("volume") <= 0).alias("zero_volume")] if "volume" in cols else []
    row = df.agg(*head)
    tall = row.select(F.explode(F.array(*(
        F.struct(F.lit(n).alias("name"), F.col(n).alias("value")) for n in row.columns))).alias("r")).select("r.*")
    if reason is None:
        return tall
    return tall.unionByName(df.groupBy(F.concat(F.lit("reason:"), F.col(reason)).alias("name")).agg(
        F.count(F.lit(1)).alias("value")))

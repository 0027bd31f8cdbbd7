"""Normalisation and cleaning steps of a dataset stage (frame to frame, for ``transform``)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barloom.functions import algebra as A
from barloom.functions.algebra import field
from barloom.operators.dataset import feature_names, query_by_time
from barloom.operators.evaluate import evaluate

# fixed values: normal-consistency of the median deviation, uniform-rank scale, guard
MAD_TO_STD = 1.4826
RANK_SCALE = 3.46
TINY = 1e-12


def nan_to_null(df: DataFrame, names: list[str]) -> DataFrame:
    return df.withColumns({n: F.when(~F.isnan(n), F.col(n)) for n in names})


def _clip(x: Column, bound: float = 3.0) -> Column:
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(-bound)), F.lit(bound)))


def drop_na(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    names = feature_names(df) if names is None else names
    return nan_to_null(df, names).dropna(subset=names)


def fill_na(df: DataFrame, value: float, fill_label: bool = True) -> DataFrame:
    names = df.columns[2:] if fill_label else feature_names(df)
    return df.fillna(value, subset=names)


def _replace(df: DataFrame, factors: dict) -> DataFrame:
    return evaluate(df, factors).select(*df.columns)


def cs_norm(df: DataFrame, method: str, names: list[str] | None = None) -> DataFrame:
    """Per date: (x-median)/median deviation/1.4826 clipped to 3 ("robust"), or z-score."""
    names = feature_names(df) if names is None else names
    df = nan_to_null(df, names)
    if method == "robust":
        centred = {n: field(n) - A.cs_median(field(n)) for n in names}
        return _replace(df, {n: A.clip(x / A.cs_median(abs(x)) / MAD_TO_STD, -3.0, 3.0)
                             for n, x in centred.items()})
    return _replace(df, {n: (field(n) - A.cs_mean(field(n))) / A.cs_std(field(n)) for n in names})


def cs_rank_norm(df: DataFrame, names: list[str]) -> DataFrame:
    """(average rank / rows of the date - 0.5) * 3.46; the denominator counts missing rows too."""
    df = nan_to_null(df, names)
    return _replace(df, {n: (A.cs_rank(field(n)) / A.cs_rows() - 0.5) * RANK_SCALE for n in names})


def cs_fill_na(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    names = feature_names(df) if names is None else names
    df = nan_to_null(df, names)
    return _replace(df, {n: A.coalesce(field(n), A.cs_mean(field(n))) for n in names})


def replace_inf(df: DataFrame) -> DataFrame:
    """Infinite values become the symbol's mean of finite values (aggregated, then joined)."""
    names = df.columns[2:]
    df = nan_to_null(df, names)
    means = df.groupBy("vt_symbol").agg(*(
        F.avg(F.when(F.abs(n) != float("inf"), F.col(n))).alias(f"_m_{n}") for n in names))
    return df.join(means, "vt_symbol", "left").select(*df.columns[:2], *(
        F.when(F.abs(n) == float("inf"), F.col(f"_m_{n}")).otherwise(F.col(n)).alias(n) for n in names))


def ts_norm(df: DataFrame, fit_start: str | None = None, fit_end: str | None = None) -> DataFrame:
    """Global mean and population deviation fitted on a date range, label included."""
    names = df.columns[2:]
    df = nan_to_null(df, names)
    fit = query_by_time(df, fit_start, fit_end) if fit_start and fit_end else df
    row = fit.agg(*(f(n).alias(f"{p}_{n}") for n in names for p, f in (("_m", F.avg), ("_s", F.stddev_pop))))
    return df.crossJoin(F.broadcast(row)).select(*df.columns[:2], *(
        F.when(F.col(f"_s_{n}") == 0, F.col(n))
        .otherwise(F.try_divide(F.col(n) - F.col(f"_m_{n}"), F.col(f"_s_{n}"))).alias(n) for n in names))


def robust_zscore(df: DataFrame, fit_start: str | None = None, fit_end: str | None = None,
                  clip_outlier: bool = True) -> DataFrame:
    """Global median and median deviation of the features fitted on a date range.

    The medians are exact. One aggregate row each is broadcast.
    """
    names = feature_names(df)
    df = nan_to_null(df, names)
    fit = query_by_time(df, fit_start, fit_end) if fit_start and fit_end else df
    middle = fit.agg(*(F.percentile(n, F.lit(0.5)).alias(f"_m_{n}") for n in names))
    spread = fit.crossJoin(F.broadcast(middle)).agg(*(
        F.percentile(F.abs(F.col(n) - F.col(f"_m_{n}")), F.lit(0.5)).alias(f"_s_{n}") for n in names))
    out = {n: (F.col(n) - F.col(f"_m_{n}")) / ((F.col(f"_s_{n}") + TINY) * MAD_TO_STD) for n in names}
    return (
        df.crossJoin(F.broadcast(middle)).crossJoin(F.broadcast(spread))
        .select(*(((_clip(out[c]) if clip_outlier else out[c]) if c in out else F.col(c)).alias(c)
                  for c in df.columns))
    )


def drop_feature(df: DataFrame, names: list[str]) -> DataFrame:
    return df.drop(*names)


def last_by_date(df: DataFrame, n: int) -> DataFrame:
    """The latest ``n`` rows of every symbol."""
    spec = Window.partitionBy("vt_symbol").orderBy(F.col("datetime").desc())
    return df.withColumn("_r", F.row_number().over(spec)).where(F.col("_r") <= n).drop("_r")

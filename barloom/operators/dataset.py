"""Dataset preparation: features and label on a panel, membership filter, processors, segments."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barloom.functions.algebra import Factor, native
from barloom.operators.evaluate import evaluate

KEYS = ["datetime", "vt_symbol"]
Processor = Callable[[DataFrame], DataFrame]


def to_date(text: Any) -> Column:
    """``YYYY-MM-DD`` or ``YYYYMMDD`` (a value or a column) to a date; unreadable text is NULL."""
    c = text if isinstance(text, Column) else F.lit(text)
    c = c.cast("string")
    return F.when(c.contains("-"), F.try_to_timestamp(c, F.lit("yyyy-MM-dd"))).otherwise(
        F.try_to_timestamp(c, F.lit("yyyyMMdd"))).cast("date")


def query_by_time(df: DataFrame, start: Any = None, end: Any = None, time: str = "datetime") -> DataFrame:
    """Inclusive range, either bound optional."""
    if start is not None:
        df = df.where(F.col(time) >= (to_date(start) if isinstance(start, str) else F.lit(start)))
    if end is not None:
        df = df.where(F.col(time) <= (to_date(end) if isinstance(end, str) else F.lit(end)))
    return df


def filter_by_membership(df: DataFrame, intervals: DataFrame) -> DataFrame:
    """Rows inside any (start, end) of their symbol; a row inside two intervals stays one row."""
    iv = intervals.select(F.col("vt_symbol").alias("_s"), F.col("start").alias("_a"), F.col("end").alias("_b"))
    inside = (F.col("vt_symbol") == F.col("_s")) & F.col("datetime").between(F.col("_a"), F.col("_b"))
    return df.join(iv, inside, "left_semi")


def membership_intervals(components: DataFrame) -> DataFrame:
    """Runs of consecutive listed dates per symbol: (vt_symbol, start, end).

    ``components`` is (trade_date, vt_symbol); only the dates present in it count as trading days.
    """
    dates = components.select("trade_date").distinct()
    numbered = dates.withColumn("_d", F.row_number().over(Window.orderBy("trade_date")))
    rows = components.select("trade_date", "vt_symbol").distinct().join(numbered, "trade_date")
    run = F.col("_d") - F.row_number().over(Window.partitionBy("vt_symbol").orderBy("trade_date"))
    return (
        rows.withColumn("_run", run).groupBy("vt_symbol", "_run")
        .agg(F.min("trade_date").alias("start"), F.max("trade_date").alias("end")).drop("_run")
    )


class Dataset:
    """Features, label and processors over a panel; every stage is a lazy DataFrame."""

    def __init__(self, panel: DataFrame, segments: dict[str, tuple[str, str]]) -> None:
        self.panel, self.segments = panel, segments
        self.features: dict[str, Factor] = {}
        self.results: dict[str, DataFrame] = {}
        self.label: Factor | None = None
        self.processors: dict[str, list[Processor]] = {"infer": [], "learn": []}
        self.stages: dict[str, DataFrame] = {}

    def add_feature(self, name: str, expression: Factor | Column | None = None,
                    result: DataFrame | None = None) -> None:
        """A factor, a ready Column, or a frame (datetime, vt_symbol, data) joined by key."""
        if (expression is None) == (result is None):
            raise ValueError("give either an expression or a result")
        if name in self.features or name in self.results:
            raise ValueError(f"feature {name} exists")
        if result is not None:
            self.results[name] = result
        else:
            self.features[name] = native(expression) if isinstance(expression, Column) else expression

    def set_label(self, expression: Factor) -> None:
        self.label = expression

    def add_processor(self, stage: str, processor: Processor) -> None:
        self.processors[stage].append(processor)

    def prepare(self, intervals: DataFrame | None = None) -> DataFrame:
        """Stage ``result`` (panel and features) and ``raw`` (keys, features, label last)."""
        todo = dict(self.features)
        if self.label is not None:
            todo["label"] = self.label
        result = evaluate(self.panel, todo)
        for name, frame in self.results.items():
            result = result.join(frame.select(*KEYS, F.col("data").alias(name)), KEYS, "left")
        raw = result if intervals is None else filter_by_membership(result, intervals)
        names = [*self.features, *self.results] + (["label"] if self.label is not None else [])
        self.stages = {"result": result, "raw": raw.select(*KEYS, *names)}
        return self.stages["raw"]

    def process(self, append: bool = True) -> None:
        """Infer processors, then learn processors on top of them (or on the raw stage)."""
        infer = self.stages["raw"]
        for f in self.processors["infer"]:
            infer = infer.transform(f)
        learn = infer if append else self.stages["raw"]
        for f in self.processors["learn"]:
            learn = learn.transform(f)
        self.stages.update(infer=infer, learn=learn)

    def fetch(self, stage: str, segment: str) -> DataFrame:
        return query_by_time(self.stages[stage], *self.segments[segment])


def feature_names(df: DataFrame) -> list[str]:
    """Columns between the two keys and the trailing label."""
    return df.columns[2:-1]


def forward_returns(panel: DataFrame, horizons: tuple[int, ...] = (1, 5, 10), close: str = "close") -> DataFrame:
    spec = Window.partitionBy("vt_symbol").orderBy("datetime")
    return panel.select(*panel.columns, *(
        (F.try_divide(F.lead(close, n).over(spec), F.col(close)) - 1).alias(f"fwd_{n}") for n in horizons))


def factor_analysis(panel: DataFrame, signal: DataFrame, name: str, quantiles: int = 10) -> DataFrame:
    """Factor joined with close, missing dropped, quantile per date and forward returns."""
    joined = panel.select(*KEYS, "close").join(signal.select(*KEYS, name), KEYS).dropna(subset=["close", name])
    with_returns = forward_returns(joined)
    spec = Window.partitionBy("datetime").orderBy(name, "vt_symbol")
    return with_returns.withColumn("quantile", F.ntile(quantiles).over(spec))


def pivot_map(df: DataFrame, time: str, symbol: str, value: str) -> DataFrame:
    """One row a date with a map from every symbol of the date to its value; a repeated key keeps its largest value."""
    cells = df.where(F.col(symbol).isNotNull()).groupBy(time, symbol).agg(F.max(value).alias("_v"))
    entries = F.array_sort(F.collect_list(F.struct(F.col(symbol).alias("key"), F.col("_v").alias("value"))))
    return cells.groupBy(time).agg(F.map_from_entries(entries).alias(value))

"""Bar and tick store, signals, components, settings and named artifacts on Parquet.

Tables are partitioned by interval and year, so range and interval filters prune files.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.ml.regression import GBTRegressionModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.operators.dataset import Dataset, query_by_time
from barloom.operators.models import MODELS, ReturnModel
from barloom.session import materialise, work_dir

# fixed values: intervals with a store of their own
INTERVALS = ("d", "1m")


def path_exists(spark: SparkSession, path: str) -> bool:
    """Works for every file system Spark can reach."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def list_names(spark: SparkSession, path: str) -> list[str]:
    if not path_exists(spark, path):
        return []
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(p)
    return sorted(s.getPath().getName() for s in found)


def remove_path(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True))


def to_store_zone(ts: Column, source: str, store: str = "UTC") -> Column:
    """Wall-clock time of the source zone as wall-clock time of the store's zone."""
    return F.convert_timezone(F.lit(source), F.lit(store), ts.cast("timestamp_ntz"))


def keep_newest(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row a key, the newest; of equally new ones the one with the largest other columns, so that reruns agree."""
    rest = [c for c in df.columns if c not in (*keys, order)]
    return df.groupBy(*keys).agg(F.max_by(F.struct(order, *rest), F.struct(order, *rest)).alias("_r")).select(*keys, "_r.*").select(*df.columns)


@contextmanager
def staged(df: DataFrame, name: str) -> Iterator[DataFrame]:
    """``df`` written aside while a table that it is read from is replaced; the copy goes afterwards."""
    path = f"{work_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    try:
        yield df.sparkSession.read.schema(df.schema).parquet(path)
    finally:
        remove_path(df.sparkSession, path)


class BarStore:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _table(self, name: str) -> str:
        return f"{self.root}/{name}"

    # --- bars ---------------------------------------------------------------------------

    @staticmethod
    def check_interval(interval: str) -> str:
        if interval not in INTERVALS:
            raise ValueError(f"unsupported interval {interval}, use one of {INTERVALS}")
        return interval

    def save_bars(self, bars: DataFrame, interval: str) -> None:
        """Upsert by (vt_symbol, datetime); of equal keys the newest save wins.

        Only the touched year partitions are read and rewritten.
        """
        self.check_interval(interval)
        path = self._table("bars")
        new = bars.withColumns({"interval": F.lit(interval), "year": F.year("datetime"), "ingest_ts": F.current_timestamp()})
        merged = new
        if path_exists(self.spark, path):
            years = new.select("interval", "year").distinct()
            old = self.spark.read.parquet(path).join(F.broadcast(years), ["interval", "year"], "left_semi")
            merged = old.unionByName(new, allowMissingColumns=True)
        merged = keep_newest(merged, ["interval", "vt_symbol", "datetime"], "ingest_ts")
        # the partitions being replaced are also being read
        with staged(merged, "bars") as rows:
            self._replace(rows, path, ["interval", "year"])

    def _replace(self, df: DataFrame, path: str, parts: list[str]) -> None:
        (df.repartition(*parts, F.pmod(F.xxhash64("vt_symbol"), F.lit(16))).sortWithinPartitions("vt_symbol", "datetime")
         .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*parts).parquet(path))

    def bars(self, interval: str) -> DataFrame:
        self.check_interval(interval)
        return self.spark.read.parquet(self._table("bars")).where(F.col("interval") == interval)

    def load_bars(self, vt_symbol: str, interval: str, start: str, end: str) -> DataFrame:
        df = self.bars(interval).where(F.col("vt_symbol") == vt_symbol)
        years = F.col("year").between(int(start[:4]), int(end[:4]))
        return query_by_time(df.where(years), F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp"))

    def delete_bars(self, vt_symbol: str, interval: str) -> int:
        """Remove one symbol's rows of an interval; returns how many there were."""
        mine = self.bars(interval).where(F.col("vt_symbol") == vt_symbol)
        gone = mine.count()
        if gone:
            years = mine.select("year").distinct()
            kept = self.bars(interval).join(F.broadcast(years), "year", "left_semi").where(F.col("vt_symbol") != vt_symbol)
            with staged(kept, "bars") as kept:
                alone = years.join(kept.select("year").distinct(), "year", "left_anti").collect()
                if len(kept.take(1)):
                    self._replace(kept, self._table("bars"), ["interval", "year"])
            # a year that held only this symbol has no rows to write, its folder is removed
            for row in alone:
                remove_path(self.spark, f"{self._table('bars')}/interval={interval}/year={row['year']}")
        return gone

    # --- ticks --------------------------------------------------------------------------

    def save_ticks(self, ticks: DataFrame) -> None:
        ticks.withColumn("day", F.col("datetime").cast("date")).write.mode("append").partitionBy("day").parquet(self._table("ticks"))

    def load_ticks(self, vt_symbol: str, start: str, end: str) -> DataFrame:
        df = self.spark.read.parquet(self._table("ticks")).where(F.col("vt_symbol") == vt_symbol)
        df = df.where(F.col("day").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
        return df.where(F.col("datetime").between(F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")))

    def delete_ticks(self, vt_symbol: str) -> int:
        """Remove one symbol's ticks; returns how many there were. Only days that hold any are rewritten."""
        path = self._table("ticks")
        ticks = self.spark.read.parquet(path)
        mine = ticks.where(F.col("vt_symbol") == vt_symbol)
        gone = mine.count()
        if gone:
            days = mine.select("day").distinct()
            with staged(ticks.join(days, "day", "left_semi").where(F.col("vt_symbol") != vt_symbol), "ticks") as kept:
                alone = days.join(kept.select("day").distinct(), "day", "left_anti").collect()
                kept.repartition("day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)
            for row in alone:
                remove_path(self.spark, f"{path}/day={row['day']}")
        return gone

    # --- signals, components, settings, artifacts -----------------------------------------

    def save_signal(self, name: str, signal: DataFrame) -> None:
        signal.write.mode("overwrite").parquet(self._table(f"signals/{name}"))

    def load_signal(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self._table(f"signals/{name}"))

    def list_signals(self) -> list[str]:
        return list_names(self.spark, self._table("signals"))

    def remove_signal(self, name: str) -> bool:
        return remove_path(self.spark, self._table(f"signals/{name}"))

    def save_components(self, components: DataFrame) -> None:
        components.write.mode("append").partitionBy("index_symbol").parquet(self._table("components"))

    def load_components(self, index_symbol: str, start: str, end: str) -> DataFrame:
        df = self.spark.read.parquet(self._table("components")).where(F.col("index_symbol") == index_symbol)
        return df.where(F.col("trade_date").between(F.lit(start).cast("date"), F.lit(end).cast("date"))).distinct()

    def save_settings(self, settings: DataFrame) -> None:
        """Upsert of per-symbol cost settings."""
        path = self._table("settings")
        new = settings.withColumn("ingest_ts", F.current_timestamp())
        old = self.spark.read.json(path) if path_exists(self.spark, path) else None
        merged = new if old is None else old.withColumn("ingest_ts", F.col("ingest_ts").cast("timestamp")).unionByName(new)
        materialise(keep_newest(merged, ["vt_symbol"], "ingest_ts"), "settings").write.mode("overwrite").json(path)

    def load_settings(self) -> DataFrame:
        return self.spark.read.json(self._table("settings")).drop("ingest_ts")

    def save_frames(self, kind: str, name: str, frames: dict[str, DataFrame]) -> None:
        """Named artifact of several frames (a dataset's stages, a run's outputs)."""
        for part, df in frames.items():
            df.write.mode("overwrite").parquet(self._table(f"{kind}/{name}/{part}"))

    def load_frames(self, kind: str, name: str) -> dict[str, DataFrame]:
        base = self._table(f"{kind}/{name}")
        return {p: self.spark.read.parquet(f"{base}/{p}") for p in list_names(self.spark, base) if not p.startswith("_")}

    def list_frames(self, kind: str) -> list[str]:
        return list_names(self.spark, self._table(kind))

    def remove_frames(self, kind: str, name: str) -> bool:
        return remove_path(self.spark, self._table(f"{kind}/{name}"))

    def save_model(self, name: str, model: ReturnModel) -> None:
        """A fitted model: its kind, settings and feature names as JSON, trees in Spark ML's own format."""
        base = self._table(f"models/{name}")
        remove_path(self.spark, base)
        spec = {"kind": type(model).__name__, **model.spec()}
        if model.model is not None:
            model.model.write().overwrite().save(f"{base}/model")
        self.spark.createDataFrame([(json.dumps(spec),)], "value string").coalesce(1).write.text(f"{base}/spec")

    def load_model(self, name: str) -> ReturnModel:
        base = self._table(f"models/{name}")
        if not path_exists(self.spark, f"{base}/spec"):
            raise KeyError(f"no model {name}")
        spec = json.loads(self.spark.read.text(f"{base}/spec").first()["value"])
        model = MODELS[spec.pop("kind")].restored(spec)
        if path_exists(self.spark, f"{base}/model"):
            model.model = GBTRegressionModel.load(f"{base}/model")
        return model

    def list_models(self) -> list[str]:
        return list_names(self.spark, self._table("models"))

    def remove_model(self, name: str) -> bool:
        return remove_path(self.spark, self._table(f"models/{name}"))

    def save_dataset(self, name: str, dataset: Dataset) -> None:
        """The stages of a prepared dataset as frames, its segments and column names as JSON."""
        base = self._table(f"datasets/{name}")
        remove_path(self.spark, base)
        self.save_frames("datasets", name, dataset.stages)
        spec = {"segments": dataset.segments, "features": [*dataset.features, *dataset.results], "has_label": dataset.label is not None}
        self.spark.createDataFrame([(json.dumps(spec),)], "value string").coalesce(1).write.text(f"{base}/_spec")

    def load_dataset(self, name: str) -> SavedDataset:
        base = self._table(f"datasets/{name}")
        if not path_exists(self.spark, f"{base}/_spec"):
            raise KeyError(f"no dataset {name}")
        spec = json.loads(self.spark.read.text(f"{base}/_spec").first()["value"])
        stages = {k: v for k, v in self.load_frames("datasets", name).items()}
        return SavedDataset(stages, {k: tuple(v) for k, v in spec["segments"].items()}, spec["features"])


class SavedDataset:
    """What a model needs of a dataset: stages, segments and the names of its features."""

    def __init__(self, stages: dict[str, DataFrame], segments: dict[str, tuple[str, str]], names: list[str]) -> None:
        self.stages, self.segments = stages, segments
        self.features: dict[str, None] = dict.fromkeys(names)
        self.results: dict[str, DataFrame] = {}

    fetch = Dataset.fetch


def load_panel(bars: DataFrame, symbols: DataFrame | None, start: str, end: str, extended_days: int = 0) -> DataFrame:
    """Multi-symbol panel: widened range, vwap, prices over the first close, rows whose numbers are all 0 blanked."""
    first = F.date_sub(F.lit(start).cast("date"), extended_days)
    last = F.date_add(F.lit(end).cast("date"), extended_days // 10)
    df = bars.where(F.col("datetime").cast("date").between(first, last))
    if symbols is not None:
        df = df.join(symbols.select("vt_symbol").distinct(), "vt_symbol", "left_semi")
    # the first close is one small aggregate per symbol, joined instead of a whole-history window
    base = df.groupBy("vt_symbol").agg(F.min_by("close", "datetime").alias("_base"))
    df = df.join(base, "vt_symbol")
    prices = ["open", "high", "low", "close"]
    df = df.withColumn("vwap", F.try_divide("turnover", "volume"))
    df = df.withColumns({p: F.try_divide(p, "_base") for p in prices}).drop("_base")
    numeric = [*prices, "volume", "turnover", "vwap"]
    # a halted bar keeps its prices; only a row without any number is blanked
    empty = sum((F.coalesce(F.col(n), F.lit(0.0)) for n in numeric[:-1]), F.lit(0.0)) == 0
    return df.withColumns({n: F.when(~empty, F.col(n)) for n in numeric})


def bar_overview(bars: DataFrame) -> DataFrame:
    return bars.groupBy("symbol", "exchange", "interval").agg(
        F.count(F.lit(1)).alias("count"), F.min("datetime").alias("start"), F.max("datetime").alias("end"))


def tick_overview(ticks: DataFrame) -> DataFrame:
    return ticks.groupBy("symbol", "exchange").agg(
        F.count(F.lit(1)).alias("count"), F.min("datetime").alias("start"), F.max("datetime").alias("end"))

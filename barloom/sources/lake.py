"""Lake operations: ingest normalisation, layers, catalog, manifests, lineage, run artifacts."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions.scalars import compact_date
from barloom.operators.dataset import query_by_time
from barloom.operators.quality import DataQualityError, require_columns
from barloom.sources.store import keep_newest, path_exists

# fixed values: column aliases of price files
ALIASES = {
    "date": "datetime", "time": "datetime", "trade_date": "datetime", "symbol": "vt_symbol", "code": "vt_symbol",
    "ts_code": "vt_symbol", "vol": "volume", "amount": "turnover", "open_price": "open", "high_price": "high",
    "low_price": "low", "close_price": "close",
}
PRICE_COLUMNS = ["datetime", "vt_symbol", "open", "high", "low", "close", "volume"]


def normalize_prices(df: DataFrame) -> DataFrame:
    """Rename aliases (unless the target exists), parse times leniently, cast numbers."""
    for old, new in ALIASES.items():
        if old in df.columns and new not in df.columns:
            df = df.withColumnRenamed(old, new)
    if "datetime" in df.columns and dict(df.dtypes)["datetime"] in ("string", "int", "bigint"):
        text = F.col("datetime").cast("string")
        df = df.withColumn("datetime", F.coalesce(
            compact_date(text).cast("timestamp_ntz"), F.try_to_timestamp(text).cast("timestamp_ntz")))
    numbers = [c for c in ("open", "high", "low", "close", "volume", "turnover") if c in df.columns]
    return df.withColumns({c: F.col(c).try_cast("double") for c in numbers})


def read_any(spark: SparkSession, path: str) -> DataFrame:
    if path.endswith(".csv"):
        return spark.read.option("header", True).csv(path)
    return spark.read.option("mergeSchema", True).parquet(path)


def load_price_data(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Parquet and CSV files or folders, columns unioned by name, validated."""
    parts = [normalize_prices(read_any(spark, p)) for p in paths]
    df = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return require_columns(df, PRICE_COLUMNS)


def read_required(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    if not path_exists(spark, path):
        raise FileNotFoundError(path)
    return require_columns(spark.read.parquet(path), columns)


def read_layered(spark: SparkSession, root: str, new: str, legacy: str) -> DataFrame:
    """New layered path first, legacy path second."""
    path = f"{root}/{new}" if path_exists(spark, f"{root}/{new}") else f"{root}/{legacy}"
    if not path_exists(spark, path):
        raise FileNotFoundError(path)
    return spark.read.parquet(path)


def load_selection(selection: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    return query_by_time(selection, start, end, "rebalance_date").orderBy("rebalance_date", "vt_symbol")


def load_benchmark(index_bars: DataFrame, index_symbol: str) -> DataFrame:
    """One index's closes; an index without rows is an error."""
    df = index_bars.where(F.col("index_symbol") == index_symbol).select("datetime", "close")
    if not df.take(1):
        raise DataQualityError(f"no benchmark rows for {index_symbol}")
    return df


def trading_days(calendar: DataFrame, market: str = "SH") -> DataFrame:
    return calendar.where(F.col("market") == market).select("trade_date").distinct().orderBy("trade_date")


def promote(spark: SparkSession, root: str, mapping: dict[str, str]) -> dict[str, list[str]]:
    """Copy legacy datasets into layered names; existing targets are skipped, absent sources listed."""
    done: dict[str, list[str]] = {"copied": [], "skipped": [], "missing": []}
    for source, target in mapping.items():
        if not path_exists(spark, f"{root}/{source}"):
            done["missing"].append(source)
        elif path_exists(spark, f"{root}/{target}"):
            done["skipped"].append(target)
        else:
            df = spark.read.parquet(f"{root}/{source}")
            if "datetime" in df.columns:
                df.withColumn("year", F.year("datetime")).write.partitionBy("year").parquet(f"{root}/{target}")
            else:
                df.write.parquet(f"{root}/{target}")
            done["copied"].append(target)
    return done


def register_views(frames: dict[str, DataFrame]) -> list[str]:
    """A named view per dataset, for plain SQL."""
    for name, df in frames.items():
        df.createOrReplaceTempView(name)
    return sorted(frames)


def merge_shards(shards: list[DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Concatenated shards without non-positive closes, and the symbols dropped wholly."""
    whole = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), shards)
    kept = whole.where(F.col("close") > 0)
    lost = whole.select("vt_symbol").distinct().join(kept.select("vt_symbol").distinct(), "vt_symbol", "left_anti")
    return kept, lost


def normalize_master(records: DataFrame, snapshot_time: str) -> DataFrame:
    """Vendor symbol records: lenient numbers, no empty symbols, stamped."""
    text = ("name", "board", "exchange", "list_date", "delist_date")
    numbers = ("limit_up", "limit_down", "pre_close")
    return records.where(F.trim("vt_symbol") != "").select(
        F.trim("vt_symbol").alias("vt_symbol"),
        *(F.col(c).cast("string").alias(c) for c in text if c in records.columns),
        *(F.col(c).try_cast("double").alias(c) for c in numbers if c in records.columns),
        F.lit(snapshot_time).cast("timestamp").alias("snapshot_time"))


def manifest(frames: dict[str, DataFrame], date: str = "datetime", symbol: str = "vt_symbol") -> DataFrame:
    """Rows, columns, date range, symbols and an order-free content hash per dataset.

    The hash is the sum of the row hashes, so it does not depend on file layout or order.
    """
    def describe(name: str, df: DataFrame) -> DataFrame:
        cols = df.columns
        row_hash = F.xxhash64(*(F.col(c) for c in sorted(cols))).cast("decimal(38,0)")
        return df.agg(
            F.count(F.lit(1)).alias("rows"),
            (F.min(date) if date in cols else F.lit(None)).cast("date").alias("date_min"),
            (F.max(date) if date in cols else F.lit(None)).cast("date").alias("date_max"),
            (F.count_distinct(symbol) if symbol in cols else F.lit(0)).cast("long").alias("symbols"),
            F.sum(row_hash).cast("string").alias("content_hash"),
        ).select(F.lit(name).alias("dataset"), "rows", F.lit(len(cols)).alias("columns"),
                 "date_min", "date_max", "symbols", "content_hash")

    return reduce(DataFrame.unionByName, (describe(n, df) for n, df in frames.items()))


def file_statistics(spark: SparkSession, path: str, previous: DataFrame | None = None, date: str = "datetime", symbol: str = "vt_symbol") -> tuple[DataFrame, int]:
    """Per file of a dataset: file, bytes, changed_at, rows, columns, date_min, date_max, symbols (list), content_hash; and how many files were read.

    Files that ``previous`` knows with the same size and time are not read again; files that are gone leave the result. Row hashes are
    summed, so that those of a dataset are the sum of its files'.
    """
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(path)
    listed = listed.select(F.col("path").alias("file"), F.col("length").alias("bytes"), F.col("modificationTime").alias("changed_at"))
    same = ["file", "bytes", "changed_at"]
    known = None if previous is None else previous.join(listed, same, "left_semi")
    new = listed if known is None else listed.join(known, same, "left_anti")
    files = [r["file"] for r in new.select("file").collect()]  # names of changed files
    if not files:
        return known, 0
    rows = spark.read.option("basePath", path).parquet(*files)
    cols = rows.columns
    row_hash = F.xxhash64(*(F.col(c) for c in sorted(cols))).cast("decimal(38,0)")
    # a file is one group, its symbols are counted once over the whole dataset
    each = rows.select("*", F.col("_metadata.file_path").alias("_file")).groupBy("_file").agg(
        F.count(F.lit(1)).alias("rows"), (F.min(date) if date in cols else F.first(F.lit(None))).cast("date").alias("date_min"),
        (F.max(date) if date in cols else F.first(F.lit(None))).cast("date").alias("date_max"),
        (F.collect_set(F.col(symbol).cast("string")) if symbol in cols else F.first(F.array().cast("array<string>"))).alias("symbols"),
        F.sum(row_hash).cast("string").alias("content_hash"))
    plain = F.regexp_replace(F.col("file"), "^file:/+", "/")
    read = new.join(each, plain == F.regexp_replace("_file", "^file:/+", "/")).select(*same, "rows", F.lit(len(cols)).alias("columns"), "date_min", "date_max", "symbols", "content_hash")
    return (read if known is None else known.unionByName(read)), len(files)


def file_manifest(statistics: dict[str, DataFrame]) -> DataFrame:
    """Manifest rows with bytes and files, from the statistics of the files of each dataset."""
    def describe(name: str, files: DataFrame) -> DataFrame:
        sums = files.agg(F.sum("rows").alias("rows"), F.max("columns").alias("columns"), F.min("date_min").alias("date_min"), F.max("date_max").alias("date_max"),
                         F.sum(F.col("content_hash").cast("decimal(38,0)")).cast("string").alias("content_hash"), F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("files"))
        symbols = files.select(F.explode("symbols").alias("s")).agg(F.count_distinct("s").alias("symbols"))
        return sums.crossJoin(symbols).select(F.lit(name).alias("dataset"), "rows", "columns", "date_min", "date_max", "symbols", "content_hash", "bytes", "files")  # one row each

    return reduce(DataFrame.unionByName, (describe(n, df) for n, df in statistics.items()))


def coherent_date(manifest_rows: DataFrame, core: list[str]) -> DataFrame:
    return manifest_rows.where(F.col("dataset").isin(core)).agg(F.min("date_max").alias("coherent_date"))


def publish_manifest(manifest_rows: DataFrame, root: str, version: str) -> None:
    """Immutable version folder plus a pointer to the current one."""
    spark = manifest_rows.sparkSession
    manifest_rows.withColumn("version", F.lit(version)).write.mode("errorifexists").parquet(f"{root}/versions/{version}")
    spark.createDataFrame([(version,)], "version string").coalesce(1).write.mode("overwrite").json(f"{root}/current")


def current_manifest(spark: SparkSession, root: str) -> DataFrame:
    version = spark.read.schema("version string").json(f"{root}/current").first()["version"]
    return spark.read.parquet(f"{root}/versions/{version}")


def with_version(df: DataFrame, current: DataFrame) -> DataFrame:
    """Version id and latest date of the current manifest attached to a run's rows."""
    head = current.agg(F.max("version").alias("data_version"), F.max("date_max").alias("data_date"))
    return df.crossJoin(F.broadcast(head))


def pinned_context(spark: SparkSession, root: str, core: list[str], frames: dict[str, DataFrame] | None = None) -> DataFrame:
    """The current manifest; fails if a core dataset is absent or its content hash changed."""
    current = current_manifest(spark, root)
    known = {r["dataset"]: r["content_hash"] for r in current.collect()}
    absent = sorted(set(core) - set(known))
    if absent:
        raise DataQualityError(f"missing core datasets: {absent}")
    if frames:
        now = {r["dataset"]: r["content_hash"] for r in manifest({n: frames[n] for n in core}).collect()}
        changed = sorted(n for n in core if now[n] != known[n])
        if changed:
            raise DataQualityError(f"changed since the manifest: {changed}")
    return current


def record(rows: DataFrame, path: str) -> None:
    """Append rows of a lineage or check table with the time of recording."""
    rows.withColumn("recorded_at", F.current_timestamp()).write.mode("append").parquet(path)


def latest_records(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    return keep_newest(spark.read.parquet(path), keys, "recorded_at")


def write_run(frames: dict[str, DataFrame], root: str, run_id: str, config: dict, metrics: DataFrame | None = None) -> str:
    """Frames as Parquet, configuration and metrics as JSON, a short Markdown summary."""
    spark = next(iter(frames.values())).sparkSession
    base = f"{root}/{run_id}"
    for name, df in frames.items():
        df.write.mode("overwrite").parquet(f"{base}/{name}")
    spark.createDataFrame([(json.dumps(config, default=str),)], "value string").coalesce(1).write.mode("overwrite").text(f"{base}/config")
    lines = [f"# Run {run_id}", ""]
    if metrics is not None:
        row = metrics.first().asDict()
        spark.createDataFrame([(json.dumps(row, default=str),)], "value string").coalesce(1).write.mode("overwrite").text(f"{base}/metrics")
        lines += [f"- {k}: {v}" for k, v in row.items()]
    spark.createDataFrame([("\n".join(lines),)], "value string").coalesce(1).write.mode("overwrite").text(f"{base}/summary")
    return base


def write_csv(df: DataFrame, path: str) -> None:
    """Small reports (one row per date) as one CSV file."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)

"""Bars from ticks: the same definition for batch tables and for streams.

Batch: deltas by ``lag``, then grouped windows. Stream: a per-symbol state holds ticks until the
watermark has passed them and releases them in order, so that results do not depend on how
micro-batches are cut; it keeps the last tick and, for bars, the open bar.

Ticks of one symbol are ordered by time, then by ``sequence`` if there is such a column, then by
their cumulative fields, day extremes and price.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

WATERMARK = "1 minute"
TICK_COLUMNS = ["last_price", "volume", "turnover", "high_price", "low_price"]
DELTA_SCHEMA = ("vt_symbol string, datetime timestamp, last_price double, d_volume double, d_turnover double, "
                "new_high double, new_low double")


def _bucket(ts: Column, seconds: int) -> Column:
    return F.floor(F.unix_timestamp(ts.cast("timestamp")) / seconds)


def _order(ticks: DataFrame) -> Column:
    """Order of ticks within a symbol; equal ones are equal in every field that bars read."""
    sequence = [F.col("sequence").cast("long").alias("sequence")] if "sequence" in ticks.columns else []
    return F.struct(F.col("datetime").alias("datetime"), *sequence, "volume", "turnover", "high_price", (-F.col("low_price")).alias("low_price"), "last_price")


def tick_deltas(ticks: DataFrame, seconds: int = 60) -> DataFrame:
    """Positive increments of the cumulative fields and newly reached day extremes (batch).

    The first tick of a bar of ``seconds`` opens it with its own price only, so a day extreme
    reached by that tick does not count.
    """
    # a busy instrument is split by day; the last tick of the day before is one row per day
    t = ticks.where(F.col("last_price") > 0).withColumn("_d", F.col("datetime").cast("date")).withColumn("_at", _order(ticks))
    state = F.struct("datetime", "volume", "turnover", "high_price", "low_price")
    ends = t.groupBy("vt_symbol", "_d").agg(F.max_by(state, "_at").alias("_end"))
    carry = ends.select("vt_symbol", "_d", F.lag("_end").over(
        Window.partitionBy("vt_symbol").orderBy("_d")).alias("_carry"))
    inside = Window.partitionBy("vt_symbol", "_d").orderBy("_at")
    t = t.join(carry, ["vt_symbol", "_d"]).withColumn("_p", F.coalesce(F.lag(state).over(inside), F.col("_carry")))

    def rise(x: str) -> Column:
        return F.greatest(F.coalesce(F.col(x) - F.col("_p")[x], F.lit(0.0)), F.lit(0.0))

    same = _bucket(F.col("datetime"), seconds) == _bucket(F.col("_p")["datetime"], seconds)
    high, low = F.col("high_price"), F.col("low_price")
    return t.select(
        "vt_symbol", F.col("datetime").cast("timestamp").alias("datetime"), "last_price",
        rise("volume").alias("d_volume"), rise("turnover").alias("d_turnover"),
        F.when(same & (high > F.col("_p")["high_price"]), high).alias("new_high"),
        F.when(same & (low < F.col("_p")["low_price"]), low).alias("new_low"), "_at")


def bars_from_deltas(deltas: DataFrame, length: str = "1 minute") -> DataFrame:
    p, at = F.col("last_price"), "_at" if "_at" in deltas.columns else "datetime"
    return deltas.groupBy(F.window("datetime", length).alias("w"), "vt_symbol").agg(
        F.min_by(p, at).alias("open"), F.max(F.greatest(p, F.coalesce("new_high", p))).alias("high"),
        F.min(F.least(p, F.coalesce("new_low", p))).alias("low"), F.max_by(p, at).alias("close"),
        F.sum("d_volume").alias("volume"), F.sum("d_turnover").alias("turnover"),
    ).select("vt_symbol", F.col("w.start").alias("datetime"), "open", "high", "low", "close", "volume", "turnover")


def tick_bars(ticks: DataFrame, seconds: int = 60) -> DataFrame:
    return bars_from_deltas(tick_deltas(ticks, seconds), f"{seconds} seconds")


def _rise(now: float | None, before: float | None) -> float:
    return max(now - before, 0.0) if now is not None and before is not None else 0.0


def _released(ticks: DataFrame, seconds: int, watermark: str, schema: str, take: Callable, close: Callable, due: Callable) -> DataFrame:
    """Ticks in order, each once the watermark has passed it, turned into rows by ``take``.

    ``take(memory, us, price, d_volume, d_turnover, new_high, new_low)`` and, after the released ticks, ``close(memory, us of the
    watermark)`` give rows; ``due(memory, us of the first held tick)`` is the time in us at which something is next to be done. A symbol's memory is JSON text.
    """
    size = seconds * 1_000_000
    names = [c.split(" ")[0] for c in schema.split(", ")]

    def step(key: tuple, frames: Iterator[pd.DataFrame], st) -> Iterator[pd.DataFrame]:
        have = json.loads(st.get[0]) if st.exists else {"last": None, "held": [], "done": None, "memory": {}}
        passed = st.getCurrentWatermarkMs()
        for frame in frames:
            for r in frame.itertuples(index=False):
                if have["done"] is None or r.us > have["done"]:
                    have["held"].append([int(r.us), *(None if pd.isna(x) else x for x in (r.sequence, r.volume, r.turnover, r.high_price, r.low_price, r.last_price))])
        held = sorted(have["held"], key=lambda t: [(x is not None, -x if k == 5 and x is not None else x or 0) for k, x in enumerate(t)])
        ready = sum(t[0] <= passed * 1000 for t in held)
        out, last = [], have["last"]
        for t in held[:ready]:
            us, _, volume, turnover, high, low, price = t
            same = last is not None and us // size == last[0] // size
            before = last or [None] * 7
            out += take(have["memory"], us, price, _rise(volume, before[2]), _rise(turnover, before[3]),
                        high if same and None not in (high, before[4]) and high > before[4] else None,
                        low if same and None not in (low, before[5]) and low < before[5] else None)
            last = t
        out += close(have["memory"], passed * 1000)
        have |= {"last": last, "held": held[ready:], "done": max(passed * 1000, have["done"] or 0)}
        st.update((json.dumps(have),))
        at = due(have["memory"], held[ready][0] if ready < len(held) else None)
        if at is not None:  # a timer fires when the watermark is past it
            st.setTimeoutTimestamp(max(-(-at // 1000) - 1, passed, 1))
        frame = pd.DataFrame([(key[0], *row) for row in out], columns=names)
        for c in names[2:]:
            frame[c] = frame[c].astype("float64")
        frame[names[1]] = frame[names[1]].astype("int64")
        yield frame

    sequence = F.col("sequence").cast("long") if "sequence" in ticks.columns else F.lit(None).cast("long")
    t = ticks.where(F.col("last_price") > 0).select(
        "vt_symbol", F.col("datetime").cast("timestamp").alias("datetime"), sequence.alias("sequence"), *(F.col(c).cast("double") for c in TICK_COLUMNS))
    t = t.withWatermark("datetime", watermark).withColumn("us", F.unix_micros("datetime"))
    out = t.groupBy("vt_symbol").applyInPandasWithState(step, schema, "state string", "append", "EventTimeTimeout")
    return out.select("vt_symbol", F.timestamp_micros("us").alias("datetime"), *names[2:])


def stream_deltas(ticks: DataFrame, seconds: int = 60, watermark: str = WATERMARK) -> DataFrame:
    """``tick_deltas`` on a stream: ticks are released in order once the watermark has passed them.

    Ticks late by less than the watermark and ticks of equal time are kept. Bound the micro-batch at the
    source: a symbol's rows of one batch are ordered in its state task.
    """
    return _released(ticks, seconds, watermark, DELTA_SCHEMA.replace("datetime timestamp", "us long"),
                     lambda memory, *row: [row], lambda memory, us: [], lambda memory, first: first)


def window_bars(bars: DataFrame, length: str) -> DataFrame:
    """Aggregate bars (batch or watermarked stream) to a longer event-time length."""
    return bars.groupBy(F.window("datetime", length).alias("w"), "vt_symbol").agg(
        F.min_by("open", "datetime").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
        F.max_by("close", "datetime").alias("close"), F.sum("volume").alias("volume"), F.sum("turnover").alias("turnover"),
    ).select("vt_symbol", F.col("w.start").alias("datetime"), "open", "high", "low", "close", "volume", "turnover")


def minute_bars(bars: DataFrame, n: int) -> DataFrame:
    if n < 2 or 60 % n:
        raise ValueError("n must divide 60")
    return window_bars(bars, f"{n} minutes")


def hour_bars(bars: DataFrame) -> DataFrame:
    return window_bars(bars, "1 hour")


def n_hour_bars(hours: DataFrame, n: int) -> DataFrame:
    """Every ``n`` consecutive hour bars of a symbol, counted, not aligned to the clock."""
    w = Window.partitionBy("vt_symbol").orderBy("datetime")
    g = hours.withColumn("_g", F.floor((F.row_number().over(w) - 1) / n))
    return g.groupBy("vt_symbol", "_g").agg(
        F.min("datetime").alias("datetime"), F.min_by("open", "datetime").alias("open"), F.max("high").alias("high"),
        F.min("low").alias("low"), F.max_by("close", "datetime").alias("close"), F.sum("volume").alias("volume"),
        F.sum("turnover").alias("turnover"), F.count(F.lit(1)).alias("n_bars")).drop("_g")


def day_bars(bars: DataFrame, daily_end: str = "15:00:00", flush: bool = False) -> DataFrame:
    """One bar per session: a session ends with the bar whose time is ``daily_end`` and bears its date.

    The last, unfinished session of a symbol only appears with ``flush``.
    """
    w = Window.partitionBy("vt_symbol").orderBy("datetime")
    ends = (F.date_format("datetime", "HH:mm:ss") == daily_end).cast("int")
    s = bars.withColumn("_e", ends).withColumn(
        "_s", F.coalesce(F.sum("_e").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    out = s.groupBy("vt_symbol", "_s").agg(
        F.max("datetime").cast("date").alias("datetime"), F.min_by("open", "datetime").alias("open"), F.max("high").alias("high"),
        F.min("low").alias("low"), F.max_by("close", "datetime").alias("close"), F.sum("volume").alias("volume"),
        F.sum("turnover").alias("turnover"), F.max("_e").alias("_e"))
    return (out if flush else out.where("_e = 1")).drop("_e", "_s")


def streaming_bars(ticks: DataFrame, seconds: int = 60, watermark: str = WATERMARK) -> DataFrame:
    """Bars of a tick stream, each once the watermark has passed its end; rows later than the watermark are dropped."""
    size = seconds * 1_000_000

    def take(memory: dict, us: int, price: float, volume: float, turnover: float, high: float | None, low: float | None) -> list[tuple]:
        done = close(memory, us)
        bar = memory.get("bar") or [us // size * size, price, price, price, price, 0.0, 0.0]
        memory["bar"] = [bar[0], bar[1], max(bar[2], price, price if high is None else high), min(bar[3], price, price if low is None else low),
                         price, bar[5] + volume, bar[6] + turnover]
        return done

    def close(memory: dict, us: int) -> list[tuple]:
        ended = memory.get("bar") is not None and memory["bar"][0] + size <= us
        return [tuple(memory.pop("bar"))] if ended else []

    def due(memory: dict, first: int | None) -> int | None:
        start = memory["bar"][0] if memory.get("bar") else None if first is None else first // size * size
        return None if start is None else start + size

    return _released(ticks, seconds, watermark, "vt_symbol string, us long, open double, high double, low double, close double, volume double, turnover double",
                     take, close, due)


def write_stream(df: DataFrame, path: str, checkpoint: str, partition: list[str] | None = None, mode: str = "append"):
    """Parquet sink fed with everything available now."""
    writer = df.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    if partition:
        writer = writer.partitionBy(*partition)
    return writer.trigger(availableNow=True).start()


def record_stream(ticks: DataFrame, contracts: DataFrame, path: str, checkpoint: str):
    """Record the ticks of chosen contracts (a static table joined to the stream)."""
    chosen = contracts.select("vt_symbol").distinct()
    kept = ticks.join(chosen, "vt_symbol", "left_semi").withColumn("day", F.col("datetime").cast("date"))
    return write_stream(kept, path, checkpoint, ["day"])


class Recorder:
    """``foreachBatch`` function that records the chosen contracts of a stream under ``path``.

    The contract table (vt_symbol, exchange, product) is read anew with every batch, so contracts listed later are recorded from
    then on. A batch is written to a folder of its epoch, which a repeated epoch overwrites: a restart writes nothing twice. Ticks and
    bars are two recorders over one source.
    """

    def __init__(self, path: str, contracts: str, exchanges: list[str] | None = None, products: list[str] | None = None) -> None:
        self.path, self.contracts, self.exchanges, self.products = path.rstrip("/"), contracts, exchanges, products

    def chosen(self, spark: SparkSession) -> DataFrame:
        found = spark.read.parquet(self.contracts)
        for column, wanted in (("exchange", self.exchanges), ("product", self.products)):
            found = found if wanted is None else found.where(F.col(column).isin(wanted))
        return found.select("vt_symbol").distinct()

    def __call__(self, batch: DataFrame, epoch: int) -> None:
        kept = batch.join(self.chosen(batch.sparkSession), "vt_symbol", "left_semi").withColumn("day", F.col("datetime").cast("date"))
        kept.write.mode("overwrite").partitionBy("day").parquet(f"{self.path}/epoch={epoch:012d}")

    def start(self, rows: DataFrame, checkpoint: str):
        return rows.writeStream.foreachBatch(self).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def read(self, spark: SparkSession, schema) -> DataFrame:
        """All that was recorded."""
        return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(self.path)


def with_indicators(bars: DataFrame, size: int, windows: tuple[int, ...]) -> DataFrame:
    """Streaming moving averages from a state list of the last ``size`` closes, ready when full."""
    names = [f"sma_{n}" for n in windows]
    schema = "vt_symbol string, datetime timestamp, close double, ready boolean, " + ", ".join(f"{n} double" for n in names)

    def step(key: tuple, frames: Iterator[pd.DataFrame], st) -> Iterator[pd.DataFrame]:
        closes = list(st.get[0]) if st.exists else []
        out = []
        for r in pd.concat(list(frames)).sort_values("datetime").itertuples(index=False):
            closes = (closes + [float(r.close)])[-size:]
            full = len(closes) == size
            out.append((key[0], r.datetime, r.close, full,
                        *(sum(closes[-n:]) / n if full else None for n in windows)))
        st.update((closes,))
        frame = pd.DataFrame(out, columns=["vt_symbol", "datetime", "close", "ready", *names])
        for n in names:
            frame[n] = frame[n].astype("float64")
        yield frame

    rows = bars.select("vt_symbol", F.col("datetime").cast("timestamp").alias("datetime"), F.col("close").cast("double"))
    return rows.groupBy("vt_symbol").applyInPandasWithState(step, schema, "closes array<double>", "append", "NoTimeout")

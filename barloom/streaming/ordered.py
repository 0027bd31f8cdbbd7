"""Keyed streams in event-time order: longer bars by count or session, and indicators over the history of bars.

Rows of a key are held in its state until the watermark has passed them and are then handed, in order of time and as
arrays, to a processor that carries a short array of numbers. So results don't depend on how micro-batches are cut, rows
late by less than the watermark count, later ones are dropped. A timer wakes a key when its next held row is due, and once it
has been idle for ``idle``: its open bar is given out then, and its state is removed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STATE = "us array<bigint>, held array<double>, done bigint, last bigint, memory array<double>"
PRICES = ["open", "high", "low", "close", "volume", "turnover"]


class Processor:
    """What is done with the rows of a key: ``width`` numbers are carried, ``outputs`` are the names of the numbers of a result."""

    width = 0
    outputs: list[str] = []

    def start(self) -> np.ndarray:
        return np.full(self.width, np.nan)

    def step(self, memory: np.ndarray, us: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Times and results (a row each) that the next rows of the key complete; changes ``memory``."""
        raise NotImplementedError

    def flush(self, memory: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What is still open when a key has become idle."""
        return np.zeros(0, np.int64), np.zeros((0, len(self.outputs)))


def microseconds(interval: str) -> int:
    """The length of an interval such as "2 hours"."""
    return int(pd.Timedelta(interval).total_seconds() * 1_000_000)


def in_order(rows: DataFrame, values: list[str | Column], make: Callable[[], Processor], watermark: str, idle: str | None = None,
             key: str = "vt_symbol", time: str = "datetime") -> DataFrame:
    """(key, time, outputs) that a processor makes of the stream ``rows``.

    Rows with a null value or time are passed over. Rows of equal time are ordered by their values.
    """
    processor = make()
    names, width = processor.outputs, len(values)
    far = microseconds(idle) if idle else None

    def step(keys: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        own = make()
        if state.exists:
            us, held, done, last, memory = state.get
            us, held, memory = np.array(us, np.int64), np.array(held, float).reshape(-1, width), np.array(memory, float)
        else:
            us, held, done, last, memory = np.zeros(0, np.int64), np.zeros((0, width)), None, None, own.start()
        passed = state.getCurrentWatermarkMs() * 1000
        parts = [f for f in frames if len(f)]
        if parts:
            frame = pd.concat(parts) if len(parts) > 1 else parts[0]
            frame = frame if done is None else frame[frame["us"] > done]
            us = np.concatenate([us, frame["us"].to_numpy(np.int64)])
            held = np.concatenate([held, frame[[f"v{i}" for i in range(width)]].to_numpy(float)])
        order = np.lexsort([*held.T[::-1], us])
        us, held = us[order], held[order]
        ready = int(np.searchsorted(us, passed, side="right"))
        out = []
        # a key that pauses for ``idle`` starts anew, whether a timer saw it or not
        while ready:
            gaps = np.diff(us[:ready], prepend=us[0] if last is None else last)
            pauses = np.flatnonzero(gaps >= far) if far is not None else np.zeros(0, np.int64)
            if len(pauses) and pauses[0] == 0:
                out.append(own.flush(memory))
                memory, last = own.start(), None
                continue
            stop = int(pauses[0]) if len(pauses) else ready
            out.append(own.step(memory, us[:stop], held[:stop]))
            last, us, held, ready = int(us[stop - 1]), us[stop:], held[stop:], ready - stop
        done = passed if done is None else max(done, passed)
        ended = far is not None and last is not None and not len(us) and passed >= last + far
        if ended:
            out.append(own.flush(memory))
            state.remove()
        else:
            state.update((us.tolist(), held.ravel().tolist(), done, last, memory.tolist()))
            wake = [int(us[0])] if len(us) else [last + far] if far is not None and last is not None else []
            for at in wake:  # a timer fires when the watermark is past it
                state.setTimeoutTimestamp(max(-(-at // 1000) - 1, passed // 1000, 1))
        times = np.concatenate([x[0] for x in out]) if out else np.zeros(0, np.int64)
        found = np.concatenate([x[1] for x in out]) if out else np.zeros((0, len(names)))
        result = pd.DataFrame(found, columns=names)
        result.insert(0, "us", times.astype(np.int64))
        result.insert(0, "key", keys[0])
        yield result

    columns = [(F.col(v) if isinstance(v, str) else v).cast("double").alias(f"v{i}") for i, v in enumerate(values)]
    given = rows.select(F.col(key).alias("key"), F.col(time).cast("timestamp").alias("time"), *columns).dropna()
    given = given.withWatermark("time", watermark).withColumn("us", F.unix_micros("time"))
    schema = "key string, us long, " + ", ".join(f"`{n}` double" for n in names)
    found = given.groupBy("key").applyInPandasWithState(step, schema, STATE, "append", "EventTimeTimeout")
    return found.select(F.col("key").alias(key), F.timestamp_micros("us").alias(time), *names)


def grouped_bars(values: np.ndarray, us: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """(time, open, high, low, close, volume, turnover, number of bars) of the groups of rows that begin at ``starts``."""
    ends = np.append(starts[1:], len(us))
    o, h, lo, c, v, t = values.T[:6]
    return np.stack([us[starts].astype(float), o[starts], np.maximum.reduceat(h, starts), np.minimum.reduceat(lo, starts), c[ends - 1],
                     np.add.reduceat(v, starts), np.add.reduceat(t, starts), (ends - starts).astype(float)], axis=1)


def merged(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """A group of bars and the one that continues it as one."""
    return np.array([first[0], first[1], max(first[2], second[2]), min(first[3], second[3]), second[4], *(first[5:] + second[5:])])


class CountedBars(Processor):
    """Every ``n`` consecutive bars as one, counted from the key's first."""

    width, outputs = 8, [*PRICES, "n_bars"]

    def __init__(self, n: int) -> None:
        self.n = n

    def step(self, memory, us, values):
        have = 0 if np.isnan(memory[7]) else int(memory[7])
        group = (have + np.arange(len(us))) // self.n
        bars = grouped_bars(values, us, np.flatnonzero(np.diff(group, prepend=-1)))
        return self.closed(memory, bars, have > 0, (have + len(us)) % self.n == 0)

    def closed(self, memory, bars, joins, complete):
        if joins:
            bars[0] = merged(memory, bars[0])
        memory[:] = np.nan if complete else bars[-1]
        bars = bars if complete else bars[:-1]
        return bars[:, 0].astype(np.int64), bars[:, 1:]

    def flush(self, memory):
        bars = memory[None] if not np.isnan(memory[7]) else np.zeros((0, 8))
        return bars[:, 0].astype(np.int64), bars[:, 1:]


class SessionBars(CountedBars):
    """Bars up to one that ends a session (its seventh value is 1) as one, which bears the session's last time."""

    def __init__(self) -> None:
        pass

    def step(self, memory, us, values):
        ends = values[:, 6] > 0
        bars = grouped_bars(values, us, np.flatnonzero(np.append(True, ends[:-1])))
        bars[:, 0] = us[np.append(np.flatnonzero(np.append(True, ends[:-1]))[1:], len(us)) - 1]
        late = bars[:, 0].copy()
        joins = not np.isnan(memory[7])
        if joins:
            bars[0] = merged(memory, bars[0])
        bars[:, 0] = late
        return self.closed(memory, bars, False, bool(ends[-1]))


def streaming_counted_bars(bars: DataFrame, n: int, watermark: str, idle: str | None = None) -> DataFrame:
    """``n_hour_bars`` on a stream of bars: complete groups of ``n``; with ``idle`` also the open one of a key that became idle."""
    return in_order(bars, list(PRICES), lambda: CountedBars(n), watermark, idle)


def streaming_session_bars(bars: DataFrame, watermark: str, daily_end: str = "15:00:00", idle: str | None = None) -> DataFrame:
    """``day_bars`` on a stream of bars: sessions closed by the bar at ``daily_end``; with ``idle`` also the open one of an idle key."""
    ends = (F.date_format("datetime", "HH:mm:ss") == daily_end).cast("int")
    found = in_order(bars, [*PRICES, ends], SessionBars, watermark, idle)
    return found.select("vt_symbol", F.col("datetime").cast("date").alias("datetime"), *PRICES)


def recursion(x: np.ndarray, value: float, alpha: float) -> np.ndarray:
    """y[t] = (1 - alpha) * y[t-1] + alpha * x[t] from y = ``value`` on, a block of rows at a time."""
    keep, out = 1.0 - alpha, np.empty(len(x))
    size = 64
    lag = np.arange(size)[:, None] - np.arange(size)
    weights = np.where(lag >= 0, keep ** np.maximum(lag, 0), 0.0) * alpha
    decay = keep ** np.arange(1, size + 1)
    for k in range(0, len(x), size):
        some = x[k : k + size]
        out[k : k + size] = weights[: len(some), : len(some)] @ some + decay[: len(some)] * value
        value = out[k + len(some) - 1]
    return out


def smoothed(memory: np.ndarray, x: np.ndarray, alpha: float, n: int) -> np.ndarray:
    """The next values of an average seeded by the mean of its first ``n``; ``memory`` holds the count and the sum, later the value."""
    out = np.full(len(x), np.nan)
    count = int(np.nan_to_num(memory[0]))
    k = 0
    if count < n:
        k = min(n - count, len(x))
        memory[1] = np.nan_to_num(memory[1]) + x[:k].sum()
        memory[0] = count + k
        if count + k < n:
            return out
        memory[1] /= n
        if k:
            out[k - 1] = memory[1]
    if k < len(x):
        out[k:] = recursion(x[k:], memory[1], alpha)
        memory[1] = out[-1]
    return out


class Indicators(Processor):
    """Moving averages over a ring of closes, exponential averages, RSI, ATR and MACD, each null until it has its samples."""

    def __init__(self, sma: tuple[int, ...] = (), ema: tuple[int, ...] = (), rsi: int = 14, atr: int = 14, macd: tuple[int, int, int] = (12, 26, 9)) -> None:
        self.sma, self.ema, self.rsi, self.atr, self.macd = sma, ema, rsi, atr, macd
        self.ring = max(sma, default=0)
        # bars seen, last close, and for each average its count and value
        self.width = 2 + 2 * (len(ema) + 2 + 1 + 3) + self.ring
        self.outputs = ["close", *(f"sma_{n}" for n in sma), *(f"ema_{n}" for n in ema), "rsi", "atr", "macd", "macd_signal", "macd_hist"]

    def step(self, memory, us, values):
        high, low, close = values.T[:3]
        m, averages = len(us), memory[2 : self.width - self.ring].reshape(-1, 2)
        seen, last = int(np.nan_to_num(memory[0])), memory[1]
        out = [close]
        ring = memory[self.width - self.ring :]
        for n in self.sma:
            both = np.concatenate([ring[self.ring - n :], close])
            windows = np.lib.stride_tricks.sliding_window_view(both, n)[1:]
            out.append(windows.mean(axis=1))  # not a number until the ring is full
        if self.ring:
            ring[:] = np.concatenate([ring, close])[-self.ring :]
        for k, n in enumerate(self.ema):
            out.append(smoothed(averages[k], close, 2.0 / (n + 1), n))
        at = len(self.ema)
        before = np.append(last, close[:-1])
        skip = 1 if seen == 0 else 0  # moves begin with the second bar
        step, wide = (close - before)[skip:], np.maximum(high - low, np.maximum(abs(high - before), abs(low - before)))[skip:]
        rise, fall = (np.append(np.full(skip, np.nan), smoothed(averages[at + i], np.maximum(s, 0.0), 1.0 / self.rsi, self.rsi)) for i, s in enumerate((step, -step)))
        total = rise + fall
        out.append(np.where(total == 0, 0.0, rise * 100.0 / np.where(total == 0, 1.0, total)))
        out.append(np.append(np.full(skip, np.nan), smoothed(averages[at + 2], wide, 1.0 / self.atr, self.atr)))
        fast, slow, signal = self.macd
        late = min(m, max(0, slow - fast - seen))  # both averages start on the same bar
        line = np.append(np.full(late, np.nan), smoothed(averages[at + 3], close[late:], 2.0 / (fast + 1), fast))
        line -= smoothed(averages[at + 4], close, 2.0 / (slow + 1), slow)
        some = ~np.isnan(line)
        mean = np.full(m, np.nan)
        mean[some] = smoothed(averages[at + 5], line[some], 2.0 / (signal + 1), signal)
        line = np.where(np.isnan(mean), np.nan, line)
        memory[0], memory[1] = seen + m, close[-1]
        return us, np.stack([*out, line, mean, line - mean], axis=1)


def streaming_indicators(bars: DataFrame, watermark: str, idle: str | None = None, **settings) -> DataFrame:
    """Indicators of every bar of a stream, equal to those of the batch terms; a key idle for ``idle`` starts anew."""
    found = in_order(bars, ["high", "low", "close"], lambda: Indicators(**settings), watermark, idle)
    return found.select("vt_symbol", "datetime", *(F.nanvl(c, F.lit(None).cast("double")).alias(c) for c in found.columns[2:]))

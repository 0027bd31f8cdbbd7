"""Recurrences no window can express: adaptive average, parabolic stop, position roll-up.

Rows are partitioned by instrument and sorted by time; every task walks its Arrow batches once
and carries only the small state of the current instrument, so a long history is never
collected and memory does not grow with it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Step = Callable[[Any, tuple], tuple[Any, tuple]]


def fold(
    df: DataFrame, key: str, order: list[str], inputs: list[str], outputs: dict[str, str],
    start: Callable[[], Any], step: Step,
) -> DataFrame:
    """``step(state, input values) -> (state, output values)`` over each key in order.

    ``outputs`` maps new column names to SQL types; all columns of ``df`` are kept.
    """
    names = list(outputs)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields),
                        *(f"`{n}` {t}" for n, t in outputs.items())])

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = None, None
        for batch in batches:
            found = []
            for k, *values in batch[[key, *inputs]].itertuples(index=False, name=None):
                if state is None or k != current:
                    current, state = k, start()
                state, result = step(state, tuple(values))
                found.append(result)
            out = batch.copy()
            for at, name in enumerate(names):
                out[name] = [r[at] for r in found]
            yield out

    return df.repartition(F.col(key)).sortWithinPartitions(key, *order).mapInPandas(walk, schema)


def kama(df: DataFrame, n: int, symbol: str = "vt_symbol", time: str = "datetime",
         fast: int = 2, slow: int = 30) -> DataFrame:
    """Kaufman adaptive average of ``close``: smoothing speed from the efficiency ratio."""
    quick, lazy = 2.0 / (fast + 1), 2.0 / (slow + 1)

    def step(state: list, values: tuple) -> tuple[list, tuple]:
        closes, average = state
        closes = (closes + [values[0]])[-(n + 1):]
        if len(closes) <= n:
            return [closes, values[0]], (None,)
        travel = sum(abs(b - a) for a, b in zip(closes, closes[1:]))
        net = closes[-1] - closes[0]
        ratio = 1.0 if travel <= net or travel == 0 else abs(net / travel)
        speed = (ratio * (quick - lazy) + lazy) ** 2
        average = average + speed * (values[0] - average)
        return [closes, average], (average,)

    return fold(df, symbol, [time], ["close"], {"kama": "double"}, lambda: [[], None], step)


def sar(df: DataFrame, acceleration: float, maximum: float,
        symbol: str = "vt_symbol", time: str = "datetime") -> DataFrame:
    """Parabolic stop-and-reverse of ``high`` and ``low``."""

    def step(state: dict, values: tuple) -> tuple[dict, tuple]:
        high, low = values
        if not state:
            return {"high": high, "low": low, "first": True}, (None,)
        s = dict(state)
        before_high, before_low = s["high"], s["low"]
        if s.pop("first", False):
            fall, rise = before_low - low, high - before_high
            s["long"] = not (fall > 0 and rise < fall)
            s["extreme"], s["stop"] = (high, before_low) if s["long"] else (low, before_high)
            s["speed"] = acceleration
            before_high, before_low = high, low
        s["high"], s["low"] = high, low
        sense = 1.0 if s["long"] else -1.0
        # mirrored coordinates: in a short position highs and lows swap roles
        near, near_before = (low, before_low) if s["long"] else (high, before_high)
        far, far_before = (high, before_high) if s["long"] else (low, before_low)
        if (near - s["stop"]) * sense <= 0:
            pick = max if s["long"] else min
            shown = pick(s["extreme"], far_before, far)
            s["long"], s["speed"], s["extreme"] = not s["long"], acceleration, near
            s["stop"] = pick(shown + s["speed"] * (near - shown), far_before, far)
            return s, (shown,)
        shown = s["stop"]
        if (far - s["extreme"]) * sense > 0:
            s["extreme"], s["speed"] = far, min(s["speed"] + acceleration, maximum)
        pick = min if s["long"] else max
        s["stop"] = pick(shown + s["speed"] * (s["extreme"] - shown), near_before, near)
        return s, (shown,)

    return fold(df, symbol, [time], ["high", "low"], {"sar": "double"}, dict, step)

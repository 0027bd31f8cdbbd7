"""Rolling terms of long windows, over Arrow batches of rows in the order of their instruments.

A window frame of Spark folds all its rows anew for every row. Here the k-th row of all windows is one slice of the column, so a
window of n rows takes n vector operations a batch. Sums and deviations are updated row by row from the oldest one, in the order
and with the formulas of Spark's aggregates, so that both give the same bits. A task holds one batch and the rows before it that
its windows reach back to.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SEQ = "_seq"
INTEGERS = ("tinyint", "smallint", "int")
Got = tuple[np.ndarray, np.ndarray]


class Block:
    """Columns of a batch behind ``pad`` rows of the batches before, the rows' numbers within their instrument, and the counts so far."""

    def __init__(self, values: dict[str, np.ndarray], nulls: dict[str, np.ndarray], seq: np.ndarray, pad: int, state: dict[str, int]) -> None:
        self.values, self.nulls, self.seq, self.pad, self.state = values, nulls, seq, pad, state
        self._codes: dict[str, np.ndarray] = {}

    def full(self, names: list[str], n: int) -> np.ndarray:
        """Which rows have a window of n rows without a null."""
        missing = np.zeros(len(self.seq) + self.pad + 1, np.int64)
        np.cumsum(np.logical_or.reduce([self.nulls[c] for c in names]), out=missing[1:])
        end = np.arange(len(self.seq)) + self.pad + 1
        return (self.seq >= n) & (missing[end] == missing[end - n])

    def steps(self, arrays: list[np.ndarray], n: int) -> Iterator[tuple[list[np.ndarray], None]]:
        """The k-th row of every window, as if all windows were full."""
        for at in range(self.pad - n + 1, self.pad + 1):
            yield [a[at : at + len(self.seq)] for a in arrays], None

    def some(self, arrays: list[np.ndarray], n: int, rows: np.ndarray, nulls: list[np.ndarray]) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
        """The k-th row of the windows of ``rows``, and where it exists and is not null."""
        for back in range(n - 1, -1, -1):
            at = rows + (self.pad - back)
            ok = self.seq[rows] > back
            for x in nulls:
                ok &= ~x[at]
            yield [a[at] for a in arrays], ok

    def codes(self, name: str) -> np.ndarray:
        """Places of the values in their order: nulls are 0, and NaN is the largest."""
        if name not in self._codes:
            place = np.unique(self.values[name], return_inverse=True)[1].astype(np.int64) + 1
            self._codes[name] = np.where(self.nulls[name], 0, place)
        return self._codes[name]


def _sum(steps: Iterator, size: int) -> Got:
    total, count = np.zeros(size), np.zeros(size)
    for (x,), ok in steps:
        total += x if ok is None else np.where(ok, x, 0.0)
        count += 1 if ok is None else ok
    return total, count


def _sums(steps: Iterator, size: int) -> Got:
    total, count = _sum(steps, size)
    return total, count == 0


def _means(steps: Iterator, size: int) -> Got:
    total, count = _sum(steps, size)
    return total / count, count == 0


def _moments(steps: Iterator, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sum of products of deviations, sum of squared deviations of the first series, and count."""
    xa, ya, both, own, count = (np.zeros(size) for _ in range(5))
    for k, ((x, y), ok) in enumerate(steps, 1):
        dx, dy = x - xa, y - ya
        now = k if ok is None else count + 1
        nx, ny = xa + dx / now, ya + dy / now
        if ok is None:
            xa, ya, count = nx, ny, np.broadcast_to(float(k), size)
            both += dx * (y - ny)
            own += dx * (dx - dx / now)
        else:
            xa, ya, count = np.where(ok, nx, xa), np.where(ok, ny, ya), count + ok
            both += np.where(ok, dx * (y - ny), 0.0)
            own += np.where(ok, dx * (dx - dx / now), 0.0)
    return both, own, count


def _covariances(steps: Iterator, size: int) -> Got:
    xa, ya, both, count = (np.zeros(size) for _ in range(4))
    for k, ((x, y), ok) in enumerate(steps, 1):
        dx = x - xa
        if ok is None:
            xa = xa + dx / k
            ya = xa if x is y else ya + (y - ya) / k
            both += dx * (y - ya)
            count[:] = k
        else:
            now = count + 1
            nx, ny = xa + dx / now, ya + (y - ya) / now
            both += np.where(ok, dx * (y - ny), 0.0)
            xa, ya, count = np.where(ok, nx, xa), np.where(ok, ny, ya), count + ok
    return both / count, count == 0


def _deviations(steps: Iterator, size: int) -> Got:
    value, null = _covariances((([x, x], ok) for (x,), ok in steps), size)
    return np.sqrt(value), null


def _slopes(steps: Iterator, size: int) -> Got:
    both, own, count = _moments(steps, size)
    return both / own, count < 2


def _maxima(steps: Iterator, size: int) -> Got:
    best, count = np.full(size, -np.inf), np.zeros(size)
    for (x,), ok in steps:
        best = np.maximum(best, x if ok is None else np.where(ok, x, -np.inf))
        count += 1 if ok is None else ok
    return best, count == 0


def _minima(steps: Iterator, size: int) -> Got:
    best, count = np.full(size, np.nan), np.zeros(size)
    for (x,), ok in steps:
        best = np.fmin(best, x if ok is None else np.where(ok, x, np.nan))
        count += 1 if ok is None else ok
    return best, count == 0


def _both_ways(fold: Callable[[Iterator, int], Got]) -> Callable[[Block, list[str], int], Got]:
    """Full windows by slices, the others (first rows, nulls) by picking their rows."""
    def run(block: Block, names: list[str], n: int) -> Got:
        arrays = [block.values[c] for c in names]
        value, null = fold(block.steps(arrays, n), len(block.seq))
        value, null = np.array(value, float), np.array(null, bool)
        rows = np.flatnonzero(~block.full(names, n))
        if len(rows):
            value[rows], null[rows] = fold(block.some(arrays, n, rows, [block.nulls[c] for c in names]), len(rows))
        return value, null
    return run


def _extremes(largest: bool, newest: bool) -> Callable[[Block, list[str], int], Got]:
    """Row numbers of the extremes; a null is smaller than any value."""
    def run(block: Block, names: list[str], n: int) -> Got:
        size = len(block.seq)
        width = block.pad + size
        rising = newest == largest
        # the code above the place, so that one comparison settles ties
        key = block.codes(names[0]) * width + (np.arange(width) if rising else np.arange(width)[::-1])
        pick, worst = (np.maximum, -1) if largest else (np.minimum, np.iinfo(np.int64).max)
        best = np.full(size, worst)
        for (x,), _ in block.steps([key], n):
            best = pick(best, x)
        rows = np.flatnonzero(block.seq < n)
        if len(rows):
            part = np.full(len(rows), worst)
            for (x,), ok in block.some([key], n, rows, []):
                part = pick(part, np.where(ok, x, worst))
            best[rows] = part
        at = best % width
        return block.values[names[1]][at if rising else width - 1 - at], np.zeros(size, bool)
    return run


def _ranks(block: Block, names: list[str], n: int) -> Got:
    """Average rank of the newest value in full windows."""
    codes = block.codes(names[0])
    me, twice = codes[block.pad :], np.zeros(len(block.seq), np.int64)
    for (v,), _ in block.steps([codes], n):
        twice += v < me
        twice += v <= me
    return (twice + 1) / (2.0 * n), ~block.full(names, n)


def _delayed(block: Block, names: list[str], n: int) -> Got:
    """The oldest row of the window."""
    at = slice(block.pad - n + 1, block.pad - n + 1 + len(block.seq))
    return block.values[names[0]][at], block.nulls[names[0]][at] | (block.seq < n)


def _counts(block: Block, names: list[str], n: int) -> Got:
    """Values of the instrument so far."""
    there = ~block.nulls[names[0]][block.pad :]
    total = np.cumsum(there)
    base = np.where(block.seq == 1, total - there, -block.state.get(names[0], 0) if block.seq[0] > 1 else 0)
    count = total - np.maximum.accumulate(base)
    block.state[names[0]] = int(count[-1])
    return count.astype(float), np.zeros(len(count), bool)


#: Operators that can be rolled: kernel, whether it compares rounded values, whether it also reads row numbers (before or behind its own column).
ROLLED: dict[str, tuple[Callable[[Block, list[str], int], Got], bool, str]] = {
    "win_sum": (_both_ways(_sums), False, ""), "ts_mean": (_both_ways(_means), False, ""),
    "ts_std": (_both_ways(_deviations), False, ""), "win_cov": (_both_ways(_covariances), False, ""),
    "win_slope": (_both_ways(_slopes), False, "before"),
    "ts_max": (_both_ways(_maxima), False, ""), "ts_min": (_both_ways(_minima), False, ""),
    "win_argmax": (_extremes(True, False), True, "behind"), "win_argmin": (_extremes(False, False), True, "behind"),
    "win_last_high": (_extremes(True, True), True, "behind"), "win_last_low": (_extremes(False, True), True, "behind"),
    "ts_rank": (_ranks, True, ""), "ts_delay": (_delayed, False, ""), "count_so_far": (_counts, False, ""),
}
#: Cheap as windows of Spark, hence rolled only where they read rolled terms: these need no new exchange then.
FOLLOWERS = ("ts_delay", "count_so_far", "win_sum", "ts_mean", "ts_max", "ts_min")


def rows_of(op: str, params: tuple) -> int:
    """Rows of an operator's window."""
    return 1 if op == "count_so_far" else params[0] + (op == "ts_delay")


def plain(schema: T.StructType) -> bool:
    """Whether all columns are of simple types."""
    return not any(isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType, T.UserDefinedType)) for f in schema.fields)


def rolled(frame: DataFrame, todo: dict[str, tuple[str, list[Column], int]], ordinal: Column, steady: Callable[[Column], Column]) -> DataFrame:
    """``frame`` with rolling terms ``{name: (operator, columns, rows)}`` added, as doubles.

    Rows must lie in the order of their instruments and carry their numbers in ``SEQ``, as a window of the instrument leaves them.
    """
    names: dict[str, str] = {}
    inputs: list[Column] = []

    def column(x: Column) -> str:
        text = str(x)
        if text not in names:
            names[text] = f"_x{len(names)}"
            inputs.append(x.cast("double").alias(names[text]))
        return names[text]

    plan = []
    for name, (op, args, n) in todo.items():
        _, rounded, numbered = ROLLED[op]
        own = [column(steady(a.cast("double")) if rounded else a) for a in args]
        own = own if not numbered else [column(ordinal), *own] if numbered == "before" else [*own, column(ordinal)]
        plan.append((name, op, own, n))
    keep, pad = len(frame.columns), max(n for *_, n in plan) - 1
    schema = T.StructType([*frame.schema.fields, *(T.StructField(name, T.DoubleType()) for name in todo)])
    used, at = list(names.values()), frame.columns.index(SEQ)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict[str, int] = {}
        values = {c: np.zeros(pad) for c in used}
        nulls = {c: np.ones(pad, bool) for c in used}
        for batch in batches:
            if not batch.num_rows:
                continue
            for k, c in enumerate(used):
                x = batch.column(keep + k)
                nulls[c] = np.concatenate([nulls[c], x.is_null().to_numpy(zero_copy_only=False)])
                values[c] = np.concatenate([values[c], x.fill_null(0.0).to_numpy(zero_copy_only=False)])
            block = Block(values, nulls, batch.column(at).to_numpy(zero_copy_only=False), pad, state)
            with np.errstate(all="ignore"):
                got = [ROLLED[op][0](block, own, n) for _, op, own, n in plan]
            yield pa.RecordBatch.from_arrays([*batch.columns[:keep], *(pa.array(v, pa.float64(), mask=m) for v, m in got)], names=schema.names)
            values = {c: x[len(x) - pad :] for c, x in values.items()}
            nulls = {c: x[len(x) - pad :] for c, x in nulls.items()}

    return frame.select("*", *inputs).mapInArrow(walk, schema)

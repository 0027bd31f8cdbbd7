"""Running terms over histories too long for one window: each piece of a history is reduced to a row, pieces combine in order.

A running sum, extreme, product, count, first or last value up to a row is the one inside the row's piece combined with that of all
earlier pieces, which is a running value over one row a piece. No task sorts more than a piece of an instrument.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barloom.functions.algebra import ORDINAL
from barloom.session import materialise


def _both(join: Callable[[Column, Column], Column]) -> Callable[[Column, Column], Column]:
    """``join`` of the value before a piece and the value inside it, where either may be missing."""
    return lambda before, inside: F.when(before.isNull(), inside).when(inside.isNull(), before).otherwise(join(before, inside))


def _first(x: Column, time: str) -> Column:
    return F.min_by(x, F.when(x.isNotNull(), F.col(time)))


def _last(x: Column, time: str) -> Column:
    return F.max_by(x, F.when(x.isNotNull(), F.col(time)))


def _earliest(x: Column) -> Column:
    return F.first(x, ignorenulls=True)


def _latest(x: Column) -> Column:
    return F.last(x, ignorenulls=True)


def _counted(before: Column, inside: Column) -> Column:
    return (F.coalesce(before, F.lit(0)) + inside).cast("double")


#: For each operator: inside a piece, one row a piece, over rows of pieces, and how the two are combined.
RUNNING: dict[str, tuple[Callable, Callable, Callable, Callable]] = {
    "run_sum": (F.sum, lambda x, time: F.sum(x), F.sum, _both(lambda a, b: a + b)),
    "run_max": (F.max, lambda x, time: F.max(x), F.max, _both(F.greatest)),
    "run_product": (F.product, lambda x, time: F.product(x), F.product, _both(lambda a, b: a * b)),
    "run_count": (F.count, lambda x, time: F.count(x), F.sum, _counted),
    "count_so_far": (F.count, lambda x, time: F.count(x), F.sum, _counted),
    "first_value": (_earliest, _first, _earliest, lambda a, b: F.coalesce(a, b)),
    "fill_forward": (_latest, _last, _latest, lambda a, b: F.coalesce(b, a)),
    "last_before": (_latest, _last, _latest, lambda a, b: F.coalesce(b, a)),
}


def _block_carries(frame: DataFrame, blocks: list[list[Column]], own: list[str]) -> DataFrame:
    """For each piece and block sum a map from the block's key to the block's sum in earlier pieces, where there are any."""
    entries = F.array(*[F.struct(F.lit(b).alias("b"), key.alias("key"), x.cast("double").alias("x")) for b, (x, key) in enumerate(blocks)])
    sums = frame.select(*own, F.inline(entries)).where("key IS NOT NULL AND x IS NOT NULL").groupBy(*own, "b", "key").agg(F.sum("x").alias("x"))
    earlier = Window.partitionBy(own[0], "b", "key").orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("x", F.sum("x").over(earlier)).where("x IS NOT NULL")
    return sums.groupBy(*own).agg(*[F.map_from_entries(F.collect_list(F.when(F.col("b") == b, F.struct("key", "x")))).alias(f"_m{b}") for b in range(len(blocks))])


def carried(frame: DataFrame, todo: dict[str, tuple[str, list[Any]]], symbol: str, time: str, size: int, paths: list[str],
            remade: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> DataFrame:
    """``frame`` with the running terms ``{name: (operator, columns)}`` added; rows are numbered within their instrument.

    A block's sum is carried like the others, by the block's key, so that all terms of a layer share one exchange of the rows.
    Rows without a block are summed inside their piece. ``paths`` names the table of the layer before, which only this one reads.
    ``remade`` adds columns that are made anew from those of a row and need not be stored.
    """
    frame = frame.withColumn("_piece", F.floor((F.col(ORDINAL) - 1) / F.lit(size)))
    own = [symbol, "_piece"]
    inside = Window.partitionBy(*own).orderBy(time)
    past, before = inside.rowsBetween(Window.unboundedPreceding, 0), inside.rowsBetween(Window.unboundedPreceding, -1)
    # read for the pieces and for the rows
    frame = materialise(frame, "history", paths)
    full = remade(frame)
    columns = list(full.columns)
    running = {n: (op, args[0]) for n, (op, args) in todo.items() if op in RUNNING}
    blocks = {n: args for n, (op, args) in todo.items() if op == "block_sum"}
    # exchanged as it is stored, and so for the windows even if the carries are broadcast
    rows = frame.repartition(*own)
    if running:
        parts = full.groupBy(*own).agg(*[RUNNING[op][1](x, time).alias(f"_p{k}") for k, (op, x) in enumerate(running.values())])
        earlier = Window.partitionBy(symbol).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
        carry = parts.select(*own, *[RUNNING[op][2](F.col(f"_p{k}")).over(earlier).alias(f"_b{k}") for k, (op, _) in enumerate(running.values())])
        rows = rows.join(carry, own)
    if blocks:
        rows = rows.join(_block_carries(full, list(blocks.values()), own), own, "left")
    rows = remade(rows)
    rows = rows.select(*columns, *[c for c in rows.columns if c.startswith("_m") and c not in columns],
                       *[RUNNING[op][3](F.col(f"_b{k}"), RUNNING[op][0](x).over(before if op == "last_before" else past)).alias(n) for k, (n, (op, x)) in enumerate(running.items())])
    for b, (name, (x, key)) in enumerate(blocks.items()):
        block = Window.partitionBy(*own, key).orderBy(time).rowsBetween(Window.unboundedPreceding, 0)
        carry = F.when(key.isNotNull(), F.try_element_at(F.col(f"_m{b}"), key))
        rows = rows.withColumn(name, _both(lambda a, c: a + c)(carry, F.sum(x).over(block)))
    return rows.select(*columns, *running, *blocks).drop("_piece")

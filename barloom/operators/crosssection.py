"""Per-date terms for dates too wide for one window partition.

Aggregates are grouped (with map-side partial aggregation) and joined back. Ranks are exact:
distinct values are counted first, cut into value ranges by approximate quantiles, ranked
inside each range and shifted by the totals of the ranges below. The quantiles only affect
balance, never the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barloom.functions.algebra import OPERATORS, RANKS, steady
from barloom.session import materialise


def exact_rank(df: DataFrame, value: str, by: list[str], rows_per_range: int, widest: int) -> DataFrame:
    """Average-tie rank of every distinct value: columns ``by``, value, ``rank``.

    ``widest`` is an upper bound on rows per group, from which the number of ranges follows.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))
    ranges = max(2, -(-widest // max(rows_per_range, 1)))
    probs = [k / ranges for k in range(1, ranges)]
    bounds = counts.groupBy(*by).agg(
        F.percentile_approx(value, probs, 20 * ranges).alias("bounds"))
    placed = counts.join(bounds, by).withColumn(
        "part", F.size(F.filter("bounds", lambda b: b < F.col(value)))).drop("bounds")
    totals = placed.groupBy(*by, "part").agg(F.sum("n").alias("in_part"))
    lower = Window.partitionBy(*by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*by, "part", F.coalesce(F.sum("in_part").over(lower), F.lit(0)).alias("below"))
    inside = Window.partitionBy(*by, "part").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    return placed.join(totals, [*by, "part"]).select(
        *by, value,
        (F.col("below") + F.sum("n").over(inside) - (F.col("n") - 1) / F.lit(2.0)).alias("rank"))


def keys_repeat(df: DataFrame, symbol: str, time: str) -> bool:
    """Whether two rows have the same key; nothing but the keys is read."""
    return not df.groupBy(symbol, time).agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()


def many_ranks(df: DataFrame, inputs: dict[str, Column], symbol: str, time: str, repeated: bool = True) -> DataFrame:
    """Add average-tie ranks of many columns with one sort instead of one sort per column.

    The inputs are laid out as rows (date, column number, value), ranked together and folded
    back; the other columns travel with the first of these rows, so nothing is joined. If keys may be ``repeated``, their
    rows are told apart by a hash of all their columns; equal rows have equal ranks and are repeated.
    """
    if not repeated:
        return _ranks_of_keys(df, inputs, symbol, time)
    row = F.struct(*df.columns)
    values = F.array(*(F.struct(steady(x).cast("double").alias("_x"), F.when(F.lit(k == 0), row).alias("_row"))
                       for k, x in enumerate(inputs.values())))
    cells = df.select(F.col(time).alias("_t"), F.col(symbol).alias("_s"), F.xxhash64(*df.columns).alias("_h"), F.posexplode(values).alias("_k", "_v"))
    cells = cells.select("_t", "_s", "_h", "_k", "_v._x", "_v._row")
    cells = cells.withColumn("_r", _rank())
    folded = cells.groupBy("_t", "_s", "_h").agg(
        F.first("_row", ignorenulls=True).alias("_row"),
        F.array_sort(F.collect_list(F.struct("_k", "_r"))).alias("_ranks"))
    folded = folded.withColumn("_n", (F.size("_ranks") / F.lit(len(inputs))).cast("int"))
    folded = folded.withColumn("_copy", F.explode(F.array_repeat(F.lit(1), F.col("_n"))))
    return folded.select("_row.*", *(
        F.get("_ranks", F.lit(k) * F.col("_n"))["_r"].alias(name) for k, name in enumerate(inputs)))


def _rank() -> Column:
    """Average-tie rank of ``_x`` within a date and column; null where it is missing."""
    spec = Window.partitionBy("_t", "_k").orderBy("_x")
    same = spec.rangeBetween(Window.currentRow, Window.currentRow)
    missing = F.count(F.when(F.col("_x").isNull(), 1)).over(spec.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    rank = F.rank().over(spec) - missing + (F.count(F.lit(1)).over(same) - 1) / F.lit(2.0)
    return F.when(F.col("_x").isNotNull(), rank)


def _ranks_of_keys(df: DataFrame, inputs: dict[str, Column], symbol: str, time: str) -> DataFrame:
    """``many_ranks`` where a key has one row: cells carry the key alone, and each column's rank is the one cell of its number."""
    row = F.struct(*df.columns)
    values = F.array(*(F.struct(steady(x).cast("double").alias("_x"), F.when(F.lit(k == 0), row).alias("_row")) for k, x in enumerate(inputs.values())))
    cells = df.select(F.col(time).alias("_t"), F.col(symbol).alias("_s"), F.posexplode(values).alias("_k", "_v")).select("_t", "_s", "_k", "_v._x", "_v._row")
    cells = cells.withColumn("_r", _rank())
    folded = cells.groupBy("_t", "_s").agg(F.first("_row", ignorenulls=True).alias("_row"), F.array_sort(F.collect_list(F.struct("_k", "_r"))).alias("_ranks"))
    return folded.select("_row.*", *(F.get("_ranks", F.lit(k))["_r"].alias(name) for k, name in enumerate(inputs)))


def wide_terms(
    df: DataFrame, todo: dict[str, tuple[str, list]], symbol: str, time: str, rows_per_range: int
) -> DataFrame:
    """Add one column per entry of ``todo`` (name -> per-date operator, its inputs and parameters)."""
    ranks = {name: spec for name, spec in todo.items() if spec[0] in RANKS}
    plain = {name: spec for name, spec in todo.items() if name not in ranks}
    frame = df
    for name, (op, args) in ranks.items():
        frame = frame.withColumn(f"{name}_v", steady(args[0]) if op == "cs_rank" else args[0])
    frame = materialise(frame, "wide")
    result = frame
    if plain:
        totals = frame.groupBy(time).agg(
            *(OPERATORS[op].grouped(*args).alias(name) for name, (op, args) in plain.items()))
        result = result.join(totals, time, "left")
    if ranks:
        widest = frame.groupBy(time).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 1
        for name in ranks:
            table = exact_rank(frame.select(time, f"{name}_v"), f"{name}_v", [time], rows_per_range, widest)
            result = result.join(table.withColumnRenamed("rank", name), [time, f"{name}_v"], "left")
    return result

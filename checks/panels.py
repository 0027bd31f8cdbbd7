"""Market panels derived from the test tables, once for Spark and once as SQL CTEs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed value: offset that keeps rounding away from decimal ties
OFFSET = 0.3819660113


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# lines of one task: larger tables are dealt over more tasks, so that none grows with the table
LINES_OF_TASK = 500_000
# a supplier of more lines is not left to one task
LINES_OF_SUPPLIER = 2_000_000


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").where("l_suppkey IS NOT NULL AND l_shipdate IS NOT NULL")


def panel_sizes(spark: SparkSession, sf: str, unit: str = "day") -> tuple[int, int]:
    """Lines of the largest supplier and of the largest date: no less than the bars of the largest instrument and date."""
    line = _lines(spark, sf)
    per = [line.groupBy(key.alias("k")).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("n")).withColumn("side", F.lit(side))
           for side, key in (("s", F.col("l_suppkey")), ("d", F.date_trunc(unit, "l_shipdate").cast("date")))]
    found = {r["side"]: r["n"] or 0 for r in per[0].unionByName(per[1]).collect()}
    return found["s"], found["d"]


def dealt(spark: SparkSession, sf: str) -> tuple[int, bool]:
    """Number of tasks over which ``bars`` deals its lines, and whether each gets whole suppliers."""
    row = _lines(spark, sf).groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n")).agg(F.sum("n").alias("rows"), F.max("n").alias("most")).first()
    return -(-(row["rows"] or 0) // LINES_OF_TASK), (row["most"] or 0) <= LINES_OF_SUPPLIER


def spread(df: DataFrame, parts: int, *by: str) -> DataFrame:
    """Rows exchanged by columns, over at least the session's partitions, and more if the table needs them.

    The number is asked for where rows are more than one task's, as adaptive coalescing sizes tasks by bytes alone.
    """
    return df.repartition(max(parts, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *by) if parts > 1 else df.repartition(*by)


def bars(spark: SparkSession, sf: str, unit: str = "day") -> DataFrame:
    """lineitem as bars: instrument = supplier, time = ship day or week.

    The lines themselves are exchanged, by instrument unless one has too many: no step that combines them first, as few
    lines share a bar, and windows of an instrument need no further exchange or sort.
    """
    price = F.col("l_extendedprice") / F.col("l_quantity")
    order = F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    when = F.date_trunc(unit, "l_shipdate").cast("date")
    name = F.concat(F.col("l_suppkey").cast("string"), F.lit(".SUP"))
    line = _lines(spark, sf).select(name.alias("vt_symbol"), when.alias("datetime"), "l_shipdate", "l_orderkey", "l_linenumber", "l_partkey",
                                    "l_quantity", "l_extendedprice")
    parts, whole = dealt(spark, sf)
    line = spread(line, parts, *(["vt_symbol"] if whole else ["vt_symbol", "datetime"]))
    agg = (
        line.groupBy("vt_symbol", "datetime")
        .agg(F.min_by(price, order).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"),
             F.max_by(price, order).alias("close"), F.sum("l_quantity").alias("volume"),
             F.sum(F.col("l_extendedprice").cast("decimal(15,2)")).cast("double").alias("turnover"))
    )
    return agg.select("vt_symbol", "datetime", "open", "high", "low", "close", "volume", "turnover",
                      F.try_divide("turnover", "volume").alias("vwap"))


def bars_sql(unit: str = "day", name: str = "bars") -> str:
    order = "(l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice)"
    return f"""{name} AS MATERIALIZED (
      SELECT vt_symbol, datetime, open, high, low, close, volume, turnover, turnover / nullif(volume, 0) AS vwap
      FROM (SELECT l_suppkey || '.SUP' AS vt_symbol, date_trunc('{unit}', l_shipdate)::DATE AS datetime,
        arg_min(l_extendedprice / l_quantity, {order}) AS open, max(l_extendedprice / l_quantity) AS high,
        min(l_extendedprice / l_quantity) AS low, arg_max(l_extendedprice / l_quantity, {order}) AS close,
        sum(l_quantity) AS volume, sum(l_extendedprice::DECIMAL(15,2))::DOUBLE AS turnover
        FROM lineitem WHERE l_suppkey IS NOT NULL AND l_shipdate IS NOT NULL GROUP BY 1, 2))"""


_STEPS = [(1.0, 1e6), (1e3, 1e4), (1e6, 10.0)]
_BIG = [(1e9, 1e2), (1e12, 1e5)]


def tidy(x: Column) -> Column:
    """About six significant digits (above 1e12: of the logarithm), as float sums differ in the last bits."""
    x = x.cast("double")
    out = None
    for limit, scale in _STEPS:
        value = F.floor(x * scale + OFFSET) / F.lit(scale)
        out = F.when(F.abs(x) < limit, value) if out is None else out.when(F.abs(x) < limit, value)
    for limit, scale in _BIG:
        out = out.when(F.abs(x) < limit, F.floor(x / scale + OFFSET) * F.lit(scale))
    size = F.floor(F.log10(F.abs(x)) * 1e5 + OFFSET) / F.lit(1e5)
    huge = F.when(F.abs(x) == float("inf"), x).otherwise(F.signum(x) * F.lit(1e12) * size)
    return out.when(F.abs(x) >= 1e12, huge).cast("double")


def tidy_sql(x: str, name: str | None = None) -> str:
    parts = [f"WHEN abs({x}) < {limit!r} THEN floor({x} * {scale!r}::DOUBLE + {OFFSET}::DOUBLE) / {scale!r}::DOUBLE"
             for limit, scale in _STEPS]
    parts += [f"WHEN abs({x}) < {limit!r} THEN floor({x} / {scale!r}::DOUBLE + {OFFSET}::DOUBLE) * {scale!r}::DOUBLE"
              for limit, scale in _BIG]
    parts.append(f"WHEN abs({x}) = 'inf'::DOUBLE THEN {x} WHEN abs({x}) >= 1e12 THEN sign({x}) * 1e12::DOUBLE * "
                 f"(floor(log10(abs({x})) * 1e5::DOUBLE + {OFFSET}::DOUBLE) / 1e5::DOUBLE)")
    return f"(CASE {' '.join(parts)} END)::DOUBLE AS {name or x}"


def present(df: DataFrame, text: list[str] = (), whole: list[str] = (), rounded: list[str] = ()) -> DataFrame:
    """Result columns in comparable types: text, 64-bit integers and tidied doubles."""
    return df.select(
        *(F.col(c).cast("string").alias(c) for c in text),
        *(F.col(c).cast("long").alias(c) for c in whole),
        *(tidy(F.col(c)).alias(c) for c in rounded))


def present_sql(source: str, text: list[str] = (), whole: list[str] = (), rounded: list[str] = ()) -> str:
    cols = [f"{c}::VARCHAR AS {c}" for c in text] + [f"{c}::BIGINT AS {c}" for c in whole]
    cols += [tidy_sql(f"{c}::DOUBLE", c) for c in rounded]
    return f"SELECT {', '.join(cols)} FROM {source}"


def members(spark: SparkSession, sf: str) -> DataFrame:
    """(vt_symbol, industry): supplier to region, as a sector name with a source prefix."""
    s, n, r = (table(spark, sf, t) for t in ("supplier", "nation", "region"))
    return (
        s.join(n, F.col("s_nationkey") == F.col("n_nationkey"))
        .join(r, F.col("n_regionkey") == F.col("r_regionkey"))
        .select(F.concat(F.col("s_suppkey").cast("string"), F.lit(".SUP")).alias("vt_symbol"),
                F.concat(F.lit("GICS1"), "r_name").alias("industry"))
        .where(F.col("industry").startswith("GICS1")).distinct())


MEMBERS_SQL = """members AS MATERIALIZED (SELECT DISTINCT s_suppkey || '.SUP' AS vt_symbol, 'GICS1' || r_name AS industry
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def universe(bars_df: DataFrame) -> DataFrame:
    """A stand-in for the execution universe: bars with more than 20 units are tradable."""
    return bars_df.select("datetime", "vt_symbol", (F.col("volume") > 20).alias("in_execution"))


UNIVERSE_SQL = "universe AS (SELECT datetime, vt_symbol, volume > 20 AS in_execution FROM bars)"

"""Latest state per key, active orders, positions rolled up from fills."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barloom.functions.algebra import ORDINAL
from barloom.operators.evaluate import LONG_HISTORY
from barloom.operators.longhistory import carried
from barloom.session import materialise
from barloom.sources.store import list_names, path_exists, remove_path

# fixed values: order states that can still trade, exchanges with separate today/yesterday closing
ACTIVE = ("submitting", "nottraded", "parttraded")
TODAY_EXCHANGES = ("SHFE", "INE")


def latest_state(events: DataFrame, keys: list[str], time: str, tie: str | None = None) -> DataFrame:
    """Last event per key (map-side combined, so busy keys do not concentrate rows)."""
    order = F.struct(*([time] + ([tie] if tie else [])))
    rest = [c for c in events.columns if c not in keys]
    return events.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_s")).select(*keys, "_s.*")


def active_orders(orders: DataFrame, keys: list[str], time: str, tie: str | None = None, status: str = "status") -> DataFrame:
    return latest_state(orders, keys, time, tie).where(F.col(status).isin(*ACTIVE))


class LatestTable:
    """A latest-state table kept by a stream: rows by hash bucket of their keys, and a log of commits.

    A micro-batch rewrites only the buckets it touches, into a folder of its own; the table is what the log names. Nothing that a
    reader sees is ever overwritten: a run that stops before its commit leaves the table as it was, and an epoch that is in the
    log is not applied again. ``vacuum`` removes folders that no bucket refers to any more.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], time: str, buckets: int = 64) -> None:
        self.spark, self.path, self.keys, self.time, self.buckets = spark, path.rstrip("/"), keys, time, buckets

    def commits(self) -> list[tuple[int, str, list[int]]]:
        """(epoch, folder, buckets written) of all commits, in order: one short line each."""
        log = f"{self.path}/log"
        done = [n for n in list_names(self.spark, log) if n.startswith("epoch=") and path_exists(self.spark, f"{log}/{n}/_SUCCESS")]
        if not done:
            return []
        rows = self.spark.read.schema("epoch long, folder string, touched array<int>").json([f"{log}/{n}" for n in done]).collect()
        return sorted((r["epoch"], r["folder"], list(r["touched"])) for r in rows)

    def places(self) -> dict[int, str]:
        """The folder that holds each bucket now."""
        return {b: folder for _, folder, touched in self.commits() for b in touched}

    def _read(self, places: dict[int, str]) -> DataFrame | None:
        paths = [f"{self.path}/data/{folder}/bucket={b}" for b, folder in sorted(places.items())]
        return self.spark.read.parquet(*paths) if paths else None

    def read(self) -> DataFrame | None:
        """The rows of the last commit; None before the first."""
        return self._read(self.places())

    def upsert(self, batch: DataFrame, epoch: int) -> None:
        """``foreachBatch`` function: the batch's latest rows replace older ones of their keys, once an epoch."""
        if any(done == epoch for done, _, _ in self.commits()):
            return
        # one row a key, written aside so that the batch is read once
        new = materialise(latest_state(batch, self.keys, self.time).withColumn("bucket", F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")), "latest")
        touched = sorted(r["bucket"] for r in new.select("bucket").distinct().collect())  # at most ``buckets`` numbers
        places = self.places()
        old = self._read({b: places[b] for b in touched if b in places})
        rows = new.drop("bucket") if old is None else old.unionByName(new.drop("bucket"))
        merged = latest_state(rows, self.keys, self.time).withColumn("bucket", F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int"))
        folder = f"{epoch:012d}-{uuid.uuid4().hex}"
        if touched:
            merged.repartition("bucket").write.partitionBy("bucket").parquet(f"{self.path}/data/{folder}")
        self.commit(epoch, folder, touched)

    def commit(self, epoch: int, folder: str, touched: list[int]) -> None:
        line = self.spark.createDataFrame([(epoch, folder, touched)], "epoch long, folder string, touched array<int>")
        line.coalesce(1).write.mode("overwrite").json(f"{self.path}/log/epoch={epoch:012d}")

    def vacuum(self) -> int:
        """Remove the folders of abandoned runs and of older versions; returns how many went."""
        used = set(self.places().values())
        gone = [n for n in list_names(self.spark, f"{self.path}/data") if n not in used]
        for name in gone:
            remove_path(self.spark, f"{self.path}/data/{name}")
        return len(gone)


def upsert_latest(path: str, keys: list[str], time: str, buckets: int = 64):
    """``foreachBatch`` function keeping a latest-state table under ``path``; ``LatestTable(...).read()`` gives its rows."""
    def run(batch: DataFrame, epoch: int) -> None:
        LatestTable(batch.sparkSession, path, keys, time, buckets).upsert(batch, epoch)

    return run


BUCKETS = ("long_yd", "long_td", "short_yd", "short_td")


def roll_up(fills: DataFrame, order: list[str], long_history: int = LONG_HISTORY, largest: int | None = None) -> DataFrame:
    """``fills`` with the position buckets after every fill, per symbol.

    Opening adds to today's bucket. Closing takes from the opposite side: the named bucket for ``close_today`` and
    ``close_yesterday``; plain ``close`` takes yesterday's where the exchange separates the two, else today's with the shortage
    taken from yesterday's.

    Each fill maps today's bucket x to max(x + a, b), with b = 0 for a closing with shortage and none otherwise; such maps compose to
    one of the same kind. From an empty bucket that is S + max(0, -S at the closings so far), S being the running sum of a, so
    that running sums and a running maximum give every state. A symbol with more than ``long_history`` fills (``largest`` is measured
    if absent) is split into pieces that carry these over.
    """
    volume, offset, plain = F.col("volume").cast("double"), F.col("offset"), (F.col("offset") == "close") & ~F.col("exchange").isin(*TODAY_EXCHANGES)
    added = fills
    for side, other in (("long", "short"), ("short", "long")):
        opens, closes = (offset == "open") & (F.col("direction") == side), (offset != "open") & (F.col("direction") == other)
        added = added.withColumns({
            f"_{side}_a": F.when(opens, volume).when(closes & ((offset == "close_today") | plain), -volume).otherwise(0.0),
            f"_{side}_t": F.when(opens, volume).when(closes, -volume).otherwise(0.0), f"_{side}_p": closes & plain})
    sums = [f"_{side}_{x}" for side in ("long", "short") for x in "at"]
    if largest is None:
        largest = fills.groupBy("vt_symbol").count().agg(F.max("count")).first()[0] or 0
    paths: list[str] = []
    if largest > long_history:
        added = numbered(added, order)
        added = carried(added, {f"{c}s": ("run_sum", [F.col(c)]) for c in sums}, "vt_symbol", ORDINAL, max(1, long_history // 2), paths)
    else:
        past = Window.partitionBy("vt_symbol").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        added = added.withColumns({f"{c}s": F.sum(c).over(past) for c in sums})
    short = {f"_{side}_low": F.when(F.col(f"_{side}_p"), -F.col(f"_{side}_as")) for side in ("long", "short")}
    if largest > long_history:
        added = carried(added, {c: ("run_max", [x]) for c, x in short.items()}, "vt_symbol", ORDINAL, max(1, long_history // 2), paths)
    else:
        added = added.withColumns(short).withColumns({c: F.max(c).over(past) for c in short})
    out = {}
    for side in ("long", "short"):
        out[f"{side}_td"] = F.col(f"_{side}_as") + F.greatest(F.lit(0.0), F.col(f"_{side}_low"))
        out[f"{side}_yd"] = F.col(f"_{side}_ts") - out[f"{side}_td"]
    return added.select(*fills.columns, *[out[b].alias(b) for b in BUCKETS])


def numbered(rows: DataFrame, order: list[str], symbol: str = "vt_symbol") -> DataFrame:
    """The rows numbered within their symbol in the given order, whose first column is a time: counts of days before, and the place in the day."""
    rows = rows.withColumn("_day", F.col(order[0]).cast("date"))
    counts = rows.groupBy(symbol, "_day").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(symbol).orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select(symbol, "_day", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy(symbol, "_day").orderBy(*order))
    return rows.join(before, [symbol, "_day"]).withColumn(ORDINAL, (place + F.col("_before")).cast("long")).drop("_day", "_before")


def frozen_volume(active: DataFrame, positions: DataFrame) -> DataFrame:
    """Unfilled closing volume per bucket, capped by the bucket.

    Closings of today's bucket count first, then plain closings, whose excess moves to yesterday's.
    """
    left = F.col("volume") - F.col("traded")
    side = F.when(F.col("direction") == "long", "short").otherwise("long")
    closing = active.where(F.col("offset") != "open").withColumns({"_left": left, "_side": side})
    split = F.col("offset")
    need = closing.groupBy("vt_symbol").agg(*(
        F.sum(F.when((F.col("_side") == s) & (split == o), F.col("_left")).otherwise(0.0)).alias(f"{s}_{o}")
        for s in ("long", "short") for o in ("close_today", "close_yesterday", "close")))
    df = positions.join(need, "vt_symbol", "left").fillna(0.0)
    out = {}
    for s in ("long", "short"):
        today = F.col(f"{s}_close_today") + F.col(f"{s}_close")
        over = F.when(F.col(f"{s}_close") > 0, F.greatest(today - F.col(f"{s}_td"), F.lit(0.0))).otherwise(0.0)
        out[f"{s}_td_frozen"] = F.least(today, F.col(f"{s}_td"))
        out[f"{s}_yd_frozen"] = F.least(F.col(f"{s}_close_yesterday") + over, F.col(f"{s}_yd"))
    df = df.withColumns(out)
    return df.select("vt_symbol", *BUCKETS, *out, *(
        (F.col(f"{s}_td_frozen") + F.col(f"{s}_yd_frozen")).alias(f"{s}_frozen") for s in ("long", "short")))

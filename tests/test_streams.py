import math
import uuid
import zlib
from datetime import datetime

import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.functions import indicators as I
from barloom.operators.evaluate import evaluate
from barloom.session import work_dir
from barloom.streaming import bars as Z
from barloom.streaming import ordered as O
from barloom.streaming import state as S

DDL = "vt_symbol string, datetime timestamp, last_price double, volume double, turnover double, high_price double, low_price double"


def ticks():
    rows = []
    for s in ("A", "B"):
        for i in range(40):
            rows.append((s, (pd.Timestamp("2024-01-01 09:30:00") + pd.Timedelta(seconds=17 * i)).to_pydatetime(), 10.0 + (i * 7) % 5, float(i * 3), float(i * 30), 15.0 + i // 9, 9.0 - i // 13))
    return rows


def drained(spark, folder, checkpoint, out):
    stream = spark.readStream.schema(DDL).option("maxFilesPerTrigger", 1).parquet(folder)
    Z.write_stream(Z.streaming_bars(stream), out, checkpoint).awaitTermination()
    return spark.read.parquet(out)


@pytest.fixture
def base(spark):
    return f"{work_dir(spark)}/test-{uuid.uuid4().hex}"


def test_stream_equals_batch_on_closed_windows(spark, base):
    rows = ticks()
    first, second = spark.createDataFrame(rows[:20] + rows[40:60], DDL), spark.createDataFrame(rows[20:40] + rows[60:], DDL)
    first.coalesce(1).write.parquet(f"{base}/in")
    drained(spark, f"{base}/in", f"{base}/c", f"{base}/out")
    second.coalesce(1).write.mode("append").parquet(f"{base}/in")
    got = drained(spark, f"{base}/in", f"{base}/c", f"{base}/out").toPandas()
    whole = Z.tick_bars(spark.createDataFrame(rows, DDL))
    last = max(r[1] for r in rows) - pd.Timedelta(minutes=1)
    want = whole.where(F.col("datetime") + F.expr("INTERVAL 1 MINUTE") <= F.lit(last)).toPandas()
    keys = ["vt_symbol", "datetime"]
    pd.testing.assert_frame_equal(got.sort_values(keys, ignore_index=True), want.sort_values(keys, ignore_index=True), check_dtype=False)


def test_late_ticks_are_dropped(spark, base):
    rows = ticks()
    spark.createDataFrame(rows, DDL).coalesce(1).write.parquet(f"{base}/in")
    before = drained(spark, f"{base}/in", f"{base}/c", f"{base}/out").count()
    late = [("A", pd.Timestamp("2024-01-01 09:31:00").to_pydatetime(), 99.0, 1e6, 1e7, 99.0, 1.0)]
    spark.createDataFrame(late, DDL).coalesce(1).write.mode("append").parquet(f"{base}/in")
    after = drained(spark, f"{base}/in", f"{base}/c", f"{base}/out")
    assert after.where("high >= 99").count() == 0 and after.count() == before


def test_ties_and_late_ticks_within_the_watermark(spark, base):
    rows = ticks()
    ties = [(s, t, p + 3.5, v + 1.0, n + 10.0, h + 0.5, w - 0.5) for s, t, p, v, n, h, w in rows[5:80:4]]
    rows = rows + ties
    order = sorted(rows, key=lambda r: (r[1] + pd.Timedelta(seconds=hash(r[2:4]) % 50), r[3]))
    for k in range(4):  # in every file ticks are late by up to 50 seconds, and ties are in one file or in two
        spark.createDataFrame(order[k * len(order) // 4:(k + 1) * len(order) // 4], DDL).coalesce(1).write.mode("append").parquet(f"{base}/in")
    got = drained(spark, f"{base}/in", f"{base}/c", f"{base}/out").toPandas()
    last = max(r[1] for r in rows) - pd.Timedelta(minutes=1)
    want = Z.tick_bars(spark.createDataFrame(rows, DDL)).where(F.col("datetime") + F.expr("INTERVAL 1 MINUTE") <= F.lit(last)).toPandas()
    keys = ["vt_symbol", "datetime"]
    assert len(want) > 10
    pd.testing.assert_frame_equal(got.sort_values(keys, ignore_index=True), want.sort_values(keys, ignore_index=True), check_dtype=False)


def test_sessions_end_with_their_closing_bar(spark):
    rows = [("A", t, 1.0, 1.0, 1.0, float(i), 1.0, 1.0) for i, t in enumerate(map(datetime.fromisoformat, (
        "2024-01-05 14:59:00", "2024-01-05 21:00:00", "2024-01-08 14:59:00", "2024-01-08 21:00:00")))]
    bars = spark.createDataFrame(rows, "vt_symbol string, datetime timestamp, open double, high double, low double, close double, volume double, turnover double")
    assert sorted((str(r["datetime"]), r["volume"]) for r in Z.day_bars(bars, "14:59:00").collect()) == [("2024-01-05", 1.0), ("2024-01-08", 2.0)]
    assert Z.day_bars(bars, "14:59:00", flush=True).count() == 3
    with pytest.raises(ValueError):
        Z.minute_bars(bars, 7)


BARS = "vt_symbol string, datetime timestamp, open double, high double, low double, close double, volume double, turnover double"


def hour_rows(days=9, symbols="ABC"):
    rows = []
    for k, s in enumerate(symbols):
        for i in range(24 * days):
            if (i * 7 + k) % 5:  # gaps
                p = 50 + 10 * math.sin(i / 5 + k) + (i * 13 + k) % 7
                rows.append((s, (pd.Timestamp("2024-01-01") + pd.Timedelta(hours=i)).to_pydatetime(), p, p + 2, p - 1.5, p + ((i * 3) % 5 - 2) / 2, float(i % 9), float(i)))
    return rows


def in_batches(spark, rows, folder, late_hours, batches=3):
    """Files by arrival, which is up to ``late_hours`` after the time of a row."""
    order = sorted(rows, key=lambda r: (r[1] + pd.Timedelta(hours=zlib.crc32(repr(r[:2]).encode()) % (late_hours + 1)), r[0]))
    for k in range(batches):
        spark.createDataFrame(order[k * len(order) // batches:(k + 1) * len(order) // batches], BARS).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(BARS).option("maxFilesPerTrigger", 1).parquet(folder)


def same(got, want, keys=("vt_symbol", "datetime")):
    got, want = (x.sort_values(list(keys), ignore_index=True) for x in (got, want))
    pd.testing.assert_frame_equal(got, want[list(got.columns)], check_dtype=False, rtol=1e-9)


def test_counted_bars_on_a_stream_equal_the_batch(spark, base):
    rows = hour_rows()
    stream = in_batches(spark, rows, f"{base}/in", 3)
    Z.write_stream(O.streaming_counted_bars(stream, 4, "4 hours"), f"{base}/out", f"{base}/c").awaitTermination()
    got = spark.read.parquet(f"{base}/out").toPandas()
    last = max(r[1] for r in rows) - pd.Timedelta(hours=4)
    seen = spark.createDataFrame([r for r in rows if r[1] <= last], BARS)
    want = Z.n_hour_bars(seen, 4).where("n_bars = 4").toPandas()
    assert len(want) > 100
    same(got, want)


def test_session_bars_on_a_stream_and_what_an_idle_symbol_leaves(spark, base):
    rows = [r for r in hour_rows() if r[0] != "B" or r[1] < datetime(2024, 1, 5, 3)]  # B stops within a session
    stream = in_batches(spark, rows, f"{base}/in", 3)
    Z.write_stream(O.streaming_session_bars(stream, "4 hours", idle="36 hours"), f"{base}/out", f"{base}/c").awaitTermination()
    got = spark.read.parquet(f"{base}/out").toPandas()
    last = max(r[1] for r in rows) - pd.Timedelta(hours=4)
    ends = {s: max(r[1] for r in rows if r[0] == s) for s in "ABC"}
    assert ends["B"] + pd.Timedelta(hours=36) < last
    frame = spark.createDataFrame([r for r in rows if r[1] <= last], BARS)
    want = Z.day_bars(frame).unionByName(Z.day_bars(frame.where("vt_symbol = 'B'"), flush=True).join(Z.day_bars(frame.where("vt_symbol = 'B'")).select("datetime"), "datetime", "left_anti"))
    want = want.toPandas()
    assert (want["vt_symbol"] == "B").sum() >= 4
    same(got, want)


def test_indicators_on_a_stream_equal_the_batch_and_expire(spark, base):
    rows = [r for r in hour_rows(14) if not (r[0] == "C" and datetime(2024, 1, 3) <= r[1] < datetime(2024, 1, 8))]  # C pauses for five days
    stream = in_batches(spark, rows, f"{base}/in", 3)
    found = O.streaming_indicators(stream, "4 hours", idle="60 hours", sma=(3, 10), ema=(5, 12), rsi=14, atr=7, macd=(4, 9, 3))
    Z.write_stream(found, f"{base}/out", f"{base}/c").awaitTermination()
    got = spark.read.parquet(f"{base}/out").toPandas()
    last = max(r[1] for r in rows) - pd.Timedelta(hours=4)
    terms = {"sma_3": I.sma(3), "sma_10": I.sma(10), "ema_5": I.ema(5), "ema_12": I.ema(12), "rsi": I.rsi(14), "atr": I.atr(7), **I.macd(4, 9, 3)}
    kept = [r for r in rows if r[1] <= last]
    # after its pause C is a new symbol
    renamed = spark.createDataFrame([("D" if r[0] == "C" and r[1] >= datetime(2024, 1, 8) else r[0], *r[1:]) for r in kept], BARS)
    want = evaluate(renamed, terms, keep=["close"]).toPandas()
    want["vt_symbol"] = want["vt_symbol"].replace("D", "C")
    assert len(got) == len(kept)
    same(got, want)


def test_latest_table_survives_replays_and_crashes(spark, base):
    ddl = "k string, t long, v double"
    batches = [[("a", 1, 1.0), ("b", 5, 2.0), ("a", 3, 3.0)], [("a", 2, 9.0), ("c", 1, 4.0)], [("b", 6, 5.0), ("d", 1, 6.0)]]
    table = S.LatestTable(spark, f"{base}/latest", ["k"], "t", buckets=3)
    assert table.read() is None
    table.upsert(spark.createDataFrame(batches[0], ddl), 0)
    table.upsert(spark.createDataFrame(batches[1], ddl), 1)
    now = {("a", 3, 3.0), ("b", 5, 2.0), ("c", 1, 4.0)}
    assert {tuple(r) for r in table.read().collect()} == now
    table.upsert(spark.createDataFrame([("a", 99, 0.0)], ddl), 1)  # an epoch that was applied
    assert {tuple(r) for r in table.read().collect()} == now

    class Stopped(S.LatestTable):
        def commit(self, *args):
            raise RuntimeError("stopped before the commit")

    with pytest.raises(RuntimeError):
        Stopped(spark, f"{base}/latest", ["k"], "t", buckets=3).upsert(spark.createDataFrame(batches[2], ddl), 2)
    assert {tuple(r) for r in table.read().collect()} == now
    table.upsert(spark.createDataFrame(batches[2], ddl), 2)
    want = {("a", 3, 3.0), ("b", 6, 5.0), ("c", 1, 4.0), ("d", 1, 6.0)}
    assert {tuple(r) for r in table.read().collect()} == want
    assert table.vacuum() >= 1 and {tuple(r) for r in table.read().collect()} == want
    table.upsert(spark.createDataFrame([], ddl), 3)
    assert {tuple(r) for r in table.read().collect()} == want

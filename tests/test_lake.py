import pytest
from pyspark.sql import functions as F

from barloom.operators import quality as Q
from barloom.operators import universe as V
from barloom.operators.models import BoostedTreesModel, LassoModel
from barloom.session import work_dir
from barloom.sources import lake as L
from barloom.sources.store import BarStore, load_panel


def store(spark, name):
    import uuid
    return BarStore(spark, f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}")


BAR = "vt_symbol string, datetime date, open double, high double, low double, close double, volume double, turnover double"


def bar(s, d, c, v=10.0):
    return (s, d, c, c, c, c, v, v * c)


def test_upsert_keeps_the_newest_row(spark, frame, column):
    s = store(spark, "s")
    s.save_bars(frame(BAR, [bar("A", "2023-12-29", 1.0), bar("A", "2024-01-02", 2.0), bar("B", "2024-01-02", 5.0)]), "d")
    s.save_bars(frame(BAR, [bar("A", "2024-01-02", 3.0)]), "d")
    assert column(s.bars("d"), "close") == [1.0, 3.0, 5.0]
    assert s.delete_bars("A", "d") == 2
    assert column(s.bars("d"), "close") == [5.0]
    with pytest.raises(ValueError):
        s.bars("1h")


def test_panel_is_normalised_by_the_first_close(frame, column):
    df = frame(BAR, [bar("A", "2024-01-01", 10.0), bar("A", "2024-01-02", 20.0), bar("A", "2024-01-03", 30.0, 0.0), bar("A", "2024-01-04", 0.0, 0.0)])
    out = load_panel(df, None, "2024-01-01", "2024-01-04")
    assert column(out, "close") == [1.0, 2.0, 3.0, None]  # halted, then empty


def test_versions_are_immutable_and_pinned(spark, frame):
    root = store(spark, "m").root
    a = frame(BAR, [bar("A", "2024-01-01", 1.0), bar("B", "2024-01-02", 2.0)])
    m = L.manifest({"bars": a})
    assert m.first()["content_hash"] == L.manifest({"bars": a.orderBy(F.desc("close"))}).first()["content_hash"]
    L.publish_manifest(m, root, "v1")
    with pytest.raises(Exception, match="exist"):
        L.publish_manifest(m, root, "v1")
    assert L.pinned_context(spark, root, ["bars"], {"bars": a}).count() == 1
    with pytest.raises(Q.DataQualityError):
        L.pinned_context(spark, root, ["bars"], {"bars": a.where("close > 1")})
    with pytest.raises(Q.DataQualityError):
        L.pinned_context(spark, root, ["bars", "members"])


def test_missing_columns_and_failed_checks_raise(frame):
    df = frame(BAR, [bar("A", "2024-01-01", -1.0), bar("A", "2024-01-01", 2.0)])
    with pytest.raises(Q.DataQualityError, match="vwap"):
        Q.require_columns(df, ["vwap"])
    checks = Q.price_checks(df, "raw")
    assert Q.gate_status(checks).first()["status"] == "fail"
    with pytest.raises(Q.DataQualityError, match="unique_keys"):
        Q.require_pass(checks)


def prices(frame, values, days=("2024-01-01", "2024-01-02")):
    return frame("datetime date, vt_symbol string, close double", [(d, "A", v) for d, v in zip(days, values)])


@pytest.mark.parametrize("ours, theirs, status, reasons", [
    ([10.0, 11.0], [10.0, 11.0], "pass", set()),
    ([10.0, 11.0], [1000.0, 1100.0], "pass", {"unit_mismatch"}),
    ([10.0, 11.0], [10.0, 20.0], "fail", {"unknown"}),
])
def test_source_comparison(frame, ours, theirs, status, reasons):
    a, b = prices(frame, ours), prices(frame, theirs)
    cmp = Q.compare_sources(a, b, 10)
    assert Q.reconciliation_summary(a, cmp, 10).first()["status"] == status
    assert {r["suspected_reason"] for r in cmp.where("suspected_reason IS NOT NULL").collect()} == reasons


def test_source_coverage_counts_missing_days(frame):
    a = prices(frame, [10.0, 11.0])
    b = a.where("datetime = '2024-01-01'")
    assert Q.reconciliation_summary(a, Q.compare_sources(a, b, 10), 10).first()["coverage"] == 0.5


def test_adjust_factors_and_actions(frame):
    raw, adj = prices(frame, [10.0, 10.0]), prices(frame, [10.0, 20.0])
    factors = V.adjust_factors(raw, adj)
    assert factors.agg(F.max("adjust_factor")).first()[0] == 2
    assert V.corporate_actions(factors, 0.01).count() == 1


def test_listing_intervals(frame):
    symbols = frame("vt_symbol string, name string, board string, exchange string, list_date string, delist_date string", [
        ("A", "Alpha", "main", "X", "20240102", "99999999"), ("B", "*ST B", "main", "X", "0", "20240102"), ("C", "C", "main", "X", "bad", "0")])
    days = frame("trade_date date", [(f"2024-01-0{d}",) for d in (1, 2, 4)])
    bars = frame(BAR, [bar("B", "2024-01-01", 5.0), bar("B", "2024-01-04", 5.0), bar("A", "2024-01-04", 5.0)])
    uni = V.daily_universe(symbols, days, bars)
    got = sorted((r["vt_symbol"], r["datetime"].day) for r in uni.collect())
    assert got == [("A", 2), ("A", 4), ("B", 1), ("B", 2)]
    reasons = {r["vt_symbol"]: r["status_reason"] for r in V.daily_status(uni, bars, V.UniverseConfig(1, 1.0, 1.0)).collect() if r["datetime"].day in (1, 4)}
    assert reasons == {"A": "ok", "B": "st"}


def test_penalty_drops_features_and_models_predict(spark):
    from checks.lake_queries import fitted
    sf = "/root/testdata/sf0.001"
    _, free = fitted(spark, sf, LassoModel(alpha=0.0))
    ds, strict = fitted(spark, sf, LassoModel(alpha=10.0))
    assert len(free.detail()) == 3 and strict.detail() == []
    trees = BoostedTreesModel(max_iter=3, max_depth=2)
    trees.fit(ds)
    assert trees.predict(ds, "test").count() > 0 and len(trees.detail()) == 3
    with pytest.raises(ValueError):
        LassoModel().predict(ds, "test")


def test_deleted_ticks_count_priced_ones_only(spark, tmp_path):
    """An event of value 0 is no price: the query counts what its SQL counts."""
    import checks.lake_queries  # noqa: F401
    rows = [(1, "2024-01-01 10:00:00", 8, 2.0), (2, "2024-01-01 11:00:00", 8, 0.0), (3, "2024-01-02 10:00:00", 9, 3.0), (4, "2024-01-02 11:00:00", 9, 0.0)]
    spark.createDataFrame(rows, "event_id long, t string, user_id long, value double").selectExpr(
        "event_id", "cast(t as timestamp_ntz) AS ts", "user_id", "value").write.parquet(f"{tmp_path}/events.parquet")
    got = checks.registry.QUERIES["store_delete_ticks"](spark, str(tmp_path)).collect()
    assert [(r["vt_symbol"], r["left"], r["gone"], r["total"]) for r in got] == [("9.EVT", 1, 1, 3.0)]


def test_recorder_counts_priced_ticks_only(spark, tmp_path):
    """An event of value 0 is recorded neither as a tick nor in a bar, as in the query's SQL."""
    import checks.lake_queries  # noqa: F401
    rows = [(1, "2024-01-01 10:00:00", 8, 2.0), (2, "2024-01-01 10:10:00", 8, 0.0), (3, "2024-01-01 12:00:00", 10, 3.0), (4, "2024-01-02 11:00:00", 8, 4.0)]
    spark.createDataFrame(rows, "event_id long, t string, user_id long, value double").selectExpr(
        "event_id", "cast(t as timestamp_ntz) AS ts", "user_id", "value").write.parquet(f"{tmp_path}/events.parquet")
    got = checks.registry.QUERIES["stream_recorder"](spark, str(tmp_path)).collect()
    assert sorted((r["vt_symbol"], r["ticks"], r["bars"], r["total"]) for r in got) == [("10.EVT", 1, 1, 3.0), ("8.EVT", 2, 1, 6.0)]


def test_manifest_files_follow_the_partitions(spark, monkeypatch):
    """The weekly bars are written by all tasks that aggregate them, not drawn into three."""
    import checks.lake_queries  # noqa: F401
    read, statistics = [], L.file_statistics

    def counted(*args):
        out = statistics(*args)
        read.append(out[1])
        return out
    monkeypatch.setattr(L, "file_statistics", counted)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        row = checks.registry.QUERIES["lake_file_manifest"](spark, "/root/testdata/sf0.001").first()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert read == [4, 4, 0] and row["only_new_read"] == row["hash_right"] == row["bytes_right"] == 1

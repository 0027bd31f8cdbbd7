"""Steps whose tasks must not grow with the table: sizes of a task are made small, so that small tables are large."""

import glob
import os

import pytest

from barloom.operators import quality as Q
from barloom.session import work_dir
from checks import lake_queries, panels, screening_queries
from checks.compare import differ

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("supplier", [10**6, 10])
def test_bars_are_dealt_over_more_tasks(spark, monkeypatch, supplier):
    want = panels.bars(spark, SF).toPandas()
    monkeypatch.setattr(panels, "LINES_OF_TASK", 500)
    monkeypatch.setattr(panels, "LINES_OF_SUPPLIER", supplier)
    got = panels.bars(spark, SF)
    assert got.rdd.getNumPartitions() >= panels.table(spark, SF, "lineitem").count() // 500 > 4
    assert differ(got.toPandas(), want) == ""


def test_duplicates_are_counted_over_more_tasks(spark, monkeypatch):
    want = Q.duplicate_keys(screening_queries.dirty(spark, SF)).toPandas()
    monkeypatch.setattr(panels, "LINES_OF_TASK", 500)
    got = Q.duplicate_keys(screening_queries.dirty(spark, SF))
    assert got.rdd.getNumPartitions() > 4
    assert differ(got.toPandas(), want) == ""


def test_price_checks_aggregate_once(spark):
    plan = Q.price_checks(panels.bars(spark, SF), "raw")._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan


def test_micro_batches_are_written_by_more_tasks(spark):
    rows = lake_queries.ticks(spark, SF)
    stream = lake_queries.cut_stream(spark, rows, 30, rows_of_file=50)
    assert stream.isStreaming
    folder = max(glob.glob(work_dir(spark).removeprefix("file:") + "/ticks-*/cut=0"), key=os.path.getmtime)
    files = [len(glob.glob(f"{folder[:-1]}{k}/*.parquet")) for k in range(3)]
    assert files[0] == files[1] == files[2] > 1

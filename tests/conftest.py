import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from barloom.session import get_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = get_session("tests", "local[4]", 4)
    s.sparkContext.setLogLevel("OFF")
    return s


@pytest.fixture(scope="session")
def frame(spark):
    """``frame("col type, ...", rows)`` with dates as ISO text in columns declared ``date``."""
    import datetime as dt

    def make(ddl, rows):
        kinds = [c.strip().split(" ")[1] for c in ddl.split(",")]
        return spark.createDataFrame([tuple(
            dt.date.fromisoformat(v) if k == "date" and isinstance(v, str) else
            dt.datetime.fromisoformat(v) if k == "timestamp" and isinstance(v, str) else v
            for k, v in zip(kinds, row)) for row in rows], ddl)

    return make


@pytest.fixture(scope="session")
def column():
    """Values of a column in (vt_symbol, datetime) order."""
    def get(df, name):
        order = [c for c in ("vt_symbol", "datetime") if c in df.columns]
        return [r[name] for r in df.orderBy(*order).collect()]

    return get

import numpy as np
import pytest

from barloom.operators.models import BoostedTreesModel, gram_matrix, lasso, split_places


@pytest.mark.parametrize("penalty", [0.0, 0.01, 0.3, 100.0])
def test_lasso_meets_its_optimality_conditions(penalty):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 6))
    x[:, 3], x[:, 5] = x[:, 0] * 0.9 + x[:, 3] * 0.1, 0.0
    y = x @ np.array([1.0, -0.5, 0.0, 0.2, 0.0, 3.0]) + rng.normal(size=400) * 0.1
    w = lasso(x.T @ x / 400, x.T @ y / 400, penalty)
    slope = x.T @ (y - x @ w) / 400
    assert np.allclose(slope[w != 0], penalty * np.sign(w[w != 0]), atol=1e-9) and (np.abs(slope[w == 0]) <= penalty + 1e-9).all() and w[5] == 0
    if penalty == 0.0:
        assert np.allclose(w[:5], np.linalg.lstsq(x[:, :5], y, rcond=None)[0])
    assert penalty < 100 or not w.any()


def test_gram_matrix_is_summed_over_all_rows(spark):
    rows = [(float(i), float(i % 7), 1.0) for i in range(1000)]
    n, sums = gram_matrix(spark.createDataFrame(rows, "a double, b double, c double").repartition(5), ["a", "b", "c"])
    x = np.array(rows)
    assert n == 1000 and np.allclose(sums, x.T @ x)
    assert gram_matrix(spark.createDataFrame([], "a double"), ["a"])[0] == 0


class Prepared:
    """A dataset of given rows: all are train, none valid."""

    def __init__(self, rows, features):
        self.rows, self.features, self.results = rows, dict.fromkeys(features), {}

    def fetch(self, stage, segment):
        return self.rows if segment == "train" else self.rows.limit(0)


def test_split_places_come_from_all_rows(spark):
    """The split that matters parts two rows from 39,998: a sample of 10,000 nearly always lacks them."""
    rows = spark.range(40_000).selectExpr("concat(id, '.A') AS vt_symbol", "DATE '2024-01-01' AS datetime", "CASE WHEN id < 2 THEN 9.0D ELSE id % 3 END AS f1",
                                          "CASE WHEN id < 2 THEN 1000.0D ELSE 0.0D END AS label", "cast(id AS double) AS f2")
    model = BoostedTreesModel(max_iter=1, max_depth=1, step=0.5, stop_early=False)
    model.fit(Prepared(rows.drop("f2"), ["f1"]))
    assert [(r["feature"], r["splits"]) for r in model.importance(spark).collect()] == [("f1", 1)]
    assert model.nodes()[0][3] == 5.5
    places = split_places(rows, ["f1", "f2"])
    assert list(places) == ["f2"] and len(places["f2"]) == 255 and abs(places["f2"][127] - 20_000) < 200

"""Return models: fit on train and valid segments, predict on a segment; boosted trees are Spark ML's."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml import Model
from pyspark.ml.feature import Bucketizer, VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.operators.dataset import KEYS, Dataset


class ReturnModel:
    """fit(dataset), predict(dataset, segment), detail()."""

    def __init__(self) -> None:
        self.names: list[str] = []
        self.model: Model | None = None

    def estimator(self):
        raise NotImplementedError

    def spec(self) -> dict:
        """Settings and what was learnt but for ``model``, as JSON can hold it."""
        raise NotImplementedError

    @classmethod
    def restored(cls, spec: dict) -> ReturnModel:
        raise NotImplementedError

    def training_rows(self, dataset: Dataset) -> DataFrame:
        """Rows of train and valid; a key in both segments counts once, as a train row."""
        parts = [dataset.fetch("learn", s).withColumn("is_valid", F.lit(s == "valid")) for s in ("train", "valid")]
        rows = parts[0].unionByName(parts[1].join(parts[0].select(*KEYS), KEYS, "left_anti"))
        return rows.dropna()

    def assemble(self, df: DataFrame) -> DataFrame:
        return VectorAssembler(inputCols=self.names, outputCol="features", handleInvalid="keep").transform(df)

    def fit(self, dataset: Dataset) -> None:
        self.names = [*dataset.features, *dataset.results]
        self.model = self.estimator().fit(self.assemble(self.training_rows(dataset)))

    def predict(self, dataset: Dataset, segment: str) -> DataFrame:
        if self.model is None:
            raise ValueError("model is not fitted")
        rows = dataset.fetch("infer", segment).dropna(subset=self.names)
        return self.model.transform(self.assemble(rows)).select(*KEYS, F.col("prediction").alias("signal"))


def gram_matrix(rows: DataFrame, names: list[str]) -> tuple[int, np.ndarray]:
    """Number of rows and the sums of products of all pairs of columns, in one pass.

    Each task adds up one matrix; what meets on the driver are as many numbers as there are pairs of columns.
    """
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((len(names), len(names))), 0
        for batch in batches:
            x = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], axis=1).astype(float)
            total += x.T @ x
            n += len(x)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, total.size)), pa.array(np.append(float(n), total.ravel()))], names=["cell", "value"])

    sums = rows.select(*[F.col(c).cast("double") for c in names]).mapInArrow(add, "cell long, value double").groupBy("cell").agg(F.sum("value").alias("value"))
    found = {r["cell"]: r["value"] for r in sums.collect()}
    return int(found.get(-1, 0)), np.array([found.get(k, 0.0) for k in range(len(names) ** 2)]).reshape(len(names), len(names))


def lasso(gram: np.ndarray, target: np.ndarray, penalty: float, tolerance: float = 1e-12, max_iter: int = 100_000) -> np.ndarray:
    """Weights w that minimise w'Gw/2 - c'w + penalty * |w|, by coordinate descent until the optimality conditions hold.

    At the optimum the slope c - Gw is the penalty, with the sign of the weight, where a weight isn't zero, and no larger elsewhere.
    """
    weights, slope, scale = np.zeros(len(target)), target.astype(float).copy(), max(1.0, float(np.abs(target).max(initial=0)))
    for _ in range(max_iter):
        for j in np.flatnonzero(np.diag(gram) > 0):
            reach = slope[j] + gram[j, j] * weights[j]
            new = np.sign(reach) * max(abs(reach) - penalty, 0.0) / gram[j, j]
            if new != weights[j]:
                slope -= gram[:, j] * (new - weights[j])
                weights[j] = new
        slope = target - gram @ weights
        off = np.where(weights != 0, np.abs(slope - penalty * np.sign(weights)), np.maximum(np.abs(slope) - penalty, 0.0))
        if off[np.diag(gram) > 0].max(initial=0) <= tolerance * scale:
            return weights
    raise RuntimeError("the optimality conditions do not hold yet")


class LassoModel(ReturnModel):
    """L1 linear regression without intercept; the penalty scales the 1/(2n) squared error.

    The rows are read once, for the products of all pairs of features; the descent works on these alone.
    """

    def __init__(self, alpha: float = 0.0005, max_iter: int = 100_000) -> None:
        super().__init__()
        self.alpha, self.max_iter = alpha, max_iter
        self.weights: np.ndarray | None = None

    def spec(self) -> dict:
        return {"alpha": self.alpha, "max_iter": self.max_iter, "names": self.names, "weights": None if self.weights is None else self.weights.tolist()}

    @classmethod
    def restored(cls, spec: dict) -> LassoModel:
        model = cls(spec["alpha"], spec["max_iter"])
        model.names, model.weights = spec["names"], None if spec["weights"] is None else np.array(spec["weights"])
        return model

    def fit(self, dataset: Dataset) -> None:
        self.names = [*dataset.features, *dataset.results]
        n, sums = gram_matrix(self.training_rows(dataset), [*self.names, "label"])
        if not n:
            raise ValueError("no rows to fit")
        self.weights = lasso(sums[:-1, :-1] / n, sums[:-1, -1] / n, self.alpha, max_iter=self.max_iter)

    def predict(self, dataset: Dataset, segment: str) -> DataFrame:
        if self.weights is None:
            raise ValueError("model is not fitted")
        rows = dataset.fetch("infer", segment).dropna(subset=self.names)
        total = F.lit(0.0)
        for name, weight in zip(self.names, self.weights, strict=True):
            total = total + F.col(name) * F.lit(float(weight))
        return rows.select(*KEYS, total.alias("signal"))

    def detail(self) -> list[tuple[str, float]]:
        """Non-zero coefficients by absolute size."""
        pairs = zip(self.names, (float(v) for v in self.weights))
        return sorted((p for p in pairs if p[1] != 0), key=lambda p: (-abs(p[1]), p[0]))


#: A feature of no more distinct values is split between any two of them, others between equally large shares of all rows.
VALUES, SHARES = 4096, 256


def split_places(rows: DataFrame, names: list[str], most: int = VALUES, parts: int = SHARES) -> dict[str, list[float]]:
    """Upper ends of ``parts`` equally large shares of each feature with more than ``most`` distinct values, from all rows."""
    values = rows.select(F.inline(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).cast("double").alias("x")) for n in names])))
    counts = {r["name"]: r["n"] for r in values.distinct().groupBy("name").agg(F.count(F.lit(1)).alias("n")).collect()}
    many = [n for n in names if counts.get(n, 0) > most]
    if not many:
        return {}
    shares = [(k + 1) / parts for k in range(parts - 1)]
    row = rows.agg(*[F.percentile_approx(F.col(n).cast("double"), shares, 100 * parts).alias(n) for n in many]).first()
    return {n: sorted(set(row[n])) for n in many}


class BoostedTreesModel(ReturnModel):
    """Squared-error boosting, stopped when the valid segment no longer improves (or never, without ``stop_early``).

    Spark looks for split places in a sample of max(maxBins^2, 10,000) rows. Here features have few values (``split_places``
    replaces others by the number of their share), and maxBins is such that the sample is all rows.
    """

    def __init__(self, max_iter: int = 50, max_depth: int = 5, step: float = 0.1, tol: float = 0.001, seed: int = 42, stop_early: bool = True) -> None:
        super().__init__()
        self.params = dict(maxIter=max_iter, maxDepth=max_depth, stepSize=step, validationTol=tol, seed=seed)
        self.stop_early = stop_early
        self.places: dict[str, list[float]] = {}

    def assemble(self, df: DataFrame) -> DataFrame:
        """Features as a vector, those with places as the number of places below the value."""
        df = df.withColumns({f"_in_{n}": F.col(n).cast("double") for n in self.names})
        for n, ends in self.places.items():
            df = Bucketizer(splits=[-math.inf, *(math.nextafter(e, math.inf) for e in ends), math.inf], inputCol=f"_in_{n}", outputCol=f"_at_{n}", handleInvalid="keep").transform(df)
            df = df.withMetadata(f"_at_{n}", {})  # ordered numbers, not categories
        return VectorAssembler(inputCols=[f"_at_{n}" if n in self.places else f"_in_{n}" for n in self.names], outputCol="features", handleInvalid="keep").transform(df)

    def fit(self, dataset: Dataset) -> None:
        self.names = [*dataset.features, *dataset.results]
        rows = self.training_rows(dataset)
        self.places = split_places(rows, self.names)
        bins = max(VALUES, math.isqrt(rows.count()) + 1)
        self.model = self.estimator().setMaxBins(bins).fit(self.assemble(rows))

    def estimator(self) -> GBTRegressor:
        valid = dict(validationIndicatorCol="is_valid") if self.stop_early else {}
        return GBTRegressor(featuresCol="features", labelCol="label", **valid, **self.params)

    def spec(self) -> dict:
        return {"params": self.params, "stop_early": self.stop_early, "names": self.names, "places": self.places}

    @classmethod
    def restored(cls, spec: dict) -> BoostedTreesModel:
        model = cls(stop_early=spec["stop_early"])
        model.params, model.names, model.places = spec["params"], spec["names"], spec.get("places", {})
        return model

    def nodes(self) -> list[tuple[int, int, str | None, float | None, float, int]]:
        """All nodes of the trees: (tree, node, feature, threshold, gain, rows); leaves have no feature. As many as the model has."""
        out: list[tuple] = []
        for tree, model in enumerate(self.model.trees):
            stack = [(1, model._call_java("rootNode"))]
            while stack:
                number, node = stack.pop()
                rows = int(node.impurityStats().count())
                if node.subtreeDepth() == 0:
                    out.append((tree, number, None, None, 0.0, rows))
                    continue
                split = node.split()
                name, place = self.names[split.featureIndex()], float(split.threshold())
                place = self.places[name][int(place)] if name in self.places else place
                out.append((tree, number, name, place, float(node.gain()), rows))
                stack += [(2 * number, node.leftChild()), (2 * number + 1, node.rightChild())]
        return out

    def importance(self, spark: SparkSession) -> DataFrame:
        """(feature, splits, gain): how many nodes split by a feature, and the squared error that they took away from the rows they saw."""
        table = spark.createDataFrame(self.nodes(), "tree int, node int, feature string, threshold double, gain double, rows long")
        return table.where("feature IS NOT NULL").groupBy("feature").agg(F.count(F.lit(1)).alias("splits"), F.sum(F.col("gain") * F.col("rows")).alias("gain"))

    def detail(self) -> list[tuple[str, float]]:
        """Features by gain importance."""
        pairs = zip(self.names, (float(v) for v in self.model.featureImportances.toArray()))
        return sorted(pairs, key=lambda p: (-p[1], p[0]))


#: Kinds of models that can be stored.
MODELS: dict[str, type[ReturnModel]] = {"LassoModel": LassoModel, "BoostedTreesModel": BoostedTreesModel}

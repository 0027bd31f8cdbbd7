"""Exact top-k search by no-random-access aggregation.

The score of a candidate is the sum over dimensions of query component times candidate component. For each
dimension the candidates of a block form a sorted list, read from the large end by queries with a positive and from the
small end by those with a negative component. After ``depth`` entries of every list, a component that was not
met yet lies between the list's other end and the last value read; replacing it by these bounds gives a lower and
an upper score. Candidates whose upper score is below the k-th lower score cannot qualify; reading stops when few
others are left, and only their final scores are resolved.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Candidates and queries of a block, and the shares of the lists that are read in turn.
CANDIDATES, QUERIES, DEPTHS = 4096, 512, (1 / 16, 1 / 4, 1 / 2, 3 / 4, 7 / 8, 1.0)
#: Reading stops when so many candidates a query, on average, could still qualify.
FEW = 24
#: Sums up to this size are exact in doubles; blocks that could exceed it are scored in Python integers.
EXACT = 2**53


def integers(vector: str | Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component, x as double; null if the vector is null or has a null or non-finite component.

    A finite component whose product doesn't fit a long is an error.
    """
    parts = F.transform(F.col(vector) if isinstance(vector, str) else vector, lambda x: x.cast("double"))
    fine = F.forall(parts, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
    return F.when(fine, F.transform(parts, lambda x: F.when(F.abs(x) < F.lit(float(2**63) / scale), F.floor(x * F.lit(float(scale))).cast("long")).otherwise(
        F.raise_error(F.concat(F.lit("a component doesn't fit a long: "), x.cast("string"))).cast("long"))))


def block_top(queries: np.ndarray, query_ids: np.ndarray, items: np.ndarray, item_ids: np.ndarray, k: int, few: int = FEW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query position, item position, score) of the k best items of a block for each query, other than itself."""
    n, dims = items.shape
    largest = float(np.abs(queries).max(initial=0)) * float(np.abs(items).max(initial=0)) * max(1, dims)
    if largest >= EXACT:
        scores = [[sum(int(a) * int(b) for a, b in zip(q, x, strict=True)) for x in items] for q in queries]
        rows = [(i, j, scores[i][j]) for i in range(len(queries)) for j in range(n) if query_ids[i] != item_ids[j]]
        out = pd.DataFrame(rows, columns=["q", "c", "s"], dtype=object)
        return out["q"].to_numpy(np.int64), out["c"].to_numpy(np.int64), np.array([x if -(2**63) <= x < 2**63 else _overflow(x) for x in out["s"]], np.int64)
    order = np.argsort(items, axis=0, kind="stable")
    ordered = np.take_along_axis(items, order, axis=0)  # the sorted lists, from the small end
    values, up, down = items.astype(float), np.maximum(queries, 0).astype(float), np.minimum(queries, 0).astype(float)
    own = query_ids[:, None] == item_ids[None, :]
    alive = ~own
    for share in DEPTHS:
        depth = max(1, math.ceil(n * share))
        high, low = ordered[n - depth], ordered[depth - 1]
        # a component that was met is itself; one that was not is at most the last value read and at least the list's end
        above = up @ np.where(values >= high, values, high).T + down @ np.where(values <= low, values, low).T
        below = up @ np.where(values >= high, values, ordered[0]).T + down @ np.where(values <= low, values, ordered[-1]).T
        below[own] = -np.inf
        if n > k:
            bar = np.partition(below, n - k, axis=1)[:, n - k]
            alive &= above >= bar[:, None]
        if alive.sum() <= few * len(queries):
            break
    q, c = np.nonzero(alive)
    scores = np.empty(len(q), np.int64)
    for i in range(0, len(q), 1 << 16):
        part = slice(i, i + (1 << 16))
        scores[part] = np.einsum("ij,ij->i", queries[q[part]], items[c[part]])
    return q, c, scores


def _overflow(score: int) -> int:
    raise OverflowError(f"a score of {score} doesn't fit a long")


def top_k(vectors: DataFrame, queries: Column, k: int = 5, key: str = "vec_id", vector: str = "embedding", scale: int = 256,
          candidates: int = CANDIDATES, batch: int = QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best scores of every query row against all other rows.

    ``queries`` marks the query rows. Scores are inner products of floor(scale * component); ties go to the smaller id.
    Vectors that are null or hold null or non-finite components take no part, nor do rows with a null id; vectors meet only
    vectors of their own length. Rows that repeat an id are candidates one by one (a query row never meets its own
    id), and are a query once: the first by vector. A query without candidates has no rows. Empty tables give an empty result.

    Queries and candidates are dealt into blocks by their ids; each pair of blocks is one task's work of bounded size.
    """
    rows = vectors.select(vectors[key].cast("long").alias("id"), integers(vectors[vector], scale).alias("v"), F.coalesce(queries, F.lit(False)).alias("asks"))
    rows = rows.where("id IS NOT NULL AND v IS NOT NULL").withColumn("dims", F.size("v"))
    asked = rows.where("asks").groupBy("id").agg(F.min("v").alias("v")).withColumn("dims", F.size("v"))
    # two counts; they size the blocks
    n, m = rows.count(), asked.count()
    c_blocks, q_blocks = max(1, math.ceil(n / candidates)), max(1, math.ceil(m / batch))
    q_side = asked.select("id", "v", "dims", F.pmod(F.xxhash64("id"), F.lit(q_blocks)).cast("int").alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(c_blocks - 1))).alias("cb"))
    c_side = rows.select("id", "v", "dims", F.pmod(F.xxhash64("id", "v"), F.lit(c_blocks)).cast("int").alias("cb"), F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))).alias("qb"))

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(left) and len(right):
            (qs, qi), (xs, xi) = ((np.stack(x["v"].to_numpy()), x["id"].to_numpy(np.int64)) for x in (left, right))
            if qs.shape[1] == 0:
                own = [(i, j) for i in range(len(qi)) for j in range(len(xi)) if qi[i] != xi[j]]
                q, c = (np.array(x, np.int64) for x in zip(*own, strict=True)) if own else (np.zeros(0, np.int64),) * 2
                s = np.zeros(len(q), np.int64)
            else:
                q, c, s = block_top(qs, qi, xs, xi, k)
            out = pd.DataFrame({"query_id": qi[q], "vec_id": xi[c], "score": s}).sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True])
            found.append(out.groupby("query_id").head(k))
        return pd.concat(found) if found else pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="int64")})

    # both sides have keys of the same types, else equal keys are dealt to different partitions
    keys = ["qb", "cb", "dims"]
    best = q_side.groupBy(*keys).cogroup(c_side.groupBy(*keys)).applyInPandas(search, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")



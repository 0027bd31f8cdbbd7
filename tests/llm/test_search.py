import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.llm import jaccard, topk


def brute_top(rows, asks, k, scale=256):
    fine = [(i, [math.floor(x * scale) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    queries = {}
    for i, v in fine:
        if asks(i):
            queries[i] = min(queries.get(i, v), v)
    out = []
    for i, q in queries.items():
        scores = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in fine if j != i and len(v) == len(q))[:k]
        out += [(i, rank + 1, j, -s) for rank, (s, j) in enumerate(scores)]
    return sorted(out)


@pytest.mark.parametrize("candidates, batch", [(4096, 512), (40, 3)])
def test_top_k_equals_brute_force(spark, candidates, batch):
    rng = np.random.default_rng(5)
    rows = [(int(i), [float(x) for x in rng.normal(0, 0.2, 12)]) for i in range(300)]
    rows += [(300 + k, rows[0][1]) for k in range(60)]  # one common vector: ties go to the smaller id
    rows += [(400, None), (401, []), (402, [None] * 12), (403, [math.nan] * 12), (404, [math.inf] * 12), (None, rows[1][1]), (410, [0.0] * 12), (20, rows[3][1]), (500, [0.5, 0.5]), (501, [0.1, -0.4])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"score": F.lit(1), "v": F.lit("x")})
    got = topk.top_k(df, F.col("vec_id") % 10 == 0, k=5, candidates=candidates, batch=batch)
    assert sorted(tuple(r) for r in got.collect()) == brute_top(rows, lambda i: i % 10 == 0, 5)


def test_blocks_meet_without_coalescing(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.range(400).select(F.col("id").alias("vec_id"), F.array(F.sin("id"), F.cos("id")).alias("embedding"))
        assert topk.top_k(df, F.col("vec_id") % 10 == 0, candidates=50, batch=5).count() == 200
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_top_k_of_few_and_none(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [-2.0])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in topk.top_k(df, F.col("vec_id") == 0).collect()] == [(0, 1, 1, -131072)]
    assert topk.top_k(df.where("vec_id = 0"), F.lit(True)).collect() == []
    assert topk.top_k(df.limit(0), F.lit(True)).collect() == []


def test_reading_stops_early_and_large_numbers_are_exact():
    rng = np.random.default_rng(3)
    items = np.zeros((1000, 8), np.int64)
    items[np.arange(1000), rng.integers(0, 8, 1000)] = rng.integers(1, 1000, 1000)
    queries = np.abs(rng.integers(0, 9, (5, 8)))
    q, c, s = topk.block_top(queries, np.arange(-5, 0), items, np.arange(1000), 3)
    assert len(q) < 5 * 1000 / 10
    for i in range(5):
        assert sorted(s[q == i])[-3:] == sorted(queries[i] @ items.T)[-3:]
    big = np.array([[2**40, 1], [2**40 + 1, 3]])
    q, c, s = topk.block_top(np.array([[2**20, 1]]), np.array([9]), big, np.array([0, 1]), 2)
    assert sorted(s.tolist()) == [2**60 + 1, 2**60 + 2**20 + 3]


def brute_components(rows, width, percent):
    sets = []
    for i, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append(frozenset(tuple(words[k : k + width]) for k in range(max(1, len(words) - width + 1))) if words else frozenset())
    ids = [i for i, _ in rows]
    boss = {i: i for i in ids if i is not None}

    def find(x):
        while boss[x] != x:
            x = boss[x]
        return x

    live = [k for k in range(len(rows)) if ids[k] is not None and sets[k]]
    for a in live:
        for b in live:
            if a < b and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(ids[a]), find(ids[b])
                boss[max(x, y)] = min(x, y)
    return sorted(((i, len(s), find(i) if i is not None and s else i) for i, s in zip(ids, sets)), key=str)


@pytest.mark.parametrize("width, percent", [(4, 85), (5, 80)])
def test_near_duplicates_equal_brute_force(spark, docs, raw, none, width, percent):
    got = jaccard.near_duplicates(docs, width, percent)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_components([(r[0], r[1]) for r in raw], width, percent)
    assert jaccard.near_duplicates(none, width, percent).collect() == []


def test_groups_around_the_threshold_equal_brute_force(spark):
    rng = random.Random(7)
    rows = []
    for group in range(6):
        base = [f"g{group}w{rng.randrange(300)}" for _ in range(rng.choice([5, 30, 90]))]
        for _ in range(25):
            text = list(base)
            for _ in range(rng.randrange(0, 5)):
                at = rng.randrange(len(text))
                text[at : at + rng.randrange(0, 2)] = [f"e{rng.randrange(40)}"]
            rows.append((len(rows), " ".join(text)))
    shared = " ".join(f"common{k}" for k in range(40))
    rows += [(1000 + k, f"{shared} own{k} words{k % 7}") for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for width, percent in ((4, 85), (5, 80), (3, 60)):
        got = jaccard.near_duplicates(df, width, percent)
        assert sorted((tuple(r) for r in got.collect()), key=str) == brute_components(rows, width, percent)


def test_components_of_a_long_path(spark):
    edges = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).unionByName(spark.range(500, 510).select(F.lit(500).cast("long").alias("a"), F.col("id").alias("b")))
    got = {r["id"]: r["component"] for r in jaccard.components(edges).collect()}
    assert got == {i: 0 for i in range(301)} | {i: 500 for i in range(500, 510)}


def test_components_beyond_a_long(spark):
    ddl = "vec_id long, embedding array<double>"
    fits = spark.createDataFrame([(0, [2.0**54]), (1, [1 / 256]), (2, [float("inf")])], ddl)
    assert [tuple(r) for r in topk.top_k(fits, F.col("vec_id") == 0).collect()] == [(0, 1, 1, 2**62)]
    with pytest.raises(Exception, match="fit a long"):
        topk.top_k(spark.createDataFrame([(0, [1e17]), (1, [1.0])], ddl), F.col("vec_id") == 0).collect()

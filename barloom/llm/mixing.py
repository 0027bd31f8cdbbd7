"""Mixing sources to target weights by weighted fair queueing.

The documents of a source are shuffled and queue up; a copy of a document has a virtual time, the tokens of
its source up to its middle divided by the weight of the source. All copies are range-sorted by that time
and served until the total budget is used up. A queue ends after ``repeats`` passes, and the others then share
what it leaves, which is the water filling that the targets state in closed form.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.session import materialise

#: Parts into which a queue (by the shuffled order) and the whole service (by time) are cut for running sums.
PARTS = 4096
#: Weights of sources in code point order, repeating.
WEIGHTS = (3.0, 1.0, 2.0)


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, repeats: int = 2) -> DataFrame:
    """(source, source_size, weight, target) for rows (source, size).

    The sources share ``share`` times all sizes by weight; no target exceeds ``repeats`` times the size of its
    source, what is left over is shared again by weight. With v the service each unit of weight gets, a target
    is min(weight * v, repeats * size). A source of null is a source of its own, ordered last. One row a source
    passes the ordering task.
    """
    total = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    table = F.array(*[F.lit(float(w)) for w in weights])
    ranked = total.withColumn("weight", F.get(table, F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))))
    ends = ranked.withColumns({"most": F.col("source_size") * F.lit(float(repeats)), "until": F.col("source_size") * F.lit(float(repeats)) / F.col("weight")})
    first = Window.orderBy("until", F.col("source").asc_nulls_last())
    whole = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    filled = ends.withColumns({
        "budget": F.sum("source_size").over(whole) * F.lit(float(share)),
        "before": F.coalesce(F.sum("most").over(first.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
        "weights": F.sum("weight").over(first.rowsBetween(Window.currentRow, Window.unboundedFollowing)),
    })
    # the first source, in the order in which queues end, that is not served in full sets the level
    filled = filled.withColumn("level", (F.col("budget") - F.col("before")) / F.col("weights"))
    level = F.max(F.when(F.col("level") <= F.col("until"), F.col("level"))).over(whole)
    return filled.select("source", "source_size", "weight", F.least(F.coalesce(F.col("weight") * level, F.col("most")), F.col("most")).alias("target"))


def queues(docs: DataFrame, targets: DataFrame, size: Column, seed: int, parts: int, repeats: int) -> DataFrame:
    """The rows of ``docs`` as struct ``row`` with source, size, source_size, weight, target and ``ahead``.

    ``ahead`` are the tokens of the source in front of the row in the shuffled order. The order is cut into parts;
    sums of the parts give each its start, so no task orders a whole source.
    """
    rows = docs.select(F.struct(*[docs[c].alias(c) for c in docs.columns]).alias("row"), docs["source"].cast("string").alias("source"), size.alias("size"), docs["doc_id"].alias("doc_id"))
    rows = rows.withColumn("at", F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 40)))
    rows = rows.withColumn("part", (F.col("at") / F.lit((1 << 40) // parts)).cast("int")).drop("doc_id")
    sums = rows.groupBy("source", "part").agg(F.sum("size").alias("held"))
    earlier = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("start", F.coalesce(F.sum("held").over(earlier), F.lit(0))).drop("held")
    within = Window.partitionBy("source", "part").orderBy("at", "size", "row").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inside", F.coalesce(F.sum("size").over(within), F.lit(0)))
    starts = sums.join(targets, sums["source"].eqNullSafe(targets["source"])).select(sums["source"].alias("s"), F.col("part").alias("p"), "start", "source_size", "weight", "target")
    joined = rows.join(starts, rows["source"].eqNullSafe(starts["s"]) & (rows["part"] == starts["p"]))
    return joined.select("row", "source", "size", "source_size", "weight", "target", "at", (F.col("start") + F.col("inside")).alias("ahead"))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, repeats: int = 2, seed: int = 17,
        size: Column | None = None, parts: int = PARTS) -> DataFrame:
    """The rows of ``docs`` with size, source_size, target and taken appended (struct ``row`` holds the rest).

    ``docs`` has doc_id, source and text, unless ``size`` is given; other columns are carried in ``row`` and must be
    orderable. Null and empty texts have size 0 and are never taken; a null source is a source. ``taken`` is 0, 1 or up
    to ``repeats`` times the size: documents are served whole, so a source ends within half a document of
    its target. Rows that repeat an id are documents of their own. If all sizes are 0, or the table is empty, all targets
    are 0. Reruns give the same mix: the order depends on the seed and the ids.
    """
    from barloom.llm.common import word_count

    size = word_count(docs["text"]) if size is None else size
    sizes = docs.select(docs["source"].cast("string").alias("source"), size.alias("size"))
    targets = materialise(source_targets(sizes, weights, share, repeats), "targets")
    queue = materialise(queues(docs, targets, size, seed, parts, repeats), "queue")
    lap = F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("lap")
    copies = queue.where("size > 0").select("size", "weight", "source_size", "ahead", "source", "at", lap)

    def time(lap: Column) -> Column:
        return (F.col("ahead") + lap * F.col("source_size") + F.col("size") / F.lit(2.0)) / F.col("weight")

    copies = copies.withColumn("time", time(F.col("lap")))
    # range sort: equal steps of time hold about equal tokens, as every queue is served at its weight
    end = copies.agg(F.max("time").alias("end"), (F.sum("size") / F.lit(repeats) * F.lit(share)).alias("budget"))
    timed = copies.crossJoin(F.broadcast(end)).withColumn("step", F.least(F.lit(parts - 1), (F.col("time") / F.col("end") * F.lit(parts)).cast("int")))
    held = timed.groupBy("step").agg(F.sum("size").alias("held"), F.first("budget").alias("budget"))
    served = held.withColumn("served", F.coalesce(F.sum("held").over(Window.orderBy("step").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    last = served.where("served <= budget").groupBy().agg(F.max(F.struct("step", "served")).alias("last")).select("last.*")
    crossing = timed.join(F.broadcast(last), "step")
    turn = Window.partitionBy("step").orderBy("time", F.col("source").asc_nulls_last(), "at", "size")
    # the copy in which the budget ends is served if more than half of it fits
    upto = crossing.withColumn("upto", F.col("served") + F.sum("size").over(turn.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size") / F.lit(2.0))
    cut = upto.agg(F.max(F.when(F.col("upto") <= F.col("budget"), F.col("time"))).alias("stop"), F.min("time").alias("open"))
    cut = cut.select(F.coalesce("stop", F.col("open") - F.lit(1e-9), F.lit(-1.0)).alias("stop"))
    laps = [(time(F.lit(k)) <= F.col("stop")).cast("long") for k in range(repeats)]
    times = laps[0]
    for more in laps[1:]:
        times = times + more
    return queue.crossJoin(F.broadcast(cut)).select("row", "size", "source_size", "target", (F.col("size") * times).alias("taken"))

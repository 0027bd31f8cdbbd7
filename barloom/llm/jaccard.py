"""N-gram Jaccard join by T-occurrence search over inverted lists, and the classes its links form.

Two sets of a and b shingles with similarity t or more share at least T = ceil(t / (1 + t) * (a + b)) of them, and
no fewer than ceil(t * a). All shingles have one global order, rarest first by a count over the whole corpus. Of
the inverted lists that a document would search, its T - 1 longest are put aside (DivideSkip), so a partner must occur
in one of the short ones: these are merged in sorted order, and partners found there are probed for the long ones by
binary search in their sorted sets until the required overlap is reached or out of reach.

Lists are merged twice, so that groups of near copies never give all their pairs. First each document meets its
neighbour in every list and the list's head of about its size, which is the document whose shingles are commonest: of near
copies that with the fewest edits, so what links with any other links with it as a rule. Links found so are closed to classes. Then only documents of different
classes are still to be compared, which finds every remaining link between classes. Pairs are first held against
counts of their shingles by bucket, whose smaller ones add up to no less than the overlap; sets are fetched for the rest.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.common import plain, slices
from barloom.session import materialise

#: Counters of the sketch by which shingles are ordered, and rows in which it is summed. The order decides which lists
#: are short, never the result.
COUNTERS, ROWS = 1 << 20, 256

#: Buckets of the marks by which pairs are ruled out before their sets are fetched, and the largest set that has marks
#: (counts of larger ones might not fit a byte; their pairs are always probed).
MARKS, MARKED = 256, 20_000

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def shingle_sets(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (64 bits, sorted) of the distinct shingles of all texts in a row, and the offsets of each text.

    A text with fewer words than ``width`` has its whole sequence as its only shingle, one without words has none.
    """
    out, cuts, hashed = [], [0], xxhash.xxh3_64_intdigest
    odd = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)
    factors = np.array([(int(odd[k % 4]) * (2 * (k // 4) + 1)) % (1 << 64) for k in range(width)], np.uint64)
    for text in texts.to_pylist():
        words = text.encode().translate(_LOWER).split()
        codes = np.fromiter(map(hashed, words), np.uint64, len(words))
        n = max(1, len(words) - width + 1) if words else 0
        code = np.full(n, min(len(words), width), np.uint64)
        for k in range(min(width, len(words))):
            code += mixed(codes[k : k + n] * factors[k])
        got = np.unique(mixed(code))
        out.append(got)
        cuts.append(cuts[-1] + len(got))
    return np.concatenate(out) if out else np.zeros(0, np.uint64), np.array(cuts, np.int64)


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    return x ^ (x >> np.uint64(27))


def counters(rows: DataFrame, codes) -> np.ndarray:
    """Sum over all tasks of a count sketch of fixed size; ``codes`` makes hashes of a batch of ``rows``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            for part in codes(batch):
                total += np.bincount((part & np.uint64(COUNTERS - 1)).astype(np.int64), minlength=COUNTERS)
        if total.any():
            yield sums(total.reshape(ROWS, -1), np.arange(ROWS))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                part = np.frombuffer(value, np.uint32).astype(np.int64)
                held[k] = held[k] + part if k in held else part
        if held:
            yield sums(np.stack(list(held.values())), np.array(list(held)))

    def sums(values: np.ndarray, keys: np.ndarray) -> pa.RecordBatch:
        values = np.minimum(values, 0xFFFFFFFF).astype(np.uint32)
        return pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int32)), pa.array([x.tobytes() for x in values], pa.binary())], names=["k", "v"])

    shape = "k int, v binary"
    total = np.zeros((ROWS, COUNTERS // ROWS), np.uint32)
    for row in rows.mapInArrow(count, shape).repartition(16, "k").mapInArrow(add, shape).collect():
        total[row["k"]] = np.frombuffer(row["v"], np.uint32)
    return total.ravel()


def needed(size: Column, percent: int) -> Column:
    """Overlap that any partner of a set of this size has at least."""
    return F.ceil(size * F.lit(percent) / F.lit(100.0)).cast("long")


def overlap(a: Column, b: Column, percent: int) -> Column:
    """T: overlap that two sets of these sizes need."""
    return F.ceil((a + b) * F.lit(percent) / F.lit(100.0 + percent) - F.lit(1e-9)).cast("long")


def prefixes(rows: DataFrame, width: int, percent: int) -> DataFrame:
    """(doc_id, n, f1, f2, short, marks, common) of rows (doc_id, text): set size, two fingerprints of the set, hashes of its short lists in order, counts by bucket, mean log count of its shingles."""

    def hashes(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        texts = plain(batch.column(1))
        for i, j in slices(texts):
            yield shingle_sets(texts[i:j], width)[0]

    frequent = rows.sparkSession.sparkContext.broadcast(counters(rows, hashes))  # of fixed size

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = frequent.value
        for batch in batches:
            texts = plain(batch.column(1))
            for i, j in slices(texts):
                codes, cuts = shingle_sets(texts[i:j], width)
                count = often[(codes & np.uint64(COUNTERS - 1)).astype(np.int64)]
                n, f1, f2, short, marks, common = np.diff(cuts), [], [], [], [], []
                again = mixed(codes ^ np.uint64(0xA24BAED4963EE407))
                for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                    f1.append(int(codes[a:b].sum(dtype=np.uint64).view(np.int64)))
                    f2.append(int(again[a:b].sum(dtype=np.uint64).view(np.int64)))
                    first = b - a - -(-(b - a) * percent // 100) + 1 if b > a else 0
                    order = np.argsort(count[a:b], kind="stable")[:first]  # equal counts keep the order of hashes
                    short.append(codes[a:b][order].view(np.int64))
                    counts = np.bincount((codes[a:b] >> np.uint64(40)).astype(np.int64) % MARKS, minlength=MARKS) if b - a <= MARKED else None
                    common.append(float(np.log1p(count[a:b]).mean()) if b > a else 0.0)
                    marks.append(counts.astype(np.uint8).tobytes() if counts is not None and counts.max() < 256 else None)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[i:j], pa.array(n), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), pa.array(short, pa.list_(pa.int64())), pa.array(marks, pa.binary()), pa.array(common, pa.float64())],
                    names=["doc_id", "n", "f1", "f2", "short", "marks", "common"])

    return rows.mapInArrow(search, "doc_id long, n long, f1 long, f2 long, short array<long>, marks binary, common double")


def sets_of(rows: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """(id, codes) of the documents in ``ids`` (id): their sorted shingle hashes, as binary."""

    def keys(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        yield batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)

    hashed = ids.select(F.xxhash64("id").alias("h"))
    some = rows.sparkSession.sparkContext.broadcast(counters(hashed, keys) > 0)  # lets most other texts go before they are hashed

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(2).to_numpy(zero_copy_only=False).view(np.uint64) & np.uint64(COUNTERS - 1)
            batch = batch.filter(pa.array(some.value[at.astype(np.int64)]))
            texts = plain(batch.column(1))
            for i, j in slices(texts):
                codes, cuts = shingle_sets(texts[i:j], width)
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], pa.array([codes[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())], names=["id", "codes"])

    found = rows.select("doc_id", "text", F.xxhash64("doc_id").alias("h")).mapInArrow(search, "id long, codes binary")
    return found.join(ids, "id", "left_semi")


def plausible(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that their marks don't rule out."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            left, right = batch.column(4), batch.column(5)
            both = np.flatnonzero(left.is_valid().to_numpy(zero_copy_only=False) & right.is_valid().to_numpy(zero_copy_only=False))
            for k in range(0, len(both), 4096):
                at = both[k : k + 4096]
                x, y = (np.frombuffer(b"".join(side.take(pa.array(at)).to_pylist()), np.uint8).reshape(-1, MARKS) for side in (left, right))
                most = np.minimum(x, y).sum(axis=1, dtype=np.int64)
                sizes = batch.column(2).to_numpy(zero_copy_only=False)[at] + batch.column(3).to_numpy(zero_copy_only=False)[at]
                keep[at] = 100 * most >= percent * (sizes - most)
            yield batch.select([0, 1]).filter(pa.array(keep))

    own = classes.select("id", "n", "marks")
    left = pairs.join(own.withColumnsRenamed({"id": "a", "n": "na", "marks": "x"}), "a")
    both = left.join(own.withColumnsRenamed({"id": "b", "n": "nb", "marks": "y"}), "b")
    return both.select("a", "b", "na", "nb", "x", "y").mapInArrow(search, "a long, b long").distinct()


def probe(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets reach the required overlap, each once."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            left, right = batch.column(2), batch.column(3)
            for k in range(batch.num_rows):
                x, y = (np.frombuffer(side[k].as_buffer(), np.uint64) for side in (left, right))
                if len(x) > len(y):
                    x, y = y, x
                if not len(x):
                    continue
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                common = int((y[at] == x).sum())
                keep[k] = 100 * common >= percent * (len(x) + len(y) - common)
            yield batch.select([0, 1]).filter(pa.array(keep))

    left = pairs.join(sets.withColumnsRenamed({"id": "a", "codes": "x"}), "a")
    both = left.join(sets.withColumnsRenamed({"id": "b", "codes": "y"}), "b")
    return both.select("a", "b", "x", "y").mapInArrow(search, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of all ids in edges (a, b): the smallest id reachable, by repeated contraction.

    In each turn every id moves to that neighbour, or stays at itself, whose hash is smallest; edges move along, and those within
    one id vanish. Hashes differ from turn to turn, so paths shrink by a constant factor and large groups at once.
    """
    left = materialise(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    steps: list[DataFrame] = []
    while not left.isEmpty():
        both = left.select(F.col("a").alias("id"), F.col("b").alias("to")).unionByName(left.select(F.col("b").alias("id"), F.col("a").alias("to")))

        def drawn(name: str, turn: int = len(steps)) -> Column:
            return F.xxhash64(F.lit(turn), name)

        near = both.groupBy("id").agg(F.min_by("to", drawn("to")).alias("to"), F.min(drawn("to")).alias("least"))
        step = materialise(near.select("id", F.when(drawn("id") < F.col("least"), F.col("id")).otherwise(F.col("to")).alias("to")), "step")
        steps.append(step)
        moved = left.join(step.withColumnsRenamed({"id": "a", "to": "x"}), "a").join(step.withColumnsRenamed({"id": "b", "to": "y"}), "b")
        left = materialise(moved.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
    if not steps:
        return left.select(F.col("a").alias("id"), F.col("b").alias("component"))
    whole = steps[-1]
    for step in reversed(steps[:-1]):
        later = whole.select(F.col("id").alias("to"), F.col("to").alias("last"))
        whole = step.join(later, "to", "left").select("id", F.coalesce("last", "to").alias("to"))
    whole = materialise(whole, "moved")
    least = whole.groupBy("to").agg(F.min("id").alias("component"))
    return whole.join(least, "to").select("id", "component")


def shared_ids(each: DataFrame, classes: DataFrame, same: list[str]) -> DataFrame:
    """Edges (a, b) between classes that hold rows of one id."""
    full = each.where("n > 0 AND doc_id IS NOT NULL").select("doc_id", F.struct(*same).alias("set"))
    several = full.groupBy("doc_id").agg(F.min("set").alias("low"), F.max("set").alias("high")).where("low <> high").select("doc_id")
    held = full.join(several, "doc_id").select("doc_id", "set.*").distinct().join(classes.select(*same, "id"), same)
    return held.join(held.groupBy("doc_id").agg(F.min("id").alias("a")), "doc_id").where("a <> id").select("a", F.col("id").alias("b")).distinct()


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs``.

    Words are what ASCII white space parts, with A-Z lower-cased; a set holds the distinct shingles of ``width``
    words, or the whole sequence of fewer words. Documents link when 100 * intersection >= percent * union;
    component_id is the smallest id reachable by links, itself included. Null, empty and blank texts have an empty set and
    link with nothing. Rows that repeat an id are one node of the graph; a row with a null id is only counted, its component is null.
    Equal sets are one class from the start, so exact copies cost nothing more. An empty table gives an empty result.
    """
    rows = docs.select(docs[key].cast("long").alias("doc_id"), docs[text].cast("string").alias("text"))
    each = materialise(prefixes(rows, width, percent), "prefixes")
    same = ["f1", "f2", "n"]
    # one class for each distinct set
    sets = each.where("n > 0 AND doc_id IS NOT NULL").groupBy(*same).agg(F.min("doc_id").alias("id"), F.any_value("short").alias("short"), F.any_value("marks").alias("marks"), F.any_value("common").alias("common"))
    classes = materialise(sets, "classes")
    lists = classes.select("id", "n", "common", F.posexplode("short").alias("place", "code"))
    order = Window.partitionBy("code").orderBy("n", "id")
    # sizes that could link lie in one such range or in two next to each other
    size_range = F.floor(F.log("n") / F.lit(max(math.log(100 / percent), 1e-9)))
    central = Window.partitionBy("code", "size_range").orderBy(F.desc("common"), "id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = F.struct("id", "n", "place")
    # lists of one entry bring nobody together
    merged = lists.select("*", size_range.alias("size_range"), F.lag(own).over(order).alias("before"), F.lead("id").over(order).alias("after"))
    merged = merged.where("before IS NOT NULL OR after IS NOT NULL").withColumn("head", F.first(own).over(central))
    lists = materialise(merged.select("code", "id", "n", "place", "before", "head"), "lists")

    def reachable(x: str, y: str) -> Column:
        """Whether the sizes allow a link, and what follows the common shingle in both sets is enough for it."""
        a, b = F.col(f"{x}.n"), F.col(f"{y}.n")
        rest = F.least(a - F.col(f"{x}.place"), b - F.col(f"{y}.place"))
        return (F.least(a, b) * 100 >= F.greatest(a, b) * percent) & (rest >= overlap(a, b, percent)) & (F.col(f"{x}.id") != F.col(f"{y}.id"))

    def ends(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()

    def ordered(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct()

    near = lists.select(own.alias("x"), F.explode(F.filter(F.array("before", "head"), lambda y: y.isNotNull())).alias("y"))
    first = materialise(plausible(ordered(near.where(reachable("x", "y"))), classes, percent), "pairs")
    links = materialise(probe(first, sets_of(rows, ends(first), width), percent), "links")
    classed = materialise(components(links.unionByName(shared_ids(each, classes, same))), "classed")

    # what is still to be compared: members of different classes in one list
    parts = lists.join(classed, "id", "left").select("code", "id", "n", "place", F.coalesce("component", "id").alias("own"))
    mixed_lists = parts.groupBy("code").agg(F.min("own").alias("low"), F.max("own").alias("high")).where("low <> high").select("code")
    open_lists = materialise(parts.join(mixed_lists, "code"), "open")
    x, y = (open_lists.select("code", F.col("own").alias(f"{s}own"), own.alias(s)) for s in "xy")
    across = x.join(y, "code").where(F.col("xown") < F.col("yown")).where(reachable("x", "y"))
    second = materialise(plausible(ordered(across).join(first, ["a", "b"], "left_anti"), classes, percent), "pairs")
    if not second.isEmpty():
        more = probe(second, sets_of(rows, ends(second), width), percent)
        # only classes are still to be joined, and documents without a link so far
        for end in "ab":
            of = classed.select(F.col("id").alias(end), F.col("component").alias("own"))
            more = more.join(of, end, "left").withColumn(end, F.coalesce("own", end)).drop("own")
        closed = components(more)
        tops = closed.select(F.col("id").alias("component"), F.col("component").alias("top"))
        alone = closed.join(classed, "id", "left_anti")
        classed = classed.join(tops, "component", "left").select("id", F.coalesce("top", "component").alias("component")).unionByName(alone)

    nodes = classes.select(*same, "id").join(classed, "id", "left").select(*same, F.coalesce("component", "id").alias("component"))
    alone = each.where("n = 0 OR doc_id IS NULL").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    linked = each.where("n > 0 AND doc_id IS NOT NULL").select("doc_id", *same).join(nodes, same).select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))
    return linked.unionByName(alone)

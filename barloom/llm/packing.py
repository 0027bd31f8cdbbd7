"""Packing documents into sequences by cutting-stock column generation.

Documents are cut into full sequences and a rest. The rests are counted by length class; a linear program over
patterns (how many rests of each class share a sequence) is solved by column generation, new patterns being
priced by a knapsack over the classes. Patterns are rounded down, what remains is packed first fit decreasing, and
the ranked rests of each class are dealt to the patterns by arithmetic. The plan depends on the histogram
alone, whose size is fixed by the sequence length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.common import plain, slices
from barloom.llm.tokens import encoder, id_columns, with_end
from barloom.session import materialise

#: Tokens of a sequence, and of one step of the length classes; rests are rounded up to steps when patterns are made.
CAPACITY, STEP = 2048, 8
#: Parts of each class whose counts give ranks without ordering a whole class in one task.
PARTS = 512


def cut_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = 1, text: str = "text") -> DataFrame:
    """Pieces (doc_id, start, length, doc_tokens, ids) of all documents: full sequences, then the rest.

    ``ids`` are little-endian unsigned 32-bit ids by the tokenizer file, with the end id after each document. A null
    text counts as empty; an empty text is the end id alone. Rows are cut one by one, so repeated rows give repeated pieces.
    """
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs[text].cast("string").alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            texts = plain(batch.column(1))
            for i, j in slices(texts):
                ids, cuts = with_end(*own.encode(texts[i:j]), end)
                total = np.diff(cuts)
                pieces = -(-total // capacity)
                doc = np.repeat(np.arange(j - i), pieces)
                start = (np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * capacity
                length = np.minimum(capacity, total[doc] - start)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[i:j].take(pa.array(doc)), pa.array(start), pa.array(length), pa.array(total[doc]),
                     id_columns(ids, np.concatenate([[0], np.cumsum(length)]))],
                    names=["doc_id", "start", "length", "doc_tokens", "ids"])

    return rows.mapInArrow(cut, "doc_id long, start long, length long, doc_tokens long, ids binary")


def best_pattern(values: np.ndarray, sizes: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """The most valuable filling of ``room`` units by items of the given sizes (knapsack with repeats)."""
    worth = np.full(room + 1, -np.inf)
    worth[sizes] = values
    best, last = np.zeros(room + 1), np.zeros(room + 1, np.int64)
    back = np.zeros(room + 1)  # best, from the end on, so that both operands are read in order
    for used in range(1, room + 1):
        gain = worth[1 : used + 1] + back[room - used + 1 :]
        size = int(gain.argmax()) + 1
        if gain[size - 1] > best[used - 1] + 1e-12:
            best[used], last[used] = gain[size - 1], size
        else:
            best[used] = best[used - 1]
        back[room - used] = best[used]
    counts, left = np.zeros(room + 1, np.int64), room
    while left > 0:
        counts[last[left]] += last[left] > 0
        left -= max(1, int(last[left]))
    counts = counts[sizes]
    return float(best[room]), counts


#: A packing whose length is within this share of the linear program's optimum ends the generation of patterns.
GAP = 0.002


def generate_patterns(demand: np.ndarray, sizes: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (a row each) and how often each is used in a fractional packing within ``GAP`` of the optimum."""
    m = len(sizes)
    patterns = np.diag(room // sizes).astype(float)
    inverse = np.diag(1 / patterns.diagonal())
    for turn in range(40 * m):  # a basis is feasible at every turn; more turns than ever needed
        value, new = best_pattern(inverse.sum(axis=0), sizes, room)
        if value <= 1 + GAP:  # dividing all prices by the value makes them feasible, which bounds the optimum
            break
        column, use = inverse @ new, inverse @ demand
        ratio = np.where(column > 1e-9, np.maximum(use, 0) / np.where(column > 1e-9, column, 1), np.inf)
        row = int(ratio.argmin())
        patterns[:, row] = new
        pivot = inverse[row] / column[row]
        inverse -= np.outer(column, pivot)
        inverse[row] = pivot
        if turn % 50 == 49:
            inverse = np.linalg.inv(patterns)
    return patterns.T.round().astype(np.int64), np.maximum(np.linalg.solve(patterns, demand.astype(float)), 0)


def first_fit(counts: np.ndarray, sizes: np.ndarray, room: int) -> list[np.ndarray]:
    """Fillings of sequences for a few remaining items, each filled with the largest that fit."""
    left, out = counts.copy(), []
    while left.any():
        pattern, free = np.zeros_like(left), room
        for item in np.flatnonzero(left)[::-1]:
            take = min(int(left[item]), free // int(sizes[item]))
            pattern[item] += take
            free -= take * int(sizes[item])
        left -= pattern
        out.append(pattern)
    return out


def plan(counts: dict[int, int], room: int) -> dict[int, np.ndarray]:
    """For each class (units) an array of rows (first rank, items a sequence, first sequence, place in the sequence)."""
    sizes = np.array(sorted(k for k, n in counts.items() if n > 0), np.int64)
    if not len(sizes):
        return {}
    demand = np.array([counts[int(k)] for k in sizes], np.int64)
    patterns, use = generate_patterns(demand, sizes, room)
    times = np.floor(use + 1e-6).astype(np.int64)
    rest = demand - times @ patterns
    while (rest < 0).any():  # only by rounding in the solution
        item = int(np.flatnonzero(rest < 0)[0])
        worst = max((p for p in range(len(times)) if times[p] and patterns[p, item]), key=lambda p: times[p])
        times[worst] -= 1
        rest = demand - times @ patterns
    chosen = [(patterns[p], int(times[p])) for p in range(len(times)) if times[p]] + [(p, 1) for p in first_fit(rest, sizes, room)]
    rows: dict[int, list] = {int(k): [] for k in sizes}
    ranks, sequence = np.zeros(len(sizes), np.int64), 0
    for pattern, n in chosen:
        place = 0
        for item in np.flatnonzero(pattern)[::-1]:
            rows[int(sizes[item])].append((int(ranks[item]), int(pattern[item]), sequence, place))
            ranks[item] += n * pattern[item]
            place += int(pattern[item])
        sequence += n
    return {k: np.array(v, np.int64) for k, v in rows.items()}


def pack(pieces: DataFrame, capacity: int = CAPACITY, step: int = STEP, parts: int = PARTS) -> DataFrame:
    """``pieces`` (doc_id, start, length and any other orderable columns) with sequence_id and offset appended.

    Lengths are 1 to ``capacity``. Pieces of a sequence lie gapless from offset 0; sequence ids are gapless from 0.
    Repeated rows are pieces of their own, ties among equal rows don't matter. An empty table stays empty.
    """
    room = capacity // step
    # a class of the full sequence alone, so that full sequences are exact whatever the step
    kind = F.when(F.col("length") == capacity, F.lit(room)).otherwise(F.least(F.ceil(F.col("length") / F.lit(step)), F.lit(room))).cast("int")
    part = F.pmod(F.xxhash64("doc_id", "start"), F.lit(parts)).cast("int")
    own = materialise(pieces.select(F.struct(*pieces.columns).alias("piece"), kind.alias("kind"), part.alias("part")), "pieces")
    # at most room * parts numbers, however many pieces there are
    held = own.groupBy("kind", "part").count().toPandas().sort_values(["kind", "part"])
    held["base"] = held.groupby("kind")["count"].cumsum() - held["count"]
    base = np.zeros((room + 1, parts), np.int64)
    base[held["kind"].to_numpy(int), held["part"].to_numpy(int)] = held["base"].to_numpy()
    placed = plan({int(k): int(n) for k, n in held.groupby("kind")["count"].sum().items()}, room)

    order = Window.partitionBy("kind", "part").orderBy("piece")
    ranked = own.withColumn("rank", F.row_number().over(order) - 1)
    names = ["sequence_id", "turn"]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds = batch.column(1).to_numpy(zero_copy_only=False)
            rank = batch.column(3).to_numpy(zero_copy_only=False) + base[kinds, batch.column(2).to_numpy(zero_copy_only=False)]
            sequence, turn = np.zeros(len(kinds), np.int64), np.zeros(len(kinds), np.int64)
            for k in np.unique(kinds):
                rows, at = placed[int(k)], np.flatnonzero(kinds == k)
                row = rows[np.searchsorted(rows[:, 0], rank[at], side="right") - 1]
                inside = rank[at] - row[:, 0]
                sequence[at], turn[at] = row[:, 2] + inside // row[:, 1], row[:, 3] + inside % row[:, 1]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sequence), pa.array(turn)], names=["piece", *names])

    dealt = ranked.mapInArrow(deal, own.select("piece").schema.add("sequence_id", "long").add("turn", "long"))
    before = Window.partitionBy("sequence_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    return dealt.withColumn("offset", F.coalesce(F.sum("piece.length").over(before), F.lit(0)).cast("long")).select("piece.*", "sequence_id", "offset")


def sequences(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Rows (sequence_id, n_tokens, padded, ids) from packed pieces that carry ``ids``; padded to the capacity unless a power of two."""
    joined = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"), F.sum("length").alias("n_tokens"))
    padded = F.when(F.expr("bit_count(n_tokens) = 1"), F.col("n_tokens")).otherwise(F.lit(capacity))
    whole = F.aggregate("parts", F.lit(b""), lambda have, x: F.concat(have, x["ids"]))
    return joined.select("sequence_id", "n_tokens", padded.cast("long").alias("padded"), whole.alias("ids"))

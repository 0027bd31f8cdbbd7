"""Repeated byte strings by prefix-free parsing, with suffix arrays of the dictionary and of the parse.

A window is a string of ``LENGTH`` bytes. A rolling hash of ``GRAM`` bytes sets triggers: the trigger of a window is the
smallest hash among its first ``REACH``, so every window has one and equal windows have it at the same offset. Triggers part a
text into phrases: the windows of one trigger begin in the phrase in front of it and end in the parse behind it. A trigger
modulo a number would leave phrases without bound, and windows without a trigger; the minimum doesn't.

1. Parse. Each task names its triggers: ``near`` names the LENGTH - REACH + 1 bytes behind the trigger, which all its windows
   hold, ``whole`` all bytes of its windows. Triggers of one near and whole name have all windows in common.
2. Names meet over the corpus, one row a task and near name. A near name that occurs once has no repeated window, which settles
   all text that isn't repeated; equal whole names settle copies without a look at their bytes.
3. What is left are the borders of repeated passages. Their bytes are brought together by near name, one of each whole name. The
   phrases (the dictionary, sorted from the trigger backwards) and the continuations (the parse, sorted forwards) give two
   suffix arrays with common-prefix lengths. A window o bytes before its trigger is in the class of phrases that share o
   bytes and in the class of continuations that share LENGTH - o; both together are its place in corpus order, and it is
   repeated if another window has the same two. No hash decides there.

A near name with more than ``GROUP`` different borders is dealt to several groups; windows that find no partner within their
group then meet by a name of their bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.common import binary_array, plain
from barloom.session import materialise

#: Bytes of a window, of the hashed grams, and of the stretch at a window's begin that holds its trigger.
LENGTH, GRAM, REACH = 200, 12, 128
#: Bytes of text that are parsed at once, and triggers that a task holds before it writes their names.
PIECE, HELD = 1 << 20, 400_000
#: Borders of one near name that are compared in one group at most, and borders that a task sorts together.
GROUP, TOGETHER = 4096, 16_384

_RNG = np.random.default_rng(20)
_VALUES = _RNG.integers(1, 1 << 63, (2, 256), dtype=np.uint64)
_BASES = [0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93]
_INVERSES = [pow(x, -1, 1 << 64) for x in _BASES]


def mixed(x: np.ndarray) -> np.ndarray:
    """Numbers scattered over all 64 bits, one to one."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def powers(base: int, n: int, known: dict[int, np.ndarray] = {}) -> np.ndarray:  # noqa: B006 - kept by the worker
    """1, base, base^2, ... modulo 2^64."""
    if base not in known or len(known[base]) < n:
        out = np.full(max(n, 2 * PIECE), base, np.uint64)
        out[0] = 1
        known[base] = np.cumprod(out, dtype=np.uint64)
    return known[base][:n]


class Sums:
    """Names of any stretches of a text from one pass over it."""

    def __init__(self, data: np.ndarray, kind: int) -> None:
        self.inverse = powers(_INVERSES[kind], len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_VALUES[kind][data] * powers(_BASES[kind], len(data)), out=self.sums[1:])

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[begin]) * self.inverse[begin] + (end - begin).astype(np.uint64))


def triggers(data: np.ndarray, n: int, gram: int, reach: int) -> np.ndarray:
    """For windows beginning at 0 to n - 1: the place of the trigger of each."""
    base = 0x01000193
    code, size = data.astype(np.uint32) + np.uint32(1), 1
    whole, have = np.zeros(len(data), np.uint32), 0
    # grams of any length from those of powers of two
    for bit in range(gram.bit_length()):
        if gram >> bit & 1:
            at = len(data) - have - size + 1
            whole = code[:at] * np.uint32(pow(base, have, 1 << 32)) + whole[size : size + at] if have else code
            have += size
        if bit + 1 < gram.bit_length():
            code = code[: len(code) - size] * np.uint32(pow(base, size, 1 << 32)) + code[size:]
            size *= 2
    whole = whole * np.uint32(0x85EBCA6B)
    whole ^= whole >> np.uint32(15)
    key = (whole.astype(np.uint64) << np.uint64(32)) + np.arange(len(whole), dtype=np.uint64)
    size, low = 1, key
    while size * 2 <= reach:
        low = np.minimum(low[: len(low) - size], low[size:])
        size *= 2
    if size < reach:
        low = np.minimum(low[: len(low) - (reach - size)], low[reach - size :])
    return (low[:n] & np.uint64(0xFFFFFFFF)).astype(np.int64)


def parse(data: np.ndarray, begins: np.ndarray, windows: np.ndarray, length: int = LENGTH, gram: int = GRAM, reach: int = REACH) -> tuple[np.ndarray, ...]:
    """(piece, trigger, first, last, near, whole) of pieces that lie behind each other; ``first`` to ``last`` begin a trigger's windows.

    ``begins`` are the places of the pieces, ``windows`` how many windows of each count.
    """
    place = triggers(data, len(data) - length + 1, gram, reach)
    first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    last = np.concatenate([first[1:], [len(place)]]) - 1
    # windows that reach over the end of a piece don't count
    ends = begins + windows
    low, high = np.searchsorted(ends, first, side="right"), np.searchsorted(begins, last, side="right") - 1
    n = np.maximum(0, high - low + 1)
    at = np.repeat(np.arange(len(first)), n)
    piece = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n) + low[at]
    trigger, first, last = place[first][at], np.maximum(first[at], begins[piece]), np.minimum(last[at], ends[piece] - 1)
    near = Sums(data, 0).of(trigger, trigger + (length - reach + 1))
    whole = Sums(data, 1).of(first, last + length) ^ mixed((trigger - first).astype(np.uint64))
    return piece, trigger, first, last, near.view(np.int64), whole.view(np.int64)


def pieces(text: bytes, length: int = LENGTH, piece: int = PIECE) -> Iterator[tuple[int, np.ndarray, int]]:
    """(place, bytes, windows) of stretches that together hold every window of a text once."""
    n = len(text) - length + 1
    for begin in range(0, n, piece):
        end = min(n, begin + piece)
        yield begin, np.frombuffer(text, np.uint8, end - begin + length - 1, begin), end - begin


def joined(rows: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans [low, high) of the same row united where they touch."""
    order = np.lexsort((low, rows))
    rows, low, high = rows[order], low[order], high[order]
    if not len(rows):
        return rows, low, high
    change = np.concatenate([[True], rows[1:] != rows[:-1]])
    group = np.cumsum(change)
    top = np.maximum.accumulate(high + group * (np.int64(1) << 40)) - group * (np.int64(1) << 40)
    new = change.copy()
    new[1:] |= low[1:] > top[:-1]
    starts = np.flatnonzero(new)
    return rows[starts], low[starts], np.maximum.reduceat(high, starts)


def common(sorted_rows: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each row of bytes with the row before it."""
    equal = sorted_rows[1:] == sorted_rows[:-1]
    out = np.where(equal.all(axis=1), equal.shape[1], equal.argmin(axis=1))
    return np.concatenate([[0], out])


def suffix_array(rows: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of rows of bytes by group and content, and their common-prefix lengths (-1 at a group's first)."""
    wide = np.ascontiguousarray(np.concatenate([group.astype(">u8").view(np.uint8).reshape(len(rows), 8), rows], axis=1))
    order = np.argsort(wide.view(f"S{wide.shape[1]}").ravel(), kind="stable")
    shared = common(rows[order])
    shared[np.concatenate([[True], group[order][1:] != group[order][:-1]])] = -1
    return order, shared


def repeated(group: np.ndarray, left: np.ndarray, right: np.ndarray, low: np.ndarray, high: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Which windows have an equal one in their group: a row for each trigger, a column for each offset of the window before it.

    ``left`` holds the bytes before the trigger from the trigger backwards, ``right`` those from it on; a trigger has the
    windows that begin ``low`` to ``high`` bytes before it.
    """
    m = len(group)
    out = np.zeros((m, left.shape[1] + 1), bool)
    by_phrase, phrase_shares = suffix_array(left, group)
    by_parse, parse_shares = suffix_array(right, group)
    for o in range(int(low.min(initial=0)), int(high.max(initial=-1)) + 1):
        some = np.flatnonzero((low <= o) & (o <= high))
        if len(some) < 2:
            continue
        phrase, parse_ = np.zeros(m, np.int64), np.zeros(m, np.int64)
        phrase[by_phrase] = np.cumsum(phrase_shares < o)
        parse_[by_parse] = np.cumsum(parse_shares < length - o)
        key = phrase[some] * (m + 1) + parse_[some]
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        out[some[order[1:][same]], o] = True
        out[some[order[:-1][same]], o] = True
    return out


#: What names a row: its id and a hash of its text. Rows of equal id and text have the same repeated spans.
ROW = ["id", "mark"]
_NAMES = pa.schema([("kind", pa.int32()), ("near", pa.int64()), ("whole", pa.int64()), ("several", pa.bool_()), ("id", pa.int64()), ("mark", pa.int64()),
                    ("trigger", pa.int64()), ("first", pa.int64()), ("last", pa.int64())])


def names(rows: DataFrame, length: int, gram: int, reach: int) -> DataFrame:
    """What each task finds in its rows (id, mark, text): one row of kind 0 a near name, kind 1 for further borders, kind 2 for repeated spans.

    ``several`` says that the task has other triggers of that near name.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owners: list[tuple[int, int]] = []  # of the rows held
        held: list[tuple[np.ndarray, ...]] = []
        waiting: list[tuple[int, int, np.ndarray, int]] = []

        def keep() -> None:
            windows = np.array([x[3] for x in waiting])
            begins = np.cumsum([0, *(len(x[2]) for x in waiting)])[:-1]
            piece, trigger, first, last, near, whole = parse(np.concatenate([x[2] for x in waiting]), begins, windows, length, gram, reach)
            shift = (np.array([x[1] for x in waiting]) - begins)[piece]
            held.append((np.array([x[0] for x in waiting])[piece], trigger + shift, first + shift, last + shift, near, whole))
            waiting.clear()

        def out() -> Iterator[pa.RecordBatch]:
            row, trigger, first, last, near, whole = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.lexsort((whole, near))
            row, trigger, first, last, near, whole = (x[order] for x in (row, trigger, first, last, near, whole))
            new = np.concatenate([[True], near[1:] != near[:-1]])
            fresh = new | np.concatenate([[True], whole[1:] != whole[:-1]])
            several = np.diff(np.concatenate([np.flatnonzero(new), [len(near)]]))[np.cumsum(new) - 1] > 1
            twice = np.diff(np.concatenate([np.flatnonzero(fresh), [len(near)]]))[np.cumsum(fresh) - 1] > 1
            ids, marks = np.array(owners, np.int64).T
            for at in np.array_split(np.flatnonzero(fresh), max(1, int(fresh.sum()) // 50_000)):
                kind = np.where(new[at], 0, 1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (kind, near[at], whole[at], several[at], ids[row[at]], marks[row[at]], trigger[at], first[at], last[at])], schema=_NAMES)
            at, low, high = joined(row[twice], first[twice], last[twice] + length)
            no = pa.nulls(len(at), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(at), 2, np.int32)), no, no, pa.nulls(len(at), pa.bool_()), pa.array(ids[at]), pa.array(marks[at]), no, pa.array(low), pa.array(high)], schema=_NAMES)
            held.clear()
            owners.clear()

        size = count = 0
        for batch in batches:
            texts = plain(batch.column(2))
            for k, own in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                data = texts[k].as_buffer()
                if data.size < length:
                    continue
                owners.append(own)
                for place, some, n in pieces(data, length, PIECE):
                    waiting.append((len(owners) - 1, place, some, n))
                    size += len(some)
                    if size >= PIECE:
                        keep()
                        size, count = 0, count + len(held[-1][0])
                if count >= HELD:
                    if waiting:
                        keep()
                    yield from out()
                    size = count = 0
        if waiting:
            keep()
        if held:
            yield from out()

    return rows.mapInArrow(run, "kind int, near long, whole long, several boolean, id long, mark long, trigger long, first long, last long")


def borders(found: DataFrame, length: int, group: int) -> tuple[DataFrame, DataFrame]:
    """(triggers whose bytes have to be compared, spans known to be repeated) from the names of all tasks."""
    near, whole = Window.partitionBy("near"), Window.partitionBy("near", "whole")
    head = F.col("kind") == 0  # of a near name at most one from a task
    dealt = F.when(F.col("near").isNull(), F.xxhash64(*ROW)).otherwise(F.col("near"))
    met = found.withColumn("key", dealt).repartition("key")
    met = met.withColumn("near", F.col("key")).withColumn("turn", F.row_number().over(whole.orderBy("kind", *ROW, "first")))
    met = met.withColumn("times", F.count(F.lit(1)).over(whole)).withColumn("tasks", F.count(F.when(head, 1)).over(near))
    met = met.where(~head | (F.col("tasks") > 1) | F.col("several"))
    met = materialise(met.select("kind", "near", "whole", *ROW, "trigger", "first", "last", "times", "turn"), "met")
    spans = met.where("kind < 2 AND times > 1").select(*ROW, "first", (F.col("last") + length).alias("last")).unionByName(met.where("kind = 2").select(*ROW, "first", "last"))
    # of triggers that have all in common one is enough
    differ = met.where("kind < 2 AND turn = 1")
    sizes = differ.groupBy("near").count().where("count > 1")
    # near names with very many borders are dealt to groups of about the same size
    wanted = differ.join(sizes, "near").withColumn("parts", F.ceil(F.col("count") / group))
    return wanted.select("near", F.pmod("whole", "parts").cast("long").alias("part"), (F.col("parts") > 1).alias("cut"), *ROW, "trigger", "first", "last"), spans


def contents(rows: DataFrame, wanted: DataFrame, length: int, reach: int) -> DataFrame:
    """(near, part, cut, id, mark, trigger, low, high, left, right) of the wanted triggers, from the texts."""
    listed = wanted.groupBy(*ROW).agg(F.collect_list(F.struct("near", "part", "cut", "trigger", "first", "last")).alias("wanted"))
    texts = rows.join(listed, ROW).select(*ROW, "text", "wanted")
    shape = pa.schema([("near", pa.int64()), ("part", pa.int64()), ("cut", pa.bool_()), ("id", pa.int64()), ("mark", pa.int64()), ("trigger", pa.int64()),
                       ("low", pa.int32()), ("high", pa.int32()), ("left", pa.binary()), ("right", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts, size = [], 0
            values = plain(batch.column(2))
            for k, own in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                text = np.concatenate([np.zeros(reach, np.uint8), np.frombuffer(values[k].as_buffer(), np.uint8), np.zeros(length, np.uint8)])
                want = batch.column(3)[k].values
                trigger, first, last = (want.field(x).to_numpy(zero_copy_only=False) for x in ("trigger", "first", "last"))
                for at in np.array_split(np.arange(len(trigger)), max(1, len(trigger) // 4096)):
                    left = text[(trigger[at] + reach - 1)[:, None] - np.arange(reach - 1)]  # backwards
                    right = text[(trigger[at] + reach)[:, None] + np.arange(length)]
                    cuts = np.arange(len(at) + 1)
                    some = want.take(pa.array(at))
                    parts.append(pa.RecordBatch.from_arrays(
                        [some.field("near"), some.field("part"), some.field("cut"), *(pa.array(np.full(len(at), x, np.int64)) for x in own), some.field("trigger"),
                         pa.array((trigger - last)[at].astype(np.int32)), pa.array((trigger - first)[at].astype(np.int32)),
                         binary_array(left.ravel(), cuts * left.shape[1]), binary_array(right.ravel(), cuts * length)], schema=shape))
                    size += len(at)
                if size >= 4096:
                    yield from pa.Table.from_batches(parts).combine_chunks().to_batches()
                    parts, size = [], 0
            if parts:
                yield from pa.Table.from_batches(parts).combine_chunks().to_batches()

    return texts.mapInArrow(run, "near long, part long, cut boolean, id long, mark long, trigger long, low int, high int, left binary, right binary")


def compared(found: DataFrame, length: int) -> DataFrame:
    """Windows of the borders: repeated ones as spans (id, mark, first, last); of groups that were cut, also a name for each window."""
    ordered = found.repartition("near", "part").sortWithinPartitions("near", "part")
    shape = pa.schema([("id", pa.int64()), ("mark", pa.int64()), ("first", pa.int64()), ("last", pa.int64()), ("name", pa.binary()), ("alone", pa.bool_())])

    def settle(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        near, part, ids, marks, trigger, low, high = (rows.column(x).to_numpy() for x in ("near", "part", "id", "mark", "trigger", "low", "high"))
        left, right = (np.frombuffer(b"".join(rows.column(x).to_pylist()), np.uint8).reshape(len(near), -1) for x in ("left", "right"))
        new = np.concatenate([[True], (near[1:] != near[:-1]) | (part[1:] != part[:-1])])
        hit = repeated(np.cumsum(new), left, right, low, high, length)
        at, o = np.nonzero(hit)
        owner = np.unique(np.stack([ids, marks], axis=1), axis=0, return_inverse=True)[1].ravel()
        first = np.unique(owner, return_index=True)[1]
        whose, begin, end = joined(owner[at], trigger[at] - o, trigger[at] - o + length)
        n = len(whose)
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids[first][whose]), pa.array(marks[first][whose]), pa.array(begin), pa.array(end), pa.nulls(n, pa.binary()), pa.nulls(n, pa.bool_())], schema=shape)
        for k in np.flatnonzero(rows.column("cut").to_numpy()):
            offsets = np.arange(low[k], high[k] + 1)
            both = left[k][::-1].tobytes() + right[k].tobytes()
            around = [blake2b(both[left.shape[1] - o : left.shape[1] - o + length], digest_size=16).digest() for o in offsets.tolist()]
            begin = trigger[k] - offsets
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(offsets), ids[k])), pa.array(np.full(len(offsets), marks[k])), pa.array(begin), pa.array(begin + length), pa.array(around, pa.binary()),
                 pa.array(~hit[k][offsets])], schema=shape)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            if held.num_rows < TOGETHER:
                continue
            near, part = held.column("near").to_numpy(), held.column("part").to_numpy()
            border = np.flatnonzero((near[1:] != near[:-1]) | (part[1:] != part[:-1]))
            if len(border):
                yield from settle(held.slice(0, int(border[-1]) + 1))
                held = held.slice(int(border[-1]) + 1)
        if held is not None and held.num_rows:
            yield from settle(held)

    return ordered.mapInArrow(run, "id long, mark long, first long, last long, name binary, alone boolean")


def repeated_spans(rows: DataFrame, length: int = LENGTH, gram: int = GRAM, reach: int = REACH, group: int = GROUP) -> DataFrame:
    """(id, mark, first, last): spans of rows (id, mark, text) that repeated windows cover; they may overlap."""
    if reach + gram - 1 > length:
        raise ValueError("a trigger has to lie within its window")
    wanted, spans = borders(names(rows, length, gram, reach), length, group)
    result = materialise(compared(contents(rows, wanted, length, reach), length), "compared")
    # windows of groups that were cut: equal bytes in another group
    named = result.where("name IS NOT NULL")
    several = named.groupBy("name").count().where("count > 1").select("name")
    late = named.where("alone").join(several, "name", "left_semi").select(*ROW, "first", "last")
    return spans.unionByName(result.where("name IS NULL").select(*ROW, "first", "last")).unionByName(late)


def without_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, reach: int = REACH, group: int = GROUP, text: str = "text") -> DataFrame:
    """``docs`` without the text, with n_bytes, n_removed, n_spans and kept (binary): the text without its repeated bytes.

    A byte goes if a string of ``length`` bytes over it also begins anywhere else, in the same text or in another; texts
    are looked at as UTF-8 and as they came in. Null and empty texts, and those shorter than ``length``, stay whole. Repeated
    rows are different rows, so their long texts go entirely. doc_id may be null. Columns named like an output are replaced by it.
    """
    others = [c for c in docs.columns if c not in (text, "n_bytes", "n_removed", "n_spans", "kept")]
    value = docs[text].cast("string")
    keyed = docs.select(F.coalesce(docs["doc_id"].cast("long"), F.lit(-1)).alias("id"), F.xxhash64(value).alias("mark"), F.struct(*[docs[c] for c in others]).alias("rest"), value.alias("text"))
    merged = repeated_spans(keyed.drop("rest"), length, gram, reach, group).groupBy(*ROW).agg(F.sort_array(F.collect_set(F.struct("first", "last"))).alias("spans"))
    schema = docs.select(*others).schema.add("n_bytes", "long").add("n_removed", "long").add("n_spans", "long").add("kept", "binary")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, spans = plain(batch.column(1)), batch.column(2)
            sizes, removed, n_spans, kept = [], [], [], []
            for k in range(batch.num_rows):
                data = texts[k].as_buffer().to_pybytes()
                low = high = np.zeros(0, np.int64)
                if spans[k].is_valid:
                    first, last = (spans[k].values.field(x).to_numpy(zero_copy_only=False) for x in ("first", "last"))
                    _, low, high = joined(np.zeros(len(first), np.int64), first, last)
                edges = [0, *np.stack([low, high], axis=1).ravel().tolist(), len(data)]
                kept.append(b"".join([data[i:j] for i, j in zip(edges[::2], edges[1::2], strict=True)]))
                sizes.append(len(data))
                removed.append(int((high - low).sum()))
                n_spans.append(len(low))
            more = [*(pa.array(x, pa.int64()) for x in (sizes, removed, n_spans)), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays([*batch.column(0).flatten(), *more], names=schema.names)

    return keyed.join(merged, ROW, "left").select("rest", "text", "spans").mapInArrow(cut, schema)

"""Periodic runs of words by seed and extend on diagonals.

A run is a stretch of words with smallest period q that is at least ``TIMES`` periods and ``SHORTEST`` words long and can't
be extended (``TIMES`` is at least 3). Lags are taken in classes [2^j, 2^(j+1)). A run of lag q and its copy q words on share at least
(TIMES - 1) * q words, so all runs of a class hold a k-gram, k being the least such overlap of the class, twice at their lag.

* Seeds: grams are indexed by names that are equal only for equal grams of the same document, doubled in length from class to
  class; positions whose gram occurs once leave the index. Since k >= q, the next occurrence of a gram of a run of smallest
  period q is exactly q on (two periods in k words would leave a smaller one), so each occurrence is paired with the next alone:
  pairs are linear in the words however often a gram occurs, and a stretch with a smaller period gives no seed.
* Extend: a seed is extended both ways word by word along its diagonal. The furthest place covered is kept for each lag, and
  seeds before it are passed over.

Documents are independent rows: a text is looked at in one piece, in arrays of a few bytes a word.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.llm.common import plain, slices

#: Least number of periods and of words in a run.
TIMES, SHORTEST = 4, 6


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts in a row (between ASCII white space), and the offset of each text's first word, with the end."""
    lists = pc.ascii_split_whitespace(texts)
    offsets = lists.offsets.to_numpy().astype(np.int64)
    flat = lists.flatten()
    some = pc.not_equal(flat, "")
    before = np.concatenate([[0], np.cumsum(some.to_numpy(zero_copy_only=False))])
    return flat.filter(some), before[offsets - offsets[0]]


class Grams:
    """Names of the grams of one length that occur twice or more in their document; -1 elsewhere."""

    def __init__(self, length: int, at: np.ndarray, key: np.ndarray, size: int) -> None:
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        name = np.concatenate([[0], np.cumsum(~same)])[: len(key)]
        twice = np.zeros(len(key), bool)
        twice[1:] |= same
        twice[:-1] |= same
        self.length, self.n = length, int(name[-1]) + 1 if len(name) else 0
        self.at = np.sort(at[order[twice]])
        self.names = np.full(size, -1, np.int64)
        self.names[at[order[twice]]] = name[twice]

    def joined(self, other: Grams) -> tuple[np.ndarray, np.ndarray]:
        """Places and keys of the grams made of one of these and one of ``other`` right behind it."""
        at = self.at[self.at < len(self.names) - self.length]
        after = other.names[at + self.length]
        at, after = at[after >= 0], after[after >= 0]
        return at, self.names[at] * np.int64(max(1, other.n)) + after


def seeds(at: np.ndarray, key: np.ndarray, least: int, most: int) -> list[tuple[int, int]]:
    """(lag, place) of occurrences whose next occurrence is ``least`` to ``most`` - 1 words on, first of each row of places, in order."""
    order = np.argsort(key, kind="stable")  # places of one gram stay in order
    key, at = key[order], at[order]
    lag = at[1:] - at[:-1]
    good = (key[1:] == key[:-1]) & (lag >= least) & (lag < most)
    lag, place = lag[good], at[:-1][good]
    order = np.lexsort((place, lag))
    lag, place = lag[order], place[order]
    head = np.ones(len(lag), bool)
    head[1:] = (lag[1:] != lag[:-1]) | (place[1:] != place[:-1] + 1)
    return list(zip(lag[head].tolist(), place[head].tolist(), strict=True))


def reach(codes: np.ndarray, at: int, lag: int, stop: int) -> int:
    """The first place from ``at`` on, or ``stop``, whose word differs from that ``lag`` words on."""
    step = 32
    while at < stop:
        to = min(stop, at + step)
        differ = codes[at:to] != codes[at + lag : to + lag]
        if differ.any():
            return at + int(differ.argmax())
        at, step = to, step * 2
    return stop


def reach_back(codes: np.ndarray, at: int, lag: int, start: int) -> int:
    """The last place p <= ``at`` such that all words from p to ``at`` - 1 equal those ``lag`` words on."""
    step = 32
    while at > start:
        to = max(start, at - step)
        differ = (codes[to:at] != codes[to + lag : at + lag])[::-1]
        if differ.any():
            return at - int(differ.argmax())
        at, step = to, step * 2
    return start


def find_runs(codes: np.ndarray, cuts: np.ndarray, times: int = TIMES, shortest: int = SHORTEST) -> np.ndarray:
    """Rows (start, length, period) of all runs, by start and period. ``cuts`` part the words into documents; starts count over all."""
    n = len(codes)
    document = np.repeat(np.arange(len(cuts) - 1, dtype=np.int64), np.diff(cuts))
    found: list[tuple[int, int, int]] = []
    longest = int(np.diff(cuts).max()) if len(cuts) > 1 else 0
    by_length = {1: Grams(1, np.arange(n), document * np.int64(int(codes.max(initial=0)) + 1) + codes, n)}

    def grams(length: int) -> Grams:
        if length not in by_length:
            half = grams(length // 2)
            by_length[length] = Grams(length, *half.joined(half), n)
        return by_length[length]

    def named(length: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and keys of grams of any length, from parts that are powers of two."""
        parts = [1 << b for b in range(length.bit_length() - 1, -1, -1) if length >> b & 1]
        whole = grams(parts[0])
        for size in parts[1:-1]:
            whole = Grams(whole.length + size, *whole.joined(grams(size)), n)
        return whole.joined(grams(parts[-1])) if len(parts) > 1 else (whole.at, whole.names[whole.at])

    low = 1
    while times * low <= longest:
        k = min(max(shortest, times * q) - q for q in range(low, 2 * low))  # the least overlap that any lag of the class guarantees
        covered: dict[int, int] = {}
        for lag, place in seeds(*named(k), low, 2 * low):
            if place < covered.get(lag, -1):
                continue
            owner = int(document[place])
            end = reach(codes, place + k, lag, int(cuts[owner + 1]) - lag)
            start = reach_back(codes, place, lag, int(cuts[owner]))
            covered[lag] = end
            if end - start + lag >= max(shortest, times * lag):
                found.append((start, end - start + lag, lag))
        by_length = {length: x for length, x in by_length.items() if length >= low}
        low *= 2
    out = np.array(found, np.int64).reshape(-1, 3)
    return out[np.lexsort((out[:, 2], out[:, 0]))]


def periodic_runs(docs: DataFrame, text: str = "text", times: int = TIMES, shortest: int = SHORTEST,
                  reading: Callable[[int | None, int], np.ndarray | None] | None = None) -> DataFrame:
    """``docs`` without the text, with n_words, runs (start, length, period; by start, then period) and collapsed.

    ``collapsed`` is the text's words without those that any run holds after its first period, joined by one space.
    ``reading`` may give, for a document's doc_id and number of words, the numbers of the words that are to be read instead.
    Null and empty texts have no words, no runs and collapse to an empty text. Whole texts are read; rows are
    independent, so repeated rows and empty tables need no rule; columns named like an output are replaced by it.
    """
    names = [c for c in docs.columns if c not in (text, "n_words", "runs", "collapsed")]
    key = names.index("doc_id") if reading is not None else None
    rows = docs.select(*names, docs[text].cast("string").alias(text))
    run = T.StructType([T.StructField(x, T.LongType()) for x in ("start", "length", "period")])
    schema = docs.select(*names).schema.add("n_words", "long").add("runs", T.ArrayType(run)).add("collapsed", "string")
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = plain(batch.column(len(names)))
            for i, j in slices(texts):
                words, cuts = words_of(texts[i:j])
                counts = np.diff(cuts)
                encoded = words.dictionary_encode()
                codes = encoded.indices.to_numpy().astype(np.int32)
                if reading is not None:
                    ids = batch.column(key)[i:j].to_pylist()
                    source = np.arange(len(codes))
                    for d, (own, n) in enumerate(zip(ids, counts.tolist(), strict=True)):
                        other = reading(own, n)
                        if other is not None:
                            source[cuts[d] : cuts[d + 1]] = cuts[d] + other
                    codes = codes[source]
                runs = find_runs(codes, cuts, times, shortest)
                edges = np.zeros(len(codes) + 1, np.int32)
                np.add.at(edges, runs[:, 0] + runs[:, 2], 1)
                np.add.at(edges, runs[:, 0] + runs[:, 1], -1)
                kept = np.cumsum(edges)[:-1] == 0
                left = np.concatenate([[0], np.cumsum(kept)])[cuts]
                said = encoded.dictionary.cast(pa.string()).take(pa.array(codes[kept]))
                collapsed = pc.binary_join(pa.ListArray.from_arrays(pa.array(left.astype(np.int32)), said), " ")
                of = np.searchsorted(runs[:, 0], cuts)
                inside = runs[:, 0] - np.repeat(cuts[:-1], np.diff(of))
                parts = pa.StructArray.from_arrays([pa.array(inside), pa.array(runs[:, 1]), pa.array(runs[:, 2])], names=["start", "length", "period"])
                listed = pa.ListArray.from_arrays(pa.array(of.astype(np.int32)), parts).cast(kind)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(k)[i:j] for k in range(len(names))), pa.array(counts), listed, collapsed],
                    names=schema.names)

    return rows.mapInArrow(search, schema)


def strongest(runs: str | Column = "runs") -> Column:
    """The run with the greatest exact length / period, the first of ties; null without runs."""
    runs = F.col(runs) if isinstance(runs, str) else runs
    better = lambda best, x: F.when(x["length"] * best["period"] > best["length"] * x["period"], x).otherwise(best)
    return F.when(F.size(runs) > 0, F.aggregate(runs, F.get(runs, F.lit(0)), better))

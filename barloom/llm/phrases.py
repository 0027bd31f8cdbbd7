"""Phrase collocations by set-oriented mining of occurrence relations.

The relation of level k holds the occurrences of grams of k words, sorted by place; places count words, with a free place
between two pieces, so that neighbours in place are neighbours in a piece. Relations are persisted in blocks of a language:
a row holds three megabytes of text as one gram code a place, and the block's own grams with their counts.

Level by level, as long as phrases may grow: the block counts are grouped over the corpus; grams that are frequent get an id; a
semi-join leaves only their occurrences; the relation left is merge-joined with itself on place and place + 1, which gives the
occurrences of the next length. What is shuffled between levels are distinct grams of blocks and coded blocks, never texts, and
a gram comes at most once from a block, so no gram is hot. Blocks are cogrouped with their frequent grams, not joined with lists of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.common import plain
from barloom.session import materialise

#: Bytes of text of a language that end a block, and of all languages that a task holds before it writes them all.
BLOCK, HELD = 3 << 20, 9 << 20
#: Parts in which a language is ranked before its best are ranked together.
PARTS = 32

_PIECE_ENDS, _BLANKS = b".,;:!?\n\x0b\x0c\r", b"\t"
_FOLD = bytes(10 if c in _PIECE_ENDS else 32 if c in _BLANKS else c + 32 if 65 <= c <= 90 else c for c in range(256))


def places_of(texts: list[str]) -> tuple[np.ndarray, pa.Array]:
    """Word codes by place, counted from 1 (0: a free place), and the words of the codes."""
    raw = "\n".join(texts).encode().translate(_FOLD).replace(b"\n", b" \n ")
    whole = pa.Array.from_buffers(pa.large_string(), 1, [None, pa.py_buffer(np.array([0, len(raw)], np.int64)), pa.py_buffer(raw)])
    tokens = pc.split_pattern(whole, " ").flatten().dictionary_encode()
    del raw, whole
    names = tokens.dictionary
    word = ~pc.is_in(names, pa.array(["", "\n"], names.type)).to_numpy(zero_copy_only=False)
    code = np.where(word, np.cumsum(word), 0).astype(np.int32)
    at = tokens.indices.to_numpy()
    empty = pc.index(names, pa.scalar("", names.type)).as_py()
    return code[at[at != empty] if empty >= 0 else at], names.filter(pa.array(word))


def packed(codes: np.ndarray) -> bytes:
    """Codes in two or four bytes each, which the first byte tells."""
    small = np.dtype("<u2" if codes.max(initial=0) < 1 << 16 else "<u4")
    return bytes([small.itemsize]) + codes.astype(small).tobytes()


def one_list(values: pa.Array | np.ndarray) -> pa.Array:
    """A single list of the values."""
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values))


def unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<u{data[0]}", offset=1)


def occurrences(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """The persisted relation of single words: rows (block, lang, n_words, words, n, codes)."""
    rows = docs.select(F.coalesce(docs[lang].cast("string"), F.lit("und")).alias("lang"), docs[text].cast("string").alias("text"))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first, number = TaskContext.get().partitionId() << 12, 0
        held: dict[str, list[str]] = {}
        size: dict[str, int] = {}

        def block(own: str) -> pa.RecordBatch:
            nonlocal number
            codes, words = places_of(held.pop(own))
            size.pop(own)
            n = np.bincount(codes, minlength=len(words) + 1)[1:]
            number += 1
            if number == 1 << 12:
                raise OverflowError("a task has more blocks than numbers")
            return pa.RecordBatch.from_arrays(
                [pa.array([first + number], pa.int64()), pa.array([own]), pa.array([int(n.sum())], pa.int64()), one_list(words.cast(pa.string())),
                 one_list(n), pa.array([packed(codes)], pa.binary())],
                names=["block", "lang", "n_words", "words", "n", "codes"])

        for batch in batches:
            texts = plain(batch.column(1))
            sizes = pc.binary_length(texts).to_pylist()
            for own, value, length in zip(batch.column(0).to_pylist(), texts, sizes, strict=True):
                held.setdefault(own, []).append(value.as_py())
                size[own] = size.get(own, 0) + length + 1
                if size[own] >= BLOCK:
                    yield block(own)
            if sum(size.values()) >= HELD:
                yield from [block(own) for own in list(held)]
        yield from [block(own) for own in list(held)]

    return materialise(rows.mapInArrow(blocks, "block long, lang string, n_words long, words array<string>, n array<long>, codes binary"), "occurrences")


def longer(relation: DataFrame, kept: DataFrame, keep_codes: bool) -> DataFrame:
    """The persisted relation of the next length from a relation (block, codes) and the places and ids (at, id) of its frequent grams.

    Rows (block, codes, grams, ids): ``grams`` holds for each gram of the block the places in ``ids`` of what it begins and ends
    with, and its count. A block meets its frequent grams by itself, so that a task holds those of one block, as plain columns.
    """
    names = ["block", "codes", "grams", "ids"]

    def join(own_key: tuple[pa.Scalar, ...], block: pa.Table, frequent: pa.Table) -> pa.Table:
        if not frequent.num_rows:
            return pa.table([pa.array([], pa.int64()), *(pa.array([], pa.binary()) for _ in names[1:])], names=names)
        codes = unpacked(block.column("codes")[0].as_py())
        m = frequent.num_rows + 1
        number = np.zeros(int(codes.max(initial=0)) + 1, np.uint32)  # of the frequent ones, in this block
        number[frequent.column("code").to_numpy()] = np.arange(1, m)
        own = number[codes]  # the semi-join
        # both sides are sorted by place, without gaps: the merge join on place + 1 is a shift
        at = np.flatnonzero((own[:-1] > 0) & (own[1:] > 0))
        key = own[at].astype(np.int64) * m + own[at + 1]
        del codes
        key, code, n = np.unique(key, return_inverse=True, return_counts=True)
        dense = np.zeros(len(own) if keep_codes else 0, np.uint32)
        if keep_codes:
            dense[at] = code + 1
        grams = np.stack([key // m - 1, key % m - 1, n]).astype("<u4")
        ids = frequent.column("id").to_numpy().astype("<i8")
        return pa.table([pa.array([own_key[0].as_py()], pa.int64()), *(pa.array([x], pa.binary()) for x in (packed(dense), grams.tobytes(), ids.tobytes()))], names=names)

    low = F.col("at").bitwiseAND(F.lit((1 << 32) - 1)).cast("int")
    codes = kept.select(F.shiftright("at", 32).alias("block"), low.alias("code"), "id")
    met = relation.select("block", "codes").groupBy("block").cogroup(codes.groupBy("block"))
    return materialise(met.applyInArrow(join, "block long, codes binary, grams binary, ids binary"), "longer")


def listed(relation: DataFrame) -> DataFrame:
    """Rows (at, first, second, n): the grams of all blocks by the ids of their parts. ``at`` is block * 2^32 + code."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                grams = np.frombuffer(batch.column(1)[k].as_buffer(), "<u4").reshape(3, -1)
                ids, block = np.frombuffer(batch.column(2)[k].as_buffer(), "<i8"), batch.column(0)[k].as_py()
                for i in range(0, grams.shape[1], 20_000):
                    some = grams[:, i : i + 20_000]
                    at = (block << 32) + np.arange(i + 1, i + 1 + some.shape[1])
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (at, ids[some[0]], ids[some[1]], some[2].astype(np.int32))], names=["at", "first", "second", "n"])

    return relation.select("block", "grams", "ids").mapInArrow(rows, "at long, first long, second long, n int")


def frequent(each: DataFrame, keys: list[str], least: int) -> DataFrame:
    """The persisted rows (at, id) of the grams that occur ``least`` times or more; a gram's first row, whose place is its id, has its keys and count f.

    Rows are dealt by gram once, both for the counts and for the semi-join with them; a block has one row of a gram at most.
    """
    same = Window.partitionBy(*keys)
    counted = each.select("at", *keys, F.sum("n").over(same).alias("f"), F.min("at").over(same).alias("id")).where(F.col("f") >= least)
    told = [F.when(F.col("at") == F.col("id"), F.col(c)).alias(c) for c in (*keys, "f")]
    return materialise(counted.select("at", "id", *told), "frequent")


def score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 * a * a / (left * right)), exact for counts below 10^15."""
    wide = "decimal(15,0)"
    top = F.lit(1_000_000).cast("decimal(7,0)") * a.cast(wide) * a.cast(wide)
    return F.call_function("div", top, left.cast("decimal(18,0)") * right.cast("decimal(18,0)"))


def collocations(docs: DataFrame, longest: int = 3, least: int = 10, percent: int = 50, first: int = 2000, text: str = "text", lang: str = "lang") -> DataFrame:
    """The ``first`` phrases of each language: lang, rank, phrase, a, l, r, n, score.

    Texts are lower-cased (A-Z), cut into pieces at ``.,;:!?`` and line ends, pieces into words at blanks and tabs. A phrase
    has 2 to ``longest`` words and ``least`` occurrences or more; ``a`` counts it, l and r the parts at its lowest-scoring
    cut, n all words of the language. Phrases in a longer one with at least ``percent`` percent of their occurrences are dropped.
    Order: score and a descending, then the phrase. A null lang is ``und``; null and empty texts have no words; repeated rows count
    each; a corpus without frequent phrases gives no rows. Only text and lang are read, so other columns don't matter.
    """
    relation = occurrences(docs, text, lang)
    totals = relation.groupBy("lang").agg(F.sum("n_words").alias("n"))
    each = relation.select("block", "lang", F.posexplode(F.arrays_zip("words", "n")).alias("code", "x"))
    at = F.shiftleft("block", 32) + F.col("code") + 1
    kept = frequent(each.select(at.alias("at"), "lang", F.col("x.words").alias("word"), "x.n"), ["lang", "word"], least)
    grams = kept.where("f IS NOT NULL")
    none = F.array().cast("array<long>")
    # heads and tails: how often the first and the last 1, 2, ... words of a gram occur
    told = grams.select("id", "lang", "f", F.col("word").alias("phrase"), F.col("word").alias("last"), none.alias("heads"), none.alias("tails"))
    keys, found = ["first", "second"], []
    for k in range(2, longest + 1):
        relation = longer(relation, kept, keep_codes=k < longest)
        each = listed(relation)
        if k < longest:
            kept = frequent(each, keys, least)
            grams = kept.where("f IS NOT NULL")
        else:
            counted = each.groupBy(*keys).agg(F.sum("n").alias("f")).where(F.col("f") >= least)
            grams = materialise(counted.withColumn("id", F.monotonically_increasing_id()), "grams")
        begin, end = told.drop("first", "second").alias("begin"), told.drop("first", "second").alias("end")
        told = materialise(
            grams.alias("own").join(begin, F.col("own.first") == F.col("begin.id")).join(end, F.col("own.second") == F.col("end.id")).select(
                "own.id", "own.first", "own.second", "begin.lang", "own.f", F.concat_ws(" ", "begin.phrase", "end.last").alias("phrase"), "end.last",
                F.concat("begin.heads", F.array("begin.f")).alias("heads"), F.concat("end.tails", F.array("end.f")).alias("tails")), "told")
        found.append(told)
    out = None
    for k, own in enumerate(found, 2):
        cuts = [F.struct(score(F.col("f"), F.col("heads")[j - 1], F.col("tails")[k - j - 1]).alias("score"), F.lit(j).alias("words"),
                         F.col("heads")[j - 1].alias("l"), F.col("tails")[k - j - 1].alias("r")) for j in range(1, k)]
        scored = own.select("id", "lang", "phrase", F.col("f").alias("a"), F.array_min(F.array(*cuts)).alias("cut"))
        if k < longest:  # a phrase in a longer one by two words is in one between them that occurs no less often
            over = found[k - 1].select(F.explode(F.array("first", "second")).alias("id"), F.col("f").alias("over")).groupBy("id").agg(F.max("over").alias("over"))
            scored = scored.join(over, "id", "left").where(F.col("over").isNull() | (100 * F.col("over") < percent * F.col("a"))).drop("over")
        scored = scored.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
        out = scored if out is None else out.unionByName(scored)
    if out is None:
        raise ValueError("phrases have two words at least")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(PARTS))
    best = out.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= first)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= first)
    return best.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")

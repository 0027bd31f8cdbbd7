"""Token id files with Elias-Fano coded document boundaries.

A file set is a Parquet folder; a row is a block of consecutive documents in the order of their ids. It
holds the ids of the block in one binary value, and two monotone sequences, the boundaries of the documents within
the ids and the document ids, as Elias-Fano codes with a directory for select, so that single offsets are
returned without unpacking and without tables of 64-bit numbers.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.llm.common import plain, slices
from barloom.llm.tokens import encoder, with_end
from barloom.session import work_dir

#: Ids after which a block ends at the next document, and ones between two entries of a select directory.
BLOCK, SAMPLE = 1 << 18, 64
#: Fields of one Elias-Fano code in a block.
CODE = "struct<n: long, base: long, low_bits: int, low: binary, high: binary, samples: binary>"


@dataclass
class EliasFano:
    """A non-decreasing sequence of integers: low bits packed, high parts in unary, select by sampled ones."""

    n: int
    base: int
    low_bits: int
    low: bytes
    high: bytes
    samples: bytes

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        n = len(values)
        if not n:
            return cls(0, 0, 0, b"", b"", b"")
        base = int(values[0])
        gaps = values.astype(np.int64).view(np.uint64) - np.uint64(base % (1 << 64))
        bits = max(0, (int(gaps[-1]) // n).bit_length() - 1)
        columns = np.unpackbits(gaps.astype(">u8").view(np.uint8).reshape(n, 8), axis=1)[:, 64 - bits :]
        ones = (gaps >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        high = np.zeros(int(ones[-1]) + 1, np.uint8)
        high[ones] = 1
        return cls(n, base, bits, np.packbits(columns).tobytes(), np.packbits(high).tobytes(), ones[::SAMPLE].astype("<u4").tobytes())

    def select(self, index: np.ndarray) -> np.ndarray:
        """The values at the given positions, without unpacking the others."""
        index = np.asarray(index, np.int64)
        high = np.frombuffer(self.high, np.uint8)
        places = np.frombuffer(self.samples, "<u4").astype(np.int64)[index // SAMPLE]
        out = np.zeros(len(index), np.int64)
        for k, (i, at) in enumerate(zip(index.tolist(), places.tolist(), strict=True)):
            left, first = i % SAMPLE, at // 8  # ones still to pass after the sampled one
            width = 16
            while True:
                ones = np.flatnonzero(np.unpackbits(high[first : first + width])[at % 8 :])
                if len(ones) > left:
                    break
                width *= 2
            out[k] = at + ones[left] - i
        return self._value(out, self._low(index))

    def _low(self, index: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(index), np.uint64)
        at = index[:, None] * self.low_bits + np.arange(self.low_bits)
        bits = (np.frombuffer(self.low, np.uint8)[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1
        weights = np.uint64(1) << np.arange(self.low_bits - 1, -1, -1).astype(np.uint64)
        return (bits.astype(np.uint64) * weights).sum(axis=1, dtype=np.uint64)

    def _value(self, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        return ((high.astype(np.uint64) << np.uint64(self.low_bits)) + low + np.uint64(self.base % (1 << 64))).view(np.int64)

    def all(self) -> np.ndarray:
        """All values in a row."""
        if not self.n:
            return np.zeros(0, np.int64)
        ones = np.flatnonzero(np.unpackbits(np.frombuffer(self.high, np.uint8)))
        return self._value(ones - np.arange(self.n), self._low(np.arange(self.n)))

    def row(self) -> dict:
        return dict(self.__dict__)


def write_ids(docs: DataFrame, path: str, tokenizer: str, end: int = 2, partitions: int | None = None, text: str = "text") -> str:
    """Write the ids of all documents in ascending order of doc_id under ``path``; returns ``path``.

    Null ids come first; rows that repeat an id are neighbours, ordered by their text. A null text counts as empty; an empty
    text is the end id alone. An empty table gives a file set without blocks. The range exchange decides the order; each
    task writes its blocks through Spark's committer, so a lost executor only costs its tasks again.
    """
    spark = docs.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs[text].cast("string"), F.lit("")).alias("text"))
    ordered = rows.repartitionByRange(n, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own, part = encoder(tokenizer), TaskContext.get().partitionId()
        number, start, held, ids, keys, lengths = 0, 0, 0, [], [], []

        def block() -> pa.RecordBatch:
            every, names = np.concatenate(ids), pa.concat_arrays(keys)
            small = np.uint16 if not len(every) or every.max() < 1 << 16 else np.uint32
            bounds = EliasFano.encode(np.concatenate([[0], np.cumsum(np.concatenate(lengths))]))
            docs = EliasFano.encode(names.drop_null().to_numpy(zero_copy_only=False))
            row = {"part": part, "block": number, "start": start, "n_docs": len(names), "null_docs": names.null_count, "n_ids": len(every),
                   "width": small().itemsize, "ids": every.astype(small).tobytes(), "bounds": bounds.row(), "doc_ids": docs.row()}
            return pa.RecordBatch.from_pylist([row], schema=pa.schema(shape))

        code = pa.struct([("n", pa.int64()), ("base", pa.int64()), ("low_bits", pa.int32()), ("low", pa.binary()), ("high", pa.binary()), ("samples", pa.binary())])
        shape = [("part", pa.int32()), ("block", pa.int32()), ("start", pa.int64()), ("n_docs", pa.int64()), ("null_docs", pa.int64()), ("n_ids", pa.int64()),
                 ("width", pa.int32()), ("ids", pa.binary()), ("bounds", code), ("doc_ids", code)]
        for batch in batches:
            texts = plain(batch.column(1))
            for i, j in slices(texts, 1 << 20):
                got, cuts = with_end(*own.encode(texts[i:j]), end)
                ids.append(got)
                keys.append(batch.column(0)[i:j])
                lengths.append(np.diff(cuts))
                held += len(got)
                if held >= BLOCK:
                    yield block()
                    number, start, held, ids, keys, lengths = number + 1, start + held, 0, [], [], []
        if ids:
            yield block()

    schema = f"part int, block int, start long, n_docs long, null_docs long, n_ids long, width int, ids binary, bounds {CODE}, doc_ids {CODE}"
    ordered.mapInArrow(blocks, schema).write.parquet(f"{path}/blocks")
    # one row a part: where its ids begin in the whole array
    totals = spark.read.parquet(f"{path}/blocks").groupBy("part").agg(F.sum("n_ids").alias("n_ids"), F.sum("n_docs").alias("n_docs"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals.withColumn("base", F.coalesce(F.sum("n_ids").over(earlier), F.lit(0))).write.parquet(f"{path}/parts")
    return path


def read_ids(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """Rows (doc_id, start, n_tokens, ids_crc32, ids) of a file set; ``ids`` is null without ``with_ids``.

    ``start`` counts the ids of all documents before, ``ids`` are little-endian unsigned 32-bit values.
    """
    blocks, parts = spark.read.parquet(f"{path}/blocks"), spark.read.parquet(f"{path}/parts")
    # as many rows as the range exchange had partitions
    placed = blocks.join(F.broadcast(parts.select("part", "base")), "part")
    placed = placed.select((F.col("base") + F.col("start")).alias("start"), "null_docs", "width", "ids", "bounds", "doc_ids")

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                bounds, names = EliasFano(**row["bounds"]).all(), EliasFano(**row["doc_ids"]).all()
                ids = np.frombuffer(row["ids"], f"<u{row['width']}").astype("<u4")
                each = [ids[i:j].tobytes() for i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                key = pa.concat_arrays([pa.nulls(row["null_docs"], pa.int64()), pa.array(names)])
                yield pa.RecordBatch.from_arrays(
                    [key, pa.array(bounds[:-1] + row["start"]), pa.array(np.diff(bounds)), pa.array([zlib.crc32(x) for x in each], pa.int64()),
                     pa.array(each, pa.binary()) if with_ids else pa.nulls(len(each), pa.binary())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"])

    return placed.mapInArrow(documents, "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")


def lookup(block: dict, position: int) -> np.ndarray:
    """The ids of one document of a block, found by select on its two boundaries."""
    first, last = EliasFano(**block["bounds"]).select(np.array([position, position + 1]))
    return np.frombuffer(block["ids"], f"<u{block['width']}")[first:last]


def scratch(spark: SparkSession) -> str:
    """A new folder for a file set in the shared folder of the session."""
    return f"{work_dir(spark)}/ids-{uuid.uuid4().hex}"

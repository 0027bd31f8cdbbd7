"""Small helpers shared by the document operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes of text that a task works on at once; longer single texts are taken alone.
SLICE_BYTES = 4 << 20

#: The words of the contracts: everything between ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: str | Column = "text") -> Column:
    """Number of words of a text; null and empty texts have none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def held_out(fold: int, folds: int, key: str = "doc_id") -> Column:
    """Whether a row falls into the fold by the CRC of its id; a null id is never held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(folds)) == fold, F.lit(False))


def unit_hash(*keys: str, seed: int = 0) -> Column:
    """A number in [0, 1) that depends on the keys and the seed alone."""
    return F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1 << 52)) / F.lit(float(1 << 52))


def plain(array: pa.Array | pa.ChunkedArray) -> pa.Array:
    """One contiguous array of texts in which nulls are empty."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    return pc.fill_null(array.cast(pa.large_string()), "")


def slices(texts: pa.Array, size: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts together have at most ``size`` bytes, or one row."""
    if not len(texts):
        return
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    row, before = 0, 0
    while row < len(texts):
        stop = max(row + 1, int(np.searchsorted(ends, before + size, side="right")))
        yield row, stop
        row, before = stop, int(ends[stop - 1])


def binary_array(data: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """Binary values that lie back to back in ``data``; ``cuts`` are element offsets."""
    data = np.ascontiguousarray(data)
    offsets = (cuts * data.itemsize).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data)]).cast(pa.binary())

"""Kernels over the character buffers of Arrow string columns: numbers of whole batches of reads, without a Python string."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql import types as T


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """One byte for each character of all strings, one string after another, and the strings' borders (one more than
    strings). A null counts as empty; a character beyond Latin-1 is ``?``."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if column.null_count:
        column = pc.fill_null(column, "")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    if len(data) and data.max() > 127:
        texts = [t.encode("latin-1", "replace") for t in column.to_pylist()]
        return np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    return data, offsets - offsets[0]


def places(borders: np.ndarray) -> np.ndarray:
    """Each character's place in its string."""
    lens = np.diff(borders)
    return np.arange(int(borders[-1]), dtype=np.int32) - np.repeat(borders[:-1].astype(np.int32), lens)


def sums(column: pa.Array, table: np.ndarray) -> np.ndarray:
    """Of each string the sum of a table's numbers of its characters."""
    data, borders = flat(column)
    running = np.concatenate([np.zeros(1, np.int64), np.cumsum(table[data], dtype=np.int64)])
    return running[borders[1:]] - running[borders[:-1]]


SCORE = np.maximum(np.arange(256) - 33, 0).astype(np.int32)
_GC = np.isin(np.arange(256), [ord(c) for c in "GCgc"]).astype(np.int8)
_Q10, _Q20, _Q30 = ((SCORE >= q).astype(np.int8) for q in (10, 20, 30))


def _with_nulls(values: np.ndarray, like: pa.Array) -> pa.Array:
    return pa.array(values, pa.int64(), mask=pc.is_null(like).to_numpy(zero_copy_only=False) if like.null_count else None)


@F.arrow_udf(T.LongType())
def quality_sum(qual: pa.Array) -> pa.Array:
    """Sum of scores of each quality string; null without one."""
    return _with_nulls(sums(qual, SCORE), qual)


@F.arrow_udf(T.StructType([T.StructField(c, T.LongType()) for c in ("gc", "qsum", "q10", "q20", "q30")]))
def read_sums(seq: pa.Array, qual: pa.Array) -> pa.Array:
    """Of each read how many bases are G or C, its sum of scores, and how many scores are at least 10, 20 and 30 (0 without)."""
    return pa.StructArray.from_arrays([pa.array(sums(c, t), pa.int64()) for c, t in ((seq, _GC), (qual, SCORE), (qual, _Q10), (qual, _Q20), (qual, _Q30))], names=["gc", "qsum", "q10", "q20", "q30"])

"""Helpers shared by the corpus operators: byte and word views of Arrow text, rolling hashes, checkpoints."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK = 1 << 20  # bytes of text that a vectorised step holds at once (a longer text is held alone)
U64 = np.uint64
_R = 0x9E3779B97F4A7C15 | 1
_RINV = pow(_R, -1, 1 << 64)
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
BYTE_VALUES = np.random.default_rng(20240611).integers(1, 1 << 63, 256, dtype=np.uint64) | U64(1)
_powers: list = [np.ones(1, U64), np.ones(1, U64)]


def shared_folder(spark: SparkSession) -> str:
    """The folder for checkpoints and tables: the one that the session names. A temporary one only in local mode, as in tests."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        named = sc.getConf().get("spark.checkpoint.dir", None)
        if not named and sc.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or os.path.join(tempfile.gettempdir(), "recoflux-checkpoints"))
    return sc.getCheckpointDir()


def remove_folder(spark: SparkSession, path: str) -> None:
    """Deletes a folder of ours in whatever store it is."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def checkpointed(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a checkpoint in the shared folder; shuffles and checkpoints that no frame needs any more are then let go."""
    spark = df.sparkSession
    shared_folder(spark)
    out = df.checkpoint(eager=True)
    del df
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    return out


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run, after which the worker, which Spark keeps for later tasks, gives the memory that it has freed back to the system."""

    def leaner(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)

    return leaner


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_key(text):
    """Two columns that stand for a text: 128 bits of hash; null counts as empty."""
    t = F.coalesce(text, F.lit(""))
    return F.xxhash64(F.lit(1), t).alias("k1"), F.xxhash64(F.lit(2), t).alias("k2")


def pieces(column: pa.Array, size: int = CHUNK):
    """(first row, last row, bytes, offsets) of slices of a string or binary column of about `size` bytes; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    n = len(column)
    if not n:
        return
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, kind, n + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + size, "right")) - 1)
        yield a, b, raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for i, r in ((0, _R), (1, _RINV)):
            x = np.full(n, r, U64)
            x[0] = 1
            _powers[i] = np.multiply.accumulate(x)
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(29)
    x *= U64(0xA0761D6478BD642F)
    return x ^ (x >> U64(32))


def prefix_sums(values: np.ndarray) -> np.ndarray:
    out = np.zeros(len(values) + 1, U64)
    np.cumsum(values * powers(len(values) + 1)[0][: len(values)], out=out[1:])
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of values[start:end]; equal wherever the values are. For candidates only: some long strings of two values collide."""
    return mix((sums[end] - sums[start]) * powers(len(sums))[1][start])


def word_spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words (runs without \\x20 \\x09-\\x0D) and the word count before each text."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    word = ~SPACE[raw]
    first = np.zeros(len(raw) + 1, bool)
    first[offsets] = True
    first[0] = first[-1] = True
    start = word.copy()
    start[1:] &= ~word[:-1] | first[1:-1]
    end = word
    end = end.copy()
    end[:-1] &= ~word[1:] | first[1:-1]
    starts = np.flatnonzero(start)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, offsets)


def run_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of runs of bytes that don't overlap and stand in order: sums of a mixed value of each byte and its place in the run.

    Unlike a rolling hash (span_hash), it has no family of strings that collide; equality of words and lines rests on it.
    """
    if not len(starts):
        return np.zeros(0, U64)
    at = np.zeros(len(raw), np.int64)
    filled = starts[ends > starts]
    at[filled] = filled
    place = np.arange(len(raw)) - np.maximum.accumulate(at)
    sums = np.zeros(len(raw) + 1, U64)
    np.cumsum(mix(BYTE_VALUES[raw] + place.astype(U64) * U64(0x9E3779B97F4A7C15)), out=sums[1:])
    return mix(sums[ends] - sums[starts] + (ends - starts).astype(U64))


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of words."""
    return run_hashes(raw, starts, ends)


def window_hashes(h: np.ndarray, start: np.ndarray, width: int) -> np.ndarray:
    """Hashes of the `width` values from each start on, in their order."""
    out = np.full(len(start), width, U64)
    for j in range(width):
        out = mix(out * U64(_R) + h[start + j])
    return out


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start+1, ... of each range, concatenated."""
    total = int(lengths.sum())
    out = np.ones(total, np.int64)
    keep = lengths > 0
    starts, lengths = starts[keep], lengths[keep]
    if not total:
        return np.zeros(0, np.int64)
    at = np.cumsum(lengths) - lengths
    out[at] = starts - np.concatenate(([0], starts[:-1] + lengths[:-1] - 1))
    return np.cumsum(out)


def sliding_min(v: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive values."""
    n = len(v)
    a = np.full(-(-n // w) * w, np.iinfo(v.dtype).max, v.dtype)
    a[:n] = v
    a = a.reshape(-1, w)
    before = np.minimum.accumulate(a, axis=1).ravel()
    after = np.minimum.accumulate(a[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[: n - w + 1], before[w - 1 : n])

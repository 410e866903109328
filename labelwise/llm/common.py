"""Small helpers shared by the text operators."""

from __future__ import annotations

import gc
import hashlib
import pickle
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

from labelwise.session import scratch_path

#: Separators of a word: space and the ASCII controls 9 to 13.
SPACES = b" \t\n\x0b\x0c\r"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared checkpoint folder, read back: the lineage is cut and a lost executor costs nothing."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of plans that nothing refers to; else they stay until the driver happens to collect its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


class Shipped:
    """A value of bounded size for all workers, pickled with its classes, so that executors need not import this package."""

    def __init__(self, spark: SparkSession, value):
        self.data = spark.sparkContext.broadcast(cloudpickle.dumps(value))

    def open(self):
        return pickle.loads(self.data.value)


def sha256_hex(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column end to end, and the n + 1 row offsets; a null counts as empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)[offsets[0]:offsets[-1]]
    return data, offsets - offsets[0]


def _odd_powers(n: int, base: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, by doubling."""
    out = np.ones(max(n, 1), np.uint64)
    have = 1
    with np.errstate(over="ignore"):
        while have < n:
            step = min(have, n - have)
            out[have:have + step] = out[:step] * np.uint64(pow(base, have, 1 << 64))
            have += step
    return out[:n]


_POWERS: dict[int, np.ndarray] = {}


def powers(n: int, base: int) -> np.ndarray:
    """Cached powers; the cache is as long as the longest batch of this worker."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        have = _POWERS[base] = _odd_powers(max(n, 1 << 16), base)
    return have[:n]


BASE_A, BASE_B = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: every input bit reaches every output bit."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64, copy=True)
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


def slice_hash(symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = BASE_A) -> np.ndarray:
    """64-bit hash of every symbols[start:end] (symbols: uint64), independent of where the slice lies."""
    n = len(symbols)
    if len(starts) == 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        acc = np.zeros(n + 1, np.uint64)
        # the symbol at i weighs base**i; an odd base has an inverse modulo 2**64, by which a slice is moved to place 0
        np.cumsum(symbols * powers(n, base), out=acc[1:])
        h = (acc[ends] - acc[starts]) * powers(n + 1, pow(base, -1, 1 << 64))[starts]
        h += (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    return mix64(h)


_BYTE_CODES = mix64(np.arange(1, 257, dtype=np.uint64))


def byte_symbols(data: np.ndarray, table: np.ndarray | None = None) -> np.ndarray:
    """A 64-bit symbol for every byte, after mapping bytes by ``table``."""
    return (_BYTE_CODES if table is None else _BYTE_CODES[table])[data]


def word_mask(data: np.ndarray, kind: str = "space") -> np.ndarray:
    """True where a byte belongs to a word.  Both word definitions only split at ASCII, so bytes suffice."""
    table = np.ones(256, bool)
    if kind == "space":
        table[list(SPACES)] = False
    else:  # "alnum": ASCII letters and digits, and everything beyond ASCII
        table[:128] = False
        table[48:58] = table[65:91] = table[97:123] = True
    return table[data]


def lower_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


def word_bounds(data: np.ndarray, offsets: np.ndarray, kind: str = "space") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for every row the index of its first word (n + 1 entries)."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = word_mask(data, kind)
    begin = inside[1:-1] & ~inside[:-2]
    finish = inside[1:-1] & ~inside[2:]
    edges = offsets[1:-1]  # a word never runs over the end of a row
    edges = edges[(edges > 0) & (edges < len(data))]
    begin[edges] = inside[1:-1][edges]
    finish[edges - 1] = inside[1:-1][edges - 1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(finish) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool) -> np.ndarray:
    """One 64-bit hash per word; ``fold`` lower-cases A to Z first."""
    return slice_hash(byte_symbols(data, lower_table() if fold else None), starts, ends)


def as_long(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def pieces(batches: Iterable[pa.RecordBatch], column: str, limit: int = 8 << 20) -> Iterable[pa.RecordBatch]:
    """The batches, cut so that the texts of one piece take about ``limit`` bytes (one longer row stands alone)."""
    for batch in batches:
        i = batch.schema.get_field_index(column)
        sizes = _lengths(batch.column(i)).astype(np.int64)
        at, total = 0, np.concatenate([[0], np.cumsum(sizes)])
        while at < batch.num_rows:
            end = int(np.searchsorted(total, total[at] + limit, side="right")) - 1
            end = min(max(end, at + 1), batch.num_rows)
            yield batch.slice(at, end - at)
            at = end


def _lengths(column: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.binary_length(column.cast(pa.large_binary())), 0).to_numpy(zero_copy_only=False)


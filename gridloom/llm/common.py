"""Helpers shared by the training-data operators.

Texts are handled as UTF-8 bytes in numpy: words, their hashes and windows of words come from a few passes over a
whole chunk of rows instead of a Python call per word.  A chunk holds CHUNK_BYTES of text (or one longer text), so the
memory of a worker doesn't depend on the size of an Arrow batch.
"""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK_BYTES = 2_000_000
U64 = np.uint64
#: Odd multipliers of the hashes.
BYTE_P, WORD_P = 0x9E3779B97F4A7C55, 0xD6E8FEB86659FD93

#: ASCII white space of the word pattern [^\x20\x09-\x0D]+ .
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


# ---------------------------------------------------------------- Spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; a local folder only where it is unset (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = found.get() if found.isDefined() else None
    return found or "file://" + os.path.join(tempfile.gettempdir(), "gridloom-shared")


def cut(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: the lineage ends there, and lost executors cost no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, *frames: DataFrame) -> None:
    """Deletes what cut() wrote for frames that nothing reads any more."""
    for df in frames:
        for file in {f.rpartition("/")[0] for f in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(file)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@lru_cache(1)
def _libc():
    try:
        lib = ctypes.CDLL(None)
        return lib if hasattr(lib, "malloc_trim") else None
    except OSError:
        return None


def trim() -> None:
    """Gives freed memory back to the system: a worker lives through many tasks and stages, and would hold the most that any needed."""
    pa.default_memory_pool().release_unused()
    if _libc() is not None:
        _libc().malloc_trim(0)


# ---------------------------------------------------------------- hashing


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser: a bijection of 64-bit values."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


#: Longest span in bytes that is hashed in passes over all spans; longer ones are hashed one by one.
SHORT_SPAN = 64


def bytes_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes data[s:e] of each span; equal contents have equal hashes wherever they stand.

    Eight bytes at a time go through a mixing step, so there are no texts that collide by their form.
    """
    size = (ends - starts).astype(np.int64)
    out = size.astype(U64) * U64(0xA24BAED4963EE407)
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    active = np.flatnonzero((size > 0) & (size <= SHORT_SPAN))
    at = 0
    while len(active):
        left = size[active] - at
        part = eight[starts[active] + at] & (U64(0xFFFFFFFFFFFFFFFF) >> (U64(8) * (U64(8) - np.minimum(left, 8).astype(U64))))
        out[active] = mix(out[active] ^ (part * U64(BYTE_P) + U64(WORD_P)))
        active, at = active[left > 8], at + 8
    for k in np.flatnonzero(size > SHORT_SPAN).tolist():
        out[k] = xxhash.xxh3_64_intdigest(data[starts[k] : ends[k]].tobytes())
    return out


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a * U64(WORD_P) + b)


def windows_hash(names: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of each n consecutive names, made from hashes of 1, 2, 4, ... of them; len(names) - n + 1 values."""
    if len(names) < n:
        return np.zeros(0, U64)
    many, power, span, done, out = len(names) - n + 1, names.astype(U64), 1, 0, None
    while True:
        if n & span:
            here = power[done : done + many]
            out = mix(here + U64(n)) if out is None else _pair(out, here)
            done += span
        if done == n:
            return out
        power, span = _pair(power[:-span], power[span:]), 2 * span


def lists_hash(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each list of 64-bit hashes that stand in a given order; list k is values[counts[k]:counts[k + 1]]."""
    size = np.diff(counts)
    sums = np.zeros(len(values) + 1, U64)
    np.cumsum(mix(values.astype(U64) ^ mix(reps(size).astype(U64) + U64(1))), out=sums[1:])
    return mix((sums[counts[1:]] - sums[counts[:-1]]) + size.astype(U64) * U64(BYTE_P))


# ---------------------------------------------------------------- texts


def texts_of(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and each row's offsets in them; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
        col = col.chunk(0) if isinstance(col, pa.ChunkedArray) else col
    if col.null_count:
        col = col.fill_null("")
    col = col.cast(pa.large_binary())
    offs = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
    data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


def chunks(offs: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most so many bytes, or of one row."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = j


def words(data: np.ndarray, offs: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes outside `space` that stay inside a row, and the number of runs before each row."""
    inside = ~space[data]
    before = np.zeros(len(data), bool)
    before[1:] = inside[:-1]
    cuts = offs[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    after = np.zeros(len(data), bool)
    after[:-1] = inside[1:]
    before[cuts] = False
    after[cuts - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offs)


def text_chunks(batch: pa.RecordBatch, text: str = "text") -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets) of bounded pieces of a batch."""
    data, offs = texts_of(batch.column(text))
    for i, j in chunks(offs):
        yield i, j, data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
    del data, offs
    trim()


def blob(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """A binary column whose row k holds the bytes of values[starts[k]:ends[k]] (spans in order, without gaps)."""
    size = values.dtype.itemsize
    offs = np.concatenate([starts[:1], ends]).astype(np.int64) * size if len(starts) else np.zeros(1, np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offs), pa.py_buffer(np.ascontiguousarray(values).tobytes())]).cast(pa.binary())


def reps(counts: np.ndarray) -> np.ndarray:
    """0..c-1 for each count c, in one array."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)


# ---------------------------------------------------------------- components


def components(edges: DataFrame, name: str) -> DataFrame:
    """Connected components: (node, component = its smallest node) for the nodes of edges (a, b), a != b.

    Alternating star contraction.  A large star hooks every larger neighbour of a node to the node's smallest one, a
    small star does so for the smaller ones; both keep the components.  Each round is cut to the shared folder; nothing
    but one changed/unchanged count reaches the driver.  Rounds grow with the logarithm of the longest path.
    """
    spark = edges.sparkSession

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else e
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        hooked = both.join(least, "a")
        if large:
            return hooked.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        return hooked.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))).where("a > b").distinct()

    e = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct(), name)
    while True:
        done = e.groupBy("a").agg(F.count("*").alias("n")).where("n > 1").isEmpty() and e.select(F.col("b").alias("a")).join(e.select("a"), "a", "left_semi").isEmpty()
        if done:
            roots = e.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
            return e.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
        nxt = cut(star(star(e, True), False), name)
        discard(spark, e)
        e = nxt

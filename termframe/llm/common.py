"""Helpers shared by the operators: the shared folder, bounded Arrow chunks, vectorised word hashes."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: The characters that the contracts call white space: space and 0x09-0x0D.
SPACES = b" \t\n\x0b\x0c\r"

#: Text bytes that one numpy step works on, so that memory doesn't follow the Arrow batch.
CHUNK_BYTES = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``. Where that is unset, a local one is set if driver and tasks are one
    process; on a cluster, whose executors would each write to their own disk, that is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: lineage ends there, and a lost
    executor costs only what it was working on."""
    spark, path = df.sparkSession, shared_dir(df.sparkSession)
    was = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")  # what was shuffled for a table goes once it is written
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, was)
    return spark.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def pieces(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut into slices of about ``most`` bytes of ``column``; a longer text stands alone."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        at, filled = 0, 0
        for i, n in enumerate(sizes.tolist()):
            if filled and filled + n > most:
                yield batch.slice(at, i - at)
                at, filled = i, 0
            filled += n
        if at < len(sizes):
            yield batch.slice(at)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows joined, and the n + 1 offsets of the rows; null counts as empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    whole = column.buffers()[2]
    data = np.frombuffer(whole, np.uint8)[offsets[0] : offsets[-1]] if whole is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


_WORDY = np.ones(256, bool)
_WORDY[list(SPACES)] = False


def word_spans(data: np.ndarray, offsets: np.ndarray, wordy: np.ndarray = _WORDY) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of ``wordy`` bytes; a run never crosses a row's border."""
    inside = wordy[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    before = np.concatenate(([False], inside[:-1])) if len(data) else inside
    starts = np.flatnonzero(inside & (~before | first[:-1]))
    after = np.concatenate((inside[1:], [False])) if len(data) else inside
    ends = np.flatnonzero(inside & (~after | first[1:])) + 1
    return starts, ends


def mix(x: np.ndarray) -> np.ndarray:
    """A fixed permutation of the 64-bit integers (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_RANDOM = np.random.default_rng(20240229)
_BYTE = _RANDOM.integers(0, 2**64, 256, dtype=np.uint64)
_BYTE[65:91] = _BYTE[97:123]  # A-Z count as a-z
_BASE = 0x9E3779B97F4A7C13 | 1
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of the hash's base and of its inverse modulo 2**64, for 0 to n - 1."""
    if len(_powers[0]) < n:
        n = max(1 << 16, 1 << (n - 1).bit_length())
        for i, base in enumerate((_BASE, pow(_BASE, -1, 2**64))):
            x = np.full(n, base, np.uint64)
            x[0] = 1
            _powers[i] = np.multiply.accumulate(x)
    return _powers[0], _powers[1]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans, A-Z taken as a-z; equal bytes have equal hashes anywhere."""
    up, down = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


_STEP = _RANDOM.integers(0, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of every n consecutive word hashes (len(words) - n + 1 of them, at least 0)."""
    m = max(0, len(words) - n + 1)
    total = np.zeros(m, np.uint64)
    for j in range(n):
        total += words[j : j + m] * _STEP[j]
    return mix(total)


def as_long(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x, np.uint64).view(np.int64)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table. From here on the session's Arrow batches have at most 8 MB: rows here can be long, and a
    batch is held by the executor and by its Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

"""Helpers shared by the training-data operators: scratch tables, Arrow text chunks, word and shingle hashes."""

from __future__ import annotations

import atexit
import contextlib
import re
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

#: Bytes of text that one vectorised step works on (a single longer document is one step).
CHUNK_BYTES = 1 << 19


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches(spark: SparkSession) -> None:
    """Bound the bytes of an Arrow batch (8 MB, unless the session has its own bound), since single rows can be long."""
    if spark.conf.get(BATCH_BYTES, None) is None:
        spark.conf.set(BATCH_BYTES, str(8 << 20))


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scratch:
    """Written tables in the folder named by spark.checkpoint.dir (the warehouse's, where it is unset).

    ``save`` materialises a frame and cuts its lineage: a lost executor only costs the tasks that were running. The
    shuffle files of a step go when its table is written. The folder goes when the driver ends, on any file system.
    """

    def __init__(self, spark: SparkSession, name: str):
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            base = f"{spark.conf.get('spark.sql.warehouse.dir')}/_scratch"
            if not spark.sparkContext.master.startswith("local") and re.match(r"(file:)?/", base):
                raise ValueError("on a cluster spark.checkpoint.dir, or the warehouse, has to be a folder that all executors share")
        self.spark, self.root = spark, f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
        _ROOTS.setdefault(spark.sparkContext.applicationId, []).append(self.root)
        _clean_at_end(spark)

    def save(self, df: DataFrame, name: str, *partition_by: str, codec: str = "zstd") -> DataFrame:
        path = f"{self.root}/{name}"
        writer = df.write.mode("overwrite").option("compression", codec)
        before = self.spark.conf.get(CLEANUP, None)
        self.spark.conf.set(CLEANUP, "true")
        try:
            (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
        finally:
            self.spark.conf.unset(CLEANUP) if before is None else self.spark.conf.set(CLEANUP, before)
        fields = sorted(df.schema.fields, key=lambda f: f.name in partition_by)
        return self.spark.read.schema(StructType(fields)).parquet(path)

    def drop(self, name: str) -> None:
        _delete(self.spark, f"{self.root}/{name}")


_ROOTS: dict[str, list[str]] = {}


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def _clean_at_end(spark: SparkSession) -> None:
    """Once per application: delete its scratch folders before the context stops, or as the driver's Python ends."""
    app = spark.sparkContext.applicationId
    if len(_ROOTS[app]) > 1:
        return

    def clean() -> None:
        with contextlib.suppress(Exception):  # the JVM may be gone
            for root in _ROOTS.pop(app, []):
                _delete(spark, root)

    atexit.register(clean)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets from 0) of runs of rows; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + n + 1]
    buf = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        j = min(j, n)
        yield i, j, buf[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_M1, _M2, _STEP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _STEP)
_WORD_BYTE = np.where(_SPACE, np.uint64(0), _BYTE[_LOWER])
_BASE = np.uint64(0xD6E8FEB86659FD93)


@lru_cache(maxsize=1)
def _powers(n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, _BASE, np.uint64)]), dtype=np.uint64)


def word_hashes(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words [^\\x20\\x09-\\x0D]+ (A-Z lower-cased) and the row of each."""
    n = len(buf)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    word = ~_SPACE[buf]
    first = word.copy()
    first[1:] &= ~word[:-1]
    edge = off[:-1][off[:-1] < n]
    first[edge] = word[edge]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    head = int(starts[0])
    order = np.cumsum(first[head:]) - 1
    place = np.arange(head, n) - starts[order]
    most = int(place.max()) + 1
    power = _powers(1 << max(10, (most - 1).bit_length()))
    total = np.add.reduceat(_WORD_BYTE[buf[head:]] * power[place], starts - head)
    length = np.add.reduceat(word[head:].astype(np.uint64), starts - head)
    return mix(total + length * _STEP), np.searchsorted(off, starts, "right") - 1


def fold(hashes: np.ndarray, width: int) -> np.ndarray:
    """The hash of each run of so many words."""
    n = len(hashes) - width + 1
    h = np.full(max(n, 0), np.uint64(width))
    for k in range(width):
        h = h * _BASE + hashes[k : k + n]
    return mix(h)


def shingle_sets(buf: np.ndarray, off: np.ndarray, width: int = 5) -> Iterator[np.ndarray]:
    """For each row the sorted distinct hashes of its word shingles; fewer words than the width are one shingle."""
    hashes, row = word_hashes(buf, off)
    runs = fold(hashes, width) if len(hashes) >= width else np.zeros(0, np.uint64)
    ends = np.searchsorted(row, np.arange(len(off)))
    for k in range(len(off) - 1):
        a, b = int(ends[k]), int(ends[k + 1])
        if b - a >= width:
            s = np.sort(runs[a : b - width + 1])
            yield s[np.concatenate(([True], s[1:] != s[:-1]))] if len(s) > 1 else s
        elif b > a:
            yield fold(hashes[a:b], b - a)
        else:
            yield np.zeros(0, np.uint64)


_ARROW = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}


def arrow_schema(ddl: str) -> pa.Schema:
    """The Arrow form of a schema that is written as ``name type, ...``."""
    return pa.schema([(name, _ARROW[kind]) for name, kind in (x.split() for x in ddl.split(","))])


def arrow_batch(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)

"""Token-ID output: each shard is a wavelet matrix, with access, rank, select and count on one compressed file.

File format: a folder of zstd Parquet files with one row per shard (``SHARD``). Ids of up to 16 bits are kept as bit
planes from the highest bit down; plane k holds that bit of the ids as stably partitioned by all higher bits, zeros
first. ``ranks`` has the number of ones before each block of 512 bits, so rank and select look at one block.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, arrow_batch, arrow_schema, bound_batches, partitions, table
from .encode import encoder

END = 1
BLOCK = 512
SHARD_TOKENS = 1 << 19
SHARD = "part int, shard int, n long, bits int, planes binary, zeros binary, ranks binary, doc_ids array<long>, lengths binary"


class WaveletMatrix:
    """ids as bit planes. Positions and counts are plain ints; ``decode`` gives all ids at once."""

    def __init__(self, n: int, bits: int, planes: np.ndarray, zeros: np.ndarray, ranks: np.ndarray):
        self.n, self.bits, self.planes, self.zeros, self.ranks = n, bits, planes, zeros, ranks

    @classmethod
    def build(cls, ids: np.ndarray) -> WaveletMatrix:
        bits = max(1, int(ids.max()).bit_length() if len(ids) else 1)
        planes = np.zeros((bits, -(-len(ids) // BLOCK) * (BLOCK // 8)), np.uint8)
        zeros, x = np.zeros(bits, np.int64), ids
        for k in range(bits):
            one = (x & x.dtype.type(1 << bits - 1 - k)) != 0
            packed = np.packbits(one, bitorder="little")
            planes[k, : len(packed)] = packed
            low = np.compress(~one, x)
            zeros[k] = len(low)
            x = np.concatenate([low, np.compress(one, x)])
        ones = np.bitwise_count(planes).reshape(bits, -1, BLOCK // 8).sum(axis=2, dtype=np.uint32)
        ranks = np.zeros((bits, ones.shape[1] + 1), np.uint32)
        np.cumsum(ones, axis=1, out=ranks[:, 1:])
        return cls(len(ids), bits, planes, zeros, ranks)

    def row(self) -> dict:
        return {"n": self.n, "bits": self.bits, "planes": self.planes.tobytes(), "zeros": self.zeros.tobytes(), "ranks": self.ranks.tobytes()}

    @classmethod
    def of(cls, row: dict) -> WaveletMatrix:
        bits = row["bits"]
        read = lambda k, t: np.frombuffer(row[k], t).reshape(bits, -1)
        return cls(row["n"], bits, read("planes", np.uint8), np.frombuffer(row["zeros"], np.int64), read("ranks", np.uint32))

    def _ones(self, k: int, i: int) -> int:
        """Ones before position i of plane k."""
        b = i // BLOCK
        tail = np.unpackbits(self.planes[k, b * (BLOCK // 8) : (i + 7) // 8], bitorder="little")[: i - b * BLOCK]
        return int(self.ranks[k, b]) + int(tail.sum())

    def access(self, i: int) -> int:
        value = 0
        for k in range(self.bits):
            one = int(self.planes[k, i >> 3]) >> (i & 7) & 1
            r = self._ones(k, i)
            value, i = value << 1 | one, int(self.zeros[k]) + r if one else i - r
        return value

    def _range(self, token: int, i: int) -> tuple[int, int]:
        lo, hi = 0, i
        for k in range(self.bits):
            a, b = self._ones(k, lo), self._ones(k, hi)
            lo, hi = (int(self.zeros[k]) + a, int(self.zeros[k]) + b) if token >> (self.bits - 1 - k) & 1 else (lo - a, hi - b)
        return lo, hi

    def rank(self, token: int, i: int) -> int:
        """Occurrences of the token before position i."""
        if token < 0 or token >> self.bits:
            return 0
        lo, hi = self._range(token, i)
        return hi - lo

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def select(self, token: int, nth: int) -> int:
        """The position of the nth occurrence (from 0)."""
        if not 0 <= nth < self.count(token):
            raise IndexError(nth)
        i = self._range(token, 0)[0] + nth
        for k in reversed(range(self.bits)):
            one = token >> (self.bits - 1 - k) & 1
            want = i - int(self.zeros[k]) if one else i
            at = self.ranks[k].astype(np.int64) if one else np.arange(self.ranks.shape[1]) * BLOCK - self.ranks[k].astype(np.int64)
            b = int(np.searchsorted(at, want, "right")) - 1
            bit = np.unpackbits(self.planes[k, b * (BLOCK // 8) : (b + 1) * (BLOCK // 8)], bitorder="little")
            i = b * BLOCK + int(np.flatnonzero(bit == one)[want - int(at[b])])
        return i

    def _ones_at(self, k: int, at: np.ndarray) -> np.ndarray:
        """Ones before each of many positions of plane k."""
        byte = at >> 3
        before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.planes[k]), dtype=np.int64)])
        held = np.append(self.planes[k], np.uint8(0))[byte] & ((1 << (at & 7)) - 1).astype(np.uint8)
        return before[byte] + np.bitwise_count(held)

    def access_many(self, at: np.ndarray) -> np.ndarray:
        """The ids at many positions."""
        at, value = at.astype(np.int64), np.zeros(len(at), np.int64)
        for k in range(self.bits):
            one, ones = (self.planes[k][at >> 3] >> (at & 7) & 1).astype(bool), self._ones_at(k, at)
            value = value << 1 | one
            at = np.where(one, self.zeros[k] + ones, at - ones)
        return value

    def rank_many(self, token: int, at: np.ndarray) -> np.ndarray:
        """Occurrences of the token before each of many positions."""
        if token < 0 or token >> self.bits:
            return np.zeros(len(at), np.int64)
        first, at = 0, at.astype(np.int64)
        for k in range(self.bits):
            one = token >> (self.bits - 1 - k) & 1
            ones, start = self._ones_at(k, at), self._ones(k, first)
            at, first = (int(self.zeros[k]) + ones, int(self.zeros[k]) + start) if one else (at - ones, first - start)
        return at - first

    def decode(self) -> np.ndarray:
        x = np.zeros(self.n, np.uint16 if self.bits <= 16 else np.uint32)
        for k in reversed(range(self.bits)):
            one = np.unpackbits(self.planes[k], bitorder="little")[: self.n].astype(bool)
            up, z = np.empty_like(x), int(self.zeros[k])
            up[np.flatnonzero(~one)] = x[:z]
            up[np.flatnonzero(one)] = x[z:] | x.dtype.type(1 << (self.bits - 1 - k))
            x = up
        return x


def write_shards(docs: DataFrame, scratch: Scratch, vocabulary: str, key: str = "doc_id", text: str = "text", end: int = END, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Encode whole texts in ascending order of the key (null first) and write the shards; returns the written table.

    A range of keys is one task; a shard closes at the first document end beyond ``shard_tokens``, so memory holds one
    shard, and a longer text is a shard of its own. Null text is empty and has only the end id; rows of one key are
    ordered by text, repeated rows are written each; other columns, whatever their names, play no part; an empty table
    gives no shards.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    n = max(partitions(spark), 1)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, shard = encoder(vocabulary, False), TaskContext.get().partitionId(), 0
        last = np.array([end], enc.kind)
        ids, doc_ids, lengths, total = [], [], [], 0

        def close() -> pa.RecordBatch:
            row = WaveletMatrix.build(np.concatenate(ids)).row()
            row |= {"part": part, "shard": shard, "doc_ids": doc_ids, "lengths": np.array(lengths, np.uint32).tobytes()}
            return pa.RecordBatch.from_pylist([row], schema=arrow_schema(SHARD))

        for batch in batches:
            for doc, x in zip(batch.column(0).to_pylist(), enc.rows(batch.column(1)), strict=True):
                ids += [x, last]
                doc_ids.append(doc)
                lengths.append(len(x) + 1)
                total += len(x) + 1
                if total >= shard_tokens:
                    yield close()
                    ids, doc_ids, lengths, total, shard = [], [], [], 0, shard + 1
        if doc_ids:
            yield close()

    ordered = docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t")).repartitionByRange(n, "k").sortWithinPartitions("k", "t")
    return scratch.save(ordered.mapInArrow(write, SHARD), "shards")


def read_shards(shards: DataFrame, end: int = END) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, last_id, end_ids of every document, from the shards alone: its ids are
    decoded, the last one is read by access, and the end ids in it are counted by rank."""
    spark = shards.sparkSession
    bound_batches(spark)
    out = "part int, shard int, doc_id long, local long, n_tokens long, ids_crc32 long, last_id long, end_ids long"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = arrow_schema(out)
        for batch in batches:
            for row in batch.to_pylist():
                held = WaveletMatrix.of(row)
                ids = held.decode().astype("<u4")
                lengths = np.frombuffer(row["lengths"], np.uint32).astype(np.int64)
                ends = np.cumsum(lengths)
                crc = [zlib.crc32(ids[b - n : b]) for b, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
                m, seen = len(crc), held.rank_many(end, np.concatenate([[0], ends]))
                yield arrow_batch(schema, [[row["part"]] * m, [row["shard"]] * m, row["doc_ids"], ends - lengths, lengths, crc, held.access_many(ends - 1), np.diff(seen)])

    sums = shards.groupBy("part").agg(F.sum("n").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = sums.select("part", before.alias("base"))
    inside = F.coalesce(F.sum("n").over(Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = shards.select("part", "shard", inside.alias("inside")).join(base, "part").select("part", "shard", (F.col("base") + F.col("inside")).alias("at"))
    rows = shards.mapInArrow(read, out).join(starts, ["part", "shard"])
    return rows.select("doc_id", (F.col("at") + F.col("local")).alias("start"), "n_tokens", "ids_crc32", "last_id", "end_ids")


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return read_shards(write_shards(docs, Scratch(spark, "op8"), public_tokenizers.path("word_bpe_49k.json")))

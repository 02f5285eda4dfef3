"""Cost-balanced packing of documents into sequences of a fixed length."""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_batch, arrow_schema, bound_batches, table
from .encode import encoder

LENGTH = 2048
END = 1
#: Documents of a packing group: its padding is under one sequence.
GROUP_DOCS = 2000
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def cost(n: np.ndarray | int, length: int = LENGTH) -> np.ndarray | float:
    """Estimated work of a piece: a linear part and the quadratic part of attention, equal at the full length."""
    return n + n * n / length


def plan(sizes: list[int], length: int = LENGTH) -> list[list[tuple[int, int, int, int]]]:
    """For each document (under ``length`` tokens each) its pieces (start, length, sequence, offset).

    As few sequences as hold all tokens are opened. Documents in descending order go to the sequence of lowest cost
    that has room; those that fit nowhere are cut into the rooms that are left, in order of cost. So all but the last
    ``length`` tokens' worth of room is used.
    """
    out: list[list[tuple[int, int, int, int]]] = [[] for _ in sizes]
    m = -(-sum(sizes) // length)
    used, spent = np.zeros(m, np.int64), np.zeros(m)
    heap = [(0.0, s) for s in range(m)]
    late = []

    def put(i: int, start: int, n: int, s: int) -> None:
        out[i].append((start, n, s, int(used[s])))
        used[s] += n
        spent[s] += cost(n, length)

    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        n, kept, found = sizes[i], [], False
        while heap:  # the sequences that are cheap but full are few until the end
            c, s = heapq.heappop(heap)
            if c != spent[s]:
                continue
            if used[s] + n <= length:
                put(i, 0, n, s)
                kept.append((float(spent[s]), s))
                found = True
                break
            kept.append((c, s))
            if len(kept) > 64:
                break
        for x in kept:
            heapq.heappush(heap, x)
        if not found:
            room = np.flatnonzero(used + n <= length)
            if len(room):
                s = int(room[np.argmin(spent[room])])
                put(i, 0, n, s)
                heapq.heappush(heap, (float(spent[s]), s))
            else:
                late.append(i)
    rooms = sorted((s for s in range(m) if used[s] < length), key=lambda s: (spent[s], s))
    for i in late:
        at = 0
        while at < sizes[i]:
            s = rooms[0]
            n = min(sizes[i] - at, length - int(used[s]))
            put(i, at, n, s)
            at += n
            if used[s] == length:
                rooms.pop(0)
    return out


REST = "g long, doc_id long, doc_tokens long, width int, full binary, ids binary"


def pack(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text", length: int = LENGTH, end: int = END, group_docs: int = GROUP_DOCS) -> DataFrame:
    """One row per piece (``PIECES``).

    A document is encoded once, whole, however long; its full stretches of ``length`` ids are sequences of their own and
    travel as figures, only the rest below ``length`` travels as ids. Rows are dealt to groups by a hash of key and ids
    and by their place in the task, about ``group_docs`` each, so that equal rows spread; a group is packed by itself.
    Null or empty text is the end id alone; null keys stay null; repeated rows are packed as often as they occur; other
    columns play no part; an empty table gives no pieces.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    groups = max(1, -(-docs.count() // group_docs))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, place = encoder(vocabulary, True), 0
        width = np.dtype(enc.kind).itemsize
        for batch in batches:
            rows = []
            for doc, ids in zip(batch.column(0).to_pylist(), enc.rows(batch.column(1)), strict=True):
                ids = np.append(ids, enc.kind(end))
                n, place = len(ids) // length, place + 1
                full = np.array([zlib.crc32(ids[k * length : (k + 1) * length].astype("<u4")) for k in range(n)], np.uint32)
                g = (zlib.crc32(ids.tobytes(), zlib.crc32(str(doc).encode())) + place) % groups
                rows.append((g, doc, len(ids), width, full.tobytes(), ids[n * length :].tobytes()))
            if rows:
                yield arrow_batch(arrow_schema(REST), list(zip(*rows, strict=True)))

    def group(t: pa.Table) -> pa.Table:
        rows = sorted(t.to_pylist(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["doc_tokens"], r["ids"]))
        base, out = rows[0]["g"] << 32, []
        ids = [np.frombuffer(r["ids"], f"<u{r['width']}") for r in rows]
        plans = plan([len(x) for x in ids], length)
        seq = max((p[2] + 1 for ps in plans for p in ps), default=0)
        for r, x, ps in zip(rows, ids, plans, strict=True):
            full = np.frombuffer(r["full"], np.uint32).tolist()
            for k, crc in enumerate(full):
                out.append((r["doc_id"], k * length, length, crc, r["doc_tokens"], base | seq, 0))
                seq += 1
            for start, n, s, offset in ps:
                out.append((r["doc_id"], len(full) * length + start, n, zlib.crc32(x[start : start + n].astype("<u4")), r["doc_tokens"], base | s, offset))
        return pa.Table.from_batches([arrow_batch(arrow_schema(PIECES), list(zip(*out, strict=True)))])

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(encode, REST)
    return rows.groupBy("g").applyInArrow(group, PIECES)


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))

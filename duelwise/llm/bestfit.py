"""Packing into few sequences by linear grouping: configurations of a few rounded lengths, then best fit for small pieces."""

from __future__ import annotations

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
END = 0
#: Lengths above this share of a sequence are large: they are grouped and get configurations.
LARGE = 1 / 8
#: Groups of equal cardinality that large lengths are rounded up in, and documents that one plan is made for.
SIZES, GROUP_DOCS = 64, 32_768
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def grouped(lengths: np.ndarray, groups: int = SIZES) -> tuple[np.ndarray, np.ndarray]:
    """(sizes, which): lengths in falling order are cut into ``groups`` runs of equal cardinality; each is rounded up to
    the greatest of its run. Runs with the same greatest length are one. ``which`` names the size of each length."""
    order = np.argsort(-lengths, kind="stable")
    run = np.arange(len(lengths)) * min(groups, len(lengths)) // max(1, len(lengths))
    first = np.flatnonzero(np.diff(run, prepend=-1))
    sizes, place = np.unique(-lengths[order][first], return_inverse=True)
    which = np.empty(len(lengths), np.int64)
    which[order] = place[run]
    return -sizes, which


def best_pattern(sizes: np.ndarray, worth: np.ndarray, length: int) -> np.ndarray:
    """How many pieces of each size make the most valuable sequence (an unbounded knapsack over whole lengths)."""
    value = np.zeros((len(sizes) + 1, length + 1))
    for g, (s, w) in enumerate(zip(sizes.tolist(), worth.tolist(), strict=True)):
        row = value[g + 1]
        row[:] = value[g]
        if w > 0:
            for _ in range(length // s):
                np.maximum(row[s:], row[:-s] + w, out=row[s:])
    pattern, room = np.zeros(len(sizes)), length
    for g in reversed(range(len(sizes))):
        while room >= sizes[g] and value[g + 1, room] > value[g, room] + 1e-12:
            pattern[g] += 1
            room -= int(sizes[g])
    return pattern


def configurations(sizes: np.ndarray, demand: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(patterns, how often): a basic solution of the fractional packing of the rounded sizes, by column generation.

    A pattern that is worth more than one sequence at the current prices enters the basis, until none is (or until a
    generous number of steps; every step's solution is feasible). At most as many patterns as sizes come back.
    """
    m = len(sizes)
    patterns = np.diag(np.maximum(1, length // sizes)).astype(float)
    inverse, often = np.diag(1 / np.diag(patterns)), demand / np.diag(patterns)
    for _ in range(40 * m):
        new = best_pattern(sizes, inverse.sum(axis=0), length)
        if inverse.sum(axis=0) @ new <= 1 + 1e-6:
            break
        step = inverse @ new
        ratio = np.where(step > 1e-9, often / np.where(step > 1e-9, step, 1), np.inf)
        out = int(ratio.argmin())
        often = often - ratio[out] * step
        often[out] = ratio[out]
        patterns[:, out] = new
        pivot = inverse[out] / step[out]
        inverse = inverse - np.outer(step, pivot)
        inverse[out] = pivot
    return patterns.astype(np.int64), np.maximum(often, 0)


def plan(lengths: list[int], length: int = LENGTH, groups: int = SIZES) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of pieces of 1 to ``length`` tokens, whole each, in few sequences.

    Large lengths are rounded up by ``grouped``; whole uses of the best configurations become sequences. Documents take
    a configuration's places in falling order, each the longest waiting one that its rounded size holds; the last place
    takes the longest that the room left by actual lengths holds, so that rounding costs little. A use
    that would fill less than its configuration is given up. What is left then and the small pieces go, in falling order,
    where they fit best.
    """
    n = np.array(lengths, np.int64)
    sequence, offset = np.full(len(n), -1, np.int64), np.zeros(len(n), np.int64)
    used: list[int] = []

    def put(i: int, s: int) -> None:
        sequence[i], offset[i] = s, used[s]
        used[s] += int(n[i])

    large = np.flatnonzero(n > length * LARGE)
    if len(large):
        sizes, which = grouped(n[large], groups)
        patterns, often = configurations(sizes, np.bincount(which, minlength=len(sizes)).astype(float), length)
        # Large documents by length; bit k of ``there`` says that one of k tokens waits.
        waiting: list[list[int]] = [[] for _ in range(length + 1)]
        for i in large[::-1].tolist():
            waiting[n[i]].append(i)
        there = sum(1 << k for k, w in enumerate(waiting) if w)
        uses = zip(patterns.T, np.floor(often + 1e-9).astype(int).tolist(), strict=True)
        for parts, times in sorted(((np.repeat(sizes, p).tolist(), k) for p, k in uses), reverse=True):
            for _ in range(times):
                taken, room = [], length
                for k, size in enumerate(parts):
                    fitting = there & ((2 << (room if k == len(parts) - 1 else min(size, room))) - 1)
                    if not fitting:
                        break
                    of = fitting.bit_length() - 1
                    taken.append(waiting[of].pop())
                    room -= of
                    if not waiting[of]:
                        there ^= 1 << of
                if room > length - sum(parts):
                    for i in taken:
                        waiting[n[i]].append(i)
                        there |= 1 << int(n[i])
                    break
                used.append(0)
                for i in taken:
                    put(i, len(used) - 1)
    # Sequences by their room; bit r of ``rooms`` says that some sequence has room for r tokens.
    by_room: list[list[int]] = [[] for _ in range(length + 1)]
    rooms = 0
    for s, u in enumerate(used):
        by_room[length - u].append(s)
        rooms |= 1 << (length - u)
    rest = np.flatnonzero(sequence < 0)
    for i in rest[np.lexsort((rest, -n[rest]))].tolist():
        fitting = rooms >> int(n[i])
        if fitting:
            room = int(n[i]) + (fitting & -fitting).bit_length() - 1
            s = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
        else:
            s = len(used)
            used.append(0)
        put(i, s)
        by_room[length - used[s]].append(s)
        rooms |= 1 << (length - used[s])
    return sequence, offset


ENCODED = "g long, doc_id long, n long, crcs binary"


def pack(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text", length: int = LENGTH, end: int = END, group_docs: int = GROUP_DOCS, sizes: int = SIZES) -> DataFrame:
    """One row per piece (``PIECES``): documents whole, cut only if longer than ``length``, in few sequences.

    A document is encoded once, whole, however long, and travels as its number of tokens and its pieces' checksums. Its
    pieces have ``length`` tokens each but for the first, which has the rest; full pieces are sequences of their own.
    Rows are dealt to plans of about ``group_docs`` by a hash of key and ids and by their place in the task, so that equal
    rows spread; the rounding of a plan costs a few sequences. Null or empty text is the end id alone; null keys stay
    null; repeated rows are packed as often as they occur; other columns, whatever their names, play no part; an empty
    table gives no pieces.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    groups = max(1, -(-docs.count() // group_docs))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, place = encoder(vocabulary, True), 0
        for batch in batches:
            rows = []
            for doc, ids in zip(batch.column(0).to_pylist(), enc.rows(batch.column(1)), strict=True):
                ids = np.append(ids, enc.kind(end)).astype("<u4")
                place += 1
                cuts = [0, *range(len(ids) % length or length, len(ids) + 1, length)]
                crcs = [zlib.crc32(ids[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
                g = (zlib.crc32(str(doc).encode(), crcs[0]) + place) % groups
                rows.append((g, doc, len(ids), np.array(crcs, np.uint32).tobytes()))
            if rows:
                yield arrow_batch(arrow_schema(ENCODED), list(zip(*rows, strict=True)))

    def group(t: pa.Table) -> pa.Table:
        rows = sorted(t.to_pylist(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["n"], r["crcs"]))
        sequence, offset = plan([r["n"] % length or length for r in rows], length, sizes)
        base, fresh = rows[0]["g"] << 32, int(sequence.max()) + 1
        out = []
        for r, s, at in zip(rows, sequence.tolist(), offset.tolist(), strict=True):
            start, n = 0, r["n"] % length or length
            for k, crc in enumerate(np.frombuffer(r["crcs"], np.uint32).tolist()):
                out.append((r["doc_id"], k, start, n, crc, base | (s if k == 0 else fresh), at if k == 0 else 0))
                start, n, fresh = start + n, length, fresh + (k > 0)
        return pa.Table.from_batches([arrow_batch(arrow_schema(PIECES), list(zip(*out, strict=True)))])

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(encode, ENCODED)
    return rows.groupBy("g").applyInArrow(group, PIECES)


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))

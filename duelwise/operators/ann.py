"""Approximate inner-product search: coarse cells, product-quantised codes, exact reordering of all that the codes' bounds leave open."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .clustering import closest, spread_start
from .retrieval import BROADCAST_BYTES, FOUND, dot, query_blocks, ranked
from .sampling import draw
from .vectors import matrix, sound_vectors

#: Rows that cells and code words are learned from, code words of a part, components of a part, rows of a matrix product,
#: pairs of a task that wait until its bounds are raised.
SAMPLE, WORDS, PART, ROWS, WAITING = 20_000, 256, 4, 1024, 1 << 20
#: Scores this near count as equal.
EQUAL = 1e-9
CODES = "cell int, id long, code binary, fine binary, step double, slip double, name long"


def learned(x: np.ndarray, k: int, seed: int, rounds: int = 10) -> np.ndarray:
    """k centres of a bounded sample."""
    centres = spread_start(x, k, seed)
    for _ in range(rounds):
        at, _ = closest(x, centres)
        n, sums = np.bincount(at, minlength=len(centres)), np.zeros(centres.shape)
        np.add.at(sums, at, x)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


def unit(x: np.ndarray) -> np.ndarray:
    size = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x / np.where(size > 0, size, 1)


@dataclass(frozen=True)
class Codebook:
    """Cell centres, for each part of the components the words that stand for what is left of a vector there, and how
    many cells a search has to look through."""

    cells: np.ndarray
    words: list[np.ndarray]
    probes: int

    @property
    def cuts(self) -> np.ndarray:
        return np.cumsum([0, *(w.shape[1] for w in self.words)])

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cell, codes): one byte per part."""
        cell, _ = closest(x, self.cells)
        rest, cuts = x - self.cells[cell], self.cuts
        return cell, np.stack([closest(rest[:, a:b], w)[0].astype(np.uint8) for w, a, b in zip(self.words, cuts, cuts[1:], strict=False)], axis=1)

    def tables(self, q: np.ndarray) -> np.ndarray:
        """Products of queries with all words: queries x parts x words."""
        out, cuts = np.zeros((len(q), len(self.words), max(len(w) for w in self.words))), self.cuts
        for p, (w, a, b) in enumerate(zip(self.words, cuts, cuts[1:], strict=False)):
            out[:, p, : len(w)] = q[:, a:b] @ w.T
        return out

    def decode(self, cell: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """What cells and code words stand for."""
        return self.cells[cell] + np.concatenate([w[codes[:, p]] for p, w in enumerate(self.words)], axis=1)


def enough_probes(x: np.ndarray, cells: np.ndarray, asked: int = 200, top: int = 10, share: float = 0.97) -> int:
    """How many of a query's best cells hold ``share`` of its ``top`` best rows, by queries out of the sample itself."""
    q = x[:asked]
    s = q @ x.T
    s[np.arange(len(q)), np.arange(len(q))] = -np.inf
    near = np.argsort(-s, axis=1, kind="stable")[:, : min(top, len(x) - 1)]
    place = np.argsort(np.argsort(-(q @ cells.T), axis=1, kind="stable"), axis=1)
    needed = np.take_along_axis(place, closest(x, cells)[0][near], axis=1)
    return 1 + int(np.quantile(needed, share, method="higher")) if needed.size else 1


@dataclass(frozen=True)
class Index:
    """codes (CODES), near each other by cell; the vectors (id, v) that they stand for; the book, null without rows."""

    codes: DataFrame
    vectors: DataFrame
    book: Codebook | None


def build(index: DataFrame, key: str = "vec_id", vector: str = "embedding", sample: int = SAMPLE, part: int = PART, seed: int = 0, unit_length: bool = True) -> Index:
    """Every sound vector of the commonest length, at length one (as it is, unless ``unit_length``), is coded; cells and words come from a bounded sample
    (``sample`` rows by hash).

    There are about as many cells as the square root of the rows, as far as the sample gives each of them eight; the sample
    also tells how many of them a search needs.
    """
    spark = index.sparkSession
    lengths = sound_vectors(index, key, vector).groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").first()
    empty = spark.createDataFrame([], CODES)
    if lengths is None:
        return Index(empty, spark.createDataFrame([], "id long, v array<double>"), None)
    norm = F.sqrt(dot(F.col("v"), F.col("v")))
    rows = sound_vectors(index, key, vector, lengths["d"])
    rows = rows.withColumn("v", F.when(norm > 0, F.transform("v", lambda x: x / norm)).otherwise(F.col("v"))) if unit_length else rows
    x = matrix(rows.orderBy(draw(F.lit(f"ann{seed}"), F.col("id")), "id").limit(sample).select("v").toArrow().column(0).combine_chunks())
    cells = learned(x, max(1, min(round(lengths["n"] ** 0.5), len(x) // 8)), seed)
    rest = x - cells[closest(x, cells)[0]]
    cuts = [*range(0, lengths["d"], part), lengths["d"]]
    words = [learned(rest[:, a:b], min(WORDS, len(x)), seed) for a, b in zip(cuts, cuts[1:], strict=False)]
    book = Codebook(cells, words, enough_probes(x, cells))
    return Index(coded(rows, book), rows, book)


def coded(rows: DataFrame, book: Codebook) -> DataFrame:
    """CODES of rows (id, v): cell and code words; what they leave of the vector, a byte (``fine``) per component in units
    of ``step``; ``slip``, the length of what is left then, so that a score by codes is off by at most slip times the query's
    length; ``name``, which copies of a vector share."""
    held = rows.sparkSession.sparkContext.broadcast(book)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column(1))
                cell, codes = held.value.encode(x)
                rest = x - held.value.decode(cell, codes)
                step = np.maximum(np.abs(rest).max(axis=1) / 127, 1e-300)
                fine = np.rint(rest / step[:, None]).astype(np.int8)
                slip = np.sqrt(((rest - fine * step[:, None]) ** 2).sum(axis=1))
                packed = lambda c: pa.array([r.tobytes() for r in c], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), batch.column(0), packed(codes), packed(fine), pa.array(step), pa.array(slip), batch.column(2)], names=["cell", "id", "code", "fine", "step", "slip", "name"])

    return rows.select("id", "v", F.xxhash64("v")).mapInArrow(run, CODES)


def save(index: Index, path: str, files: int = 16) -> None:
    """Codes in order of cell, so that a search reads only the row groups of its cells; vectors; the book, a row per centre."""
    index.codes.repartitionByRange(files, "cell", "id").sortWithinPartitions("cell", "id").write.mode("overwrite").parquet(f"{path}/codes")
    index.vectors.write.mode("overwrite").parquet(f"{path}/vectors")
    parts = [] if index.book is None else [np.array([[index.book.probes]]), index.book.cells, *index.book.words]
    rows = [(p, i, [float(x) for x in row]) for p, rows in enumerate(parts) for i, row in enumerate(rows)]
    index.codes.sparkSession.createDataFrame(rows, "part int, i int, x array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/book")


def load(spark: SparkSession, path: str) -> Index:
    parts: dict[int, list] = {}
    for r in spark.read.parquet(f"{path}/book").orderBy("part", "i").collect():
        parts.setdefault(r["part"], []).append(r["x"])
    held = [np.array(parts[p]) for p in sorted(parts)]
    return Index(spark.read.parquet(f"{path}/codes"), spark.read.parquet(f"{path}/vectors"), Codebook(held[1], held[2:], int(held[0][0, 0])) if held else None)


class Bounds:
    """Pairs of queries and rows that can be among a query's ``k`` best, by the bounds of their scores.

    ``floor`` is each query's k-th greatest lower bound so far: a pair whose upper bound doesn't reach it is out. Of
    copies (one name and one bound) the k of smallest id stay.
    """

    def __init__(self, queries: int, k: int):
        self.k, self.floor, self.waiting = k, np.full(queries, -np.inf), 0
        self.pairs = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0))]

    def see(self, row: np.ndarray, ids: np.ndarray, names: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
        self.pairs.append((row, ids, names, low, high))
        self.waiting += len(row)
        if self.waiting > WAITING:
            self.raised()

    def raised(self) -> tuple[np.ndarray, ...]:
        pairs = [np.concatenate(c) for c in zip(*self.pairs, strict=True)]
        row, ids, names, low, _ = pairs
        pairs = [c[np.lexsort((ids, names, -low, row))] for c in pairs]
        row, ids, names, low, high = pairs
        first = np.flatnonzero(np.diff(row, prepend=-1))
        full = first[np.diff(np.append(first, len(row))) >= self.k] + self.k - 1
        self.floor[row[full]] = np.maximum(self.floor[row[full]], low[full])
        other = np.ones(len(row), bool)
        other[1:] = (row[1:] != row[:-1]) | (names[1:] != names[:-1]) | (low[1:] != low[:-1])
        copy = np.arange(len(row)) - np.maximum.accumulate(np.where(other, np.arange(len(row)), 0))
        stay = (high >= self.floor[row] - EQUAL) & (copy < self.k)
        self.pairs, self.waiting = [tuple(c[stay] for c in pairs)], 0
        return self.pairs[0]


BOUNDED = "query_id long, id long, name long, low double, high double"


def search(index: Index, queries: DataFrame, k: int, probes: int | None = None, key: str = "vec_id", vector: str = "embedding", not_self: bool = False) -> DataFrame:
    """query_id, rank, key, score: the k best of the cells that a query looks through (all there are, if it looks through
    all cells).

    A query looks through its ``probes`` best cells (by default as many as the index has found to be enough). There the
    codes give bounds of each score; pairs that by their bounds can be among the k best are scored exactly against the
    vectors. Codes of one cell lie in many tasks' batches, so a common cell is shared out like any other.
    """
    spark, book = index.codes.sparkSession, index.book
    found = None
    # A query goes out as its vector; tasks hold a byte for each query and cell besides.
    most = BROADCAST_BYTES * 8 * book.cells.shape[1] // (8 * book.cells.shape[1] + len(book.cells)) if book else BROADCAST_BYTES
    for block in query_blocks(queries, key, vector, most):
        for asked, q in block if book else []:
            if q.shape[1] != book.cells.shape[1]:
                continue
            n = min(probes or book.probes, len(book.cells))
            held = spark.sparkContext.broadcast((asked, q, book))

            def best(batches: Iterator[pa.RecordBatch], held=held, n=n) -> Iterator[pa.RecordBatch]:
                asked, q, book = held.value
                size, mine = np.sqrt((q * q).sum(axis=1)) * (1 + 1e-12), Bounds(len(q), k)
                looks = None
                if n < len(book.cells):
                    looks = np.zeros((len(q), len(book.cells)), bool)
                    for a in range(0, len(q), ROWS):
                        np.put_along_axis(looks[a : a + ROWS], np.argsort(-(q[a : a + ROWS] @ book.cells.T), axis=1, kind="stable")[:, :n], True, axis=1)

                def score(who: np.ndarray, x: np.ndarray, ids: np.ndarray, names: np.ndarray, slip: np.ndarray) -> None:
                    for a in range(0, len(who), ROWS):
                        w = who[a : a + ROWS]
                        s, off = q[w] @ x.T, size[w, None] * slip[None, :]
                        r, c = np.nonzero(s + off >= mine.floor[w, None] - EQUAL)
                        if not_self:
                            other = asked[w[r]] != ids[c]
                            r, c = r[other], c[other]
                        mine.see(w[r], ids[c], names[c], s[r, c] - off[r, c], s[r, c] + off[r, c])

                everyone = np.arange(len(q))
                for batch in batches:
                    if not batch.num_rows:
                        continue
                    cells, ids, step, slip, names = (batch.column(i).to_numpy() for i in (0, 1, 4, 5, 6))
                    codes, fine = (np.frombuffer(b"".join(batch.column(i).to_pylist()), t).reshape(len(ids), -1) for i, t in ((2, np.uint8), (3, np.int8)))
                    x = book.decode(cells, codes) + fine * step[:, None]
                    slip = slip + 1e-12
                    if looks is None:
                        for a in range(0, len(x), ROWS):
                            score(everyone, x[a : a + ROWS], ids[a : a + ROWS], names[a : a + ROWS], slip[a : a + ROWS])
                        continue
                    order = np.argsort(cells, kind="stable")
                    for at in np.split(order, np.flatnonzero(np.diff(cells[order])) + 1):
                        who = np.flatnonzero(looks[:, cells[at[0]]])
                        for a in range(0, len(at) if len(who) else 0, ROWS):
                            part = at[a : a + ROWS]
                            score(who, x[part], ids[part], names[part], slip[part])
                row, *rest = mine.raised()
                yield pa.RecordBatch.from_arrays([pa.array(asked[row]), *map(pa.array, rest)], names=["query_id", "id", "name", "low", "high"])

            wanted = [int(c) for c in np.unique(np.argsort(-(q @ book.cells.T), axis=1)[:, :n])] if len(q) <= ROWS and n < len(book.cells) else []
            codes = index.codes.where(F.col("cell").isin(wanted)) if 0 < len(wanted) < len(book.cells) else index.codes
            near = codes.mapInArrow(best, BOUNDED)
            found = near if found is None else found.unionAll(near)
    if found is None:
        return ranked(spark.createDataFrame([], FOUND), k, key)
    mine = Window.partitionBy("query_id")
    found = found.withColumn("copy", F.row_number().over(Window.partitionBy("query_id", "name", "low").orderBy("id"))).where(F.col("copy") <= k)
    near = found.withColumn("place", F.row_number().over(mine.orderBy(F.desc("low"))))
    near = near.withColumn("floor", F.max(F.when(F.col("place") == k, F.col("low"))).over(mine)).where(F.col("floor").isNull() | (F.col("high") >= F.col("floor") - EQUAL)).select("query_id", "id")
    exact = near.join(index.vectors, "id").join(sound_vectors(queries, key, vector).select(F.col("id").alias("query_id"), F.col("v").alias("q")), "query_id")
    return ranked(exact.select("query_id", "id", dot(F.col("q"), F.col("v")).alias("score")), k, key)


def knn_approximate(index: DataFrame, queries: DataFrame, k: int, probes: int | None = None, key: str = "vec_id", vector: str = "embedding", not_self: bool = False, seed: int = 0) -> DataFrame:
    """``search`` over an index that is built for it."""
    return search(build(index, key, vector, seed=seed), queries, k, probes, key=key, vector=vector, not_self=not_self)

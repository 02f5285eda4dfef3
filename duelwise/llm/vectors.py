"""Nearest neighbours by collision counting, and exact inner-product search over norm buckets.

Vectors are packed into blocks of rows; each block is its own index. Queries are first searched in one block, which
bounds what their other neighbours have to reach. Then blocks of queries (a bounded number of rows) are sent to the
blocks of vectors that can reach a bound of theirs, and the best of all blocks are merged. No task holds more than one
block of each.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, arrow_batch, arrow_schema, bound_batches, table

BLOCK, QUERIES, TOP = 4096, 512, 10
#: Projections, share of them that must collide, window at radius 1 (QALSH's for a factor of 2), growth of the radius.
PROJECTIONS, COLLIDE, WINDOW, GROWTH = 64, 0.74, 2.719, 1.15
PACKED = "block long, dim int, ids binary, data binary, grade double"


def sound(df: DataFrame, key: str, vector: str, nonzero: bool) -> DataFrame:
    """(id, vec) of rows with a key and a vector of finite components (and, if asked for, not all zero)."""
    v = F.col(vector).cast("array<double>")
    finite = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    ok = F.col(key).isNotNull() & v.isNotNull() & (F.size(v) > 0) & finite
    if nonzero:
        ok &= F.exists(v, lambda x: x != 0)
    return df.where(ok).select(F.col(key).cast("long").alias("id"), v.alias("vec"))


def packed(rows: DataFrame, size: int, grade: Callable = lambda x: 0.0) -> DataFrame:
    """Rows (id, vec) in the order of each partition as blocks of one dimension and at most ``size`` rows, each with the grade of its vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, part, count, held = arrow_schema(PACKED), TaskContext.get().partitionId(), 0, {}

        def block(dim: int) -> pa.RecordBatch:
            nonlocal count
            count += 1
            ids, data = zip(*held.pop(dim), strict=True)
            x = np.array(data)
            return arrow_batch(schema, [[(part << 32) | count], [dim], [np.array(ids, np.int64).tobytes()], [x.tobytes()], [float(grade(x))]])

        for batch in batches:
            ids, col = batch.column(0).to_pylist(), batch.column(1)
            flat, off = col.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(pc.list_value_length(col).to_numpy())])
            for k, i in enumerate(ids):
                x = flat[off[k] : off[k + 1]]
                held.setdefault(len(x), []).append((i, x))
                if len(held[len(x)]) == size:
                    yield block(len(x))
        for dim in list(held):
            yield block(dim)

    return rows.mapInArrow(run, PACKED)


FOUND = "query_id long, vec_id long, score double"


def asked(rows: DataFrame, is_query) -> DataFrame:
    """One query of each id: of different vectors of one id the smallest."""
    return rows.where(is_query(F.col("id"))).groupBy("id").agg(F.min("vec").alias("vec"))


def search(blocks: DataFrame, queries: DataFrame, local: Callable, found: str = FOUND) -> DataFrame:
    """local(block id, ids, vectors, query ids, query vectors) -> columns of ``found``, over all pairs of blocks that
    can meet: those whose grade reaches the queries' grade."""
    bound_batches(blocks.sparkSession)
    # Ids are (partition, place in it): two numbers name all that there can be.
    parts, most = blocks.agg(F.max(F.shiftright("block", 32)), F.max(F.col("block").bitwiseAND(F.lit((1 << 32) - 1)))).first()
    to = queries.select(F.col("block").alias("q"), "dim", F.col("grade").alias("need"), F.explode(F.sequence(F.lit(0), F.lit(parts or 0))).alias("part"))
    to = to.select("q", "dim", "need", "part", F.explode(F.sequence(F.lit(1), F.lit(most or 1))).alias("place"))
    to = to.select("q", "dim", "need", (F.shiftleft(F.col("part").cast("long"), 32) + F.col("place")).alias("block"))
    pairs = to.join(blocks.select("block", "dim", "grade"), ["block", "dim"]).where("grade >= need").select("block", "q")
    sent = pairs.join(queries.select(F.col("block").alias("q"), F.col("ids").alias("qids"), F.col("data").alias("qdata")), "q").drop("q")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = arrow_schema(found)
        for batch in batches:
            for r in batch.to_pylist():
                x = np.frombuffer(r["data"]).reshape(-1, r["dim"])
                qids = np.frombuffer(r["qids"], np.int64)
                q = np.frombuffer(r["qdata"]).reshape(len(qids), -1)
                columns = local(r["block"], np.frombuffer(r["ids"], np.int64), x, qids, q)
                yield arrow_batch(schema, columns)

    return blocks.drop("grade").join(sent, "block").select("block", "dim", "ids", "data", "qids", "qdata").mapInArrow(run, found)


def bounded(queries: DataFrame, first: DataFrame, worst, top: int) -> DataFrame:
    """queries(id, vec) with one more component: what the last of ``top`` scores found first is (``worst`` of them), or infinite."""
    bound = first.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), worst("score").cast("double").alias("bound")).where(F.col("n") >= top)
    joined = queries.join(bound, queries["id"] == bound["query_id"], "left")
    return joined.select("id", F.concat("vec", F.array(F.coalesce("bound", F.lit(float("inf") if worst is F.max else float("-inf"))))).alias("vec"))


def query_blocks(queries: DataFrame, scratch: Scratch, name: str, extra: int = 0, grade: Callable = lambda x: 0.0, order=None) -> DataFrame:
    """Packed queries, those of a block near each other in ``order``; ``extra`` components at the end don't count as dimensions."""
    tasks = 1 + queries.count() // (4 * QUERIES)
    dealt = queries.repartition(tasks, "id") if order is None else queries.withColumn("_o", order).repartitionByRange(tasks, "_o", "id").sortWithinPartitions("_o", "id").drop("_o")
    return scratch.save(packed(dealt, QUERIES, grade).withColumn("dim", F.col("dim") - extra), name)


def best(found: DataFrame, order: list, top: int = TOP) -> DataFrame:
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))
    return ranked.where(F.col("rank") <= top).select("query_id", F.col("rank").cast("int"), "vec_id", "score")


class CollisionIndex:
    """Per random projection, the values of all vectors in order. A query widens windows around its own projections.

    At radius R a vector collides in a projection if it lies within half a window times R of the query. Widening from
    one radius to the next (virtual rehashing) adds the two ends of each window. Vectors with enough collisions are
    verified; the search ends once the last of the best lies within the radius, or all vectors were verified.
    """

    def __init__(self, x: np.ndarray, projections: int = PROJECTIONS, seed: int = 17):
        self.x, n = x, len(x)
        self.a = np.random.default_rng(seed).standard_normal((x.shape[1], projections))
        values = x @ self.a
        self.order = np.ascontiguousarray(np.argsort(values, axis=0).T)
        self.values = np.take_along_axis(np.ascontiguousarray(values.T), self.order, axis=1)
        self.least = max(1, int(np.ceil(COLLIDE * projections)))
        self.start = max(float(np.std(values)) / 8, 1e-9)

    def query(self, q: np.ndarray, own: np.ndarray, top: int, bound: float = np.inf) -> tuple[np.ndarray, np.ndarray]:
        """Places and distances of verified vectors, at least the ``top`` nearest within ``bound`` as far as found."""
        n, m = len(self.x), len(self.order)
        at, radius = q @ self.a, self.start if bound == np.inf else max(bound / GROWTH**2, 1e-9)
        count, done = np.zeros(n, np.int32), own.copy()
        lo = hi = np.full(m, -1)
        places, dists, near = [], [], np.full(top, bound)
        while True:
            half = WINDOW * radius / 2
            a = np.array([v.searchsorted(c) for v, c in zip(self.values, at - half, strict=True)])
            b = np.array([v.searchsorted(c, "right") for v, c in zip(self.values, at + half, strict=True)])
            if lo[0] < 0:
                fresh = [self.order[j, s:e] for j, s, e in zip(range(m), a.tolist(), b.tolist(), strict=True)]
            else:
                fresh = [x for j, s, u, v, e in zip(range(m), a.tolist(), lo.tolist(), hi.tolist(), b.tolist(), strict=True) for x in (self.order[j, s:u], self.order[j, v:e])]
            lo, hi = a, b
            count += np.bincount(np.concatenate(fresh), minlength=n)
            new = np.flatnonzero((count >= self.least) & ~done)
            if len(new):
                done[new] = True
                d = np.sqrt(((self.x[new] - q) ** 2).sum(axis=1))
                places.append(new)
                dists.append(d)
                near = np.sort(np.concatenate([near, d]))[:top]
            if near[-1] <= radius or (hi - lo == n).all():
                break
            radius *= GROWTH
        return (np.concatenate(places), np.concatenate(dists)) if places else (np.zeros(0, np.int64), np.zeros(0))


def _first(ids: np.ndarray, scores: np.ndarray, top: int) -> np.ndarray:
    return np.lexsort((ids, scores))[:top]


def nearest(vectors: DataFrame, is_query, key: str = "vec_id", vector: str = "embedding", top: int = TOP) -> DataFrame:
    """query_id, rank, vec_id, score: each query's nearest rows by Euclidean distance, nearest first, ties to the smaller id.

    Approximate, but each query has ``top`` rows (all candidates, if fewer): what the first block gave stays, other
    blocks add to it. Recall is measured by tests. Rows without key, and vectors null, empty, zero or with null or
    non-finite components take no part; a query meets vectors of its own dimension and no row of its own id. Repeated
    rows are candidates each, but one query (of different vectors of a query's id the smallest asks). Other columns play
    no part; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    bound_batches(spark)
    scratch = Scratch(spark, "nearest")
    rows = sound(vectors, key, vector, True)
    # Blocks follow the number of rows, not the layout of the files.
    blocks = scratch.save(packed(rows.repartition(max(1, -(-rows.count() // BLOCK))), BLOCK), "blocks")
    who = scratch.save(asked(rows, is_query), "asked")

    def local(block: int, ids: np.ndarray, x: np.ndarray, qids: np.ndarray, q: np.ndarray) -> list:
        known, out = index(CollisionIndex, x.tobytes(), x.shape[1]), ([], [], [])
        bounds = q[:, -1] if q.shape[1] > x.shape[1] else np.full(len(q), np.inf)
        for i, v, bound in zip(qids.tolist(), q[:, : x.shape[1]], bounds.tolist(), strict=True):
            at, d = known.query(v, ids == i, top, bound)
            pick = _first(ids[at], d, top)
            pick = pick[d[pick] <= bound]
            for column, values in zip(out, (np.full(len(pick), i), ids[at][pick], d[pick]), strict=True):
                column.append(values)
        return [np.concatenate(c) for c in out]

    heads = F.broadcast(blocks.groupBy("dim").agg(F.min("block").alias("block")))
    first = scratch.save(search(blocks.join(heads, ["dim", "block"], "left_semi"), query_blocks(who, scratch, "queries"), local), "first")
    queries = query_blocks(bounded(who, first, F.max, top), scratch, "bounded", 1)
    found = scratch.save(search(blocks.join(heads, ["dim", "block"], "left_anti"), queries, local), "found")
    return best(first.unionByName(found), [F.col("score"), F.col("vec_id")], top)


SCORED = "query_id long, vec_id long, score long"
_LIMIT = float(1 << 53)


def _products(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Integer inner products; values that doubles can't hold are computed as Python ints and kept within 64 bits."""
    if x.shape[1] * (np.abs(x).max(initial=0.0) * np.abs(q).max(initial=0.0)) < _LIMIT:
        return (x @ q).astype(np.int64)
    whole = lambda v: int(v) if np.isfinite(v) else (1 << 62) * (1 if v > 0 else -1)
    ints = [sum(whole(a) * whole(b) for a, b in zip(row, q, strict=True)) for row in x]
    return np.array([min(max(s, -(1 << 63)), (1 << 63) - 1) for s in ints], np.int64)


def _least_length(q: np.ndarray) -> float:
    """The length that some vector needs to reach the bound (last component) of one of these queries."""
    length, bound = np.sqrt((q[:, :-1] ** 2).sum(axis=1)), q[:, -1]
    return float(np.where((bound > 0) & (length > 0), bound / np.maximum(length, 1e-300) * (1 - 1e-9), -np.inf).min())


class NormBucket:
    """Vectors by falling length, and for each coordinate the sorted values of the unit vectors."""

    def __init__(self, x: np.ndarray):
        self.x, self.norm = x, np.sqrt((x * x).sum(axis=1))
        unit = x / np.where(self.norm > 0, self.norm, 1)[:, None]
        self.order = np.argsort(unit, axis=0)
        self.values = np.take_along_axis(unit, self.order, axis=0)

    def candidates(self, q: np.ndarray, least: float) -> np.ndarray | slice | None:
        """Places that may reach the score ``least``: by the cosine it asks of the longest vector, nothing, those in
        the narrowest feasible range of a coordinate, or those long enough; whichever are fewer."""
        length = float(np.sqrt((q * q).sum()))
        top = float(self.norm[0])
        if least == -np.inf or length == 0 or top == 0 or least <= 0:
            return slice(None)
        cos = least / (length * top) * (1 - 1e-9)
        if cos > 1:
            return None
        long = int(np.searchsorted(-self.norm, -(least / length) * (1 - 1e-9), "right"))
        unit = q / length
        focus = np.argsort(-np.abs(unit))[:4]
        spread = np.sqrt(max(0.0, 1 - cos * cos)) * np.sqrt(np.maximum(0, 1 - unit[focus] ** 2))
        # The unit vector's coordinate lies within this range if its cosine is at least cos, as long as cos > |coordinate|.
        lo = np.where(-unit[focus] > cos, -1.0, unit[focus] * cos - spread) - 1e-9
        hi = np.where(unit[focus] > cos, 1.0, unit[focus] * cos + spread) + 1e-9
        ranges = [(np.searchsorted(self.values[:, f], a), np.searchsorted(self.values[:, f], b, "right"), f) for f, a, b in zip(focus, lo, hi, strict=True)]
        a, b, f = min(ranges, key=lambda r: r[1] - r[0])
        return self.order[a:b, f] if b - a < long else slice(0, long)


def top_products(vectors: DataFrame, is_query, key: str = "vec_id", vector: str = "embedding", scale: float = 1024.0, top: int = TOP) -> DataFrame:
    """query_id, rank, vec_id, score: each query's rows of highest integer inner product, ties to the smaller id; exact.

    Components are floor(scale * x). Vectors are dealt to buckets by falling length. The longest bucket gives each
    query a score that its result has to reach; every bucket is then pruned by length or coordinate and verified.
    Null and odd values are handled as in ``nearest``, but zero vectors take part.
    """
    spark = vectors.sparkSession
    bound_batches(spark)
    scratch = Scratch(spark, "products")
    rows = sound(vectors, key, vector, False).select("id", F.transform("vec", lambda x: _floor(x * F.lit(scale))).alias("vec"))
    rows = rows.withColumn("norm", F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x))
    n = max(1, -(-rows.count() // BLOCK))
    sorted_rows = rows.repartitionByRange(n, F.desc("norm"), F.asc("id")).sortWithinPartitions(F.desc("norm"), F.asc("id")).select("id", "vec")
    blocks = scratch.save(packed(sorted_rows, BLOCK, lambda x: np.sqrt((x * x).sum(axis=1)).max()), "blocks")
    who = scratch.save(asked(rows, is_query), "asked")
    queries = query_blocks(who, scratch, "queries", grade=lambda x: -np.inf)

    def within(ids, x, qids, q, least) -> list:
        known, out = index(NormBucket, x.tobytes(), x.shape[1]), ([], [], [])
        for i, v, t in zip(qids.tolist(), q, least, strict=True):
            at = known.candidates(v, t)
            if at is None:
                continue
            who = ids[at]
            score = _products(x[at], v)
            keep = (who != i) & (score >= t)
            who, score = who[keep], score[keep]
            pick = np.lexsort((who, -score))[:top]
            for column, values in zip(out, (np.full(len(pick), i), who[pick], score[pick]), strict=True):
                column.append(values)
        return [np.concatenate(c) if c else [] for c in out]

    head = blocks.join(F.broadcast(blocks.groupBy("dim").agg(F.min("block").alias("block"))), ["dim", "block"])
    first = scratch.save(search(head, queries, lambda b, ids, x, qids, q: within(ids, x, qids, q, [-np.inf] * len(q)), SCORED), "first")
    squares = F.aggregate(F.slice("vec", 1, F.size("vec") - 1), F.lit(0.0), lambda a, x: a + x * x)
    reach = F.when((squares > 0) & (F.element_at("vec", -1) > 0), F.element_at("vec", -1) / F.sqrt(squares)).otherwise(float("-inf"))
    queries = query_blocks(bounded(who, first, F.min, top), scratch, "bounded", 1, _least_length, reach)

    def pruned(block, ids, x, qids, q) -> list:
        return within(ids, x, qids, q[:, :-1], q[:, -1])

    found = scratch.save(search(blocks, queries, pruned, SCORED), "found")
    return best(found, [F.desc("score"), F.col("vec_id")], top)


@lru_cache(maxsize=1)
def index(kind: type, raw: bytes, dim: int) -> CollisionIndex | NormBucket:
    """The index of the block at hand; blocks of queries follow each other on one block of vectors."""
    return kind(np.frombuffer(raw).reshape(-1, dim))


def _floor(x):
    """floor that stays a double."""
    return F.rint(x) - F.when(F.rint(x) > x, F.lit(1.0)).otherwise(F.lit(0.0))


def hundredth(key):
    return key % 100 == 0


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), hundredth)


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_products(table(spark, sf_dir, "embeddings"), hundredth)


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS x
  FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.x, c.x), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.x) = len(c.x)),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 10
"""

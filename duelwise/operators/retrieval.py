"""Dense retrieval: exact inner products, cosine triangles, principal components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .vectors import Best, by_length, sound_vectors

#: Query rows of one matrix product, and bytes of queries that are sent to every task at once.
QUERY_BLOCK, BROADCAST_BYTES = 1024, 64 << 20


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def query_blocks(queries: DataFrame, key: str, vector: str, most_bytes: int = BROADCAST_BYTES) -> Iterator[list[tuple[np.ndarray, np.ndarray]]]:
    """The sound queries in blocks of bounded bytes, each as (ids, matrix) by length of vector."""
    rows = sound_vectors(queries, key, vector)
    n, widest = rows.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    blocks = -(-n * 8 * (widest or 0) // most_bytes)
    for b in range(blocks):
        block = rows.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).orderBy("id").toArrow().combine_chunks()
        if block.num_rows:
            yield [part for batch in block.to_batches() for part in by_length(batch.column(0), batch.column(1))]


def ranked(found: DataFrame, k: int, key: str) -> DataFrame:
    """(query_id, id, score) -> query_id, rank, key, score: k best per query, ties (to nine places) to the smaller id."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(key), "score")


FOUND = "query_id long, id long, score double"


def knn(index: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", not_self: bool = False) -> DataFrame:
    """query_id, rank, key, score: exact inner products, k best per query.

    Queries go out in blocks of bounded bytes; a task multiplies its batches with them and keeps k rows per query, so
    what is shuffled is k rows per query and task. Null vectors and those with null or non-finite components take no
    part; a query meets the vectors of its own length.
    """
    spark = index.sparkSession
    rows, found = sound_vectors(index, key, vector), None
    for block in query_blocks(queries, key, vector):
        held = spark.sparkContext.broadcast(block)

        def best(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            kept = [Best(k) for _ in held.value]
            for batch in batches:
                for ids, x in by_length(batch.column(0), batch.column(1)):
                    for (asked, q), mine in zip(held.value, kept, strict=True):
                        for at in range(0, len(q) if q.shape[1] == x.shape[1] else 0, QUERY_BLOCK):
                            s = q[at : at + QUERY_BLOCK] @ x.T
                            if not_self:
                                s[asked[at : at + QUERY_BLOCK, None] == ids[None, :]] = -np.inf
                            mine.see_all(at, ids, s)
            for (asked, _), mine in zip(held.value, kept, strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(asked[mine.row]), pa.array(mine.id), pa.array(mine.score)], names=["query_id", "id", "score"])

        part = rows.mapInArrow(best, FOUND)
        found = part if found is None else found.unionAll(part)
    return ranked(spark.createDataFrame([], FOUND) if found is None else found, k, key)


def recall(exact: DataFrame, approximate: DataFrame, key: str = "vec_id") -> DataFrame:
    """query_id, hits, k."""
    hit = approximate.select("query_id", key, F.lit(1).alias("hit"))
    return exact.join(hit, ["query_id", key], "left").groupBy("query_id").agg(F.count("hit").alias("hits"), F.count(F.lit(1)).alias("k"))


def triangle(df: DataFrame, a: str, b: str, c: str) -> DataFrame:
    """Cosines of three vectors and the triangle whose sides fall with them; null where all cosines agree.

    The longest side is 200, the shortest 100; A lies at the origin, B on the x axis.
    """
    d = df.withColumns({"cos_ab": cosine(F.col(a), F.col(b)), "cos_ac": cosine(F.col(a), F.col(c)), "cos_bc": cosine(F.col(b), F.col(c))})
    names = ("ab", "ac", "bc")
    low, high = F.least(*[F.col(f"cos_{x}") for x in names]), F.greatest(*[F.col(f"cos_{x}") for x in names])
    d = d.withColumns({f"side_{x}": F.lit(200.0) * (1 - 0.5 * (F.col(f"cos_{x}") - low) / F.nullif(high - low, F.lit(0.0))) for x in names})
    cos = (F.col("side_ab") ** 2 + F.col("side_ac") ** 2 - F.col("side_bc") ** 2) / (2 * F.col("side_ab") * F.col("side_ac"))
    angle = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cos)))
    return d.withColumns({"cx": F.col("side_ac") * F.cos(angle), "cy": F.col("side_ac") * F.sin(angle)})


def triangle_labels(d: DataFrame) -> DataFrame:
    """The rows of ``triangle`` once per edge: edge, its rounded length (halves to even) as a label, and its midpoint."""
    ends = {"ab": (F.col("side_ab"), F.lit(0.0)), "ac": (F.col("cx"), F.col("cy")), "bc": (F.col("side_ab") + F.col("cx"), F.col("cy"))}
    edge = lambda e, x, y: F.struct(F.lit(e).alias("edge"), F.bround(f"side_{e}", 0).cast("long").cast("string").alias("label"), (x / 2).alias("mid_x"), (y / 2).alias("mid_y"))
    return d.withColumn("_edge", F.explode(F.array(*(edge(e, *xy) for e, xy in ends.items())))).select(*d.columns, "_edge.*")


def project(df: DataFrame, dims: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """key and a ``dims``-dimensional point: principal components of centred vectors, the largest loading positive.

    For tables of any size; ``projection`` has views of one request. Vectors null, empty or with null or non-finite
    components have no point; the others are of one length, at least ``dims``.
    """
    rows = sound_vectors(df, key, vector).select(F.col("id").alias(key), "v")
    if rows.isEmpty():
        return df.sparkSession.createDataFrame([], f"{key} long, point array<double>")
    mean = rows.select(Summarizer.mean(array_to_vector("v"))).first()[0]
    centre = F.array(*[F.lit(float(x)) for x in mean])
    rows = rows.select(key, array_to_vector(F.zip_with("v", centre, lambda x, m: x - m)).alias("features"))
    model = PCA(k=dims, inputCol="features", outputCol="pc").fit(rows)
    load = model.pc.toArray()
    signs = F.array(*[F.lit(float(np.sign(load[np.abs(load[:, j]).argmax(), j]) or 1.0)) for j in range(dims)])
    return model.transform(rows).select(key, F.zip_with(vector_to_array("pc"), signs, lambda x, s: x * s).alias("point"))

"""k-means over tables: whole rounds or mini-batches, each one pass of partial sums per centre."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sampling import draw
from .vectors import matrix, sound_vectors

#: Rows that starting centres are chosen from, their bytes, and rows of a mini-batch.
SAMPLE, SAMPLE_BYTES, BATCH_ROWS = 10_000, 64 << 20, 4096


def spread_start(x: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """k rows far from each other: each further one is drawn by its squared distance to those that are there."""
    rng = np.random.default_rng(seed)
    picked = [int(rng.integers(len(x)))]
    near = ((x - x[picked[0]]) ** 2).sum(axis=1)
    while len(picked) < min(k, len(x)):
        total = near.sum()
        at = int(rng.choice(len(x), p=near / total)) if total > 0 else next(i for i in range(len(x)) if i not in picked)
        picked.append(at)
        near = np.minimum(near, ((x - x[at]) ** 2).sum(axis=1))
    return x[picked].astype(float)


def closest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(centre, squared distance) of each row; ties go to the first centre."""
    d = (x * x).sum(axis=1)[:, None] - 2 * (x @ centres.T) + (centres * centres).sum(axis=1)[None, :]
    at = d.argmin(axis=1)
    return at, ((x - centres[at]) ** 2).sum(axis=1)


def moved(centres: np.ndarray, seen: np.ndarray, n: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Centres after a batch, each weighed by all rows it has had: its rate falls as one over their number."""
    seen = seen + n
    gain = np.where(seen > 0, 1 / np.maximum(seen, 1), 0)[:, None]
    return centres + gain * (sums - n[:, None] * centres), seen


def totals(rows: DataFrame, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Rows and vector sums by nearest centre, and the sum of squared distances. Tasks add up their rows, Spark adds up
    the tasks; centres x dimensions numbers come back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, cost = np.zeros(len(centres), np.int64), np.zeros(centres.shape), np.zeros(len(centres))
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column(0))
                at, d = closest(x, centres)
                n += np.bincount(at, minlength=len(n))
                cost += np.bincount(at, d, len(n))
                np.add.at(sums, at, x)
        for c in np.flatnonzero(n).tolist():
            yield pa.RecordBatch.from_pydict({"c": pa.array([c], pa.int32()), "n": pa.array([n[c]], pa.int64()), "cost": [cost[c]], "s": pa.array([sums[c]], pa.list_(pa.float64()))})

    parts = rows.select("v").mapInArrow(run, "c int, n long, cost double, s array<double>")
    cells = parts.select("c", F.posexplode("s").alias("i", "x"), "n", "cost").groupBy("c", "i").agg(F.sum("x").alias("x"), F.sum("n").alias("n"), F.sum("cost").alias("cost"))
    n, sums, cost = np.zeros(len(centres)), np.zeros(centres.shape), np.zeros(len(centres))
    for r in cells.toLocalIterator():
        n[r["c"]], sums[r["c"], r["i"]], cost[r["c"]] = r["n"], r["x"], r["cost"]
    return n, sums, float(cost.sum())


def kmeans(df: DataFrame, k: int, method: str = "KMeans", start: np.ndarray | None = None, seed: int = 0, rounds: int = 20, tolerance: float = 1e-4, batch_rows: int = BATCH_ROWS, key: str = "vec_id", vector: str = "embedding") -> np.ndarray:
    """The centres (at most as many as there are rows).

    ``KMeans`` moves each centre to the mean of its rows, round after round, until the cost falls by less than
    ``tolerance`` of itself. ``MiniBatchKMeans`` deals the rows to batches of about ``batch_rows`` by a portable hash and
    takes at most ``rounds`` of them, one after the other (again from the first one, if there are fewer); a batch pulls
    a centre by the share it has in all rows that the centre has had. Without ``start`` a bounded sample gives one.
    Null vectors and those with null or non-finite components take no part.
    """
    rows = sound_vectors(df, key, vector)
    if start is None:
        widest = rows.agg(F.max(F.size("v"))).first()[0]
        if widest is None:
            return np.zeros((0, 0))
        sample = rows.orderBy(draw(F.lit(f"start{seed}"), F.col("id")), "id").limit(max(k, min(SAMPLE, SAMPLE_BYTES // (8 * widest))))
        start = spread_start(matrix(sample.select("v").toArrow().column(0).combine_chunks()), k, seed)
    centres = np.array(start, float)
    if method == "KMeans":
        before = np.inf
        for _ in range(rounds):
            n, sums, cost = totals(rows, centres)
            centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
            if before - cost <= tolerance * cost:
                break
            before = cost
        return centres
    if method != "MiniBatchKMeans":
        raise ValueError(f"unknown method {method}")
    batches = max(1, -(-rows.count() // batch_rows))
    of = F.conv(F.substring(draw(F.lit(f"batch{seed}"), F.col("id")), 1, 8), 16, 10).cast("long") % batches
    # A row is read for its own batch alone: the rows wait by batch.
    dealt, seen = rows.select("v", of.alias("batch")).where(F.col("batch") < rounds).persist(), np.zeros(len(centres))
    try:
        for step in range(rounds):
            n, sums, _ = totals(dealt.where(F.col("batch") == step % batches), centres)
            centres, seen = moved(centres, seen, n, sums)
    finally:
        dealt.unpersist()
    return centres


def assigned(df: DataFrame, centres: np.ndarray, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """key, cluster, distance (squared) of every sound row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                at, d = closest(matrix(batch.column(1)), centres)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(at.astype(np.int32)), pa.array(d)], names=[key, "cluster", "distance"])

    return sound_vectors(df, key, vector).select("id", "v").mapInArrow(run, f"{key} long, cluster int, distance double")


def cluster(df: DataFrame, k: int, method: str = "KMeans", seed: int = 0, key: str = "vec_id", vector: str = "embedding", **options) -> DataFrame:
    """key, cluster."""
    return assigned(df, kmeans(df, k, method, seed=seed, key=key, vector=vector, **options), key, vector).select(key, "cluster")

"""Vector columns as matrices, and which vectors count."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sound_vectors(rows: DataFrame, key: str, vector: str, dims: int | None = None, *others: str) -> DataFrame:
    """(id, v, others) of rows whose vector is there, not empty, and has finite components only (``dims`` of them, if given)."""
    v = F.col(vector).cast("array<double>")
    finite = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    length = F.size(v) > 0 if dims is None else F.size(v) == dims
    return rows.where(v.isNotNull() & length & finite).select(F.col(key).cast("long").alias("id"), v.alias("v"), *others)


def matrix(column: pa.Array) -> np.ndarray:
    """The rows of a list column of equal lengths, without a copy through Python lists."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(flat) % len(column):
        raise ValueError("vectors of different lengths")
    return flat.reshape(len(column), -1)


def by_length(ids: pa.Array, column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, matrix) for each length of vectors in a batch."""
    lengths = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    for n in np.unique(lengths).tolist():
        same = pa.array(lengths == n)
        yield ids.filter(same).to_numpy(zero_copy_only=False), matrix(column.filter(same))


class Best:
    """The ``k`` best of what has been seen for each query: by score (to so many places) and then the smaller id."""

    def __init__(self, k: int, places: int = 9):
        self.k, self.places, self.row, self.id, self.score = k, places, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)

    def see(self, row: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        row, ids, score = np.concatenate([self.row, row]), np.concatenate([self.id, ids]), np.concatenate([self.score, score])
        order = np.lexsort((ids, -np.round(score, self.places), row))
        row = row[order]
        first = np.flatnonzero(np.diff(row, prepend=-1))
        place = np.arange(len(row)) - np.repeat(first, np.diff(np.append(first, len(row))))
        kept = order[place < self.k]
        self.row, self.id, self.score = row[place < self.k], ids[kept], score[kept]

    def see_all(self, first_row: int, ids: np.ndarray, s: np.ndarray) -> None:
        """Scores of a block of queries (rows of s, numbered from ``first_row``) and all ids; -inf doesn't count."""
        if not s.size:
            return
        m = min(self.k, s.shape[1])
        # Whatever rounds to the last kept score stays in, so that ties can go by id.
        floor = np.partition(s, -m, axis=1)[:, -m][:, None] - 10.0**-self.places
        r, c = np.nonzero((s >= floor) & (s > -np.inf))
        self.see(first_row + r, ids[c], s[r, c])

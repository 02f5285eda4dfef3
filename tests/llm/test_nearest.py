"""Nearest neighbours over the given tables: whole lists, recall, and the same blocks for any layout."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from duelwise.llm import vectors


def exact(spark, sf):
    rows = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").where("vec_id IS NOT NULL AND embedding IS NOT NULL").collect()
    ids = np.array([r["vec_id"] for r in rows])
    x = np.array([r["embedding"] for r in rows], float)
    for q, v in zip(ids, x, strict=True):
        if q % 100 == 0:
            d = np.sqrt(((x - v) ** 2).sum(axis=1))
            d[ids == q] = np.inf
            order = np.lexsort((ids, d))[: min(10, (ids != q).sum())]
            yield int(q), list(zip(ids[order].tolist(), d[order].tolist(), strict=True))


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_whole_lists_and_recall(spark, sf):
    got = {}
    for r in sorted(vectors.op2(spark, f"/root/testdata/{sf}").collect(), key=lambda r: r["rank"]):
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    want = dict(exact(spark, sf))
    assert {q: len(x) for q, x in got.items()} == {q: len(x) for q, x in want.items()}
    hits = sum(len({v for v, _ in got[q]} & {v for v, _ in want[q]}) for q in want)
    assert hits >= 0.9 * sum(map(len, want.values()))
    for found in got.values():
        assert found == sorted(found, key=lambda x: (x[1], x[0]))


def test_equal_vectors_over_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 16)
    rows = [(i, [1.0, 2.0, 3.0] if i % 2 else [float(i), 1.0, 0.5]) for i in range(150)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(7)
    got = sorted(vectors.nearest(df, lambda k: k % 50 == 1).collect(), key=lambda r: (r["query_id"], r["rank"]))
    for q in (1, 51, 101):
        mine = [r for r in got if r["query_id"] == q]
        assert [r["score"] for r in mine] == [0.0] * 10
    best = sorted(vectors.top_products(df, lambda k: k % 50 == 1, scale=1.0).collect(), key=lambda r: (r["query_id"], r["rank"]))
    x = np.floor(np.array([r[1] for r in rows])).astype(int)
    for q in (1, 51, 101):
        s = x @ x[q]
        order = sorted((i for i in range(150) if i != q), key=lambda i: (-s[i], i))[:10]
        assert [(r["vec_id"], r["score"]) for r in best if r["query_id"] == q] == [(i, s[i]) for i in order]


def test_blocks_follow_rows_not_files(spark, monkeypatch):
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").repartition(40)
    seen = []
    save = vectors.Scratch.save
    monkeypatch.setattr(vectors.Scratch, "save", lambda self, df, name, *a, **b: seen.append((name, out := save(self, df, name, *a, **b))) or out)
    vectors.nearest(rows, vectors.hundredth).collect()
    assert dict(seen)["blocks"].count() == 1
    assert dict(seen)["blocks"].select(F.sum(F.length("ids"))).first()[0] == 8 * rows.count()

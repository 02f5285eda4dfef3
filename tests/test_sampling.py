"""Draws without replacement: every set as likely, at the cost of what is drawn."""

from collections import Counter
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from duelwise.operators import sampling


def test_picks_are_uniform(spark):
    n, m, draws = 5, 2, 20_000
    d = spark.range(draws).select(sampling.picks(F.lit(n).cast("long"), F.lit(m).cast("long"), F.lit("u"), F.col("id")).alias("p"))
    seen = Counter(tuple(r["p"]) for r in d.collect())
    assert all(len(set(p)) == m and 0 <= min(p) <= max(p) < n for p in seen)
    pairs = [(a, b) for a in range(n) for b in range(n) if a != b]
    assert set(seen) == set(pairs)
    # 20 ordered pairs, 1,000 each: five standard deviations are about 155.
    assert all(abs(seen[p] - draws / len(pairs)) < 160 for p in pairs)


@pytest.mark.parametrize(("n", "m", "size"), [(3, 5, 3), (4, 4, 4), (1, 1, 1), (0, 2, 0), (10**12, 3, 3)])
def test_picks_of_any_size(spark, n, m, size):
    got = spark.range(50).select(sampling.picks(F.lit(n).cast("long"), F.lit(m).cast("long"), F.lit("s"), F.col("id")).alias("p")).collect()
    assert all(len(set(r["p"])) == size and all(0 <= x < n for x in r["p"]) for r in got)


def test_places(spark):
    rows = [(f"k{i % 4}", f"item{i}") for i in range(300)]
    got = sampling.placed(spark.createDataFrame(rows, "c string, x string").repartition(5), "x", "at", "c").collect()
    for c in {r[0] for r in rows}:
        assert sorted(r["at"] for r in got if r["c"] == c) == list(range(75))
    whole = sampling.placed(spark.createDataFrame(rows, "c string, x string"), "x", "at").collect()
    assert sorted(r["at"] for r in whole) == list(range(300))


def test_pick_per_draw(spark):
    items = spark.createDataFrame([(x,) for x in "abcde"] * 2, "item string")
    got = {}
    for r in sampling.pick_per_draw(spark.range(200).withColumnRenamed("id", "d"), items, 3, "d", "item").collect():
        got.setdefault(r["d"], {})[r["place"]] = r["item"]
    assert len(got) == 200
    assert all(sorted(v) == [0, 1, 2] and len(set(v.values())) == 3 for v in got.values())
    assert {frozenset(v.values()) for v in got.values()} == {frozenset(c) for c in combinations("abcde", 3)}


def test_nested_draws(spark):
    items = [(c, f"{c}{i}") for c, n in (("a", 1), ("b", 2), ("c", 5), ("d", 40)) for i in range(n)]
    df = spark.createDataFrame([*items, *items[:3]], "c string, x string")
    rows = sampling.nested_draws(spark.range(400).withColumnRenamed("id", "k"), df, "k", "c", "x").collect()
    by_draw, sizes = {}, {"a": (1, 1), "b": (2, 2), "c": (2, 5), "d": (2, 8)}
    for r in rows:
        by_draw.setdefault(r["k"], {}).setdefault((r["place"], r["c"], r["n_categories"]), []).append((r["item_place"], r["x"]))
    assert len(by_draw) == 400
    for drawn in by_draw.values():
        n = {k[2] for k in drawn}
        assert len(n) == 1
        assert len(drawn) == n.pop() in (2, 3, 4)
        assert sorted(k[0] for k in drawn) == list(range(len(drawn)))
        for (_, c, _), got in drawn.items():
            assert sizes[c][0] <= len(got) <= sizes[c][1]
            assert sorted(p for p, _ in got) == list(range(len(got)))
            assert len({x for _, x in got}) == len(got)
            assert all(x.startswith(c) for _, x in got)
    counts = Counter(len(v) for drawn in by_draw.values() for k, v in drawn.items() if k[1] == "d")
    assert set(counts) == set(range(2, 9))
    assert sampling.nested_draws(spark.range(3).withColumnRenamed("id", "k"), df.limit(0), "k", "c", "x").count() == 0

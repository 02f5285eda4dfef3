"""Live votes, counts and ratings against the batch operators, over restarts, late and repeated votes."""

import json
import random

import pytest
from pyspark.sql import functions as F

from duelwise.operators import ratings
from duelwise.streaming import live

SCHEMA = "battle_id long, tstamp double, task_type string, model_a string, model_b string, winner string, type string"
HOUR, START = 3600.0, 1_700_000_000.0


def vote(i, t, task="sts", a="x", b="y", winner="model_a", kind="leftvote"):
    return {"battle_id": i, "tstamp": START + t, "task_type": task, "model_a": a, "model_b": b, "winner": winner, "type": kind}


def some_votes(n, seed):
    r = random.Random(seed)
    return [vote(i, r.uniform(0, 20 * 60), r.choice(["sts", "retrieval"]), *r.sample(["x", "y", "z"], 2), r.choice([*ratings.SCORES])) for i in range(n)]


class Log:
    """A folder of vote files and a query that takes what is there and stops, again and again."""

    def __init__(self, spark, path, make, out="out"):
        self.spark, self.path, self.make, self.out, self.files = spark, path, make, path / out, 0
        (path / "in").mkdir()

    def add(self, rows):
        self.files += 1
        (self.path / "in" / f"{self.files}.json").write_text("\n".join(map(json.dumps, rows)))
        stream = self.make(live.votes(self.spark, str(self.path / "in"), SCHEMA, "30 minutes"))
        q = stream.writeStream.format("parquet").option("path", str(self.out)).option("checkpointLocation", str(self.path / "checkpoint")).trigger(availableNow=True).start()
        assert q.awaitTermination(180)
        return self.spark.read.parquet(str(self.out))


def rated(df):
    return {(r["task"], r["model"]): (pytest.approx(r["rating"]), r["num_battles"]) for r in df.collect()}


def test_live_elo_over_restarts(spark, tmp_path):
    """Votes of three files in mixed order, some repeated; each file is a query of its own on the same checkpoint."""
    rows = some_votes(60, 3)
    log = Log(spark, tmp_path, live.live_elo)
    log.add(rows[:25])
    log.add([*rows[25:50], *rows[10:15]])
    out = log.add([*rows[50:], *rows[:3], vote(10_000, 5 * HOUR)])
    batch = ratings.online_elo(spark.createDataFrame(rows, SCHEMA), "task_type")
    assert rated(live.standings(out)) == {k: (v[0].expected, v[1]) for k, v in rated(batch).items()}
    # The last vote waits for a later one.
    out = log.add([vote(10_001, 9 * HOUR)])
    whole = ratings.online_elo(spark.createDataFrame([*rows, vote(10_000, 5 * HOUR)], SCHEMA), "task_type")
    assert rated(live.standings(out)) == {k: (v[0].expected, v[1]) for k, v in rated(whole).items()}


def test_votes_too_late_are_left_out(spark, tmp_path):
    log = Log(spark, tmp_path, live.live_elo)
    log.add([vote(1, 0), vote(2, 5 * HOUR, winner="model_b")])
    log.add([vote(3, 60, winner="tie"), vote(4, 5 * HOUR - 60)])
    out = log.add([vote(5, 12 * HOUR)])
    want = ratings.online_elo(spark.createDataFrame([vote(1, 0), vote(4, 5 * HOUR - 60), vote(2, 5 * HOUR, winner="model_b")], SCHEMA), "task_type")
    assert rated(live.standings(out)) == {k: (v[0].expected, v[1]) for k, v in rated(want).items()}


def test_each_vote_once(spark, tmp_path):
    log = Log(spark, tmp_path, lambda s: s.select("battle_id", "type"))
    log.add([vote(1, 0), vote(2, 60), vote(1, 0)])
    out = log.add([vote(2, 60), vote(3, 120), vote(4, 2 * HOUR)])
    assert sorted(r["battle_id"] for r in out.collect()) == [1, 2, 3, 4]
    # By now the watermark stands at an hour and a half: this vote is later than it allows.
    out = log.add([vote(5, 180), vote(6, 2 * HOUR)])
    assert sorted(r["battle_id"] for r in out.collect()) == [1, 2, 3, 4, 6]


def test_hourly_counts(spark, tmp_path):
    log = Log(spark, tmp_path, lambda s: live.hourly(s).select("window.start", "type", "n"))
    kinds = ["leftvote", "tievote", "chat"]
    rows = [vote(i, i * 300, kind=kinds[i % 3]) for i in range(40)]
    log.add(rows[:20])
    log.add([*rows[20:], *rows[15:18]])
    out = log.add([vote(1000, 30 * HOUR), vote(1001, 0)])
    want = spark.createDataFrame(rows, SCHEMA).groupBy(F.window(F.timestamp_seconds("tstamp"), "1 hour").start.alias("start"), "type").count()
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, want.collect()))


def test_a_task_of_nothing(spark):
    assert ratings.online_elo(spark.createDataFrame([], SCHEMA), "task_type").count() == 0
    with pytest.raises(ValueError, match="unexpected winner"):
        ratings.Table().play("a", "b", "both")

"""Structured Streaming: vote ingestion, live counts, live Elo, sessions. The batch operators stay the truth for late votes."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.ratings import K, Table


def votes(spark: SparkSession, path: str, schema: str, late: str = "1 hour", key: str = "battle_id") -> DataFrame:
    """JSON votes with event time, each id once within the watermark."""
    d = spark.readStream.schema(schema).json(path).withColumn("ts", F.timestamp_seconds("tstamp"))
    return d.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def hourly(stream: DataFrame, key: str = "type") -> DataFrame:
    """Votes of each hour and kind; those later than the watermark don't count."""
    return stream.groupBy(F.window("ts", "1 hour"), key).agg(F.count(F.lit(1)).alias("n"))


#: A task's state: its table, and the votes whose time the watermark hasn't passed.
STATE = "model array<string>, rating array<double>, num_battles array<long>, at array<double>, id array<long>, a array<string>, b array<string>, winner array<string>"
LIVE = "task string, upto double, model string, rating double, num_battles long"


def live_elo(stream: DataFrame, task: str = "task_type", k: float = K) -> DataFrame:
    """stream(ts with a watermark, tstamp, battle_id, model_a, model_b, winner, task) -> a task's whole table each time
    that votes were added to it, with the time of the last one (``upto``).

    A vote waits in its task's state until the watermark passes its time; then waiting votes are played in order of time,
    ties by battle_id. So the tables are those of the batch fold over the votes up to then, in whatever order they came;
    a vote that comes later than the watermark allows is left out (and in the batch fold it isn't). Tasks are apart from
    each other; a state holds one rating per model and the votes of one watermark's delay.
    """

    def play(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        model, rating, battles, *waiting = state.get if state.exists else ([],) * 8
        rows = list(zip(*waiting, strict=True))
        for f in frames:
            rows += zip(f["tstamp"], f["battle_id"], f["model_a"], f["model_b"], f["winner"], strict=True)
        rows.sort(key=lambda r: (r[0], r[1]))
        passed = state.getCurrentWatermarkMs() / 1000
        ready = [r for r in rows if r[0] <= passed]
        table = Table(model, rating, battles, k)
        for _, _, a, b, winner in ready:
            table.play(a, b, winner)
        left = rows[len(ready) :]
        kept = table.columns()
        state.update((kept["model"], kept["rating"], kept["num_battles"], *(list(c) for c in (zip(*left, strict=True) if left else [()] * 5))))
        if left:
            state.setTimeoutTimestamp(max(int(left[0][0] * 1000) + 1, state.getCurrentWatermarkMs() + 1))
        if ready:
            yield pd.DataFrame({"task": key[0], "upto": ready[-1][0], **kept})

    rows = stream.select(F.col(task).alias("task"), "ts", "tstamp", F.col("battle_id").cast("long").alias("battle_id"), "model_a", "model_b", "winner")
    return rows.groupBy("task").applyInPandasWithState(play, LIVE, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def standings(tables: DataFrame) -> DataFrame:
    """The last table of each task out of all that ``live_elo`` gave."""
    last = tables.groupBy("task").agg(F.max("upto").alias("upto"))
    return tables.join(last, ["task", "upto"]).select("task", "model", "rating", "num_battles")


def sessions(rows: DataFrame, key: str, value: str, ts: str = "ts", gap: str = "30 minutes") -> DataFrame:
    """The values of each key's session in time order; works on streams (with a watermark) and tables alike."""
    grouped = rows.groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.sort_array(F.collect_list(F.struct(ts, value))).alias("_v"))
    return grouped.select(key, F.col("w.start").alias("started"), F.transform("_v", lambda s: s[value]).alias("history"))


def committed(stream: DataFrame, path: str, checkpoint: str, every: str | None = "5 minutes", by: str = "message_type") -> StreamingQuery:
    """Appends a stream's rows as JSON lines, one folder per message type, at fixed times; without ``every`` it takes what
    is there and ends. The checkpoint makes each row appear once, also after a restart."""
    out = stream.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).partitionBy(by)
    return (out.trigger(processingTime=every) if every else out.trigger(availableNow=True)).start()

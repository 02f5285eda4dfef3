"""Event records of chats and votes, as they go into the log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .requests import route


def chat_events(requests: DataFrame, task: str, fields: tuple[str, ...] = ("prompt",)) -> DataFrame:
    """One chat event for each of a request's two models, from (model_a, model_b, started, finished, ip, *fields)."""
    sides = F.posexplode(F.array(F.col("model_a"), F.col("model_b"))).alias("side", "model")
    d = requests.select("*", sides)
    time = lambda c: F.round(c, 4)
    return d.select(time("finished").alias("tstamp"), F.lit(task).alias("task_type"), F.lit("chat").alias("type"), "side", "model", time("started").alias("start"), time("finished").alias("finish"), "ip", *fields)


def vote_events(votes: DataFrame, task: str, fields: tuple[str, ...] = ("prompt",)) -> DataFrame:
    """One event per vote with both sides' fields (``0_``, ``1_``) and the log it goes to: battle, unless someone chose a
    model, then side_by_side. Columns: type, selector_a/b, model_a/b, tstamp, ip, *fields."""
    state = [F.col(c).alias(f"{side}_{c}") for side in (0, 1) for c in fields]
    names = [F.col("model_a").alias("0_model_name"), F.col("model_b").alias("1_model_name")]
    log = F.concat(F.lit(f"{task}_"), route("selector_a", "selector_b"))
    return votes.select(F.round("tstamp", 4).alias("tstamp"), F.lit(task).alias("task_type"), "type", F.array("selector_a", "selector_b").alias("models"), "ip", *names, *state, log.alias("message_type"))

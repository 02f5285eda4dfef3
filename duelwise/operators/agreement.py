"""Comparisons of two answers to the same questions, and of two lists position by position."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranks import positions


def answers(left: DataFrame, right: DataFrame, key: str, value: str) -> DataFrame:
    """key, left_answer, right_answer, agree; a question that only one side answered is no agreement."""
    x, y = (t.select(key, F.col(value).alias(f"{side}_answer")) for t, side in ((left, "left"), (right, "right")))
    agree = F.coalesce(F.col("left_answer") == F.col("right_answer"), F.lit(False))
    return x.join(y, key, "full_outer").withColumn("agree", agree)


def positional(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """One row: n_equal positions, n_left and n_right rows, for lists in order of a unique key."""
    x, y = (positions(t.select(key), key, "pos").select("pos", F.col(key).alias(f"{side}_key")) for t, side in ((left, "left"), (right, "right")))
    same = F.count_if(F.col("left_key") == F.col("right_key")).alias("n_equal")
    return x.join(y, "pos", "full_outer").agg(same, F.count("left_key").alias("n_left"), F.count("right_key").alias("n_right"))

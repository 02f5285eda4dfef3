"""Pairwise tables in long form; pivoting is left to presentation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def both_seats(battles: DataFrame) -> DataFrame:
    """model, opponent, won: each battle from either seat."""
    sides = F.array(F.struct(F.col("model_a").alias("model"), F.col("model_b").alias("opponent"), (F.col("winner") == "model_a").alias("won")), F.struct(F.col("model_b").alias("model"), F.col("model_a").alias("opponent"), (F.col("winner") == "model_b").alias("won")))
    return battles.select(F.explode(sides).alias("s"), "winner").select("s.*", "winner")


def value_counts(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def win_fractions(battles: DataFrame) -> DataFrame:
    """model, opponent, fraction, games over battles that weren't ties."""
    d = both_seats(battles.where(~F.col("winner").contains("tie")))
    return d.groupBy("model", "opponent").agg(F.avg(F.col("won").cast("double")).alias("fraction"), F.count(F.lit(1)).alias("games"))


def win_fractions_compat(battles: DataFrame) -> DataFrame:
    """model, opponent, fraction for every pair of models that had a battle without a tie.

    Four count tables, aligned by label, make a cell: wins in either seat over battles in either order. A table has rows
    for the models that are first in it and columns for those that are second; a cell outside of any of the four is
    null, and so is one without battles. Tables are turned over by joining them to themselves with the seats changed.
    """
    d = battles.where(~F.col("winner").contains("tie"))
    won = [F.count_if(F.col("winner") == w).alias(n) for w, n in (("model_a", "a_won"), ("model_b", "b_won"))]
    counts = d.groupBy(F.col("model_a").alias("model"), F.col("model_b").alias("opponent")).agg(*won, F.count(F.lit(1)).alias("n"))
    turned = counts.select(F.col("opponent").alias("model"), F.col("model").alias("opponent"), F.col("b_won").alias("t_won"), F.col("n").alias("t_n"))
    cells = counts.drop("b_won").join(turned, ["model", "opponent"], "full_outer")
    # Which tables a model has a row and a column in.
    has = lambda seat, w: F.max((F.col("seat") == seat) & F.col("w").isin(*w))
    seats = d.select(F.explode(F.array(F.struct(F.lit("a").alias("seat"), F.col("model_a").alias("m")), F.struct(F.lit("b").alias("seat"), F.col("model_b").alias("m")))).alias("s"), F.col("winner").alias("w")).select("s.*", "w")
    any_, a, b = ("model_a", "model_b"), ("model_a",), ("model_b",)
    known = seats.groupBy("m").agg((has("a", a) & has("b", b) & has("a", any_) & has("b", any_)).alias("row"), (has("b", a) & has("a", b) & has("b", any_) & has("a", any_)).alias("column"))
    grid = known.select(F.col("m").alias("model"), "row").crossJoin(F.broadcast(known.select(F.col("m").alias("opponent"), "column")))
    sums = [F.coalesce(x, F.lit(0)) + F.coalesce(y, F.lit(0)) for x, y in (("a_won", "t_won"), ("n", "t_n"))]
    fraction = F.when(F.col("row") & F.col("column") & (sums[1] > 0), sums[0] / sums[1])
    return grid.join(cells, ["model", "opponent"], "left").select("model", "opponent", fraction.alias("fraction"))


def average_win_rates(battles: DataFrame) -> DataFrame:
    return win_fractions(battles).groupBy("model").agg(F.avg("fraction").alias("avg_win_rate"), F.count(F.lit(1)).alias("opponents"))


def unordered_counts(battles: DataFrame) -> DataFrame:
    return battles.groupBy(F.least("model_a", "model_b").alias("model_1"), F.greatest("model_a", "model_b").alias("model_2")).agg(F.count(F.lit(1)).alias("n"))


def votes_per_model(battles: DataFrame, strict: bool = False) -> DataFrame:
    """model, num_battles over both seats. ``strict``: a model seen in one seat only is an error."""
    seats = battles.select(F.explode(F.array(F.struct(F.col("model_a").alias("model"), F.lit(1).alias("a")), F.struct(F.col("model_b").alias("model"), F.lit(0).alias("a")))).alias("s")).select("s.*")
    d = seats.groupBy("model").agg(F.count(F.lit(1)).alias("num_battles"), F.sum("a").alias("as_a"))
    if strict:
        bad = (F.col("as_a") == 0) | (F.col("as_a") == F.col("num_battles"))
        d = d.withColumn("num_battles", F.when(bad, F.raise_error(F.concat(F.lit("one seat only: "), "model"))).otherwise(F.col("num_battles")))
    return d.select("model", "num_battles")


def ranked(df: DataFrame, value: str, key: str = "model") -> DataFrame:
    """rank 1, 2, ... by falling value, ties by key. Meant for tables of models: one row per model."""
    return df.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(value), key)))


def first_seen(battles: DataFrame) -> DataFrame:
    """model, seen_id: numbered from 0 by first appearance in (tstamp, battle_id), seat A before seat B."""
    seats = battles.select("tstamp", "battle_id", F.posexplode(F.array("model_a", "model_b")).alias("seat", "model"))
    return ranked_by(seats.groupBy("model").agg(F.min(F.struct("tstamp", "battle_id", "seat")).alias("_at")), "_at", "seen_id")


def ranked_by(df: DataFrame, order: str, name: str) -> DataFrame:
    """0-based numbers of an aggregate of few rows."""
    return df.withColumn(name, F.row_number().over(Window.orderBy(order)) - 1).drop(order)

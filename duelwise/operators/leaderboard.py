"""Leaderboard tables: ratings joined to model metadata, display strings, totals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.display import CONSOLE


def first_rows(meta: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """One row of each key: the first by ``order``, without one the smallest of all its columns."""
    least = F.min(F.struct(*([order] if order else []), *[c for c in meta.columns if c not in (key, order)])).alias("_row")
    return meta.groupBy(key).agg(least).select(key, *(F.col(f"_row.{c}").alias(c) for c in meta.columns if c != key))


def leaderboard(ratings: DataFrame, full: DataFrame, meta: DataFrame, key: str = "model", order: str | None = None) -> DataFrame:
    """One row per rated model; unknown metadata is N/A, a model without full rating has 0. Of several metadata rows of a
    model the first counts (``first_rows``)."""
    other = full.select(key, F.col("rating").alias("rating_full"))
    meta = first_rows(meta, key, order)
    columns = [c for c in meta.columns if c not in (key, order)]
    d = ratings.join(other, key, "left").join(meta, key, "left")
    return d.select(*ratings.columns, F.coalesce("rating_full", F.lit(0.0)).alias("rating_full"), *(F.coalesce(F.col(c).cast("string"), F.lit("N/A")).alias(c) for c in columns))


#: The published table's columns in order, by the metadata's names; averages bear their benchmark's name.
AVERAGES = {"overall": "Overall Avg", "retrieval": "Retrieval Avg", "clustering": "Clustering Avg", "sts": "STS Avg"}
ABOUT = {"license": "License", "organization": "Organization", "link": "Link"}


def published_columns(benchmark: str = "") -> dict[str, str]:
    """Metadata names to headers: x_overall to "X Overall Avg" for a benchmark X."""
    before = f"{benchmark.lower()}_" if benchmark else ""
    return {f"{before}{k}": f"{benchmark} {v}".strip() for k, v in AVERAGES.items()} | ABOUT


def published(ratings: DataFrame, full: DataFrame, meta: DataFrame, key: str = "model", order: str | None = None, benchmark: str = "", title: str = "Elo rating") -> DataFrame:
    """The published table: key, Model, both ratings under ``title``, then ``published_columns``; other metadata is dropped.

    A model without metadata has N/A in each column, one whose metadata lacks a column is empty there, one without full
    rating has 0; models without rating are left out. Columns that the metadata lacks altogether are empty.
    """
    meta = first_rows(meta.withColumn("_known", F.lit(True)), key, order)
    other = full.select(key, F.col("rating").alias("_full"))
    d = ratings.select(key, "rating").join(other, key, "left").join(meta, key, "left")
    shown = lambda c: F.when(F.col("_known").isNull(), "N/A").otherwise(F.col(c).cast("string") if c in meta.columns else F.lit(None).cast("string"))
    scores = [F.col("rating").alias(f"{title} (anony)"), F.coalesce("_full", F.lit(0.0)).alias(f"{title} (full)")]
    return d.select(F.col(key).alias("key"), F.col(key).alias("Model"), *scores, *(shown(c).alias(name) for c, name in published_columns(benchmark).items())).orderBy(F.desc(f"{title} (anony)"), "key")


def statistics(rated: DataFrame, samples: DataFrame, counts: DataFrame, most: int = 25, key: str = "model") -> DataFrame:
    """The ``most`` best rated models with their battles and the spread of their sampled ratings (key, rating_q025,
    rating_q975, variance); models without samples or battles have nulls or 0."""
    d = rated.select(key, "rating").join(samples.select(key, "variance", "rating_q025", "rating_q975"), key, "left").join(counts.select(key, "num_battles"), key, "left")
    return d.withColumn("num_battles", F.coalesce("num_battles", F.lit(0).cast("long"))).orderBy(F.desc("rating"), key).limit(most)


def with_averages(board: DataFrame, averages: DataFrame, key: str = "model", by_position: bool = False, order: str = "rating") -> DataFrame:
    """Adds benchmark averages by key; ``by_position`` gives the best row the first one of ``averages`` (in order of its
    column ``place``, from 0) and so on, whatever their keys. Models are few rows."""
    if not by_position:
        return board.join(averages, key, "left")
    place = F.row_number().over(Window.orderBy(F.desc(order), key)) - 1
    return board.withColumn("place", place).join(averages.drop(key), "place", "left").drop("place")


def mean_or_zero(rows: DataFrame, keys: DataFrame, value: str, key: str) -> DataFrame:
    """key, average: one row per listed key, 0 for one without values."""
    found = rows.groupBy(key).agg(F.avg(value).alias("average"))
    return keys.join(found, key, "left").select(key, F.coalesce("average", F.lit(0.0)).alias("average"))


def console_lines(df: DataFrame, value: str = "rating", key: str = "model") -> DataFrame:
    """rank and one line of text per model, the best first; halves are rounded to even."""
    rank = F.row_number().over(Window.orderBy(F.desc(value), key))
    return df.select(rank.alias("rank"), F.format_string(CONSOLE, rank, F.col(key), F.bround(value, 0).cast("long")).alias("line"))


def interval_strings(df: DataFrame) -> DataFrame:
    """'+u/-l' with halves rounded to even, and error bars."""
    up, down = F.bround(F.col("rating_q975") - F.col("rating"), 0), F.bround(F.col("rating") - F.col("rating_q025"), 0)
    return df.withColumns({"ci": F.format_string("+%d/-%d", up.cast("int"), down.cast("int")), "error_y": F.col("rating_q975") - F.col("rating"), "error_y_minus": F.col("rating") - F.col("rating_q025"), "rating_rounded": F.bround("rating", 2)})


def error_bars(rated: DataFrame, samples: DataFrame, most: int = 25, key: str = "model") -> DataFrame:
    """model, lower, rating, upper, error_y, error_y_minus, rating_rounded of the ``most`` best; a model without sampled
    ratings has no bars."""
    q = samples.select(key, "rating_q025", "rating_q975")
    d = interval_strings(rated.select(key, "rating").join(q, key, "left")).orderBy(F.desc("rating"), key).limit(most)
    return d.select(key, F.col("rating_q025").alias("lower"), "rating", F.col("rating_q975").alias("upper"), "error_y", "error_y_minus", "rating_rounded")


def medal_rows(df: DataFrame, value: str = "rating", key: str = "model") -> DataFrame:
    """rank and a markdown row; ranks 1 to 3 carry medals."""
    rank = F.row_number().over(Window.orderBy(F.desc(value), key))
    medal = F.when(F.col("rank") == 1, "\U0001F947 ").when(F.col("rank") == 2, "\U0001F948 ").when(F.col("rank") == 3, "\U0001F949 ").otherwise("")
    d = df.withColumn("rank", rank)
    return d.select("rank", key, F.concat(F.lit("| "), F.col("rank").cast("string"), F.lit(" | "), medal, F.col(key), F.lit(" | "), F.floor(F.col(value) + 0.5).cast("string"), F.lit(" |")).alias("line"))


def totals(votes: DataFrame) -> DataFrame:
    """Votes (each counted at two models) and models."""
    return votes.agg(F.expr("sum(num_battles) div 2").alias("votes"), F.count(F.lit(1)).alias("models"))

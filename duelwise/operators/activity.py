"""Activity statistics over the event log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ZONE = "America/Los_Angeles"


def daily_counts(events: DataFrame, ts: str = "ts") -> DataFrame:
    day = F.to_date(F.from_utc_timestamp(ts, ZONE))
    return events.groupBy(day.alias("day")).agg(F.count(F.lit(1)).alias("n"))


def is_anonymous_vote() -> Column:
    return F.col("type").isin("leftvote", "rightvote", "tievote", "bothbad_vote") & (F.element_at("models", 1) == "")


def anonymous_votes(activity: DataFrame) -> DataFrame:
    """Votes of the activity log (type, models) whose first model was hidden."""
    return activity.where(is_anonymous_vote())


def daily_kinds(activity: DataFrame, ts: str = "ts") -> DataFrame:
    """day, chats, anonymous votes: both series from one pass; a day with neither is left out."""
    d = activity.groupBy(F.to_date(F.from_utc_timestamp(ts, ZONE)).alias("day")).agg(F.count_if(F.col("type") == "chat").alias("n_chats"), F.count_if(is_anonymous_vote()).alias("n_votes"))
    return d.where("n_chats > 0 OR n_votes > 0")


def resumed(rows: DataFrame, done: int, position: str = "pos") -> DataFrame:
    """Rows after the last position that is done."""
    return rows.where(F.col(position) > done)


def progress(rows: DataFrame, *by: str, size: str = "text") -> DataFrame:
    """Rows and characters so far, in all or by key."""
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.sum(F.length(size)), F.lit(0)).cast("long").alias("n_chars"))


def trailing(events: DataFrame, seconds: float, t: str = "tstamp") -> DataFrame:
    """Rows later than so many seconds before the last row's time."""
    last = events.agg(F.max(t).alias("_last"))
    return events.join(F.broadcast(last), F.col(t) > F.col("_last") - F.lit(seconds)).drop("_last")


def merged_counts(events: DataFrame, key: str, windows: dict[str, float], t: str = "tstamp") -> DataFrame:
    """key and counts over all time and each trailing window, in one pass; keys absent from a window are left out."""
    last = events.agg(F.max(t).alias("_last"))
    d = events.join(F.broadcast(last))
    counts = {name: F.count_if(F.col(t) > F.col("_last") - F.lit(s)).alias(name) for name, s in windows.items()}
    out = d.groupBy(key).agg(F.count(F.lit(1)).alias("all_time"), *counts.values())
    return out.where(" AND ".join(f"{name} > 0" for name in windows))


def last_day_hours(events: DataFrame, t: str = "tstamp") -> DataFrame:
    """hour 1 to 24 and n: hours of the last day, counted from the earliest row of the last 24 hours; none is left out."""
    d = trailing(events, 86400.0, t)
    base = d.agg(F.min(t).alias("_base"))
    hours = d.join(F.broadcast(base)).groupBy((F.floor((F.col(t) - F.col("_base")) / 3600) + 1).cast("int").alias("hour")).agg(F.count(F.lit(1)).alias("n"))
    return events.sparkSession.range(1, 25).select(F.col("id").cast("int").alias("hour")).join(hours, "hour", "left").select("hour", F.coalesce("n", F.lit(0)).alias("n"))

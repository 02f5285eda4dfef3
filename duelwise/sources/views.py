
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table

MODELS = 8


def battles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """battle_id, model_a, model_b, winner, judge, anony, tstamp."""
    e = table(spark, sf_dir, "events").where("event_type <> 'error'")
    return e.selectExpr(
        "event_id AS battle_id", f"concat('m', user_id % {MODELS}) AS model_a", f"concat('m', (user_id % {MODELS} + 1 + event_id % {MODELS - 1}) % {MODELS}) AS model_b",
        "CASE event_type WHEN 'click' THEN 'model_a' WHEN 'view' THEN 'model_b' WHEN 'purchase' THEN 'tie' WHEN 'signup' THEN 'tie (bothbad)' END AS winner",
        "user_id AS judge", "event_id % 5 <> 0 AS anony", "unix_micros(cast(ts AS timestamp)) / 1000000D AS tstamp",
    )


BATTLES_SQL = """battles AS (
  SELECT event_id AS battle_id, 'm' || (user_id % 8) AS model_a, 'm' || ((user_id % 8 + 1 + event_id % 7) % 8) AS model_b,
    CASE event_type WHEN 'click' THEN 'model_a' WHEN 'view' THEN 'model_b' WHEN 'purchase' THEN 'tie' WHEN 'signup' THEN 'tie (bothbad)' END AS winner,
    user_id AS judge, event_id % 5 <> 0 AS anony, epoch_us(ts) / 1000000.0::DOUBLE AS tstamp
  FROM events WHERE event_type <> 'error')"""


def votes_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A raw vote log with every kind of defect that the cleaner judges."""
    e = table(spark, sf_dir, "events")
    return e.selectExpr(
        "event_id", "element_at(array('retrieval', 'clustering', 'STS'), cast(event_id % 3 + 1 AS int)) AS task_type",
        "CASE event_type WHEN 'click' THEN 'leftvote' WHEN 'view' THEN 'rightvote' WHEN 'purchase' THEN 'tievote' WHEN 'signup' THEN 'bothbadvote' ELSE 'share' END AS type",
        "unix_micros(cast(ts AS timestamp)) / 1000000D AS tstamp", "user_id AS ip",
        "CASE WHEN event_id % 19 = 0 THEN 'old-m' ELSE 'm' END || user_id % 8 AS hidden_a", "'m' || ((user_id % 8 + 1 + event_id % 7) % 8) AS hidden_b",
    ).selectExpr(
        "* EXCEPT (hidden_a)", "CASE WHEN event_id % 35 = 0 THEN ' ' ELSE hidden_a END AS hidden_a", "CASE WHEN event_id % 5 <> 0 THEN '' WHEN event_id % 11 = 0 THEN '' WHEN event_id % 13 = 0 THEN 'other' WHEN event_id % 17 = 0 THEN '### Model A: ' || hidden_a ELSE hidden_a END AS public_a",
        "CASE WHEN event_id % 5 <> 0 THEN '' ELSE hidden_b END AS public_b",
    )


VOTES_SQL = """raw AS (
  SELECT event_id, ['retrieval', 'clustering', 'STS'][(event_id % 3 + 1)::INT] AS task_type,
    CASE event_type WHEN 'click' THEN 'leftvote' WHEN 'view' THEN 'rightvote' WHEN 'purchase' THEN 'tievote' WHEN 'signup' THEN 'bothbadvote' ELSE 'share' END AS type,
    epoch_us(ts) / 1000000.0::DOUBLE AS tstamp, user_id AS ip,
    CASE WHEN event_id % 19 = 0 THEN 'old-m' ELSE 'm' END || (user_id % 8) AS hidden_a, 'm' || ((user_id % 8 + 1 + event_id % 7) % 8) AS hidden_b
  FROM events),
votes AS (
  SELECT * REPLACE (CASE WHEN event_id % 35 = 0 THEN ' ' ELSE hidden_a END AS hidden_a), CASE WHEN event_id % 5 <> 0 THEN '' WHEN event_id % 11 = 0 THEN '' WHEN event_id % 13 = 0 THEN 'other' WHEN event_id % 17 = 0 THEN '### Model A: ' || hidden_a ELSE hidden_a END AS public_a,
    CASE WHEN event_id % 5 <> 0 THEN '' ELSE hidden_b END AS public_b
  FROM raw)"""

"""Mixing sources to target weights: hash-random order, distributed prefix sums of words, exact budgets, epochs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, table

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
EPOCHS = 3


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """source, source_size -> also weight and target.

    Sources in order of code points, null last, take the weights in turn and share the sum of all sizes; a target
    stops at ``epochs`` times its source's size, and what is over is shared again by weight. With the sources in
    ascending order of capacity per weight, those whose capacity lies below the level that the rest would get are full.
    """
    total, by_name = Window.partitionBy(F.lit(0)), Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    w = F.array(*[F.lit(x) for x in weights])
    ranked = sizes.withColumn("weight", w[(F.row_number().over(by_name) - 1) % len(weights)]).withColumn("cap", F.col("source_size") * epochs)
    fill = Window.partitionBy(F.lit(0)).orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    ranked = ranked.select(
        "*",
        F.sum("source_size").over(total).alias("all"),
        F.sum("weight").over(total).alias("weights"),
        F.coalesce(F.sum("cap").over(fill), F.lit(0)).alias("cap_before"),
        F.coalesce(F.sum("weight").over(fill), F.lit(0)).alias("weight_before"),
    )
    level = (F.col("all") - F.col("cap_before")).cast("double") / (F.col("weights") - F.col("weight_before"))
    full = F.col("cap") <= level * F.col("weight")
    # Fullness is monotone in this order, so the level of the first source that is not full holds for all after it.
    ranked = ranked.withColumn("level", F.min(F.when(~full, F.struct("cap_before", level.alias("level")))).over(total)["level"])
    target = F.when(full, F.col("cap").cast("double")).otherwise(F.col("level") * F.col("weight"))
    return ranked.select("source", "source_size", "weight", target.alias("target"))


#: Tables of up to so many sources are sent to every task; larger ones are joined by shuffle. Results are the same.
BROADCAST_SOURCES = 50_000


def mix_shares(docs: DataFrame, key: str = "doc_id", group: str = "source", text: str = "text", seed: str = "mix", weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS, keep_text: bool = True, scratch: Scratch | None = None) -> DataFrame:
    """docs with size, source_size, target and taken (words that the mix takes of the document, repeats counted).

    Each document gets a hash-random key; a source is a range of keys, cut into so many ranges that each holds about
    the square root of all rows. Sums of the ranges give each range its offset; a window inside the range does the
    rest, so no task sees a source whole. Whole epochs take each document once; the last one stops exactly at the
    rounded target, inside a document if need be. Words are counted in one pass, whose table is written.

    Null text has size 0 and takes 0; a null source is a source; rows that agree in key, size and id are ordered
    arbitrarily, which no result shows. An empty table gives an empty one. Other columns pass through unchanged
    (a column that bears a name of the result is replaced; the text goes if ``keep_text`` is false).
    """
    scratch = scratch or Scratch(docs.sparkSession, "mix")
    d = docs.drop("size", "source_size", "target", "taken")
    digest = F.md5(F.concat_ws("-", F.lit(seed), F.coalesce(F.col(key).cast("string"), F.lit(""))))
    words = F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
    kept = [c for c in d.columns if keep_text or c != text]
    d = scratch.save(d.select(*[F.col(c) for c in kept], words.alias("size"), F.conv(F.substring(digest, 1, 12), 16, 10).cast("long").alias("_mix_k")), "sized")
    sizes = d.groupBy(F.col(group).alias("source")).agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    goal = scratch.save(_goals(sizes, weights, epochs).select(F.col("source").alias("_mix_s"), "source_size", "target", F.col("ranges").alias("_mix_n")), "goals")
    goal = F.broadcast(goal) if goal.count() <= BROADCAST_SOURCES else goal
    d = d.join(goal, F.col(group).eqNullSafe(F.col("_mix_s"))).withColumn("_mix_r", F.floor(F.col("_mix_k") * F.col("_mix_n") / F.lit(float(1 << 48))))
    part = d.groupBy("_mix_s", "_mix_r").agg(F.sum("size").alias("_mix_sum"))
    before = Window.partitionBy("_mix_s").orderBy("_mix_r").rowsBetween(Window.unboundedPreceding, -1)
    part = part.select(F.col("_mix_s").alias("_mix_s2"), F.col("_mix_r").alias("_mix_r2"), F.coalesce(F.sum("_mix_sum").over(before), F.lit(0)).alias("_mix_base"))
    inside = Window.partitionBy("_mix_s", "_mix_r").orderBy("_mix_k", F.col(key), "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = d.withColumn("_mix_in", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    placed = placed.join(part, F.col("_mix_s").eqNullSafe(F.col("_mix_s2")) & (F.col("_mix_r") == F.col("_mix_r2")))
    budget = F.round("target").cast("long")
    rounds = F.when(F.col("source_size") > 0, F.floor(budget / F.greatest(F.col("source_size"), F.lit(1)))).otherwise(0).cast("long")
    rest = budget - rounds * F.col("source_size")
    part_taken = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("_mix_base") - F.col("_mix_in")))
    return placed.withColumn("taken", (rounds * F.col("size") + part_taken).cast("long")).select(*kept, "size", "source_size", "target", "taken")


def _goals(sizes: DataFrame, weights: tuple[int, ...], epochs: int) -> DataFrame:
    n = Window.partitionBy(F.lit(0))
    ranged = sizes.withColumn("ranges", F.ceil(F.col("n") / F.greatest(F.lit(500.0), F.sqrt(F.sum("n").over(n)))))
    goal = targets(sizes.drop("n"), weights, epochs).withColumnRenamed("source", "_g")
    return ranged.drop("source_size").join(goal, F.col("source").eqNullSafe(F.col("_g"))).drop("_g", "n")


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix_shares(docs, keep_text=False).select("doc_id", "size", "source_size", "target", "taken")


SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5('mix-' || coalesce(doc_id::VARCHAR, '')), 1, 12))::BIGINT AS k
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w, 3 * source_size AS cap FROM s),
f AS (SELECT *, sum(source_size) OVER () AS total, sum(w) OVER () AS ws,
        coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cb,
        coalesce(sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS wb
      FROM r),
l AS (SELECT *, (total - cb)::DOUBLE / (ws - wb)::DOUBLE AS lv FROM f),
t AS (SELECT *, (SELECT arg_min(lv, cb) FROM l WHERE cap > lv * w) AS level FROM l),
g AS (SELECT source, source_size, CASE WHEN cap <= lv * w THEN cap::DOUBLE ELSE level * w END AS target FROM t),
p AS (SELECT d.*, g.source_size, g.target, round(g.target)::BIGINT AS budget,
        coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
      FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target,
  (CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END * size
   + greatest(0, least(size, budget - CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END * source_size - before)))::BIGINT AS taken
FROM p
"""

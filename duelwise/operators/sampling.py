"""Seeded draws by a portable hash, so that every engine draws the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def draw(*parts: Column) -> Column:
    return F.md5(F.concat_ws("-", *[p.cast("string") for p in parts]))


def number(*parts: Column) -> Column:
    """60 bits of the draw."""
    return F.conv(F.substring(draw(*parts), 1, 15), 16, 10).cast("long")


def picks(n: Column, m: Column, *parts: Column) -> Column:
    """``m`` different places out of 0 .. n - 1 in drawn order (all of them, if fewer), at a cost of m, whatever n.

    One draw for each j of the last m places: a place up to j, or j itself if that one is taken already; every set is as
    likely as any other. The set is then put in order of a further draw.
    """
    m = F.least(m, n)
    last = F.when(m > 0, F.sequence(n - m, n - 1)).otherwise(F.array().cast("array<bigint>"))

    def take(held: Column, j: Column) -> Column:
        at = number(*parts, j) % (j + 1)
        return F.array_append(held, F.when(F.array_contains(held, at), j).otherwise(at))

    taken = F.aggregate(last, F.array().cast("array<bigint>"), take)
    return F.transform(F.sort_array(F.transform(taken, lambda x: F.struct(draw(*parts, F.lit("order"), x).alias("h"), x.alias("x")))), lambda s: s["x"])


#: Hex digits of a hash that items are dealt to ranges by.
DIGITS = 4


def placed(items: DataFrame, key: str, name: str, by: str | None = None) -> DataFrame:
    """items with 0-based places in order of (the first digits of the key's hash, key), within each ``by`` if given.

    A window numbers the items of one hash range; ranges, of which there is a fixed number, have offsets by their counts.
    """
    within = [by] if by else []
    d = items.withColumn("_range", F.substring(F.md5(F.col(key).cast("string")), 1, DIGITS))
    before = F.sum("_n").over(Window.partitionBy(*(within or [F.lit(0)])).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    offsets = d.groupBy(*within, "_range").agg(F.count(F.lit(1)).alias("_n")).withColumn("_before", F.coalesce(before, F.lit(0))).drop("_n")
    inside = F.row_number().over(Window.partitionBy(*within, "_range").orderBy(key)) - 1
    return d.withColumn(name, inside.cast("long")).join(offsets, [*within, "_range"]).withColumn(name, F.col(name) + F.col("_before")).drop("_range", "_before")


def pick_per_draw(draws: DataFrame, items: DataFrame, n: int, draw_key: str, item_key: str, seed: str = "s") -> DataFrame:
    """draw_key, place, item_key: ``n`` different items for each draw (all, if fewer), in drawn order.

    A draw picks places, the items are joined by theirs: no task holds the list.
    """
    listed = placed(items.select(item_key).distinct(), item_key, "_at")
    total = listed.agg(F.count(F.lit(1)).alias("_of"))
    picked = draws.join(F.broadcast(total)).select(draw_key, F.posexplode(picks(F.col("_of"), F.lit(n).cast("long"), F.lit(seed), F.col(draw_key))).alias("place", "_at"))
    return picked.join(listed, "_at").select(draw_key, "place", item_key)


def nested_draws(draws: DataFrame, items: DataFrame, draw_key: str, category: str, item: str, categories: tuple[int, int] = (2, 5), per_category: tuple[int, int] = (2, 8), seed: str = "nested") -> DataFrame:
    """draw_key, place, category, n_categories, item_place, item: for each draw some different categories, and of each
    some different items.

    Both numbers are drawn between their bounds; a category with fewer items than the upper bound gives up to all of
    them, one with fewer than the lower gives all. Work and rows are those of what is drawn: neither categories nor items
    are laid out per draw. Repeated items of a category count once.
    """
    listed = placed(items.select(category, item).distinct(), item, "_place", category)
    sizes = placed(listed.groupBy(category).agg(F.count(F.lit(1)).alias("_size")), category, "_at")
    total = sizes.agg(F.count(F.lit(1)).alias("_of"))
    between = lambda low, high, *parts: F.lit(low) + number(F.lit(seed), *parts) % F.greatest(high - low + 1, F.lit(1))
    d = draws.join(F.broadcast(total))
    d = d.withColumn("n_categories", F.least(between(categories[0], F.lit(categories[1]).cast("long"), F.lit("n"), F.col(draw_key)), F.col("_of")))
    d = d.select(draw_key, "n_categories", F.posexplode(picks(F.col("_of"), F.col("n_categories"), F.lit(seed), F.lit("category"), F.col(draw_key))).alias("place", "_at")).join(sizes, "_at")
    wanted = between(per_category[0], F.least(F.col("_size"), F.lit(per_category[1])), F.lit("k"), F.col(draw_key), F.col(category))
    chosen = picks(F.col("_size"), wanted, F.lit(seed), F.lit("item"), F.col(draw_key), F.col(category))
    d = d.select(draw_key, "n_categories", "place", category, F.posexplode(chosen).alias("item_place", "_place"))
    return d.join(listed, [category, "_place"]).select(draw_key, "place", category, "n_categories", "item_place", item)


def first_by_hash(df: DataFrame, key: str, seed: str, n: int) -> DataFrame:
    return df.select(key, draw(F.lit(seed), F.col(key)).alias("h")).orderBy("h", key).limit(n).select(key)


def keep_first(df: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key in input order."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("_r = 1").drop("_r")


def shuffled(values: Column, seed: str, key: Column) -> Column:
    """The elements of a row's array in hashed order."""
    return F.transform(F.sort_array(F.transform(values, lambda x: F.struct(draw(F.lit(seed), key, x).alias("h"), x.alias("x")))), lambda s: s["x"])

"""Exact Jaccard join on word shingles: size-aware, with heavy and light sets.

Small (light) sets enumerate all subsets of the fixed sizes that a link would have to share and meet on them. Large
(heavy) sets scan inverted lists; a list holds the sets that have the shingle among their first tokens (one more than
a partner may miss), the corpus' frequent shingles ordered last. The boundary between both is the size with the lowest
estimated cost, from the counts of small sizes and the mean list length.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, arrow_batch, arrow_schema, bound_batches, partitions, shingle_sets, table, text_chunks
from .graph import components

WIDTH, NUM, DEN = 5, 80, 100
#: Shingles whose place in the order follows their frequency; all others count as rare. It shapes cost, not results.
FREQUENT = 1 << 15
#: Largest boundary that is weighed for light sets.
LIGHT_MOST = 12
#: Members of one star that one task verifies.
STAR = 400
#: Members of a star that share a shingle beside its centre and are paired by it; one that more have counts as the centre's.
BESIDE = 32
#: Pairs of a star's members that one task weighs.
WEIGHED = 1 << 22


def need(a: int, b: int) -> int:
    """Shared elements that sets of these sizes need for a link."""
    return -(-NUM * (a + b) // (DEN + NUM))


def least_size(n: int) -> int:
    return -(-NUM * n // DEN)


def subset_sizes(n: int, boundary: int) -> list[int]:
    """Sizes of shared subsets by which a light set of n finds different light sets."""
    return sorted({need(n, t) for t in range(least_size(n), min(boundary, n * DEN // NUM) + 1) if need(n, t) < max(n, t)})


def choose_boundary(counts: dict[int, int], mean_list: float) -> int:
    """The size up to which enumerating subsets costs less than scanning lists."""
    def price(x: int) -> float:
        light = sum(c * sum(comb(n, o) for o in subset_sizes(n, x)) for n, c in counts.items() if n <= x)
        heavy = sum(c * (n - least_size(n) + 1) * (1 + mean_list) for n, c in counts.items() if n >= least_size(x + 1))
        return light + heavy

    return min(range(LIGHT_MOST + 1), key=price)


#: Bits of a set's first name.
NAME = 64


def names_of(s: np.ndarray, bits: int = NAME) -> tuple[int, int]:
    """Two names of 64 bits; the first one has so many of them."""
    both = xxhash.xxh3_128_intdigest(s.tobytes())
    return (both & ((1 << bits) - 1)) - (1 << 63), (both >> 64) - (1 << 63)


def node_of(s: np.ndarray, shared: frozenset[int], bits: int = NAME) -> int:
    """The set's first name, or its second one if different sets share the first."""
    first, second = names_of(s, bits)
    return second if first in shared else first


PROFILE = "kind int, a long, b long, n int, fp long, twin long"


def profile(docs: DataFrame, key: str, text: str, bits: int = NAME) -> DataFrame:
    """kind 0: (key, first name of the set, its size, hash of the text, second name) per row. kind 1: (shingle, count) of shingles that come up often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, held, size = arrow_schema(PROFILE), [], 0

        def often() -> pa.RecordBatch:
            token, count = np.unique(np.concatenate(held), return_counts=True)
            token, count = token[count > 2].view(np.int64), count[count > 2]
            m = len(token)
            return arrow_batch(schema, [np.ones(m, np.int32), token, count, np.zeros(m, np.int32), np.zeros(m, np.int64), np.zeros(m, np.int64)])

        for batch in batches:
            keys, fps = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            for i, j, buf, off in text_chunks(batch.column(1)):
                nodes, ns = [], []
                for s in shingle_sets(buf, off, WIDTH):
                    nodes.append(names_of(s, bits) if len(s) else (None, None))
                    ns.append(len(s))
                    held.append(s)
                    size += len(s)
                first, second = zip(*nodes, strict=True)
                yield arrow_batch(schema, [np.zeros(j - i, np.int32), keys[i:j], first, ns, fps[i:j], second])
                if size > 1 << 20:
                    yield often()
                    held, size = [], 0
        if held:
            yield often()

    return docs.select(F.col(key).cast("long"), F.col(text), F.xxhash64(text)).mapInArrow(run, PROFILE)


LISTS = "token long, node long, n int, last long"


def lists(docs: DataFrame, text: str, frequent: np.ndarray, rank: np.ndarray, boundary: int, name: Callable[[np.ndarray], int]) -> DataFrame:
    """Inverted lists of different sets: (token, node, size, place of the set's last listed token in the order)."""
    spark = docs.sparkSession
    known = spark.sparkContext.broadcast((frequent, rank))

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, seen = arrow_schema(LISTS), set()
        often, place = known.value
        for batch in batches:
            for _, _, buf, off in text_chunks(batch.column(0)):
                tokens, nodes, ns, lasts = [], [], [], []

                def add(token: np.ndarray, node: int, n: int, last: int, tokens=tokens, nodes=nodes, ns=ns, lasts=lasts) -> None:
                    tokens.append(token)
                    nodes.append(np.full(len(token), node, np.int64))
                    ns.append(np.full(len(token), n, np.int32))
                    lasts.append(np.full(len(token), last, np.int64))

                for s in shingle_sets(buf, off, WIDTH):
                    n = len(s)
                    if not n or (node := name(s)) in seen:
                        continue
                    seen.add(node)
                    if n <= boundary:
                        subs = [xxhash.xxh3_64_intdigest(np.array(c, np.uint64).tobytes(), seed=o) for o in subset_sizes(n, boundary) for c in combinations(s.tolist(), o)]
                        if subs:
                            add(np.array(subs, np.uint64), node, n, -1)
                    if n >= least_size(boundary + 1):
                        order = s >> np.uint64(7)
                        if len(often):
                            at = np.minimum(np.searchsorted(often, s), len(often) - 1)
                            order |= np.where(often[at] == s, place[at], np.uint64(0)) << np.uint64(57)
                        m = n - least_size(n) + 1
                        first = np.argpartition(order, m - 1)[:m] if m < n else np.arange(n)
                        add(s[first], node, n, int(order[first].max()))
                if tokens:
                    yield arrow_batch(schema, [np.concatenate(tokens).view(np.int64), *(np.concatenate(x) for x in (nodes, ns, lasts))])

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of rows sorted by token and node, the tokens of at least two sets, each pair once."""
        held = None  # the run of one set that the batch before ended with
        for batch in batches:
            t, v = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if not len(t):
                continue
            twin = np.zeros(len(t), bool)
            twin[1:] = (t[1:] == t[:-1]) & (v[1:] == v[:-1])
            again = held is not None and held[0] == t[0]
            if again and held[1] == v[0]:
                twin[0] = True
                k = int(np.argmin((t == t[0]) & (v == v[0]))) or len(t)
                twin[:k] = True
            batch, t = batch.filter(pa.array(~twin)), t[~twin]
            if not len(t):
                continue
            again = held is not None and held[0] == t[0]
            more = np.zeros(len(t), bool)
            same = t[1:] == t[:-1]
            more[1:] |= same
            more[:-1] |= same
            if again:
                more[0] = True
                if held[2] is not None:
                    yield held[2]
            if more[:-1].any() or (len(t) and more[0]):
                keep = more.copy()
                if not more[-1]:
                    keep[-1] = False
                yield batch.filter(pa.array(keep))
            last = batch.slice(len(t) - 1, 1)
            held = (t[-1], last.column(1)[0].as_py(), None if more[-1] else last)

    rows = docs.select(text).mapInArrow(listed, LISTS)
    return rows.repartition(partitions(spark), "token").sortWithinPartitions("token", "node").mapInArrow(shared, LISTS)


CHECKED = "kind int, a long, b long, shared int, n int, own array<long>"
LINK, MEMBER = 0, 1


def verify(pairs: DataFrame, classes: DataFrame, docs: DataFrame, key: str, text: str, name: Callable[[np.ndarray], int]) -> DataFrame:
    """Rows (CHECKED) of pairs (g, node): a LINK if they are one; a MEMBER, with the shared count and the shingles that
    g doesn't have, if the node shares at least half of its shingles with the centre g.

    A star's members are dealt to tasks of STAR members, each with its centre.
    """
    spark = docs.sparkSession
    members = pairs.groupBy("g").agg(F.count(F.lit(1)).alias("m")).select("g", F.ceil(F.col("m") / STAR).cast("int").alias("salts"))
    rows = pairs.join(members, "g").select("g", F.pmod(F.xxhash64("node"), F.col("salts")).cast("int").alias("salt"), "node", F.lit(1).alias("member"))
    centres = members.select("g", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("g").alias("node"), F.lit(0).alias("member"))
    wanted = rows.unionByName(centres).join(classes.select("node", F.col("first").alias("_id")), "node")
    texts = docs.select(F.col(key).cast("long").alias("_doc"), F.col(text).alias("_text"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, star, centre = arrow_schema(CHECKED), None, None
        for batch in batches:
            g, salt, node, member = (batch.column(k).to_pylist() for k in range(4))
            found = []
            for i, _, buf, off in text_chunks(batch.column(4)):
                for k, s in enumerate(shingle_sets(buf, off, WIDTH), i):
                    if not len(s) or name(s) != node[k]:  # another document of the same id
                        continue
                    if not member[k]:
                        star, centre = (g[k], salt[k]), s
                    elif star == (g[k], salt[k]):
                        at = np.minimum(np.searchsorted(centre, s), len(centre) - 1)
                        same = centre[at] == s
                        shared, n = int(same.sum()), len(s)
                        if shared >= need(len(centre), n):
                            found.append((LINK, g[k], node[k], shared, n, None))
                        if 2 * shared >= n:
                            found.append((MEMBER, g[k], node[k], shared, n, s[~same].view(np.int64)))
            if found:
                yield arrow_batch(schema, list(zip(*found, strict=True)))

    rows = wanted.join(texts, F.col("_id").eqNullSafe(F.col("_doc"))).select("g", "salt", "node", "member", "_text")
    return rows.repartition(partitions(spark), "g", "salt").sortWithinPartitions("g", "salt", "member").mapInArrow(check, CHECKED)


def jaccard_classes(docs: DataFrame, key: str = "doc_id", text: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """key, n_shingles, component_id (smallest key reachable by links, the row's own included) for every row."""
    rows = jaccard_rows(docs, key, text, scratch)
    return rows.select(F.col("key").alias(key), F.col("n").cast("long").alias("n_shingles"), "component_id")


def jaccard_rows(docs: DataFrame, key: str = "doc_id", text: str = "text", scratch: Scratch | None = None, bits: int = NAME) -> DataFrame:
    """key, fp (hash of the text), n (set size), component_id and grp for every row; rows of one group, null keys too, bear
    the same grp, and rows with an empty set a null one.

    1. One row per different set; copies hang on their set from here on. Sets have names of 128 bits: where different
       sets share the first 64 (``bits``), the others name them; such names are a handful, if any.
    2. Inverted lists (and subset lists of small sets), kept where two sets meet.
    3. Stars: each set is verified against the fullest centre that it shares most tokens with, and, where that leaves
       several components, against the member nearest to what the star's members have in common. In a group of near
       copies that leaves few components, however many members it has.
    4. All pairs of sets in different components that meet in lists, and share as many listed tokens as a link must,
       are verified. So no link between components is lost, and pairs inside a component are never formed.

    Null text, or a text without words, has an empty set and no links. Rows of null key link like others and are left
    out of the minimum; alone they have a null component. Repeated rows each get a row, very long texts count whole,
    other columns play no part. An empty table gives none.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    scratch = scratch or Scratch(spark, "jaccard")
    prof = scratch.save(profile(docs, key, text, bits), "profile", "kind")
    rows = prof.where("kind = 0").select(F.col("a").alias("key"), F.col("b").alias("node"), "twin", "n", "fp")
    twice = rows.where("n > 0").groupBy("node").agg(F.min("twin").alias("x"), F.max("twin").alias("y")).where("x <> y")
    shared = frozenset(r["node"] for r in twice.select("node").collect())
    if shared:
        named = twice.select(F.col("node").alias("_shared"))
        rows = rows.join(F.broadcast(named), F.col("node") == F.col("_shared"), "left").withColumn("node", F.when(F.col("_shared").isNull(), F.col("node")).otherwise(F.col("twin"))).drop("_shared")
    rows = rows.drop("twin")
    name = partial(node_of, shared=shared, bits=bits)
    classes = scratch.save(rows.where("n > 0").groupBy("node").agg(F.min("key").alias("first"), F.first("n").alias("n")), "classes")

    often = prof.where("kind = 1").groupBy("a").agg(F.sum("b").alias("c")).orderBy(F.desc("c")).limit(FREQUENT).toPandas()
    token, count = often["a"].to_numpy(np.int64).view(np.uint64), often["c"].to_numpy(np.int64)
    by = np.argsort(token)
    token, rank = token[by], np.minimum(np.log2(np.maximum(count[by], 1)).astype(np.uint64) + np.uint64(1), np.uint64(63))
    small = {r["n"]: r["c"] for r in classes.where(F.col("n") <= LIGHT_MOST * 2).groupBy("n").agg(F.count(F.lit(1)).alias("c")).collect()}
    total = classes.agg(F.sum("n")).first()[0] or 1
    boundary = choose_boundary(small, float((count.astype(float) ** 2).sum()) / total)
    met = scratch.save(lists(docs, text, token, rank, boundary, name), "lists")

    degree = met.groupBy("node").agg((F.count(F.lit(1)) / F.first("n")).alias("share"))
    rich = met.select("token", "node").join(degree, "node")
    hubs = rich.groupBy("token").agg(F.max(F.struct("share", "node"))["node"].alias("g"))
    counted = met.select("token", "node").join(hubs, "token").where("node <> g").groupBy("node", "g").agg(F.count(F.lit(1)).alias("c"))
    stars = scratch.save(counted.groupBy("node").agg(F.max(F.struct("c", "g"))["g"].alias("g")), "stars")
    checked = scratch.save(verify(stars, classes, docs, key, text, name), "checked", "kind")
    links = checked.where(F.col("kind") == LINK).select("a", "b").distinct()

    comps = scratch.save(components(links, scratch, "first"), "comps")
    members, beside = star_members(checked, comps)
    members, beside = scratch.save(members, "members"), scratch.save(beside, "beside")
    second = verify(nearest(members, comps), classes, docs, key, text, name).where(F.col("kind") == LINK).select("a", "b").distinct()
    second = scratch.save(second, "second")
    links = links.unionByName(second)
    comps = scratch.save(components(links, scratch, "middle"), "comps2")
    cross = star_pairs(members, beside, comps).unionByName(cross_pairs(met, comps, checked, boundary)).distinct()
    cross = scratch.save(cross, "cross")
    more = verify(cross, classes, docs, key, text, name).where(F.col("kind") == LINK).select("a", "b").distinct()
    more = scratch.save(more, "more")
    final = components(links.unionByName(more), scratch, "final")
    named = final.join(classes.select("node", "first"), "node")
    least = named.groupBy("comp").agg(F.min("first").alias("least"))
    named = classes.select("node", "first").join(final, "node", "left").join(least, "comp", "left").select(F.col("node").alias("_node"), F.coalesce("least", "first").alias("component"), F.coalesce("comp", "node").alias("grp"))
    out = rows.join(named, F.col("node") == F.col("_node"), "left")
    return out.select("key", "fp", "n", F.coalesce("component", "key").alias("component_id"), "grp")


SHARED = f"ceil({NUM} * (n1 + n) / {DEN + NUM})"
SIZES = f"least(n1, n) * {DEN} >= greatest(n1, n) * {NUM}"


def outside(rows: DataFrame, comps: DataFrame, star: str = "star") -> DataFrame:
    """Adds to rows(star, node) the component, and the most frequent one of its star (main) with its rows (most) and all
    rows (all); stars of one component are left out."""
    rows = rows.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    sums = rows.groupBy(star, "comp").agg(F.count(F.lit(1)).alias("c"))
    main = sums.groupBy(star).agg(F.max(F.struct("c", "comp")).alias("m"), F.sum("c").alias("all"), F.count(F.lit(1)).alias("comps"))
    return rows.join(main.where("comps > 1").select(star, F.col("m.comp").alias("main"), F.col("m.c").alias("most"), "all"), star)


def star_members(checked: DataFrame, comps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(star, node, shared, n, wide), (star, node, token) of stars with several components: a member's shingles beside the
    centre that over ``BESIDE`` members have, and those that others, but no more of them, have too.

    If the centre is a copy that has changed, nearly all members share what it has lost: pairs by such shingles would
    grow with the square of the star.
    """
    rows = checked.where(F.col("kind") == MEMBER).select(F.col("a").alias("star"), F.col("b").alias("node"), "shared", "n", "own").dropDuplicates(["star", "node"])
    rows = outside(rows, comps)
    own = rows.select("star", "node", F.explode("own").alias("token"))
    often = own.groupBy("star", "token").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    own = own.join(often, ["star", "token"])
    wide = own.where(F.col("c") > BESIDE).groupBy("star", "node").agg(F.collect_list("token").alias("wide"))
    members = rows.select("star", "node", "shared", "n").join(wide, ["star", "node"], "left")
    return members.withColumn("wide", F.coalesce("wide", F.array().cast("array<long>"))), own.where(F.col("c") <= BESIDE).select("star", "node", "token")


def nearest(members: DataFrame, comps: DataFrame) -> DataFrame:
    """Pairs (g, node) of each star's member that shares most with the centre and what is common beside it, and all in
    other components that have a size for a link: a second centre where the first was a poor one."""
    rows = members.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    held = F.expr(f"{NUM + DEN} * (shared + size(wide)) - {NUM} * n")
    best = rows.groupBy("star").agg(F.max(F.struct(held.alias("held"), "node", "n", "comp")).alias("x")).select("star", F.col("x.node").alias("g"), F.col("x.n").alias("n1"), F.col("x.comp").alias("comp1"))
    return rows.join(best, "star").where(f"comp1 <> comp AND {SIZES}").select("g", "node").distinct()


def star_pairs(members: DataFrame, beside: DataFrame, comps: DataFrame) -> DataFrame:
    """Pairs (g, node) of members of one star in different components that can be links.

    Two members share at most the smaller of what each shares with the centre, and what both have beside it: of the
    shingles that many have (wide), and of the others. So they are a pair if the first two are enough, or with the
    others, which few have.
    """
    rows = outside(members, comps).withColumn("held", F.col("shared") + F.size("wide"))
    first = lambda d, *keys: d.where("comp <> main").select(*keys, *(F.col(c).alias(f"{c}1") for c in ("node", "shared", "n", "comp", "held", "wide") if c in d.columns))
    differ = f"comp1 <> comp AND (comp = main OR node1 < node) AND {SIZES}"
    # A link is at least so much of either set; a large star's weighing is dealt to several tasks.
    near = rows.where(f"held * {DEN} >= n * {NUM}").withColumn("salts", F.ceil((F.col("all") - F.col("most")) * F.col("all") / WEIGHED).cast("int"))
    some = first(near.withColumn("salt", F.pmod(F.xxhash64("node"), F.col("salts")).cast("int")), "star", "salt")
    every = near.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    both = f"least(held1, held) >= {SHARED} AND least(shared1, shared) + size(array_intersect(wide1, wide)) >= {SHARED}"
    enough = some.join(every, ["star", "salt"]).where(f"{differ} AND {both}").select(F.col("node1").alias("g"), "node")
    own = beside.join(rows.select("star", "node", "main", "shared", "n", "comp", F.size("wide").alias("w")), ["star", "node"])
    mine = own.where("comp <> main").select("star", "token", *(F.col(c).alias(f"{c}1") for c in ("node", "shared", "n", "comp", "w")))
    pairs = mine.join(own, ["star", "token"]).where(differ)
    pairs = pairs.groupBy("node1", "node").agg(F.count(F.lit(1)).alias("c"), *(F.first(c).alias(c) for c in ("shared1", "shared", "n1", "n", "w1", "w")))
    pairs = pairs.where(f"least(shared1, shared) + least(w1, w) + c >= {SHARED}").select(F.col("node1").alias("g"), "node")
    return enough.unionByName(pairs)


def cross_pairs(met: DataFrame, comps: DataFrame, checked: DataFrame, boundary: int) -> DataFrame:
    """Pairs (g, node) in different components that share enough listed tokens to be links, but for members of one star.

    In a list, only sets outside its most frequent component are paired with the rest, so a list of one component
    gives nothing. With T shared elements needed, the set whose listed tokens end first has n - listed others, so the
    pair must share at least T less that many listed tokens.
    """
    star = checked.where(F.col("kind") == MEMBER).select(F.col("b").alias("node"), F.col("a").alias("star")).distinct()
    rows = met.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node")).join(star, "node", "left")
    sums = rows.groupBy("token", "comp").agg(F.count(F.lit(1)).alias("c"))
    main = sums.groupBy("token").agg(F.max(F.struct("c", "comp"))["comp"].alias("main"), F.count(F.lit(1)).alias("comps")).where("comps > 1").drop("comps")
    rows = rows.join(main, "token")
    rare = rows.where("comp <> main").select("token", *(F.col(c).alias(f"{c}1") for c in ("node", "n", "last", "comp", "star")))
    fits = F.expr(f"comp1 <> comp AND (comp = main OR node1 < node) AND {SIZES} AND coalesce(star1 <> star, true)")
    pairs = rare.join(rows, "token").where(fits)
    # Lists of one pair can have different main components; all count for the pair, whichever side is main there.
    sides = [F.expr(f"if(node1 < node, {x}, {y})").alias(z) for c in ("node", "n", "last") for x, y, z in ((f"{c}1", c, f"{c}1"), (c, f"{c}1", c))]
    counted = pairs.select(*sides).groupBy(F.col("node1").alias("g"), "node").agg(F.count(F.lit(1)).alias("c"), F.first("n1").alias("n1"), F.first("n").alias("n"), F.first("last1").alias("last1"), F.first("last").alias("last"), F.max(F.expr("last1 < 0 AND last < 0")).alias("subset"))
    unlisted = f"ceil({NUM} * if(last1 <= last, n1, n) / {DEN}) - 1"
    return counted.where(F.expr(f"subset OR greatest(n1, n) <= {boundary} OR c >= {SHARED} - {unlisted}")).select("g", "node")


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(table(spark, sf_dir, "documents").select("doc_id", "text"))

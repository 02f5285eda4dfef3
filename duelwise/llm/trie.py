"""The prefix tree of conversations that share their beginnings, kept as one chain of nodes per conversation.

The digest of a prefix is the exclusive or of hashes of (position, turn), so prefix digests are prefix sums that blocks
of a long conversation can add up apart. A node belongs to the smallest conversation that has its prefix; a conversation
that owns a node owns all deeper ones of its own, so its first owned depth is found by binary search against the
table of least conversations by digest. What it owns is a chain, hung on the node before; totals go up the chains
by doubling.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, arrow_batch, arrow_schema, bound_batches, partitions, table

#: Turns of a block: what one window or array holds of a conversation. A family of conversation numbers shares at most
#: the first SHARED - 1 turns of its first one.
BLOCK, FAMILY, SHARED = 4096, 100, 6
#: Characters of joined ids in a row.
JOINED = 1 << 16
EMPTY = hashlib.sha256(b"").hexdigest()
NODE = ["conv_id", "depth"]


def numbered(conversations: DataFrame, block: int = BLOCK) -> DataFrame:
    """(c, j, a, b, size): each conversation's turns from 1 on, by 128 bits of role and text and the text's code points."""
    t = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("c"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.floor(F.col("turn") / block).alias("blk")
    )
    before = F.sum("n").over(Window.partitionBy("c").orderBy(F.col("blk").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1))
    offsets = t.groupBy("c", "blk").agg(F.count(F.lit(1)).alias("n")).select(F.col("c").alias("_c"), F.col("blk").alias("_blk"), F.coalesce(before, F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("c", "blk").orderBy(F.col("turn").asc_nulls_first(), "role", "text"))
    d = t.select("c", "blk", inside.alias("i"), F.xxhash64("role", "text").alias("a"), F.xxhash64(F.lit(1), "text", "role").alias("b"), F.length("text").cast("long").alias("size"))
    return d.join(offsets, (F.col("c") == F.col("_c")) & F.col("blk").eqNullSafe(F.col("_blk"))).select("c", (F.col("before") + F.col("i")).alias("j"), "a", "b", "size")


def rebuilt(turns: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(conversations, turns): c and its rebuilt length; (c, k, a, b, size) of the rebuilt turns."""
    shared = F.crc32(F.col("c").cast("string").cast("binary")) % SHARED
    first = turns.where((F.col("c") % FAMILY == 0) & (F.col("j") < SHARED)).groupBy(F.col("c").alias("base")).agg(F.sort_array(F.collect_list(F.struct("j", "a", "b", "size"))).alias("head"))
    convs = turns.groupBy("c").agg(F.count(F.lit(1)).alias("n")).withColumns({"h": shared.cast("int"), "base": F.col("c") - F.col("c") % FAMILY})
    head = F.slice(F.coalesce("head", F.array().cast("array<struct<j:bigint,a:bigint,b:bigint,size:bigint>>")), F.lit(1), F.col("h"))
    convs = convs.join(first, "base", "left").select("c", "h", "n", head.alias("head"))
    convs = scratch.save(convs.withColumn("length", F.size("head") + F.greatest(F.col("n") - F.col("h"), F.lit(0))), "convs")
    lent = convs.select("c", F.explode("head").alias("t")).select("c", F.col("t.j").alias("k"), "t.a", "t.b", "t.size")
    own = turns.join(convs.select("c", "h", (F.size("head") - F.col("h")).alias("shift")), "c").where("j > h").select("c", (F.col("j") + F.col("shift")).alias("k"), "a", "b", "size")
    return convs.select("c", "length"), lent.unionByName(own)


def running(rows: DataFrame, place: str, values: dict[str, Column], down: bool = False, block: int = BLOCK) -> DataFrame:
    """rows with running values by ``place`` within each c, from the end if ``down``: within a block by a window, over
    blocks by one of the blocks' totals."""
    merge = F.bit_xor if not down else F.sum
    plus = (lambda x, y: x.bitwiseXOR(y)) if not down else (lambda x, y: x + y)
    order = lambda c: F.desc(c) if down else F.asc(c)
    rows = rows.withColumns(values).withColumn("blk", F.floor(F.col(place) / block))
    earlier = Window.partitionBy("c").orderBy(order("blk")).rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("c", "blk").agg(*(merge(v).alias(v) for v in values))
    totals = totals.select("c", "blk", *(F.coalesce(merge(v).over(earlier), F.lit(0)).alias(f"_{v}") for v in values))
    inside = Window.partitionBy("c", "blk").orderBy(order(place)).rowsBetween(Window.unboundedPreceding, 0)
    d = rows.withColumns({v: merge(v).over(inside) for v in values}).join(totals, ["c", "blk"])
    return d.withColumns({v: plus(F.col(v), F.col(f"_{v}")) for v in values}).drop(*(f"_{v}" for v in values))


def first_owned(prefixes: DataFrame, least: DataFrame, scratch: Scratch, block: int = BLOCK) -> DataFrame:
    """(c, s, p): the depth from which a conversation owns its prefixes (one beyond its length: none), and the owner of
    the depth before (null: the root).

    Each block asks for its last prefix first; in the first owned block, halving goes on by one join of all conversations
    at a time, carrying only the half that is left.
    """
    item = F.struct("k", "x", "y")
    held = prefixes.groupBy("c", "blk").agg(F.sort_array(F.collect_list(item)).alias("items"))
    owner = least.select(F.struct("k", "x", "y").alias("at"), "owner")
    asked = held.withColumn("at", F.element_at("items", -1)).join(owner, "at")
    along = Window.partitionBy("c").orderBy("blk")
    asked = asked.withColumns({"before": F.lag("owner").over(along), "last": F.lead("blk").over(along).isNull()})
    asked = scratch.save(asked.where((F.col("owner") == F.col("c")) & (F.coalesce(F.col("before") != F.col("c"), F.lit(True))) | (F.col("last") & (F.col("owner") != F.col("c")))), "asked")
    none = asked.where("owner <> c").select("c", (F.col("at.k") + 1).alias("s"), F.col("owner").alias("p"))
    # The last of the items is always owned; p owns what is before the first.
    left = asked.where("owner = c").select("c", F.col("before").alias("p"), "items")
    found, step = none, 0
    while True:
        found = found.unionByName(left.where(F.size("items") == 1).select("c", F.col("items")[0]["k"].alias("s"), "p"))
        left = left.where(F.size("items") > 1)
        if left.limit(1).isEmpty():
            return found
        half = F.shiftright(F.size("items"), 1)
        tried = left.withColumn("half", half).withColumn("at", F.element_at("items", F.col("half"))).join(owner, "at")
        mine = F.col("owner") == F.col("c")
        rest = F.when(mine, F.slice("items", F.lit(1), F.col("half"))).otherwise(F.slice("items", F.col("half") + 1, F.size("items") - F.col("half")))
        left = scratch.save(tried.select("c", F.when(mine, F.col("p")).otherwise(F.col("owner")).alias("p"), rest.alias("items")), f"halved-{step}")
        step += 1


def up_the_chains(chains: DataFrame, root: int, scratch: Scratch) -> DataFrame:
    """chains(c, p, leaves, saved) -> (c, leaves, saved) with those of all chains that hang on c, however far below.

    After round i a chain has the sums of those less than 2 ** i steps below it, and knows the one 2 ** i steps above.
    """
    t, step = chains.select("c", F.col("p").alias("above"), "leaves", "saved"), 0
    while not t.where("above IS NOT NULL").limit(1).isEmpty():
        below = t.where("above IS NOT NULL").groupBy(F.col("above").alias("c")).agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
        next_ = t.where((F.col("c") != root)).select(F.col("c").alias("above"), F.col("above").alias("higher"))
        # Nothing is above the root, the commonest place to hang on: those chains need no join.
        inner = t.where(F.coalesce(F.col("above") != root, F.lit(False))).join(next_, "above", "left").select("c", F.col("higher").alias("above"), "leaves", "saved")
        outer = t.where(F.coalesce(F.col("above") == root, F.lit(True))).select("c", F.lit(None).cast("long").alias("above"), "leaves", "saved")
        t = inner.unionByName(outer).join(below, "c", "left")
        t = scratch.save(t.select("c", "above", (F.col("leaves") + F.coalesce("more_leaves", F.lit(0))).alias("leaves"), (F.col("saved") + F.coalesce("more_saved", F.lit(0))).alias("saved")), f"up-{step}")
        step += 1
    return t.select("c", "leaves", "saved")


def digests_of_ids(rows: DataFrame, joined: int = JOINED) -> DataFrame:
    """rows(conv_id, depth, c) -> (conv_id, depth, sha): the SHA-256 of a node's c, ascending, joined by commas.

    Ranges of (node, c) join runs of ids first; a node's few runs then stream through one hash, since that can't be split.
    """
    n = partitions(rows.sparkSession)
    runs, hashed = "conv_id long, depth long, part int, run long, ids string", "conv_id long, depth long, sha string"

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, part, run, node, ids, size = arrow_schema(runs), TaskContext.get().partitionId(), 0, None, [], 0
        for batch in batches:
            out = []
            for conv, depth, c in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if (conv, depth) != node or size > joined:
                    if ids:
                        out.append((*node, part, run, ",".join(ids)))
                    node, ids, size, run = (conv, depth), [], 0, run + 1
                ids.append(str(c))
                size += len(ids[-1]) + 1
            if out:
                yield arrow_batch(schema, list(zip(*out, strict=True)))
        if ids:
            yield arrow_batch(schema, [[x] for x in (*node, part, run, ",".join(ids))])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, node, sha = arrow_schema(hashed), None, None
        for batch in batches:
            out = []
            for conv, depth, ids in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if (conv, depth) != node:
                    if node:
                        out.append((*node, sha.hexdigest()))
                    node, sha = (conv, depth), hashlib.sha256(ids.encode())
                else:
                    sha.update(b"," + ids.encode())
            if out:
                yield arrow_batch(schema, list(zip(*out, strict=True)))
        if node:
            yield arrow_batch(schema, [[x] for x in (*node, sha.hexdigest())])

    ordered = rows.select(*NODE, "c").repartitionByRange(n, *NODE, "c").sortWithinPartitions(*NODE, "c")
    parts = ordered.mapInArrow(join, runs).repartition(n, *NODE).sortWithinPartitions(*NODE, "part", "run")
    return parts.select(*NODE, "ids").mapInArrow(digest, hashed)


def prefix_trie(conversations: DataFrame, block: int = BLOCK, joined: int = JOINED) -> DataFrame:
    """One row per different beginning of a rebuilt conversation, the empty one (the root) included.

    Rows without conv_id play no part; null roles and texts are empty; turns go by turn, null first, those of one turn
    by role and text; repeated rows are turns each. A conversation left without turns is a member of the root. Texts of
    any length count whole, by their hash (128 bits for a prefix); other columns play no part; an empty table gives no
    rows. Long conversations are dealt in blocks of ``block`` turns.
    """
    spark = conversations.sparkSession
    bound_batches(spark)
    scratch = Scratch(spark, "trie")
    turns = scratch.save(numbered(conversations, block), "turns")
    convs, rows = rebuilt(turns, scratch)
    total, root = convs.agg(F.count(F.lit(1)), F.min("c")).first()
    rows = running(rows, "k", {"x": F.xxhash64("k", "a", "b"), "y": F.xxhash64("b", "k", "a")}, block=block).select("c", "k", "blk", "x", "y", "size")
    prefixes = scratch.save(rows, "prefixes")
    scratch.drop("turns")
    least = scratch.save(prefixes.groupBy("k", "x", "y").agg(F.min("c").alias("owner"), F.count(F.lit(1)).alias("n"), F.min("size").alias("size")), "least")

    top = F.col("c") == F.lit(root)
    found = convs.join(first_owned(prefixes, least, scratch, block), "c", "left")
    found = found.select("c", "length", F.when(top, 0).otherwise(F.coalesce("s", F.lit(1))).cast("long").alias("s"), F.when(~top, F.coalesce("p", F.lit(root))).cast("long").alias("p"))
    found = scratch.save(found.withColumn("owns", F.col("s") <= F.col("length")), "found")
    chains = found.where("owns")
    hung = chains.where("p IS NOT NULL").groupBy(F.col("p").alias("c"), (F.col("s") - 1).alias("length")).agg(F.count(F.lit(1)).alias("kids"))
    tips = chains.select("c", "p", "length").join(hung, ["c", "length"], "left").select("c", "p", F.when(F.col("kids").isNull(), 1).otherwise(0).cast("long").alias("leaves"))
    # The nodes are the owned prefixes and the root.
    nodes = least.select(F.col("owner").alias("c"), F.col("k").cast("long").alias("d"), "n", ((F.col("n") - 1) * F.col("size")).alias("saved"))
    nodes = nodes.unionByName(chains.where(top).select("c", F.lit(0).cast("long").alias("d"), F.lit(total).cast("long").alias("n"), F.lit(0).cast("long").alias("saved")))
    own = tips.join(nodes.groupBy("c").agg(F.sum("saved").alias("saved")), "c")
    whole = up_the_chains(scratch.save(own, "own"), root, scratch)

    # What happens at a place of a chain: the node, its first and last place, and the chains that hang there.
    event = lambda d, **x: d.select("c", "d", *(x.get(k, F.lit(None)).cast("long").alias(k) for k in ("n", "p", "first", "tip", "kids", "leaves", "saved")))
    heads = chains.select("c", F.col("s").alias("d"), "p")
    ends = chains.select("c", F.col("length").cast("long").alias("d")).join(tips.select("c", "leaves"), "c")
    kids = chains.where("p IS NOT NULL").join(whole, "c").select(F.col("p").alias("c"), (F.col("s") - 1).alias("d"), "leaves", "saved")
    kids = kids.groupBy("c", "d").agg(F.count(F.lit(1)).alias("kids"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    col = F.col
    events = event(nodes, n=col("n"), saved=col("saved")).unionByName(event(heads, p=col("p"), first=F.lit(1)))
    events = events.unionByName(event(ends, tip=F.lit(1), leaves=col("leaves"))).unionByName(event(kids, kids=col("kids"), leaves=col("leaves"), saved=col("saved")))
    at = events.groupBy("c", "d").agg(F.max("n").alias("n"), F.max("p").alias("p"), F.max("first").alias("first"), F.max("tip").alias("tip"), *(F.coalesce(F.sum(k), F.lit(0)).alias(k) for k in ("kids", "leaves", "saved")))
    summed = running(at, "d", {"leaves": col("leaves"), "saved": col("saved")}, True, block)
    out = summed.select(
        col("c").alias("conv_id"), col("d").alias("depth"), F.when(col("first").isNull(), col("c")).otherwise(col("p")).alias("parent_conv_id"), col("n").alias("n_convs"),
        (col("kids") + F.when(col("tip").isNull(), 1).otherwise(0)).alias("n_children"), col("leaves").alias("n_leaves"), col("saved").alias("saved_tokens"),
    )
    members = found.select(F.when(col("owns"), col("c")).otherwise(col("p")).alias("conv_id"), col("length").cast("long").alias("depth"), "c")
    return out.join(digests_of_ids(members, joined), NODE, "left").withColumn("ends_sha256", F.coalesce("sha", F.lit(EMPTY))).drop("sha")


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))


#: The checksum is worked out bit by bit, since the SQL engine has no function for it.
SQL = """
WITH t AS (SELECT conv_id AS c, list({'r': coalesce(role, ''), 't': coalesce(text, '')} ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS ts FROM conversations WHERE conv_id IS NOT NULL GROUP BY 1),
h AS (SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda x: ord(x)::BIGINT)),
    lambda acc, b: list_reduce(list_prepend(xor(acc, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda r, z: xor(r >> 1, 3988292384::BIGINT * (r & 1)))), 4294967295::BIGINT) % 6 AS h FROM t),
s AS (SELECT h.c, list_concat(coalesce(b.ts, [])[1:h.h], h.ts[h.h + 1:]) AS ts FROM h LEFT JOIN t b ON b.c = h.c - h.c % 100),
p AS (SELECT c, ts, d, ts[1:d] AS pre FROM (SELECT c, ts, unnest(range(0, len(ts) + 1)) AS d FROM s)),
n AS (SELECT d, pre, min(c) AS conv_id, count(*) AS n_convs, string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (len(ts) = d) AS ends FROM p GROUP BY ALL),
k AS (SELECT d - 1 AS d, pre[1:d - 1] AS pre, count(*) AS n_children FROM n WHERE d > 0 GROUP BY ALL),
m AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k ON k.d = n.d AND k.pre = n.pre),
u AS (SELECT a AS d, pre[1:a] AS pre, count_if(n_children = 0) AS n_leaves, sum(CASE WHEN d > 0 THEN (n_convs - 1) * length(pre[d].t) ELSE 0 END) AS saved FROM (SELECT *, unnest(range(0, d + 1)) AS a FROM m) GROUP BY ALL)
SELECT m.conv_id, m.d AS depth, o.conv_id AS parent_conv_id, m.n_convs, m.n_children, u.n_leaves::BIGINT AS n_leaves, u.saved::BIGINT AS saved_tokens, sha256(coalesce(m.ends, '')) AS ends_sha256
FROM m JOIN u ON u.d = m.d AND u.pre = m.pre LEFT JOIN n o ON o.d = m.d - 1 AND o.pre = m.pre[1:m.d - 1]
"""

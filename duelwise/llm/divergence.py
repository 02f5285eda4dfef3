"""How far the sources of a language diverge in their words, counted and compared by DuckDB shard by shard.

Tasks count the words of their documents; counts are hashed by language and term to shards. In each shard DuckDB sums
them, keeps the terms that enough documents have, and later sums the shard's share of every pair of sources and picks
its best terms; Spark merges sums and rankings. A pair's sum over all kept terms is written as what it would be if
no term occurred in both sources, plus a correction by the terms that do, so zeros are never laid out.
"""

from __future__ import annotations

import tempfile
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, arrow_batch, arrow_schema, bound_batches, partitions, table

#: A kept term occurs in so many documents of its language at least; so many terms of a group are reported.
LEAST_DOCS, TOP = 10, 10
#: The unit of shares, and what is added to each count.
UNIT, PRIOR = 1_000_000_000, 2
#: Bytes of counted terms that a task holds before it passes them on (``ENTRY`` and its own for a term).
HELD_BYTES, ENTRY = 64 << 20, 130
#: Text of a shard (vocabularies grow slower than text, so there is no need for more than MOST_SHARDS), bytes that DuckDB
#: may hold there, and rows that it takes in before it adds up those of a term and source.
SHARD_BYTES, MOST_SHARDS, MEMORY, FRESH = 8 << 20, 20_000, "200MB", 250_000
#: Copies of a language's groups, so that one language's pairs are made by as many tasks.
SALTS = 8
COUNTS = "lang string, source string, term string, n long, df long"
#: What parts a term: all of ASCII but letters. A-Z are lower-cased, other bytes are left alone.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def term_counts(docs: DataFrame, held_bytes: int = HELD_BYTES) -> DataFrame:
    """(lang, source, term, n, df): a task's occurrences and documents of each term."""

    def rows(lang: str, source: str, n: Counter, df: Counter) -> Iterator[pa.RecordBatch]:
        terms, schema = list(n), arrow_schema(COUNTS)
        for k in range(0, len(terms), 1 << 16):
            part = terms[k : k + (1 << 16)]
            try:
                names = pa.array(part, pa.binary()).cast(pa.string())
            except pa.ArrowInvalid:  # bytes that are no UTF-8
                names = pa.array([t.decode(errors="replace") for t in part])
            m = len(part)
            yield pa.RecordBatch.from_arrays([pa.repeat(lang, m), pa.repeat(source, m), names, pa.array([n[t] for t in part]), pa.array([df[t] for t in part])], schema=schema)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = {}, 0
        for batch in batches:
            for lang, source, text in zip(*batch.columns, strict=True):
                words = (text.as_py() or b"").translate(_LETTERS).split()
                n, df = held.setdefault((lang.as_py(), source.as_py()), (Counter(), Counter()))
                own, known = set(words), len(n)
                n.update(words)
                df.update(own)
                if len(n) > known:
                    size += (len(n) - known) * ENTRY + sum(map(len, own)) * (len(n) - known) // len(own)
                if size > held_bytes:
                    for group, counted in held.items():
                        yield from rows(*group, *counted)
                    held, size = {}, 0
        for group, counted in held.items():
            yield from rows(*group, *counted)

    return docs.select("lang", "source", F.col("text").cast("binary").alias("text")).mapInArrow(count, COUNTS)


def by_shard(rows: DataFrame, shards: int, script: list[str], result: str, ddl: str, added: str | None = None) -> DataFrame:
    """Each shard of rows (hashed by lang and term) as DuckDB's table ``t``; what ``result`` selects after ``script``.

    ``added`` selects fewer rows of t that mean the same; they replace t whenever it has doubled, so that a term which
    every task has counted takes no more room than its sources. What MEMORY can't hold goes to a folder of the task's own:
    DuckDB's default is one below the working folder, which all workers there would share.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        schema, db, fresh, held, spill = arrow_schema(ddl), None, 0, 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            shard = pa.Table.from_batches([batch])  # noqa: F841  named in the SQL
            if db is None:
                spill = tempfile.TemporaryDirectory()
                db = duckdb.connect(config={"threads": 1, "memory_limit": MEMORY, "temp_directory": spill.name})
                db.execute("CREATE TABLE t AS SELECT * FROM shard LIMIT 0")
            db.execute("INSERT INTO t SELECT * FROM shard")
            fresh += batch.num_rows
            if added and fresh > max(FRESH, held):
                db.execute(f"CREATE OR REPLACE TABLE t AS {added}")
                fresh, held = 0, db.execute("SELECT count(*) FROM t").fetchall()[0][0]  # all of it: a result with rows to come shuts out the next query
        if db is not None:
            for statement in script:
                db.execute(statement)
            for batch in db.sql(result).to_arrow_reader(1 << 14):
                if batch.num_rows:
                    yield from pa.Table.from_batches([batch]).cast(schema).to_batches()
            db.close()
            spill.cleanup()

    return rows.repartition(shards, "lang", "term").mapInArrow(run, ddl)


ADDED = "SELECT lang, source, term, sum(n)::BIGINT AS n, sum(df)::BIGINT AS df FROM t GROUP BY ALL"


def _kept_sql(least: int) -> str:
    return f"""SELECT lang, term, source, sum(n)::BIGINT AS n, any_value(total) AS total, source = any_value(head) AS head
FROM t JOIN (SELECT lang, term, sum(n)::BIGINT AS total, min(source) AS head FROM t GROUP BY ALL HAVING sum(df) >= {least}) USING (lang, term) GROUP BY lang, term, source"""


#: p and q are shares of a term in its group and in its language, z is the group's share of a term that it lacks.
SHARES = [
    f"CREATE TABLE s AS SELECT lang, term, source, 1 + ({UNIT}::HUGEINT * (n + {PRIOR}) // (size + 2 * v))::BIGINT AS p, 1 + ({UNIT}::HUGEINT * {PRIOR} // (size + 2 * v))::BIGINT AS z, "
    f"1 + ({UNIT}::HUGEINT * (total + {PRIOR}) // (lang_size + 2 * v))::BIGINT AS q FROM t",
    "CREATE MACRO f(p, q) AS (p - q) * (p - q) // (p + q)",
]
PARTS = "kind string, lang string, source string, item string, p long, value long"


def _parts_sql(top: int) -> str:
    return f"""SELECT 'both' AS kind, x.lang AS lang, x.source AS source, y.source AS item, 0::BIGINT AS p, sum(f(x.p, y.p) - f(x.p, y.z) - f(x.z, y.p) + f(x.z, y.z))::BIGINT AS value
  FROM s x JOIN s y ON x.lang = y.lang AND x.term = y.term AND x.source < y.source GROUP BY ALL
UNION ALL SELECT 'one', lang, source, '', p, count(*) FROM s GROUP BY ALL
UNION ALL SELECT 'term', lang, source, term, 0, value
  FROM (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, term) AS r FROM (SELECT lang, source, term, f(p, q) AS value FROM s WHERE p > q)) WHERE r <= {top}"""


def _f(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP, held_bytes: int = HELD_BYTES, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """lang, source, part, item, value, rank: each group's distance from the language's other sources (part ``pair``, all
    of them) and the terms that it has beyond the language's share (part ``term``, the ``top`` first).

    Null text, language or source is empty, and the empty ones are groups as any other; a group without kept terms has
    its pairs, a language with one source has none. Texts of any length are counted whole, as are repeated rows; ties go
    by the item's bytes; other columns play no part; an empty table gives no rows. All arithmetic is on whole numbers.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    scratch = Scratch(spark, "divergence")
    docs = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    groups = scratch.save(docs.groupBy("lang", "source").agg(F.sum(F.octet_length("text")).alias("bytes")), "texts")
    shards = max(partitions(spark), min(MOST_SHARDS, -(-(groups.agg(F.sum("bytes")).first()[0] or 0) // shard_bytes)))
    kept = by_shard(term_counts(docs, held_bytes), shards, [], _kept_sql(least_docs), "lang string, term string, source string, n long, total long, head boolean", ADDED)
    kept = scratch.save(kept, "kept")
    langs = kept.groupBy("lang").agg(F.sum("n").alias("lang_size"), F.count_if("head").alias("v"))
    sized = kept.groupBy("lang", "source").agg(F.sum("n").alias("size"), F.count(F.lit(1)).alias("terms"))
    groups = scratch.save(groups.drop("bytes").join(sized, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0), "groups")
    parts = by_shard(kept.join(groups, ["lang", "source"]).drop("head", "terms"), shards, SHARES, _parts_sql(top), PARTS)
    parts = scratch.save(parts, "parts")

    lacking = F.when(F.col("v") > 0, 1 + F.call_function("div", F.lit(UNIT * PRIOR), F.col("size") + 2 * F.col("v")))
    own = groups.select("lang", "source", "v", "terms", lacking.alias("z"))
    salted = lambda d, *by: d.withColumn("salt", F.pmod(F.xxhash64(*by), F.lit(SALTS)))
    others = own.select("lang", F.col("source").alias("item"), F.col("terms").alias("terms_b"), F.col("z").alias("z_b"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"))
    paired = lambda d, *by: salted(d, *by).join(others, ["lang", "salt"]).where("source <> item")
    none = paired(own, "source").select("lang", "source", "item", F.coalesce((F.col("v") - F.col("terms") - F.col("terms_b")) * _f(F.col("z"), F.col("z_b")), F.lit(0)).alias("value"))
    one = parts.where("kind = 'one'").groupBy("lang", "source", "p").agg(F.sum("value").alias("h"))
    one = paired(one, "source", "p").groupBy("lang", "source", "item").agg(F.sum(F.col("h") * _f(F.col("p"), F.col("z_b"))).alias("value"))
    both = parts.where("kind = 'both'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    half = one.unionByName(both)
    swapped = half.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value")
    pairs = none.unionByName(half).unionByName(swapped).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    out = lambda d, part: d.withColumn("rank", rank).select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    terms = parts.where("kind = 'term'").select("lang", "source", "item", "value")
    return out(pairs, "pair").unionByName(out(terms, "term").where(F.col("rank") <= top))


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(table(spark, sf_dir, "documents").select("text", "lang", "source"))


SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(coalesce(text, ''), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
w AS (SELECT id, lang, source, translate(unnest(ts), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM d),
k AS (SELECT lang, term, count(*) AS total FROM w GROUP BY ALL HAVING count(DISTINCT id) >= {LEAST_DOCS}),
v AS (SELECT lang, count(*) AS v, sum(total) AS size FROM k GROUP BY ALL),
c AS (SELECT lang, source, term, count(*) AS n FROM w JOIN k USING (lang, term) GROUP BY ALL),
g AS (SELECT lang, source, coalesce(sum(n), 0) AS size FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN c USING (lang, source) GROUP BY ALL),
x AS (SELECT g.lang, g.source, k.term, coalesce(n, 0) AS n, 1 + ({UNIT}::HUGEINT * (coalesce(n, 0) + {PRIOR}) // (g.size + 2 * v.v))::BIGINT AS p, 1 + ({UNIT}::HUGEINT * (total + {PRIOR}) // (v.size + 2 * v.v))::BIGINT AS q
  FROM g JOIN k ON k.lang = g.lang JOIN v ON v.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
ab AS (SELECT a.lang, a.source, b.source AS item, coalesce((SELECT sum((m.p - o.p) * (m.p - o.p) // (m.p + o.p)) FROM x m JOIN x o ON o.lang = m.lang AND o.term = m.term WHERE m.lang = a.lang AND m.source = a.source AND o.source = b.source), 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source),
t AS (SELECT lang, source, term AS item, ((p - q) * (p - q) // (p + q))::BIGINT AS value FROM x WHERE n > 0 AND p > q),
r AS (SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INTEGER AS rank FROM ab
  UNION ALL SELECT lang, source, 'term', item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INTEGER FROM t)
SELECT * FROM r WHERE part = 'pair' OR rank <= {TOP}
"""

"""BM25 over postings, in DataFrame operations."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .vectors import Best

K1, B = 1.5, 0.75


#: A word is two or more letters, digits or underscores of any script.
WORD = r"[\p{L}\p{N}_]{2,}"
#: Query terms up to this number are sent to every task.
BROADCAST_TERMS = 100_000
#: Queries that are answered in one pass, and scores (queries x documents) that are held at once.
QUERIES, SCORES = 8192, 1 << 21


def tokens(c: Column, stop: tuple[str, ...] = (), stem: Callable[[Column], Column] | None = None) -> Column:
    """Lower-cased words, less stop words, each stemmed by an injected expression."""
    out = F.regexp_extract_all(F.lower(c), F.lit(WORD), F.lit(0))
    out = F.filter(out, lambda w: ~w.isin(*stop)) if stop else out
    return F.transform(out, stem) if stem else out


def postings(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """term, key, tf, dl: one row per term of a document. Term counts come from one grouped pass."""
    d = docs.select(F.col(key), tokens(F.col(text)).alias("t"))
    d = d.select(key, F.size("t").alias("dl"), F.explode("t").alias("term"))
    return d.groupBy("term", key, "dl").agg(F.count(F.lit(1)).alias("tf"))


def counted(docs: DataFrame, key: str, text: str, title: str | None, stop: tuple[str, ...], stem: Callable[[Column], Column] | None) -> DataFrame:
    """key, dl, t: the words of each document and their number."""
    whole = F.concat_ws(" ", title, text) if title else F.col(text)
    return docs.select(F.col(key), tokens(whole, stop, stem).alias("t")).select(key, F.size("t").alias("dl"), "t")


def document_frequencies(posts: DataFrame, docs: DataFrame) -> DataFrame:
    """term, df, idf."""
    n = docs.agg(F.count(F.lit(1)).alias("docs"))
    d = posts.groupBy("term").agg(F.count(F.lit(1)).alias("df")).join(F.broadcast(n))
    return d.select("term", "df", F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))


def term_places(column: pa.Array, terms: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term) of each word of the rows' lists that is one of the terms, by place, and the rows' numbers of words
    (-1 for a null list)."""
    known = column.is_valid().to_numpy(zero_copy_only=False)
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    term = pc.fill_null(pc.index_in(column.flatten(), value_set=terms), -1).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(column)), lengths)
    return row[term >= 0], term[term >= 0].astype(np.int64), np.where(known, lengths, -1)


def term_shape(words: DataFrame, terms: list[str]) -> tuple[np.ndarray, int, float]:
    """Documents of each term, of all, and their average length (null texts count as documents, not for the average), in
    one pass; tasks add up, Spark adds up the tasks."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed, total = pa.array(terms, pa.string()), np.zeros(len(terms) + 3, np.int64)
        for batch in batches:
            row, term, lengths = term_places(batch.column(0), listed)
            total[: len(terms)] += np.bincount(np.unique(row * len(terms) + term) % max(1, len(terms)), minlength=len(terms))
            total[-3:] += (len(lengths), (lengths >= 0).sum(), np.maximum(lengths, 0).sum())
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["i", "n"])

    total = np.zeros(len(terms) + 3, np.int64)
    for r in words.select("t").mapInArrow(count, "i long, n long").groupBy("i").agg(F.sum("n").alias("n")).collect():
        total[r["i"]] = r["n"]
    return total[: len(terms)], int(total[-3]), total[-1] / max(1, total[-2])


def bm25(docs: DataFrame, queries: DataFrame, k: int, key: str = "doc_id", text: str = "text", qkey: str = "item_id", k1: float = K1, b: float = B, title: str | None = None, stop: tuple[str, ...] = (), stem: Callable[[Column], Column] | None = None) -> DataFrame:
    """qkey, rank, key, score: the k best documents that share a term with the query; a title counts as text before it.

    Queries go out in blocks, as lists of terms with the queries that ask for them. One pass counts the terms'
    documents, a second one scores: a task looks its words up in the list, adds up each document's parts for all queries
    and keeps k documents per query, so neither words nor postings are shuffled.
    """
    spark = docs.sparkSession
    words = counted(docs, key, text, title, stop, stem).select(F.col(key).cast("long").alias("id"), "t")
    asked = queries.select(F.col(qkey).cast("long").alias("q"), F.explode(tokens(F.col(text), stop, stem)).alias("term")).groupBy("q", "term").agg(F.count(F.lit(1)).alias("m"))
    n, different = asked.agg(F.count_distinct("q"), F.count_distinct("term")).first()
    blocks, found = max(-(-n // QUERIES), -(-different // BROADCAST_TERMS)), None
    for block in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == block).collect()
        if not rows:
            continue
        terms, ids = sorted({r["term"] for r in rows}), sorted({r["q"] for r in rows})
        at, place = {t: i for i, t in enumerate(terms)}, {q: i for i, q in enumerate(ids)}
        df, total, average = term_shape(words, terms)
        idf = np.log(1 + (total - df + 0.5) / (df + 0.5))
        askers: list[list[tuple[int, float]]] = [[] for _ in terms]
        for r in rows:
            askers[at[r["term"]]].append((place[r["q"]], r["m"] * idf[at[r["term"]]]))
        held = spark.sparkContext.broadcast((terms, ids, [(np.array([q for q, _ in a]), np.array([w for _, w in a])) for a in askers]))

        def score(batches: Iterator[pa.RecordBatch], held=held, average=average) -> Iterator[pa.RecordBatch]:
            terms, ids, askers = held.value
            listed, mine, rows = pa.array(terms, pa.string()), Best(k, 6), max(64, SCORES // len(ids))
            for whole in batches:
                for first in range(0, whole.num_rows, rows):
                    batch = whole.slice(first, rows)
                    row, term, lengths = term_places(batch.column(1), listed)
                    cell, tf = np.unique(term * len(lengths) + row, return_counts=True)
                    term, row = np.divmod(cell, max(1, len(lengths)))
                    part = tf / (tf + k1 * (1 - b + b * lengths[row] / average))
                    s = np.zeros((len(ids), len(lengths)))
                    ends = np.searchsorted(term, np.arange(len(terms) + 1))
                    for t in np.unique(term).tolist():
                        here = slice(ends[t], ends[t + 1])
                        who, weight = askers[t]
                        s[np.ix_(who, row[here])] += weight[:, None] * part[here][None, :]
                    s[s == 0] = -np.inf
                    mine.see_all(0, batch.column(0).to_numpy(), s)
            yield pa.RecordBatch.from_arrays([pa.array(np.array(ids, np.int64)[mine.row]), pa.array(mine.id), pa.array(mine.score)], names=["q", "id", "score"])

        part = words.mapInArrow(score, "q long, id long, score double")
        found = part if found is None else found.unionAll(part)
    found = spark.createDataFrame([], "q long, id long, score double") if found is None else found
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "id"))
    found = found.withColumn("score", F.round("score", 6)).withColumn("rank", rank).where(F.col("rank") <= k)
    return found.select(F.col("q").alias(qkey), "rank", F.col("id").alias(key), "score")


def _scored(asked: DataFrame, posts: DataFrame, shape: DataFrame, k: int, key: str, qkey: str, k1: float, b: float) -> DataFrame:
    df = posts.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    part = F.col("tf") / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    idf = F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    scored = posts.join(df, "term").join(F.broadcast(shape)).select("term", key, (idf * part).alias("s"))
    total = asked.join(scored, "term").groupBy(qkey, key).agg(F.round(F.sum("s"), 6).alias("score"))
    rank = F.row_number().over(Window.partitionBy(qkey).orderBy(F.desc("score"), key))
    return total.withColumn("rank", rank).where(F.col("rank") <= k).select(qkey, "rank", key, "score")


def save_postings(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", title: str | None = None, stop: tuple[str, ...] = (), stem: Callable[[Column], Column] | None = None) -> None:
    """Writes postings, in order of the term within each file so that a read for few terms skips row groups, and the
    collection's shape."""
    d = counted(docs, key, text, title, stop, stem)
    posts = d.select(key, "dl", F.explode("t").alias("term")).groupBy("term", key, "dl").agg(F.count(F.lit(1)).alias("tf"))
    posts.sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/postings")
    d.agg(F.count(F.lit(1)).alias("docs"), F.avg("dl").alias("avgdl")).coalesce(1).write.mode("overwrite").parquet(f"{path}/shape")


def search_postings(spark: SparkSession, path: str, queries: DataFrame, k: int, key: str = "doc_id", text: str = "text", qkey: str = "item_id", k1: float = K1, b: float = B, stop: tuple[str, ...] = (), stem: Callable[[Column], Column] | None = None) -> DataFrame:
    """What ``bm25`` gives, from saved postings."""
    asked = queries.select(F.col(qkey), F.explode(tokens(F.col(text), stop, stem)).alias("term"))
    terms = asked.select("term").distinct()
    terms = F.broadcast(terms) if terms.count() <= BROADCAST_TERMS else terms
    posts = spark.read.parquet(f"{path}/postings").join(terms, "term", "left_semi")
    return _scored(asked, posts, spark.read.parquet(f"{path}/shape"), k, key, qkey, k1, b)

"""A corpus pipeline of five stages; each takes (spark, docs, sf_dir) and returns a DataFrame.

The first four return the columns of documents. ``run`` applies all to the documents table, writing each stage's
rows as Parquet for the next, as a scheduler would.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duelwise.llm import jaccard, language, lines, mixing, packing
from duelwise.llm.common import Scratch

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A text that no language's machine claims at least this much (0 to 1) is rejected, and so is one without a letter.
LEAST_CLAIM = 0.2


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a recognisable language: without a letter, claimed by no language, or less like any
    learned text than the table's own labelled texts are (``language.least_kin``).

    Null, empty and letterless texts are rejected, so are all texts if none is labelled. Rows without doc_id are judged,
    but not learned from; repeated rows get one answer; very long texts count whole. Columns other than those of documents go, whatever
    their names. An empty table gives an empty one.
    """
    docs = docs.select(*COLUMNS)
    train = docs.where(F.col("doc_id").isNotNull() & ~language.held_out())
    model = language.fit(train)
    least = language.least_kin(train, model)
    found = language.identify(docs, model)
    return found.where((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LEAST_CLAIM) & (F.col("kin") >= least)).select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes copied lines; a document that consists of nothing else goes.

    One occurrence of like lines stays, that of the smallest doc_id (null first). Null texts stay null, empty ones empty
    and lines of white space as they are; repeated rows are one document and lose the same lines; very long lines are
    compared whole. Columns other than those of documents go. An empty table gives an empty one.
    """
    found = lines.dedup_lines(docs.select(*COLUMNS)).where((F.col("n_removed") == 0) | (F.trim("text") != ""))
    return found.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies, the one of smallest id (null last), of several rows of that id one.

    Documents without words are linked with nothing and stay. An empty table gives an empty one; texts of any length
    are compared whole. Columns other than those of documents go.
    """
    docs = docs.select(*COLUMNS)
    scratch = Scratch(spark, "near")
    rows = scratch.save(jaccard.jaccard_rows(docs), "rows")
    best = F.min(F.struct(F.col("key").isNull().alias("none"), "key", "fp")).alias("best")
    chosen = rows.where("grp IS NOT NULL").groupBy("grp").agg(best).select("best.key", "best.fp").distinct()
    kept = scratch.save(rows.where("grp IS NULL").select("key", "fp").distinct().unionByName(chosen), "kept").select(F.col("key").alias("_key"), F.col("fp").alias("_fp"))
    same = lambda key, fp: F.col("_key").eqNullSafe(F.col(key)) & F.col("_fp").eqNullSafe(fp)
    out = docs.join(kept, same("doc_id", F.xxhash64("text")), "left_semi").select(*COLUMNS)
    repeated = rows.where("grp IS NOT NULL").groupBy("key", "fp").agg(F.count(F.lit(1)).alias("c")).where("c > 1").drop("c")
    repeated = repeated.join(kept, same("key", F.col("fp")), "left_semi").withColumnsRenamed({"key": "_key", "fp": "_fp"})
    if repeated.isEmpty():
        return out
    several = same("doc_id", F.xxhash64("text"))
    once = out.join(repeated, several, "left_semi").dropDuplicates(["doc_id", "text"])
    return out.join(repeated, several, "left_anti").unionByName(once)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or cuts documents, so that each source has the words of its target; the last one taken is cut inside.

    A null source is one of its own, the last. Documents without words, null texts too, stay once. Repeated rows are
    drawn each; very long texts are cut by words like others. Columns other than those of documents go. An empty table gives an empty one.
    """
    mixed = mixing.mix_shares(docs.select(*COLUMNS))
    whole = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size"))).otherwise(1).cast("int")
    rest = F.when(F.col("size") > 0, F.col("taken") % F.col("size")).otherwise(0).cast("int")
    copies = F.concat(F.array_repeat(F.lit(0), whole), F.when(rest > 0, F.array(rest)).otherwise(F.array().cast("array<int>")))
    spread = mixed.withColumn("_first", F.explode(copies))
    words = F.slice(F.regexp_extract_all("text", F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0)), F.lit(1), F.col("_first"))
    text = F.when(F.col("_first") == 0, F.col("text")).otherwise(F.array_join(words, ""))
    return spread.withColumn("text", text).withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long")).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents into sequences of 2048 tokens: one row per piece (``packing.PIECES``).

    A null or empty text is one end token; null ids stay null; repeated rows are packed each; long texts fill sequences of
    their own and a rest. Other columns play no part. An empty table gives no pieces.
    """
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("mix_sources", mix_sources),
    ("pack_sequences", pack_sequences),
]

#: Language scores, SimHash groups and token ids can't be expressed in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark, "pipeline")
    for name, stage in STAGES:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return docs

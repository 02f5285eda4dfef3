"""File sources and sinks: vote logs, passages, corpora, embeddings and result bundles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.display import cutoff_date

#: The keys of a vote record that the cleaner reads.
VOTE_SCHEMA = "tstamp double, task_type string, type string, models array<string>, ip string, `0_conv_id` string, `0_model_name` string, `1_conv_id` string, `1_model_name` string"
ACTIVITY_SCHEMA = "type string, tstamp double, model string, models array<string>"
BATTLE_SCHEMA = "model_a string, model_b string, winner string, judge string, anony boolean, tstamp double"
VOTE_TYPES = ("leftvote", "rightvote", "tievote", "bothbadvote", "bothbad_vote")


def append_events(events: DataFrame, path: str) -> None:
    """One JSON object per line, one folder per message type; committed as a whole."""
    events.write.mode("append").partitionBy("message_type").json(path)


def recent_logs(spark: SparkSession, path: str, most: int | None = None) -> list[str]:
    """Paths of conversation logs in order of modification; the last ``most`` if given. Lists files, reads none."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*-conv.json").option("recursiveFileLookup", "true").load(path)
    files = files.select("path", "modificationTime").orderBy(F.desc("modificationTime"), F.desc("path"))
    return [r["path"] for r in (files.limit(most) if most else files).collect()][::-1]


def read_activity(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """The four keys of the activity report, with their defaults."""
    d = spark.read.schema(ACTIVITY_SCHEMA).json(paths)
    return d.withColumns({"model": F.coalesce("model", F.lit("")), "models": F.coalesce("models", F.array(F.lit(""), F.lit("")))})


def read_votes(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Vote records only; a malformed line ends the read."""
    return spark.read.schema(VOTE_SCHEMA).option("mode", "FAILFAST").json(paths).where(F.col("type").isin(*VOTE_TYPES))


def read_battles(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of battles."""
    return spark.read.schema(BATTLE_SCHEMA).option("multiLine", True).json(path)


def write_battles(battles: DataFrame, path: str, cutoff: str | None = None) -> None:
    """JSON lines; with ``cutoff``, a path, also the local date of the last battle, as a file of one line. Battles without
    a time have no date: the file is empty then."""
    battles.write.mode("overwrite").json(path)
    if cutoff:
        last = battles.agg(F.max("tstamp").alias("t")).where("t IS NOT NULL")
        last.select(cutoff_date(F.timestamp_seconds("t"))).coalesce(1).write.mode("overwrite").text(cutoff)


def write_bundle(tables: dict[str, DataFrame], path: str, cutoff_date: str, task: str, scope: str) -> None:
    """Each result table as Parquet, partitioned by cutoff date, task and scope."""
    for name, df in tables.items():
        out = df.withColumns({"cutoff_date": F.lit(cutoff_date), "task": F.lit(task), "scope": F.lit(scope)})
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("cutoff_date", "task", "scope").parquet(f"{path}/{name}")


def read_leaderboard(spark: SparkSession, path: str) -> DataFrame:
    """Leaderboard CSV: '-' is missing, ratings are cut to whole numbers."""
    d = spark.read.option("header", True).option("escape", '"').csv(path)
    rating = lambda c: F.expr(f"cast(try_cast(nullif(`{c}`, '-') AS double) AS int)").alias(c)
    return d.select(*(rating(c) if "rating" in c else F.expr(f"nullif(`{c}`, '-')").alias(c) for c in d.columns))


def write_leaderboard(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


#: How names of result files begin or end, by kind.
KINDS = {"ratings": "elo_results_*", "leaderboard": "*_leaderboard.csv"}


def task_of(path: Column) -> Column:
    """The task that a result file's name holds; other names are an error."""
    name = F.element_at(F.split(path, "/"), -1)
    return F.when(name.contains("clustering"), "clustering").when(name.contains("retrieval"), "retrieval").when(name.contains("sts"), "sts").otherwise(F.raise_error(F.concat(F.lit("no task in "), path)))


def find_results(spark: SparkSession, path: str) -> DataFrame:
    """(kind, task, path) of the result files right in a folder: of each kind and task the last by name. Lists files,
    reads none; a file of a kind whose name has no task is an error."""
    found = None
    for kind, pattern in KINDS.items():
        part = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select(F.lit(kind).alias("kind"), task_of(F.col("path")).alias("task"), "path")
        found = part if found is None else found.unionAll(part)
    return found.groupBy("kind", "task").agg(F.max("path").alias("path"))


def numbered_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(line, value): the lines of files in the order of ``paths`` (those of a folder by name), numbered from 0 throughout.

    A line's number is what lies before its block of the file, by the blocks' counts, and its place in the block, which
    is contiguous in its partition; lines don't move, only a row per block does. Gzip files are one block each.
    """
    parts = [spark.read.text(path).select("value", F.lit(i).alias("_path"), "_metadata.file_path", "_metadata.file_block_start") for i, path in enumerate([paths] if isinstance(paths, str) else paths)]
    lines = parts[0]
    for p in parts[1:]:
        lines = lines.unionAll(p)
    block = ["_path", "file_path", "file_block_start"]
    lines = lines.withColumn("_at", F.monotonically_increasing_id())
    counts = lines.groupBy(*block).agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy(*block).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select(*block, (before - F.col("_first")).alias("_offset"))
    return lines.join(offsets, block).select((F.col("_at") + F.col("_offset")).alias("line"), "value")


def read_passages(spark: SparkSession, paths: str | list[str], most: int = -1, shard: tuple[int, int] | None = None) -> DataFrame:
    """id, title, text of passage JSONL (gzip too); a section extends the title; blank lines are null passages.

    ``most`` reads the first lines only; ``shard`` (rank, workers) every ``workers``-th line from ``rank`` on, so that the
    shards of all ranks are the whole, without overlap.
    """
    if most >= 0 or shard:
        lines = numbered_lines(spark, paths)
        lines = lines.where(F.col("line") < most) if most >= 0 else lines
        lines = lines.where(F.col("line") % shard[1] == shard[0]) if shard else lines
    else:
        lines = spark.read.text(paths)
    p = F.from_json(F.when(F.trim("value") != "", F.col("value")), "id string, title string, section string, text string, _id string")
    title = F.when(F.length("p.section") > 0, F.concat_ws(": ", "p.title", "p.section")).otherwise(F.col("p.title"))
    return lines.select(p.alias("p")).select(F.coalesce("p.id", "p._id").alias("id"), title.alias("title"), "p.text")


def read_corpus(df: DataFrame, columns: dict[str, str], limit: int | None = None) -> DataFrame:
    """Renames and prunes to the passage columns; a limit counts only above 1."""
    d = df.withColumnsRenamed(columns).select(*columns.values())
    return d.limit(limit) if limit and limit > 1 else d


def read_paired_dump(spark: SparkSession, path: str, keep: str = "_doc") -> DataFrame:
    """Lines in pairs: an action header, then the document; documents under another type are skipped."""
    lines = spark.read.text(path).select("value", F.input_file_name().alias("_file"), F.expr("input_file_block_start()").alias("_start"), F.monotonically_increasing_id().alias("_at"))
    # The line before is the header. A file may be read in several blocks: the last line of each goes before the next.
    before = F.lag("value").over(Window.partitionBy("_file", "_start").orderBy("_at"))
    last = lines.groupBy("_file", "_start").agg(F.max_by("value", "_at").alias("_last"))
    last = last.select("_file", "_start", F.lag("_last").over(Window.partitionBy("_file").orderBy("_start")).alias("_before"))
    rows = lines.withColumn("header", before).join(last, ["_file", "_start"]).withColumn("header", F.coalesce("header", "_before"))
    kind = F.get_json_object("header", "$.index._type")
    return rows.where(kind == keep).select(F.from_json("value", "title string, page_id string, source_text string").alias("d")).select("d.*")


def write_chunks(df: DataFrame, path: str, rows: int = 100_000) -> None:
    df.write.mode("overwrite").option("maxRecordsPerFile", rows).option("compression", "gzip").json(path)


def embedding_lines(df: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """{"id", "embedding"} with numbers as strings, one JSON object per row."""
    strings = F.transform(vector, lambda x: x.cast("double").cast("string"))
    return df.select(F.to_json(F.struct(F.col(key).cast("string").alias("id"), strings.alias("embedding"))).alias("value"))


def read_embedding_lines(lines: DataFrame) -> DataFrame:
    e = F.from_json("value", "id string, embedding array<string>")
    return lines.select(e.alias("e")).select("e.id", F.transform("e.embedding", lambda x: x.cast("float")).alias("embedding"))


def save_index(df: DataFrame, path: str, shards: int, key: str = "vec_id", overwrite: bool = True) -> None:
    """Contiguous key ranges as Parquet files."""
    df.repartitionByRange(shards, key).sortWithinPartitions(key).write.mode("overwrite" if overwrite else "ignore").parquet(path)


def load_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)

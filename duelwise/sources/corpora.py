"""Corpora by kind, indices that are loaded or built, small dimension files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import wikitext
from . import files


def arxiv(papers: DataFrame) -> DataFrame:
    """id, title, abstract, categories; white space of title and abstract is normalised."""
    return papers.select("id", T.collapse_whitespace(F.col("title")).alias("title"), T.collapse_whitespace(F.col("abstract")).alias("abstract"), "categories")


def short_texts(posts: DataFrame, words: int = 500) -> DataFrame:
    """id, text of posts with at most so many parts between single spaces."""
    return posts.where(F.size(F.split("text", " ")) <= words).select("id", "text")


def read_arxiv(spark: SparkSession, path: str) -> DataFrame:
    return arxiv(spark.read.schema("id string, title string, abstract string, categories string").json(path))


def read_stackexchange(spark: SparkSession, path: str, words: int = 500) -> DataFrame:
    """A folder of gzipped JSON lines."""
    return short_texts(spark.read.schema("id string, text string").option("pathGlobFilter", "*.json.gz").json(path), words)


def read_wikipedia(spark: SparkSession, path: str, words: int = 100, endings: tuple[str, ...] = ("See also", "References", "External links")) -> DataFrame:
    """A paired dump: pages are cleaned, chunked backwards and numbered as page-0, page-1, .."""
    pages = files.read_paired_dump(spark, path)
    chunks = T.backward_chunks(wikitext.clean_sections(F.col("source_text"), list(endings)), words, list(endings))
    d = pages.select("page_id", "title", F.posexplode(chunks).alias("i", "text"))
    return d.select(F.concat_ws("-", "page_id", F.col("i").cast("string")).alias("id"), "title", "text")


READERS: dict[str, Callable[..., DataFrame]] = {"wikipedia": read_wikipedia, "arxiv": read_arxiv, "stackexchange": read_stackexchange}


def read_kind(spark: SparkSession, kind: str, path: str, **options) -> DataFrame:
    """The passages of a corpus of that kind; an unknown kind is an error."""
    if kind not in READERS:
        raise NotImplementedError(f"no reader for corpus kind {kind}")
    return READERS[kind](spark, path, **options)


def custom_passage(spark: SparkSession, path_or_number: str) -> DataFrame:
    """A corpus of one passage: the file's text, or so many start marks."""
    if path_or_number.isdecimal():
        return spark.range(1).select(F.lit("").alias("title"), F.repeat(F.lit("<s>"), int(path_or_number)).alias("text"))
    return spark.read.text(path_or_number, wholetext=True).select(F.lit("").alias("title"), F.col("value").alias("text"))


def load_or_build(spark: SparkSession, path: str, build: Callable[[], DataFrame], shards: int = 1, key: str = "vec_id") -> DataFrame:
    """The index at the path; if there is none, what ``build`` gives is saved there first."""
    try:
        return files.load_index(spark, path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
    files.save_index(build(), path, shards, key)
    return files.load_index(spark, path)


def read_dimension(spark: SparkSession, path: str, section: str, key: str = "model") -> DataFrame:
    """A YAML file's section, a map of names to attributes, as one row of strings per name; attributes that a name lacks
    are null. Such files are lists of models, read by the driver."""
    import yaml

    held = yaml.safe_load("\n".join(r["value"] for r in spark.read.text(path, wholetext=True).collect()))[section]
    names = sorted({a for attributes in held.values() for a in attributes})
    text = lambda v: None if v is None else str(v)
    rows = [(name, *(text(attributes.get(a)) for a in names)) for name, attributes in held.items()]
    return spark.createDataFrame(rows, ", ".join(f"`{c}` string" for c in (key, *names)))

"""Text forms of labels, links, grids and times, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import HEADINGS

#: Fixed value: stands between the texts of one request.
SEPARATOR = "<|SEP|>"
#: Fixed value: a model's link in tables (address, name).
LINK = '<a target="_blank" href="%s" style="color: var(--link-text-color); text-decoration: underline;text-decoration-style: dotted;">%s</a>'
#: Fixed value: a console line of a rated model (rank, name, whole rating).
CONSOLE = "%2d, %-25s, %d"
ZONE, WINTER, SUMMER = "America/Los_Angeles", "PST", "PDT"


def unlabelled(c: Column, seat: int) -> Column:
    """The name without its revealed heading, wherever that stands in it."""
    return F.replace(c, F.lit(HEADINGS[seat]), F.lit(""))


def parts(c: Column) -> Column:
    return F.split(c, r"\Q" + SEPARATOR + r"\E")


def joined(c: Column) -> Column:
    return F.array_join(c, SEPARATOR)


def first_token(c: Column) -> Column:
    """What stands before the first space."""
    return F.substring_index(c, " ", 1)


def contains_any(c: Column, substrings: list[str]) -> Column:
    return F.exists(F.array(*map(F.lit, substrings)), lambda s: F.contains(c, s)) if substrings else F.lit(False)


def hyperlink(name: Column, address: Column) -> Column:
    return F.format_string(LINK, address, name)


def description_grid(models: DataFrame, key: str = "model", address: str = "link", text: str = "description", width: int = 3) -> DataFrame:
    """One markdown table of all models (a short list, one row each) in order of name, ``width`` to a line.

    A line is ended once it is full; the last one may be short and is then left open.
    """
    cell = F.concat(F.lit("["), F.col(key), F.lit("]("), F.col(address), F.lit("): "), F.col(text))
    cells = models.agg(F.sort_array(F.collect_list(F.struct(F.col(key).alias("k"), cell.alias("c")))).alias("s"))
    put = lambda x, i: F.concat(F.when(i % width == 0, "|").otherwise(""), F.lit(" "), x["c"], F.lit(" |"), F.when(i % width == width - 1, "\n").otherwise(""))
    head = "|" + " |" * width + "\n|" + " ---- |" * width + "\n"
    return cells.select(F.concat(F.lit(head), F.array_join(F.transform("s", put), "")).alias("grid"))


def local_time(ts: Column) -> Column:
    return F.from_utc_timestamp(ts, ZONE)


def local_stamp(ts: Column) -> Column:
    """Date, time and the zone's name in that season, e.g. 2024-01-31 08:15:00 PST."""
    offset = F.unix_seconds(local_time(ts)) - F.unix_seconds(ts)
    return F.concat(F.date_format(local_time(ts), "yyyy-MM-dd HH:mm:ss "), F.when(offset == -8 * 3600, WINTER).otherwise(SUMMER))


def cutoff_date(ts: Column) -> Column:
    return F.date_format(local_time(ts), "yyyyMMdd")


def log_name(ts: Column) -> Column:
    """The name of the day's conversation log."""
    return F.concat(F.date_format(ts, "yyyy-MM-dd"), F.lit("-conv.json"))


#: Where indices are kept, some by name, the others by corpus.
REGIONS = {
    "index_stackexchange_Salesforce__SFR-Embedding-2_R": "us-central1",
    "index_stackexchange_text-embedding-004": "us-central1",
    "index_stackexchange_intfloat__e5-mistral-7b-instruct": "us-central1",
    "index_stackexchange_voyage-multilingual-2": "us-central1",
    "index_wikipedia_text-embedding-004": "us-central1",
}
REGION_OF_CORPUS, OTHER_REGION = {"wikipedia": "us-east1", "stackexchange": "us-east1"}, "us-central1"


def index_name(model: Column, corpus: Column, own: dict[str, str] | None = None) -> Column:
    """The index of a model and corpus; ``own`` names those of some models outright."""
    path = F.replace(F.replace(model, F.lit("/"), F.lit("__")), F.lit(" "), F.lit("_"))
    name = F.replace(F.concat(F.lit("index_"), corpus, F.lit("_"), path), F.lit("."), F.lit("_"))
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in own.items() for x in kv]), model), name) if own else name


def region(name: Column, corpus: Column, regions: dict[str, str] = REGIONS, by_corpus: dict[str, str] = REGION_OF_CORPUS, other: str = OTHER_REGION) -> Column:
    look = lambda held, c: F.try_element_at(F.create_map(*[F.lit(x) for kv in held.items() for x in kv]), c)
    return F.coalesce(F.nullif(look(regions, name), F.lit("")), look(by_corpus, corpus), F.lit(other))

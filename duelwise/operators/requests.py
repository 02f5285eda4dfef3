"""Checks and routing of incoming requests, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _filled(c: str) -> Column:
    return F.coalesce(F.trim(c), F.lit(""))


def valid_group(*columns: str) -> Column:
    """True if no text is blank or null and no two are equal."""
    texts = F.array(*map(_filled, columns))
    return ~F.array_contains(texts, "") & (F.size(F.array_distinct(texts)) == len(columns))


def route(*selectors: str) -> Column:
    """'battle' if nobody chose a model, else 'side_by_side'; null counts as not chosen."""
    chosen = F.exists(F.array(*selectors), lambda s: F.coalesce(s, F.lit("")) != "")
    return F.when(chosen, "side_by_side").otherwise("battle")


def client_address(header: Column, host: Column) -> Column:
    """The proxy's header if it says anything, else the host, else an empty string."""
    return F.coalesce(F.nullif(header, F.lit("")), host, F.lit(""))


def can_be_added(text: Column, added: Column) -> Column:
    """True for a text that says something and isn't among those of its session yet; a session without texts is null or empty."""
    return (F.coalesce(text, F.lit("")) != "") & ~F.coalesce(F.array_contains(added, text), F.lit(False))


def chat_turns(messages: Column, text: str = "text") -> Column:
    """An array of structs as user and assistant in turn, whoever spoke; null stays null."""
    return F.transform(messages, lambda m, i: F.struct(F.when(i % 2 == 0, "user").otherwise("assistant").alias("role"), m[text].alias("content")))

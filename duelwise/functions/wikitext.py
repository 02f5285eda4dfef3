"""Wiki pages as plain text: markup is taken apart by one scan that follows nesting of any depth, the rest are expressions."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T

#: Links to these are left out, and tags with all that they hold.
MEDIA = ("file:", "image:", "media:")
DROPPED_TAGS = frozenset(("ref", "table", "tbody", "tr", "td", "th", "li", "ul", "infobox"))
#: Tags whose content isn't prose.
SILENT_TAGS = frozenset(("gallery", "imagemap", "math", "timeline", "score", "script", "style"))
#: Tags that never hold anything.
EMPTY_TAGS = frozenset(("br", "hr", "wbr", "img", "link", "meta"))

_TOKENS = re.compile(
    r"<!--|\{\{|\}\}|\[\[|\]\]|^[ \t]*\{\||^[ \t]*\|\}(?!\})|<(?P<end>/?)(?P<tag>[A-Za-z][A-Za-z0-9]*)(?:\s[^<>]*?|)(?P<alone>/?)>|^(?P<heading>=[^\n]*=)[ \t]*$",
    re.MULTILINE,
)
_ENTITY = re.compile(r"&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});")
_QUOTES, _LISTS = re.compile(r"'{2,}"), re.compile(r"^[*#:;]+[ \t]*", re.MULTILINE)
_OUTSIDE, _GAPS = re.compile(r"\[(?:https?:|ftp:)?//[^\s\[\]]+(?:[ \t]+([^\[\]\n]*))?\]"), re.compile(r"\n{3,}")


class _Frame:
    """Something that was opened: its kind (braces, brackets, table or a tag's name), the text that opened it, what it holds.

    ``held`` has texts and headings; a heading is a pair of its title and its line.
    """

    def __init__(self, kind: str, opened: str):
        self.kind, self.opened, self.held = kind, opened, []

    def text(self) -> str:
        return "".join(x if isinstance(x, str) else x[1] for x in self.held)


def _scanned(page: str, headings: bool = True) -> list:
    """Texts and headings of a page without comments, templates, tables, media links and dropped tags; links are their
    labels. What is opened and never closed, or closed and never opened, is text."""
    stack, waiting = [_Frame("", "")], {}

    def close(kind: str) -> _Frame | None:
        """The nearest open frame of the kind; what was opened inside it and not closed is text in it."""
        if not waiting.get(kind):
            return None
        over = []
        while stack[-1].kind != kind:
            over.append(stack.pop())
            waiting[over[-1].kind] -= 1
        found = stack.pop()
        waiting[kind] -= 1
        for f in reversed(over):
            found.held += [f.opened, *f.held]
        return found

    def open_(kind: str, opened: str) -> None:
        stack.append(_Frame(kind, opened))
        waiting[kind] = waiting.get(kind, 0) + 1

    at, last_comment = 0, page.rfind("-->")
    while m := _TOKENS.search(page, at):
        stack[-1].held.append(page[at : m.start()])
        at, token = m.end(), m[0]
        bare = token.lstrip(" \t")
        if token == "<!--":
            if at <= last_comment:
                at = page.index("-->", at) + 3
            else:
                stack[-1].held.append(token)
        elif bare in ("{{", "[[", "{|"):
            open_(bare, token)
        elif bare in ("}}", "|}"):
            if close({"}}": "{{", "|}": "{|"}[bare]) is None:
                stack[-1].held.append(token)
        elif bare == "]]":
            link = close("[[")
            if link is None:
                stack[-1].held.append(token)
            elif not (whole := link.text()).strip().lower().startswith(MEDIA):
                stack[-1].held.append(whole.partition("|")[2] or whole.partition("|")[0])
        elif m["heading"]:
            title = _title(m["heading"]) if headings else None
            stack[-1].held.append(token if title is None else (title, token))
        else:
            tag = m["tag"].lower()
            if m["alone"] or tag in EMPTY_TAGS:
                continue
            if not m["end"]:
                open_(f"<{tag}", token)
            elif (inner := close(f"<{tag}")) is None:
                stack[-1].held.append(token)
            elif tag not in DROPPED_TAGS and tag not in SILENT_TAGS:
                stack[-1].held += inner.held
    stack[-1].held.append(page[at:])
    return [x for k, f in enumerate(stack) for x in ([f.opened] if k else []) + f.held]


def _title(line: str) -> str | None:
    """What stands between as many marks on either side, six at most; a line of nothing else is no heading."""
    level = min(6, len(line) - len(line.lstrip("=")), len(line) - len(line.rstrip("=")))
    title = line[level:-level].strip()
    return "".join(x if isinstance(x, str) else x[1] for x in _scanned(title, False)) if title.strip("=") else None


def page_sections(page: str, endings: tuple[str, ...] = ()) -> list[str]:
    """The plain text of each section, its heading first, up to the first heading that contains an ending."""
    sections, heading = [[]], None
    for x in _scanned(page):
        if isinstance(x, str):
            sections[-1].append(x)
        else:
            heading = _plain(x[0])
            if any(e in heading for e in endings):
                break
            sections.append([heading])
    return [_GAPS.sub("\n\n", _plain(_LISTS.sub("", "".join(s)))).strip("\n") for s in sections]


def _plain(s: str) -> str:
    return _ENTITY.sub(lambda m: html.unescape(m[0]), _OUTSIDE.sub(lambda m: m[1] or "", _QUOTES.sub("", s)))


def sections(c: Column, endings: list[str] = ()) -> Column:
    """An array of the sections' texts (``page_sections``); null stays null."""

    @F.pandas_udf("array<string>")
    def run(pages: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for p in pages:
            yield p.map(lambda x: None if x is None else page_sections(x, tuple(endings)))

    return run(c)


def tidied(c: Column) -> Column:
    """What parsing leaves over goes in this order: table lines, tags, named templates, blank lines, other braces."""
    return T.strip_templates(T.strip_tags(T.drop_table_lines(c)))


def clean_sections(c: Column, endings: list[str] = ()) -> Column:
    """Tidied sections with an empty line between them, empty ones left out; null stays null."""
    return T.let(sections(c, endings), lambda s: F.array_join(F.filter(F.transform(s, tidied), lambda x: x != ""), "\n\n"))

"""Text expressions: label clean-up, whitespace, tags, paragraphs, chunks. All run inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The two headings that wrap a revealed model name (13 characters each).
HEADINGS = ("### Model A: ", "### Model B: ")


def strip_label(c: Column) -> Column:
    """<h3>...: X</h3>\\n -> X; a Model A/B heading -> X; anything else as it is."""
    h3 = F.startswith(c, F.lit("<h3>"))
    inner = F.substr(c, F.instr(c, F.lit(": ")) + F.lit(2), F.length(c) - F.instr(c, F.lit(": ")) - F.lit(7))
    heading = F.startswith(c, F.lit(HEADINGS[0])) | F.startswith(c, F.lit(HEADINGS[1]))
    return F.when(h3, inner).when(heading, F.substr(c, F.lit(14))).otherwise(c)


#: White space as in Unicode, for a character class of both Java's and RE2's expressions.
WHITE = r"\t-\r\x1c-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
#: Information separators are white space as well, but not to Java's class of Unicode's white space.
SEPARATORS = "\x1c\x1d\x1e\x1f"
SPACES = "\t\n\x0b\x0c\r" + SEPARATORS + " \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
#: White space within a line.
INLINE = r"[\t\x0b-\r\x1c-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]*"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value worked out once however often ``use`` names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def spaced(c: Column) -> Column:
    """c with separators as spaces; few texts have any, the others aren't copied."""
    odd = F.lit(False)
    for x in SEPARATORS:
        odd = odd | F.contains(c, F.lit(x))
    return F.when(odd, F.translate(c, SEPARATORS, " " * len(SEPARATORS))).otherwise(c)


def strip(c: Column) -> Column:
    """White space off both ends, in one pass however long its runs are."""
    return F.trim(c, F.lit(SPACES))


def collapse_whitespace(c: Column) -> Column:
    """Blank lines keep one empty line, every other run of white space becomes a space, ends are trimmed."""
    marked = F.regexp_replace(spaced(c), r"(?U)\n\s*\n", "\u0001")
    return F.trim(F.replace(F.regexp_replace(marked, r"(?U)\s+", " "), F.lit("\u0001"), F.lit("\n\n")), F.lit(" \n"))


def strip_tags(c: Column) -> Column:
    return F.regexp_replace(c, "<[^>]+>", "")


def drop_blank_lines(c: Column) -> Column:
    """The lines that hold something, stripped."""
    return strip(F.regexp_replace(c, r"(?U)(?<![\s\x1c-\x1f])[\s\x1c-\x1f]*\n[\s\x1c-\x1f]*", "\n"))


def strip_named_templates(c: Column) -> Column:
    """Without cite and infobox templates, each up to the first double braces that close."""
    return F.regexp_replace(F.regexp_replace(c, r"(?is)\{\{cite.*?\}\}", ""), r"(?is)\{\{infobox.*?\}\}", "")


def strip_braces(c: Column) -> Column:
    """Without what lies between the first opening and the last closing double braces; if any are left then, words that
    hold them go, and the others stand apart by single spaces."""
    first, last = F.instr(c, F.lit("{{")), F.length(c) - F.instr(F.reverse(c), F.lit("}}"))
    paired = (first > 0) & (F.instr(c, F.lit("}}")) > 0) & (last >= first + 2)
    inner = F.when(paired, F.concat(F.substr(c, F.lit(1), first - 1), F.substr(c, last + 2))).otherwise(c)
    held = lambda x: F.contains(x, F.lit("{{")) | F.contains(x, F.lit("}}"))
    words = lambda x: F.filter(F.split(strip(x), r"(?U)[\s\x1c-\x1f]+"), lambda w: ~held(w))
    return let(inner, lambda x: F.when(held(x), F.array_join(words(x), " ")).otherwise(x))


def strip_templates(c: Column) -> Column:
    """All three steps: named templates, blank lines, what is left of braces."""
    return strip_braces(drop_blank_lines(strip_named_templates(c)))


def drop_table_lines(c: Column) -> Column:
    """Removes table markup: lines from one that starts with {| or |- up to one with |}, and lines that start with a bar;
    white space before these doesn't count. One pass, whatever the number of lines."""
    lines = F.concat(F.lit("\n"), c)
    lines = F.regexp_replace(lines, rf"(?s)\n{INLINE}(?:\{{\||\|-).*?(?:\n{INLINE}\|\}}[^\n]*|\z)", "")
    return F.substr(F.regexp_replace(lines, rf"\n{INLINE}\|[^\n]*", ""), F.lit(2))


def word_count(c: Column) -> Column:
    return F.regexp_count(spaced(c), F.lit(r"(?U)\S+"))


def backward_chunks(c: Column, limit: int, endings: list[str] = (), lossless: bool = False, slack: int = 10, short: int = 5) -> Column:
    """Array of chunks, made from the last paragraph to the first.

    A paragraph joins the front of the buffer while the words stay within the limit (a paragraph under ``short`` words
    may exceed it up to ``slack``). Blank paragraphs and those that are one of the endings, ends stripped, are left out,
    and so are categories. Chunks are stripped. On overflow the buffer is a chunk and, as in the source data's convention, the
    paragraph that overflowed is lost; ``lossless`` starts the next buffer with it and drops empty chunks.

    Paragraphs are counted once; the fold goes over their numbers of words and notes where chunks begin and end, and the
    texts are cut by these places afterwards.
    """
    listed = (lambda p: strip(p).isin(*endings)) if endings else (lambda p: F.lit(False))
    counted = F.transform(F.split(c, "\n"), lambda p: F.struct(p.alias("t"), word_count(p).alias("w")))
    told = F.filter(F.reverse(counted), lambda p: (p["w"] > 0) & ~listed(p["t"]) & ~F.startswith(p["t"], F.lit("Category:")))
    # i paragraphs were seen; the buffer has n words of those after ``at``; cuts are (paragraphs before, paragraphs in it).
    cut = "array<struct<at:int,size:int>>"
    start = F.struct(F.lit(0).alias("i"), F.lit(0).alias("at"), F.lit(0).alias("n"), F.array().cast(cut).alias("cuts"))

    def step(acc: Column, w: Column) -> Column:
        fits = (acc["n"] + w <= limit) | ((w < short) & (acc["n"] < limit + slack))
        cuts = F.concat(acc["cuts"], F.array(F.struct(acc["at"].alias("at"), (acc["i"] - acc["at"]).alias("size"))))
        joined = F.struct((acc["i"] + 1).alias("i"), acc["at"].alias("at"), (acc["n"] + w).alias("n"), acc["cuts"].alias("cuts"))
        next_ = (acc["i"], w) if lossless else (acc["i"] + 1, F.lit(0))
        flushed = F.struct((acc["i"] + 1).alias("i"), next_[0].alias("at"), next_[1].alias("n"), cuts.alias("cuts"))
        return F.when(fits, joined).otherwise(flushed)

    def finish(acc: Column) -> Column:
        last = F.array(F.struct(acc["at"].alias("at"), (acc["i"] - acc["at"]).alias("size")))
        return F.reverse(F.when(acc["i"] > acc["at"], F.concat(acc["cuts"], last)).otherwise(acc["cuts"]))

    def chunks(p: Column) -> Column:
        cuts = F.aggregate(p["w"], start, step, finish)
        out = F.transform(cuts, lambda x: strip(F.array_join(F.reverse(F.slice(p["t"], x["at"] + 1, x["size"])), "\n")))
        return F.filter(out, lambda x: x != "") if lossless else out

    return let(told, chunks)

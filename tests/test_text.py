"""Text and wiki clean-up by the rules, at any nesting and length."""

import time

import pytest
from pyspark.sql import functions as F

from duelwise.functions import text as T
from duelwise.functions import wikitext


def one(spark, c, *texts):
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[0] for r in d.select("i", c(F.col("t")).alias("x")).orderBy("i").select("x").collect()]


@pytest.mark.parametrize("c", [T.strip, T.collapse_whitespace, T.drop_blank_lines, T.drop_table_lines, T.strip_templates, lambda c: F.size(T.backward_chunks(c, 60)), wikitext.clean_sections])
def test_long_runs_cost_one_pass(spark, c):
    runs = ["a" + " " * 500_000 + "b", "a" + "\n" * 500_000 + "b", "a" + " \n" * 250_000 + "b", "{{" * 200_000, "}}" * 200_000, "\n|" * 200_000]
    one(spark, c, "warm")
    start = time.time()
    one(spark, c, *runs)
    assert time.time() - start < 20


def test_white_space_is_pythons(spark):
    odd = [chr(k) for k in range(0x3100) if chr(k).isspace()]
    assert sorted(T.SPACES) == sorted(odd)
    texts = [f"{x}a{x}{x}b\n{x}\n{x}c{x}" for x in odd] + ["", " ", None, "a"]
    assert one(spark, T.strip, *texts) == [t and t.strip() for t in texts]
    assert one(spark, T.word_count, *texts) == [None if t is None else len(t.split()) for t in texts]
    assert one(spark, T.drop_blank_lines, *texts) == [None if t is None else "\n".join(x.strip() for x in t.split("\n") if x.strip()) for t in texts]


def lines_by_state(text):
    kept, inside = [], False
    for line in text.split("\n"):
        mark = line.strip()[:2]
        if mark in ("{|", "|-"):
            inside = True
        elif mark == "|}":
            inside = False
        elif not inside and not mark.startswith("|"):
            kept.append(line)
    return "\n".join(kept)


def test_table_lines(spark):
    texts = ["a\n  {| x\nb\n\t|}  y\nc", "{|\nnever closed", "|}\na", "a\n| b\n  | c\nd |", "|-\n{|\n|}\nx\n|}\n|y\n", "", "a", "\n\n", "a\n|", "|- \n  |} \nk\n\n"]
    assert one(spark, T.drop_table_lines, *texts) == [lines_by_state(t) for t in texts]


def test_braces(spark):
    texts = ["set {a} and }b{", "a {{x}} b {{y}} c", "a {{b c", "a }} b {{ c", "x {{cite\nweb}} {{INFObox y}} z", "{{a}} }}b {{c}}", "{{}}", "{{}", "", "{{cite a b", "one\n\n two}} {{three"]
    want = ["set {a} and }b{", "a  c", "a c", "a b c", "x   z", "", "", "", "", "a b", "one"]
    assert one(spark, T.strip_templates, *texts) == want


CHUNKED = [("\n".join(" ".join([c] * 6) for c in "abcd"), 14), ("Category:x\n\na b\n \nc", 3), ("a b c d\nx\ny y y y y y y\nz", 3), ("", 5), ("w " * 50 + "\n" + "v " * 50, 20)]


def chunks_by_loop(text, limit, endings):
    out, buf, n = [], "", 0
    for p in reversed(text.split("\n")):
        if p.strip() in ["", *endings] or p.startswith("Category:"):
            continue
        w = len(p.split())
        if n + w > limit and not (w < 5 and n < limit + 10):
            out.insert(0, buf.strip())
            buf, n = "", 0
        else:
            buf, n = p + "\n" + buf, n + w
    return [buf.strip(), *out] if buf.strip() else out


@pytest.mark.parametrize(("text", "limit"), CHUNKED)
def test_chunks(spark, text, limit):
    assert one(spark, lambda c: T.backward_chunks(c, limit), text) == [chunks_by_loop(text, limit, [])]
    assert one(spark, lambda c: T.backward_chunks(c, limit, ["z"]), text) == [chunks_by_loop(text, limit, ["z"])]
    whole = one(spark, lambda c: T.backward_chunks(c, limit, lossless=True), text)[0]
    assert " ".join(whole).split() == [w for line in text.split("\n") if not line.startswith("Category:") for w in line.split()]


def test_nested_markup():
    page = wikitext.page_sections
    assert page("x {{a|{{b|{{c}} d}} e}} y") == ["x  y"]
    assert page("x <ul><li>p<ul><li>q<ul><li>r</li></ul></li></ul></li></ul> y<li>z</li>") == ["x  y"]
    assert page("[[File:a|thumb|[[b|c [[d]]]] e]][[ image:x]] [[g|h [[i|j [[k]]]] l]] [[Media]]") == [" h j k l Media"]
    assert page("<ref>a {{b [[c]] }} <b>d</b></ref>e<REF name='x' />f<br>g<math>h</math>") == ["efg"]
    assert page("{|\n|-\n|\n{| \n| in {{t|}}\n|}\n|}\nafter") == ["after"]
    assert page("a <!-- {{ [[ --> b &amp; &nbsp;c &amp d '''e''' ''f''") == ["a  b & \xa0c &amp d e f"]
    assert page("* one\n# two\n:: three\n[//x y] [http://z] (https://w)") == ["one\ntwo\nthree\ny  (https://w)"]


def test_markup_that_is_not_closed():
    page = wikitext.page_sections
    assert page("a {{b [[c|d]] e") == ["a {{b d e"]
    assert page("a }} b ]] c </b> d") == ["a }} b ]] c </b> d"]
    assert page("{{a [[b }} c ]] d") == [" c ]] d"]
    assert page("<ul>a {{b}} c\n== H ==\nd") == ["<ul>a  c", "H\nd"]
    assert page("<!-- a") == ["<!-- a"]


def test_sections_and_headings():
    page = "lead\n== A ==\na\n=== '''B''' [[c|d]] ===\nb\n{{t|\n== not one ==\n}}\n== See also x ==\nlost\n== C ==\nlost"
    assert wikitext.page_sections(page, ("See also",)) == ["lead", "A\na", "B d\nb"]
    assert len(wikitext.page_sections(page)) == 5
    assert wikitext.page_sections("====\n== x\n= y =\nz") == ["====\n== x", "y\nz"]
    assert wikitext.page_sections("") == [""]


@pytest.mark.parametrize("s", ["{{", "[[", "<b>", "<!--", "== a ", "=", "[//a ", "\n{|", "'", "<a ", "[[a ]] ", "{{a|", "</b>"])
def test_scan_is_linear(s):
    start = time.time()
    wikitext.page_sections(s * 40_000)
    wikitext.page_sections(s * 40_000 + "}}]]</b>-->|}")
    assert time.time() - start < 5


def test_clean_pages(spark):
    pages = ["lead {{x\n{{y}}\n\n {|\n| z\n|}\n== A ==\n<i>a</i>\n\n== B ==\n== Sources ==\nc", None, "", "{{a}}"]
    assert one(spark, lambda c: wikitext.clean_sections(c, ["Sources"]), *pages) == ["lead\n\nA\na\n\nB", None, "", ""]

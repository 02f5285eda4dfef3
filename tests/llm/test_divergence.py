"""Source divergence against exact arithmetic in plain Python."""

import random
import re
from collections import Counter, defaultdict

import pytest

from duelwise.llm import divergence

DOCS = "doc_id long, text string, lang string, source string, value string, item string, rank string, term string, n string"


def brute(rows, least, top):
    docs = [(lang or "", source or "", [w.translate({c: c + 32 for c in range(65, 91)}) for w in re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", text or "")]) for text, lang, source in rows]
    df, n, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, words in docs:
        groups[lang].add(source)
        df[lang].update(set(words))
        n[lang, source].update(words)
    out = set()
    byte = lambda x: x[0].encode()
    for lang, sources in groups.items():
        kept = sorted(t for t, k in df[lang].items() if k >= least)
        share = lambda c: {t: 1 + 10**9 * (c[t] + 2) // (sum(c[x] for x in kept) + 2 * len(kept)) for t in kept}  # noqa: B023, E731
        f = lambda p, q: (p - q) ** 2 // (p + q)
        whole = share(sum((n[lang, s] for s in sources), Counter()))
        p = {s: share(n[lang, s]) for s in sources}
        for s in sources:
            pairs = [(o, sum(f(p[s][t], p[o][t]) for t in kept)) for o in sources if o != s]
            terms = [(t, f(p[s][t], whole[t])) for t in kept if n[lang, s][t] and p[s][t] > whole[t]]
            for part, found, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
                for rank, (item, value) in enumerate(sorted(sorted(found, key=byte), key=lambda x: -x[1])[:most], 1):
                    out.add((lang, s, part, item, value, rank))
    return out


def some_rows(seed, count):
    r = random.Random(seed)
    words = ["The", "the", "THE", "é", "É", "日本", "a", "b2c", "x-y", "ß", "\u0085z", "\x00q", *(f"w{chr(97 + k)}" for k in range(26))]
    rows = [(" ".join(r.choice(words[: r.choice([6, 20, 38])]) for _ in range(r.randint(0, 60))), r.choice(["en", "fr", None, ""]), r.choice(["s1", "s2", "s3", "é", None])) for _ in range(count)]
    return [*rows, *rows[:5], (None, "de", "only"), ("", "en", "bare"), ("solo " * 3000, "xx", "one"), ("w" * 50_000, "en", "s1"), ("123 456", "yy", "n1"), ("123", "yy", "n2")]


@pytest.mark.parametrize(("least", "held", "shard"), [(2, divergence.HELD_BYTES, divergence.SHARD_BYTES), (10, 500, 4000), (10_000, 10_000, 100_000)])
def test_divergence(spark, least, held, shard):
    rows = some_rows(least, 150)
    docs = spark.createDataFrame([(k, *r, "v", "i", "r", "t", "n") for k, r in enumerate(rows)], DOCS).repartition(3)
    got = [tuple(r[c] for c in ("lang", "source", "part", "item", "value", "rank")) for r in divergence.divergence(docs, least, 4, held, shard).collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute(rows, least, 4)


def test_divergence_of_nothing(spark):
    assert divergence.divergence(spark.createDataFrame([], DOCS)).count() == 0


def test_one_source_has_no_pairs(spark):
    docs = spark.createDataFrame([(1, "a b c", "en", "s", "", "", "", "", "")], DOCS)
    assert divergence.divergence(docs, 1).count() == 0


def test_shards_spill_apart(spark, monkeypatch):
    """Shards that memory can't hold, several at a time: none meets another's folder, and all rows come back."""
    monkeypatch.setattr(divergence, "MEMORY", "120MB")
    rows = spark.range(0, 3_200_000, 1, 4).selectExpr("'en' AS lang", "concat('s', id % 7) AS source", "concat('a rather long term ', id) AS term", "1L AS n", "10L AS df")
    got = divergence.by_shard(rows, 4, [], divergence._kept_sql(10), "lang string, term string, source string, n long, total long, head boolean", divergence.ADDED)
    assert got.selectExpr("count(*)", "sum(n)", "count_if(head)").first()[:] == (3_200_000,) * 3
    folders = [r[0] for r in divergence.by_shard(rows.limit(1000), 4, [], "SELECT current_setting('temp_directory') AS folder", "folder string").collect()]
    assert len(set(folders)) == len(folders) > 1


def test_shards_end_with_added_rows(spark, monkeypatch):
    """Rows of a shard are added up after its last batch, too."""
    monkeypatch.setattr(divergence, "FRESH", 0)
    rows = spark.range(0, 60_000, 1, 4).selectExpr("'en' AS lang", "concat('s', id % 3) AS source", "concat('t', id % 500) AS term", "2L AS n", "1L AS df")
    got = divergence.by_shard(rows, 3, [], divergence._kept_sql(10), "lang string, term string, source string, n long, total long, head boolean", divergence.ADDED)
    assert got.selectExpr("count(*)", "sum(n)", "sum(total)", "count_if(head)").first()[:] == (1500, 120_000, 360_000, 500)

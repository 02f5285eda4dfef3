"""The pipeline's stages, one by one, over odd rows: nulls, repeated rows, clashing names, long and empty texts, empty tables."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from duelwise.llm import language

R = random.Random(11)
WORDS = ["".join(R.choice("etaoinshrdlu") for _ in range(R.randint(2, 8))) for _ in range(300)]
#: Names that stages and operators use inside.
CLASHES = ["kin", "score", "lang_pred", "n_removed", "n_lines", "key", "fp", "_key", "grp", "size", "taken", "target", "source_size", "_first", "comp", "l1", "t", "y", "g"]


def prose(n):
    return " ".join(R.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    near = [prose(300) for _ in range(3)]
    rows = [(i, prose(R.randint(30, 200)), "en" if i % 3 else None, R.choice(["s1", "s2", None])) for i in range(60)]
    rows += [(100, None, "en", "s1"), (101, "", "en", "s1"), (102, " \n ", None, None), (103, prose(9000), "en", "s2"), (None, prose(80), "en", "s1")]
    for k, t in enumerate(near):
        rows += [(200 + 10 * k + j, t + f" tail{j}", "en", "s1") for j in range(4)]
    rows += [rows[5], rows[5], (rows[5][0], prose(50), "en", "s1"), (300, prose(12) + "\n" + near[0], "en", "s2")]
    full = [(i, t, lang, source, len(t or ""), *["clash"] * len(CLASHES)) for i, t, lang, source in rows]
    return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHES)).repartition(3).cache()


def rows_of(df):
    return Counter(tuple(r[c] for c in P.COLUMNS) for r in df.select(*P.COLUMNS).collect())


@pytest.mark.parametrize(("name", "stage"), P.STAGES)
def test_empty_tables_and_clashing_names(spark, odd, name, stage):
    assert stage(spark, odd.limit(0), "").count() == 0
    out = stage(spark, odd, "")
    if name != "pack_sequences":
        assert out.columns == P.COLUMNS
        assert rows_of(out) == rows_of(stage(spark, odd.select(*P.COLUMNS), ""))
        assert out.where("n_chars <> coalesce(length(text), 0)").count() == 0


def test_language_stage(spark, odd):
    junk = spark.createDataFrame([(900, "日本 語の 文書", None, "s", 8), (901, "0 1 2 3", None, "s", 7)], odd.select(*P.COLUMNS).schema)
    before, kept = rows_of(odd), rows_of(P.language_id(spark, odd.select(*P.COLUMNS).unionByName(junk), ""))
    assert not {900, 901, 100, 101, 102} & {r[0] for r in kept}
    assert kept == Counter({r: n for r, n in before.items() if r[1] and r[1].strip()})


def test_least_kin_is_that_of_all_labelled_texts(spark, monkeypatch):
    """The quantile of all, by numpy, however few texts the model learns from."""
    rng = random.Random(7)
    texts = [" ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 40))) for _ in range(400)] + ["", None]
    d = spark.createDataFrame([(t, "en" if i % 2 else "fr") for i, t in enumerate(texts)], "text string, lang string").repartition(3)
    monkeypatch.setattr(language, "TEXTS", 20)
    model = language.fit(d)
    near = []
    for t in filter(None, texts):
        buf = np.frombuffer(t.encode(), np.uint8)
        a, b = np.sort(model.kernel(buf, np.array([0, len(buf)]))[0])[-2:]
        near.append(a if b > 0.9999 else b)
    want = np.sort(near)[int(np.ceil(0.1 * len(near))) - 1]
    assert language.least_kin(d, model, quantile=0.1, share=1.0) == pytest.approx(want, abs=1.01 / language.LEVELS)


def test_nothing_is_kept_that_nothing_was_learned_of(spark, odd):
    assert P.language_id(spark, odd.withColumn("lang", F.lit(None).cast("string")), "").count() == 0


def test_line_stage(spark, odd):
    out = rows_of(P.line_dedup(spark, odd, ""))
    assert {r[0] for r in out} >= {100, 101, 102, 103}
    assert next(r for r in out if r[0] == 100)[1] is None
    again = rows_of(P.line_dedup(spark, spark.createDataFrame([r for r, n in out.items() for _ in range(n)], odd.select(*P.COLUMNS).schema), ""))
    assert again == out


def test_near_duplicate_stage(spark, odd):
    before, kept = rows_of(odd), rows_of(P.near_duplicates(spark, odd, ""))
    assert not kept - before
    ids = {r[0] for r in kept}
    assert {200, 210, 220} <= ids
    assert not ids & {201, 202, 203, 211, 212, 213, 221, 222, 223}
    copy = next(r for r, n in before.items() if n == 3)
    assert kept[copy] == 1
    assert ids >= {100, 101, 102, 103, None}


def test_mixing_stage(spark, odd):
    out = P.mix_sources(spark, odd, "")
    words = lambda d: {r["source"]: r["w"] for r in d.groupBy("source").agg(F.sum(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))).alias("w")).collect()}
    had, has = words(odd), words(out)
    assert set(had) == set(has)
    assert all(has[s] <= 3 * had[s] for s in had)
    assert abs(sum(has.values()) - sum(had.values())) <= len(had)
    assert {r["doc_id"] for r in out.collect()} >= {100, 101, 102}
    text = {r["doc_id"]: r["text"] for r in odd.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).collect()}
    assert all(text[r["doc_id"]].startswith(r["text"]) for r in out.where("doc_id > 199").collect())


def test_packing_stage(spark, odd):
    out = P.pack_sequences(spark, odd, "").collect()
    tokens = Counter()
    for r in out:
        tokens[r["doc_id"]] += r["length"]
    assert set(tokens) == {r[0] for r in rows_of(odd)}
    assert tokens[100] == tokens[101] == 1
    assert max(r["offset"] + r["length"] for r in out) <= 2048


def test_stages_in_a_row(spark, odd, tmp_path, monkeypatch):
    odd.select(*P.COLUMNS).write.parquet(str(tmp_path / "documents.parquet"))
    out = P.run(spark, str(tmp_path))
    kept = {r["doc_id"] for r in out.collect()}
    assert {103, 200, 210, 220, None} <= kept
    assert not kept & {100, 101, 102, 201, 211, 221}

"""Files written and read back, corpora by kind, saved indices, committed streams."""

import gzip
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from duelwise.operators import dispatch, lexical
from duelwise.sources import corpora, files
from duelwise.streaming import live


def lines(path, rows, opener=open):
    path.parent.mkdir(parents=True, exist_ok=True)
    with opener(path, "wt") as f:
        f.write("".join(json.dumps(r) + "\n" for r in rows))
    return str(path)


DOCS = [(1, "the red fox runs"), (2, "a blue fox sleeps"), (3, "red red wine"), (4, None), (5, "")]


def docs(spark):
    return spark.createDataFrame(DOCS, "doc_id long, text string")


def test_saved_postings_find_what_bm25_finds(spark, tmp_path):
    asked = spark.createDataFrame([(1, "red fox"), (2, "wine"), (3, "unknown")], "item_id long, text string")
    lexical.save_postings(docs(spark), str(tmp_path / "i"))
    want = sorted(lexical.bm25(docs(spark), asked, 2).collect())
    assert want and sorted(lexical.search_postings(spark, str(tmp_path / "i"), asked, 2).collect()) == want


def test_index_is_built_once(spark, tmp_path):
    calls = []

    def build():
        calls.append(1)
        return spark.range(10).select(F.col("id").alias("vec_id"), F.array(F.lit(1.0)).alias("embedding"))

    for _ in range(2):
        assert corpora.load_or_build(spark, str(tmp_path / "i"), build, 3).count() == 10
    assert len(calls) == 1


def test_index_shards_are_ranges(spark, tmp_path):
    files.save_index(spark.range(100).withColumnRenamed("id", "vec_id"), str(tmp_path / "i"), 4)
    parts = files.load_index(spark, str(tmp_path / "i")).groupBy(F.input_file_name()).agg(F.min("vec_id").alias("a"), F.max("vec_id").alias("b")).orderBy("a").collect()
    assert len(parts) == 4
    assert all(x["b"] < y["a"] for x, y in zip(parts, parts[1:], strict=False))


def test_corpora_by_kind(spark, tmp_path):
    arxiv = lines(tmp_path / "a.json", [{"id": "1", "title": " A\n b ", "abstract": "x\n \ny  z", "categories": "cs", "more": 1}])
    assert [tuple(r) for r in corpora.read_kind(spark, "arxiv", arxiv).collect()] == [("1", "A b", "x\n\ny z", "cs")]
    lines(tmp_path / "s" / "p.json.gz", [{"id": "1", "text": "a b"}, {"id": "2", "text": "a b c"}], gzip.open)
    lines(tmp_path / "s" / "skipped.json", [{"id": "3", "text": "a"}])
    assert [r["id"] for r in corpora.read_kind(spark, "stackexchange", str(tmp_path / "s"), words=2).collect()] == ["1"]
    dump = lines(tmp_path / "w.json", [{"index": {"_type": "_doc"}}, {"title": "T", "page_id": "7", "source_text": "one two three four five six\nseven [[eight]] nine ten eleven twelve\n== See also ==\ngone"}])
    found = corpora.read_kind(spark, "wikipedia", dump).collect()
    assert [(r["id"], r["title"]) for r in found] == [("7-0", "T")]
    assert "eight" in found[0]["text"] and "gone" not in found[0]["text"]
    with pytest.raises(NotImplementedError):
        corpora.read_kind(spark, "other", arxiv)


def test_custom_passage(spark, tmp_path):
    assert corpora.custom_passage(spark, "3").collect()[0]["text"] == "<s><s><s>"
    (tmp_path / "t.txt").write_text("two\nlines")
    assert [tuple(r) for r in corpora.custom_passage(spark, str(tmp_path / "t.txt")).collect()] == [("", "two\nlines")]


def test_dimension_file(spark, tmp_path):
    pytest.importorskip("yaml")
    (tmp_path / "m.yml").write_text("models:\n  a/x:\n    link: l\n    dim: 3\n  b:\n    link: k\n")
    got = {r["model"]: (r["link"], r["dim"]) for r in corpora.read_dimension(spark, str(tmp_path / "m.yml"), "models").collect()}
    assert got == {"a/x": ("l", "3"), "b": ("k", None)}


def test_committed_rows_appear_once(spark, tmp_path):
    schema = "message_type string, n long"
    for k in range(2):
        lines(tmp_path / "in" / f"{k}.json", [{"message_type": "chat", "n": k}, {"message_type": "vote", "n": k}])
        stream = spark.readStream.schema(schema).json(str(tmp_path / "in"))
        live.committed(stream, str(tmp_path / "out"), str(tmp_path / "check"), every=None).awaitTermination()
    got = spark.read.json(str(tmp_path / "out"))
    assert sorted((r["message_type"], r["n"]) for r in got.collect()) == [("chat", 0), ("chat", 1), ("vote", 0), ("vote", 1)]


def test_votes_with_a_malformed_line_end_the_read(spark, tmp_path):
    path = lines(tmp_path / "v.json", [{"type": "leftvote", "tstamp": 1.0}, {"type": "chat", "tstamp": 2.0}])
    assert [r["type"] for r in files.read_votes(spark, path).collect()] == ["leftvote"]
    with open(path, "a") as f:
        f.write("{broken\n")
    with pytest.raises(Exception, match="MALFORMED"):
        files.read_votes(spark, path).collect()


def test_leaderboard_file(spark, tmp_path):
    d = spark.createDataFrame([("a", "1201.7", "-"), ("b", "-", "x,\"y\"")], "model string, `elo rating` string, note string")
    files.write_leaderboard(d, str(tmp_path / "l"))
    got = sorted(tuple(r) for r in files.read_leaderboard(spark, str(tmp_path / "l")).collect())
    assert [r[:2] for r in got] == [("a", 1201), ("b", None)]
    assert got[0][2] is None


def test_bundle_overwrites_its_own_part_only(spark, tmp_path):
    for day, n in (("20240101", 1), ("20240102", 2), ("20240101", 3)):
        files.write_bundle({"t": spark.range(n)}, str(tmp_path / "b"), day, "sts", "full")
    got = {str(r["cutoff_date"]): r["count"] for r in spark.read.parquet(str(tmp_path / "b" / "t")).groupBy("cutoff_date").count().collect()}
    assert got == {"20240101": 3, "20240102": 2}


def test_battles_and_logs(spark, tmp_path):
    (tmp_path / "b.json").write_text(json.dumps([{"model_a": "x", "model_b": "y", "winner": "tie", "anony": True, "tstamp": 1.5}]))
    assert [r["winner"] for r in files.read_battles(spark, str(tmp_path / "b.json")).collect()] == ["tie"]
    for name in ("1-conv.json", "2-conv.json", "other.json"):
        lines(tmp_path / "logs" / name, [{}])
    assert len(files.recent_logs(spark, str(tmp_path / "logs"))) == 2
    assert len(files.recent_logs(spark, str(tmp_path / "logs"), 1)) == 1


def test_corpus_columns_and_split_output(spark, tmp_path):
    d = files.read_corpus(docs(spark).withColumn("x", F.lit(1)), {"doc_id": "id", "text": "text"}, 3)
    assert d.columns == ["id", "text"] and d.count() == 3
    files.write_chunks(docs(spark).coalesce(1), str(tmp_path / "c"), 2)
    assert len(list((tmp_path / "c").glob("*.json.gz"))) == 3


def test_encoder_is_injected_and_instructed(spark):
    def length(texts):
        return np.array([[len(t), 1.0] for t in texts])

    got = {r["doc_id"]: r["embedding"] for r in dispatch.encode(docs(spark), length, "doc_id", instruction="go: ", rows=2).collect()}
    assert got == {k: [len(t or "") + 4.0, 1.0] for k, t in DOCS}


def test_methods_agree_on_the_best(spark):
    asked = spark.createDataFrame([(1, "blue fox sleeps"), (2, "red wine")], "item_id long, text string")
    for method in ("bm25", "exact", "approximate"):
        model = dispatch.Model(method, method, dispatch.HashedWords(256))
        found = docs(spark).unionByName(spark.range(10, 60).selectExpr("id AS doc_id", "concat('filler', id) AS text"))
        got = {r["item_id"]: (r["doc_id"], r["passage"]) for r in dispatch.retrieve(asked, found, "wikipedia", model).collect()}
        assert got == {1: (2, "\n\na blue fox sleeps"), 2: (3, "\n\nred red wine")}
    with pytest.raises(ValueError, match="unknown"):
        dispatch.retrieve(asked, docs(spark), "wikipedia", dispatch.Model("x", "other"))

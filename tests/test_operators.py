"""Hand-sized cases of rating, cleaning and text rules."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from duelwise.functions import text as T
from duelwise.functions import wikitext
from duelwise.operators import agreement, clean, matrix, ratings, requests, retrieval
from duelwise.sources import files
from duelwise.streaming import live


def battles(spark, rows):
    return spark.createDataFrame([(i, float(i), *r) for i, r in enumerate(rows)], "battle_id long, tstamp double, model_a string, model_b string, winner string")


def test_elo_steps(spark):
    tie = {r["model"]: r["rating"] for r in ratings.online_elo(battles(spark, [("x", "y", "tie")])).collect()}
    assert tie == {"x": 1000.0, "y": 1000.0}
    win = {r["model"]: r["rating"] for r in ratings.online_elo(battles(spark, [("x", "y", "model_a")])).collect()}
    assert win == {"x": 1002.0, "y": 998.0}


def test_elo_keeps_the_sum(spark):
    rng = np.random.default_rng(0)
    rows = [(f"m{a}", f"m{b}", w) for a, b, w in zip(rng.integers(0, 3, 200), rng.integers(3, 6, 200), rng.choice(["model_a", "model_b", "tie"], 200), strict=True)]
    assert sum(r["rating"] for r in ratings.online_elo(battles(spark, rows)).collect()) == pytest.approx(6000)


def test_bradley_terry_is_symmetric_and_anchored(spark):
    b = battles(spark, [("x", "y", "model_a"), ("y", "x", "model_a"), ("x", "llama-13b", "model_a")])
    got = {r["model"]: r["rating"] for r in ratings.bradley_terry(ratings.outcome_counts(b)).collect()}
    assert got["llama-13b"] == pytest.approx(800)
    even = battles(spark, [("x", "y", "tie")])
    assert [r["rating"] for r in ratings.bradley_terry(ratings.outcome_counts(even)).collect()] == pytest.approx([1000, 1000])


def test_strict_votes(spark):
    with pytest.raises(Exception, match="one seat only"):
        matrix.votes_per_model(battles(spark, [("x", "y", "tie"), ("y", "z", "tie")]), strict=True).collect()


def test_compat_fractions(spark):
    b = battles(spark, [("x", "y", "model_a"), ("y", "z", "model_b"), ("z", "x", "model_a")])
    fixed = {(r["model"], r["opponent"]): r["fraction"] for r in matrix.win_fractions(b).collect()}
    assert fixed["x", "y"] + fixed["y", "x"] == 1
    assert len(fixed) == 6


def test_labels(spark):
    d = spark.createDataFrame([("### Model A: m",), ("<h3>Model: m</h3>\n",), ("m",), ("",)], "c string")
    assert [r[0] for r in d.select(T.strip_label(F.col("c"))).collect()] == ["m", "m", "m", ""]


def test_chunks_lose_the_overflowing_paragraph(spark):
    p = [" ".join([c] * 6) for c in "abcd"]
    d = spark.createDataFrame([("\n".join(p),)], "t string")
    assert d.select(T.backward_chunks(F.col("t"), 14)).first()[0] == [p[0], p[2] + "\n" + p[3]]
    assert d.select(T.backward_chunks(F.col("t"), 14, lossless=True)).first()[0] == [p[0] + "\n" + p[1], p[2] + "\n" + p[3]]


def test_equal_cosines_give_no_triangle(spark):
    d = spark.createDataFrame([([1.0, 0.0],) * 3], "a array<double>, b array<double>, c array<double>")
    assert retrieval.triangle(d, "a", "b", "c").first()["cx"] is None


def test_unknown_vote_is_an_error(spark):
    d = spark.createDataFrame([(1, "ok", "odd", "x", "y", True, 1.0, 1)], "event_id long, status string, type string, model_a string, model_b string, anony boolean, tstamp double, ip long")
    with pytest.raises(Exception, match="unknown vote"):
        clean.clean_battles(d).collect()


def test_log_round_trip(spark, tmp_path):
    d = spark.createDataFrame([("leftvote", 1.0, "votes"), ("chat", 2.0, "votes")], "type string, tstamp double, message_type string")
    files.append_events(d, str(tmp_path / "log"))
    assert files.read_votes(spark, str(tmp_path / "log")).count() == 1
    assert files.read_activity(spark, str(tmp_path / "log")).first()["models"] == ["", ""]


def test_sections_end_at_the_listed_heading(spark):
    t = "A '''b''' [[x|y]] [[z]]{{Infobox q|{{r}}}}<ref>n</ref>[[Image:p.png|[[l]]]]\n== Life ==\nc [http://h.i j k]\n=== See also this ===\nrest"
    d = spark.createDataFrame([(t,), ("",), (None,), ("plain",)], "t string")
    assert [r[0] for r in d.select(wikitext.clean_sections(F.col("t"), ["See also"])).collect()] == ["A b y z\n\nLife\nc j k", "", None, "plain"]
    assert d.select(wikitext.clean_sections(F.col("t"))).first()[0].endswith("See also this\nrest")


def test_requests(spark):
    d = spark.createDataFrame([("x", "y", ""), ("x", " x", None), (None, "y", "m"), (" ", "y", "")], "a string, b string, c string")
    assert [r[0] for r in d.select(requests.valid_group("a", "b")).collect()] == [True, False, False, False]
    assert [r[0] for r in d.select(requests.route("c")).collect()] == ["battle", "battle", "side_by_side", "battle"]
    assert [r[0] for r in d.select(requests.client_address(F.col("c"), F.col("a"))).collect()] == ["x", "x", "m", " "]


def test_agreement(spark):
    x, y = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(1, "a"), (3, "c")], "k int, v string")
    assert {r["k"]: r["agree"] for r in agreement.answers(x, y, "k", "v").collect()} == {1: True, 2: False, 3: False}
    assert agreement.positional(x, y, "k").first()[:] == (1, 2, 2)
    assert agreement.positional(x.limit(0), y, "k").first()[:] == (0, 0, 2)


def test_live_sessions(spark, tmp_path):
    """A stream gives the sessions that the table gives."""
    rows = spark.createDataFrame([("u", 0, "a"), ("u", 60, "b"), ("u", 9000, "c"), ("w", 5, "d")], "user string, s long, prompt string")
    rows.selectExpr("user", "timestamp_seconds(s) AS ts", "prompt").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("user string, ts timestamp, prompt string").parquet(str(tmp_path / "in")).withWatermark("ts", "1 hour")
    q = live.sessions(stream, "user", "prompt").writeStream.format("memory").queryName("live_sessions").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    assert sorted((r["user"], r["history"]) for r in spark.table("live_sessions").collect()) == [("u", ["a", "b"]), ("u", ["c"]), ("w", ["d"])]


def test_named_votes_without_hidden_names(spark):
    rows = [(1, "", "", "x", "y"), (2, " ", None, "Model A", "Model B"), (3, "h", "i", "x", "y"), (4, "x", "y", "### Model A: x", "y"), (5, "h", "i", "", ""), (6, "h", "i", "x", "")]
    v = spark.createDataFrame([(k, "leftvote", "STS", "a", float(k), *r) for k, *r in rows], "event_id long, type string, task_type string, ip string, tstamp double, hidden_a string, hidden_b string, public_a string, public_b string")
    got = {r["event_id"]: (r["status"], r["anony"], r["model_a"], r["model_b"]) for r in clean.with_status(v, "sts").collect()}
    assert got[1] == ("ok", False, "x", "y") and got[2] == ("ok", True, "Model A", "Model B") and got[3][0] == "mismatch"
    assert got[4] == ("ok", False, "x", "y") and got[5] == ("ok", True, "h", "i") and got[6][0] == "invalid"


def test_paired_dump_across_splits(spark, tmp_path):
    import json

    lines = []
    for k in range(200):
        lines += [json.dumps({"index": {"_type": "_doc" if k % 10 else "page"}}), json.dumps({"title": f"t{k}", "page_id": str(k), "source_text": "x" * (k % 37)})]
    (tmp_path / "dump.json").write_text("\n".join(lines) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        assert sorted(int(r["page_id"]) for r in files.read_paired_dump(spark, str(tmp_path)).collect()) == [k for k in range(200) if k % 10]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_white_space_of_any_kind(spark):
    d = spark.createDataFrame([("\n \n lead\u00a0 x\n\u2003\n end \u3000",)], "t string")
    assert d.select(T.collapse_whitespace(F.col("t"))).first()[0] == "lead x\n\n end"
    d = spark.createDataFrame([("one two\n\u00a0 \n References \nthree",)], "t string")
    assert d.select(T.backward_chunks(F.col("t"), 60, ["References"])).first()[0] == ["one two\nthree"]


def test_knn_leaves_out_null_vectors(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [None, 1.0]), (4, [0.5, 0.0])], "vec_id long, embedding array<double>")
    got = [(r["query_id"], r["vec_id"]) for r in retrieval.knn(rows, rows, 2).orderBy("query_id", "rank").collect()]
    assert got == [(1, 1), (1, 4), (4, 1), (4, 4)]

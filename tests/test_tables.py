"""Sharded reads, workers' caches, label-aligned tables, boards, counters and draws of outcomes."""

import gzip
import hashlib
import json
import os
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from duelwise.functions import display
from duelwise.operators import clean, dispatch, leaderboard, matrix, ratings, requests, retrieval
from duelwise.operators.ranks import positions
from duelwise.sources import files


@pytest.fixture
def small_splits(spark):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
    spark.conf.set("spark.sql.files.openCostInBytes", before[1])


def passage_files(path):
    """Three files, one gzipped, with blank lines; the names aren't in the order that they are read in."""
    lines, names = [], ["b.jsonl", "a.jsonl", "c.jsonl.gz"]
    for f, n in zip(names, (120, 7, 90), strict=True):
        own = []
        for k in range(n):
            item = {"_id": f"{f}-{k}", "title": f"t{k}", "text": "x" * (k * 7 % 50)}
            if k % 3 == 0:
                item["section"] = "" if k % 2 else f"s{k}"
            own.append("  " if k % 11 == 5 else json.dumps(item))
        data = ("\n".join(own) + "\n").encode()
        (path / f).write_bytes(gzip.compress(data) if f.endswith("gz") else data)
        lines += own
    return [str(path / f) for f in names], lines


def loaded(line):
    if not line.strip():
        return (None, None, None)
    x = json.loads(line)
    return (x["_id"], f"{x['title']}: {x['section']}" if x.get("section") else x["title"], x["text"])


def test_numbered_lines(spark, tmp_path, small_splits):
    paths, lines = passage_files(tmp_path)
    assert spark.read.text(paths).rdd.getNumPartitions() > 5
    got = sorted(map(tuple, files.numbered_lines(spark, paths).collect()))
    assert got == list(enumerate(lines))


@pytest.mark.parametrize(("workers", "most"), [(1, -1), (3, -1), (4, 50), (2, 0), (5, 10_000)])
def test_passage_shards(spark, tmp_path, small_splits, workers, most):
    paths, lines = passage_files(tmp_path)
    lines = lines if most < 0 else lines[:most]
    for rank in range(workers):
        got = Counter(map(tuple, files.read_passages(spark, paths, most, (rank, workers)).collect()))
        assert got == Counter(map(loaded, lines[rank::workers]))


def test_passages_without_shards(spark, tmp_path):
    paths, lines = passage_files(tmp_path)
    assert Counter(map(tuple, files.read_passages(spark, paths).collect())) == Counter(map(loaded, lines))
    assert Counter(map(tuple, files.read_passages(spark, paths, 130).collect())) == Counter(map(loaded, lines[:130]))


def loading(folder, name):
    def load():
        with open(f"{folder}/{name}-{os.getpid()}", "a") as f:
            f.write("x")
        return lambda texts, **hints: np.array([[float(len(t)), float(len(hints))] for t in texts])

    return load


def test_encoders_are_loaded_once_a_worker(spark, tmp_path):
    rows = [(i, "a" * (i % 5) if i % 7 else None, ["m", "nomic-ai/nomic-embed-text-v1"][i % 2], ["sts", "clustering", None][i % 3]) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, text string, model string, task string").repartition(8)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    try:
        loaders = {n: loading(tmp_path, n.replace("/", "_")) for n in ("m", "nomic-ai/nomic-embed-text-v1")}
        for _ in range(2):
            got = {r["id"]: (r["model"], r["task"], r["embedding"]) for r in dispatch.encode_requests(df, loaders, "id").collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for i, text, model, task in rows:
        assert got[i] == (model, task, [len(text or ""), 1.0 if task and model != "m" else 0.0])
    loads = {f.name: len(f.read_text()) for f in tmp_path.iterdir()}
    # Eighty batches in sixteen tasks of two queries: a worker loads a model once.
    assert set(loads.values()) == {1}
    assert len({f.rpartition("-")[0] for f in loads}) == 2
    with pytest.raises(Exception, match="no loader for model"):
        dispatch.encode_requests(df, {}, "id").collect()


def test_held():
    made, held = [], dispatch.Held(2)
    load = lambda k: lambda: made.append(k) or k
    assert [held.get(k, load(k)) for k in "abab"] == list("abab")
    assert made == ["a", "b"]
    held.get("c", load("c"))
    held.get("b", load("b"))
    held.get("a", load("a"))
    assert made == ["a", "b", "c", "a"]


def test_indices(spark, tmp_path):
    built, indices = [], dispatch.Indices(str(tmp_path))
    make = lambda: built.append(1) or spark.createDataFrame([(1, [1.0]), (2, [2.0])], "doc_id long, embedding array<double>")
    first = indices.get(spark, "org/m", "wiki", make)
    assert indices.get(spark, "org/m", "wiki", make) is first
    assert first.is_cached
    assert first.count() == 2
    assert indices.get(spark, "org/m", "arxiv", make) is not first
    assert len(built) == 2
    indices.release()
    assert dispatch.Indices(str(tmp_path)).get(spark, "org/m", "wiki", make).count() == 2
    assert len(built) == 2


def battles(spark, rows):
    return spark.createDataFrame([(i, float(i), *r) for i, r in enumerate(rows)], "battle_id long, tstamp double, model_a string, model_b string, winner string")


def test_compat_fractions(spark):
    """Three battles leave one cell of nine."""
    b = battles(spark, [("x", "y", "model_a"), ("y", "z", "model_b"), ("z", "x", "model_a"), ("x", "w", "tie")])
    got = {(r["model"], r["opponent"]): r["fraction"] for r in matrix.win_fractions_compat(b).collect()}
    assert len(got) == 9
    assert {k: v for k, v in got.items() if v is not None} == {("z", "y"): 1.0}
    assert matrix.win_fractions_compat(b.limit(0)).count() == 0


def test_rating_systems(spark):
    rows = [("x", "y", "model_a")] * 30 + [("y", "z", "model_a")] * 20 + [("x", "z", "tie")] * 5
    b = battles(spark, rows)
    order = lambda d: [r["model"] for r in d.orderBy(F.desc("rating")).collect()]
    assert order(ratings.rate(b)) == order(ratings.rate(b, "elo", 20)) == ["x", "y", "z"]
    assert dict(ratings.rate(b, "elo", 5).dtypes)["rating"] == "int"
    apart = {r["model"]: r["rating"] for r in ratings.rate(b, exclude_tie=True).collect()}
    assert apart["x"] - apart["z"] > 100
    with pytest.raises(ValueError, match="other"):
        ratings.rate(b, "other")


def test_draws_of_outcomes(spark):
    b = battles(spark, [("x", "y", "model_a")] * 60 + [("x", "y", "tie")] * 30 + [("y", "x", "model_b")] * 10)
    for draw in (ratings.bootstrap_counts, ratings.multinomial_counts):
        rows = draw(b, 300).collect()
        per_round = Counter()
        n = {}
        for r in rows:
            per_round[r["round"]] += r["n"]
            n.setdefault((r["model_a"], r["winner"]), []).append(r["n"])
        assert set(per_round.values()) == {100}
        assert len(per_round) == 300
        for cell, share in ((("x", "model_a"), 0.6), (("x", "tie"), 0.3), (("y", "model_b"), 0.1)):
            x = np.array(n[cell] + [0] * (300 - len(n[cell])))
            assert x.mean() == pytest.approx(100 * share, abs=1.5)
            assert x.var() == pytest.approx(100 * share * (1 - share), rel=0.35)
        assert draw(b.limit(0), 3).count() == 0
        assert {r["n"] for r in draw(b.limit(7), 4).collect()} == {7}


def test_boards(spark):
    rated = spark.createDataFrame([("a", 1100.456), ("b", 900.0), ("c", 1000.0)], "model string, rating double")
    meta = spark.createDataFrame([("a", "l2", 2, 5.0, "gone"), ("a", "l1", 1, None, "gone"), ("c", None, 3, 1.5, "gone"), ("z", "l", 4, 1.0, "gone")], "model string, link string, place int, quiz_sts double, starting_from string")
    board = {r["model"]: r for r in leaderboard.leaderboard(rated, rated.where("model = 'a'"), meta, order="place").collect()}
    assert sorted(board) == ["a", "b", "c"]
    assert (board["a"]["link"], board["a"]["rating_full"], board["c"]["rating_full"], board["b"]["link"]) == ("l1", 1100.456, 0.0, "N/A")
    assert leaderboard.leaderboard(rated, rated, meta).count() == 3
    out = leaderboard.published(rated, rated.where("model = 'a'"), meta, order="place", benchmark="Quiz", title="Game rating")
    assert out.columns == ["key", "Model", "Game rating (anony)", "Game rating (full)", "Quiz Overall Avg", "Quiz Retrieval Avg", "Quiz Clustering Avg", "Quiz STS Avg", "License", "Organization", "Link"]
    assert leaderboard.published(rated, rated, meta).columns[2:5] == ["Elo rating (anony)", "Elo rating (full)", "Overall Avg"]
    rows = {r["key"]: r.asDict() for r in out.collect()}
    assert [r["key"] for r in out.collect()] == ["a", "c", "b"]
    assert (rows["a"]["Quiz STS Avg"], rows["c"]["Quiz STS Avg"], rows["b"]["Quiz STS Avg"]) == (None, "1.5", "N/A")
    assert (rows["a"]["License"], rows["b"]["License"], rows["c"]["Link"]) == (None, "N/A", None)
    samples = spark.createDataFrame([("a", 1090.0, 1120.0)], "model string, rating_q025 double, rating_q975 double")
    bars = leaderboard.error_bars(rated, samples, 2).collect()
    assert [r["model"] for r in bars] == ["a", "c"]
    assert (bars[0]["error_y"], bars[0]["rating_rounded"], bars[1]["error_y"]) == (pytest.approx(19.544), 1100.46, None)


def test_votes_on_models(spark):
    rows = [(1, "m1 x", None, None, None), (2, None, "m1", "a", "b"), (3, None, None, "a", "xm1x"), (4, None, None, "m1", None), (5, None, None, None, None), (6, "b", "m1", "m1", "m1")]
    v = spark.createDataFrame(rows, "id int, model string, model_name string, `0_model_name` string, `1_model_name` string")
    assert sorted(r["id"] for r in clean.remove_model_votes(v, ["m1", "zz"]).collect()) == [5, 6]
    assert clean.remove_model_votes(v, []).count() == 6
    assert sorted(r["id"] for r in clean.remove_model_votes(v.select("id", "model_name"), ["m1"]).collect()) == [1, 3, 4, 5]


def test_modes_and_counters(spark):
    rows = [(1, "ok", "leftvote", "x", "y", True, 1_700_000_000.0), (2, "ok", "tievote", "x", "z", False, 1_700_000_100.0), (3, "banned", "leftvote", "q", "r", True, 1.8e9), (4, "invalid", "leftvote", "x", "y", True, 0.0), (5, "other_task", "leftvote", "x", "y", True, 0.0)]
    s = spark.createDataFrame([(*r, 7) for r in rows], "event_id long, status string, type string, model_a string, model_b string, anony boolean, tstamp double, ip long")
    assert "question_id" not in clean.clean_battles(s, mode="simple").columns
    assert "question_id" in clean.clean_battles(s).columns
    with pytest.raises(ValueError, match="unknown mode"):
        clean.clean_battles(s, mode="x")
    c = clean.counters(s).first()
    assert (c["n_votes"], c["n_invalid"], c["n_banned"], c["n_battles"], c["n_anony"], c["n_models"], c["last_updated"]) == (4, 1, 1, 2, 2, 3, "2023-11-14 14:15:00 PST")
    assert clean.counters(s.limit(0)).first()["last_updated"] is None


def test_new_texts_and_turns(spark):
    d = spark.createDataFrame([("a", ["b"]), ("a", ["a"]), ("", None), (None, []), ("a", None), ("a", [None])], "t string, added array<string>")
    assert [r[0] for r in d.select(requests.can_be_added(F.col("t"), F.col("added"))).collect()] == [True, False, False, False, True, True]
    d = spark.createDataFrame([([("bot", "x"), ("bot", None), ("me", "z")],), ([],), (None,)], "m array<struct<who:string,text:string>>")
    assert [r[0] and [tuple(x) for x in r[0]] for r in d.select(requests.chat_turns(F.col("m"))).collect()] == [[("user", "x"), ("assistant", None), ("user", "z")], [], None]


def test_triangle_labels(spark):
    d = spark.createDataFrame([([1.0, 0.0], [0.0, 1.0], [1.0, 1.0]), ([1.0, 0.0],) * 3], "a array<double>, b array<double>, c array<double>")
    rows = retrieval.triangle_labels(retrieval.triangle(d, "a", "b", "c").withColumn("k", F.monotonically_increasing_id())).collect()
    assert Counter(r["edge"] for r in rows) == {"ab": 2, "ac": 2, "bc": 2}
    one = {r["edge"]: r for r in rows if r["cx"] is not None}
    assert (one["ab"]["label"], one["ac"]["label"], one["ab"]["mid_x"], one["ab"]["mid_y"]) == ("200", "100", 100.0, 0.0)
    assert all(r["label"] is None for r in rows if r["cx"] is None)


def test_names_and_regions(spark):
    d = spark.createDataFrame([("a/b c.d", "wikipedia"), ("text-embedding-004", "stackexchange"), ("own", "arxiv")], "m string, c string")
    name = display.index_name(F.col("m"), F.col("c"), {"own": "debug"})
    assert [tuple(r) for r in d.select(name, display.region(name, F.col("c"))).collect()] == [("index_wikipedia_a__b_c_d", "us-east1"), ("index_stackexchange_text-embedding-004", "us-central1"), ("debug", "us-central1")]


def test_result_files(spark, tmp_path):
    for n in ("elo_results_sts.pkl", "elo_results_sts_2.pkl", "elo_results_retrieval.pkl", "clustering_leaderboard.csv", "notes.txt"):
        (tmp_path / n).write_text("x")
    got = {(r["kind"], r["task"]): r["path"].rpartition("/")[2] for r in files.find_results(spark, str(tmp_path)).collect()}
    assert got == {("ratings", "sts"): "elo_results_sts_2.pkl", ("ratings", "retrieval"): "elo_results_retrieval.pkl", ("leaderboard", "clustering"): "clustering_leaderboard.csv"}
    (tmp_path / "other_leaderboard.csv").write_text("x")
    with pytest.raises(Exception, match="no task in"):
        files.find_results(spark, str(tmp_path)).collect()


def test_cutoff_file(spark, tmp_path):
    b = spark.createDataFrame([("x", 1_700_000_000.0), ("y", 1_600_000_000.0)], "model_a string, tstamp double")
    files.write_battles(b, str(tmp_path / "b"), str(tmp_path / "cutoff"))
    assert [r[0] for r in spark.read.text(str(tmp_path / "cutoff")).collect()] == ["20231114"]
    assert spark.read.json(str(tmp_path / "b")).count() == 2
    files.write_battles(b.limit(0), str(tmp_path / "b"), str(tmp_path / "cutoff"))
    assert spark.read.text(str(tmp_path / "cutoff")).count() == 0


def test_positions_over_ranges(spark, monkeypatch):
    from duelwise.operators import ranks

    monkeypatch.setattr(ranks, "RANGE_ROWS", 50)
    keys = [None, *range(-300, 700, 2)]
    d = spark.createDataFrame([(k,) for k in keys], "k long").repartition(5)
    assert sorted((r["p"], r["k"]) for r in positions(d, "k", "p").collect()) == list(enumerate(keys))


def test_draws_look_up_battles(spark, monkeypatch):
    """Draw by draw in plain Python, in order of battle_id, whatever number of rounds is drawn at once."""
    rng = random.Random(3)
    rows = [(f"m{rng.randrange(3)}", f"n{rng.randrange(2)}", rng.choice(list(ratings.SCORES))) for _ in range(70)]
    b = spark.createDataFrame([(7 * i % 71, 0.0, *r) for i, r in enumerate(rows)], "battle_id long, tstamp double, model_a string, model_b string, winner string").repartition(3)
    listed = [r for _, r in sorted((7 * i % 71, r) for i, r in enumerate(rows))]
    want, elo = Counter(), {}
    for k in range(5):
        table = ratings.Table()
        for i in range(70):
            r = listed[int(hashlib.md5(f"{k}-{i}".encode()).hexdigest()[:8], 16) % 70]
            want[k, *r] += 1
            table.play(*r)
        elo.update({(k, m): x for m, x in table.rating.items()})
    for at_once in (1, 150, 10**6):
        monkeypatch.setattr(ratings, "AT_ONCE", at_once)
        assert {tuple(r)[:4]: r["n"] for r in ratings.battle_counts(b, 5).collect()} == want
        assert {(r["round"], r["model"]): r["rating"] for r in ratings.drawn_elo(b, 5).collect()} == elo
    assert ratings.battle_counts(b.limit(0), 5).count() == 0
    assert ratings.rate(b.limit(0), "elo", 5).count() == 0

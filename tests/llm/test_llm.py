"""The training-data operators against brute force, and their defined results for odd rows."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from duelwise.llm import jaccard, language, lines, mixing, packing, suffixes, tokens, urls, vectors
from duelwise.llm.common import Scratch
from duelwise.llm.encode import Encoder

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string, score string, part string"
R = random.Random(7)
WORDS = ["".join(R.choice("abcdefgh") for _ in range(R.randint(2, 7))) for _ in range(400)]


def prose(n):
    return " ".join(R.choice(WORDS) for _ in range(n))


def odd_rows():
    base = prose(120)
    words = base.split()
    near = [" ".join(words[:k] + ["zzz"] + words[k + 1 :]) for k in (5, 60, 110)]
    small = ["a b c d e f g h", "a b c d e f g h i", "x y", "x y", "A  b\tC d e f g h"]
    texts = [base, *near, base, *small, "", None, " \n ", "é ü ß", "ab " * 400, prose(3000), base + "\n" + prose(50), prose(90) + "\n" + base]
    texts += [prose(R.randint(1, 80)) for _ in range(25)]
    rows = [(i, t, R.choice(["en", "fr", None]), R.choice(["s1", "s2", None]), len(t or ""), "x", None, "y") for i, t in enumerate(texts)]
    return [*rows, (None, base, "en", "s1", 1, "x", None, "y"), (3, near[2], "en", "s1", 1, "x", None, "y"), rows[0]]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(odd_rows(), DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def brute_sets(rows):
    out = []
    for r in rows:
        w = (r["text"] or "").encode().lower().split()
        out.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    return out


def test_jaccard(docs, empty):
    rows = docs.collect()
    sets, comp = brute_sets(rows), list(range(len(rows)))

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                comp[max(root(i), root(j))] = min(root(i), root(j))
    least = {}
    for i, r in enumerate(rows):
        if r["doc_id"] is not None:
            least[root(i)] = min(least.get(root(i), 1 << 60), r["doc_id"])
    want = sorted((str(r["doc_id"]), len(sets[i]), least.get(root(i), r["doc_id"])) for i, r in enumerate(rows))
    got = sorted((str(r["doc_id"]), r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_classes(docs).collect())
    assert got == want
    assert jaccard.jaccard_classes(empty).count() == 0
    for bits in (0, 5, 9):  # all sets, many and some share their first name
        again = jaccard.jaccard_rows(docs, bits=bits).select("key", F.col("n").cast("long"), "component_id").collect()
        assert sorted((str(r["key"]), r["n"], r["component_id"]) for r in again) == want


def test_jaccard_counts_a_pair_over_all_lists(spark):
    """Two sets of 100 shingles that share 89 list 21 each, and 10 of them are shared; each one's group leads 5 of the lists."""
    groups = {1: (1, 11, 12), 2: (2, 21, 22)}
    rows = [(t, n, 100, 1000) for t in range(10) for n in (1, 2, *groups[1 + t % 2][1:])]
    met = spark.createDataFrame(rows, "token long, node long, n int, last long")
    comps = spark.createDataFrame([(n, c) for c, nodes in groups.items() for n in nodes], "node long, comp long")
    found = jaccard.cross_pairs(met, comps, spark.createDataFrame([], jaccard.CHECKED), 0).collect()
    assert [tuple(r) for r in found] == [(1, 2)]


def star_of(spark):
    """150 members that share 70 to 89 shingles of 100 with a centre; ten beside it are in all of them, ten in three."""
    rows = [(jaccard.MEMBER, 0, 1 + k, 70 + k % 20, 100, [*range(900, 910), *range(2000 + k // 3 * 10, 2010 + k // 3 * 10), *range(5000 + 20 * k, 5010 - k % 20 + 20 * k)]) for k in range(150)]
    return spark.createDataFrame(rows, jaccard.CHECKED)


def test_jaccard_shingles_that_a_centre_lacks(spark):
    """What nearly all members of a star have, but its centre hasn't, pairs none of them; pairs that can be links stay."""
    checked, none = star_of(spark), spark.createDataFrame([], "node long, comp long")
    members, beside = jaccard.star_members(checked, none)
    assert members.where(F.size("wide") == 10).count() == 150
    assert beside.groupBy("token").count().agg(F.max("count")).first()[0] == 3 and beside.count() == 1500
    rows = {r["b"]: (r["shared"], set(r["own"])) for r in checked.collect()}
    want = {(a, b) for a in rows for b in rows if a < b and min(rows[a][0], rows[b][0]) + len(rows[a][1] & rows[b][1]) >= 89}
    found = {tuple(sorted(r)) for r in jaccard.star_pairs(members, beside, none).collect()}
    assert want and found == want
    best = {r["node"]: r["g"] for r in jaccard.nearest(members, none).collect()}
    assert len(best) == 149 and rows[best.popitem()[1]][0] == 89


def test_jaccard_boundary_follows_cost():
    assert jaccard.choose_boundary({}, 5.0) == 0
    assert jaccard.choose_boundary({4: 1000, 5: 1000, 8: 1000}, 50.0) > 4


def brute_repeats(texts, length=200):
    where = {}
    for i, t in enumerate(texts):
        for p in range(len(t) - length + 1):
            where.setdefault(t[p : p + length], []).append((i, p))
    gone = [bytearray(len(t)) for t in texts]
    for places in where.values():
        if len(places) > 1:
            for i, p in places:
                gone[i][p : p + length] = b"\1" * length
    return gone


@pytest.mark.parametrize(("bucket", "windows", "batch"), [(suffixes.BUCKET, suffixes.SORTED, 10_000), (1, 1, 3), (4, 300, 7)])
def test_repeats(spark, docs, empty, bucket, windows, batch, monkeypatch):
    monkeypatch.setattr(suffixes, "BUCKET", bucket)
    monkeypatch.setattr(suffixes, "SORTED", windows)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    rows = docs.collect()
    texts = [(r["text"] or "").encode() for r in rows]
    want = []
    for r, t, g in zip(rows, texts, brute_repeats(texts), strict=True):
        kept = bytes(b for b, x in zip(t, g, strict=True) if not x)
        spans = sum(1 for k in range(len(g)) if g[k] and (k == 0 or not g[k - 1]))
        want.append((str(r["doc_id"]), len(t), sum(g), spans, hashlib.sha256(kept).hexdigest()))
    got = suffixes.remove_repeats(docs).collect()
    assert sorted((str(r["doc_id"]), *list(r)[1:5]) for r in got) == sorted(want)
    assert suffixes.remove_repeats(empty).count() == 0
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_language(docs, empty):
    model = language.fit(docs)
    out = language.identify(docs, model)
    assert out.count() == docs.count() and "source" in out.columns
    for r in out.collect():
        assert 0 <= r["score"] <= 1
        assert (r["lang_pred"] == "und") == (not any(map(str.isalpha, r["text"] or "")))
    assert language.fit(empty) is None
    assert {r["lang_pred"] for r in language.identify(docs, None).collect()} == {"und"}


def test_language_scores_by_brute_force(spark, monkeypatch):
    """Kernel, landmarks and ridge written out over sets of n-grams."""
    monkeypatch.setattr(language, "LANDMARKS", 20)
    rows = [(i, " ".join(R.choice(ws) for _ in range(R.randint(5, 40))), y) for i in range(60) for y, ws in (("a", WORDS[:80]), ("b", WORDS[80:160]), ("c", WORDS[160:240]))]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    train = d.where("doc_id < 40")
    got = {(r["text"], r["lang"]): (r["lang_pred"], r["score"], r["kin"]) for r in language.identify(d, language.fit(train)).collect()}

    def grams(t):
        b, out = t.lower().encode(), set()
        for i in range(len(b)):
            h = 0
            for k in range(1, 4):
                if i + k <= len(b):
                    h = (h * 0x01000193 + b[i + k - 1] + k) & 0xFFFFFFFF
                    x = h ^ h >> 15
                    out.add((x * 0x2C1B3C6D & 0xFFFFFFFF) >> 16)
        return out

    kernel = lambda s, t: len(s & t) / np.sqrt(len(s) * len(t))
    seen = [(r["t"], r["y"]) for r in language.sample(train).orderBy("place", "t", "y").collect()]
    sets = [grams(t) for t, _ in seen]
    marks = sets[:20]
    square = np.array([[kernel(s, t) for t in marks] for s in marks])
    values, vectors = np.linalg.eigh(square)
    keep = values > 1e-6 * values.max()
    white = vectors[:, keep] / np.sqrt(values[keep])
    features = lambda s: np.append(np.array([kernel(s, t) for t in marks]) @ white, 1.0)
    f = np.array([features(s) for s in sets])
    goal = np.array([[1.0 if y == z else -1.0 for z in "abc"] for _, y in seen])
    beta = np.linalg.solve(f.T @ f + language.RIDGE * len(f) / 100 * np.eye(f.shape[1]), f.T @ goal)
    for (t, _), (pred, score, kin) in got.items():
        v = features(grams(t)) @ beta
        assert pred == "abc"[int(np.argmax(v))] and abs(score - min(1, max(0, (v.max() + 1) / 2))) < 1e-3
        assert abs(kin - max(kernel(grams(t), m) for m in marks)) < 1e-4


def test_language_learns_every_label(spark, monkeypatch):
    monkeypatch.setattr(language, "SAMPLE", 30)
    rows = [(k * 50 + i, " ".join(R.choice(WORDS[k * 12 : k * 12 + 12]) for _ in range(12)), f"l{k}") for k in range(30) for i in range(3)]
    model = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.languages == sorted({y for _, _, y in rows})


def test_clashing_columns_pass(spark):
    """Tables whose other columns bear names that operators use inside keep them."""
    names = ["n_lines", "ranges", "depth", "labels", "entropy", "params", "top_rate", "l1", "id", "comp", "token", "g", "norm", "fp", "node", "n", "grp", "spans", "ids", "place", "t", "y"]
    texts = [prose(30), prose(20), None, ""]
    rows = [(i, texts[i % 4], "en", f"s{i % 2}", f"http://q{i}.com/fr/x", *[f"{c}{i}" for c in names]) for i in range(8)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, url string, " + ", ".join(f"{c} string" for c in names))
    path = public_tokenizers.path("byte_bpe_50k.json")
    for out, dropped in ((lines.dedup_lines(d), {"n_lines"}), (mixing.mix_shares(d), set()), (urls.judge(d), set()), (language.identify(d, language.fit(d)), set())):
        kept = {r["doc_id"]: r for r in out.collect()}
        assert len(kept) == 8 and all(kept[i][c] == f"{c}{i}" for i in kept for c in names if c not in dropped)
    assert jaccard.jaccard_classes(d).count() == 8 and suffixes.remove_repeats(d).count() == 8
    assert packing.pack(d, path).select("doc_id").distinct().count() == 8
    assert tokens.read_shards(tokens.write_shards(d, Scratch(spark, "t"), public_tokenizers.path("word_bpe_49k.json"))).count() == 8


def test_packing_keeps_large_ids_beside_null_ones(spark):
    big = (1 << 53) + 1
    d = spark.createDataFrame([(big, "a b"), (None, "c d"), (None, None)], "doc_id long, text string")
    got = packing.pack(d, public_tokenizers.path("byte_bpe_50k.json")).collect()
    assert sorted((r["doc_id"] or 0 for r in got)) == [0, 0, big]


def test_small_batches_and_a_long_text(spark):
    """Whatever the batches are, and with a text over 1 MB, results are those of one batch."""
    words = [prose(8) for _ in range(3000)]
    long = " ".join(words * 8)
    assert len(long) > 1 << 20
    rows = [(i, prose(40) if i % 3 else words[i] * 30) for i in range(40)] + [(90, long), (91, long + " tail"), (92, words[0] * 30)]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    path = public_tokenizers.path("word_bpe_49k.json")
    todo = {
        "jaccard": lambda: jaccard.jaccard_classes(d), "repeats": lambda: suffixes.remove_repeats(d, with_bytes=False),
        "tokens": lambda: tokens.read_shards(tokens.write_shards(d, Scratch(spark, "t"), path)), "lines": lambda: lines.dedup_lines(d).select("doc_id", "n_removed"),
        "mix": lambda: mixing.mix_shares(d.withColumn("source", F.lit("s")), keep_text=False), "language": lambda: language.identify(d, language.fit(d.withColumn("lang", F.lit("x")))).select("doc_id", "lang_pred"),
        "packing": lambda: packing.pack(d, public_tokenizers.path("byte_bpe_50k.json")).groupBy("doc_id").agg(F.sum("length"), F.min("doc_tokens")),
    }
    want = {k: sorted(map(str, f().collect())) for k, f in todo.items()}
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(key, "3")
    try:
        assert {k: sorted(map(str, f().collect())) for k, f in todo.items()} == want
    finally:
        spark.conf.unset(key)


def test_language_held_out_accuracy(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn("held_out", language.held_out())
    out = language.identify(d, language.fit(d.where("not held_out"))).where("held_out and lang is not null")
    assert out.select(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] > 0.98


def test_language_stage_rejects_junk(spark):
    import corpus_pipeline

    rng = random.Random(9)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(rng.randint(2, 9)))
    base64 = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/"
    junk = [" ".join(word(x) for _ in range(n)) for n in (20, 150) for x in ("abcdefghijklmnopqrstuvwxyz", "αβγδεζηθικλμνξοπρστυφχψω", "абвгдежзийклмнопрстуфхцчшщ")]
    junk += ["".join(rng.choice(base64) for _ in range(1000)), "a " + "".join(rng.choice("0123456789 ") for _ in range(500))]
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select(*corpus_pipeline.COLUMNS)
    clean = d.where(language.held_out() & F.col("text").rlike(r"\p{L}"))
    odd = spark.createDataFrame([(10**9 + i, t, None, "junk", len(t)) for i, t in enumerate(junk)], d.schema)
    kept = corpus_pipeline.language_id(spark, d.unionByName(odd), "").where(language.held_out() | (F.col("source") == "junk")).groupBy((F.col("source") == "junk").alias("junk")).count().collect()
    kept = {r["junk"]: r["count"] for r in kept}
    assert True not in kept and kept[False] >= 0.998 * clean.count()


def test_lines(spark, docs, empty):
    line = "the quick brown foxes jumped over the lazy dogs in summertime 12 times"
    copy = line.replace(" ", "  ").replace("12", "34").replace("brown", "Brown,")
    d = spark.createDataFrame([(1, f"{line}\nfirst own line of words here"), (2, f"{copy}\nsecond own text is quite another"), (3, f"short\n\n{line.upper()}!"), (4, None), (5, ""), (6, "short")], "doc_id long, text string")
    got = {r["doc_id"]: (r["text"], r["n_removed"]) for r in lines.dedup_lines(d).collect()}
    assert got[1] == (f"{line}\nfirst own line of words here", 0)
    assert got[2] == ("second own text is quite another", 1)
    assert got[3] == ("short\n", 1)
    assert got[4] == (None, 0) and got[5] == ("", 0) and got[6] == ("", 1)
    assert lines.dedup_lines(docs).count() == docs.count()
    assert lines.dedup_lines(empty).count() == 0


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_lines_near_copies(spark):
    """One changed letter in a long line: its word leaves all blocks but two alone."""
    rng = random.Random(2)
    texts, k = [], 40
    for _ in range(k):
        w = [rng.choice(WORDS) + rng.choice(WORDS) for _ in range(60)]
        texts += [" ".join(w), " ".join([*w[:30], w[30][:-1] + "q", *w[31:]])]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["n_removed"] for r in lines.dedup_lines(d).collect()}
    assert all(got[2 * i] == 0 for i in range(k))
    assert sum(got[2 * i + 1] for i in range(k)) == k


def test_lines_find_nine_of_ten_pairs_that_are_alike(spark, tmp_path):
    """Against all pairs of the different normal lines of a small table, by DuckDB's edit distance."""
    import duckdb

    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("doc_id % 4 = 0").select("doc_id", "text")
    occ, named = lines.line_groups(d, "doc_id", "text", Scratch(spark, "t"))
    rows = occ.join(named, ["l1", "l2"], "left").select("norm", "comp").distinct().toPandas()
    rows = rows[rows["norm"].str.len() <= lines.LONG_CHARS].reset_index(names="i")
    found = duckdb.sql("""
      WITH p AS (SELECT a.comp AS x, b.comp AS y, a.norm AS s, b.norm AS t, greatest(length(a.norm), length(b.norm)) AS n FROM rows a JOIN rows b
                 ON a.i < b.i AND least(length(a.norm), length(b.norm)) >= 0.8 * greatest(length(a.norm), length(b.norm)))
      SELECT count(*), count_if(x = y) FROM p WHERE list_sum(list_transform(list_distinct(string_split(lower('abcdefghijklmnopqrstuvwxyz'), '')),
        lambda c: abs(length(replace(s, c, '')) - length(replace(t, c, '')) - length(s) + length(t)))) <= 0.4 * n AND levenshtein(s, t) <= floor(0.2 * n + 1e-9)""").fetchall()[0]
    assert found[0] >= 20 and found[1] >= 0.9 * found[0], found


def test_lines_tokens_hold_the_bits_of_their_blocks(spark):
    """A token is its way and its blocks' bits, without a hash: what differs in either never meets."""
    rng, bits, rows = random.Random(5), lines.BITS, []
    for i in range(60):
        rows.append((i, 10 + i, *(rng.getrandbits(bits) for _ in range(lines.BLOCKS)), *(rng.choice((0, 1, 2, i // 12)) for _ in range(lines.BLOCKS))))
    names = [f"{x} long" for x in ("id", "chars", *(f"{c}{b}" for c in "bm" for b in range(lines.BLOCKS)))]
    want = []
    for i, chars, *both in rows:
        b, m = both[: lines.BLOCKS], both[lines.BLOCKS :]
        for way, at in enumerate(lines.TRIPLES + lines.PAIRS):
            met = sum(m) <= lines.SHORT if len(at) == 3 else sum(m) >= lines.LONG
            if met and sum(m[k] for k in at) >= (2 if len(at) == 3 else 3):
                width = 13 if len(at) == 3 else 18
                want.append((i, chars, way << 39 | sum((b[k] & (1 << width) - 1) << width * j for j, k in enumerate(at))))
    assert sorted(tuple(r) for r in lines.block_keys(spark.createDataFrame(rows, ", ".join(names)), bits).collect()) == sorted(want)
    assert len({t for *_, t in want}) == len(want) > 500


def test_lines_code_is_compiled_and_words_are_made_once(spark, monkeypatch):
    """The JVM interprets methods of over 8,000 bytes of code, and a filter on what explode takes makes it again."""
    explained, save = {}, Scratch.save

    def saved(self, df, name, *args, **kw):
        plan = df._jdf.queryExecution()
        explained[name] = plan.optimizedPlan().toString(), spark._jvm.PythonSQLUtils.explainString(plan, "codegen")
        return save(self, df, name, *args, **kw)

    monkeypatch.setattr(Scratch, "save", saved)
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        lines.line_groups(spark.createDataFrame([(1, "one line\nanother"), (2, "one line")], "doc_id long, text string"), "doc_id", "text", Scratch(spark, "t"))
        for name in ("occurrences", "sims", "met", "stars", "texts", "links", "more"):
            assert max(int(x) for x in re.findall(r"maxMethodCodeSize:(\d+)", explained[name][1])) < 8000, name
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    for name in ("occurrences", "sims"):
        assert explained[name][0].count("split(") == 1, name


def test_lines_meet_alike_in_tables_of_any_size(spark, monkeypatch):
    """The bits of a block are those of a small table."""
    seen = []

    def stop(occ, bits):
        seen.append(bits)
        raise InterruptedError

    monkeypatch.setattr(lines, "simhashes", stop)
    for n in (10, 200_000):
        with pytest.raises(InterruptedError):
            lines.line_groups(spark.range(n).selectExpr("id AS doc_id", "md5(cast(id AS string)) AS text"), "doc_id", "text", Scratch(spark, "t"))
    assert seen[0] == seen[1]


def test_lines_within_groups_are_alike(spark):
    """Every removed line is like a line that stayed, or like one that is, and so on: brute force over small groups."""
    rng = random.Random(4)
    base = [" ".join(rng.choice(WORDS) for _ in range(rng.choice([1, 2, 5, 9, 13, 20, 40]))) for _ in range(60)]
    texts = base + [b[:-1] + "q" for b in base[::2]] + [b + " end" for b in base[::3]]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    occ, named = lines.line_groups(d, "doc_id", "text", Scratch(spark, "t"))
    comps = {}
    for r in occ.join(named, ["l1", "l2"]).collect():
        comps.setdefault(r["comp"], set()).add(r["norm"])
    for members in comps.values():
        left, reached = set(members), [members.pop()]
        left -= set(reached)
        while reached:
            x = reached.pop()
            near = {y for y in left if distance(x, y) <= 0.2 * max(len(x), len(y)) + 1e-9}
            left -= near
            reached += near
        assert not left


def test_lines_are_compared_by_bounds_before_all_characters(spark):
    """Distances of words in place and of pieces are never less than that of characters, and decide most pairs that are alike."""
    rng, rows = random.Random(8), []
    for i in range(300):
        w = [rng.choice(WORDS) + rng.choice(WORDS)[: rng.randrange(5)] for _ in range(rng.randrange(18, 60))]
        v = list(w)
        for _ in range(int(len(w) * rng.choice((0.05, 0.15, 0.2, 0.3)))):
            k = rng.randrange(len(v))
            v[k : k + 1] = [[], [rng.choice(WORDS)], [v[k][::-1]], [v[k], rng.choice(WORDS)]][rng.randrange(4) if i % 2 else 2]
        rows.append((" ".join(w), " ".join(v)))
    one = lines.spelled(spark.createDataFrame(rows, "norm string, other string"))
    two = lines.spelled(one.select(F.col("norm").alias("first"), F.col("other").alias("norm")).distinct())
    both = one.join(two.select("first", *[F.col(c).alias(f"{c}2") for c in ("norm", "spelt", "longest", "runs")]), (F.col("norm") == F.col("first")) & (F.col("other") == F.col("norm2")))
    longer = F.greatest(F.length("norm"), F.length("norm2"))
    x, y = F.split("norm", " "), F.split("norm2", " ")
    shared = F.size(F.array_intersect(x, y)) * 5 >= F.least(F.size(F.array_distinct(x)), F.size(F.array_distinct(y))) * 2
    for share in (0.1, 0.2, 0.3):
        most = longer * F.lit(share)
        got = both.select((F.levenshtein("norm", "norm2") <= F.floor(most + F.lit(1e-9))).alias("near"), lines.in_place(x, y, most).alias("place"), lines.in_pieces("norm", "norm2", most).alias("pieces"), lines.alike().alias("alike"), shared.alias("shared")).collect()
        assert len(got) == len(rows)
        assert all(r["near"] for r in got if r["place"] or r["pieces"])
        assert sum(r["place"] or r["pieces"] for r in got) >= 0.7 * sum(r["near"] for r in got) > 20
        assert share != 0.2 or all(r["alike"] == r["near"] for r in got if r["shared"]) and any(not r["near"] for r in got)


def test_lines_of_large_groups(spark, docs, monkeypatch):
    """Groups that are dealt to several tasks lose the same lines."""
    d = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(1000 + i, f"one line that all of them have\nown {i} {i * i}") for i in range(60)], "doc_id long, text string"))
    want = Counter((r["doc_id"], r["text"], r["n_removed"]) for r in lines.dedup_lines(d).collect())
    monkeypatch.setattr(lines, "HOT", 3)
    assert Counter((r["doc_id"], r["text"], r["n_removed"]) for r in lines.dedup_lines(d).collect()) == want
    assert sum(n for (i, _, gone), n in want.items() if (i or 0) >= 1000 and gone) == 59


def test_lines_counters_that_overflow(spark, monkeypatch):
    """Copies vote once, and counters too narrow for a line don't keep it from its copies."""
    w = [f"word{k}" for k in range(20)]
    copy, near = " ".join(w), " ".join([*w[:-1], "other"])
    d = spark.createDataFrame([(i, copy) for i in range(40)] + [(99, near), (100, "x" * 3000 + "\n" + " ".join(w * 400))], "doc_id long, text string")
    want = {r["doc_id"]: r["n_removed"] for r in lines.dedup_lines(d).collect()}
    monkeypatch.setattr(lines, "LANE", 8)
    assert {r["doc_id"]: r["n_removed"] for r in lines.dedup_lines(d).collect()} == want
    assert want[0] == 0 and want[1] == 1 and want[99] == 1 and want[100] == 0


def test_urls(spark):
    rows = [(1, "http://A.example.ORG/es/1"), (2, "https://x.org/en/1"), (3, "http://example.org/en/12"), (4, "http://q.com/fr/a?x"), (5, "http://q.com/de/#f"), (6, None), (7, "nothing"), (8, "http://q.net/de/9"), (9, "http://borg/"), (10, "http://x.org"), (1, "http://A.example.ORG/es/1")]
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert got[1] == ("a.example.org", "/es/1", "example.org/es/", "block")
    assert got[2][2:] == ("org/", "allow") and got[3][2:] == ("example.org/en/1", "block")
    assert got[4][2:] == ("com/fr/", "allow") and got[5][2:] == ("com/de/", "block")
    assert got[6][:3] == ("", "", None) and got[7][:3] == ("", "", None)
    assert got[9][2] is None and got[10][:3] == ("x.org", "", None)
    assert {v[3] for v in got.values()} <= {"allow", "block"}
    assert urls.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_mixing(docs, empty):
    rows = mixing.mix_shares(docs).collect()
    total = sum(r["size"] for r in rows)
    by = {}
    for r in rows:
        assert r["size"] == len((r["text"] or "").encode().split()) and 0 <= r["taken"] <= 3 * r["size"]
        by.setdefault(r["source"], [r["source_size"], r["target"], 0, 0])
        by[r["source"]][2] += r["taken"]
        by[r["source"]][3] += r["size"]
    for size, target, taken, real in by.values():
        assert size == real and abs(taken - target) <= 0.5 + 1e-6 and target <= 3 * size + 1e-6
    assert sum(t for _, t, _, _ in by.values()) == pytest.approx(total)
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix_shares(docs.repartition(2)).collect()))
    assert mixing.mix_shares(empty).count() == 0


@pytest.mark.parametrize(("name", "spaces"), [("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)])
def test_ids_are_the_librarys(name, spaces):
    path = public_tokenizers.path(name)
    t, e = Tokenizer.from_file(path), Encoder(path, spaces)
    odd = ["a  b\n\n c", "Don't  stop,\tor!? x", " ", "", "été Straße ñandú.", "日本 語", "x <|endoftext|> y", "a\r\nb", "1,234.5%%% tz.", "\nThe end.", "é combining", "x  y"]
    for x in [*odd, *(r[1] or "" for r in odd_rows())]:
        assert e.ids(x).tolist() == t.encode(x, add_special_tokens=False).ids, x


def test_token_shards(spark, docs, empty):
    path = public_tokenizers.path("word_bpe_49k.json")
    t, at, want = Tokenizer.from_file(path), 0, []
    for r in sorted(docs.collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["text"] or "")):
        ids = [*t.encode(r["text"] or "", add_special_tokens=False).ids, 1]
        want.append((r["doc_id"], at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), 1, ids.count(1)))
        at += len(ids)
    got = tokens.read_shards(tokens.write_shards(docs, Scratch(spark, "t"), path, shard_tokens=500))
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    assert tokens.read_shards(tokens.write_shards(empty, Scratch(spark, "t"), path)).count() == 0


@pytest.mark.parametrize("kind", [np.uint16, np.uint32])
def test_wavelet_matrix(kind):
    x = np.random.default_rng(1).integers(0, 300, 2000).astype(kind)
    w = tokens.WaveletMatrix.of(tokens.WaveletMatrix.build(x).row())
    assert (w.decode() == x).all() and [w.access(i) for i in range(0, 2000, 97)] == x[::97].tolist()
    for t in (0, 5, 299):
        at = np.flatnonzero(x == t)
        assert w.count(t) == len(at) and w.rank(t, 777) == (x[:777] == t).sum()
        assert [w.select(t, k) for k in range(len(at))] == at.tolist()
    assert w.count(1 << 15) == 0
    at = np.concatenate([np.arange(2000), np.random.default_rng(2).integers(0, 2000, 500)])
    assert (w.access_many(at) == x[at]).all()
    for t in (0, 5, 299, 301, 1 << 15, -1):
        assert w.rank_many(t, np.append(at, 2000)).tolist() == [*((x == t).cumsum() - (x == t))[at].tolist(), int((x == t).sum())]


def test_packing(docs, empty):
    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    ids = {r["doc_id"]: np.array([*t.encode(r["text"] or "", add_special_tokens=False).ids, 1], "<u4") for r in docs.collect() if r["doc_id"] not in (0, 3)}
    pieces, sequences = {}, {}
    got = packing.pack(docs, path).collect()
    for r in got:
        pieces.setdefault(r["doc_id"], []).append(r)
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert set(pieces) == {r["doc_id"] for r in docs.collect()}
    for d, x in ids.items():
        at = 0
        for p in sorted(pieces[d], key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(x) and p["ids_crc32"] == zlib.crc32(x[at : at + p["length"]].tobytes())
            at += p["length"]
        assert at == len(x)
    total = 0
    for s in sequences.values():
        at = 0
        for offset, n in sorted(s):
            assert offset == at
            at += n
        assert at <= 2048
        total += 2048 - at
    assert total < 2048
    assert packing.pack(empty, path).count() == 0


VECTORS = "vec_id long, embedding array<float>, score string"


def odd_vectors(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in v], "x") for i, v in enumerate(rng.standard_normal((600, 16)).astype(np.float32))]
    rows += [(700, None, "x"), (800, [0.0] * 16, "x"), (900, [float("nan")] + [1.0] * 15, "x"), (901, [None] + [1.0] * 15, "x"), (902, [float("inf")] * 16, "x"), (None, [1.0] * 16, "x"), (903, rows[0][1], "x"), (904, [1.0, 2.0], "x"), (905, [], "x")]
    return spark.createDataFrame(rows, VECTORS), {r[0]: np.array(r[1], float) for r in rows[:600]} | {903: np.array(rows[0][1], float)}


def test_nearest(spark):
    d, x = odd_vectors(spark)
    got = {}
    for r in vectors.nearest(d, vectors.hundredth).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    hits = 0
    assert set(got) == {0, 100, 200, 300, 400, 500}
    for q, found in got.items():
        want = sorted((float(np.sqrt(((x[i] - x[q]) ** 2).sum())), i) for i in x if i != q)[:10]
        assert sorted(found) == list(range(1, 11)) and [s for _, s in sorted(found.values(), key=lambda v: v[1])] == [found[k][1] for k in range(1, 11)]
        hits += len({i for _, i in want} & {i for i, _ in found.values()})
    assert got[0][1] == (903, 0.0) and hits >= 54
    twice = vectors.nearest(d.unionByName(d.where("vec_id = 100")), vectors.hundredth).where("query_id = 100").collect()
    assert sorted(r["rank"] for r in twice) == list(range(1, 11)) and len({r["vec_id"] for r in twice}) == 10
    assert vectors.nearest(spark.createDataFrame([], VECTORS), vectors.hundredth).count() == 0


def test_nearest_over_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 100)
    monkeypatch.setattr(vectors, "QUERIES", 4)
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.standard_normal((1500, 24)) * 0.3 + rng.standard_normal(24) for _ in range(2)])
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in vectors.nearest(d, vectors.hundredth).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits = 0
    for q in range(0, 3000, 100):
        far = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        far[q] = np.inf
        hits += len(got[q] & set(np.argsort(far)[:10].tolist()))
    assert hits >= 0.9 * 300
    ours = [(r["query_id"], r["rank"], r["score"]) for r in vectors.top_products(d, vectors.hundredth).collect()]
    w = np.floor(1024 * x)
    want = [(q, k + 1, s) for q in range(0, 3000, 100) for k, s in enumerate(sorted((int(v) for i, v in enumerate(w @ w[q]) if i != q), reverse=True)[:10])]
    assert sorted(ours) == want


def test_top_products(spark):
    d, x = odd_vectors(spark)
    x = {i: np.floor(1024 * v) for i, v in x.items()} | {800: np.zeros(16)}
    got = {}
    for r in vectors.top_products(d, vectors.hundredth).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    for q in (0, 100, 500, 800):
        want = sorted((-int(x[i] @ x[q]), i) for i in x if i != q)[:10]
        assert [got[q][k] for k in range(1, 11)] == [(i, -s) for s, i in want]
    twice = vectors.top_products(d.unionByName(d.where("vec_id = 100")), vectors.hundredth).where("query_id = 100").collect()
    assert sorted(r["rank"] for r in twice) == list(range(1, 11)) and len({r["vec_id"] for r in twice}) == 10
    assert vectors.top_products(spark.createDataFrame([], VECTORS), vectors.hundredth).count() == 0


def test_pipeline(spark, docs, tmp_path):
    import corpus_pipeline

    at = docs.select("doc_id", "text", "lang", "source", "n_chars")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, at, "").write.parquet(str(tmp_path / str(k)))
        at = spark.read.parquet(str(tmp_path / str(k)))
        if k < 4:
            assert at.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        assert at.count() > 0
    none = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, "").count() == 0

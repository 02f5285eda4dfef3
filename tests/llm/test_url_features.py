"""URL parts, features and suffix rates against plain Python."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from duelwise.llm import urls
from duelwise.llm.common import Scratch


def split(url):
    at = (url or "").find("://")
    rest = url[at + 3 :] if at >= 0 else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def plain(url):
    u, (host, path) = url or "", split(url)
    query = re.search(r"\?([^#]*)", u)
    query = query[1] if query else ""
    counts = Counter(u)
    return {
        "host_length": len(host), "path_length": len(path), "query_length": len(query), "labels": host.count("."), "depth": path.count("/"),
        "digit_ratio": sum("0" <= c <= "9" for c in u) / max(1, len(u)), "entropy": -sum(n / len(u) * math.log2(n / len(u)) for n in counts.values()) if u else 0,
        "params": query.count("&") + 1 if query else 0,
    }


def keys(url):
    host, path = split(url)
    folder, ending = re.match("^/([^/]*)/", path), re.search(r"(\.[A-Za-z0-9]+|/)$", path)
    return {"top": host.rpartition(".")[2], "folder": folder[1] if folder else "", "ending": ending[1] if ending else ""}


def some_urls():
    r = random.Random(3)
    pick = lambda *x: r.choice(x)
    made = [f"http{pick('', 's')}://{pick('a.', 'B.', '')}{pick('x', 'example', 'é')}{pick('.org', '.com', '.net', '')}{pick('', '/fr/', '/de/', '/es/1', '/en/1')}{pick('', 'p.html', 'a/b.php', 'q/')}{pick('', '?', '?a=1&b=2', '#?x', '?k#f')}" for _ in range(300)]
    return [*made, None, "", "none", "://", "http://x.org?a/b", "a://b://c", "http://" + "l" * 5000 + ".com/de/" + "9" * 5000]


def test_parts_and_features(spark):
    d = spark.createDataFrame([(i, u) for i, u in enumerate(some_urls())], "i int, url string")
    host, path = urls.parts(F.col("url"))
    d = d.withColumn("host", host).withColumn("path", path)
    own = urls.lexical(F.col("url"), F.col("host"), F.col("path"))
    for r in d.withColumns({f"f_{k}": v for k, v in own.items()}).collect():
        assert (r["host"], r["path"]) == split(r["url"])
        for k, v in plain(r["url"]).items():
            assert r[f"f_{k}"] == pytest.approx(v), (k, r["url"])
        for k, v in keys(r["url"]).items():
            assert r[f"f_{k}"] == v, (k, r["url"])


def test_rates_of_exact_keys(spark):
    known = [(u, *split(u), float(i % 3 == 0)) for i, u in enumerate(some_urls())]
    df = spark.createDataFrame(known, "_u string, host string, path string, _label double").repartition(3)
    got = {(r["t"], r["key"]): r["rate"] for r in urls.rates(df, Scratch(spark, "t"), 0.25).collect()}
    want = {}
    for u, _, _, label in known:
        for t, key in keys(u).items():
            n, block = want.get((t, key), (0, 0.0))
            want[t, key] = n + 1, block + label
    assert got == {k: pytest.approx((block + 10 * 0.25) / (n + 10)) for k, (n, block) in want.items()}
    rated = spark.createDataFrame([(*k, v) for k, v in got.items() if k[1] != "org"], "t string, key string, rate double")
    for r in urls.features(df, "_u", rated, 0.25).collect():
        for t, key in keys(r["_u"]).items():
            assert r[f"_url_{t}"] == pytest.approx(0.25 if key == "org" else got[t, key])


def test_rows_stay_as_they_are(spark):
    d = spark.createDataFrame([(i % 50, u) for i, u in enumerate(some_urls() * 2)], "page_id long, url string").repartition(4)
    out = urls.judge(d)
    assert Counter((r["page_id"], r["url"]) for r in out.collect()) == Counter((r["page_id"], r["url"]) for r in d.collect())
    by_url = {}
    for r in out.collect():
        by_url.setdefault(r["url"], set()).add((r["rule"], r["verdict"], r["p_block"]))
    assert all(len(v) == 1 for v in by_url.values())
    learned = out.where("rule IS NULL").collect()
    assert all((r["verdict"] == "block") == (r["p_block"] > 0.5) for r in learned)

"""URL filter: rules by host and path, and gradient-boosted trees on lexical features for all other URLs.

DataFrame operations only. The trees learn from URLs that the rules decide.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, table

ALLOW, BLOCK = "allow", "block"
#: (verdict, host, start of the path)
RULES = ((ALLOW, "org", "/"), (BLOCK, "example.org", "/es/"), (BLOCK, "example.org", "/en/1"), (ALLOW, "com", "/fr/"), (BLOCK, "com", "/de/"))
#: Labelled URLs to learn from, about; chosen by a hash of the URL.
TRAIN_ROWS = 20_000
TREES, DEPTH, SMOOTH = 12, 4, 10.0
KEYS = ("top", "folder", "ending")
PLAIN = ("host_length", "path_length", "query_length", "labels", "depth", "digit_ratio", "entropy", "params")


def parts(url: Column) -> tuple[Column, Column]:
    """(host, path): the host runs from after the first :// to /, ?, # or the end (A-Z lower-cased), the path to ?, # or the end."""
    at = F.instr(url, F.lit("://"))
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), upper, upper.lower())
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def matched(host: Column, path: Column, rules: tuple = RULES) -> Column:
    """The longest rule that fits, as struct(rule, verdict), or null. A rule fits its host and subdomains, by start of path."""
    out = None
    for verdict, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r)):
        fits = ((host == h) | F.endswith(host, F.lit(f".{h}"))) & F.startswith(path, F.lit(p))
        value = F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out if out is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def lexical(url: Column, host: Column, path: Column) -> dict[str, Column]:
    """The plain features by name, and the URL's key in each suffix table."""
    u = F.coalesce(url, F.lit(""))
    chars = F.split(u, "")
    count = lambda c: (F.length(u) - F.length(F.replace(u, c, F.lit("")))).cast("double")
    spread = F.aggregate(F.filter(F.array_distinct(chars), lambda c: c != ""), F.lit(0.0), lambda a, c: a + count(c) * F.log2(count(c)))
    query = F.regexp_extract(u, r"\?([^#]*)", 1)
    keys = {"top": F.substring_index(host, ".", -1), "folder": F.regexp_extract(path, "^/([^/]*)/", 1), "ending": F.regexp_extract(path, r"(\.[A-Za-z0-9]+|/)$", 1)}
    return {
        "host_length": F.length(host).cast("double"),
        "path_length": F.length(path).cast("double"),
        "query_length": F.length(query).cast("double"),
        "labels": F.regexp_count(host, F.lit(r"\.")).cast("double"),
        "depth": F.regexp_count(path, F.lit("/")).cast("double"),
        "digit_ratio": F.regexp_count(u, F.lit("[0-9]")) / F.greatest(F.length(u), F.lit(1)),
        "entropy": F.when(F.length(u) > 0, F.log2(F.length(u).cast("double")) - spread / F.length(u)).otherwise(0.0),
        "params": F.when(query == "", 0.0).otherwise(F.regexp_count(query, F.lit("&")) + F.lit(1.0)),
    } | keys


def rates(known: DataFrame, scratch: Scratch, prior: float) -> DataFrame:
    """(t, key, rate): how often URLs with a key of a suffix table are blocked, over all labelled URLs; few URLs pull less."""
    own = lexical(F.col("_u"), F.col("host"), F.col("path"))
    keyed = known.select("_label", F.explode(F.array(*[F.struct(F.lit(k).alias("t"), own[k].alias("key")) for k in KEYS])).alias("k"))
    counts = keyed.groupBy("k.t", "k.key").agg(F.sum("_label").alias("block"), F.count(F.lit(1)).alias("n"))
    return scratch.save(counts.select("t", "key", ((F.col("block") + SMOOTH * prior) / (F.col("n") + SMOOTH)).alias("rate")), "rates")


def features(rows: DataFrame, url: str, rated: DataFrame, prior: float) -> DataFrame:
    """rows(url, host, path) with all features as _url_*; a key that no labelled URL has gets the prior. The tables are
    joined by their keys, sent along only where Spark finds them small."""
    own = lexical(F.col(url), F.col("host"), F.col("path"))
    out = rows.withColumns({f"_url_{k}": own[k] for k in PLAIN} | {f"_key_{k}": own[k] for k in KEYS})
    for k in KEYS:
        table_ = rated.where(F.col("t") == k).select(F.col("key").alias(f"_of_{k}"), F.col("rate").alias(f"_rate_{k}"))
        out = out.join(table_, F.col(f"_key_{k}") == F.col(f"_of_{k}"), "left").withColumn(f"_url_{k}", F.coalesce(f"_rate_{k}", F.lit(prior)))
    return out.drop(*(f"_{x}_{k}" for x in ("key", "of", "rate") for k in KEYS))


def judge(pages: DataFrame, url: str = "url", rules: tuple = RULES, scratch: Scratch | None = None) -> DataFrame:
    """pages with host, path, rule, verdict and p_block (what the trees say; null under a rule).

    Null URLs, and those without ://, have empty host and path, fit no rule and are judged by the trees like others.
    Without labelled URLs of both verdicts the trees can't learn: then all other URLs get the one verdict that the
    labels have, or allow. Repeated rows get the same answer, and one URL counts once in the sample; long URLs are read
    whole; columns that bear a name of the result are replaced, all others pass. An empty table gives an empty one.
    """
    spark = pages.sparkSession
    scratch = scratch or Scratch(spark, "urls")
    pages = pages.drop("host", "path", "rule", "verdict", "p_block")
    host, path = parts(F.col(url))
    rows = pages.withColumn("host", host).withColumn("path", path).withColumn("_rule", matched(F.col("host"), F.col("path"), rules))
    known = rows.where(F.col("_rule").isNotNull()).select(F.col(url).alias("_u"), "host", "path", (F.col("_rule.verdict") == BLOCK).cast("double").alias("_label"))
    total, blocked, urls = known.agg(F.count(F.lit(1)), F.coalesce(F.sum("_label"), F.lit(0.0)), F.approx_count_distinct("_u")).first()
    out = rows.withColumns({"rule": F.col("_rule.rule"), "verdict": F.col("_rule.verdict")}).drop("_rule")
    if not 0 < blocked < total:
        return out.withColumns({"verdict": F.coalesce("verdict", F.lit(BLOCK if blocked else ALLOW)), "p_block": F.lit(None).cast("double")})
    prior = blocked / total
    rated = rates(known, scratch, prior)
    picked = known.where(F.pmod(F.xxhash64("_u"), F.lit(1 << 30)) < F.lit(int(TRAIN_ROWS / urls * (1 << 30)) + 1)).dropDuplicates(["_u"])
    train = features(picked, "_u", rated, prior).select("_label", *[f"_url_{k}" for k in PLAIN + KEYS])
    assemble = VectorAssembler(inputCols=[f"_url_{k}" for k in PLAIN + KEYS], outputCol="_url_x")
    fitted = assemble.transform(scratch.save(train, "train")).select("_url_x", "_label").coalesce(4)
    trees = GBTClassifier(featuresCol="_url_x", labelCol="_label", maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=7).fit(fitted)
    trees.setFeaturesCol("_url_x").setPredictionCol("").setRawPredictionCol("").setProbabilityCol("_url_p")
    scored = trees.transform(assemble.transform(features(out, url, rated, prior))).withColumn("p_block", F.when(F.col("rule").isNull(), vector_to_array("_url_p")[1]))
    scored = scored.withColumn("verdict", F.coalesce("verdict", F.when(F.col("p_block") > 0.5, BLOCK).otherwise(ALLOW)))
    return scored.select(*pages.columns, "host", "path", "rule", "verdict", "p_block")


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict", "p_block")

"""Retrieval by model name: an encoder is injected, a corpus has a format, and one job serves both sides of a battle."""

from __future__ import annotations

import hashlib
import threading
from collections import OrderedDict
from collections.abc import Callable, Hashable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import regex
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.corpora import load_or_build
from . import ann, lexical, retrieval

#: Texts to vectors, one row each.
Encoder = Callable[[list[str]], np.ndarray]
#: How a found passage is shown.
FORMATS = {"arxiv": "Title: {title}\n\nAbstract: {text}", "wikipedia": "{title}\n\n{text}", "stackexchange": "{text}"}


class HashedWords:
    """The default encoder: counts of words by hash, at length one (no words: zero). Needs no weights; a hint counts as
    words of each text."""

    def __init__(self, dims: int = 64):
        self.dims, self.word, self.known = dims, regex.compile(lexical.WORD), {}

    def place(self, word: str) -> int:
        if word not in self.known:
            if len(self.known) > 1 << 18:
                self.known.clear()
            self.known[word] = int(hashlib.md5(word.encode()).hexdigest()[:8], 16) % self.dims
        return self.known[word]

    def __call__(self, texts: list[str], **hints: str) -> np.ndarray:
        out, more = np.zeros((len(texts), self.dims)), "".join(f" {v}" for _, v in sorted(hints.items()))
        for row, text in zip(out, texts, strict=True):
            places = [self.place(w) for w in self.word.findall((text + more).lower())]
            if places:
                row += np.bincount(places, minlength=self.dims)
        size = np.sqrt((out * out).sum(axis=1, keepdims=True))
        return out / np.where(size > 0, size, 1)


@dataclass(frozen=True)
class Model:
    """A name, a method (bm25, exact or approximate), its encoder, and instructions for queries by corpus."""

    name: str
    method: str = "exact"
    encoder: Encoder | None = None
    instructions: dict[str, str] = field(default_factory=dict)


def model_lists(models: DataFrame, fixed: dict[str, list[str]] | None = None, key: str = "model", lexical_name: str = "BM25") -> DataFrame:
    """(task, model): retrieval has all names, clustering and sts all but the lexical one, and a corpus with a list of
    its own (``fixed``) has those of its names that are known."""
    names = models.select(key).distinct()
    tasks = F.when(F.col(key) == lexical_name, F.array(F.lit("retrieval"))).otherwise(F.array(*map(F.lit, ("retrieval", "clustering", "sts"))))
    out = names.select(F.explode(tasks).alias("task"), key)
    for task, chosen in (fixed or {}).items():
        out = out.unionByName(names.where(F.col(key).isin(chosen)).select(F.lit(task).alias("task"), key))
    return out


def encode(texts: DataFrame, encoder: Encoder, key: str, text: str = "text", instruction: str = "", rows: int = 512) -> DataFrame:
    """key, embedding: each Arrow batch is encoded in runs of ``rows`` texts; a null text is an empty one."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for at in range(0, len(f), rows):
                part = f.iloc[at : at + rows]
                yield pd.DataFrame({key: part[key].to_numpy(), "embedding": list(np.asarray(encoder(part["t"].tolist()), float))})

    d = texts.select(F.col(key).cast("long").alias(key), F.concat(F.lit(instruction), F.coalesce(text, F.lit(""))).alias("t"))
    return d.mapInPandas(run, f"{key} long, embedding array<double>")


#: The hints that some encoders take, by task and model.
HINTS = {
    "clustering": {
        "text-embedding-004": {"google_task_type": "CLUSTERING"},
        "embed-english-v3.0": {"cohere_task_type": "clustering"},
        "nomic-ai/nomic-embed-text-v1.5": {"input_type": "clustering"},
        "nomic-ai/nomic-embed-text-v1": {"input_type": "clustering"},
    },
    "sts": {
        "text-embedding-004": {"google_task_type": "SEMANTIC_SIMILARITY"},
        "nomic-ai/nomic-embed-text-v1.5": {"input_type": "classification"},
        "nomic-ai/nomic-embed-text-v1": {"input_type": "classification"},
    },
}


class Held:
    """What was loaded, by key, the ``most`` used last: each key is loaded once at a time, by one thread."""

    def __init__(self, most: int = 8):
        self.most, self.lock, self.found = most, threading.Lock(), OrderedDict()

    def get(self, key: Hashable, load: Callable):
        with self.lock:
            if key not in self.found:
                self.found[key] = load()
            self.found.move_to_end(key)
            while len(self.found) > self.most:
                self.found.popitem(last=False)
            return self.found[key]


#: Of each Python worker, for as long as it lives.
ENCODERS = Held()


def held_encoder(key: Hashable, load: Callable[[], Encoder]) -> Encoder:
    return ENCODERS.get(key, load)


def encode_requests(requests: DataFrame, loaders: dict[str, Callable[[], Encoder]], key: str, text: str = "text", model: str = "model", task: str = "task", hints: dict[str, dict[str, dict[str, str]]] = HINTS) -> DataFrame:
    """key, model, task, embedding: each request by its own model, with the hints of its task.

    A worker loads a model when it first meets it and keeps it for later batches, tasks and queries with the same loader.
    A model without loader is an error; a null text is an empty one.
    """
    keys = {name: (name, hashlib.sha256(cloudpickle.dumps(load)).hexdigest()) for name, load in loaders.items()}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for (name, kind), part in f.groupby(["model", "task"], sort=False, dropna=False):
                if name not in loaders:
                    raise KeyError(f"no loader for model {name}")
                encoder = held_encoder(keys[name], loaders[name])
                kind = None if pd.isna(kind) else kind
                found = np.asarray(encoder(part["t"].tolist(), **hints.get(kind, {}).get(name, {})), float)
                same = lambda x, n=len(part): pd.Series([x] * n, dtype=object)
                yield pd.DataFrame({"id": part["id"].to_numpy(), "model": same(name), "task": same(kind), "embedding": list(found)})

    d = requests.select(F.col(key).cast("long").alias("id"), F.col(model).alias("model"), F.col(task).alias("task"), F.coalesce(text, F.lit("")).alias("t"))
    return d.mapInPandas(run, "id long, model string, task string, embedding array<double>").withColumnRenamed("id", key)


class Indices:
    """Indices by model and corpus: found at ``path``, or built and saved there, once, and then kept by the executors."""

    def __init__(self, path: str):
        self.path, self.found = path, {}

    def get(self, spark: SparkSession, model: str, corpus: str, build: Callable[[], DataFrame], key: str = "doc_id") -> DataFrame:
        if (model, corpus) not in self.found:
            name = f"{self.path}/index_{corpus}_{model.replace('/', '_')}"
            self.found[model, corpus] = load_or_build(spark, name, build, key=key).persist()
        return self.found[model, corpus]

    def release(self) -> None:
        while self.found:
            self.found.popitem()[1].unpersist()


def build_index(passages: DataFrame, encoder: Encoder, key: str = "doc_id", text: str = "text", title: str | None = None) -> DataFrame:
    """The dense index of a corpus; a title goes before the text."""
    whole = passages.withColumn(text, F.concat_ws(" ", title, text)) if title else passages
    return encode(whole, encoder, key, text)


def shown(corpus: str, title: Column, text: Column) -> Column:
    """A passage in its corpus's format; a corpus without one is an error."""
    pieces = regex.split(r"(\{title\}|\{text\})", FORMATS[corpus])
    values = {"{title}": F.coalesce(title, F.lit("")), "{text}": F.coalesce(text, F.lit(""))}
    return F.concat(*[values.get(p, F.lit(p)) for p in pieces if p])


def retrieve(queries: DataFrame, passages: DataFrame, corpus: str, model: Model, k: int = 1, index: DataFrame | None = None, qkey: str = "item_id", key: str = "doc_id", text: str = "text", title: str | None = None) -> DataFrame:
    """qkey, model, rank, key, score, passage: the k best of the corpus for each query by the model's method.

    Passages are joined to the few found ids at the end, so texts are formatted only where they are found.
    """
    if model.method == "bm25":
        found = lexical.bm25(passages, queries, k, key, text, qkey, title=title)
    elif model.method in ("exact", "approximate"):
        index = build_index(passages, model.encoder, key, text, title) if index is None else index
        asked = encode(queries, model.encoder, qkey, instruction=model.instructions.get(corpus, ""))
        search = retrieval.knn if model.method == "exact" else ann.knn_approximate
        found = search(index.withColumnRenamed(key, "vec_id"), asked.withColumnRenamed(qkey, "vec_id"), k).withColumnsRenamed({"query_id": qkey, "vec_id": key})
    else:
        raise ValueError(f"unknown method {model.method}")
    passage = passages.select(key, shown(corpus, F.col(title) if title else F.lit(""), F.col(text)).alias("passage"))
    return found.join(passage, key).select(qkey, F.lit(model.name).alias("model"), "rank", key, "score", "passage")


def retrieve_pair(queries: DataFrame, passages: DataFrame, corpus: str, models: dict[str, Model], qkey: str = "item_id", **options) -> DataFrame:
    """queries(qkey, text, model_a, model_b) -> one row per query and side: side, model and the found passage.

    Each model searches once, for the queries that name it on either side.
    """
    named = queries.select(qkey, F.posexplode(F.array("model_a", "model_b")).alias("side", "model"))
    found = None
    for m in models.values():
        mine = named.where(F.col("model") == m.name).select(qkey).distinct()
        part = retrieve(queries.join(mine, qkey, "left_semi"), passages, corpus, m, qkey=qkey, **options)
        found = part if found is None else found.unionByName(part)
    return named.join(found, [qkey, "model"])

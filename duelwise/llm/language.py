"""Language ID: blended-spectrum presence kernels, Nyström landmarks, one-versus-rest kernel ridge regression.

Two texts are as near as the number of byte n-grams (1 to 3, A-Z lower-cased) that both hold, over the geometric mean
of how many each holds. A model keeps landmark texts and one weight per landmark and language, so scoring a batch is
two matrix products. Languages are learned from a bounded sample; every row is scored over its whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .common import _LOWER, Scratch, bound_batches, table, text_chunks

#: Training bounds: texts per language, texts in all (each language has its share), landmarks; and the ridge.
TEXTS, SAMPLE, LANDMARKS, RIDGE = 500, 100_000, 256, 1e-2
#: Tables of up to so many labels are sent to every task.
BROADCAST_LABELS = 50_000
#: Sums that come to the driver for a label, whatever the number of tasks.
SUMS = 16
#: Levels of kin (0 to 1) that texts are counted by.
LEVELS = 10_000
SPECTRUM, DIM, ROWS = (1, 2, 3), 1 << 16, 128
UNKNOWN = "und"


def presence(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Rows by hashed n-grams: which occur."""
    n, out = len(buf), np.zeros((len(off) - 1, DIM), bool)
    if not n:
        return out
    row = np.repeat(np.arange(len(off) - 1), np.diff(off))
    low, h = _LOWER[buf].astype(np.uint32), np.zeros(n, np.uint32)
    for k in range(1, max(SPECTRUM) + 1):
        m = n - k + 1
        if m <= 0:
            break
        h = h[:m] * np.uint32(0x01000193) + low[k - 1 :] + np.uint32(k)
        if k in SPECTRUM:
            x = h ^ (h >> np.uint32(15))
            x = (x * np.uint32(0x2C1B3C6D)) >> np.uint32(16)
            inside = row[:m] == row[k - 1 :]
            out[row[:m][inside], x[inside]] = True
    return out


@dataclass
class Model:
    languages: list[str]
    vocabulary: np.ndarray  # hashed n-grams of the landmarks
    landmarks: np.ndarray  # vocabulary by landmarks, float32, each column over its norm
    weights: np.ndarray  # landmarks by languages
    bias: np.ndarray

    def kernel(self, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        held = presence(buf, off)
        norm = np.sqrt(np.maximum(np.count_nonzero(held, axis=1), 1)).astype(np.float32)
        return held[:, self.vocabulary].astype(np.float32) @ self.landmarks / norm[:, None]

    def scores(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One-versus-rest values, about 1 for the own language and -1 for others; the kernel's value at the nearest landmark."""
        kernel = self.kernel(buf, off)
        return kernel @ self.weights + self.bias, kernel.max(axis=1)


def sample(train: DataFrame, text: str = "text", label: str = "lang") -> DataFrame:
    """(t, y, place): about as many rows of each label as its share of the bounds is, chosen by a hash of the row."""
    rows = train.where(F.col(text).isNotNull() & F.col(label).isNotNull()).select(F.col(text).alias("t"), F.col(label).cast("string").alias("y"))
    place = F.pmod(F.xxhash64("t", "y"), F.lit(1 << 40)).cast("double") / float(1 << 40)
    counts = rows.groupBy("y").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("least"))
    labels = max(1, counts.count())
    share = counts.select(F.col("y").alias("_y"), (F.lit(max(1, min(TEXTS, SAMPLE // labels))) / F.col("n")).alias("share"), "least")
    share = F.broadcast(share) if labels <= BROADCAST_LABELS else share
    # The least place of a label is always in, so that no label is without a text.
    picked = rows.withColumn("place", place).join(share, F.col("y") == F.col("_y")).where("place < share OR place = least")
    return picked.select("t", "y", "place").distinct()


def fit(train: DataFrame, text: str = "text", label: str = "lang", scratch: Scratch | None = None) -> Model | None:
    """Learn from a sample (TEXTS, SAMPLE) of all labels; equal rows count once. None, if no row has text and label.

    The landmarks are the texts of smallest hash. Tasks add up the products of their texts' features; only the sums,
    which depend on the number of landmarks and labels, come to the driver.
    """
    spark = train.sparkSession
    bound_batches(spark)
    rows = (scratch or Scratch(spark, "language")).save(sample(train, text, label), "sample")
    first = rows.orderBy("place", "t", "y").limit(LANDMARKS).mapInArrow(_bits, "place double, data binary").toPandas()
    if not len(first):
        return None
    first = first.sort_values(["place", "data"], ignore_index=True)
    marks = np.unpackbits(np.frombuffer(b"".join(first["data"]), np.uint8).reshape(len(first), -1), axis=1)
    vocabulary = np.flatnonzero(marks.any(axis=0))
    norm = np.sqrt(np.maximum(marks.sum(axis=1), 1)).astype(np.float32)
    landmarks = (marks[:, vocabulary].astype(np.float32) / norm[:, None]).T
    values, vectors = np.linalg.eigh((landmarks.T @ landmarks).astype(float))
    keep = values > 1e-6 * values.max()
    whiten = vectors[:, keep] / np.sqrt(values[keep])
    held = spark.sparkContext.broadcast((vocabulary, landmarks, whiten))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc, land, white = held.value
        gram, sums, count = np.zeros((white.shape[1] + 1,) * 2), {}, 0
        for batch in batches:
            labels = batch.column(1).to_pylist()
            for i, j, buf, off in _blocks(batch.column(0)):
                x = presence(buf, off)
                size = np.sqrt(np.maximum(np.count_nonzero(x, axis=1), 1))
                f = np.column_stack([(x[:, voc].astype(np.float32) @ land / size[:, None]) @ white, np.ones(j - i)])
                gram += f.T @ f
                count += j - i
                for y, row in zip(labels[i:j], f, strict=True):
                    sums[y] = sums.get(y, 0) + row
        names = [None, *sums]
        data = [gram.tobytes(), *(v.tobytes() for v in sums.values())]
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([count] * len(names), pa.int64()), pa.array(data, pa.binary())], names=["label", "n", "data"])

    def together(t: pa.Table) -> pa.Table:
        data = np.sum([np.frombuffer(x) for x in t.column("data").to_pylist()], axis=0)
        return pa.table({"label": t.column("label").slice(0, 1), "n": pa.array([sum(t.column("n").to_pylist())], pa.int64()), "data": pa.array([data.tobytes()], pa.binary())})

    # Executors add up the tasks' sums, so that what comes to the driver doesn't grow with the number of tasks.
    parts = rows.select("t", "y").mapInArrow(add, "label string, n long, data binary").withColumn("g", F.spark_partition_id() % SUMS)
    gram, total, sums = 0, 0, {}
    for r in parts.groupBy("label", "g").applyInArrow(together, "label string, n long, data binary").collect():
        part = np.frombuffer(r["data"])
        if r["label"] is None:
            gram, total = gram + part.reshape(whiten.shape[1] + 1, -1), total + r["n"]
        else:
            sums[r["label"]] = sums.get(r["label"], 0) + part
    languages = sorted(sums)
    all_sums = sum(sums.values())
    goal = np.column_stack([2 * sums[y] - all_sums for y in languages])
    beta = np.linalg.solve(gram + RIDGE * total / 100 * np.eye(len(gram)), goal)
    return Model(languages, vocabulary, landmarks, (whiten @ beta[:-1]).astype(np.float32), beta[-1].astype(np.float32))


def least_kin(train: DataFrame, model: Model | None, text: str = "text", label: str = "lang", quantile: float = 0.01, share: float = 0.64) -> float:
    """How near its nearest landmark a text of the learned languages is at least: ``share`` of a low quantile of the kin
    of all labelled texts (each row counts; empty ones don't), where a landmark's own kin is that to its nearest other
    one. 0 without a model, or with one landmark.

    Texts are counted by levels of kin (LEVELS), rounded down, so that the quantile is one of all texts and no more than
    a number per level comes to the driver.
    """
    if model is None or model.landmarks.shape[1] < 2:
        return 0.0
    spark = train.sparkSession
    held = spark.sparkContext.broadcast(model)

    def kin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, buf, off in _blocks(batch.column(0)):
                near = np.sort(held.value.kernel(buf, off), axis=1)[:, -2:]
                yield pa.RecordBatch.from_arrays([pa.array(np.where(near[:, 1] > 0.9999, near[:, 0], near[:, 1]).astype(float))], names=["kin"])

    bound_batches(spark)
    rows = train.where(F.col(text).isNotNull() & (F.col(text) != "") & F.col(label).isNotNull()).select(F.col(text).alias("t"))
    counts = sorted(map(tuple, rows.mapInArrow(kin, "kin double").groupBy(F.floor(F.col("kin") * LEVELS).alias("level")).agg(F.count(F.lit(1)).alias("n")).collect()))
    wanted = quantile * sum(n for _, n in counts)
    for level, n in counts:
        wanted -= n
        if wanted <= 0:
            return share * level / LEVELS
    return 0.0


def _bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j, buf, off in _blocks(batch.column(0)):
            rows = [x.tobytes() for x in np.packbits(presence(buf, off), axis=1)]
            yield pa.RecordBatch.from_arrays([batch.column(2).slice(i, j - i), pa.array(rows, pa.binary())], names=["place", "data"])


def _blocks(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    for i, j, buf, off in text_chunks(texts):
        for a in range(0, j - i, ROWS):
            b = min(a + ROWS, j - i)
            yield i + a, i + b, buf[off[a] : off[b]], off[a : b + 1] - off[a]


def identify(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """docs with lang_pred, score (0 to 1: how far the best machine claims the text) and kin (0 to 1: how near the
    nearest landmark is, whatever its language and however many there are).

    Texts count whole, however long; empty ones have no letter. An empty table gives an empty one. Null text, or text without a letter, is ``und`` with score and kin 0, and so is every row without a model. Repeated rows
    get the same answer; ties go to the first language in order; a column that bears a name of the result is replaced.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    docs = docs.drop("lang_pred", "score", "kin")
    at, held = docs.columns.index(text), spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for batch in batches:
            texts = batch.column(at)
            names, scores, kins = [UNKNOWN] * len(texts), [0.0] * len(texts), [0.0] * len(texts)
            for i, _, buf, off in _blocks(texts) if m else ():
                f, near = m.scores(buf, off)
                best = f.argmax(axis=1)
                letters = np.concatenate([[0], np.cumsum((buf | 32) - np.uint8(97) < 26)])
                ascii_letters = letters[off[1:]] > letters[off[:-1]]
                for k, b in enumerate(best.tolist()):
                    if ascii_letters[k] or any(map(str.isalpha, texts[i + k].as_py() or "")):
                        names[i + k], scores[i + k], kins[i + k] = m.languages[b], float(np.clip((f[k, b] + 1) / 2, 0, 1)), float(np.clip(near[k], 0, 1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(kins, pa.float64())], names=[*batch.schema.names, "lang_pred", "score", "kin"])

    schema = StructType([*docs.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("kin", DoubleType())])
    return docs.mapInArrow(run, schema)


def held_out(key: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 4 == 2, F.lit(False))


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", held_out().alias("held_out"))
    model = fit(docs.where(F.col("doc_id").isNotNull() & ~F.col("held_out")))
    return identify(docs.drop("lang"), model).select("doc_id", "held_out", "lang_pred", "score")

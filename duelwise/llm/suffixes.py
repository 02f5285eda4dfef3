"""Removal of repeated byte strings over a corpus, by sorting suffixes in sampled ranges of their leading token.

Sorting all suffixes of a corpus would move each byte hundreds of times, so the suffix order is built sparsely: the
leading token of a window of LENGTH bytes is the smallest K-byte hash inside it, and consecutive windows of one token
are a run. Equal windows have equal tokens. Splitters sampled from the corpus cut the order of (token, content) into
ranges; a bucket holds one range of runs in order. A run that is alone in its token has no repeat, a run whose whole
content comes again is a repeat, and a token that a splitter falls into is judged over all the buckets it lies in. Only
runs that share their token but not their content are fetched, again by sampled ranges. Their suffixes (all windows) are
sorted by a multikey quicksort whose characters are eight-byte words of the text itself, and ties are repeats. A token of
very many runs is split by the depth at which its windows hold it, which equal windows share.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import _BYTE, Scratch, arrow_batch, arrow_schema, bound_batches, mix, partitions, table, text_chunks

LENGTH, K = 200, 32
#: Longest run in windows; runs of one leading token from which it is split by depth; windows that one sort takes up.
RUN, BUCKET, SORTED = 1024, 4096, 1 << 18
#: Documents of the sample of splitters, about, and runs of it for each bucket.
SAMPLE_DOCS, PER_BUCKET = 2000, 64
_BASE = 0xD6E8FEB86659FD93


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up = lambda b: np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, np.uint64(b), np.uint64)]), dtype=np.uint64)
    return up(_BASE), up(pow(_BASE, -1, 1 << 64))


def runs(buf: np.ndarray, off: np.ndarray, length: int = LENGTH, k: int = K) -> tuple[np.ndarray, ...]:
    """row, lo, windows, leading hash, content hash of each run, and whether its leading k-mer comes in it twice.

    Positions are within the row. Equal windows inside one run need the k-mer twice, so all other runs have none.
    """
    empty = tuple(np.zeros(0, np.int64) for _ in range(6))
    n = len(buf)
    if n < length:
        return empty
    power, inverse = _powers(1 << max(20, n.bit_length()))
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[buf] * power[:n], out=total[1:])
    least = kmers = mix((total[k:] - total[:-k]) * inverse[: n - k + 1])
    width, span = length - k + 1, 1
    while span * 2 <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < width:
        least = np.minimum(least[: len(least) - (width - span)], least[width - span :])
    valid = np.zeros(len(least), bool)  # starts of windows inside one row
    for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
        if b - a >= length:
            valid[a : b - length + 1] = True
    first = valid.copy()
    first[1:] &= (least[1:] != least[:-1]) | ~valid[:-1]
    edge = off[:-1][off[:-1] < len(first)]
    first[edge] = valid[edge]
    starts = np.flatnonzero(first)
    if not len(starts):
        return empty
    last = valid.copy()
    last[:-1] &= first[1:] | ~valid[1:]
    ends = np.flatnonzero(last) + 1
    if (long := ends - starts > RUN).any():
        parts = [np.arange(a, b, RUN) for a, b in zip(starts[long], ends[long], strict=True)]
        starts = np.sort(np.concatenate([starts[~long], *parts]))
        ends = np.sort(np.concatenate([ends, *(p[1:] for p in parts)]))
    row = np.searchsorted(off, starts, "right") - 1
    raw = memoryview(np.ascontiguousarray(buf))
    digest = xxhash.xxh3_128_digest
    content = b"".join([digest(raw[i:j]) for i, j in zip(starts.tolist(), (ends - 1 + length).tolist(), strict=True)])
    # Places of k-mers that are some window's smallest. Two equal ones next to each other, and so near that no window
    # lies between them, are what a run needs to hold its token twice.
    held = np.concatenate([np.zeros(width - 1, np.uint64), np.where(valid, least, np.uint64(0)), np.zeros(len(kmers) - len(least), np.uint64)])
    span = 1
    while span * 2 <= width:
        held = np.maximum(held[:-span], held[span:])
        span *= 2
    if span < width:
        held = np.maximum(held[: len(held) - (width - span)], held[width - span :])
    places = np.flatnonzero(held == kmers)
    twins = np.zeros(len(places) + 1, np.int64)
    if len(places) > 1:
        twins[2:] = np.cumsum((kmers[places[1:]] == kmers[places[:-1]]) & (np.diff(places) <= width))
    lo, hi = np.searchsorted(places, starts), np.searchsorted(places, ends + width - 1)
    twice = (hi - lo > 1) & (twins[hi] > twins[np.minimum(lo + 1, len(places))])
    return row, starts - off[row], ends - starts, least[starts].view(np.int64), np.frombuffer(content, "<i8").reshape(-1, 2), twice


RUNS = "part int, lead long, c1 long, c2 long, twice int, doc_id long, fp long, lo long, windows int"
MARKS = "kind int, lead long, c1 long, c2 long, twice int, doc_id long, fp long, lo long, windows int"
#: Kinds of marks: the run is a repeat; the run has to be compared; both (it stands for all runs of its content); its
#: token lies in several buckets.
REPEAT, COMPARE, BOTH, EDGE = 0, 1, 2, 3


class Ranges:
    """Splitters (token, first half of the content) in order; the token alone, where contents play no part."""

    def __init__(self, pairs: list[tuple[int, int]], buckets: int):
        pairs = sorted(pairs)
        cut = sorted({pairs[len(pairs) * k // buckets] for k in range(1, buckets)}) if pairs else []
        self.lead, self.c1 = np.array([x for x, _ in cut], np.int64), np.array([x for _, x in cut], np.int64)
        self.split = set(self.lead.tolist())

    def bucket(self, lead: np.ndarray, c1: np.ndarray) -> np.ndarray:
        part, end = np.searchsorted(self.lead, lead), np.searchsorted(self.lead, lead, "right")
        for k in np.flatnonzero(part < end).tolist():
            part[k] += np.searchsorted(self.c1[part[k] : end[k]], c1[k], "right")
        return part.astype(np.int32)


def _emit_runs(ranges: Ranges, buckets: int):
    """Runs that come more than once in a chunk are known repeats; all but one of them go anywhere, by themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = arrow_schema(RUNS)
        for batch in batches:
            ids, fps = batch.column(0), batch.column(1)
            for i, _, buf, off in text_chunks(batch.column(2)):
                row, lo, windows, lead, content, own = runs(buf, off)
                if not len(row):
                    continue
                order = np.lexsort((content[:, 1], content[:, 0], lead))
                a, b, c = lead[order], content[order, 0], content[order, 1]
                same = (a[1:] == a[:-1]) & (b[1:] == b[:-1]) & (c[1:] == c[:-1])
                again = np.concatenate([[False], same])
                twin = again | np.concatenate([same, [False]])
                twice = np.where(again, 2, np.where(twin, 1, 0)).astype(np.int32) + np.where(own[order] & ~again, 4, 0).astype(np.int32)
                at = pa.array(row[order] + i)
                spread = mix((row[order] * 1000003 + lo[order]).astype(np.uint64)) % np.uint64(buckets)
                part = np.where(again, spread.astype(np.int32), ranges.bucket(a, b))
                yield arrow_batch(schema, [part, a, b, c, twice, ids.take(at), fps.take(at), lo[order], windows[order].astype(np.int32)])

    return run


def _match_runs(ranges: Ranges):
    """Rows of a bucket in order: judges each leading token that lies in this bucket alone when all its runs are there."""

    def judged(t: pa.Table) -> pa.RecordBatch:
        lead, c1, c2, twice = (t.column(k).to_numpy() for k in ("lead", "c1", "c2", "twice"))
        n = len(lead)
        new_lead = np.ones(n, bool)
        new_lead[1:] = lead[1:] != lead[:-1]
        new_content = new_lead.copy()
        new_content[1:] |= (c1[1:] != c1[:-1]) | (c2[1:] != c2[:-1])
        g, h = np.cumsum(new_content) - 1, np.cumsum(new_lead) - 1
        repeat = (np.bincount(g)[g] > 1) | (twice & 3 == 1)
        several = (np.bincount(h, new_content)[h] > 1) | (twice & 4 > 0)
        kind = np.where(repeat, np.where(several & new_content, BOTH, REPEAT), np.where(several, COMPARE, -1)).astype(np.int32)
        return marked(t, kind)

    def marked(t: pa.Table | pa.RecordBatch, kind: np.ndarray) -> pa.RecordBatch:
        keep = pa.array(kind >= 0)
        columns = [t.column(k) for k in ("lead", "c1", "c2", "twice", "doc_id", "fp", "lo", "windows")]
        columns = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns]
        return pa.RecordBatch.from_arrays([pa.array(kind).filter(keep), *(c.filter(keep) for c in columns)], schema=arrow_schema(MARKS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        split = np.array(sorted(ranges.split), np.int64)
        for batch in batches:
            known = batch.column("twice").to_numpy() == 2
            edge = ~known & np.isin(batch.column("lead").to_numpy(), split)
            if (known | edge).any():
                yield marked(batch, np.where(known, REPEAT, np.where(edge, EDGE, -1)).astype(np.int32))
                batch = batch.filter(pa.array(~(known | edge)))
            if not len(batch):
                continue
            held.append(batch)
            t = pa.Table.from_batches(held)
            lead = t.column("lead").to_numpy()
            cut = int(np.searchsorted(lead, lead[-1]))  # the last token may go on
            if cut:
                yield judged(t.slice(0, cut))
                held = t.slice(cut).to_batches()
        if held:
            yield judged(pa.Table.from_batches(held))

    return run


def _across(edges: DataFrame) -> DataFrame:
    """Marks of runs whose token lies in several buckets, from counts over all of them."""
    where = F.struct("doc_id", "fp", "lo")
    contents = edges.groupBy("lead", "c1", "c2").agg(F.count(F.lit(1)).alias("n"), F.min(where).alias("one"))
    leads = contents.groupBy("lead").agg(F.count(F.lit(1)).alias("contents"))
    rows = edges.join(contents, ["lead", "c1", "c2"]).join(leads, "lead")
    repeat = F.expr("n > 1 OR twice & 3 = 1")
    several = F.expr("contents > 1 OR twice & 4 > 0")
    kind = F.when(repeat, F.when(several & where.eqNullSafe(F.col("one")), BOTH).otherwise(REPEAT)).when(several, COMPARE)
    return rows.withColumn("kind", kind).where("kind IS NOT NULL").select("kind", "lead", "doc_id", "fp", "lo", "windows")


CUTS = "part int, lead long, depth int, doc_id long, fp long, lo long, windows int, bytes binary"
SPANS = "doc_id long, fp long, lo long, windows int"


def _depths(raw: bytes, windows: int, lead: int) -> np.ndarray:
    """For each window of a run, how far into it its leading token comes first."""
    buf = np.frombuffer(raw, np.uint8)
    power, inverse = _powers(1 << max(20, len(buf).bit_length()))
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_BYTE[buf] * power[: len(buf)], out=total[1:])
    at = np.flatnonzero(mix((total[K:] - total[:-K]) * inverse[: len(buf) - K + 1]).view(np.int64) == lead)
    start = np.arange(windows)
    return at[np.searchsorted(at, start)] - start


def _cut(ranges: Ranges, buckets: int):
    """The bytes of runs that are compared, in one piece; of hot tokens, in one piece for each depth of the token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = arrow_schema(CUTS)
        for batch in batches:
            for doc, fp, text, wanted in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                raw, out = text.encode(), []
                parts = ranges.bucket(np.array([w["lead"] for w in wanted], np.int64), np.zeros(len(wanted), np.int64)).tolist()
                for w, part in zip(wanted, parts, strict=True):
                    lead, lo, n = w["lead"], w["lo"], w["windows"]
                    own = raw[lo : lo + n - 1 + LENGTH]
                    if not w["hot"]:
                        out.append((part, lead, -1, doc, fp, lo, n, own))
                        continue
                    for k, d in enumerate(_depths(own, n, lead).tolist()):
                        out.append((int(mix(np.array([lead + d], np.int64).view(np.uint64))[0]) % buckets, lead, d, doc, fp, lo + k, 1, own[k : k + LENGTH]))
                for k in range(0, len(out), 5000):
                    yield arrow_batch(schema, list(zip(*out[k : k + 5000], strict=True)))

    return run


def multikey_ties(words: np.ndarray, at: np.ndarray, group: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Which of the strings words[at:] of ``length`` bytes have an equal in their group: a multikey quicksort by words
    that goes on, in each group of strings equal so far, at the first word in which any of them differs from the first."""
    tied, active, level, group = np.zeros(len(at), bool), np.arange(len(at)), np.zeros(len(at), np.int64), group.copy()
    steps, never = [*range(0, length - 7, 8), *([length - 8] if length % 8 else [])], 1 << 30
    while len(active):
        key = words[at[active] + level]
        order = np.lexsort((key, group[active]))
        active, key = active[order], key[order]
        g = group[active]
        new = np.ones(len(active) + 1, bool)
        new[1:-1] = (g[1:] != g[:-1]) | (key[1:] != key[:-1])
        alone = new[:-1] & new[1:]
        active, head = active[~alone], new[:-1][~alone]
        if not len(active):
            break
        heads = np.flatnonzero(head)
        g = np.cumsum(head) - 1
        here, first = at[active], at[active[heads]][g]
        differ = np.full(len(active), never)
        for step in reversed(steps):
            differ[words[here + step] != words[first + step]] = step
        level = np.minimum.reduceat(differ, heads)[g]
        whole = level == never
        tied[active[whole]] = True
        group[active] = g
        active, level = active[~whole], level[~whole]
    return tied


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of token and depth: windows with an equal in another place of the bucket."""
    schema = arrow_schema(SPANS)

    def sort(t: pa.Table) -> pa.RecordBatch | None:
        t = t.combine_chunks()
        lead, depth, windows, lo = (t.column(k).to_numpy() for k in ("lead", "depth", "windows", "lo"))
        same = (lead[1:] == lead[:-1]) & (depth[1:] == depth[:-1])
        raw = t.column("bytes").combine_chunks()
        _, offsets, data = raw.buffers()
        off = np.frombuffer(offsets, np.int32)[raw.offset : raw.offset + len(raw) + 1].astype(np.int64)
        buf = np.frombuffer(data, np.uint8)
        words = np.ndarray((len(buf) - 7,), "<u8", buf, strides=(1,))
        r = np.repeat(np.arange(len(lead)), windows)
        place = np.arange(len(r)) - np.repeat(np.cumsum(windows) - windows, windows)
        group = np.cumsum(np.concatenate([[0], ~same]))[r]
        tied = multikey_ties(words, off[r] + place, group)
        head = tied.copy()
        head[1:] &= ~tied[:-1] | (r[1:] != r[:-1])
        tail = tied.copy()
        tail[:-1] &= ~tied[1:] | (r[1:] != r[:-1])
        a, b = np.flatnonzero(head), np.flatnonzero(tail)
        if not len(a):
            return None
        at = pa.array(r[a])
        ids, fps = (t.column(k).combine_chunks().take(at) for k in ("doc_id", "fp"))
        return arrow_batch(schema, [ids, fps, lo[r[a]] + place[a], (b - a + 1).astype(np.int32)])

    held: list[pa.RecordBatch] = []
    windows = 0
    for whole in batches:
        for k in range(0, len(whole), 1024):
            batch = whole.slice(k, 1024)
            held.append(batch)
            windows += int(batch.column("windows").to_numpy().sum())
            if windows < SORTED:
                continue
            t = pa.Table.from_batches(held)
            lead, depth = t.column("lead").to_numpy(), t.column("depth").to_numpy()
            cut = int(np.argmax((lead == lead[-1]) & (depth == depth[-1])))  # the last group may go on
            if cut:
                if (x := sort(t.slice(0, cut))) is not None:
                    yield x
                held = [pa.RecordBatch.from_arrays([c.combine_chunks() for c in t.slice(cut).columns], schema=t.schema)]
                windows = int(held[0].column("windows").to_numpy().sum())
    if held and (x := sort(pa.Table.from_batches(held))) is not None:
        yield x


def _sampled(rows: DataFrame, buckets: int) -> list[tuple[int, int]]:
    """(token, content) of runs chosen by their hash, a bounded number for each bucket."""
    order = F.xxhash64("lead", "c1", "doc_id", "lo")
    return [(r[0], r[1]) for r in rows.select("lead", "c1", order.alias("o")).orderBy("o").limit(PER_BUCKET * buckets).collect()]


def repeated_spans(docs: DataFrame, key: str, text: str, scratch: Scratch) -> DataFrame:
    """(doc_id, fp, lo, windows): runs of windows of LENGTH bytes that start anywhere else too."""
    n = partitions(docs.sparkSession)
    source = docs.select(F.col(key).cast("long").alias("doc_id"), F.xxhash64(text).alias("fp"), F.col(text).alias("text")).where(F.octet_length("text") >= LENGTH)
    some = source.where(F.pmod(F.xxhash64("fp", "doc_id"), F.lit(max(1, docs.count() // SAMPLE_DOCS))) == 0)
    ranges = Ranges(_sampled(some.mapInArrow(_emit_runs(Ranges([], 1), 1), RUNS), n), n)
    dealt = source.mapInArrow(_emit_runs(ranges, n), RUNS).repartitionById(n, "part").sortWithinPartitions("lead", "c1", "c2")
    first = scratch.save(dealt.mapInArrow(_match_runs(ranges), MARKS), "marks", "kind")
    columns = ["kind", "lead", "doc_id", "fp", "lo", "windows"]
    marks = scratch.save(first.where(F.col("kind") != EDGE).select(*columns).unionByName(_across(first.where(F.col("kind") == EDGE)).select(*columns)), "judged", "kind")
    wanted = marks.where(F.col("kind") != REPEAT)
    deep = Ranges(_sampled(wanted.withColumn("c1", F.lit(0).cast("long")), n), n)
    hot = wanted.groupBy("lead").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > BUCKET).select("lead", F.lit(True).alias("hot"))
    per_doc = wanted.join(hot, "lead", "left").groupBy("doc_id", "fp").agg(F.collect_list(F.struct("lead", "lo", "windows", F.coalesce("hot", F.lit(False)).alias("hot"))).alias("wanted"))
    both = per_doc.withColumnsRenamed({"doc_id": "_d", "fp": "_f"})
    # Rows of one key and text are the same place: their runs are equal anyway, and one of them stands for all.
    joined = source.join(both, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("fp") == F.col("_f"))).select("doc_id", "fp", "text", "wanted")
    cuts = joined.mapInArrow(_cut(deep, n), CUTS).repartitionById(n, "part").sortWithinPartitions("lead", "depth")
    found = scratch.save(cuts.mapInArrow(_compare, SPANS), "found")
    return marks.where(F.col("kind") != COMPARE).select("doc_id", "fp", "lo", "windows").unionByName(found)


KEPT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", scratch: Scratch | None = None, with_bytes: bool = True) -> DataFrame:
    """key, n_bytes, n_removed, n_spans, kept_sha256 (and kept, the remaining bytes) for every row.

    A byte goes if a string of LENGTH bytes covers it that starts anywhere else, in any row or the same one, as judged
    on the input. Null text is empty; texts under LENGTH bytes stay whole; equal rows remove each other; an empty
    table gives no rows. Other columns play no part.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    spans = repeated_spans(docs, key, text, scratch or Scratch(spark, "repeats"))
    spans = spans.groupBy("doc_id", "fp").agg(F.collect_list(F.struct("lo", "windows")).alias("spans")).withColumnsRenamed({"doc_id": "_d", "fp": "_f"})
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.xxhash64(text).alias("fp"), F.col(text).alias("text"))
    joined = rows.join(spans, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("fp") == F.col("_f")), "left").select("doc_id", "text", "spans")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = arrow_schema(KEPT)
        for batch in batches:
            out = []
            for doc, t, marks in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                raw, kept, at, removed, count = (t or "").encode(), [], 0, 0, 0
                for lo, hi in _merged(marks or []):
                    kept.append(raw[at:lo])
                    at, removed, count = hi, removed + hi - lo, count + 1
                kept = b"".join([*kept, raw[at:]])
                out.append((doc, len(raw), removed, count, hashlib.sha256(kept).hexdigest(), kept if with_bytes else None))
            if out:
                yield arrow_batch(schema, list(zip(*out, strict=True)))

    return joined.mapInArrow(cut, KEPT).withColumnRenamed("doc_id", key)


def _merged(marks: list[dict]) -> list[list[int]]:
    out: list[list[int]] = []
    for lo, hi in sorted((m["lo"], m["lo"] + m["windows"] - 1 + LENGTH) for m in marks):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return out


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeats(docs, with_bytes=False).drop("kept")

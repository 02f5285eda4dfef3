"""Best-fit packing: every rule of the result, the plan against brute force and bounds."""

import random
import zlib
from itertools import permutations

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from duelwise.llm import bestfit

DOCS = "doc_id long, text string, length string, sequence_id string, piece string"


def brute(lengths, length):
    best = len(lengths)
    for order in set(permutations(lengths)):
        rooms = []
        for n in order:
            k = next((k for k, r in enumerate(rooms) if r >= n), None)
            if k is None:
                rooms.append(length - n)
            else:
                rooms[k] -= n
        best = min(best, len(rooms))
    return best


def checked(lengths, sequence, offset, length):
    held = {}
    for n, s, o in zip(lengths, sequence.tolist(), offset.tolist(), strict=True):
        held.setdefault(s, []).append((o, n))
    for parts in held.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= length
    return len(held)


@pytest.mark.parametrize("seed", range(40))
def test_few_pieces_against_all_orders(seed):
    r = random.Random(seed)
    lengths = [r.randint(1, 20) for _ in range(r.randint(1, 7))]
    assert checked(lengths, *bestfit.plan(lengths, 20, r.choice([2, 3, 64])), 20) <= brute(lengths, 20) + 1


@pytest.mark.parametrize("groups", [1, 8, 64])
def test_bound_and_first_fit(groups):
    rng = np.random.default_rng(3)
    for lengths in (rng.integers(1, 2049, 3000), np.minimum(2048, rng.lognormal(6, 1, 3000).astype(int) + 1), np.full(999, 700), np.repeat([1500, 548], 400)):
        lengths = lengths.tolist()
        least = max(-(-sum(lengths) // 2048), sum(n > 1024 for n in lengths))
        rooms = []
        for n in sorted(lengths, reverse=True):
            k = next((k for k, r in enumerate(rooms) if r >= n), None)
            if k is None:
                rooms.append(2048 - n)
            else:
                rooms[k] -= n
        got = checked(lengths, *bestfit.plan(lengths, 2048, groups), 2048)
        assert least <= got <= 1.005 * len(rooms) + 1


def test_rounding_is_up_within_groups_of_equal_cardinality():
    lengths = np.array([9, 1, 8, 2, 7, 3, 6, 4, 5, 5])
    sizes, which = bestfit.grouped(lengths, 5)
    assert (sizes[which] >= lengths).all()
    assert sizes.tolist() == [9, 7, 5, 4, 2]
    assert np.bincount(which).tolist() == [2, 2, 2, 2, 2]


def test_configurations_cover_the_demand():
    sizes, demand = np.array([1200, 900, 600, 400]), np.array([10.0, 20.0, 31.0, 7.0])
    patterns, often = bestfit.configurations(sizes, demand, 2048)
    assert np.allclose(patterns @ often, demand)
    assert (sizes @ patterns <= 2048).all()
    assert often.sum() <= 33  # 60,800 tokens need 29.7; 900s and 1200s can't all be filled


def test_pack(spark):
    r = random.Random(5)
    texts = [None, "", "a", " \n ", "é ü ß 日本", "one two three " * 4000, "x" * 9000] + [" ".join(r.choice(["alpha", "beta", "gamma7"]) for _ in range(r.randint(1, 900))) for _ in range(60)]
    rows = [(i, t, "1", "2", "3") for i, t in enumerate(texts)] + [(None, "a", "1", "2", "3"), (7, texts[7], "1", "2", "3"), (7, "other", "1", "2", "3")]
    path = public_tokenizers.path("byte_bpe_50k.json")
    got = [x.asDict() for x in bestfit.pack(spark.createDataFrame(rows, DOCS).repartition(3), path, group_docs=25).collect()]
    tokenizer = Tokenizer.from_file(path)
    want = {}
    for doc, t, *_ in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        cuts = [0, *range(len(ids) % 2048 or 2048, len(ids) + 1, 2048)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            x = (doc, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes()))
            want[x] = want.get(x, 0) + 1
    have = {}
    for x in got:
        y = (x["doc_id"], x["piece"], x["start"], x["length"], x["ids_crc32"])
        have[y] = have.get(y, 0) + 1
    assert have == want
    ids = np.array([x["sequence_id"] for x in got])
    checked([x["length"] for x in got], ids, np.array([x["offset"] for x in got]), 2048)


def test_pack_of_nothing(spark):
    assert bestfit.pack(spark.createDataFrame([], DOCS), public_tokenizers.path("byte_bpe_50k.json")).count() == 0

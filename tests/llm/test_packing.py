"""Packing against an item-by-item best-fit-decreasing, and whole sequences against the library."""

import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from retensa.llm import packing

from ..conftest import SF_SMALL

WORD = public_tokenizers.path("word_bpe_49k.json")


def best_fit(sizes, capacity):
    """How full the bins get, one item after the other, by a plain search (which of several
    bins with equal room takes an item changes neither their number nor how full they get)."""
    room = []
    for s in sorted(sizes, reverse=True):
        fits = [(r, i) for i, r in enumerate(room) if r >= s]
        i = min(fits)[1] if fits else len(room)
        if not fits:
            room.append(capacity)
        room[i] -= s
    return Counter(capacity - r for r in room)


@pytest.mark.parametrize("seed", range(25))
def test_plan_is_best_fit_decreasing(seed):
    rng = random.Random(seed)
    capacity = rng.choice([1, 7, 16, 100, 255, 256])
    kinds = [rng.randint(1, capacity) for _ in range(rng.randint(0, 30))]
    sizes = [rng.choice(kinds) for _ in range(rng.randint(0, 300))] if kinds else []
    counts = Counter(sizes)
    plan = packing.Plan(counts, capacity)
    size = np.array([s for s, n in counts.items() for _ in range(n)], np.int64)
    rank = np.array([r for n in counts.values() for r in range(n)], np.int64)
    sequence, offset = plan.find(size, rank)
    bins = {}
    for b, at, s in sorted(zip(sequence.tolist(), offset.tolist(), size.tolist())):
        own = bins.setdefault(b, [])
        assert at == sum(own) and at + s <= capacity
        own.append(s)
    assert sorted(bins) == list(range(plan.sequences))
    assert Counter(map(sum, bins.values())) == best_fit(sizes, capacity)


def test_plan_stays_small_for_any_number_of_pieces():
    plan = packing.Plan({s: 10 ** 12 + s for s in range(1, 2049)}, 2048)
    assert len(plan.size) < 50_000
    total = sum(s * (10 ** 12 + s) for s in range(1, 2049))
    assert total / 2048 <= plan.sequences < 1.001 * total / 2048
    with pytest.raises(ValueError):
        packing.Plan({9: 1}, 8)


def test_local_ranks():
    seen = np.zeros(6, np.int64)
    assert packing.local_ranks(np.array([5, 2, 5, 5, 0]), seen).tolist() == [0, 0, 1, 2, 0]
    assert packing.local_ranks(np.array([2, 5]), seen).tolist() == [1, 3]


def check(docs, rows, capacity, end_id=0):
    tokenizer = Tokenizer.from_file(WORD)
    packed = packing.pack(docs, WORD, end_id, capacity)
    got = packed.places.collect()
    expected, sizes = [], []
    for doc_id, text in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [end_id]
        for k in range(0, len(ids), capacity):
            own = ids[k:k + capacity]
            sizes.append(len(own))
            expected.append((doc_id, k // capacity, k, len(own),
                             zlib.crc32(np.array(own, "<u4").tobytes())))
    order = lambda r: (r[0] is not None, *(x or 0 for x in r))
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got),
                  key=order) == sorted(expected, key=order)
    bins = {}
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        own = bins.setdefault(r["sequence_id"], [])
        assert r["offset"] == sum(own)
        own.append(r["length"])
    assert Counter(map(sum, bins.values())) == best_fit(sizes, capacity)
    assert sorted(bins) == list(range(packed.n_sequences))
    return packed, got


def test_packing(spark, edge, edge_rows, none):
    small = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    check(small, [tuple(r) for r in small.select("doc_id", "text").collect()], 2048)
    packed, got = check(edge, edge_rows, 97, end_id=7)
    whole = packed.sequences().collect()
    assert len(whole) == packed.n_sequences
    pieces = {(r["sequence_id"], r["offset"]): r for r in got}
    for s in whole:
        ids = np.frombuffer(s["ids"], "<u2")
        assert len(ids) == s["length"]
        for at in s["documents"]:
            piece = pieces[s["sequence_id"], at["offset"]]
            own = ids[at["offset"]:at["offset"] + piece["length"]]
            assert zlib.crc32(own.astype("<u4").tobytes()) == piece["ids_crc32"]
            assert (piece["doc_id"], piece["piece"]) == (at["doc_id"], at["piece"])
    empty = packing.pack(none, WORD, 0)
    assert empty.places.count() == empty.sequences().count() == empty.n_sequences == 0
    with pytest.raises(ValueError):
        packing.pack(none, WORD, 0, 0)


def test_text_ids(spark):
    docs = spark.createDataFrame([("a", "x y"), ("b", None), (None, "z")], "doc_id string, text string")
    assert {r["doc_id"] for r in packing.pack(docs, WORD, 0, 4).places.collect()} == {"a", "b", None}

"""Packing: exact ids, nothing lost, bins full."""

import math
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from undercroft.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, length long, slice int"


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def check(rows, docs, tokenizer, capacity=1024):
    wanted = {}
    for d, text in docs:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        wanted.setdefault((d, len(ids)), []).append(ids)
    bins, pieces = {}, {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        pieces.setdefault(r["doc_id"], []).append((r["start"], r["length"], r["ids_crc32"], r["piece"]))
    for placed in bins.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= capacity
    for d in {d for d, _ in docs}:
        expected = []
        for ids in (i for (x, _), many in wanted.items() if x == d for i in many):
            first = min(len(ids), capacity, len(ids) % capacity or capacity)
            cuts = [0, *range(first, len(ids) + 1, capacity)]
            expected += [(a, b - a, zlib.crc32(ids[a:b].tobytes()), i) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))]
        assert sorted(pieces[d]) == sorted(expected)
    return len(bins)


def test_documents(spark, tokenizer):
    rnd = random.Random(4)
    words = "the of and naïve 漢字 <|endoftext|> don't  x9 \n ñandú".split(" ")
    docs = [(i, " ".join(rnd.choices(words, k=rnd.choice([0, 3, 50, 400, 1500])))) for i in range(80)]
    docs += [(80, None), (81, ""), (None, "no id"), (82, "twice"), (82, "twice"), (83, "long " * 5000), (84, "<|endoftext|>")]
    frame = spark.createDataFrame([(d, t, 1, 2) for d, t in docs], SCHEMA)
    rows = packing.pack_documents(frame, PATH).collect()
    n = check(rows, docs, tokenizer)
    assert n <= 1.02 * math.ceil(sum(r["length"] for r in rows) / 1024) + 1


def test_empty(spark):
    assert packing.pack_documents(spark.createDataFrame([], SCHEMA), PATH).count() == 0


@pytest.mark.parametrize("seed", range(5))
def test_plan_uses_every_piece_once(seed):
    rnd = random.Random(seed)
    counts = {rnd.randint(1, 100): rnd.randint(1, 50) for _ in range(40)}
    plan = packing.best_two_fit(counts, 100)
    used = {}
    for times, lengths in plan:
        assert times > 0 and sum(lengths) <= 100
        for n in lengths:
            used[n] = used.get(n, 0) + times
    assert used == counts


def piece_by_piece(pieces, capacity):
    """Bins one at a time from a list of pieces: the largest that fits until none does, then the smallest of the bin for
    the two that fill its gap best, if they fill it better."""
    left, bins = sorted(pieces, reverse=True), []
    while left:
        filled, gap = [], capacity
        for n in list(left):
            if n <= gap:
                filled.append(n)
                gap -= n
                left.remove(n)
        smallest = filled[-1]
        pairs = [(a + b, a, b) for i, a in enumerate(left) for b in left[i + 1:] if smallest < a + b <= gap + smallest]
        if pairs and gap:
            best = max(p[0] for p in pairs)
            # Of equally good pairs the one with the shortest piece.
            _, a, b = min((p for p in pairs if p[0] == best), key=lambda p: min(p[1], p[2]))
            filled = [*filled[:-1], a, b]
            left.remove(a)
            left.remove(b)
            left = sorted([*left, smallest], reverse=True)
        bins.append(sorted(filled))
    return bins


@pytest.mark.parametrize("seed", range(8))
def test_plan_equals_packing_piece_by_piece(seed):
    rnd = random.Random(seed)
    pieces = [rnd.choice([rnd.randint(1, 100), rnd.randint(20, 45), 33]) for _ in range(rnd.choice([1, 20, 150]))]
    counts = {n: pieces.count(n) for n in pieces}
    plan = packing.best_two_fit(counts, 100)
    got = sorted(sorted(lengths) for times, lengths in plan for _ in range(times))
    want = piece_by_piece(pieces, 100)
    assert len(got) == len(want)
    assert sorted(sum(b) for b in got) == sorted(sum(b) for b in want)


def test_two_fit_improves_a_greedy_bin():
    # Greedy puts 60 and 30 together; 60 with 20 and 20 fills the bin.
    plan = packing.best_two_fit({60: 1, 30: 1, 20: 2}, 100)
    assert sorted(plan[0][1]) == [20, 20, 60]


def test_ranking_in_slices(spark, monkeypatch):
    monkeypatch.setattr(packing, "RANK_ROWS", 3)
    pieces = spark.createDataFrame([(i, 0, 0, 300, i) for i in range(200)], "doc_id long, piece int, start long, length long, ids_crc32 long")
    rows = packing.pack(pieces).collect()
    assert len({(r["sequence_id"], r["offset"]) for r in rows}) == 200 and len({r["sequence_id"] for r in rows}) == 67

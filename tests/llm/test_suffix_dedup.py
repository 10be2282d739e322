"""Suffix sorting and repeat removal against looking at every window."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from undercroft.llm import suffix_dedup
from undercroft.llm.induced import DEPTH, suffix_order
from undercroft.llm.suffix_dedup import RepeatConfig, remove_repeats

SCHEMA = "doc_id long, text string, data string, runs int"


@pytest.mark.parametrize("seed", range(40))
def test_suffix_order(seed):
    rnd = random.Random(seed)
    n, symbols = rnd.choice([0, 1, 2, 7, 60, 700]), rnd.choice([1, 2, 3, 30])
    text = [rnd.randint(1, symbols) for _ in range(n)]
    if seed % 3 == 0:
        text = (text[:9] * n)[:n]
    text.append(0)
    order, common = suffix_order(np.array(text, np.uint16), symbols + 1, memory=rnd.choice([0, 300, 1 << 20]))
    assert sorted(order.tolist()) == list(range(len(text)))
    for a, b, c in zip(order[:-1].tolist(), order[1:].tolist(), common[1:].tolist()):
        assert text[a:a + DEPTH] <= text[b:b + DEPTH]
        same = next((i for i in range(DEPTH) if text[a + i:a + i + 1] != text[b + i:b + i + 1] or a + i >= len(text)), DEPTH)
        assert same == c


def brute(docs, length):
    data = [(d, (t or "").encode()) for d, t in docs]
    seen = Counter(b[i:i + length] for _, b in data for i in range(len(b) - length + 1))
    out = []
    for d, b in data:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i:i + length]] > 1:
                gone[i:i + length] = b"\1" * length
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out.append((d, len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def run(spark, docs, cfg):
    return sorted(map(tuple, remove_repeats(spark.createDataFrame([(d, t, "x", 1) for d, t in docs], SCHEMA), cfg).collect()), key=str)


def corpus(seed):
    rnd = random.Random(seed)
    letters = "abcdefghijklmnop é\n"
    fresh = lambda n: "".join(rnd.choice(letters) for _ in range(n))
    passages = [fresh(rnd.randint(150, 600)) for _ in range(6)]
    docs = []
    for i in range(60):
        parts = []
        for _ in range(rnd.randint(1, 4)):
            p = rnd.choice(passages)
            cut = sorted(rnd.sample(range(len(p)), 2))
            parts += [fresh(rnd.choice([0, 5, 100, 300])), rnd.choice([p, p[cut[0]:cut[1]], ""])]
        docs.append((i, "".join(parts)))
    return docs + [(60, docs[3][1]), (61, None), (62, ""), (63, "ab" * 700), (64, "short"), (64, "short"), (None, docs[5][1][7:])]


@pytest.mark.parametrize("seed", [1, 2])
def test_against_all_windows(spark, seed):
    cfg = RepeatConfig(bits=1 << 20)
    docs = corpus(seed)
    got = run(spark, docs, cfg)
    assert got == brute(docs, cfg.length) and sum(r[2] for r in got) > 1000


def test_hot_anchors_and_full_tables(spark):
    # Every anchor with two slices is hot, and a tiny table lets all grams through: same result.
    docs = corpus(3)
    assert run(spark, docs, RepeatConfig(bits=1 << 15, hot=1, hot_share=1 << 40)) == brute(docs, 200)
    assert run(spark, docs, RepeatConfig(bits=1 << 15, sort_bytes=1, memory=0)) == brute(docs, 200)


def test_blocks_of_long_texts(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "_BLOCK", 1 << 10)
    docs = corpus(4) + [(99, "".join(t or "" for _, t in corpus(4)))]
    for n in (0, 199, 200, 1023, 1024, 5000):
        blocks = list(suffix_dedup._blocks(bytes(n), RepeatConfig()))
        starts = [at + i for at, b in blocks for i in range(len(b) - 199)]
        assert starts == list(range(max(0, n - 199)))
    assert len(docs) > 60


def test_empty(spark):
    assert run(spark, [], RepeatConfig(bits=1 << 15)) == []

"""Buckets by payload composition against the CRC of the spelled-out words; draws against a plain sort."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from undercroft.llm import resampling
from undercroft.llm.resampling import ResampleConfig, WordDictionary

DOCS = "doc_id long, text string, score int, word string, part int, able string"
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return _WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def runs(text, buckets, longest=3):
    w = words_of(text)
    return [zlib.crc32(" ".join(w[i:i + n]).encode()) % buckets for n in range(1, longest + 1) for i in range(len(w) - n + 1)]


def brute(docs, target, cfg):
    s, t = [0] * cfg.buckets, [0] * cfg.buckets
    for counts, texts in ((s, [x for _, x in docs]), (t, target)):
        for text in texts:
            for b in runs(text, cfg.buckets, cfg.words):
                counts[b] += 1
    n, m = sum(s), sum(t)
    gain = [math.floor(1000 * math.log((b + 1) * (n + cfg.buckets) / ((a + 1) * (m + cfg.buckets)))) for a, b in zip(s, t)]
    rows = []
    for i, text in docs:
        feats = runs(text, cfg.buckets, cfg.words)
        h = int(hashlib.sha256(f"{cfg.seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in feats)
        rows.append((i, len(words_of(text)), len(feats), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in rows if r[1] >= cfg.least_words), key=lambda r: (-r[4], r[0] is None, r[0]))
    drawn = [r[:1] + r[2:] + (k + 1,) for k, r in enumerate(able[:cfg.percent * len(able) // 100])]
    left = able[len(drawn):] + [r for r in rows if r[1] < cfg.least_words]
    return sorted([*drawn, *(r[:1] + r[2:] + (None,) for r in left)], key=str)


def texts(seed, n):
    rnd = random.Random(seed)
    vocabulary = ["the", "of", "Äpfel", "naïve", "x", "42", "日本語", "𝔘ni", "É", "don't", "a-b", "ſ", "long" * 30]
    out = []
    for i in range(n):
        size = rnd.choice([0, 1, 2, 3, 19, 20, 21, 60])
        words = [rnd.choice(vocabulary) if rnd.random() < 0.7 else f"w{rnd.randrange(300)}" for _ in range(size)]
        out.append((i, rnd.choice([" ", "  ", "\n", " -- ", "\x00"]).join(words)))
    return out


@pytest.mark.parametrize("seed, dictionary, percent", [(1, 65_536, 5), (2, 5, 50), (3, 0, 100)])
def test_resample(spark, seed, dictionary, percent):
    cfg = ResampleConfig(buckets=97, dictionary=dictionary, percent=percent)
    docs = texts(seed, 150) + [(900, None), (901, ""), (902, " .,! "), (None, "some words " * 30), (5, texts(seed, 150)[5][1])]
    docs += [(1000 + i, docs[140][1]) for i in range(60)]
    target = ["the naïve Äpfel of 42", None, "", "the of x"]
    frame = spark.createDataFrame([(i, x, 1, "w", 0, "a") for i, x in docs], DOCS)
    aim = spark.createDataFrame([(i, x) for i, x in enumerate(target)], "item_id long, text string")
    got = sorted(map(tuple, resampling.resample(frame, aim, cfg).collect()), key=str)
    assert got == brute(docs, target, cfg)


def test_empty_tables(spark):
    none = spark.createDataFrame([], DOCS)
    aim = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert resampling.resample(none, aim).count() == 0
    docs = [(i, "one two three four five " * 5) for i in range(40)]
    frame = spark.createDataFrame([(i, x, 1, "", 0, "") for i, x in docs], DOCS)
    got = sorted(map(tuple, resampling.resample(frame, aim.limit(0)).collect()), key=str)
    assert got == brute(docs, [], ResampleConfig())
    assert sum(r[4] is not None for r in got) == 2


def test_long_texts_go_on_behind_their_last_words(monkeypatch):
    monkeypatch.setattr(resampling, "SLICE", 7)
    monkeypatch.setattr(resampling, "STRETCH", 30)
    rnd = random.Random(3)
    data = [" ".join(rnd.choice(["a", "bb", "ccc", "é", "zzz", "w" * 200]) for _ in range(n)) for n in (0, 1, 50, 6, 7, 8, 23)]
    for entries in ([], [b"a", b"ccc"], [b"a", b"bb", b"ccc", "é".encode(), b"zzz", b"w" * 200]):
        found = np.zeros(1000, int)
        for crc, spaced, size, text, own in resampling._slices(pa.array(data), WordDictionary(entries), 3):
            assert len(crc) <= 9
            for last, run in resampling.compose(crc, spaced, size, text, 3):
                found += np.bincount(run[own[last]] % 1000, minlength=1000)
        want = np.bincount([b for t in data for b in runs(t, 1000)], minlength=1000)
        assert (found == want).all()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aB9é日 -\n", max_size=40), max_size=6), st.sets(st.sampled_from(["a", "b9", "é", "日", "ab"])))
def test_scan_emits_every_word_in_order(data, entries):
    words = WordDictionary(sorted(w.encode() for w in entries))
    for text in data:
        got = [c for part in words.scan(resampling.normal(text)) for c in zip(*(x.tolist() for x in part[:3]))]
        want = [w.encode() for w in words_of(text)]
        assert got == [(zlib.crc32(w), zlib.crc32(b" " + w), len(w)) for w in want]
        ends = [e for part in words.scan(resampling.normal(text)) for e in part[3].tolist()]
        assert ends == [sum(len(w) + 1 for w in want[:i + 1]) for i in range(len(want))]


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=300), st.binary(max_size=300))
def test_push_composes(a, b):
    out = resampling.push(np.array([zlib.crc32(a)], np.uint32), np.array([len(b)], np.int64))
    assert int(out[0]) ^ zlib.crc32(b) == zlib.crc32(a + b)


def test_dictionary_holds_the_most_frequent_words(spark):
    docs = spark.createDataFrame([(i, "common " * 9 + f"rare{i} mid{i % 3}") for i in range(60)], "doc_id long, text string")
    assert resampling.frequent_words(docs, 4) == [b"common", b"mid0", b"mid1", b"mid2"]
    assert resampling.frequent_words(docs, 3) == [b"common"]
    assert resampling.frequent_words(docs, 0) == []
    assert len(resampling.frequent_words(docs, 1000)) == 64

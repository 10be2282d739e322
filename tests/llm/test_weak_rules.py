"""Base measures against plain Python; estimation against a generative sample and a plain rewrite; labels as a check."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from undercroft.llm import weak_rules
from undercroft.llm.weak_rules import QualityConfig, Rule

DOCS = "doc_id long, text string, votes string, quality int, n_words string"
BASE = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    counts = Counter(windows)
    repeated = {j for i, w in enumerate(windows) if counts[w] > 1 for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)),
            len(repeated), len(words) < 10 or 100 * len(repeated) > 20 * len(words))


def texts(seed):
    rnd = random.Random(seed)
    out = [None, "", " \n\t ", "one", "a b c d e a b c d e", "x " * 300, "line\nline\r\nline\n\n \nline", "日本語 テキスト x y",
           "\x1c\x1d a \x85 b", "# * $ % & | < > <>", "w" * 5000, "é" * 40 + " " + "ß.", "a b c d e f a b c d e"]
    for _ in range(120):
        vocabulary = [f"w{i}" for i in range(rnd.choice([2, 5, 40, 400]))] + ["#1", "a|b", "É!", "ok."]
        words = [rnd.choice(vocabulary) for _ in range(rnd.choice([3, 9, 10, 11, 40, 200]))]
        out.append("".join(w + rnd.choice([" ", " ", " ", "\n", "\t", "  ", "\x0b"]) for w in words))
    return out + out[20:24]


@pytest.mark.parametrize("seed", [1, 2])
def test_base_measures(spark, seed):
    rows = list(enumerate(texts(seed))) + [(None, "no id"), (3, "one")]
    frame = spark.createDataFrame([(i, t, "+", 1, "x") for i, t in rows], DOCS)
    judged = weak_rules.judge(frame)
    got = sorted((tuple(r) for r in judged.select(*BASE).collect()), key=str)
    assert got == sorted(((i, *brute(t)) for i, t in rows), key=str)
    assert judged.where("kept and base_failed").count() == 0
    assert judged.where("kept is null or quality is null").count() == 0


def test_empty_table_and_filter(spark):
    assert weak_rules.judge(spark.createDataFrame([], DOCS)).count() == 0
    prose = ["The quick fox number %d sees a lazy dog near some house of stone. It then goes home to rest, as foxes do. "
             "Nobody knows why animal %d would walk so far, but there it went again in the rain, over hills and valleys." % (i, i) for i in range(60)]
    junk = ["%%% $$$ " * 40 + str(i) for i in range(4)]
    frame = spark.createDataFrame([(i, t, None, i, "") for i, t in enumerate(prose + junk + [prose[0]])], DOCS)
    kept = weak_rules.filter_quality(frame)
    assert kept.columns == frame.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [*range(60), 64]


def test_rules_vote_or_abstain(spark):
    rules = (Rule("both", lambda: weak_rules.F.lit(True), lambda: weak_rules.F.lit(True)),
             Rule("none", lambda: weak_rules.F.lit(False), lambda: weak_rules.F.lit(False)),
             Rule("long", lambda: weak_rules.F.col("n_words") > 2, lambda: weak_rules.F.lit(None).cast("boolean")))
    frame = spark.createDataFrame([(1, "a b c", "", 0, ""), (2, "a", "", 0, "")], DOCS)
    got = {r["doc_id"]: r["votes"] for r in weak_rules.votes(weak_rules.measure(frame), rules).collect()}
    assert got == {1: "-0+", 2: "-00"}


def plain_estimate(pattern, counts, cfg):
    """The same rounds, votes one by one."""
    n = len(pattern[0])
    start = [[cfg.for_good] * n] + [[cfg.for_seen if r == k else cfg.for_unseen for r in range(n)] for k in range(n)]
    prior = [cfg.prior] + [(1 - cfg.prior) / n] * n
    plus = [[max(x, 1 - cfg.wrong) for x in start[0]], *map(list, start[1:])]
    share = list(prior)

    def kinds(p):
        odds = []
        for k in range(n + 1):
            x = share[k]
            for r, v in enumerate(p):
                x *= plus[k][r] if v > 0 else 1 - plus[k][r] if v < 0 else 1
            odds.append(x)
        return [x / sum(odds) for x in odds]
    for _ in range(cfg.rounds):
        found = [kinds(p) for p in pattern]
        before = [list(share), [list(x) for x in plus]]
        for k in range(n + 1):
            share[k] = (sum(c * f[k] for c, f in zip(counts, found)) + cfg.weight * prior[k]) / (sum(counts) + cfg.weight)
            for r in range(n):
                up = sum(c * f[k] for c, f, p in zip(counts, found, pattern) if p[r] > 0)
                down = sum(c * f[k] for c, f, p in zip(counts, found, pattern) if p[r] < 0)
                plus[k][r] = (up + cfg.weight * start[k][r]) / (up + down + cfg.weight)
        plus[0] = [max(x, 1 - cfg.wrong) for x in plus[0]]
        moved = max(max(abs(a - b) for a, b in zip(share, before[0])),
                    max(abs(a - b) for x, y in zip(plus, before[1]) for a, b in zip(x, y)))
        if moved < cfg.settled:
            break
    return [kinds(p)[0] for p in pattern]


def sample(n, seed=5):
    """Votes of four rules about texts that are good or bad in the way of one rule."""
    rnd = random.Random(seed)
    rows = []
    for _ in range(n):
        kind = 0 if rnd.random() < 0.85 else rnd.randrange(1, 4)
        row = []
        for r in range(4):
            chance = 0.995 if kind == 0 else 0.05 if kind == r + 1 else 0.9
            row.append(0 if rnd.random() < 0.2 else 1 if rnd.random() < chance else -1)
        rows.append((tuple(row), kind))
    return rows


def test_estimate_equals_plain_rounds():
    counts = Counter(p for p, _ in sample(500))
    pattern = sorted(counts)
    cfg = QualityConfig(rounds=25)
    n = np.array([counts[p] for p in pattern], float)
    got = weak_rules.estimate(np.array(pattern), n, cfg).kinds(np.array(pattern))[:, 0]
    assert np.allclose(got, plain_estimate(pattern, n.tolist(), cfg), atol=1e-9)


def test_estimate_finds_what_made_the_votes():
    rows = sample(20_000)
    counts = Counter(p for p, _ in rows)
    pattern = np.array(sorted(counts))
    worth = weak_rules.estimate(pattern, np.array([counts[tuple(p)] for p in pattern], float), QualityConfig())
    assert abs(worth.share[0] - 0.85) < 0.03
    assert (worth.plus[0] >= 0.98).all()
    assert max(worth.plus[k + 1][k] for k in range(3)) < 0.15
    posterior = dict(zip(map(tuple, pattern.tolist()), worth.kinds(pattern)[:, 0]))
    right = sum((posterior[p] >= 0.5) == (kind == 0) for p, kind in rows) / len(rows)
    assert right > 0.93


def test_posterior_agrees_with_labels(spark):
    """Labels are never read by the rules; of the texts that pass the base, the kept ones are those marked good."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    judged = weak_rules.judge(docs).where("not base_failed").drop("quality").join(labels, "doc_id")
    kept = {(r["quality"], r["kept"]): r["count"] for r in judged.groupBy("quality", "kept").count().collect()}
    good, bad = (kept.get((q, True), 0) / sum(n for (x, _), n in kept.items() if x == q) for q in (1, 0))
    assert good > 0.98 and bad < 0.05

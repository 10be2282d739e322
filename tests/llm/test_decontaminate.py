"""Decontamination against scoring every passage with every item."""

import math
import random
from collections import Counter

from undercroft.llm import decontaminate as dc

DOCS = "doc_id long, text string, item_id string"
CFG = dc.LeakConfig(passage=24, stride=12, block=2, threshold=0.4)


def brute(docs, items, cfg):
    items = sorted({(i, t) for i, t in items if t is not None}, key=str)
    entries = [(i, t, p) for i, t in items for p in dc.item_parts(t, cfg)]
    mean = sum(len(p) for _, _, p in entries) / max(1, len(entries))
    df = Counter(w for _, _, p in entries for w in set(p))
    out = {}
    for d, text in docs:
        words = dc.words_of(text or "")
        for start in range(0, max(1, len(words) - cfg.stride), cfg.stride) if words else ():
            passage = set(words[start:start + cfg.passage])
            for i, t, part in entries:
                weight = {}
                for w, n in Counter(part).items():
                    idf = math.log(1 + (len(entries) - df[w] + 0.5) / (df[w] + 0.5))
                    weight[w] = idf * n * (cfg.k1 + 1) / (n + cfg.k1 * (1 - cfg.b + cfg.b * len(part) / mean))
                score = sum(v for w, v in weight.items() if w in passage) / sum(weight.values())
                if score < cfg.threshold - 1e-9:
                    continue
                q, a = dc.question_answer(t)
                region = words[max(0, start - len(q) - len(a)):start + cfg.passage + len(q) + len(a)]
                shares = [dc.found_share(dc.shingle_set(x, cfg.shingle), region) for x in (q, a)]
                if min(shares) >= cfg.overlap:
                    out[d, i] = max(out.get((d, i), (0, 0)), (round(score, 6), -start))
    return {(*k, s, -b) for k, (s, b) in out.items()}


def corpus(seed):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(120)]
    sentence = lambda n: " ".join(rnd.choices(words, [1 / (i + 1) for i in range(120)], k=n))
    items = [(i, ". ".join(sentence(rnd.randint(1, 14)) for _ in range(rnd.randint(1, 3))) + ".") for i in range(25)]
    docs = []
    for d in range(60):
        text = sentence(rnd.randint(0, 80))
        if rnd.random() < 0.5:
            leak = rnd.choice(items)[1].split(" ")
            if rnd.random() < 0.4:
                leak[rnd.randrange(len(leak))] = "zz"
            text = f"{text} {' '.join(leak)} {sentence(rnd.randint(0, 30))}".upper()
        docs.append((d, text))
    return docs, items


def run(spark, docs, items, cfg=CFG):
    frame = spark.createDataFrame([(d, t, "x") for d, t in docs], DOCS)
    tests = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, doc_id int")
    got = dc.find_leaks(frame, tests, cfg).collect()
    return {(r["doc_id"], r["item_id"], round(r["score"], 6), r["word"]) for r in got}


def test_against_all_pairs(spark):
    docs, items = corpus(11)
    got = run(spark, docs, items)
    assert got == brute(docs, items, CFG) and len(got) > 15


def test_several_passes(spark):
    docs, items = corpus(12)
    split = dc.LeakConfig(passage=24, stride=12, block=2, threshold=0.4, index_bytes=300)
    assert run(spark, docs, items, split) == brute(docs, items, split)


def test_edges(spark):
    items = [(1, "what is the name of the longest river there. the nile"), (1, "what is the name of the longest river there. the nile"),
             (2, None), (3, ""), (None, "which animals have black and white stripes all over. zebras do")]
    docs = [(1, None), (2, ""), (None, "x " * 200 + items[0][1]), (4, "Which animals have black and white stripes all over? Zebras do"),
            (4, "Which animals have black and white stripes all over? Zebras do"), (5, "the the the")]
    got = run(spark, docs, items)
    assert {g[:2] for g in got} == {(None, 1), (4, None)} and got == brute(docs, items, CFG)
    assert not run(spark, [], items) and not run(spark, docs, [])


def test_long_item_in_parts(spark):
    item = " ".join(f"q{i}" for i in range(60)) + ". the answer is here"
    assert {g[:2] for g in run(spark, [(1, "pad " * 7 + item + " pad" * 9), (2, item[:80])], [(9, item)])} == {(1, 9)}

"""Fuzzy line dedup against a brute force in Python."""

import itertools
import random
import re

import xxhash

from undercroft.llm import line_dedup
from undercroft.llm.line_dedup import LineConfig, dedup_lines

SCHEMA = "doc_id long, text string, lines string"


def normal(line):
    return re.sub(r"[^\w]+|_+", " ", line.lower()).strip()


def simhash(words):
    hashes = [xxhash.xxh64_intdigest(w.encode(), seed=42) for w in words]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) > len(words) // 2)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def brute(docs, cfg):
    seen = {}
    for key in sorted({(2 ** 63 if d is None else d, t or "") for d, t in docs}):
        for i, line in enumerate(key[1].split("\n")):
            if normal(line):
                seen.setdefault(normal(line), []).append((key, i))
    root = {n: n for n in seen}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    blocks = {n: [simhash(set(n.split(" "))) >> 16 * k & 0xFFFF for k in range(4)] for n in seen}
    for a, b in itertools.combinations(sorted(seen), 2):
        alike = sum(x == y for x, y in zip(blocks[a], blocks[b]))
        longest = max(len(a), len(b))
        if alike >= 2 and distance(a, b) <= int(longest * (1 - cfg.similarity) + 1e-9):
            root[find(b)] = find(a)
    groups = {}
    for n, places in seen.items():
        groups.setdefault(find(n), []).extend(places)
    gone = {p for places in groups.values() for p in places} - {min(places) for places in groups.values()}
    out = []
    for d, t in docs:
        key = (2 ** 63 if d is None else d, t or "")
        lines = key[1].split("\n")
        keep = [x for i, x in enumerate(lines) if (key, i) not in gone]
        out.append((d, None if t is None else "\n".join(keep), len(lines) - len(keep)))
    return sorted(out, key=str)


def corpus(seed):
    rnd = random.Random(seed)
    words = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 7))) for _ in range(60)]
    base = [" ".join(rnd.choice(words) for _ in range(rnd.randint(3, 40))) for _ in range(40)]
    docs = []
    for i in range(60):
        lines = []
        for _ in range(rnd.randint(0, 6)):
            line = rnd.choice(base)
            if rnd.random() < 0.6:
                parts = line.split(" ")
                parts[rnd.randrange(len(parts))] += rnd.choice(["", "x", "."])
                line = " ".join(parts)
            lines.append(rnd.choice([line, line.upper(), line + "!!", " " + line]))
        docs.append((i, "\n".join(lines)))
    return docs


def check(spark, docs, cfg=LineConfig()):
    frame = spark.createDataFrame([(d, t, "own") for d, t in docs], SCHEMA)
    got = dedup_lines(frame, cfg)
    assert got.columns[:3] == ["doc_id", "text", "lines"]
    rows = sorted(((r["doc_id"], r["text"], r["n_removed"]) for r in got.collect()), key=str)
    assert rows == brute(docs, cfg)
    return rows


def test_random_corpus(spark):
    docs = corpus(5)
    rows = check(spark, docs)
    assert sum(r[2] for r in rows) > 20


def test_edges(spark):
    line = "one two three four five six seven eight nine ten"
    docs = [(None, line), (None, line), (3, None), (4, ""), (5, "\n\n--\n"), (6, line + "\n" + line), (16, line), (7, "--\n" + line),
            (8, "w " * 5000 + "end"), (9, "w " * 5000 + "end.")]
    rows = check(spark, docs)
    assert {r[1] for r in rows if r[0] in (8, 9)} == {"", "w " * 5000 + "end"}


def test_empty(spark):
    assert dedup_lines(spark.createDataFrame([], SCHEMA)).count() == 0


def test_long_lines_count_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "_CHUNK", 7)
    a = " ".join(f"w{i}" for i in range(100))
    docs = [(1, a), (2, a.replace("w50", "w5")), (3, "z")]
    got = {r["doc_id"]: r["n_removed"] for r in dedup_lines(spark.createDataFrame([(d, t, "") for d, t in docs], SCHEMA)).collect()}
    assert got[1] == 0 and got[3] == 0


def test_plan_is_native(spark):
    frame = spark.createDataFrame([(1, "a b\na b", "")], SCHEMA)
    plan = dedup_lines(frame)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


def test_rows_that_share_an_id(spark):
    line = "one two three four five six seven eight nine ten"
    frame = spark.createDataFrame([(1, line, ""), (1, line + "\n" + line, "")], SCHEMA)
    kept = "\n".join(r["text"] for r in dedup_lines(frame).collect())
    assert [x for x in kept.split("\n") if x] == [line]


def test_texts_are_normalised_once(spark):
    frame = spark.createDataFrame([(1, "a b\na b", "")], SCHEMA)
    plan = line_dedup._normal_lines(frame)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") == 1


def test_pieces_settle_no_pair_wrongly(spark):
    rnd = random.Random(8)
    texts = []
    for n in (100, 300, 1500):
        base = "".join(rnd.choice("abcd ") for _ in range(n))
        texts += [base, "x" * int(0.1 * n) + base, "y" * int(0.19 * n) + base, "z" * int(0.3 * n) + base,
                  "".join("\u00e4" if rnd.random() < 0.25 else c for c in base)]
    rows = spark.createDataFrame(list(enumerate(texts)), "line_id long, normal string")
    pairs = [(a, b) for k in range(0, 15, 5) for a, b in itertools.combinations(range(k, k + 5), 2)]
    got = line_dedup._close(spark.createDataFrame(pairs, "a long, b long"), rows, LineConfig()).collect()
    want = {(a, b) for a, b in pairs if distance(texts[a], texts[b]) <= int(max(len(texts[a]), len(texts[b])) * 0.2 + 1e-9)}
    assert {tuple(r) for r in got} == want and 0 < len(want) < len(pairs)

"""The Jaccard join against comparing all pairs."""

import random
import re
import tracemalloc

import numpy as np
import pytest

from undercroft.llm import jaccard
from undercroft.llm.jaccard import JaccardConfig, Repeats, component_ids, keep_one

SCHEMA = "doc_id long, text string, cls string, n int"
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sets_of(docs, words):
    out = []
    for _, text in docs:
        found = [w for w in "".join("\n" if c in " \t\n\x0b\x0c\r" else c for c in (text or "").translate(FOLD)).split("\n") if w]
        size = min(words, len(found))
        out.append({tuple(found[i:i + size]) for i in range(len(found) - size + 1)} if found else set())
    return out


def brute(docs, cfg):
    sets = sets_of(docs, cfg.words)
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if sets[i] and sets[j] and cfg.den * len(sets[i] & sets[j]) >= cfg.num * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    lowest = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            lowest[find(i)] = min(lowest.get(find(i), d), d)
    return sorted(((d, len(sets[i]), d if not sets[i] else lowest.get(find(i), d)) for i, (d, _) in enumerate(docs)), key=str)


def frame(spark, docs):
    return spark.createDataFrame([(d, t, "x", 0) for d, t in docs], SCHEMA)


def run(spark, docs, cfg=JaccardConfig()):
    return sorted(map(tuple, component_ids(frame(spark, docs), cfg).collect()), key=str)


def corpus(seed, groups, copies, edits):
    rnd = random.Random(seed)
    word = lambda: "w" + str(int(rnd.paretovariate(0.6)) % 4000)
    boiler = " ".join(word() for _ in range(12))
    docs = []
    for _ in range(groups):
        base = [word() for _ in range(rnd.randint(1, 120))]
        for _ in range(rnd.randint(1, copies)):
            text = list(base)
            for _ in range(rnd.randint(0, edits)):
                text[rnd.randrange(len(text))] = word()
            if rnd.random() < 0.3:
                text = text[rnd.randint(0, 3):] + boiler.split()
            docs.append(" ".join(text))
    rnd.shuffle(docs)
    return list(enumerate(docs))


@pytest.mark.parametrize("seed, cfg", [(1, JaccardConfig()), (2, JaccardConfig(words=5, num=80)), (3, JaccardConfig(words=2, num=50))])
def test_all_pairs(spark, seed, cfg):
    docs = corpus(seed, 40, 6, 5)
    got = run(spark, docs, cfg)
    assert got == brute(docs, cfg) and len({c for _, _, c in got}) < len(docs)


def test_large_group_of_changed_copies(spark):
    docs = corpus(7, 2, 150, 9)
    assert run(spark, docs) == brute(docs, JaccardConfig())


def chains(seeds):
    """A group of near copies of copies for every seed, each with words of its own: (documents, expected rows)."""
    docs, want = [], []
    for seed in seeds:
        rnd = random.Random(seed)
        fresh = iter(range(1 << 30))
        word = lambda: f"g{seed}x{next(fresh)}"
        sets = [[word() for _ in range(rnd.randint(30, 90))]]
        for _ in range(rnd.randint(4, 12)):
            copy = list(rnd.choice(sets))
            for i in rnd.sample(range(len(copy)), int(len(copy) * rnd.uniform(0.01, 0.13))):
                copy[i] = word()
            sets.append(copy)
        group = [(len(docs) + i, " ".join(s)) for i, s in enumerate(sets)]
        docs += group
        want += brute(group, JaccardConfig(words=1))
    return docs, sorted(want, key=str)


def test_chains_of_copies_of_copies(spark):
    docs, want = chains(range(600))
    assert run(spark, docs, JaccardConfig(words=1)) == want


def test_followers_of_unlinked_leaders_do_not_all_meet(spark, monkeypatch):
    """Two texts too far apart to link, each with 60 shorter copies: pairs of copies do not grow with the product."""
    rnd = random.Random(11)
    one = [f"w{i}" for i in range(200)]
    other = [f"v{i}" if i < 18 else w for i, w in enumerate(one)]
    shorter = lambda t: [t[i] for i in sorted(rnd.sample(range(200), 196))]
    docs = [(i, " ".join(t)) for i, t in enumerate([one, other, *[shorter(t) for t in (one, other) for _ in range(60)]])]
    opened, stage = [], jaccard.stage

    def counted(df, tag):
        made = stage(df, tag)
        opened.extend([made.count()] if tag == "jaccard-third" else [])
        return made
    monkeypatch.setattr(jaccard, "stage", counted)
    cfg = JaccardConfig(words=1)
    got = run(spark, docs, cfg)
    assert got == brute(docs, cfg) and {c for _, _, c in got} == {0, 1}
    assert opened[0] <= len(docs)


def joined_rows(plan):
    """Output rows of all joins of an executed plan."""
    inner = [getattr(plan, f)() for f in ("executedPlan", "plan") if type(plan).__name__ == "JavaObject" and f in dir(plan)]
    below = plan.children()
    rows = [n for p in (*inner, *(below.apply(i) for i in range(below.size()))) for n in joined_rows(p)]
    return rows + ([plan.metrics().apply("numOutputRows").value()] if "Join" in plan.nodeName() else [])


def test_copies_that_do_not_link_do_not_all_meet(spark, monkeypatch):
    """Copies of a text with 25 of 200 words changed: too far from the text and each other to link, and so to be paired."""
    rnd = random.Random(3)
    base = [f"w{i}" for i in range(200)]
    docs = [(0, " ".join(base))]
    for i in range(1, 150):
        changed = set(rnd.sample(range(200), 25))
        docs.append((i, " ".join(f"c{i}x{k}" if k in changed else w for k, w in enumerate(base))))
    made, stage = [], jaccard.stage

    def counted(df, tag):
        if tag == "jaccard-pairs":
            df.collect()
            made.extend(joined_rows(df._jdf.queryExecution().executedPlan()))
        return stage(df, tag)
    monkeypatch.setattr(jaccard, "stage", counted)
    cfg = JaccardConfig(words=1)
    got = run(spark, docs, cfg)
    assert got == brute(docs, cfg) and len({c for _, _, c in got}) == len(docs)
    # A join without rows is dropped from the plan while it runs.
    assert max(made, default=0) <= len(docs)


def method_sizes(df):
    """Bytes of the largest method in each piece of generated code of a finished plan."""
    text = df.sparkSession._jvm.org.apache.spark.sql.api.python.PythonSQLUtils.explainString(df._jdf.queryExecution(), "codegen")
    return [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", text)]


def test_followers_do_not_meet_by_whole_rows(spark, monkeypatch):
    """The code generated for pairs of followers stays small; one method with both sides as keys takes long to compile."""
    rnd = random.Random(11)
    one = [f"w{i}" for i in range(200)]
    other = [f"v{i}" if i < 18 else w for i, w in enumerate(one)]

    def copy(text):  # without three of the words that part the two texts, and without up to three others
        gone = {*rnd.sample(range(18), 3), *rnd.sample(range(18, 200), rnd.randint(0, 3))}
        return [w for i, w in enumerate(text) if i not in gone]
    docs = [(i, " ".join(t)) for i, t in enumerate([one, other, *[copy(t) for t in (one, other) for _ in range(40)]])]
    sizes, rows, stage = {}, {}, jaccard.stage

    def measured(df, tag):
        if tag in ("jaccard-found", "jaccard-third"):
            rows[tag] = len(df.collect())
            sizes[tag] = method_sizes(df)
        return stage(df, tag)
    monkeypatch.setattr(jaccard, "stage", measured)
    cfg = JaccardConfig(words=1)
    assert run(spark, docs, cfg) == brute(docs, cfg)
    assert rows["jaccard-third"] > 0 and 0 < max(n for found in sizes.values() for n in found) < 2000


def test_shingles_seen_once_are_not_held():
    """A task over shingles that hardly repeat holds a bit for each, and counts those that come again."""
    rnd = np.random.default_rng(1)
    often = rnd.integers(0, 2 ** 64, 1000, dtype=np.uint64)
    tracemalloc.start()
    repeats = Repeats(4_000_000)
    for i in range(2000):
        repeats.add(np.unique(np.concatenate([rnd.integers(0, 2 ** 64, 1500, dtype=np.uint64), often[:i // 2 + 1]])))
    keys, counts = repeats.counts()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert repeats.total == 2000 * 1500 + sum(i // 2 + 1 for i in range(2000)) and peak < 80_000_000
    found = dict(zip(keys.tolist(), counts.tolist()))
    got = np.array([found[k] for k in often.tolist()])
    want = 2000 - 2 * np.arange(1000)
    # A bit that another shingle has set counts once too many; few do.
    assert ((got == want) | (got == want + 1)).all() and (got == want).mean() > 0.9
    assert len(keys) < 1000 + 0.05 * 2000 * 1500 and (keys[1:] > keys[:-1]).all()


def test_many_repeats_keep_the_frequent():
    rnd = np.random.default_rng(2)
    values = np.sort(rnd.integers(0, 2 ** 64, 1000, dtype=np.uint64))
    often = values[::200]
    repeats = Repeats(10)
    for _ in range(12_000):
        repeats.add(np.union1d(often, rnd.choice(values, 100)))
    keys, counts = repeats.counts()
    assert len(keys) <= 40
    assert [n in (12_000, 12_001) for n in counts[np.isin(keys, often)]] == [True] * 5


def test_edges(spark):
    docs = [(1, None), (2, ""), (3, " \t\n"), (4, "One TWO"), (5, "one two"), (5, "one two"), (None, "one  two"), (None, "alone here"),
            (6, "É è"), (7, "é è"), (8, "a b c d"), (9, "a b c d e"), (10, "w " * 6000), (11, "w w w w")]
    got = run(spark, docs)
    assert got == brute(docs, JaccardConfig())
    assert (4, 1, 4) in got and (None, 1, 4) in got and (6, 1, 6) in got and (7, 1, 7) in got and (11, 1, 10) in got


def test_empty(spark):
    assert run(spark, []) == []


def test_keep_one(spark):
    docs = [(3, "a b c d e f g"), (2, "A b c d e f g"), (2, "A b c d e f g"), (9, ""), (None, "a b c d e f g"), (5, "z y x w v u")]
    kept = keep_one(frame(spark, docs), JaccardConfig(words=5, num=80))
    assert kept.columns == ["doc_id", "text", "cls", "n"]
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect())) == [(2, "A b c d e f g"), (5, "z y x w v u"), (9, "")]


def test_shingle_hashes_tell_sequences_apart():
    powers = jaccard.Powers()
    seen = {}
    rnd = random.Random(0)
    for _ in range(5000):
        text = " ".join(rnd.choice("abcde") * rnd.randint(1, 3) for _ in range(3)).encode()
        seen.setdefault(tuple(jaccard.shingles(text, 3, powers)), set()).add(text)
    assert all(len(v) == 1 for v in seen.values())
    assert np.array_equal(jaccard.shingles("x  Ab\tc d".encode(), 4, powers), jaccard.shingles(b"X aB c D ", 4, powers))


def test_bitmaps_bound_overlaps():
    rnd = np.random.default_rng(5)
    for n, m, common in [(300, 300, 255), (300, 260, 250), (1, 1, 1), (40, 900, 40), (5, 5, 0), (2000, 2100, 1990)]:
        both = np.unique(rnd.integers(0, 2 ** 64, n + m - common, dtype=np.uint64))
        a, b = both[:n], both[n - common:]
        most = jaccard.most_common(jaccard.sketch(a), len(a), jaccard.sketch(b), len(b))
        assert common <= most <= min(n, m)
    # Sets that are alike but do not link are told apart without looking at them.
    both = np.unique(rnd.integers(0, 2 ** 64, 345, dtype=np.uint64))
    most = jaccard.most_common(jaccard.sketch(both[:300]), 300, jaccard.sketch(both[45:]), 300)
    assert 255 <= most < JaccardConfig().need(300) * 2 * 300 / (300 + JaccardConfig().need(300))

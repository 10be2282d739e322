"""MaxScore against all products; URL rules and host scores against Python."""

import math
import random

import numpy as np
import pytest

from undercroft.llm import maxscore, urlgraph
from undercroft.llm.urlgraph import GraphConfig, Rule

VECTORS = "vec_id long, embedding array<float>, v string, shard int"
PAGES = "page_id long, url string, html string, host string, trust double"
RULES = (Rule("allow", "org", "/"), Rule("block", "example.org", "/es/"), Rule("block", "example.org", "/en/1"),
         Rule("allow", "com", "/fr/"), Rule("block", "com", "/de/"))


def brute_top(rows, k, every):
    fine = {}
    for i, x in rows:
        if i is None or x is None or any(c is None or not math.isfinite(c) for c in x):
            continue
        v = [math.floor(256 * float(np.float32(c))) for c in x]
        fine[i] = min(fine.get(i, v), v)
    out = []
    for q, x in fine.items():
        if q % every == 0:
            scored = sorted((-sum(a * b for a, b in zip(x, y)), i) for i, y in fine.items() if i != q)[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored)]
    return sorted(out)


@pytest.mark.parametrize("seed, width", [(1, 8), (2, 1), (3, 40)])
def test_top_k(spark, seed, width):
    rnd = random.Random(seed)
    rows = [(i, [rnd.choice([0.0, rnd.gauss(0, 0.4), rnd.gauss(0, 3)]) for _ in range(width)]) for i in range(300)]
    rows += [(500 + i, rows[i % 7][1]) for i in range(60)]
    rows += [(700, None), (701, [None] * width), (702, [float("nan")] * width), (703, [float("inf")] * width), (None, rows[0][1]),
             (50, rows[50][1]), (750, []), (751, rows[3][1][:1])]
    frame = spark.createDataFrame([(i, x, "a", 1) for i, x in rows], VECTORS)
    got = sorted(map(tuple, maxscore.search_table(frame, 5, 50).collect()))
    assert got == brute_top(rows, 5, 50)


def test_small_and_empty_tables(spark):
    frame = spark.createDataFrame([(50, [1.0], "", 1), (100, [2.0], "", 1)], VECTORS)
    assert sorted(map(tuple, maxscore.search_table(frame).collect())) == [(50, 1, 100, 131072), (100, 1, 50, 131072)]
    assert maxscore.search_table(spark.createDataFrame([], VECTORS)).count() == 0


def test_pruning_keeps_the_best():
    rnd = np.random.default_rng(5)
    ids, x = np.arange(2000), rnd.integers(-400, 400, (2000, 24))
    for qid in range(30):
        q = x[qid]
        at, score = maxscore.search_shard(ids, x, qid, q, 5, x.max(axis=0), x.min(axis=0))
        full = x @ q
        want = sorted((-int(s), int(i)) for i, s in zip(ids, full) if i != qid)[:5]
        assert [(-int(s), int(ids[a])) for a, s in zip(at, score)] == want


def test_thresholds_of_other_shards_spare_work_and_lose_nothing():
    rnd = np.random.default_rng(6)
    ids, x = np.arange(1500), np.asfortranarray(rnd.integers(-400, 400, (1500, 24)).astype(float))
    high, low = x.max(axis=0), x.min(axis=0)
    for qid in range(20):
        q = x[qid]
        full = x @ q
        want = sorted((-int(s), int(i)) for i, s in zip(ids, full) if i != qid)[:5]
        fifth = -want[-1][0]
        for floor in (None, fifth - 1000, fifth):
            at, score = maxscore.search_shard(ids, x, qid, q, 5, high, low, floor)
            assert [(-int(s), int(ids[a])) for a, s in zip(at, score)] == want
        # Nothing here reaches a score that is known to be reached elsewhere, but its equals stay.
        at, score = maxscore.search_shard(ids, x, qid, q, 5, high, low, -want[1][0])
        assert [(-int(s), int(ids[a])) for a, s in zip(at, score)][:2] == want[:2]


def python_rule(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    cut = min([rest.index(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[:min([path.index(c) for c in "?#" if c in path] or [len(path)])]
    fits = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return host, path, max(fits, key=lambda r: len(r.text)) if fits else None


URLS = ["http://A.Example.ORG/en/17", "https://example.org/es/", "https://example.org", "http://x.com/fr/1?q#f", "ftp://com/de/", "no scheme",
        None, "", "://", "http://notexample.org/en/1", "http://a.net/x", "http://É.ORG/", "http://a.com?x=/de/", "x://y://z/org/", "http://b.net/"]


def test_rules(spark):
    frame = spark.createDataFrame([(i, u, None, "h", 0.0) for i, u in enumerate(URLS)], PAGES)
    got = {r["page_id"]: (r["host"], r["path"], r["rule"]) for r in urlgraph.judge_pages(frame, RULES).collect()}
    want = {}
    for i, u in enumerate(URLS):
        host, path, rule = python_rule(u)
        want[i] = (host, path, rule.text if rule else None)
    assert got == want


def brute_rank(edges, seeds, cfg):
    total = sum(seeds.values())
    if not total:
        return dict.fromkeys(seeds, 0.0)
    seed = {h: s / total for h, s in seeds.items()}
    degree = {}
    for (a, _), n in edges.items():
        degree[a] = degree.get(a, 0) + n
    rank = dict(seed)
    for _ in range(cfg.rounds if edges else 0):
        flow = dict.fromkeys(rank, 0.0)
        for (a, b), n in edges.items():
            flow[b] += rank[a] * n / degree[a]
        lost = 1 - sum(flow.values())
        new = {h: cfg.damping * flow[h] + seed[h] * (1 - cfg.damping + cfg.damping * lost) for h in rank}
        moved = sum(abs(new[h] - rank[h]) for h in rank)
        rank = new
        if moved < cfg.settled:
            break
    return rank


def test_link_graph(spark):
    rnd = random.Random(8)
    hosts = ["a.org", "b.net", "c.net", "d.com", "e.net", "f.com"]
    pages, edges = [], {}
    for i in range(60):
        h = rnd.choice(hosts)
        links = [rnd.choice([*hosts, "only.linked"]) for _ in range(rnd.randint(0, 3))]
        html = "".join(f'<a href="{rnd.choice(["http://", "//", "HTTPS://"])}{x}/p">x</a><a href=/local>y</a>' for x in links)
        pages.append((i, f"http://{h}/{rnd.choice(['fr', 'de', 'en'])}/{i}", html, "", 0.0))
        for x in links:
            if x != h:
                edges[h, x] = edges.get((h, x), 0) + 1
    got = urlgraph.judge_pages(spark.createDataFrame(pages, PAGES), RULES).collect()
    share = {}
    for _, url, *_ in pages:
        host, _, rule = python_rule(url)
        a = share.setdefault(host, [0, 0, 0])
        a[0] += 1
        a[1] += bool(rule and rule.verdict == "allow")
        a[2] += bool(rule and rule.verdict == "block")
    nodes = {h for e in edges for h in e} | set(share)
    cfg = GraphConfig()
    trust = brute_rank(edges, {h: share.get(h, [1, 0, 0])[1] / share.get(h, [1, 0, 0])[0] for h in nodes}, cfg)
    against = brute_rank({(b, a): n for (a, b), n in edges.items()}, {h: share.get(h, [1, 0, 0])[2] / share.get(h, [1, 0, 0])[0] for h in nodes}, cfg)
    verdicts = set()
    for r in got:
        assert r["trust"] == pytest.approx(trust[r["host"]], abs=1e-9) and r["distrust"] == pytest.approx(against[r["host"]], abs=1e-9)
        rule = python_rule(pages[r["page_id"]][1])[2]
        spread = "block" if against[r["host"]] > 0.5 * (trust[r["host"]] + against[r["host"]]) else "allow"
        assert r["verdict"] == (rule.verdict if rule else spread)
        verdicts.add((rule is None, r["verdict"]))
    assert len(verdicts) == 4
    plan = urlgraph.judge_pages(spark.createDataFrame(pages, PAGES), RULES)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_distrust_reaches_the_end_of_a_chain(spark):
    n = 24
    pages = [(i, f"http://h{i}.net/x", f'<a href="http://{"h%d.net" % (i + 1) if i < n else "com"}/de/">x</a>', "", 0.0) for i in range(n + 1)]
    pages.append((n + 1, "http://com/de/", "", "", 0.0))
    got = urlgraph.judge_pages(spark.createDataFrame(pages, PAGES), RULES, GraphConfig(settled=0.05)).collect()
    assert all(r["verdict"] == "block" and r["distrust"] > 0 for r in got) and len(got) == n + 2


def test_ranks_that_do_not_settle_are_a_fault(spark):
    edges = spark.createDataFrame([("a", "b", 1), ("b", "a", 1)], "src string, dst string, n long")
    seeds = spark.createDataFrame([("a", 1.0), ("b", 0.0)], "host string, seed double")
    with pytest.raises(RuntimeError):
        urlgraph.spread(edges, seeds, GraphConfig(rounds=2), "fault")


def test_no_pages(spark):
    assert urlgraph.judge_pages(spark.createDataFrame([], PAGES), RULES).count() == 0

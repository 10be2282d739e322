"""Toxicity: features by hand, accuracy on held-out labels, defined results without labels."""

import random
import zlib

import pytest

from undercroft.llm import toxicity
from undercroft.llm.toxicity import FEATURES, ToxicityConfig

DOCS = "doc_id long, text string, score double, features string"
LABELS = "doc_id long, quality int, toxic int"


def corpus(n, seed=1):
    rnd = random.Random(seed)
    plain = ["".join(rnd.choice("aeiourstln") for _ in range(rnd.randint(3, 8))) for _ in range(400)]
    bad = ["grubble", "snark", "vexilo", "vexida", "moop"]
    docs, labels = [], []
    for i in range(n):
        words = rnd.choices(plain, k=rnd.randint(5, 60))
        toxic = rnd.random() < 0.25
        if toxic:
            for _ in range(rnd.randint(2, 5)):
                words.insert(rnd.randrange(len(words)), rnd.choice(bad))
        docs.append((i, " ".join(words), 0.5, "x"))
        labels.append((i, 1, int(toxic)))
    return docs, labels


def test_held_out_accuracy_and_columns(spark):
    docs, labels = corpus(900)
    docs += [(2000, None, 0.0, ""), (2001, "", 0.0, ""), (None, "grubble snark", 0.0, ""), (2002, "moop " * 30_000, 0.0, "")]
    labels += [(None, 1, 1), (2001, 1, None), (5000, 1, 1), (3, 1, 1), (3, 1, 0)]
    cfg = ToxicityConfig(rounds=10)
    rows = toxicity.score(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS), cfg).collect()
    assert len(rows) == len(docs)
    truth = dict((i, t) for i, _, t in labels[:900])
    right = held = 0
    for r in rows:
        d = r["doc_id"]
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)
        assert r["held_out"] == (d is not None and zlib.crc32(str(d).encode()) % 3 == 1)
        if r["held_out"] and d in truth:
            held += 1
            right += r["predicted"] == truth[d]
    assert right / held > 0.95
    by = {r["doc_id"]: r for r in rows}
    assert by[2000]["score"] == by[2001]["score"] < 0.5 and by[2002]["predicted"] == 1
    kept = toxicity.reject(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS), cfg)
    assert kept.columns == ["doc_id", "text", "score", "features"]
    assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in rows if not r["predicted"]}


def test_labels_of_held_out_documents_do_not_matter(spark):
    docs, labels = corpus(300, 4)
    turned = [(d, q, 1 - t if zlib.crc32(str(d).encode()) % 3 == 1 else t) for d, q, t in labels]
    frame = spark.createDataFrame(docs, DOCS)
    cfg = ToxicityConfig(rounds=3)
    one, two = (sorted(map(tuple, toxicity.score(frame, spark.createDataFrame(x, LABELS), cfg).collect())) for x in (labels, turned))
    assert one == two


@pytest.mark.parametrize("labels", [[], [(1, 1, 0), (2, 1, 0)], [(1, 1, 5)]])
def test_without_usable_labels(spark, labels):
    rows = toxicity.score(spark.createDataFrame([(1, "a", 0.0, ""), (2, "b", 0.0, "")], DOCS), spark.createDataFrame(labels, LABELS)).collect()
    assert [r["score"] for r in rows] == [0.0, 0.0]


def test_no_documents(spark):
    assert toxicity.score(spark.createDataFrame([], DOCS), spark.createDataFrame([(1, 1, 1)], LABELS)).count() == 0


def test_features():
    cfg = ToxicityConfig()
    got = dict(zip(FEATURES, toxicity.text_features("YOU are an id1ot, IDIOT!! soooo calm", {"idiot": 4.0, "^idio": 1.0}, cfg, {})))
    assert got["hits"] == 2 and got["peak"] == 5.0 and got["near_second_person"] == pytest.approx(2 / 7)
    assert got["shouted"] == pytest.approx(2 / 7) and got["obfuscated"] == pytest.approx(1 / 7) and got["stretched"] == pytest.approx(1 / 7)
    assert toxicity.text_features("  ", {}, cfg, {}) == [0.0] * len(FEATURES)
    # Dots and digits inside a word are undone, hyphens are not: compounds are written with them.
    assert toxicity.read_word("f-u-n,") == ("f-u-n", False, False)
    assert toxicity.read_word("f.u.n,") == ("fun", True, False) and toxicity.read_word("fu7n") == ("futn", True, False)

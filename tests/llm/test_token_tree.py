"""Token trees against encoding the whole edited text."""

import random

import public_tokenizers
import pytest

from undercroft.llm import token_tree
from undercroft.llm.packing import encode
from undercroft.llm.token_tree import TokenTree

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, source string"


def text_of(rnd, n):
    parts = ["the ", "a ", "  ", "\n", "don't ", "x9 ", "Ünïcode ", "ñandú, ", "...", "\t", "12345 ", "漢字 ", "'s "]
    return "".join(rnd.choice(parts) for _ in range(n))


@pytest.mark.parametrize("seed", range(6))
def test_edits_equal_encoding(seed):
    rnd = random.Random(seed)
    for size in (0, 3, 40, 900):
        text = text_of(rnd, size)
        tree = TokenTree.build(text, PATH)
        assert tree.total == len(encode(text, PATH))
        for _ in range(10):
            start = rnd.randint(0, len(text) + 2)
            stop = start + rnd.choice([0, 0, 1, 5, 400])
            put = rnd.choice(["", " ", "\n", "x", "'ll", text_of(rnd, rnd.choice([2, 60, 1500]))])
            want = text[:min(start, len(text))] + put + text[min(stop, len(text)):]
            text = tree.edit(text, start, stop, put, PATH)
            assert text == want and tree.total == len(encode(text, PATH)) and tree.chars[1] == len(text)


def test_small_edits_encode_little():
    text = "some words of a text that goes on and on " * 3000
    tree = TokenTree.build(text, PATH)
    tree.encoded = tree.renewed = 0
    text = tree.edit(text, 60_000, 60_005, "other", PATH)
    assert tree.total == len(encode(text, PATH))
    assert tree.encoded < 4 * token_tree.PIECE and tree.renewed < 40


def test_query_against_whole_texts(spark):
    rnd = random.Random(3)
    docs = [(i, text_of(rnd, rnd.choice([0, 1, 30, 600])), "s") for i in range(30)]
    docs += [(30, None, "s"), (None, "no id here", None), (31, "twice", "s"), (31, "twice", "s")]
    frame = spark.createDataFrame(docs, SCHEMA)
    items = spark.createDataFrame([(0, "an item text"), (1, " with space "), (2, None)], "item_id long, text string")
    edits = {}
    for e in token_tree.revisions(frame, items).collect():
        edits.setdefault(e["row_key"], []).append((e["seq"], e["start"], e["stop"], e["put"] or ""))
    got = token_tree.count_revised(frame, items, PATH).collect()
    assert len(got) == len(docs)
    texts = {r["row_key"]: r["text"] for r in token_tree._rows(frame).collect()}
    for r in got:
        text = texts[r["row_key"]]
        assert r["tokens_before"] == len(encode(text, PATH))
        for _, start, stop, put in sorted(edits[r["row_key"]]):
            text = text[:min(start, len(text))] + put + text[min(stop, len(text)):]
        assert r["text"] == text and r["tokens_after"] == len(encode(text, PATH)) and r["chars"] == len(text)


def test_empty(spark):
    frame = spark.createDataFrame([], SCHEMA)
    items = spark.createDataFrame([], "item_id long, text string")
    assert token_tree.count_revised(frame, items, PATH).count() == 0


def test_documents_without_benchmark_items(spark):
    """Stretches are cut out and nothing is put in their place."""
    docs = spark.createDataFrame([(1, "some words of a text that is long enough to lose some", "s"), (2, None, "s")], SCHEMA)
    items = spark.createDataFrame([], "item_id long, text string")
    got = {r["doc_id"]: r for r in token_tree.count_revised(docs, items, PATH).collect()}
    assert set(got) == {1, 2} and all(r["tokens_after"] == len(encode(r["text"], PATH)) for r in got.values())
    assert got[2]["text"] == "\nsource 0" and got[1]["text"].endswith("\nsource 35")

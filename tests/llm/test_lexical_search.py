"""Ranked search against a plain ranking of every document, and range maxima against slices."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from helpers import edge_rows, frame, prose, row

from spanledger.llm import lexical_search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, items, best=50):
    held = [(r["doc_id"], Counter(TERM.findall((r["text"] or "").translate(LOWER)))) for r in rows]
    held = [(d, c, sum(c.values())) for d, c in held if c]
    n_docs, all_terms = len(held), sum(n for *_, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item_id, text in items:
        scored = []
        for doc_id, counts, n in held:
            m = 100 - 50 + 50 * n * n_docs // all_terms
            score = 0
            for t in set(TERM.findall((text or "").translate(LOWER))):
                if tf := counts[t]:
                    score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * tf // (1000 * tf + 20 * m))
            if score > 0:
                scored.append((-score, doc_id is None, doc_id or 0, doc_id))
        out += [(item_id, k + 1, s[3], -s[0]) for k, s in enumerate(sorted(scored)[:best])]
    return out


def ours(spark, rows, items, best=50, extra=False):
    asked = spark.createDataFrame(items, "item_id long, text string")
    if extra:
        asked = asked.selectExpr("*", "1 as item", "2 as term", "3 as rank")
    found = lexical_search.ranked(frame(spark, rows, extra), asked, best)
    return [tuple(r) for r in found.select("item_id", "rank", "doc_id", "score").collect()]


def same(a, b):
    assert sorted(a, key=repr) == sorted(b, key=repr)


@pytest.mark.parametrize("extra", [False, True])
def test_edge_texts_equal_the_plain_ranking(spark, extra):
    rows = edge_rows()
    texts = [None, "", "!!", "a b c", "A B C a", "again line w7 w19999", "Ünknown É 漢字 かな", "word 12 34", "word 12 34"]
    items = list(enumerate(texts)) + [(None, "a b"), (3, "same very")]
    same(ours(spark, rows, items, extra=extra), plain(rows, items))


def corpus():
    rng = random.Random(4)
    words = [f"t{k}" for k in range(60)]
    rows = []
    for k in range(400):
        picked = rng.choices(words, weights=[1 / (j + 1) for j in range(60)], k=rng.randint(1, 60))
        rows.append(row(k, " ".join(picked)))
    # A third of all rows are copies, which tie.
    return rows + [row(1000 + k, "t3 t9 t9 t40 t41") for k in range(200)]


ITEMS = [(k, " ".join(f"t{(7 * k + 3 * j) % 63}" for j in range(1 + k))) for k in range(20)]


@pytest.mark.parametrize(("best", "opened", "block"), [(50, 64, 2_000_000), (7, 1, 300), (1, 3, 1), (1000, 64, 900)])
def test_best_first_finds_what_scoring_all_finds(spark, best, opened, block, monkeypatch):
    rows = corpus()
    monkeypatch.setattr(lexical_search, "OPENED", opened)
    small = lexical_search.index

    def in_small_blocks(docs):
        return small(docs.repartition(9)) if block < 2_000_000 else small(docs)

    monkeypatch.setattr(lexical_search, "index", in_small_blocks)
    same(ours(spark, rows, ITEMS, best), plain(rows, ITEMS, best))


def test_items_in_parts_and_joined_terms(spark, monkeypatch):
    monkeypatch.setattr(lexical_search, "ITEM_TERMS", 40)
    monkeypatch.setattr(lexical_search, "BROADCAST_ROWS", 3)
    same(ours(spark, corpus(), ITEMS, 5), plain(corpus(), ITEMS, 5))


def test_empty_tables(spark):
    assert ours(spark, [], ITEMS) == []
    assert ours(spark, corpus(), []) == []
    same(ours(spark, [row(1, None), row(2, "...")], ITEMS), [])


def test_ids_of_text(spark):
    docs = spark.createDataFrame([("b", "x y"), ("a", "x y"), (None, "x y"), ("c", "z")], "doc_id string, text string")
    items = spark.createDataFrame([("i", "x")], "item_id string, text string")
    found = lexical_search.ranked(docs, items).orderBy("rank").collect()
    assert [(r.item_id, r.rank, r.doc_id) for r in found] == [("i", 1, "a"), ("i", 2, "b"), ("i", 3, None)]


def test_range_maxima():
    rng = np.random.default_rng(1)
    sizes = [1, 5, 64, 1000]
    docs = [np.sort(rng.choice(2000, n, replace=False)) for n in sizes]
    impacts = [rng.integers(1, 50, n) for n in sizes]
    held = lexical_search.Postings([0, 1, 2, 3], docs, impacts, 2000)
    starts = np.cumsum([0, *sizes])
    for _ in range(500):
        k = int(rng.integers(0, 4))
        a, b = sorted(rng.integers(0, sizes[k] + 1, 2).tolist())
        top = int(held.largest(np.array([starts[k] + a]), np.array([starts[k] + b]))[0])
        assert held.impact[top] == (impacts[k][a:b].max() if a < b else 0)


def test_intervals_below_the_best_are_not_opened():
    """A few documents stand out, so most of the others are never scored."""
    docs, impacts = np.arange(100_000), np.ones(100_000, np.int64)
    impacts[::10_000] = 1000
    held = lexical_search.Postings([0, 1], [docs, docs], [impacts, impacts], 100_000)
    scored, order = [], np.arange(100_000)
    plain_max = held.largest
    held.largest = lambda a, b: scored.append(len(a)) or plain_max(a, b)
    found = held.search(np.array([0, 1]), 10, order)
    assert found == [(2000, 10_000 * k) for k in range(10)] and sum(scored) < 1000

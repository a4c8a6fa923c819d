"""Language-model scores against dictionaries of n-grams, and monotone sequences against plain arrays."""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from helpers import edge_rows, frame, prose, row

from spanledger.llm import elias_fano, lm_scoring
from spanledger.llm.blocks import pack, pack_steps, unpack

COLUMNS = ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def plain(rows):
    """The same model with exact probabilities."""
    texts = []
    for r in rows:
        fold = None if r["doc_id"] is None else zlib.crc32(str(r["doc_id"]).encode()) % 7
        words = (r["text"] or "").encode().lower().split()
        texts.append((r["doc_id"], fold, [*words, b""]))
    one, two, three, before = Counter(), Counter(), Counter(), Counter()
    pairs = Counter()
    for _, fold, tokens in texts:
        if fold is None or fold == 2:
            continue
        u = v = None
        for w in tokens:
            one[w] += 1
            two[v, w] += 1
            before[v] += 1
            three[u, v, w] += 1
            pairs[u, v] += 1
            u, v = v, w
    n, distinct = sum(one.values()), len(one)
    out = []
    for doc_id, fold, tokens in texts:
        base = score = 0.0
        u = v = None
        for w in tokens:
            p = (one[w] + 1) / (n + distinct + 1)
            base += math.log10(p)
            p = (two[v, w] + lm_scoring.PRIOR_2 * p) / (before[v] + lm_scoring.PRIOR_2)
            p = (three[u, v, w] + lm_scoring.PRIOR_3 * p) / (pairs[u, v] + lm_scoring.PRIOR_3)
            score += math.log10(p)
            u, v = v, w
        out.append((doc_id, fold == 2, len(tokens), sum(one[w] > 0 for w in tokens), n, base, score))
    return out


def check(found, rows):
    key = lambda t: (t[0] is None, t[0] or 0, *t[2:4], round(t[5], 3))
    ours, theirs = sorted(found, key=key), sorted(plain(rows), key=key)
    assert [t[:5] for t in ours] == [t[:5] for t in theirs]
    for x, y in zip(ours, theirs):
        assert x[5] == pytest.approx(y[5], rel=1e-9, abs=1e-9)
        # Two codes of half a step each at most enter the score of a token.
        assert abs(x[6] - y[6]) <= x[2] * 1.01 / lm_scoring.STEPS


def ours(spark, rows, extra=False, **options):
    return [tuple(r) for r in lm_scoring.lm_scores(frame(spark, rows, extra), **options).select(*COLUMNS).collect()]


def corpus():
    texts = [prose(k % 7, 40 + k) + " the same passage of words in many texts " + prose(k, 25) for k in range(60)]
    return [row(k, t) for k, t in enumerate(texts + ["the the the the"] * 30 + [None, "", "unheard-of words"])]


@pytest.mark.parametrize("extra", [False, True])
def test_edge_texts_equal_the_plain_model(spark, extra):
    rows = edge_rows()
    check(ours(spark, rows, extra), rows)


# With a shard of 50 tokens, frequent words are dealt over many shards.
@pytest.mark.parametrize("shard_tokens", [50, 700, 1 << 20])
def test_any_number_of_shards_gives_the_model(spark, shard_tokens, monkeypatch):
    rows = corpus()
    check(ours(spark, rows, shard_tokens=shard_tokens), rows)


def test_blocks_of_any_size_give_the_model(spark, monkeypatch):
    rows = corpus()
    whole = sorted(ours(spark, rows), key=repr)
    plain_blocks = lm_scoring.token_blocks
    monkeypatch.setattr(lm_scoring, "token_blocks", lambda docs: plain_blocks(docs.repartition(17)))
    assert sorted(ours(spark, rows), key=repr) == whole


def test_words_are_counted_by_rows_of_many_words(spark):
    """A row for each block and bucket; a row for each word of a block took a seventh of the time."""
    rows = corpus()
    blocks = lm_scoring.token_blocks(frame(spark, rows).repartition(5)).localCheckpoint()
    found = lm_scoring.vocabulary(blocks, 3).collect()
    assert len(found) <= 3 * blocks.count()
    learned, everywhere = Counter(), Counter()
    for r in rows:
        fold = zlib.crc32(str(r["doc_id"]).encode()) % 7
        for w in [*(r["text"] or "").encode().lower().split(), b""]:
            everywhere[w] += 1
            learned[w] += fold != 2
    words = {r["block"]: r["words"].split(b" ") for r in blocks.collect()}
    numbers = {}
    for r in found:
        parts = [unpack(r[x], "<i8").tolist() for x in ("place", "number", "learned", "everywhere")]
        for place, number, *counts in zip(*parts):
            word = words[r["of"]][place]
            assert numbers.setdefault(word, number) == number
            assert counts == [learned[word], everywhere[word]]
    assert set(numbers) == set(everywhere) and len(set(numbers.values())) == len(numbers) and min(numbers.values()) > 0
    assert sum(r["distinct"] for r in found) == sum(n > 0 for n in learned.values())


def asked(spark, *rows):
    """Questions to one shard: for each block its (v, w, u, n), sorted, and counts of its contexts."""
    made = []
    for of, (grams, contexts) in enumerate(rows):
        v, w, u, n = (np.array(x) for x in zip(*grams))
        places, counted = (np.array(x) for x in zip(*contexts))
        made.append((of, 0, pack_steps(v), pack_steps(w), pack(u, "<i8"), pack(n, "<i4"), pack_steps(places), pack(counted, "<i8")))
    return spark.createDataFrame(made, lm_scoring.QUESTION).coalesce(1)


def test_a_word_dealt_over_shards_beside_its_neighbours(spark):
    """Counts of dealt words are negative; as part of a sort key they put word 11 before word 10."""
    (found,) = lm_scoring.answers(asked(spark, ([(10, 3, 2, 5), (11, 4, -1, 7)], [(10, 5), (11, -100)]))).collect()
    code = lambda p: int(lm_scoring._code(np.array([p]))[0])
    assert unpack(found["own_2"], "<u2").tolist() == [code(5 / 205), code(7 / 300)]
    assert unpack(found["own_3"], "<u2").tolist() == [code(5 / 55), lm_scoring.NONE]
    assert unpack(found["weight_3"], "<u2").tolist() == [code(50 / 55), lm_scoring.NONE]


def test_what_several_blocks_ask_is_searched_once(monkeypatch):
    searched = []
    find = elias_fano.Monotone.find
    monkeypatch.setattr(elias_fano.Monotone, "find", lambda self, values, *a: searched.append(len(values)) or find(self, values, *a))
    # Five blocks, each with the bigrams (1, 1) and (1, 2) behind the words 1 and 2.
    u, v, w = np.tile([1, 2, 1, 2], 5), np.ones(20, np.int64), np.tile([1, 1, 2, 2], 5)
    levels = lm_scoring.Levels(u, v, w, np.array([1]))
    own_2, own_3, weight_3 = lm_scoring.Trie(levels, np.ones(20, np.int64), np.array([20])).answer(levels)
    assert searched == [1, 2, 2, 4]
    code = lambda p: lm_scoring._code(np.array([p]))[0]
    assert set(own_2) == {code(10 / 220)} and set(own_3) == {code(5 / 60)} and set(weight_3) == {code(50 / 60)}


def test_without_texts_to_learn_from(spark):
    assert ours(spark, []) == []
    held = [k for k in range(200) if zlib.crc32(str(k).encode()) % 7 == 2][:3]
    rows = [row(k, "some words") for k in held] + [row(None, "more words")]
    assert {t[5:] for t in ours(spark, rows)} == {(0.0, 0.0)}
    check(ours(spark, rows), rows)


def test_held_out_texts_like_the_training_texts_score_above_the_base(spark):
    rows = [row(k, prose(k % 5, 60)) for k in range(80)]
    held = [t for t in ours(spark, rows) if t[1]]
    assert held and all(t[6] > t[5] + 10 for t in held)


@pytest.mark.parametrize("seed", range(6))
def test_monotone_sequences(seed):
    rng = np.random.default_rng(seed)
    n, top = [(0, 1), (1, 5), (500, 300), (4000, 1 << 40), (3000, 3001), (5000, 1 << 60)][seed]
    values = np.sort(rng.integers(0, top, n)).astype(np.int64)
    # Some crowded stretches, so that many values share a high part.
    if n > 1000:
        values = np.sort(np.concatenate([values, values[7] + np.arange(1000)]))
    mapped = elias_fano.Mapped({f"x.{k}": a for k, a in elias_fano.Monotone.arrays(values).items()})
    sequence = mapped.monotone("x")
    if len(values):
        places = rng.integers(0, len(values), 3000)
        assert (sequence.get(places) == values[places]).all()
    asked = np.concatenate([values, values + 1, values - 1, rng.integers(0, top + 9, 2000), [-1, top * 2]])
    found = sequence.find(asked)
    first = np.searchsorted(values, asked)
    there = np.isin(asked, values)
    assert (found == np.where(there, first, -1)).all()

"""Exact and near copies, components, covering codes."""

from __future__ import annotations

import random

import brute
import numpy as np
import pytest
from helpers import edge_rows, frame, prose, row, tuples

from spanledger.llm import exact_dedup, simhash
from spanledger.llm.common import stage
from spanledger.llm.components import components

EXACT = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def test_exact_duplicates_are_those_of_brute_force(spark):
    rows = edge_rows() + [row(200 + k, "hot  text") for k in range(60)]
    for extra in (False, True):
        got = exact_dedup.exact_duplicates(frame(spark, rows, extra))
        assert brute.near_equal(tuples(got, *EXACT), brute.exact(rows))


def test_exact_duplicates_of_an_empty_table(spark):
    assert tuples(exact_dedup.exact_duplicates(frame(spark, []))) == []
    assert exact_dedup.without_exact_duplicates(frame(spark, [])).columns == brute.COLUMNS


def test_one_row_of_each_text_stays_with_its_columns(spark):
    rows = edge_rows()
    got = exact_dedup.without_exact_duplicates(frame(spark, rows, extra=True))
    assert got.columns[: len(brute.COLUMNS)] == brute.COLUMNS and got.columns[-1] == "host"
    want = [(r["doc_id"], r["text"]) for r, e in zip(rows, brute.exact(rows)) if e[3]]
    # Of rows equal but for white space and order any may be the first, so ids are compared.
    assert sorted(r[0] or -1 for r in tuples(got, "doc_id")) == sorted(w[0] or -1 for w in want)


def test_index_persists_between_runs(spark):
    index = exact_dedup.new_index(spark)
    first = exact_dedup.exact_duplicates(frame(spark, [row(5, "x"), row(7, "y")]), index)
    assert {r[3] for r in tuples(first, *EXACT)} == {True}
    again = exact_dedup.exact_duplicates(frame(spark, [row(1, "x"), row(2, "z"), row(3, "z")]), index)
    assert {(r[0], r[1], r[3]) for r in tuples(again, *EXACT)} == {(1, 5, False), (2, 2, True), (3, 2, False)}
    assert sorted(r[0] for r in tuples(index.table(), "keep_id")) == [2, 5, 7]


def test_index_side_of_the_anti_join_is_not_shuffled(spark):
    index = exact_dedup.new_index(spark)
    exact_dedup.exact_duplicates(frame(spark, [row(k, f"t{k}") for k in range(50)]), index)
    new = spark.range(10).selectExpr("unhex(sha2(cast(id as string), 256)) as digest").groupBy("digest").count()
    plan = new.join(index.table().hint("merge"), "digest", "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and plan.count("Exchange hashpartitioning") == 1


def near_rows() -> list[dict]:
    """Chains of texts a word apart, copies, and texts that are alone."""
    rng, rows = random.Random(7), []
    for k in range(12):
        words = prose(k, 400).split()
        for _ in range(8):
            rows.append(row(len(rows), " ".join(words)))
            words[rng.randrange(len(words))] = "other"
    rows += [row(1000 + k, prose(50 + k, 60)) for k in range(20)]
    rng.shuffle(rows)
    return rows + [row(2000 + k, rows[0]["text"].upper()) for k in range(10)]


NEAR = ("doc_id", "fingerprint", "component_id")


@pytest.mark.parametrize("plan", [simhash.PLAIN, simhash.WIDE])
def test_near_duplicates_are_those_of_brute_force(spark, plan):
    rows = edge_rows() + near_rows()
    want = brute.near(rows)
    assert len({w[2] for w in want}) < len({w[1] for w in want})
    got = simhash.near_duplicates(frame(spark, rows, extra=True), plan=plan)
    assert brute.near_equal(tuples(got, *NEAR), want)


def test_anchors_dealt_over_several_tasks_lose_no_link(spark, monkeypatch):
    rows = near_rows()
    monkeypatch.setattr(simhash, "NEXT_TO", 2)
    assert brute.near_equal(tuples(simhash.near_duplicates(frame(spark, rows)), *NEAR), brute.near(rows))


def test_near_duplicates_of_an_empty_table(spark):
    assert tuples(simhash.near_duplicates(frame(spark, []))) == []
    assert tuples(simhash.without_near_duplicates(frame(spark, []))) == []


def test_smallest_id_of_each_class_stays(spark):
    rows = near_rows()
    want = {w[2] for w in brute.near(rows)}
    got = [r[0] for r in tuples(simhash.without_near_duplicates(frame(spark, rows)), "doc_id")]
    assert sorted(got) == sorted(want)


@pytest.mark.parametrize("plan", [simhash.PLAIN, simhash.WIDE])
def test_partners_meet_at_the_anchor_next_to_either(plan):
    rng = np.random.default_rng(1)
    for _, cover in simhash.covers(plan, 4):
        values = rng.integers(0, 1 << cover.bits, 500)
        others = values ^ (1 << rng.integers(0, cover.bits, 500))
        near, _ = cover.anchors(values)
        for partner in (values, others):
            anchors, there = cover.anchors(partner)
            assert ((anchors == near[:, :1]) & there).any(axis=1).all()


def test_components_of_a_path_a_star_and_a_ring(spark):
    rng = random.Random(3)
    names = rng.sample(range(10_000), 300)
    path = list(zip(names[:100], names[1:100]))
    star = [(names[100], n) for n in names[101:200]]
    ring = list(zip(names[200:], names[201:] + names[200:201]))
    edges = stage(spark.createDataFrame(path + star + ring + [(1, 1)], "a long, b long"), "test")
    got = dict(tuples(components(edges)))
    want = {}
    for group in (names[:100], names[100:200], names[200:]):
        want |= {n: min(group) for n in group if n != min(group)}
    assert got == want

"""The whole pipeline against brute force, and what the queries promise."""

from __future__ import annotations

import threading
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path
from types import SimpleNamespace

import brute
import pytest
from helpers import edge_rows, frame, prose, row, tuples

import corpus_pipeline
from spanledger.llm import common
from spanledger.llm.queries import ORACLE, QUERIES


def corpus() -> list[dict]:
    rows = edge_rows() + [row(1000 + k, prose(k % 130, 60 + k % 7), source=f"s{k % 3}") for k in range(200)]
    rows += [row(2000 + k, prose(k % 130, 60 + k % 7).replace("a", "ä", 1), source="hot") for k in range(150)]
    rows += [row(3000 + k, "$$$ ".join(prose(900 + k, 40).split()), source="hot") for k in range(5)]
    return [r for r in rows if r["doc_id"] is not None]


def test_stages_chain_as_brute_force_does(spark, tmp_path):
    rows = list({r["doc_id"]: r for r in corpus()}.values())
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")

    kept = {q[0] for q in brute.quality(rows) if q[-1]}
    want = [r for r in rows if r["doc_id"] in kept]
    assert 0 < len(want) < len(rows)
    want = [r for r, e in zip(want, brute.exact(want)) if e[3]]
    named = brute.near(want)
    assert len({n[2] for n in named}) < len(named)
    want = [r for r, n in zip(want, named) if n[2] == n[0]]
    times = {m[0]: int(m[4] / m[1] + 0.5) for m in brute.mix(want)}
    want = [r for r in want for _ in range(times[r["doc_id"]])]
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert brute.near_equal(tuples(got, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256"), brute.encode(want))


def test_rows_without_an_id_or_with_a_repeated_one_are_told_apart_by_their_texts(spark):
    rows = corpus() + [row(None, prose(5000 + k, 60)) for k in range(60)]
    rows += [row(7, prose(6000 + k, 60)) for k in range(20)]
    rows += [row(None, prose(5000 + k, 60).replace("a", "ä", 1)) for k in range(10)]
    kept = [r for r, q in zip(rows, brute.quality(rows)) if q[-1]]
    kept = [r for r, e in zip(kept, brute.exact(kept)) if e[3]]
    classes = {}
    for r, named in zip(kept, brute.near([{**r, "doc_id": k} for k, r in enumerate(kept)])):
        classes.setdefault(named[2], []).append(r)
    assert sum(all(r["doc_id"] is None for r in c) for c in classes.values()) >= 50
    assert sum(min(r["doc_id"] or 9999 for r in c) == 7 for c in classes.values()) >= 20
    docs = frame(spark, rows)
    for _, step in corpus_pipeline.STAGES[:3]:
        docs = common.stage(step(spark, docs, ""), "test")
    texts = {r["text"]: name for name, c in classes.items() for r in c}
    got = tuples(docs, "doc_id", "text")
    assert sorted(texts[text] for _, text in got) == sorted(classes)
    for doc_id, text in got:
        members = classes[texts[text]]
        assert doc_id == min((r["doc_id"] for r in members if r["doc_id"] is not None), default=None)


def test_all_but_the_last_stage_keep_the_columns(spark):
    docs = frame(spark, corpus()[:60], extra=True)
    for _, step in corpus_pipeline.STAGES[:-1]:
        staged = common.stage(step(spark, docs, ""), "test")
        assert staged.schema.simpleString() == docs.schema.simpleString()


def test_rows_of_parquet_files_are_told_apart_without_a_copy(spark, tmp_path):
    frame(spark, corpus()).write.parquet(f"{tmp_path}/documents.parquet")
    made = len(common.MADE.folders[-1])
    rows = common.Rows(spark.read.parquet(f"{tmp_path}/documents.parquet"), "test")
    assert len(common.MADE.folders[-1]) == made
    assert rows.docs.select("row").distinct().count() == len(corpus())
    derived = common.Rows(spark.read.parquet(f"{tmp_path}/documents.parquet").union(frame(spark, corpus())), "test")
    assert len(common.MADE.folders[-1]) == made + 1
    assert derived.docs.select("row").distinct().count() == 2 * len(corpus())


def test_rows_joined_by_shuffle_give_the_same(spark, monkeypatch):
    docs = frame(spark, corpus())
    for _, step in corpus_pipeline.STAGES[:-1]:
        small = step(spark, docs, "").select("doc_id", "text").collect()
        with monkeypatch.context() as patch:
            patch.setattr(common, "BROADCAST_ROWS", -1)
            large = step(spark, docs, "").select("doc_id", "text").collect()
        assert sorted(map(repr, small)) == sorted(map(repr, large))


def test_empty_tables_pass_through(spark, tmp_path):
    frame(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_each_operator_has_its_query():
    numbers = sorted(int(name[2:].split("_")[0]) for name in QUERIES)
    assert numbers == list(range(1, 14)) and set(ORACLE) <= set(QUERIES)


def test_a_failing_query_leaves_nothing(spark):
    folder = Path(common.shared_folder(spark).removeprefix("file://"))
    before = set(folder.iterdir())

    def failing():
        common.stage(spark.range(3), "left")
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError, match="lost"):
        common.settled(failing, "failing")
    assert set(folder.iterdir()) == before and common.MADE.folders[-1] == common.MADE.folders[0]


def test_two_queries_at_a_time_keep_their_tables_apart(spark):
    both = threading.Barrier(2)

    def slow(name):
        def make():
            df = common.stage(spark.range(10), name)
            both.wait(60)
            return df.selectExpr("id + 1 as id")

        result = common.settled(make, name)
        both.wait(60)
        return result.count()

    with ThreadPoolExecutor(2) as pool:
        assert list(pool.map(slow, ["one", "two"])) == [10, 10]


def test_a_cluster_without_a_shared_folder_is_an_error():
    def session(master):
        conf = SimpleNamespace(get=lambda key, default: default, set=lambda *_: None)
        return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master))

    assert common.shared_folder(session("local[8]")).startswith("file:///")
    for master in ("local-cluster[3,2,1024]", "spark://host:7077", "yarn"):
        with pytest.raises(ValueError, match="share"):
            common.shared_folder(session(master))


def test_only_the_result_stays_in_the_shared_folder(spark, tmp_path):
    frame(spark, corpus()).write.parquet(f"{tmp_path}/documents.parquet")
    pages = spark.createDataFrame([(1, "http://a/", "<p>x")], "page_id long, url string, html string")
    pages.write.parquet(f"{tmp_path}/pages.parquet")
    folder = Path(common.shared_folder(spark).removeprefix("file://"))
    benchmark = spark.createDataFrame([(1, "the very same line")], "item_id long, text string")
    benchmark.write.parquet(f"{tmp_path}/benchmark.parquet")
    # Those that stage nothing return what is computed when it is read.
    queries = [q for name, q in QUERIES.items() if name not in ("op1_language_id", "op4_license_scan", "op6_bpe")]
    for query in [*queries, corpus_pipeline.run]:
        before, tables = set(folder.iterdir()), spark.catalog.listTables()
        result = query(spark, str(tmp_path))
        assert len(set(folder.iterdir()) - before) == 1 and spark.catalog.listTables() == tables
        assert result.count() > 0

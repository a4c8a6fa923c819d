"""Ranked lexical search by range maxima over posting lists, best first.

Documents are indexed in blocks: for each term the places of its documents in the
block and how often they hold it, as one row of the index, which covers every term
and can be stored and searched again.  A search takes the rows of its terms, sums
document frequencies over them, and meets each block once: all impacts of the block's
postings lie in one array with a sparse table of range maxima over it.  For an item,
an interval of documents is bounded by the sum over its terms of the largest impact
in the interval.  Intervals are taken best first and split at the document that has
the largest single impact, which is scored in full; what is bounded below the score
of the last of the best is never opened.  The best of each block are ranked at the end.

Items are taken in blocks of a bounded number of terms, so neither the items nor the
index need fit a task, and nothing else meets the driver.

Defined results: a text that is null or has no term is not found, and an item without
one finds nothing; equal items and repeated rows are ranked each for itself; equal
scores go to the smaller doc_id, null ids last; a very long text makes a block of its
own size; empty tables give no row; ids keep their type; extra columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanledger.llm.blocks import Numbers, first_block, grouped, id_type, pack, unpack
from spanledger.llm.common import BROADCAST_ROWS, release, ship, stage

BEST = 50
#: Terms of documents in a block, terms of items searched at a time, intervals opened at a time.
BLOCK_TERMS, ITEM_TERMS, OPENED = 2_000_000, 1_000_000, 64
#: The constants of the score.
UNIT, TF, LENGTH, MEAN_PART = 1_000_000_000, 1000, 20, 50
#: All that parts terms becomes a space, and A-Z lower case; bytes of other letters stay.
LETTERS = bytes(
    ord(" ") if b < 128 and not chr(b).isalnum() else ord(chr(b).lower()) if b < 128 else b for b in range(256)
)


def terms(text: bytes) -> list[bytes]:
    return text.translate(LETTERS).split()


class Block:
    """Documents and the terms they hold."""

    def __init__(self):
        self.ids: list = []
        self.lengths: list[int] = []
        self.terms = Numbers()
        self.texts: list[np.ndarray] = []
        self.size = 0

    def add(self, doc_id, text: bytes) -> None:
        own = np.array([self.terms[t] for t in terms(text)], "<i4")
        self.ids.append(doc_id)
        self.lengths.append(len(own))
        self.texts.append(own)
        self.size += len(own) + 1

    def rows(self, number: int, id_kind: pa.DataType) -> Iterator[pa.RecordBatch]:
        """One row for the documents, with no term, then one for each term."""
        lengths = np.array(self.lengths, np.int64)
        doc = np.repeat(np.arange(len(lengths), dtype=np.int64), lengths)
        places, of = grouped(np.concatenate(self.texts).astype(np.int64) * len(lengths) + doc)
        times = np.bincount(of, minlength=len(places))
        term, doc = places // max(1, len(lengths)), places % max(1, len(lengths))
        offsets = np.searchsorted(term, np.arange(len(self.terms) + 1))
        n = len(self.terms)
        kinds = [pa.list_(id_kind), pa.list_(pa.int32())]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([number], pa.int64()),
                pa.array([None], pa.binary()),
                pa.array([self.ids], kinds[0]),
                pa.array([lengths], kinds[1]),
                pa.array([None], kinds[1]),
                pa.array([None], kinds[1]),
            ],
            names=NAMES,
        )
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(n, number), pa.int64()),
                pa.array(self.terms.keys_in_order, pa.binary()),
                pa.nulls(n, kinds[0]),
                pa.nulls(n, kinds[1]),
                *[
                    pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(x, pa.int32()))
                    for x in (doc, times)
                ],
            ],
            names=NAMES,
        )


NAMES = ["block", "term", "doc_ids", "lengths", "docs", "times"]


def index(docs: DataFrame) -> DataFrame:
    """The index of all whole texts: block, term, docs (places in the block), times; for each block
    also a row without a term that holds its doc_ids and their lengths in terms."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, block = first_block(), Block()
        for batch in batches:
            for doc_id, text in zip(*batch.columns):
                block.add(doc_id.as_py(), text.as_py() or b"")
                if block.size >= BLOCK_TERMS:
                    yield from block.rows(number, batch.column(0).type)
                    number, block = number + 1, Block()
        if block.ids:
            yield from block.rows(number, batch.column(0).type)

    schema = (
        f"block long, term binary, doc_ids array<{id_type(docs)}>, lengths array<int>, docs array<int>, times array<int>"
    )
    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, schema)


def item_terms(items: DataFrame, column: str = "item_id") -> DataFrame:
    """item (a number for each row of ``items``), item_id, and each distinct term of its text."""
    ship(items.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = first_block()
        for batch in batches:
            rows = []
            for item_id, text in zip(*batch.columns):
                rows += [(number, item_id.as_py(), t) for t in dict.fromkeys(terms(text.as_py() or b""))]
                number += 1
            kinds = (pa.int64(), batch.column(0).type, pa.binary())
            columns = list(zip(*rows)) if rows else [[], [], []]
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, kind) for x, kind in zip(columns, kinds)], names=["item", "item_id", "term"]
            )

    schema = f"item long, item_id {id_type(items, column)}, term binary"
    return items.select(F.col(column).alias("item_id"), F.col("text").cast("binary").alias("text")).mapInArrow(run, schema)


class Postings:
    """The postings of a block for the terms searched, and range maxima over their impacts."""

    def __init__(self, terms: list[int], docs: list[np.ndarray], impacts: list[np.ndarray], n_docs: int):
        """``terms`` are numbers from 0, rising."""
        self.span = n_docs
        sizes = np.array([len(x) for x in docs], np.int64)
        self.keys = np.concatenate([np.int64(t) * n_docs + x for t, x in zip(terms, docs)])
        self.docs = np.concatenate(docs)
        # One more place with impact 0 stands for an empty range.
        self.impact = np.append(np.concatenate(impacts), 0)
        self.none = len(self.keys)
        # maxima[k][i]: where the largest of 2**k impacts from i on lies; lists need not be kept apart,
        # since no range asked for reaches beyond its own.
        self.maxima = [np.arange(self.none + 1, dtype=np.int32)]
        width = 1
        while 2 * width <= int(sizes.max()):
            last = self.maxima[-1]
            left, right = last[: self.none - 2 * width + 1], last[width : self.none - width + 1]
            self.maxima.append(np.where(self.impact[left] >= self.impact[right], left, right))
            width *= 2

    def largest(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Where the largest impact of each range lies; ``none`` for an empty one."""
        out = np.full(begin.shape, self.none, np.int64)
        size = end - begin
        level = np.frexp(np.maximum(size, 1).astype(np.float64))[1] - 1
        for k in np.unique(level[size > 0]).tolist():
            at = np.nonzero((level == k) & (size > 0))
            left = self.maxima[k][begin[at]]
            right = self.maxima[k][end[at] - (1 << k)]
            out[at] = np.where(self.impact[left] >= self.impact[right], left, right)
        return out

    def search(self, terms: np.ndarray, best: int, order: np.ndarray) -> list[tuple[int, int]]:
        """(score, place of the document) of the ``best`` documents by score, then ``order``, scores above 0."""
        base = terms * self.span
        heap: list[tuple[int, int, int, int]] = []
        found: list[tuple[int, int]] = []
        scores: list[int] = []

        def push(low: np.ndarray, high: np.ndarray) -> None:
            begin = np.searchsorted(self.keys, base[None, :] + low[:, None])
            end = np.searchsorted(self.keys, base[None, :] + high[:, None])
            top = self.largest(begin, end)
            impact = self.impact[top]
            bound = impact.sum(axis=1)
            split = self.docs[np.minimum(top[np.arange(len(low)), impact.argmax(axis=1)], self.none - 1)]
            least = scores[0] if len(scores) == best else 1
            for k in np.flatnonzero(bound >= least).tolist():
                heapq.heappush(heap, (-int(bound[k]), int(low[k]), int(high[k]), int(split[k])))

        push(np.array([0]), np.array([self.span]))
        while heap and (len(scores) < best or -heap[0][0] >= scores[0]):
            opened = []
            while heap and len(opened) < OPENED and (len(scores) < best or -heap[0][0] >= scores[0]):
                opened.append(heapq.heappop(heap))
            _, low, high, split = np.array(opened).T
            at = np.searchsorted(self.keys, wanted := base[None, :] + split[:, None])
            at = np.where(self.keys[np.minimum(at, self.none - 1)] == wanted, at, self.none)
            for score, doc in zip(self.impact[at].sum(axis=1).tolist(), split.tolist()):
                found.append((score, doc))
                if len(scores) < best:
                    heapq.heappush(scores, score)
                elif score > scores[0]:
                    heapq.heapreplace(scores, score)
            low, high = np.concatenate([low, split + 1]), np.concatenate([split, high])
            inside = low < high
            push(low[inside], high[inside])
        found.sort(key=lambda x: (-x[0], order[x[1]]))
        return found[:best]


def _id_order(ids: list) -> np.ndarray:
    """The rank of each id, nulls last, of equal ones by place."""
    rank = np.empty(len(ids), np.int64)
    rank[sorted(range(len(ids)), key=lambda k: (ids[k] is None, 0 if ids[k] is None else ids[k], k))] = np.arange(len(ids))
    return rank


def search(index: DataFrame, asked: DataFrame, best: int = BEST) -> DataFrame:
    """item, item_id, rank, doc_id and score of the best documents of each item.

    ``index`` comes from ``index``, ``asked`` from ``item_terms``; both are read several times, so they are
    best stored.
    """
    spark = index.sparkSession
    documents = index.where("term is null").select(F.col("block").alias("of"), "doc_ids", "lengths")
    length = F.explode("lengths").alias("n")
    n_docs, all_terms = documents.select(length).agg(F.count_if(F.col("n") > 0), F.sum("n")).first()
    # Items in parts of about ITEM_TERMS terms each.
    n_parts = max(1, -(-asked.count() // ITEM_TERMS))
    parts = asked.withColumn("part", F.pmod(F.xxhash64("item"), F.lit(n_parts)))
    results = []
    for part in range(n_parts):
        rows = parts.where(F.col("part") == part)
        wanted = stage(rows.select("term").distinct(), "terms")
        few = wanted.count() <= BROADCAST_ROWS
        postings = stage(
            index.where("term is not null").join(F.broadcast(wanted) if few else wanted, "term").drop("doc_ids", "lengths"),
            "postings",
        )
        frequencies = postings.groupBy("term").agg(F.sum(F.size("docs")).alias("df"))
        # Bounded: the distinct terms, and the pairs of item and term, of one part of the items.
        weights = {
            bytes(r.term): math.floor(1000 * math.log((2.0 * n_docs + 2) / (2 * r.df + 1))) for r in frequencies.collect()
        }
        items: dict[int, list[bytes]] = {}
        for r in rows.select("item", "term").collect():
            items.setdefault(r.item, []).append(bytes(r.term))
        known = spark.sparkContext.broadcast((weights, items))
        results.append(_searched(postings, documents, known, n_docs or 0, all_terms or 0, best))
        release(wanted)
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return (
        reduce(DataFrame.union, results)
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= best)
        .join(asked.select("item", "item_id").distinct(), "item")
        .select("item", "item_id", "rank", "doc_id", "score")
    )


def _searched(postings: DataFrame, documents: DataFrame, known, n_docs: int, all_terms: int, best: int) -> DataFrame:
    """The best documents of each block for each item."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        weights, items = known.value
        (block,) = right.to_pylist()
        lengths = np.array(block["lengths"], np.int64)
        mean = 100 - MEAN_PART + MEAN_PART * lengths * n_docs // max(1, all_terms)
        number, docs, impacts = {}, [], []
        for term, places, times in zip(left.column("term"), left.column("docs"), left.column("times")):
            weight = weights[term.as_py()]
            if weight > 0:
                doc, n = (x.values.to_numpy().astype(np.int64) for x in (places, times))
                number[term.as_py()] = len(docs)
                docs.append(doc)
                impacts.append(weight * (UNIT * n // (TF * n + LENGTH * mean[doc])))
        out = []
        if docs:
            held = Postings(list(range(len(docs))), docs, impacts, len(lengths))
            order = _id_order(block["doc_ids"])
            for item, own in items.items():
                here = np.array(sorted(number[t] for t in own if t in number), np.int64)
                if len(here):
                    out += [(item, block["doc_ids"][d], s) for s, d in held.search(here, best, order)]
        columns = list(zip(*out)) if out else [[], [], []]
        kinds = (pa.int64(), right.schema.field("doc_ids").type.value_type, pa.int64())
        return pa.table([pa.array(x, kind) for x, kind in zip(columns, kinds)], names=["item", "doc_id", "score"])

    id_kind = documents.schema["doc_ids"].dataType.elementType.simpleString()
    schema = f"item long, doc_id {id_kind}, score long"
    return postings.groupBy("block").cogroup(documents.groupBy("of")).applyInArrow(run, schema)


def ranked(docs: DataFrame, items: DataFrame, best: int = BEST) -> DataFrame:
    """item_id, rank, doc_id and score of the best documents of every item."""
    built = stage(index(docs), "index")
    asked = stage(item_terms(items), "asked")
    return search(built, asked, best).select("item_id", "rank", "doc_id", "score")

"""SimHash near-dedup by anchor points of a covering code.

Fingerprints within ``distance`` bits of each other are linked.  Their 64 bits
are cut into blocks, so that a linked pair differs in at most ``distance //
blocks`` bits of some block.  The values of a block are covered by the words of
a linear code: every value lies within the covering radius R of an anchor.  Each
distinct fingerprint is replicated to every anchor within R plus the block's
threshold, so the partner of a pair is found at the anchor next to either of
them, and full fingerprints are compared per anchor, next-of against all.

The blocks are two words of the binary Golay code (23 bits, R = 3) and one of a
Hamming code with three free bits (18 bits, R = 1): about 22 rows a fingerprint.
``WIDE`` has more anchors for more fingerprints and about 43 rows for each.

An anchor's rows are compared in pieces by one task and only a forest of its
links leaves it, never all pairs.  Where many fingerprints are next to one
anchor they are dealt out over several tasks, each of which gets all rows
replicated to that anchor.  Copies are one fingerprint before all this.

Defined results: null and empty texts have fingerprint zero and are linked like
any other; repeated rows get equal results; a null id never is a component's
name unless all its ids are null; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanledger.llm.common import Rows, ship, stage
from spanledger.llm.components import components

BITS = 64
SEED = 42
SHINGLE = 4
DISTANCE = 4
#: Shingles whose bits are counted at a time, and rows compared at a time.
COUNT_AT_ONCE = 1 << 14
COMPARE_AT_ONCE = 1 << 20
#: Fingerprints next to one anchor that one task compares with all at that anchor.
NEXT_TO = 20_000


def fingerprint(text: bytes, width: int = SHINGLE) -> int:
    """The SimHash of a text: bit by bit, whether over half of its shingles' hashes have it."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    n = max(1, len(words) - width + 1)
    starts = np.concatenate(([0], ends[:-1] + 1))[:n].tolist()
    ends = ends[-n:].tolist()
    counts = np.zeros(BITS, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, COUNT_AT_ONCE):
        till = min(n, at + COUNT_AT_ONCE)
        hashes = np.array([digest(joined[s:e], SEED) for s, e in zip(starts[at:till], ends[at:till])], "<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * counts > n, bitorder="little")
    return int(bits.view("<u8")[0])


def as_long(bits: int) -> int:
    return bits - (1 << BITS) if bits >> (BITS - 1) else bits


def fingerprints(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """The rows of ``docs`` (doc_id, text and others) with ``fp`` in place of the text."""
    ship(docs.sparkSession)
    at = docs.columns.index("text")
    schema = ", ".join(
        "fp long" if f.name == "text" else f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at)
            fps = [as_long(fingerprint((t.as_py() or "").encode(), width)) for t in texts]
            columns = batch.columns
            columns[at] = pa.array(fps, pa.int64())
            names = ["fp" if n == "text" else n for n in batch.schema.names]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.mapInArrow(run, schema)


class Cover:
    """A linear code over ``bits`` bits as anchors: each value is within ``radius`` of one.

    ``checks`` has the syndrome of each bit.  The anchors near a value are the
    value with those error patterns applied that have the value's syndrome.
    """

    def __init__(self, bits: int, checks: list[int], radius: int, threshold: int):
        self.bits = bits
        patterns: dict[int, list[tuple[int, int]]] = {}
        reach = radius + threshold
        level = [(0, 0, -1)]
        for weight in range(reach + 1):
            for error, syndrome, _ in level:
                patterns.setdefault(syndrome, []).append((weight, error))
            level = [
                (e | 1 << i, s ^ checks[i], i) for e, s, top in level for i in range(top + 1, bits)
            ]
        size = 1 << max(checks).bit_length()
        if len(patterns) != size or any(min(p)[0] > radius for p in patterns.values()):
            raise ValueError("the code does not cover its values within this radius")
        self.width = max(map(len, patterns.values()))
        self.errors = np.full((size, self.width), -1, np.int64)
        for syndrome, found in patterns.items():
            # The nearest anchor comes first: it is the one the value is next to.
            self.errors[syndrome, : len(found)] = [e for _, e in sorted(found)]
        parts = [list(range(at, min(bits, at + 8))) for at in range(0, bits, 8)]
        self.tables = []
        for part in parts:
            table = np.zeros(256, np.int64)
            for byte in range(256):
                for k, bit in enumerate(part):
                    if byte >> k & 1:
                        table[byte] ^= checks[bit]
            self.tables.append(table)

    def anchors(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each value a row of anchors and of whether there is one; the first is next to it."""
        syndromes = np.zeros(len(values), np.int64)
        for k, table in enumerate(self.tables):
            syndromes ^= table[values >> (8 * k) & 255]
        errors = self.errors[syndromes]
        return values[:, None] ^ np.where(errors < 0, 0, errors), errors >= 0


def golay(threshold: int) -> Cover:
    """The perfect binary Golay code: remainders by its generator polynomial are the syndromes."""
    generator, degree = 0b110001110101, 11
    checks, value = [], 1
    for _ in range(23):
        checks.append(value)
        value <<= 1
        if value >> degree & 1:
            value ^= generator
    return Cover(23, checks, 3, threshold)


def hamming(free: int, threshold: int) -> Cover:
    """The perfect Hamming code of 15 bits beside ``free`` bits that anchors keep as they are."""
    return Cover(15 + free, [*range(1, 16), *[0] * free], 1, threshold)


PLAIN = (("golay", 23), ("golay", 23), ("hamming", 18))
WIDE = (("hamming", 21), ("hamming", 21), ("hamming", 22))


def covers(plan: tuple[tuple[str, int], ...], distance: int) -> list[tuple[int, Cover]]:
    """(first bit, code) of each block; by pigeonhole a block has its share of the distance at most."""
    if sum(bits for _, bits in plan) != BITS:
        raise ValueError("the blocks must cover all bits once")
    threshold, at, found = distance // len(plan), 0, []
    for kind, bits in plan:
        found.append((at, golay(threshold) if kind == "golay" else hamming(bits - 15, threshold)))
        at += bits
    return found


def replicate(fps: DataFrame, plan: tuple[tuple[str, int], ...], distance: int) -> DataFrame:
    """(anchor, next, fp): each fingerprint at every anchor within radius plus threshold, block by block."""
    ship(fps.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = covers(plan, distance)
        for batch in batches:
            all_values = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for part in range(0, len(all_values), 1 << 12):
                values = all_values[part : part + (1 << 12)]
                for k, (at, cover) in enumerate(blocks):
                    block = (values.view(np.uint64) >> np.uint64(at)).astype(np.int64) & ((1 << cover.bits) - 1)
                    anchors, there = cover.anchors(block)
                    near = np.zeros_like(there)
                    near[:, 0] = True
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(anchors[there] * len(blocks) + k),
                            pa.array(near[there]),
                            pa.array(np.broadcast_to(values[:, None], there.shape)[there]),
                        ],
                        names=["anchor", "next", "fp"],
                    )

    return fps.select("fp").mapInArrow(run, "anchor long, next boolean, fp long")


def unite(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Labels after the sets of each i and j are joined; a label is the smallest member of its set."""
    while True:
        x, y = label[i], label[j]
        apart = x != y
        if not apart.any():
            return label
        i, j, x, y = i[apart], j[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label != (above := label[label])).any():
            label = above


def forest(fps: np.ndarray, near: np.ndarray, distance: int) -> np.ndarray:
    """Edges that connect what is linked: those next to the anchor against all that reach it.

    One edge from each linked fingerprint to the first of its set, so that a
    cluster leaves as stars, not as pairs.
    """
    bits = fps.view(np.uint64)
    label = np.arange(len(fps))
    home = np.flatnonzero(near)
    step = max(1, COMPARE_AT_ONCE // len(fps))
    for at in range(0, len(home), step):
        rows = home[at : at + step]
        i, j = np.nonzero(np.bitwise_count(bits[rows][:, None] ^ bits[None, :]) <= distance)
        label = unite(label, rows[i], j)
    linked = np.flatnonzero(label != np.arange(len(fps)))
    return np.stack([fps[linked], fps[label[linked]]], axis=1)


def links(fps: DataFrame, plan: tuple[tuple[str, int], ...] = PLAIN, distance: int = DISTANCE) -> DataFrame:
    """(a, b): edges that connect every pair of distinct fingerprints within the distance."""
    ship(fps.sparkSession)
    rows = replicate(fps, plan, distance)
    # Anchors with many fingerprints next to them are dealt out by those; a row that is only
    # within reach goes to each part.
    parts = stage(
        rows.where("next")
        .groupBy("anchor")
        .agg(F.ceil(F.count("*") / NEXT_TO).cast("int").alias("parts"))
        .where("parts > 1")
        .withColumnRenamed("anchor", "of"),
        "parts",
    )
    if parts.isEmpty():
        dealt = rows.select("anchor", F.lit(0).alias("part"), "next", "fp")
    else:
        many = F.coalesce("parts", F.lit(1))
        own = F.pmod(F.xxhash64("fp"), many).cast("int")
        dealt = (
            rows.join(parts, F.col("anchor") == F.col("of"), "left")
            .withColumn("part", F.explode(F.sequence(F.lit(0), many - 1)))
            .select("anchor", "part", (F.col("next") & (F.col("part") == own)).alias("next"), "fp")
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def compare(keep: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
            near, fps = (np.concatenate([k[n] for k in keep]) for n in (0, 1))
            ends = forest(fps, near, distance)
            return pa.RecordBatch.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1])], names=["a", "b"])

        key, keep = None, []
        for batch in batches:
            anchor, part, near, fps = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            cuts = np.flatnonzero((np.diff(anchor) != 0) | (np.diff(part) != 0)) + 1
            for s, e in zip([0, *cuts.tolist()], [*cuts.tolist(), len(anchor)]):
                if s == e:
                    continue
                if (anchor[s], part[s]) != key:
                    if keep:
                        yield compare(keep)
                    key, keep = (anchor[s], part[s]), []
                keep.append((near[s:e].astype(bool), fps[s:e].astype(np.int64)))
        if keep:
            yield compare(keep)

    partitions = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (
        dealt.repartition(partitions, "anchor", "part")
        .sortWithinPartitions("anchor", "part")
        .mapInArrow(run, "a long, b long")
        .distinct()
    )


def classes(rows: DataFrame, plan: tuple[tuple[str, int], ...] = PLAIN, distance: int = DISTANCE) -> DataFrame:
    """(fp, root, component_id) of every distinct fingerprint of ``rows`` (doc_id, fp).

    The root, a fingerprint, tells classes apart.  Their component_ids need not: they are null
    where all ids are, and ids that are repeated give several classes the same.
    """
    groups = stage(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "fingerprints")
    roots = components(links(groups, plan, distance))
    named = groups.join(roots, F.col("fp") == F.col("node"), "left").select(
        "fp", F.coalesce("root", "fp").alias("root"), "least"
    )
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return named.join(least, "root").select("fp", "root", "component_id")


def near_duplicates(
    docs: DataFrame, width: int = SHINGLE, distance: int = DISTANCE, plan: tuple[tuple[str, int], ...] = PLAIN
) -> DataFrame:
    """doc_id, fingerprint and component_id of every document."""
    rows = stage(fingerprints(docs.select(F.col("doc_id").cast("long"), "text"), width), "simhash")
    named = classes(rows, plan, distance).withColumnRenamed("fp", "of")
    return rows.join(named, F.col("fp") == F.col("of")).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def without_near_duplicates(
    docs: DataFrame, width: int = SHINGLE, distance: int = DISTANCE, plan: tuple[tuple[str, int], ...] = PLAIN
) -> DataFrame:
    """One document of each class, that of the smallest id, with its own columns."""
    documents = Rows(docs, "near")
    texts = documents.values(doc_id=F.col("doc.doc_id").cast("long"), text=F.col("doc.text"))
    rows = stage(fingerprints(texts, width), "simhash")
    named = classes(rows, plan, distance).withColumnRenamed("fp", "of")
    tagged = rows.join(named, F.col("fp") == F.col("of"))
    first = tagged.groupBy("root").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row")).alias("first")
    )
    keep = first.select(F.col("first.row").alias("row"))
    return documents.without(rows.select("row").join(keep, "row", "left_anti"))

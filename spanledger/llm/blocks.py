"""Blocks: documents of a task taken together, so that what they share is counted once.

An operator that needs corpus-wide numbers for very many small keys (words, pairs
of tokens) keeps the documents of a block as one row of packed arrays, sends each
distinct key of the block once, and gets one number back for it.  A key that is in
every document is then one row per block, and no text moves.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame

#: Tokens after which a block is closed; a document is never cut.
BLOCK_TOKENS = 2_000_000


class Numbers(dict):
    """Numbers from 0 for whatever is looked up, in the order of ``keys_in_order``."""

    def __init__(self):
        self.keys_in_order: list = []

    def __missing__(self, key):
        self[key] = number = len(self.keys_in_order)
        self.keys_in_order.append(key)
        return number


def first_block() -> int:
    """The number of a task's first block; the next ones follow it."""
    return TaskContext.get().partitionId() << 32


def id_type(docs: DataFrame, column: str = "doc_id") -> str:
    """The type of a table's ids, which every result keeps."""
    return docs.schema[column].dataType.simpleString()


def parts(batch: pa.RecordBatch, column: str, size: int) -> Iterator[pa.RecordBatch]:
    """A batch in slices whose texts have about ``size`` bytes together; a row is never cut."""
    texts = batch.column(column)
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    begin = 0
    while begin < batch.num_rows:
        before = ends[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, before + size, side="right")))
        yield batch.slice(begin, end - begin)
        begin = end


def pack(values: Sequence | np.ndarray, kind: str) -> bytes:
    """An array of numbers, compressed plane by plane: first all lowest bytes, then all next ones."""
    values = np.ascontiguousarray(values, dtype=kind)
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.itemsize).T)
    return zstandard.ZstdCompressor(level=1).compress(planes)


def unpack(data: bytes, kind: str) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(planes.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def pack_steps(values: np.ndarray) -> bytes:
    """Numbers as differences from the one before: small where they are sorted or repeat."""
    return pack(np.diff(values, prepend=0), "<i8")


def unpack_steps(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data, "<i8"))


def expand(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The indices start, start + 1, ... of ranges of these sizes, one range after the other."""
    total = int(sizes.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(sizes)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - sizes), sizes)


def sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The sum of each of the ranges of these sizes, one after the other; empty ranges give 0."""
    out = np.zeros(len(sizes), values.dtype)
    full = np.flatnonzero(sizes)
    if len(full):
        starts = (np.cumsum(sizes) - sizes)[full]
        out[full] = np.add.reduceat(values, starts)
    return out


def distinct(values: np.ndarray) -> np.ndarray:
    """Sorted, each once; sorting is several times faster than np.unique, which hashes first."""
    if not len(values):
        return values
    values = np.sort(values)
    return values[np.concatenate(([True], values[1:] != values[:-1]))]


def placed(keys: np.ndarray) -> np.ndarray:
    """The places of the keys (0 or more) in sorted order, equal ones in their own.

    Where a key and its place fit one number, one sort of these takes the place of an indirect sort.
    """
    n = len(keys)
    bits = max(1, (n - 1).bit_length())
    if not n or int(keys.max()).bit_length() + bits > 62:
        return np.argsort(keys, kind="stable")
    return np.sort(keys << bits | np.arange(n, dtype=np.int64)) & ((1 << bits) - 1)


def grouped(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct keys (0 or more) and which of them each is, as np.unique gives them."""
    order = placed(keys)
    keys = keys[order]
    new = np.concatenate(([True], keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, bool)
    of = np.empty(len(keys), np.int64)
    of[order] = np.cumsum(new) - 1
    return keys[new], of

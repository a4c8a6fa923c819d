"""Alignment of two tokenizers over whole texts, by anchors at white space.

Both tokenizers encode each whole text.  Where a token of either begins with a
space at the same byte, the tokens before it end together: such verified shared
ends are anchors, and cut the text into windows of token ids.  A window is
aligned by its byte ends into groups, and a worker keeps alignments by the tuples
of ids, since windows repeat.  The tokens of a group are linked, each of the one
tokenizer with each of the other.

Neither vocabulary merges over a lone space between other characters (checked
when it is loaded; where it could, whole texts are encoded at once).  So the ids
of a text are those of its chunks, cut before such spaces, and the ids, anchors
and windows of chunks met before are remembered: a chunk's first tokens are space
marked, and its bytes are compared with what its tokens stand for.  New chunks of one
window are aligned many at a time.

How many documents hold an id pair is counted over the corpus: a block of
documents (``blocks``) sends each distinct pair once with its number of
documents, and gets the corpus-wide count back, so a pair that every document
holds is one row a block.  Blocks, counts and results are tables in the shared
folder or shuffles; nothing meets the driver.

Defined results: a text that is null, empty, or that either tokenizer does not
give back byte by byte has no tokens, zeros and an empty digest; equal texts and
repeated rows are documents of their own; a very long text makes a block of its
own size; an empty table gives no row; ids keep their type, null ids stay null;
extra columns are ignored.
"""

from __future__ import annotations

import gc
import hashlib
import json
import os
import re
from array import array
from collections import Counter
from collections.abc import Iterator, Sequence
from functools import lru_cache
from itertools import accumulate, chain, compress

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import Window as Over
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from spanledger.llm.blocks import BLOCK_TOKENS, Numbers, distinct, expand, first_block, id_type, pack, sums, unpack
from spanledger.llm.bpe import byte_symbols
from spanledger.llm.common import BROADCAST_ROWS, ship, stage

#: What a worker remembers, in two generations of chunks (characters of texts and groups) and one of
#: windows (ids).
CHUNK_BYTES, WINDOW_IDS = 12_000_000, 1_000_000
#: Pairs that documents of a block hold, listed at a time.
PART_PAIRS = 1_000_000
#: Bytes of texts that are encoded in one call.
BATCH_BYTES = 1 << 20
#: Chunks that are encoded and aligned at a time, and those encoded as one text.
LEARN_CHUNKS, JOINED_CHUNKS = 30_000, 256

SPACE_MARK = "▁"
#: A lone space that something else follows; Python's white space holds all of the tokenizer's.
CUT = re.compile(rf"(?<=[^ {SPACE_MARK}])(?= \S)")

#: Links of a group up to which they are listed one by one.
FEW_LINKS = 64

#: Groups as text, their number, and as eight bytes each the id pairs, a << 32 | b, and the links
#: of each (none: one each).  Flat values keep the collector of cycles from visiting the memory.
Window = tuple[str, int, bytes, bytes]
#: Tokens of each tokenizer, then as a window.
Chunk = tuple[int, int, str, int, bytes, bytes]


def byte_level_tokens(path: str) -> tuple[Tokenizer, list[bytes], bool]:
    """A byte-level tokenizer that takes special strings for text, the bytes of each id, and
    whether it takes words apart, each with the space before it, and merges within words alone."""
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    back = {s: b for b, s in enumerate(byte_symbols())}
    names = {i: bytes(back[s] for s in token) for token, i in spec["model"]["vocab"].items()}
    words = spec["pre_tokenizer"] or {}
    apart = words.get("type") == "ByteLevel" and words.get("use_regex", True) and not spec["normalizer"]
    return tokenizer, [names.get(i, b"") for i in range(max(names) + 1)], apart


def piece_tokens(path: str) -> tuple[sentencepiece.SentencePieceProcessor, list[bytes]]:
    """A piece tokenizer and the bytes of each id."""
    pieces = sentencepiece.SentencePieceProcessor(model_file=path)
    names = []
    for i in range(pieces.get_piece_size()):
        name = pieces.id_to_piece(i)
        names.append(bytes([int(name[3:5], 16)]) if pieces.is_byte(i) else name.replace(SPACE_MARK, " ").encode())
    return pieces, names


def align(a: tuple[int, ...], b: tuple[int, ...], a_sizes: list[int], b_sizes: list[int]) -> Window:
    """The groups of a window, which are cut where a token of each ends at the same byte."""
    return aligned(a, b, _ends(a, a_sizes), _ends(b, b_sizes))


def _ends(ids: Sequence[int], sizes: list[int]) -> list[int]:
    return list(accumulate(map(sizes.__getitem__, ids)))


def _flat(ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Lists of ids one after the other, and their lengths."""
    counts = np.fromiter(map(len, ids), np.int64, len(ids))
    return np.fromiter(chain.from_iterable(ids), np.int64, int(counts.sum())), counts


def aligned(a: Sequence[int], b: Sequence[int], a_ends: list[int], b_ends: list[int]) -> Window:
    """The same of the tokens and where they end."""
    if len(a) == len(b) == 1:
        return f"{a[0]}|{b[0]}", 1, (a[0] << 32 | b[0]).to_bytes(8, "little"), b""
    many: Counter[int] | None = None
    if a_ends == b_ends:
        pairs = [x << 32 | y for x, y in zip(a, b)]
        groups = [f"{x}|{y}" for x, y in zip(a, b)]
    else:
        groups, pairs, many = _groups(a, b, a_ends, b_ends)
    links = b""
    if many or len(set(pairs)) < len(pairs):
        many = many or Counter()
        many.update(pairs)
        pairs = list(many)
        links = array("q", many.values()).tobytes()
    return ";".join(groups), len(groups), array("q", pairs).tobytes(), links


def _groups(
    a: Sequence[int], b: Sequence[int], a_ends: list[int], b_ends: list[int]
) -> tuple[list[str], list[int], Counter[int] | None]:
    """Groups as text, the pairs of small groups listed, and those of long ones, if any, counted."""
    groups, pairs, many = [], [], None
    i = j = 0
    while i < len(a) and j < len(b):
        to_i, to_j = i + 1, j + 1
        end, other = a_ends[i], b_ends[j]
        while end != other:
            if end < other:
                end = a_ends[to_i]
                to_i += 1
            else:
                other = b_ends[to_j]
                to_j += 1
        if to_i - i == to_j - j == 1:
            groups.append(f"{a[i]}|{b[j]}")
            pairs.append(a[i] << 32 | b[j])
        else:
            left, right = a[i:to_i], b[j:to_j]
            groups.append(f"{','.join([str(x) for x in left])}|{','.join([str(y) for y in right])}")
            if len(left) * len(right) <= FEW_LINKS:
                pairs += [x << 32 | y for x in left for y in right]
            else:
                # A group's links are products, so equal ids of a long one are multiplied, not listed.
                many = many or Counter()
                rights = Counter(right)
                for x, n in Counter(left).items():
                    for y, m in rights.items():
                        many[x << 32 | y] += n * m
        i, j = to_i, to_j
    return groups, pairs, many


class Aligner:
    """Both tokenizers, and what a worker remembers of chunks and windows met so far."""

    def __init__(self, byte_path: str, piece_path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.a, self.a_bytes, words_apart = byte_level_tokens(byte_path)
        self.b, self.b_bytes = piece_tokens(piece_path)
        self.a_sizes, self.b_sizes = (np.array([len(t) for t in ts], np.int64) for ts in (self.a_bytes, self.b_bytes))
        self.a_token, self.b_token = self.a_bytes.__getitem__, self.b_bytes.__getitem__
        self.a_lengths, self.b_lengths = self.a_sizes.tolist(), self.b_sizes.tolist()
        self.a_spaced, self.b_spaced = (np.array([t[:1] == b" " for t in ts]) for ts in (self.a_bytes, self.b_bytes))
        # Every id as it is written with a comma, a bar or a semicolon behind it.
        self.written = [f"{i}{sign}" for i in range(max(len(self.a_bytes), len(self.b_bytes))) for sign in ",|;"]
        self.written_sizes = np.array([len(x) for x in self.written], np.int64)
        # A merge over the border would make a piece with a space behind another character.
        self.cut = CUT.split if words_apart and not any(b" " in t.lstrip(b" ") for t in self.b_bytes) else None
        self.windows: dict[tuple, Window] = {}
        self.window_size = 0
        self.chunks: dict[str, Chunk] = {}
        self.old_chunks: dict[str, Chunk] = {}
        self.chunk_size = 0

    def split(self, text: str) -> list[str]:
        """A space and the text, cut before every lone space that something else follows."""
        if not text:
            return []
        spaced = " " + text
        return self.cut(spaced) if self.cut else [spaced]

    def learn(self, texts: list[list[str]]) -> None:
        """Encode and align the chunks of some texts that are not known yet."""
        self.known(list(dict.fromkeys(chain.from_iterable(texts))))

    def known(self, chunks: list[str]) -> list[Chunk]:
        """Different chunks as remembered; those not known yet are encoded and aligned."""
        found = list(map(self.chunks.get, chunks))
        new = []
        for k in [k for k, chunk in enumerate(found) if chunk is None]:
            if chunk := self.old_chunks.get(chunks[k]):
                found[k] = chunk
                self.remember(chunks[k], chunk)
            else:
                new.append(k)
        for begin in range(0, len(new), LEARN_CHUNKS):
            places = new[begin : begin + LEARN_CHUNKS]
            for k, chunk in zip(places, self.encoded([chunks[k] for k in places])):
                found[k] = chunk
                self.remember(chunks[k], chunk)
        return found

    def encoded(self, chunks: list[str]) -> list[Chunk]:
        """Different chunks encoded and aligned, those of one window and small groups all at once."""
        raws = [c.encode() for c in chunks]
        sizes = np.fromiter(map(len, raws), np.int64, len(raws))
        a, a_counts = self.byte_ids(chunks, sizes)
        second = self.b.encode([c[1:] for c in chunks], num_threads=1)
        b, b_counts = _flat(second)
        # Chunks that may be sound are compared as one; where they differ, one by one.
        sound = (sums(self.a_sizes[a], a_counts) == sizes) & (sums(self.b_sizes[b], b_counts) == sizes)
        sound &= np.fromiter([raw.find(b" ", 1) < 0 for raw in raws], bool, len(raws))
        whole = b"".join(compress(raws, sound))
        left, right = a[np.repeat(sound, a_counts)], b[np.repeat(sound, b_counts)]
        if b"".join(map(self.a_token, left.tolist())) != whole or b"".join(map(self.b_token, right.tolist())) != whole:
            sound[:] = False
        else:
            few, found = self.aligned_together(left, right, a_counts[sound], b_counts[sound])
            sound[sound] = few
        a_from, b_from = np.cumsum(a_counts) - a_counts, np.cumsum(b_counts) - b_counts
        out: list[Chunk] = []
        for k in np.flatnonzero(~sound).tolist():
            x = a[a_from[k] : a_from[k] + a_counts[k]].tolist()
            out.append(self.chunk(raws[k], x, second[k], _ends(x, self.a_lengths), _ends(second[k], self.b_lengths)))
        if not out:
            return found
        together, alone = iter(found if sound.any() else []), iter(out)
        return [next(together) if at_once else next(alone) for at_once in sound.tolist()]

    def byte_ids(self, chunks: list[str], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the byte-level tokenizer, one chunk after the other, and their number in each.

        A text that would be cut into just these chunks has their ids, so many chunks are encoded as one
        text; each of them ends where its bytes do.
        """
        texts: list[str] = []
        for begin in range(0, len(chunks), JOINED_CHUNKS):
            some = chunks[begin : begin + JOINED_CHUNKS]
            joined = "".join(some)
            texts += [joined] if self.cut and self.cut(joined) == some else some
        ids, counts = _flat([x.ids for x in self.a.encode_batch_fast(texts, add_special_tokens=False)])
        if len(texts) == len(chunks):
            return ids, counts
        ends, to = np.cumsum(self.a_sizes[ids]), np.cumsum(sizes)
        last = np.searchsorted(ends, to)
        if last[-1] != len(ids) - 1 or (ends[last] != to).any():
            return _flat([x.ids for x in self.a.encode_batch_fast(chunks, add_special_tokens=False)])
        return ids, np.diff(last, prepend=-1)

    def aligned_together(
        self, a: np.ndarray, b: np.ndarray, a_counts: np.ndarray, b_counts: np.ndarray
    ) -> tuple[np.ndarray, list[Chunk]]:
        """``aligned`` of many windows, given one after the other: which have small groups only, and those as chunks."""
        if not len(a_counts):
            return np.zeros(0, bool), []
        a_ends, b_ends = np.cumsum(self.a_sizes[a]), np.cumsum(self.b_sizes[b])
        ends = np.zeros(int(a_ends[-1]) + 1, np.int8)
        ends[a_ends] += 1
        ends[b_ends] += 1
        # Every window ends with a token of each, so a group lies in one window.
        a_last, b_last = ends[a_ends] == 2, ends[b_ends] == 2
        a_to, b_to = np.flatnonzero(a_last) + 1, np.flatnonzero(b_last) + 1
        a_size, b_size = np.diff(a_to, prepend=0), np.diff(b_to, prepend=0)
        n_groups = np.diff(np.searchsorted(a_to, np.cumsum(a_counts)), prepend=-1)
        n_pairs = a_size * b_size
        few = sums(n_pairs > FEW_LINKS, n_groups) == 0
        if not few.all():
            left, right = np.repeat(few, a_counts), np.repeat(few, b_counts)
            return few, self.aligned_together(a[left], b[right], a_counts[few], b_counts[few])[1]

        # As text: the tokens of a group in order, each with what follows it.
        codes = np.empty(len(a) + len(b), np.int64)
        a_group, b_group = np.cumsum(a_last) - a_last, np.cumsum(b_last) - b_last
        codes[np.arange(len(a)) + (b_to - b_size)[a_group]] = a * 3 + a_last
        codes[np.arange(len(b)) + a_to[b_group]] = b * 3 + 2 * b_last
        text = "".join(map(self.written.__getitem__, codes.tolist()))
        text_to = np.cumsum(sums(self.written_sizes[codes], a_counts + b_counts))

        # Pairs of the groups, sorted in each window, and how often each is there.
        group = np.repeat(np.arange(len(n_pairs)), n_pairs)
        row, column = np.divmod(np.arange(len(group)) - (np.cumsum(n_pairs) - n_pairs)[group], b_size[group])
        x, y = a[(a_to - a_size)[group] + row], b[(b_to - b_size)[group] + column]
        window = np.repeat(np.arange(len(few)), sums(n_pairs, n_groups))
        keys = np.sort((window * len(self.a_sizes) + x) * len(self.b_sizes) + y)
        first = np.flatnonzero(np.diff(keys, prepend=-1))
        links = np.diff(first, append=len(keys))
        window, pair = np.divmod(keys[first], len(self.a_sizes) * len(self.b_sizes))
        x, y = np.divmod(pair, len(self.b_sizes))
        n_distinct = np.bincount(window, minlength=len(few))
        repeated = sums(links > 1, n_distinct).tolist()
        pairs, links = (x << 32 | y).tobytes(), links.tobytes()
        pairs_to = (8 * np.cumsum(n_distinct)).tolist()
        out: list[Chunk] = []
        at = begin = 0
        for n_a, n_b, to, n, end, more in zip(
            a_counts.tolist(), b_counts.tolist(), text_to.tolist(), n_groups.tolist(), pairs_to, repeated
        ):
            out.append((n_a, n_b, text[at : to - 1], n, pairs[begin:end], links[begin:end] if more else b""))
            at, begin = to, end
        return few, out

    def remember(self, text: str, chunk: Chunk) -> None:
        if self.chunk_size > CHUNK_BYTES:
            self.chunks, self.old_chunks, self.chunk_size = {}, self.chunks, 0
        self.chunks[text] = chunk
        self.chunk_size += len(text) + len(chunk[2])

    def chunk(self, raw: bytes, a: list[int], b: list[int], a_ends: list[int], b_ends: list[int]) -> Chunk:
        """Tokens of each, groups as text, number of groups, links; no groups where the bytes differ."""
        if b"".join(map(self.a_token, a)) != raw or b"".join(map(self.b_token, b)) != raw:
            return 0, 0, "", 0, b"", b""
        i, j = self.anchors(a, b) if raw.find(b" ", 1) > 0 else ([0, len(a)], [0, len(b)])
        if len(i) == 2:
            # The only window of a chunk is remembered with the chunk.
            return len(a), len(b), *aligned(a, b, a_ends, b_ends)
        parts = [self.window(tuple(a[i[k] : i[k + 1]]), tuple(b[j[k] : j[k + 1]])) for k in range(len(i) - 1)]
        links: Counter[int] = Counter()
        for _, _, pairs, counts in parts:
            listed = array("q", pairs)
            links.update(dict(zip(listed, array("q", counts))) if counts else listed)
        flat = array("q", links).tobytes(), array("q", links.values()).tobytes()
        return len(a), len(b), ";".join([p[0] for p in parts]), sum([p[1] for p in parts]), *flat

    def anchors(self, a: list[int], b: list[int]) -> tuple[list[int], list[int]]:
        """Where windows begin among the tokens of each, and the ends of both.

        They begin at tokens of both that a space marks, at the same byte: there the tokens before
        them end together.
        """
        a_size, b_size = self.a_sizes[a], self.b_sizes[b]
        a_start, b_start = np.cumsum(a_size) - a_size, np.cumsum(b_size) - b_size
        at = np.intersect1d(a_start[self.a_spaced[a]], b_start[self.b_spaced[b]], assume_unique=True)
        return [*np.searchsorted(a_start, at).tolist(), len(a)], [*np.searchsorted(b_start, at).tolist(), len(b)]

    def window(self, a: tuple[int, ...], b: tuple[int, ...]) -> Window:
        found = self.windows.get((a, b))
        if found is None:
            found = align(a, b, self.a_lengths, self.b_lengths)
            if self.window_size > WINDOW_IDS:
                self.windows, self.window_size = {}, 0
            self.windows[a, b] = found
            self.window_size += len(a) + len(b)
        return found


@lru_cache(1)
def aligner(byte_path: str, piece_path: str) -> Aligner:
    # Memories are large and have no cycles: look for cycles more rarely.
    gc.set_threshold(200_000, 20, 100)
    return Aligner(byte_path, piece_path)


def holders(docs: np.ndarray, chunks: np.ndarray, sizes: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    """How many documents hold each of n pairs: ``docs``, sorted, hold ``chunks``, of ``sizes`` pairs each (``of``).

    Some documents at a time, so that what they hold is never listed for the whole block.
    """
    holding = np.zeros(n, np.int64)
    starts = np.cumsum(sizes) - sizes
    ends = np.cumsum(sizes[chunks])
    begin = 0
    while begin < len(docs):
        before = ends[begin - 1] if begin else 0
        # A document is never cut: its last chunk ends the part.
        last = docs[min(int(np.searchsorted(ends, before + PART_PAIRS)), len(docs) - 1)]
        end = int(np.searchsorted(docs, last, side="right"))
        some = chunks[begin:end]
        own = (docs[begin:end] - docs[begin]) * n
        held = distinct(np.repeat(own, sizes[some]) + of[expand(starts[some], sizes[some])])
        if n:
            holding += np.bincount(held % n, minlength=n)
        begin = end
    return holding


class Block:
    """Aligned documents that share one list of chunks and one list of id pairs."""

    def __init__(self, kit: Aligner):
        self.kit = kit
        self.ids: list = []
        self.digests: list[str] = []
        self.numbers = Numbers()
        self.found: list[Chunk] = []
        self.groups: list[str] = []
        #: Chunks without groups: a text that holds one has no tokens.
        self.spoiling: set[int] = set()
        self.texts: list[np.ndarray] = []
        self.size = 0

    def add(self, doc_id, chunks: list[str]) -> None:
        self.add_all([doc_id], [chunks])

    def add_all(self, ids: list, texts: list[list[str]]) -> None:
        """Documents by their chunks, which are looked up once, and learned where the block has not met them."""
        numbered = [list(map(self.numbers.__getitem__, chunks)) for chunks in texts]
        for chunk in self.kit.known(self.numbers.keys_in_order[len(self.found) :]):
            if not chunk[2]:
                self.spoiling.add(len(self.found))
            self.found.append(chunk)
            self.groups.append(chunk[2])
        for own in numbered:
            if self.spoiling and not self.spoiling.isdisjoint(own):
                own = []
            groups = ";".join(map(self.groups.__getitem__, own))
            self.digests.append(hashlib.sha256(groups.encode()).hexdigest() if own else "")
            self.texts.append(np.array(own, np.int64))
            self.size += len(own)
        self.ids += ids

    def row(self, number: int, id_kind: pa.DataType) -> pa.RecordBatch:
        pairs = np.frombuffer(b"".join([c[4] for c in self.found]), "<i8")
        ones = array("q", [1]).tobytes()
        links = np.frombuffer(b"".join([c[5] or ones * (len(c[4]) >> 3) for c in self.found]), "<i8")
        sizes = np.array([len(c[4]) >> 3 for c in self.found], np.int64)
        known, of = np.unique(pairs, return_inverse=True)
        counts = np.array([len(t) for t in self.texts], np.int64)
        chunks = np.concatenate(self.texts) if self.texts else np.zeros(0, np.int64)
        totals = [
            sums(np.array([c[k] for c in self.found], np.int64)[chunks], counts) for k in (0, 1, 3)
        ]
        # Documents that hold a pair: their distinct chunks, then their distinct pairs.
        docs = np.repeat(np.arange(len(counts), dtype=np.int64), counts)
        held = distinct(docs << 32 | chunks)
        docs, of_chunk = held >> 32, held & 0xFFFFFFFF
        holding = holders(docs, of_chunk, sizes, of, len(known))
        columns = {
            "block": pa.array([number], pa.int64()),
            "doc_ids": pa.array([self.ids], pa.list_(id_kind)),
            "totals": pa.array([pack(np.concatenate(totals), "<i8")], pa.binary()),
            "digests": pa.array([self.digests], pa.list_(pa.string())),
            "n_chunks": pa.array([pack(counts, "<i4")], pa.binary()),
            "chunks": pa.array([pack(chunks, "<i4")], pa.binary()),
            "chunk_sizes": pa.array([pack(sizes, "<i4")], pa.binary()),
            "chunk_pairs": pa.array([pack(of, "<i4")], pa.binary()),
            "chunk_links": pa.array([pack(links, "<i8")], pa.binary()),
            "pairs": pa.array([known], pa.list_(pa.int64())),
            "holding": pa.array([holding], pa.list_(pa.int64())),
        }
        return pa.RecordBatch.from_pydict(columns)


PACKED = "totals binary, digests array<string>, n_chunks binary, chunks binary, chunk_sizes binary, chunk_pairs binary, chunk_links binary"


def aligned_blocks(docs: DataFrame, byte_path: str, piece_path: str) -> DataFrame:
    """Rows of aligned documents with their distinct id pairs and, for each, the documents that hold it."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kit = aligner(byte_path, piece_path)
        number, block = first_block(), Block(kit)
        for batch in batches:
            id_kind = batch.column(0).type
            at = 0
            while at < batch.num_rows:
                ids, texts, size, tokens = [], [], 0, block.size
                while at < batch.num_rows and size < BATCH_BYTES and tokens < BLOCK_TOKENS:
                    text = batch.column(1)[at].as_py() or ""
                    ids.append(batch.column(0)[at].as_py())
                    texts.append(kit.split(text))
                    size += len(text)
                    tokens += len(texts[-1])
                    at += 1
                block.add_all(ids, texts)
                if block.size >= BLOCK_TOKENS:
                    yield block.row(number, id_kind)
                    number, block = number + 1, Block(kit)
        if block.ids:
            yield block.row(number, id_kind)

    schema = f"block long, doc_ids array<{id_type(docs)}>, {PACKED}, pairs array<long>, holding array<long>"
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def pair_counts(blocks: DataFrame) -> DataFrame:
    """pair, the documents corpus-wide that hold it, and whether no pair of its first id has more."""
    counts = (
        blocks.select(F.explode(F.arrays_zip("pairs", "holding")).alias("p"))
        .groupBy(F.col("p.pairs").alias("pair"))
        .agg(F.sum("p.holding").alias("n"))
    )
    # At most as many rows share a first id as the second vocabulary has ids.
    same = Over.partitionBy(F.shiftright("pair", 32))
    return counts.withColumn("best", F.col("n") == F.max("n").over(same))


def alignments(docs: DataFrame, byte_path: str, piece_path: str) -> DataFrame:
    """Tokens, groups and links of every document, with the corpus-wide counts of the linked pairs."""
    blocks = stage(aligned_blocks(docs, byte_path, piece_path), "aligned")
    counts = stage(pair_counts(blocks), "pairs")
    if counts.count() <= BROADCAST_ROWS:
        counts = F.broadcast(counts)
    answers = (
        blocks.select(F.col("block").alias("of"), F.posexplode("pairs").alias("place", "pair"))
        .join(counts, "pair")
        .select("of", "place", "n", "best")
    )
    kind = id_type(docs)

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        (row,) = left.to_pylist()
        order = np.argsort(right.column("place").to_numpy())
        n = right.column("n").to_numpy()[order]
        best = right.column("best").to_numpy(zero_copy_only=False)[order]
        of, links = unpack(row["chunk_pairs"], "<i4"), unpack(row["chunk_links"], "<i8")
        sizes = unpack(row["chunk_sizes"], "<i4")
        per_chunk = [sums(x, sizes) for x in (links, links * best[of], links * n[of])]
        chunks, n_chunks = unpack(row["chunks"], "<i4"), unpack(row["n_chunks"], "<i4")
        per_doc = [sums(x[chunks], n_chunks) for x in per_chunk]
        totals = unpack(row["totals"], "<i8").reshape(3, -1)
        return pa.table(
            {
                "doc_id": pa.array(row["doc_ids"], left.schema.field("doc_ids").type.value_type),
                **{name: totals[k] for k, name in enumerate(("n_a", "n_b", "n_groups"))},
                **{name: per_doc[k] for k, name in enumerate(("n_links", "n_best", "count_sum"))},
                "groups_sha256": pa.array(row["digests"], pa.string()),
            }
        )

    schema = f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    packed = blocks.drop("pairs", "holding")
    return packed.groupBy("block").cogroup(answers.groupBy("of")).applyInArrow(finish, schema)

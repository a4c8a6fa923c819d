"""Language-model scores from an Elias-Fano trie of n-grams over the whole training corpus.

The model interpolates three orders with Dirichlet priors: with c() counted in all
training documents, N their tokens and V their distinct tokens,

    p(w)     = (c(w) + 1) / (N + V + 1)
    p(w|v)   = (c(vw) + PRIOR_2 p(w)) / (c(v) + PRIOR_2)
    p(w|u,v) = (c(uvw) + PRIOR_3 p(w|v)) / (c(uv) + PRIOR_3)

so each is an own part of the n-gram and a weight of its context times the lower
order.  Own parts and weights are kept as logarithms in steps of 1 / STEPS decade.

The trie is cut into shards by the word v before the predicted one.  Below v lie
its successors w and the words u before it, below u and v the successors of both,
each as its place among the successors of v: every level is a monotone sequence in
Elias-Fano form, memory-mapped, and searched by successor search within the context.
A word that takes more than a shard's tokens is dealt over several: its trigrams by
u, its bigrams by w, so no shard grows with the corpus and none needs another's counts.

Documents are taken in blocks (``blocks``).  A block sends its distinct words once
for their corpus-wide counts and numbers, then its distinct n-grams once to their
shards, with how often its training documents hold them; the shard adds these up,
builds its levels and answers the same n-grams, held-out ones included.  A word or
passage that is everywhere is one row a block.  Nothing but three totals meets the
driver.

Defined results: a null text is empty and has the end token only; a null id is
neither held out nor learned from; without a training document all scores are 0;
repeated rows count as documents of their own; a very long text makes a block of its
own size; an empty table gives no row; ids keep their type; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pandas.util import hash_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanledger.llm.blocks import first_block, grouped, id_type, pack, pack_steps, parts, placed, sums, unpack, unpack_steps
from spanledger.llm.common import let_go, release, ship, stage
from spanledger.llm.elias_fano import Mapped, Monotone

HELD_OUT, FOLDS = 2, 7
PRIOR_2, PRIOR_3 = 200.0, 50.0
#: Steps a decade of the stored logarithms, and the stored value of what is not there.
STEPS, NONE = 4096, 65535
#: Tokens of a block, of a shard of the trie, and rows of a bucket of the vocabulary.  A task holds some
#: 200 bytes a token of the first two.
BLOCK_TOKENS, SHARD_TOKENS, BUCKET_ROWS = 1_500_000, 400_000, 400_000
#: Bytes of texts that are cut into words in one call.
PART_BYTES = 2_000_000
#: The end of a text is the word without a letter; the start of a text has number 0.
END, START = b"", 0


def _code(values: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(-np.log10(values) * STEPS), 0, NONE - 1).astype("<u2")


def _value(codes: np.ndarray, missing: float) -> np.ndarray:
    return np.where(codes == NONE, missing, 10.0 ** (codes.astype(np.float64) / -STEPS))


class Block:
    """Documents as numbers of the block's words."""

    def __init__(self):
        self.ids: list = []
        self.flags: list[tuple[bool, bool]] = []
        self.words: list[pa.DictionaryArray] = []
        self.sizes: list[np.ndarray] = []
        self.size = 0

    def add(self, ids: list, held: list[bool], learn: list[bool], texts: pa.StringArray) -> None:
        # Of ASCII these know A-Z and the six white spaces of the contract alone; ends give empty words.
        split = pc.ascii_split_whitespace(pc.ascii_lower(texts))
        words = split.flatten()
        real = pc.greater(pc.binary_length(words), 0)
        sizes = split.value_lengths().to_numpy().astype(np.int64)
        self.sizes.append(sums(real.to_numpy(zero_copy_only=False).astype(np.int64), sizes) + 1)
        self.words.append(words.filter(real).cast(pa.binary()).dictionary_encode())
        self.ids += ids
        self.flags += zip(held, learn)
        self.size += int(self.sizes[-1].sum())

    def row(self, number: int, id_kind: pa.DataType) -> pa.RecordBatch:
        words, sizes = pa.concat_arrays(self.words), np.concatenate(self.sizes)
        # Number 0 is the end, behind the words of each document.
        tokens = np.zeros(self.size, np.int64)
        inside = np.ones(self.size, bool)
        inside[np.cumsum(sizes) - 1] = False
        tokens[inside] = words.indices.to_numpy() + 1
        held, learn = (np.array(x, bool) for x in zip(*self.flags))
        n = len(words.dictionary) + 1
        n_learn = np.bincount(tokens[np.repeat(learn, sizes)], minlength=n)
        columns = {
            "block": pa.array([number], pa.int64()),
            "doc_ids": pa.array([self.ids], pa.list_(id_kind)),
            "held": pa.array([pack(held, "?")], pa.binary()),
            "learn": pa.array([pack(learn, "?")], pa.binary()),
            "sizes": pa.array([pack(sizes, "<i4")], pa.binary()),
            "tokens": pa.array([pack(tokens, "<i4")], pa.binary()),
            "words": joined(pa.concat_arrays([pa.array([END], pa.binary()), words.dictionary]), [0, n]),
            "n_learn": pa.array([pack(n_learn, "<i8")], pa.binary()),
            "n_all": pa.array([pack(np.bincount(tokens, minlength=n), "<i8")], pa.binary()),
            "n_words": pa.array([n], pa.int64()),
            "learned": pa.array([n_learn.sum()], pa.int64()),
            "everywhere": pa.array([self.size], pa.int64()),
        }
        return pa.RecordBatch.from_pydict(columns)


def joined(words: pa.BinaryArray, cuts: Sequence[int]) -> pa.BinaryArray:
    """The words from each cut to the next as one value; no word holds a white space, and none is cut off."""
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), words), b" ")


def token_blocks(docs: DataFrame) -> DataFrame:
    """Blocks of whole texts as token numbers, with the block's words and their counts."""
    ship(docs.sparkSession)
    kind = id_type(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, block = first_block(), Block()
        for batch in batches:
            for part in parts(batch, "text", PART_BYTES):
                block.add(*[part.column(k).to_pylist() for k in range(3)], part.column(3))
                if block.size >= BLOCK_TOKENS:
                    yield block.row(number, batch.column(0).type)
                    number, block = number + 1, Block()
        if block.ids:
            yield block.row(number, batch.column(0).type)

    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS
    flags = [F.coalesce(x, F.lit(False)) for x in (fold == HELD_OUT, fold != HELD_OUT)]
    text = F.coalesce("text", F.lit(""))
    schema = (
        f"block long, doc_ids array<{kind}>, held binary, learn binary, sizes binary, tokens binary, "
        "words binary, n_learn binary, n_all binary, n_words long, learned long, everywhere long"
    )
    return docs.select("doc_id", flags[0].alias("held"), flags[1].alias("learn"), text.alias("text")).mapInArrow(run, schema)


def words_by_bucket(blocks: DataFrame, buckets: int) -> DataFrame:
    """For each block and bucket the block's words that fall into it, their places in the block, and their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield rows(row)

    def rows(row: dict) -> pa.RecordBatch:
        words = pc.split_pattern(pa.array([row["words"]], pa.binary()), " ").flatten()
        hashes = hash_array(words.to_numpy(zero_copy_only=False), categorize=False)
        bucket = (hashes % np.uint64(buckets)).astype(np.int64)
        place = placed(bucket)
        bucket = bucket[place]
        cuts = np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])), len(place))
        columns = [place, *[unpack(row[x], "<i8")[place] for x in ("n_learn", "n_all")]]
        packed = [[pack(x[a:b], "<i8") for a, b in zip(cuts, cuts[1:])] for x in columns]
        return pa.RecordBatch.from_pydict(
            {
                "of": pa.array(np.full(len(cuts) - 1, row["block"])),
                "bucket": pa.array(bucket[cuts[:-1]]),
                "words": joined(words.take(pa.array(place)), cuts),
                **{x: pa.array(y, pa.binary()) for x, y in zip(("place", "n_learn", "n_all"), packed)},
            }
        )

    schema = "of long, bucket long, words binary, place binary, n_learn binary, n_all binary"
    return blocks.select("block", "words", "n_learn", "n_all").mapInArrow(run, schema)


def vocabulary(blocks: DataFrame, buckets: int) -> DataFrame:
    """For each word of a block, packed by block and bucket, its number and counts over the corpus.

    ``distinct``, in one row of a bucket, is how many of its words training documents hold.
    """

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["of"])
        split = [pc.split_pattern(pa.array([r["words"]], pa.binary()), " ").flatten().dictionary_encode() for r in rows]
        ends = np.cumsum([len(x) for x in split])[:-1]
        rank = pa.concat_arrays(split).indices.to_numpy().astype(np.int64)
        of_word = [np.zeros(int(rank.max()) + 1, np.int64) for _ in range(2)]
        for counts, name in zip(of_word, ("n_learn", "n_all")):
            # A block has a word once.
            for at, r in zip(np.split(rank, ends), rows):
                counts[at] += unpack(r[name], "<i8")
        number = 1 + rank * buckets + rows[0]["bucket"]
        columns = {"number": number, "learned": of_word[0][rank], "everywhere": of_word[1][rank]}
        distinct = np.zeros(len(rows), np.int64)
        distinct[0] = np.count_nonzero(of_word[0])
        return pa.table(
            {
                "of": pa.array([r["of"] for r in rows], pa.int64()),
                "place": pa.array([r["place"] for r in rows], pa.binary()),
                **{
                    name: pa.array([pack(x, "<i8") for x in np.split(values, ends)], pa.binary())
                    for name, values in columns.items()
                },
                "distinct": distinct,
            }
        )

    schema = "of long, place binary, number binary, learned binary, everywhere binary, distinct long"
    return words_by_bucket(blocks, buckets).groupBy("bucket").applyInArrow(run, schema)


def numbered_blocks(blocks: DataFrame, words: DataFrame) -> DataFrame:
    """Blocks with the corpus-wide numbers and counts of their words instead of the words."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = right.to_pylist()
        order = np.argsort(np.concatenate([unpack(r["place"], "<i8") for r in rows]))
        kept = left
        for name in ("number", "learned", "everywhere"):
            values = np.concatenate([unpack(r[name], "<i8") for r in rows])[order]
            kept = kept.append_column(name, pa.array([pack(values, "<i8")], pa.binary()))
        return kept

    kind = blocks.schema["doc_ids"].dataType.simpleString()
    schema = (
        f"block long, doc_ids {kind}, held binary, learn binary, sizes binary, tokens binary, "
        "number binary, learned binary, everywhere binary"
    )
    packed = blocks.select("block", "doc_ids", "held", "learn", "sizes", "tokens")
    return packed.groupBy("block").cogroup(words.drop("distinct").groupBy("of")).applyInArrow(run, schema)


class Grams:
    """The distinct n-grams of a block: bigrams (v, w), trigrams (u, v, w), and those of each token."""

    def __init__(self, row: dict):
        self.sizes = unpack(row["sizes"], "<i4")
        self.learn = np.repeat(unpack(row["learn"], "?"), self.sizes)
        self.number, self.learned, self.everywhere = (
            unpack(row[x], "<i8") for x in ("number", "learned", "everywhere")
        )
        # The start comes first, as its number does, then the block's words by their numbers, so that
        # n-grams sorted here are sorted by numbers.  It is a context as often as there are ends.
        order = np.argsort(self.number)
        self.number, self.learned, self.everywhere = (
            np.append(first, values[order])
            for first, values in ((START, self.number), (0, self.learned), (0, self.everywhere))
        )
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(1, len(order) + 1)
        self.tokens = place[unpack(row["tokens"], "<i4")]
        start, end = 0, place[0]
        self.context, self.context_everywhere = self.learned.copy(), self.everywhere.copy()
        self.context[start], self.context_everywhere[start] = self.learned[end], self.everywhere[end]
        begins = np.cumsum(self.sizes) - self.sizes
        before = np.empty_like(self.tokens)
        before[1:] = self.tokens[:-1]
        before[begins] = start
        before_that = np.empty_like(self.tokens)
        before_that[1:] = before[:-1]
        before_that[begins] = start
        base = len(self.number)
        bigrams, self.bigram_of_token = grouped(before * base + self.tokens)
        self.v = bigrams // base
        self.w = bigrams - self.v * base
        trigrams, self.trigram_of_token = grouped(self.bigram_of_token * base + before_that)
        self.bigram = trigrams // base
        self.u = trigrams - self.bigram * base

    def counted(self, of_token: np.ndarray, n: int) -> np.ndarray:
        """How often each n-gram is in the block's training documents."""
        return np.bincount(of_token[self.learn], minlength=n)


def _spread(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """A shard for each pair of numbers."""
    x = a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + b.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((x ^ (x >> np.uint64(32))) % np.uint64(n)).astype(np.int64)


NUMBERS = ("v", "w", "u", "n", "context", "counted")
QUESTION = "of long, shard long, " + ", ".join(f"{x} binary" for x in NUMBERS)


class Asked:
    """The n-grams of a block that are asked for, dealt over shards and in the order they are sent.

    ``place`` is the n-gram's place among the block's trigrams, then among its bigrams, which have
    u = -1 and are asked for only where the word before them is dealt over shards.
    """

    def __init__(self, grams: Grams, shards: int, shard_tokens: int):
        dealt_over = -(-grams.context_everywhere // shard_tokens)[grams.v]
        # A context that no training document holds needs no answer.
        known = grams.context[grams.v] > 0
        three = np.flatnonzero(known[grams.bigram])
        two = np.flatnonzero(known & (dealt_over > 1))
        of = np.concatenate([grams.bigram[three], two])
        u = np.concatenate([grams.number[grams.u[three]], np.full(len(two), -1)])
        v, w = grams.number[grams.v[of]], grams.number[grams.w[of]]
        shard = _spread(v, np.where(u >= 0, u, w) % np.maximum(dealt_over[of], 1), shards)
        # By shard, then v, then w, as the bigrams are, so that v and w are sent as small steps.
        order = placed(shard * len(grams.v) + of)
        self.u, self.v, self.w, self.shard, self.of = u[order], v[order], w[order], shard[order], of[order]
        self.place = np.concatenate([three, len(grams.u) + two])[order]
        self.dealt = dealt_over[self.of] > 1
        ends = np.flatnonzero(np.append(np.diff(self.shard) != 0, True)) + 1 if len(order) else []
        #: shard, and from and to which place its n-grams stand.
        self.ranges = [
            (int(self.shard[begin]), int(begin), int(end)) for begin, end in zip([0, *ends[:-1]], ends)
        ]


def questions(blocks: DataFrame, shards: int, shard_tokens: int) -> DataFrame:
    """The distinct n-grams of each block for each shard, with their counts in its training documents.

    ``context`` and ``counted`` are the distinct v of the row and their counts, negative where they
    are dealt over shards.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield from rows(row["block"], Grams(row))

    def rows(block: int, grams: Grams) -> Iterator[pa.RecordBatch]:
        asked = Asked(grams, shards, shard_tokens)
        n = np.concatenate(
            [
                grams.counted(grams.trigram_of_token, len(grams.u)),
                grams.counted(grams.bigram_of_token, len(grams.v)),
            ]
        )[asked.place]
        counted = grams.context[grams.v[asked.of]]
        counted = np.where(asked.dealt, -counted, counted)
        for shard, begin, end in asked.ranges:
            v = asked.v[begin:end]
            first = begin + np.flatnonzero(np.append(True, v[1:] != v[:-1]))
            columns = {"of": pa.array([block], pa.int64()), "shard": pa.array([shard], pa.int64())}
            packed = (
                pack_steps(v),
                pack_steps(asked.w[begin:end]),
                pack(asked.u[begin:end], "<i8"),
                pack(n[begin:end], "<i4"),
                pack_steps(asked.v[first]),
                pack(counted[first], "<i8"),
            )
            columns |= {name: pa.array([x], pa.binary()) for name, x in zip(NUMBERS, packed)}
            yield pa.RecordBatch.from_pydict(columns)

    return blocks.mapInArrow(run, QUESTION)


class Levels:
    """The n-grams asked of a shard, each once and sorted, as the levels of the trie are: v, then w or u below it, then both.

    ``bigram``, ``context`` and ``trigram`` say which of them each question is, the latter two for the
    questions ``three``, which have a u (others have -1).
    """

    def __init__(self, u: np.ndarray, v: np.ndarray, w: np.ndarray, roots: np.ndarray):
        """``roots`` are all v, sorted."""
        self.roots = roots
        # Questions come in the order of v: what repeats is looked up once.
        new = np.append(True, v[1:] != v[:-1])[: len(v)]
        root = np.searchsorted(roots, v[new])[np.cumsum(new) - 1]
        self.three = np.flatnonzero(u >= 0)
        self.span = int(max(w.max(initial=0), u.max(initial=0))) + 1
        bigrams, self.bigram = grouped(root * self.span + w)
        self.bigram_root = bigrams // self.span
        self.w = bigrams - self.bigram_root * self.span
        contexts, self.context = grouped((root * self.span + u)[self.three])
        self.context_root = contexts // self.span
        self.u = contexts - self.context_root * self.span
        trigrams, self.trigram = grouped(self.context * max(1, len(bigrams)) + self.bigram[self.three])
        self.trigram_context = trigrams // max(1, len(bigrams))
        self.trigram_bigram = trigrams - self.trigram_context * len(bigrams)


def _total(of: np.ndarray, n: np.ndarray, size: int) -> np.ndarray:
    return np.bincount(of, n, size).astype(np.int64)


class Trie:
    """A shard's levels, built of counted n-grams and then searched."""

    def __init__(self, asked: Levels, n: np.ndarray, counted: np.ndarray):
        """``n`` counts each question, ``counted`` each root, negative where it is dealt over shards."""
        count, dealt = np.abs(counted).astype(np.float64), counted < 0
        self.span = asked.span
        # Bigrams: of words dealt over shards those sent as such, of others all that trigrams hold.
        held = _total(asked.bigram, n, len(asked.w))
        alone = n.copy()
        alone[asked.three] = 0
        own = np.where(dealt[asked.bigram_root], _total(asked.bigram, alone, len(asked.w)), held)
        b_seen = held > 0
        b_root, b_n = asked.bigram_root[b_seen], own[b_seen]
        with np.errstate(divide="ignore"):
            b_code = np.where(b_n > 0, _code(np.maximum(b_n, 1) / (count[b_root] + PRIOR_2)), NONE).astype("<u2")
        first = np.searchsorted(b_root, np.arange(len(asked.roots) + 1))
        t_n = _total(asked.trigram, n[asked.three], len(asked.trigram_bigram))
        t_seen = t_n > 0
        t_n, t_bigram, t_context = t_n[t_seen], asked.trigram_bigram[t_seen], asked.trigram_context[t_seen]
        c_n = _total(t_context, t_n, len(asked.u))
        c_seen = c_n > 0
        place = (np.cumsum(b_seen) - 1)[t_bigram] - first[asked.bigram_root[t_bigram]]
        self.width = int(place.max()) + 1 if len(place) else 1
        levels = {
            "roots": asked.roots,
            "firsts": first,
            "successors": b_root * self.span + asked.w[b_seen],
            "contexts": asked.context_root[c_seen] * self.span + asked.u[c_seen],
            # Places follow w, so they rise within a context.
            "deep": (np.cumsum(c_seen) - 1)[t_context] * self.width + place,
        }
        codes = {
            "own_2": b_code,
            "weight_3": _code(PRIOR_3 / (c_n[c_seen] + PRIOR_3)),
            "own_3": _code(t_n / (c_n[t_context] + PRIOR_3)),
        }
        stored = {f"{name}.{k}": x for name, values in levels.items() for k, x in Monotone.arrays(values).items()}
        self.mapped = Mapped(stored | codes)
        self.levels = {name: self.mapped.monotone(name) for name in levels}

    def answer(self, asked: Levels) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Codes of p's own part of order 2, own part of order 3, and weight of the context (u, v)."""
        level, codes = self.levels, self.mapped.arrays
        # Each n-gram is searched once, in the order of its level.
        root = level["roots"].find(asked.roots)
        first = level["firsts"].get(np.maximum(root, 0))
        at = root[asked.bigram_root]
        bigram = level["successors"].find(at * self.span + asked.w, (at >= 0) & (asked.w < self.span))
        place = np.where(bigram >= 0, bigram - first[asked.bigram_root], -1)
        at = root[asked.context_root]
        context = level["contexts"].find(at * self.span + asked.u, (at >= 0) & (asked.u < self.span))
        above, below = context[asked.trigram_context], place[asked.trigram_bigram]
        deep = level["deep"].find(above * self.width + below, (above >= 0) & (below >= 0) & (below < self.width))

        def coded(name: str, at: np.ndarray) -> np.ndarray:
            out = np.full(len(at), NONE, "<u2")
            out[at >= 0] = codes[name][at[at >= 0]]
            return out

        own_3, weight_3 = (np.full(len(asked.bigram), NONE, "<u2") for _ in range(2))
        own_3[asked.three] = coded("own_3", deep)[asked.trigram]
        weight_3[asked.three] = coded("weight_3", context)[asked.context]
        return coded("own_2", bigram)[asked.bigram], own_3, weight_3


ANSWER = "of long, shard long, own_2 binary, own_3 binary, weight_3 binary"


def answers(asked: DataFrame) -> DataFrame:
    """Each shard's levels built and searched: for each block the codes of its n-grams."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        readers = (unpack_steps, unpack_steps, *[lambda x, k=k: unpack(x, k) for k in ("<i8", "<i4")], unpack_steps)
        readers += (lambda x: unpack(x, "<i8"),)
        read = {x: [reader(r[x]) for r in rows] for x, reader in zip(NUMBERS, readers)}
        v, w, u, n, contexts, counted = (np.concatenate(read[x]).astype(np.int64) for x in NUMBERS)
        # A context's count is the same in all rows, and negative where it is dealt: no sort key.
        roots, first = np.unique(contexts, return_index=True)
        levels = Levels(u, v, w, roots)
        found = Trie(levels, n, counted[first]).answer(levels)
        ends = np.cumsum([len(x) for x in read["v"]])[:-1]
        cut = [np.split(x, ends) for x in found]
        return pa.table(
            {
                "of": pa.array([r["of"] for r in rows], pa.int64()),
                "shard": table.column("shard"),
                **{
                    name: pa.array([pack(x, "<u2") for x in parts], pa.binary())
                    for name, parts in zip(("own_2", "own_3", "weight_3"), cut)
                },
            }
        )

    return asked.groupBy("shard").applyInArrow(run, ANSWER)


def scored(
    blocks: DataFrame, found: DataFrame, tokens: int, words: int, shards: int, shard_tokens: int
) -> DataFrame:
    """Scores of the documents of all blocks, of the answers to their n-grams."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        (row,) = left.to_pylist()
        grams = Grams(row)
        three = len(grams.u)
        own_2 = np.full(len(grams.v), NONE, "<u2")
        own_3, weight_3 = np.full(three, NONE, "<u2"), np.full(three, NONE, "<u2")
        asked = Asked(grams, shards, shard_tokens)
        ranges = {shard: slice(begin, end) for shard, begin, end in asked.ranges}
        for answer in right.to_pylist():
            mine = ranges[answer["shard"]]
            place, of = asked.place[mine], asked.of[mine]
            two, three_own, weight = (unpack(answer[x], "<u2") for x in ("own_2", "own_3", "weight_3"))
            trigram = place < three
            at = place[trigram]
            own_3[at], weight_3[at] = three_own[trigram], weight[trigram]
            there = two != NONE
            own_2[of[there]] = two[there]
        single = (grams.learned + 1) / (tokens + words + 1)
        weight_2 = PRIOR_2 / (grams.context[grams.v] + PRIOR_2)
        pair = _value(own_2, 0.0) + weight_2 * single[grams.w]
        triple = np.log10(_value(own_3, 0.0) + _value(weight_3, 1.0) * pair[grams.bigram])
        base = np.log10(single)
        sizes = grams.sizes
        n = len(sizes)
        return pa.table(
            {
                "doc_id": pa.array(row["doc_ids"], left.schema.field("doc_ids").type.value_type),
                "held_out": unpack(row["held"], "?"),
                "n_tokens": sizes.astype(np.int64),
                "n_known": sums((grams.learned[grams.tokens] > 0).astype(np.int64), sizes),
                "train_tokens": np.full(n, tokens),
                "base_score": sums(base[grams.tokens], sizes),
                "score": sums(triple[grams.trigram_of_token], sizes),
            }
        )

    kind = blocks.schema["doc_ids"].dataType.elementType.simpleString()
    schema = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return blocks.groupBy("block").cogroup(found.groupBy("of")).applyInArrow(run, schema)


def lm_scores(docs: DataFrame, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """The model's and the base score of every document, learned from those that are not held out."""
    plain = stage(token_blocks(docs), "tokens")
    total = plain.agg(*[F.sum(x) for x in ("n_words", "learned", "everywhere")]).first()
    rows, tokens, everywhere = (x or 0 for x in total)
    words = stage(vocabulary(plain, max(1, -(-rows // BUCKET_ROWS))), "words")
    distinct = words.agg(F.sum("distinct")).first()[0] or 0
    blocks = stage(numbered_blocks(plain, words), "numbered")
    release(plain, words)
    shards = max(1, -(-everywhere // shard_tokens))
    found = stage(answers(questions(blocks, shards, shard_tokens)), "answers")
    let_go(docs.sparkSession)
    return scored(blocks, found, tokens, distinct, shards, shard_tokens)

"""Cross-tokenizer alignment against a plain version that compares every byte end."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from helpers import EDGE_TEXTS, edge_rows, frame, row

from spanledger.llm import alignment
from spanledger.llm.queries import BYTE_VOCABULARY, PIECE_VOCABULARY

COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def plain(rows):
    """Groups by the set of shared byte ends, links by listing, counts by dictionaries."""
    a, a_bytes, _ = alignment.byte_level_tokens(BYTE_VOCABULARY)
    b, b_bytes = alignment.piece_tokens(PIECE_VOCABULARY)
    texts = []
    for r in rows:
        text = " " + (r["text"] or "")
        left = a.encode(text, add_special_tokens=False).ids
        right = b.encode(text[1:])
        whole = text.encode() if text != " " else None
        if b"".join(a_bytes[i] for i in left) != whole or b"".join(b_bytes[i] for i in right) != whole:
            left, right = [], []

        def ends(ids, names):
            out, at = [], 0
            for i in ids:
                at += len(names[i])
                out.append(at)
            return out

        left_ends, right_ends = ends(left, a_bytes), ends(right, b_bytes)
        groups, start = [], 0
        for cut in sorted(set(left_ends) & set(right_ends)):
            groups.append(
                (
                    [i for i, e in zip(left, left_ends) if start < e <= cut],
                    [i for i, e in zip(right, right_ends) if start < e <= cut],
                )
            )
            start = cut
        texts.append((r["doc_id"], left, right, groups, Counter((x, y) for g in groups for x in g[0] for y in g[1])))
    counts = Counter(pair for t in texts for pair in t[4])
    most = Counter()
    for (x, _), n in counts.items():
        most[x] = max(most[x], n)
    out = []
    for doc_id, left, right, groups, links in texts:
        written = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        out.append(
            (
                doc_id,
                len(left),
                len(right),
                len(groups),
                sum(links.values()),
                sum(n for pair, n in links.items() if counts[pair] == most[pair[0]]),
                sum(n * counts[pair] for pair, n in links.items()),
                hashlib.sha256(written.encode()).hexdigest() if groups else "",
            )
        )
    return out


def ours(spark, rows, extra=False):
    found = alignment.alignments(frame(spark, rows, extra), BYTE_VOCABULARY, PIECE_VOCABULARY)
    return [tuple(r) for r in found.select(*COLUMNS).collect()]


@pytest.mark.parametrize("extra", [False, True])
def test_edge_texts_equal_the_plain_version(spark, extra):
    short = [t if t is None or len(t) < 20_000 else t[:20_000] for t in EDGE_TEXTS]
    odd = ["<s> </s> <unk> <0x41> ▁▁", "<|endoftext|> and <|endoftext|>", "   a    b \n\n\n  c\t\t", "  " * 300, "1234567" * 90]
    rows = [row(k, t) for k, t in enumerate([*short, *odd])] + [r for r in edge_rows() if len(r["text"] or "") < 9000]
    assert sorted(ours(spark, rows, extra), key=repr) == sorted(plain(rows), key=repr)


def test_blocks_of_any_size_give_the_same(spark, monkeypatch):
    rows = [row(k, t) for k, t in enumerate(["the cat sat", "the cat", "a dog, the cat", "the", "dogs and cats"] * 8)]
    assert sorted(ours(spark, rows)) == sorted(plain(rows))
    # One document a block: every count is put together over blocks.
    kit = alignment.aligner(BYTE_VOCABULARY, PIECE_VOCABULARY)
    blocks = []
    for n, r in enumerate(rows):
        block = alignment.Block(kit)
        chunks = kit.split(r["text"])
        kit.learn([chunks])
        block.add(r["doc_id"], chunks)
        blocks.append(block.row(n, pa.int64()))
    single = spark.createDataFrame(pa.Table.from_batches(blocks))
    monkeypatch.setattr(alignment, "aligned_blocks", lambda *_: single)
    assert sorted(ours(spark, rows)) == sorted(plain(rows))


def test_empty_table_and_ids_of_text(spark):
    assert ours(spark, []) == []
    docs = spark.createDataFrame([("x1", "a b"), (None, "a b"), ("x1", None)], "doc_id string, text string")
    found = alignment.alignments(docs, BYTE_VOCABULARY, PIECE_VOCABULARY)
    assert dict(found.dtypes)["doc_id"] == "string"
    assert sorted((r.doc_id or "", r.n_groups, r.count_sum) for r in found.collect()) == [("", 2, 4), ("x1", 0, 0), ("x1", 2, 4)]


def test_windows_are_cut_at_shared_ends_before_spaces():
    kit = alignment.aligner(BYTE_VOCABULARY, PIECE_VOCABULARY)
    text = " unbelievable things,  happening everywhere"
    a, b = kit.a.encode(text, add_special_tokens=False).ids, kit.b.encode(text[1:])
    i, j = kit.anchors(a, b)
    words = [b"".join(kit.a_bytes[t] for t in a[i[k] : i[k + 1]]) for k in range(len(i) - 1)]
    assert words == [b" unbelievable", b" things,", b"  happening", b" everywhere"] or words[2:4] == [b" ", b" happening"]
    assert words == [b"".join(kit.b_bytes[t] for t in b[j[k] : j[k + 1]]) for k in range(len(j) - 1)]


def test_chunks_give_the_ids_of_whole_texts():
    """White space of every kind, runs of it, marks, digits, apostrophes and letters beyond ASCII."""
    kit = alignment.aligner(BYTE_VOCABULARY, PIECE_VOCABULARY)
    assert kit.cut is not None
    rng = random.Random(5)
    parts = [" ", "  ", "   ", "\n", "\t", "\r\n", "\x0b", "\x1c", "\x85", "\xa0", "\u2003", "\u3000", "▁", "a", "It's", "'ll", "12", "3.5", "é", "漢字", "!?", "<s>", "<|endoftext|>", "\x00", "word", "🤯"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(1, 12)))
        chunks = kit.split(text)
        assert "".join(chunks) == " " + text
        whole = kit.a.encode(" " + text, add_special_tokens=False).ids, kit.b.encode(text)
        cut = [x for c in chunks for x in kit.a.encode(c, add_special_tokens=False).ids]
        assert cut == whole[0] and [x for c in chunks for x in kit.b.encode(c[1:])] == whole[1]


def test_forgotten_chunks_are_learned_again(spark, monkeypatch):
    monkeypatch.setattr(alignment, "CHUNK_BYTES", 20)
    monkeypatch.setattr(alignment, "WINDOW_IDS", 5)
    kit = alignment.Aligner(BYTE_VOCABULARY, PIECE_VOCABULARY)
    texts = [f"one two w{k} three" for k in range(40)]
    block = alignment.Block(kit)
    for text in texts:
        kit.learn([kit.split(text)])
    for text in texts:
        block.add(0, kit.split(text))
    assert [d for d in block.digests] == [r[-1] for r in plain([row(0, t) for t in texts])]


def test_only_windows_of_chunks_with_several_are_remembered():
    """A chunk's only window is kept with the chunk; a second copy of each took memory and was never asked for."""
    kit = alignment.Aligner(BYTE_VOCABULARY, PIECE_VOCABULARY)
    kit.learn([kit.split("unbelievable things,  happening everywhere")])
    assert len(kit.chunks) == 3 and sum(len(a) for a, _ in kit.windows) == len(
        kit.a.encode(" things,  happening", add_special_tokens=False).ids
    )
    kit = alignment.Aligner(BYTE_VOCABULARY, PIECE_VOCABULARY)
    kit.learn([kit.split("some plain words")])
    assert len(kit.chunks) == 3 and not kit.windows


def test_a_chunk_that_is_not_given_back_spoils_no_other():
    """Chunks are compared all at once, and one by one where some differ."""
    kit = alignment.Aligner(BYTE_VOCABULARY, PIECE_VOCABULARY)
    good, bad = "plain words here", "a\u2581b \u2163 \ufb01sh"
    kit.learn([kit.split(good), kit.split(bad)])
    block = alignment.Block(kit)
    for k, text in enumerate((good, bad)):
        block.add(k, kit.split(text))
    assert block.digests == [r[-1] for r in plain([row(0, good), row(1, bad)])]


def test_holders_of_pairs_are_counted_in_parts_of_any_size(monkeypatch):
    rng = np.random.default_rng(3)
    sizes = rng.integers(0, 5, 30)
    of = rng.integers(0, 40, sizes.sum())
    held = alignment.distinct(rng.integers(0, 25, 200) << 32 | rng.integers(0, 30, 200))
    docs, chunks = held >> 32, held & 0xFFFFFFFF
    starts = np.cumsum(sizes) - sizes
    pairs = {(d, p) for d, c in zip(docs, chunks) for p in of[starts[c] : starts[c] + sizes[c]].tolist()}
    whole = [sum(p == k for _, p in pairs) for k in range(40)]
    for part in (1, 7, 50, 1_000_000):
        monkeypatch.setattr(alignment, "PART_PAIRS", part)
        assert alignment.holders(docs, chunks, sizes, of, 40).tolist() == whole
    nothing = np.zeros(0, np.int64)
    assert alignment.holders(nothing, nothing, nothing, nothing, 0).tolist() == []


def test_new_chunks_are_encoded_and_aligned_together(monkeypatch):
    """A call for each of them took most of the time."""
    kit = alignment.Aligner(BYTE_VOCABULARY, PIECE_VOCABULARY)
    tokenizer, alone, texts, one = kit.a, [], [], alignment.aligned

    class Seen:
        def encode_batch_fast(self, batch, **options):
            texts.extend(batch)
            return tokenizer.encode_batch_fast(batch, **options)

    kit.a = Seen()
    monkeypatch.setattr(alignment, "aligned", lambda *of: alone.append(of) or one(*of))
    kit.learn([kit.split(" ".join(f"word{k}ing{k * k}," for k in range(2000)))])
    assert len(kit.chunks) == 2000 and len(texts) <= 2000 // alignment.JOINED_CHUNKS + 1 and not alone


@pytest.mark.parametrize("few", [1, 6, 64])
def test_chunks_together_equal_each_alone(monkeypatch, few):
    """Any mixture of sound and unsound chunks, of one and several windows, of small and long groups."""
    monkeypatch.setattr(alignment, "FEW_LINKS", few)
    monkeypatch.setattr(alignment, "JOINED_CHUNKS", 7)
    kit = alignment.Aligner(BYTE_VOCABULARY, PIECE_VOCABULARY)
    rng = random.Random(8)
    parts = ["a", "It's", "unbelievable", "12", "3.5", "é", "漢字", "!?", "<s>", "\x00", "🤯", "=" * 70, "\n", "\xa0", "ﬁ", "▁", "  ", "haha" * 30, "zx" * 9]
    chunks = list({" " + "".join(rng.choice(parts) for _ in range(rng.randint(0, 6))): None for _ in range(1500)})
    sound = [c for c in chunks if not {"▁", " "} & set(c[1:])]

    def counted(chunk):
        pairs = np.frombuffer(chunk[4], "<i8").tolist()
        links = np.frombuffer(chunk[5], "<i8").tolist() or [1] * len(pairs)
        assert len(set(pairs)) == len(pairs) == len(links)
        return *chunk[:4], dict(zip(pairs, links))

    for some in (chunks, sound, sound[:1], chunks[::-1]):
        expected = []
        for c in some:
            a, b = kit.a.encode(c, add_special_tokens=False).ids, kit.b.encode(c[1:])
            a_ends, b_ends = alignment._ends(a, kit.a_lengths), alignment._ends(b, kit.b_lengths)
            expected.append(counted(kit.chunk(c.encode(), a, b, a_ends, b_ends)))
        assert [counted(c) for c in kit.encoded(some)] == expected


def test_chunks_that_a_text_makes_forgotten_are_learned_again_together(monkeypatch):
    """A text with more different chunks than a worker remembers."""
    monkeypatch.setattr(alignment, "CHUNK_BYTES", 2000)
    kit = alignment.Aligner(BYTE_VOCABULARY, PIECE_VOCABULARY)
    text = " ".join(f"w{k}ord" for k in range(1000))
    chunks, calls, encoded = kit.split(text), [], kit.encoded
    kit.learn([chunks])
    assert len(kit.chunks) + len(kit.old_chunks) < 1000
    kit.encoded = lambda some: calls.append(len(some)) or encoded(some)
    block = alignment.Block(kit)
    block.add(0, chunks)
    assert block.digests == [r[-1] for r in plain([row(0, text)])] and len(calls) == 1


def test_chunks_of_a_block_are_looked_up_in_the_memory_once():
    """A worker's memory is asked for the chunks that a block has not met, not for every one of a text."""
    kit = alignment.Aligner(BYTE_VOCABULARY, PIECE_VOCABULARY)
    known, asked = kit.known, []
    kit.known = lambda some: asked.extend(some) or known(some)
    texts = ["the cat sat on the mat, the cat", "a b", "", "the mat, the hat", "the a▁b cat"]
    block = alignment.Block(kit)
    block.add_all([0, 1, 2], [kit.split(t) for t in texts[:3]])
    block.add_all([3, 4], [kit.split(t) for t in texts[3:]])
    assert sorted(asked) == sorted({c for t in texts for c in kit.split(t)})
    assert block.ids == [0, 1, 2, 3, 4] and block.digests == [r[-1] for r in plain([row(k, t) for k, t in enumerate(texts)])]

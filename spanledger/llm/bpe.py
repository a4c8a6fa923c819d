"""BPE encoding and decoding by dynamic programming over prefixes.

For every prefix of a word exactly one last token belongs to the merged result.
A suffix automaton over the vocabulary (in the form of Aho and Corasick, which
follows the longest suffix that begins a token) gives, at each position, the tokens that
end there; the right one is that whose pair with the last token of the prefix
before it is compatible, which means no merge would cross their border.  The
last tokens are stored, and following them back from the end gives the ids.
The work is linear in the length of a word, however long, and equals what
applying merges one by one in rank order gives.

Words repeat, so a worker keeps the finished ids of words it has met, in a new
and an old generation of up to CACHE_CHARS characters each: when the new one is
full it becomes the old one, and what is still in use moves on from there.

Defined results: a null text is an empty text and has no ids; rows, ties and
repeats are independent of each other; an empty table gives no row; ids keep their
type; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from spanledger.llm.blocks import id_type
from spanledger.llm.common import ship

#: Characters of words whose ids a worker remembers in a generation, and compatible pairs.
CACHE_CHARS = 1_500_000
CACHE_PAIRS = 300_000

RESULT = "n_tokens long, ids_sha256 string, decoded_sha256 string"
NEVER = 1 << 60
# Code points that are letters or numbers since a later version of Unicode than the
# library's; it takes them for other symbols.
LATER_LETTERS = (
    "0558 058B-058C 088F 0C5C 0CDC 208F 209D-209F A7CF A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF "
    "10940-10959 10EC5-10EC7 10ED9-10EEE 11B0A 11DB0-11DDB 11DE0-11DE9 11DF1 1246F "
    "12475-1247F 12550-12686 16EBB-16ED3 16FF2-16FF6 187F8-187FF 18CD6-18CDA 18D09-18D20 "
    "18D80-18DF2 18E00-19191 191A0-191D2 1B123-1B128 1B168 1D6A6 1DF1F-1DF24 1DF2B-1DF81 "
    "1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4 "
    "1E6FE-1E6FF 2B73A-2B73F 2B81E 2CEA2-2CEAD 323B0-33479 3D000-3FC3F "
)
# Combining marks that the library does not know to be such, so it never moves
# them or joins them with a letter.
LATER_MARKS = (
    "07FD 0898-089F 08CA-08D3 09FE 0C3C 0D3B-0D3C 0EBA 1715 1ABF-1ACE 1DF6-1DFA A82C "
    "10D24-10D27 10EAB-10EAC 10EFD-10EFF 10F46-10F50 10F82-10F85 11070 1133B 1145E "
    "11839-1183A 11930 1193D-1193E 11943 119E0 11A34 11A47 11A99 11D42 11D44-11D45 11D97 "
    "11F41-11F42 16FF0-16FF1 1E08F 1E130-1E136 1E2AE 1E2EC-1E2EF 1E4EC-1E4EF "
)
# Capital letters that the library makes lower case and this Python does not know yet.
LATER_CAPITALS = {
    0x1C89: 0x1C8A, 0xA7CB: 0x0264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5,
    0xA7DA: 0xA7DB, 0xA7DC: 0x019B,
    **{c: c + 0x20 for c in range(0x10D50, 0x10D66)},
    **{c: c + 0x1B for c in range(0x16EA0, 0x16EB9)},
}
SEPARATORS = re.compile("[\x1c-\x1f]")
SPACES = regex.compile(r"\s+")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


def _inside_class(ranges: str) -> str:
    """Code points and ranges of them as they stand within brackets of a pattern."""
    return "".join("-".join([f"\\U{int(x, 16):08x}" for x in part.split("-")]) for part in ranges.split())


class WordEndBpe:
    """Encoder of a vocabulary file whose words end in a marked symbol."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.end = model["end_of_word_suffix"]
        self.ids: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = {i: t for t, i in [*self.ids.items(), *self.special.items()]}
        self.numbers = {i: str(i) for i in self.names}
        pattern = next(
            p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"
        )
        self.words = regex.compile(pattern).findall
        later = _inside_class(LATER_LETTERS)
        self.later = regex.compile(f"[{later}]").search
        marks = _inside_class(LATER_MARKS)
        self.has_mark, self.marks = regex.compile(f"[{marks}]").search, regex.compile(f"([{marks}])").split
        self.capitals = regex.compile("[" + "".join(map(chr, LATER_CAPITALS)) + "]").search
        own = pattern.replace(r"[^\s\p{L}\p{N}]", rf"(?:[^\s\p{{L}}\p{{N}}]|[{later}])")
        for kind in (r"\p{L}", r"\p{N}"):
            own = own.replace(f"[{kind}]", f"[{kind}--[{later}]]")
        self.words_with_later = regex.compile(own, regex.V1).findall
        self.split_special = regex.compile(
            "(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")"
        ).split
        # Bytes as single characters; the last byte of a word as a character of its own.
        symbols = byte_symbols()
        self.last_symbol = {chr(b): chr(256 + b) for b in range(256)}
        back = {s: chr(b) for b, s in enumerate(symbols)}
        self.rank: dict[tuple[int, int], int] = {}
        self.made_of: dict[int, tuple[int, int]] = {}
        self.made_at: dict[int, int] = {}
        for n, merge in enumerate(model["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            a, b, c = self.ids[left], self.ids[right], self.ids[left + right]
            self.rank.setdefault((a, b), n)
            if c not in self.made_of:
                self.made_of[c], self.made_at[c] = (a, b), n
        self.automaton = ahocorasick.Automaton()
        for token, i in self.ids.items():
            closed = token.endswith(self.end) and token != self.end
            raw = "".join(back[s] for s in (token[: -len(self.end)] if closed else token))
            if closed:
                raw = raw[:-1] + self.last_symbol[raw[-1]]
            if len(raw) == 1 or i in self.made_of:
                self.automaton.add_word(raw, (i, len(raw)))
        self.automaton.make_automaton()
        self.left_spine = lru_cache(None)(lambda t: self._spine(t, 0))
        self.right_spine = lru_cache(None)(lambda t: self._spine(t, 1))
        self.compatible: dict[int, bool] = {}
        self.known: dict[str, tuple[str, str]] = {}
        self.known_words: dict[str, tuple[str, str]] = {}
        self.old: dict[str, tuple[str, str]] = {}
        self.old_words: dict[str, tuple[str, str]] = {}
        self.known_chars = 0

    def _spine(self, token: int, side: int) -> list[tuple[int, int]]:
        """The tokens at one edge of ``token`` while it was merged: each with the rank that ended it."""
        spine, ends = [], NEVER
        while True:
            spine.append((token, ends))
            if token not in self.made_of:
                return spine[::-1]
            ends = self.made_at[token]
            token = self.made_of[token][side]

    def fits(self, left: int, right: int) -> bool:
        """Whether the two tokens stay apart when their text is merged as one.

        At any time the border lies between an edge token of each side.  Their
        merge would cross it if it came before either edge token was taken into
        a larger one; at equal rank the one further left comes first.
        """
        a, b = self.right_spine(left), self.left_spine(right)
        i = j = 0
        answer = True
        while True:
            (x, x_ends), (y, y_ends) = a[i], b[j]
            rank = self.rank.get((x, y))
            if rank is not None and rank < x_ends and rank <= y_ends:
                answer = False
                break
            if x_ends == y_ends == NEVER:
                break
            if x_ends <= y_ends:
                i += 1
            else:
                j += 1
        if len(self.compatible) >= CACHE_PAIRS:
            self.compatible.clear()
        self.compatible[left << 32 | right] = answer
        return answer

    def encode_word(self, word: str) -> list[int]:
        """Ids of one word of the pattern."""
        text = word.encode("utf-8").decode("latin-1")
        text = text[:-1] + self.last_symbol[text[-1]]
        last: list[int | None] = [None] * len(text)
        size = last.copy()
        compatible, fits = self.compatible.get, self.fits
        for end, (token, length) in self.automaton.iter(text):
            if last[end] is None:
                start = end - length
                if start >= 0:
                    before = last[start]
                    if before is None:
                        continue
                    known = compatible(before << 32 | token)
                    if known is False or known is None and not fits(before, token):
                        continue
                last[end] = token
                size[end] = length
        ids, at = [], len(text) - 1
        while at >= 0:
            ids.append(last[at])
            at -= size[at]
        return ids[::-1]

    def remember(self, known: dict[str, tuple[str, str]], text: str, entry: tuple[str, str]) -> None:
        known[text] = entry
        self.known_chars += len(text)
        if self.known_chars > CACHE_CHARS:
            self.old, self.old_words = self.known, self.known_words
            self.known, self.known_words, self.known_chars = {}, {}, 0

    def word(self, word: str) -> tuple[str, str]:
        """Ids and tokens of a word, each joined by a space."""
        if (entry := self.known_words.get(word)) is None:
            if (entry := self.old_words.get(word)) is None:
                ids = self.encode_word(word)
                entry = (" ".join([self.numbers[i] for i in ids]), " ".join([self.names[i] for i in ids]))
            self.remember(self.known_words, word, entry)
        return entry

    def chunk(self, chunk: str) -> tuple[str, str]:
        """The same for text between white space, which no word of the pattern crosses."""
        if (entry := self.known.get(chunk)) is not None:
            return entry
        if (entry := self.old.get(chunk)) is not None:
            self.remember(self.known, chunk, entry)
            return entry
        split = self.words_with_later if not chunk.isascii() and self.later(chunk) else self.words
        words = [self.word(w) for w in split(chunk)]
        entry = words[0] if len(words) == 1 else (
            " ".join([w[0] for w in words]),
            " ".join([w[1] for w in words]),
        )
        self.remember(self.known, chunk, entry)
        return entry

    def normal(self, text: str) -> str:
        """Composed and lower case, letter by letter: no form depends on what surrounds a letter."""
        if text.isascii():
            return text.lower()
        parts = self.marks(text) if self.has_mark(text) else [text]
        text = "".join([unicodedata.normalize("NFC", part) for part in parts]).replace("Σ", "σ").lower()
        return text.translate(LATER_CAPITALS) if self.capitals(text) else text

    def pieces(self, text: str) -> list[tuple[str, str]]:
        """Ids and tokens of each chunk; special tokens written in the text are those tokens."""
        parts = self.split_special(text) if "<|" in text else [text]
        found: list[tuple[str, str]] = []
        for n, part in enumerate(parts):
            if n % 2:
                found.append((str(self.special[part]), part))
                continue
            normal = self.normal(part)
            # str.split() also cuts at four separators that the pattern takes for symbols.
            chunks = SPACES.split(normal) if SEPARATORS.search(normal) else normal.split()
            known, chunk = self.known, self.chunk
            found += [known.get(c) or chunk(c) for c in chunks if c]
        return found

    def encode(self, text: str | None) -> list[int]:
        return [int(i) for ids, _ in self.pieces(text or "") for i in ids.split(" ")]

    def decode(self, ids: list[int]) -> str:
        """The tokens joined by spaces: the vocabulary names no other decoder."""
        return " ".join(self.names[i] for i in ids)


@lru_cache(2)
def encoder(path: str) -> WordEndBpe:
    return WordEndBpe(path)


def digests(bpe: WordEndBpe, text: str | None) -> tuple[int, str, str]:
    """Number of ids, digest of the ids, digest of the decoded text."""
    pieces = bpe.pieces(text or "")
    ids = " ".join([p[0] for p in pieces])
    decoded = " ".join([p[1] for p in pieces])
    return (
        ids.count(" ") + 1 if pieces else 0,
        hashlib.sha256(ids.encode()).hexdigest(),
        hashlib.sha256(decoded.encode()).hexdigest(),
    )


def bpe_digests(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every whole text."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(vocabulary)
        for batch in batches:
            # One text at a time in Python: a batch of long texts stays in Arrow's buffers.
            rows = [digests(bpe, text.as_py()) for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([r[0] for r in rows], pa.int64()),
                    pa.array([r[1] for r in rows], pa.string()),
                    pa.array([r[2] for r in rows], pa.string()),
                ],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type(docs)}, {RESULT}")


def bpe_ids(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id and ids (array of int) of every whole text."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(vocabulary)
        for batch in batches:
            ids = [bpe.encode(text.as_py()) for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"]
            )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type(docs)}, ids array<int>")


def bpe_texts(ids: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id and text decoded from a table of ids."""
    ship(ids.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(vocabulary)
        for batch in batches:
            texts = [bpe.decode(row.as_py() or []) for row in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"]
            )

    return ids.select("doc_id", "ids").mapInArrow(run, f"doc_id {id_type(ids)}, text string")

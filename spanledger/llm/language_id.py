"""Language identification by compression.

Per language a raw-content zstandard dictionary is made of a bounded sample of
labelled texts.  A text is encoded with each dictionary, piece by piece so that
the dictionary and not the text's own past explains it, and the language with
the smallest total wins.  Margins that are narrow for the text's size are
rejected: ``rejected`` is true there, beside the best guess.

The sample takes distinct whole texts of a language, by the digest of the text,
until its dictionary is full, SAMPLE_DOCS at most; the last is cut where the
dictionary is full, at DICTIONARY_BYTES or an equal share of TOTAL_BYTES where
there are many languages.  Texts are drawn, told apart and ranked in Spark, so
what meets the driver is at most SAMPLE_DOCS texts a language, and of each at most
what fits the dictionary, whatever ids or texts repeat.  Predictions read whole
texts in tasks of their own and shuffle nothing.

Every piece is encoded TIMES times over in a row, whatever the length of the text:
alone, what zstandard cannot shorten is stored as it is, at the same size by any
dictionary, and a short text would tell nothing.

Defined results: a text that is null or has no letter is ``und`` with score 0;
of equal sizes the language with more labelled texts wins, then the smaller
name; without any labelled text everything is ``und``; a language whose texts are
all empty is not learned; a null id is neither held out nor learned from; repeated
rows are judged alike and learned once; a very long text is read whole, piece by
piece; an empty table gives no row; ids keep their type; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanledger.llm.blocks import id_type
from spanledger.llm.common import ship

UNKNOWN = "und"
SAMPLE_DOCS = 150
DICTIONARY_BYTES = 110 << 10
#: All dictionaries together; each has what zstandard needs at least.
TOTAL_BYTES, LEAST = 1 << 24, 8
#: Rows of a language that may be looked at where its share is a few texts, so that one of them passes.
FEW = 20
#: Bytes of text encoded at a time, and how often in a row.
PIECE, TIMES = 2048, 6
LEVEL = 6
#: Least lead of the best size over the next, in relation to it and in bytes.
NARROW, NARROW_BYTES = 0.01, 2

RESULT = "held_out boolean, lang_pred string, score double, margin double, rejected boolean"
LETTER = regex.compile(r"\p{L}")


def remainder() -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3


def normal(text: str) -> bytes:
    return " ".join(text.lower().split()).encode()


def dictionaries(labelled: DataFrame) -> list[tuple[str, bytes]]:
    """(language, dictionary) by falling number of labelled texts; ``labelled`` has doc_id, text, lang."""
    counts = (
        labelled.where("lang is not null")
        .groupBy("lang")
        .agg(F.count("*").alias("n"), F.approx_count_distinct("text").alias("n_texts"))
        .orderBy(F.desc("n"), "lang")
        .collect()
    )
    if not counts:
        return []
    size = max(LEAST, min(DICTIONARY_BYTES, TOTAL_BYTES // len(counts)))
    # Of the different texts twice the number wanted pass the threshold, so that hardly ever fewer than wanted do.
    place = F.pmod(F.xxhash64("text"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    shares = labelled.sparkSession.createDataFrame(
        [(row.lang, min(1.0, max(2 * SAMPLE_DOCS, FEW) / max(1, row.n_texts))) for row in counts], "of string, share double"
    )
    ranked = Window.partitionBy("lang").orderBy("place", "digest")
    # Equal texts are combined in each task before they move, and no more of a text than fits does.
    sample = (
        labelled.select("lang", place.alias("place"), "text")
        .where("text is not null")
        .join(F.broadcast(shares), F.col("lang") == F.col("of"))
        .where("place < share")
        .select("lang", "place", F.sha2("text", 256).alias("digest"), F.substring("text", 1, size).alias("text"))
        .groupBy("lang", "place", "digest")
        .agg(F.min("text").alias("text"))
        .withColumn("rank", F.row_number().over(ranked))
        .withColumn("before", F.sum(F.octet_length("text")).over(ranked) - F.octet_length("text"))
        .where((F.col("rank") <= SAMPLE_DOCS) & (F.col("before") < size))
        .select("lang", "rank", "text")
        .collect()
    )
    texts: dict[str, list[bytes]] = {row.lang: [] for row in counts}
    for row in sorted(sample, key=lambda r: r.rank):
        texts[row.lang].append(normal(row.text))
    made = [(lang, b" ".join(found).strip()) for lang, found in texts.items()]
    # A dictionary of a few letters is repeated until it is long enough to be one.
    return [(lang, (text if len(text) >= LEAST else (text + b" ") * LEAST)[:size]) for lang, text in made if text]


class Coders:
    """One encoder per language."""

    def __init__(self, made: list[tuple[str, bytes]]):
        self.names = [lang for lang, _ in made]
        self.coders = [self._coder(content, LEVEL) for _, content in made]

    @staticmethod
    def _coder(content: bytes, level: int) -> zstandard.ZstdCompressor:
        dictionary = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        dictionary.precompute_compress(level=level)
        return zstandard.ZstdCompressor(
            level=level, dict_data=dictionary, write_content_size=False, write_checksum=False, write_dict_id=False
        )

    def sizes(self, text: bytes) -> list[int]:
        pieces = [(b" " + text[at : at + PIECE]) * TIMES for at in range(0, len(text), PIECE)]
        return [sum([len(c.compress(p)) for p in pieces]) for c in self.coders]

    def predict(self, text: str | None) -> tuple[str, float, float, bool]:
        """Language, score, margin, rejected.

        Sizes are code lengths, so the score is the share of the winner's
        likelihood under equal priors, one bit for each byte of difference.
        """
        if not text or not self.names or not LETTER.search(text):
            return UNKNOWN, 0.0, 0.0, True
        sizes = self.sizes(normal(text))
        best = min(range(len(sizes)), key=sizes.__getitem__)
        score = 1.0 / sum(2.0 ** (sizes[best] - size) for size in sizes)
        if len(sizes) == 1:
            return self.names[best], score, 1.0, False
        lead = min(size for k, size in enumerate(sizes) if k != best) - sizes[best]
        margin = lead / max(1, sizes[best])
        return self.names[best], score, margin, margin < NARROW or lead < NARROW_BYTES


def predictions(docs: DataFrame, made: list[tuple[str, bytes]]) -> DataFrame:
    """doc_id, held_out, lang_pred, score, margin and rejected of every whole text."""
    spark = docs.sparkSession
    ship(spark)
    learned = spark.sparkContext.broadcast(made)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coders = Coders(learned.value)
        for batch in batches:
            rows = [coders.predict(text.as_py()) for text in batch.column(2)]
            columns = [list(c) for c in zip(*rows)] if rows else [[], [], [], []]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array(columns[0], pa.string()),
                    pa.array(columns[1], pa.float64()),
                    pa.array(columns[2], pa.float64()),
                    pa.array(columns[3], pa.bool_()),
                ],
                names=["doc_id", "held_out", "lang_pred", "score", "margin", "rejected"],
            )

    held_out = F.coalesce(remainder() == 1, F.lit(False)).alias("held_out")
    return docs.select("doc_id", held_out, "text").mapInArrow(run, f"doc_id {id_type(docs)}, {RESULT}")


def languages(docs: DataFrame) -> DataFrame:
    """Predictions for every document, learned from those that are not held out."""
    return predictions(docs, dictionaries(docs.where(remainder() != 1).select("doc_id", "text", "lang")))

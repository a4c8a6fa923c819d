"""Small tables with nulls, empty and long texts, ties, repeated rows and clashing columns."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"

EDGE_TEXTS = [
    None,
    "",
    " \t\n\x0b\f\r ",
    "word",
    "a b c",
    "a  b\tc",
    "a b   c",
    "É Ü ß ǅ İ ſ K Σ ΑΣ",
    "<|startoftext|>it's<|endoftext|> 12 34 !!!",
    "l" * 5000,
    " ".join(["again and again it is the very same line of words"] * 30),
    "\n".join(["one line that is here twice", "another line", "one line that is here twice"] * 3),
    " ".join(f"w{k}" for k in range(20_000)),
    "🤯 漢字 かな \U0001f468‍\U0001f469 é \x00 \x1c \x85",
]


def row(doc_id, text, lang="en", source="s") -> dict:
    return {"doc_id": doc_id, "text": text, "lang": lang, "source": source, "n_chars": None if text is None else len(text)}


def edge_rows() -> list[dict]:
    """Every edge text, some of them again: as ties under other ids, and as whole rows."""
    rows = [row(3 * k + 1, t, "en" if k % 3 else None, f"s{k % 4}" if k % 5 else None) for k, t in enumerate(EDGE_TEXTS)]
    rows += [row(100 - k, t) for k, t in enumerate(EDGE_TEXTS[:6])]
    rows += [dict(r) for r in rows[:8]]
    return rows + [row(None, "a b c"), row(None, None), row(None, None, None, None)]


def frame(spark: SparkSession, rows: list[dict], extra: bool = False) -> DataFrame:
    """The rows in several partitions; ``extra`` adds columns named like those the operators make."""
    df = spark.createDataFrame([tuple(r[c] for c in ("doc_id", "text", "lang", "source", "n_chars")) for r in rows], SCHEMA)
    if extra:
        for name in ("row", "digest", "fp", "size", "n_words", "kept", "group", "of", "src", "words", "doc", "host"):
            df = df.selectExpr("*", f"'x' as `{name}`")
    return df.repartition(3) if rows else df


def tuples(df: DataFrame, *columns: str) -> list[tuple]:
    return [tuple(r) for r in df.select(*(columns or df.columns)).collect()]


def prose(seed: int, n: int) -> str:
    """n words that hardly any other seed gives in the same order."""
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("aeioubcdfglmnprst") for _ in range(rng.randint(2, 7))) for _ in range(n))

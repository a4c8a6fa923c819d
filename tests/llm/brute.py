"""The contracts once more, row by row and without Spark."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import xxhash
from tokenizers import Tokenizer

from spanledger.llm import quality_rules as Q
from spanledger.llm.queries import ORACLE

WORD = re.compile(r"[^\x20\x09-\x0D]+")
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def exact(rows: list[dict]) -> list[tuple]:
    """doc_id, keep_id, group_size, kept, text_sha256."""
    key = [hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", r["text"] or "").encode()).hexdigest() for r in rows]
    groups = defaultdict(list)
    for k, digest in enumerate(key):
        groups[digest].append(k)
    out = []
    for k, r in enumerate(rows):
        members = groups[key[k]]
        first = min(members, key=lambda m: (rows[m]["doc_id"] is None, rows[m]["doc_id"] or 0, m))
        out.append((r["doc_id"], rows[first]["doc_id"], len(members), k == first, key[k]))
    return out


def fingerprint(text: str | None) -> int:
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def near(rows: list[dict], distance: int = 4) -> list[tuple]:
    """doc_id, fingerprint, component_id by looking at all pairs."""
    prints = [fingerprint(r["text"]) for r in rows]
    label = list(range(len(rows)))

    def root(k: int) -> int:
        while label[k] != k:
            k = label[k]
        return k

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= distance:
                a, b = root(i), root(j)
                label[max(a, b)] = min(a, b)
    ids = defaultdict(list)
    for k, r in enumerate(rows):
        if r["doc_id"] is not None:
            ids[root(k)].append(r["doc_id"])
    return [(r["doc_id"], f"{prints[k]:016x}", min(ids[root(k)], default=None)) for k, r in enumerate(rows)]


def counts(text: str | None) -> dict:
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {i + k for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for k in range(5)}
    lines = [line for line in text.split("\n") if WORD.search(line)]
    return {
        "n_words": len(words),
        "word_chars": sum(map(len, words)),
        "n_symbols": len(re.findall(r"[#*$%&|<>]", text)),
        "n_lines": len(lines),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(covered),
    }


def quality(rows: list[dict]) -> list[tuple]:
    """doc_id, the five counts, base_failed, kept; the estimate as the operator defines it, in numpy."""
    t = pd.DataFrame([counts(r["text"]) for r in rows])
    half_up = lambda x: np.floor(x * Q.UNIT + 0.5)
    x = np.stack(
        [
            half_up(np.log((t.word_chars + 250) / (t.n_words + 50))),
            half_up(np.sqrt(t.n_symbols / (t.word_chars + 200))),
            half_up(np.sqrt(t.n_dup_lines / (t.n_lines + 5))),
            half_up(np.sqrt(t.n_repeat_words / (t.n_words + 50))),
        ],
        axis=1,
    )
    failed = ((t.n_words < 10) | (100 * t.n_repeat_words > 20 * t.n_words)).to_numpy()
    # Each row's groups by language and source, by language, and the table; judged by the first with enough.
    levels = [[(2, r["lang"], r["source"]), (1, r["lang"]), (0,)] for r in rows]
    n = Counter(key for keys, f in zip(levels, failed) if not f for key in keys)
    group = [next((k for k in keys if n[k] >= Q.MIN_ROWS), (0,)) for keys in levels]
    floors = np.array([Q.FLOOR[v] * Q.UNIT for v in Q.VARIABLES])
    kept = ~failed
    for g in set(group):
        of = np.array([k for k, own in enumerate(group) if own == g])
        y = x[[k for k, keys in enumerate(levels) if g in keys and not failed[k]]]
        if not len(y):
            continue
        best = None

        def moments(z):
            cov = Q.CONSISTENT * ((z.T @ z) / len(z) - np.outer(z.mean(0), z.mean(0))) + np.diag(floors**2)
            return z.mean(0), cov

        def distances(z, mean, cov):
            d = z - mean
            return np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d)

        for mean, cov in (moments(y), (np.median(y, 0), np.diag(floors**2))):
            for _ in range(Q.STEPS):
                d = np.floor(np.log1p(distances(y, mean, cov)) * 512 + 0.5)
                mean, cov = moments(y[d <= np.percentile(d, 100 * Q.PART)])
            det = np.linalg.slogdet(cov)[1]
            if best is None or det < best[0] - 1e-9:
                best = det, mean, cov
        kept[of] &= distances(x[of], *best[1:]) <= Q.CUTOFF
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return [
        (r["doc_id"], *map(int, t.loc[k, names]), bool(failed[k]), bool(kept[k])) for k, r in enumerate(rows)
    ]


def sql(name: str, **tables: pd.DataFrame) -> list[tuple]:
    """Rows of a query's SQL over small tables."""
    connection = duckdb.connect()
    for table, frame in tables.items():
        connection.register(f"{table}_rows", frame)
        connection.sql(f"create table {table} as from {table}_rows")
    return connection.sql(ORACLE[name]).fetchall()


def documents(rows: list[dict]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=COLUMNS).astype({"doc_id": "Int64", "n_chars": "Int64"})
    return frame.astype({c: "string" for c in ("text", "lang", "source")})


def mix(rows: list[dict]) -> list[tuple]:
    """doc_id, size, source_size, target, taken."""
    return sql("op9_mixing", documents=documents(rows))


TOKENIZER = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def encode(rows: list[dict]) -> list[tuple]:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 by the library."""
    out = []
    for r in rows:
        ids = TOKENIZER.encode(r["text"] or "", add_special_tokens=False).ids
        decoded = TOKENIZER.decode(ids, skip_special_tokens=False)
        sha = [hashlib.sha256(x.encode()).hexdigest() for x in (" ".join(map(str, ids)), decoded)]
        out.append((r["doc_id"], len(ids), *sha))
    return out


def near_equal(a: list[tuple], b: list[tuple]) -> bool:
    """Whether two tables hold the same rows, doubles to nine places."""
    def key(rows):
        return Counter(
            tuple(round(v, 9) if isinstance(v, float) and not math.isnan(v) else v for v in row) for row in rows
        )

    return key(a) == key(b)

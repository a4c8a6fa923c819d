"""License scans by sentence rules.

A text is cut into sentences; each is normalised (lower case, words and versions
only, comment marks gone) and mapped to the identifiers of the known license
sentences in it, in order; where it holds several, each reaches up to the next.
The sequence of identifiers is then matched against
ordered rules: at each place the first rule whose sentences follow each other,
with at most GAP other sentences between two of them, gives the license and
takes its sentences.  Known sentences that no rule takes are reported too, and the
licenses that a sentence allows in later versions as well.

Whole texts are read once in tasks of their own; nothing is shuffled, so hot
sources and copies make no hot task.  A text without any trigger word holds no
known sentence and is not cut.

Defined results: a null or empty text has no sentences; rows are independent, so
repeated rows and ties get equal results; extra columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanledger.llm.common import ship

#: Unknown sentences allowed between two of a rule.
GAP = 2

#: Single words, as only those are the same in a text and its normal form; each known sentence has one.
TRIGGER = re.compile(
    r"licen[sc]|permission|redistribut|spdx|domain|warrant|liable|endorse|creative"
    r"|(?<![a-z0-9])(?:mpl|cc0?|eupl)(?![a-z0-9])|(?<![a-z0-9])[al]?gpl",
    re.I,
)
END = re.compile(r"(?<!\bv)[.!?](?=\s|\Z)|\n[\s*#/;-]*\n", re.I)
WORDS = re.compile(r"[a-z0-9]+(?:[.+-][a-z0-9]+)*\+?")

#: What follows a version where later ones are allowed too.
LATER = r"(?P<later>\+|(?: of the license)? or (?:at your option )?(?:any )?(?:later|newer))?"
UNDER = r"under (?:the )?(?:terms (?:and conditions )?of (?:the )?)?"
VERSION = r"(?:version |v )?v?(\d\.\d)"

# Sentences of public licenses, normalised, with the license that one names by itself.
SENTENCES = (
    ("spdx", r"spdx-license-identifier ([a-z0-9.+-]+)", "{0}"),
    ("apache-named", r"(?:under (?:the )?(?:terms of the )?|\b(?:or|and) (?:the )?)apache license (?:version )?(2\.0)(?![a-z0-9])", "apache-{0}"),
    ("apache-may-not", r"you may not use this file except in compliance with the license", ""),
    ("apache-obtain", r"you may obtain a copy of the license at", ""),
    ("apache-unless", r"unless required by applicable law or agreed to in writing software distributed under the license", ""),
    ("apache-see", r"see the license for the specific language governing permissions and limitations", ""),
    ("mit-grant", r"permission is hereby granted free of charge to any person obtaining a copy of this software", ""),
    ("mit-notice", r"the above copyright notice and this permission notice shall be included in all copies", ""),
    ("mit-as-is", r"the software is provided as is without warranty of any kind", ""),
    ("mit-liable", r"in no event shall the authors or copyright holders be liable", ""),
    ("mit-named", r"(?:under (?:the )?(?:terms of the )?|^the |\b(?:or|and) (?:the )?)mit license", "mit"),
    ("bsd-use", r"redistribution and use in source and binary forms with or without modification are permitted", ""),
    ("bsd-source", r"redistributions of source code must retain the above copyright notice", ""),
    ("bsd-binary", r"redistributions in binary form must reproduce the above copyright notice", ""),
    ("bsd-endorse", r"neither the name .{0,120} may be used to endorse or promote products", ""),
    ("bsd-as-is", r"this software is provided by .{0,120} as is and any express or implied warranties", ""),
    ("bsd-liable", r"in no event shall .{0,120} be liable for any direct indirect incidental", ""),
    ("bsd-named", r"under (?:the )?(?:terms of the )?(?:(2|3)-clause )?bsd(?:-| )(2|3)?(?:-clause )?license", "bsd-{0}{1}-clause"),
    ("lgpl-free", r"redistribute it and or modify it under the terms of the gnu lesser general public license .{0,80}version (\d(?:\.\d)?)" + LATER, "lgpl-{0}"),
    ("agpl-free", r"redistribute it and or modify it under the terms of the gnu affero general public license .{0,80}version (\d(?:\.\d)?)" + LATER, "agpl-{0}"),
    ("gpl-free", r"redistribute it and or modify it under the terms of the gnu general public license .{0,80}version (\d(?:\.\d)?)" + LATER, "gpl-{0}"),
    ("gpl-hope", r"distributed in the hope that it will be useful but without any warranty", ""),
    ("gpl-received", r"you should have received a copy of the gnu (?:lesser |affero )?general public license", ""),
    ("lgpl-named", r"under the (?:terms of the )?gnu lesser general public license (?:version |v)(\d(?:\.\d)?)" + LATER, "lgpl-{0}"),
    ("agpl-named", r"under the (?:terms of the )?gnu affero general public license (?:version |v)(\d(?:\.\d)?)" + LATER, "agpl-{0}"),
    ("gpl-named", r"under the (?:terms of the )?gnu general public license (?:version |v)(\d(?:\.\d)?)" + LATER, "gpl-{0}"),
    ("mpl-subject", r"subject to the terms of the mozilla public license v (\d\.\d)", "mpl-{0}"),
    ("mpl-obtain", r"if a copy of the mpl was not distributed with this file you can obtain one", ""),
    ("isc-grant", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ""),
    ("isc-as-is", r"the software is provided as is and the author disclaims all warranties", ""),
    ("cc-named", r"under (?:a |the )?(?:cc|creative commons) (by(?:-nc)?(?:-sa|-nd)?) (\d\.\d)", "cc-{0}-{1}"),
    ("unlicense", r"this is free and unencumbered software released into the public domain", "unlicense"),
    ("public-domain", r"(?:dedicated|released|placed) (?:to|into|in) the public domain", "public-domain"),
    ("gpl-short", r"\b(?:" + UNDER + r"(?:gnu )?|gnu )([al]?gpl)(?: version |-v| v|-| |v)?(\d(?:\.\d)?)(?:-only)?" + LATER, "{0}-{1}"),
    ("license-field", r"^license (mit|isc|zlib|0bsd|unlicense|apache-2\.0|bsl-1\.0|epl-[12]\.0|eupl-1\.[12]|mpl-[12]\.[01]|cc0-1\.0|cc-by(?:-nc)?(?:-sa|-nd)?-\d\.\d|bsd-[23]-clause|[al]?gpl-\d(?:\.\d)?(?:-only|-or-later|\+)?)(?=$| copyright| author| version)", "{0}"),
    ("isc-named", UNDER + r"isc license", "isc"),
    ("zlib-named", UNDER + r"zlib(?: libpng)? license", "zlib"),
    ("zlib-as-is", r"this software is provided as-is without any express or implied warranty", ""),
    ("zlib-grant", r"permission is granted to anyone to use this software for any purpose", ""),
    ("boost-named", UNDER + r"boost software license " + VERSION, "bsl-{0}"),
    ("boost-grant", r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", "bsl-1.0"),
    ("epl-named", UNDER + r"eclipse public license " + VERSION, "epl-{0}"),
    ("eupl-named", UNDER + r"(?:european union public license|eupl) " + VERSION, "eupl-{0}"),
    ("mpl-named", UNDER + r"mozilla public license " + VERSION, "mpl-{0}"),
    ("cc-by-long", r"creative commons attribution (\d\.\d)", "cc-by-{0}"),
    ("cc-by-sa-long", r"creative commons attribution[ -]share-?alike (\d\.\d)", "cc-by-sa-{0}"),
    ("cc-by-nd-long", r"creative commons attribution[ -]no-?deriv(?:ative)?s (\d\.\d)", "cc-by-nd-{0}"),
    ("cc-by-nc-long", r"creative commons attribution[ -]non-?commercial (\d\.\d)", "cc-by-nc-{0}"),
    ("cc-by-nc-sa-long", r"creative commons attribution[ -]non-?commercial[ -]share-?alike (\d\.\d)", "cc-by-nc-sa-{0}"),
    ("cc-by-nc-nd-long", r"creative commons attribution[ -]non-?commercial[ -]no-?deriv(?:ative)?s (\d\.\d)", "cc-by-nc-nd-{0}"),
    ("cc0-named", r"cc0[ -](1\.0)", "cc0-{0}"),
    ("cc0-long", r"creative commons zero v?(1\.0)", "cc0-{0}"),
)

# Rules in order; a rule without a license takes the one that its sentences name.
RULES = (
    (("mit-grant", "mit-notice", "mit-as-is", "mit-liable"), "mit"),
    (("mit-grant", "mit-notice", "mit-as-is"), "mit"),
    (("mit-grant", "mit-notice"), "mit"),
    (("bsd-use", "bsd-source", "bsd-binary", "bsd-endorse", "bsd-as-is", "bsd-liable"), "bsd-3-clause"),
    (("bsd-use", "bsd-source", "bsd-binary", "bsd-endorse"), "bsd-3-clause"),
    (("bsd-use", "bsd-source", "bsd-binary", "bsd-as-is", "bsd-liable"), "bsd-2-clause"),
    (("bsd-use", "bsd-source", "bsd-binary"), "bsd-2-clause"),
    (("apache-named", "apache-may-not", "apache-obtain", "apache-unless", "apache-see"), None),
    (("apache-named", "apache-may-not"), None),
    (("lgpl-free", "gpl-hope", "gpl-received"), None),
    (("agpl-free", "gpl-hope", "gpl-received"), None),
    (("gpl-free", "gpl-hope", "gpl-received"), None),
    (("mpl-subject", "mpl-obtain"), None),
    (("isc-grant", "isc-as-is"), "isc"),
    (("zlib-as-is", "zlib-grant"), "zlib"),
    *(((name,), None) for name, _, names in SENTENCES if names),
)

PATTERNS = tuple((name, re.compile(rf"(?<![a-z0-9]){pattern}(?![a-z0-9])" if pattern[0] != "(" else pattern), names) for name, pattern, names in SENTENCES)

RESULT = "doc_id long, n_sentences long, sentences string, licenses string, spans string, unmatched string, or_later string"


class Known(NamedTuple):
    """A known sentence of a text: which of its sentences it is, where, the license it names, and whether in later versions too."""

    name: str
    number: int
    start: int
    end: int
    names: str
    later: bool


def lowered(piece: str) -> str:
    """``piece`` in lower case, as long as it is: letters that grow would move what follows."""
    lower = piece.lower()
    return lower if len(lower) == len(piece) else "".join(c.lower()[0] for c in piece)


def normal(sentence: str) -> str:
    return " ".join(WORDS.findall(lowered(sentence).replace("licence", "license")))


def matches(words: str) -> list[tuple[int, str, re.Match[str], str]]:
    """(place, name, match, license) of known sentences, in order; of those that overlap the first of the table counts."""
    found: list[tuple[int, str, re.Match[str], str]] = []
    for name, pattern, names in PATTERNS:
        for match in pattern.finditer(words):
            if all(match.end() <= m.start() or m.end() <= match.start() for _, _, m, _ in found):
                # A license named without its number of clauses is its family.
                named = names.format(*[g or "" for g in match.groups()]).replace("--clause", "")
                found.append((match.start(), name, match, named))
    return sorted(found, key=lambda m: m[0])


def places(piece: str) -> list[tuple[int, int, int]]:
    """(place in the normal sentence, start, end) of each word of ``piece``."""
    out, at = [], 0
    for m in WORDS.finditer(lowered(piece)):
        out.append((at, m.start(), m.end()))
        at += m.end() - m.start() + 1
    return out


def expression(piece: str, words: str, where: list[tuple[int, int, int]], match: re.Match[str]) -> list[str]:
    """The further licenses of the SPDX expression that begins with ``match``, up to its line's end."""
    k = bisect_left(where, (match.start(1),))
    others: list[str] = []
    while k + 2 < len(where) and "\n" not in piece[where[k][1] : where[k + 2][2]]:
        joint, name = (words[at : at + end - start] for at, start, end in where[k + 1 : k + 3])
        if joint not in ("or", "and", "with"):
            break
        # What follows "with" is an exception, not a license.
        if joint != "with":
            others.append(name)
        k += 2
    return others


def or_later(match: re.Match[str]) -> bool:
    return bool(match.groupdict().get("later"))


def known_sentences(text: str) -> list[Known]:
    if not TRIGGER.search(text):
        return []
    found, at, number = [], 0, 0
    for end in [*(m.end() for m in END.finditer(text)), len(text)]:
        piece = text[at:end]
        start = at + len(piece) - len(piece.lstrip())
        at = end
        if not any(c.isalpha() for c in piece):
            continue
        number += 1
        if not TRIGGER.search(piece):
            continue
        words, piece = normal(piece), piece.strip()
        here = matches(words)
        if len(here) == 1 and here[0][1] != "spdx":
            _, name, match, named = here[0]
            found.append(Known(name, number, start, start + len(piece), named, or_later(match)))
        elif here:
            where = places(piece)
            starts = [0, *(where[min(bisect_left(where, (m[0],)), len(where) - 1)][1] for m in here[1:])]
            for k, (_, name, match, named) in enumerate(here):
                ends = len(piece[: starts[k + 1]].rstrip()) if k + 1 < len(here) else len(piece)
                all_named = [named, *(expression(piece, words, where, match) if name == "spdx" else ())]
                found += [Known(name, number, start + starts[k], start + ends, n, or_later(match)) for n in all_named]
    return found


def licenses_of(known: list[Known]) -> tuple[list[tuple[str, int, int, bool]], list[Known]]:
    """(license, start, end, or later) by the rules, and the sentences that none takes."""
    found, left, at = [], [], 0
    while at < len(known):
        for names, license_ in RULES:
            taken = known[at : at + len(names)]
            near = all(b.number - a.number <= GAP + 1 for a, b in zip(taken, taken[1:]))
            if near and tuple(k.name for k in taken) == names:
                own = license_ or next(k.names for k in taken if k.names)
                found.append((own, taken[0].start, taken[-1].end, any(k.later for k in taken)))
                at += len(names)
                break
        else:
            left.append(known[at])
            at += 1
    return found, left


def scanned(text: str | None) -> tuple[int, str, str, str, str, str]:
    known = known_sentences(text or "")
    found, left = licenses_of(known)
    return (
        len(known),
        ",".join(k.name for k in known),
        ",".join(dict.fromkeys(f[0] for f in found)),
        ",".join(f"{name}:{start}:{end}" for name, start, end, _ in found),
        ",".join(k.name for k in left),
        ",".join(dict.fromkeys(name for name, _, _, later in found if later)),
    )


def licenses(docs: DataFrame) -> DataFrame:
    """doc_id, known sentences, licenses with their spans (code points), sentences without a rule, and licenses also in later versions."""
    ship(docs.sparkSession)
    names = ("n_sentences", "sentences", "licenses", "spans", "unmatched", "or_later")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [scanned(text.as_py()) for text in batch.column(1)]
            columns = [list(c) for c in zip(*rows)] if rows else [[] for _ in names]
            kinds = [pa.int64(), *[pa.string()] * 5]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds)]], names=["doc_id", *names]
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, RESULT)

"""License scans: whole licenses, named ones, order and gaps, and the given documents."""

from __future__ import annotations

import random
import re

import brute
import pytest
from helpers import edge_rows, frame, row, tuples

from spanledger.llm import license_scan

MIT = """ * Permission is hereby granted, free of charge, to any person obtaining a copy
 * of this software and associated documentation files (the "Software"), to deal.
 * The above copyright notice and this permission notice shall be included in
 * all copies or substantial portions.
 * THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND. IN NO EVENT SHALL THE
 * AUTHORS OR COPYRIGHT HOLDERS BE LIABLE for it."""
BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided:
1. Redistributions of source code must retain the above copyright notice.
2. Redistributions in binary form must reproduce the above copyright notice.
"""
ENDORSE = "3. Neither the name of X nor of its contributors may be used to endorse or promote products."
GPL = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
    "License as published by the Free Software Foundation, either version 2 of the License. This program is distributed "
    "in the hope that it will be useful, but WITHOUT ANY WARRANTY. You should have received a copy of the GNU General "
    "Public License along with it."
)
CASES = [
    ("text before it\nLicensed under the Apache License, Version 2.0.", "apache-2.0"),
    ("Licensed under the Apache Licence, version 2.0", "apache-2.0"),
    ("This work is licensed under the GNU General Public License, version 3.", "gpl-3"),
    ("Licensed under CC BY-NC 4.0.", "cc-by-nc-4.0"),
    ("Released under the MIT License.", "mit"),
    ("under the 3-clause BSD license", "bsd-3-clause"),
    ("Distributed under the BSD 2-Clause License", "bsd-2-clause"),
    ("Distributed under the BSD License", "bsd"),
    ("// SPDX-License-Identifier: LGPL-2.1+\n", "lgpl-2.1+"),
    (MIT, "mit"),
    (BSD, "bsd-2-clause"),
    (BSD + ENDORSE, "bsd-3-clause"),
    (GPL, "gpl-2"),
    (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was "
        "not distributed with this file, You can obtain one at x.",
        "mpl-2.0",
    ),
    (f"{MIT}\n\n{BSD}\n\nReleased under the MIT License.", "mit,bsd-2-clause"),
    ("The licensed driver had permission to park. No warranty.", ""),
    ("You may obtain a copy of the License at x. Nothing else.", ""),
]


@pytest.mark.parametrize(("text", "found"), CASES)
def test_licenses_of_texts(text, found):
    assert license_scan.scanned(text)[2] == found


def test_rules_hold_in_order_and_within_the_gap():
    first, *rest = BSD.strip().split("\n")
    swapped = "\n".join([rest[0], first, rest[1]])
    assert license_scan.scanned(swapped)[2] == ""
    assert license_scan.scanned(swapped)[4] == "bsd-source,bsd-use,bsd-binary"
    for others, found in ((license_scan.GAP, "bsd-2-clause"), (license_scan.GAP + 1, "")):
        spread = " ".join([first + " x.", "Some other sentence. " * others, *rest])
        assert license_scan.scanned(spread)[2] == found


def test_every_known_sentence_is_in_a_rule_or_reported():
    names = [name for name, _, _ in license_scan.SENTENCES]
    used = {n for rule, _ in license_scan.RULES for n in rule}
    assert len(set(names)) == len(names) and used <= set(names)
    for rule, license_ in license_scan.RULES:
        named = [n for name, _, n in license_scan.SENTENCES if name in rule and n]
        assert license_ or len(named) == 1


def test_spans_are_code_points_of_the_sentences():
    text = "é漢🤯 before.  Licensed under CC BY-NC 4.0. After"
    spans = license_scan.scanned(text)[3]
    name, start, end = spans.split(":")
    assert (name, text[int(start) : int(end)]) == ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0.")


APACHE = """/*
 * Licensed under the Apache License, Version 2.0 (the "License");
 * you may not use this file except in compliance with the License.
 * You may obtain a copy of the License at
 *
 *     http://www.apache.org/licenses/LICENSE-2.0
 *
 * Unless required by applicable law or agreed to in writing, software
 * distributed under the License is distributed on an "AS IS" BASIS,
 * WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
 * See the License for the specific language governing permissions and
 * limitations under the License.
 */"""
VERBATIM_BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:
    * Redistributions of source code must retain the above copyright
      notice, this list of conditions and the following disclaimer.
    * Redistributions in binary form must reproduce the above copyright
      notice, this list of conditions and the following disclaimer in the
      documentation and/or other materials provided with the distribution.
    * Neither the name of the X nor the names of its contributors may be used to
      endorse or promote products derived from this software without specific prior written permission.
"""
VERBATIM_GPL = (
    "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public "
    "License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any "
    "later version."
)


@pytest.mark.parametrize(
    ("text", "names", "found"),
    [
        (APACHE, "apache-named,apache-may-not,apache-obtain,apache-unless,apache-see", "apache-2.0"),
        (VERBATIM_BSD, "bsd-use,bsd-source,bsd-binary,bsd-endorse", "bsd-3-clause"),
        (VERBATIM_GPL, "gpl-free", "gpl-2"),
        ("// SPDX-License-Identifier: (MIT OR Apache-2.0)\nor that", "spdx,spdx", "mit,apache-2.0"),
        ("SPDX-License-Identifier: GPL-2.0 WITH Linux-syscall-note AND ISC", "spdx,spdx", "gpl-2.0,isc"),
        ("# SPDX-License-Identifier: MIT\n# SPDX-License-Identifier: ISC\n", "spdx,spdx", "mit,isc"),
        ("under the MIT License and under the Apache License, Version 2.0", "mit-named,apache-named", "mit,apache-2.0"),
        (
            "Licensed under the Apache License, Version 2.0 <LICENSE-APACHE or http://www.apache.org/licenses/LICENSE-2.0>"
            " or the MIT license <LICENSE-MIT>, at your option.",
            "apache-named,mit-named",
            "apache-2.0,mit",
        ),
    ],
)
def test_each_known_sentence_of_a_piece_counts(text, names, found):
    _, sentences, licenses, _, left, _ = license_scan.scanned(text)
    assert (sentences, licenses, left) == (names, found, "")


def test_several_licenses_of_a_sentence_have_spans_of_their_own():
    text = "İ x. Eitİher under the MIT License; or under the Apache License, Version 2.0. After"
    spans = [s.split(":") for s in license_scan.scanned(text)[3].split(",")]
    assert [text[int(a) : int(b)] for _, a, b in spans] == [
        "Eitİher under the MIT License; or",
        "under the Apache License, Version 2.0.",
    ]


ZLIB = """This software is provided 'as-is', without any express or implied
warranty.  In no event will the authors be held liable for any damages
arising from the use of this software.

Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it
freely, subject to the following restrictions:"""


@pytest.mark.parametrize(
    ("text", "found", "later"),
    [
        ("Licensed under GPL-3.0", "gpl-3.0", ""),
        ("Licensed under the GPLv2.", "gpl-2", ""),
        ("It is GNU GPL v3 or later.", "gpl-3", "gpl-3"),
        ("under the AGPL-3.0-only, that is", "agpl-3.0", ""),
        ("under the GNU LGPL version 2.1 or any later version", "lgpl-2.1", "lgpl-2.1"),
        ("under the GPLv3+", "gpl-3", "gpl-3"),
        (VERBATIM_GPL, "gpl-2", "gpl-2"),
        (f"{VERBATIM_GPL} Released under the MIT License.", "gpl-2,mit", "gpl-2"),
        ("License: MIT", "mit", ""),
        ("Text before.\n\nLicence: GPL-2.0-or-later\n\nText after", "gpl-2.0-or-later", ""),
        ("licensed under the ISC license", "isc", ""),
        ("a Creative Commons Attribution-ShareAlike 4.0 International License", "cc-by-sa-4.0", ""),
        ("Creative Commons Attribution-NonCommercial-NoDerivatives 4.0", "cc-by-nc-nd-4.0", ""),
        ("Marked CC0 1.0 Universal", "cc0-1.0", ""),
        ("made available under the terms of the Eclipse Public License v2.0 which is there", "epl-2.0", ""),
        ("Distributed under the Boost Software License, Version 1.0.", "bsl-1.0", ""),
        ("under the terms of the EUPL v1.2", "eupl-1.2", ""),
        ("Distributed under the zlib/libpng license", "zlib", ""),
        ("under the terms of the Mozilla Public License, v. 2.0", "mpl-2.0", ""),
        (ZLIB, "zlib", ""),
        ("Die License mit allen Rechten", "", ""),
        ("A license mit hand, 3 gplots and the GNU project", "", ""),
    ],
)
def test_short_forms_and_later_versions(text, found, later):
    got = license_scan.scanned(text)
    assert (got[2], got[5]) == (found, later)


def plain_rules(known: list) -> list[tuple[str, int, int]]:
    """Licenses by brute force: at each place every rule is tried, and the first of the list that fits is taken."""
    out, at = [], 0
    while at < len(known):
        fits = []
        for order, (names, license_) in enumerate(license_scan.RULES):
            part = known[at : at + len(names)]
            gaps = [b.number - a.number - 1 for a, b in zip(part, part[1:])]
            if [k.name for k in part] == list(names) and all(g <= license_scan.GAP for g in gaps):
                fits.append((order, license_ or [k.names for k in part if k.names][0], part))
        if fits:
            _, license_, part = min(fits, key=lambda f: f[0])
            out.append((license_, part[0].start, part[-1].end))
        at += len(fits and min(fits, key=lambda f: f[0])[2]) or 1
    return out


def test_random_texts_against_brute_force():
    rng, seen = random.Random(3), set()
    for _ in range(3000):
        parts = rng.choices([*EXAMPLES.values(), "Something else"], k=rng.randint(1, 12))
        # Whole licenses come up when some of their sentences are kept in order.
        whole = [EXAMPLES[n] for n in rng.choice(license_scan.RULES)[0]]
        others = ["And this"] * rng.randint(0, 3)
        sentences = parts + [s for w in whole for s in (*others, w)] + ["The end"]
        text = ". ".join(sentences)
        known = license_scan.known_sentences(text)
        want = [(name, part) for part in sentences for name, example in EXAMPLES.items() if part == example]
        assert [k.name for k in known] == [name for name, _ in want]
        for k, (_, part) in zip(known, want):
            assert text[k.start : k.end].rstrip(".") == part
        found, _ = license_scan.licenses_of(known)
        assert [f[:3] for f in found] == plain_rules(known)
        seen.update(f[0] for f in found)
    assert seen >= {"mit", "zlib", "isc", "bsd-2-clause", "bsd-3-clause", "bsl-1.0"}


#: A text of each known sentence, broken by comment marks.
EXAMPLES = {
    "spdx": "SPDX-License-Identifier: MIT",
    "apache-named": "under the Apache License, Version 2.0",
    "apache-may-not": "you may not use this file except in compliance with the License",
    "apache-obtain": "You may obtain a copy of the License at",
    "apache-unless": "Unless required by applicable law or agreed to in writing, software distributed under the License",
    "apache-see": "See the License for the specific language governing permissions and limitations",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software",
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies",
    "mit-as-is": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND',
    "mit-liable": "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE",
    "mit-named": "under the MIT license",
    "bsd-use": "Redistribution and use in source and binary forms, with or without modification, are permitted",
    "bsd-source": "Redistributions of source code must retain the above copyright notice",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice",
    "bsd-endorse": "Neither the name of X may be used to endorse or promote products",
    "bsd-as-is": 'This software is provided by X "as is" and any express or implied warranties',
    "bsd-liable": "In no event shall X be liable for any direct, indirect, incidental",
    "bsd-named": "under the 3-clause BSD license",
    "lgpl-free": "redistribute it and/or modify it under the terms of the GNU Lesser General Public License version 2.1",
    "agpl-free": "redistribute it and/or modify it under the terms of the GNU Affero General Public License version 3",
    "gpl-free": "redistribute it and/or modify it under the terms of the GNU General Public License version 3",
    "gpl-hope": "distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY",
    "gpl-received": "You should have received a copy of the GNU General Public License",
    "lgpl-named": "under the GNU Lesser General Public License v3",
    "agpl-named": "under the GNU Affero General Public License v3",
    "gpl-named": "under the GNU General Public License v3",
    "mpl-subject": "subject to the terms of the Mozilla Public License, v. 2.0",
    "mpl-obtain": "If a copy of the MPL was not distributed with this file, You can obtain one",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
    "hereby granted",
    "isc-as-is": 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES',
    "cc-named": "under CC BY-SA 4.0",
    "unlicense": "This is free and unencumbered software released into the public domain",
    "public-domain": "placed in the public domain",
    "gpl-short": "under GPL-3.0",
    "license-field": "License: MIT",
    "isc-named": "under the ISC license",
    "zlib-named": "under the zlib license",
    "zlib-as-is": "This software is provided 'as-is', without any express or implied warranty",
    "zlib-grant": "Permission is granted to anyone to use this software for any purpose",
    "boost-named": "under the Boost Software License, Version 1.0",
    "boost-grant": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the "
    "software and accompanying documentation covered by this license",
    "epl-named": "under the terms of the Eclipse Public License v2.0",
    "eupl-named": "under the EUPL, Version 1.2",
    "mpl-named": "under the Mozilla Public License 2.0",
    "cc-by-long": "Creative Commons Attribution 4.0",
    "cc-by-sa-long": "Creative Commons Attribution-ShareAlike 4.0",
    "cc-by-nd-long": "Creative Commons Attribution-NoDerivatives 4.0",
    "cc-by-nc-long": "Creative Commons Attribution-NonCommercial 4.0",
    "cc-by-nc-sa-long": "Creative Commons Attribution-NonCommercial-ShareAlike 3.0",
    "cc-by-nc-nd-long": "Creative Commons Attribution-NonCommercial-NoDerivs 3.0",
    "cc0-named": "CC0 1.0",
    "cc0-long": "Creative Commons Zero v1.0",
}


def test_each_known_sentence_has_a_trigger():
    assert list(EXAMPLES) == [name for name, _, _ in license_scan.SENTENCES]
    for name, text in EXAMPLES.items():
        for spread in (text, text.replace(" ", "\n * "), f"_{text}_"):
            assert license_scan.scanned(spread)[1] == name


@pytest.mark.parametrize("text", ["available under CC BY-SA 4.0.", "under a Creative Commons BY 4.0", "under the\n# CC\n# BY 4.0"])
def test_creative_commons_without_other_words_is_found(text):
    assert license_scan.scanned(text)[2].startswith("cc-by")


def test_license_lines_of_the_given_documents(spark):
    rows = [r.asDict() for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    lines = {
        "gpl-3": r"licensed under the GNU General Public License, version 3",
        "cc-by-nc-4.0": r"Licensed under CC BY-NC 4\.0",
        "mit": r"Released under the MIT License",
        "apache-2.0": r"Licensed under the Apache License, Version 2\.0",
    }
    want = [(r["doc_id"], ",".join(sorted(k for k, p in lines.items() if re.search(p, r["text"])))) for r in rows]
    got = tuples(license_scan.licenses(frame(spark, rows, extra=True)), "doc_id", "licenses")
    assert sum(bool(w[1]) for w in want) > 10
    assert brute.near_equal([(d, ",".join(sorted(filter(None, x.split(","))))) for d, x in got], want)


def test_edge_texts(spark):
    rows = [*edge_rows(), row(500, MIT), row(500, MIT), row(501, "x " * 200_000 + GPL)]
    got = tuples(license_scan.licenses(frame(spark, rows, extra=True)), "doc_id", "n_sentences", "licenses")
    assert len(got) == len(rows)
    assert sorted(r for r in got if r[1]) == [(500, 4, "mit"), (500, 4, "mit"), (501, 3, "gpl-2")]
    assert tuples(license_scan.licenses(frame(spark, []))) == []

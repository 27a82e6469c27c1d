import re

from neurosheaf.llm import licenses
from neurosheaf.llm.license_rules import BASE, FORMS, LICENSES, PHRASE, Rule, rules

SCHEMA = "doc_id long, text string, found string, score string, n_words string, labels string"
TEXTS = [
    "This is released Under the MIT License, see under the mit-license!",
    "Apache License, Version 2.0 and apache license version 2 twice; CC BY-NC 4.0 and cc by nc.",
    "under the mit license" * 3,
    "Licensed under the GNU General Public License version 3. All rights reserved.",
    "SPDX-License-Identifier: BSD-3-Clause",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and more",
    "nothing here", "", None, "...", "É under the mit license É", "under the mitX license", "x " * 60_000 + "under the mit license",
]


def words(text):
    lower = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def brute(text):
    w = words(text)
    places = [(i, label) for label, phrase in BASE.items() for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
    return len(w), len(places), min((i for i, _ in places), default=None), max((i for i, _ in places), default=None), ",".join(sorted({x for _, x in places}))


def scanned(spark, texts):
    docs = spark.createDataFrame([(i, t, "a", "b", "c", "d") for i, t in enumerate(texts)], SCHEMA)
    return {r.doc_id: r for r in licenses.summarise(licenses.scan(docs)).collect()}


def test_base_against_brute_force(spark):
    got = scanned(spark, TEXTS)
    for i, t in enumerate(TEXTS):
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(t), t and t[:60]
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) | {""} and 0 <= r.score <= 1


def test_detections(spark):
    got = scanned(spark, TEXTS)
    assert got[3].labels == "gpl-3" and got[4].labels == "bsd-3-clause" and got[5].labels == "mit"
    assert got[6].labels == "" and got[6].score == 0


def plain(text):
    """What is left of all matches of all regexes, without keywords: (first, last, rank)."""
    norm = f" {' '.join(words(text))} "
    found = []
    for rank, r in enumerate(rules()):
        for m in re.finditer(rf" (?:{r.pattern})(?= )", norm):
            first = norm[: m.start() + 1].count(" ") - 1
            found.append((first, first + m[0].count(" ") - 1, rank, r.priority))

    def suppressed(x):
        for y in found:
            within = y[0] <= x[0] and x[1] <= y[1] and (y[:2] != x[:2] or (y[3], y[2]) < (x[3], x[2]))
            if within and y[3] <= x[3]:
                return True
            if x[0] <= y[0] and y[1] <= x[1] and 0 < y[3] < x[3]:
                return True
        return False

    left = [x for x in found if x[2] < len(BASE) or not suppressed(x)]
    says = [x for x in left if x[3] < PHRASE]
    return sorted(x[:3] for x in says or left)


def test_detections_against_plain_regexes(spark):
    texts = [f"{a} {b} {c}" for a in ("licensed under the", "see", "SPDX-License-Identifier") for b in ("LGPL v2.1", "creative commons attribution share alike 4.0", "Mozilla Public License 2.0", "Artistic License 2.0", "isc") for c in ("license", "now", "licence and redistribution")]
    got = scanned(spark, [*texts, *TEXTS[:6]])
    for i, t in enumerate([*texts, *TEXTS[:6]]):
        assert sorted((p["first"], p["last"], p["rank"]) for p in got[i].found) == plain(t), t


def test_every_form_with_every_name(spark):
    """In lower, upper and title case, between other words."""
    texts = []
    for k, (_, form, *_) in enumerate(FORMS):
        for j, (_, _, name) in enumerate(LICENSES):
            t = example(form.replace("{name}", f"(?:{name})"))
            texts.append(f"some words, {(t, t.upper(), t.title())[(j + k) % 3]}; and others")
    got = scanned(spark, texts)
    for i, t in enumerate(texts):
        assert got[i].found and sorted((p["first"], p["last"], p["rank"]) for p in got[i].found) == plain(t), t


def test_priority_decides_between_a_form_and_a_longer_one(spark):
    """A detection of a better priority stays, whether it lies in one of a worse priority or holds it."""
    own = [*rules()[: len(BASE)], Rule("long", 50, ("alpha",), "alpha beta gamma", 0.5), Rule("short", 10, ("beta",), "beta", 0.5), Rule("same", 50, ("alpha",), "alpha beta", 0.5), Rule("worse", 60, ("gamma",), "gamma", 0.5)]
    docs = spark.createDataFrame([(1, "alpha beta gamma"), (2, "alpha gamma"), (3, "beta alpha beta delta")], "doc_id long, text string")
    got = {r.doc_id: sorted(p["label"] for p in r.found) for r in licenses.scan(docs, all_rules=own).collect()}
    assert got == {1: ["short"], 2: ["worse"], 3: ["short", "short"]}


def test_no_rows(spark):
    assert licenses.summarise(licenses.scan(spark.createDataFrame([], SCHEMA))).count() == 0


def example(pattern):
    """A text that the pattern fits: first branches, least repeats."""

    def made(items):
        out = ""
        for op, arg in items:
            op = str(op)
            if op == "LITERAL":
                out += chr(arg)
            elif op == "ANY":
                out += "x"
            elif op == "IN":
                out += chr(arg[0][1]) if str(arg[0][0]) in ("LITERAL",) else chr(arg[0][1][0]) if str(arg[0][0]) == "RANGE" else "x"
            elif op == "BRANCH":
                out += made(arg[1][0])
            elif op == "SUBPATTERN":
                out += made(arg[3])
            else:  # MAX_REPEAT, MIN_REPEAT
                out += made(arg[2]) * arg[0]
        return out

    return made(re._parser.parse(pattern))


def test_every_rule_by_its_own_pattern_and_keyword(spark):
    texts = []
    for r in rules():
        t = example(r.pattern)
        assert re.fullmatch(r.pattern, t)
        texts.append(t if any(k in f" {t} " for k in r.keywords) else f"{t} and {r.keywords[0]}")
    got = scanned(spark, texts)
    for i, r in enumerate(rules()):
        assert any(p["first"] == 0 for p in got[i].found), (r, texts[i])


def test_short_notices(spark):
    named = {"Released under Apache 2.0.": "apache-2", "distributed under BSD 3-Clause": "bsd-3-clause", "under MPL 2.0": "mpl-2", "under zlib": "zlib", "under an ISC": "isc", "under Expat": "mit", "under CC Zero": "cc0"}
    got = scanned(spark, list(named))
    assert [got[i].labels for i in range(len(named))] == list(named.values())


_BSD = """Copyright (c) 2020, Somebody. All rights reserved. Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
_GNU = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY. See the GNU {} for more details."
NOTICES = {
    "bsd-2-clause": _BSD,
    "bsd-3-clause": _BSD + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "bsd-4-clause": _BSD + "3. All advertising materials mentioning features or use of this software must display the following acknowledgement: This product includes software developed by Somebody. 4. Neither the name of Somebody nor the names of its contributors may be used to endorse or promote products derived from this software.",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction. The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. All rights reserved.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "apache-2": "Copyright 2020. All rights reserved. Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS basis.",
    "gpl-2-or-later": _GNU.format(*["General Public License", "2", "General Public License"]),
    "gpl-3-or-later": _GNU.format(*["General Public License", "3", "General Public License"]),
    "lgpl-2.1-or-later": _GNU.format(*["Lesser General Public License", "2.1", "Lesser General Public License"]),
    "agpl-3-or-later": _GNU.format(*["Affero General Public License", "3", "Affero General Public License"]),
    "mpl-2": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable. The origin of this software must not be misrepresented; Altered source versions must be plainly marked as such.",
    "unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, for any purpose, commercial or non-commercial, and by any means.",
    "proprietary": "Copyright 2020 Somebody. All rights reserved.",
}


def test_whole_notices_have_one_label(spark):
    got = scanned(spark, list(NOTICES.values()))
    assert [got[i].labels for i in range(len(NOTICES))] == list(NOTICES)

"""Licence recognition from sentences.

Texts are cut into sentences twice: once with every line end as a boundary
(headers and notices of one line), once with blank lines only (wrapped licence
texts).  Sentences are normalised: holders, programs and pointers to a licence
file, which differ from notice to notice, give way to one wording, and an SPDX
expression becomes a sentence for each of its licences.  Each sentence maps to
the identifier of a known licence sentence, or to none, through a table of
small buckets chosen by its hash; a licence is found where the identifiers of
one of its rules stand next to each other, in order, among a text's known
sentences.  A clause of unknown wording has an identifier of its own, so that a
list that it continues is not taken for the shorter licence.  All of it is one projection
per document: no shuffle, no Python.
"""

from __future__ import annotations

import json
import re
from functools import reduce

import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Sentences of public notices and licence texts, in the order in which they stand there.
APACHE_FIRST = 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License'
APACHE_AT, APACHE_PLACE = "You may obtain a copy of the License at", "http://www.apache.org/licenses/LICENSE-2.0"
APACHE_REST = [
    'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied',
    "See the License for the specific language governing permissions and limitations under the License",
]
BSD_FIRST = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"
BSD_LIST = [
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
]
BSD_NAME = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"
MIT_TEXT = [
    'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions',
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT',
    "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE",
]
ISC_TEXT = [
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS',
]
MPL_TEXT = [
    "This Source Code Form is subject to the terms of the Mozilla Public License, v 2.0",
    "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/",
]
ZLIB_TEXT = [
    "This software is provided 'as-is', without any express or implied warranty",
    "In no event will the authors be held liable for any damages arising from the use of this software",
]
BSD_ADVERTISING = "All advertising materials mentioning features or use of this software must display the following acknowledgement: This product includes software developed by the copyright holder"
BSD_DISCLAIMER = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES'
EPL_1 = "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html"
EPL_2 = "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at http://www.eclipse.org/legal/epl-2.0"
BOOST_TEXT = 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following'
NO_CONDITION = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
UNLICENSE_TEXT = ["This is free and unencumbered software released into the public domain"]
GNU_START, GNU_LATER = "This program is free software: you can redistribute it and/or modify it under the terms of", "or (at your option) any later version"
GNU_BY = "as published by the Free Software Foundation"


def _gnu(name: str, version: str) -> list[str]:
    return [f"{GNU_START} the {name} {GNU_BY}, either version {version} of the License, {GNU_LATER}"]


def _gnu_only(name: str, version: str) -> list[list[str]]:
    """Wordings without later versions."""
    forms = [f"the {name} {GNU_BY}, version {version} of the License", f"the {name} {GNU_BY}, either version {version} of the License", f"the {name} {GNU_BY}; version {version}", f"the {name} version {version} {GNU_BY}", f"the {name}, version {version}, {GNU_BY}", f"version {version} of the {name} {GNU_BY}"]
    return [[s] for s in dict.fromkeys(canonical(f"{GNU_START} {f}") for f in forms)]


def normalised(sentence: str) -> str:
    """Lower case, and one blank for every run of other characters than letters and digits."""
    return re.sub(r"[\W_]+", " ", sentence.lower()).strip()


# What differs from notice to notice in normalised sentences, and the wording that takes its place.  The patterns mean the same to Java, RE2 and Python.
SLOTS = [
    ("^.{1,90}? is free software you can redistribute it and or modify it under", "this program is free software you can redistribute it and or modify it under"),
    (" as published by the free software foundation inc ", " as published by the free software foundation "),
    ("^.{1,90}? is distributed in the hope that it will be useful but", "this program is distributed in the hope that it will be useful but"),
    ("^(neither the names? of .{1,300}? may|the names? of .{1,300}? may not) be used to endorse or promote products derived from this software without (specific )?prior written permission( of .{1,200})?$", normalised(BSD_NAME)),
    ("^all advertising materials mentioning features or use of this software must display the following acknowledge?ments? this product includes software developed by .{1,200}$", normalised(BSD_ADVERTISING)),
    ("^this software is provided by .{1,300}? as is and any express(ed)? or implied warranties.*$", normalised(BSD_DISCLAIMER)),
    (" see (the )?(accompanying )?(licen[sc]e|copying)( [a-z0-9 ]{0,80})?$", ""),
]
SPDX = "spdx license identifier "
# Words of a condition; in a text with a BSD list, a sentence with one of them and of no known wording is a clause of its own.
CLAUSE = "(endorse|promote|advertising|acknowledg|redistribut|commercial|patent|military|must|shall|may not)"
UNKNOWN = -1


def canonical(sentence: str) -> str:
    """A normalised sentence with its slots filled."""
    out = normalised(sentence)
    for pattern, filled in SLOTS:
        out = re.sub(pattern, filled, out)
    return out


# Notices, the more specific first.
NOTICES = [
    ("Apache-2.0", "permissive", [APACHE_FIRST, f"{APACHE_AT} {APACHE_PLACE}", *APACHE_REST]),
    ("Apache-2.0", "permissive", [APACHE_FIRST, APACHE_AT, APACHE_PLACE, *APACHE_REST]),
    ("BSD-3-Clause", "permissive", [BSD_FIRST, *BSD_LIST, BSD_NAME]),
    ("MIT", "permissive", MIT_TEXT),
    ("AGPL-3.0-or-later", "copyleft", _gnu("GNU Affero General Public License", "3")),
    ("LGPL-3.0-or-later", "copyleft", _gnu("GNU Lesser General Public License", "3")),
    ("LGPL-2.1-or-later", "copyleft", _gnu("GNU Lesser General Public License", "2.1")),
    ("GPL-3.0-or-later", "copyleft", _gnu("GNU General Public License", "3")),
    ("GPL-2.0-or-later", "copyleft", _gnu("GNU General Public License", "2")),
    ("ISC", "permissive", ISC_TEXT),
    ("BSD-2-Clause", "permissive", [BSD_FIRST, *BSD_LIST]),
    ("MPL-2.0", "copyleft", MPL_TEXT),
    ("Zlib", "permissive", ZLIB_TEXT),
    ("Unlicense", "public domain", UNLICENSE_TEXT),
    ("BSD-4-Clause", "permissive", [BSD_FIRST, *BSD_LIST, BSD_ADVERTISING, BSD_NAME]),
    ("BSL-1.0", "permissive", [BOOST_TEXT]),
    ("0BSD", "permissive", [NO_CONDITION]),
    ("EPL-2.0", "copyleft", [EPL_2]),
    ("EPL-1.0", "copyleft", [EPL_1]),
    *[
        (f"{short}-{version if '.' in version else version + '.0'}-only", "copyleft", grant)
        for short, name, version in [("AGPL", "GNU Affero General Public License", "3"), ("LGPL", "GNU Lesser General Public License", "3"), ("LGPL", "GNU Lesser General Public License", "2.1"), ("GPL", "GNU General Public License", "3"), ("GPL", "GNU General Public License", "2")]
        for grant in _gnu_only(name, version)
    ],
    # no licence of its own: a list that another clause continues
    (None, None, [BSD_FIRST, *BSD_LIST, UNKNOWN]),
]

# Licences by name; each name in each of the phrases below is one declaration of the licence.
NAMED = [
    ("Apache-2.0", "permissive", ["the Apache License, Version 2.0", "the Apache License 2.0", "the Apache 2.0 License", "Apache 2.0", "Apache-2.0"]),
    ("MIT", "permissive", ["the MIT License", "the MIT licence", "MIT"]),
    ("GPL-3.0-only", "copyleft", ["the GNU General Public License version 3", "the GNU General Public License v3.0", "the GNU GPL v3", "the GPLv3", "GPL-3.0", "GPL-3.0-only"]),
    ("GPL-3.0-or-later", "copyleft", ["the GNU General Public License version 3 or later", "GPL-3.0-or-later"]),
    ("GPL-2.0-only", "copyleft", ["the GNU General Public License version 2", "the GNU General Public License v2.0", "the GNU GPL v2", "the GPLv2", "GPL-2.0", "GPL-2.0-only"]),
    ("GPL-2.0-or-later", "copyleft", ["the GNU General Public License version 2 or later", "GPL-2.0-or-later"]),
    ("LGPL-3.0-or-later", "copyleft", ["the GNU Lesser General Public License version 3 or later", "LGPL-3.0-or-later"]),
    ("LGPL-2.1-or-later", "copyleft", ["the GNU Lesser General Public License version 2.1 or later", "LGPL-2.1-or-later"]),
    ("LGPL-2.1-only", "copyleft", ["the GNU Lesser General Public License version 2.1", "the LGPLv2.1", "LGPL-2.1", "LGPL-2.1-only"]),
    ("AGPL-3.0-or-later", "copyleft", ["the GNU Affero General Public License version 3 or later", "AGPL-3.0-or-later"]),
    ("BSL-1.0", "permissive", ["the Boost Software License, Version 1.0", "the Boost Software License 1.0", "BSL-1.0"]),
    ("EPL-2.0", "copyleft", ["the Eclipse Public License 2.0", "the Eclipse Public License, Version 2.0", "EPL-2.0"]),
    ("EPL-1.0", "copyleft", ["the Eclipse Public License 1.0", "the Eclipse Public License, Version 1.0", "EPL-1.0"]),
    ("Zlib", "permissive", ["the zlib License", "Zlib"]),
    ("Unlicense", "public domain", ["the Unlicense", "Unlicense"]),
    ("0BSD", "permissive", ["the Zero-Clause BSD License", "0BSD"]),
    ("LGPL-3.0-only", "copyleft", ["the GNU Lesser General Public License version 3", "the LGPLv3", "LGPL-3.0", "LGPL-3.0-only"]),
    ("AGPL-3.0-only", "copyleft", ["the GNU Affero General Public License version 3", "the AGPLv3", "AGPL-3.0", "AGPL-3.0-only"]),
    ("MPL-2.0", "copyleft", ["the Mozilla Public License 2.0", "the Mozilla Public License, Version 2.0", "MPL-2.0"]),
    ("BSD-3-Clause", "permissive", ["the BSD 3-Clause License", "the 3-Clause BSD License", "BSD-3-Clause"]),
    ("BSD-2-Clause", "permissive", ["the BSD 2-Clause License", "the 2-Clause BSD License", "BSD-2-Clause"]),
    ("ISC", "permissive", ["the ISC License", "ISC"]),
    ("CC-BY-NC-4.0", "noncommercial", ["CC BY-NC 4.0", "a Creative Commons Attribution-NonCommercial 4.0 International License"]),
    ("CC-BY-NC-SA-4.0", "noncommercial", ["CC BY-NC-SA 4.0", "a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"]),
    ("CC-BY-SA-4.0", "copyleft", ["CC BY-SA 4.0", "a Creative Commons Attribution-ShareAlike 4.0 International License"]),
    ("CC-BY-4.0", "permissive", ["CC BY 4.0", "a Creative Commons Attribution 4.0 International License"]),
    ("CC0-1.0", "public domain", ["CC0 1.0", "CC0"]),
]
PHRASES = [
    "Licensed under {}", "Released under {}", "Distributed under {}", "Available under {}", "Published under {}", "This work is licensed under {}", "This work is released under {}",
    "This project is licensed under {}", "This project is licensed under the terms of {}", "This software is licensed under {}", "This software is released under {}", "This file is licensed under {}",
    "This code is licensed under {}", "This text is licensed under {}", "SPDX-License-Identifier: {}",
]


def _tables(notices: list[tuple], named: list[tuple], phrases: list[str]) -> tuple[dict[str, int], list[tuple[str, str, list[int]]]]:
    """``(identifier by sentence, ordered rules)``; a rule is a run of identifiers."""
    ids: dict[str, int] = {}
    known = lambda s: s if s == UNKNOWN else ids.setdefault(canonical(s), len(ids) + 1)
    rules = [(name, kind, [known(s) for s in sentences]) for name, kind, sentences in notices]
    known(BSD_DISCLAIMER)  # of no rule, but no clause either
    for n, (name, kind, forms) in enumerate(named, len(ids) + 1):
        for sentence in (canonical(p.format(f)) for p in phrases for f in forms):
            ids.setdefault(sentence, n)
        rules.append((name, kind, [n]))
    return ids, rules


SENTENCES, RULES = _tables(NOTICES, NAMED, PHRASES)

# A sentence ends at its mark before a blank, and before a numbered point; "v. 2.0" is one.
SENTENCE_ENDS = "[.!?][\\x20\\x09-\\x0D]|\\x0A[\\x20\\x09*#/]*[0-9]{1,2}[.)][\\x20\\x09]"
# Marks that end no sentence, and one scheme for all addresses.
SPELLINGS = [(" v. ", " v "), (" inc. ", " inc "), (" ltd. ", " ltd "), (" corp. ", " corp "), (" co. ", " co "), ("https://", "http://")]
LISTED = "redistribution and use in source and binary forms"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _marked(text: Column) -> Column:
    """Normalised text with U+0001 at sentence ends; its line ends stay."""
    low = F.translate(text, UPPER, LOWER)
    for said, meant in SPELLINGS:
        low = F.replace(low, F.lit(said), F.lit(meant))
    # the line end of a mark that ends a sentence goes with it, so a blank line after it is kept as one
    return F.regexp_replace(F.regexp_replace(low, SENTENCE_ENDS, "\u0001\n"), "[^\\p{L}\\p{N}\\x01\\x0A]+", " ")


def _filled(part: Column) -> Column:
    """A sentence with its slots filled."""
    s = F.trim(part)
    for pattern, filled in SLOTS:
        s = F.regexp_replace(s, pattern, filled)
    return s


def _licences_of(s: Column) -> Column:
    """An SPDX expression as one sentence for each of its licences; any other sentence alone."""
    whole = F.replace(s, F.lit(" or later"), F.lit(" orlater"))
    single = F.split(F.regexp_replace(whole, " (or|and|with) ", "\u0001" + SPDX), "\u0001")
    return F.when(s.startswith(SPDX), F.transform(single, lambda x: F.replace(x, F.lit(" orlater"), F.lit(" or later")))).otherwise(F.array(s))


def _traits(marked: Column) -> list[Column]:
    """What is asked once a text: whether it has a BSD list, words of a slot, SPDX expressions."""
    has = lambda *words: reduce(lambda a, b: a & b, [marked.contains(w) for w in words])
    slotted = has("redistribute") | has("endorse") | has("hope", "distributed") | has("advertising", "acknowledg") | has("implied", "express") | (has("see") & (has("license") | has("licence") | has("copying")))
    return [has(LISTED).alias("listed"), slotted.alias("slotted"), has("spdx").alias("spdx")]


def _spread(parts: Column) -> Column:
    """The sentences as they are looked up.  Texts without any word of a slot, nearly all, are only trimmed."""
    plain = F.when(F.col("slotted"), F.transform(parts, _filled)).otherwise(F.transform(parts, lambda s: F.trim(s)))
    return F.when(F.col("spdx"), F.flatten(F.transform(plain, _licences_of))).otherwise(plain)


def _identifiers(parts: Column, sentences: dict[str, int], listed: Column) -> Column:
    """Identifiers of the known ones among these sentences, in order; buckets are chosen by the sentence's hash.

    In texts with a BSD list (``listed``) other clauses are ``UNKNOWN``.
    """
    n = 4 * len(sentences)
    buckets: list[list[tuple[str, int]]] = [[] for _ in range(n)]
    for sentence, i in sentences.items():
        signed = xxhash.xxh64_intdigest(sentence.encode(), 42)
        buckets[(signed - (1 << 64) if signed >> 63 else signed) % n].append((sentence, i))
    texts = F.from_json(F.lit(json.dumps([[s for s, _ in b] for b in buckets])), "array<array<string>>")  # folded once
    ids = F.from_json(F.lit(json.dumps([[i for _, i in b] for b in buckets])), "array<array<int>>")

    def find(s: Column) -> Column:
        bucket = F.pmod(F.xxhash64(s), F.lit(n)).cast("int")
        place = F.array_position(F.get(texts, bucket), s).cast("int")
        return F.coalesce(F.get(F.get(ids, bucket), place - 1), F.when(listed & s.rlike(CLAUSE), UNKNOWN), F.lit(0))

    return F.filter(F.transform(parts, find), lambda i: i != 0)


def recognise_licences(docs: DataFrame, sentences: dict[str, int] = SENTENCES, rules: list[tuple] = RULES) -> DataFrame:
    """All columns of ``docs`` and ``n_known_sentences``, ``rules_found``, ``licence``, ``licence_class``.

    ``rules_found`` holds the 1-based numbers of all matching rules, ascending;
    a run that is part of a longer rule's match is not a match of its own.
    ``licence`` and ``licence_class`` are those of the first, null where none
    matches.  A null or empty text has no sentences.  Input columns of the four
    new names are replaced.  Texts and sentences of any length, repeated
    sentences and ties between rules are all defined by the order of ``rules``;
    repeated rows come back as often, and an empty table gives no rows.
    """
    new = ("n_known_sentences", "rules_found", "licence", "licence_class")
    marked = docs.select(F.struct(*[c for c in docs.columns if c not in new]).alias("row"), _marked(F.coalesce("text", F.lit(""))).alias("marked"))
    lines = F.split(F.translate("marked", "\n", "\u0001"), "\u0001")
    wrapped = F.split(F.regexp_replace(F.regexp_replace("marked", "\\x0A(?: ?\\x0A)+", "\u0001"), "[ \\x0A]+", " "), "\u0001")
    marked = marked.select("row", "marked", *_traits(F.col("marked")))
    looked_up = lambda parts: _identifiers(_spread(parts), sentences, F.col("listed"))
    found = marked.select("row", looked_up(lines).alias("lines"), looked_up(wrapped).alias("wrapped"))
    written = lambda ids: F.concat(F.lit(","), F.array_join(F.transform(ids, lambda i: i.cast("string")), ","), F.lit(","))
    found = found.withColumn("both", F.concat(written(F.col("lines")), F.lit("|"), written(F.col("wrapped"))))
    hits = []
    for n, (run, longer) in enumerate(_runs(rules), 1):
        if rules[n - 1][0] is None:
            continue
        left = F.col("both")
        for other in longer:
            left = F.replace(left, F.lit(other), F.lit(",0,"))
        hits.append(F.when(left.contains(run), F.lit(n)))
    found = found.withColumn("hits", F.filter(F.array(*hits), lambda n: n.isNotNull()))
    first = F.try_element_at("hits", F.lit(1))
    names = F.array(*[F.lit(r[0] or "") for r in rules])
    kinds = F.array(*[F.lit(r[1] or "") for r in rules])
    return found.select(
        "row.*",
        F.greatest(*[F.size(F.filter(c, lambda i: i > 0)) for c in ("lines", "wrapped")]).cast("bigint").alias("n_known_sentences"),
        F.col("hits").alias("rules_found"),
        F.when(first.isNotNull(), F.element_at(names, first)).alias("licence"),
        F.when(first.isNotNull(), F.element_at(kinds, first)).alias("licence_class"),
    )


def _runs(rules: list[tuple]) -> list[tuple[str, list[str]]]:
    """Each rule's identifiers as text, and those longer runs that contain them."""
    runs = ["," + ",".join(map(str, ids)) + "," for _, _, ids in rules]
    return [(run, sorted({x for x in runs if run in x and x != run}, key=len, reverse=True)) for run in runs]


def op10_licence_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = recognise_licences(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_known_sentences", F.array_join(F.transform("rules_found", lambda n: n.cast("string")), ",").alias("rules_found"), "licence", "licence_class")


def _sql() -> str:
    known = "[" + ", ".join(f"'{s}'" for s in SENTENCES) + "]"
    numbers = "[" + ", ".join(map(str, SENTENCES.values())) + "]"
    low = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"
    for said, meant in SPELLINGS:
        low = f"replace({low}, '{said}', '{meant}')"
    slots = "trim(s)"
    for pattern, filled in SLOTS:
        slots = f"regexp_replace({slots}, '{pattern}', '{filled}')"
    single = f"list_transform(string_split(regexp_replace(replace(s, ' or later', ' orlater'), ' (or|and|with) ', chr(1) || '{SPDX}', 'g'), chr(1)), lambda x: replace(x, ' orlater', ' or later'))"
    spread = lambda parts: f"flatten(list_transform(list_transform({parts}, lambda s: {slots}), lambda s: CASE WHEN starts_with(s, '{SPDX}') THEN {single} ELSE [s] END))"
    listed = f"(contains(m, '{LISTED}') AND regexp_matches(s, '{CLAUSE}'))"
    marked = f"regexp_replace(regexp_replace({low}, '{SENTENCE_ENDS}', chr(1) || chr(10), 'g'), '[^\\p{{L}}\\p{{N}}\\x01\\x0A]+', ' ', 'g')"
    lines = "string_split(translate(m, chr(10), chr(1)), chr(1))"
    wrapped = "string_split(regexp_replace(regexp_replace(m, '\\x0A(?: ?\\x0A)+', chr(1), 'g'), '[ \\x0A]+', ' ', 'g'), chr(1))"
    ids = lambda parts: f"list_filter(list_transform({spread(parts)}, lambda s: coalesce({numbers}[list_position({known}, s)], CASE WHEN {listed} THEN {UNKNOWN} END, 0)), lambda i: i <> 0)"
    written = lambda c: f"',' || array_to_string({c}, ',') || ','"

    def left(longer: list[str]) -> str:
        text = "b"
        for other in longer:
            text = f"replace({text}, '{other}', ',0,')"
        return text

    tests = ", ".join(f"CASE WHEN contains({left(longer)}, '{run}') THEN {n} END" for n, (run, longer) in enumerate(_runs(RULES), 1) if RULES[n - 1][0])
    pick = lambda k: "CASE r[1] " + " ".join(f"WHEN {n} THEN '{r[k]}'" for n, r in enumerate(RULES, 1) if r[0]) + " END"
    return f"""
WITH m AS (SELECT doc_id, {marked} m FROM documents),
     s AS (SELECT doc_id, {ids(lines)} l, {ids(wrapped)} w FROM m),
     t AS (SELECT doc_id, l, w, {written('l')} || '|' || {written('w')} b FROM s),
     u AS (SELECT doc_id, l, w, list_filter([{tests}], lambda n: n IS NOT NULL) r FROM t)
SELECT doc_id, CAST(greatest(len(list_filter(l, lambda i: i > 0)), len(list_filter(w, lambda i: i > 0))) AS BIGINT) n_known_sentences, array_to_string(r, ',') rules_found,
       {pick(0)} licence, {pick(1)} licence_class FROM u"""


QUERIES = {"op10_licence_sentences": op10_licence_sentences}
ORACLES = {"op10_licence_sentences": _sql()}

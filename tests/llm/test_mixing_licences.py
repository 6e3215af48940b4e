import math
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from karyospark.llm import licences, mixing


def docs_of(spark, sizes):
    rows = [(f"s{k}" if k else None, n) for k, n in enumerate(sizes)]
    df = spark.createDataFrame(rows, "source string, n int").select("source", F.explode(F.sequence(F.lit(1), "n")).alias("i"))
    return df.select(F.xxhash64("source", "i").alias("doc_id"), F.lit("t").alias("text"), "source", F.lit("x").alias("rate"))


def test_rates_and_poisson_shape(spark):
    mixed = mixing.mix_sources(docs_of(spark, [4000, 1000, 250]), temperature=0.5)
    rows = mixed.groupBy("source").agg(F.count("*").alias("n"), F.first("rate").alias("rate")).collect()
    roots = [math.sqrt(x) for x in (4000, 1000, 250)]
    for r in rows:
        k = 0 if r.source is None else int(r.source[1:])
        n = (4000, 1000, 250)[k]
        want = 5250 * roots[k] / sum(roots) / n
        assert r.rate == pytest.approx(want)
        assert abs(r.n - n * want) < 5 * math.sqrt(n * want)
    times = Counter(Counter(r.doc_id for r in mixed.where("source = 's1'").collect()).values())
    rate = 5250 * roots[1] / sum(roots) / 1000
    for k in (1, 2, 3):
        p = math.exp(-rate) * rate**k / math.factorial(k)
        assert abs(times[k] - 1000 * p) < 5 * math.sqrt(1000 * p)


def test_named_weights_and_order(spark):
    docs = docs_of(spark, [300, 300, 300])
    mixed = mixing.mix_sources(docs, weights={"s1": 3.0, "s2": 1.0}, total=800)
    counts = {r.source: r["count"] for r in mixed.groupBy("source").count().collect()}
    assert set(counts) == {"s1", "s2"} and 500 < counts["s1"] < 700 and 130 < counts["s2"] < 270
    for part in mixed.select("mix_key").rdd.glom().collect():
        keys = [r[0] for r in part]
        assert keys == sorted(keys)
    again = mixing.mix_sources(docs.repartition(3), weights={"s1": 3.0, "s2": 1.0}, total=800)
    assert sorted(map(str, again.collect())) == sorted(map(str, mixed.collect()))


def test_mixing_odd_rows(spark):
    rows = [(None, None, None), (1, "", "a"), (1, "", "a"), (2, "x" * 200_000, "a"), (3, "y", "b")]
    docs = spark.createDataFrame([(*r, 5) for r in rows], "doc_id bigint, text string, source string, copy int")
    mixed = mixing.mix_sources(docs, total=40)
    assert {r.doc_id for r in mixed.collect()} <= {None, 1, 2, 3} and mixed.count() > 10
    assert mixing.mix_sources(docs.limit(0)).count() == 0


@pytest.mark.parametrize("rate", [0.3, 5.0, 150.0, 745.0, 746.0, 1257.0, 40000.0])
def test_poisson_table(rate):
    least, cdf = mixing.poisson_cdf(rate)
    p = np.diff(cdf, prepend=0.0)
    k = least + np.arange(len(p))
    assert cdf[-1] == 1 and (p * k).sum() == pytest.approx(rate) and (p * (k - rate) ** 2).sum() == pytest.approx(rate)
    for at in (int(rate), int(rate + math.sqrt(rate))):
        assert p[at - least] == pytest.approx(math.exp(at * math.log(rate) - rate - math.lgamma(at + 1)))


def test_many_copies_of_a_rare_source(spark):
    docs = docs_of(spark, [40, 40])
    mixed = mixing.mix_sources(docs, weights={"s1": 1.0}, total=40 * 1257)
    copies = list(Counter(r.doc_id for r in mixed.select("doc_id").collect()).values())
    assert len(copies) == 40 and len(set(copies)) > 20
    assert abs(sum(copies) / 40 - 1257) < 5 * math.sqrt(1257 / 40)
    assert all(abs(n - 1257) < 6 * math.sqrt(1257) for n in copies)


MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
"""

APACHE = """Copyright 2020 A. Person

Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.
"""

GPL = """    This program is free software: you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation, either version 3 of the License, or
    (at your option) any later version.

    This program is distributed in the hope that it will be useful,
    but WITHOUT ANY WARRANTY; without even the implied warranty of
    MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
    GNU General Public License for more details.

    You should have received a copy of the GNU General Public License
    along with this program.  If not, see <https://www.gnu.org/licenses/>.
"""

LGPL = """This library is free software; you can redistribute it and/or
modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation; either
version 2.1 of the License, or (at your option) any later version.

This library is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU
Lesser General Public License for more details.
"""

BSD = """Copyright (c) 2020, A. Person

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""

BSD_THIRD = """
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""

DISCLAIMER = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES ARE DISCLAIMED.
"""

ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH
REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY
AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL DAMAGES.
"""

MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at http://mozilla.org/MPL/2.0/.
"""

ZLIB = """This software is provided 'as-is', without any express or implied
warranty. In no event will the authors be held liable for any damages
arising from the use of this software.
"""

UNLICENSE = "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy it.\n"


def commented(text, mark):
    return "/*\n" + "".join(f" {mark} {line}".rstrip() + "\n" for line in text.split("\n")) + " */\nint main() {}\n"


FULL = [
    (APACHE, "Apache-2.0", 2),
    (APACHE.replace("at\n\n ", "at\n ").replace("2.0\n\n", "2.0.\n"), "Apache-2.0", 1),
    (BSD + BSD_THIRD + DISCLAIMER, "BSD-3-Clause", 3),
    (MIT, "MIT", 4),
    (GPL.replace("GNU General", "GNU Affero General"), "AGPL-3.0-or-later", 5),
    (LGPL.replace("version 2.1", "version 3"), "LGPL-3.0-or-later", 6),
    (LGPL, "LGPL-2.1-or-later", 7),
    (GPL, "GPL-3.0-or-later", 8),
    (GPL.replace("version 3", "version 2"), "GPL-2.0-or-later", 9),
    (ISC, "ISC", 10),
    (BSD + DISCLAIMER, "BSD-2-Clause", 11),
    (MPL, "MPL-2.0", 12),
    (ZLIB, "Zlib", 13),
    (UNLICENSE, "Unlicense", 14),
]

TEXTS = [
    (MIT, "MIT"),
    ("Some prose | without an end\nReleased under the MIT License.\nMore prose.", "MIT"),
    ("Some prose. Licensed under CC BY-NC 4.0.", "CC-BY-NC-4.0"),
    ("It was not released under the MIT licence, he said.", None),
    ("Permission is hereby granted.", None),
    ("the wordlicensed under cc by 4.0", None),
    ("See the GNU General Public License for more details.", None),
    ("Licensed under the Apache License, Version 2.0.\n" * 500, "Apache-2.0"),
    ("# SPDX-License-Identifier: GPL-2.0-or-later\nimport os", "GPL-2.0-or-later"),
    (None, None),
    ("", None),
    ("x" * 300_000, None),
]


@pytest.mark.parametrize("style", [lambda t: t, lambda t: commented(t, "*"), lambda t: commented(t, "#"), lambda t: t.replace("\n", "\r\n")])
def test_every_notice_by_its_own_text(spark, style):
    docs = spark.createDataFrame([(n, style(text)) for n, (text, _, _) in enumerate(FULL)], "doc_id int, text string")
    got = {r.doc_id: (r.licence, r.rules_found) for r in licences.recognise_licences(docs).collect()}
    assert got == {n: (name, [rule]) for n, (_, name, rule) in enumerate(FULL)}


def bsd(third):
    return BSD + third + DISCLAIMER.replace("THE COPYRIGHT HOLDERS AND CONTRIBUTORS", "EXAMPLE INC.")


FSF_LGPL = GPL.replace("GNU General", "GNU Lesser General")
#: Notices as they are met: named holders and programs, other schemes, versions and wordings.
MET = [
    (bsd("\n3. Neither the name of Example Inc. nor the names of its contributors may\n   be used to endorse or promote products derived from this software without\n   specific prior written permission.\n"), ["BSD-3-Clause"]),
    (bsd("\n * Neither the name of the University of Somewhere nor the names of its\n   contributors may be used to endorse or promote products derived from\n   this software without specific prior written permission.\n"), ["BSD-3-Clause"]),
    (bsd("\n3. The names of the authors may not be used to endorse or promote products\n   derived from this software without prior written permission.\n"), ["BSD-3-Clause"]),
    (bsd("\n3. All advertising materials mentioning features or use of this software\n   must display the following acknowledgement:\n   This product includes software developed by the Example Group.\n\n4. Neither the name of the Example Group nor the names of its contributors\n   may be used to endorse or promote products derived from this software\n   without specific prior written permission.\n"), ["BSD-4-Clause"]),
    (bsd("\n3. This software must not be used in a nuclear facility.\n"), []),
    (bsd(""), ["BSD-2-Clause"]),
    (bsd("") + "\nYou must read this.\n", ["BSD-2-Clause"]),
    (MPL.replace("http://", "https://"), ["MPL-2.0"]),
    (APACHE.replace("http://", "https://"), ["Apache-2.0"]),
    (FSF_LGPL, ["LGPL-3.0-or-later"]),
    (GPL.replace("This program is free software", "This file is free software"), ["GPL-3.0-or-later"]),
    (GPL.replace("This program", "Foobar 2"), ["GPL-3.0-or-later"]),
    (GPL.replace("either version 3 of the License, or\n    (at your option) any later version.", "version 2 of the License."), ["GPL-2.0-only"]),
    (GPL.replace("License as published by\n    the Free Software Foundation, either version 3 of the License, or\n    (at your option) any later version.", "License version 2 as\n    published by the Free Software Foundation."), ["GPL-2.0-only"]),
    (GPL.replace("Free Software Foundation, either", "Free Software Foundation, Inc., either"), ["GPL-3.0-or-later"]),
    (GPL.replace("GNU General", "GNU Affero General").replace(", or\n    (at your option) any later version", ""), ["AGPL-3.0-only"]),
    ("This project is licensed under the MIT License - see the LICENSE file for details.", ["MIT"]),
    ("This project is licensed under the MIT License - see the [LICENSE.md](LICENSE.md) file for details", ["MIT"]),
    ("// SPDX-License-Identifier: MIT OR Apache-2.0", ["Apache-2.0", "MIT"]),
    ("SPDX-License-Identifier: (GPL-2.0-or-later AND BSD-3-Clause)", ["GPL-2.0-or-later", "BSD-3-Clause"]),
    ("SPDX-License-Identifier: GPL-2.0-only WITH Some-exception", ["GPL-2.0-only"]),
    ("Licensed under AGPL-3.0-or-later.", ["AGPL-3.0-or-later"]),
    ("Distributed under the Boost Software License, Version 1.0. (See accompanying\nfile LICENSE_1_0.txt or copy at https://www.boost.org/LICENSE_1_0.txt)", ["BSL-1.0"]),
    (licences.BOOST_TEXT + ":\n", ["BSL-1.0"]),
    ("This program and the accompanying materials are made\navailable under the terms of the Eclipse Public License 2.0\nwhich is available at https://www.eclipse.org/legal/epl-2.0/\n", ["EPL-2.0"]),
    ("Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted.\n", ["0BSD"]),
    ("The report must be free. Neither side may be used to it.", []),
]


@pytest.mark.parametrize("style", [lambda t: t, lambda t: commented(t, "*"), lambda t: commented(t, "#"), lambda t: t.replace("\n", "\r\n")])
def test_notices_as_they_are_met(spark, style):
    docs = spark.createDataFrame([(n, style(text)) for n, (text, _) in enumerate(MET)], "doc_id int, text string")
    got = {r.doc_id: [licences.RULES[k - 1][0] for k in r.rules_found] for r in licences.recognise_licences(docs).collect()}
    assert got == {n: names for n, (_, names) in enumerate(MET)}


def test_every_notice_is_found_by_its_sentences(spark):
    rules = [(n, name, ". ".join(s) + ".") for n, (name, _, s) in enumerate(licences.NOTICES, 1) if name]
    got = {r.doc_id: r.rules_found for r in licences.recognise_licences(spark.createDataFrame([(n, t) for n, _, t in rules], "doc_id int, text string")).collect()}
    assert all(licences.RULES[got[n][0] - 1][0] == name for n, name, _ in rules)


def test_sql_of_notices_as_they_are_met(spark, tmp_path):
    texts = [style(t) for t, _ in MET for style in (lambda t: t, lambda t: commented(t, "*"))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = licences.op10_licence_sentences(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == sorted(con.sql(licences.ORACLES["op10_licence_sentences"]).fetchall())


def test_every_phrase_declares_its_licence(spark):
    said = [(name, f"Prose. {p.format(form)}.") for name, _, forms in licences.NAMED for form in forms for p in licences.PHRASES]
    docs = spark.createDataFrame([(n, text) for n, (_, text) in enumerate(said)], "doc_id int, text string")
    got = {r.doc_id: r.licence for r in licences.recognise_licences(docs).collect()}
    assert got == {n: name for n, (name, _) in enumerate(said)}


def test_a_part_of_a_longer_match_counts_alone_only_elsewhere(spark):
    docs = spark.createDataFrame([(1, BSD + BSD_THIRD), (2, BSD + BSD_THIRD + DISCLAIMER + "\n" + BSD + DISCLAIMER)], "doc_id int, text string")
    assert {r.doc_id: r.rules_found for r in licences.recognise_licences(docs).collect()} == {1: [3], 2: [3, 11]}


def test_licences(spark):
    rows = [(i // 2, t, "k", "z") for i, (t, _) in enumerate(TEXTS)]
    got = licences.recognise_licences(spark.createDataFrame(rows, "doc_id int, text string, licence string, _x string")).collect()
    assert [r.licence for r in got] == [want for _, want in TEXTS]
    assert got[0].rules_found == [4] and got[0].n_known_sentences == 4 and got[0]._x == "z"
    empty = licences.recognise_licences(spark.createDataFrame([], "doc_id int, text string"))
    assert empty.count() == 0

import random
import re
import textwrap
import time

import duckdb
import pytest
from pyspark.sql import functions as F

from tideweave.llm import licences, urls
from tideweave.llm.oracles import ORACLES
from tideweave.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", ["op1_license_scan", "op10_url_filter"])
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = QUERIES[name](spark, SF)
    want = con.execute(f"select {', '.join(got.columns)} from ({ORACLES[name]})").fetchall()
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_licences(spark):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
    mit += "\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."
    rows = [(1, None), (2, ""), (3, "x. Released under the MIT License. y"), (3, "x. Released under the MIT License. y"), (4, mit + "\nAll rights reserved."), (5, "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."), (6, "Licensed under CC BY-NC 4.0.\nLicensed under CC BY-NC 4.0.\nLicensed under the Apache License, Version 2.0."), (None, "licence of sorts"), (7, "word " * 200_000 + ". All rights reserved!")]
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id bigint, text string, ids int")
    got = sorted((tuple(r)[:2] + (r.licences,) for r in licences.scan_licences(df).collect()), key=str)
    assert got == sorted([(1, 0, ""), (2, 0, ""), (3, 1, "MIT"), (3, 1, "MIT"), (4, 4, "MIT,proprietary"), (5, 1, "unknown"), (6, 3, "Apache-2.0,CC-BY-NC-4.0"), (None, 0, ""), (7, 1, "proprietary")], key=str)
    assert licences.scan_licences(df.limit(0)).count() == 0


def test_urls(spark):
    rows = [(1, None), (2, "no scheme"), (3, "http://A.Example.COM/en/x?q#f"), (4, "http://www.example.com/en/1"), (5, "http://x.com"), (6, "http://x.com?a/b"), (7, "https://b.net/es/1"), (8, "https://b.net/ES/1"), (9, "http://notexample.com/en/1"), (10, "://h://p/"), (10, "://h://p/"), (None, "ftp://net/fr/"), (11, "http://x.org/" + "a" * 3000), (12, "http://net.fr/é\n/b?c")]
    df = spark.createDataFrame([(*r, "z") for r in rows], "page_id bigint, url string, rule string")
    got = {r.page_id: r for r in urls.judge_urls(df).collect()}
    assert (got[1].host, got[1].path, got[2].host) == ("", "", "")
    assert (got[3].host, got[3].path, got[3].rule, got[3].verdict) == ("a.example.com", "/en/x", "example.com/en/", "block")
    assert (got[4].rule, got[4].verdict) == ("www.example.com/en/", "allow")
    assert (got[5].rule, got[5].path, got[6].path) == (None, "", "")
    assert got[7].rule == "net/es/" and got[8].rule is None and got[9].rule == "com/"
    assert (got[10].host, got[10].path) == ("h:", "//p/") and got[None].verdict == "block"
    assert got[12].path == "/é\n/b"
    assert urls.judge_urls(df.limit(0)).count() == 0
    assert {r.verdict for r in urls.judge_urls(df.filter("page_id in (1, 2, 11)")).collect()} == {"allow"}


MIT = ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE."]
BSD = ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:", "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.", "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.", "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."]
APACHE = ["Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at", "http://www.apache.org/licenses/LICENSE-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License."]
GPL = ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License."]
MPL = ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy was not distributed, get one."]


def test_licence_layouts(spark):
    texts = [(MIT, 3, "MIT"), (BSD, 4, "BSD-3-Clause"), (APACHE, 4, "Apache-2.0"), (GPL, 2, "GPL-3.0-or-later"), (MPL, 1, "MPL-2.0"), (["All rights. Reserved words follow."], 0, ""), (["All rights", "reserved words follow."], 0, "")]
    rows, want = [], []
    for parts, n, licence in texts:
        lines = [y for k, part in enumerate(parts) for y in [""] * (k > 0) + textwrap.wrap(part, 60)]
        layouts = ["\n".join(lines), "\r\n".join(lines), *("\n".join(p + y for y in lines) for p in (" * ", "// ", "# ", ";; ", "REM ", "dnl "))]
        for x in [*layouts, "\n\n".join(parts), *[" ".join(parts)] * (n > 0)]:
            rows.append((len(rows), "Copyright (c) 2020 A. Author, some rights\n\n" + x + "\n\nint main;"))
            want.append((n, licence))
    got = sorted(licences.scan_licences(spark.createDataFrame(rows, "doc_id bigint, text string")).collect())
    bad = [(rows[r.doc_id][1], r.sentence_ids, r.licences) for r, w in zip(got, want) if (r.n_sentences, r.licences) != w]
    assert not bad, bad[0]


def test_whole_urls(spark):
    rows = [(i, f"http://www.example.com/en/{i}?sort=asc") for i in range(30)] + [(100 + i, f"http://b.net/es/{i}?xxqq=zz") for i in range(30)]
    rows += [(200, "http://x.org/p?sort=asc&sort=asc"), (201, "http://x.org/p?xxqq=zz&xxqq=zz"), (202, "sort=asc"), (203, "xxqq=zz"), (204, None)]
    df = spark.createDataFrame(rows, "page_id bigint, url string")
    got = {r.page_id: r for r in urls.judge_urls(df).collect()}
    assert [got[i].verdict for i in (200, 201, 202, 203)] == ["allow", "block", "allow", "block"]
    assert (got[200].host, got[200].path, got[202].host) == ("x.org", "/p", "")
    again = {r.page_id: r.score for r in urls.judge_urls(df.repartition(7)).collect()}
    assert again == {k: r.score for k, r in got.items()}


def test_long_urls(spark):
    """A url of a million characters, in time that follows its length; characters beyond the basic plane are one each."""
    rows = [(i, f"http://a.com/{i}") for i in range(20)] + [(50 + i, f"http://b.net/es/{i}") for i in range(20)] + [(100, "http://x.org/" + "a/b?" * 250_000), (101, "\U0001f600" * 5)]
    df = spark.createDataFrame(rows, "page_id bigint, url string")
    began = time.perf_counter()
    got = {r.page_id: r for r in urls.judge_urls(df).collect()}
    assert time.perf_counter() - began < 30 and len(got[100].path) == 4 and got[100].verdict in ("allow", "block")
    grams = df.filter("page_id = 101").select(urls.grams(F.col("url")).alias("g")).first().g
    assert grams == ["\x02\x02\x02\U0001f600", "\x02\x02" + "\U0001f600" * 2, "\x02" + "\U0001f600" * 3, *["\U0001f600" * 4] * 2, "\U0001f600" * 3 + "\x03"]


def test_threshold_is_held_out(spark):
    """Texts that set the threshold don't train: a gram that they alone have is unknown to the models."""
    df = spark.createDataFrame([(i, f"http://a.com/{i}") for i in range(300)] + [(900 + i, f"http://b.net/es/{i}zz") for i in range(300)], "page_id bigint, url string")
    held = {r.page_id for r in df.filter(urls.held_out(F.col("url"))).collect()}
    assert 60 < len(held) < 180
    trained = df.filter(~urls.held_out(F.col("url")))
    assert trained.count() + len(held) == 600


def test_whole_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{SF}/pages.parquet'")
    got = QUERIES["op10_url_filter_whole"](spark, SF)
    want = con.execute(f"select {', '.join(got.columns)} from ({ORACLES['op10_url_filter_whole']})").fetchall()
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_published_texts(spark):
    """Whole published texts and headers, wrapped: each its licence and nothing unknown; a rule's gap is bounded."""
    liability = "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    as_is = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."
    mit = [MIT[0], MIT[1], MIT[2].replace(" IN NO EVENT SHALL THE AUTHORS BE LIABLE.", " " + liability)]
    apache = [APACHE[0], "    http://www.apache.org/licenses/LICENSE-2.0", APACHE[2].replace("See the License.", "See the License for the specific language governing permissions and limitations under the License.")]
    mpl = ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."]
    gpl = [GPL[0], GPL[1] + " for more details.", "You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."]
    gap = " ".join(f"word{i}" for i in range(60))
    texts = [(mit, "MIT"), ([*BSD, as_is], "BSD-3-Clause"), ([*BSD[:3], as_is], "BSD-2-Clause"), (apache, "Apache-2.0"), (mpl, "MPL-2.0"), (gpl, "GPL-3.0-or-later"), ([mit[0], gap, *mit[1:]], "unknown"), ([mit[0], gap[:200], *mit[1:]], "MIT")]
    texts += [([x], y) for x, y in (("SPDX-License-Identifier: LGPL-2.1-or-later", "LGPL-2.1-or-later"), ("Made available under the terms of the Eclipse Public License v2.0.", "EPL-2.0"), ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "CC-BY-SA-4.0"), ("Licensed under either of", ""), ("Distributed under GPLv3.", "GPL-3.0-only"), ("Released under the MIT.", "MIT"), ("Available under Apache-2.0.", "Apache-2.0"), ("Released under the GNU GPL v3 license.", "GPL-3.0-only"), ("Licensed under GPLv3.", "GPL-3.0-only"), ("Governed by\nCC-BY-4.0", "CC-BY-4.0"), ("Subject to the MPL 2.0", "MPL-2.0"), ("SPDX-License-Identifier: MIT OR Apache-2.0", "Apache-2.0,MIT"), ("SPDX-License-Identifier: (GPL-2.0-or-later WITH Classpath-exception-2.0) AND BSD-3-Clause OR ISC", "BSD-3-Clause,Classpath-exception-2.0,GPL-2.0-or-later,ISC"), ("Licensed under either of Apache License, Version 2.0 or MIT license at your option.", "Apache-2.0,MIT"), ("MIT License\n\nCopyright (c) 2020", "MIT"), ("A story of the MIT License and more, with permission.", ""), ("Mozilla Public License Version 2.0\n==================================\n\n1. Definitions\n--------------\n\n1.1. \"Contributor\"\n    means each individual or legal entity that creates, contributes to\n    the creation of, or owns Covered Software.", "MPL-2.0"), ("                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/>\n Everyone is permitted to copy and distribute verbatim copies\n of this license document, but changing it is not allowed.\n\n                            Preamble\n\n  The GNU General Public License is a free, copyleft license for\nsoftware and other kinds of works.", "GPL-3.0-only"), ("                  GNU LESSER GENERAL PUBLIC LICENSE\n                       Version 2.1, February 1999\n\n Copyright (C) 1991, 1999 Free Software Foundation, Inc.\n Everyone is permitted to copy and distribute verbatim copies\n of this license document, but changing it is not allowed.", "LGPL-2.1-only"), ("                                 Apache License\n                           Version 2.0, January 2004\n                        http://www.apache.org/licenses/\n\n   TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION\n\n   1. Definitions.", "Apache-2.0"), ("Eclipse Public License - v 2.0\n\nTHE ACCOMPANYING PROGRAM IS PROVIDED UNDER THE TERMS OF THIS ECLIPSE\nPUBLIC LICENSE (\"AGREEMENT\"). ANY USE, REPRODUCTION OR DISTRIBUTION OF THE PROGRAM CONSTITUTES RECIPIENT'S ACCEPTANCE OF THIS AGREEMENT.", "EPL-2.0"), ("Distributed under the Boost Software License, Version 1.0.", "BSL-1.0"))]
    rows = [(i, "\n".join(y for part in parts for y in [*([part] if "\n" in part else textwrap.wrap(part, 78)), ""])) for i, (parts, _) in enumerate(texts)]
    got = {r.doc_id: r.licences for r in licences.scan_licences(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert [got[i] for i in range(len(texts))] == [x for _, x in texts]


def test_long_runs(spark):
    """A million stops, line feeds, leads and names: time in proportion to the length."""
    texts = ["license " + "." * 1_000_000, "license" + "\n" * 1_000_000, "license " + "?! " * 300_000, "licensed under " * 60_000, "licensed under mit" + " or mit" * 100_000, "license v" + ".v" * 300_000]
    df = spark.createDataFrame([(i, x + " All rights reserved.") for i, x in enumerate(texts)], "doc_id bigint, text string").repartition(6)
    began = time.perf_counter()
    got = {r.doc_id: (r.n_sentences, r.licences) for r in licences.scan_licences(df).collect()}
    assert time.perf_counter() - began < 60
    assert {got[i] for i in (0, 1, 2, 3, 5)} == {(1, "proprietary")} and got[4] == (100_002, "MIT,proprietary")


def plain_marks(text):
    """The identifiers and gaps of a text, by trying every known sentence at every word of every sentence."""
    known = {tuple(k.split()): v for k, v in licences.SENTENCES.items()}
    names = {tuple(k.split()): v for k, v in licences.NAMES.items()}
    longest = max(map(len, known))
    heads = [tuple(x.split()) for lead in licences.LEADS for opener in licences.OPENERS for article in licences.ARTICLES for x in [f"{opener}{lead} {article}"]]
    heads = sorted({*heads}, key=len, reverse=True)
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    sentences = [re.findall("[a-z0-9]+", x) for x in re.split(r"\n[^a-z0-9\n]*\n|(?<![.!?])(?<![^a-z0-9]v)[.!?]+[ \t\r\n]+", low)]
    out, gap = [], 0
    for words in sentences:
        i = 0
        while i < len(words):
            best = next(((k, known[tuple(words[i : i + k])]) for k in range(min(longest, len(words) - i), 0, -1) if tuple(words[i : i + k]) in known), None)
            for head in heads:
                if tuple(words[i : i + len(head)]) == head:
                    j = i + len(head)
                    name = next(((k, names[tuple(words[j : j + k])]) for k in range(min(30, len(words) - j), 0, -1) if tuple(words[j : j + k]) in names), None)
                    if name and (best is None or len(head) + name[0] > best[0]):
                        best = (len(head) + name[0], name[1])
            if best is None:
                gap, i = gap + 1, i + 1
                continue
            if gap > licences.GAP:
                out.append("/")
            out.append(best[1])
            gap, i = 0, i + best[0]
    return out


def test_sequences_by_brute_force(spark):
    r = random.Random(6)
    pieces = [*r.sample(sorted(licences.SENTENCES), 12), *("licensed under the " + n for n in r.sample(sorted(licences.NAMES), 12)), "released under mit", "distributed under gplv3", "word", "other words here", "the license", "w " * 45]
    texts = []
    for _ in range(150):
        got = [r.choice(pieces) for _ in range(r.randrange(1, 7))]
        texts.append(r.choice([" ", ". ", "\n\n", "\n# "]).join(f"plain {x}" if r.random() < 0.5 else x.upper() for x in got) + " x y z.")
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for row in licences.scan_licences(df).collect():
        want = [x for x in plain_marks(texts[row.doc_id]) if x != "/"]
        assert row.sentence_ids.split() == want, texts[row.doc_id]

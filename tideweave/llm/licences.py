"""Licence scan by sentence rules; DataFrame operations only.

Texts are normalised (A-Z lower-cased, single line feeds, comment prefixes and everything else but a-z and 0-9 as one
blank; full stops and blank lines end sentences) and searched for known licence sentences, which are runs of whole words
within a sentence, so wrapped texts and texts on one line give the same. Sentences are those of licence texts and
headers, and references: a lead such as "licensed under the" before one of several hundred names, built from families
and versions. A text's identifiers in order form a sequence, parted where more than GAP other words stand between two.
Rules are tried in their order, and each takes all its runs of identifiers out of the sequence, so a longer rule before
a shorter one wins; a reference that no rule takes stands for its own licence. Identifiers that are left make the
licence `unknown`. Everything is one projection: no shuffle, and tables of fixed size in the plan.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Normalised sentences of licence texts and headers, and their identifiers.
SENTENCES = {
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so": "mit-0-grant",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "mit-grant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit-notice",
    "the above copyright notice and this permission notice including the next paragraph shall be included in all copies or substantial portions of the software": "mit-notice",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "as-is",
    "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software": "mit-liability",
    "you may not use this file except in compliance with the license": "apache-terms",
    "you may obtain a copy of the license at": "apache-copy",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "apache-warranty",
    "see the license for the specific language governing permissions and limitations under the license": "apache-see",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd-grant",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "bsd-source",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "bsd-binary",
    "all advertising materials mentioning features or use of this software must display the following acknowledgement": "bsd-advertising",
    "may be used to endorse or promote products derived from this software without specific prior written permission": "bsd-endorse",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd-endorse",
    "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed": "bsd-as-is",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "0bsd-grant",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc-grant",
    "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc-grant",
    "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness": "isc-as-is",
    "this software is provided as is without any express or implied warranty": "zlib-as-is",
    "in no event will the authors be held liable for any damages arising from the use of this software": "zlib-liability",
    "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions": "zlib-grant",
    "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so": "boost-grant",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed": "wtfpl",
    "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed": "gnu-text",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl-2-header",
    "if a copy of the mpl was not distributed with this file you can obtain one at": "mpl-2-copy",
    "is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose": "gnu-warranty",
    "you should have received a copy of the gnu general public license along with this program": "gnu-copy",
    "you should have received a copy of the gnu lesser general public license along with this library": "gnu-copy",
    "you should have received a copy of the gnu affero general public license along with this program": "gnu-copy",
    "all rights reserved": "reserved",
    "apache license version 2 0 january 2004": "apache-2-title",
    "terms and conditions for use reproduction and distribution": "apache-2-terms",
    "end of terms and conditions": "end-of-terms",
    "gnu general public license version 2 june 1991": "gpl-2-title",
    "gnu general public license version 3 29 june 2007": "gpl-3-title",
    "gnu lesser general public license version 2 1 february 1999": "lgpl-2.1-title",
    "gnu lesser general public license version 3 29 june 2007": "lgpl-3-title",
    "gnu affero general public license version 3 19 november 2007": "agpl-3-title",
    "the gnu general public license is a free copyleft license for software and other kinds of works": "gpl-3-preamble",
    "the gnu affero general public license is a free copyleft license for software and other kinds of works specifically designed to ensure cooperation with the community in the case of network server software": "agpl-3-preamble",
    "this version of the gnu lesser general public license incorporates the terms and conditions of version 3 of the gnu general public license supplemented by the additional permissions listed below": "lgpl-3-incorporates",
    "the licenses for most software are designed to take away your freedom to share and change it": "gnu-preamble",
    "contributor means each individual or legal entity that creates contributes to the creation of or owns covered software": "mpl-2-contributor",
    "the accompanying program is provided under the terms of this eclipse public license epl": "epl-1-program",
    "the accompanying program is provided under the terms of this eclipse public license agreement": "epl-program",
    "any use reproduction or distribution of the program constitutes recipient s acceptance of this agreement": "epl-acceptance",
}
# Runs of identifiers and the licence they stand for, in the order in which they are tried.
RULES = [
    ("mit-grant mit-notice as-is mit-liability", "MIT"),
    ("mit-grant mit-notice as-is", "MIT"),
    ("mit-0-grant as-is mit-liability", "MIT-0"),
    ("mit-0-grant as-is", "MIT-0"),
    ("bsd-grant bsd-source bsd-binary bsd-advertising bsd-endorse bsd-as-is", "BSD-4-Clause"),
    ("bsd-grant bsd-source bsd-binary bsd-advertising bsd-endorse", "BSD-4-Clause"),
    ("bsd-grant bsd-source bsd-binary bsd-endorse bsd-as-is", "BSD-3-Clause"),
    ("bsd-grant bsd-source bsd-binary bsd-endorse", "BSD-3-Clause"),
    ("bsd-grant bsd-source bsd-binary bsd-as-is", "BSD-2-Clause"),
    ("bsd-grant bsd-source bsd-binary", "BSD-2-Clause"),
    ("isc-grant isc-as-is", "ISC"),
    ("0bsd-grant isc-as-is", "0BSD"),
    ("zlib-as-is zlib-liability zlib-grant", "Zlib"),
    ("boost-grant as-is", "BSL-1.0"),
    ("boost-grant", "BSL-1.0"),
    ("unlicense", "Unlicense"),
    ("wtfpl", "WTFPL"),
    ("Apache-2.0 apache-terms apache-copy apache-warranty apache-see", "Apache-2.0"),
    ("Apache-2.0 apache-terms apache-copy apache-warranty", "Apache-2.0"),
    ("mpl-2-header mpl-2-copy", "MPL-2.0"),
    ("mpl-2-header", "MPL-2.0"),
    ("apache-2-title apache-2-terms end-of-terms", "Apache-2.0"),
    ("apache-2-title apache-2-terms", "Apache-2.0"),
    ("apache-2-title", "Apache-2.0"),
    ("lgpl-3-title gnu-text lgpl-3-incorporates", "LGPL-3.0-only"),
    ("lgpl-3-title gnu-text", "LGPL-3.0-only"),
    ("lgpl-3-title", "LGPL-3.0-only"),
    ("lgpl-2.1-title gnu-text gnu-preamble", "LGPL-2.1-only"),
    ("lgpl-2.1-title gnu-text", "LGPL-2.1-only"),
    ("lgpl-2.1-title", "LGPL-2.1-only"),
    ("agpl-3-title gnu-text agpl-3-preamble", "AGPL-3.0-only"),
    ("agpl-3-title gnu-text", "AGPL-3.0-only"),
    ("agpl-3-title", "AGPL-3.0-only"),
    ("gpl-3-title gnu-text gpl-3-preamble", "GPL-3.0-only"),
    ("gpl-3-title gnu-text", "GPL-3.0-only"),
    ("gpl-3-title", "GPL-3.0-only"),
    ("gpl-2-title gnu-text gnu-preamble", "GPL-2.0-only"),
    ("gpl-2-title gnu-text", "GPL-2.0-only"),
    ("gpl-2-title", "GPL-2.0-only"),
    ("MPL-2.0 mpl-2-contributor", "MPL-2.0"),
    ("mpl-2-contributor", "MPL-2.0"),
    ("EPL-2.0 epl-program epl-acceptance", "EPL-2.0"),
    ("EPL-1.0 epl-1-program epl-acceptance", "EPL-1.0"),
    ("EPL-2.0 epl-program", "EPL-2.0"),
    ("EPL-1.0 epl-1-program", "EPL-1.0"),
    ("reserved", "proprietary"),
]
# Exceptions that an expression adds to a licence.
EXCEPTIONS = ("Classpath-exception-2.0", "LLVM-exception", "GCC-exception-3.1", "Linux-syscall-note", "Autoconf-exception-3.0", "Bison-exception-2.2", "Font-exception-2.0", "OpenJDK-assembly-exception-1.0")
# Families of licences, their names and versions; other names and their licences.
GNU = {"GPL": ("gnu general public license", "gnu gpl", "gpl"), "LGPL": ("gnu lesser general public license", "gnu library general public license", "gnu lgpl", "lgpl"), "AGPL": ("gnu affero general public license", "gnu agpl", "agpl")}
GNU_VERSIONS = {"GPL": ("1.0", "2.0", "3.0"), "LGPL": ("2.0", "2.1", "3.0"), "AGPL": ("1.0", "3.0")}
COMMONS = {"by": "attribution", "by-sa": "attribution sharealike", "by-nc": "attribution noncommercial", "by-nd": "attribution noderivatives", "by-nc-sa": "attribution noncommercial sharealike", "by-nc-nd": "attribution noncommercial noderivatives"}
COMMONS_VERSIONS = ("1.0", "2.0", "2.5", "3.0", "4.0")
FAMILIES = {
    "Apache": (("apache license", "apache software license", "apache"), ("1.0", "1.1", "2.0")),
    "MPL": (("mozilla public license", "mpl"), ("1.0", "1.1", "2.0")),
    "EPL": (("eclipse public license", "epl"), ("1.0", "2.0")),
    "CDDL": (("common development and distribution license", "cddl"), ("1.0", "1.1")),
    "CPL": (("common public license", "cpl"), ("1.0",)),
    "EUPL": (("european union public license", "european union public licence", "eupl"), ("1.1", "1.2")),
    "BSL": (("boost software license", "boost license"), ("1.0",)),
    "Artistic": (("artistic license",), ("1.0", "2.0")),
    "OFL": (("sil open font license", "open font license", "ofl"), ("1.0", "1.1")),
    "AFL": (("academic free license",), ("2.1", "3.0")),
    "OSL": (("open software license",), ("2.1", "3.0")),
    "ZPL": (("zope public license",), ("2.0", "2.1")),
    "PSF": (("python software foundation license",), ("2.0",)),
    "ODbL": (("open database license",), ("1.0",)),
}
OTHERS = {
    "MIT": ("mit license", "mit licence", "expat license", "mit"),
    "ISC": ("isc license", "isc licence", "isc"),
    "Zlib": ("zlib license", "zlib libpng license", "zlib"),
    "0BSD": ("zero clause bsd license", "0bsd"),
    "BSD-2-Clause": ("2 clause bsd license", "two clause bsd license", "simplified bsd license", "bsd 2 clause license", "bsd 2 clause"),
    "BSD-3-Clause": ("3 clause bsd license", "three clause bsd license", "new bsd license", "modified bsd license", "bsd 3 clause license", "bsd 3 clause"),
    "BSD-4-Clause": ("4 clause bsd license", "original bsd license", "bsd 4 clause license", "bsd 4 clause"),
    "Unlicense": ("unlicense",),
    "WTFPL": ("do what the fuck you want to public license", "wtfpl"),
    "CC0-1.0": ("creative commons zero v1 0 universal", "creative commons cc0 1 0 universal", "cc0 1 0", "cc0"),
    "NCSA": ("university of illinois ncsa open source license", "ncsa"),
    "PostgreSQL": ("postgresql license", "postgresql"),
    "MS-PL": ("microsoft public license", "ms pl"),
    "Ruby": ("ruby license", "ruby s license"),
    "Vim": ("vim license",),
}
# What stands before a licence's name, and before that.
LEADS = ("licensed under", "relicensed under", "spdx license identifier", "released under", "distributed under", "published under", "provided under", "available under", "covered by", "governed by", "subject to")
OPENERS = ("", *(f"this {x} is " for x in ("work", "project", "software", "file", "program", "library", "package", "document", "code")), "made ")
#: Words, at most, of other text between two identifiers of a rule.
GAP = 40


def _names() -> dict[str, str]:
    """Normalised licence names and the licences they stand for."""
    plain = lambda x: re.sub("[^a-z0-9]+", " ", x.lower()).strip()
    said = lambda v: {plain(x) for x in ([v, v[:-2]] if v.endswith(".0") else [v])}
    out: dict[str, str] = {}
    for spdx, names in OTHERS.items():
        out |= dict.fromkeys((*names, plain(spdx)), spdx)
    for family, (names, versions) in FAMILIES.items():
        for v in versions:
            spdx = f"{family}-{v}"
            out |= {f"{n}{between}{x}{after}": spdx for n in names for x in said(v) for between in (" version ", " v", " v ", " ") for after in ("", " license") if n.endswith(("license", "licence")) <= (not after)}
            out[plain(spdx)] = spdx
    for family, names in GNU.items():
        for v in GNU_VERSIONS[family]:
            only, later = f"{family}-{v}-only", f"{family}-{v}-or-later"
            versioned = [f"{n}{between}{x}" for n in names for x in said(v) for between in (" version ", " v", " v ", " ", "v")]
            out |= {n: only for n in versioned} | {f"{n} only": only for n in versioned}
            out |= {f"{n} {more}": later for n in versioned for more in ("or later", "or any later version", "or at your option any later version")}
            out |= {plain(only): only, plain(later): later}
            out |= {f"{names[0]} as published by the free software foundation either version {x} of the license or at your option any later version": later for x in said(v)}
            out |= {f"{names[0]} as published by the free software foundation version {x} of the license": only for x in said(v)}
    for kind, name in COMMONS.items():
        for v in COMMONS_VERSIONS:
            spdx = f"CC-{kind.upper()}-{v}"
            out |= {f"{a} {b}": spdx for a in (f"creative commons {name}", f"cc {plain(kind)}") for b in (f"{plain(v)} international license", f"{plain(v)} international", f"{plain(v)} unported", f"{plain(v)} license", plain(v))}
    return out


#: References: the name after `@` and the identifier, which is the licence.
NAMES = _names()
#: What may follow a reference and `or`, `and` or `with`.
MORE = NAMES | {re.sub("[^a-z0-9]+", " ", x.lower()).strip(): x for x in EXCEPTIONS}
#: The notices of GNU headers go with the licence before them.
RULES += [(f"{x} {more}", x) for more in ("gnu-warranty gnu-copy", "gnu-warranty", "gnu-copy") for x in sorted(set(NAMES.values())) if x.split("-")[0] in GNU]
#: A reference begins with one of these.
ARTICLES = ("", "the terms of the ", "the terms of ", "the ", "a ", "an ", "either of the ", "either of ", "either the ", "either ")
#: A stem of every known sentence or lead: texts with none of them are not cut up.
STEMS = "licen|permission|copyright|warrant|redistribut|rights reserved|public domain|endorse|advertising|(?:released|distributed|published|provided|available)[^a-z0-9]+under|(?:covered|governed)[^a-z0-9]+by|subject[^a-z0-9]+to|accompanying program|constitutes recipient|terms and conditions|covered software|designed to take away"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Ends of sentences in lower-cased text: stops, though not that of a version's "v.", and lines without letters or digits.
#: A run of stops is tried once, from its first one, so a text of stops alone takes time in proportion.
ENDS = "\\n[^a-z0-9\\n]*+\\n|(?<![.!?])(?<![^a-z0-9]v)[.!?]++[ \\t\\r\\n]++"
#: Comment prefixes of letters; those of signs go with all signs.
PREFIX = "\\n[ \\t]*(rem|dnl)[ \\t]+"


def _tree(sentences) -> str:
    """A pattern of word runs that shares their beginnings, so that a text's word is tried once; the longest run wins."""
    root: dict = {}
    for x in sentences:
        at = root
        for w in x.split():
            at = at.setdefault(w, {})
        at[""] = {}

    def pattern(node) -> str:
        more = "|".join(w + (f" {pattern(n)}" if "" not in n else f"(?: {pattern(n)})?" if len(n) > 1 else "") for w, n in sorted(node.items()) if w)
        return f"(?:{more})"

    return pattern(root)


_OPEN = f"(?:{'|'.join(x for x in OPENERS if x)})?"
#: What goes for `@` before a reference is looked up.
LEAD = f"{_OPEN}(?:{'|'.join(LEADS)}) (?:{'|'.join(x for x in ARTICLES if x)})?"
#: GNU headers: redistribute and modify under the terms of a named licence.
HEADER = "(?:this (?:program|library|software|file) is free software )?you can redistribute it and or modify it under the terms of the "
#: Known sentences, of two that begin at the same word the longer one; and headings, which are a name between ends alone.
KNOWN = f"(?<![a-z0-9])({_tree(SENTENCES)}|(?:{LEAD}|{HEADER}){_tree(NAMES)}|(?<=Z |^ ?){_tree(NAMES)}(?= ?(?:Z|$)))(?![a-z0-9])"
#: Names that go on with a reference or an expression: each begins where a known sentence or the name before it has ended.
AND = f"(?:(?<=[a-z0-9]Q)|(?<!^)\\G)( (?:or|and|with|and or) (?:the |a |an )?)({_tree(MORE)})(?![a-z0-9])"
LOOKUP = SENTENCES | {"@" + n: spdx for n, spdx in MORE.items()}


def pieces(text: Column) -> Column:
    """A text's other words and known sentences by turns: other, known, other, ..., other."""
    low = F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER)
    ended = F.regexp_replace(F.regexp_replace(low, PREFIX, "\n"), ENDS, "Z")  # low has no capitals
    plain = F.regexp_replace(ended, "[^a-z0-9Z]+", " ")
    marked = F.regexp_replace(F.regexp_replace(plain, KNOWN, "Q$1Q"), AND, "$1Q@$2Q")
    return F.when(low.rlike(STEMS), F.split(marked, "Q")).otherwise(F.array(F.lit("")))


def sequence(parts: Column) -> Column:
    """Identifiers of pieces(), and `/` where more than GAP words part two."""
    known = F.create_map(*[F.lit(x) for kv in LOOKUP.items() for x in kv])
    said = lambda x: F.try_element_at(known, F.regexp_replace(x, f"^(?:{LEAD}|{HEADER})", "@"))
    wide = lambda x: F.when(F.regexp_count(x, F.lit("[a-z0-9]+")) > GAP, "/")
    return F.array_compact(F.transform(parts, lambda x, i: F.when(i % 2 == 1, F.coalesce(F.try_element_at(known, x), said(x), F.try_element_at(known, F.concat(F.lit("@"), x)))).otherwise(wide(x))))


def scan_licences(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text, ...) to (doc_id, n_sentences, sentence_ids, licences), one row per row of docs.

    n_sentences counts known sentences; sentence_ids has them in order, blank-joined; licences is sorted and
    comma-joined, with `unknown` last if some identifier was left over, empty without any. Null and empty texts have
    none; an empty table gives no rows. A sentence that is repeated counts each time. A text of any length is one value
    in one task. Other columns are ignored, so their names can't clash.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), pieces(F.col("text")).alias("parts"))
    rows = rows.select("doc_id", F.when(F.size("parts") > 1, sequence(F.col("parts"))).otherwise(F.array().cast("array<string>")).alias("marks"))
    rows = rows.select("doc_id", "marks", F.filter("marks", lambda x: x != "/").alias("ids"))
    take = F.aggregate(
        F.array(*[F.struct(F.lit(" " + run.replace(" ", "  ") + " ").alias("run"), F.lit(name).alias("name")) for run, name in RULES]),
        F.struct(F.concat_ws("", F.transform("marks", lambda x: F.when(x == "/", x).otherwise(F.concat(F.lit(" "), x, F.lit(" "))))).alias("left"), F.array().cast("array<string>").alias("found")),
        lambda acc, r: F.struct(
            F.replace(acc["left"], r["run"], F.lit("/")).alias("left"),
            F.when(F.contains(acc["left"], r["run"]), F.array_union(acc["found"], F.array(r["name"]))).otherwise(acc["found"]).alias("found"),
        ),
    )
    none = F.struct(F.lit("").alias("left"), F.array().cast("array<string>").alias("found"))
    rows = rows.withColumn("took", F.when(F.size("ids") > 0, take).otherwise(none))
    left = F.filter(F.split("took.left", "[ /]+"), lambda x: x != "")
    own = F.array(*[F.lit(x) for x in sorted(set(MORE.values()))])
    found = F.array_sort(F.array_union("took.found", F.array_intersect(left, own)))
    unknown = F.when(F.exists(left, lambda x: ~F.array_contains(own, x)), F.array(F.lit("unknown"))).otherwise(F.array().cast("array<string>"))
    return rows.select("doc_id", F.size("ids").cast("bigint").alias("n_sentences"), F.array_join("ids", " ").alias("sentence_ids"), F.array_join(F.concat(found, unknown), ",").alias("licences"))


def duckdb_sql() -> str:
    """The same over a table documents: the fixed values above in SQL."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    known = f"map {{{', '.join(f'{quoted(k)}: {quoted(v)}' for k, v in LOOKUP.items())}}}"
    own = f"[{', '.join(map(quoted, sorted(set(MORE.values()))))}]"
    steps = reduce(
        lambda sql, r: f"select doc_id, ids, replace(l, {quoted(' ' + r[0].replace(' ', '  ') + ' ')}, '/') as l, case when contains(l, {quoted(' ' + r[0].replace(' ', '  ') + ' ')}) and not list_contains(found, {quoted(r[1])}) then list_append(found, {quoted(r[1])}) else found end as found from ({sql})",
        RULES,
        "select doc_id, ids, array_to_string(list_transform(ids, lambda x: ' ' || x || ' '), '') as l, []::varchar[] as found from i",
    )
    return f"""
with n as (
  select doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') as low from documents
), s as (
  select doc_id, case when regexp_matches(low, '{STEMS}') then list_transform(string_split(regexp_replace(regexp_replace(low, '[.!?]+[ \\t\\r\\n]+', chr(10), 'g'), '[^a-z0-9\\n]+', ' ', 'g'), chr(10)), lambda x: trim(x)) else [] end as parts from n
), m as (select {known} as known), i as (
  select doc_id, list_filter(list_transform(parts, lambda x: coalesce(known[x], known[regexp_replace(x, '^(?:{LEAD}|{HEADER})', '@')])), lambda x: x is not null) as ids from s, m
), r as ({steps}), o as (
  select doc_id, ids, found, list_filter(string_split_regex(l, '[ /]+'), lambda x: x <> '') as l from r
), f as (
  select doc_id, ids, list_sort(list_distinct(list_concat(found, list_filter(l, lambda x: list_contains({own}, x))))) as found, len(list_filter(l, lambda x: not list_contains({own}, x))) as unknown from o
)
select doc_id, len(ids)::bigint as n_sentences, coalesce(array_to_string(ids, ' '), '') as sentence_ids,
  coalesce(array_to_string(case when unknown > 0 then list_append(found, 'unknown') else found end, ','), '') as licences
from f
"""

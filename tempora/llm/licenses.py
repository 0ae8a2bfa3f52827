"""Licence scan by sentence rules, in DataFrame functions only.

Sentences end at line ends and after ``. ! ? : ;``, and one may also go on over
line ends (for wrapped lines).  A text is normalised to its lower-case letters
and digits and these two kinds of ends; every stretch from one end to another
that is a known licence sentence gives its identifier, from left to right, the
longest first, so headings and other lines beside a sentence do no harm.  The
identifiers of a text, in order, are matched against ordered licence rules: each
rule that matches names its licence and takes the identifiers it matched out, so
specific rules come first.

Every step is an expression over one row, so nothing is shuffled and repeated
rows, ties and hot sources cost what other rows cost.

Defined cases: null and empty texts, and texts without a known sentence, have
no identifiers and no licences (empty strings); a table without rows gives none;
very long texts are read whole, by expressions whose work is linear in their
length; repeated rows are all returned; other columns are kept, and one named
like an output column is replaced.
"""

from __future__ import annotations

import re

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame

# Sentences of published licences and common licence notices, by identifier.
SENTENCES = {
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions",
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    "mit-as-is": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT",
    "mit-liability": "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE",
    "mit-short": "Released under the MIT License",
    "mit-short-2": "Licensed under the MIT License",
    "mit-short-3": "This project is licensed under the MIT License",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "isc-as-is": "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
    "bsd-names": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd-adverts": "All advertising materials mentioning features or use of this software must display the following acknowledgement",
    "bsd-as-is": "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED",
    "bsd-short": "Licensed under the BSD License",
    "apache-grant": "you may not use this file except in compliance with the License",
    "apache-head": "Licensed under the Apache License, Version 2.0 (the \"License\")",
    "apache-copy": "You may obtain a copy of the License at",
    "apache-as-is": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied",
    "apache-see": "See the License for the specific language governing permissions and limitations under the License",
    "apache-short": "Licensed under the Apache License, Version 2.0",
    "gpl-or-later-3": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "gpl-or-later-2": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later version",
    "gpl-terms": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "gpl-later-2": "either version 2 of the License, or (at your option) any later version",
    "gpl-later-3": "either version 3 of the License, or (at your option) any later version",
    "lgpl-terms": "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    "lgpl-later-21": "either version 2.1 of the License, or (at your option) any later version",
    "lgpl-or-later-21": "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 2.1 of the License, or (at your option) any later version",
    "lgpl-or-later-3": "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "agpl-or-later-3": "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "gpl-hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY",
    "gpl-implied": "without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE",
    "gpl-see": "See the GNU General Public License for more details",
    "gpl-copy": "You should have received a copy of the GNU General Public License along with this program",
    "gpl-short-3": "This work is licensed under the GNU General Public License, version 3",
    "gpl-short-2": "This work is licensed under the GNU General Public License, version 2",
    "mpl-head": "This Source Code Form is subject to the terms of the Mozilla Public License, v",
    "mpl-copy": "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/",
    "zlib-as-is": "This software is provided 'as-is', without any express or implied warranty",
    "zlib-liability": "In no event will the authors be held liable for any damages arising from the use of this software",
    "zlib-grant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",
    "0bsd-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "bsl-grant": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following",
    "epl-2": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0",
    "apache-text": "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form",
    "gpl-3-text": "The GNU General Public License is a free, copyleft license for software and other kinds of works",
    "gpl-2-text": "By contrast, the GNU General Public License is intended to guarantee your freedom to share and change free software--to make sure the software is free for all its users",
    "lgpl-21-text": "By contrast, the GNU General Public Licenses are intended to guarantee your freedom to share and change free software--to make sure the software is free for all its users",
    "lgpl-3-text": "This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU General Public License, supplemented by the additional permissions listed below",
    "agpl-3-text": "The GNU Affero General Public License is a free, copyleft license for software and other kinds of works, specifically designed to ensure cooperation with the community in the case of network server software",
    "cc-by-text": "By exercising the Licensed Rights (defined below), You accept and agree to be bound by the terms and conditions of this Creative Commons Attribution 4.0 International Public License (\"Public License\")",
    "cc-by-sa-text": "By exercising the Licensed Rights (defined below), You accept and agree to be bound by the terms and conditions of this Creative Commons Attribution-ShareAlike 4.0 International Public License (\"Public License\")",
    "cc0-short": "Licensed under CC0 1.0",
    "cc-by-short": "Licensed under CC BY 4.0",
    "cc-by-sa-short": "Licensed under CC BY-SA 4.0",
    "cc-by-nc-short": "Licensed under CC BY-NC 4.0",
    "cc-by-nd-short": "Licensed under CC BY-ND 4.0",
    "cc-by-long": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "cc-by-sa-long": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "cc-by-nc-long": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
    "unlicense": "This is free and unencumbered software released into the public domain",
    "reserved": "All rights reserved",
    "spdx-mit": "SPDX-License-Identifier MIT",
    "spdx-apache": "SPDX-License-Identifier Apache-2.0",
    "spdx-gpl-3": "SPDX-License-Identifier GPL-3.0-or-later",
    "spdx-gpl-2": "SPDX-License-Identifier GPL-2.0-only",
    "spdx-bsd-3": "SPDX-License-Identifier BSD-3-Clause",
}

# Licence rules in the order in which they apply; (a) is an optional sentence, a/b a choice.
RULES = [
    ("BSD-4-Clause", "bsd-grant bsd-source bsd-binary bsd-adverts bsd-names (bsd-as-is)"),
    ("BSD-3-Clause", "bsd-grant bsd-source bsd-binary bsd-names (bsd-as-is)"),
    ("BSD-2-Clause", "bsd-grant bsd-source bsd-binary (bsd-as-is)"),
    ("MIT", "mit-grant mit-notice (mit-as-is) (mit-liability)"),
    ("ISC", "isc-grant (isc-as-is)"),
    ("Apache-2.0", "apache-head apache-grant (apache-copy) (apache-as-is) (apache-see)"),
    ("AGPL-3.0-or-later", "agpl-or-later-3"),
    ("LGPL-3.0-or-later", "lgpl-or-later-3 (gpl-hope) (gpl-implied)"),
    ("LGPL-2.1-or-later", "lgpl-or-later-21 (gpl-hope) (gpl-implied)"),
    ("LGPL-2.1-or-later", "lgpl-terms lgpl-later-21 (gpl-hope) (gpl-implied)"),
    ("LGPL-3.0-or-later", "lgpl-terms gpl-later-3 (gpl-hope) (gpl-implied)"),
    ("GPL-3.0-or-later", "gpl-or-later-3 (gpl-hope) (gpl-implied) (gpl-see) (gpl-copy)"),
    ("GPL-2.0-or-later", "gpl-or-later-2 (gpl-hope) (gpl-implied) (gpl-see) (gpl-copy)"),
    ("GPL-3.0-or-later", "gpl-terms gpl-later-3 (gpl-hope) (gpl-implied) (gpl-see) (gpl-copy)"),
    ("GPL-2.0-or-later", "gpl-terms gpl-later-2 (gpl-hope) (gpl-implied) (gpl-see) (gpl-copy)"),
    ("GPL-3.0-or-later", "spdx-gpl-3"),
    ("AGPL-3.0", "agpl-3-text"),
    ("LGPL-3.0", "lgpl-3-text"),
    ("LGPL-2.1", "lgpl-21-text"),
    ("GPL-3.0", "gpl-short-3/gpl-3-text"),
    ("GPL-2.0", "gpl-short-2/spdx-gpl-2/gpl-2-text"),
    ("MPL-2.0", "mpl-head (mpl-copy)"),
    ("Zlib", "zlib-as-is (zlib-liability) zlib-grant"),
    ("0BSD", "0bsd-grant (isc-as-is)"),
    ("BSL-1.0", "bsl-grant"),
    ("EPL-2.0", "epl-2"),
    ("Apache-2.0", "apache-short/spdx-apache/apache-text"),
    ("MIT", "mit-short/mit-short-2/mit-short-3/spdx-mit"),
    ("BSD", "bsd-short"),
    ("BSD-3-Clause", "spdx-bsd-3"),
    ("CC0-1.0", "cc0-short"),
    ("CC-BY-4.0", "cc-by-short/cc-by-long/cc-by-text"),
    ("CC-BY-SA-4.0", "cc-by-sa-short/cc-by-sa-long/cc-by-sa-text"),
    ("CC-BY-NC-4.0", "cc-by-nc-short/cc-by-nc-long"),
    ("CC-BY-ND-4.0", "cc-by-nd-short"),
    ("Unlicense", "unlicense"),
    ("all-rights-reserved", "reserved"),
]

#: Each known sentence, however its lines are broken, holds one of these, so texts without them need no splitting.
HINT = r"(?i)licen[sc]|copyright|permission|distribut|warrant|provided|software|version|rights[^A-Za-z0-9]+reserved"
SPDX, AFTER_STOP, LINE_ENDS, OTHER_SIGNS = r"(?i)SPDX-License-Identifier:[ \t]*", r"([.!?:;])[ \t\r\n\f]+", r"[\r\n]+", r"[^A-Za-z0-9]+"


def normalised(sentence: str) -> str:
    return re.sub(OTHER_SIGNS, " ", sentence).strip().lower()


def rule_pattern(rule: str) -> str:
    """A regular expression over ``|id|id|``; the last bar stays for the next match."""
    parts = []
    for word in rule.split():
        optional, names = word.startswith("("), "|".join(re.escape(n).replace("\\-", "-") for n in word.strip("()").split("/"))
        parts.append(f"(?:\\|(?:{names}))" + ("?" if optional else ""))
    return "".join(parts) + r"\|"


def _known_pattern() -> str:
    """A known sentence between two ends (``|`` after a stop, ``/`` between lines), lines within it joined."""
    longest_first = sorted(map(normalised, SENTENCES.values()), key=lambda s: (-len(s), s))
    return "(?<=[|/])(?:" + "|".join(s.replace(" ", "[ /]") for s in longest_first) + ")(?=[|/])"


def _identifiers(text: Column) -> Column:
    known = F.create_map(*[F.lit(x) for i, s in SENTENCES.items() for x in (normalised(s), i)])
    plain = F.regexp_replace(F.translate(text, "|/", "##"), AFTER_STOP, "|")
    plain = F.regexp_replace(F.regexp_replace(plain, LINE_ENDS, "/"), "[^A-Za-z0-9|/]+", " ")
    plain = F.regexp_replace(F.regexp_replace(plain, " ?/[ /]*+", "/"), r"[ /]?\|[ |/]*+", "|")
    ended = F.concat(F.lit("|"), F.lower(F.trim(plain)), F.lit("|"))
    found = F.regexp_extract_all(ended, F.lit(_known_pattern()), F.lit(0))
    return F.transform(found, lambda s: F.try_element_at(known, F.translate(s, "/", " ")))


def _matched(identifiers: Column) -> Column:
    """The licences that the rules find in a text's identifiers, in the order of the rules."""
    rules = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(rule_pattern(rule)).alias("pattern")) for name, rule in RULES])
    start = F.struct(F.concat(F.lit("|"), F.array_join(identifiers, "|"), F.lit("|")).alias("left"), F.array().cast("array<string>").alias("found"))

    def apply(so: Column, rule: Column) -> Column:
        hit = F.regexp_like(so["left"], rule["pattern"])
        return F.when(hit, F.struct(F.regexp_replace(so["left"], rule["pattern"], F.lit("|")).alias("left"), F.concat(so["found"], F.array(rule["name"])).alias("found"))).otherwise(so)

    return F.aggregate(rules, start, apply)["found"]


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``sentence_ids`` and ``licences``, both joined by commas."""
    hinted = F.when(F.regexp_like(F.col(f"`{text}`"), F.lit(HINT)), F.regexp_replace(F.col(f"`{text}`"), SPDX, "SPDX-License-Identifier "))
    rows = docs.withColumn("sentence_ids", _identifiers(hinted))
    found = F.when(F.size("sentence_ids") > 0, F.array_distinct(_matched(F.col("sentence_ids"))))
    return rows.withColumn("licences", F.coalesce(F.array_join(found, ","), F.lit(""))).withColumn("sentence_ids", F.coalesce(F.array_join("sentence_ids", ","), F.lit("")))


def oracle_sql() -> str:
    """The scan of ``documents`` in DuckDB's SQL."""

    def quoted(s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    known = "MAP {" + ", ".join(f"{quoted(normalised(s))}: {quoted(i)}" for i, s in SENTENCES.items()) + "}"
    # every end is doubled, so that each sentence takes one of its own on both sides
    longest_first = sorted(map(normalised, SENTENCES.values()), key=lambda s: (-len(s), s))
    sentence = "[|/](" + "|".join(s.replace(" ", "(?: |//)") for s in longest_first) + ")[|/]"
    plain = f"regexp_replace(regexp_replace(text, {quoted(SPDX)}, 'SPDX-License-Identifier ', 'g'), '[|/]', '#', 'g')"
    for pattern, to in ((AFTER_STOP, "|"), (LINE_ENDS, "/"), ("[^A-Za-z0-9|/]+", " "), (" ?/[ /]*", "/"), (r"[ /]?\|[ |/]*", "|")):
        plain = f"regexp_replace({plain}, {quoted(pattern)}, {quoted(to)}, 'g')"
    steps = []
    for k, (name, rule) in enumerate(RULES):
        hit = f"regexp_matches(seq, {quoted(rule_pattern(rule))})"
        steps.append(f"r{k + 1} AS (SELECT r, ids, CASE WHEN {hit} THEN regexp_replace(seq, {quoted(rule_pattern(rule))}, '|', 'g') ELSE seq END AS seq, CASE WHEN {hit} THEN list_append(found, {quoted(name)}) ELSE found END AS found FROM r{k})")
    return f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
ended AS (SELECT r, replace(replace('|' || lower(trim({plain})) || '|', '|', '||'), '/', '//') AS text, {known} AS known FROM docs),
found AS (SELECT r, list_transform(regexp_extract_all(text, {quoted(sentence)}, 1), lambda s: known[replace(s, '//', ' ')]) AS ids FROM ended),
r0 AS (SELECT r, ids, '|' || array_to_string(ids, '|') || '|' AS seq, []::VARCHAR[] AS found FROM found WHERE len(ids) > 0),
{", ".join(steps)},
firsts AS (SELECT r, ids, list_filter(found, lambda x, i: list_position(found, x) = i) AS found FROM r{len(RULES)})
SELECT d.doc_id, coalesce(array_to_string(ids, ','), '') AS sentence_ids, coalesce(array_to_string(found, ','), '') AS licences
FROM docs d LEFT JOIN firsts f ON d.r = f.r
"""

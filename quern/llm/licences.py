"""Licence scan by sentence rules, with DataFrame operations only.

A text is cut into sentences, each is normalised (A-Z lower-cased, every run of other than
letters and digits one blank) and looked up among known licence sentences.  The identifiers
found, in order, are matched against licence rules, each an ordered list of identifiers without
a known sentence between them.  Sentences are cut three times: with line breaks as blanks
(licence texts are wrapped), with line breaks as ends (notices are lines), and by sections, where
blank lines and copyright lines are ends but ';' and 'v. ' are not (the wrapped texts as their
authors set them).  A rule may match in any; what the sections show comes on top of the others.

Texts without any of the words that every known sentence contains are not cut at all; they can
match nothing.  Null and empty texts have no licences, texts of any length are read whole,
repeated rows and ids are scanned each for itself, a licence that several rules find is named once,
and an empty table gives an empty result.  Input columns that are named like an added one are
replaced, all others stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.labelled import fresh

# Normalised sentences of public licence texts and notices, by identifier.
SENTENCES = {
    1: "released under the mit license",
    2: "licensed under the mit license",
    3: "this project is licensed under the mit license",
    4: "licensed under the apache license version 2 0",
    5: "licensed under the apache license version 2 0 the license",
    6: "you may not use this file except in compliance with the license",
    7: "you may obtain a copy of the license at http www apache org licenses license 2 0",
    8: "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    9: "see the license for the specific language governing permissions and limitations under the license",
    10: "this work is licensed under the gnu general public license version 3",
    11: "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    12: "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    13: "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    14: "see the gnu general public license for more details",
    15: "licensed under cc by nc 4 0",
    16: "licensed under cc by 4 0",
    17: "licensed under cc by sa 4 0",
    18: "this work is licensed under a creative commons attribution 4 0 international license",
    19: "this work is licensed under a creative commons attribution noncommercial 4 0 international license",
    20: "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    21: "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    22: "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    23: "spdx license identifier mit",
    24: "spdx license identifier apache 2 0",
    25: "spdx license identifier gpl 3 0 only",
    26: "spdx license identifier gpl 3 0 or later",
    27: "spdx license identifier bsd 3 clause",
    28: "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    29: "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
    30: "this is free and unencumbered software released into the public domain",
    31: "this source code form is subject to the terms of the mozilla public license v 2 0",
    32: "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0",
}
# Licences as ordered sentence identifiers.
RULES = (
    ("MIT", "notice", (1,)), ("MIT", "notice", (2,)), ("MIT", "notice", (3,)), ("MIT", "tag", (23,)), ("MIT", "text", (20, 21, 22)),
    ("Apache-2.0", "notice", (4,)), ("Apache-2.0", "tag", (24,)), ("Apache-2.0", "header", (5, 6, 7, 8, 9)), ("Apache-2.0", "header", (4, 6, 7, 8, 9)),
    ("GPL-3.0-only", "notice", (10,)), ("GPL-3.0-only", "tag", (25,)), ("GPL-3.0-or-later", "tag", (26,)), ("GPL-3.0-or-later", "header", (11, 13, 14)), ("GPL-2.0-or-later", "header", (12, 13, 14)),
    ("CC-BY-NC-4.0", "notice", (15,)), ("CC-BY-NC-4.0", "notice", (19,)), ("CC-BY-4.0", "notice", (16,)), ("CC-BY-4.0", "notice", (18,)), ("CC-BY-SA-4.0", "notice", (17,)),
    ("BSD-3-Clause", "tag", (27,)), ("ISC", "text", (28, 29)), ("Unlicense", "notice", (30,)), ("MPL-2.0", "header", (31, 32)),
)
_URL = ("http www apache org licenses license 2 0", "https www apache org licenses license 2 0")
_AT = "you may obtain a copy of the license at"
_CONDITIONS, _NOTICE = SENTENCES[20].split(" the above copyright notice ")
# More sentences of public licence texts, which only sections are searched for.
MORE_SENTENCES = {
    40: "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    41: "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    42: "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    43: "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    44: "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
    45: "in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage",
    46: "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version",
    47: "this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    48: "see the gnu lesser general public license for more details",
    49: "this program is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    50: "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    51: "see the gnu affero general public license for more details",
    52: "this software is provided as is without any express or implied warranty",
    53: "in no event will the authors be held liable for any damages arising from the use of this software",
    54: "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    55: "the origin of this software must not be misrepresented you must not claim that you wrote the original software",
    56: "if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required",
    57: "altered source versions must be plainly marked as such and must not be misrepresented as being the original software",
    58: "this notice may not be removed or altered from any source distribution",
    59: "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0",
    60: "to the extent possible under law the author s have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide",
    61: "this software is distributed without any warranty",
}
# Their licences as ordered sentence identifiers.
MORE_RULES = (
    ("BSD-3-Clause", "text", (40, 41, 42, 43, 44, 45)), ("BSD-2-Clause", "text", (40, 41, 42, 44, 45)),
    ("LGPL-2.1-or-later", "header", (46, 47, 48)), ("LGPL-3.0-or-later", "header", (49, 13, 48)), ("AGPL-3.0-or-later", "header", (50, 13, 51)),
    ("Zlib", "text", (52, 53, 54, 55, 56, 57, 58)), ("EPL-2.0", "notice", (59,)), ("CC0-1.0", "text", (60, 61)),
)
#: Sentences as sections cut them; one identifier may have several spellings.
SECTION_SENTENCES = (
    {s: i for i, s in SENTENCES.items()}
    | {f"{SENTENCES[5]} {SENTENCES[6]}": 33, _AT: 34, f"{_AT} {_URL[1]}": 7, SENTENCES[32].replace("https", "http"): 32}
    | {u: 35 for u in _URL}
    | {f"{u} {SENTENCES[8]}": 36 for u in _URL}
    | {f"{_AT} {u} {SENTENCES[8]}": 37 for u in _URL}
    | {_CONDITIONS: 38, f"the above copyright notice {_NOTICE}": 39}
    | {s: i for i, s in MORE_SENTENCES.items()}
    # the number of a first item that follows without a blank line
    | {f"{MORE_SENTENCES[i]} 1": i for i in (40, 54)}
    | {MORE_SENTENCES[45].replace("copyright holder or", f"copyright {who} or"): 45 for who in ("owner", "holders")}
)
#: More licences as ordered identifiers, for sections only.
SECTION_RULES = (
    *(("Apache-2.0", "header", (*start, *rest, 9)) for start in ((33,), (5, 6), (4, 6)) for rest in ((7, 8), (34, 35, 8), (34, 36), (37,))),
    ("MIT", "text", (38, 39, 21, 22)),
    *MORE_RULES,
)
#: Every known sentence contains one of these.
ANCHORS = ("license", "licensed", "permission", "warranty", "software", "mpl")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Ends of sentences: a mark before white space or the end.
ENDS = r"[.!?;]+(?:[\x09-\x0D\x20]+|$)"
LINE_ENDS = r"[.!?;]*[\x0A\x0D]+|[.!?;]+(?:[\x09-\x0D\x20]+|$)"
#: Ends of sentences in sections; a blank line may hold marks of a comment.
SECTION_ENDS = r"(?<!\bv)[.!?]+(?:[\x09-\x0D\x20]+|$)|\n[^a-z0-9\n]*\n"
#: A line that states a copyright (not one that a wrapped licence text starts with the word).
COPYRIGHT_LINE = r"(?dm)^[^a-z0-9\n]*(?:portions )?copyright[^a-z0-9\n]*(?:\(c\)|©|[0-9<\[{])[^\n]*"


def _quoted(s: str) -> str:
    return "'" + s + "'"


def known_ids(text: Column, ends: str, known: dict[str, int] | None = None) -> Column:
    """Identifiers of the known sentences of a lower-cased text, in order."""
    known = known or {s: i for i, s in SENTENCES.items()}
    table = F.create_map(*(F.lit(x) for pair in known.items() for x in pair))
    normal = lambda s: F.trim(F.regexp_replace(s, r"[^a-z0-9]+", " "))
    return F.filter(F.transform(F.split(text, ends), lambda s: table[normal(s)]), lambda i: i.isNotNull())


def section_ids(text: Column) -> Column:
    """Identifiers of the known sentences of a lower-cased text, cut by sections."""
    lines = F.regexp_replace(F.regexp_replace(text, r"\r\n?", "\n"), COPYRIGHT_LINE, "")
    return known_ids(lines, SECTION_ENDS, SECTION_SENTENCES)


def scan(documents: DataFrame, text: str = "text") -> DataFrame:
    """Add ``sentence_ids`` (array, by lines, by sentences, then those that only sections show) and ``licences`` (sorted names)."""
    low = F.translate(F.coalesce(F.col(text), F.lit("")), UPPER, LOWER)
    may = F.lit(False)
    for word in ANCHORS:
        may = may | F.contains(low, F.lit(word))
    empty = F.array().cast("array<int>")
    cuts = {fresh(documents.columns, name): cut for name, cut in (("_wrapped", lambda c: known_ids(c, ENDS)), ("_lines", lambda c: known_ids(c, LINE_ENDS)), ("_sections", section_ids))}
    wrapped, lines, own = cuts
    lower = fresh(documents.columns, "_low")
    with_ids = documents.withColumn(lower, F.when(may, low))
    for name, cut in cuts.items():
        with_ids = with_ids.withColumn(name, F.when(F.col(lower).isNotNull(), cut(F.col(lower))).otherwise(empty))
    joined = lambda c: F.concat(F.lit(","), F.array_join(F.col(c).cast("array<string>"), ","), F.lit(","))
    names = []
    for name, _, ids in (*RULES, *SECTION_RULES):
        mark = F.lit("," + ",".join(map(str, ids)) + ",")
        names.append(F.when(F.contains(joined(wrapped), mark) | F.contains(joined(lines), mark) | F.contains(joined(own), mark), F.lit(name)))
    found = F.when((F.size(wrapped) + F.size(lines) + F.size(own)) > 0, F.array_sort(F.array_distinct(F.array_compact(F.array(*names))))).otherwise(F.array().cast("array<string>"))
    others = F.filter(own, lambda i: ~F.array_contains(F.concat(lines, wrapped), i))
    added = {"licences": found, "sentence_ids": F.concat(lines, wrapped, others)}
    return with_ids.select(*(F.col(f"`{c}`") for c in documents.columns if c not in added), *(e.alias(c) for c, e in added.items()))


def op8_license_scan(spark, sf_dir: str) -> DataFrame:
    """Every document's licences: ``doc_id, n_sentences (known), sentence_ids, licences``, lists joined by commas."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = scan(documents)
    return found.select("doc_id", F.size("sentence_ids").cast("long").alias("n_sentences"), F.array_join(F.col("sentence_ids").cast("array<string>"), ",").alias("sentence_ids"), F.array_join("licences", ",").alias("licences"))


def _sql() -> str:
    cases = "CASE s " + " ".join(f"WHEN {_quoted(s)} THEN {i}" for i, s in SENTENCES.items()) + " END"

    def ids(ends: str) -> str:
        split = f"regexp_split_to_array(low, '{ends}')"
        normal = f"list_transform({split}, lambda x: trim(regexp_replace(x, '[^a-z0-9]+', ' ', 'g')))"
        return f"list_filter(list_transform({normal}, lambda s: {cases}), lambda i: i IS NOT NULL)"

    rules = ", ".join(f"CASE WHEN contains(w, ',{','.join(map(str, r))},') OR contains(l, ',{','.join(map(str, r))},') THEN {_quoted(n)} END" for n, _, r in RULES)
    return f"""
WITH low AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS low FROM documents),
ids AS (SELECT doc_id, {ids(ENDS)} AS wrapped, {ids(LINE_ENDS)} AS lines FROM low),
seq AS (SELECT *, ',' || array_to_string(wrapped, ',') || ',' AS w, ',' || array_to_string(lines, ',') || ',' AS l FROM ids)
SELECT doc_id, (len(wrapped) + len(lines))::BIGINT AS n_sentences, coalesce(array_to_string(list_concat(lines, wrapped), ','), '') AS sentence_ids,
       coalesce(array_to_string(list_sort(list_distinct(list_filter([{rules}], lambda x: x IS NOT NULL))), ','), '') AS licences
FROM seq
"""


OP8_SQL = _sql()

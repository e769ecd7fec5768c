"""Licence texts and headers as their authors wrap them, under a heading and a copyright line."""

import pytest

from quern.llm.licences import RULES, SECTION_RULES, scan

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
ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH
REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY
AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER.
"""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.
"""
GPL3 = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.
"""
GPL2 = GPL3.replace("software: you", "software; you").replace("Foundation, either version 3", "Foundation; either version 2")
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at http://mozilla.org/MPL/2.0/.
"""
UNLICENSE = "This is free and unencumbered software released into the public\ndomain.\n"
LGPL3 = GPL3.replace("GNU General", "GNU Lesser General")
LGPL21 = GPL2.replace("GNU General", "GNU Lesser General").replace("version 2 of", "version 2.1 of").replace("This program", "This library")
AGPL3 = GPL3.replace("GNU General", "GNU Affero General")
BSD3 = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE
FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER
CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY,
OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE
OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.
"""
BSD2 = BSD3[: BSD3.index("3. Neither")] + BSD3[BSD3.index("THIS SOFTWARE") :]
ZLIB = """This software is provided 'as-is', without any express or implied
warranty. In no event will the authors be held liable for any damages
arising from the use of this software.

Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it
freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not
   claim that you wrote the original software. If you use this software
   in a product, an acknowledgment in the product documentation would be
   appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be
   misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.
"""
EPL2 = """This program and the accompanying materials are made available under the
terms of the Eclipse Public License 2.0 which is available at
https://www.eclipse.org/legal/epl-2.0/
"""
CC0 = """To the extent possible under law, the author(s) have dedicated all copyright
and related and neighboring rights to this software to the public domain
worldwide. This software is distributed without any warranty.
"""
TEXTS = {
    "LGPL-3.0-or-later": LGPL3, "LGPL-2.1-or-later": LGPL21, "AGPL-3.0-or-later": AGPL3, "BSD-3-Clause": BSD3, "BSD-2-Clause": BSD2, "Zlib": ZLIB, "EPL-2.0": EPL2, "CC0-1.0": CC0,
    "MIT": MIT, "ISC": ISC, "Apache-2.0": APACHE, "GPL-3.0-or-later": GPL3, "GPL-2.0-or-later": GPL2, "MPL-2.0": MPL, "Unlicense": UNLICENSE,
}


def _scan(spark, texts):
    rows = list(enumerate(texts))
    got = {r["doc_id"]: r["licences"] for r in scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    return [got[i] for i in range(len(texts))]


def _commented(text, mark):
    return "\n".join(f"{mark} {line}".rstrip() for line in text.split("\n"))


@pytest.mark.parametrize("head", ["The licence\n\nCopyright (c) 2020 Some One\n\n", "Copyright 2020 Some One\n", "Some heading\n\n"])
def test_canonical_texts(spark, head):
    names = list(TEXTS)
    ways = [
        lambda t: head + t,
        lambda t: (head + t).replace("\n", "\r\n"),
        lambda t: _commented(head + t, "#"),
        lambda t: "/*\n" + _commented(head + t, " *") + "\n */\nint x;\n",
        lambda t: (head + t).replace("http:", "https:"),
        lambda t: (head + t).replace("met:\n\n", "met:\n").replace("restrictions:\n\n", "restrictions:\n"),
    ]
    got = _scan(spark, [way(TEXTS[n]) for way in ways for n in names])
    assert got == [[n] for _ in ways for n in names]
    # every rule of several sentences has its text here
    assert {n for n, _, ids in (*RULES, *SECTION_RULES) if len(ids) > 1} <= set(names)


def test_other_cuts_of_the_texts(spark):
    flat = [" ".join(TEXTS[n].split()) for n in TEXTS]
    old_gpl3 = GPL2.replace("version 2", "version 3")
    url_below = APACHE.replace("LICENSE-2.0\n\n", "LICENSE-2.0\n")
    url_above = APACHE.replace("at\n\n", "at\n")
    assert _scan(spark, flat) == [[n] for n in TEXTS]
    assert _scan(spark, [old_gpl3, url_below, url_above]) == [["GPL-3.0-or-later"], ["Apache-2.0"], ["Apache-2.0"]]
    # what blank lines part is still one sentence by the first cut
    assert _scan(spark, ["Released under the\n\nMIT License.", "A part of it: " + MPL, GPL3[:300]]) == [["MIT"], [], []]


def test_odd_rows(spark):
    """Repeated rows and ids, a licence found twice, long texts, empty tables and clashing names."""
    twice = "Released under the MIT License.\nLicensed under the MIT License.\n"
    rows = [(1, MIT), (1, MIT), (1, None), (None, twice), (2, "word " * 60_000 + "\n\n" + BSD3 + "\n" + MIT)]
    df = spark.createDataFrame([(i, t, 1, 2, 3, 4, 5) for i, t in rows], "doc_id long, text string, _low int, _wrapped int, _lines int, _sections int, licences int")
    out = scan(df)
    assert out.columns == ["doc_id", "text", "_low", "_wrapped", "_lines", "_sections", "licences", "sentence_ids"]
    got = sorted((r["doc_id"] or 0, r["licences"]) for r in out.collect())
    assert got == [(0, ["MIT"]), (1, []), (1, ["MIT"]), (1, ["MIT"]), (2, ["BSD-3-Clause", "MIT"])]
    assert scan(df.limit(0)).collect() == []

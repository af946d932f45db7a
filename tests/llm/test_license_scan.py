from __future__ import annotations

import textwrap

import pytest
from pyspark.sql import functions as F

from gaugewise.llm import license_scan as ls

MIT = """MIT License

Copyright (c) 2020 Someone

Permission is hereby granted, free of charge, to any person obtaining a copy
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
BSD_2 = """Copyright (c) 2020, Someone

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES ARE DISCLAIMED.
"""
BSD_3 = BSD_2.replace(
    "THIS SOFTWARE",
    """3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.

THIS SOFTWARE""",
)
ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH
REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY
AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE.
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
GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.
"""
GPL_2 = """This program is free software; you can redistribute it and/or
modify it under the terms of the GNU General Public License
as published by the Free Software Foundation; either version 2
of the License, or (at your option) any later version.
"""
LGPL_21 = """This library is free software; you can redistribute it and/or
modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation; either
version 2.1 of the License, or (at your option) any later version.
"""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/.
"""
GPL_TITLE = """                    GNU GENERAL PUBLIC LICENSE
                       Version 3, 29 June 2007

 Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/>
"""
CASES = {
    "MIT": MIT,
    "BSD-2-Clause": BSD_2,
    "BSD-3-Clause": BSD_3,
    "BSD-4-Clause": BSD_3.replace("3. Neither", "3. All advertising materials mentioning features or use of this software\n   must display the following acknowledgement: made by Someone.\n\n4. Neither"),
    "ISC": ISC,
    "0BSD": ISC.replace(", provided that the above\ncopyright notice and this permission notice appear in all copies", ""),
    "X11": MIT + "\nExcept as contained in this notice, the name of the X Consortium shall not be\nused in advertising or otherwise to promote the sale, use or other dealings\nin this Software without prior written authorization from the X Consortium.\n",
    "MIT-0": MIT.replace(", subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all\ncopies or substantial portions of the Software", ""),
    "NCSA": BSD_2.replace("Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:", MIT[MIT.index("Permission") : MIT.index("The above")].replace("deal\nin the", "deal\nwith the")),
    "Apache-2.0": APACHE,
    "GPL-3.0": GPL,
    "GPL-2.0": GPL_2,
    "LGPL-2.1": LGPL_21,
    "LGPL-3.0": GPL.replace("General Public License as", "Lesser General Public License as"),
    "AGPL-3.0": GPL.replace("General Public License as", "Affero General Public License as"),
    "MPL-2.0": MPL,
    "Unlicense": "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish it.\n",
    "BSL-1.0": 'Boost Software License - Version 1.0 - August 17th, 2003\n\nPermission is hereby granted, free of charge, to any person or organization\nobtaining a copy of the software and accompanying documentation covered by\nthis license (the "Software") to use, reproduce, display, distribute,\nexecute, and transmit the Software, and to prepare derivative works of the\nSoftware, and to permit third-parties to whom the Software is furnished to\ndo so, all subject to the following:\n',
    "Zlib": "This software is provided 'as-is', without any express or implied\nwarranty. In no event will the authors be held liable.\n\nPermission is granted to anyone to use this software for any purpose,\nincluding commercial applications, and to alter it and redistribute it\nfreely, subject to the following restrictions:\n",
    "EPL-2.0": "This program and the accompanying materials are made\navailable under the terms of the Eclipse Public License 2.0\nwhich is available at https://www.eclipse.org/legal/epl-2.0/\n",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-SA-3.0": "This work is licensed under the Creative Commons Attribution-NonCommercial-ShareAlike 3.0 Unported License. To view a copy, visit us.",
    "CC0-1.0": "Released under CC0 1.0 Universal.",
    "OFL-1.1": "This Font Software is licensed under the SIL Open Font License, Version 1.1.",
}


def scan(df, **how):
    return {r.doc_id: (list(r.licenses), list(r.license_sentences)) for r in ls.scan_licenses(df, **how).collect()}


def test_standard_texts_show_their_licence_alone(docs_from):
    """Unaltered, wrapped anew, and as comments."""
    shapes = {
        "as it is": lambda t: t, "hash": lambda t: textwrap.indent(t, "# ", lambda _: True), "slashes": lambda t: textwrap.indent(t, "    // ", lambda _: True),
        "block": lambda t: "/*\n" + textwrap.indent(t, " * ", lambda _: True) + "\n */\n", "code": lambda t: "import os\n\n" + textwrap.indent(t, "# ") + "\nprint(1)\n", "crlf": lambda t: t.replace("\n", "\r\n"),
        "one line": lambda t: "\n\n".join(" ".join(p.split()) for p in t.split("\n\n")),
    }
    rows, want = [], {}
    for name, text in CASES.items():
        for f in shapes.values():
            want[len(rows)] = name
            rows.append((len(rows), f(text)))
    rows.append((9999, GPL_TITLE))
    got = scan(docs_from(rows))
    assert {i: g[0] for i, g in got.items() if i < 9999} == {i: [n] for i, n in want.items()} and got[9999][0] == ["GPL-3.0"]


def test_notices(docs_from):
    rows = {
        "Hello.\nLicensed under the Apache License, Version 2.0.\nAll rights reserved.\nBye": ["Apache-2.0", "LicenseRef-all-rights-reserved"],
        "Released under the MIT License. Released under the MIT License.": ["MIT"],
        "// SPDX-License-Identifier: GPL-2.0-only\n#include <x>": ["GPL-2.0"],
        "SPDX-License-Identifier: Apache-2.0": ["Apache-2.0"],
        "This work is licensed under the GNU General Public License, version 3.": ["GPL-3.0"],
        "Licensed under CC BY-NC 4.0.": ["CC-BY-NC-4.0"],
        "This project is distributed under the terms of the LGPL v2.1 or later, see COPYING.": ["LGPL-2.1"],
        "The code is not licensed under the MIT License.": [],
        "bsd and MIT and the Apache License are names": [],
        "Taxis are licensed under the city's rules.": [],
        "A long line of a text that goes on without any full stop at all\nReleased under the MIT License\nand more": ["MIT"],
    }
    got = scan(docs_from(list(enumerate(rows))))
    assert {i: g[0] for i, g in got.items()} == dict(enumerate(rows.values()))
    assert got[1][1] == ["notice:MIT", "notice:MIT"]


def test_enough_licences_are_known():
    assert len({*ls.RULES, *ls.LICENCE_NAMES.values()}) >= 60 and max(map(len, (ls.SENTENCES, ls.NAMES, ls.RULES))) < 200
    for i, forms in ls.TEXTS.items():
        assert all(ls.SENTENCES[ls.plain(s)] == i for s in forms)


def test_rules_are_ordered(docs_from):
    ids, rules = {"a": "one", "b": "two", "c": "three"}, {"L": [["one", "three"]], "M": [["three", "one", "!two"]]}
    got = scan(docs_from([(1, "A. B. C."), (2, "C. A."), (3, "A."), (4, "A C."), (5, "C. A. B.")]), sentence_ids=ids, rules=rules, names={})
    assert [got[i][0] for i in (1, 2, 3, 4, 5)] == [["L"], ["M"], [], [], []]


def test_edges(docs_from):
    assert ls.scan_licenses(docs_from([])).count() == 0
    rows = [(None, None), (1, ""), (2, "word " * 60_000 + ". All rights reserved."), (2, "x")]
    df = docs_from(rows).withColumn("licenses", F.lit(1)).withColumn("sentence", F.lit("s"))
    got = ls.scan_licenses(df).collect()
    assert len(got) == 4 and all(r.sentence == "s" for r in got) and sorted(len(r.licenses) for r in got) == [0, 0, 0, 1]


@pytest.mark.parametrize("form", ["GNU GPLv3", "the Apache License, Version 2.0", "CC BY-SA 4.0"])
def test_names_are_bare(form):
    assert ls.bare(form) in ls.LICENCE_NAMES


@pytest.mark.parametrize("holder", ["Google Inc.", "Some Company Ltd.", "J. Smith", "the Foo Corp."])
def test_abbreviations_end_no_sentence(spark, holder):
    """A name with points in the endorsement clause leaves a three-clause licence one, on one line or wrapped."""
    clause = f"3. Neither the name of {holder} nor the names of its\n   contributors"
    text = BSD_3[: BSD_3.index("3. Neither")] + clause + BSD_3[BSD_3.index("contributors", BSD_3.index("3. Neither")) + len("contributors") :]
    rows = spark.createDataFrame([(1, text), (2, text.replace("nor the names of its\n   contributors", "nor\nthe names of its contributors")), (3, "\n\n".join(" ".join(p.split()) for p in text.split("\n\n")))], "doc_id long, text string")
    assert [r.licenses for r in ls.scan_licenses(rows).orderBy("doc_id").collect()] == [["BSD-3-Clause"]] * 3

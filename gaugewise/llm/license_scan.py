"""License scans: sentences to known identifiers, identifier sequences to ordered rules.

Row-level DataFrame functions only, no shuffle. Comment marks are stripped from the lines of a text
and wrapped lines joined; the text is cut into sentences, each is normalised and mapped to the
identifier of a known licence sentence, or of a notice that names a licence; unknown sentences drop
out. The sequence of identifiers is then matched against rules, each an ordered list of identifiers
that must follow one another, other known sentences between them being allowed, and of identifiers
that must not occur. As a short line may be a sentence without a full stop, lines are also read each
by itself, and what only they show comes after the rest.
"""

from __future__ import annotations

import re
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugewise.llm._common import col

#: A line of this many characters or more goes on in the next one, if that is not blank.
WRAPPED = 45
# Marks before a line of a comment.
COMMENT = r"(^|\n)[ \t]*(?:/\*+|\*+/|\*+|//+!?|#+|;+|--+|<!--|%+|dnl|REM)[ \t]?"
# Sentences of licence texts and headers by identifier; signs, capitals and blanks do not count.
TEXTS = {
    "all-rights-reserved": ["All rights reserved"],
    "mit-grant": ['Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions'],
    "mit-0-grant": ['Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so'],
    "mit-notice-clause": [
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
        "The above copyright notice and this permission notice (including the next paragraph) shall be included in all copies or substantial portions of the Software",
    ],
    "mit-warranty": ['The software is provided "as is", without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement'],
    "mit-liability": [
        "In no event shall the authors or copyright holders be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with the software or the use or other dealings in the software"
    ],
    "ncsa-grant": ['Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal with the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions'],
    "isc-grant": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
        "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    ],
    "0bsd-grant": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"],
    "isc-warranty": ['The software is provided "as is" and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness'],
    "postgresql-grant": ["Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted, provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies"],
    "boost-grant": ['Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following'],
    "zlib-warranty": ["This software is provided 'as-is', without any express or implied warranty"],
    "zlib-grant": ["Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"],
    "bsd-grant": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistribution and use in source and binary forms, with or without modification, are permitted (subject to the limitations in the disclaimer below) provided that the following conditions are met",
    ],
    "bsd-source": [
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
        "Redistributions of source code must retain the above copyright notice, this list of conditions, and the following disclaimer",
    ],
    "bsd-binary": ["Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution"],
    "bsd-advertising": ["All advertising materials mentioning features or use of this software must display the following acknowledgement"],
    "bsd-clear-patents": ["No express or implied licenses to any party's patent rights are granted by this license"],
    "apache-title": ["Apache License"],
    "apache-2-version": ["Version 2.0, January 2004"],
    "apache-2-notice": ['Licensed under the Apache License, Version 2.0 (the "License")'],
    "apache-2-compliance": ["You may not use this file except in compliance with the License"],
    "apache-2-copy": ["You may obtain a copy of the License at"],
    "apache-2-limits": ["See the License for the specific language governing permissions and limitations under the License"],
    "gpl-title": ["GNU General Public License"],
    "lgpl-title": ["GNU Lesser General Public License"],
    "library-gpl-title": ["GNU Library General Public License"],
    "agpl-title": ["GNU Affero General Public License"],
    "gpl-2-version": ["Version 2, June 1991"],
    "lgpl-2.1-version": ["Version 2.1, February 1999"],
    "gpl-3-version": ["Version 3, 29 June 2007"],
    "agpl-3-version": ["Version 3, 19 November 2007"],
    "gpl-free": ["This program is free software", "This file is free software", "This software is free software"],
    "lgpl-free": ["This library is free software"],
    "gpl-terms": ["You can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"],
    "lgpl-terms": ["You can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"],
    "agpl-terms": ["You can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation"],
    "version-2-or-later": ["Either version 2 of the License, or (at your option) any later version"],
    "version-2.1-or-later": ["Either version 2.1 of the License, or (at your option) any later version"],
    "version-3-or-later": ["Either version 3 of the License, or (at your option) any later version"],
    "version-2-only": ["Version 2 of the License"],
    "gpl-2-terms": ["You can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation", "You can redistribute it and/or modify it under the terms of the GNU General Public License, version 2, as published by the Free Software Foundation"],
    "gpl-2-terms-later": ["You can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later version"],
    "gpl-3-terms": ["You can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"],
    "lgpl-3-terms": ["You can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"],
    "agpl-3-terms": ["You can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"],
    "mpl-2-notice": ["This Source Code Form is subject to the terms of the Mozilla Public License, v 2.0"],
    "mpl-2-title": ["Mozilla Public License Version 2.0"],
    "mpl-2-covered": ["Covered Software means Source Code Form to which the initial Contributor has attached the notice in Exhibit A, the Executable Form of such Source Code Form, and Modifications of such Source Code Form, in each case including portions thereof"],
    "unlicense-grant": ["This is free and unencumbered software released into the public domain"],
    "wtfpl-title": ["Do what the fuck you want to public license"],
    "wtfpl-grant": ["You just do what the fuck you want to"],
    "cc0-dedication": ["The person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law, including all related and neighboring rights, to the extent allowed by law"],
    "cc0-title": ["CC0 1.0 Universal"],
    "cc0-purpose": ["Statement of Purpose"],
    "beerware-grant": ["As long as you retain this notice you can do whatever you want with this stuff"],
    "ofl-title": ["SIL Open Font License Version 1.1 - 26 February 2007"],
    "epl-2-title": ["Eclipse Public License - v 2.0"],
    "artistic-2-title": ["The Artistic License 2.0"],
    "artistic-2-copy": ["Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed"],
}
# Sentences with a free part (a holder's name), as patterns over normalised sentences that hold the word "name".
PATTERNS = {
    "^neither the names? of .+ may be used to endorse or promote products derived from this software.*$": "bsd-endorse",
    "^the names? of .+ may not be used to endorse or promote products derived from this software.*$": "bsd-endorse",
    "^except as contained in this notice the names? .+ shall not be used in advertising or otherwise to promote the sale use or other dealings in (?:this|the) software without prior written authorization.*$": "x11-name",
}
# Ordered rules, licence to the sequences of sentences of which any one shows it; "!" before what must not occur.
RULES = {
    "0BSD": [["0bsd-grant", "isc-warranty"]],
    "AGPL-3.0": [["gpl-free", "agpl-3-terms"], ["gpl-free", "agpl-terms", "version-3-or-later"], ["agpl-title", "agpl-3-version"]],
    "Apache-2.0": [["apache-2-notice"], ["apache-2-compliance", "apache-2-copy", "apache-2-limits"], ["apache-title", "apache-2-version"]],
    "Artistic-2.0": [["artistic-2-title", "artistic-2-copy"]],
    "BSD-2-Clause": [["bsd-grant", "bsd-source", "bsd-binary", "!bsd-endorse", "!bsd-advertising", "!bsd-clear-patents"]],
    "BSD-3-Clause": [["bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse", "!bsd-advertising", "!bsd-clear-patents"]],
    "BSD-3-Clause-Clear": [["bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse", "bsd-clear-patents"]],
    "BSD-4-Clause": [["bsd-grant", "bsd-source", "bsd-binary", "bsd-advertising", "bsd-endorse"]],
    "BSL-1.0": [["boost-grant"]],
    "Beerware": [["beerware-grant"]],
    "CC0-1.0": [["cc0-dedication"], ["cc0-title", "cc0-purpose"]],
    "EPL-2.0": [["epl-2-title"]],
    "GPL-2.0": [["gpl-free", "gpl-terms", "version-2-or-later"], ["gpl-free", "gpl-terms", "version-2-only"], ["gpl-free", "gpl-2-terms"], ["gpl-free", "gpl-2-terms-later"], ["gpl-title", "gpl-2-version"]],
    "GPL-3.0": [["gpl-free", "gpl-3-terms"], ["gpl-free", "gpl-terms", "version-3-or-later"], ["gpl-title", "gpl-3-version", "!lgpl-title"]],
    "ISC": [["isc-grant", "isc-warranty"]],
    "LGPL-2.0": [["library-gpl-title", "gpl-2-version"]],
    "LGPL-2.1": [["lgpl-free", "lgpl-terms", "version-2.1-or-later"], ["lgpl-title", "lgpl-2.1-version"]],
    "LGPL-3.0": [["lgpl-free", "lgpl-3-terms"], ["gpl-free", "lgpl-3-terms"], ["lgpl-free", "lgpl-terms", "version-3-or-later"], ["lgpl-title", "gpl-3-version"]],
    "LicenseRef-all-rights-reserved": [["all-rights-reserved"]],
    "MIT": [["mit-grant", "mit-notice-clause", "mit-warranty", "!x11-name"]],
    "MIT-0": [["mit-0-grant", "mit-warranty"]],
    "MPL-2.0": [["mpl-2-notice"], ["mpl-2-title", "mpl-2-covered"]],
    "NCSA": [["ncsa-grant", "bsd-source", "bsd-binary"]],
    "OFL-1.1": [["ofl-title"]],
    "PostgreSQL": [["postgresql-grant"]],
    "Unlicense": [["unlicense-grant"]],
    "WTFPL": [["wtfpl-title", "wtfpl-grant"]],
    "X11": [["mit-grant", "mit-notice-clause", "mit-warranty", "x11-name"]],
    "Zlib": [["zlib-warranty", "zlib-grant"]],
}
# Names of licences as notices write them; the identifier itself is a name too.
NAMES = {
    "0BSD": ["Zero-Clause BSD", "BSD Zero Clause"],
    "AFL-3.0": ["Academic Free License version 3.0"],
    "AGPL-3.0": ["AGPLv3", "AGPL version 3", "GNU AGPLv3", "GNU AGPL version 3", "GNU Affero General Public License version 3", "GNU Affero General Public License version 3.0", "Affero General Public License version 3"],
    "Apache-1.1": ["Apache Software License version 1.1"],
    "Apache-2.0": ["Apache License version 2", "Apache Software License version 2.0", "ASL 2.0"],
    "Artistic-1.0": [],
    "Artistic-2.0": [],
    "BSD-2-Clause": ["2-clause BSD", "Simplified BSD", "FreeBSD"],
    "BSD-3-Clause": ["3-clause BSD", "New BSD", "Modified BSD", "Revised BSD"],
    "BSD-4-Clause": ["4-clause BSD", "Original BSD"],
    "BSL-1.0": ["Boost Software License version 1.0"],
    "Beerware": ["Beer-Ware"],
    "BlueOak-1.0.0": ["Blue Oak Model License 1.0.0"],
    "CC0-1.0": ["CC0", "CC0 1.0 Universal", "Creative Commons Zero", "Creative Commons Zero version 1.0 Universal", "Creative Commons CC0 1.0 Universal"],
    "CDDL-1.0": ["Common Development and Distribution License version 1.0", "Common Development and Distribution License"],
    "CDDL-1.1": ["Common Development and Distribution License version 1.1"],
    "CECILL-2.1": ["CeCILL license version 2.1"],
    "CPL-1.0": ["Common Public License version 1.0"],
    "ECL-2.0": ["Educational Community License version 2.0"],
    "EPL-1.0": ["Eclipse Public License version 1.0"],
    "EPL-2.0": ["Eclipse Public License version 2.0"],
    "EUPL-1.1": ["European Union Public License version 1.1"],
    "EUPL-1.2": ["European Union Public License version 1.2"],
    "GFDL-1.3": ["GNU Free Documentation License version 1.3"],
    "GPL-2.0": ["GPLv2", "GPL version 2", "GNU GPLv2", "GNU GPL version 2", "GNU General Public License version 2", "GNU General Public License version 2.0"],
    "GPL-3.0": ["GPLv3", "GPL version 3", "GNU GPLv3", "GNU GPL version 3", "GNU General Public License version 3", "GNU General Public License version 3.0"],
    "ISC": [],
    "LGPL-2.1": ["LGPLv2.1", "GNU LGPLv2.1", "GNU LGPL version 2.1", "GNU Lesser General Public License version 2.1"],
    "LGPL-3.0": ["LGPLv3", "LGPL version 3", "GNU LGPLv3", "GNU LGPL version 3", "GNU Lesser General Public License version 3", "GNU Lesser General Public License version 3.0"],
    "LPPL-1.3c": ["LaTeX Project Public License version 1.3c"],
    "MIT": ["MIT (MIT)", "Expat", "MIT/Expat"],
    "MIT-0": ["MIT No Attribution"],
    "MPL-1.1": ["Mozilla Public License version 1.1", "MPL 1.1"],
    "MPL-2.0": ["Mozilla Public License version 2.0", "MPL 2.0"],
    "MS-PL": ["Microsoft Public License"],
    "MS-RL": ["Microsoft Reciprocal License"],
    "MulanPSL-2.0": ["Mulan PSL v2"],
    "NCSA": ["University of Illinois/NCSA Open Source License"],
    "ODbL-1.0": ["Open Database License", "Open Data Commons Open Database License", "Open Data Commons Open Database License v1.0"],
    "OFL-1.1": ["SIL Open Font License version 1.1", "SIL OFL 1.1"],
    "OSL-3.0": ["Open Software License version 3.0"],
    "PSF-2.0": ["Python Software Foundation License version 2", "PSF license version 2"],
    "PostgreSQL": [],
    "Unlicense": [],
    "UPL-1.0": ["Universal Permissive License version 1.0"],
    "Vim": [],
    "WTFPL": ["Do What The Fuck You Want To Public License"],
    "X11": [],
    "ZPL-2.1": ["Zope Public License version 2.1"],
    "Zlib": ["zlib/libpng"],
}
# Creative Commons elements as codes and as words, and versions; their names follow from these.
CC_ELEMENTS = {"by": "Attribution", "nc": "NonCommercial", "nd": "NoDerivatives", "sa": "ShareAlike"}
CC_KINDS = ["by", "by-sa", "by-nd", "by-nc", "by-nc-sa", "by-nc-nd"]
CC_VERSIONS = {"1.0": "Generic", "2.0": "Generic", "2.5": "Generic", "3.0": "Unported", "4.0": "International"}
# Words of a notice, over normalised sentences without articles and the words "public" and "license".
FILLER = r"\b(?:the|an?|public|licen[cs]es?)\b ?"
VERSION = r"\bv(?:ersion)? ?([0-9])"
_VERBS = "(?:licensed|released|distributed|redistributed|published|available|provided|offered|covered|governed|shared|used|subject|bound)"
NOTICE = rf"^(?:spdx identifier|(?:.* )?{_VERBS} (?:under|by|to)(?: terms(?: and conditions)? of)?(?: this)?) (.+)$"
DENIAL = rf"(?:^| )(?:not|never|cannot|unless|if|no longer) (?:[a-z0-9]+ )*{_VERBS} "
TAIL = r" (?:see|which|that|as|for|please|found|copyright|c|at|you|and can|with|from|in|on|or newer)(?: .*)?$"
LATER = r"(?: or)?(?: at your option)? any later(?: version)?$| or later$| only$"


def plain(sentence: str) -> str:
    return re.sub("[^a-z0-9]+", " ", sentence.lower()).strip()


def bare(sentence: str) -> str:
    """A licence's name without articles, the words "public" and "license", and "version"."""
    return re.sub(VERSION, r"\1", re.sub(FILLER, "", plain(sentence))).strip()


#: Normalised sentence to identifier, and bare name to licence.
SENTENCES = {plain(s): i for i, forms in TEXTS.items() for s in forms}
LICENCE_NAMES = {bare(n): i for i, names in NAMES.items() for n in [i, *names]} | {
    bare(name): f"CC-{kind.upper()}-{version}"
    for kind in CC_KINDS
    for version, scope in CC_VERSIONS.items()
    for words in ["Creative Commons " + "-".join(CC_ELEMENTS[e] for e in kind.split("-")), f"CC {kind}", f"Creative Commons {kind}"]
    for name in [f"{words} {version}", f"{words} {version} {scope}"]
}


#: Points that end no sentence: of versions and companies, of an initial before a name, and those that a small letter follows.
ABBREVIATION = r"\b([vV]|Inc|Ltd|Corp|Co)\.(\s)|\b([A-Z])\.([ \t][A-Z][a-z])|\.([ \t]+[a-z])"


def cleaned(text: Column) -> Column:
    """Without comment marks, and with points and colons that end no sentence taken out."""
    lines = F.regexp_replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), COMMENT, "$1")
    return F.regexp_replace(F.regexp_replace(lines, ABBREVIATION, "$1$2$3$4$5"), r"SPDX-License-Identifier:[ \t]*", "SPDX-License-Identifier ")


def joined(text: Column) -> Column:
    """Wrapped lines joined: those that a small letter or a bracket follows, and long ones."""
    small = F.regexp_replace(text, r"([^.!?:;\n])\n[ \t]*([a-z(])", "$1 $2")
    return F.array_join(F.transform(F.split(small, "\n"), lambda x: F.concat(x, F.when(F.length(F.trim(x)) >= WRAPPED, " ").otherwise("\n"))), "")


def sentences(text: Column) -> Column:
    """Normalised sentences: cut after . ! ? ; : and at line ends."""
    cut = F.split(F.regexp_replace(text, r"([.!?;:])[ \t]+", "$1\n"), "\n")
    return F.transform(cut, lambda s: F.trim(F.regexp_replace(F.lower(s), "[^a-z0-9]+", " ")))


def _lookup(values: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in sorted(values.items()) for x in pair]), key)


def _identified(found: Column, known: dict[str, str], names: dict[str, str]) -> Column:
    """Identifiers of those sentences that have one."""

    def one(s: Column) -> Column:
        out = F.when(s.isin(*sorted(known)), _lookup(known, s)) if known else F.when(F.lit(False), "")
        shapes = reduce(lambda c, p: c.when(s.rlike(p[0]), F.lit(p[1])), list(PATTERNS.items())[1:], F.when(s.rlike(next(iter(PATTERNS))), F.lit(next(iter(PATTERNS.values())))))
        out = out.when(s.contains(" name") & s.contains(" software"), shapes)
        if names:
            short = F.regexp_replace(F.trim(F.regexp_replace(s, FILLER, "")), VERSION, "$1")
            name = F.regexp_replace(F.regexp_replace(F.regexp_extract(short, NOTICE, 1), TAIL, ""), LATER, "")
            notice = F.when(~s.rlike(DENIAL), F.concat(F.lit("notice:"), _lookup(names, F.trim(name))))
            out = out.when(s.rlike(rf"^spdx|{_VERBS} (?:under|by|to) "), notice)
        return out

    return F.filter(F.transform(found, one), lambda x: x.isNotNull())


def rule_pattern(sequence: list[str]) -> str:
    """Matches a blank-framed sequence of identifiers that holds ``sequence`` in order."""
    return " " + " ([^ ]+ )*".join(re.escape(s) for s in sequence if s[0] != "!") + " "


def scan_licenses(
    docs: DataFrame, text: str = "text", sentence_ids: dict[str, str] | None = None, rules: dict[str, list[list[str]]] | None = None, names: dict[str, str] | None = None
) -> DataFrame:
    """``docs`` with ``license_sentences`` (identifiers in the order of the text) and ``licenses`` (sorted).

    ``sentence_ids``, ``rules`` and ``names`` take the place of SENTENCES, RULES and LICENCE_NAMES. A
    notice that names a licence has the identifier ``notice:`` and the licence, and shows it. A null
    or empty text has neither: both arrays are empty. Repeats of a sentence are kept in
    ``license_sentences``; a licence is listed once. Identifiers that only single lines show are at
    the end, sorted, each once. Input columns of these names are replaced; all rows stay.
    """
    known = SENTENCES if sentence_ids is None else sentence_ids
    rules = RULES if rules is None else rules
    names = LICENCE_NAMES if names is None else names
    docs = docs.drop("license_sentences", "licenses")
    none = F.array().cast("array<string>")
    views = F.transform(
        F.array(cleaned(F.coalesce(col(text).cast("string"), F.lit("")))),
        lambda t: F.struct(_identified(sentences(joined(t)), known, names).alias("whole"), _identified(sentences(t), known, names).alias("lines")),
    )
    found = F.transform(views, lambda v: F.concat(v["whole"], F.array_sort(F.array_except(v["lines"], v["whole"]))))[0]
    out = docs.withColumn("license_sentences", F.coalesce(found, none))
    ids = F.col("license_sentences")
    sequence = F.concat(F.lit(" "), F.array_join(ids, " "), F.lit(" "))
    hits = [
        F.when(reduce(or_, [reduce(and_, [sequence.rlike(rule_pattern(way)), *[~sequence.contains(f" {s[1:]} ") for s in way if s[0] == "!"]]) for way in ways]), F.lit(name))
        for name, ways in sorted(rules.items())
    ]
    told = F.transform(F.filter(ids, lambda x: x.startswith("notice:")), lambda x: F.substring(x, 8, 100))
    shown = F.array_sort(F.array_distinct(F.concat(told, F.filter(F.array(*hits), lambda x: x.isNotNull()) if hits else none)))
    return out.withColumn("licenses", F.when(F.size(ids) == 0, none).otherwise(shown))

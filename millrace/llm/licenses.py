"""License scans by sentence-rule recognition.

Texts are freed of comment marks and list numbers and cut into sentences, which
are normalised and mapped to identifiers: those of known license sentences, of
statements that name a license, and of SPDX expressions.  The sequence of
identifiers is matched against ordered rules, longer rules first; other
identifiers may stand between those of a rule, and what a rule has matched is
used up.  Spark only hands on texts that have a word which every known sentence
has; the rest of a row never reaches Python.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from millrace.llm._shared import bounded_batches

# The licenses' own sentences, normalised: a-z and 0-9 with single spaces, and inner full stops, plus and minus signs.
SENTENCES = {
    "apache-header": "licensed under the apache license version 2.0 the license you may not use this file except in compliance with the license",
    "apache-copy": "you may obtain a copy of the license at",
    "apache-url": "http www.apache.org licenses license-2.0",
    "apache-urls": "https www.apache.org licenses license-2.0",
    "apache-copy-url": "you may obtain a copy of the license at http www.apache.org licenses license-2.0",
    "apache-unless": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "apache-see": "see the license for the specific language governing permissions and limitations under the license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit0-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so",
    "mit-title": "the mit license mit",
    "mit-notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit-warranty": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "mit-liability": "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "gpl3-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl2-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "gpl2-only": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license version 2 as published by the free software foundation",
    "gpl3-only": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license version 3 as published by the free software foundation",
    "gpl-hope": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "gpl-see": "see the gnu general public license for more details",
    "lgpl21-free": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2.1 of the license or at your option any later version",
    "lgpl3-free": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "lgpl-hope": "this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "lgpl-see": "see the gnu lesser general public license for more details",
    "agpl3-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "agpl-see": "see the gnu affero general public license for more details",
    "bsd-use": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-advert": "all advertising materials mentioning features or use of this software must display the following acknowledgement",
    "bsd-name": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "0bsd-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    "isc-warranty": "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
    "mpl-subject": "this source code form is subject to the terms of the mozilla public license v 2.0",
    "mpl-copy": "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla.org mpl 2.0",
    "mpl-copys": "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla.org mpl 2.0",
    "epl2-under": "this program and the accompanying materials are made available under the terms of the eclipse public license 2.0 which is available at https www.eclipse.org legal epl-2.0",
    "zlib-as-is": "this software is provided as-is without any express or implied warranty",
    "zlib-liable": "in no event will the authors be held liable for any damages arising from the use of this software",
    "zlib-grant": "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    "zlib-origin": "the origin of this software must not be misrepresented you must not claim that you wrote the original software",
    "zlib-altered": "altered source versions must be plainly marked as such and must not be misrepresented as being the original software",
    "zlib-notice": "this notice may not be removed or altered from any source distribution",
    "bsl-grant": "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third-parties to whom the software is furnished to do so all subject to the following",
    "bsl-line": "distributed under the boost software license version 1.0",
    "unlicense-free": "this is free and unencumbered software released into the public domain",
    "unlicense-grant": "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non-commercial and by any means",
    "cc0-waive": "to the extent possible under law the author s have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide",
    "wtfpl-do": "you just do what the fuck you want to",
    "ofl-line": "this font software is licensed under the sil open font license version 1.1",
    "rights-reserved": "all rights reserved",
    "apache-title": "apache license version 2.0 january 2004 http www.apache.org licenses",
    "apache-titles": "apache license version 2.0 january 2004 https www.apache.org licenses",
    "gpl2-title": "gnu general public license version 2 june 1991",
    "gpl3-title": "gnu general public license version 3 29 june 2007",
    "lgpl21-title": "gnu lesser general public license version 2.1 february 1999",
    "lgpl3-title": "gnu lesser general public license version 3 29 june 2007",
    "agpl3-title": "gnu affero general public license version 3 19 november 2007",
}

# Sentences with a part of their own, such as a holder's name; normalised ones match them whole.
PATTERNS = {
    "bsd-name": r"^(?:neither )?the names? of [a-z0-9 .+-]+ may (?:not )?be used to endorse or promote products derived from this software without (?:specific )?prior written permission$",
    "style-see": r"^(?:use of this source code is governed by )?an? [a-z0-9]+-style license that can be found in the (?:license|copying)(?:[.](?:txt|md))? file$",
}

# Ordered rules: a license and the identifiers that state it, in order.
RULES = [
    ("BSD-4-Clause", ["bsd-use", "bsd-source", "bsd-binary", "bsd-advert", "bsd-name"]),
    ("BSD-3-Clause", ["bsd-use", "bsd-source", "bsd-binary", "bsd-name"]),
    ("BSD-2-Clause", ["bsd-use", "bsd-source", "bsd-binary"]),
    ("Apache-2.0", ["apache-header", "apache-copy", "apache-url", "apache-unless", "apache-see"]),
    ("Apache-2.0", ["apache-header", "apache-copy", "apache-urls", "apache-unless", "apache-see"]),
    ("Apache-2.0", ["apache-header", "apache-copy-url", "apache-unless", "apache-see"]),
    ("Zlib", ["zlib-as-is", "zlib-liable", "zlib-grant", "zlib-origin", "zlib-altered", "zlib-notice"]),
    ("MIT", ["mit-grant", "mit-notice", "mit-warranty", "mit-liability"]),
    ("MIT-0", ["mit0-grant", "mit-warranty", "mit-liability"]),
    ("AGPL-3.0-or-later", ["agpl3-free", "gpl-hope", "agpl-see"]),
    ("LGPL-2.1-or-later", ["lgpl21-free", "lgpl-hope", "lgpl-see"]),
    ("LGPL-3.0-or-later", ["lgpl3-free", "lgpl-hope", "lgpl-see"]),
    ("GPL-3.0-or-later", ["gpl3-free", "gpl-hope", "gpl-see"]),
    ("GPL-2.0-or-later", ["gpl2-free", "gpl-hope", "gpl-see"]),
    ("GPL-3.0-only", ["gpl3-only", "gpl-hope", "gpl-see"]),
    ("GPL-2.0-only", ["gpl2-only", "gpl-hope", "gpl-see"]),
    ("MIT", ["mit-grant", "mit-notice"]),
    ("MIT", ["mit-title"]),
    ("ISC", ["isc-grant", "isc-warranty"]),
    ("0BSD", ["0bsd-grant", "isc-warranty"]),
    ("MPL-2.0", ["mpl-subject", "mpl-copy"]),
    ("MPL-2.0", ["mpl-subject", "mpl-copys"]),
    ("Unlicense", ["unlicense-free", "unlicense-grant"]),
    ("BSL-1.0", ["bsl-grant"]),
    ("Apache-2.0", ["apache-header"]),
    ("MIT-0", ["mit0-grant"]),
    ("AGPL-3.0-or-later", ["agpl3-free"]),
    ("LGPL-2.1-or-later", ["lgpl21-free"]),
    ("LGPL-3.0-or-later", ["lgpl3-free"]),
    ("GPL-3.0-or-later", ["gpl3-free"]),
    ("GPL-2.0-or-later", ["gpl2-free"]),
    ("GPL-3.0-only", ["gpl3-only"]),
    ("GPL-2.0-only", ["gpl2-only"]),
    ("Zlib", ["zlib-grant"]),
    ("ISC", ["isc-grant"]),
    ("0BSD", ["0bsd-grant"]),
    ("MPL-2.0", ["mpl-subject"]),
    ("EPL-2.0", ["epl2-under"]),
    ("BSL-1.0", ["bsl-line"]),
    ("Unlicense", ["unlicense-free"]),
    ("CC0-1.0", ["cc0-waive"]),
    ("WTFPL", ["wtfpl-do"]),
    ("OFL-1.1", ["ofl-line"]),
    ("Apache-2.0", ["apache-title"]),
    ("Apache-2.0", ["apache-titles"]),
    ("GPL-2.0-only", ["gpl2-title"]),
    ("GPL-3.0-only", ["gpl3-title"]),
    ("LGPL-2.1-only", ["lgpl21-title"]),
    ("LGPL-3.0-only", ["lgpl3-title"]),
    ("AGPL-3.0-only", ["agpl3-title"]),
]

# SPDX identifiers that expressions may name.
SPDX = """0BSD AFL-3.0 AGPL-3.0-only AGPL-3.0-or-later Apache-1.1 Apache-2.0 Artistic-2.0 BSD-2-Clause BSD-3-Clause BSD-4-Clause BSL-1.0
BlueOak-1.0.0 CC-BY-3.0 CC-BY-4.0 CC-BY-NC-4.0 CC-BY-NC-ND-4.0 CC-BY-NC-SA-4.0 CC-BY-ND-4.0 CC-BY-SA-3.0 CC-BY-SA-4.0 CC0-1.0 CDDL-1.0
CPL-1.0 ECL-2.0 EPL-1.0 EPL-2.0 EUPL-1.2 GPL-2.0-only GPL-2.0-or-later GPL-3.0-only GPL-3.0-or-later ISC LGPL-2.0-only LGPL-2.0-or-later
LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0-only LGPL-3.0-or-later LPPL-1.3c MIT MIT-0 MPL-1.1 MPL-2.0 MS-PL NCSA OFL-1.1 ODbL-1.0 OpenSSL
PHP-3.01 PostgreSQL PSF-2.0 Python-2.0 Ruby Unlicense UPL-1.0 Vim W3C WTFPL X11 Zlib""".split()

# What licenses are called in statements, normalised; families with versions are made by ``names``.
CALLED = {
    "MIT": ["mit license", "mit", "mit x11 license", "expat license"], "ISC": ["isc license", "isc"], "Zlib": ["zlib license", "zlib"],
    "BSD-2-Clause": ["bsd 2-clause license", "2-clause bsd license", "simplified bsd license", "bsd-2-clause license", "bsd-2-clause"],
    "BSD-3-Clause": ["bsd 3-clause license", "3-clause bsd license", "new bsd license", "modified bsd license", "bsd-3-clause license", "bsd-3-clause"],
    "Unlicense": ["unlicense"], "WTFPL": ["wtfpl"], "0BSD": ["0bsd license", "0bsd", "zero-clause bsd license"], "PostgreSQL": ["postgresql license"],
    "CC0-1.0": ["cc0", "cc0 1.0", "cc0 1.0 universal", "creative commons zero v1.0 universal", "creative commons cc0 1.0 universal"],
    "BSL-1.0": ["boost software license version 1.0", "boost software license 1.0"], "OFL-1.1": ["sil open font license version 1.1", "sil open font license 1.1"],
}
_FAMILIES = {"Apache": ("apache license", ["2.0"]), "MPL": ("mozilla public license", ["1.1", "2.0"]), "EPL": ("eclipse public license", ["1.0", "2.0"]), "Artistic": ("artistic license", ["2.0"]), "EUPL": ("european union public license", ["1.2"])}
_GNU = {"GPL": ("gnu general public license", ["2.0", "3.0"]), "LGPL": ("gnu lesser general public license", ["2.1", "3.0"]), "AGPL": ("gnu affero general public license", ["3.0"])}
_SHARED = {"by": "attribution", "by-sa": "attribution-sharealike", "by-nc": "attribution-noncommercial", "by-nd": "attribution-noderivatives", "by-nc-sa": "attribution-noncommercial-sharealike", "by-nc-nd": "attribution-noncommercial-noderivatives"}


@cache
def names() -> dict[str, str]:
    """Normalised names and the licenses that they are names of."""
    out = {name: license for license, all_names in CALLED.items() for name in all_names}
    for short, (long, versions) in _FAMILIES.items():
        for v in versions:
            for form in (f"{long} version {v}", f"{long} v{v}", f"{long} v {v}", f"{long} {v}", f"{short.lower()}-{v}", f"{short.lower()} {v}", f"{short.lower()} license {v}"):
                out[form] = f"{short}-{v}"
    for short, (long, versions) in _GNU.items():
        for v in versions:
            for number in {v, v.removesuffix(".0")}:
                for form in (f"{long} version {number}", f"{long} v{number}", f"{long} {number}", f"gnu {short.lower()} version {number}", f"gnu {short.lower()} v{number}", f"{short.lower()} version {number}", f"{short.lower()}v{number}", f"{short.lower()} v{number}", f"{short.lower()}-{number}", f"{short.lower()} {number}"):
                    out[form] = out[f"{form} only"] = f"{short}-{v}-only"
                    for later in ("or later", "or any later version", "or at your option any later version"):
                        out[f"{form} {later}"] = f"{short}-{v}-or-later"
                    out[f"{form}+"] = f"{short}-{v}-or-later"
    for code, words in _SHARED.items():
        for form in (f"cc {code} 4.0", f"cc-{code}-4.0", f"creative commons {words} 4.0 international license", f"creative commons {words} 4.0 international", f"creative commons {words} 4.0"):
            out[form] = f"CC-{code.upper()}-4.0"
    return out


@cache
def spdx_names() -> dict[str, str]:
    """SPDX identifiers in lower case, with the older forms of the GNU ones."""
    out = {x.lower(): x for x in SPDX}
    for x in SPDX:
        if x.endswith("-only"):
            out[x.removesuffix("-only").lower()] = x
        elif x.endswith("-or-later"):
            out[x.removesuffix("-or-later").lower() + "+"] = x
    return out


#: Only a text with one of these is looked at; every known sentence has one.
TRIGGERS = ["licens", "licenc", "permission", "redistribut", "warrant", "rights reserved", "rights to this software", "public domain", "you want to", "advertising materials", "source versions must", "source distribution", "will the authors be held", "must not be misrepresented", "copyright holders be liable", "mozilla.org", "anyone is free to copy", "released under", "distributed under", "available under", "published under", "provided under"]

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# The regular expressions mean the same to Python and to DuckDB.
#: Comment marks at the ends of lines go, list numbers become blank lines, full stops after "v" go; blank lines, full stops and colons end a run.
MARK = r"(?m)^[ \t]*(?:/\*+|\*+/|\*+|//+!?|#+!?|;+|--+|<!--+|%+|[.]{2}[ \t])[ \t]*"
END_MARK = r"(?m)[ \t]*(?:\*+/|--+>)[ \t\r]*$"
NUMBER = r"(?m)^[ \t]*(?:[(]?(?:[0-9]{1,2}|[a-z]|[ivx]{2,4})[.)]|-)[ \t]+"
VERSION = r"\b(v|ver|version)[.][ \t]*([0-9])"
RUN_END = r"\n[ \t\r]*\n|:[ \t]*\r?\n|[.!?]+['\")]*(?:[ \t]+|\r?\n)|[.!?]+['\")]*[ \t\r]*$"
#: Full stops in a holder's name end nothing: before "nor", and behind an initial.
INITIAL = r"\b(names? of [a-z0-9 ,&-]{0,60} [a-z])[.]"
STOP_NOR = r"[.],?([ \t\r]*\n?[ \t]*nor\b)"
_GIVEN = "(?:dual-)?(?:licensed|released|distributed|available|published|provided|covered) (?:under|by) "
#: A statement that names licenses, one that says that it is not so, and a line of SPDX.
STATEMENT = rf"^(?:[a-z0-9 ]* )?{_GIVEN}(?:the |an? )?(?:terms (?:and conditions )?of (?:the |an? )?)?([a-z0-9.+ -]+?)(?: the license)?$"
DENIED = rf"^(?:[a-z0-9 ]* )?(?:not|never|nor|neither|cannot|longer|isn t|aren t|wasn t|weren t) (?:[a-z0-9]+ ){{0,2}}{_GIVEN}"
LINE = r"^(?:[a-z0-9]+ )?license (?:the )?([a-z0-9.+ -]+)$"
EXPRESSION = r"^spdx-license-identifier ([a-z0-9.+ -]+)$"
#: What stands between the licenses of a list, and round one.
LIST = " (?:and|or) (?:the |an? )?"
CHOICE = r"^either (?:of )?(?:the )?| at your option$"
#: An expression may name licenses of its own.
OWN = "licenseref-"


def normal(sentence: str) -> str:
    return re.sub(r"\blicence\b", "license", re.sub(r"^[ .+-]+|[ .-]+$", "", re.sub(r"[^a-z0-9.+-]+", " ", sentence)))


@cache
def _known() -> dict[str, str]:
    return {sentence: i for i, sentence in SENTENCES.items()}


@cache
def _patterns() -> list[tuple[str, re.Pattern]]:
    return [(i, re.compile(p)) for i, p in PATTERNS.items()]


def _spdx(part: str) -> str | None:
    return f"LicenseRef-{part[len(OWN) :]}" if part.startswith(OWN) else spdx_names().get(part)


def _named(text: str) -> list[str]:
    """The licenses that a statement's object names: one, or all of a list."""
    if text in names():
        return [names()[text]]
    parts = re.split(LIST, re.sub(CHOICE, "", text))
    return [names()[x] for x in parts] if len(parts) > 1 and all(x in names() for x in parts) else []


def identifiers_of(sentence: str) -> list[str]:
    """What a normalised sentence is: a known one, names of licenses (``name:``), or the parts of an SPDX expression (``spdx:``)."""
    if sentence in _known():
        return [_known()[sentence]]
    for i, pattern in _patterns():
        if pattern.match(sentence):
            return [i]
    if found := re.match(EXPRESSION, sentence):
        return [f"spdx:{x}" for x in map(_spdx, re.split(" (?:and|or|with) ", found[1])) if x]
    if re.match(DENIED, sentence):
        return []
    for pattern in (STATEMENT, LINE):
        found = re.match(pattern, sentence)
        if found and (named := _named(found[1])):
            return [f"name:{x}" for x in named]
    return [f"name:{names()[sentence]}"] if sentence.endswith(" license") and sentence in names() else []


def identifiers(text: str) -> list[str]:
    """The identifiers of a lower-cased text in order: of each run of lines as a whole, else of its lines."""
    text = re.sub(VERSION, r"\1 \2", re.sub(NUMBER, "\n\n", re.sub(STOP_NOR, r"\1", re.sub(INITIAL, r"\1", re.sub(MARK, "", re.sub(END_MARK, "", text))))))
    out = []
    for run in re.split(RUN_END, text):
        out += identifiers_of(normal(run)) or [x for line in run.split("\n") for x in identifiers_of(normal(line))]
    return out


def matched(found: list[str]) -> set[str]:
    """The licenses that rules find in a sequence of identifiers.

    A rule takes its first identifier where that comes next, and the others each
    where they come first after it; it begins again behind its last.  What it
    takes is used up.  It looks places up in lists, so its time goes with the
    number of identifiers.
    """
    places: dict[str, list[int]] = {}
    for at, x in enumerate(found):
        places.setdefault(x, []).append(at)
    licenses = set()
    for name, rule in RULES:
        lists = [places.get(x, []) for x in rule]
        if not all(lists):
            continue
        heads, behind, used = [0] * len(rule), -1, set()
        while True:
            taken = []
            for k, where in enumerate(lists):
                while heads[k] < len(where) and where[heads[k]] <= behind:
                    heads[k] += 1
                if heads[k] == len(where):
                    break
                behind = where[heads[k]]
                taken.append(behind)
            if len(taken) < len(rule):
                break
            licenses.add(name)
            used.update(taken)
        for x in set(rule) if used else ():
            places[x] = [at for at in places[x] if at not in used]
    return licenses


def recognised(text: str) -> tuple[str, str, str]:
    """``sentence_ids``, ``licenses`` and ``verdict`` of a text."""
    text = text.translate(str.maketrans(_UPPER, _LOWER))
    found = identifiers(text) if any(t in text for t in TRIGGERS) else []
    ids = "|" + "".join(f"{x}|" for x in found)
    licenses = {x.split(":", 1)[1] for x in found if ":" in x} | matched(found)
    verdict = "known" if licenses else "reserved" if "rights-reserved" in found else "unknown" if found else "none"
    return ids, ",".join(sorted(licenses)), verdict


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``id_col``, ``sentence_ids``, ``licenses`` and ``verdict``.

    ``sentence_ids`` has the identifiers of what is known in the text in order,
    between bars.  ``licenses`` has the distinct SPDX identifiers of licenses
    that a rule found, or a statement or an SPDX expression names, sorted and
    separated by commas.  ``verdict`` is ``known`` if there is one, ``reserved``
    if there is none but all rights are reserved, ``unknown`` if there are other
    known sentences, else ``none``; null and empty texts are ``none``.  Repeated
    rows stay repeated, very long texts are read whole, other columns are not
    read, an empty table gives an empty result.
    """
    lower = F.translate(F.coalesce(F.col(text_col), F.lit("")), _UPPER, _LOWER)
    told = F.lit(False)
    for word in TRIGGERS:
        told = told | F.contains(F.col("lower"), F.lit(word))
    rows = bounded_batches(docs).select(F.col(id_col).alias("id"), lower.alias("lower")).select("id", F.when(told, F.col("lower")).alias("body"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [("|", "", "none") if x is None else recognised(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([m[i] for m in made], pa.string()) for i in range(3))], ["id", "sentence_ids", "licenses", "verdict"])

    fields = [rows.schema["id"], *(StructField(c, StringType()) for c in ("sentence_ids", "licenses", "verdict"))]
    return rows.mapInArrow(run, StructType(fields)).withColumnRenamed("id", id_col)


def _map_sql(table: dict[str, str]) -> str:
    return "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in table.items()) + "}"


def scan_sql(table: str = "documents", id_col: str = "doc_id", text_col: str = "text") -> str:
    """The scan as SQL for DuckDB."""

    def q(pattern: str) -> str:
        return "'" + pattern.replace("'", "''") + "'"

    def rule_pattern(rule: list[str]) -> str:
        first, *rest = (re.escape(i).replace("\\-", "-") for i in rule)
        return f"<{first}>" + "".join(f"((?:<[^>]*>)*?)<{x}>" for x in rest)

    steps, last, hits = [], "s", []
    for i, (name, rule) in enumerate(RULES):
        rest = "<#>" + "".join(f"{chr(92)}{k + 1}" for k in range(len(rule) - 1))
        steps.append(f"r{i} AS (SELECT * EXCLUDE (rest), CASE WHEN regexp_matches(rest, {q(rule_pattern(rule))}) THEN '{name}' END AS hit{i}, regexp_replace(rest, {q(rule_pattern(rule))}, {q(rest)}, 'g') AS rest FROM {last})")
        last = f"r{i}"
        hits.append(f"hit{i}")
    told = " OR ".join(f"contains(body, '{w}')" for w in TRIGGERS)
    clean = f"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(body, {q(END_MARK)}, '', 'g'), {q(MARK)}, '', 'g'), {q(INITIAL)}, '\\1', 'g'), {q(STOP_NOR)}, '\\1', 'g'), {q(NUMBER)}, chr(10) || chr(10), 'g'), {q(VERSION)}, '\\1 \\2', 'g')"
    norm = r"regexp_replace(regexp_replace(regexp_replace({0}, '[^a-z0-9.+-]+', ' ', 'g'), '^[ .+-]+|[ .-]+$', '', 'g'), '\blicence\b', 'license', 'g')"

    def ids(source: str, key: str) -> str:
        spdx = f"CASE WHEN starts_with(x, '{OWN}') THEN 'LicenseRef-' || substr(x, {len(OWN) + 1}) ELSE m[x] END"
        parts = f"list_filter(list_transform(string_split_regex(regexp_extract({key}, {q(EXPRESSION)}, 1), ' (?:and|or|with) '), lambda x: 'spdx:' || {spdx}), lambda x: x IS NOT NULL)"

        def named(pattern: str) -> str:
            text = f"regexp_extract({key}, {q(pattern)}, 1)"
            listed = f"list_transform(string_split_regex(regexp_replace({text}, {q(CHOICE)}, '', 'g'), {q(LIST)}), lambda x: 'name:' || n[x])"
            return f"""CASE WHEN n[{text}] IS NOT NULL THEN ['name:' || n[{text}]] WHEN len({listed}) > 1 AND len(list_filter({listed}, lambda x: x IS NULL)) = 0 THEN {listed} ELSE [] END"""

        known = " ".join(f"WHEN regexp_matches({key}, {q(p)}) THEN ['{i}']" for i, p in PATTERNS.items())
        return f"""SELECT *, CASE WHEN k[{key}] IS NOT NULL THEN [k[{key}]] {known} WHEN regexp_matches({key}, {q(EXPRESSION)}) THEN {parts} WHEN regexp_matches({key}, {q(DENIED)}) THEN []
  WHEN len({named(STATEMENT)}) > 0 THEN {named(STATEMENT)} WHEN len({named(LINE)}) > 0 THEN {named(LINE)}
  WHEN ends_with({key}, ' license') AND n[{key}] IS NOT NULL THEN ['name:' || n[{key}]] ELSE [] END AS ids
  FROM {source}, maps"""

    return f"""
WITH maps AS (SELECT {_map_sql(_known())} AS k, {_map_sql(names())} AS n, {_map_sql(spdx_names())} AS m),
a AS (SELECT row_number() OVER () AS row, {id_col}, translate(coalesce({text_col}, ''), '{_UPPER}', '{_LOWER}') AS body FROM {table}),
b AS (SELECT row, unnest(runs) AS run, generate_subscripts(runs, 1) AS i FROM (SELECT row, string_split_regex({clean}, {q(RUN_END)}) AS runs FROM a WHERE {told})),
c AS MATERIALIZED ({ids("(SELECT *, " + norm.format("run") + " AS key FROM b)", "key")}),
d AS (SELECT row, i, unnest(lines) AS line, generate_subscripts(lines, 1) AS j FROM (SELECT row, i, string_split(run, chr(10)) AS lines FROM c WHERE len(ids) = 0)),
e AS MATERIALIZED ({ids("(SELECT *, " + norm.format("line") + " AS line_key FROM d)", "line_key")}),
f AS (SELECT row, i, 0 AS j, ids FROM c UNION ALL SELECT row, i, j, ids FROM e),
g AS (SELECT row, list(x ORDER BY i, j, place) AS found FROM (SELECT row, i, j, unnest(ids) AS x, generate_subscripts(ids, 1) AS place FROM f) GROUP BY row),
s AS (SELECT {id_col}, coalesce(found, []) AS found, '|' || coalesce(array_to_string(found, '|') || '|', '') AS sentence_ids, coalesce('<' || array_to_string(found, '><') || '>', '') AS rest FROM a LEFT JOIN g USING (row)),
{', '.join(steps)},
t AS (SELECT {id_col}, found, sentence_ids, array_to_string(list_sort(list_distinct(list_filter([{', '.join(hits)}], lambda x: x IS NOT NULL) ||
  list_transform(list_filter(found, lambda x: contains(x, ':')), lambda x: split_part(x, ':', 2)))), ',') AS licenses FROM {last})
SELECT {id_col}, sentence_ids, licenses, CASE WHEN licenses <> '' THEN 'known' WHEN contains(sentence_ids, '|rights-reserved|') THEN 'reserved'
  WHEN sentence_ids <> '|' THEN 'unknown' ELSE 'none' END AS verdict FROM t
"""

import re
from collections import Counter

import duckdb
import pytest

from millrace.llm import licenses

MIT = """MIT License

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
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT ...
"""
GPL = """# This program is free software: you can redistribute it and/or modify it
# under the terms of the GNU General Public License as published by the Free
# Software Foundation, either version 3 of the License, or (at your option) any
# later version. This program is distributed in the hope that it will be useful,
# but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY
# or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for
# more details.
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


BSD = """Copyright (c) 2020, Someone
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
BSD_NAME = """
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
BSD_ADVERT = """
3. All advertising materials mentioning features or use of this software must
   display the following acknowledgement:
   This product includes software developed by Someone.
"""
ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH
REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND
FITNESS. IN NO EVENT ...
"""
ZERO = ISC.replace(", provided that the above\ncopyright notice and this permission notice appear in all copies", "")
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/.
"""
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
BOOST = """Permission is hereby granted, free of charge, to any person or organization
obtaining a copy of the software and accompanying documentation covered by
this license (the "Software") to use, reproduce, display, distribute,
execute, and transmit the Software, and to prepare derivative works of the
Software, and to permit third-parties to whom the Software is furnished to
do so, all subject to the following:
"""
UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or
distribute this software, either in source code form or as a compiled
binary, for any purpose, commercial or non-commercial, and by any
means.
"""
CC0 = """To the extent possible under law, the author(s) have dedicated all copyright
and related and neighboring rights to this software to the public domain
worldwide.
"""
EPL = """This program and the accompanying materials are made available under the
terms of the Eclipse Public License 2.0 which is available at
https://www.eclipse.org/legal/epl-2.0/
"""


def gnu(kind, version, what="program"):
    return (
        f"This {what} is free software; you can redistribute it and/or modify it\nunder the terms of the GNU {kind}General Public License as published by the Free\n"
        f"Software Foundation; either version {version} of the License, or (at your option)\nany later version.\n\nThis {what} is distributed in the hope that it will be useful,\n"
        "but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY\nor FITNESS FOR A PARTICULAR PURPOSE. See the GNU "
        f"{kind}General Public License for\nmore details.\n"
    )


TEXTS = {
    "MIT": MIT, "Apache-2.0": APACHE, "BSD-2-Clause": BSD, "BSD-3-Clause": BSD + BSD_NAME, "BSD-4-Clause": BSD + BSD_ADVERT + BSD_NAME.replace("3.", "4."), "ISC": ISC, "0BSD": ZERO, "MPL-2.0": MPL,
    "MIT-0": MIT.split("\n\n", 1)[1].replace(", subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all\ncopies or substantial portions of the Software.", "."),
    "Zlib": ZLIB, "BSL-1.0": BOOST, "Unlicense": UNLICENSE, "CC0-1.0": CC0, "EPL-2.0": EPL, "WTFPL": " 0. You just DO WHAT THE FUCK YOU WANT TO.\n", "OFL-1.1": "This Font Software is licensed under the SIL Open Font License, Version 1.1.\n",
    "GPL-2.0-or-later": gnu("", "2"), "GPL-3.0-or-later": gnu("", "3"), "LGPL-2.1-or-later": gnu("Lesser ", "2.1", "library"), "LGPL-3.0-or-later": gnu("Lesser ", "3", "library"), "AGPL-3.0-or-later": gnu("Affero ", "3"),
    "GPL-2.0-only": "This program is free software; you can redistribute it and/or modify\nit under the terms of the GNU General Public License version 2 as\npublished by the Free Software Foundation.\n",
    "GPL-3.0-only": "This program is free software; you can redistribute it and/or modify\nit under the terms of the GNU General Public License version 3 as\npublished by the Free Software Foundation.\n",
    "LGPL-2.1-only": "                  GNU LESSER GENERAL PUBLIC LICENSE\n                       Version 2.1, February 1999\n\n Copyright (C) 1991, 1999 Free Software Foundation, Inc.\n",
    "LGPL-3.0-only": "GNU LESSER GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007\n", "AGPL-3.0-only": "GNU AFFERO GENERAL PUBLIC LICENSE\nVersion 3, 19 November 2007\n",
}
TITLES = {
    "Apache-2.0": "                                 Apache License\n                           Version 2.0, January 2004\n                        http://www.apache.org/licenses/\n\n   TERMS AND CONDITIONS\n",
    "GPL-3.0-only": "                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Copyright (C) 2007\n", "GPL-2.0-only": "GNU GENERAL PUBLIC LICENSE\nVersion 2, June 1991\n",
}
HOLDERS = ["Google Inc.", "the University", "the University of California, Berkeley", "John Q. Public", "the <ORGANIZATION>", "Some-One & Sons, Ltd."]

COMMENTS = [
    lambda t: t, lambda t: "x = 1\n\n" + "".join(f"# {x}\n" if x else "#\n" for x in t.splitlines()) + "\ny = 2\n",
    lambda t: "/*\n" + "".join(f" * {x}\n" if x else " *\n" for x in t.splitlines()) + " */\nint x;\n",
    lambda t: "".join(f"// {x}\n" if x else "//\n" for x in t.splitlines()), lambda t: f"<!--\n{t}-->\n<p>", lambda t: "".join(f";; {x}\r\n" for x in t.splitlines()),
]


def licenses_of(text):
    return licenses.recognised(text)[1]


@pytest.mark.parametrize("name", TEXTS)
@pytest.mark.parametrize("style", range(len(COMMENTS)))
def test_a_license_of_its_own_text(name, style):
    assert licenses_of(COMMENTS[style](TEXTS[name])) == name


def test_every_rule_is_met():
    assert {name for name, _ in licenses.RULES} <= set(TEXTS)
    for name, rule in licenses.RULES:
        assert licenses_of("\n\n".join(licenses.SENTENCES[i] for i in rule)) == name
        between = "\n\nsee the gnu general public license for more details\n\n"
        if "gpl-see" not in rule:  # others may stand between, and stay
            assert licenses.recognised(between.join(licenses.SENTENCES[i] for i in rule))[0].split("|").count("gpl-see") == len(rule) - 1
            assert name in licenses_of(between.join(licenses.SENTENCES[i] for i in rule))


STATEMENTS = {
    "SPDX-License-Identifier: GPL-2.0-or-later": "GPL-2.0-or-later", "// SPDX-License-Identifier: (MIT OR Apache-2.0)": "Apache-2.0,MIT", "/* SPDX-License-Identifier: GPL-2.0+ */": "GPL-2.0-or-later",
    "# SPDX-License-Identifier: GPL-2.0 WITH Linux-syscall-note": "GPL-2.0-only", "SPDX-License-Identifier: NoSuch": "", "License: MIT": "MIT", "Released under the MIT Licence.": "MIT",
    'Licensed under the Apache License, Version 2.0 (the "License")': "Apache-2.0", "Words.\nReleased under the MIT License.\nmore words": "MIT", "licensed under CC BY-NC 4.0": "CC-BY-NC-4.0",
    "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.": "CC-BY-SA-4.0", "A. Licensed under the Apache License, Version 2.0. B.": "Apache-2.0",
    "This work is licensed under the GNU General Public License, version 3.\nReleased under the MIT License.": "GPL-3.0-only,MIT", "Distributed under the terms of the BSD 3-Clause License": "BSD-3-Clause",
    "This package is licensed under the GNU Lesser General Public License v2.1 or later.": "LGPL-2.1-or-later", "The MIT License (MIT)": "MIT", "Available under the Mozilla Public License, v. 2.0.": "MPL-2.0",
    "Released under the\nMIT License": "MIT", "Released under CC0 1.0 Universal.": "CC0-1.0", "This licensed thing has no known sentence.": "", "This permission is no license of mine.": "", "the license mitten": "",
}


@pytest.mark.parametrize("text", STATEMENTS)
def test_statements(text):
    assert licenses_of(text) == STATEMENTS[text]


MORE = {
    "This file is not licensed under the MIT License.": "", "Not available under the MIT license.": "", "It is no longer released under the GPL v3.": "", "This is not a toy and is licensed under the MIT License.": "MIT",
    "This crate is dual-licensed under the MIT license and the Apache License 2.0.": "Apache-2.0,MIT", "Licensed under either of Apache License, Version 2.0 or MIT license at your option.": "Apache-2.0,MIT",
    "Licensed under the MIT license or no such license.": "", "SPDX-License-Identifier: MIT AND LicenseRef-Own-1": "LicenseRef-own-1,MIT", "SPDX-License-Identifier: LicenseRef-x": "LicenseRef-x",
}


@pytest.mark.parametrize("text", MORE)
def test_denials_and_lists(text):
    assert licenses_of(text) == MORE[text]


@pytest.mark.parametrize("holder", HOLDERS)
@pytest.mark.parametrize("style", range(len(COMMENTS)))
def test_bsd_of_any_holder(holder, style):
    for their in ("its", "their"):
        name = BSD_NAME.replace("the copyright holder", holder).replace("of its", f"of {their}")
        assert licenses_of(COMMENTS[style](BSD + name)) == "BSD-3-Clause"
        assert licenses_of(COMMENTS[style](BSD + BSD_ADVERT + name.replace("3.", "4."))) == "BSD-4-Clause"
    assert licenses_of(BSD + "3. The name of the author may not be used to endorse or promote products\nderived from this software without specific prior written permission.\n") == "BSD-3-Clause"


@pytest.mark.parametrize("name", TITLES)
def test_titles_of_full_texts(name):
    assert [licenses_of(style(TITLES[name])) for style in COMMENTS] == [name] * len(COMMENTS)


def test_a_style_is_no_license():
    assert licenses.recognised("Use of this source code is governed by a BSD-style\nlicense that can be found in the LICENSE file.") == ("|style-see|", "", "unknown")


def test_copies_of_a_header_take_time_by_their_number():
    import time

    took = []
    for n in (500, 2000):
        began = time.perf_counter()
        assert licenses_of((BSD + BSD_NAME + "\n" + APACHE + "\n") * n) == "Apache-2.0,BSD-3-Clause"
        took.append(time.perf_counter() - began)
    assert took[1] < 12 * took[0]


def test_rules_like_plain_scans():
    """The matcher against a plain one, on generated sequences."""
    import random

    def plain(found):
        left, out = list(found), set()
        for name, rule in licenses.RULES:
            begin = 0
            while True:
                taken, at = [], begin
                for x in rule:
                    while at < len(left) and left[at] != x:
                        at += 1
                    if at == len(left):
                        break
                    taken.append(at)
                    at += 1
                if len(taken) < len(rule):
                    break
                out.add(name)
                begin = taken[-1] + 1
                for at in taken:
                    left[at] = "#"
        return out

    rng = random.Random(4)
    for _ in range(300):
        rules = rng.sample(licenses.RULES, 4)
        found = [rng.choice(rng.choice(rules)[1]) for _ in range(rng.randint(0, 25))]
        assert licenses.matched(found) == plain(found)


def test_verdicts():
    assert licenses.recognised("Copyright 2020 Someone. All rights reserved.")[1:] == ("", "reserved")
    assert licenses.recognised(BSD)[2] == "known"
    assert licenses.recognised("See the GNU General Public License for more details.")[1:] == ("", "unknown")
    assert licenses.recognised("Plain words.") == ("|", "", "none")


def test_two_licenses_in_one_text():
    spdx = "SPDX-License-Identifier: GPL-3.0-only\nmodule loader\n\n"
    apache = "apache-header|apache-copy|apache-url|apache-unless|apache-see|"
    assert licenses.recognised(spdx + APACHE) == ("|spdx:GPL-3.0-only|" + apache, "Apache-2.0,GPL-3.0-only", "known")
    assert licenses.recognised(APACHE + "\n" + spdx) == ("|" + apache + "spdx:GPL-3.0-only|", "Apache-2.0,GPL-3.0-only", "known")
    grant, rest = MIT.split("\n\n", 1)[1].split("\n\n", 1)
    assert licenses.recognised(grant + "\n\n" + spdx + rest.replace(" IN NO EVENT ...", "")) == ("|mit-grant|spdx:GPL-3.0-only|mit-notice|mit-warranty|", "GPL-3.0-only,MIT", "known")


def texts():
    plain = [t for style in COMMENTS for t in map(style, TEXTS.values())] + list(STATEMENTS)
    plain += [*MORE, *TITLES.values(), (BSD + BSD_NAME) * 3, BSD + BSD_NAME + BSD, MIT * 2 + BSD_NAME, *(BSD + BSD_NAME.replace("the copyright holder", h) for h in HOLDERS)]
    return [None, "", *plain, "\n".join(TEXTS.values()), "All rights reserved.", "x " * 200_000 + "\n" + MIT, *plain[:5]]


def test_the_table_like_each_text(spark):
    rows = list(enumerate(texts()))
    got = Counter(tuple(r) for r in licenses.scan(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)).collect())
    assert got == Counter((i, *(licenses.recognised(t or ""))) for i, t in rows)


def test_sql_like_each_text():
    connection = duckdb.connect()
    connection.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    rows = list(enumerate(texts()))
    connection.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    got = Counter(connection.execute(licenses.scan_sql()).fetchall())
    assert got == Counter((i, *(licenses.recognised(t or ""))) for i, t in rows)


def test_every_known_sentence_has_a_trigger_and_is_normal():
    for s in [*licenses.SENTENCES.values(), *(f"released under the {n}" for n in licenses.names() if "licen" in n)]:
        assert any(t in s for t in licenses.TRIGGERS) or s.startswith("released under"), s
        assert re.fullmatch(r"[a-z0-9][a-z0-9 .+-]*[a-z0-9+]", s) and "  " not in s
    assert {i for _, rule in licenses.RULES for i in rule} <= set(licenses.SENTENCES)
    assert set(licenses.names().values()) <= set(licenses.SPDX) and {n for n, _ in licenses.RULES} <= set(licenses.SPDX)


def test_odd_rows(odd_docs, odd_rows):
    got = Counter((r.doc_id, r.sentence_ids, r.licenses, r.verdict) for r in licenses.scan(odd_docs).collect())
    assert got == Counter((r[0], *licenses.recognised(r[1] or "")) for r in odd_rows)


def test_empty_table(no_docs):
    assert licenses.scan(no_docs).count() == 0

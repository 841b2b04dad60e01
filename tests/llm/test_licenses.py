"""Licence notices as they are published: wrapped, and in comments."""

import re

from taperline.llm import license_scan

GNU = """This program is free software{} you can redistribute it and/or modify
it under the terms of the GNU {}General Public License as published by
the Free Software Foundation{} either version {} of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.
"""
BSD2 = """Copyright (c) 2020, Someone. All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
BSD3 = BSD2 + """
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
BSD_END = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY ARE DISCLAIMED.
"""
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED.
"""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
"""
ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES.
"""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/.
"""
UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or
distribute this software, either in source code form or as a compiled
binary, for any purpose, commercial or non-commercial, and by any
means.
"""
PUBLISHED = [
    (GNU.format(":", "", ",", 3), "GPL-3.0-or-later"), (GNU.format(";", "", ";", 2), "GPL-2.0-or-later"), (GNU.format(";", "Lesser ", ";", "2.1"), "LGPL-2.1-or-later"), (GNU.format(":", "Lesser ", ",", 3), "LGPL-3.0-or-later"),
    (GNU.format(":", "Affero ", ",", 3), "AGPL-3.0-or-later"), (BSD2 + BSD_END, "BSD-2-Clause"), (BSD3 + BSD_END, "BSD-3-Clause"), (MIT, "MIT"), (APACHE, "Apache-2.0"), (ISC, "ISC"), (MPL, "MPL-2.0"), (UNLICENSE, "Unlicense"),
]
OTHERS = [
    ("All  rights \t reserved.", "Proprietary"), ("All rights\nreserved", "Proprietary"), ("Released under the MIT\n\nLicense", None), ("This work is licensed under the GNU General Public License, version 3.", "GPL-3.0"),
    ("subject to the terms of the Mozilla Public License, v. 2.0.", "MPL-2.0"), ("Licensed under CC BY-NC 4.0.", "CC-BY-NC-4.0"), ("the software licence permits | rights", None), ("", None), (None, None),
]


#: More published notices.
NOTICES = [
    (BSD2 + BSD3[len(BSD2) :].replace("the copyright holder", "Google Inc.") + BSD_END, "BSD-3-Clause"),
    ("This program is free software; you can redistribute it and/or modify\nit under the terms of the GNU General Public License version 2 as\npublished by the Free Software Foundation.\n", "GPL-2.0-only"),
    ("This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; version 2 of the License.", "GPL-2.0-only"),
    ("This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License version 2.1 as published by the Free Software Foundation.", "LGPL-2.1-only"),
    (ISC.replace("and/or", "and"), "ISC"),
    ("                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Copyright", "GPL-3.0"), ("GNU GENERAL PUBLIC LICENSE\n   Version 2, June 1991\n", "GPL-2.0"),
    ("                   GNU LESSER GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n", "LGPL-3.0"), ("GNU AFFERO GENERAL PUBLIC LICENSE\nVersion 3, 19 November 2007", "AGPL-3.0"),
    ("Released under the GPLv3", "GPL-3.0"), ("Distributed under GPL v2.", "GPL-2.0"), ("Released under the LGPL 2.1", "LGPL-2.1"), ("Licensed under the AGPLv3.", "AGPL-3.0"),
    ("SPDX-License-Identifier: MIT", "MIT"), ("/* SPDX-License-Identifier: GPL-2.0-only WITH Linux-syscall-note */\nint x;", "GPL-2.0-only"), ("# SPDX-License-Identifier: GPL-2.0+\n", "GPL-2.0-or-later"),
    ("// SPDX-License-Identifier: LGPL-2.1\n// more", "LGPL-2.1"), ("SPDX-License-Identifier: (Apache-2.0 OR MIT)\nSPDX-License-Identifier: Unlicense", "MIT"), ("SPDX-License-Identifier: MIT-0", None), ("SPDX: MIT", None),
]


def marked(text, first, each, last):
    return first + "".join(f"{each}{line}".rstrip() + "\n" for line in text.split("\n")) + last


def test_published_notices(spark):
    forms = [lambda t: t, lambda t: marked(t, "/*\n", " * ", " */\n"), lambda t: marked(t, "", "// ", ""), lambda t: marked(t, "#!/bin/sh\n", "# ", ""), lambda t: re.sub(r"(?<!\n)\n(?!\n)", "\r\n", t), lambda t: "x y z.\n\n" + t + "\nint main;"]
    cases = [(f(t), want) for t, want in PUBLISHED for f in forms] + NOTICES + OTHERS
    d = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "doc_id long, text string")
    got = {r["doc_id"]: r["license"] for r in license_scan.license_scan(d).collect()}
    assert [(cases[i][0], got[i]) for i in range(len(cases))] == cases


def test_all_of_a_sentence(spark):
    text = "licensed under CC BY 4.0 or released under the MIT License or licensed under CC BY 4.0"
    r = license_scan.license_scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert r["sentence_ids"] == ["CcBy", "MitGrant", "CcBy"] and r["licenses"] == ["MIT", "CC-BY-4.0"]


def test_hints_and_rules_cover_the_sentences():
    names = [n for n, _ in license_scan.SENTENCES]
    assert len(set(names)) == len(names) and {i for _, need in license_scan.RULES for i in need if not i.startswith("Spdx")} <= set(names)
    for name, pattern in license_scan.SENTENCES:
        assert any(h in pattern for h in license_scan.HINTS), name


def test_sql_gives_the_same_rows(spark):
    import duckdb

    from taperline.llm.queries import ORACLE_SQL

    cases = [t for t, _ in PUBLISHED + NOTICES + OTHERS]
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", list(enumerate(cases)))
    d = spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")
    ours = {r["doc_id"]: (r["n_sentences"], ";".join(r["sentence_ids"]), r["license"], ";".join(r["licenses"])) for r in license_scan.license_scan(d).collect()}
    theirs = {r[0]: r[1:] for r in con.execute(f"select doc_id, n_sentences, sentence_ids, license, licenses from ({ORACLE_SQL['op8_license_scan']})").fetchall()}
    assert ours == theirs


def test_a_filter_does_not_copy_the_patterns(spark):
    d = license_scan.license_scan(spark.createDataFrame([(1, MIT), (2, "x")], "doc_id long, text string"))
    plan = lambda x: len(x._jdf.queryExecution().optimizedPlan().toString())
    assert plan(d.where("license is null").select("doc_id", "license", "licenses")) < 1.1 * plan(d)
    assert [r["doc_id"] for r in d.where("license is null").collect()] == [2]


def test_every_licence_of_a_text(spark):
    text = "SPDX-License-Identifier: Apache-2.0 OR MIT AND ISC\n\n" + MIT + "\nCopyright 2020 Some Co. Ltd. and others\n\n" + BSD2
    r = license_scan.license_scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert r["sentence_ids"][:3] == ["SpdxApache20", "SpdxMIT", "SpdxISC"] and r["licenses"] == ["MIT", "Apache-2.0", "ISC", "BSD-2-Clause", "Proprietary"]

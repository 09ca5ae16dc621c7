import os
import re

import duckdb

from keyloom.llm import licences as L

APACHE, MIT = "Licensed under the Apache License, Version 2.0.", "Released under the MIT License."
ROWS = [
    (1, "https://a.example.com/src/LICENSE", f"<p>{APACHE}</p>"), (2, "https://a.example.com/src/deep/er/x.html?q=1", "<p>nothing here</p>"), (3, "https://a.example.com/other/y", "<p>nor here</p>"),
    (4, "http://a.example.com/src/lib/", f"<h1>{MIT}</h1><p>text</p>"), (5, "http://a.example.com/src/lib/z#top", "<p>inherits the nearest</p>"), (6, "http://b.example.com/index.html", f"intro\n{MIT}\n"), (7, "http://b.example.com/q/r", ""),
    (8, "http://b.example.com/own", f"<p>{APACHE}</p><p>and a word on warranty</p>"), (9, None, None), (10, "plain", "All rights reserved"), (11, "plain", None), (11, "plain", None), (None, "c/d", f"<p>{MIT}"), (12, "", "licensed"),
    (13, "http://a.example.com/srcs/t", "not below src"), (14, "x/LICENSE", MIT), (15, "x/LICENSE", APACHE), (16, "x/y", "a tie of two licence files"),
]


def frame(spark, rows=ROWS):
    return spark.createDataFrame([(*r, "own", 1.0) for r in rows], "page_id long, url string, html string, licence string, cosine double")


def test_inheritance(spark):
    got = {r["page_id"]: (r["licence"], r["inherited_from"]) for r in L.licences(frame(spark)).collect()}
    assert got[1] == ("Apache-2.0", None) and got[2] == ("Apache-2.0", "a.example.com/src") and got[3] == (None, None)
    assert got[4] == ("MIT", None) and got[5] == ("MIT", "a.example.com/src/lib") and got[7] == ("MIT", "b.example.com")
    assert got[8] == ("Apache-2.0", None) and got[9] == got[11] == (None, None) and got[10] == ("Proprietary", None) and got[13] == (None, None)
    assert got[16][1] == "x" and len(L.licences(frame(spark)).collect()) == len(ROWS)


def test_matches_sql(spark):
    con = duckdb.connect()
    con.register("pages", frame(spark).select("page_id", "url", "html").toPandas().astype({"page_id": "Int64"}))
    columns = ["page_id", "path", "own_licence", "cosine", "licence", "inherited_from"]
    want = sorted(map(str, con.execute(f"SELECT {', '.join(columns)} FROM ({L.sql()})").fetchall()))
    assert sorted(str(tuple(r)) for r in L.licences(frame(spark)).select(*columns).collect()) == want


def test_every_template_finds_itself(spark):
    rows = [(k, f"p/{k}", text) for k, (_, text) in enumerate((n, t) for n, own in L.TEMPLATES.items() for t in own)]
    names = [n for n, own in L.TEMPLATES.items() for _ in own]
    assert all(re.search(L.CUE, t) for _, _, t in rows)
    got = {r["page_id"]: r["own_licence"] for r in L.licences(frame(spark, rows)).collect()}
    assert all(got[k] == names[k] for k in got)


COMMON = "/usr/share/common-licenses"
FULL = {"Apache-2.0": "Apache-2.0", "BSD": "BSD-3-Clause", "CC0-1.0": "CC0-1.0", "GFDL-1.2": "GFDL-1.2", "GFDL-1.3": "GFDL-1.3", "GPL-1": "GPL-1.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2": "LGPL-2.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-1.1": "MPL-1.1", "MPL-2.0": "MPL-2.0"}
MIT_TEXT = """MIT License

Copyright (c) 2024 The Authors

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
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.
"""
HEADERS = {
    "Apache-2.0": 'Copyright 2024 The Authors\n\nLicensed under the Apache License, Version 2.0 (the "License");\nyou may not use this file except in compliance with the License.\nYou may obtain a copy of the License at\n\n    http://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law or agreed to in writing, software\ndistributed under the License is distributed on an "AS IS" BASIS,\nWITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version.\n\nThis program is distributed in the hope that it will be useful,\nbut WITHOUT ANY WARRANTY; without even the implied warranty of\nMERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "GPL-2.0": "This program is free software; you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation; either version 2 of the License, or\n(at your option) any later version.",
    "LGPL-2.1": "This library is free software; you can redistribute it and/or\nmodify it under the terms of the GNU Lesser General Public\nLicense as published by the Free Software Foundation; either\nversion 2.1 of the License, or (at your option) any later version.",
    "LGPL-3.0": "This library is free software: you can redistribute it and/or modify\nit under the terms of the GNU Lesser General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version.",
    "AGPL-3.0": "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU Affero General Public License as published\nby the Free Software Foundation, either version 3 of the License, or\n(at your option) any later version.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this\nfile, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "BSD-3-Clause": "Copyright (c) 2024, The Authors\nAll rights reserved.\n\nRedistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:",
    "ISC": "Copyright (c) 2024 The Authors\n\nPermission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies.",
    "MIT": MIT_TEXT.split("\n\n")[2],
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons\nAttribution-ShareAlike 4.0 International License.",
    "Proprietary": "Copyright 2024 The Authors. All rights reserved.",
}


def test_real_texts_wrapped_unwrapped_and_as_headers(spark):
    """Full texts as they come, on one line, and without their line ends within paragraphs; headers in comments, above code."""
    full = {n: open(f"{COMMON}/{f}", errors="replace").read() for f, n in FULL.items() if os.path.exists(f"{COMMON}/{f}")} | {"MIT": MIT_TEXT}
    rows, want = [], []

    def put(name, text):
        rows.append((len(rows), f"p{len(rows)}/x", text))
        want.append(name)

    for name, text in full.items():
        put(name, text)
        put(name, " ".join(text.split()))
        put(name, re.sub(r"(?<!\n)\n(?!\n)", " ", text))
        put(name, text.replace("\n", "\r\n"))
    for name, text in HEADERS.items():
        put(name, text)
        put(name, " ".join(text.split()))
        put(name, "#!/bin/sh\n#\n" + "".join(f"# {line}\n" for line in text.split("\n")) + "#\n\nimport sys\nrun()\n")
        put(name, "/*\n" + "".join(f" * {line}\n" for line in text.split("\n")) + " */\n\nint main(void) { return 0; }\n")
    for text in ("Some prose on how the licence of a driver is renewed.", "warranty claims need a receipt", "The king gave his permission."):
        put(None, text)
    got = {r["page_id"]: r["own_licence"] for r in L.licences(frame(spark, rows)).collect()}
    wrong = [(want[k], got[k], rows[k][2][:60]) for k in range(len(rows)) if got[k] != want[k]]
    assert not wrong and len(want) > 50


def test_very_long_texts(spark):
    text = "word and more words\n" * 100_000
    got = {r["page_id"]: r["own_licence"] for r in L.licences(frame(spark, [(1, "a/b", text + MIT_TEXT + text), (2, "a/c", text), (3, "a/d", "licence " * 300_000)])).collect()}
    assert got == {1: "MIT", 2: None, 3: None}


def test_many_pages_of_one_directory(spark, monkeypatch):
    before = sorted(map(str, L.licences(frame(spark)).collect()))
    monkeypatch.setattr("keyloom.llm.common.HOT_ROWS", 2)
    assert sorted(map(str, L.licences(frame(spark)).collect())) == before


def test_empty_table(spark):
    assert L.licences(frame(spark).limit(0)).collect() == []

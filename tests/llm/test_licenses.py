import textwrap

from gaugework.llm import licenses


def wrapped(*names):
    return "\n\n".join("\n".join(textwrap.wrap(licenses.SENTENCES[n], 60)) for n in names)


def test_rules(documents):
    s = licenses.SENTENCES
    rows = [
        (1, "Some prose.\nReleased under the MIT License.\nAnd more"),
        (2, wrapped("mit-grant", "mit-notice", "mit-as-is")),
        (3, wrapped("mit-as-is", "mit-notice", "mit-grant")),  # the wrong order
        (4, wrapped("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse")),
        (5, s["gpl3-grant"] + " Filler one. Filler two. " + s["gpl-no-warranty"]),
        (6, s["gpl3-grant"] + " Filler one. Filler two. Filler three. " + s["gpl-no-warranty"]),  # too far apart
        (7, "licensed UNDER  cc-by-nc 4.0. All rights reserved!"),
        (8, "This licence text is not a known one. Permission is granted."),
        (9, wrapped("apache2-grant", "apache2-copy") + "\n\n" + s["apache2-as-is"]),
    ]
    got = {r["doc_id"]: r["licenses"] for r in licenses.license_report(documents(rows)).collect()}
    assert got == {
        1: "MIT", 2: "MIT", 3: "", 4: "BSD-2-Clause,BSD-3-Clause", 5: "GPL-3.0", 6: "", 7: "CC-BY-NC-4.0,all-rights-reserved", 8: "", 9: "Apache-2.0",
    }


def test_every_known_sentence_has_an_anchor_and_every_rule_its_sentences():
    numbers, rules = licenses._catalogue()
    assert all(any(a in s for a in licenses.ANCHORS) for s in numbers)
    assert {x for all_ in licenses.RULES.values() for rule in all_ for x in rule} == set(licenses.SENTENCES)
    assert len(rules) == sum(map(len, licenses.RULES.values()))


def test_edges_and_native_plan(documents, edge_rows):
    out = licenses.license_report(documents(edge_rows))
    rows = out.collect()
    assert len(rows) == len(edge_rows) and all(tuple(r)[1:] == (0, 0, "") for r in rows)
    assert licenses.license_report(documents([])).collect() == []
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not any(w in plan for w in ("Python", "Pandas", "Arrow", "Exchange"))
    kept = licenses.scanned(documents([(1, "x")]))
    assert kept.columns == [*documents([]).columns, "licenses"]


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
BSD = """Copyright 2008, Google Inc.
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are
met:

    * Redistributions of source code must retain the above copyright
notice, this list of conditions and the following disclaimer.
    * Redistributions in binary form must reproduce the above
copyright notice, this list of conditions and the following disclaimer
in the documentation and/or other materials provided with the
distribution.
    * Neither the name of Google Inc. nor the names of its
contributors may be used to endorse or promote products derived from
this software without specific prior written permission.
"""
ZLIB = """Copyright (c) 2000 A B

This software is provided 'as-is', without any express or implied
warranty. In no event will the authors be held liable for any damages
arising from the use of this software.

Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it
freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented.
"""
EPL = """/*
 * Copyright (c) 2019 A and others
 *
 * This program and the accompanying materials are made available under
 * the terms of the Eclipse Public License 2.0 which is available at
 * https://www.eclipse.org/legal/epl-2.0/
 *
 * SPDX-License-Identifier: EPL-2.0
 */
"""


def test_published_notices(documents):
    hashed = "".join(f"# {line}".rstrip() + "\n" for line in ("Copyright 2020 Google LLC\n" + APACHE).splitlines())
    lgpl = "\n\n".join("\n".join(textwrap.wrap(licenses.PUBLISHED[n], 70)) for n in ("lgpl2.1-grant", "lgpl2.1-no-warranty"))
    rows = [
        (1, APACHE), (2, "Copyright 2020 Google LLC\n" + APACHE), (3, hashed), (4, BSD), (5, ZLIB), (6, EPL), (7, lgpl),
        (8, "This work is licensed under a Creative Commons\nAttribution-NonCommercial-ShareAlike 4.0 International License."),
        (9, "Copyright 2020 A\n" + wrapped("mit-grant", "mit-notice", "mit-as-is")), (10, APACHE.replace("Unless", "When")), (11, None),
    ]
    got = {r["doc_id"]: r["licenses"] for r in licenses.published_report(documents(rows)).collect()}
    assert got == {
        1: "Apache-2.0", 2: "Apache-2.0", 3: "Apache-2.0", 4: "BSD-2-Clause,BSD-3-Clause,all-rights-reserved", 5: "Zlib", 6: "EPL-2.0",
        7: "LGPL-2.1", 8: "CC-BY-NC-SA-4.0", 9: "MIT", 10: "", 11: "",
    }


def test_sentences_and_rules_are_arguments(documents):
    rows = [(1, "Before. Take it and\nrun. After."), (2, "Take it.")]
    got = licenses.license_report(documents(rows), sentences={"own": "Take it and run."}, rules={"Own": [["own"]]}, joined=True)
    assert {r["doc_id"]: r["licenses"] for r in got.collect()} == {1: "Own", 2: ""}

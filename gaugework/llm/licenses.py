r"""License scans by sentence rules, in DataFrame operations only.

A text is cut into sentences, each sentence is reduced to its lower-case ASCII letters and digits, and known license
sentences become identifiers. A rule is an ordered list of identifiers; it holds where its sentences follow each other
with at most ``GAP`` other sentences between two of them. Texts are read twice, once with each line end closing a
sentence and once with only empty lines doing so (wrapped license texts); a rule may hold in either reading.

That catalogue (``SENTENCES``, ``RULES``) and the two readings are those of the ``op4`` query, whose SQL fixes them. Sentences
and rules are arguments; ``published_report`` takes the wider catalogue (``PUBLISHED``, ``PUBLISHED_RULES``) and a third reading
for notices as they are published: empty lines are no ends, copyright lines, colons and addresses at a line's end are,
and the organisation in "Neither the name of ..." is read as the copyright holder.

Every step works inside a row, so nothing is shuffled and no row depends on another. A text without any of the words
that every known sentence contains is left out of the cutting; that test is exact, and not made for sentences without.

Defined cases: a null or empty text has no sentences and no licenses; a rule that holds several times is named once;
licenses are listed in code point order; rows with equal keys get results of their own; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugework.functions.columns import once, ref
from gaugework.llm.common import free_name

GAP = 2

# Sentences of well-known licenses, as they are published, by identifier.
SENTENCES = {
    "agpl-grant": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "agpl3-name": "This work is licensed under the GNU Affero General Public License, version 3.",
    "all-rights": "All rights reserved.",
    "apache2-as-is": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "apache2-copy": "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "apache2-copy-https": "You may obtain a copy of the License at https://www.apache.org/licenses/LICENSE-2.0",
    "apache2-grant": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
    "apache2-name": "Licensed under the Apache License, Version 2.0.",
    "boost-name": "Distributed under the Boost Software License, Version 1.0.",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-endorse": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-name": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "cc-by-4": "Licensed under CC BY 4.0.",
    "cc-by-4-work": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4": "Licensed under CC BY-NC 4.0.",
    "cc-by-nc-4-work": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "cc-by-nd-4": "Licensed under CC BY-ND 4.0.",
    "cc-by-sa-4": "Licensed under CC BY-SA 4.0.",
    "cc-by-sa-4-work": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc0-name": "Licensed under CC0 1.0.",
    "gpl-no-warranty": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "gpl2-grant": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "gpl2-name": "This work is licensed under the GNU General Public License, version 2.",
    "gpl3-grant": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl3-name": "This work is licensed under the GNU General Public License, version 3.",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "mit-as-is": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "mit-name": "Released under the MIT License.",
    "mit-name-licensed": "Licensed under the MIT License.",
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mpl2-copy": "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "mpl2-grant": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "unlicense-grant": "This is free and unencumbered software released into the public domain.",
}

# License (SPDX identifiers where there is one) -> its rules, each an ordered list of sentences.
RULES = {
    "AGPL-3.0": [["agpl3-name"], ["agpl-grant", "gpl-no-warranty"]],
    "Apache-2.0": [["apache2-name"], ["apache2-grant", "apache2-copy", "apache2-as-is"], ["apache2-grant", "apache2-copy-https", "apache2-as-is"]],
    "BSD-2-Clause": [["bsd-grant", "bsd-source", "bsd-binary"]],
    "BSD-3-Clause": [["bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse"]],
    "BSD-style": [["bsd-name"]],
    "BSL-1.0": [["boost-name"]],
    "CC-BY-4.0": [["cc-by-4"], ["cc-by-4-work"]],
    "CC-BY-NC-4.0": [["cc-by-nc-4"], ["cc-by-nc-4-work"]],
    "CC-BY-ND-4.0": [["cc-by-nd-4"]],
    "CC-BY-SA-4.0": [["cc-by-sa-4"], ["cc-by-sa-4-work"]],
    "CC0-1.0": [["cc0-name"]],
    "GPL-2.0": [["gpl2-name"], ["gpl2-grant", "gpl-no-warranty"]],
    "GPL-3.0": [["gpl3-name"], ["gpl3-grant", "gpl-no-warranty"]],
    "ISC": [["isc-grant"]],
    "MIT": [["mit-name"], ["mit-name-licensed"], ["mit-grant", "mit-notice", "mit-as-is"]],
    "MPL-2.0": [["mpl2-grant", "mpl2-copy"], ["mpl2-grant"]],
    "Unlicense": [["unlicense-grant"]],
    "all-rights-reserved": [["all-rights"]],
}

# Sentences and rules beside those of the query.
PUBLISHED = SENTENCES | {
    "cc-by-nc-sa-4": "Licensed under CC BY-NC-SA 4.0.",
    "cc-by-nc-sa-4-work": "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
    "cc-by-nd-4-work": "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    "epl1-grant": "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html",
    "epl2-grant": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "lgpl2.1-grant": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "lgpl2.1-no-warranty": "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "lgpl3-grant": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "zlib-as-is": "This software is provided 'as-is', without any express or implied warranty.",
    "zlib-grant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
}
PUBLISHED_RULES = RULES | {
    "CC-BY-NC-SA-4.0": [["cc-by-nc-sa-4"], ["cc-by-nc-sa-4-work"]],
    "CC-BY-ND-4.0": [["cc-by-nd-4"], ["cc-by-nd-4-work"]],
    "EPL-1.0": [["epl1-grant"]],
    "EPL-2.0": [["epl2-grant"]],
    "LGPL-2.1": [["lgpl2.1-grant", "lgpl2.1-no-warranty"]],
    "LGPL-3.0": [["lgpl3-grant", "gpl-no-warranty"]],
    "Zlib": [["zlib-as-is", "zlib-grant"]],
}

# Every known sentence has one of these words.
ANCHORS = ("licen", "copyright", "permission", "permitted", "warrant", "rights", "unencumbered", "redistribut", "mpl")

_END = r"([.!?])[\x09\x0A\x0C\x0D\x20]+"
_COPYRIGHT_LINE = r"(?m)^[^a-z0-9\x0A]*(?:copyright\b(?:[^\x0A]*(?:\(c\)|©|[0-9]{4})| (?:the|by)\b)|\(c\)|©)[^\x0A]*$"
_LINE_END = r"(:|https?://[^\x09\x0A\x0C\x0D\x20]+)[\x09\x0D\x20]*(?:\x0A|\z)"
_HOLDER = r"neither~the~names?~of~[^\x01]{1,150}?~nor~the~names~of~(?:(?:its|their|any)~)?contributors".replace("~", r"[^a-z0-9\x01]+")
_ANY_HOLDER = "neither the name of the copyright holder nor the names of its contributors"
_EMPTY_LINE = r"\x0A[\x09\x0C\x0D\x20]*\x0A"


def cut(text: str) -> list[str]:
    """The sentences of a known text in their reduced form (as ``_sentences`` makes them)."""
    marked = re.sub(r"[^a-z0-9\n]+", " ", re.sub(_END, "\\1\n", text.lower()))
    return [s.strip(" ") for s in marked.split("\n") if s.strip(" ")]


def rule_pattern(rule: list[str], numbers: dict[str, str]) -> str:
    """A rule over the sequence of sentence numbers, each ended by a semicolon; other sentences are a dash."""
    between = "([^;]*;){0,%d}" % GAP
    return "(^|;)" + between.join(f"{numbers[s]};" for s in rule)


def _catalogue(sentences: dict[str, str] = SENTENCES, licenses: dict[str, list[list[str]]] = RULES) -> tuple[dict[str, str], list[tuple[str, str]]]:
    """Reduced sentence -> number, and (license, pattern) of each rule. A sentence that is cut is a run of numbers."""
    numbers: dict[str, str] = {}
    runs: dict[str, str] = {}
    for name, text in sentences.items():
        # "v. 2.0" leaves a rest that says nothing
        parts = [p for p in cut(text) if re.search("|".join(ANCHORS), p)] or cut(text)
        for p in parts:
            numbers.setdefault(p, str(len(numbers) + 1))
        runs[name] = ";".join(numbers[p] for p in parts)
    rules = [(name, rule_pattern(rule, runs)) for name, all_ in licenses.items() for rule in all_]
    return numbers, rules


def _sentences(text: Column) -> Column:
    marked = F.regexp_replace(F.regexp_replace(F.lower(text), _END, "$1\n"), "[^a-z0-9\n]+", " ")
    return F.filter(F.transform(F.split(marked, "\n"), lambda s: F.trim(s)), lambda s: s != "")


def _joined(text: Column) -> Column:
    """The text of the third reading: a line for each stretch without an end."""
    ended = F.regexp_replace(F.regexp_replace(F.lower(text), _COPYRIGHT_LINE, "\x01"), _LINE_END, "$1\x01")
    return F.translate(F.regexp_replace(ended, _HOLDER, _ANY_HOLDER), "\n\x01", " \n")


def scanned(
    docs: DataFrame, text: str = "text", column: str = "licenses", sentences: dict[str, str] = SENTENCES,
    rules: dict[str, list[list[str]]] = RULES, joined: bool = False,
) -> DataFrame:
    """``docs`` with a struct column, ``column`` or its first free form: licenses (sorted), known (number of known sentences), lines and wrapped (the
    sequences of sentence numbers in both readings); with the third reading (``joined``) also joined."""
    numbers, rules = _catalogue(sentences, rules)
    known = F.create_map(*[F.lit(x) for pair in numbers.items() for x in pair])
    body = ref(text).cast("string")
    anchored = all(re.search("|".join(ANCHORS), s) for s in numbers)
    may = F.coalesce(F.lower(body).rlike("|".join(ANCHORS)), F.lit(False)) if anchored else body.isNotNull()
    none = F.array().cast("array<string>")
    wrapped = F.translate(F.regexp_replace(body, _EMPTY_LINE, "\x01"), "\n\x01", " \n")
    cut_ = once(docs, _gw_lines=F.when(may, _sentences(body)).otherwise(none))
    cut_ = once(cut_, _gw_wrapped=F.when(may, _sentences(wrapped)).otherwise(none))

    readings = {"lines": "_gw_a", "wrapped": "_gw_b"}
    if joined:
        cut_ = once(cut_, _gw_joined=F.when(may, _sentences(_joined(body))).otherwise(none))
        readings["joined"] = "_gw_c"

    def sequence(sentences: str) -> Column:
        return F.array_join(F.transform(sentences, lambda s: F.concat(F.coalesce(F.try_element_at(known, s), F.lit("-")), F.lit(";"))), "")

    coded = once(cut_, **{c: sequence(f"_gw_{r}") for r, c in readings.items()})
    codes = list(readings.values())
    held: dict[str, Column] = {}
    for name, pattern in rules:
        holds = reduce(or_, [F.col(c).rlike(pattern) for c in codes])
        held[name] = held[name] | holds if name in held else holds
    names = F.array_compact(F.array(*[F.when(held[n], F.lit(n)) for n in sorted(held)]))
    any_known = reduce(or_, [F.col(c).rlike("[0-9]") for c in codes])
    result = F.struct(
        F.when(any_known, names).otherwise(none).alias("licenses"),
        F.greatest(*[F.regexp_count(c, F.lit("[0-9]+;")) for c in codes]).cast("long").alias("known"),
        *[F.col(c).alias(r) for r, c in readings.items()],
    )
    return coded.withColumn(free_name(docs, column), result).drop(*[f"_gw_{r}" for r in readings], *codes)


def license_report(
    docs: DataFrame, key: str = "doc_id", text: str = "text", sentences: dict[str, str] = SENTENCES,
    rules: dict[str, list[list[str]]] = RULES, joined: bool = False,
) -> DataFrame:
    """Per document: number of known sentences, number of licenses, and the licenses, joined by commas."""
    rows = scanned(docs.select(ref(key).alias("doc_id"), ref(text).alias("text")), sentences=sentences, rules=rules, joined=joined)
    found = F.col("licenses.licenses")
    return rows.select(
        "doc_id", F.col("licenses.known").alias("n_known"), F.size(found).cast("long").alias("n_licenses"),
        F.array_join(found, ",").alias("licenses"),
    )


def published_report(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The report with the wider catalogue and the third reading."""
    return license_report(docs, key, text, PUBLISHED, PUBLISHED_RULES, joined=True)


def check_sql() -> str:
    """The report in SQL: sentences as rows, rules over their numbers."""
    numbers, rules = _catalogue()
    values = ", ".join(f"('{s}', '{n}')" for s, n in numbers.items())
    tests = ", ".join(f"('{name}', '{pattern}')" for name, pattern in rules)
    reading = "regexp_replace(regexp_replace(lower({0}), '%s', '\\1' || chr(10), 'g'), '[^a-z0-9\\n]+', ' ', 'g')" % _END
    whole = f"translate(regexp_replace(text, '{_EMPTY_LINE}', chr(1), 'g'), chr(10) || chr(1), ' ' || chr(10))"
    return f"""
WITH known(sentence, n) AS (VALUES {values}),
rules(license, pattern) AS (VALUES {tests}),
readings AS (
  SELECT doc_id, 'a' AS r, {reading.format('text')} AS body FROM documents
  UNION ALL SELECT doc_id, 'b', {reading.format(whole)} FROM documents),
parts AS (
  SELECT doc_id, r, i, trim(l[i]) AS sentence FROM (
    SELECT doc_id, r, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, r, string_split(body, chr(10)) AS l FROM readings))),
codes AS (
  SELECT doc_id, r, string_agg(coalesce(n, '-') || ';', '' ORDER BY i) AS code, count(n) AS n_known
  FROM parts LEFT JOIN known ON parts.sentence = known.sentence WHERE parts.sentence <> '' GROUP BY doc_id, r),
held AS (SELECT DISTINCT doc_id, license FROM codes, rules WHERE n_known > 0 AND regexp_matches(code, pattern)),
named AS (SELECT doc_id, count(*) AS n, string_agg(license, ',' ORDER BY license) AS l FROM held GROUP BY doc_id),
most AS (SELECT doc_id, max(n_known) AS n_known FROM codes GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(m.n_known, 0) AS BIGINT) AS n_known, CAST(coalesce(h.n, 0) AS BIGINT) AS n_licenses,
  coalesce(h.l, '') AS licenses
FROM documents d LEFT JOIN most m ON d.doc_id = m.doc_id LEFT JOIN named h ON d.doc_id = h.doc_id
"""

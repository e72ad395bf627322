"""Licence scans by sentence rules, in DataFrame functions only.

A text is cut at ends of sentences and at blank lines, and may be cut at single line breaks: a known sentence
is found where it fills one line or a run of neighbouring lines, whatever comment marks or bullets these start
with. Text is normalised: lower case, and every run of other characters than letters and digits becomes one
space. Known licence sentences have identifiers; a rule is an ordered list of identifiers, and it matches a text whose sequence of identifiers
holds them in that order with at most ``gap`` other known sentences between two of them. Of nested rules
the longest counts: a rule is left out where all its sentences belong to a longer rule that matched.

Work is bounded by the text: sentences are of a fixed table and begin at cuts alone, and texts without any cue that
every known sentence holds are not cut at all. Null and empty texts have no licence; repeated rows have
equal results; copies of a text in one document count once in ``licences``.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Licence sentences (as published) by identifier, and rules as ordered identifiers.
SENTENCES = {
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions",
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    "mit-warranty": "The Software is provided \"as is\", without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement",
    "mit-short": "Released under the MIT License",
    "mit-short-2": "Licensed under the MIT License",
    "mit-short-3": "This project is licensed under the MIT License",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
    "bsd-names": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "apache-header": "Licensed under the Apache License, Version 2.0 (the \"License\")",
    "apache-comply": "you may not use this file except in compliance with the License",
    "apache-copy": "You may obtain a copy of the License at",
    "apache-basis": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied",
    "apache-see": "See the License for the specific language governing permissions and limitations under the License",
    "apache-short": "Licensed under the Apache License, Version 2.0",
    "gpl3-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "gpl2-free": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version",
    "gpl-hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY",
    "gpl-implied": "without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE",
    "gpl-details": "See the GNU General Public License for more details",
    "gpl3-short": "This work is licensed under the GNU General Public License, version 3",
    "gpl2-short": "This work is licensed under the GNU General Public License, version 2",
    "mpl2-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "unlicense": "This is free and unencumbered software released into the public domain",
    "cc0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work",
    "cc-by-4": "Licensed under CC BY 4.0",
    "cc-by-sa-4": "Licensed under CC BY-SA 4.0",
    "cc-by-nc-4": "Licensed under CC BY-NC 4.0",
    "cc-by-4-long": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "cc-by-sa-4-long": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "cc-by-nc-4-long": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
    "spdx-mit": "SPDX-License-Identifier: MIT",
    "spdx-apache": "SPDX-License-Identifier: Apache-2.0",
    "spdx-bsd3": "SPDX-License-Identifier: BSD-3-Clause",
    "spdx-gpl3": "SPDX-License-Identifier: GPL-3.0-only",
    "reserved": "All rights reserved",
}
RULES = [
    ("MIT", "mit-grant mit-notice mit-warranty"), ("MIT", "mit-grant mit-notice"), ("MIT", "mit-short"), ("MIT", "mit-short-2"), ("MIT", "mit-short-3"), ("MIT", "spdx-mit"),
    ("ISC", "isc-grant"),
    ("BSD-3-Clause", "bsd-grant bsd-source bsd-binary bsd-names"), ("BSD-2-Clause", "bsd-grant bsd-source bsd-binary"), ("BSD-3-Clause", "spdx-bsd3"),
    ("Apache-2.0", "apache-header apache-comply apache-copy apache-basis apache-see"), ("Apache-2.0", "apache-header"), ("Apache-2.0", "apache-short"), ("Apache-2.0", "spdx-apache"),
    ("GPL-3.0-or-later", "gpl3-free gpl-hope gpl-implied gpl-details"), ("GPL-3.0-or-later", "gpl3-free"), ("GPL-2.0-or-later", "gpl2-free gpl-hope gpl-implied gpl-details"), ("GPL-2.0-or-later", "gpl2-free"),
    ("GPL-3.0", "gpl3-short"), ("GPL-2.0", "gpl2-short"), ("GPL-3.0", "spdx-gpl3"),
    ("MPL-2.0", "mpl2-header"), ("Unlicense", "unlicense"), ("CC0-1.0", "cc0"),
    ("CC-BY-4.0", "cc-by-4"), ("CC-BY-SA-4.0", "cc-by-sa-4"), ("CC-BY-NC-4.0", "cc-by-nc-4"),
    ("CC-BY-4.0", "cc-by-4-long"), ("CC-BY-SA-4.0", "cc-by-sa-4-long"), ("CC-BY-NC-4.0", "cc-by-nc-4-long"),
    ("proprietary", "reserved"),
]
CUES = "licen|permi|copyright|warrant|redistribut|free software|all rights reserved|unencumbered"
# Ends of sentences: line breaks, and marks before white space or a quote; a semicolon counts as one.
BREAK = r"[\r\n]+|[.!?;](?=[\s\"'*)]|$)"
# Gaps between words, by what is in them. A gap that ends a sentence, or holds a blank line, is a cut; one with a
# single line break may be. An end mark after the line break (as in "; comment") belongs to the next line's prefix.
_GAP = r"(?<![^a-z0-9])[^a-z0-9\r\n]*"
_CUT = rf"{_GAP}?[.!?;](?=[\s\"'*)]|$)[^a-z0-9]*+|{_GAP}+(?>\r\n|\r|\n)[^a-z0-9\r\n]*+[\r\n][^a-z0-9]*+"
_LINE = r"(?<![^a-z0-9])[^a-z0-9\r\nH]*+[\r\n][^a-z0-9]*+"
# Words that start a comment line in m4 and in batch files.
_PREFIX = r"(?<![^\r\n])[^\S\r\n]*+@?(?:dnl|rem)(?![a-z0-9])"


def normal(sentence: str) -> str:
    return re.sub(r"[^a-z0-9]+", " ", sentence.lower()).strip()


def table(sentences: dict[str, str]) -> dict[str, str]:
    """Normalised sentence to identifier; a known sentence with breaks inside counts by its longest part."""
    out = {}
    for name, text in sentences.items():
        parts = [p for p in map(normal, re.split(BREAK, text)) if p]
        out[max(parts, key=len)] = name
    return out


def scan(docs: DataFrame, sentences: dict[str, str] | None = None, rules: list[tuple[str, str]] | None = None, gap: int = 2) -> DataFrame:
    """``doc_id, n_known, sentence_ids, licences`` of every row of ``doc_id, text``: texts joined by commas."""
    sentences, rules = sentences or SENTENCES, rules or RULES
    known = table(sentences)
    if any(not re.search(CUES, k) for k in known):
        raise ValueError("every known sentence must hold a cue")
    lookup = F.create_map(*[x for k, v in known.items() for x in (F.lit(k), F.lit(v))])
    text = F.lower(F.coalesce(F.col("text"), F.lit("")))
    # Words in small letters, with H for a cut, S for a line break and a space for any other gap.
    stream = F.regexp_replace(text, _PREFIX, "")
    for gap_pattern, mark in ((_CUT, "H"), (_LINE, "S"), ("[^a-z0-9HS]+", " ")):
        stream = F.regexp_replace(stream, gap_pattern, mark)
    longest_first = "|".join(k.replace(" ", "[ S]") for k in sorted(known, key=lambda k: (-len(k), k)))
    hits = F.regexp_extract_all(F.trim(stream), F.lit(f"(?<![a-z0-9 ])(?:{longest_first})(?![a-z0-9 ])"), F.lit(0))
    found = F.transform(hits, lambda s: F.try_element_at(lookup, F.translate(s, "S", " ")))
    names = F.when(text.rlike(CUES.replace(" ", "[^a-z0-9]+(?:(?:dnl|rem)[^a-z0-9]+)?")), found).otherwise(F.array().cast("array<string>"))
    rows = docs.select("doc_id", names.alias("names")).withColumn("line", F.concat(F.lit(","), F.concat_ws(",", "names"), F.lit(",")))
    between = rf"(?:[^,]+,){{0,{gap}}}?"
    matched = {i: F.col("line").rlike("," + ("," + between).join(map(re.escape, r.split())) + ",") for i, (_, r) in enumerate(rules)}
    parts = []
    for i, (licence, r) in enumerate(rules):
        longer = [j for j, (_, other) in enumerate(rules) if j != i and set(r.split()) < set(other.split())]
        held = matched[i]
        for j in longer:
            held = held & ~matched[j]
        parts.append(F.when(held, F.lit(licence)))
    told = rows.withColumn("licences", F.when(F.size("names") > 0, F.concat_ws(",", F.array_sort(F.array_distinct(F.array_compact(F.array(*parts)))))).otherwise(""))
    return told.select("doc_id", F.size("names").cast("long").alias("n_known"), F.concat_ws(",", "names").alias("sentence_ids"), "licences")


def oracle() -> str:
    """The same scan for the documents table in DuckDB's SQL."""
    def quoted(x: str) -> str:
        return "'" + x.replace("'", "''") + "'"

    values = ", ".join(f"({quoted(k)}, {quoted(v)})" for k, v in table(SENTENCES).items())
    pieces = []
    for i, (licence, r) in enumerate(RULES):
        def test(rule: str) -> str:
            return "regexp_matches(line, " + quoted("," + ",(?:[^,]+,){0,2}?".join(map(re.escape, rule.split())) + ",") + ")"

        longer = [other for j, (_, other) in enumerate(RULES) if j != i and set(r.split()) < set(other.split())]
        pieces.append("CASE WHEN " + " AND ".join([test(r), *(f"NOT {test(o)}" for o in longer)]) + f" THEN {quoted(licence)} END")
    return f"""
WITH known(sentence, name) AS (VALUES {values}),
cut AS (
  SELECT doc_id, rowid_, unnest(parts) AS part, generate_subscripts(parts, 1) AS i
  FROM (SELECT doc_id, row_number() OVER () AS rowid_, regexp_split_to_array(regexp_replace(coalesce(text, ''), '[.!?;]([\\s"''*)]|$)', chr(10) || '\\1', 'g'), '[\\r\\n]+') AS parts FROM documents)
), named AS (
  SELECT c.doc_id, c.rowid_, string_agg(k.name, ',' ORDER BY c.i) AS ids, count(k.name) AS n
  FROM cut c LEFT JOIN known k ON k.sentence = trim(regexp_replace(lower(c.part), '[^a-z0-9]+', ' ', 'g')) GROUP BY ALL
), lined AS (SELECT doc_id, n, coalesce(ids, '') AS ids, ',' || coalesce(ids, '') || ',' AS line FROM named)
SELECT doc_id, n AS n_known, ids AS sentence_ids,
  coalesce(array_to_string(list_sort(list_distinct(list_filter([{", ".join(pieces)}], lambda x: x IS NOT NULL))), ','), '') AS licences
FROM lined
"""

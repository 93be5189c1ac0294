"""Licence scans by sentence rules.

A text is cut into sentences (after . ; : ! ? before white space, and at blank lines), which are
normalised (lower case, runs of other characters than a-z and 0-9 as one space) and looked up
among the known licence sentences.  A sentence over several lines is looked up whole and, if
unknown, line by line.  A known sentence that this cut falls into (``v. 2.0``) is recognised by its
pieces, one right after the other.  The recognised identifiers in text order are then matched against
ordered rules: a licence is found where the identifiers of one of its rules stand in that order
next to each other.  A match inside a longer match of another licence doesn't count if ``part_of``
says so; one elsewhere in the text does.

One projection, no shuffle: the row keeps its identity, so repeated rows and doc_ids are no problem
and ties don't arise.  Null and empty texts have no sentence and no licence.  Texts are scanned
whole; those that hold none of a few words, chosen so that every known sentence has one, are done
at once.  Only doc_id and text are read, so other columns can't clash; an empty table gives an
empty result.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidara.llm.common import let

#: Licence sentences by identifier, in the public licences' own words.
SENTENCES = {
    1: "Released under the MIT License",
    2: "Licensed under the MIT License",
    3: "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions",
    4: "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    5: "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT",
    10: "Licensed under the Apache License, Version 2.0",
    11: "Licensed under the Apache License, Version 2.0 (the \"License\")",
    12: "you may not use this file except in compliance with the License",
    13: "You may obtain a copy of the License at",
    14: "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied",
    20: "This work is licensed under the GNU General Public License, version 3",
    21: "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    22: "This program is free software",
    23: "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    24: "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    25: "either version 2 of the License, or (at your option) any later version",
    26: "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY",
    27: "without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE",
    28: "See the GNU General Public License for more details",
    29: "You should have received a copy of the GNU General Public License along with this program",
    30: "Licensed under CC BY-NC 4.0",
    31: "Licensed under CC BY 4.0",
    32: "Licensed under CC BY-SA 4.0",
    33: "This work is licensed under a Creative Commons Attribution 4.0 International License",
    34: "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
    40: "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    41: "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
    42: "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
    43: "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    44: "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED",
    50: "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    60: "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    61: "This is free and unencumbered software released into the public domain",
    70: "This library is free software",
    71: "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    72: "either version 2.1 of the License, or (at your option) any later version",
    73: "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    74: "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    75: "either version 3 of the License, or (at your option) any later version",
    80: "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide",
    81: "Licensed under CC0 1.0",
    82: "This work is licensed under CC0 1.0 Universal",
    85: "This software is provided 'as-is', without any express or implied warranty",
    86: "In no event will the authors be held liable for any damages arising from the use of this software",
    87: "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",
    88: "Distributed under the Boost Software License, Version 1.0",
    89: "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0",
    90: "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    91: "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed",
}
#: Ordered rules, licence and identifiers.
RULES = (
    ("MIT", (1,)),
    ("MIT", (2,)),
    ("MIT", (3, 4)),
    ("MIT", (3, 4, 5)),
    ("Apache-2.0", (10,)),
    ("Apache-2.0", (11, 12)),
    ("Apache-2.0", (11, 12, 13, 14)),
    ("GPL-3.0", (20,)),
    ("GPL-3.0", (21,)),
    ("GPL-3.0", (22, 23)),
    ("GPL-3.0", (22, 23, 26, 27, 28)),
    ("GPL-3.0", (22, 24, 75)),
    ("GPL-2.0", (22, 24, 25)),
    ("GPL-2.0", (22, 24, 25, 26, 27, 28)),
    ("GPL", (26, 27, 28)),
    ("GPL", (28, 29)),
    ("GPL-2.0", (22, 24, 25, 26, 27, 28, 29)),
    ("GPL-3.0", (22, 23, 26, 27, 28, 29)),
    ("LGPL-2.1", (70, 71, 72)),
    ("LGPL-2.1", (22, 71, 72)),
    ("LGPL-3.0", (70, 73)),
    ("LGPL-3.0", (22, 73)),
    ("LGPL-3.0", (70, 71, 75)),
    ("AGPL-3.0", (22, 74)),
    ("CC-BY-NC-4.0", (30,)),
    ("CC-BY-NC-4.0", (34,)),
    ("CC-BY-4.0", (31,)),
    ("CC-BY-4.0", (33,)),
    ("CC-BY-SA-4.0", (32,)),
    ("CC-BY-SA-4.0", (90,)),
    ("CC0-1.0", (80,)),
    ("CC0-1.0", (81,)),
    ("CC0-1.0", (82,)),
    ("BSD-2-Clause", (40, 41, 42)),
    ("BSD-3-Clause", (40, 41, 42, 43)),
    ("BSD-2-Clause", (40, 41, 42, 44)),
    ("BSD-3-Clause", (40, 41, 42, 43, 44)),
    ("ISC", (50,)),
    ("MPL-2.0", (60,)),
    ("Unlicense", (61,)),
    ("Zlib", (85, 86, 87)),
    ("BSL-1.0", (88,)),
    ("EPL-2.0", (89,)),
    ("WTFPL", (91,)),
)
#: Matches of the first licence don't count inside those of the second.
PART_OF = (("BSD-2-Clause", "BSD-3-Clause"), ("GPL", "GPL-2.0"), ("GPL", "GPL-3.0"))
END = r"[.;:!?]+(?=\s|$)|\n\s*\n"


def normal(s: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(s), "[^a-z0-9]+", " "))


def normal_text(s: str) -> str:
    return re.sub("[^a-z0-9]+", " ", s.lower()).strip()


def pieces_of(s: str) -> list[str]:
    """The normalised sentences that a text of this one sentence is cut into."""
    return [p for p in map(normal_text, re.split(END, s)) if p]


def known_sentences(sentences) -> tuple[dict[str, int], dict[int, list[int]]]:
    """Identifiers by normalised sentence, and the pieces of those that are cut further.

    Pieces that aren't sentences of their own have negative identifiers; a sentence all of whose
    pieces are known ones is left to rules over these.
    """
    known: dict[str, int] = {}
    for i, s in sentences.items():
        known.setdefault(normal_text(s), i)
    cut = {i: p for i, s in sentences.items() if len(p := pieces_of(s)) > 1 and not all(x in known for x in p)}
    for p in cut.values():
        for x in p:
            known.setdefault(x, -1 - len(known))
    return known, {i: [known[x] for x in p] for i, p in cut.items()}


def telling_words(sentences) -> list[str]:
    """Words of which every sentence has at least one, long and shared ones first."""
    left = [{w for w in x.split() if len(w) >= 7} or {max(x.split(), key=len)} for x in map(normal_text, sentences.values()) if x]
    out = []
    while left:
        best = max(sorted(set().union(*left)), key=lambda w: (sum(w in x for x in left), len(w)))
        out.append(best)
        left = [x for x in left if best not in x]
    return out


def sentence_ids(text: Column, sentences=None) -> Column:
    """Identifiers of the known sentences of a text, in order; sentences have positive numbers."""
    sentences = SENTENCES if sentences is None else sentences
    known, cut = known_sentences(sentences)
    if not known:
        return F.array().cast("array<int>")
    table = F.create_map(*[F.lit(x) for kv in known.items() for x in kv])
    id_of = lambda s: F.try_element_at(table, normal(s))

    def of(segment: Column) -> Column:
        whole = id_of(segment)
        lines = F.transform(F.split(segment, "\n", -1), id_of)
        return let(whole, lambda w: F.when(w.isNotNull(), F.array(w)).when(segment.contains("\n"), lines).otherwise(F.array(F.lit(None).cast("int"))))

    def joined(found: Column) -> Column:
        """The sentence in place of the first of its pieces, and nothing in place of the others."""

        def at(x: Column, i: Column) -> Column:
            out = F.when(x.isNull(), F.lit(None).cast("int"))
            for number, ids in cut.items():
                whole = x == ids[0]
                for k, piece in enumerate(ids[1:], 1):
                    whole = whole & F.coalesce(F.get(found, i + k) == piece, F.lit(False))
                out = out.when(whole, F.lit(number))
            return out.when(x > 0, x)

        return F.transform(found, at)

    parts = F.flatten(F.transform(F.split(text, END, -1), of))
    ids = F.filter(let(parts, joined) if cut else parts, lambda x: x.isNotNull())
    low = F.lower(text)
    worth = F.lit(False)
    for word in telling_words(sentences):
        worth = worth | low.contains(word)
    return F.when(worth, ids).otherwise(F.array().cast("array<int>"))


def match_rules(ids: Column, rules=RULES, part_of=PART_OF) -> Column:
    """Sorted names of the licences whose ordered rules match the identifiers."""
    line = F.concat(F.lit(" "), F.array_join(F.transform(ids, lambda x: x.cast("string")), " "), F.lit(" "))
    by_name: dict[str, list] = {}
    for name, seq in rules:
        by_name.setdefault(name, []).append(" " + " ".join(map(str, seq)) + " ")

    def any_of(line: Column) -> Column:
        hit = {}
        for name, seqs in by_name.items():
            for s in seqs:
                hit[name] = line.contains(s) if name not in hit else hit[name] | line.contains(s)
        for part in dict.fromkeys(p for p, _ in part_of if p in by_name):
            wholes = [x for p, whole in part_of if p == part for x in by_name.get(whole, [])]
            taken = "|".join(x.rstrip() for x in sorted(wholes, key=lambda x: (-len(x), x)))
            rest = F.regexp_replace(line, f"(?:{taken})(?= )", " |") if wholes else line
            hit[part] = F.lit(False)
            for x in by_name[part]:
                hit[part] = hit[part] | rest.contains(x)
        return F.filter(F.array(*[F.when(hit[name], F.lit(name)) for name in sorted(hit)]), lambda x: x.isNotNull())

    return let(line, any_of)


def scan_licenses(docs: DataFrame) -> DataFrame:
    """doc_id, n_sentences, sentence_ids, licenses (both joined by commas) of every document."""
    text = F.coalesce("text", F.lit(""))
    found = docs.select("doc_id", let(sentence_ids(text), lambda ids: F.struct(ids.alias("ids"), match_rules(ids).alias("names"))).alias("f"))
    return found.select(
        "doc_id",
        F.size("f.ids").cast("long").alias("n_sentences"),
        F.array_join(F.transform("f.ids", lambda x: x.cast("string")), ",").alias("sentence_ids"),
        F.array_join("f.names", ",").alias("licenses"),
    )

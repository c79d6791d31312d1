"""Licence scans by sentence rules.

A text is cut into sentences, a sentence is normalised (lower case, words
only), and a table maps the sentences that occur in licences to their
identifiers. A licence is an ordered rule: a sequence of sentence identifiers
that must follow each other. Rules are tried longest first at every known
sentence, and a match consumes its sentences.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import need, ship_package

# Sentences of public licence texts and notices.
SENTENCES = {
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
                 "associated documentation files (the \"Software\"), to deal in the Software without restriction, "
                 "including without limitation the rights to use, copy, modify, merge, publish, distribute, "
                 "sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is "
                 "furnished to do so, subject to the following conditions:",
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or "
                  "substantial portions of the Software.",
    "mit-released": "Released under the MIT License.",
    "mit-licensed": "Licensed under the MIT License.",
    "mit-this": "This project is licensed under the MIT License.",
    "apache-licensed": "Licensed under the Apache License, Version 2.0.",
    "apache-header": "Licensed under the Apache License, Version 2.0 (the \"License\");",
    "apache-may-not": "you may not use this file except in compliance with the License.",
    "apache-obtain": "You may obtain a copy of the License at",
    "apache-unless": "Unless required by applicable law or agreed to in writing, software distributed under the "
                     "License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, "
                     "either express or implied.",
    "apache-see": "See the License for the specific language governing permissions and limitations under the License.",
    "gpl3-work": "This work is licensed under the GNU General Public License, version 3.",
    "gpl3-licensed": "Licensed under the GNU General Public License, version 3.",
    "gpl3-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the "
                     "GNU General Public License as published by the Free Software Foundation, either version 3 of the "
                     "License, or (at your option) any later version.",
    "gpl2-or-later": "This program is free software; you can redistribute it and/or modify it under the terms of the "
                     "GNU General Public License as published by the Free Software Foundation; either version 2 of the "
                     "License, or (at your option) any later version.",
    "gpl-hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even "
                "the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "bsd-redistribution": "Redistribution and use in source and binary forms, with or without modification, are "
                          "permitted provided that the following conditions are met:",
    "bsd-licensed": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "mpl2-subject": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "mpl2-obtain": "If a copy of the MPL was not distributed with this file, You can obtain one at "
                   "https://mozilla.org/MPL/2.0/.",
    "cc-by": "Licensed under CC BY 4.0.",
    "cc-by-sa": "Licensed under CC BY-SA 4.0.",
    "cc-by-nc": "Licensed under CC BY-NC 4.0.",
    "cc-by-nd": "Licensed under CC BY-ND 4.0.",
    "cc-by-nc-sa": "Licensed under CC BY-NC-SA 4.0.",
    "cc-by-nc-nd": "Licensed under CC BY-NC-ND 4.0.",
    "cc-by-work": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to "
           "this work.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "reserved": "All rights reserved.",
}
# Licence -> its rules, each an ordered sequence of sentence identifiers.
RULES = {
    "MIT": [("mit-grant", "mit-notice"), ("mit-released",), ("mit-licensed",), ("mit-this",)],
    "Apache-2.0": [("apache-header", "apache-may-not", "apache-obtain"), ("apache-header", "apache-may-not"),
                   ("apache-unless", "apache-see"), ("apache-licensed",)],
    "GPL-3.0": [("gpl3-work",), ("gpl3-licensed",)],
    "GPL-3.0-or-later": [("gpl3-or-later", "gpl-hope"), ("gpl3-or-later",)],
    "GPL-2.0-or-later": [("gpl2-or-later", "gpl-hope"), ("gpl2-or-later",)],
    "BSD": [("bsd-redistribution",), ("bsd-licensed",)],
    "MPL-2.0": [("mpl2-subject", "mpl2-obtain"), ("mpl2-subject",)],
    "CC-BY-4.0": [("cc-by",), ("cc-by-work",)],
    "CC-BY-SA-4.0": [("cc-by-sa",)],
    "CC-BY-NC-4.0": [("cc-by-nc",)],
    "CC-BY-ND-4.0": [("cc-by-nd",)],
    "CC-BY-NC-SA-4.0": [("cc-by-nc-sa",)],
    "CC-BY-NC-ND-4.0": [("cc-by-nc-nd",)],
    "CC0-1.0": [("cc0",)],
    "Unlicense": [("unlicense",)],
    "All-Rights-Reserved": [("reserved",)],
}

# A sentence ends at the end of a line, or at . ! ? ; : before white space.
_BREAK = re.compile(r"(?<=[.!?;:])\s+|\n")
_WORDS = re.compile(r"[a-z0-9]+")


def normalise(sentence: str) -> tuple[str, ...]:
    return tuple(_WORDS.findall(sentence.lower()))


class Scanner:
    """Recognises sentences and matches rules over their identifiers. A known
    sentence may itself hold breaks; it then counts as its parts in order."""

    def __init__(self, sentences: dict[str, str], rules: dict[str, list[tuple[str, ...]]]):
        parts = {name: tuple(p for p in map(normalise, _BREAK.split(text)) if p) for name, text in sentences.items()}
        self.ids: dict[tuple[str, ...], int] = {}
        for seq in parts.values():
            for p in seq:
                self.ids.setdefault(p, len(self.ids))
        # ordered rules over identifiers, longest first; ties in the order given
        self.by_first: dict[int, list[tuple[tuple[int, ...], str]]] = {}
        for licence, options in rules.items():
            for option in options:
                seq = tuple(self.ids[p] for name in option for p in parts[name])
                self.by_first.setdefault(seq[0], []).append((seq, licence))
        for options in self.by_first.values():
            options.sort(key=lambda x: -len(x[0]))
        # a known sentence holds one of these words; texts without them are not split
        rare = {min(p, key=lambda w: (-len(w), w)) for p in self.ids}
        self.hint = re.compile("|".join(sorted(map(re.escape, rare))), re.I)
        self.most_words = max(map(len, self.ids), default=0)

    def sentences(self, text: str):
        """(identifier or None, start, end) of every sentence; wrapped lines are joined while
        they make up a known sentence."""
        spans, at = [], 0
        for m in _BREAK.finditer(text):
            spans.append((at, m.start()))
            at = m.end()
        spans.append((at, len(text)))
        words = [normalise(text[a:b]) for a, b in spans]
        out, i = [], 0
        while i < len(spans):
            joined, found = words[i], None
            j = i
            while joined and len(joined) <= self.most_words:
                if joined in self.ids:
                    found = (self.ids[joined], j)
                j += 1
                if j >= len(spans):
                    break
                joined = joined + words[j]
            if found:
                out.append((found[0], spans[i][0], spans[found[1]][1]))
                i = found[1] + 1
            else:
                if words[i]:
                    out.append((None, *spans[i]))
                i += 1
        return out

    def scan(self, text: str | None) -> list[tuple[str, int, int]]:
        """(licence, start, end) in the order of the text."""
        if not text or not self.hint.search(text):
            return []
        seen, found, i = self.sentences(text), [], 0
        while i < len(seen):
            for seq, licence in self.by_first.get(seen[i][0], ()):
                if tuple(s[0] for s in seen[i:i + len(seq)]) == seq:
                    found.append((licence, seen[i][1], seen[i + len(seq) - 1][2]))
                    i += len(seq)
                    break
            else:
                i += 1
        return found


def scan_licences(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                  sentences: dict[str, str] | None = None, rules: dict | None = None) -> DataFrame:
    """One row per document: id, licences (distinct, sorted), and spans: an
    array of (licence, start, stop) in code points of the text.

    A NULL or empty text has none; repeated rows are scanned alike; other
    columns are ignored; an empty table gives no row.
    """
    need(docs, id_col, text_col)
    ship_package(docs.sparkSession)
    scanner = Scanner(sentences or SENTENCES, rules or RULES)
    span = pa.list_(pa.struct([("licence", pa.string()), ("start", pa.int32()), ("stop", pa.int32())]))

    def run(batches):
        for batch in batches:
            found = [scanner.scan(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([sorted({x[0] for x in f}) for f in found], pa.list_(pa.string())),
                 pa.array([[{"licence": n, "start": a, "stop": b} for n, a, b in f] for f in found], span)],
                names=["doc_id", "licences", "spans"])
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        run, "doc_id long, licences array<string>, spans array<struct<licence:string,start:int,stop:int>>")

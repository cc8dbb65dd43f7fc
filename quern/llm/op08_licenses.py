"""License scans by template-markup matching.

Templates are license wordings with markup: ``<<beginOptional>>`` ...
``<<endOptional>>`` may be there or not, ``<<var;min=1;max=6>>`` stands for
any so many words.  A template is compiled to a token automaton; a text is
accepted where a run of its words goes through the automaton, that is where
the mandatory wording matches exactly and in full.  Base phrases are found
besides, wherever their words stand consecutively.

A worker first numbers the words that templates use (all others are one
number), tests with array arithmetic which documents hold every mandatory word
of a template, and runs the automaton over those only; a document without one
of the mandatory words can't be accepted.

Null text counts as empty (no words, no labels, score 0).  Every row gives one
row, repeated ids and null ids included; an empty table an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.words import NOT_ALNUM, coded, row_of, slices, split_words

# Base phrases and their labels.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

# Wordings of public licenses and of usual notices, with markup.
TEMPLATES = {
    "mit": [
        "<<beginOptional>>this <<var;min=1;max=3>> is<<endOptional>> released under the <<beginOptional>>terms of the<<endOptional>> MIT license",
        "licensed under the <<beginOptional>>terms of the<<endOptional>> MIT license",
        """<<beginOptional>>MIT License<<endOptional>> <<beginOptional>>Copyright <<var;min=1;max=12>><<endOptional>>
        Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
        associated documentation files (the "Software"), to deal in the Software without restriction, including
        without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
        copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the
        following conditions: The above copyright notice and this permission notice
        <<beginOptional>>(including the next paragraph)<<endOptional>> shall be included in all copies or
        substantial portions of the Software.""",
    ],
    "apache-2": [
        "licensed under the Apache License, Version 2.0 <<beginOptional>>(the License)<<endOptional>>",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
        compliance with the License. You may obtain a copy of the License at <<var;min=1;max=12>> Unless required
        by applicable law or agreed to in writing, software distributed under the License is distributed on an
        "AS IS" BASIS""",
    ],
    "gpl-3": [
        "this <<var;min=1;max=3>> is licensed under the <<beginOptional>>terms of the<<endOptional>> GNU General Public License, <<beginOptional>>GPL<<endOptional>> version 3",
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU
        General Public License as published by the Free Software Foundation, either version 3 of the License, or
        (at your option) any later version.""",
    ],
    "cc-by-nc": ["<<beginOptional>>this <<var;min=1;max=3>> is<<endOptional>> licensed under <<beginOptional>>a creative commons<<endOptional>> CC BY-NC <<beginOptional>>4.0<<endOptional>>"],
    "isc": [
        """Permission to use, copy, modify, and<<beginOptional>>/or<<endOptional>> distribute this software for any
        purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.""",
    ],
    "bsd": [
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided
        that the following conditions are met: <<beginOptional>>1.<<endOptional>> Redistributions of source code must
        retain the above copyright notice, this list of conditions and the following disclaimer.""",
        "licensed under the <<beginOptional>>terms of the<<endOptional>> <<beginOptional>><<var;min=1;max=3>><<endOptional>> BSD <<beginOptional>><<var;min=1;max=2>><<endOptional>> license",
    ],
    "all-rights-reserved": ["<<beginOptional>>copyright <<var;min=1;max=8>><<endOptional>> all rights reserved"],
    "gpl-2": [
        """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General
        Public License as published by the Free Software Foundation; either version 2 of the License, or (at your
        option) any later version.""",
        "licensed under the <<beginOptional>>terms of the<<endOptional>> GNU General Public License, <<beginOptional>>GPL<<endOptional>> version 2",
    ],
    "lgpl": [
        """This <<var;min=1;max=2>> is free software: you can redistribute it and/or modify it under the terms of the GNU
        Lesser General Public License as published by the Free Software Foundation""",
        "GNU Library General Public License as published by the Free Software Foundation",
        "licensed under the <<beginOptional>>terms of the<<endOptional>> GNU Lesser General Public License",
    ],
    "agpl-3": [
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero
        General Public License as published by the Free Software Foundation, either version 3 of the License""",
        "licensed under the <<beginOptional>>terms of the<<endOptional>> GNU Affero General Public License",
    ],
    "mpl-2": [
        """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was
        not distributed with this file, You can obtain one at""",
        "licensed under the <<beginOptional>>terms of the<<endOptional>> Mozilla Public License <<beginOptional>>version<<endOptional>> <<beginOptional>>v<<endOptional>> 2.0",
    ],
    "mpl-1.1": ["""The contents of this file are subject to the Mozilla Public License Version 1.1 (the "License"); you may not use this file except in compliance with the License."""],
    "epl": ["made available under the terms of the Eclipse Public License <<beginOptional>>version<<endOptional>> <<beginOptional>>v<<endOptional>> <<var;min=1;max=2>>"],
    "cddl": ["subject to the terms of the Common Development and Distribution License"],
    "eupl": ["licensed under the <<beginOptional>>European Union Public Licence<<endOptional>> EUPL", "licensed under the European Union Public Licence"],
    "unlicense": ["This is free and unencumbered software released into the public domain."],
    "public-domain": [
        "<<beginOptional>>is<<endOptional>> <<beginOptional>>hereby<<endOptional>> released into the public domain",
        "placed in the public domain",
        "is in the public domain",
    ],
    "cc0": ["has waived all copyright and related or neighboring rights", "licensed under <<beginOptional>>a creative commons<<endOptional>> CC0", "CC0 1.0 Universal"],
    "cc-by": ["licensed under a Creative Commons Attribution <<beginOptional>>3.0<<endOptional>> <<beginOptional>>4.0<<endOptional>> <<beginOptional>>International<<endOptional>> <<beginOptional>>Unported<<endOptional>> License", "licensed under <<beginOptional>>a creative commons<<endOptional>> CC BY 4.0"],
    "cc-by-sa": ["licensed under a Creative Commons Attribution-ShareAlike", "licensed under <<beginOptional>>a creative commons<<endOptional>> CC BY-SA"],
    "cc-by-nd": ["licensed under a Creative Commons Attribution-NoDerivatives", "licensed under a Creative Commons Attribution-NoDerivs", "licensed under <<beginOptional>>a creative commons<<endOptional>> CC BY-ND"],
    "cc-by-nc-sa": ["licensed under a Creative Commons Attribution-NonCommercial-ShareAlike", "licensed under <<beginOptional>>a creative commons<<endOptional>> CC BY-NC-SA"],
    "cc-by-nc-nd": ["licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives", "licensed under <<beginOptional>>a creative commons<<endOptional>> CC BY-NC-ND"],
    "zlib": [
        """Permission is granted to anyone to use this software for any purpose, including commercial applications, and
        to alter it and redistribute it freely, subject to the following restrictions""",
    ],
    "boost": ["Boost Software License, Version 1.0", "licensed under the Boost Software License"],
    "wtfpl": ["do what the fuck you want to public license"],
    "ofl": ["licensed under the SIL Open Font License"],
    "artistic": ["licensed under the <<beginOptional>>terms of the<<endOptional>> Artistic License", "under the same terms as Perl itself"],
    "postgresql": ["Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted"],
    "python": ["Python Software Foundation License <<beginOptional>>version<<endOptional>> <<var;min=1;max=1>>"],
    "gfdl": ["Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License"],
    "ncsa": ["University of Illinois/NCSA Open Source License"],
    "ms-pl": ["Microsoft Public License (Ms-PL)"],
    "upl": ["Universal Permissive License (UPL), Version 1.0", "licensed under the Universal Permissive License"],
    "afl": ["licensed under the Academic Free License"],
    "odbl": ["Open Data Commons Open Database License", "licensed under the Open Database License"],
    "sspl": ["licensed under the Server Side Public License", "terms of the Server Side Public License"],
    "busl": ["Business Source License <<beginOptional>>version<<endOptional>> 1.1"],
    "elastic": ["licensed under the Elastic License"],
    "cpl": ["made available under the terms of the Common Public License"],
    "openssl": ["This product includes software developed by the OpenSSL Project for use in the OpenSSL Toolkit"],
}

# Identifiers of a license line, and their labels.
IDENTIFIERS = {
    "MIT": "mit", "Apache-2.0": "apache-2", "GPL-2.0": "gpl-2", "GPL-3.0": "gpl-3", "LGPL-2.0": "lgpl", "LGPL-2.1": "lgpl",
    "LGPL-3.0": "lgpl", "AGPL-3.0": "agpl-3", "MPL-1.1": "mpl-1.1", "MPL-2.0": "mpl-2", "EPL-1.0": "epl", "EPL-2.0": "epl",
    "CDDL-1.0": "cddl", "EUPL-1.2": "eupl", "BSD-2-Clause": "bsd", "BSD-3-Clause": "bsd", "0BSD": "0bsd", "ISC": "isc",
    "Unlicense": "unlicense", "CC0-1.0": "cc0", "CC-BY-4.0": "cc-by", "CC-BY-SA-4.0": "cc-by-sa", "CC-BY-NC-4.0": "cc-by-nc",
    "CC-BY-ND-4.0": "cc-by-nd", "CC-BY-NC-SA-4.0": "cc-by-nc-sa", "CC-BY-NC-ND-4.0": "cc-by-nc-nd", "Zlib": "zlib",
    "BSL-1.0": "boost", "WTFPL": "wtfpl", "OFL-1.1": "ofl", "Artistic-2.0": "artistic", "PostgreSQL": "postgresql",
    "PSF-2.0": "python", "GFDL-1.3": "gfdl", "NCSA": "ncsa", "MS-PL": "ms-pl", "UPL-1.0": "upl", "AFL-3.0": "afl",
    "ODbL-1.0": "odbl", "SSPL-1.0": "sspl", "BUSL-1.1": "busl", "Elastic-2.0": "elastic", "CPL-1.0": "cpl", "OpenSSL": "openssl",
}
for _name, _label in IDENTIFIERS.items():
    TEMPLATES.setdefault(_label, []).append(f"SPDX-License-Identifier: {_name}")

MARK = re.compile(r"<<(beginOptional|endOptional|var;min=(\d+);max=(\d+))>>")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text: str) -> list[str]:
    """Words of an ASCII template, lower-cased."""
    return WORD.findall(text.lower())


class Automaton:
    """Token automaton of one template.

    State k stands before item k; items are a word's number, or None for any
    word.  free[k]: states that are reached from k without a word.
    """

    def __init__(self, template: str, number: dict[str, int]):
        self.items: list[int | None] = []
        self.free: dict[int, set[int]] = {}
        self.mandatory: set[int] = set()
        opened: list[int] = []
        last = 0
        for m in [*MARK.finditer(template), None]:
            for w in words_of(template[last : m.start() if m else None]):
                self.items.append(number[w])
                if not opened:
                    self.mandatory.add(number[w])
            if m is None:
                break
            last = m.end()
            if m[1] == "beginOptional":
                opened.append(len(self.items))
            elif m[1] == "endOptional":
                self.free.setdefault(opened.pop(), set()).add(len(self.items))
            else:
                least, most = int(m[2]), int(m[3])
                end = len(self.items) + most
                for k in range(least, most):
                    self.free.setdefault(len(self.items) + k, set()).add(end)
                self.items += [None] * most
        self.initial = self.closed({0})
        self.first = {self.items[k] for k in self.initial if k < len(self.items)}

    def closed(self, states: set[int]) -> set[int]:
        todo, out = list(states), set(states)
        while todo:
            for k in self.free.get(todo.pop(), ()):
                if k not in out:
                    out.add(k)
                    todo.append(k)
        return out

    def accepted(self, codes: list[int]) -> list[tuple[int, int]]:
        """(start, end) of runs that go through, leftmost and longest first, not overlapping."""
        out, at, n, end = [], 0, len(codes), len(self.items)
        anything = None in self.first
        while at < n:
            if not anything and codes[at] not in self.first:
                at += 1
                continue
            states, k, found = self.initial, at, -1
            while states and k < n:
                states = self.closed({s + 1 for s in states if s < end and self.items[s] in (None, codes[k])})
                k += 1
                if end in states:
                    found = k
            if found >= 0:
                out.append((at, found))
            at = found if found > at else at + 1
        return out


Wordings = tuple[tuple[str, str], ...]
OWN_PHRASES: Wordings = tuple((label, p) for p, label in PHRASES.items())
OWN_TEMPLATES: Wordings = tuple((label, t) for label, ts in TEMPLATES.items() for t in ts)


def wordings(table: DataFrame, most: int = 20_000) -> Wordings:
    """Templates or phrases from a table (label, text); more than ``most`` rows are
    an error, as every worker compiles and holds all of them."""
    rows = table.select(F.col("label").cast("string"), F.col("text").cast("string")).filter("label is not null and text is not null").distinct().limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} wordings")
    return tuple(sorted(map(tuple, rows)))


@lru_cache(maxsize=2)
def compiled(phrases: Wordings, templates: Wordings) -> tuple[dict[str, int], list[tuple[str, list[int]]], list[tuple[str, Automaton]]]:
    """The words' numbers, phrases and automata; wordings without words are left out."""
    number = {w: k for k, w in enumerate(sorted({w for _, t in (*phrases, *templates) for w in words_of(MARK.sub(" ", t))}))}
    automata = [(label, Automaton(t, number)) for label, t in templates]
    return number, [(label, [number[w] for w in words_of(p)]) for label, p in phrases if words_of(p)], [(label, a) for label, a in automata if a.mandatory]


def phrase_starts(codes: np.ndarray, rows: np.ndarray, phrase: list[int]) -> np.ndarray:
    """Where all words of the phrase follow one another within a row."""
    n, m = len(codes), len(phrase)
    if n < m:
        return np.zeros(0, np.int64)
    fits = rows[: n - m + 1] == rows[m - 1 :]
    for k, w in enumerate(phrase):
        fits &= codes[k : n - m + 1 + k] == w
    return np.flatnonzero(fits)


PLACES = "array<struct<label:string,start:int,end:int>>"
ARROW_PLACES = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: Wordings = OWN_PHRASES, templates: Wordings = OWN_TEMPLATES) -> DataFrame:
    """One row per row of docs: doc_id, n_words, phrases and templates (label,
    first word, word after the last), score.

    phrases, templates: (label, text), see wordings().
    score: 1 with a phrase or an accepted template; else half the greatest
    share of a template's mandatory words that the text holds.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, spelt, automata = compiled(phrases, templates)
        vocabulary = pa.array(list(number), pa.large_string())
        for part in slices(batches, "text"):
            words, offsets = split_words(part.column("text"), NOT_ALNUM)
            of_word, distinct = coded(words)
            known = pc.index_in(distinct, value_set=vocabulary).fill_null(-1).to_numpy(zero_copy_only=False)
            codes = known[of_word] if len(distinct) else np.zeros(0, np.int32)
            rows = row_of(offsets)
            plain: list[list[dict]] = [[] for _ in range(part.num_rows)]
            marked: list[list[dict]] = [[] for _ in range(part.num_rows)]
            for label, phrase in spelt:
                for k in phrase_starts(codes, rows, phrase):
                    start = int(k - offsets[rows[k]])
                    plain[rows[k]].append({"label": label, "start": start, "end": start + len(phrase)})
            used = codes >= 0
            holds = np.zeros((part.num_rows, len(number)), bool)
            holds[rows[used], codes[used]] = True
            score = np.zeros(part.num_rows)
            for label, automaton in automata:
                share = holds[:, sorted(automaton.mandatory)].mean(axis=1)
                score = np.maximum(score, share / 2)
                for r in np.flatnonzero(share == 1):
                    for a, b in automaton.accepted(codes[offsets[r] : offsets[r + 1]].tolist()):
                        marked[r].append({"label": label, "start": a, "end": b})
            score[[bool(p or m) for p, m in zip(plain, marked, strict=True)]] = 1.0
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(np.diff(offsets)), pa.array(plain, ARROW_PLACES), pa.array(marked, ARROW_PLACES), pa.array(score)],
                ["doc_id", "n_words", "phrases", "templates", "score"],
            )

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(run, f"doc_id long, n_words long, phrases {PLACES}, templates {PLACES}, score double")

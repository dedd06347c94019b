"""License scans: templates with optional and replaceable regions, compiled to token automata.

A text holds a license where its words run through the license's template: mandatory wording exactly, optional regions
whole or not at all, replaceable regions by any words up to a bound.
"""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .texts import add_columns

#: Words are runs of anything but these characters, after A-Z are lower-cased: ASCII letters and digits, and all beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same on lower-cased UTF-8 bytes.
_BYTES = re.compile(rb"[0-9a-z\x80-\xff]+")
#: Fixed phrases and their labels; they are templates without regions.
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
#: Templates: "[[" to "]]" is optional and may be nested, "<<n>>" stands for up to n words, "<<m,n>>" for m to n.
TEMPLATES = (
    ("mit", """[[Copyright [[c]] <<0,20>>]] Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
associated documentation files (the <<1,3>>), to deal in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the
Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice
[[(including the next paragraph)]] shall be included in all copies or substantial portions of the Software. [[THE SOFTWARE IS
PROVIDED <<1,3>>, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL <<1,12>> BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE
OR OTHER DEALINGS IN THE SOFTWARE.]]"""),
    ("mit", "licensed under the [[terms of the]] MIT license"),
    ("isc", """[[Copyright [[c]] <<0,20>>]] Permission to use, copy, modify, and/or distribute this software for any purpose with or without
fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. [[THE SOFTWARE IS
PROVIDED <<1,3>> AND <<1,12>> DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS.]]"""),
    ("bsd-2-clause", """[[Copyright [[c]] <<0,20>>]] Redistribution and use in source and binary forms, with or without modification, are permitted
provided that the following conditions are met: [[1]] Redistributions of source code must retain the above copyright notice, this
list of conditions and the following disclaimer. [[2]] Redistributions in binary form must reproduce the above copyright notice, this
list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""),
    ("bsd-3-clause", """Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer
in the documentation and/or other materials provided with the distribution. [[3]] Neither the name of <<1,12>> nor the names of
[[its]] <<0,3>> contributors may be used to endorse or promote products derived from this software without specific prior written
permission."""),
    ("apache-2", """Licensed under the Apache License, Version 2.0 (the <<1,3>>); you may not use this file except in compliance with the License.
You may obtain a copy of the License at <<1,12>> Unless required by applicable law or agreed to in writing, software distributed under
the License is distributed on an <<2,4>> BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."""),
    ("apache-2", "licensed under [[the [[terms of the]]]] Apache [[software]] License [[v [[ersion]]]] 2 [[0]]"),
    ("gpl-3", "[[licensed]] under the [[terms of the]] GNU General Public License[[, version]] 3"),
    ("gpl-3-or-later", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as
published by the Free Software Foundation, either version 3 of the License, or [[(at your option)]] any later version."""),
    ("gpl-2", "[[licensed]] under the [[terms of the]] GNU General Public License[[, version]] 2"),
    ("lgpl-3", "[[licensed]] under the [[terms of the]] GNU Lesser General Public License[[, version]] 3"),
    ("mpl-2", "subject to the terms of the Mozilla Public License, v. 2.0. [[If a copy of the MPL was not distributed with this file, You can obtain one at <<1,8>>]]"),
    ("cc-by-nc", "licensed under [[a]] [[the]] CC BY NC [[4 0]]"),
    ("cc-by-nc", "Creative Commons Attribution NonCommercial [[<<1,2>> International]] [[<<1,3>>]] License"),
    ("cc-by", "Creative Commons Attribution [[<<1,2>> International]] License"),
    ("cc0", "[[released]] under [[the]] CC0 [[1 0]]"),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
    ("zlib", """This software is provided <<1,3>>, without any express or implied warranty. In no event will <<1,12>> be held liable for any damages
arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial
applications, and to alter it and redistribute it freely"""),
)
#: A template's weight of evidence is its mandatory words over themselves and this.
HALF = 4


def words(text: str | None) -> list[bytes]:
    return _BYTES.findall(text.encode("utf-8", "surrogatepass").lower()) if text else []


def parse(markup: str) -> list:
    """A template as a list of words, (least, most) for a replaceable region, and lists for optional ones."""
    tokens = re.findall(rf"\[\[|\]\]|<<(?:\d+,)?\d+>>|{WORD}", markup.lower())
    stack: list[list] = [[]]
    for t in tokens:
        if t == "[[":
            stack.append([])
        elif t == "]]":
            if len(stack) == 1:
                raise ValueError("an optional region ends that did not begin")
            done = stack.pop()
            stack[-1].append(done)
        elif t[:2] == "<<":
            least, _, most = t[2:-2].rpartition(",")
            stack[-1].append((int(least or 0), int(most)))
        else:
            stack[-1].append(t.encode())
    if len(stack) > 1:
        raise ValueError("an optional region does not end")
    return stack[0]


def mandatory(node: list) -> int:
    """Words that every match has."""
    return sum(isinstance(x, bytes) for x in node)


class TokenAutomaton:
    """All templates as one automaton over words.

    A state is a place in a template. ``on[state]`` has the states that a word leads to, ``any_[state]`` the states that
    every word leads to; optional regions are passed over by closing over ``skip``. Replaceable regions of at most n words
    are n states, so a thread needs no counter.
    """

    def __init__(self, templates: list[tuple[str, str]]):
        self.on: list[dict[bytes, int]] = []
        self.any_: list[int | None] = []
        self.skip: list[list[int]] = []
        self.accepts: dict[int, int] = {}
        self.labels, self.weights = [x[0] for x in templates], []
        starts: list[int] = []
        for k, (_, markup) in enumerate(templates):
            tree = parse(markup)
            if not mandatory(tree):
                raise ValueError("a template without a mandatory word matches anywhere")
            self.weights.append(mandatory(tree))
            begin = self._state()
            self.accepts[self._compile(tree, begin)] = k
            starts += sorted(self._closed({begin}))
        self.starts: dict[bytes, list[int]] = {}
        for s in starts:
            if s in self.accepts or self.any_[s] is not None:
                raise ValueError("a template must begin with a word")
            for word in self.on[s]:
                self.starts.setdefault(word, []).append(s)
        self.ends = [self._closed({s}) for s in range(len(self.on))]

    def _state(self) -> int:
        self.on.append({})
        self.any_.append(None)
        self.skip.append([])
        return len(self.on) - 1

    def _compile(self, node: list, at: int) -> int:
        for x in node:
            if isinstance(x, list):
                after = self._compile(x, at_in := self._state())
                out = self._state()
                self.skip[at] += [at_in, out]
                self.skip[after].append(out)
                at = out
            elif isinstance(x, bytes):
                self.on[at][x] = to = self._state()
                at = to
            else:
                out = None
                for i in range(x[1]):
                    if i >= x[0]:
                        out = self._state() if out is None else out
                        self.skip[at].append(out)
                    self.any_[at] = to = self._state()
                    at = to
                if out is not None:
                    self.skip[at].append(out)
                    at = out
        return at

    def _closed(self, states: set[int]) -> set[int]:
        todo, found = list(states), set(states)
        while todo:
            for s in self.skip[todo.pop()]:
                if s not in found:
                    found.add(s)
                    todo.append(s)
        return found

    def scan(self, found: list[bytes]) -> list[tuple[int, int, int]]:
        """All (template, first word, end word, exclusive) that the words run through, for each end the earliest start.

        Threads carry where they began; two that reach one state are one from then on, the earlier. So the work on a word is
        bounded by the automaton's size, and is nothing where no thread is alive and no template begins.
        """
        out, threads = [], {}
        for i, word in enumerate(found):
            begin = self.starts.get(word)
            if not threads and begin is None:
                continue
            moved: dict[int, int] = {}
            for s in begin or ():
                threads.setdefault(s, i)
            for s, since in threads.items():
                for to in (self.on[s].get(word), self.any_[s]):
                    if to is not None:
                        for end in self.ends[to]:
                            if moved.get(end, i + 1) > since:
                                moved[end] = since
            threads = moved
            out += [(self.accepts[s], since, i + 1) for s, since in moved.items() if s in self.accepts]
        return out


@lru_cache(maxsize=2)
def automaton(templates: tuple[tuple[str, str], ...]) -> TokenAutomaton:
    return TokenAutomaton(list(templates))


def find_licenses(text: str | None, templates: tuple[tuple[str, str], ...], n_phrases: int) -> tuple[int, list[tuple[str, int, int, bool]], float]:
    """The number of words, the matches (label, first word, end word, is a phrase) by place, and the score.

    A template's matches that lie inside a longer one of the same template are left out; phrases have all their places.
    The score is the weight of the longest evidence: mandatory words over themselves and ``HALF``; 0 without a match.
    """
    auto, found = automaton(templates), words(text)
    spans = sorted(auto.scan(found), key=lambda m: (m[1], -m[2], m[0]))
    out, reached = [], {}
    for k, start, end in spans:
        if k >= n_phrases and end <= reached.get(k, -1):
            continue
        reached[k] = max(end, reached.get(k, -1))
        out.append((auto.labels[k], start, end, k < n_phrases))
    best = max((auto.weights[k] for k, *_ in spans), default=0)
    return len(found), out, best / (best + HALF)


def scan_licenses(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None, templates: tuple[tuple[str, str], ...] = TEMPLATES, phrases: tuple[tuple[str, str], ...] = PHRASES) -> DataFrame:
    """``docs`` with n_words, matches (label, first_word, end_word, phrase) and license_score, by whole texts.

    One pass in Arrow batches, no shuffle; work is linear in a text's words. Cases: null and empty texts have no words or
    matches and score 0; repeated rows have theirs each; kept columns of these names are replaced; an empty table gives
    no rows.
    """
    every = tuple((label, phrase) for phrase, label in phrases) + tuple(templates)
    new = "n_words long, matches array<struct<label: string, first_word: long, end_word: long, phrase: boolean>>, license_score double"
    shown = ("label", "first_word", "end_word", "phrase")

    def make(texts: list) -> list[tuple]:
        found = (find_licenses(t, every, len(phrases)) for t in texts)
        return [(n, [dict(zip(shown, m, strict=True)) for m in matches], score) for n, matches, score in found]

    return add_columns(docs, text_col, new, make, keep)


def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licenses of all documents."""
    found = scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])
    base = F.filter("matches", lambda m: m["phrase"])
    names = lambda ms: F.array_join(F.array_sort(F.array_distinct(F.transform(ms, lambda m: m["label"]))), ",")
    places = F.transform(base, lambda m: m["first_word"])
    return found.select("doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(places).alias("first_word"), F.array_max(places).alias("last_word"), names(base).alias("base_labels"), names(F.col("matches")).alias("labels"), F.col("license_score").alias("score"))


def _pattern(node: list) -> str:
    """A template as a regular expression over words that each end with a space."""
    one = lambda x: f"(?:{_pattern(x)})?" if isinstance(x, list) else f"{x.decode()} " if isinstance(x, bytes) else f"(?:[^ ]+ ){{{x[0]},{x[1]}}}"
    return "".join(map(one, node))


def _op11_sql() -> str:
    trees = [(label, parse(markup)) for label, markup in TEMPLATES]
    hits = ", ".join(f"CASE WHEN regexp_matches(s, ' {_pattern(tree)}') THEN {{'label': '{label}', 'n': {mandatory(tree)}}} END" for label, tree in trees)
    places = ", ".join(f"list_transform(list_filter(range(len(w)), lambda i: w[i + 1:i + {len(p.split())}] = {p.split()}), lambda i: {{'label': '{label}', 'at': i, 'n': {len(p.split())}}})" for p, label in PHRASES)
    labels = lambda x: f"array_to_string(list_sort(list_distinct(list_transform({x}, lambda m: m.label))), ',')"
    return f"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS w FROM documents),
 b AS (SELECT doc_id, w, ' ' || array_to_string(w, ' ') || ' ' AS s, flatten([{places}]) AS p FROM d),
 t AS (SELECT doc_id, w, p, list_concat(list_transform(p, lambda m: {{'label': m.label, 'n': m.n}}), list_filter([{hits}], lambda m: m IS NOT NULL)) AS hits FROM b)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(p) AS BIGINT) AS n_base, list_min(list_transform(p, lambda m: m.at)) AS first_word, list_max(list_transform(p, lambda m: m.at)) AS last_word,
       {labels('p')} AS base_labels, {labels('hits')} AS labels, CASE WHEN len(hits) = 0 THEN 0.0::DOUBLE ELSE list_max(list_transform(hits, lambda x: x.n)) / (list_max(list_transform(hits, lambda x: x.n)) + {float(HALF)}::DOUBLE) END AS score
FROM t
"""


OP11_SQL = _op11_sql()

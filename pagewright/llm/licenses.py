"""Licence scan by a generalised suffix automaton.

The automaton holds the tokens of all licence templates. A file's tokens are streamed
through it; the matching statistics (the longest template substring that ends at
each token) give maximal matches, which are chained per template into covered spans. Licences of one family share most
of their words: a span needs one of the phrases that tell its licence from the others, and of overlapping spans the one of most words stays.
The automaton is a fixed value of the code's templates, built once per Python worker.
"""

from __future__ import annotations

import re
from bisect import bisect
from collections.abc import Iterator, Mapping
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from pagewright.llm.common import text_batches

# Short phrases, each a licence name; every place where one stands counts.
PHRASES: dict[str, str] = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Notices of widespread public licences, by label.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "apache": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the "
        "License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or "
        "agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR "
        "CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and "
        "limitations under the License.",
        "Licensed under the Apache License, Version 2.0.",
    ),
    "gpl": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program "
        "is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
        "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have "
        "received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/.",
        "This program is licensed under the GNU General Public License, version 3.",
    ),
    "mit": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        "(the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, "
        "merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is "
        "furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be "
        "included in all copies or substantial portions of the Software.",
        "Released under the MIT License.",
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
        "conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the "
        "following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the "
        "following disclaimer in the documentation and/or other materials provided with the distribution.",
    ),
    "cc-by": (
        "This work is licensed under a Creative Commons Attribution 4.0 International License. To view a copy of this license, visit "
        "http://creativecommons.org/licenses/by/4.0/",
        "Licensed under CC BY 4.0.",
    ),
    "cc-by-nc": (
        "This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 International License. To view a copy of this "
        "license, visit http://creativecommons.org/licenses/by-nc/4.0/",
        "Licensed under CC BY-NC 4.0.",
    ),
    "agpl": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License "
        "as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This "
        "program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
        "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details. You should "
        "have received a copy of the GNU Affero General Public License along with this program. If not, see https://www.gnu.org/licenses/.",
        "This program is licensed under the GNU Affero General Public License, version 3.",
    ),
    "lgpl": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License "
        "as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This "
        "library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
        "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details. You should have "
        "received a copy of the GNU Lesser General Public License along with this library; if not, write to the Free Software Foundation.",
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
    ),
    "cc-by-sa": (
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License. To view a copy of this license, "
        "visit http://creativecommons.org/licenses/by-sa/4.0/",
        "Licensed under CC BY-SA 4.0.",
    ),
    "cc-by-nd": (
        "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License. To view a copy of this "
        "license, visit http://creativecommons.org/licenses/by-nd/4.0/",
        "Licensed under CC BY-ND 4.0.",
    ),
    "cc-by-nc-sa": (
        "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License. To view a copy of "
        "this license, visit http://creativecommons.org/licenses/by-nc-sa/4.0/",
        "Licensed under CC BY-NC-SA 4.0.",
    ),
    "cc-by-nc-nd": (
        "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License. To view a copy "
        "of this license, visit http://creativecommons.org/licenses/by-nc-nd/4.0/",
        "Licensed under CC BY-NC-ND 4.0.",
    ),
    "mit-0": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        "(the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, "
        "merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is "
        "furnished to do so. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND",
    ),
    "0bsd": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE "
        "SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE",
    ),
    "mpl": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed "
        "with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided "
        "that the above copyright notice and this permission notice appear in all copies.",
    ),
}

# Phrases of which a span must hold one, for licences whose families share most of their words.
TELLING: dict[str, tuple[str, ...]] = {
    "gpl": ("gnu general public license",),
    "agpl": ("affero general public license",),
    "lgpl": ("lesser general public license",),
    "mit": ("subject to the following conditions", "mit license"),
    "mit-0": ("furnished to do so the software is",),
    "isc": ("provided that the above copyright notice",),
    "0bsd": ("is hereby granted the software is",),
    **{
        label: tuple(f"{name} {end}" for name in names for end in ("1", "2", "3", "4", "international", "unported", "license"))
        for label, names in {
            "cc-by": ("attribution", "cc by"),
            "cc-by-sa": ("attribution sharealike", "by sa"),
            "cc-by-nd": ("attribution noderivatives", "attribution noderivs", "by nd"),
            "cc-by-nc": ("attribution noncommercial", "by nc"),
            "cc-by-nc-sa": ("attribution noncommercial sharealike", "by nc sa"),
            "cc-by-nc-nd": ("attribution noncommercial noderivatives", "attribution noncommercial noderivs", "by nc nd"),
        }.items()
    },
}

#: Bytes of a word: digits, a-z after lower-casing, and all of UTF-8 outside ASCII.
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def words_of(text: str | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lower-cased, as UTF-8."""
    return _WORD.findall(text.encode("utf-8", "surrogatepass").lower()) if text else []  # bytes.lower() changes A-Z only


class SuffixAutomaton:
    """A generalised suffix automaton over word lists.

    Each template is inserted from the initial state, so the automaton accepts exactly
    the substrings of single templates. A state has the length of its longest string, a
    suffix link and, for each template that holds its strings, the positions where they end.
    """

    def __init__(self, templates: list[list[bytes]]):
        self.templates = templates
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[dict[int, list[int]]] = [{}]  # template -> end positions, made complete below
        for number, words in enumerate(templates):
            last = 0
            for position, word in enumerate(words):
                last = self._extend(last, word)
                self.ends[last].setdefault(number, []).append(position)
        for state in sorted(range(1, len(self.next)), key=self.length.__getitem__, reverse=True):
            if (up := self.link[state]) > 0:
                for number, found in self.ends[state].items():
                    self.ends[up].setdefault(number, []).extend(found)
        for held in self.ends:
            for number in held:
                held[number] = sorted(set(held[number]))

    def _new(self, length: int, edges: dict[bytes, int], link: int) -> int:
        self.next.append(edges)
        self.length.append(length)
        self.link.append(link)
        self.ends.append({})
        return len(self.next) - 1

    def _split(self, state: int, word: bytes, target: int) -> int:
        """A copy of ``target`` for strings no longer than those that reach it through ``state``."""
        copy = self._new(self.length[state] + 1, dict(self.next[target]), self.link[target])
        self.link[target] = copy
        while state >= 0 and self.next[state].get(word) == target:
            self.next[state][word] = copy
            state = self.link[state]
        return copy

    def _extend(self, last: int, word: bytes) -> int:
        known = self.next[last].get(word)
        if known is not None:  # the string is a substring of an earlier template
            return known if self.length[known] == self.length[last] + 1 else self._split(last, word, known)
        state = self._new(self.length[last] + 1, {}, 0)
        up = last
        while up >= 0 and word not in self.next[up]:
            self.next[up][word] = state
            up = self.link[up]
        if up >= 0:
            target = self.next[up][word]
            self.link[state] = target if self.length[target] == self.length[up] + 1 else self._split(up, word, target)
        return state

    def matches(self, words: list[bytes], least: int) -> list[tuple[int, int, int]]:
        """Maximal matches of at least ``least`` words: (end in the file, length, state), by end.

        A match is maximal if the next word does not prolong it.
        """
        edges, link, length = self.next, self.link, self.length
        first = edges[0]
        out = []
        state = matched = 0
        for at, word in enumerate(words):
            if not state:
                if word in first:
                    state, matched = first[word], 1
                continue
            onward = edges[state].get(word)
            if onward is not None:
                state, matched = onward, matched + 1
                continue
            if matched >= least:
                out.append((at - 1, matched, state))
            while state and word not in edges[state]:
                state = link[state]
                matched = length[state]
            if word in edges[state]:
                state, matched = edges[state][word], matched + 1
            else:
                state = matched = 0
        if matched >= least:
            out.append((len(words) - 1, matched, state))
        return out


def chain(matches: list[tuple[int, int, int]], automaton: SuffixAutomaton, slack: int) -> dict[int, list[tuple[int, int, int]]]:
    """Per template its chains of matches that do not overlap, best first: (words covered, first word, last word + 1) in the file.

    A chain follows both file and template order; between two of its matches at most
    ``slack`` words may be skipped on either side. Overlaps count once.
    """
    best: dict[int, dict[int, tuple[int, int]]] = {}  # template -> start -> (covered, end)
    open_chains: dict[int, list[tuple[int, int, int, int]]] = {}  # template -> (file end, template end, covered, start)
    for end, length, state in matches:
        for number, places in automaton.ends[state].items():
            chains = [c for c in open_chains.get(number, ()) if end - length + 1 - c[0] - 1 <= slack]
            grown = []
            for place in places:
                pick = (end, place, length, end - length + 1)
                for file_end, place_end, covered, start in chains:
                    if end > file_end and place > place_end and place - length + 1 - place_end - 1 <= slack:
                        more = min(length, end - file_end, place - place_end)
                        if covered + more > pick[2]:
                            pick = (end, place, covered + more, start)
                grown.append(pick)
            open_chains[number] = chains + grown  # those too far back have been left out above
            for _, _, covered, start in grown:
                starts = best.setdefault(number, {})
                if covered > starts.get(start, (0, 0))[0]:
                    starts[start] = (covered, end + 1)
    return {number: _apart(starts) for number, starts in best.items()}


def _apart(starts: dict[int, tuple[int, int]]) -> list[tuple[int, int, int]]:
    """Chains, most words first and of equal ones the one that ends first, without those that overlap a better one."""
    taken: list[tuple[int, int]] = []  # by place
    out = []
    for start, (covered, end) in sorted(starts.items(), key=lambda x: (-x[1][0], x[1][1], x[0])):
        at = bisect(taken, (start, end))
        if (at == 0 or taken[at - 1][1] <= start) and (at == len(taken) or end <= taken[at][0]):
            taken.insert(at, (start, end))
            out.append((covered, start, end))
    return out


@lru_cache(maxsize=4)
def _built(templates: tuple[tuple[str, tuple[str, ...]], ...]) -> tuple[SuffixAutomaton, list[str]]:
    texts = [(label, words_of(text)) for label, several in templates for text in several]
    return SuffixAutomaton([words for _, words in texts]), [label for label, _ in texts]


def scan_text(
    text: str | None,
    templates: tuple[tuple[str, tuple[str, ...]], ...],
    phrases: tuple[tuple[str, str], ...],
    least: int,
    coverage: float,
    slack: int,
) -> tuple[int, list[int], set[str], set[str], float, list[tuple[str, int, int, float]]]:
    """n_words, starts of all phrase places, base labels, all labels, score and spans of one text."""
    automaton, labels = _built(templates)
    words = words_of(text)
    starts: list[int] = []
    base: set[str] = set()
    joined: dict[bytes, list[tuple[list[bytes], str]]] = {}
    for phrase, label in phrases:
        wanted = phrase.encode().split(b" ")
        joined.setdefault(wanted[0], []).append((wanted, label))
    for first, several in joined.items():
        at = -1
        for _ in range(words.count(first)):
            at = words.index(first, at + 1)
            for wanted, label in several:
                if words[at : at + len(wanted)] == wanted:
                    starts.append(at)
                    base.add(label)
    score = 1.0 if base else 0.0
    likely = []
    for number, chains in chain(automaton.matches(words, least), automaton, slack).items():
        for covered, start, end in chains:
            share = covered / len(automaton.templates[number])
            score = max(score, share)
            if share >= coverage and _tells(words, start, end, labels[number]):
                likely.append((covered, share, labels[number], start, end))
    spans = _winners(likely)
    return len(words), starts, base, base | {s[0] for s in spans}, score, spans


def _tells(words: list[bytes], start: int, end: int, label: str) -> bool:
    """Whether the span, or its edge with the next three words, holds a phrase that tells the licence from others of its family."""
    phrases = TELLING.get(label)
    text = b" %s " % b" ".join(words[start : end + 3])
    return phrases is None or any(b" %s " % p.encode() in text for p in phrases)


def _winners(likely: list[tuple[int, float, str, int, int]]) -> list[tuple[str, int, int, float]]:
    """Of overlapping (covered, share, label, start, end) the one of most words, then of the larger share; as (label, start, end, share) by place."""
    taken: list[tuple[int, int]] = []  # by place
    out = []
    for _, share, label, start, end in sorted(likely, key=lambda x: (-x[0], -x[1], x[3], x[2])):
        at = bisect(taken, (start, end))
        if (at == 0 or taken[at - 1][1] <= start) and (at == len(taken) or end <= taken[at][0]):
            taken.insert(at, (start, end))
            out.append((label, start, end, share))
    return sorted(out, key=lambda x: x[1:3])


def scan_licenses(
    documents: DataFrame,
    templates: Mapping[str, tuple[str, ...]] = TEMPLATES,
    phrases: Mapping[str, str] = PHRASES,
    least: int = 4,
    coverage: float = 0.6,
    slack: int = 4,
) -> DataFrame:
    """Every document's licence places, labels, score and covered spans.

    Columns: doc_id; n_words; n_base, first_word and last_word (number, smallest and
    largest start of all phrase places; null without one); base_labels; labels (also those
    templates of which chained matches of at least ``least`` words cover ``coverage`` and hold a telling phrase, if no
    longer span overlaps); score (1 with a phrase, else the best template's coverage); spans (label, first word, end, coverage), one
    for each copy, by place.

    Edge cases: a null or empty text has no words, no label and score 0; null ids pass
    through; repeated rows are scanned one by one; other columns are ignored; an empty table
    gives no row. Whole texts are read; memory is bound by the longest text.
    """
    fixed_templates = tuple((label, tuple(texts)) for label, texts in templates.items())
    fixed_phrases = tuple(phrases.items())
    span = pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("coverage", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches):
            rows = [scan_text(t, fixed_templates, fixed_phrases, least, coverage, slack) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([r[0] for r in rows], pa.int64()),
                    pa.array([len(r[1]) for r in rows], pa.int64()),
                    pa.array([min(r[1], default=None) for r in rows], pa.int64()),
                    pa.array([max(r[1], default=None) for r in rows], pa.int64()),
                    pa.array([",".join(sorted(r[2])) for r in rows], pa.string()),
                    pa.array([",".join(sorted(r[3])) for r in rows], pa.string()),
                    pa.array([r[4] for r in rows], pa.float64()),
                    pa.array([[dict(zip(("label", "start", "end", "coverage"), s)) for s in r[5]] for r in rows], pa.list_(span)),
                ],
                ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"],
            )

    rows = documents.select("doc_id", "text")
    return rows.mapInArrow(
        run,
        f"doc_id {dict(rows.dtypes)['doc_id']}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
        "score double, spans array<struct<label:string,start:long,end:long,coverage:double>>",
    )

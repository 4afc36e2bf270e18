"""License scans: template markup compiled to token automata."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from merscope.llm.batches import bound_batches

# The base phrases and their labels.
BASE_PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Wording that two or more templates share.
MIT_OPENING = (
    "[copyright <1:12>] permission is hereby granted free of charge to any person obtaining a copy of"
    " <1:8> and associated documentation files [the software] to deal in the software without restriction"
    " including without limitation the rights to use copy modify merge publish distribute sublicense and or sell"
    " copies of the software"
)
BSD_OPENING = (
    "redistribution and use in source and binary forms with or without modification are permitted"
    " provided that the following conditions are met [1] redistributions of source code must retain the above"
    " copyright notice this list of conditions and the following disclaimer"
)
BSD_BINARY = (
    " [2] redistributions in binary form must reproduce the above copyright notice this list of conditions and the"
    " following disclaimer in the documentation and or other materials provided with the distribution"
)
BSD_WARRANTY = (
    " this software is provided by <1:20> as is and any express or implied warranties including but not limited to"
    " the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall"
    " <1:20> be liable for any direct indirect incidental special exemplary or consequential damages including but not"
    " limited to procurement of substitute goods or services loss of use data or profits or business interruption"
    " however caused and on any theory of liability whether in contract strict liability or tort including negligence"
    " or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"
)
GPL_HEADER = (
    " is free software you can redistribute it and or modify it under the terms of the gnu general public license as"
    " published by the free software foundation either version {} of the license or at your option any later version"
    " <1:12> is distributed in the hope that it will be useful but without any warranty without even the implied"
    " warranty of merchantability or fitness for a particular purpose see the gnu general public license for more"
    " details"
)

# License wording. Words in [ ] may be missing; <a:b> stands for
# a to b words of any kind; all other wording has to match exactly. Labels that
# end in -license, -clause or -header stand for the whole wording of a license
# or of its standard notice, those in -opening for its beginning whatever
# follows, the others for a notice of one line.
TEMPLATES = {
    "apache-2.0": "licensed under the apache license version 2 0 [the license]",
    "apache-2.0-header": "licensed under the apache license version 2 0 the license you may not use this file except in"
    " compliance with the license you may obtain a copy of the license at [http] [https] [www] apache org licenses"
    " license 2 0 [txt] [html] unless required by applicable law or agreed to in writing software distributed under"
    " the license is distributed on an as is basis without warranties or conditions of any kind either express or"
    " implied see the license for the specific language governing permissions and limitations under the license",
    "cc-by-4.0": "licensed under [a] [creative commons] [attribution] cc by 4 0 [international] [license]",
    "cc-by-nc-4.0": "licensed under [a] [creative commons] cc by nc 4 0 [international] [license]",
    "cc-by-sa-4.0": "licensed under [a] [creative commons] cc by sa 4 0 [international] [license]",
    "gpl-2.0": "licensed under the [terms of the] gnu general public license version 2 [only] [or later]",
    "gpl-2.0-header": "program" + GPL_HEADER.format(2),
    "gpl-3.0": "licensed under the [terms of the] gnu general public license version 3 [only] [or later]",
    "gpl-3.0-header": "program" + GPL_HEADER.format(3),
    "mit-notice": "released under the [terms of the] mit license",
    "mit-text-opening": MIT_OPENING,
    "mit-license": MIT_OPENING + " and to permit persons to whom the software is furnished to do so subject to the"
    " following conditions the above copyright notice and this permission notice [including the next paragraph] shall"
    " be included in all copies or substantial portions of the software the software is provided as is without"
    " warranty of any kind express or implied including but not limited to the warranties of merchantability fitness"
    " for a particular purpose and noninfringement in no event shall <1:20> be liable for any claim damages or other"
    " liability whether in an action of contract tort or otherwise arising from out of or in connection with the"
    " software or the use or other dealings in the software",
    "bsd-text-opening": BSD_OPENING,
    "bsd-2-clause": BSD_OPENING + BSD_BINARY + BSD_WARRANTY,
    "bsd-3-clause": BSD_OPENING + BSD_BINARY + " [3] neither the name of <1:20> nor the names of <1:8> contributors may"
    " be used to endorse or promote products derived from this software without specific prior written permission"
    + BSD_WARRANTY,
}

MARKUP = re.compile(r"\[|\]|<(\d+):(\d+)>|[^\s\[\]<>]+")
WORDS = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
GAP = rb"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
PART_OF_WORD = np.array([not re.fullmatch(GAP, bytes([b])) for b in range(256)])


@dataclass
class Automaton:
    """States with word steps, free steps (any word) and empty steps."""

    label: str
    by_word: list[dict[bytes, int]] = field(default_factory=lambda: [{}])
    by_any: list[int | None] = field(default_factory=lambda: [None])
    skips: list[list[int]] = field(default_factory=lambda: [[]])
    must: list[bytes] = field(default_factory=list)

    def grow(self) -> int:
        self.by_word.append({})
        self.by_any.append(None)
        self.skips.append([])
        return len(self.by_word) - 1

    @property
    def final(self) -> int:
        return len(self.by_word) - 1

    def closure(self, states: set[int]) -> set[int]:
        todo, seen = list(states), set(states)
        while todo:
            for to in self.skips[todo.pop()]:
                if to not in seen:
                    seen.add(to)
                    todo.append(to)
        return seen

    def match(self, words: list[bytes], start: int) -> int | None:
        """End of the longest match that begins at ``start``."""
        states, end = self.closure({0}), None
        for at in range(start, len(words) + 1):
            if self.final in states:
                end = at
            if at == len(words):
                break
            after = {to for s in states if (to := self.by_word[s].get(words[at])) is not None}
            after |= {to for s in states if (to := self.by_any[s]) is not None}
            if not after:
                break
            states = self.closure(after)
        return end

    def first_words(self) -> set[bytes]:
        return {w for s in self.closure({0}) for w in self.by_word[s]}


def compile_template(label: str, markup: str) -> Automaton:
    """The automaton of a template.

    An optional region is an empty step around its states, a replaceable one
    a chain of free steps, those beyond the least number with empty steps
    around them. A template must not begin with a replaceable region.
    """
    made, opened = Automaton(label), []
    for token in MARKUP.finditer(markup):
        last = made.final
        if token[0] == "[":
            opened.append(last)
        elif token[0] == "]":
            made.skips[opened.pop()].append(last)
        elif token[1]:
            least, most = int(token[1]), int(token[2])
            for n in range(most):
                here, to = made.final, made.grow()
                made.by_any[here] = to
                if n >= least:
                    made.skips[here].append(to)
        else:
            word = token[0].encode()
            made.by_word[last][word] = made.grow()
            if not opened:
                made.must.append(word)
    return made


class Scanner:
    """Base phrases and templates over whole texts."""

    def __init__(self, templates: dict[str, str]) -> None:
        self.automata = [compile_template(label, markup) for label, markup in templates.items()]
        self.keys = [max(a.must, key=len) for a in self.automata]
        self.starts = [a.first_words() for a in self.automata]
        edge = rb"[0-9A-Za-z\x80-\xff]"
        self.phrases = [
            (label, phrase.encode().split(), re.compile(rb"(?<!%b)%b(?!%b)" % (edge, GAP.join(phrase.encode().split()), edge)))
            for phrase, label in BASE_PHRASES.items()
        ]

    def scan(self, text: str | None) -> tuple:
        """``n_words, n_base, first, last, base labels, labels, score`` of one text."""
        raw = (text or "").encode("utf-8", "replace").lower()
        inside = PART_OF_WORD[np.frombuffer(raw, np.uint8)]
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        n_words = int(np.count_nonzero(begins))
        base = []
        for label, words, pattern in self.phrases:
            if all(w in raw for w in words):
                base += [(m.start(), label) for m in pattern.finditer(raw)]
        tokens, offsets, spans = None, None, []
        for automaton, key, starts in zip(self.automata, self.keys, self.starts, strict=True):
            if key in raw:
                tokens = WORDS.findall(raw) if tokens is None else tokens
                for at, word in enumerate(tokens):
                    if word in starts and (end := automaton.match(tokens, at)) is not None:
                        spans.append((at, end, automaton.label))
        offsets = np.flatnonzero(begins) if base else None
        places = [int(np.searchsorted(offsets, at)) for at, _ in base]
        base_labels = {label for _, label in base}
        labels = base_labels | {label for _, _, label in spans}
        explained = count_inside(places, spans)
        score = 0.0 if not labels else 0.5 + 0.5 * (explained / len(places) if places else 1.0)
        return (
            n_words,
            len(places),
            min(places, default=None),
            max(places, default=None),
            ",".join(sorted(base_labels)),
            ",".join(sorted(labels)),
            score,
        )


def count_inside(places: list[int], spans: list[tuple[int, int, str]]) -> int:
    """How many places lie in some span, by one sweep over both in order."""
    inside, reach, spans = 0, -1, sorted(spans)
    at = 0
    for place in sorted(places):
        while at < len(spans) and spans[at][0] <= place:
            reach = max(reach, spans[at][1])
            at += 1
        inside += place < reach
    return inside


FIELDS = {
    "n_words": "bigint",
    "n_base": "bigint",
    "first_word": "bigint",
    "last_word": "bigint",
    "base_labels": "string",
    "labels": "string",
    "score": "double",
}


def scan_text(text: Column, templates: dict[str, str]) -> Column:
    @F.pandas_udf("struct<" + ",".join(f"{k}:{v}" for k, v in FIELDS.items()) + ">")
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scanner = Scanner(templates)
        for texts in batches:
            frame = pd.DataFrame([scanner.scan(t) for t in texts], columns=list(FIELDS))
            yield frame.astype({"first_word": "Int64", "last_word": "Int64"})

    return scan(text)


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """One row per row of ``docs``: base phrases and accepted templates.

    A template is accepted where its automaton takes a run of words: all
    mandatory wording exactly, optional regions or nothing, replaceable ones
    by any words. An opening or a notice of one line says nothing of what
    follows it. ``score`` is 0 without labels; else from 0.5, when no base
    phrase is part of an accepted run, to 1, when all are. Null text is empty:
    no words, no labels. Repeated rows give repeated rows, an empty table
    none; other columns are not read. Nothing is shuffled.
    """
    bound_batches(docs.sparkSession)
    found = scan_text(F.col("text"), TEMPLATES if templates is None else templates)
    return docs.select("doc_id", found.alias("found")).select("doc_id", "found.*")

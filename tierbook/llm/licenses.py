"""License texts by template markup.

A template is license wording with two kinds of markup: ``<<beginOptional>> ... <<endOptional>>`` may be left out, and
``<<var;words=N>>`` stands for up to N words of any kind.  Each template is compiled into an automaton over words; a document
holds the license if some run of its words is accepted, which needs all mandatory words exactly and in order.  Beside the
templates, base phrases are counted wherever their words stand in a row.

A document is put through an automaton only if it holds the template's longest mandatory word; without it no run can be
accepted.  Words are runs of digits, ASCII letters (A-Z lower-cased) and characters beyond ASCII.  Null text is empty; empty
texts have no words and no labels.  Rows without doc_id and repeated rows are reported like others; other columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierbook.llm.common import WORD, by_batch, lowered

#: Base phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: License wording with markup, by label; whole licenses to the end of their disclaimers, and notices that refer to one.
TEMPLATES = {
    "apache-2.0": "licensed under the apache license <<beginOptional>>version<<endOptional>> 2.0 <<beginOptional>>the license<<endOptional>>",
    "apache-2.0-header": """licensed under the apache license version 2.0 the license you may not use this file except in compliance with the license
        you may obtain a copy of the license at <<beginOptional>>http<<endOptional>> <<beginOptional>>https<<endOptional>> www.apache.org/licenses/LICENSE-2.0
        <<beginOptional>>.html<<endOptional>> unless required by applicable law or agreed to in writing software distributed under the license is
        distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific
        language governing permissions and limitations under the license""",
    "bsd-2-clause": """redistribution and use in source and binary forms with or without modification are permitted provided that the
        following conditions are met <<beginOptional>>1<<endOptional>> redistributions of source code must retain the above
        copyright notice this list of conditions and the following disclaimer <<beginOptional>>2<<endOptional>> redistributions
        in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the
        documentation and/or other materials provided with the distribution this software is provided by <<var;words=15>> as is and any express
        or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are
        disclaimed in no event shall <<var;words=15>> be liable for any direct indirect incidental special exemplary or consequential damages
        including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however
        caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way
        out of the use of this software even if advised of the possibility of such damage""",
    "bsd-3-clause": """redistribution and use in source and binary forms with or without modification are permitted provided that the
        following conditions are met <<beginOptional>>1<<endOptional>> redistributions of source code must retain the above
        copyright notice this list of conditions and the following disclaimer <<beginOptional>>2<<endOptional>> redistributions
        in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the
        documentation and/or other materials provided with the distribution <<beginOptional>>3<<endOptional>> neither the name of
        <<var;words=15>> nor the names of its contributors may be used to endorse or promote products derived from this software without
        specific prior written permission this software is provided by <<var;words=15>> as is and any express
        or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are
        disclaimed in no event shall <<var;words=15>> be liable for any direct indirect incidental special exemplary or consequential damages
        including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however
        caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way
        out of the use of this software even if advised of the possibility of such damage""",
    "cc-by-4.0": """<<beginOptional>>this work is<<endOptional>> licensed under <<beginOptional>>a<<endOptional>> creative commons attribution
        4.0 <<beginOptional>>international<<endOptional>> license""",
    "cc-by-nc-4.0": "licensed under <<beginOptional>>a<<endOptional>> cc by nc 4.0 <<beginOptional>>license<<endOptional>>",
    "gpl-3.0": """licensed under the <<beginOptional>>terms of the<<endOptional>> gnu general public license <<beginOptional>>as published by
        the free software foundation<<endOptional>> <<beginOptional>>either<<endOptional>> version 3""",
    "gpl-header": """<<var;words=6>> is free software you can redistribute it and or modify it under the terms of the gnu general public license as
        published by the free software foundation either version <<beginOptional>>2<<endOptional>> <<beginOptional>>3<<endOptional>> of the license
        or <<beginOptional>>at your option<<endOptional>> any later version <<var;words=6>> is distributed in the hope that it will be useful but
        without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public
        license for more details""",
    "isc": """permission to use copy modify and <<beginOptional>>or<<endOptional>> distribute this software for any purpose with or without
        fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as
        is and <<var;words=10>> disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in
        no event shall <<var;words=10>> be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss
        of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or
        performance of this software""",
    "lgpl-header": """<<var;words=6>> is free software you can redistribute it and or modify it under the terms of the gnu <<beginOptional>>lesser
        <<endOptional>> <<beginOptional>>library<<endOptional>> general public license as published by the free software foundation either version
        <<beginOptional>>2.1<<endOptional>> <<beginOptional>>3<<endOptional>> of the license or <<beginOptional>>at your option<<endOptional>> any later
        version""",
    "mit": """permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation
        files the software to deal in the software without restriction including without limitation the rights to use copy
        modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the
        software is furnished to do so subject to the following conditions <<beginOptional>><<var;words=60>><<endOptional>> the above
        copyright notice and this permission notice <<beginOptional>>including the next paragraph<<endOptional>> shall be included in
        all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied
        including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall
        <<var;words=12>> be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of
        or in connection with the software or the use or other dealings in the software""",
    "mit-notice": "<<beginOptional>>released<<endOptional>> under the mit license",
    "mpl-2.0-header": """this source code form is subject to the terms of the mozilla public license v 2.0 if a copy of the mpl was not distributed with
        this file you can obtain one at <<beginOptional>>http<<endOptional>> <<beginOptional>>https<<endOptional>> <<beginOptional>>www<<endOptional>> mozilla.org/MPL/2.0""",
    "reserved-notice": "copyright <<beginOptional>>c<<endOptional>> <<var;words=12>> all rights reserved",
}

#: Worth of what was found: a whole template, or only a base phrase.
TEMPLATE_SCORE = 1.0
PHRASE_SCORE = 0.5
SCHEMA = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
)


@dataclass(frozen=True)
class Automaton:
    """States 0 .. accept; ``words`` are moves on one word, ``free`` moves on any word, ``skips`` moves on none."""

    words: tuple[tuple[bytes | None, int], ...]  # the word each state needs (None: none) and the state it leads to
    free: frozenset[int]  # states that go on to the next state with any word
    skips: tuple[tuple[int, ...], ...]  # states reached from each state without a word
    accept: int
    rarest: bytes

    def closed(self, states: set[int]) -> set[int]:
        out, todo = set(states), list(states)
        while todo:
            for s in self.skips[todo.pop()]:
                if s not in out:
                    out.add(s)
                    todo.append(s)
        return out

    def starts(self) -> set[bytes]:
        return {w for s in self.closed({0}) if (w := self.words[s][0]) is not None}

    def accepts_at(self, words: list[bytes], place: int) -> bool:
        states = self.closed({0})
        while self.accept not in states:
            if place == len(words) or not states:
                return False
            word, place = words[place], place + 1
            states = self.closed({self.words[s][1] for s in states if self.words[s][0] == word} | {s + 1 for s in states if s in self.free})
        return True

    def found_in(self, words: list[bytes]) -> bool:
        first = self.starts()
        if any(s in self.free for s in self.closed({0})):
            return any(self.accepts_at(words, k) for k in range(len(words)))
        return any(self.accepts_at(words, k) for k, w in enumerate(words) if w in first)


MARK = re.compile(r"<<(beginOptional|endOptional|var;words=([0-9]+))>>")


def compiled(template: str) -> Automaton:
    words: list[tuple[bytes | None, int]] = []
    free: set[int] = set()
    skips: dict[int, set[int]] = {}
    opened: list[int] = []
    mandatory: list[bytes] = []

    def literal(text: str) -> None:
        for w in WORD.findall(lowered(text)):
            if not opened:
                mandatory.append(w)
            words.append((w, len(words) + 1))

    at = 0
    for m in MARK.finditer(template):
        literal(template[at : m.start()])
        at = m.end()
        if m[1] == "beginOptional":
            opened.append(len(words))
        elif m[1] == "endOptional":
            if not opened:
                raise ValueError("an optional region ends that never began")
            skips.setdefault(opened.pop(), set()).add(len(words))
        else:
            end = len(words) + int(m[2])
            for s in range(len(words), end):
                words.append((None, s + 1))
                free.add(s)
                skips.setdefault(s, set()).add(end)
    literal(template[at:])
    if opened:
        raise ValueError("an optional region does not end")
    if not mandatory:
        raise ValueError("a template needs a mandatory word")
    accept = len(words)
    words.append((None, accept))
    return Automaton(tuple(words), frozenset(free), tuple(tuple(sorted(skips.get(s, ()))) for s in range(accept + 1)), accept, max(mandatory, key=lambda w: (len(w), w)))


@cache
def default_automata() -> dict[str, Automaton]:
    return {label: compiled(text) for label, text in TEMPLATES.items()}


def places(words: list[bytes], phrase: list[bytes]) -> list[int]:
    out, at = [], -1
    while True:
        try:
            at = words.index(phrase[0], at + 1)
        except ValueError:
            return out
        if words[at : at + len(phrase)] == phrase:
            out.append(at)


IS_WORD = np.zeros(256, bool)
IS_WORD[[b for b in range(256) if WORD.fullmatch(bytes([b]))]] = True


def word_count(raw: bytes) -> int:
    inside = IS_WORD[np.frombuffer(raw, np.uint8)]
    return int(np.count_nonzero(inside[1:] & ~inside[:-1])) + int(len(raw) > 0 and inside[0])


def scan(text: str | None, phrases: dict[str, str], automata: dict[str, Automaton]) -> tuple:
    """(n_words, n_base, first_word, last_word, base_labels, labels, score) of a text."""
    raw = lowered(text)
    wanted = [(p, [w.encode() for w in p.split()]) for p in phrases]
    wanted = [(p, ws) for p, ws in wanted if all(w in raw for w in ws)]
    tried = [(label, a) for label, a in automata.items() if a.rarest in raw]
    if not wanted and not tried:
        return word_count(raw), 0, None, None, "", "", 0.0
    words = WORD.findall(raw)
    base, found = set(), []
    for p, ws in wanted:
        if at := places(words, ws):
            base.add(phrases[p])
            found += at
    whole = {label for label, a in tried if a.found_in(words)}
    score = TEMPLATE_SCORE if whole else PHRASE_SCORE if base else 0.0
    return (
        len(words), len(found), min(found, default=None), max(found, default=None),
        ",".join(sorted(base)), ",".join(sorted(base | whole)), score,
    )


def labelled(docs: DataFrame, phrases: dict[str, str] = PHRASES, templates: dict[str, str] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every document."""
    automata = default_automata() if templates is TEMPLATES else {label: compiled(t) for label, t in templates.items()}
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    kinds = [{"long": pa.int64(), "string": pa.string(), "double": pa.float64()}[x.split()[1]] for x in SCHEMA.split(", ")]

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        found = [scan(t, phrases, automata) for t in batch.column(1).to_pylist()]
        if not found:
            return None
        columns = [pa.array(v, k) for v, k in zip(zip(*found, strict=True), kinds[1:], strict=True)]
        return pa.record_batch([batch.column(0), *columns], names)

    return by_batch(docs.select(F.col(id_col).cast("long"), F.col(text_col)), SCHEMA, rows)

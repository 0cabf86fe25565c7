import random
import re

import pytest

from tierbook.llm import licenses

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def expressed(template: str) -> re.Pattern:
    """The template as a regular expression over words that each end with a space."""
    out, at = "", 0
    for m in licenses.MARK.finditer(template):
        out += "".join(re.escape(w) + " " for w in words(template[at : m.start()]))
        at = m.end()
        out += {"beginOptional": "(?:", "endOptional": ")?"}.get(m[1]) or rf"(?:\S+ ){{0,{m[2]}}}"
    return re.compile("(?:^| )" + out + "".join(re.escape(w) + " " for w in words(template[at:])))


def plain(text):
    w = words(text)
    places, labels = [], set()
    for phrase, label in licenses.PHRASES.items():
        p = phrase.split()
        found = [k for k in range(len(w)) if w[k : k + len(p)] == p]
        places += found
        labels |= {label} if found else set()
    joined = "".join(x + " " for x in w)
    whole = {k for k, t in licenses.TEMPLATES.items() if expressed(t).search(joined)}
    return (len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)), ",".join(sorted(labels | whole)),
            1.0 if whole else 0.5 if labels else 0.0)


def filled(template, rng):
    """A text the template accepts."""
    out, keep, at = [], [True], 0
    for m in licenses.MARK.finditer(template):
        if all(keep):
            out += template[at : m.start()].split()
        at = m.end()
        if m[1] == "beginOptional":
            keep.append(rng.random() < 0.5)
        elif m[1] == "endOptional":
            keep.pop()
        elif all(keep):
            out += ["Any-name"] * (rng.randint(0, int(m[2])) // 2)
    return " ".join(out + template[at:].split())


def fixture():
    rng = random.Random(1)
    texts = [None, "", "...", "CC BY cc-by ccby cc  by", "General Public\nLicense, all rights reserved. All rights reserved", "rights reserved all", "İ K CC BYé"]
    for template in licenses.TEMPLATES.values():
        for _ in range(6):
            good = filled(template, rng)
            w = good.split()
            texts += [good, "Intro. " + good.upper() + " (end)", " ".join(w[:-1]), " ".join(w[: len(w) // 2] + ["extra"] + w[len(w) // 2 :])]
    return texts + ["cc " * 50_000 + "by the mit license"]


def test_documents_against_plain_search(spark):
    texts = fixture()
    rows = [(k, t, "l", 1.0) for k, t in enumerate(texts)] + [(None, texts[3], "l", 1.0), (3, texts[3], "l", 1.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, labels string, score double").repartition(3)
    got = licenses.labelled(docs).collect()
    key = lambda r: tuple((-1 if x is None else x) for x in r)
    assert sorted(key(r) for r in got) == sorted(key((r[0], *plain(r[1]))) for r in rows)
    assert licenses.labelled(docs.limit(0)).collect() == []


def test_faulty_templates_are_refused():
    for bad in ("<<beginOptional>> a", "a <<endOptional>>", "<<var;words=3>>", "<<beginOptional>>a<<endOptional>>"):
        with pytest.raises(ValueError, match="region|mandatory"):
            licenses.compiled(bad)
    assert licenses.compiled("<<var;words=2>> b").found_in([b"x", b"b"])


def test_whole_licenses_need_their_disclaimers():
    mit = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the
    "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute,
    sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following
    conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."""
    warranty = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
    MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES
    OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER
    DEALINGS IN THE SOFTWARE."""
    found = lambda text: licenses.scan(text, licenses.PHRASES, licenses.default_automata())[5]
    assert found(f"MIT License\n\nCopyright (c) 2020 A. Person\n\n{mit}\n\n{warranty}") == "mit"
    assert found(mit) == "" and found(mit + warranty.replace("NONINFRINGEMENT", "OTHER THINGS")) == ""
    assert found("// This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, "
                 "You can obtain one at https://mozilla.org/MPL/2.0/.") == "mpl-2.0-header"

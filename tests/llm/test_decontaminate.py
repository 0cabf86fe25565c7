import hashlib
import random
import re

import numpy as np
import pytest

from tierbook.llm import decontaminate
from tierbook.llm.fmindex import Index

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").encode().lower())


def plain(docs, items):
    windows = {}
    for item, text in items:
        w = words(text)
        for s in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[s : s + 10]), set()).add("" if item is None else str(item))
    out = []
    for text in docs:
        w, hit, found = words(text), set(), set()
        for s in range(len(w)):
            for n in range(1, 11):
                if s + n <= len(w) and (held := windows.get(tuple(w[s : s + n]))):
                    found |= held
                    hit.update(range(s, s + n))
        out.append((len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


def test_index_finds_and_locates_every_occurrence():
    rng = np.random.default_rng(4)
    for largest in (1, 3, 9, 40):
        text = rng.integers(0, largest + 1, 400)
        index = Index(text, largest)
        for n in (1, 2, 5):
            patterns = np.array([text[s : s + n] for s in rng.integers(0, 395, 30)] + [rng.integers(1, largest + 1, n) for _ in range(10)])
            patterns = patterns[(patterns > 0).all(axis=1)]
            low, high = index.search(patterns)
            for p, a, b in zip(patterns, low, high, strict=True):
                found = sorted(index.locate(np.arange(a, b)).tolist())
                assert found == [s for s in range(len(text) - n + 1) if (text[s : s + n] == p).all()]


def fixture():
    rng = random.Random(9)
    vocabulary = [f"w{k}" for k in range(30)] + ["É", "naïve", "7"]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(k, text(rng.choice([0, 1, 3, 9, 10, 11, 40]))) for k in range(25)] + [(3, text(20)), (None, "one odd item"), (26, None), (27, "..."), (0, "w1 w2")]
    leak = items[-5][1]
    docs = [None, "", "Nothing Known Here", leak.upper().replace("É", "É"), "x " + leak + ", y", (leak + " ") * 40, "ONE, odd--item!", text(5000)]
    docs += [text(rng.randint(1, 80)) + " " + (items[rng.randrange(25)][1] or "") + "\n" + text(5) for _ in range(60)]
    return docs, items


@pytest.mark.parametrize(("shard_words", "block_bytes"), [(1_500_000, 8_000_000), (50, 150)])
def test_report_against_plain_search(spark, shard_words, block_bytes):
    docs, items = fixture()
    table = spark.createDataFrame([(k, t, "r", 1) for k, t in enumerate(docs)] + [(None, docs[4], "r", 1), (4, docs[4], "r", 1)],
                                  "doc_id long, text string, row string, n_words int").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.report(table, bench, shard_words=shard_words, block_bytes=block_bytes).collect()
    expected = plain([*docs, docs[4], docs[4]], items)
    ids = [*range(len(docs)), -1, 4]
    assert sorted((-1 if r[0] is None else r[0], *r[1:]) for r in got) == sorted((k, *e) for k, e in zip(ids, expected, strict=True))
    assert decontaminate.report(table.limit(0), bench).collect() == []
    assert not any(r["contaminated"] for r in decontaminate.report(table, bench.limit(0)).collect())


def test_clean_cuts_the_words_and_keeps_all_else(spark):
    bench = spark.createDataFrame([("q", "the secret answer of this test is forty two indeed yes")], "item_id string, text string")
    rows = [(1, "Before.  The secret ANSWER of this test, is forty two indeed: yes! After", "en"), (2, "clean text stays As It Is", None), (3, None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row string")
    out = decontaminate.clean(docs, bench)
    assert out.columns == docs.columns
    got = {r[0]: (r[1], r[2]) for r in out.collect()}
    assert got == {1: ("Before.  ! After", "en"), 2: (rows[1][1], None), 3: (None, "x")}

"""Near words, forms and roots against a comparison of all words with all words."""

import random
import re
import zlib
from collections import Counter

import pytest

from tierbook.llm import spellings

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(rows, least=7):
    counts = Counter()
    for doc, text in rows:
        for run in RUN.findall(text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= least:
                counts[run] += 1
    counts = {w: n for w, n in counts.items() if n >= 2}
    form = {}
    sizes = {}
    for w, n in counts.items():
        others = [v for v in counts if abs(len(v) - len(w)) < 2 and near(w, v)]
        sizes[w] = len(others)
        best = min(others, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= 10 * n else None
    out = []
    for w, n in counts.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, sizes[w], counts[form[w]] if form[w] else None))
    return sorted(out)


def edited(rng, word, letters):
    at = rng.randrange(len(word))
    return rng.choice([word[:at] + word[at + 1 :], word[:at] + rng.choice(letters) + word[at:], word[:at] + rng.choice(letters) + word[at + 1 :]])


def corpus(seed, letters, sizes, n_words):
    rng = random.Random(seed)
    base = ["".join(rng.choices(letters, k=rng.choice(sizes))) for _ in range(n_words)]
    texts = []
    for k, word in enumerate(base):
        chain, times = word, 200 if k % 5 == 0 else 20
        for _ in range(4):
            texts += [chain if rng.random() < 0.8 else chain.upper()] * times
            chain, times = edited(rng, chain, letters), max(2, times // rng.choice([3, 10, 12]))
    rng.shuffle(texts)
    return [(k, rng.choice([" ", "9", "\n", "_"]).join(texts[k::97])) for k in range(97)]


@pytest.mark.parametrize("letters, sizes, longest", [("ab", range(6, 12), 64), ("abcé×ÿ", range(6, 16), 10), ("aab", range(6, 12), 7), ("abcdefgh", (62, 63, 64, 65, 66, 200), 64)])
def test_against_all_pairs(spark, letters, sizes, longest):
    rows = corpus(len(letters), letters, list(sizes), 40)
    rows += [(200, None), (201, ""), (None, rows[0][1]), (None, rows[0][1]), (3, rows[4][1]), (202, "12 中文 short")]
    docs = spark.createDataFrame([(i, t, "x", 3) for i, t in rows], "doc_id long, text string, word string, n int").repartition(5)
    assert sorted(map(tuple, spellings.variants(docs, longest=longest).collect())) == plain(rows)


def test_long_runs_and_roots_of_several_steps(spark):
    long = "abcdefghij" * 20_000
    rows = [(k, f"{long} {long}x wonderful") for k in range(3)] + [(10 + k, "sometimes " * 3000 + "sometime " * 200 + "somtime " * 15) for k in range(2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["word"]: r for r in spellings.variants(docs).collect()}
    assert found["somtime"]["form"] == "sometime" and found["somtime"]["root"] == "sometimes" and found["somtime"]["n_near"] == 1
    assert found[long]["n_near"] == found[long + "x"]["n_near"] == 1 and found[long]["form"] is None
    assert spellings.variants(docs.limit(0)).collect() == []
    assert spellings.variants(docs.selectExpr("doc_id", "cast(null as string) as text")).collect() == []


def test_roots_follow_long_chains(spark):
    forms = spark.createDataFrame([(k, k + 1) for k in range(19)] + [(100, 0), (101, 18), (102, 7)], "id long, form long")
    assert {r["id"]: r["root"] for r in spellings.roots(forms).collect()} == dict.fromkeys([*range(19), 100, 101, 102], 19)

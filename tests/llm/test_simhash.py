import random

import numpy as np
import pytest
from xxhash import xxh64_intdigest

from tierbook.llm import simhash


def plain(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    hashes = [xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups_of(prints: dict[int, int]) -> dict[int, int]:
    """Smallest id reachable over pairs within three bits."""
    low = {k: k for k in prints}

    def top(k):
        while low[k] != k:
            k = low[k]
        return k

    ids = sorted(prints)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= 3:
                x, y = sorted((top(a), top(b)))
                low[y] = x
    return {k: top(k) for k in prints}


def test_fingerprint_matches_plain_python():
    for text in ("", None, "One", "a b", "A b C", "a b c a b c a b c", "x " * 500 + "é ü\x0b\x1cz", "  a b"):
        assert simhash.fingerprint(simhash.shingle_hashes(text)) == plain(text)
    words = [str(k % 977) for k in range(150_000)]
    assert simhash.fingerprint(simhash.shingle_hashes(" ".join(words))) == plain(" ".join(words))


def test_close_fingerprints_share_three_blocks():
    masks = simhash.block_masks()
    assert len(masks) == 20
    rng = random.Random(2)
    for _ in range(300):
        a, b = rng.getrandbits(64), 0
        b = a
        for bit in rng.sample(range(64), rng.randint(0, 3)):
            b ^= 1 << bit
        assert any((a ^ b) & (m % (1 << 64)) == 0 for m in masks)


@pytest.mark.parametrize("crowd", [1, 4, 256])
def test_links_give_the_groups_of_all_pairs(spark, crowd):
    rng = random.Random(crowd)
    prints, k = {}, 0
    for _ in range(6):
        x = rng.getrandbits(64)
        for _ in range(12):
            prints[k], k = x, k + 1
            for bit in rng.sample(range(64), rng.randint(0, 4)):
                x ^= 1 << bit
    first = {}
    for k, x in prints.items():
        first.setdefault(x, k)
    signed = lambda x: int(np.uint64(x).astype(np.int64))
    classes = spark.createDataFrame([(signed(x), k) for x, k in first.items()], "fp long, node long")
    from tierbook.llm.common import components

    found = {r["node"]: r["component"] for r in components(simhash.links(classes, crowd)).collect()}
    expected = groups_of({k: x for x, k in first.items()})
    assert {k: found.get(k, k) for k in first.values()} == expected


def test_documents(spark):
    base = " ".join(f"w{k}" for k in range(3000))
    rows = [(5, base), (3, base + " tail"), (9, base), (7, ""), (8, None), (1, "Alone here now"), (2, "ALONE HERE NOW"), (9, base),
            (None, base), (None, "nothing like it"), (11, "very " * 60_000)]
    docs = spark.createDataFrame([(i, t, "fp", 1) for i, t in rows], "doc_id long, text string, component_id string, fp int")
    found = simhash.groups(docs.drop("component_id", "fp").withColumnsRenamed({}), "doc_id", "text").collect()
    assert len(found) == len(rows)
    expected = groups_of({i: plain(t) for i, t in rows if i is not None})
    for r in found:
        if r["doc_id"] is not None:
            assert r["component_id"] == expected[r["doc_id"]]
            assert r["fingerprint"] == f"{plain(dict(rows)[r['doc_id']]):016x}"
    assert {r["component_id"] for r in found if r["doc_id"] is None} == {expected[9], None}
    kept = simhash.deduplicated(docs).collect()
    assert sorted(r["doc_id"] for r in kept if r["doc_id"] is not None) == sorted(set(expected.values()))
    assert [r["text"] for r in kept if r["doc_id"] is None] == ["nothing like it"]
    assert simhash.groups(docs.limit(0)).collect() == [] and simhash.deduplicated(docs.limit(0)).collect() == []


def test_rows_without_id_link_others_and_texts_under_one_id_stay_apart(spark, monkeypatch):
    prints = {"zero": 0, "seven": 7, "all": 63, "far": 1 << 40 | 0xFFFF << 20, "alone": 0xFFFF}
    rows = [(1, "zero"), (None, "seven"), (2, "all"), (9, "far"), (9, "alone"), (None, "far")]
    docs = spark.createDataFrame([(i, t, "a", "b", 1, 2) for i, t in rows], "doc_id long, text string, _id string, mark string, id int, row int")
    given = spark.createDataFrame([(i, t, prints[t]) for i, t in rows], "doc_id long, mark string, fp long")
    monkeypatch.setattr(simhash, "fingerprints", lambda *a: given.withColumn("mark", simhash.text_mark("mark")))
    found = {(r["doc_id"], r["fp"]): r["component_id"] for r in simhash.groups(docs).collect()}
    assert found == {(1, 0): 1, (None, 7): 1, (2, 63): 1, (9, prints["far"]): 9, (None, prints["far"]): 9, (9, prints["alone"]): 9}
    kept = simhash.deduplicated(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"], r["text"], r["_id"], r["row"]) for r in kept.collect()) == [(1, "zero", "a", 2), (9, "alone", "a", 2), (9, "far", "a", 2)]


def test_components_of_long_paths_and_stars(spark):
    from tierbook.llm.common import components

    rng = random.Random(3)
    path, star = list(range(0, 400)), [(1000, 1001 + k) for k in range(300)]
    rng.shuffle(path)
    edges = list(zip(path, path[1:], strict=False)) + star + [(5000, 5001), (5001, 5000), (7, 7)]
    found = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == dict.fromkeys(range(400), 0) | dict.fromkeys(range(1000, 1301), 1000) | {5000: 5000, 5001: 5000}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []

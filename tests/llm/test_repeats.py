import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from tierbook.llm import repeats
from tierbook.llm.suffixes import buckets_down


@pytest.mark.parametrize("memory", [1, 200, 1 << 24])
def test_suffix_order_and_common_prefixes(tmp_path, memory):
    rng = random.Random(memory)
    for _ in range(150):
        text = np.array([rng.randint(rng.choice([0, 1]), rng.choice([1, 2, 4])) for _ in range(rng.randint(1, 60))], np.uint8)
        if rng.random() < 0.4:
            text = np.concatenate([text, text[: len(text) // 2], text])
        cap, raw = rng.choice([3, 20, 200]), bytes(text)
        order = sorted(range(len(raw)), key=lambda i: raw[i:])
        parts = list(buckets_down(text, cap, str(tmp_path), memory))[::-1]
        assert np.concatenate([p for p, _ in parts]).tolist() == order
        found = np.concatenate([c for _, c in parts]).tolist()
        for k, (a, b) in enumerate(zip(order, order[1:], strict=False), 1):
            n = 0
            while n < cap and max(a, b) + n < len(raw) and raw[a + n] == raw[b + n]:
                n += 1
            assert found[k] == n
    assert not list(tmp_path.iterdir())


def plain(texts: list[bytes], length: int) -> list[tuple]:
    count = Counter(t[p : p + length] for t in texts for p in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for p in range(len(t) - length + 1):
            if count[t[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        spans = sum(1 for k, g in enumerate(gone) if g and not (k and gone[k - 1]))
        out.append((len(t), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(t, gone, strict=True) if not g)).hexdigest()))
    return out


def fixture() -> list[str | None]:
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    passage, long = text(60), text(400)
    rows = [None, "", "short", "x" * 199, "x" * 200, "x" * 201, "y" * 5000, long, long, long[:-1] + "Z", long[50:700], "ab" * 300]
    rows += [text(rng.randint(5, 60)) + " " + passage + " " + text(rng.randint(5, 60)) for _ in range(25)]
    rows += [passage[k : k + 205] + text(9) for k in range(0, 40, 7)] + [text(3000) + passage]
    return rows


@pytest.mark.parametrize(("crowd", "entries", "shard_bytes", "memory"), [(4000, 1_000_000, 3_000_000, 1 << 28), (2, 0, 5000, 1), (1, 1_000_000, 5000, 500), (5, 0, 1, 1 << 20)])
def test_documents_against_counting(spark, crowd, entries, shard_bytes, memory):
    texts = fixture()
    rows = [(k, t, "r", "k") for k, t in enumerate(texts)] + [(None, texts[12], "r", "k"), (13, texts[13], "r", "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row string, kept string").repartition(3)
    found = repeats.with_removals(docs, crowd=crowd, broadcast_entries=entries, shard_bytes=shard_bytes, memory=memory)
    got = sorted((-1 if r["row"]["doc_id"] is None else r["row"]["doc_id"], *r[1:5]) for r in found.collect())
    expected = plain([(t or "").encode() for _, t, *_ in rows], 200)
    assert got == sorted((-1 if r[0] is None else r[0], *e) for r, e in zip(rows, expected, strict=True))


def test_cut_documents_keep_rows_and_columns(spark):
    same = "a long passage that stands twice, " * 9
    docs = spark.createDataFrame([(1, "é" + same, "en", 3), (2, same + "é", "fr", None), (3, None, None, 1)], "doc_id long, text string, lang string, row int")
    out = repeats.cut_documents(docs)
    assert out.columns == docs.columns
    assert {r["doc_id"]: (r["text"], r["lang"], r["row"]) for r in out.collect()} == {1: ("é", "en", 3), 2: ("é", "fr", None), 3: ("", None, 1)}
    assert repeats.cut_documents(docs.limit(0)).collect() == []


def test_long_texts_are_cut_into_slices_without_loss():
    rng = np.random.default_rng(5)
    data = rng.integers(97, 100, repeats.SLICE + 5000).astype(np.uint8)
    low, n, key = repeats.segments(data, np.array([0, 300, 300, 350, len(data)]), 200)
    starts = np.concatenate([np.arange(s, s + k) for s, k in zip(low, n, strict=True)])
    assert sorted(starts) == list(range(0, 101)) + list(range(350, len(data) - 199))
    assert (n <= 200 - repeats.GRAM + 1).all() and len(key) == len(low)


def test_a_passage_in_many_surroundings(spark):
    """Crowded owners at the registered settings: the runs of equal bytes around the passage differ from document to document."""
    rng = random.Random(11)
    letters = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage = letters(330)
    texts = [letters(rng.randint(0, 300)) + rng.choice(["", "\n\n", "ab"]) + passage + rng.choice(["", ".", "\n\n"]) + letters(rng.randint(0, 300)) for _ in range(1500)]
    texts += [passage[: 200 + k] + letters(50) for k in range(0, 130, 3)] + [letters(30) + passage[k : k + 201] for k in range(0, 130, 7)]
    texts += [texts[5]] * 40
    docs = spark.createDataFrame([(None if k % 11 == 0 else k, t) for k, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    got = sorted((tuple(r[1:5]) for r in repeats.with_removals(docs).collect()))
    assert got == sorted(plain([t.encode() for t in texts], 200))


def test_production_memory_spills_and_recurses(monkeypatch):
    from tierbook.llm import suffixes

    spills, levels = [], []
    spill, spelled = suffixes.Buckets._spill, suffixes.spelled
    monkeypatch.setattr(suffixes.Buckets, "_spill", lambda self: (spills.append(1), spill(self))[1])
    monkeypatch.setattr(suffixes, "spelled", lambda names: (levels.append(1), spelled(names))[1])
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))) for _ in range(3000)]
    half = np.frombuffer(" ".join(rng.choices(words, k=260_000)).encode(), np.uint8)[: repeats.SHARD_BYTES // 2]
    text = np.concatenate([half, half[:-1], np.array([65], np.uint8)])
    mask = suffixes.repeated_starts(text, 200, repeats.MEMORY)
    n = len(half)
    starts = np.flatnonzero(~mask)
    assert mask[: n - 200].all() and mask[n : 2 * n - 200].all() and set(starts) >= {n - 200, 2 * n - 200}
    assert spills and levels

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tierbook.llm import packing


def test_cut_keeps_all_ids_and_only_the_first_piece_is_short():
    for n in (1, 5, 1023, 1024, 1025, 2048, 5000):
        pieces = packing.cut(n, 1024)
        assert sum(k for _, k in pieces) == n
        assert [s for s, _ in pieces] == list(np.cumsum([0] + [k for _, k in pieces])[:-1])
        assert all(k == 1024 for _, k in pieces[1:])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=9))
def test_bound_and_best_fit_enclose_the_optimum(lengths):
    sizes = np.array(lengths, np.int64)

    def fits(bins: int) -> bool:
        rooms = [20] * bins

        def place(k: int) -> bool:
            if k == len(lengths):
                return True
            for room in set(rooms):
                if room >= lengths[k]:
                    at = rooms.index(room)
                    rooms[at] -= lengths[k]
                    if place(k + 1):
                        return True
                    rooms[at] += lengths[k]
            return False

        return place(0)

    optimum = next(b for b in range(len(lengths) + 1) if fits(b))
    where, offset, fill = packing.best_fit(sizes, 20)
    assert packing.lower_bound(sizes, 20) <= optimum <= len(fill)
    by_bin = defaultdict(list)
    for b, o, n in zip(where, offset, sizes, strict=True):
        by_bin[b].append((o, n))
    for b, rows in by_bin.items():
        at = 0
        for o, n in sorted(rows):
            assert o == at
            at += n
        assert at == fill[b] <= 20


def test_bound_is_better_than_the_sum():
    assert packing.lower_bound(np.array([600] * 10), 1024) == 10
    assert packing.lower_bound(np.array([400] * 9), 1024) == 5  # three of 400 do not fit


def check_packed(rows, capacity):
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return by


def test_documents_are_packed_whole(spark):
    texts = ["", None, "the cat", "word " * 3000, "naïve <|endoftext|> text\n\n  x", "the cat"]
    docs = spark.createDataFrame([(k, t, "x", 1) for k, t in enumerate(texts)] + [(None, "no id", "x", 1), (2, "the cat", "x", 1)],
                                 "doc_id long, text string, piece string, length int")
    rows = packing.pack_documents(docs).collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    expected = []
    for doc, text in [(r["doc_id"], r["text"]) for r in docs.collect()]:
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        for piece, (start, length) in enumerate(packing.cut(len(ids), 1024)):
            expected.append((doc, piece, start, length, zlib.crc32(ids[start : start + length].tobytes())))
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted(map(key, expected)) == sorted(key(r[:5]) for r in rows)
    check_packed(rows, 1024)


@pytest.mark.parametrize(("part_rows", "most"), [(64, 1.06), (10_000, 1.02)])
def test_partitions_exchange_until_few_sequences_are_left(spark, part_rows, most):
    rng = np.random.default_rng(1)
    lengths = rng.integers(1, 1025, 1500)
    pieces = spark.createDataFrame([(k, 0, 0, int(n), k) for k, n in enumerate(lengths)], packing.PIECES)
    rows = packing.pack(pieces, 1024, part_rows).collect()
    assert len(rows) == 1500
    used = len(check_packed(rows, 1024))
    assert used <= most * packing.lower_bound(lengths, 1024) + 1
    assert packing.pack(pieces.limit(0), 1024).collect() == []


def test_same_ids_as_the_other_library(spark):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    enc = packing.encoder(packing.default_vocabulary())
    texts = [r[0] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    texts += ["  a b ퟿ 🙂🙂 don't 12345 ___", " " * 300, "a" * 5000, "\r\n\t x"]
    for t in texts:
        assert enc.encode_ordinary(t) == tokenizer.encode(t, add_special_tokens=False).ids


def test_very_long_runs_of_one_kind(spark):
    kinds = [" ", "\n", "\t", "\u00a0", "a", "9", ".", "日"]
    rows = [(k, f"begin{c * 2_000_000}end") for k, c in enumerate(kinds)] + [(50, "x" + " " * (packing.BLANKS - 1) + "y" + " " * packing.BLANKS)]
    found = packing.pack_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(8)).collect()
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(packing.default_vocabulary().removesuffix(".tiktoken") + ".json")
    for doc, text in rows:
        assert sum(r["length"] for r in found if r["doc_id"] == doc) == len(model.encode(text, add_special_tokens=False).ids) + 1


def test_groups_of_repeated_rows_stay_bounded(spark):
    pieces = spark.range(4000).selectExpr("cast(null as long) as doc_id", "0 as piece", "0L as start", "7L as length", "5L as ids_crc32")
    sizes = []
    found = packing.pack(pieces, 64, part_rows=200).collect()
    assert len(found) == 4000
    by = {}
    for r in found:
        by.setdefault(r["sequence_id"], []).append(r["offset"])
    assert all(sorted(o) == [7 * k for k in range(len(o))] and len(o) <= 9 for o in by.values())
    groups = {}
    for s, o in by.items():
        groups[s >> 22] = groups.get(s >> 22, 0) + len(o)
        sizes.append(len(o))
    assert max(groups.values()) < 400 and len(groups) >= 20

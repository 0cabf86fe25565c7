"""Ids against the tokenizer itself, pieces against whole documents, neighbours against plain BM25."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tierbook.llm import neighbours, wordids

ODD = ["", " ", "Don't STOP", "a b c", "é é É ΣΑΣ", "<|endoftext|> x", "日本語 テスト", "x\x00y\x0bz\x1fq", "1234 5-6", "İstanbul ǅ ß", "a" * 5000, "'s 're 'S", "́ b", "🙂🙂 ok",
       "tab\tline\nreturn\r\x85next", "ﬁ 가"]


def plain_ids(text, model=[]):  # noqa: B006
    if not model:
        model.append(Tokenizer.from_file(wordids.default_vocabulary()))
        model[0].encode_special_tokens = True
    return [*model[0].encode(text or "", add_special_tokens=False).ids, 2]


def test_ids_are_those_of_the_tokenizer():
    rng = random.Random(1)
    texts = [*ODD, None, *("".join(rng.choices([*" \n\t'.,-", *"abcXYZé́日1", " ", "­"], k=200)) for _ in range(300))]
    texts += [rng.choice([" ", "\n", ""]).join(rng.choices(ODD, k=5)) for _ in range(100)]
    encode = wordids.encoder(wordids.default_vocabulary())
    for _ in range(2):  # from the tokenizer and from what is remembered
        ids, starts = encode(pa.array(texts, pa.string()))
        for k, text in enumerate(texts):
            assert ids[starts[k] : starts[k + 1]].tolist() == plain_ids(text)[:-1], text


def corpus(seed=0):
    rng = random.Random(seed)
    topics = [[f"{w}{t}" for w in ("river", "stone", "market", "engine", "violin")] for t in range(6)]
    rows = [(k, " ".join(rng.choices(topics[k % 6] + ["the", "of"], k=rng.randrange(1, 60)))) for k in range(240)]
    rows += [(500, None), (501, ""), (502, " \n"), (503, "word " * 700), (504, "word " * 63), (505, "again and again " * 500), (None, "no id"), (None, None), (None, None)]
    return rows + [rows[3]] * 40 + [(3, "another text")]


@pytest.mark.parametrize("shard_rows", [4, 50, 10_000])
def test_every_id_once_and_no_padding(spark, shard_rows):
    rows, capacity = corpus(), 64
    docs = spark.createDataFrame([(i, t, 1, "k", 2) for i, t in rows], "doc_id long, text string, row int, key string, shard int").repartition(4)
    found = neighbours.packed(docs, capacity, shard_rows=shard_rows).collect()
    # each document's pieces, put together, are as many and the same ids
    want, places = Counter(), defaultdict(list)
    ids = [(doc, plain_ids(text)) for doc, text in rows]
    lengths = defaultdict(list)
    for doc, own in ids:
        want[doc] += len(own)
        lengths[doc].append(own)
    got = Counter()
    for r in found:
        got[r["doc_id"]] += r["length"]
        fits = [own for own in lengths[r["doc_id"]] if len(own) == r["doc_tokens"]]
        assert any(zlib.crc32(np.array(own[r["start"] : r["start"] + r["length"]], "<u4")) == r["ids_crc32"] for own in fits)
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    assert got == want
    for parts in places.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end and length > 0
            end += length
        assert end == capacity or (end < capacity and end & (end - 1) == 0)
    single = [(doc, own) for doc, own in ids if doc is not None and len(lengths[doc]) == 1]
    for doc, own in single:
        spans = sorted((r["start"], r["length"]) for r in found if r["doc_id"] == doc)
        assert [s for s, _ in spans] == [0, *np.cumsum([n for _, n in spans]).tolist()[:-1]] and sum(n for _, n in spans) == len(own)


def test_neighbours_by_plain_bm25():
    rng = random.Random(2)
    docs = [[rng.randrange(1, 60) for _ in range(rng.randrange(1, 80))] for _ in range(50)]
    held = Counter(t for d in docs for t in set(d))
    mean = sum(map(len, docs)) / len(docs)

    def weight(term, doc):
        tf = doc.count(term)
        idf = max(0.0, math.log((len(docs) - held[term] + 0.5) / (held[term] + 0.5)))
        return idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(doc) / mean)) if tf else 0.0

    counts = np.zeros(neighbours.TERMS + 2, np.int64)
    counts[list(held)] = list(held.values())
    counts[neighbours.TERMS :] = len(docs), sum(map(len, docs))
    weights = neighbours.Weights(counts)
    vectors = []
    for d in docs:
        terms, times = np.unique(np.array(d, np.uint16), return_counts=True)
        w = weights.of(terms, times, len(d))
        vectors.append((terms[w > 0], w[w > 0]))
    index, unused = neighbours.Index(vectors), np.ones(len(docs), bool)
    unused[::7] = False
    for k, d in enumerate(docs):
        scores = {j: sum(weight(t, e) for t in set(d) if weight(t, d) > 0) for j, e in enumerate(docs) if unused[j]}
        got = index.neighbours(k, unused, 100, 100).tolist()
        assert set(got) == {j for j, s in scores.items() if s > 0}
        assert all(scores[a] >= scores[b] - 1e-4 for a, b in zip(got, got[1:], strict=False))
        assert index.neighbours(k, unused, 100, 3).tolist() == got[:3]


def test_windows_hold_what_is_alike(spark):
    rows = [r for r in corpus()[:240]]
    found = neighbours.packed(spark.createDataFrame(rows, "doc_id long, text string"), 256, shard_rows=1000).collect()
    at = defaultdict(Counter)
    for r in found:
        at[r["sequence_id"]][r["doc_id"] % 6] += r["length"]
    same = sum(c.most_common(1)[0][1] for c in at.values()) / sum(sum(c.values()) for c in at.values())
    assert same > 0.85


def test_hot_keys_are_spread():
    counts = {5: 10_000, 6: 3, 7: 4, neighbours.TERMS: 900}
    first, spread = neighbours.deal(counts, 100)
    shards = Counter()
    for key, n in counts.items():
        for row in range(n):
            shards[int(first[key] + row % spread[key])] += 1
    assert max(shards.values()) <= 200 and sum(shards.values()) == sum(counts.values())


def test_empty_table(spark):
    assert neighbours.packed(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_weightiest_terms_of_many_pieces_are_those_of_each():
    rng = np.random.default_rng(3)
    docs = [(rng.zipf(1.4, int(rng.integers(0, 300))) % 50).astype("<u2") for _ in range(600)] + [np.array([7, 3, 3, 7], "<u2")]
    counts = np.zeros(neighbours.TERMS + 2, np.int64)
    for d in docs:
        counts[np.unique(d)] += 1
        counts[neighbours.TERMS :] += (1, len(d))
    cut = [None if k % 7 else np.concatenate([x.astype("<u4") for x in np.unique(np.append(d, d[:9]), return_counts=True)]).tobytes() for k, d in enumerate(docs)]
    weights, least = neighbours.Weights(counts), 5
    batch = pa.record_batch([pa.array([len(d) for d in docs]), pa.array([d.tobytes() for d in docs], pa.binary()), pa.array(cut, pa.binary())], ["doc_tokens", "ids", "terms"])
    want = []
    for d, whole in zip(docs, cut, strict=True):
        terms, times = neighbours.terms_of(d, whole)
        gained = np.where(weights.held[terms] >= least, weights.of(terms, times, len(d)), 0)
        want.append(int(terms[gained.argmax()]) if len(terms) and gained.max() > 0 else neighbours.TERMS)
    asked = (weights.held >= least) & (weights.idf > 0)
    assert neighbours.weightiest(batch, weights, asked).tolist() == want and len(set(want)) > 5
    assert neighbours.weightiest(batch.slice(600), weights, asked).tolist() == want[600:]
    assert neighbours.weightiest(batch.slice(0, 0), weights, asked).tolist() == []

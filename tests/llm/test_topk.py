import math
import random

import pytest

from tierbook.llm import topk


def plain(rows, k):
    fine = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in {(i, tuple(v)) for i, v in fine if i is not None and i % 50 == 0}:
        scored = [(-sum(x * y for x, y in zip(a, b, strict=True)), math.inf if i is None else i) for i, b in fine if i != q and len(b) == len(a)]
        out += [(q, r, -1 if i == math.inf else i, -s) for r, (s, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize(("block", "query_block"), [(16, 4096), (3, 2)])
def test_against_all_scores(spark, block, query_block):
    rng = random.Random(block)
    rows = [(i, [rng.gauss(0, 1) for _ in range(20)]) for i in range(400)]
    rows += [(500 + i, rows[i][1]) for i in range(0, 100, 3)]  # ties
    rows += [(50, rows[50][1]), (7, rows[7][1])]  # repeated rows
    rows += [(450, None), (451, [1.0, None] * 10), (452, [float("nan")] * 20), (453, [float("inf")] * 20), (550, [0.5] * 7), (551, [0.25] * 7), (600, [])]
    rows += [(None, rows[3][1]), (650, [1e200] * 20 if block == 3 else [3e5] * 20)]
    if block == 3:
        rows.pop()  # whole numbers beyond 64 bits are no scores
    frame = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<double>, rank int, score int").repartition(4)
    got = topk.search(frame, lambda i: i % 50 == 0, 5, block=block, query_block=query_block).collect()
    assert sorted((r[0], r[1], -1 if r[2] is None else r[2], r[3]) for r in got) == plain(rows, 5)
    assert topk.search(frame.limit(0), lambda i: i % 50 == 0).collect() == []


def test_many_equal_vectors(spark):
    frame = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(300)], "vec_id long, embedding array<double>").repartition(3)
    got = topk.search(frame, lambda i: i == 100, 5).collect()
    assert [(r["rank"], r["vec_id"]) for r in sorted(got, key=lambda r: r["rank"])] == [(1, 0), (2, 1), (3, 2), (4, 3), (5, 4)]

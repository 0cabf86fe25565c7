import random
from collections import Counter

import corpus_pipeline
from tierbook.llm import simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, extra int"


def tables(spark, folder, docs, labels, items):
    rows = [(i, t, "en", "src0", len(t or ""), 1) for i, t in docs]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def stages(spark, folder):
    docs = corpus_pipeline.table(spark, folder, "documents")
    out = []
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stored(stage(spark, docs, folder), name)
        out.append(docs)
    return out


def test_every_stage_takes_effect(spark, tmp_path):
    rng = random.Random(4)
    text = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(n))
    clean = [(i, text(rng.randint(30, 90))) for i in range(60)]
    toxic = [(100 + i, text(40) + " you vile stupid clown " + text(10)) for i in range(40)]
    base, passage, leak = text(2500), text(50), text(25)
    near = [(200, base), (201, base), (202, base + " end"), (203, base)]
    shared = [(300 + i, text(40) + " " + passage + " " + text(40)) for i in range(3)]
    leaked = [(400, "before it " + leak + " after it")]
    odd = [(500, None), (501, ""), (None, text(70)), (502, "tiny"), (5, clean[5][1]), (503, text(20_000))]
    labels = [(i, 1, 0) for i, _ in clean] + [(i, 1, 1) for i, _ in toxic] + [(None, None, 1), (9999, 1, 1)]
    folder = tables(spark, tmp_path / "sf", clean + toxic + near + shared + leaked + odd, labels, [(1, leak), (2, None)])
    first, second, third, fourth, last = stages(spark, folder)
    assert all(d.columns == corpus_pipeline.table(spark, folder, "documents").columns for d in (first, second, third, fourth))
    ids = [r["doc_id"] for r in first.collect()]
    assert not set(ids) & set(range(100, 140))
    assert Counter(ids) == Counter(i for i, _ in clean + near + shared + leaked + odd)
    kept = {r["doc_id"]: r["text"] for r in second.collect()}
    assert 200 in kept and not {201, 202, 203} & set(kept) and {500, 501} & set(kept) and len({500, 501} & set(kept)) == 1
    assert second.count() == len(kept) == len({simhash.fingerprint(simhash.shingle_hashes(t)) for _, t in clean + shared + leaked + odd + [near[0]]})
    cut = {r["doc_id"]: r for r in third.collect()}
    assert set(cut) == set(kept)
    assert all(passage[10:-10] not in cut[300 + i]["text"] and cut[300 + i]["n_chars"] == len(cut[300 + i]["text"]) for i in range(3))
    assert all(cut[i]["text"] == t for i, t in clean + leaked if i in cut) and cut[None]["text"] == odd[2][1]
    final = {r["doc_id"]: r["text"] for r in fourth.collect()}
    assert final[400].split() == ["before", "it", "after", "it"] and all(final[i] == (cut[i]["text"]) for i in final if i != 400)
    packed = last.collect()
    assert {r["doc_id"] for r in packed} == set(final)
    places = Counter()
    for r in packed:
        places[r["sequence_id"]] += r["length"]
    assert max(places.values()) <= 1024
    assert corpus_pipeline.run(spark, folder).count() == len(packed)


def test_empty_tables(spark, tmp_path):
    folder = tables(spark, tmp_path / "none", [], [], [])
    assert [d.count() for d in stages(spark, folder)] == [0] * 5
    folder = tables(spark, tmp_path / "unlabelled", [(1, "a few words"), (2, None)], [], [])
    assert corpus_pipeline.run(spark, folder).count() == 2

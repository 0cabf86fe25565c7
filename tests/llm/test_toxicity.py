import zlib

from tierbook.llm import toxicity


def test_held_out_documents_are_told_apart(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels)
    found = {r["row"]["doc_id"]: r["score"] for r in toxicity.scored(docs.select("doc_id", "text"), model).collect()}
    assert len(found) == docs.count() and all(0 <= s <= 1 for s in found.values())
    known = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    held = [(found[d] >= 0.5, known[d]) for d in known if zlib.crc32(str(d).encode()) % 5 == 0]
    assert sum(said == bool(y) for said, y in held) / len(held) > 0.97
    # some texts labelled toxic hold no toxic word at all
    assert sum(said for said, y in held if y) / sum(y for _, y in held) > 0.85


def test_labels_of_the_held_out_and_columns_are_no_inputs(spark):
    rows = [(i, f"fine words number {i % 7} here", "en", "a") for i in range(200)] + [(i, f"you stupid clown number {i % 7}", "en", "b") for i in range(200, 400)]
    rows += [(400, None, None, None), (401, "", "fr", ""), (None, "stupid clown", "de", "b"), (5, rows[5][1], "x", "y"), (402, "a stupid clown " + "word " * 60_000, "en", "c")]
    schema = "doc_id long, text string, lang string, score string"
    docs = spark.createDataFrame(rows, schema)
    labels = [(i, int(i >= 200)) for i in range(400)] + [(None, 1), (399, None), (9999, 1)]

    def run(labels, rows):
        frame = spark.createDataFrame(labels, "doc_id long, toxic int")
        model = toxicity.fit(docs, frame)
        out = toxicity.scored(spark.createDataFrame(rows, schema), model)
        assert out.select("row.*").columns == docs.columns
        return sorted((-1 if r["row"]["doc_id"] is None else r["row"]["doc_id"], r["score"]) for r in out.collect())

    base = run(labels, rows)
    assert len(base) == len(rows)
    assert all((s >= 0.5) == (200 <= i < 400 or i in (-1, 402)) for i, s in base if i not in (400, 401))
    flipped = [(i, 1 - y if i is not None and y is not None and zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, y in labels]
    assert run(flipped, rows) == base
    assert [s for _, s in run(labels, [(i, t, "zz", "q") for i, t, _, _ in rows])] == [s for _, s in base]
    assert {s for _, s in run([], rows)} == {s for _, s in run([(1, 0)], rows)} and max(s for _, s in run([], rows)) < 0.01
    assert toxicity.scored(docs.limit(0), toxicity.Model()).collect() == []


def test_long_texts_score_as_if_read_at_once():
    model = toxicity.train(["bad word pair", "good word pair", "bad thing", "nice thing"] * 20, [1, 0, 1, 0] * 20)
    words = [b"nice"] * 50_000 + [b"bad"] + [b"nice"] * 50_000
    encode = toxicity.Encoder(model)
    assert abs(toxicity.logits(model, encode, [words])[0] - toxicity.logits(model, encode, [[b"nice"] * 3 + [b"bad"] + [b"nice"] * 3])[0]) < 1e-5


def test_one_id_with_many_texts_gives_one_text(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(toxicity, "train", lambda texts, toxic: seen.append((texts, toxic)) or toxicity.Model())
    docs = spark.createDataFrame([(1, f"text {k}") for k in range(500)] + [(2, "clean"), (3, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0), (4, 1)], "doc_id long, toxic int")
    monkeypatch.setattr(toxicity, "held_out", lambda doc: doc < 0)
    toxicity.fit(docs, labels)
    toxicity.fit(docs.repartition(7), labels)
    assert len(seen[0][0]) == 3 and seen[0] == seen[1] and sorted(seen[0][1]) == [0, 0, 1]


def test_every_labelled_text_is_trained_on(spark):
    # no text of 50 kB or more and no more than 2000 of a class were looked at once
    rows = [(i, f"fine words number {i % 7} here", 0) for i in range(40)] + [(i, "long words " * 5_000 + f"stupid clown number {i % 7}", 1) for i in range(40, 80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(docs.drop("toxic"), docs.select("doc_id", "toxic"))
    found = {r["row"]["doc_id"]: r["score"] for r in toxicity.scored(docs.select("doc_id", "text"), model).collect()}
    assert all((found[i] >= 0.5) == bool(y) for i, _, y in rows)


def test_groups_train_one_model(spark):
    rude, fine = ["clown", "stupid", "moron", "rotten"], ["nice", "warm", "kind", "calm"]
    rows = [(i, f"these {rude[i % 4] if i % 3 == 0 else fine[i % 4]} words are number {i % 7}", int(i % 3 == 0)) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    text, known = docs.drop("toxic"), docs.select("doc_id", "toxic")

    def run(docs):
        model = toxicity.fit(docs, known, at_once=600)
        out = toxicity.scored(text, model, keep=["doc_id"]).collect()
        return model, {r["row"]["doc_id"]: r["score"] for r in out}

    model, found = run(text)
    assert all((found[i] >= 0.5) == bool(y) for i, _, y in rows)
    again = run(text.repartition(7))[1]
    assert again == found
    # rows are those of hashes in toxic texts, and only those that training has moved
    assert 0 < len(model.rows) == len(model.embedding) - 1 and not model.embedding[-1].any() and model.embedding[:-1].any(axis=1).all()
    assert not {zlib.crc32(b"=" + w.encode()) for w in fine} & set(model.rows)

"""The registered queries on given tables: schemas, SQL checks, and the plain form where SQL has none."""

from collections import Counter

import check
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_best_fit_packing": {"doc_id": "bigint", "piece": "int", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "sequence_id": "bigint", "offset": "bigint"},
    "op2_html_extraction": {"page_id": "bigint", "url": "string", "text": "string", "n_chars": "bigint"},
    "op3_simhash_near_dedup": {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"},
    "op4_exact_topk": {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "bigint"},
    "op5_toxicity": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op6_benchmark_decontamination": {"doc_id": "bigint", "n_words": "bigint", "n_hit": "bigint", "n_items": "bigint", "items_sha256": "string", "contaminated": "boolean"},
    "op7_license_scan": {"doc_id": "bigint", "n_words": "bigint", "n_base": "bigint", "first_word": "bigint", "last_word": "bigint", "base_labels": "string",
                         "labels": "string", "score": "double"},
    "op8_warc": {"page_id": "bigint", "payload_bytes": "bigint", "payload_digest": "string", "record_type": "string", "refers_to": "bigint"},
    "op9_suffix_dedup": {"doc_id": "bigint", "n_bytes": "bigint", "n_removed": "bigint", "n_spans": "bigint", "kept_sha256": "string"},
    "op10_importance_resampling": {"doc_id": "bigint"},
    "op11_lexical_packing": {"doc_id": "bigint", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "doc_tokens": "bigint", "sequence_id": "bigint", "offset": "bigint"},
    "op12_spelling_variants": {"word": "string", "form": "string", "root": "string", "n": "bigint", "n_near": "bigint", "form_n": "bigint"},
    "op13_ngram_resampling": {"doc_id": "bigint", "n_features": "bigint", "weight": "bigint", "score": "bigint", "rank": "bigint"},
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns_and_rows(spark, name):
    frame = entry.queries()[name](spark, SF)
    kinds = dict(frame.dtypes)
    assert COLUMNS[name].items() <= kinds.items()
    rows = frame.collect()
    if name in ("op3_simhash_near_dedup", "op5_toxicity", "op6_benchmark_decontamination", "op7_license_scan", "op9_suffix_dedup"):
        ids = Counter(r["doc_id"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect())
        assert Counter(r["doc_id"] for r in rows) == ids
    assert rows


@pytest.mark.parametrize("name", ["op4_exact_topk", "op8_warc", "op12_spelling_variants", "op13_ngram_resampling"])
def test_agrees_with_sql(spark, name):
    ok, text = check.compare(spark, check.connect(SF), name, SF, entry.queries()[name], entry.oracle_sql()[name])
    assert ok and "types differ" not in text, text


def test_pipeline_is_registered(spark):
    assert entry.queries()["pipeline"](spark, SF).count() > 0

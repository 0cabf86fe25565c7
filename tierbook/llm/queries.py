"""Registered queries of the operators, with SQL checks where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tierbook.llm import decontaminate, gains, licenses, neighbours, packing, repeats, resample, simhash, spellings, topk, toxicity, warc, wrappers
from tierbook.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def add(run: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return add


@register("op1_best_fit_packing")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


@register("op3_simhash_near_dedup")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.groups(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


BASE32_SQL = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(h, {5 * i + 1}, 5))::BIGINT) >> {s}) & 31)::INT + 1, 1)"
    for i in range(8) for s in (15, 10, 5, 0)
)


@register(
    "op8_warc",
    f"""
    with p as (select page_id, coalesce(html, '') as html, sha1(coalesce(html, '')) as h from pages),
    q as (select page_id, strlen(html)::bigint as payload_bytes, {BASE32_SQL} as payload_digest,
                 max(page_id) over (partition by html) as original from p)
    select page_id, payload_bytes, payload_digest,
           case when page_id = original then 'response' else 'revisit' end as record_type,
           case when page_id <> original then original end as refers_to
    from q
    """,
)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return warc.round_trip(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@register("op9_suffix_dedup")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return repeats.with_removals(docs).select("row.doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@register("op6_benchmark_decontamination")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@register(
    "op4_exact_topk",
    """
    with v as (select vec_id, [floor(256 * x::double)::bigint for x in embedding] as e from embeddings
               where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
    s as (select q.vec_id as query_id, c.vec_id, list_inner_product(q.e::double[], c.e::double[])::bigint as score
          from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 50 = 0)
    select query_id, rank, vec_id, score from (
      select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from s)
    where rank <= 5
    """,
)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 50 == 0)


@register("op5_toxicity")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    found = toxicity.scored(docs, toxicity.fit(docs, labels), keep=["doc_id"])
    doc_id = F.col("row.doc_id")
    return found.select(doc_id, toxicity.held_out(doc_id).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@register("op10_importance_resampling")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sample drawn towards documents labelled good; its share of the corpus is that of the good among the labelled."""
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    known = labels.where("quality is not null").groupBy("doc_id").agg(F.max(F.col("quality").cast("int")).alias("quality"))
    share = known.agg(F.avg("quality")).first()[0]
    target = resample.texts_of(docs, known.where("quality = 1"))
    found = resample.select(docs, target, resample.FRACTION if share is None else share)
    return found.where("selected").select("doc_id", "log_weight", "key")


@register("op7_license_scan")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.labelled(table(spark, sf_dir, "documents"))


@register("op2_html_extraction")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrappers.extracted(table(spark, sf_dir, "pages")).withColumn("n_chars", F.char_length("text").cast("long"))


@register("op11_lexical_packing")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.packed(table(spark, sf_dir, "documents"))


#: Lists of all bytes' CRC-32 steps, as the table ``tables``.
CRC_TABLES_SQL = """tables as (
    select list(t order by x) as tab
    from (select x, list_reduce([0,1,2,3,4,5,6,7]::bigint[], lambda a, b: xor(a >> 1, (a & 1) * 3988292384), x::bigint) as t from range(256) r(x)))"""


def crc_sql(text: str) -> str:
    """CRC-32 of the UTF-8 bytes of a column, next to ``tables``."""
    byte = f"('0x' || substr(hex(encode({text})), 2 * i::int + 1, 2))::bigint"
    steps = f"list_reduce(list_transform(range(strlen({text})), lambda i: {byte}), lambda a, b: xor(a >> 8, tab[xor(a & 255, b) + 1]), 4294967295::bigint)"
    return f"xor({steps}, 4294967295)"


def lower_sql(text: str) -> str:
    return f"translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@register(
    "op12_spelling_variants",
    f"""
    with recursive {CRC_TABLES_SQL},
    runs as (
      select doc_id, unnest(regexp_extract_all({lower_sql("text")}, '[a-z\u00C0-\u00FF]+')) as run from documents),
    hashed as (
      select run, n, {crc_sql("s")} as h
      from (select run, coalesce(doc_id::varchar, '') || ':' || run as s, count(*) as n from runs group by all) x, tables),
    kept as (
      select case when h % 31 = 0 then substr(run, 1, (h % length(run))::int) || substr(run, (h % length(run))::int + 2) else run end as word, n from hashed),
    words as (select word, sum(n)::bigint as n from kept where length(word) >= 7 group by word having sum(n) >= 2),
    places as (select word, n, unnest(range(1, length(word) + 1))::int as i from words),
    gaps as (select word, n, substr(word, 1, i - 1) || '_' || substr(word, i + 1) as gap, substr(word, 1, i - 1) || substr(word, i + 1) as rest from places),
    inserted as (select distinct g.word as a, g.n as a_n, w.word as b, w.n as b_n from gaps g join words w on g.rest = w.word),
    near as (
      select l.word, r.word as other, r.n as other_n from gaps l join gaps r on l.gap = r.gap and l.word <> r.word
      union all select a, b, b_n from inserted
      union all select b, a, a_n from inserted),
    best as (select word, count(*)::bigint as n_near, first(other order by other_n desc, other) as other, max(other_n) as other_n from near group by word),
    forms as (
      select w.word, w.n, coalesce(n_near, 0)::bigint as n_near, case when other_n >= 10 * w.n then other end as form, case when other_n >= 10 * w.n then other_n end as form_n
      from words w left join best using (word)),
    follow as (
      select word, word as root, form as further from forms
      union all select f.word, g.word, g.form from follow f join forms g on f.further = g.word)
    select f.word, form, root, n, n_near, form_n::bigint as form_n from forms f join follow o on f.word = o.word and o.further is null
    """,
)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spellings.variants(table(spark, sf_dir, "documents"))


WORD_SQL = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"


def _features_sql(name: str) -> str:
    return f"""
      select row, w as f from (select row, unnest(w) as w from {name})
      union all select row, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) from {name}
      union all select row, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) from {name}"""


@register(
    "op13_ngram_resampling",
    f"""
    with {CRC_TABLES_SQL},
    docs as (select row_number() over () as row, doc_id, regexp_extract_all({lower_sql("text")}, {WORD_SQL}) as w from documents),
    items as (select row_number() over () as row, regexp_extract_all({lower_sql("text")}, {WORD_SQL}) as w from benchmark),
    raw as ({_features_sql("docs")}),
    target as ({_features_sql("items")}),
    hashed as (select f, {crc_sql("f")} % 10000 as bucket from (select f from raw union select f from target) x, tables),
    counts as (
      select bucket, sum(s) as s, sum(t) as t
      from (select f, count(*) as s, 0 as t from raw group by f union all select f, 0, count(*) from target group by f) join hashed using (f) group by bucket),
    gains as (
      select bucket, floor(1000 * ln((t + 1)::double * (sum(s) over () + 10000)::double / ((s + 1)::double * (sum(t) over () + 10000)::double)))::bigint as gain from counts),
    weights as (select row, count(*) as n_features, sum(gain) as weight from raw join hashed using (f) join gains using (bucket) group by row),
    scored as (
      select d.doc_id, len(w) as n_words, coalesce(n_features, 0)::bigint as n_features, coalesce(weight, 0)::bigint as weight,
             coalesce(weight, 0)::bigint + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || coalesce(d.doc_id::varchar, '')), 1, 8))::bigint + 0.5)::double / 4294967296)))::bigint as score
      from docs d left join weights using (row)),
    drawn as (select *, row_number() over (partition by n_words >= 20 order by score desc, doc_id nulls last, n_features)::bigint as place, count(*) over (partition by n_words >= 20) as n from scored)
    select doc_id, n_features, weight, score, case when n_words >= 20 and place <= 5 * n // 100 then place end as rank from drawn
    """,
)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = gains.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark").select("text"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")

"""Anonymization keys: lookup per level, matching, harmonised insert, purge.

A key row pairs the five real identity values of an image with the anonymous ones; further attribute pairs hang below it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tierbook import schema as S
from tierbook.functions.scalar import map_of
from tierbook.operators.query import Predicate, all_of, check_column, page, text_filter

REAL = ["patientName", "patientID", "studyInstanceUID", "seriesInstanceUID", "sopInstanceUID"]
ANON = ["anon" + ("SOP" + c[3:] if c.startswith("sop") else c[0].upper() + c[1:]) for c in REAL]
DEPTH = {"IMAGE": 5, "SERIES": 4, "STUDY": 3, "PATIENT": 2}
IDENTITY_PATHS = [S.TAG_TEXT[k] for k, _ in S.IDENTITY]
VALUE_LEVEL = {S.TAG_TEXT[k]: S.LEVEL_RANK[lv] for k, lv in S.MANDATORY_VALUES + S.OPTIONAL_VALUES}


def list_keys(keys: DataFrame, text: str | None = None, order_by: str | None = None, ascending: bool = True,
              start: int = 0, count: int | None = None) -> DataFrame:
    """Free text matches the beginning of any identity column, case ignored."""
    columns = [c for pair in zip(REAL, ANON, strict=True) for c in pair]
    return page(text_filter(keys, columns, text, prefix=True), order_by, ascending, start, count)


def query_keys(keys: DataFrame, predicates: tuple[Predicate, ...], order_by: str | None = None, ascending: bool = True,
               start: int = 0, count: int | None = None) -> DataFrame:
    for p in predicates:
        check_column(keys, p.prop)
    return page(keys.filter(all_of([p.on(F.col(p.prop)) for p in predicates])), order_by, ascending, start, count)


def path_hash(columns: list[Column]) -> list[Column]:
    """128 bits for the patient, study, series and image path of the identity values (two, then one more each), chained from the parent's.

    Null where a value of the path is null, as null equals nothing.
    """
    high, low, out = F.lit(0).cast("long"), F.lit(1).cast("long"), []
    for depth, values in ((2, columns[:2]), *((d, columns[d - 1 : d]) for d in range(3, len(columns) + 1))):
        high, low = F.xxhash64(high, F.lit("high"), *values), F.xxhash64(low, F.lit("low"), *values)
        whole = all_of([c.isNotNull() for c in columns[:depth]])
        out.append(F.when(whole, F.struct(high.alias("high"), low.alias("low"))))
    return out


def match_keys(requests: DataFrame, keys: DataFrame, anonymous: bool = False) -> DataFrame:
    """Deepest level with a key: image, series, study, then patient; of the keys of a level the newest (created, then id).

    ``requests`` has one row per image with the five identity values under their plain names.  Adds ``match_level``
    (rank 1..4) and ``key_id``; without a hit the level is PATIENT and the key null.  Null equals nothing, and a request asks for
    nothing unless its series path is whole.

    Requests and keys go through one shuffle, on their study path, and lie sorted by their values there: what is known of an image, its series
    and its study are three windows over the same rows.  Keys of patients come in with the distinct studies of the requests, of which there are
    far fewer than images, so a patient with many images is no hot key.  Requests that ask for nothing are spread evenly.
    """
    image, series, study, patient = REAL, REAL[:4], REAL[:3], REAL[:2]
    others = [f for f in requests.schema if f.name not in image]
    told = [f.name for f in requests.schema if "map<" not in f.dataType.simpleString()]
    newest = F.struct("depth", "created", "id")
    named = keys.select(*[F.col(c).alias(r) for c, r in zip(ANON if anonymous else REAL, REAL, strict=True)], F.lit(DEPTH["STUDY"]).alias("depth"), "created", "id")
    known = named.where(_whole(study)).select(*image, newest.alias("__key"))
    of_patient = named.where(_whole(patient)).groupBy(*patient).agg(F.max(F.struct("created", "id")).alias("k"))
    asked = requests.where(_whole(series)).select(*study).distinct().join(of_patient, patient)
    asked = asked.select(*study, *[F.lit(None).cast("string").alias(c) for c in image[3:]], F.struct(F.lit(DEPTH["PATIENT"]).alias("depth"), "k.created", "k.id").alias("__key"))
    nothing = [F.lit(None).cast(f.dataType).alias(f.name) for f in others]
    rows = requests.select(*image, *[f.name for f in others], F.lit(None).cast(known.schema["__key"].dataType).alias("__key"), F.lit(True).alias("__asks"),
                           F.when(~_whole(series), F.xxhash64(*told)).alias("__apart"))
    held = known.unionByName(asked).select(*image, *nothing, "__key", F.lit(False).alias("__asks"), F.lit(None).cast("bigint").alias("__apart"))
    # the hash is made after the shuffle, where it costs no bytes and spares most comparisons of texts
    met = rows.unionByName(held).repartition("__apart", *study).withColumn("__study", path_hash([F.col(c) for c in study])[1]["high"])

    def best(columns: list[str]) -> Column:
        return F.when(_whole(columns), F.max("__key").over(Window.partitionBy("__study", "__apart", *columns)))

    found = met.withColumns({"__image": best(image), "__series": best(series), "__of_study": best(study)}).where("__asks")
    above, own = F.when(_whole(series), F.coalesce("__series", "__of_study")), F.when(_whole(series), F.col("__image.id"))
    level = F.when(own.isNotNull(), F.lit(S.LEVEL_RANK["IMAGE"])).when(_whole(series) & F.col("__series").isNotNull(), F.lit(S.LEVEL_RANK["SERIES"]))
    level = level.when(_whole(series) & (F.col("__of_study.depth") == DEPTH["STUDY"]), F.lit(S.LEVEL_RANK["STUDY"])).otherwise(F.lit(S.LEVEL_RANK["PATIENT"]))
    return found.select(*requests.columns, level.cast("bigint").alias("match_level"), F.coalesce(own, above["id"]).alias("key_id"))


def _whole(columns: list[str]) -> Column:
    return all_of([F.col(c).isNotNull() for c in columns])


def key_maps(keys: DataFrame, values: DataFrame, column: str) -> DataFrame:
    """One map path -> value per key, of its stored pairs and the five identity pairs; of pairs that share a path the least value counts.

    A key goes to its shuffle as one row, with its identity values side by side and without their paths, and what it holds is collected after it:
    nearly every key has one row, so aggregating before the shuffle would sort all pairs and spill them, and save nothing.
    """
    named = dict(zip(REAL, ANON, strict=True))
    texts = {f"v{i}": F.col(real if column == "value" else named[real]) for i, real in enumerate(REAL)}
    none = F.lit(None).cast("string")
    own = keys.select(F.col("id").alias("key_id"), *[c.alias(v) for v, c in texts.items()], none.alias("path"), F.lit(True).alias("own"))
    more = values.select("key_id", F.col(column).alias("v0"), *[none.alias(v) for v in list(texts)[1:]], F.col("tag_path").alias("path"), F.lit(False).alias("own"))
    met = own.unionByName(more).where("key_id is not null").repartition("key_id").sortWithinPartitions("key_id")
    identity = [F.struct(F.lit(p).alias("tag_path"), F.col(v).alias("value")) for p, v in zip(IDENTITY_PATHS, texts, strict=True)]
    single = F.array(F.struct(F.col("path").alias("tag_path"), F.col("v0").alias("value")))
    met = met.select("key_id", F.when(F.col("own"), F.array(*identity)).otherwise(single).alias("held"))
    return met.groupBy("key_id").agg(map_of(F.flatten(F.collect_set("held"))).alias("pairs"))


def with_key_values(matched: DataFrame, keys: DataFrame, values: DataFrame, column: str) -> DataFrame:
    """The map of each row's key."""
    return matched.join(key_maps(keys, values, column), "key_id", "left")


def value_level(path: Column) -> Column:
    """Level rank of a value attribute, null for any other path."""
    chain = F
    for rank in sorted(set(VALUE_LEVEL.values())):
        chain = chain.when(path.isin(*[p for p, r in VALUE_LEVEL.items() if r == rank]), F.lit(rank))
    return chain


def harmonise(pairs: DataFrame, context: DataFrame | None = None) -> DataFrame:
    """Pairs to insert: at or above the matched level an existing anonymous value is reused.

    ``pairs`` is (image_id, tag_path, value, anon_value), ``context`` one row per image with match_level and the map of
    the matched key; pairs may carry both along instead, which saves their shuffle.  ``stored`` is false for identity pairs, which live in the key row itself.  New values come from a
    keyed hash, so images of one batch agree with each other in any order.
    """
    reused = F.when(value_level(F.col("tag_path")) <= F.col("match_level"),
                    F.try_element_at(F.col("pairs"), F.col("tag_path")))
    if context is not None:
        pairs = pairs.join(context.select("image_id", "match_level", "pairs"), "image_id")
    return pairs.select(
        "image_id", "match_level", "tag_path", "value", F.coalesce(reused, "anon_value").alias("anon_value"),
        (~F.col("tag_path").isin(*IDENTITY_PATHS)).alias("stored"),
    )


def key_rows(harmonised: DataFrame) -> DataFrame:
    """One new key per image from its harmonised identity pairs, missing values empty."""
    def at(path: str, column: str) -> Column:
        return F.coalesce(F.max(F.when(F.col("tag_path") == path, F.col(column))), F.lit(""))

    columns = [
        c
        for path, real, anon in zip(IDENTITY_PATHS, REAL, ANON, strict=True)
        for c in (at(path, "value").alias(real), at(path, "anon_value").alias(anon))
    ]
    return harmonised.groupBy("image_id", "match_level").agg(*columns)


def purge(keys: DataFrame, values: DataFrame, image_ids: DataFrame | None = None,
          key_ids: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Drop keys of deleted images or keys by id, and the values below them."""
    left = keys
    if image_ids is not None:
        left = left.join(image_ids.toDF("image_id").distinct(), "image_id", "left_anti")
    if key_ids is not None:
        left = left.join(key_ids.toDF("id").distinct(), "id", "left_anti")
    return left.select(*keys.columns), values.join(left.select(F.col("id").alias("key_id")), "key_id", "left_semi")

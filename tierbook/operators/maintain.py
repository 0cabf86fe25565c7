"""Catalogue maintenance: upsert, cascading delete, labels, dimension merges, constraint checks.

Every operator is a function from tables to new tables; callers write the result as a new snapshot.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tierbook import schema as S
from tierbook.operators.ordered import allocate_ids
from tierbook.operators.query import Catalogue
from tierbook.session import materialise


def key_path(level: str) -> list[str]:
    """Natural key columns from the top down to a level."""
    rank = S.LEVELS[level].rank
    return [k for lv in S.LEVELS.values() if lv.rank <= rank for k in lv.key]


def resolve_ids(rows: DataFrame, cat: Catalogue) -> DataFrame:
    """Ids of every level by natural key inside the parent; null where a level is not known."""
    for name, lv in S.LEVELS.items():
        known = cat.level(name)
        if name == "patient":
            known = known.withColumn("patientName", F.substring("patientName", 1, S.NAME_LIMIT))
        on = list(lv.key)
        selected = [F.col("id").alias(f"{name}_id"), *lv.key]
        if lv.parent:
            on.append(f"{lv.parent}_id")
            selected.append(F.col(lv.ref).alias(f"{lv.parent}_id"))
        rows = rows.join(known.select(*selected), on, "left")
    return rows


def latest(batch: DataFrame, keys: list[str], props: list[str], order: Column) -> DataFrame:
    """Last write per key.  ``max_by`` combines on the map side: a key sent a billion times stays cheap."""
    kept = batch.groupBy(*keys).agg(F.max_by(F.struct(*props), order).alias("__row"))
    return kept.select(*keys, *[F.col(f"__row.{p}").alias(p) for p in props])


def upsert(existing: DataFrame, batch: DataFrame, keys: list[str], props: list[str], order: Column) -> DataFrame:
    """Merge a batch into a snapshot on the natural key: update all columns or insert; ``status`` tells which."""
    new = latest(batch, keys, props, order).select(*keys, F.struct(*props).alias("__new"))
    old = existing.select(*keys, F.struct(*props).alias("__old"))
    merged = F.coalesce("__new", "__old")
    status = F.when(F.col("__old").isNull(), "added").when(F.col("__new").isNull(), "kept").otherwise("updated")
    return (
        old.join(new, keys, "full_outer")
        .select(*keys, merged.alias("__row"), status.alias("status"))
        .select(*keys, *[F.col(f"__row.{p}").alias(p) for p in props], "status")
    )


def own_props(level: str) -> list[str]:
    return [p for p in S.LEVELS[level].props if p not in S.LEVELS[level].key]


def upsert_hierarchy(existing: dict[str, DataFrame], batch: DataFrame, order: Column) -> dict[str, DataFrame]:
    """One merge per level over wide arrival rows; names are cut to the stored length first."""
    batch = batch.withColumn("patientName", F.substring("patientName", 1, S.NAME_LIMIT))
    return {name: upsert(existing[name], batch, key_path(name), own_props(name), order) for name in S.LEVELS}


def snapshot_of(batch: DataFrame, order: Column) -> dict[str, DataFrame]:
    return {name: latest(batch, key_path(name), own_props(name), order) for name in S.LEVELS}


# -- ingest ----------------------------------------------------------------------------------------------------

SOURCE = ("sourcetype", "sourcename", "sourceid")


@dataclass(frozen=True)
class Ingest:
    catalogue: Catalogue
    added: DataFrame  # one row per image that arrived: ids of the four levels and whether each of them is new


def empty_catalogue(spark: SparkSession) -> Catalogue:
    def frame(columns: list[str]) -> DataFrame:
        kinds = {"id": "bigint", "sourceid": "bigint"} | {lv.ref: "bigint" for lv in S.LEVELS.values()}
        # known to be empty while the plan is made, so nothing is shuffled to meet it
        return spark.range(1).selectExpr(*[f"cast(null AS {kinds.get(c, 'string')}) AS {c}" for c in columns]).where("false")

    return Catalogue(**{name: frame(lv.columns) for name, lv in S.LEVELS.items()}, series_sources=frame(["id", *SOURCE]))


def _last_writes(batch: DataFrame) -> dict[str, DataFrame]:
    """The last write of every image, series, study and patient.

    Arrivals are shuffled once, on their series: the last row of an image is reduced there, and what it says of the levels above is kept only on
    the last one of its series, so series are read out of the same rows.
    """
    levels = list(S.LEVELS)
    upper = [p for name in levels[:-1] for p in own_props(name)] + [*SOURCE, "__order"]
    own, path = own_props("image"), key_path("series")
    last = batch.repartition(*path).groupBy(*key_path("image")).agg(F.max_by(F.struct(*own, *upper), "__order").alias("r")).select(*key_path("image"), "r.*")
    top = F.row_number().over(Window.partitionBy(*path).orderBy(F.col("__order").desc())) == 1
    last = last.withColumn("__top", top).select(*key_path("image"), *own, "__top", *[F.when(F.col("__top"), F.col(c)).alias(c) for c in upper])
    last = materialise(last, "ingest-image")
    rolled = {"image": last.select(*key_path("image"), *own), "series": last.filter("__top").select(*path, *upper)}
    for rank in range(len(levels) - 2, 0, -1):
        name = levels[rank - 1]
        props = [p for above in levels[:rank] for p in own_props(above)]
        below = rolled[levels[rank]].groupBy(*key_path(name)).agg(F.max_by(F.struct(*props, "__order"), "__order").alias("r"))
        rolled[name] = materialise(below.select(*key_path(name), "r.*"), f"ingest-{name}")
    return rolled


def ingest(cat: Catalogue, arrivals: DataFrame, order: Column) -> Ingest:
    """Insert or update all four levels and the sources of their series; the result is a catalogue for the next query.

    ``arrivals`` has one row per arrival of an image with the properties of all levels and its source; the last one in
    ``order`` wins.  A row that is known by its natural key inside its parent keeps its id, a new one gets the next free id.
    Arrivals are read once: they are reduced to the last write of each image, and every level is rolled up from the one below.  What an image
    meets on the way to its id is written once, as known rows, new rows and the offsets of their ids all read it.
    """
    batch = arrivals.withColumn("patientName", F.substring("patientName", 1, S.NAME_LIMIT)).withColumn("__order", order)
    rolled = _last_writes(batch)
    tables: dict[str, DataFrame] = {}
    with_ids: dict[str, DataFrame] = {}
    for name, lv in S.LEVELS.items():
        rows, known = rolled[name], cat.level(name)
        on = [*lv.key, *([lv.ref] if lv.ref else [])]
        # the path leads the level below to its parent; images have none below them
        path = [] if name == "image" else key_path(name)
        columns = list(dict.fromkeys([*lv.columns, *path, *(SOURCE if name == "series" else ()), "added"]))
        if lv.parent:
            above = with_ids[lv.parent].select(*key_path(lv.parent), F.col("id").alias(lv.ref))
            rows = rows.join(above, key_path(lv.parent))
        rows = rows.select(*[c for c in columns if c not in ("id", "added")]).join(known.select(F.col("id").alias("__known"), *on), on, "left")
        rows = materialise(rows, f"ingest-met-{name}")
        free = F.coalesce(known.agg(F.max("id")).scalar(), F.lit(0)) + 1
        new = allocate_ids(rows.filter("__known IS NULL"), path or on, free).withColumn("added", F.lit(True))
        old = rows.filter("__known IS NOT NULL").withColumn("id", F.col("__known")).withColumn("added", F.lit(False))
        with_ids[name] = materialise(old.select(*columns).unionByName(new.select(*columns)), f"ingest-ids-{name}")
        tables[name] = known.select(*lv.columns).join(with_ids[name], "id", "left_anti").unionByName(with_ids[name].select(*lv.columns))
    came = with_ids["series"].select("id", *SOURCE)
    sources = cat.series_sources.select("id", *SOURCE).join(came, "id", "left_anti").unionByName(came)
    parents = None  # joined from the top, so images meet one join
    for name, lv in ((n, S.LEVELS[n]) for n in ("patient", "study", "series")):
        parent = [F.col(lv.ref).alias(f"{lv.parent}_id")] if lv.parent else []
        rows = with_ids[name].select(F.col("id").alias(f"{name}_id"), *parent, F.col("added").alias(f"{name}_added"))
        parents = rows if parents is None else rows.join(parents, f"{lv.parent}_id")
    added = with_ids["image"].select(F.col("id").alias("image_id"), F.col("series_ref").alias("series_id"), F.col("added").alias("image_added")).join(parents, "series_id")
    return Ingest(replace(cat, **tables, series_sources=sources), added)


# -- delete ----------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Deletion:
    survivors: dict[str, DataFrame]
    deleted: dict[str, DataFrame]  # one id column per level


def cascade_delete(cat: Catalogue, image_ids: DataFrame) -> Deletion:
    """Delete images, then every parent that lost its last child.

    A parent is empty when all its children are marked, one ``min`` per parent: it aggregates on the map side and needs
    neither a join of children with themselves nor a distinct.  Parents that had no children before stay.
    """
    survivors: dict[str, DataFrame] = {}
    deleted: dict[str, DataFrame] = {}
    doomed = image_ids.toDF("id").distinct()
    for name in ("image", "series", "study", "patient"):
        ref = S.LEVELS[name].ref
        frame = cat.level(name)
        marked = frame.join(doomed.withColumn("__gone", F.lit(True)), "id", "left").withColumn(
            "__gone", F.coalesce("__gone", F.lit(False))
        )
        survivors[name] = marked.filter(~F.col("__gone")).select(*frame.columns)
        deleted[name] = marked.filter("__gone").select("id")
        if ref:
            doomed = marked.groupBy(F.col(ref).alias("id")).agg(F.min("__gone").alias("__gone")).filter("__gone").select("id")
    return Deletion(survivors, deleted)


def drop_children(child: DataFrame, ref: str, parents: DataFrame) -> DataFrame:
    """Foreign-key cascade: children whose parent was deleted go too."""
    gone = parents.toDF("__gone").distinct()
    return child.join(gone, child[ref] == gone["__gone"], "left_anti")


# -- labels ----------------------------------------------------------------------------------------------------


def add_tags(tags: DataFrame, links: DataFrame, requests: DataFrame, series: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Add named labels to series: unknown names are created, existing links ignored, unknown series refused.

    ``requests`` has (series_id, name).  Returns the new label table and the new link table.
    """
    from tierbook.operators.ordered import allocate_ids

    wanted = requests.join(series.select(F.col("id").alias("series_id")), "series_id", "left_semi").distinct()
    names = wanted.select("name").distinct().join(tags.select("name"), "name", "left_anti")
    top = tags.agg(F.coalesce(F.max("id"), F.lit(0)) + 1).scalar()
    all_tags = tags.select("id", "name").unionByName(allocate_ids(names, ["name"], top).select("id", "name"))
    asked = wanted.join(all_tags, "name").select("series_id", F.col("id").alias("tag_id"))
    return all_tags, links.select("series_id", "tag_id").union(asked).distinct()


def remove_links(links: DataFrame, requests: DataFrame) -> DataFrame:
    """Unlink the requested pairs; labels themselves stay even when unused."""
    return links.join(requests.distinct(), links.columns, "left_anti")


def assign_types(links: DataFrame, added: DataFrame) -> DataFrame:
    return links.unionByName(added.select(*links.columns)).distinct()


# -- dimensions ------------------------------------------------------------------------------------------------


def create_if_absent(existing: DataFrame, candidates: DataFrame, key: str, owner: str, order: str) -> DataFrame:
    """Verdict per candidate: ``existing`` (same owner), ``conflict`` (name taken by another owner) or ``created``.

    Among new candidates of one name the lowest ``order`` creates it; the others are judged against that one.
    """
    first = candidates.groupBy(key).agg(F.min_by(owner, order).alias("__first"), F.min(order).alias("__order"))
    known = existing.select(key, F.col(owner).alias("__owner"))
    holder = F.coalesce("__owner", "__first")
    verdict = (
        F.when(F.col("__owner").isNull() & (F.col(order) == F.col("__order")), "created")
        .when(F.col(owner) == holder, "existing")
        .otherwise("conflict")
    )
    return candidates.join(first, key).join(known, key, "left").select(*candidates.columns, verdict.alias("verdict"))


def update_by_id(dim: DataFrame, changes: DataFrame, columns: list[str]) -> DataFrame:
    new = changes.select("id", *[F.col(c).alias(f"__{c}") for c in columns])
    replaced = [F.coalesce(F.col(f"__{c}"), F.col(c)).alias(c) if c in columns else F.col(c) for c in dim.columns]
    return dim.join(new, "id", "left").select(*replaced)


# -- constraints -----------------------------------------------------------------------------------------------


def duplicate_keys(frame: DataFrame, keys: list[str]) -> DataFrame:
    return frame.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)


def orphans(child: DataFrame, ref: str, parent: DataFrame) -> DataFrame:
    ids = parent.select(F.col("id").alias("__parent"))
    return child.join(ids, child[ref] == ids["__parent"], "left_anti")


# -- attributes ------------------------------------------------------------------------------------------------


def merge_elements(elements: DataFrame, changes: DataFrame) -> DataFrame:
    """Replace or insert attributes; ``changes`` holds full element rows, one per (image, path)."""
    kept = elements.join(changes.select("image_id", "tag_path"), ["image_id", "tag_path"], "left_anti")
    return kept.select(*elements.columns).unionByName(changes.select(*elements.columns))


# -- snapshots -------------------------------------------------------------------------------------------------


def level_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Natural keys added, kept and deleted on every level between two sets of image rows.

    The keys of both sets are written once, whatever it takes to derive them; keys of a level combine before their shuffle.
    """
    keys = key_path("image")
    both = before.select(*keys, F.lit(True).alias("__old")).unionByName(after.select(*keys, F.lit(False).alias("__old")))
    both, out = materialise(both, "level-keys"), None
    for name in S.LEVELS:
        key = F.concat_ws("|", *key_path(name)).alias("natural_key")
        found = both.groupBy(key).agg(F.max("__old").alias("was"), F.min("__old").alias("gone"))
        status = F.when(~F.col("was"), "added").when(F.col("gone"), "deleted").otherwise("kept")
        rows = found.select(F.lit(name).alias("level"), "natural_key", status.alias("status"))
        out = rows if out is None else out.unionByName(rows)
    return out

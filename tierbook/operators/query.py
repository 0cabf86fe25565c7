"""Level queries over the hierarchy: property predicates, advanced filters, ordering, paging, drill-down.

Existence of a matching relative is always written as a semi join, never as a join plus DISTINCT, so wide rows are not
shuffled to undo fan-out.  Downward existence first reduces the lower level to distinct parent keys, which aggregates
on the map side: a parent holding a third of all rows reaches its task as one row per input partition.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tierbook import schema as S
from tierbook.functions.scalar import like_contains, like_prefix
from tierbook.session import materialise


#: Rows of a page when the caller names none.
PAGE_ROWS = 20


@dataclass(frozen=True)
class Catalogue:
    patient: DataFrame
    study: DataFrame
    series: DataFrame
    image: DataFrame
    series_sources: DataFrame | None = None  # id, sourcetype, sourcename, sourceid
    series_tags: DataFrame | None = None  # id, name
    series_tag_links: DataFrame | None = None  # series_id, tag_id
    series_types: DataFrame | None = None  # id, name
    series_type_links: DataFrame | None = None  # series_id, type_id

    def level(self, name: str) -> DataFrame:
        return getattr(self, name)


@dataclass(frozen=True)
class Predicate:
    prop: str
    op: str  # "=" or "like"
    value: str

    def __post_init__(self):
        if self.op not in ("=", "like"):
            raise ValueError(f"unknown operator {self.op}")

    def on(self, column: Column) -> Column:
        return column == F.lit(self.value) if self.op == "=" else like_contains(column, self.value)


@dataclass(frozen=True)
class Filters:
    """Groups are AND-ed, members of a group OR-ed; an empty group does not filter."""

    sources: tuple[tuple[str, int], ...] = ()
    type_ids: tuple[int, ...] = ()
    tag_ids: tuple[int, ...] = ()

    def __bool__(self) -> bool:
        return bool(self.sources or self.type_ids or self.tag_ids)


@dataclass(frozen=True)
class Query:
    start: int = 0
    count: int | None = None
    order_by: str | None = None
    ascending: bool = True
    predicates: tuple[Predicate, ...] = ()
    filters: Filters = field(default_factory=Filters)


QUERY_LEVELS = {
    "patient": ("patient", "study", "series"),
    "study": ("patient", "study", "series"),
    "series": ("patient", "study", "series"),
    "flat_series": ("patient", "study", "series"),
    "image": ("patient", "study", "series", "image"),
}


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def owner_of(prop: str, levels: tuple[str, ...]) -> str:
    """The level a property belongs to; unknown properties are refused while the plan is built."""
    for name in levels:
        if prop in S.LEVELS[name].props:
            return name
    raise ValueError(f"unknown property {prop}")


def check_column(frame: DataFrame, name: str | None) -> None:
    if name is not None and name not in frame.columns:
        raise ValueError(f"unknown column {name}")


def page(frame: DataFrame, order_by: str | None, ascending: bool, start: int = 0, count: int | None = None) -> DataFrame:
    """Order by one column with the id as tiebreak, then cut a page: a top-k, not a full sort.

    A page that starts beyond the first row has ``PAGE_ROWS`` rows unless told otherwise; ``page_after`` reads deep pages.
    """
    check_column(frame, order_by)
    if start and count is None:
        count = PAGE_ROWS
    keys = [] if order_by is None else [F.col(order_by).asc() if ascending else F.col(order_by).desc()]
    if order_by != "id":
        keys.append(F.col("id").asc())
    if order_by is None and start == 0 and count is None:
        return frame
    frame = frame.orderBy(*keys)
    if start:
        frame = frame.offset(start)
    return frame if count is None else frame.limit(count)


def page_after(frame: DataFrame, order_by: str, ascending: bool, last: tuple[object, int] | None, count: int | None = None) -> DataFrame:
    """The page after the row with order value and id ``last``: a filter and a top-k of ``count`` rows, however deep.

    Null order values come first when ascending, last when not, as in ``page``.
    """
    check_column(frame, order_by)
    if last is not None:
        value, row_id = F.lit(last[0]), last[1]
        tie = F.col(order_by).eqNullSafe(value) & (F.col("id") > row_id)
        if last[0] is None:
            beyond = F.col(order_by).isNotNull() if ascending else F.lit(False)
        else:
            beyond = F.col(order_by) > value if ascending else (F.col(order_by) < value) | F.col(order_by).isNull()
        frame = frame.filter(tie | beyond)
    return page(frame, order_by, ascending, 0, PAGE_ROWS if count is None else count)


def page_by_rank(frame: DataFrame, order_by: str, ascending: bool, start: int, count: int = PAGE_ROWS, few: int = 20_000, splits: int = 64) -> DataFrame:
    """The same page as ``page``, however deep, without the rows before it: the ranks are found by counting.

    Values from a sample part the rows into ranges, each is counted, and only the ranges that hold the page go on, until ``few`` rows are
    left to be ordered; rows of one value are parted by id.  Every pass scans the order column and the id, which are written once so that the
    rows are not derived anew for it, and reduces the rows about ``splits`` times; whole rows are derived for the page alone.  The driver
    sees the values between the ranges and their counts.
    """
    check_column(frame, order_by)
    order, row_id = F.col(order_by), F.col("id")
    left, by_id, depth = start, order_by == "id", 0
    ranks = materialise(frame.select(*dict.fromkeys([order_by, "id"])), "ranks")
    while True:
        value = row_id if by_id else order
        seen = ranks.agg(F.count(F.lit(1)).alias("n"), F.min(value).alias("low"), F.max(value).alias("high"), F.count(value).alias("held")).first()
        if seen["n"] <= few:
            break
        if seen["low"] == seen["high"] and seen["held"] in (0, seen["n"]):
            if by_id:
                break
            by_id = True
            continue
        depth += 1
        sample = ranks.where(F.pmod(F.xxhash64("id", F.lit(depth)), F.lit(max(1, seen["n"] // 4000))) == 0).where(value.isNotNull()).limit(8000)
        values = sample.agg(F.array_sort(F.collect_set(value))).first()[0] or []
        bounds = [values[len(values) * k // splits] for k in range(splits)] if values else []
        bounds = list(dict.fromkeys([*bounds, seen["high"]]))
        range_ = F.when(value.isNotNull(), _bounds_up_to(value, bounds))
        counts = {r["range"]: r["count"] for r in ranks.groupBy(range_.alias("range")).count().collect()}
        upwards = ascending or (by_id and order_by != "id")
        ordered = sorted((r for r in counts if r is not None), reverse=not upwards)
        if None in counts:
            ordered = [None, *ordered] if upwards else [*ordered, None]
        chosen, before, at = [], 0, 0
        for r in ordered:
            if at < left + count and at + counts[r] > left:
                chosen.append(r)
            elif at + counts[r] <= left:
                before += counts[r]
            at += counts[r]
        left -= before
        some = [r for r in chosen if r is not None]
        inside = any_of([range_.isin(some) if some else F.lit(False), range_.isNull() if None in chosen else F.lit(False)])
        frame, ranks = frame.where(inside), ranks.where(inside)
        if len(chosen) == len(counts) or not chosen:
            break
    return page(frame, order_by, ascending, left, count)


def _bounds_up_to(value: Column, bounds: list, first: int = 0) -> Column:
    """How many of the ascending bounds are not above the value, by halving."""
    if not bounds:
        return F.lit(first)
    half = len(bounds) // 2
    lower = _bounds_up_to(value, bounds[:half], first)
    return F.when(value < F.lit(bounds[half]), lower).otherwise(_bounds_up_to(value, bounds[half + 1 :], first + half + 1))


def text_filter(frame: DataFrame, columns: list[str], value: str | None, prefix: bool = False) -> DataFrame:
    """Free text: any of the columns holds the value, case ignored."""
    if value is None:
        return frame
    match = like_prefix if prefix else like_contains
    return frame.filter(any_of([match(F.col(c).cast("string"), value, ignore_case=True) for c in columns]))


# -- advanced filters ------------------------------------------------------------------------------------------


def filter_series(series: DataFrame, cat: Catalogue, filters: Filters, key: str = "id") -> DataFrame:
    """Keep series that satisfy every non-empty filter group; one semi join per group that is set."""
    if filters.sources:
        hit = any_of(
            [(F.col("sourcetype") == t) & (F.col("sourceid") == F.lit(i).cast("bigint")) for t, i in filters.sources]
        )
        series = _semi(series, key, cat.series_sources.filter(hit).select("id"))
    if filters.type_ids:
        links = cat.series_type_links.filter(F.col("type_id").isin(*filters.type_ids)).select("series_id")
        series = _semi(series, key, links)
    if filters.tag_ids:
        links = cat.series_tag_links.filter(F.col("tag_id").isin(*filters.tag_ids)).select("series_id")
        series = _semi(series, key, links)
    return series


def _semi(frame: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    right = keys.toDF("__key")
    return frame.join(right, frame[key] == right["__key"], "left_semi")


# -- level queries ---------------------------------------------------------------------------------------------


def _narrow(cat: Catalogue, level: str, by_level: dict[str, list[Predicate]]) -> DataFrame:
    return cat.level(level).filter(all_of([p.on(F.col(p.prop)) for p in by_level.get(level, [])]))


def _parents_hit(cat: Catalogue, level: str, by_level: dict[str, list[Predicate]], filters: Filters) -> DataFrame:
    """Rows of a level whose own, upper and bridge predicates hold."""
    frame = _narrow(cat, level, by_level)
    if level == "series":
        frame = filter_series(frame, cat, filters)
    parent = S.LEVELS[level].parent
    upper = [name for name, lv in S.LEVELS.items() if lv.rank < S.LEVELS[level].rank]
    needs_parent = any(by_level.get(name) for name in upper) or (level == "image" and bool(filters))
    if parent and needs_parent:
        frame = _semi(frame, S.LEVELS[level].ref, _parents_hit(cat, parent, by_level, filters).select("id"))
    return frame


def run_query(cat: Catalogue, level: str, q: Query) -> DataFrame:
    levels = QUERY_LEVELS[level]
    by_level: dict[str, list[Predicate]] = {}
    for predicate in q.predicates:
        by_level.setdefault(owner_of(predicate.prop, levels), []).append(predicate)

    if level == "flat_series":
        narrowed = Catalogue(
            patient=_narrow(cat, "patient", by_level),
            study=_narrow(cat, "study", by_level),
            series=filter_series(_narrow(cat, "series", by_level), cat, q.filters),
            image=cat.image,
        )
        return page(flat_series(narrowed), q.order_by, q.ascending, q.start, q.count)

    if level in ("series", "image"):
        rows = _parents_hit(cat, level, by_level, q.filters)
    else:
        rows = _narrow(cat, level, by_level)
        if level == "study" and by_level.get("patient"):
            rows = _semi(rows, "patient_ref", _narrow(cat, "patient", by_level).select("id"))
        series_needed = bool(by_level.get("series")) or bool(q.filters)
        if series_needed:
            studies = filter_series(_narrow(cat, "series", by_level), cat, q.filters).select("study_ref").distinct()
        if level == "study" and series_needed:
            rows = _semi(rows, "id", studies)
        if level == "patient" and (series_needed or by_level.get("study")):
            below = _narrow(cat, "study", by_level)
            if series_needed:
                below = _semi(below, "id", studies)
            rows = _semi(rows, "id", below.select("patient_ref").distinct())
    return page(rows, q.order_by, q.ascending, q.start, q.count)


def flat_series(cat: Catalogue) -> DataFrame:
    """Series with all study and patient properties; ids are unique, so no DISTINCT is needed."""
    series = cat.series.select("id", F.col("study_ref").alias("study_id"), *S.SERIES.props)
    study = cat.study.select(F.col("id").alias("study_id"), F.col("patient_ref").alias("patient_id"), *S.STUDY.props)
    patient = cat.patient.select(F.col("id").alias("patient_id"), *S.PATIENT.props)
    return (
        series.join(study, "study_id")
        .join(patient, "patient_id")
        .select("id", "patient_id", "study_id", *S.PATIENT.props, *S.STUDY.props, *S.SERIES.props)
    )


FLAT_TEXT_COLUMNS = [
    "id", *S.PATIENT.props, "studyDescription", "studyDate", "studyID", "accessionNumber", "patientAge",
    "seriesDescription", "seriesDate", "modality", "protocolName", "bodyPartExamined", "manufacturer", "stationName",
]


def list_flat_series(cat: Catalogue, text: str | None = None, filters: Filters = Filters(), order_by: str | None = None,
                     ascending: bool = True, start: int = 0, count: int | None = None) -> DataFrame:
    if filters:
        cat = Catalogue(cat.patient, cat.study, filter_series(cat.series, cat, filters), cat.image)
    return page(text_filter(flat_series(cat), FLAT_TEXT_COLUMNS, text), order_by, ascending, start, count)


def list_patients(cat: Catalogue, text: str | None = None, filters: Filters = Filters(), order_by: str | None = None,
                  ascending: bool = True, start: int = 0, count: int | None = None) -> DataFrame:
    rows = text_filter(cat.patient, list(S.PATIENT.props), text)
    if filters:
        studies = filter_series(cat.series, cat, filters).select("study_ref").distinct()
        rows = _semi(rows, "id", _semi(cat.study, "id", studies).select("patient_ref").distinct())
    return page(rows, order_by, ascending, start, count)


# -- drill-down ------------------------------------------------------------------------------------------------


def studies_for_patient(cat: Catalogue, patient_id: int, filters: Filters = Filters(), start: int = 0,
                        count: int | None = None) -> DataFrame:
    """With filters the listing starts from the series, so studies without a matching series drop out."""
    rows = cat.study.filter(F.col("patient_ref") == patient_id)
    if filters:
        rows = _semi(rows, "id", filter_series(cat.series, cat, filters).select("study_ref").distinct())
    return page(rows, None, True, start, count)


def series_for_study(cat: Catalogue, study_id: int, filters: Filters = Filters(), start: int = 0,
                     count: int | None = None) -> DataFrame:
    rows = filter_series(cat.series.filter(F.col("study_ref") == study_id), cat, filters)
    return page(rows, None, True, start, count)


def images_for_series(cat: Catalogue, series_id: int, text: str | None = None, order_by: str | None = None,
                      ascending: bool = True, start: int = 0, count: int | None = None) -> DataFrame:
    rows = cat.image.filter(F.col("series_ref") == series_id)
    return page(text_filter(rows, list(S.IMAGE.props), text), order_by, ascending, start, count)


def images_for_study(cat: Catalogue, study_id: int, filters: Filters = Filters()) -> DataFrame:
    series = filter_series(cat.series.filter(F.col("study_ref") == study_id), cat, filters)
    return _semi(cat.image, "series_ref", series.select("id"))


def images_for_patient(cat: Catalogue, patient_id: int, filters: Filters = Filters()) -> DataFrame:
    studies = cat.study.filter(F.col("patient_ref") == patient_id).select("id")
    series = _semi(filter_series(cat.series, cat, filters), "study_ref", studies)
    return _semi(cat.image, "series_ref", series.select("id"))


# -- lookups ---------------------------------------------------------------------------------------------------


def by_id(frame: DataFrame, value: int) -> DataFrame:
    return frame.filter(F.col("id") == value)


def by_ids(frame: DataFrame, ids: DataFrame) -> DataFrame:
    """Bulk lookup: ``ids`` has one column; duplicates in it are removed on the map side first."""
    return _semi(frame, "id", ids.distinct())


def labels_of_series(links: DataFrame, dim: DataFrame, link_key: str, wanted: DataFrame | None = None) -> DataFrame:
    """(series, label) pairs, optionally for a list of series only."""
    if wanted is not None:
        links = _semi(links, "series_id", wanted.distinct())
    return links.join(dim.withColumnRenamed("id", link_key), link_key).select("series_id", link_key, "name")


# -- saved filter strings --------------------------------------------------------------------------------------


def parse_source_refs(text: str) -> tuple[tuple[str, int], ...]:
    """``box:23,user:2`` as source references; an unknown type name becomes ``unknown``."""
    refs = []
    for part in text.split(","):
        bits = part.split(":")
        if len(bits) < 2 or not bits[1].lstrip("+-").isdigit():
            raise ValueError("sources must be a comma separated list of type:id, e.g. box:23,user:2")
        refs.append((bits[0] if bits[0] in S.SOURCE_TYPES else "unknown", int(bits[1])))
    return tuple(refs)


def parse_ids(text: str) -> tuple[int, ...]:
    parts = text.split(",")
    if not all(p.lstrip("+-").isdigit() for p in parts):
        raise ValueError("ids must be a comma separated list of numbers, e.g. 2,5,11")
    return tuple(int(p) for p in parts)


def explode_source_refs(frame: DataFrame, column: str) -> DataFrame:
    """The same parser for a whole table of saved filters: one row per reference, ``valid`` false where malformed."""
    part = F.explode(F.split(column, ",")).alias("part")
    kind = F.split_part(F.col("part"), F.lit(":"), F.lit(1))
    number = F.split_part(F.col("part"), F.lit(":"), F.lit(2))
    return frame.select("*", part).select(
        *frame.columns,
        F.when(kind.isin(*S.SOURCE_TYPES), kind).otherwise(F.lit("unknown")).alias("sourcetype"),
        number.try_cast("bigint").alias("sourceid"),
        number.try_cast("bigint").isNotNull().alias("valid"),
    )

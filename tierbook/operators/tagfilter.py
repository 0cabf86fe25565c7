"""Per-source attribute filters: blacklists drop matching paths and subtrees, whitelists keep only matching ones.

All patterns of a source are folded into one row of the definition tables, so filtering is a single equality join on the
source plus a predicate per element row: no fan-out and, as the definitions are small, no shuffle of elements.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tierbook.sources.attributes import Records

SOURCE = ["sourcetype", "sourceid"]


def specs(filters: DataFrame, paths: DataFrame, sources: DataFrame) -> DataFrame:
    """(source, filter name, kind, sorted paths)"""
    per_filter = paths.groupBy(F.col("filter_id").alias("id")).agg(F.array_sort(F.collect_list("path")).alias("paths"))
    empty = F.array().cast("array<string>")
    return (
        sources.withColumnRenamed("filter_id", "id")
        .join(filters, "id")
        .join(per_filter, "id", "left")
        .select(*SOURCE, "name", "kind", F.coalesce("paths", empty).alias("paths"))
    )


def patterns_by_source(spec: DataFrame) -> DataFrame:
    def of(kind: str) -> Column:
        return F.array_distinct(F.flatten(F.collect_list(F.when(F.col("kind") == kind, F.col("paths")))))

    return spec.groupBy(*SOURCE).agg(of("BLACKLIST").alias("black"), of("WHITELIST").alias("white"))


def _steps(path: Column) -> Column:
    return F.split(path, r"\.")


def _step_hit(pattern: Column, step: Column) -> Column:
    """Same attribute, and the item is equal, any, or not given on either side's last step."""
    same_tag = F.substring(pattern, 1, 11) == F.substring(step, 1, 11)
    any_item = F.length(pattern) == 11
    return (pattern == step) | (same_tag & (any_item | pattern.endswith("[*]")))


def _is_trunk(short: Column, long: Column, hit) -> Column:
    """Every step of ``short`` meets the step of ``long`` at the same place."""
    pairs = F.zip_with(short, F.slice(long, 1, F.size(short)), lambda s, t: F.coalesce(hit(s, t), F.lit(False)))
    return (F.size(short) <= F.size(long)) & F.forall(pairs, lambda ok: ok)


def covers(pattern: Column, path: Column) -> Column:
    return _is_trunk(_steps(pattern), _steps(path), _step_hit)


def leads_to(path: Column, pattern: Column) -> Column:
    """The path is an ancestor of the pattern; a sequence row carries no item and leads to all of them."""
    def hit(step: Column, wanted: Column) -> Column:
        return _step_hit(wanted, step) | ((F.length(step) == 11) & (F.substring(wanted, 1, 11) == step))

    return _is_trunk(_steps(path), _steps(pattern), hit)


def dropped_by_blacklist(path: Column, black: Column) -> Column:
    return F.coalesce(F.exists(black, lambda p: covers(p, path)), F.lit(False))


def kept_by_whitelist(path: Column, white: Column) -> Column:
    """An empty whitelist keeps everything."""
    hit = F.exists(white, lambda p: covers(p, path) | leads_to(path, p))
    return F.coalesce(F.size(white) == 0, F.lit(True)) | F.coalesce(hit, F.lit(True))


def apply_filters(elements: DataFrame | Records, spec: DataFrame, blacklist: bool = True, whitelist: bool = True) -> DataFrame:
    """``elements`` carry the source columns; blacklists run before whitelists.  The paths of records are known: patterns are held against
    them once per source, an image meets the verdicts of its source, and only what is kept is spread."""
    if isinstance(elements, Records):
        paths = F.array(*[F.lit(p) for p, _, _ in elements.elements])

        def verdict(path: Column) -> Column:
            kept = F.lit(True)
            if blacklist:
                kept = kept & ~dropped_by_blacklist(path, F.col("black"))
            return kept & kept_by_whitelist(path, F.col("white")) if whitelist else kept

        verdicts = patterns_by_source(spec).select(*SOURCE, F.transform(paths, verdict).alias("kept"))
        images = elements.images.join(verdicts, SOURCE, "left")
        # a source without patterns keeps everything
        kept = F.coalesce("kept", F.array_repeat(F.lit(True), len(elements.elements)))
        return replace(elements, images=images.withColumn("kept", kept)).rows(tuple(SOURCE), kept="kept")
    frame = elements.join(patterns_by_source(spec), SOURCE, "left")
    path = F.col("tag_path")
    if blacklist:
        frame = frame.filter(~dropped_by_blacklist(path, F.col("black")))
    if whitelist:
        frame = frame.filter(kept_by_whitelist(path, F.col("white")))
    return frame.select(*elements.columns)

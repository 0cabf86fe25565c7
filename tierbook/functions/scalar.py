"""Scalar building blocks, all plain column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tierbook.schema import NAME_LIMIT

PSEUDO_DIGITS = 36


def truncate_name(name: Column) -> Column:
    return F.substring(name, 1, NAME_LIMIT)


def join_values(values: Column) -> Column:
    r"""Multi-value text, joined with ``\``."""
    return F.array_join(values, "\\")


def comma_values(values: Column) -> Column:
    """Comma-joined values for rule comparison; absent or empty gives the empty string."""
    return F.coalesce(F.array_join(values, ","), F.lit(""))


def map_of(entries: Column) -> Column:
    """A map of an array of (tag_path, value) structs; of entries that share a path the first in sort order counts."""
    ordered = F.sort_array(entries)
    first = F.filter(
        F.transform(ordered, lambda e, i: F.struct(e.alias("e"), ((i == 0) | (e["tag_path"] != F.get(ordered, i - 1)["tag_path"])).alias("new"))),
        lambda x: x["new"],
    )
    return F.map_from_entries(F.transform(first, lambda x: x["e"]))


def mask_hit(tag: Column, mask: int, masked_tag: int) -> Column:
    return tag.bitwiseAND(F.lit(mask).cast("bigint")) == F.lit(masked_tag).cast("bigint")


def is_overlay(tag: Column) -> Column:
    group = F.shiftrightunsigned(tag, 16)
    return (group >= 0x6000) & (group < 0x6100)


def anonymous_name(sex: Column, age: Column) -> Column:
    def shown(value: Column, missing: str) -> Column:
        return F.coalesce(F.nullif(value, F.lit("")), F.lit(missing))

    return F.concat_ws(" ", F.lit("Anonymous"), shown(sex, "<unknown sex>"), shown(age, "<unknown age>"))


def sanitise(text: Column) -> Column:
    return F.translate(text, "/\\", "--")


def digits_of(text: Column, count: int, salt: str) -> Column:
    """Decimal digits from a salted SHA-256 of the text: same input, same digits, on any executor."""
    digest = F.sha2(F.concat(F.lit(salt + "|"), text), 256)
    return F.substring(F.translate(digest, "abcdef", "012345"), 1, count)


def pseudo_uid(text: Column, salt: str) -> Column:
    return F.concat(F.lit("2.25.1"), digits_of(text, PSEUDO_DIGITS, salt))


def pseudo_accession(text: Column, salt: str) -> Column:
    return digits_of(text, 16, salt + "|accession")


def like_contains(column: Column, value: str, ignore_case: bool = False) -> Column:
    r"""``LIKE '%value%'`` where ``%`` and ``_`` inside the value stay live and ``\`` is a plain character."""
    return _like(column, f"%{value}%", ignore_case)


def like_prefix(column: Column, value: str, ignore_case: bool = False) -> Column:
    return _like(column, f"{value}%", ignore_case)


def _like(column: Column, pattern: str, ignore_case: bool) -> Column:
    pattern = pattern.replace("\\", "\\\\")
    return F.lower(column).like(pattern.lower()) if ignore_case else column.like(pattern)


def path_steps(path: Column) -> Column:
    """``(gggg,eeee)[item].(gggg,eeee)`` as ``array<struct<tag bigint, item string>>``; null if malformed."""
    step = r"\([0-9A-Fa-f]{4},[0-9A-Fa-f]{4}\)(\[([0-9]+|\*)\])?"
    parts = F.split(path, r"\.")
    parsed = F.transform(
        parts,
        lambda p: F.struct(
            F.conv(F.concat(F.substring(p, 2, 4), F.substring(p, 7, 4)), 16, 10).cast("bigint").alias("tag"),
            F.nullif(F.regexp_extract(p, r"\[(.+)\]", 1), F.lit("")).alias("item"),
        ),
    )
    return F.when(path.rlike(rf"^{step}(\.{step})*$"), parsed)


def format_steps(steps: Column) -> Column:
    def one(s: Column) -> Column:
        text = F.lpad(F.hex(s["tag"]), 8, "0")
        item = F.when(s["item"].isNotNull(), F.concat(F.lit("["), s["item"], F.lit("]"))).otherwise(F.lit(""))
        return F.concat(F.lit("("), F.substring(text, 1, 4), F.lit(","), F.substring(text, 5, 4), F.lit(")"), item)

    return F.array_join(F.transform(steps, one), ".")


def url_token(url: Column) -> Column:
    """Last segment of a base URL, one trailing slash ignored."""
    return F.substring_index(F.regexp_replace(F.trim(url), "/$", ""), "/", -1)


def url_protocol(url: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(url, "^([A-Za-z]*)://", 1), F.lit("")), F.lit("http"))


def url_host(url: Column) -> Column:
    return F.regexp_extract(url, "^(?:[A-Za-z]*://)?([^:|/]+)", 1)


def url_port(url: Column) -> Column:
    given = F.regexp_extract(url, "^(?:[A-Za-z]*://)?[^:|/]+:([0-9]+)", 1)
    default = F.when(url_protocol(url) == "https", F.lit(443)).otherwise(F.lit(80))
    return F.coalesce(F.nullif(given, F.lit("")).cast("int"), default)

"""Attribute paths as nested JSON: ``{"tag"|"name", "item", "previous": {...}}``, innermost attribute first."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tierbook import schema as S

def _text(tag: Column, item: Column) -> Column:
    digits = F.lpad(F.hex(tag), 8, "0")
    valid = F.when(item.rlike(r"^(\*|-?[0-9]+)$"), F.concat(F.lit("["), item, F.lit("]"))).otherwise(F.lit(""))
    return F.concat(F.lit("("), F.substring(digits, 1, 4), F.lit(","), F.substring(digits, 5, 4), F.lit(")"), valid)


def path_of_json(document: Column) -> Column:
    """Canonical text of a JSON path, null when a step names neither a tag nor a known keyword.

    A step before the last only counts when it carries an item, as a plain attribute cannot contain another one.
    """
    keyword_tag = F.create_map(*[x for k, t, _, _ in S.DICTIONARY for x in (F.lit(k), F.lit(S.tag_number(t)))])

    def text(at: Column) -> Column:
        number = at["tag"].try_cast("bigint")
        # negative numbers are the signed form of tags from 0x80000000 on
        given = F.when(number < 0, number + F.lit(1 << 32)).otherwise(number)
        tag = F.coalesce(given, F.try_element_at(keyword_tag, at["name"]))
        return _text(tag, F.coalesce(at["item"], F.lit("")))

    # one round for each nested step: the fields of the step, and the text of the step it is in
    depth = F.size(F.split(document, '"previous"'))
    start = F.struct(document.alias("rest"), F.array().cast("array<map<string,string>>").alias("steps"))

    def open_step(acc: Column, _: Column) -> Column:
        fields = F.from_json(acc["rest"], "map<string,string>")
        return F.struct(
            F.try_element_at(fields, F.lit("previous")).alias("rest"),
            F.when(fields.isNull(), acc["steps"]).otherwise(F.array_append(acc["steps"], fields)).alias("steps"),
        )

    steps = F.aggregate(F.sequence(F.lit(1), depth), start, open_step, lambda acc: acc["steps"])
    above = F.filter(F.slice(steps, 2, F.greatest(F.size(steps) - 1, F.lit(0))), lambda at: at["item"].isNotNull())
    here = text(F.get(steps, F.lit(0)))
    outer = F.filter(F.transform(above, text), lambda t: t.isNotNull())
    return F.when(here.isNotNull(), F.concat_ws(".", F.reverse(outer), here))

"""Series classification: a type is assigned when any of its rules has all attributes equal on the representative image.

Rule attributes meet the element rows through equality joins on (sequence, tag, value), so only matching pairs exist; no
series is paired with every rule.  An expected empty string means "absent or empty" and is checked by its violations.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierbook.functions.scalar import comma_values


def representatives(images: DataFrame) -> DataFrame:
    """Lowest image id per series."""
    return images.groupBy(F.col("series_ref").alias("series_id")).agg(F.min("id").alias("image_id"))


def involved(elements: DataFrame, attributes: DataFrame) -> DataFrame:
    """Only root attributes some rule asks for, cut before anything is shuffled."""
    asked = attributes.select(F.col("tag").alias("tag_path")).distinct()
    return elements.join(asked, "tag_path", "left_semi")


def rule_values(elements: DataFrame, attributes: DataFrame, sequences: bool = False) -> DataFrame:
    """(series_id, sequence, tag, value) for every place a rule attribute can look at.

    With ``sequences`` the first item of the named sequence is read, ``(gggg,eeee)[1].(gggg,eeee)`` names one inside another;
    a sequence without a first item falls back to the root attribute.
    """
    root = involved(elements, attributes).select(
        "series_id", F.lit("").alias("sequence"), F.col("tag_path").alias("tag"), comma_values(F.col("values")).alias("value")
    )
    if not sequences:
        return root
    asked = attributes.filter(F.col("sequence") != "").select("sequence", "tag").distinct()
    inside = (
        elements.filter(F.col("tag_path").rlike(r"^\([0-9A-F,]+\)(\[1\]\.\([0-9A-F,]+\))+$"))
        .select("series_id", F.split("tag_path", r"\[1\]\.").alias("steps"), comma_values(F.col("values")).alias("value"))
        .select(
            "series_id", "steps", "value", F.element_at("steps", -1).alias("tag"),
            F.array_join(F.slice("steps", 1, F.size("steps") - 1), "[1].").alias("sequence"),
        )
    )
    # a first item is there if anything is inside it, at any depth
    depth = F.explode(F.sequence(F.lit(1), F.size("steps") - 1))
    resolved = inside.select("series_id", "steps", depth.alias("depth")).select(
        "series_id", F.array_join(F.slice("steps", F.lit(1), F.col("depth")), "[1].").alias("sequence")).distinct()
    inside = inside.join(asked.select("sequence").distinct(), "sequence", "left_semi")
    fallback = (
        root.drop("sequence").join(asked, "tag")
        .join(resolved, ["series_id", "sequence"], "left_anti")
        .select("series_id", "sequence", "tag", "value")
    )
    return root.unionByName(inside.select("series_id", "sequence", "tag", "value")).unionByName(fallback)


def classify(series: DataFrame, values: DataFrame, rules: DataFrame, attributes: DataFrame) -> DataFrame:
    """(series_id, type_id) links.  ``series`` lists the series that have a representative image."""
    asked = attributes.select("rule_id", "sequence", "tag", "expected").distinct()
    positive = asked.filter(F.col("expected") != "").withColumnRenamed("expected", "value")
    negative = asked.filter(F.col("expected") == "").drop("expected")
    needed = positive.groupBy("rule_id").agg(F.count(F.lit(1)).alias("needed"))

    hits = values.join(positive, ["sequence", "tag", "value"]).groupBy("series_id", "rule_id").agg(
        F.count(F.lit(1)).alias("hits"))
    broken = values.filter(F.col("value") != "").join(negative, ["sequence", "tag"]).select("series_id", "rule_id").distinct()

    full = hits.join(needed, "rule_id").filter(F.col("hits") == F.col("needed")).select("series_id", "rule_id")
    # rules without a positive attribute hold for every series unless broken: the result itself has that many rows
    open_rules = rules.join(needed, "rule_id", "left_anti").agg(F.collect_set("rule_id")).scalar()
    always = series.select("series_id", F.explode(open_rules).alias("rule_id"))
    matched = full.unionByName(always).join(broken, ["series_id", "rule_id"], "left_anti")
    return matched.join(rules, "rule_id").select("series_id", "type_id").distinct()


def type_info(rules: DataFrame, attributes: DataFrame) -> DataFrame:
    """Type with its rules and their attributes as nested lists, plus the attributes involved.  Definition tables only."""
    per_rule = attributes.groupBy("rule_id").agg(
        F.array_sort(F.collect_set(F.struct("tag", "expected"))).alias("attributes"))
    return (
        rules.join(per_rule, "rule_id", "left")
        .groupBy("type_id")
        .agg(
            F.array_sort(F.collect_list(F.struct("rule_id", "attributes"))).alias("rules"),
            F.array_distinct(F.flatten(F.collect_list(F.transform("attributes", lambda a: a["tag"])))).alias("tags"),
        )
        .withColumn("max_tag", F.array_max("tags"))
    )

"""Small constant tables.

Every frame made here holds rows written in the program, so its size is fixed before any data is read.  They are
created from Arrow, which Spark keeps as a local relation with exact size statistics: the optimizer broadcasts them
by itself, no hint is needed.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tierbook import schema as S


def constant_table(spark: SparkSession, rows: list[tuple], columns: dict[str, str]) -> DataFrame:
    """A frame of rows written in the program; ``columns`` maps name to a Spark SQL type.  Tables of a user come from files."""
    arrays = {name: [row[i] for row in rows] for i, name in enumerate(columns)}
    types = {"bigint": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "int": pa.int32(),
             "array<string>": pa.list_(pa.string()), "array<bigint>": pa.list_(pa.int64())}
    return spark.createDataFrame(pa.table({n: pa.array(v, types[columns[n]]) for n, v in arrays.items()}))


def tag_dim(spark: SparkSession) -> DataFrame:
    rows = [(S.tag_number(tag), tag, keyword, vr, vm) for keyword, tag, vr, vm in S.DICTIONARY]
    return constant_table(
        spark, rows, {"tag": "bigint", "tag_text": "string", "keyword": "string", "vr": "string", "vm": "string"}
    )


def value_tag_dim(spark: SparkSession) -> DataFrame:
    """Mandatory and optional value attributes with their level (union, duplicates removed)."""
    types = {"keyword": "string", "level": "string"}
    mandatory = constant_table(spark, S.MANDATORY_VALUES, types)
    optional = constant_table(spark, S.OPTIONAL_VALUES, types)
    return mandatory.unionByName(optional).distinct()


def context_dim(spark: SparkSession, extended: bool = False) -> DataFrame:
    """Accepted (storage class, encoding) pairs: every accepted class allows every accepted encoding."""
    classes = S.ACCEPTED_IMAGE_CLASSES + (S.ACCEPTED_EXTENDED_CLASSES if extended else [])
    pairs = [(c, s) for c in classes for s in S.ACCEPTED_SYNTAXES]
    return constant_table(spark, pairs, {"sop_class": "string", "transfer_syntax": "string"})

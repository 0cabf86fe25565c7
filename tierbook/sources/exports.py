"""Exports: the key table as delimited text, and the archive manifest of an image set."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierbook.functions.scalar import sanitise

# Heading of the key export.
KEY_EXPORT = [
    ("id", "ID"), ("image_id", "Image ID"), ("created", "Created"),
    ("patientName", "Patient Name"), ("anonPatientName", "Anonymous Patient Name"),
    ("patientID", "Patient ID"), ("anonPatientID", "Anonymous Patient ID"),
    ("studyInstanceUID", "Study Instance UID"), ("anonStudyInstanceUID", "Anonymous Study Instance UID"),
    ("seriesInstanceUID", "Series Instance UID"), ("anonSeriesInstanceUID", "Anonymous Series Instance UID"),
    ("sopInstanceUID", "SOP Instance UID"), ("anonSOPInstanceUID", "Anonymous SOP Instance UID"),
    ("tag_path", "Tag Path"), ("value", "Value"), ("anon_value", "Anonymized Value"),
]


def key_export(keys: DataFrame, values: DataFrame) -> DataFrame:
    """Every key with its values; a key without values gives one row with an empty path."""
    joined = keys.join(values.withColumnRenamed("key_id", "id"), "id", "left")
    defaults = {"tag_path": "(0000,0000)", "value": "", "anon_value": ""}
    return joined.select(
        *[F.coalesce(F.col(c), F.lit(defaults[c])).alias(h) if c in defaults else F.col(c).alias(h) for c, h in KEY_EXPORT]
    )


def write_key_csv(frame: DataFrame, path: str) -> None:
    """One text part per task; nothing is gathered on the driver."""
    frame.write.mode("overwrite").csv(path, sep=";", header=True, quoteAll=False)


def manifest(images: DataFrame, flat: DataFrame) -> DataFrame:
    """Archive path ``patient/study/series/image`` per image, folder names without slashes."""
    series = flat.select(
        F.col("id").alias("series_ref"),
        sanitise(F.concat(F.col("patient_id").cast("string"), F.lit("_"), F.col("patientName"), F.lit("-"),
                          F.col("patientID"))).alias("patient_folder"),
        sanitise(F.concat_ws("_", "study_id", "studyDate")).alias("study_folder"),
        sanitise(F.concat_ws("_", "id", "seriesDate", "modality")).alias("series_folder"),
    )
    name = F.concat(F.col("id").cast("string"), F.lit(".dcm"))
    return images.join(series, "series_ref").select(
        F.col("id").alias("image_id"), "patient_folder", "study_folder", "series_folder",
        F.concat_ws("/", "patient_folder", "study_folder", "series_folder", name).alias("entry"),
    )


def write_manifest(frame: DataFrame, path: str) -> None:
    """Partitioned by patient folder; the rebalance joins small parts and splits a hot patient over as many files as it needs."""
    spread = frame.hint("rebalance", "patient_folder")
    spread.write.mode("overwrite").partitionBy("patient_folder").parquet(path)

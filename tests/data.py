"""The small hand-made catalogue: 1 patient, 2 studies, 4 series, 8 images."""

from __future__ import annotations

from tierbook import schema as S
from tierbook.operators.query import Catalogue


def frame(spark, level, rows):
    lv = S.LEVELS[level]
    types = ["bigint" if c in ("id", lv.ref) else "string" for c in lv.columns]
    return spark.createDataFrame(rows, ", ".join(f"{c} {t}" for c, t in zip(lv.columns, types, strict=True)))


def catalogue(spark) -> Catalogue:
    patients = frame(spark, "patient", [(1, "p1", "s1", "2000-01-01", "M")])
    studies = frame(spark, "study", [
        (1, 1, "stuid1", "stdesc1", "19990101", "stid1", "acc1", "12Y"),
        (2, 1, "stuid2", "stdesc2", "19990102", "stid1", "acc2", "14Y"),
    ])
    series = frame(spark, "series", [
        (1, 1, "seuid1", "sedesc1", "19990101", "NM", "prot1", "bodypart1", "manu1", "station1", "frid1"),
        (2, 1, "seuid2", "sedesc2", "19990102", "NM", "prot2", "bodypart2", "manu2", "station2", "frid2"),
        (3, 2, "seuid3", "sedesc1", "19990103", "NM", "prot1", "bodypart1", "manu3", "station3", "frid1"),
        (4, 2, "seuid4", "sedesc2", "19990104", "NM", "prot2", "bodypart2", "manu3", "station3", "frid2"),
    ])
    images = frame(spark, "image", [(i, (i + 1) // 2, f"souid{i}", "PRIMARY\\RECON\\TOMO", str(i % 2 + 1)) for i in range(1, 9)])
    return Catalogue(
        patients, studies, series, images,
        series_sources=spark.createDataFrame(
            [(1, "user", "u", 1), (2, "box", "b", 1), (3, "directory", "d", 1), (4, "scp", "s", 1)],
            "id bigint, sourcetype string, sourcename string, sourceid bigint"),
        series_tags=spark.createDataFrame([(1, "Tag1"), (2, "Tag2")], "id bigint, name string"),
        series_tag_links=spark.createDataFrame([(1, 1), (1, 2), (2, 1), (3, 2)], "series_id bigint, tag_id bigint"),
        series_types=spark.createDataFrame([(1, "t1"), (2, "t2")], "id bigint, name string"),
        series_type_links=spark.createDataFrame([(1, 1), (2, 1), (2, 2), (3, 2)], "series_id bigint, type_id bigint"),
    )

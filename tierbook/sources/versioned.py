"""Tables whose changes cost what the change weighs, and whose versions switch as a whole.

A table lies in buckets of its key, one folder each.  A merge or a delete writes the changed rows only, as a delta, and publishes a
manifest that names the folders of the new version; readers take the newest manifest, so a run that fails, or one that still goes
on, is not seen.  Reading resolves deltas in the buckets they touch and scans the others as they are; a lookup by key reads the
buckets of its keys.  Where deltas have grown to ``fold`` of the rows, the buckets they touch, and no others, are written anew.

``how`` is what a delta does to a row of the same key: ``latest`` replaces it, ``sum`` adds its ``n``.  The driver sees bucket numbers only.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BUCKET, VERSION, DELETED = "__bucket", "__version", "__deleted"


class Versioned:
    def __init__(self, spark: SparkSession, path: str, keys: list[str], buckets: int = 64, how: str = "latest", fold: float = 0.25):
        self.spark, self.path, self.keys, self.buckets, self.how, self.fold = spark, path, keys, buckets, how, fold

    # -- manifests -----------------------------------------------------------------------------------------------

    def _file(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def manifest(self, version: int | None = None) -> dict:
        """The newest published version, or a given one; an unfinished file is none."""
        fs, folder = self._file("manifest")
        names = [f.getPath().getName() for f in fs.listStatus(folder)] if fs.exists(folder) else []
        numbers = sorted((int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[0] != "."), reverse=True)
        for number in numbers if version is None else [version]:
            fs, path = self._file(f"manifest/{number}.json")
            stream = fs.open(path)
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            stream.close()
            try:
                return json.loads(text)
            except json.JSONDecodeError:
                continue
        raise FileNotFoundError(f"{self.path} has no published version")

    def _publish(self, manifest: dict) -> None:
        """Creating a file that must not exist is the switch: of two writers of one version the second fails."""
        fs, path = self._file(f"manifest/{manifest['version']}.json")
        out = fs.create(path, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()

    # -- writing -------------------------------------------------------------------------------------------------

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _base(self, frame: DataFrame, version: int) -> dict[str, list[int]]:
        """Writes rows with a bucket, one folder and file each; version and number of rows of every bucket that has any."""
        folder = f"{self.path}/base/{version}"
        frame.repartition(BUCKET).write.mode("overwrite").partitionBy(BUCKET).parquet(folder)
        found = self.spark.read.schema(frame.schema).parquet(folder).groupBy(BUCKET).count().collect()
        return {str(r[BUCKET]): [version, r["count"]] for r in found}

    def create(self, frame: DataFrame) -> Versioned:
        base = self._base(frame.withColumn(BUCKET, self.bucket()), 1)
        self._publish({"version": 1, "schema": frame.schema.json(), "base": base, "deltas": []})
        return self

    def merge(self, rows: DataFrame, delete: DataFrame | None = None) -> None:
        """Rows with distinct keys to insert or replace (``sum``: to add), and keys to delete."""
        old = self.manifest()
        version, schema = old["version"] + 1, StructType.fromJson(json.loads(old["schema"]))
        change = rows.select(*[F.col(c) for c in schema.names], F.lit(False).alias(DELETED))
        if delete is not None:
            empty = [F.col(f.name) if f.name in self.keys else F.lit(None).cast(f.dataType).alias(f.name) for f in schema]
            change = change.union(delete.select(*self.keys).distinct().select(*empty, F.lit(True)))
        folder = f"{self.path}/delta/{version}"
        change.withColumn(BUCKET, self.bucket()).repartitionByRange(BUCKET).sortWithinPartitions(BUCKET).write.mode("overwrite").parquet(folder)
        touched = self.spark.read.schema(change.withColumn(BUCKET, self.bucket()).schema).parquet(folder).groupBy(BUCKET).count().collect()
        if not touched:
            return
        delta = {"version": version, "buckets": sorted(r[BUCKET] for r in touched), "rows": sum(r["count"] for r in touched)}
        new = old | {"version": version, "deltas": [*old["deltas"], delta]}
        self._publish(new)
        if sum(d["rows"] for d in new["deltas"]) > self.fold * sum(rows for _, rows in new["base"].values()):
            self.compact()

    def compact(self) -> None:
        old = self.manifest()
        touched = sorted({b for d in old["deltas"] for b in d["buckets"]})
        if not touched:
            return
        version = old["version"] + 1
        fresh = self._base(self._resolved(old, touched).withColumn(BUCKET, self.bucket()), version)
        base = {b: entry for b, entry in old["base"].items() if int(b) not in touched} | fresh
        self._publish(old | {"version": version, "base": base, "deltas": []})

    # -- reading -------------------------------------------------------------------------------------------------

    def _scan(self, manifest: dict, buckets: set[int]) -> DataFrame:
        schema = StructType.fromJson(json.loads(manifest["schema"]))
        paths = [f"{self.path}/base/{v}/{BUCKET}={b}" for b, (v, _) in manifest["base"].items() if int(b) in buckets]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _resolved(self, manifest: dict, buckets: list[int]) -> DataFrame:
        """Rows of the buckets with their deltas applied."""
        schema = StructType.fromJson(json.loads(manifest["schema"]))
        whole = StructType.fromJson(schema.jsonValue()).add(DELETED, "boolean").add(BUCKET, "integer")
        rows = self._scan(manifest, set(buckets)).withColumns({DELETED: F.lit(False), VERSION: F.lit(0)})
        for delta in manifest["deltas"]:
            if set(delta["buckets"]) & set(buckets):
                part = self.spark.read.schema(whole).parquet(f"{self.path}/delta/{delta['version']}").where(F.col(BUCKET).isin(buckets))
                rows = rows.unionByName(part.drop(BUCKET).withColumn(VERSION, F.lit(delta["version"])))
        if self.how == "sum":
            return rows.groupBy(*self.keys).agg(F.sum("n").alias("n")).where("n <> 0").select(*schema.names)
        values = [c for c in schema.names if c not in self.keys]
        last = rows.groupBy(*self.keys).agg(F.max_by(F.struct(DELETED, *values), VERSION).alias("__row")).where(f"not __row.{DELETED}")
        return last.select(*[F.col(c) if c in self.keys else F.col(f"__row.`{c}`").alias(c) for c in schema.names])

    def read(self, version: int | None = None, buckets: set[int] | None = None) -> DataFrame:
        """The table as of a version, or what some buckets hold of it."""
        manifest = self.manifest(version)
        wanted = set(range(self.buckets)) if buckets is None else buckets
        touched = sorted({b for d in manifest["deltas"] for b in d["buckets"]} & wanted)
        plain = self._scan(manifest, wanted - set(touched))
        return plain.unionByName(self._resolved(manifest, touched)) if touched else plain

    def lookup(self, keys: DataFrame) -> DataFrame:
        """The rows with these keys, from their buckets."""
        keys = keys.select(*self.keys).distinct()
        buckets = {r[0] for r in keys.select(self.bucket()).distinct().collect()}
        return self.read(buckets=buckets).join(keys, self.keys, "left_semi")

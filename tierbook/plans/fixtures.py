"""The catalogue derived from the given star-schema tables.

Nothing is cached or collected; every method returns a lazy frame over the parquet tables, so column pruning and
filters reach the scans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tierbook import schema as S
from tierbook.operators.query import Catalogue
from tierbook.plans import fixture_values as V
from tierbook.session import materialise
from tierbook.sources.attributes import Records, unpivot
from tierbook.sources.dims import constant_table

SOURCE_KIND = ("user", "box", "scp", "directory", "import")


def source_kind(n: Column) -> Column:
    return F.element_at(F.array(*[F.lit(k) for k in SOURCE_KIND]), (n % 5).cast("int") + 1)


class Fixtures:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.dir = sf_dir
        self._schemas = {}
        self._listed: DataFrame | None = None

    def table(self, name: str) -> DataFrame:
        """A table of the data folder; its footer is read for the schema only once per plan."""
        reader, path = self.spark.read, f"{self.dir}/{name}.parquet"
        if name in self._schemas:
            return reader.schema(self._schemas[name]).parquet(path)
        frame = reader.parquet(path)
        self._schemas[name] = frame.schema
        return frame

    # -- hierarchy ---------------------------------------------------------------------------------------------

    def patients(self) -> DataFrame:
        return self.table("nation").select(
            F.col("n_nationkey").cast("bigint").alias("id"),
            F.col("n_name").alias("patientName"),
            F.col("n_nationkey").cast("string").alias("patientID"),
            F.lit("").alias("patientBirthDate"),
            F.when(F.col("n_regionkey") % 2 == 0, "M").otherwise("F").alias("patientSex"),
        )

    def studies(self) -> DataFrame:
        return self.table("customer").select(
            F.col("c_custkey").alias("id"),
            F.col("c_nationkey").cast("bigint").alias("patient_ref"),
            F.col("c_name").alias("studyInstanceUID"),
            F.col("c_mktsegment").alias("studyDescription"),
            F.lit("").alias("studyDate"),
            F.col("c_custkey").cast("string").alias("studyID"),
            F.substring(F.md5("c_name"), 1, 16).alias("accessionNumber"),
            F.lit("").alias("patientAge"),
        )

    def series(self) -> DataFrame:
        def text(prefix: str, value: Column) -> Column:
            return F.concat(F.lit(prefix), value.cast("string"))

        order, cust = F.col("o_orderkey"), F.col("o_custkey")
        return self.table("orders").select(
            order.alias("id"),
            cust.alias("study_ref"),
            text("SE.", order).alias("seriesInstanceUID"),
            F.col("o_orderpriority").alias("seriesDescription"),
            F.date_format("o_orderdate", "yyyyMMdd").alias("seriesDate"),
            F.col("o_orderstatus").alias("modality"),
            text("P", order % 10).alias("protocolName"),
            text("B", order % 4).alias("bodyPartExamined"),
            text("M", cust % 6).alias("manufacturer"),
            text("S", cust % 12).alias("stationName"),
            text("FR.", cust).alias("frameOfReferenceUID"),
        )

    def arrivals(self, of_series: DataFrame | None = None) -> DataFrame:
        """Every arrival of an image, with the arrival order as a struct that compares left to right.  ``of_series`` adds columns by series_ref;
        texts and the order are built after that join, so what is shuffled are the columns as they came."""
        rows, more = self.table("lineitem"), []
        if of_series is not None:
            more = [c for c in of_series.columns if c != "series_ref"]
            rows = rows.join(of_series, F.col("l_orderkey") == F.col("series_ref")).drop("series_ref")
        return rows.select(
            (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"),
            F.col("l_orderkey").alias("series_ref"),
            F.concat_ws(".", F.lit("SO"), "l_orderkey", "l_linenumber").alias("sopInstanceUID"),
            F.concat("l_returnflag", F.lit("\\"), "l_linestatus").alias("imageType"),
            F.col("l_linenumber").cast("string").alias("instanceNumber"),
            F.col("l_shipdate").cast("date").alias("ship_date"),
            F.struct("l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice", "l_returnflag", "l_linestatus").alias(
                "arrival"
            ),
            "l_partkey",
            "l_suppkey",
            "l_quantity",
            *more,
        )

    def last_arrivals(self) -> DataFrame:
        """Last arrival per image, with keys and flags only.  The aggregate combines on the map side, so a hot series costs nothing extra."""
        order = ["l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice", "l_returnflag", "l_linestatus"]
        last = self.table("lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max(F.struct(*order)).alias("a"))
        return last.select("l_orderkey", "l_linenumber", "a.l_returnflag", "a.l_linestatus")

    def image_columns(self) -> dict[str, Column]:
        """Of an image, out of its last arrival; texts are built after shuffles, which keeps the shuffled rows short."""
        return {
            "id": F.col("l_orderkey") * 10 + F.col("l_linenumber"),
            "series_ref": F.col("l_orderkey"),
            "sopInstanceUID": F.concat_ws(".", F.lit("SO"), "l_orderkey", "l_linenumber"),
            "imageType": F.concat("l_returnflag", F.lit("\\"), "l_linestatus"),
            "instanceNumber": F.col("l_linenumber").cast("string"),
        }

    def images(self) -> DataFrame:
        return self.last_arrivals().select(*[c.alias(n) for n, c in self.image_columns().items()])

    def series_sources(self) -> DataFrame:
        key = F.col("o_orderkey")
        return self.table("orders").select(
            key.alias("id"),
            source_kind(key).alias("sourcetype"),
            F.concat(source_kind(key), (key % 7).cast("string")).alias("sourcename"),
            (key % 7).alias("sourceid"),
        )

    def series_tags(self) -> DataFrame:
        return constant_table(self.spark, V.SERIES_TAG_NAMES, {"id": "bigint", "name": "string"})

    def series_tag_links(self) -> DataFrame:
        flags = self.table("lineitem").select(F.col("l_orderkey").alias("series_id"), "l_returnflag").distinct()
        return flags.join(self.series_tags(), F.col("l_returnflag") == F.col("name")).select(
            "series_id", F.col("id").alias("tag_id")
        )

    def series_types(self) -> DataFrame:
        return constant_table(self.spark, V.SERIES_TYPE_NAMES, {"id": "bigint", "name": "string"})

    def series_type_links(self) -> DataFrame:
        part = self.table("part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_type").alias("name"))
        return (
            self.table("lineitem")
            .select(F.col("l_orderkey").alias("series_id"), "l_partkey")
            .join(part, "l_partkey")
            .join(self.series_types(), "name")
            .select("series_id", F.col("id").alias("type_id"))
            .distinct()
        )

    def catalogue(self) -> Catalogue:
        return Catalogue(
            patient=self.patients(),
            study=self.studies(),
            series=self.series(),
            image=self.images(),
            series_sources=self.series_sources(),
            series_tags=self.series_tags(),
            series_tag_links=self.series_tag_links(),
            series_types=self.series_types(),
            series_type_links=self.series_type_links(),
        )

    # -- attributes --------------------------------------------------------------------------------------------

    def flat_series(self, of_series: DataFrame | None = None) -> DataFrame:
        """Series with the properties of their study and patient; ``of_series`` adds columns by series_id."""
        series = self.series().withColumnRenamed("id", "series_id").withColumnRenamed("study_ref", "study_id")
        if of_series is not None:
            series = series.join(of_series, "series_id")
        series = series.join(self.studies().withColumnRenamed("id", "study_id").withColumnRenamed("patient_ref", "patient_id"), "study_id")
        return series.join(self.patients().withColumnRenamed("id", "patient_id"), "patient_id")

    def under_series(self, series: DataFrame, how: str = "inner") -> DataFrame:
        """Every image beside the columns of its series; its texts are built after the join, so what is shuffled are keys and flags."""
        joined = self.last_arrivals().join(series, F.col("l_orderkey") == F.col("series_id"), how)
        names = {"id": "image_id", "series_ref": "series_id"}
        columns = [c.alias(names.get(n, n)) for n, c in self.image_columns().items()]
        return joined.select(columns[1], columns[0], *columns[2:], *[c for c in series.columns if c != "series_id"])

    def flat_images(self, images: DataFrame | None = None, of_series: DataFrame | None = None) -> DataFrame:
        """One wide row per image with all promoted properties.  Levels are joined from the top, so images meet one join, on their series."""
        series = self.flat_series(of_series)
        if images is None:
            flat = self.under_series(series)
        else:
            flat = images.withColumnRenamed("id", "image_id").withColumnRenamed("series_ref", "series_id").join(series, "series_id")
        keys = ["patient_id", "study_id", "series_id"]
        return flat.select(*keys, *[c for c in flat.columns if c not in keys])

    def listed_flat_images(self) -> DataFrame:
        """Every image with all promoted properties; ``copy`` numbers the rows of an image, null where no series, study and patient is above it.
        Copies are numbered among the series, in the order their join needs, so images are not shuffled for it."""
        series = self.flat_series()
        copy = F.row_number().over(Window.partitionBy("series_id").orderBy(*[c for c in series.columns if c != "series_id"]))
        return self.under_series(series.withColumn("copy", copy), "left")

    def stored_listed_images(self) -> DataFrame:
        """The same for plans that read it several times: written once to the shared folder."""
        if self._listed is None:
            self._listed = materialise(self.listed_flat_images(), "flat_images")
        return self._listed

    def stored_flat_images(self) -> DataFrame:
        """``flat_images`` out of the stored ones."""
        return self.stored_listed_images().filter("copy IS NOT NULL").drop("copy")

    def records(self, images: DataFrame | None = None) -> Records:
        """Images with their elements; ``images`` are listed flat images, with more columns if need be."""
        copy = F.col("copy")
        return Records(self.listed_flat_images() if images is None else images, tuple(V.ELEMENTS), F.coalesce(copy, F.lit(1)) == 1, copy.isNotNull())

    def elements(self, images: DataFrame | None = None, paths: list[str] | None = None, keep: tuple[str, ...] = (),
                 of_series: DataFrame | None = None) -> DataFrame:
        """Element rows; ``of_series`` adds columns by series_id before the images are spread into elements."""
        wanted = [e for e in V.ELEMENTS if paths is None or e[0] in paths]
        return unpivot(self.flat_images(images, of_series), wanted, keep)

    def flat_records(self, of_series: DataFrame | None = None) -> Records:
        """The same elements as records: one for every row of the flat images."""
        return Records(self.flat_images(of_series=of_series), tuple(V.ELEMENTS), F.lit(True), F.lit(True))

    # -- rules and filters -------------------------------------------------------------------------------------

    def rules(self, nested: bool = False) -> DataFrame:
        rows = V.NESTED_RULES if nested else V.RULES
        return constant_table(self.spark, rows, {"type_id": "bigint", "rule_id": "bigint"})

    def rule_attributes(self, nested: bool = False) -> DataFrame:
        rows = V.NESTED_RULE_ATTRIBUTES if nested else V.RULE_ATTRIBUTES
        return constant_table(
            self.spark, rows, {"rule_id": "bigint", "tag": "string", "sequence": "string", "expected": "string"}
        )

    def tag_filters(self) -> DataFrame:
        return constant_table(self.spark, V.TAG_FILTERS, {"id": "bigint", "name": "string", "kind": "string"})

    def tag_filter_paths(self) -> DataFrame:
        return constant_table(
            self.spark, V.TAG_FILTER_PATHS, {"id": "bigint", "filter_id": "bigint", "path": "string"}
        )

    def source_tag_filters(self) -> DataFrame:
        return constant_table(
            self.spark, V.SOURCE_TAG_FILTERS, {"sourcetype": "string", "sourceid": "bigint", "filter_id": "bigint"}
        )

    def forwarding_rules(self) -> DataFrame:
        return constant_table(
            self.spark,
            V.FORWARDING_RULES,
            {"rule_id": "bigint", "sourcetype": "string", "sourceid": "bigint", "destinationtype": "string",
             "destinationid": "bigint", "keep_images": "boolean"},
        )

    # -- keys --------------------------------------------------------------------------------------------------

    def anon_keys(self, flat: DataFrame | None = None) -> DataFrame:
        """Two generations of keys for all images of a hash share of the patients, and for some images of the other patients, whose
        remaining images match a series, a study or a patient only."""
        some = F.col("imageType").startswith("A") & (F.col("studyDescription") == "FURNITURE") & (F.col("modality") == "F")
        keyed = (self.flat_images() if flat is None else flat).filter((F.substring(F.md5("patientID"), 1, 1) >= "a") | some)
        gen = F.col("created").cast("string")
        return keyed.withColumn("created", F.explode(F.array(F.lit(1).cast("bigint"), F.lit(2).cast("bigint")))).select(
            (F.col("image_id") * 10 + F.col("created")).alias("id"),
            "created",
            "image_id",
            "patientName", F.concat(F.lit("AN"), gen, F.lit("."), "patientID").alias("anonPatientName"),
            "patientID", F.concat(F.lit("AI"), gen, F.lit("."), "patientID").alias("anonPatientID"),
            "studyInstanceUID", F.concat(F.lit("AS"), gen, F.lit("."), "studyID").alias("anonStudyInstanceUID"),
            "seriesInstanceUID", F.concat(F.lit("AE"), gen, F.lit("."), "seriesInstanceUID").alias("anonSeriesInstanceUID"),
            "sopInstanceUID", F.concat(F.lit("AO"), gen, F.lit("."), "sopInstanceUID").alias("anonSOPInstanceUID"),
            "studyDescription", "protocolName", "studyID",
        )

    def anon_key_table(self, flat: DataFrame | None = None) -> DataFrame:
        return self.anon_keys(flat).drop("studyDescription", "protocolName", "studyID")

    def anon_key_values(self, flat: DataFrame | None = None) -> DataFrame:
        """Second-generation keys also hold values for two study attributes and one series attribute."""
        keys = self.anon_keys(flat).filter(F.col("created") == 2)
        pair = [("StudyDescription", "studyDescription"), ("StudyID", "studyID"), ("ProtocolName", "protocolName")]
        rows = F.array(
            *[
                F.struct(
                    F.lit(S.TAG_TEXT[k]).alias("tag_path"),
                    F.col(c).alias("value"),
                    F.concat(F.lit("anon "), F.col(c)).alias("anon_value"),
                )
                for k, c in pair
            ]
        )
        return keys.select(F.col("id").alias("key_id"), F.explode(rows).alias("v")).select("key_id", "v.*")

    # -- events ------------------------------------------------------------------------------------------------

    def events(self, frame: DataFrame | None = None) -> DataFrame:
        frame = self.table("events") if frame is None else frame
        return frame.withColumn("ts", F.col("ts").cast("timestamp"))

    def log(self, frame: DataFrame | None = None) -> DataFrame:
        kind = F.when(F.col("event_type") == "error", "ERROR").when(F.col("event_type") == "purchase", "WARN").when(
            F.col("event_type") == "signup", "INFO"
        ).otherwise("DEFAULT")
        return self.events(frame).select(
            F.col("event_id").alias("id"),
            F.unix_millis("ts").alias("created"),
            kind.alias("entry_type"),
            F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("subject"),
            F.col("props").alias("message"),
        )

    def image_added(self, frame: DataFrame | None = None) -> DataFrame:
        return self.events(frame).select(
            "event_id",
            F.expr("event_id % 500 + event_id div 10000 * 500").alias("image_id"),
            "ts",
            F.unix_millis("ts").alias("ts_ms"),
            source_kind(F.col("user_id")).alias("sourcetype"),
            (F.col("user_id") % 7).alias("sourceid"),
        )

    # -- transfers ---------------------------------------------------------------------------------------------

    def outgoing_images(self) -> DataFrame:
        return self.table("conversations").select(
            (F.col("conv_id") * 1000 + F.col("turn")).alias("id"),
            F.col("conv_id").alias("transaction_id"),
            (F.col("conv_id") * 10 + F.col("turn") % 7 + 1).alias("image_id"),
            (F.col("turn") + 1).alias("sequence"),
            (F.col("role") == "user").alias("sent"),
            "role",
        )

    def outgoing(self) -> DataFrame:
        """One transaction per conversation; counters come from its members."""
        done = F.coalesce(F.sum(F.when(F.col("sent"), 1)), F.lit(0)).cast("bigint")
        return (
            self.outgoing_images()
            .groupBy("transaction_id")
            .agg(
                F.count(F.lit(1)).alias("total"),
                done.alias("sent_count"),
                F.max("sequence").alias("last_sequence"),
                F.max(F.when(F.col("role") == "system", 1).otherwise(0)).alias("has_system"),
            )
            .select(
                F.col("transaction_id").alias("id"),
                (F.col("transaction_id") % 5).alias("box_id"),
                "total",
                "sent_count",
                (F.col("transaction_id") * 7 % 50).alias("created"),
                (F.lit(V.NOW_MS) - F.col("last_sequence") * 3000 - F.col("transaction_id") % 3).alias("updated"),
                F.when(F.col("has_system") == 1, "FAILED").when(F.col("sent_count") == 0, "WAITING")
                .otherwise("PROCESSING").alias("status"),
            )
        )

    def incoming_events(self, whole: DataFrame | None = None) -> DataFrame:
        """``whole`` is the table to count turns in, where the rows come as a stream."""
        talk = self.table("conversations")
        totals = (talk if whole is None else whole).groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"))
        return talk.join(totals, "conv_id").select(
            (F.col("conv_id") % 5).alias("box_id"),
            F.col("conv_id").alias("transaction_id"),
            (F.col("turn") + 1).alias("sequence"),
            F.when(F.col("role") != "system", F.col("conv_id") * 10 + F.col("turn") % 7 + 1).alias("image_id"),
            (F.col("role") == "user").alias("added"),
            # the sender may correct the total while it sends
            F.when(F.col("turn") == 1, F.lit(1).cast("bigint")).otherwise(F.col("turns") + F.col("conv_id") % 2).alias("total"),
            # eight are sent at a time, so they do not arrive in the order of their numbers
            ((F.col("turn") * 7 + F.col("conv_id")) % 10 * 1000 + F.col("turn")).alias("ts_ms"),
        )

    def import_log(self) -> DataFrame:
        """Arrivals as an import log: quantity 50 stands for a rejected file."""
        return self.arrivals().select(
            (F.col("series_ref") % 20).alias("session_id"),
            F.col("id").alias("image_id"),
            (F.col("l_quantity") == 50).alias("rejected"),
            "arrival",
            F.unix_millis(F.col("arrival.l_shipdate").cast("timestamp")).alias("ts_ms"),
        )

    def boxes(self) -> DataFrame:
        return self.table("region").select(
            F.col("r_regionkey").cast("bigint").alias("id"),
            F.col("r_name").alias("name"),
            F.when(F.col("r_regionkey") % 2 == 0, "POLL").otherwise("PUSH").alias("send_method"),
        )

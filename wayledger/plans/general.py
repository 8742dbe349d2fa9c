"""The queries p1_ to p5_ over the project's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayledger.functions.geo import coordinate
from wayledger.functions.text import number_key, settled, squash, strip_all
from wayledger.functions.times import epoch_ms
from wayledger.functions.zones import transitions, zone_version
from wayledger.operators.instants import EPOCH_MS, ISO_Z, instant_ms, known_zones, unusual_instants, with_feed_rules
from wayledger.operators.intervals import periods_and_gaps
from wayledger.operators.places import area, placed, regions_and_neighbours
from wayledger.operators.redelivery import admit_batch, deduplicated, redelivered
from wayledger.operators.snapshots import snapshot_changes
from wayledger.session import table


def _reports(spark: SparkSession, d: str) -> DataFrame:
    return settled(table(spark, d, "fixmystreet"), {"report_no": number_key("id"), "updated_at": F.trim("updated").try_cast("timestamp")})


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return redelivered(_reports(spark, d), "report_no", "updated_at", "delivery_id")


def p1_reports(spark: SparkSession, d: str) -> DataFrame:
    """The reports that remain."""
    return deduplicated(_reports(spark, d), "report_no", "updated_at", "delivery_id").select("delivery_id", "report_no", "batch_no", "title", "status")


def p1_new_batches(spark: SparkSession, d: str) -> DataFrame:
    """What the newest tenth of the batches adds to the identifiers stored from those before."""
    reports = _reports(spark, d).select("delivery_id", "batch_no", "report_no", "updated_at")
    cut = F.lit(reports.agg(F.floor(F.max("batch_no") * 0.9)).first()[0])
    stored, new = reports.where(F.col("batch_no") <= cut), reports.where(F.col("batch_no") > cut)
    return admit_batch(stored, new, "report_no", "updated_at", "delivery_id").select("delivery_id", "report_no")


def _register(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "roadworks")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    works = _register(spark, d)
    rows = works.select("snapshot_no", F.upper(strip_all("referenceno")).alias("referenceno"), F.lower(squash("worksstate")).alias("state"))
    return snapshot_changes(rows, works, "referenceno", "state", preferred="works started")


def p2_change_counts(spark: SparkSession, d: str) -> DataFrame:
    return p2_found(spark, d).groupBy("snapshot_no", "change_kind").agg(F.count("*").alias("n"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    feeds = table(spark, d, "feeds")
    tables = known_zones(feeds)
    rows = _register(spark, d).select(F.lower(squash("linkname")).alias("road"), "feed", "validfrom", "validto").where("road <> '' and validfrom is not null and validto is not null")
    rows = with_feed_rules(rows.distinct(), feeds)  # the same times stand in snapshot after snapshot; each is read once
    rows = rows.select("road", *[instant_ms(F.col(c), F.col("_zone"), F.col("_day_first"), tables).alias(c) for c in ("validfrom", "validto")])
    return periods_and_gaps(rows, "road", "validfrom", "validto").withColumnRenamed("entity", "road")


def p3_layer_spans(spark: SparkSession, d: str) -> DataFrame:
    """The same over the highways layer, whose times are timestamps."""
    rows = table(spark, d, "road_status").select(F.lower(squash("road")).alias("road"), epoch_ms("start_date").alias("a"), epoch_ms("end_date").alias("b")).where("road <> ''")
    return periods_and_gaps(rows, "road", "a", "b").withColumnRenamed("entity", "road")


def _places(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    divisions = table(spark, d, "burnley_ceds")
    counts = table(spark, d, "count_points").select(F.col("count_point_id").cast("string").alias("target"), F.col("latitude").try_cast("double").alias("clat"), F.col("longitude").try_cast("double").alias("clng"))
    corners = divisions.select(F.explode("coordinates").alias("v")).select(F.col("v")[1].alias("lat"), F.col("v")[0].alias("lng"))
    box = area([corners, counts.select(F.col("clat").alias("lat"), F.col("clng").alias("lng"))])
    reports = table(spark, d, "fixmystreet").select("delivery_id", "lat", "lng")
    reports = placed(reports, coordinate("lat"), coordinate("lng"), box).where("lat is not null")
    return reports, divisions, counts


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    reports, divisions, counts = _places(spark, d)
    others = counts.select("target", F.col("clat").alias("olat"), F.col("clng").alias("olng"))
    found = regions_and_neighbours(reports, divisions, "ons_code", "coordinates", others, "target", 150.0)
    return found.select("delivery_id", F.when(F.col("target_kind") == "region", "division").otherwise("count_point").alias("target_kind"), "target")


def p4_division_counts(spark: SparkSession, d: str) -> DataFrame:
    return p4_found(spark, d).groupBy("target_kind", "target").agg(F.count("*").alias("n"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    feeds = table(spark, d, "feeds")
    works = unusual_instants(_register(spark, d), feeds, "row_id", {"validfrom": EPOCH_MS, "creationtime": EPOCH_MS}, src_table="roadworks")
    reports = unusual_instants(table(spark, d, "fixmystreet"), feeds, "delivery_id", {"reported": ISO_Z}, src_table="fixmystreet")
    return works.unionByName(reports)


def p5_forms(spark: SparkSession, d: str) -> DataFrame:
    """Per field: values, those in the usual form, those read from another form, and those that denote no instant."""
    fields = (("roadworks", "validfrom", EPOCH_MS), ("roadworks", "creationtime", EPOCH_MS), ("fixmystreet", "reported", ISO_Z))
    counts = [table(spark, d, t).agg(F.lit(t).alias("src_table"), F.lit(f).alias("field_name"), F.count(f).alias("in_all"), F.count_if(F.col(f).rlike(usual)).alias("usual")) for t, f, usual in fields]
    found = p5_found(spark, d).groupBy("src_table", "field_name").agg(F.count("*").alias("other_form"))
    out = counts[0].unionByName(counts[1]).unionByName(counts[2]).join(found, ["src_table", "field_name"], "left").na.fill(0, ["other_form"])
    return out.withColumn("none", F.col("in_all") - F.col("usual") - F.col("other_form"))


def p5_zones(spark: SparkSession, d: str) -> DataFrame:
    """The zone transition tables in use: version, zone, instant of change (null before the first) and offset in seconds.
    Names that are no zone have none."""
    names = sorted(known_zones(table(spark, d, "feeds")))
    rows = [(zone_version(), n, None if i == 0 else int(at[i - 1]), int(o)) for n in names for at, offsets in [transitions(n)] for i, o in enumerate(offsets)]
    return spark.createDataFrame(rows, "tz_version string, zone_name string, from_utc_s long, offset_s long")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p1_found, p1_reports, p1_new_batches, p2_found, p2_change_counts, p3_found, p3_layer_spans, p4_found, p4_division_counts, p5_found, p5_forms, p5_zones)
}

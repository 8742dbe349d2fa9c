"""Queries for the analytics over works, reports, the highways layer and count points, and over the star-schema tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayledger.functions import rules
from wayledger.functions.geo import haversine_m
from wayledger.functions.text import source_key, squash
from wayledger.functions.times import calendar_days, epoch_ms, epoch_s, floor_days
from wayledger.operators import aggregate, cluster, dedupe, rank, spatial, temporal
from wayledger.operators.instants import instant_ms, known_zones, with_feed_rules
from wayledger.operators.redelivery import ranked_first
from wayledger.session import broadcast_if_small, table, use_checkpoints

#: The day that counts as today: 2026-03-01, and the star schema's 2000-01-01.
AS_OF_DAY, STAR_DAY = 20513, 10957
AS_OF_MS = AS_OF_DAY * temporal.DAY
TOWNS = {"Brookhale": "brookhale", "Penny Moss": "marlbeck", "Rosewick": "rosewick", "Hyndmere": "hyndmere"}
TERMS = [("Spring term", 20459, 20543), ("Summer term", 20556, 20654), ("Autumn term", 20332, 20439)]
#: Share of a day's movement by hour.
PROFILE = [1, 1, 1, 1, 2, 3, 6, 9, 10, 7, 6, 6, 6, 6, 7, 8, 9, 10, 8, 6, 4, 3, 2, 1]
KINDS = {"Open": (300.0, 2.0), "Closed": (800.0, 8.0), "Restricted": (500.0, 5.0)}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def works(spark: SparkSession, d: str) -> DataFrame:
    """The register flattened: texts trimmed with '' for missing, times of every form in epoch milliseconds (null where
    none is denoted), blank severity as unknown, the flag as a boolean."""
    feeds = table(spark, d, "feeds")
    tables = known_zones(feeds)
    t = with_feed_rules(table(spark, d, "roadworks"), feeds)
    text = lambda c: F.coalesce(F.trim(F.col(c)), F.lit(""))
    ms = lambda c: instant_ms(F.col(c), F.col("_zone"), F.col("_day_first"), tables)
    return t.select(
        F.col("row_id").alias("id"),
        "snapshot_no",
        text("linkname").alias("road"),
        rules.strip_suffix(text("areaname"), " Ward").alias("ward"),
        rules.mapped(text("townname"), TOWNS).alias("district"),
        F.col("geometry.y").alias("lat"),
        F.col("geometry.x").alias("lng"),
        ms("validfrom").alias("start_ms"),
        ms("validto").alias("end_ms"),
        ms("creationtime").alias("created_ms"),
        text("organisation").alias("operator"),
        F.lower(squash(F.coalesce("worksstate", F.lit("")))).alias("status"),
        text("workscategory").alias("category"),
        F.coalesce(F.nullif(F.lower(text("severity")), F.lit("")), F.lit("unknown")).alias("severity"),
        text("networkmanagement").alias("restrictions"),
        F.upper(text("referenceno")).alias("reference"),
        (F.lower(text("urgent")) == "true").alias("urgent"),
        text("publiccomment").alias("description"),
        text("managementtype").alias("management"),
        text("trafficconstriction").alias("constriction"),
        text("impactdelays").alias("impact"),
    )


STARTED = "works started"


def live(w: DataFrame) -> DataFrame:
    """The works of the newest snapshot, one row each: of a reference the started one, else the first; without a reference
    the first of a road, operator, start and end."""
    newest = w.where(F.col("snapshot_no") == F.lit(w.agg(F.max("snapshot_no")).first()[0]))
    return dedupe.keep_preferred(newest, "reference", ["road", "operator", "start_ms", "end_ms"], F.col("status") == STARTED, [F.col("id")])


def _keyed(w: DataFrame) -> DataFrame:
    return w.withColumn("key", dedupe.snapshot_key("reference", ["road", "operator", "start_ms"]))


def register(spark: SparkSession, d: str) -> DataFrame:
    """One row a work, the one of the newest snapshot that holds it (a started one before others, of a reference the first
    row, without one the last), with active, completed_ms (the time of the first snapshot without it) and actual_days."""
    w = _keyed(works(spark, d)).where("snapshot_no is not null")
    at = table(spark, d, "roadworks").where("snapshot_no is not null").groupBy("snapshot_no").agg(F.max(epoch_ms("snapshot_at")).alias("_at"))
    later = at.select("snapshot_no", F.lead("_at").over(Window.orderBy("snapshot_no")).alias("completed_ms"), F.lead("snapshot_no").over(Window.orderBy("snapshot_no")).isNull().alias("active"))  # a row a snapshot
    order = [F.desc("snapshot_no"), (F.col("status") == STARTED).desc(), F.when(F.col("reference") != "", F.col("id")).otherwise(-F.col("id"))]
    one = ranked_first(w, "key", order).join(broadcast_if_small(later, 100_000), "snapshot_no")
    return one.withColumn("actual_days", floor_days(F.col("completed_ms") / 1000, F.col("start_ms") / 1000))


def register_day_ms(spark: SparkSession, d: str) -> int:
    """The time of the newest snapshot, which counts as now for the register."""
    return table(spark, d, "roadworks").agg(F.max(epoch_ms("snapshot_at"))).first()[0] or 0


def _days() -> F.Column:
    return floor_days(F.col("end_ms") / 1000, F.col("start_ms") / 1000)


def _layer(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "road_status").select("row_id", F.col("lat").alias("olat"), F.col("lng").alias("olng"), F.initcap(F.trim("status")).alias("kind"))


def _counters(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "count_points").select("count_point_id", F.col("latitude").try_cast("double").alias("lat"), F.col("longitude").try_cast("double").alias("lng"), "all_motor_vehicles", "road_name")


# ---- projections, filters, labels


@query
def works_flat(spark, d):
    return works(spark, d).select("id", "road", "ward", "district", "start_ms", "end_ms", "severity", "urgent", "reference")


@query
def restriction_labels(spark, d):
    w = works(spark, d)
    kind = rules.first_rule([(F.lower("restrictions").contains("closed"), "full"), (F.lower("restrictions").contains("lane"), "lane"), (F.lower("restrictions").contains("light"), "lights")], "minor")
    return w.select("id", rules.camel_words("restrictions").alias("label"), kind.alias("kind"), rules.tier(_days(), [(30, "long"), (7, "medium")], "short").alias("length"), rules.duration_label(_days()).alias("duration"))


@query
def keyword_flags(spark, d):
    docs = table(spark, d, "documents")
    words = ["bridge", "drain", "lights", "diversion"]
    return docs.select("doc_id", rules.any_keyword("text", words).alias("any_hit"), rules.keyword_hits("text", words).alias("hits"), rules.either_contains("road", "topic").alias("alike"), rules.is_postcode("topic").alias("postcode"))


@query
def field_fallback(spark, d):
    t = table(spark, d, "count_points")
    return t.select("count_point_id", rules.first_of("start_junction_road_name", "end_junction_road_name", "road_name").alias("name"))


@query
def reading_time(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("doc_id", rules.word_count("text").cast("long").alias("words"), rules.reading_minutes("text").alias("minutes"))


@query
def stripped_markup(spark, d):
    return table(spark, d, "documents").where(F.col("text").contains("<")).select("doc_id", F.length(rules.strip_tags("text")).cast("long").alias("n"), F.length(rules.xml_escape("text")).cast("long").alias("escaped"))


@query
def json_props(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", F.get_json_object("props", "$.k").try_cast("long").alias("k"), F.from_json("props", "k int").getField("k").cast("long").alias("k2"))


@query
def strict_and_inclusive_boxes(spark, d):
    r = table(spark, d, "road_status")
    strict = (F.col("lat") > 53.05) & (F.col("lat") < 53.15) & (F.col("lng") > -1.6) & (F.col("lng") < -1.45)
    return r.where(aggregate.valid_place("lat", "lng")).select("row_id", strict.alias("strict"), (F.col("lat").between(53.05, 53.15) & F.col("lng").between(-1.6, -1.45)).alias("inclusive"))


@query
def days_between(spark, d):
    r = table(spark, d, "road_status").where("start_date is not null")
    return r.select("row_id", floor_days(epoch_s("end_date"), epoch_s("start_date")).alias("floor_days"), calendar_days("end_date", "start_date").alias("calendar_days"))


@query
def not_finished(spark, d):
    w = works(spark, d)
    return w.where(F.col("end_ms").isNull() | (temporal.day_of("end_ms") >= AS_OF_DAY)).select("id", "road")


@query
def layer_places(spark, d):
    """Middle vertices of polylines made from each division's ring."""
    c = table(spark, d, "burnley_ceds")
    return c.select("ons_code", rules.middle("coordinates")[0].alias("lng"), rules.middle("coordinates")[1].alias("lat"), F.size("coordinates").cast("long").alias("vertices"))


@query
def ring_means(spark, d):
    """Mean vertices of the rings, and the window around each."""
    c = table(spark, d, "burnley_ceds")
    side = lambda k, f: f(F.transform("coordinates", lambda v: v[k]))
    w = rules.focus_window(side(0, F.array_min), side(0, F.array_max), side(1, F.array_min), side(1, F.array_max))
    m = rules.mean_vertex("coordinates", 4)
    return c.select("ons_code", m[0].alias("lng"), m[1].alias("lat"), F.round(w["west"], 6).alias("west"), F.round(w["north"], 6).alias("north"))


@query
def svg_paths(spark, d):
    """Rings as drawing paths: a linear map of the area to 100 x 100."""
    c = table(spark, d, "burnley_ceds").select("ons_code", F.posexplode("coordinates").alias("i", "v"))
    part = F.concat(F.round((F.col("v")[0] + 2.0) * 100.0).cast("int").cast("string"), F.lit(","), F.round((53.5 - F.col("v")[1]) * 100.0).cast("int").cast("string"))
    return c.groupBy("ons_code").agg(F.concat(F.lit("M"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", part.alias("p")))), lambda x: x["p"]), " L"), F.lit("Z")).alias("path"))  # a list a ring


# ---- grouped analytics


@query
def operator_league(spark, d):
    """Works that left the register count as completed; they overran if that took longer than planned."""
    over = F.coalesce((_days() > 0) & (F.col("actual_days") > _days()), F.lit(False))
    return aggregate.league(register(spark, d), "operator", F.col("active"), _days(), over, F.col("severity") == "high", "district").orderBy(F.desc("total"), "operator")


@query
def district_volume(spark, d):
    """Live works, works completed in the last 30 and 90 days and the trend, for each district."""
    w = register(spark, d).withColumn("district", F.coalesce(F.nullif("district", F.lit("")), F.lit("unknown")))
    ago = floor_days(F.lit(register_day_ms(spark, d) / 1000), F.col("completed_ms") / 1000)
    return aggregate.volume_trend(w, "district", ago, F.col("active"))


@query
def severity_trends(spark, d):
    """Works by severity: live ones and those completed in the last 30 days."""
    ago = floor_days(F.lit(register_day_ms(spark, d) / 1000), F.col("completed_ms") / 1000)
    return register(spark, d).groupBy("severity").agg(F.count_if("active").alias("current"), F.count_if(~F.col("active") & (ago <= 30)).alias("completed_30d"))


@query
def supplier_league(spark, d):
    """The same league over the star schema: suppliers' nations by order lines."""
    l, o = table(spark, d, "lineitem"), table(spark, d, "orders")
    s, n = table(spark, d, "supplier"), table(spark, d, "nation")
    j = l.join(o, l.l_orderkey == o.o_orderkey).join(s, l.l_suppkey == s.s_suppkey).join(n, s.s_nationkey == n.n_nationkey)
    planned = (F.col("o_orderkey") % 40).cast("long")
    return aggregate.league(j, "n_name", F.col("o_orderstatus") == "O", planned, F.col("l_shipdate") > F.col("o_orderdate"), F.col("o_orderpriority") == "1-URGENT", "o_custkey")


@query
def group_counts_default(spark, d):
    t = table(spark, d, "fixmystreet")
    return aggregate.group_counts(t, "ward").withColumnRenamed("ward", "key")


@query
def category_counts(spark, d):
    return aggregate.group_counts(table(spark, d, "fixmystreet"), "service_code", "Other").withColumnRenamed("service_code", "key")


@query
def district_pivot_counts(spark, d):
    w = live(works(spark, d))
    return aggregate.pivot_counts(w, "district", {"started": F.col("status") == "works started", "planned": F.col("status") == "works planned", **{s: F.col("severity") == s for s in ("high", "medium", "low")}})


@query
def volume_trend(spark, d):
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return aggregate.volume_trend(o, "c_mktsegment", F.lit(STAR_DAY) - F.floor(epoch_s("o_orderdate") / 86400), F.col("o_orderstatus") == "O")


@query
def severity_zero_filled(spark, d):
    return aggregate.zero_filled(live(works(spark, d)), "severity", ["high", "medium", "low", "unknown", "none"])


@query
def duration_stats(spark, d):
    """Planned days of all works, live and gone, by category and together."""
    return aggregate.duration_stats(register(spark, d).withColumn("days", _days()), "days", "category")


@query
def longest_running(spark, d):
    """The 20 live works that began longest ago, over 90 days at least."""
    w = live(works(spark, d)).withColumn("days", floor_days(F.lit(register_day_ms(spark, d) / 1000), F.col("start_ms") / 1000)).where("days > 90")
    return rank.top_n(w, 20, [F.desc("days"), F.col("id")]).select("id", "road", "days")


@query
def overdue(spark, d):
    """The 30 longest overdue works and the true count of all."""
    w = live(works(spark, d)).where(F.col("end_ms") < AS_OF_MS).withColumn("days_overdue", floor_days(F.lit(AS_OF_MS / 1000), F.col("end_ms") / 1000))
    return rank.top_n(w, 30, [F.desc("days_overdue"), F.col("id")]).select("id", "days_overdue", F.lit(w.count()).cast("long").alias("overdue_count"))


@query
def distinct_areas(spark, d):
    return works(spark, d).agg(F.countDistinct("district").alias("districts"), F.countDistinct("ward").alias("wards"), F.countDistinct("operator").alias("operators"))


@query
def argmax_latest(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", epoch_s("o_orderdate").alias("at"))
    return aggregate.arg_max(o, "o_custkey", "at", "o_orderkey")


@query
def busiest_counter_by_road(spark, d):
    c = table(spark, d, "count_points").select("road_name", "count_point_id", "all_motor_vehicles")
    return rank.top_n(aggregate.arg_max(c, "road_name", "all_motor_vehicles", "count_point_id"), 20, [F.desc("all_motor_vehicles"), F.col("road_name")])


@query
def place_bounds(spark, d):
    return aggregate.bounds(table(spark, d, "road_status"), "lat", "lng")


@query
def nearest_rank_95(spark, d):
    w = works(spark, d).where("end_ms is not null")
    return aggregate.nearest_rank(w.select(temporal.day_of("end_ms").alias("day")), "day", 0.95)


@query
def size_histogram(spark, d):
    return table(spark, d, "part").groupBy(F.trim(F.regexp_replace("p_type", "(?i)brushed", "")).alias("zone")).agg(F.count("*").alias("n"))


@query
def worst_by_road(spark, d):
    w = live(works(spark, d))
    return w.groupBy("road").agg(F.bool_or(F.lower("restrictions").contains("closed")).alias("any_full"), F.bool_or(F.lower("restrictions").contains("lane")).alias("any_lane"), F.count("*").alias("n"))


@query
def headline(spark, d):
    w, r = works(spark, d), table(spark, d, "fixmystreet")
    b = r.agg(F.count("*"), F.count_if(F.col("status") == "open")).first()
    c = table(spark, d, "count_points").count()
    a = w.agg(F.count("*").alias("works"), F.count_if(F.col("severity") == "high").alias("high"), F.count_if("urgent").alias("urgent"))
    return a.withColumns({"reports": F.lit(b[0]).cast("long"), "open_reports": F.lit(b[1]).cast("long"), "counters": F.lit(c).cast("long")})


@query
def layer_totals(spark, d):
    r = table(spark, d, "road_status")
    return r.groupBy("layer", F.initcap(F.trim("status")).alias("status")).agg(F.count("*").alias("n"))


@query
def source_freshness(spark, d):
    ms = lambda t, c: (table(spark, d, t), epoch_ms(c))
    return aggregate.freshness({"reports": ms("fixmystreet", "received_at"), "works": ms("roadworks", "received_at"), "documents": ms("documents", "published")}, F.lit(AS_OF_MS))


@query
def share_of_tokens(spark, d):
    docs = table(spark, d, "documents").select(source_key("source").alias("source"), "n_chars")
    return aggregate.share_of_total(docs, "source", "n_chars")


@query
def weighted_score(spark, d):
    c = table(spark, d, "count_points")
    volume = F.coalesce(F.col("all_motor_vehicles") / 300.0, F.lit(10.0))
    score = rules.weighted([(volume, 0.6), (F.when(F.col("road_type") == "Major", 100.0).otherwise(30.0), 0.4)])
    return c.select("count_point_id", score.alias("score")).withColumn("level", rules.tier("score", [(70, "critical"), (50, "high"), (30, "medium")], "low"))


# ---- one of several rows, differences, unions


@query
def dedupe_first(spark, d):
    l = table(spark, d, "lineitem")
    order = [F.col(c) for c in l.columns]
    return dedupe.keep_first(l, ["l_orderkey", "l_linenumber"], order).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")


@query
def dedupe_preferred(spark, d):
    w = works(spark, d).where("road <> ''")
    return dedupe.keep_preferred(w, "reference", ["road", "operator", "start_ms", "end_ms"], F.col("status") == "works started", [F.col("id")]).select("id", "reference")


@query
def snapshot_archive(spark, d):
    """What the register lost from the last snapshot but one to the newest, and isn't archived: works count as archived
    that vanished from any snapshot to the next one before. Of a key's rows the last counts."""
    w = _keyed(works(spark, d))
    nos = w.where("snapshot_no is not null").select("snapshot_no").distinct().withColumn("age", F.row_number().over(Window.orderBy(F.desc("snapshot_no"))))  # a row a snapshot
    w = w.join(F.broadcast(nos), "snapshot_no")
    return dedupe.archive_additions(w.where("age = 2"), w.where("age = 1"), dedupe.vanished(w, "key", "age").where("age >= 3"), "key", [F.desc("id")]).select("id", "key")


@query
def fallback_union(spark, d):
    s, c = table(spark, d, "supplier"), table(spark, d, "customer")
    first = s.select(F.col("s_nationkey").alias("k"), F.col("s_name").alias("name"))
    return dedupe.with_fallback(first, c.select(F.col("c_nationkey").alias("k"), F.col("c_name").alias("name")), "k")


@query
def fill_missing(spark, d):
    c = table(spark, d, "count_points").select("count_point_id", "road_name", "start_junction_road_name")
    other = c.groupBy("road_name").agg(F.min(F.nullif(F.trim("start_junction_road_name"), F.lit(""))).alias("start_junction_road_name"))
    return dedupe.fill_missing(c, other, "road_name", ["start_junction_road_name"])


@query
def union_states(spark, d):
    w = live(works(spark, d)).select("id", "status")
    return dedupe.union_all(w.where("status = 'works started'"), w.where("status = 'works planned'"))


# ---- sorts, pages, filters


@query
def severity_sort_topn(spark, d):
    w = works(spark, d)
    return rank.top_n(w, 25, [rank.severity_rank("severity"), F.col("district"), F.col("road"), F.col("id")]).select("id", "severity", "district", "road")


@query
def facet_page(spark, d):
    w = works(spark, d)
    return rank.facet_query(w, {"severity": "high", "district": "all"}, road="road", window=(AS_OF_MS - 90 * temporal.DAY, AS_OF_MS), sort="start", number=2, size=15).select("id", "road", "start_ms")


@query
def facet_hour(spark, d):
    return rank.facet_query(works(spark, d), {"status": STARTED}, day=AS_OF_DAY, hour=8, sort="road").select("id", "road")


@query
def facet_sorted(spark, d):
    return rank.facet_query(works(spark, d), sort="duration", number=3).select("id")


@query
def featured_or_latest(spark, d):
    docs = table(spark, d, "documents")
    return rank.first_or_newest(docs, (F.col("topic") == "closures") & (F.col("n_chars") > 5000), F.col("published"), "doc_id").select("doc_id")


@query
def all_but_featured(spark, d):
    docs = table(spark, d, "documents")
    one = rank.first_or_newest(docs, F.lit(False), F.col("published"), "doc_id")
    return rank.all_but(docs, one, "doc_id").select("doc_id")


@query
def road_search(spark, d):
    """The first work on a road by part of its name."""
    return rank.top_n(works(spark, d).where(F.contains(F.lower("road"), F.lit("bramble"))), 1, [F.col("id")]).select("id", "road", "lat", "lng")


# ---- times


@query
def active_on_day(spark, d):
    return works(spark, d).where(temporal.active_on("start_ms", "end_ms", AS_OF_DAY)).select("id", "road")


@query
def hourly_strip(spark, d):
    """Works active at each hour of a day, the bar's height between the quietest and the busiest hour, and the first peak."""
    w = live(works(spark, d)).where(temporal.active_on("start_ms", "end_ms", AS_OF_DAY))
    return temporal.hourly_bars(temporal.hourly_counts(w, "start_ms", "end_ms"))


@query
def daily_density(spark, d):
    return temporal.daily_counts(works(spark, d), "start_ms", "end_ms", AS_OF_DAY - 89, 90)


@query
def stacked_90d(spark, d):
    w = works(spark, d).where("severity in ('high', 'medium', 'low', 'unknown')")
    return temporal.stacked(temporal.daily_counts(w, "start_ms", "end_ms", AS_OF_DAY - 89, 90, "severity"), "severity", ["high", "medium", "low", "unknown"])


@query
def term_lookup(spark, d):
    w = works(spark, d).select("id", temporal.day_of("start_ms").alias("day"))
    return temporal.in_ranges(w, "day", TERMS, "School holiday").select("id", "term")


@query
def overlap_pairs(spark, d):
    r = table(spark, d, "road_status").select("row_id", F.lower(squash("road")).alias("road"), epoch_ms("start_date").alias("s"), epoch_ms("end_date").alias("t"))
    return temporal.overlap_pairs(r, "row_id", "road", "s", "t")


@query
def clash_rollup(spark, d):
    """Roads by how many pairs of their rows overlap, and the first row of a pair. Pairs are counted, not formed; the first
    row of a pair is the smallest that overlaps any other."""
    r = table(spark, d, "road_status").select("row_id", F.lower(squash("road")).alias("road"), F.coalesce(epoch_ms("start_date"), F.lit(-(1 << 60))).alias("s"), F.coalesce(epoch_ms("end_date"), F.lit(1 << 60)).alias("t")).where("road is not null and s <= t")
    n = spatial.overlap_counts(r, "road", "s", "t", 32 * temporal.DAY).where("pairs > 0").join(temporal.overlapping(r, "road", "s", "t").groupBy("road").agg(F.min("row_id").alias("first")), "road")
    return n.withColumn("level", rules.tier("pairs", [(50, "breach"), (10, "coordination"), (3, "monitor")], "none"))


@query
def first_event_in_works(spark, d):
    """For each work the first count of a match day (Saturdays of the window) that falls into it."""
    days = spark.range(20514, 20514 + 70, 7).select((F.col("id") * temporal.DAY).alias("at_ms"), F.col("id").alias("day"))
    w = works(spark, d).select("id", "start_ms", "end_ms")
    return temporal.first_in_interval(w, "id", "start_ms", "end_ms", days, "at_ms", "day").select("id", "day")


@query
def heatmap_7x24(spark, d):
    extra = spark.createDataFrame([(AS_OF_DAY + 6, 15, 4.0), (AS_OF_DAY + 6, 16, 2.5)], "day long, hour int, extra double")
    return temporal.heatmap(live(works(spark, d)), "start_ms", "end_ms", AS_OF_DAY, PROFILE, overlays=extra)


@query
def heatmap_peaks(spark, d):
    return temporal.peak_hours(heatmap_7x24(spark, d)).select("day", "peak_hour", "peak_flow")


@query
def running_offset(spark, d):
    l = table(spark, d, "documents").select(source_key("source").alias("source"), "doc_id", "n_chars")
    return temporal.running_offset(l, "source", "doc_id", "n_chars").select("doc_id", "offset")


# ---- places


@query
def radius_count(spark, d):
    c = _counters(spark, d)
    return spatial.radius_summary(c, "count_point_id", _layer(spark, d), 500.0, {"n": F.lit(1)}).select("count_point_id", F.col("n").cast("long").alias("n"))


@query
def radius_weighted(spark, d):
    c = _counters(spark, d)
    out = spatial.radius_summary(c, "count_point_id", _layer(spark, d), 1000.0, {"w": spatial.falling_weight(1000.0) * 100.0, "closed": (F.col("kind") == "Closed").cast("int")})
    return out.select("count_point_id", F.round("w", 3).alias("w"), F.col("closed").cast("long").alias("closed"))


@query
def kind_scores(spark, d):
    return spatial.kind_points(_counters(spark, d), "count_point_id", _layer(spark, d), KINDS).select("count_point_id", F.least(F.col("score"), F.lit(100.0)).alias("score"))


@query
def nearest_counter(spark, d):
    r = table(spark, d, "road_status").select("row_id", "lat", "lng")
    c = _counters(spark, d).where("all_motor_vehicles > 0").select("count_point_id", F.col("lat").alias("olat"), F.col("lng").alias("olng"))
    return spatial.nearest_within(r, "row_id", c, 1500.0, "count_point_id").select("row_id", "count_point_id", F.round("distance_m", 3).alias("distance_m"))


@query
def first_counter(spark, d):
    r = table(spark, d, "road_status").select("row_id", "lat", "lng")
    c = _counters(spark, d).select("count_point_id", F.col("lat").alias("olat"), F.col("lng").alias("olng"))
    return spatial.first_within(r, "row_id", c, 800.0, "count_point_id").select("row_id", "count_point_id")


@query
def semi_near(spark, d):
    return spatial.any_within(_counters(spark, d), "count_point_id", _layer(spark, d).where("kind = 'Closed'"), 800.0)


@query
def spatiotemporal_pairs(spark, d):
    r = table(spark, d, "road_status").select("row_id", "lat", "lng", epoch_ms("start_date").alias("s"), epoch_ms("end_date").alias("t"))
    return spatial.near_in_time(r, "row_id", "s", "t", 400.0)


@query
def first_division(spark, d):
    r = table(spark, d, "road_status").select("row_id", "lat", "lng")
    divisions = table(spark, d, "burnley_ceds").select("ons_code", "coordinates", F.substring("ons_code", 4, 6).alias("ord"))
    return spatial.first_region(r, "row_id", divisions, "ons_code", "coordinates", "ord")


@query
def point_distances(spark, d):
    c = _counters(spark, d)
    return c.select("count_point_id", F.round(haversine_m(F.col("lat"), F.col("lng"), F.lit(53.1), F.lit(-1.55)), 3).alias("distance_m"))


@query
def counters_with_volume(spark, d):
    """Counters with the newest volume of their road joined on, left outer."""
    c = table(spark, d, "count_points").select("count_point_id", "road_name")
    best = aggregate.arg_max(table(spark, d, "count_points").select("road_name", F.col("count_point_id").alias("from_point"), "all_motor_vehicles"), "road_name", "all_motor_vehicles", "from_point")
    return c.join(best, "road_name", "left").select("count_point_id", "from_point", F.col("all_motor_vehicles").cast("long").alias("volume"))


@query
def greedy_cluster(spark, d):
    return cluster.greedy_clusters(_counters(spark, d), "count_point_id", 400.0)


@query
def greedy_cluster_3(spark, d):
    """Clusters of three and more count points."""
    return cluster.greedy_clusters(_counters(spark, d), "count_point_id", 600.0, least=3)


@query
def hotspots(spark, d):
    """Clusters and direct kinds with the places of the layer near them, in order of rank."""
    use_checkpoints(spark)
    c = cluster.greedy_clusters(_counters(spark, d), "count_point_id", 600.0, least=3).select(F.lit("cluster").alias("kind"), F.col("cluster").alias("id"), "lat", "lng", F.lit(1).alias("rank"))
    m = _counters(spark, d).where("road_name like 'M%'").select(F.lit("motorway").alias("kind"), F.col("count_point_id").alias("id"), "lat", "lng", F.lit(0).alias("rank"))
    spots = c.unionByName(m).withColumn("key", F.concat_ws(":", "kind", F.col("id").cast("string"))).checkpoint()
    near = spatial.radius_summary(spots, "key", _layer(spark, d), 500.0, {"nearby": F.lit(1)})
    return spots.join(near, "key").select("kind", "id", "rank", F.round("lat", 6).alias("lat"), F.round("lng", 6).alias("lng"), F.col("nearby").cast("long").alias("nearby")).orderBy("rank", "kind", "id")


@query
def junction_index(spark, d):
    """A composed index of count points: volume, nearby layer rows by distance, closures, and kinds with their own radius."""
    c = _counters(spark, d)
    near = spatial.radius_summary(c, "count_point_id", _layer(spark, d), 500.0, {"w": spatial.falling_weight(500.0) * 100.0, "closed": (F.col("kind") == "Closed").cast("int")})
    kinds = spatial.kind_points(c, "count_point_id", _layer(spark, d), KINDS)
    j = c.join(near, "count_point_id").join(kinds, "count_point_id")
    volume = F.coalesce(F.col("all_motor_vehicles") / 300.0, F.lit(20.0) * 0.75)
    score = rules.weighted([(volume, 0.4), (F.col("w"), 0.3), (F.col("closed") * 30.0, 0.2), (F.col("score"), 0.1)], 1)
    return j.select("count_point_id", score.alias("index")).withColumn("level", rules.tier("index", [(70, "critical"), (50, "high"), (30, "medium")], "low"))


# ---- tags, corridors, events

#: Capacity that works take from a road, by what is said of them (fixed values); the first that holds counts.
def _restriction() -> list[tuple[F.Column, str, float]]:
    c, m, r, i = (F.lower(x) for x in ("constriction", "management", "restrictions", "impact"))
    lights = r == "temporarytrafficlights"
    lanes = (c == "lanesblocked") | (m == "laneclosures")
    return [
        ((c == "roadblocked") | (m == "roadclosed"), "full_closure", 1.0),
        (lanes & lights, "lane_restriction", 0.6),
        (lanes, "lane_restriction", 0.4),
        (lights, "lane_restriction", 0.5),
        ((i == "verylongdelays") & (F.col("severity") == "high"), "lane_restriction", 0.4),
        (i.isin("longdelays", "verylongdelays"), "lane_restriction", 0.3),
    ]


def classified(w: DataFrame) -> DataFrame:
    """Works with restriction_class and capacity."""
    steps = _restriction()
    return w.withColumns({"restriction_class": rules.first_rule([(c, k) for c, k, _ in steps], "minor"), "capacity": rules.first_rule([(c, v) for c, _, v in steps], 0.1)})


PROJECTS = [
    {"name": "Gorse renewal", "box": (53.0, 53.1, -1.6, -1.4), "roads": ["gorse", "sallowfield road"], "keywords": ["footway", "bridge", "culvert"]},
    {"name": "Canal bank", "box": (53.05, 53.25, -1.75, -1.5), "roads": ["fenwick"], "keywords": ["diversion", "lane", "bridge"]},
]


@query
def works_tagged(spark, d):
    """Live works with restriction class, capacity, project, flags and owner."""
    w = classified(live(works(spark, d)))
    owner = rules.any_keyword("operator", ["council"])
    return w.select("id", "restriction_class", "capacity", rules.first_project(PROJECTS, "lat", "lng", "road", "description", owner).alias("project"), rules.any_keyword("description", ["bridge", "culvert"]).alias("is_bridge"), owner.alias("is_owner"), (F.col("status") == STARTED).alias("is_started"))


@query
def road_classes(spark, d):
    w = works(spark, d)
    steps = {"M": 80000, "A": 15000, "B": 5000, "quiet": 200, "busier": 3000, "other": 1500, "unnamed": 500}
    return w.select("id", rules.road_class("road", "description", ["A6997", "A6211"]).alias("road_class"), rules.estimated_volume("road", "description", steps).cast("long").alias("volume"))


@query
def coverage_counters(spark, d):
    """How many live works each tag covers, and all tags together, works under several counted for each."""
    t = works_tagged(spark, d)
    flags = {"started": F.col("is_started"), "bridges": F.col("is_bridge"), "in_projects": F.col("project").isNotNull(), "closures": F.col("restriction_class") == "full_closure"}
    one = t.agg(F.count("*").alias("works"), *[F.count_if(c).alias(n) for n, c in flags.items()])
    return one.withColumn("covered", F.expr(" + ".join(flags)))


def _corridors(spark: SparkSession, d: str) -> DataFrame:
    """The divisions' outlines as corridors, with a base severity."""
    return table(spark, d, "burnley_ceds").select("ons_code", "coordinates", ((F.substring("ons_code", 4, 6).cast("int") % 5) / 10.0).alias("base"))


@query
def corridor_scores(spark, d):
    """Severity of each corridor from its base, the volume counted along it and the number of live works."""
    lines = _corridors(spark, d)
    c = _counters(spark, d).select("count_point_id", F.col("lat").alias("olat"), F.col("lng").alias("olng"), "all_motor_vehicles")
    mean = spatial.line_means(lines, "ons_code", "coordinates", c, "count_point_id", "all_motor_vehicles", 800.0)
    n = live(works(spark, d)).count()
    severity = F.least(F.col("base") + F.least(F.col("mean") / 50000.0, F.lit(1.0)) * 0.3 + F.lit(min(n * 0.02, 0.3)), F.lit(1.0))
    out = lines.join(mean, "ons_code").select("ons_code", F.bround(severity, 2).alias("severity"), F.floor("mean").cast("long").alias("vehicles"), "hits")
    return out.withColumn("level", rules.tier("severity", [(0.8, "critical"), (0.6, "severe"), (0.4, "high"), (0.2, "moderate")], "low"))


@query
def corridor_clashes(spark, d):
    """Works along each corridor that aren't over: how many, overlapping pairs, the capacity they take together."""
    w = classified(live(works(spark, d))).where(F.col("end_ms").isNull() | (temporal.day_of("end_ms") >= AS_OF_DAY))
    w = w.withColumns({"a": temporal.day_of("start_ms"), "b": temporal.day_of("end_ms")})
    near = spatial.near_lines(w, "id", _corridors(spark, d), "ons_code", "coordinates", 300.0).join(w.select("id", "a", "b", "capacity"), "id")
    per = near.groupBy("ons_code").agg(F.count("*").alias("works"), F.bround(F.sum("capacity"), 2).alias("capacity"))
    out = per.join(spatial.overlap_counts(near, "ons_code", "a", "b"), "ons_code").where("works >= 2 and pairs > 0")
    return out.withColumn("level", rules.tier("capacity", [(1.5, "critical"), (1.0, "high")], "moderate"))


def _events(spark: SparkSession, d: str) -> DataFrame:
    """Events at count points: place, radius and days (every 21 and 28 days from a day of their own)."""
    k = F.col("count_point_id")
    c = _counters(spark, d).where((k % 7 == 0) & F.col("lat").isNotNull() & F.col("lng").isNotNull())
    first = F.lit(AS_OF_DAY - 60) + k % 40
    return c.select("count_point_id", "lat", "lng", (F.lit(1000.0) + (k % 3) * 500.0).alias("radius_m"), F.array_sort(F.array(first, first + 21, first + 49)).alias("days"))


@query
def event_dates(spark, d):
    """Events with days to come: how many, the first and the last."""
    e = _events(spark, d).withColumn("left", rules.dates_ahead("days", AS_OF_DAY)).where("left is not null")
    return e.select("count_point_id", F.size("left").cast("long").alias("n"), F.try_element_at("left", F.lit(1)).alias("first_day"), F.try_element_at("left", F.lit(-1)).alias("last_day"))


def _timed(spark: SparkSession, d: str) -> DataFrame:
    w = live(works(spark, d))
    return w.select("id", "lat", "lng", temporal.day_of("start_ms").alias("a"), temporal.day_of("end_ms").alias("b")).where("a is not null")


@query
def work_events(spark, d):
    """For each live work the first event, by number, within the event's radius on a day of the work."""
    hit = spatial.near_on_days(_timed(spark, d), "id", "a", "b", _events(spark, d), "count_point_id")
    return hit.groupBy("id").agg(F.min_by(F.struct("count_point_id", "day"), "count_point_id").alias("e")).select("id", "e.count_point_id", "e.day")


@query
def event_works(spark, d):
    """For each event the live works within its radius on one of its days, and the three nearest of them."""
    e = _events(spark, d)
    hit = spatial.near_on_days(_timed(spark, d), "id", "a", "b", e, "count_point_id", inclusive=False)
    near = rank.first_of_each(hit, "count_point_id", [F.col("distance_m"), F.col("id")], 3).groupBy("count_point_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("distance_m", "id"))), lambda x: x["id"].cast("string")), " ").alias("nearest"))
    n = hit.groupBy("count_point_id").agg(F.count("*").alias("works"))
    return e.select("count_point_id").join(n, "count_point_id", "left").join(near, "count_point_id", "left").select("count_point_id", F.coalesce("works", F.lit(0)).cast("long").alias("works"), F.coalesce("nearest", F.lit("")).alias("nearest"))


WEEKEND = [2, 1, 1, 1, 1, 2, 3, 4, 5, 6, 7, 8, 8, 8, 7, 7, 6, 6, 5, 5, 4, 4, 3, 3]


@query
def heatmap_profiles(spark, d):
    """The heatmap with a weekend profile and the school run in term."""
    return temporal.heatmap(live(works(spark, d)), "start_ms", "end_ms", AS_OF_DAY, PROFILE, weekend=WEEKEND, school={8: 3.0, 15: 2.5}, terms=TERMS)


@query
def nation_winner(spark, d):
    """Whether each nation's customers have as much on average as its suppliers, or more."""
    c = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.avg("c_acctbal").alias("c"))
    s = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.avg("s_acctbal").alias("s"))
    return c.join(s, "k", "left").select("k", rules.ahead("c", "s").alias("ahead"), rules.ahead("c", "s", lower_is_better=True).alias("behind"))

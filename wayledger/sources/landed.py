"""Readers of landed files: what remote services answered, as files in a folder. Schemas are given, never inferred."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayledger.functions.rules import first_of, middle, strip_suffix

#: Attributes of a works feature by their landed names (fixed values); times are epoch milliseconds.
WORKS_TEXT = "linkName areaName townName Organisation WorksState WorksCategory Severity Duration Scale NetworkManagement ManagementType PublicComment NonPublicComment Direction ImpactDelays TrafficConstriction ReferenceNo PermitStatus Urgent ImgUrl OneNetworkURL CauseDesc CauseType Cause RoadMaintType Compliance Probability".split()
WORKS_TIMES = "ValidFrom ValidTo CreationTime".split()

POINT_OR_PATHS = "struct<x: double, y: double, paths: array<array<array<double>>>>"
WORKS_FEATURES = f"features array<struct<attributes: struct<OBJECTID: bigint, {', '.join(f'{c}: bigint' for c in WORKS_TIMES)}, {', '.join(f'{c}: string' for c in WORKS_TEXT)}>, geometry: {POINT_OR_PATHS}>>"
LAYER_FEATURES = f"features array<struct<attributes: map<string, string>, geometry: {POINT_OR_PATHS}>>"
COUNT_POINT = "struct<count_point_id: bigint, road_name: string, road_category: string, road_type: string, latitude: string, longitude: string, start_junction_road_name: string, end_junction_road_name: string>"
REPORT = "struct<service_request_id: string, title: string, description: string, service_name: string, service_code: string, status: string, lat: string, long: string, media_url: string, requested_datetime: string, updated_datetime: string, interface_used: string>"
ELEMENT = "struct<type: string, id: bigint, lat: double, lon: double, center: struct<lat: double, lon: double>, tags: map<string, string>>"


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path, or any file of a glob, is there, in whatever file system it names."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p)
    return found is not None and len(found) > 0


def documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Whole-file JSON documents; none there gives an empty frame of the schema, a broken one a row of nulls."""
    if not exists(spark, path):
        return spark.createDataFrame([], T._parse_datatype_string(schema))
    return spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").json(path)


def records(spark: SparkSession, path: str, field: str, element: str) -> DataFrame:
    """The records of one array of a document, a column each."""
    return documents(spark, path, f"{field} array<{element}>").select(F.explode(field).alias("_r")).select("_r.*")


def _text(c: str) -> Column:
    return F.coalesce(F.trim(F.col(c)), F.lit(""))


def _ms(c: str) -> Column:
    return F.timestamp_millis(F.nullif(F.col(c), F.lit(0).cast("long")))


def works_features(spark: SparkSession, path: str, towns: dict[str, str] | None = None) -> DataFrame:
    """Works flattened from landed features: 31 columns, texts trimmed, times as timestamps (0 and missing null)."""
    f = documents(spark, path, WORKS_FEATURES).select(F.explode("features").alias("f")).select("f.attributes.*", F.col("f.geometry.y").alias("lat"), F.col("f.geometry.x").alias("lng"))
    town = _text("townName")
    table = F.create_map(*[F.lit(x) for kv in (towns or {"": ""}).items() for x in kv])
    return f.select(
        F.col("OBJECTID").alias("id"), _text("linkName").alias("road"), strip_suffix(_text("areaName"), " Ward").alias("ward"), _text("areaName").alias("area"),
        F.coalesce(table[town], town).alias("district"), town.alias("district_raw"), "lat", "lng",
        _ms("ValidFrom").alias("start_date"), _ms("ValidTo").alias("end_date"), _ms("CreationTime").alias("created"),
        _text("Organisation").alias("operator"), _text("WorksState").alias("status"), _text("WorksCategory").alias("category"), F.lower(_text("Severity")).alias("severity"),
        _text("Duration").alias("duration"), _text("Scale").alias("scale"), _text("NetworkManagement").alias("restrictions"), _text("ManagementType").alias("management_type"),
        _text("PublicComment").alias("description"), _text("Direction").alias("direction"), _text("ImpactDelays").alias("impact"), _text("TrafficConstriction").alias("traffic_constriction"),
        _text("ReferenceNo").alias("reference"), _text("PermitStatus").alias("permit_status"), (F.lower(_text("Urgent")) == "true").alias("urgent"),
        _text("ImgUrl").alias("image_url"), _text("OneNetworkURL").alias("one_network_url"), _text("CauseDesc").alias("cause"), _text("CauseType").alias("cause_type"), _text("RoadMaintType").alias("road_type"),
    )


def layer_features(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """A highways layer whose fields go by several names; a polyline counts as its middle vertex."""
    f = documents(spark, path, LAYER_FEATURES).select(F.explode("features").alias("f")).select("f.attributes", "f.geometry")
    of = lambda *names: first_of(*[F.col("attributes")[n] for n in names])
    time_of = lambda *names: F.timestamp_millis(F.nullif(of(*names).try_cast("long"), F.lit(0).cast("long")))
    vertex = middle(F.try_element_at(F.col("geometry.paths"), F.lit(1)))
    return f.select(
        F.lit(kind).alias("layer"), of("OBJECTID", "objectid").try_cast("long").alias("id"), of("RoadName", "linkName", "Road").alias("road"), of("Status", "WorksState").alias("status"),
        F.substring(of("Description", "PublicComment"), 1, 300).alias("description"), time_of("StartDate", "ValidFrom").alias("start_date"), time_of("EndDate", "ValidTo").alias("end_date"),
        F.coalesce("geometry.y", vertex[1]).alias("lat"), F.coalesce("geometry.x", vertex[0]).alias("lng"),
    )


def count_point_pages(spark: SparkSession, folder: str, box: tuple[float, float, float, float] | None = None) -> DataFrame:
    """Count points of all landed pages of a paged service, those strictly inside a box (south, north, west, east)."""
    p = records(spark, folder, "count_points", COUNT_POINT)
    p = p.withColumns({"lat": F.col("latitude").try_cast("double"), "lng": F.col("longitude").try_cast("double")})
    return p if box is None else p.where((F.col("lat") > box[0]) & (F.col("lat") < box[1]) & (F.col("lng") > box[2]) & (F.col("lng") < box[3]))


def yearly_flows(spark: SparkSession, folder: str) -> DataFrame:
    """Yearly mean flows of landed answers, one or several for each count point: count_point_id, year (by either of its two
    names) and all_motor_vehicles."""
    f = records(spark, folder, "average_annual_daily_flow", "struct<count_point_id: bigint, year: int, aadf_year: int, all_motor_vehicles: bigint>")
    return f.select("count_point_id", F.coalesce("year", "aadf_year").alias("year"), "all_motor_vehicles")


def newest_flow(points: DataFrame, flows: DataFrame) -> DataFrame:
    """points with flow_year and all_motor_vehicles of their own newest year; nulls where none was counted."""
    newest = flows.where("year is not null").groupBy("count_point_id").agg(F.max_by(F.struct(F.col("year").alias("flow_year"), "all_motor_vehicles"), F.struct("year", "all_motor_vehicles")).alias("_f"))
    return points.drop("flow_year", "all_motor_vehicles").join(newest.select("count_point_id", "_f.*"), "count_point_id", "left")


def reports(spark: SparkSession, path: str, council: str, field: str = "service_requests") -> DataFrame:
    """Street reports from a document with a list, or from a bare list."""
    if not exists(spark, path):
        return records(spark, path, field, REPORT)
    inner = REPORT.removeprefix("struct<").removesuffix(">").replace(": ", " ")
    raw = spark.read.schema(f"{field} array<{REPORT}>, {inner}").option("multiLine", True).json(path)  # a bare list gives a row a report
    names = [f.split()[0] for f in inner.split(", ")]
    r = raw.select(F.explode(F.coalesce(F.col(field), F.array(F.struct(*names)))).alias("r")).select("r.*").where("service_request_id is not null")
    return r.select(
        F.col("service_request_id").alias("id"), "title", F.substring(F.coalesce("description", F.lit("")), 1, 300).alias("description"), F.col("service_name").alias("category"), "service_code", "status",
        "lat", F.col("long").alias("lng"), F.col("media_url").alias("photo"), F.col("requested_datetime").alias("reported"), F.col("updated_datetime").alias("updated"), F.col("interface_used").alias("interface"), F.lit(council).alias("council"),
    )


def map_elements(spark: SparkSession, path: str, exclusive: list[tuple[str, Column]], overlapping: list[tuple[str, Column]]) -> DataFrame:
    """Elements of a map extract, one row for the first exclusive kind whose condition holds and one for each overlapping
    kind. Conditions read the column tags; a way's place is its centre."""
    e = records(spark, path, "elements", ELEMENT)
    one = F.coalesce(*[F.when(c, F.lit(k)) for k, c in exclusive]) if exclusive else F.lit(None).cast("string")
    kinds = F.array_compact(F.array(one, *[F.when(c, F.lit(k)) for k, c in overlapping]))
    return e.select("type", "id", F.coalesce("lat", "center.lat").alias("lat"), F.coalesce("lon", "center.lon").alias("lng"), "tags", F.explode(kinds).alias("kind"))


def first_success(candidates: DataFrame, key: str, priority: str) -> DataFrame:
    """Rows of each key's first source that has any."""
    best = candidates.groupBy(key).agg(F.min(priority).alias("_p"))
    return candidates.join(best, key).where(F.col(priority) == F.col("_p")).drop("_p")


def calendar(spark: SparkSession, path: str, home_ground: str | None = None) -> DataFrame:
    """Events of iCalendar files: start, summary, place, and whether the place names the home ground. Folded lines are
    joined; events without a start are left out."""
    t = spark.read.option("lineSep", "END:VEVENT").text(path).where(F.contains("value", F.lit("BEGIN:VEVENT")))
    t = t.select(F.regexp_replace(F.substring_index("value", "BEGIN:VEVENT", -1), "\r?\n[ \t]", "").alias("v"))
    part = lambda name: F.trim(F.regexp_extract("v", rf"(?m)^{name}(?:;[^:\r\n]*)?:([^\r\n]*)", 1))
    start = part("DTSTART")
    at = F.coalesce(F.try_to_timestamp(start, F.lit("yyyyMMdd'T'HHmmssX")), F.try_to_timestamp(start, F.lit("yyyyMMdd'T'HHmmss")), F.try_to_timestamp(start, F.lit("yyyyMMdd")))
    out = t.select(at.alias("start"), F.replace(part("SUMMARY"), F.lit("\\,"), F.lit(",")).alias("summary"), F.replace(part("LOCATION"), F.lit("\\,"), F.lit(",")).alias("location")).where("start is not null")
    return out if home_ground is None else out.withColumn("is_home", F.contains(F.lower("location"), F.lit(home_ground.lower())))


def fixtures(spark: SparkSession, path: str, home_team: str, as_of: str, past_days: int = 60, future_days: int = 120) -> DataFrame:
    """Matches of a team around a day: two forms of date, opponent by who is at home, score only if both sides have one."""
    schema = "DateUtc string, HomeTeam string, AwayTeam string, Location string, HomeTeamScore int, AwayTeamScore int, RoundNumber int"
    m = spark.read.schema(schema).option("multiLine", True).json(path)
    at = F.coalesce(F.try_to_timestamp("DateUtc", F.lit("yyyy-MM-dd HH:mm:ssX")), F.try_to_timestamp(F.substring("DateUtc", 1, 10), F.lit("yyyy-MM-dd")))
    home = F.contains(F.lower("HomeTeam"), F.lit(home_team.lower()))
    m = m.withColumns({"at": at, "is_home": home}).where("at is not null").where(home | F.contains(F.lower("AwayTeam"), F.lit(home_team.lower())))
    day = F.to_date(F.lit(as_of))
    m = m.where(F.to_date("at").between(F.date_sub(day, past_days), F.date_add(day, future_days)))
    score = F.when(F.col("HomeTeamScore").isNotNull() & F.col("AwayTeamScore").isNotNull(), F.concat_ws("-", "HomeTeamScore", "AwayTeamScore"))
    return m.select(F.to_date("at").alias("date"), F.hour("at").alias("kickoff_hour"), F.when(F.col("is_home"), F.col("AwayTeam")).otherwise(F.col("HomeTeam")).alias("opponent"), F.col("Location").alias("location"), "is_home", score.alias("score"), F.col("RoundNumber").alias("round"))


def keyed_lists(spark: SparkSession, path: str, outer: str, field: str, element: str) -> DataFrame:
    """Records of a list that stands under each key of a map in a document, tagged with the key as district."""
    c = documents(spark, path, f"{outer} map<string, struct<{field}: array<{element}>>>")
    return c.select(F.explode(outer).alias("district", "_v")).select("district", F.explode(f"_v.{field}").alias("_r")).select("district", "_r.*")


def page_details(pages: DataFrame, html: str = "html") -> DataFrame:
    """pages with email and committees (distinct, in order, five at most) found in the page's text."""
    names = F.array_distinct(F.transform(F.regexp_extract_all(html, F.lit(r"""<a[^>]*mgCommitteeDetails[^>]*>([^<]+)</a>"""), 1), lambda x: F.trim(x)))
    return pages.withColumns({"email": F.nullif(F.regexp_extract(html, r"mailto:([A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,})", 1), F.lit("")), "committees": F.slice(names, 1, 5)})


def markdown(spark: SparkSession, path: str) -> DataFrame:
    """Articles with front matter: id, title, date, description, tags, image, featured, draft and body; defaults for what
    is missing. Files without front matter are left out."""
    t = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.regexp_replace("value", "\r\n", "\n").alias("v")).where(F.col("v").startswith("---\n"))
    head = F.regexp_extract("v", r"(?s)^---\n(.*?)\n---", 1)
    t = t.select(F.regexp_replace("file", r"\.md$", "").alias("id"), head.alias("h"), F.regexp_replace("v", r"(?s)^---\n.*?\n---\s*|\s+$", "").alias("body"))
    field = lambda n: F.nullif(F.regexp_replace(F.trim(F.regexp_extract("h", rf"(?m)^{n}:[ \t]*(.*)$", 1)), "^[\"']|[\"']$", ""), F.lit(""))
    inline = F.regexp_replace(F.regexp_extract("h", r"(?m)^tags:[ \t]*\[(.*)\]", 1), "[\"']", "")
    block = F.transform(F.regexp_extract_all(F.regexp_extract("h", r"(?m)^tags:[ \t]*\n((?:[ \t]*-[^\n]*\n?)+)", 1), F.lit(r"-[ \t]*([^\n]+)"), 1), lambda x: F.regexp_replace(F.trim(x), "[\"']", ""))
    tags = F.when(inline != "", F.transform(F.split(inline, ","), lambda x: F.trim(x))).otherwise(block)
    truth = lambda n: F.coalesce(F.lower(field(n)) == "true", F.lit(False))
    at = F.coalesce(F.try_to_timestamp(field("date")), F.try_to_timestamp(F.substring(field("date"), 1, 10)))
    return t.select("id", field("title").alias("title"), at.alias("date"), field("description").alias("description"), tags.alias("tags"), field("image").alias("image"), truth("featured").alias("featured"), truth("draft").alias("draft"), "body")


def published(articles: DataFrame) -> DataFrame:
    return articles.where(~F.col("draft")).orderBy(F.desc("date"), "id")


def boundaries(spark: SparkSession, path: str, field: str = "wards") -> DataFrame:
    """Regions of a document that maps a slug to a name and a boundary whose first ring counts."""
    schema = f"{field} map<string, struct<name: string, boundary: struct<coordinates: array<array<array<double>>>>>>"
    return documents(spark, path, schema).select(F.explode(field).alias("slug", "v")).select("slug", F.col("v.name").alias("name"), F.try_element_at("v.boundary.coordinates", F.lit(1)).alias("coordinates"))


def rings(spark: SparkSession, path: str) -> DataFrame:
    """Regions of a bare list with flat rings."""
    return spark.read.schema("name string, ons_code string, centroid array<double>, coordinates array<array<double>>").option("multiLine", True).json(path)


def fresh_or_made(spark: SparkSession, path: str, make, max_age_s: float = 86_400.0) -> DataFrame:
    """A table kept at path while it is younger than max_age_s, made anew and written there otherwise."""
    jvm, mark = spark.sparkContext._jvm, f"{path}/_SUCCESS"
    if exists(spark, mark):
        p = jvm.org.apache.hadoop.fs.Path(mark)
        age = time.time() - p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).getModificationTime() / 1000
        if age <= max_age_s:
            return spark.read.parquet(path)
    make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)

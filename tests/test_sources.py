"""Readers, sinks and streams over files made here."""

import json

import pytest
from pyspark.sql import functions as F

from wayledger.sources import landed, sinks
from wayledger.streaming import streams


def put(path, value):
    path.write_text(value if isinstance(value, str) else json.dumps(value), encoding="utf-8")
    return str(path)


def test_works_features(spark, tmp_path):
    doc = {"features": [{"attributes": {"OBJECTID": 1, "linkName": " High St ", "areaName": "East Ward Ward", "townName": "Old", "ValidFrom": 1735689600000, "ValidTo": 0, "Severity": "HIGH", "Urgent": "True"}, "geometry": {"x": -1.5, "y": 53.1}}, {"attributes": {"OBJECTID": 2}, "geometry": None}]}
    rows = landed.works_features(spark, put(tmp_path / "f.json", doc), {"Old": "New"}).orderBy("id").collect()
    assert len(rows[0]) == 31
    assert (rows[0].road, rows[0].ward, rows[0].district, rows[0].severity, rows[0].urgent, rows[0].end_date) == ("High St", "East", "New", "high", True, None)
    assert rows[0].start_date.year == 2025 and rows[1].road == "" and rows[1].lat is None
    assert landed.works_features(spark, str(tmp_path / "none.json")).count() == 0


def test_layer_features(spark, tmp_path):
    doc = {"features": [{"attributes": {"linkName": "A", "WorksState": "Open", "ValidFrom": "1735689600000"}, "geometry": {"paths": [[[1.0, 2.0], [3.0, 4.0], [5.0, 6.0], [7.0, 8.0]]]}}, {"attributes": {"RoadName": "B", "Description": "x" * 400}, "geometry": {"paths": [[]]}}]}
    a, b = landed.layer_features(spark, put(tmp_path / "l.json", doc), "status").orderBy("road").collect()
    assert (a.road, a.status, a.lng, a.lat) == ("A", "Open", 5.0, 6.0) and b.lat is None and len(b.description) == 300


def test_pages_and_reports(spark, tmp_path):
    for i, page in enumerate([[{"count_point_id": 1, "latitude": "53.1", "longitude": "-1.5"}], [{"count_point_id": 2, "latitude": "bad", "longitude": "-1.5"}], []]):
        put(tmp_path / f"p{i}.json", {"count_points": page})
    assert [r.count_point_id for r in landed.count_point_pages(spark, str(tmp_path / "p*.json"), (53, 54, -2, -1)).collect()] == [1]
    one = {"service_request_id": "7", "lat": "53.1", "description": "d" * 400}
    for name, doc in (("o.json", {"service_requests": [one]}), ("b.json", [one])):
        r = landed.reports(spark, put(tmp_path / name, doc), "c").collect()
        assert [(x.id, x.lat, len(x.description), x.council) for x in r] == [("7", "53.1", 300, "c")]


def test_flows_of_each_point(spark, tmp_path):
    rows = [{"count_point_id": 1, "year": 2019, "all_motor_vehicles": 5}, {"count_point_id": 1, "aadf_year": 2021, "all_motor_vehicles": 9}, {"count_point_id": 2, "all_motor_vehicles": 7}]
    put(tmp_path / "f1.json", {"average_annual_daily_flow": rows})
    points = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "count_point_id long, road string")
    got = landed.newest_flow(points, landed.yearly_flows(spark, str(tmp_path / "f*.json"))).orderBy("count_point_id").collect()
    assert [(r.count_point_id, r.flow_year, r.all_motor_vehicles) for r in got] == [(1, 2021, 9), (2, None, None), (3, None, None)]


def test_map_elements(spark, tmp_path):
    doc = {"elements": [{"type": "node", "id": 1, "lat": 1.0, "lon": 2.0, "tags": {"highway": "crossing"}}, {"type": "way", "id": 2, "center": {"lat": 3.0, "lon": 4.0}, "tags": {"bridge": "yes", "maxweight": "7"}}, {"type": "node", "id": 3}]}
    tag = lambda k: F.col("tags")[k].isNotNull()
    got = landed.map_elements(spark, put(tmp_path / "m.json", doc), [("crossing", F.col("tags")["highway"] == "crossing")], [("bridge", tag("bridge")), ("weight", tag("maxweight"))])
    assert sorted((r.id, r.kind, r.lat) for r in got.collect()) == [(1, "crossing", 1.0), (2, "bridge", 3.0), (2, "weight", 3.0)]


def test_calendar_and_fixtures(spark, tmp_path):
    ics = "BEGIN:VCALENDAR\r\nBEGIN:VEVENT\r\nDTSTART:20250308T150000Z\r\nSUMMARY:A v B\\, cup\r\nLOCATION:The Gro\r\n und\r\nEND:VEVENT\r\nBEGIN:VEVENT\r\nDTSTART;VALUE=DATE:20250401\r\nSUMMARY:C\r\nEND:VEVENT\r\nBEGIN:VEVENT\r\nSUMMARY:none\r\nEND:VEVENT\r\nEND:VCALENDAR\r\n"
    got = landed.calendar(spark, put(tmp_path / "c.ics", ics), "the ground").orderBy("start").collect()
    assert [(r.summary, r.is_home) for r in got] == [("A v B, cup", True), ("C", False)] and got[0].start.hour == 15
    m = [{"DateUtc": "2025-03-08 15:00:00Z", "HomeTeam": "Town FC", "AwayTeam": "X", "Location": "L", "HomeTeamScore": 2, "AwayTeamScore": 1, "RoundNumber": 3}, {"DateUtc": "2025-03-20", "HomeTeam": "Y", "AwayTeam": "Town FC"}, {"DateUtc": "2024-01-01", "HomeTeam": "Town FC", "AwayTeam": "Z"}, {"DateUtc": "bad", "HomeTeam": "Town FC"}]
    rows = landed.fixtures(spark, put(tmp_path / "f.json", m), "town", "2025-03-01").orderBy("date").collect()
    assert [(r.opponent, r.is_home, r.score, r.kickoff_hour) for r in rows] == [("X", True, "2-1", 15), ("Y", False, None, 0)]
    c = spark.createDataFrame([("v", 2, "b"), ("v", 1, "a"), ("w", 2, "c")], "venue string, pri int, x string")
    assert sorted(r.x for r in landed.first_success(c, "venue", "pri").collect()) == ["a", "c"]


def test_lists_pages_articles_boundaries(spark, tmp_path):
    doc = {"councils": {"n": {"schools": [{"name": "S", "pupils": 5}]}, "m": {"schools": []}}}
    assert [(r.district, r.name) for r in landed.keyed_lists(spark, put(tmp_path / "k.json", doc), "councils", "schools", "struct<name: string, pupils: int>").collect()] == [("n", "S")]
    html = '<a href="mailto:a.b@c.example">x</a><a href="mgCommitteeDetails.aspx?ID=1"> One </a><a href="mgCommitteeDetails.aspx?ID=2">Two</a><a href="mgCommitteeDetails.aspx?ID=1">One</a>'
    r = landed.page_details(spark.createDataFrame([(html,), ("",)], "html string")).collect()
    assert (r[0].email, r[0].committees) == ("a.b@c.example", ["One", "Two"]) and r[1].email is None and r[1].committees == []
    put(tmp_path / "a.md", "---\ntitle: 'T & <x>'\ndate: 2025-01-02\ntags: [one, \"two\"]\n---\nBody\n")
    put(tmp_path / "b.md", "---\ntitle: U\ndate: 2025-02-02T10:00:00Z\ntags:\n  - three\ndraft: true\nfeatured: true\n---\n")
    put(tmp_path / "c.md", "no front matter")
    a = {x.id: x for x in landed.markdown(spark, str(tmp_path / "*.md")).collect()}
    assert set(a) == {"a", "b"} and a["a"].tags == ["one", "two"] and a["b"].tags == ["three"] and a["b"].draft and not a["a"].featured and a["a"].body == "Body"
    arts = landed.markdown(spark, str(tmp_path / "*.md"))
    assert [x.id for x in landed.published(arts).collect()] == ["a"]
    xml = sinks.feed(arts, "https://s.example", "News").collect()[0].value
    assert "T &amp; &lt;x&gt;" in xml and "<category>two</category>" in xml and "Thu, 02 Jan 2025" in xml and "/news/a/" in xml and "/news/b/" not in xml
    assert "2025-01-02" in sinks.sitemap(arts, "https://s.example").collect()[0].value
    b = {"wards": {"w": {"name": "W", "boundary": {"coordinates": [[[0.0, 0.0], [1.0, 0.0], [1.0, 1.0]]]}}}}
    assert landed.boundaries(spark, put(tmp_path / "w.json", b)).collect()[0].coordinates[1] == [1.0, 0.0]
    assert landed.rings(spark, put(tmp_path / "r.json", [{"name": "N", "ons_code": "1", "coordinates": [[0.0, 0.0]]}])).count() == 1


def test_archive_and_cache(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2), ("a", 3)], "key string, v int")
    path = str(tmp_path / "archive")
    assert sinks.append_archive(df, path, "key", F.lit(1)) == 2
    assert sinks.append_archive(df.union(spark.createDataFrame([("c", 4)], "key string, v int")), path, "key", F.lit(2)) == 1
    made = []
    make = lambda: made.append(1) or df
    for _ in range(2):
        assert landed.fresh_or_made(spark, str(tmp_path / "kept"), make).count() == 3
    assert len(made) == 1
    landed.fresh_or_made(spark, str(tmp_path / "kept"), make, max_age_s=-1)
    assert len(made) == 2


def test_sitemap_is_well_formed_and_whole(spark, tmp_path):
    import xml.etree.ElementTree as et

    arts = spark.createDataFrame([(f"a{i}", f"T & {i}", "2025-01-02", ["x", "<y>"] if i % 2 else [], False) for i in range(1200)], "id string, title string, date string, tags array<string>, draft boolean").withColumn("date", F.to_timestamp("date")).withColumn("description", F.lit(None).cast("string"))
    root = et.fromstring(sinks.sitemap(arts, "https://s.example", "The & News").collect()[0].value.split("?>", 1)[1])
    assert len(root) == 1200 and len(et.fromstring(sinks.feed(arts, "https://s.example", "N").collect()[0].value.split("?>", 1)[1]).findall(".//item")) == 1200
    news = "{http://www.google.com/schemas/sitemap-news/0.9}"
    assert root.findall(f".//{news}name")[0].text == "The & News" and len(root.findall(f".//{news}keywords")) == 600


def test_archive_record_and_document(spark, tmp_path):
    df = spark.createDataFrame([("a", 0), ("b", None)], "key string, start_ms long")
    got = {r.key: r for r in sinks.left_register(df, "start_ms", 5 * 86_400_000 - 1, "gone").collect()}
    assert got["a"].actual_duration_days == 4 and got["b"].actual_duration_days is None and got["a"].archived_reason == "gone"
    sinks.analytics_document({"league": df, "stats": df.limit(1)}, str(tmp_path / "doc"), "2026-01-01", {"live": 2})
    assert spark.read.json(str(tmp_path / "doc/league")).count() == 2 and spark.read.json(str(tmp_path / "doc/meta")).first().live == 2


def test_late_copies_never_pass(spark, tmp_path):
    store = str(tmp_path / "store")
    run = streams.once_per_message_ever(store, "k", "u", "d")
    batches = [[("a", 1, 1), ("a", 2, 2), ("b", 1, 3)], [("a", 9, 4), ("c", 1, 5), (None, 1, 6)], [("b", 5, 7), ("c", 5, 8)]]
    for n in (0, 1, 2, 1):  # one is run again
        run(spark.createDataFrame(batches[n], "k string, u long, d long"), n)
    assert sorted(r.d for r in spark.read.parquet(store).collect()) == [2, 3, 5, 6]


@pytest.mark.parametrize("form", ["intervals", "once", "archive"])
def test_streams(spark, tmp_path, form):
    source, rows = tmp_path / "in", [[("r", 0, 10), ("r", 20, 30), ("q", 0, 1)], [("r", 10, 15), (None, 0, 1), ("r", 5, 4)]]
    schema = "k string, a long, b long, at timestamp"
    for i, part in enumerate(rows):
        spark.createDataFrame(part, "k string, a long, b long").withColumn("at", F.lit(f"2025-01-0{i + 1}").cast("timestamp")).coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema(schema).parquet(str(source))
        state = str(tmp_path / "state")
        if form == "intervals":
            out = streams.interval_state(stream, "k", "a", "b").writeStream.outputMode("update").foreachBatch(lambda d, n: d.write.mode("append").parquet(str(tmp_path / "out")))
        elif form == "once":
            out = streams.once_per_message(stream, "k", "at").writeStream.format("parquet").option("path", str(tmp_path / "out"))
        else:
            out = stream.writeStream.foreachBatch(streams.archive_snapshots(str(tmp_path / "now"), str(tmp_path / "out"), "k", "a"))
        out.option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out"))
    if form == "intervals":
        last = got.where("entity = 'r' and version = 2").orderBy("from_ms").collect()
        assert [(r.span_kind, r.from_ms, r.to_ms) for r in last] == [("period", 0, 15), ("gap", 15, 20), ("period", 20, 30)]
    elif form == "once":
        assert sorted(str(r.k) for r in got.collect()) == ["None", "q", "r"]
    else:
        assert [r.k for r in got.collect()] == ["q"]

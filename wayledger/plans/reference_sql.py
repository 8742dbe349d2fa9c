"""DuckDB SQL for the queries of wayledger.plans.reference. The greedy clusters, which depend on the order of the points,
and what is built on them are tested against brute force instead."""

from wayledger.plans.general_sql import BLANK, instant

_DAY = 86400000
_AS_OF = 20513
_SQUASH = f"trim(regexp_replace(%s, '{BLANK}', ' ', 'g'))"
_FDAYS = "cast(floor(floor((end_ms - start_ms) / 1.0) / 86400000.0) as bigint)"
_SOURCE = f"regexp_replace(lower({_SQUASH % 'source'}), '[-_ ]+', '_', 'g')"

_WORKS = rf"""
works as (
  select row_id as id, snapshot_no, coalesce(trim(linkname, ' '), '') as road, trim(replace(coalesce(trim(areaname, ' '), ''), ' Ward', ''), ' ') as ward,
    case coalesce(trim(townname, ' '), '') when 'Brookhale' then 'brookhale' when 'Penny Moss' then 'marlbeck' when 'Rosewick' then 'rosewick' when 'Hyndmere' then 'hyndmere' else coalesce(trim(townname, ' '), '') end as district,
    geometry.y as lat, geometry.x as lng,
    {instant("validfrom", "zone_name", "day_first")} as start_ms, {instant("validto", "zone_name", "day_first")} as end_ms, {instant("creationtime", "zone_name", "day_first")} as created_ms,
    coalesce(trim(organisation, ' '), '') as operator, lower({_SQUASH % "coalesce(worksstate, '')"}) as status, coalesce(trim(workscategory, ' '), '') as category,
    coalesce(nullif(lower(coalesce(trim(severity, ' '), '')), ''), 'unknown') as severity, coalesce(trim(networkmanagement, ' '), '') as restrictions,
    upper(coalesce(trim(referenceno, ' '), '')) as reference, lower(coalesce(trim(urgent, ' '), '')) = 'true' as urgent,
    coalesce(trim(managementtype, ' '), '') as management, coalesce(trim(trafficconstriction, ' '), '') as constriction, coalesce(trim(impactdelays, ' '), '') as impact, coalesce(trim(publiccomment, ' '), '') as description, snapshot_at
  from roadworks left join feeds using (feed)),
newest as (select * from works where snapshot_no = (select max(snapshot_no) from works)),
live as (select * exclude (rn) from (select *, row_number() over (partition by reference order by cast(status = 'works started' as int) desc, id) as rn from newest where reference <> ''
    union all select *, row_number() over (partition by road, operator, start_ms, end_ms order by id) as rn from newest where reference = '') where rn = 1)
"""
W = f"with {_WORKS}"
_REGISTER = f"""{W}, keyed as (select *, coalesce(nullif(reference, ''), concat_ws('|', road, operator, coalesce(cast(start_ms as varchar), ''))) as key from works where snapshot_no is not null),
  nos as (select snapshot_no, lead(taken) over (order by snapshot_no) as completed_ms, lead(taken) over (order by snapshot_no) is null as active from (select snapshot_no, max(epoch_ms(snapshot_at)) as taken from keyed group by all)),
  held as (select *, row_number() over (partition by key order by snapshot_no desc, cast(status = 'works started' as int) desc, case when reference <> '' then id else -id end) as rn from keyed),
  register as (select held.*, completed_ms, active, cast(floor((completed_ms - start_ms) / 86400000.0) as bigint) as actual_days, {_FDAYS} as days,
    cast(floor(((select max(epoch_ms(snapshot_at)) from works) - completed_ms) / 86400000.0) as bigint) as ago from held join nos using (snapshot_no) where rn = 1)"""


def _hav(a: str, b: str, c: str, d: str) -> str:
    h = f"(pow(sin((radians({c}) - radians({a})) / 2.0), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians({d} - {b}) / 2.0), 2))"
    return f"(2.0 * 6371000.0 * atan2(sqrt({h}), sqrt(1.0 - least({h}, 1.0))))"


_COUNTERS = "counters as (select count_point_id, try_cast(latitude as double) as lat, try_cast(longitude as double) as lng, all_motor_vehicles, road_name from count_points)"
_LAYER = "layer_pts as (select row_id, lat as olat, lng as olng, upper(substr(trim(status), 1, 1)) || lower(substr(trim(status), 2)) as kind from road_status)"
_NEAR = f"{_COUNTERS}, {_LAYER}, near as (select c.count_point_id, l.row_id, l.kind, {_hav('c.lat', 'c.lng', 'l.olat', 'l.olng')} as dm from counters c join layer_pts l on l.olat between c.lat - 0.02 and c.lat + 0.02)"
_ROWNEAR = f"{_COUNTERS}, near as (select r.row_id, c.count_point_id, c.all_motor_vehicles, {_hav('r.lat', 'r.lng', 'c.lat', 'c.lng')} as dm from road_status r join counters c on c.lat between r.lat - 0.02 and r.lat + 0.02)"
_DAYS = f"days as (select unnest(range({_AS_OF - 89}, {_AS_OF + 1})) as day)"
_HOUR = f"{W}, h as (select id, road, coalesce(cast(floor((start_ms % {_DAY}) / 3600000.0) as int), 0) as a, coalesce(cast(floor((end_ms % {_DAY}) / 3600000.0) as int), 0) as b, status, start_ms, end_ms from works)"
_ON_DAY = f"floor(start_ms / {_DAY}.0) <= {_AS_OF} and floor(end_ms / {_DAY}.0) >= {_AS_OF}"
_HOUR_ON = "(a = 0 or (%s >= a and %s <= case when b = 0 then 23 else b end))"
_SPANS = f"spans as (select row_id, lower({_SQUASH % 'road'}) as road, epoch_ms(start_date) as s, epoch_ms(end_date) as t, lat, lng from road_status)"
_PAIRS = f"{_SPANS}, o as (select *, coalesce(s, -9000000000000000) as s1, coalesce(t, 9000000000000000) as t1 from spans where road is not null), pairs as (select x.road, x.row_id as a, y.row_id as b from o x join o y on x.road = y.road and x.row_id < y.row_id and x.s1 <= x.t1 and y.s1 <= y.t1 and x.s1 <= y.t1 and y.s1 <= x.t1)"
_FEATURED = "cast(coalesce(topic = 'closures' and n_chars > 5000, false) as int)"
_PROFILE = "[1,1,1,1,2,3,6,9,10,7,6,6,6,6,7,8,9,10,8,6,4,3,2,1]"
_HEAT = f"""{W}, d as (select unnest(range({_AS_OF}, {_AS_OF + 7})) as day), n as (select day, count(id) as n from d left join live on floor(start_ms / {_DAY}.0) <= day and floor(end_ms / {_DAY}.0) >= day group by all),
  heat as (select day, h as hour, round_even(cast({_PROFILE}[h + 1] as double) + case when h between 7 and 18 then least(n * 0.15::double, 3.0::double) else 0.0 end
    + case when day = {_AS_OF + 6} and h = 15 then 4.0 when day = {_AS_OF + 6} and h = 16 then 2.5 else 0.0 end, 2) as flow from n, (select unnest(range(0, 24)) as h))"""
_KEYED = f"""{W}, k as (select *, coalesce(nullif(reference, ''), concat_ws('|', road, operator, coalesce(cast(start_ms as varchar), ''))) as key from works),
  nos as (select snapshot_no, row_number() over (order by snapshot_no desc) as age from (select distinct snapshot_no from works where snapshot_no is not null)), aged as (select k.*, age from k join nos using (snapshot_no)),
  lost as (select distinct o.key, o.age from aged o where o.age > 1 and not exists (select 1 from aged n where n.key = o.key and n.age = o.age - 1))"""
_KIND_SCORE = "sum(case when kind = 'Open' and dm < 300.0 then 2.0 when kind = 'Closed' and dm < 800.0 then 8.0 when kind = 'Restricted' and dm < 500.0 then 5.0 else 0.0 end)"
_STRICT_RING = """ring as (select ons_code, cast(substr(ons_code, 4, 6) as int) as ord, coordinates as r, len(coordinates) as n from burnley_ceds),
edge as (select ons_code, ord, r[i][1] as ax, r[i][2] as ay, r[i % n + 1][1] as xb, r[i % n + 1][2] as yb from (select *, unnest(range(1, n + 1)) as i from ring)),
inside as (select row_id, ons_code, ord from road_status p join edge on ((ay > lat) != (yb > lat)) and lng < ax + (lat - ay) * (xb - ax) / (yb - ay) group by all having count(*) % 2 = 1)"""

_CLASS = """case when lower(constriction) = 'roadblocked' or lower(management) = 'roadclosed' then 1.0 when (lower(constriction) = 'lanesblocked' or lower(management) = 'laneclosures') then case when lower(restrictions) = 'temporarytrafficlights' then 0.6 else 0.4 end
  when lower(restrictions) = 'temporarytrafficlights' then 0.5 when lower(impact) = 'verylongdelays' and severity = 'high' then 0.4 when lower(impact) in ('longdelays', 'verylongdelays') then 0.3 else 0.1 end"""
_IN = "(lat <> 0 and lng <> 0 and lat between %s::double and %s::double and lng between %s::double and %s::double)"
_OWNER = "contains(lower(operator), 'council')"
_HITS = lambda *ws: "(" + " + ".join(f"cast(contains(lower(description), '{w}') as int)" for w in ws) + " >= 2)"
_ROADS = lambda *rs: "(" + " or ".join(f"contains(lower(road), '{r}') or contains('{r}', lower(road))" for r in rs) + ")"
_TAGGED = f"""{W}, tagged as (select id, case {_CLASS} when 1.0 then 'full_closure' when 0.1 then 'minor' else 'lane_restriction' end as restriction_class, cast({_CLASS} as double) as capacity,
    case when {_IN % (53.0, 53.1, -1.6, -1.4)} and ({_ROADS('gorse', 'sallowfield road')} or ({_OWNER} and {_HITS('footway', 'bridge', 'culvert')})) then 'Gorse renewal'
      when {_IN % (53.05, 53.25, -1.75, -1.5)} and ({_ROADS('fenwick')} or ({_OWNER} and {_HITS('diversion', 'lane', 'bridge')})) then 'Canal bank' end as project,
    contains(lower(description), 'bridge') or contains(lower(description), 'culvert') as is_bridge, {_OWNER} as is_owner, status = 'works started' as is_started from live)"""
_QUIET = ["rear of", "back of", "alley", "lane", "court", "close", "mews", "cul-de-sac", "terrace", "grove", "place", "rise", "walk", "crescent", "gardens", "square", "yard", "passage", "footpath", "footway", "bridleway", "access road", "service road"]
_BUSIER = ["road", "street", "avenue", "way", "drive", "boulevard", "highway"]
_LINES = f"lines as (select ons_code, (cast(substr(ons_code, 4, 6) as int) % 5) / 10.0::double as base, unnest(range(1, len(coordinates) + 1)) as i, coordinates from burnley_ceds), vertex as (select ons_code, base, i, coordinates[i][2] as vlat, coordinates[i][1] as vlng from lines)"
_EVENTS = f"""ev as (select count_point_id, lat, lng, 1000.0::double + (count_point_id % 3) * 500.0::double as radius_m, {_AS_OF - 60} + count_point_id % 40 as d from counters where count_point_id % 7 = 0 and lat is not null and lng is not null),
  evd as (select *, [d, d + 21, d + 49] as days from ev)"""
_TIMED = f"""{W}, {_COUNTERS}, {_EVENTS}, timed as (select id, lat as wlat, lng as wlng, floor(start_ms / {_DAY}.0) as a, floor(end_ms / {_DAY}.0) as b from live where start_ms is not null),
  hit as (select * from (select id, count_point_id, {_hav('wlat', 'wlng', 'lat', 'lng')} as dm, radius_m, list_filter(days, lambda x: x >= a and (b is null or x <= b))[1] as day from timed join evd on wlat between lat - 0.03 and lat + 0.03) where day is not null)"""

SQL = {
    "works_flat": f"{W} select id, road, ward, district, start_ms, end_ms, severity, urgent, reference from works",
    "restriction_labels": rf"""{W}, l as (select id, restrictions, regexp_replace(restrictions, '([a-z])([A-Z])', '\1 \2', 'g') as x, {_FDAYS} as d from works)
      select id, case when x = '' then 'None' else upper(substr(x, 1, 1)) || substr(x, 2) end as label, case when lower(restrictions) like '%closed%' then 'full' when lower(restrictions) like '%lane%' then 'lane' when lower(restrictions) like '%light%' then 'lights' else 'minor' end as kind,
      case when d >= 30 then 'long' when d >= 7 then 'medium' else 'short' end as length,
      case when coalesce(d, 0) <= 1 then '1 day' when d < 7 then d || ' days' when d < 11 then '1 wk' when d < 30 then cast(floor(d / 7.0::double + 0.5::double) as bigint) || ' wks' when d < 45 then '1 mo'
        else cast(floor(d / 30.0::double + 0.5::double) as bigint) || ' mos' end as duration from l""",
    "keyword_flags": """with t as (select *, lower(text) as x from documents) select doc_id, coalesce(contains(x, 'bridge') or contains(x, 'drain') or contains(x, 'lights') or contains(x, 'diversion'), false) as any_hit,
      coalesce(cast(contains(x, 'bridge') as int) + cast(contains(x, 'drain') as int) + cast(contains(x, 'lights') as int) + cast(contains(x, 'diversion') as int), 0) as hits,
      coalesce((contains(lower(road), lower(topic)) or contains(lower(topic), lower(road))) and road <> '' and topic <> '', false) as alike,
      coalesce(regexp_matches(trim(topic), '^[A-Za-z]{1,2}[0-9][A-Za-z0-9]?\\s*[0-9][A-Za-z]{2}$'), false) as postcode from t""",
    "field_fallback": "select count_point_id, coalesce(nullif(trim(start_junction_road_name), ''), nullif(trim(end_junction_road_name), ''), nullif(trim(road_name), ''), '') as name from count_points",
    "reading_time": r"""with t as (select doc_id, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\x{000B}\f\r]+'), lambda w: w <> '')) as words from documents)
      select doc_id, words, cast(greatest(1, ceil(words / 220.0)) as bigint) as minutes from t""",
    "stripped_markup": """select doc_id, cast(length(regexp_replace(text, '<[^>]*>', '', 'g')) as bigint) as n,
      cast(length(replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&apos;')) as bigint) as escaped from documents where contains(text, '<')""",
    "json_props": "select event_id, cast(json_extract(props, '$.k') as bigint) as k, cast(json_extract(props, '$.k') as bigint) as k2 from events",
    "strict_and_inclusive_boxes": "select row_id, lat > 53.05::double and lat < 53.15::double and lng > -1.6::double and lng < -1.45::double as strict, lat between 53.05::double and 53.15::double and lng between -1.6::double and -1.45::double as inclusive from road_status where lat <> 0 and lng <> 0",
    "days_between": "select row_id, cast(floor((epoch_ms(end_date) // 1000 - epoch_ms(start_date) // 1000) / 86400.0) as bigint) as floor_days, cast(coalesce(greatest(date_diff('day', start_date, end_date), 1), 0) as bigint) as calendar_days from road_status where start_date is not null",
    "not_finished": f"{W} select id, road from works where end_ms is null or floor(end_ms / {_DAY}.0) >= {_AS_OF}",
    "layer_places": "select ons_code, coordinates[len(coordinates) // 2 + 1][1] as lng, coordinates[len(coordinates) // 2 + 1][2] as lat, len(coordinates) as vertices from burnley_ceds",
    "ring_means": """with t as (select ons_code, [v[1] for v in coordinates] as x, [v[2] for v in coordinates] as y from burnley_ceds)
      select ons_code, round_even(list_sum(x) / len(x), 4) as lng, round_even(list_sum(y) / len(y), 4) as lat, round(list_min(x) - (list_max(x) - list_min(x)) * 0.1::double, 6) as west, round(list_max(y) + (list_max(y) - list_min(y)) * 0.1::double, 6) as north from t""",
    "svg_paths": "select ons_code, 'M' || array_to_string([cast(cast(round((v[1] + 2.0::double) * 100.0::double) as int) as varchar) || ',' || cast(cast(round((53.5::double - v[2]) * 100.0::double) as int) as varchar) for v in coordinates], ' L') || 'Z' as path from burnley_ceds",
    "operator_league": f"""{_REGISTER}, w as (select * replace (coalesce(nullif(operator, ''), 'Unknown') as operator), active as act, coalesce(days > 0 and actual_days > days, false) as ov from register)
      select operator, count(*) filter (act) as active, count(*) filter (not act) as completed, count(*) as total, round_even(avg(cast(days as double)) filter (days > 0), 1) as avg_days,
      round_even(100.0::double * count(*) filter (not act and ov) / nullif(count(*) filter (not act), 0), 1) as overrun_pct, round_even(100.0::double * count(*) filter (severity = 'high') / count(*), 1) as high_pct, count(distinct nullif(district, '')) as areas from w group by operator""",
    "district_volume": f"""{_REGISTER}, g as (select coalesce(nullif(district, ''), 'unknown') as district, count(*) filter (active) as active, count(*) filter (not active and ago between 0 and 30) as last_30d, count(*) filter (not active and ago between 0 and 90) as last_90d from register group by all)
      select *, case when last_30d > last_90d / 3.0::double * 1.2::double then 'increasing' when last_30d < last_90d / 3.0::double * 0.8::double then 'decreasing' else 'stable' end as trend from g""",
    "severity_trends": f"{_REGISTER} select severity, count(*) filter (active) as current, count(*) filter (not active and ago <= 30) as completed_30d from register group by all",
    "supplier_league": """with j as (select n_name, o_orderstatus = 'O' as act, o_orderkey % 40 as days, l_shipdate > o_orderdate as ov, o_orderpriority, o_custkey from lineitem join orders on l_orderkey = o_orderkey join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey)
      select n_name, count(*) filter (act) as active, count(*) filter (not act) as completed, count(*) as total, round_even(avg(cast(days as double)) filter (days > 0), 1) as avg_days,
      round_even(100.0::double * count(*) filter (not act and ov) / nullif(count(*) filter (not act), 0), 1) as overrun_pct, round_even(100.0::double * count(*) filter (o_orderpriority = '1-URGENT') / count(*), 1) as high_pct, count(distinct o_custkey) as areas from j group by n_name""",
    "group_counts_default": "select coalesce(nullif(trim(ward, ' '), ''), 'Unknown') as key, count(*) as n from fixmystreet group by all",
    "category_counts": "select coalesce(nullif(trim(service_code, ' '), ''), 'Other') as key, count(*) as n from fixmystreet group by all",
    "district_pivot_counts": f"""{W} select coalesce(nullif(district, ''), 'unknown') as district, count(*) as total, count(*) filter (status = 'works started') as started, count(*) filter (status = 'works planned') as planned,
      count(*) filter (severity = 'high') as high, count(*) filter (severity = 'medium') as medium, count(*) filter (severity = 'low') as low from live group by all""",
    "volume_trend": """with t as (select c_mktsegment, o_orderstatus = 'O' as act, 10957 - floor(epoch_ms(o_orderdate) / 86400000.0) as ago from orders join customer on o_custkey = c_custkey),
      g as (select c_mktsegment, count(*) filter (act) as active, count(*) filter (not act and ago between 0 and 30) as last_30d, count(*) filter (not act and ago between 0 and 90) as last_90d from t group by all)
      select *, case when last_30d > last_90d / 3.0::double * 1.2::double then 'increasing' when last_30d < last_90d / 3.0::double * 0.8::double then 'decreasing' else 'stable' end as trend from g""",
    "severity_zero_filled": f"{W} select coalesce(s, severity) as severity, count(severity) as n from live full join (select unnest(['high', 'medium', 'low', 'unknown', 'none']) as s) on s = severity group by all",
    "duration_stats": f"""{_REGISTER}, t as (select category, days from register), u as (select category, days from t union all select '(all)', days from t)
      select category, count(*) as n, round_even(avg(cast(days as double)), 1) as avg_days, cast(round_even(median(cast(days as double)), 0) as bigint) as median_days, max(days) as max_days from u where days > 0 and days < 3650 group by category""",
    "longest_running": f"{W}, t as (select id, road, cast(floor(((select max(epoch_ms(snapshot_at)) from works) - start_ms) / 86400000.0) as bigint) as days from live) select * from t where days > 90 order by days desc, id limit 20",
    "overdue": f"{W}, t as (select id, cast(floor(({_AS_OF * _DAY} / 1000.0::double - end_ms / 1000.0::double) / 86400.0) as bigint) as days_overdue from live where end_ms < {_AS_OF * _DAY}) select *, (select count(*) from t) as overdue_count from t order by days_overdue desc, id limit 30",
    "distinct_areas": f"{W} select count(distinct district) as districts, count(distinct ward) as wards, count(distinct operator) as operators from works",
    "argmax_latest": "select o_custkey, o_orderkey, epoch_ms(o_orderdate) // 1000 as at from (select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey) as rn from orders) where rn = 1",
    "busiest_counter_by_road": "select road_name, count_point_id, all_motor_vehicles from (select *, row_number() over (partition by road_name order by all_motor_vehicles desc, count_point_id) as rn from count_points where all_motor_vehicles is not null) where rn = 1 order by all_motor_vehicles desc, road_name limit 20",
    "place_bounds": "select min(lat) as south, max(lat) as north, min(lng) as west, max(lng) as east, count(*) as n from road_status where lat <> 0 and lng <> 0",
    "nearest_rank_95": f"{W}, t as (select cast(floor(end_ms / {_DAY}.0) as bigint) as v from works where end_ms is not null), r as (select v, row_number() over (order by v) - 1 as k from t) select v as value from r where k = (select cast(floor(count(*) * 0.95::double) as bigint) from t)",
    "size_histogram": "select trim(regexp_replace(p_type, 'brushed', '', 'gi'), ' ') as zone, count(*) as n from part group by all",
    "worst_by_road": f"{W} select road, bool_or(lower(restrictions) like '%closed%') as any_full, bool_or(lower(restrictions) like '%lane%') as any_lane, count(*) as n from live group by road",
    "headline": f"{W} select count(*) as works, count(*) filter (severity = 'high') as high, count(*) filter (urgent) as urgent, (select count(*) from fixmystreet) as reports, (select count(*) from fixmystreet where status = 'open') as open_reports, (select count(*) from count_points) as counters from works",
    "layer_totals": "select layer, upper(substr(trim(status), 1, 1)) || lower(substr(trim(status), 2)) as status, count(*) as n from road_status group by all",
    "source_freshness": f"""with t as (select 'reports' as source, count(*) as records, max(epoch_ms(received_at)) as newest from fixmystreet union all select 'works', count(*), max(epoch_ms(received_at)) from roadworks union all select 'documents', count(*), max(epoch_ms(published)) from documents)
      select *, coalesce(({_AS_OF * _DAY} - newest) / 3600000.0 > 6.0, true) as stale from t""",
    "share_of_tokens": f"with t as (select {_SOURCE} as source, cast(sum(n_chars) as bigint) as weight from documents group by all) select source, weight, round_even(weight / cast((select sum(weight) from t) as double), 4) as share from t",
    "weighted_score": """with t as (select count_point_id, round_even(greatest(0.0::double, least(100.0::double, coalesce(all_motor_vehicles / 300.0::double, 10.0::double))) * 0.6::double + greatest(0.0::double, least(100.0::double, case when road_type = 'Major' then 100.0::double else 30.0::double end)) * 0.4::double, 1) as score from count_points)
      select *, case when score >= 70 then 'critical' when score >= 50 then 'high' when score >= 30 then 'medium' else 'low' end as level from t""",
    "dedupe_first": """select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity from (select *, row_number() over (partition by l_orderkey, l_linenumber order by l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) as rn from lineitem) where rn = 1""",
    "dedupe_preferred": f"""{W}, w as (select * from works where road <> ''), a as (select id, reference, row_number() over (partition by reference order by cast(status = 'works started' as int) desc, id) as rn from w where reference <> ''),
      b as (select id, reference, row_number() over (partition by road, operator, start_ms, end_ms order by id) as rn from w where reference = '') select id, reference from (select * from a union all select * from b) where rn = 1""",
    "snapshot_archive": f"""{_KEYED}, g as (select *, row_number() over (partition by key order by id desc) as rn from aged where age = 2 and key in (select key from lost where age = 2) and key not in (select key from lost where age > 2)) select id, key from g where rn = 1""",
    "fallback_union": "select s_nationkey as k, s_name as name from supplier union all select c_nationkey, c_name from customer where c_nationkey not in (select s_nationkey from supplier)",
    "fill_missing": """with o as (select road_name, min(nullif(trim(start_junction_road_name), '')) as v from count_points group by all)
      select count_point_id, c.road_name, coalesce(nullif(trim(start_junction_road_name), ''), v) as start_junction_road_name from count_points c left join o using (road_name)""",
    "union_states": f"{W} select id, status from live where status in ('works started', 'works planned')",
    "severity_sort_topn": f"{W} select id, severity, district, road from works order by case severity when 'high' then 0 when 'medium' then 1 when 'low' then 2 else 9 end, district, road, id limit 25",
    "facet_page": f"""{W}, t as (select id, road, start_ms from works where severity = 'high' and contains(lower(road), 'road') and start_ms <= {_AS_OF * _DAY} and end_ms >= {(_AS_OF - 90) * _DAY})
      select * from t order by start_ms, id limit 15 offset (select (least(2, greatest(1, cast(ceil(count(*) / 15.0) as bigint))) - 1) * 15 from t)""",
    "facet_hour": f"{_HOUR} select id, road from h where {_ON_DAY} and status = 'works started' and {_HOUR_ON % (8, 8)}",
    "facet_sorted": f"{W} select id from works order by end_ms - start_ms desc nulls last, id limit 30 offset 60",
    "featured_or_latest": f"select doc_id from documents order by {_FEATURED} desc, published desc nulls last, doc_id limit 1",
    "all_but_featured": "select doc_id from documents where doc_id <> (select doc_id from documents order by published desc nulls last, doc_id limit 1)",
    "road_search": f"{W} select id, road, lat, lng from works where contains(lower(road), 'bramble') order by id limit 1",
    "active_on_day": f"{W} select id, road from works where floor(start_ms / {_DAY}.0) <= {_AS_OF} and floor(end_ms / {_DAY}.0) >= {_AS_OF}",
    "hourly_strip": f"""{_HOUR}, c as (select cast(hr as int) as hour, count(id) as n from (select unnest(range(0, 24)) as hr) left join (select * from h where {_ON_DAY} and id in (select id from live)) on {_HOUR_ON % ('hr', 'hr')} group by all), m as (select min(n) as lo, max(n) as hi from c)
      select hour, n, cast(floor(6.0::double + coalesce((n - lo) / nullif(hi - lo, 0), 0.0::double) * 38.0::double + 0.5::double) as bigint) as height, hour = (select min(hour) from c where n = (select hi from m)) as is_peak from c, m""",
    "daily_density": f"{W}, {_DAYS} select day, count(id) as n from days left join works on floor(start_ms / {_DAY}.0) <= day and floor(end_ms / {_DAY}.0) >= day group by all",
    "stacked_90d": f"""{W}, {_DAYS}, s as (select unnest(['high', 'medium', 'low', 'unknown']) as severity, unnest([1, 2, 3, 4]) as o),
      c as (select s.severity, day, o, count(id) as n from s cross join days left join works w on w.severity = s.severity and floor(start_ms / {_DAY}.0) <= day and floor(end_ms / {_DAY}.0) >= day group by all)
      select severity, day, n, cast(sum(n) over (partition by day order by o) as bigint) as upto from c""",
    "term_lookup": f"""{W}, t as (select id, floor(start_ms / {_DAY}.0) as day from works) select id, case when day between 20459 and 20543 then 'Spring term' when day between 20556 and 20654 then 'Summer term' when day between 20332 and 20439 then 'Autumn term' else 'School holiday' end as term from t""",
    "overlap_pairs": f"with {_PAIRS} select road, a, b from pairs",
    "clash_rollup": f"with {_PAIRS}, g as (select road, count(*) as pairs, min(a) as first from pairs group by all) select *, case when pairs >= 50 then 'breach' when pairs >= 10 then 'coordination' when pairs >= 3 then 'monitor' else 'none' end as level from g",
    "first_event_in_works": f"{W}, d as (select unnest(range(20514, 20584, 7)) as day) select id, min(day) as day from works join d on day between floor(start_ms / {_DAY}.0) and floor(end_ms / {_DAY}.0) group by id",
    "heatmap_7x24": f"{_HEAT} select day, cast(hour as int) as hour, flow from heat",
    "heatmap_peaks": f"{_HEAT}, r as (select *, row_number() over (partition by day order by flow desc, hour) as rn from heat) select day, cast(hour as int) as peak_hour, flow as peak_flow from r where rn = 1",
    "running_offset": f"with t as (select doc_id, {_SOURCE} as source, n_chars from documents) select doc_id, cast(coalesce(sum(n_chars) over (partition by source order by doc_id rows between unbounded preceding and 1 preceding), 0) as bigint) as offset from t",
    "radius_count": f"with {_NEAR} select c.count_point_id, count(n.row_id) as n from counters c left join near n on n.count_point_id = c.count_point_id and dm < 500.0 group by all",
    "radius_weighted": f"""with {_NEAR} select c.count_point_id, round(coalesce(sum(greatest(0.0::double, 1.0::double - dm / 1000.0::double) * 100.0::double), 0), 3) as w, cast(coalesce(sum(cast(kind = 'Closed' as int)), 0) as bigint) as closed
      from counters c left join near n on n.count_point_id = c.count_point_id and dm < 1000.0 group by all""",
    "kind_scores": f"with {_NEAR} select c.count_point_id, least(cast(coalesce({_KIND_SCORE}, 0) as double), 100.0::double) as score from counters c left join near n on n.count_point_id = c.count_point_id group by all",
    "nearest_counter": f"with {_ROWNEAR}, r as (select *, row_number() over (partition by row_id order by dm, count_point_id) as rn from near where dm < 1500.0 and all_motor_vehicles > 0) select row_id, count_point_id, round(dm, 3) as distance_m from r where rn = 1",
    "first_counter": f"with {_ROWNEAR} select row_id, min(count_point_id) as count_point_id from near where dm < 800.0 group by all",
    "semi_near": f"with {_NEAR} select distinct count_point_id from near where kind = 'Closed' and dm < 800.0",
    "spatiotemporal_pairs": f"with {_SPANS} select x.row_id as a, y.row_id as b from spans x join spans y on x.row_id < y.row_id and y.lat between x.lat - 0.005 and x.lat + 0.005 and {_hav('x.lat', 'x.lng', 'y.lat', 'y.lng')} < 400.0 and x.s <= y.t and y.s <= x.t where x.t is not null and y.t is not null and x.s is not null and y.s is not null",
    "first_division": f"with {_STRICT_RING}, m as (select row_id, min(ord) as ord from inside group by all) select p.row_id, coalesce((select min(ons_code) from ring r where r.ord = m.ord), '') as ons_code from road_status p left join m using (row_id)",
    "point_distances": f"with {_COUNTERS} select count_point_id, round({_hav('lat', 'lng', '53.1::double', '-1.55::double')}, 3) as distance_m from counters",
    "counters_with_volume": "with b as (select road_name, count_point_id as from_point, all_motor_vehicles as volume, row_number() over (partition by road_name order by all_motor_vehicles desc, count_point_id) as rn from count_points where all_motor_vehicles is not null) select c.count_point_id, from_point, volume from count_points c left join b on b.road_name = c.road_name and rn = 1",
    "junction_index": f"""with {_NEAR}, g as (select c.count_point_id, c.all_motor_vehicles as v, coalesce(sum(case when dm < 500.0 then greatest(0.0::double, 1.0::double - dm / 500.0::double) * 100.0::double end), 0.0::double) as w,
        coalesce(sum(case when dm < 500.0 and kind = 'Closed' then 1 end), 0) as closed, cast(coalesce({_KIND_SCORE}, 0) as double) as score from counters c left join near n on n.count_point_id = c.count_point_id group by all),
      s as (select count_point_id, round_even(least(100.0::double, coalesce(v / 300.0::double, 15.0::double)) * 0.4::double + least(100.0::double, w) * 0.3::double + least(100.0::double, closed * 30.0::double) * 0.2::double + least(100.0::double, score) * 0.1::double, 1) as index from g)
      select *, case when index >= 70 then 'critical' when index >= 50 then 'high' when index >= 30 then 'medium' else 'low' end as level from s""",
    "works_tagged": f"{_TAGGED} select * from tagged",
    "road_classes": f"""{W}, t as (select id, road, description, regexp_extract(upper(trim(road, ' ')), '^([MAB])[0-9]', 1) as k from works)
      select id, case when road = '' then 'minor' when contains(upper(description), 'A6997') or contains(upper(description), 'A6211') then 'a_road' when k = 'M' then 'motorway' when k = 'A' then 'a_road' when k = 'B' then 'b_road' else 'minor' end as road_class,
      cast(case when road = '' then 500 when k = 'M' then 80000 when k = 'A' then 15000 when k = 'B' then 5000 when len(list_filter({_QUIET}, lambda w: contains(lower(road), w) or contains(lower(description), w))) > 0 then 200
        when len(list_filter({_BUSIER}, lambda w: ends_with(rtrim(lower(road), ' '), w))) > 0 then 3000 else 1500 end as bigint) as volume from t""",
    "coverage_counters": f"""{_TAGGED}, c as (select count(*) as works, count(*) filter (is_started) as started, count(*) filter (is_bridge) as bridges, count(*) filter (project is not null) as in_projects, count(*) filter (restriction_class = 'full_closure') as closures from tagged)
      select *, started + bridges + in_projects + closures as covered from c""",
    "corridor_scores": f"""{W}, {_COUNTERS}, {_LINES}, f as (select ons_code, i, arg_min(all_motor_vehicles, count_point_id) as v from vertex join counters on lat between vlat - 0.01 and vlat + 0.01 and all_motor_vehicles > 0 and {_hav('vlat', 'vlng', 'lat', 'lng')} < 800.0 group by all),
      m as (select l.ons_code, any_value(base) as base, coalesce(avg(cast(v as double)), 0.0::double) as mean, count(v) as hits from vertex l left join f on f.ons_code = l.ons_code and f.i = l.i group by all),
      s as (select ons_code, round_even(least(base + least(mean / 50000.0::double, 1.0::double) * 0.3::double + least((select count(*) from live) * 0.02::double, 0.3::double), 1.0::double), 2) as severity, cast(floor(mean) as bigint) as vehicles, hits from m)
      select *, case when severity >= 0.8 then 'critical' when severity >= 0.6 then 'severe' when severity >= 0.4 then 'high' when severity >= 0.2 then 'moderate' else 'low' end as level from s""",
    "corridor_clashes": f"""{W}, {_LINES}, t as (select id, lat, lng, floor(start_ms / {_DAY}.0) as a, floor(end_ms / {_DAY}.0) as b, cast({_CLASS} as double) as capacity from live where end_ms is null or floor(end_ms / {_DAY}.0) >= {_AS_OF}),
      n as (select distinct ons_code, id, a, b, capacity from vertex join t on lat between vlat - 0.005 and vlat + 0.005 and {_hav('vlat', 'vlng', 'lat', 'lng')} < 300.0),
      p as (select x.ons_code, count(*) as pairs from n x join n y on x.ons_code = y.ons_code and x.id < y.id and x.a is not null and y.a is not null and (x.b is null or x.b >= x.a) and (y.b is null or y.b >= y.a) and not coalesce(x.b < y.a, false) and not coalesce(y.b < x.a, false) group by all),
      g as (select ons_code, count(*) as works, round_even(sum(capacity), 2) as capacity from n group by all)
      select g.*, pairs, case when capacity >= 1.5 then 'critical' when capacity >= 1.0 then 'high' else 'moderate' end as level from g join p using (ons_code) where works >= 2""",
    "event_dates": f"""with {_COUNTERS}, {_EVENTS}, l as (select count_point_id, list_filter(days, lambda x: x >= {_AS_OF}) as days from evd) select count_point_id, len(days) as n, days[1] as first_day, days[-1] as last_day from l where len(days) > 0""",
    "work_events": f"{_TIMED} select id, min(count_point_id) as count_point_id, arg_min(day, count_point_id) as day from hit where dm <= radius_m group by id",
    "event_works": f"""{_TIMED}, h as (select count_point_id, id, row_number() over (partition by count_point_id order by dm, id) as rn from hit where dm < radius_m)
      select e.count_point_id, count(id) as works, coalesce(string_agg(cast(id as varchar), ' ' order by rn) filter (rn <= 3), '') as nearest from evd e left join h using (count_point_id) group by all""",
    "heatmap_profiles": f"""{W}, d as (select unnest(range({_AS_OF}, {_AS_OF + 7})) as day), n as (select day, count(id) as n from d left join live on floor(start_ms / {_DAY}.0) <= day and floor(end_ms / {_DAY}.0) >= day group by all)
      select day, cast(h as int) as hour, round_even(cast(case when (day + 3) % 7 >= 5 then [2,1,1,1,1,2,3,4,5,6,7,8,8,8,7,7,6,6,5,5,4,4,3,3][h + 1] else {_PROFILE}[h + 1] end as double)
        + case when (day + 3) % 7 < 5 and (day between 20459 and 20543 or day between 20556 and 20654 or day between 20332 and 20439) then case h when 8 then 3.0::double when 15 then 2.5::double else 0.0::double end else 0.0::double end
        + case when h between 7 and 18 then least(n * 0.15::double, 3.0::double) else 0.0::double end, 2) as flow from n, (select unnest(range(0, 24)) as h)""",
    "nation_winner": "with c as (select c_nationkey as k, avg(c_acctbal) as c from customer group by all), s as (select s_nationkey as k, avg(s_acctbal) as s from supplier group by all) select k, c >= s as ahead, c <= s as behind from c left join s using (k)",
}

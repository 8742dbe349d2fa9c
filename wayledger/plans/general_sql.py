"""DuckDB SQL for the queries of wayledger.plans.general that SQL can express."""

BLANK = r"[\s\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200B}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+"
_STRIP = f"regexp_replace(%s, '{BLANK}', '', 'g')"
_SQUASH = f"trim(regexp_replace(%s, '{BLANK}', ' ', 'g'))"

_ZONED = "(Z|UTC|GMT|BST|EST|EDT)?([+-][0-9]{2}:?[0-9]{2})?$"
_DATES = ["%Y-%m-%dT%H:%M:%S.%g", "%Y-%m-%dT%H:%M:%S", "%Y-%m-%d %H:%M:%S", "%Y-%m-%d %H:%M", "%Y-%m-%d", "%Y%m%dT%H%M%S", "%d %b %Y %H:%M:%S", "%a, %d %b %Y %H:%M:%S", "%d %b %Y, %H.%M"]
_DAY_FIRST, _MONTH_FIRST = (["%d/%m/%Y %H:%M:%S", "%d/%m/%Y %I:%M %p"], ["%m/%d/%Y %H:%M:%S", "%m/%d/%Y %I:%M %p"])


def instant(value: str, zone: str, day_first: str) -> str:
    """Epoch milliseconds of a text in any of the forms of the project's tables; null where it denotes no instant. A local
    time that occurs twice is the first, one that is skipped moves on: the earlier of its own reading and of that of an
    hour before, an hour later."""
    t = f"trim({value}, ' ')"
    local = rf"regexp_replace(regexp_replace({t}, ' ?{_ZONED}', ''), '(\.[0-9]{{3}})[0-9]+$', '\1')"
    at = f"coalesce(try_strptime({local}, {_DATES}), case when coalesce({day_first}, true) then coalesce(try_strptime({local}, {_DAY_FIRST}), try_strptime({local}, {_MONTH_FIRST})) else coalesce(try_strptime({local}, {_MONTH_FIRST}), try_strptime({local}, {_DAY_FIRST})) end)"
    part = lambda k: f"regexp_extract({t}, '([+-])([0-9]{{2}}):?([0-9]{{2}})$', {k})"
    offset = f"(case regexp_extract({t}, '{_ZONED}', 1) when 'BST' then 3600 when 'EDT' then -14400 when 'EST' then -18000 else 0 end + case {part(1)} when '' then 0 when '-' then -1 else 1 end * (coalesce(try_cast({part(2)} as bigint), 0) * 3600 + coalesce(try_cast({part(3)} as bigint), 0) * 60))"
    own = f"coalesce({zone}, 'UTC')"
    return f"""(case when regexp_full_match({t}, '[0-9]{{13}}([.][0-9]+)?') then nullif(cast(substr({t}, 1, 13) as bigint), 0) when regexp_full_match({t}, '[0-9]{{16}}') then cast({t} as bigint) // 1000
      when regexp_full_match({t}, '[0-9]{{10}}') then nullif(cast({t} as bigint), 0) * 1000 when {t} like '/Date(%' then cast(regexp_extract({t}, '[0-9]{{13}}') as bigint)
      when regexp_extract({t}, '{_ZONED}', 0) <> '' then epoch_ms({at}) - {offset} * 1000
      else epoch_ms(least(timezone({own}, {at}), timezone({own}, {at} - interval 1 hour) + interval 1 hour)) end)"""


_REPORTS = rf"""
reports as (
  select *, nullif(regexp_replace(regexp_replace(regexp_replace(regexp_replace({_STRIP % "id"}, '[^0-9.,]', '', 'g'), '[.][0-9]*$', ''), '[^0-9]', '', 'g'), '^0+', ''), '') as report_no,
         try_cast(nullif(trim(updated), '') as timestamptz) as updated_at
  from fixmystreet)
"""
_RANKED = f"with {_REPORTS}, ranked as (select *, row_number() over (partition by report_no order by updated_at desc nulls last, delivery_id) as rn from reports)"

_STATES = f"""
with works as (
  select snapshot_no, upper({_STRIP % "referenceno"}) as referenceno, coalesce(lower({_SQUASH % "worksstate"}), '') as state from roadworks),
one as (
  select snapshot_no, referenceno, case when bool_or(state = 'works started') then 'works started' else min(state) end as state
  from works where referenceno <> '' group by all),
nos as (select snapshot_no, lag(snapshot_no) over (order by snapshot_no) as prev from (select distinct snapshot_no from roadworks)),
old as (select n.snapshot_no, o.referenceno, o.state from nos n join one o on o.snapshot_no = n.prev),
new as (select n.snapshot_no, o.referenceno, o.state from nos n join one o using (snapshot_no) where n.prev is not null),
changes as (
  select snapshot_no, referenceno, case when o.state is null then 'added' when n.state is null then 'removed' else 'changed' end as change_kind
  from old o full join new n using (snapshot_no, referenceno) where o.state is distinct from n.state)
"""


def _coordinate(c: str) -> str:
    s = rf"replace(upper({_STRIP % c}), ',', '.')"
    body = rf"regexp_replace({s}, '^[NSEW]|[NSEW]$', '')"
    dms = r"'^([0-9]+)°([0-9]+)''([0-9.]+)\"$'"
    return rf"""(case when {s} like '-%' or {s} similar to '.*[SW]' then -1 else 1 end * case
      when regexp_matches({body}, {dms}) then try_cast(regexp_extract({body}, {dms}, 1) as double) + try_cast(regexp_extract({body}, {dms}, 2) as double) / 60.0 + try_cast(regexp_extract({body}, {dms}, 3) as double) / 3600.0
      else abs(try_cast({body} as double)) end)"""


_PLACES = rf"""
with corner as (select v[2] as lat, v[1] as lng from (select unnest(coordinates) as v from burnley_ceds)
  union all select try_cast(latitude as double), try_cast(longitude as double) from count_points),
box as (select min(lat) - 0.02 as a, max(lat) + 0.02 as b, min(lng) - 0.02 as c, max(lng) + 0.02 as d from corner),
raw as (select delivery_id, {_coordinate("lat")} as y, {_coordinate("lng")} as x from fixmystreet),
pts as (select delivery_id, case when y between a and b and x between c and d then y when x between a and b and y between c and d then x end as lat,
  case when y between a and b and x between c and d then x when x between a and b and y between c and d then y end as lng from raw, box),
ring as (select ons_code, coordinates as r, len(coordinates) as n, list_aggregate([v[1] for v in coordinates], 'min') as x0, list_aggregate([v[1] for v in coordinates], 'max') as x1,
  list_aggregate([v[2] for v in coordinates], 'min') as y0, list_aggregate([v[2] for v in coordinates], 'max') as y1 from burnley_ceds),
edge as (select ons_code, r[i][1] as ax, r[i][2] as ay, r[i % n + 1][1] as xb, r[i % n + 1][2] as yb from (select *, unnest(range(1, n + 1)) as i from ring)),
boxed as (select delivery_id, lat, lng, ons_code from pts join ring on lng between x0 and x1 and lat between y0 and y1),
inside as (select delivery_id, b.ons_code from boxed b join edge e on e.ons_code = b.ons_code and ((ay > lat) != (yb > lat)) and lng < ax + (lat - ay) * (xb - ax) / (yb - ay)
  group by all having count(*) % 2 = 1),
cp as (select count_point_id, try_cast(latitude as double) as clat, try_cast(longitude as double) as clng from count_points),
near as (select delivery_id, count_point_id from pts join cp on lat between clat - 0.0014 and clat + 0.0014 and lng between clng - 0.004 and clng + 0.004
  where 2 * 6371000.0 * asin(sqrt(pow(sin(radians(clat - lat) / 2), 2) + cos(radians(lat)) * cos(radians(clat)) * pow(sin(radians(clng - lng) / 2), 2))) < 150.0),
found as (select delivery_id, 'division' as target_kind, ons_code as target from inside union all select delivery_id, 'count_point', cast(count_point_id as varchar) from near)
"""

_EPOCH, _ISO_Z = "[0-9]{13}", "[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}Z"
_TIMES = (("roadworks", "row_id", "validfrom", _EPOCH), ("roadworks", "row_id", "creationtime", _EPOCH), ("fixmystreet", "delivery_id", "reported", _ISO_Z))
_UNUSUAL = f"""odd as ({" union all ".join(f"select '{t}' as src_table, {k} as row_key, '{f}' as field_name, {f} as v, feed from {t} where not regexp_full_match({f}, '{usual}')" for t, k, f, usual in _TIMES)}),
  seen as (select src_table, row_key, field_name, {instant("v", "zone_name", "day_first")} as utc_ms from odd left join feeds using (feed)),
  found as (select * from seen where utc_ms is not null)"""
_SPANS = """o as (select *, max(b) over (partition by road order by a, b rows between unbounded preceding and 1 preceding) as reach from t where road <> '' and a < b),
      r as (select *, sum(case when reach >= a then 0 else 1 end) over (partition by road order by a, b rows unbounded preceding) as run from o),
      p as (select road, run, min(a) as a, max(b) as b from r group by all),
      g as (select road, lag(b) over (partition by road order by a) as a, a as b from p)
      select road, 'period' as span_kind, a as from_ms, b as to_ms from p union all select road, 'gap', a, b from g where a is not null"""

SQL = {
    "p1_found": f"{_RANKED} select delivery_id from ranked where report_no is not null and rn > 1",
    "p1_reports": f"{_RANKED} select delivery_id, report_no, batch_no, title, status from ranked where report_no is null or rn = 1",
    "p1_new_batches": f"""with {_REPORTS}, cut as (select floor(max(batch_no) * 0.9) as cut from fixmystreet),
      new as (select r.*, row_number() over (partition by report_no order by updated_at desc nulls last, delivery_id) as rn from reports r, cut where batch_no > cut)
      select delivery_id, report_no from new where report_no is null or (rn = 1 and report_no not in (select report_no from reports, cut where batch_no <= cut and report_no is not null))""",
    "p2_found": f"{_STATES} select snapshot_no, referenceno, change_kind from changes",
    "p2_change_counts": f"{_STATES} select snapshot_no, change_kind, count(*) as n from changes group by all",
    "p3_layer_spans": f"""with t as (select distinct lower({_SQUASH % "road"}) as road, epoch_ms(start_date) as a, epoch_ms(end_date) as b from road_status),
      {_SPANS}""",
    "p3_found": f"""with t as (select distinct lower({_SQUASH % "linkname"}) as road, {instant("validfrom", "zone_name", "day_first")} as a, {instant("validto", "zone_name", "day_first")} as b from roadworks left join feeds using (feed)),
      {_SPANS}""",
    "p5_found": f"with {_UNUSUAL} select src_table, row_key, field_name, utc_ms from found",
    "p5_forms": f"""with {_UNUSUAL}, n as ({" union all ".join(f"select '{t}' as src_table, '{f}' as field_name, count({f}) as in_all, count(*) filter (regexp_full_match({f}, '{usual}')) as usual from {t}" for t, k, f, usual in _TIMES)}),
      g as (select src_table, field_name, count(*) as other_form from found group by all)
      select src_table, field_name, in_all, usual, coalesce(other_form, 0) as other_form, in_all - usual - coalesce(other_form, 0) as none from n left join g using (src_table, field_name)""",
    "p4_found": f"{_PLACES} select delivery_id, target_kind, target from found",
    "p4_division_counts": f"{_PLACES} select target_kind, target, count(*) as n from found group by all",
}

"""Column builders for ordered rules, tiers, keywords and labels. The rules themselves are parameters."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def first_rule(rules: Sequence[tuple[Column, object]], default: object = None) -> Column:
    """Value of the first rule whose condition holds; a null condition doesn't hold."""
    out = None
    for condition, value in rules:
        value = value if isinstance(value, Column) else F.lit(value)
        out = F.when(condition, value) if out is None else out.when(condition, value)
    default = default if isinstance(default, Column) else F.lit(default)
    return default if out is None else out.otherwise(default)


def tier(value: Column | str, steps: Sequence[tuple[float, str]], lowest: str, strict: bool = False) -> Column:
    """Name of the highest step that the value reaches (strict: passes)."""
    v = _c(value)
    return first_rule([((v > s) if strict else (v >= s), name) for s, name in sorted(steps, reverse=True)], lowest)


def any_keyword(text: Column | str, keywords: Sequence[str]) -> Column:
    """Whether the text, in lower case, contains one of the keywords; false for null."""
    low = F.lower(_c(text))
    return F.coalesce(reduce(lambda a, b: a | b, [low.contains(k.lower()) for k in keywords], F.lit(False)), F.lit(False))


def keyword_hits(text: Column | str, keywords: Sequence[str]) -> Column:
    """How many of the keywords the text contains; 0 for null."""
    low = F.lower(_c(text))
    return reduce(lambda a, b: a + b, [F.coalesce(low.contains(k.lower()), F.lit(False)).cast("int") for k in keywords], F.lit(0))


def either_contains(a: Column | str, b: Column | str, blank_matches: bool = False) -> Column:
    """Whether one text contains the other, ignoring case. A blank text matches only if asked to."""
    a, b = F.lower(_c(a)), F.lower(_c(b))
    hit = a.contains(b) | b.contains(a)
    return F.coalesce(hit if blank_matches else hit & (a != "") & (b != ""), F.lit(False))


def mapped(value: Column | str, table: dict[str, str]) -> Column:
    """Value by a table of any size that fits a literal; the value itself where the table has none."""
    v = _c(value)
    return F.coalesce(F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[v], v) if table else v


def strip_suffix(value: Column | str, suffix: str) -> Column:
    """Without every occurrence of the suffix, trimmed."""
    return F.trim(F.replace(_c(value), F.lit(suffix), F.lit("")))


def camel_words(value: Column | str, nothing: str = "None") -> Column:
    """camelCase to words with a capital first letter, letters as they are otherwise; `nothing` for null and empty."""
    words = F.regexp_replace(F.nullif(_c(value), F.lit("")), "([a-z])([A-Z])", "$1 $2")
    return F.coalesce(F.concat(F.upper(F.substring(words, 1, 1)), F.substring(words, F.lit(2), F.length(words))), F.lit(nothing))


def duration_label(days: Column | str) -> Column:
    """Days as '1 day' (also 0 and null), 'n days', 'n wk(s)' (from 7) or 'n mo(s)' (from 30), halves rounded up."""
    d = F.coalesce(_c(days), F.lit(0))

    def many(per: int, unit: str) -> Column:
        n = F.floor(d / F.lit(per) + F.lit(0.5)).cast("long")
        return F.concat(n.cast("string"), F.lit(f" {unit}"), F.when(n != 1, "s").otherwise(""))

    return first_rule([(d <= 1, "1 day"), (d < 7, F.concat(d.cast("string"), F.lit(" days"))), (d < 30, many(7, "wk"))], many(30, "mo"))


def is_postcode(value: Column | str) -> Column:
    return F.coalesce(F.trim(_c(value)).rlike(r"(?i)^[A-Z]{1,2}\d[A-Z\d]?\s*\d[A-Z]{2}$"), F.lit(False))


def clamp(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def weighted(parts: Sequence[tuple[Column, float]], digits: int = 1) -> Column:
    """Sum of parts, each held to 0..100, by weight; half-even rounding."""
    return F.bround(reduce(lambda a, b: a + b, [clamp(p, 0.0, 100.0) * w for p, w in parts]), digits)


def trend(short: Column, long: Column, periods: float = 3.0, up: float = 1.2, down: float = 0.8) -> Column:
    """increasing, decreasing or stable: a short count against the long one divided by its number of periods."""
    usual = long / F.lit(periods)
    return first_rule([(short > usual * up, "increasing"), (short < usual * down, "decreasing")], "stable")


def first_of(*values: Column | str) -> Column:
    """First value that is neither null nor blank; an empty string if there is none (fields that go by several names)."""
    return F.coalesce(*[F.nullif(F.trim(_c(v)), F.lit("")) for v in values], F.lit(""))


def middle(path: Column | str) -> Column:
    """Middle vertex of a polyline; null for an empty one."""
    p = _c(path)
    return F.try_element_at(p, (F.floor(F.size(p) / 2) + 1).cast("int"))


def mean_vertex(path: Column | str, digits: int = 6) -> Column:
    """Mean of a path's vertices, [first, second], to so many digits; null for an empty one or with a null vertex."""
    p = _c(path)
    mean = lambda k: F.bround(F.try_divide(F.aggregate(p, F.lit(0.0), lambda a, v: a + v[k]), F.size(p)), digits)
    return F.when(F.size(p) > 0, F.array(mean(0), mean(1)))


def focus_window(west: Column, east: Column, south: Column, north: Column, margin: float = 0.1) -> Column:
    """A box widened on each side by a part of its width and height."""
    dx, dy = (east - west) * margin, (north - south) * margin
    return F.struct((west - dx).alias("west"), (east + dx).alias("east"), (south - dy).alias("south"), (north + dy).alias("north"))


def word_count(text: Column | str) -> Column:
    return F.size(F.filter(F.split(F.coalesce(_c(text), F.lit("")), r"\s+"), lambda w: w != ""))


def reading_minutes(text: Column | str, words_per_minute: int = 220) -> Column:
    return F.greatest(F.lit(1), F.ceil(word_count(text) / words_per_minute)).cast("long")


def strip_tags(html: Column | str) -> Column:
    return F.regexp_replace(_c(html), "<[^>]*>", "")


def xml_escape(text: Column | str) -> Column:
    out = _c(text)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def road_letter(name: Column | str) -> Column:
    """M, A or B of a road's number, at its beginning; null for other names."""
    return F.nullif(F.regexp_extract(F.upper(F.trim(_c(name))), "^([MAB])[0-9]", 1), F.lit(""))


def road_class(name: Column | str, text: Column | str | None = None, numbers: Sequence[str] = (), names: Sequence[str] = ("motorway", "a_road", "b_road", "minor")) -> Column:
    """Class of a road by its number; one of the numbers in the text makes it the second class."""
    letter = road_letter(name)
    named = F.when(letter == "M", names[0]).when(letter == "A", names[1]).when(letter == "B", names[2]).otherwise(names[3])
    if text is None or not numbers:
        return named
    hit = reduce(lambda a, b: a | b, [F.upper(_c(text)).contains(n) for n in numbers])
    return F.when(F.trim(_c(name)).isNull() | (F.trim(_c(name)) == ""), names[3]).when(F.coalesce(hit, F.lit(False)), names[1]).otherwise(named)


#: Words of quiet streets, and last words of busier ones (fixed values).
QUIET = ["rear of", "back of", "alley", "lane", "court", "close", "mews", "cul-de-sac", "terrace", "grove", "place", "rise", "walk", "crescent", "gardens", "square", "yard", "passage", "footpath", "footway", "bridleway", "access road", "service road"]
BUSIER = ["road", "street", "avenue", "way", "drive", "boulevard", "highway"]


def estimated_volume(name: Column | str, text: Column | str, steps: dict[str, int]) -> Column:
    """Vehicles a day by a road's name, where none were counted: steps for M, A, B, quiet, busier, other and unnamed."""
    low, letter = F.lower(_c(name)), road_letter(name)
    ends = reduce(lambda a, b: a | b, [F.endswith(F.rtrim(low), F.lit(w)) for w in BUSIER])
    quiet = any_keyword(name, QUIET) | any_keyword(text, QUIET)
    by_letter = [(letter == k, steps[k]) for k in "MAB"]
    return first_rule([(F.coalesce(_c(name), F.lit("")) == "", steps["unnamed"]), *by_letter, (quiet, steps["quiet"]), (ends, steps["busier"])], steps["other"])


def ahead(a: Column | str, b: Column | str, lower_is_better: bool = False) -> Column:
    """Whether a is as good as b or better; null if one is missing."""
    return (_c(a) <= _c(b)) if lower_is_better else (_c(a) >= _c(b))


def in_box(lat: Column | str, lng: Column | str, box: tuple[float, float, float, float]) -> Column:
    """Whether a place is within (south, north, west, east), edges included; 0 and null are no places."""
    a, b = _c(lat), _c(lng)
    return F.coalesce((a != 0) & (b != 0) & a.between(box[0], box[1]) & b.between(box[2], box[3]), F.lit(False))


def first_project(projects: Sequence[dict], lat: str, lng: str, road: str, text: str, owner: Column) -> Column:
    """Name of the first project (name, box, roads, keywords) whose box holds the place and that shares a road's name, or,
    for the owner's works, two keywords; null if there is none."""
    return first_rule([(in_box(lat, lng, p["box"]) & (reduce(lambda a, b: a | b, [either_contains(road, F.lit(r), True) for r in p["roads"]], F.lit(False)) | (owner & (keyword_hits(text, p["keywords"]) >= 2))), p["name"]) for p in projects])


def dates_ahead(dates: Column | str, day: int) -> Column:
    """The days of a list that aren't before a day; null if none is left."""
    left = F.filter(_c(dates), lambda d: d >= day)
    return F.when(F.size(left) > 0, left)

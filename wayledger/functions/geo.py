"""Column builders for places."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wayledger.functions.text import strip_all

EARTH_M = 6_371_000.0
#: Metres of one degree of latitude.
DEGREE_M = EARTH_M * 3.141592653589793 / 180.0

_DMS = r"^([0-9]{1,3})[°ºd:]([0-9]{1,2})(?:['′’m:]([0-9]{1,2}(?:\.[0-9]+)?)?(?:[\"″”s]|'')?)?$"


def coordinate(c: Column | str) -> Column:
    """Degrees from a text: decimal with point or comma, with exponent, with a letter for the half of the globe, or in
    degrees, minutes and seconds. Null where it is none of these."""
    s = F.regexp_replace(F.upper(F.regexp_replace(strip_all(c), ",", ".")), "[−–]", "-")
    half = F.regexp_extract(s, "(^[NSEW]|[NSEW]$)", 1)
    body = F.lower(F.regexp_replace(s, "(^[NSEW]|[NSEW]$)", ""))
    bare = F.regexp_replace(body, "^[-+]", "")
    part = lambda k: F.regexp_extract(bare, _DMS, k).try_cast("double")
    plain = F.when(bare.rlike(r"^([0-9]+\.?[0-9]*|\.[0-9]+)(e[-+]?[0-9]{1,2})?°?$"), F.regexp_replace(bare, "°", "").try_cast("double"))
    dms = F.when(bare.rlike(_DMS), part(1) + part(2) / 60.0 + F.coalesce(part(3), F.lit(0.0)) / 3600.0)
    value = F.coalesce(plain, dms)
    general = F.when(body.startswith("-") | half.isin("S", "W"), -value).otherwise(value)
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c.rlike(r"^-?[0-9]{1,3}\.[0-9]{1,15}$"), c.try_cast("double")).otherwise(general)


def haversine_m(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Metres on the sphere."""
    p, q = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((q - p) / 2.0), 2) + F.cos(p) * F.cos(q) * F.pow(F.sin(F.radians(lng2 - lng1) / 2.0), 2)
    return 2.0 * EARTH_M * F.atan2(F.sqrt(h), F.sqrt(1.0 - F.least(h, F.lit(1.0))))

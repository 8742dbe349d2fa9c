"""Column builders for dates and times. Zone-less timestamps mean UTC, whatever the session's zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def epoch_ms(c: str) -> Column:
    """Epoch milliseconds of a zone-less timestamp column."""
    return F.expr(f"timestampdiff(MILLISECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', `{c}`)")


def epoch_s(c: str) -> Column:
    return F.expr(f"timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', `{c}`)")


def floor_days(later: Column, earlier: Column) -> Column:
    """Whole days between two epoch seconds, towards minus infinity."""
    return F.floor((later - earlier) / F.lit(86400)).cast("long")


def calendar_days(later: Column | str, earlier: Column | str) -> Column:
    """Midnights between two dates, at least 1; 0 if one is missing."""
    n = F.datediff(later, earlier)
    return F.coalesce(F.greatest(n, F.lit(1)), F.lit(0)).cast("long")



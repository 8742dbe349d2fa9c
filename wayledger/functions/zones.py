"""Zone transition tables: the offsets of each zone as sorted arrays, built once from the installed zone data and
stamped with its version, so that a conversion is a binary search over whole arrays."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import UTC, datetime
from functools import lru_cache
from pathlib import Path
from zoneinfo import ZoneInfo

import numpy as np

#: Offsets in seconds of zone abbreviations (fixed values).
ABBREVIATIONS = {
    "Z": 0, "UTC": 0, "GMT": 0, "UT": 0, "WET": 0,
    "BST": 3600, "IST": 3600, "WEST": 3600, "CET": 3600, "CEST": 7200, "EET": 7200, "EEST": 10800,
    "EST": -18000, "EDT": -14400, "CST": -21600, "CDT": -18000, "MST": -25200, "MDT": -21600, "PST": -28800, "PDT": -25200,
}


def zone_version() -> str:
    """Version of the zone data in use."""
    try:
        import tzdata

        return tzdata.IANA_VERSION
    except ImportError:
        named = Path("/usr/share/zoneinfo/tzdata.zi")
        return named.open().readline().split()[-1] if named.exists() else "unknown"


def _offset(zone: ZoneInfo, second: int) -> int:
    return int(datetime.fromtimestamp(second, zone).utcoffset().total_seconds())


#: Zone data begins after the first year; from REPEAT on only the zones' last rules hold. The Gregorian calendar repeats
#: itself, days of the week included, every CYCLE seconds (400 years).
FIRST_YEAR, REPEAT, CYCLE = 1840, 2100, 146_097 * 86_400


@lru_cache(maxsize=1024)
def transitions(zone_name: str, first_year: int = FIRST_YEAR, last_year: int = REPEAT + 401, step_days: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """(instants at which the offset changes, offsets): offsets[0] holds before the first change, offsets[i + 1] after
    change i. What comes after the last year repeats the 400 years before it."""
    zone = ZoneInfo(zone_name)
    start, end = (int(datetime(y, 1, 1, tzinfo=UTC).timestamp()) for y in (first_year, last_year))
    at, offsets, step = [], [_offset(zone, start)], step_days * 86400
    for lo in range(start, end, step):
        hi = min(lo + step, end)
        if _offset(zone, hi) != offsets[-1]:
            a, b = lo, hi
            while b - a > 1:
                mid = (a + b) // 2
                a, b = (a, mid) if _offset(zone, mid) != offsets[-1] else (mid, b)
            at.append(b)
            offsets.append(_offset(zone, hi))
    return np.array(at, dtype=np.int64), np.array(offsets, dtype=np.int64)


def zone_tables(zone_names: Iterable[str]) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Per zone (local thresholds, offsets) for to_utc. Names that are no zone are left out."""
    tables = {}
    for name in zone_names:
        try:
            at, offsets = transitions(name)
        except (KeyError, ValueError, OSError):
            continue
        tables[name] = (at + np.maximum(offsets[:-1], offsets[1:]), offsets)
    return tables


_REPEAT_S = int(datetime(REPEAT, 1, 2, tzinfo=UTC).timestamp())


def to_utc(local_s: np.ndarray, table: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """UTC seconds of local seconds, of any year. A local time that occurs twice means the first; a skipped one moves forward
    by the length of the skip. Both are the offset before the change, which thus holds up to the later of its two local
    readings."""
    thresholds, offsets = table
    far = np.maximum(local_s - _REPEAT_S, 0) // CYCLE * CYCLE
    return local_s - offsets[np.searchsorted(thresholds, local_s - far, side="right")]

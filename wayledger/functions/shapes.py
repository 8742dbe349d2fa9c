"""Instants from text of mixed form. A value becomes its shape mask, every character replaced by its class; values of one
mask have all fields at the same places, so each distinct mask is given a parser once and the parser then reads the
fields of all its values as columns of a byte matrix."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

from wayledger.functions.zones import ABBREVIATIONS, to_utc

WIDTH = 64  # no form is longer but for decimals, of which any number may follow; longer values lose those beyond the ninth
_DECIMALS = re.compile(rb"([.,][0-9]{9})[0-9]+")
NONE = np.iinfo(np.int64).min
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")

_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[ord("0") : ord("9") + 1] = ord("9")
_CLASS[ord("A") : ord("Z") + 1] = ord("A")
_CLASS[ord("a") : ord("z") + 1] = ord("a")

_CLOCK = r"(?P<h>9{1,2})[:.](?P<mi>99)(?:[:.](?P<s>99)(?:[.,](?P<f>9+))?)?(?: ?(?P<ap>AA|aa)(?![Aa]))?"
_ZONE = r"(?: ?(?P<z>A{1,4})?(?P<o>[+-]99(?::?99)?)?)"
#: Forms as patterns over masks. The group names tell what the parser reads: an epoch e with decimals f; or year y, month
#: m (a number) or mn (a name), day d, or two numbers a and b in the order of the feed; clock h, mi, s, f, ap; zone z, offset o.
FORMS = [
    re.compile(p)
    for p in (
        r"^(?P<e>9{9,13}|9{16}|9{18,19})(?:\.(?P<f>9+))?$",
        r"^/Aaaa\((?P<e>9{9,13})(?:[+-]9999)?\)/$",
        r"^(?P<y>9999)(?P<m>99)(?P<d>99)(?:[A ]?(?P<h>99)(?P<mi>99)(?P<s>99)?(?:[.,](?P<f>9+))?)?" + _ZONE + "$",
        r"^(?P<y>9999)[-/.](?P<m>9{1,2})[-/.](?P<d>9{1,2})(?:(?:A| |, )" + _CLOCK + _ZONE + ")?$",
        r"^(?P<a>9{1,2})[-/.](?P<b>9{1,2})[-/.](?P<y>9999)(?:(?:A| |, )" + _CLOCK + _ZONE + ")?$",
        r"^(?:Aa{2,8},? )?(?P<d>9{1,2})[ -](?P<mn>[Aa]{3,9})[ -](?P<y>9999)(?:,? " + _CLOCK + _ZONE + ")?$",
        r"^(?:Aa{2,8},? )?(?P<mn>[Aa]{3,9}) (?P<d>9{1,2}),? (?P<y>9999)(?:,? " + _CLOCK + _ZONE + ")?$",
    )
]


@dataclass(frozen=True)
class Parser:
    """Where the fields of a mask stand: name -> (from, to)."""

    at: dict[str, tuple[int, int]]

    def number(self, chars: np.ndarray, name: str, default: int = 0) -> np.ndarray:
        if name not in self.at:
            return np.full(len(chars), default, dtype=np.int64)
        lo, hi = self.at[name]
        out = np.zeros(len(chars), dtype=np.int64)
        for k in range(lo, hi):
            out = out * 10 + (chars[:, k].astype(np.int64) - 48)
        return out

    def fraction_ms(self, chars: np.ndarray) -> np.ndarray:
        """Decimals of a second in whole milliseconds, finer digits dropped."""
        if "f" not in self.at:
            return np.zeros(len(chars), dtype=np.int64)
        lo, hi = self.at["f"]
        out = np.zeros(len(chars), dtype=np.int64)
        for k in range(3):
            out = out * 10 + (chars[:, lo + k].astype(np.int64) - 48 if lo + k < hi else 0)
        return out

    def words(self, chars: np.ndarray, name: str, value: Callable[[str], int | None]) -> tuple[np.ndarray, np.ndarray]:
        """(values, known) of a field of letters; each distinct word is looked up once."""
        lo, hi = self.at[name]
        own, back = np.unique(np.ascontiguousarray(chars[:, lo:hi]).view(f"S{hi - lo}").ravel(), return_inverse=True)
        got = [value(w.decode("latin1")) for w in own]
        return np.array([0 if g is None else g for g in got], dtype=np.int64)[back], np.array([g is not None for g in got])[back]


_parsers: dict[bytes, Parser | None] = {}


def parser_of(mask: bytes) -> Parser | None:
    """The parser of a mask, found once a process; None for masks that denote no instant."""
    if mask not in _parsers:
        if len(_parsers) > 100_000:  # masks of junk don't fill the memory
            _parsers.clear()
        text = mask.decode("latin1")
        m = next((m for p in FORMS if (m := p.match(text))), None) if "9" in text else None
        _parsers[mask] = m and Parser({k: m.span(k) for k in m.groupdict() if m.group(k) is not None})
    return _parsers[mask]


def _month(word: str) -> int | None:
    return MONTHS.index(word[:3].lower()) + 1 if word[:3].lower() in MONTHS else None


def _days(y: np.ndarray, m: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Days since 1970-01-01 of a proleptic Gregorian date."""
    y = y - (m <= 2)
    era = y // 400
    yoe = y - era * 400
    doy = (153 * (m + np.where(m > 2, -3, 9)) + 2) // 5 + d - 1
    return era * 146097 + yoe * 365 + yoe // 4 - yoe // 100 + doy - 719468


_LENGTHS = np.array([0, 31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31])


def _read(p: Parser, chars: np.ndarray, zones: np.ndarray, day_first: np.ndarray, tables: dict) -> np.ndarray:
    if "e" in p.at:
        e, digits = p.number(chars, "e"), p.at["e"][1] - p.at["e"][0]
        if digits <= 11:
            ms = e * 1000 + p.fraction_ms(chars)
        else:
            ms = e // {12: 1, 13: 1, 16: 1000, 18: 1_000_000, 19: 1_000_000}[digits]
        return np.where(e == 0, NONE, ms)
    ok = np.ones(len(chars), dtype=bool)
    y = p.number(chars, "y")
    if "a" in p.at:
        a, b = p.number(chars, "a"), p.number(chars, "b")
        d, m = np.where(day_first, a, b), np.where(day_first, b, a)
        flip = (m > 12) & (d <= 12)  # only one order can be meant
        d, m = np.where(flip, m, d), np.where(flip, d, m)
    else:
        d = p.number(chars, "d")
        if "mn" in p.at:
            m, known = p.words(chars, "mn", _month)
            ok &= known
        else:
            m = p.number(chars, "m")
    h, mi, s = (p.number(chars, k) for k in ("h", "mi", "s"))
    if "ap" in p.at:
        pm, known = p.words(chars, "ap", lambda w: {"am": 0, "pm": 1}.get(w.lower()))
        ok &= known & (h >= 1) & (h <= 12)
        h = h % 12 + 12 * pm
    leap = (y % 4 == 0) & ((y % 100 != 0) | (y % 400 == 0))
    ok &= (y > 0) & (m >= 1) & (m <= 12)
    ok &= (d >= 1) & (d <= _LENGTHS[np.clip(m, 0, 12)] + (leap & (m == 2))) & (mi < 60) & (s <= 60)
    ok &= (h < 24) | ((h == 24) & (mi == 0) & (s == 0))
    local = _days(y, np.clip(m, 1, 12), d) * 86400 + h * 3600 + mi * 60 + s
    shift, named = np.zeros(len(chars), dtype=np.int64), False
    if "z" in p.at:
        named = True
        shift, known = p.words(chars, "z", lambda w: ABBREVIATIONS.get(w.upper()))
        ok &= known
    if "o" in p.at:
        named = True
        lo, hi = p.at["o"]
        digits = [k for k in range(lo + 1, hi) if k != lo + 3 or hi - lo != 6]
        n = np.zeros(len(chars), dtype=np.int64)
        for k in digits:
            n = n * 10 + (chars[:, k].astype(np.int64) - 48)
        n = n if len(digits) == 4 else n * 100
        shift = shift + np.where(chars[:, lo] == ord("-"), -1, 1) * (n // 100 * 3600 + n % 100 * 60)
    if named:
        utc = local - shift
    else:
        utc = local.copy()  # a feed without a known zone: UTC
        for zone in np.unique(zones):
            if zone in tables:
                own = zones == zone
                utc[own] = to_utc(local[own], tables[zone])
    return np.where(ok, utc * 1000 + p.fraction_ms(chars), NONE)


def instants_ms(values: list[str | None], zones: list[str | None], day_first: list[bool | None], tables: dict) -> np.ndarray:
    """Epoch milliseconds of each value, NONE where it denotes no instant. Never raises on content."""
    out = np.full(len(values), NONE, dtype=np.int64)
    if not len(values):
        return out
    raw = [b"" if v is None else v.replace("\u00a0", " ").strip().encode("ascii", "replace") for v in values]
    raw = [_DECIMALS.sub(rb"\1", v) if len(v) > WIDTH else v for v in raw]
    long = np.fromiter((len(v) > WIDTH or b"\0" in v for v in raw), dtype=bool, count=len(raw))
    chars = np.array([b"" if x else v for v, x in zip(raw, long)], dtype=f"S{WIDTH}").view(np.uint8).reshape(-1, WIDTH)
    masks, back = np.unique(_CLASS[chars].view(f"S{WIDTH}").ravel(), return_inverse=True)
    order = np.argsort(back, kind="stable")
    edges = np.searchsorted(back[order], np.arange(len(masks) + 1))
    zone_of = np.array(["" if z is None else z for z in zones], dtype=object)
    first_of = np.array([True if x is None else bool(x) for x in day_first])
    for k, mask in enumerate(masks):
        p = parser_of(bytes(mask))
        if p is not None:
            own = order[edges[k] : edges[k + 1]]
            out[own] = _read(p, chars[own], zone_of[own], first_of[own], tables)
    return out

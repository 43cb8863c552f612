"""PostgreSQL interval texts as microseconds: a plain parser, and the same as native Column expressions.

A month is 30 days and a year 365 days, as a cache or a window needs a fixed length; calendar arithmetic is Spark's own.
Forms: `interval 'x'`, `'x'::interval`, a quoted or bare text, `make_interval(k => n)`, and ISO 8601 in any of the
quoted forms. A leading minus negates the whole text; later signs negate their own part.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Microseconds of each unit, by its names.
_UNITS = {
    "us": 1, "usec": 1, "microsecond": 1, "ms": 1_000, "msec": 1_000, "millisecond": 1_000,
    "s": 1_000_000, "sec": 1_000_000, "second": 1_000_000, "m": 60_000_000, "min": 60_000_000, "minute": 60_000_000,
    "h": 3_600_000_000, "hr": 3_600_000_000, "hour": 3_600_000_000, "d": 86_400_000_000, "day": 86_400_000_000,
    "w": 604_800_000_000, "week": 604_800_000_000, "mon": 2_592_000_000_000, "month": 2_592_000_000_000,
    "y": 31_536_000_000_000, "yr": 31_536_000_000_000, "year": 31_536_000_000_000,
}
UNITS = {name + plural: size for name, size in _UNITS.items() for plural in (("", "s") if len(name) > 1 else ("",))}
_MAKE = {"years": "year", "months": "month", "weeks": "week", "days": "day", "hours": "hour", "mins": "min", "secs": "sec"}
_ISO = {"Y": "year", "M": "month", "W": "week", "D": "day", "tH": "hour", "tM": "min", "tS": "sec"}

_WRAPPED = r"""^\s*(?:interval\s*)?(?:'([^']*)'|"([^"]*)")\s*(?:::\s*interval)?\s*$"""
_PART = r"([+-]?)\s*(\d+(?:\.\d+)?)\s*([a-z]+)"
_TEXT = rf"^\s*(?:{_PART}\s*,?\s*)+$"
_MAKE_CALL = r"^\s*make_interval\s*\(\s*((?:[a-z]+\s*=>\s*-?\d+(?:\.\d+)?\s*,?\s*)+)\)\s*$"
_MAKE_PART = r"([a-z]+)\s*=>\s*(-?\d+(?:\.\d+)?)"
_ISO_TEXT = r"^\s*(-?)P(?=\d|T\d)((?:\d+(?:\.\d+)?[YMWD])*)(?:T((?:\d+(?:\.\d+)?[HMS])+))?\s*$"


class IntervalError(ValueError):
    """A text that is no interval."""


def parse_interval(text: str) -> int:
    """Microseconds of an interval expression; IntervalError for anything else."""
    made = re.match(_MAKE_CALL, text, re.I)
    if made:
        total = 0.0
        for name, number in re.findall(_MAKE_PART, made[1], re.I):
            if name.lower() not in _MAKE:
                raise IntervalError(f"make_interval has no {name}")
            total += float(number) * UNITS[_MAKE[name.lower()]]
        return round(total)
    wrapped = re.match(_WRAPPED, text, re.I)
    inner = (wrapped[1] if wrapped[1] is not None else wrapped[2]) if wrapped else text
    iso = re.match(_ISO_TEXT, inner, re.I)
    if iso:
        total = 0.0
        for part, prefix in ((iso[2], ""), (iso[3] or "", "t")):
            for number, unit in re.findall(r"(\d+(?:\.\d+)?)([A-Z])", part.upper()):
                total += float(number) * UNITS[_ISO[prefix + unit]]
        return round(-total if iso[1] else total)
    low = inner.lower()
    if not re.match(_TEXT, low):
        raise IntervalError(f"not an interval: {text!r}")
    parts = re.findall(_PART, low)
    whole = -1 if parts[0][0] == "-" else 1
    total = 0.0
    for k, (sign, number, unit) in enumerate(parts):
        if unit not in UNITS:
            raise IntervalError(f"no unit {unit!r}")
        total += float(number) * UNITS[unit] * (-1 if sign == "-" and k else 1)
    return round(whole * total)


def _size_of(unit: Column, names: dict[str, int]) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in names.items() for x in pair]), unit)


def _sum(parts: Column, value) -> Column:
    """Sum of value(part) over an array of strings; null if any is null."""
    return F.aggregate(F.transform(parts, value), F.lit(0.0), lambda a, b: a + b)


def interval_micros(text: Column) -> Column:
    """parse_interval as a native expression: bigint microseconds, or null where the text is no interval."""
    number = lambda part, pattern, group: F.regexp_extract(part, pattern, group).cast("double")
    made_sizes = {name: UNITS[unit] for name, unit in _MAKE.items()}
    call = F.regexp_extract_all(F.lower(F.regexp_extract(text, "(?i)" + _MAKE_CALL, 1)), F.lit(_MAKE_PART), F.lit(0))
    made = _sum(call, lambda p: number(p, _MAKE_PART, 2) * _size_of(F.regexp_extract(p, _MAKE_PART, 1), made_sizes))
    wrapped = text.rlike("(?i)" + _WRAPPED)
    quoted = F.concat(F.regexp_extract(text, "(?i)" + _WRAPPED, 1), F.regexp_extract(text, "(?i)" + _WRAPPED, 2))
    inner = F.lower(F.when(wrapped, quoted).otherwise(text))
    iso_pattern = "(?i)" + _ISO_TEXT
    piece = r"(\d+(?:\.\d+)?)([a-z])"
    sizes = {k.lower() if k[0] != "t" else "t" + k[1].lower(): UNITS[u] for k, u in _ISO.items()}
    side = lambda group, prefix: _sum(
        F.regexp_extract_all(F.regexp_extract(inner, iso_pattern, group), F.lit(piece), F.lit(0)),
        lambda p: number(p, piece, 1) * _size_of(F.concat(F.lit(prefix), F.regexp_extract(p, piece, 2)), sizes),
    )
    iso = (side(2, "") + side(3, "t")) * F.when(F.regexp_extract(inner, iso_pattern, 1) == "-", -1).otherwise(1)
    parts = F.regexp_extract_all(inner, F.lit(_PART), F.lit(0))
    signed = F.transform(parts, lambda p, k: number(p, _PART, 2) * _size_of(F.regexp_extract(p, _PART, 3), UNITS) * F.when((F.regexp_extract(p, _PART, 1) == "-") & (k > 0), -1).otherwise(1))
    plain = F.aggregate(signed, F.lit(0.0), lambda a, b: a + b) * F.when(F.regexp_extract(F.try_element_at(parts, F.lit(1)), _PART, 1) == "-", -1).otherwise(1)
    micros = F.when(text.rlike("(?i)" + _MAKE_CALL), made).when(inner.rlike(iso_pattern), iso).when(inner.rlike(_TEXT), plain)
    return F.round(micros).cast("bigint")

"""Time ranges such as '14', '2013/09-2013/10', '**.14', 'c14:10-14:10:10' or '-10m' as conditions on records.

A specification is a run of fields from year to second of which the last given one is the length of the range; '*' stands
for any value of its field. Without year, month or day those of ``now`` are meant. '-x' counts back from ``now``, '+x' is
a length, and a number above 10,000,000 is seconds since 1970. An indicator in front tells how a record must lie to the
range: i (default) touches it, n spans it, c lies within it; x before it turns the answer round.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import UTC, datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNITS = "ymdHMS"
_NAMES = {"y": "year", "M": "month", "d": "day", "h": "hour", "H": "hour", "m": "minute", "s": "second", "S": "second"}
_ORDER = ("year", "month", "day", "hour", "minute", "second")


@dataclass(frozen=True)
class Spec:
    """Fields from year on; None is a wildcard, ``depth`` how many fields are given (the rest is the range)."""

    fields: tuple[int | None, ...]
    depth: int


def _add(at: datetime, unit: str, n: int) -> datetime:
    if unit in ("year", "month"):
        months = at.year * 12 + at.month - 1 + n * (12 if unit == "year" else 1)
        year, month = divmod(months, 12)
        last = (datetime(year + (month == 11), (month + 1) % 12 + 1, 1, tzinfo=UTC) - timedelta(days=1)).day
        return at.replace(year=year, month=month + 1, day=min(at.day, last))
    return at + timedelta(seconds=n * {"day": 86400, "hour": 3600, "minute": 60, "second": 1}[unit])


def _offset(text: str) -> list[tuple[str, int]]:
    parts = re.findall(r"(\d+)([yMdhHmsS])", text)
    if not parts or "".join(a + b for a, b in parts) != text:
        raise ValueError(f"no time offset {text!r}")
    return [(_NAMES[u], int(n)) for n, u in parts]


def _number(word: str) -> int | None:
    return None if set(word) == {"*"} else int(word)


def parse_spec(text: str, now: datetime, like: Spec | None = None) -> Spec:
    """One specification. ``like``: the start of the range, from which the end takes the fields it does not give."""
    if re.fullmatch(r"\d{8,}", text) and int(text) > 10_000_000:
        at = datetime.fromtimestamp(int(text), UTC)
        return Spec((at.year, at.month, at.day, at.hour, at.minute, at.second), 6)
    if re.search(r"[yMdhHmsS]", text):
        found: dict[str, int | None] = {}
        for value, unit in re.findall(r"(\d+|\*+)([yMdhHmsS])", text):
            name = _NAMES[unit]
            if unit == "m" and "month" not in found and "hour" not in found and "day" not in found and not re.search(r"m.*m", text) and re.search(r"m\d+d", text):
                name = "month"
            found[name] = _number(value)
        deepest = max(_ORDER.index(n) for n in found)
        base = (now.year, now.month, now.day)
        fields = [found.get(n, base[i] if i < 3 else 0) for i, n in enumerate(_ORDER)]
        return Spec(tuple(fields), deepest + 1)
    date, _, clock = text.rpartition(".") if "." in text else (text, "", "") if "/" in text or re.fullmatch(r"\d{4}|\*{4}", text) else ("", "", text)
    parts = [_number(p) for p in date.split("/")] if date else []
    base = list(like.fields[:3]) if like else [now.year, now.month, now.day]
    if "/" in date or re.fullmatch(r"\d{4}|\*{4}", date):
        full = len(date.split("/")[0]) == 4
        ymd = parts if full else [base[0], *parts]
    else:
        ymd = [base[0], base[1], *parts] if parts else base
    hms = [_number(p) for p in clock.split(":")] if clock else []
    depth = 3 + len(hms) if clock else len(ymd)
    fields = [*ymd, *([1] * (3 - len(ymd))), *hms, *([0] * (3 - len(hms)))]
    return Spec(tuple(fields[:6]), depth)


def bounds(spec: Spec) -> tuple[datetime, datetime]:
    """[start, end) of a specification without wildcards."""
    y, mo, d, h, mi, s = (f if f is not None else 0 for f in spec.fields)
    start = datetime(y, mo or 1, d or 1, h, mi, s, tzinfo=UTC)
    return start, _add(start, _ORDER[spec.depth - 1], 1)


@dataclass(frozen=True)
class Range:
    how: str
    invert: bool
    start: datetime | None
    end: datetime | None
    pattern: Spec | None = None


def parse(text: str, now: datetime | None = None) -> Range:
    now = now or datetime.now(UTC)
    m = re.match(r"(x?)([inc]?)(.*)$", text.strip())
    invert, how, body = bool(m[1]), m[2] or "i", m[3]
    if body[:1] == "-":
        first, _, second = body[1:].partition("+")
        start = now
        for unit, n in _offset(first):
            start = _add(start, unit, -n)
        end = now
        if second:
            if first.endswith(("M", "y", "d")) and len(_offset(first)) == 1:
                unit = _offset(first)[0][0]
                start = datetime(*(getattr(start, u) if i <= _ORDER.index(unit) else (1 if i < 3 else 0) for i, u in enumerate(_ORDER)), tzinfo=UTC)
            end = start
            for unit, n in _offset(second):
                end = _add(end, unit, n)
        return Range(how, invert, start, end)
    if "+" in body:
        first, second = body.split("+", 1)
        start = bounds(parse_spec(first, now))[0]
        end = start
        for unit, n in _offset(second):
            end = _add(end, unit, n)
        return Range(how, invert, start, end)
    first, _, second = body.partition("-")
    spec = parse_spec(first, now)
    if None in spec.fields[: spec.depth]:
        if second:
            raise ValueError("wildcards and a range exclude each other")
        return Range(how, invert, None, None, spec)
    start, end = bounds(spec)
    if second:
        last = parse_spec(second, now, spec)
        end = bounds(last)[0] if last.depth > 3 else bounds(last)[1]
    return Range(how, invert, start, end)


def condition(r: Range) -> Column:
    """Test on stime and ltime (their _us columns). Records without start fail, also in the inverted form's inner test."""
    start, end = F.col("stime_us"), F.coalesce(F.col("ltime_us"), F.col("stime_us"))
    if r.pattern is None:
        a, b = (F.lit(int(t.timestamp() * 1_000_000)) for t in (r.start, r.end))
        test = {"i": (start < b) & (end >= a), "n": (start <= a) & (end >= b), "c": (start >= a) & (end < b)}[r.how]
    else:
        ts = F.timestamp_micros(start)
        parts = (F.year(ts), F.month(ts), F.dayofmonth(ts), F.hour(ts), F.minute(ts), F.second(ts))
        test = F.lit(True)
        for i, value in enumerate(r.pattern.fields[: r.pattern.depth]):
            if value is not None:
                test &= parts[i] == value
    test = F.coalesce(test, F.lit(False))
    return ~test if r.invert else test


def within(df: DataFrame, text: str, now: datetime | None = None) -> DataFrame:
    return df.where(condition(parse(text, now)))

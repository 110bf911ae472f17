"""Durations, ages and text for a terminal. Durations are parsed on the driver (a setting each);
ages and inert text are columns too."""

from __future__ import annotations

import re
from datetime import timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Units of a duration in seconds (fixed values).
UNITS = {"ns": 1e-9, "us": 1e-6, "µs": 1e-6, "μs": 1e-6, "ms": 1e-3, "s": 1.0, "m": 60.0, "h": 3600.0}
MOST_DAYS = 106_751
_PART = r"(\d+\.?\d*|\.\d+)(ns|us|µs|μs|ms|s|m|h)"


def duration(text: str) -> timedelta:
    """``30d``, or numbers with units one after another (``1h30m``, ``-1.5h``), or ``0``."""
    days = re.fullmatch(r"([+-]?\d+)d", text)
    if days:
        if abs(int(days[1])) > MOST_DAYS:
            raise ValueError(f"{text!r} is more than {MOST_DAYS} days")
        return timedelta(days=int(days[1]))
    sign, body = (-1, text[1:]) if text[:1] == "-" else (1, text.removeprefix("+"))
    if body == "0":
        return timedelta()
    if not re.fullmatch(f"(?:{_PART})+", body):
        raise ValueError(f"{text!r} isn't a duration")
    return sign * timedelta(seconds=sum(float(n) * UNITS[u] for n, u in re.findall(_PART, body)))


def age(seconds: Column) -> Column:
    """How long ago, in the largest unit that keeps two figures apart; days from 48 hours on."""
    whole = lambda n: F.floor(seconds / n).cast("string")
    out = F.when(seconds < 5, F.lit("just now")).when(seconds < 60, F.concat(whole(1), F.lit("s ago"))).when(seconds < 3600, F.concat(whole(60), F.lit("m ago")))
    return out.when(seconds < 48 * 3600, F.concat(whole(3600), F.lit("h ago"))).otherwise(F.concat(whole(86400), F.lit("d ago")))


def counted(n: Column, one: str, many: str | None = None) -> Column:
    """``1 document``, ``2 documents``."""
    return F.concat_ws(" ", n.cast("string"), F.when(n == 1, F.lit(one)).otherwise(F.lit(many or f"{one}s")))


#: Characters that may move a terminal's cursor or turn its text: controls but line ends and
#: tabs, line and paragraph separators, marks of direction, and the replacement character.
_ACTIVE = r"[\x00-\x08\x0B-\x1F\x7F-\x9F؜‎‏  ‪-‮⁦-⁩�]"
_NAMED = {7: r"\a", 8: r"\b", 11: r"\v", 12: r"\f", 13: r"\r"}


def _escaped(c: str) -> str:
    n = ord(c)
    return _NAMED.get(n) or (f"\\x{n:02x}" if n < 0x80 else f"\\u{n:04x}")


def inert(text: Column) -> Column:
    """The text with every active character written out; a text without one as it is."""
    table = [chr(c) for c in [*range(0x09), *range(0x0B, 0x20), *range(0x7F, 0xA0), 0x061C, 0x200E, 0x200F, 0x2028, 0x2029, *range(0x202A, 0x202F), *range(0x2066, 0x206A), 0xFFFD]]
    names = F.create_map(*(F.lit(x) for c in table for x in (c, _escaped(c))))
    each = F.transform(F.split(text, ""), lambda c: F.coalesce(F.try_element_at(names, c), c))
    return F.when(text.rlike(_ACTIVE), F.array_join(each, "")).otherwise(text)


def inert_line(text: Column) -> Column:
    """The same on one line: line ends and tabs are written out too."""
    return F.replace(F.replace(inert(text), F.lit("\n"), F.lit("\\n")), F.lit("\t"), F.lit("\\t"))

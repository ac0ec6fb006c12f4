"""All valid readings of a text that may denote a time or a date.

A reading is ``(style, value, cost, norm)``: the way of writing it supposes, a
number by which readings are ordered in time (microseconds since 1970, UTC), a
cost, and the normal form. Cost 0 is the reading its host's declared clock and
order of day and month give; readings against a declaration cost AGAINST. What
no declaration settles costs 0 in every reading: the order of day and month of
a host that declares ANY_ORDER, and an abbreviation of several zones none of
which is the host's. There the order of the records decides.
"""

from __future__ import annotations

import re
import unicodedata
from datetime import date, datetime, timedelta, timezone
from functools import lru_cache
from zoneinfo import ZoneInfo

Reading = tuple[str, int, int, str]

#: Cost of a reading against what its host declares: more than any order of records can make up for.
AGAINST = 1000
#: As order of day and month: none is declared.
ANY_ORDER = "any"

# Month names in English, German, French, Spanish, Portuguese, Dutch, Italian and Swedish,
# without accents; a month's abbreviation is a beginning of at least three letters that fits one month only.
MONTHS = (
    "january januar janvier enero janeiro januari gennaio",
    "february februar fevrier febrero fevereiro februari febbraio",
    "march marz maerz mars marzo marco maart mrt",
    "april avril abril aprile",
    "may mai mayo maio mei maggio maj",
    "june juni juin junio junho giugno",
    "july juli juillet julio julho luglio",
    "august aout agosto augustus augusti",
    "september septembre septiembre setembro settembre",
    "october oktober octobre octubre outubro ottobre",
    "november novembre noviembre novembro",
    "december dezember decembre diciembre dezembro dicembre",
)
# Minutes east of Greenwich of zone abbreviations; several where an abbreviation is used for several.
ZONES = {
    "z": (0,), "utc": (0,), "gmt": (0,), "ut": (0,), "wet": (0,), "west": (60,), "bst": (60,), "cet": (60,), "cest": (120,), "mez": (60,), "mesz": (120,),
    "eet": (120,), "eest": (180,), "msk": (180,), "est": (-300, 600), "edt": (-240, 660), "cst": (-360, 480), "cdt": (-300,), "mst": (-420,), "mdt": (-360,),
    "pst": (-480,), "pdt": (-420,), "ist": (330, 60, 120), "jst": (540,), "kst": (540,), "aest": (600,), "aedt": (660,), "nzst": (720,), "nzdt": (780,),
}

_EPOCH = datetime(1970, 1, 1)
_STRIP = " \t\r\n\f\v\"' 　﻿​"
_CLOCK = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d+))?)?(?:\s*([AaPp])\.?[Mm]\.?)?"
_ZONE = r"\s*(.*)$"
_TIME_FORMS = [
    ("iso", re.compile(r"(\d{4})([-/.])(\d{1,2})\2(\d{1,2})(?:[Tt\s]\s*" + _CLOCK + _ZONE + r"|$)")),
    ("compact", re.compile(r"(\d{4})(\d{2})(\d{2})[Tt]?(\d{2})(\d{2})(\d{2})?(?:[.,](\d+))?" + _ZONE)),
    ("ordinal", re.compile(r"(\d{4})-?(\d{3})[Tt\s]" + _CLOCK + _ZONE)),
    ("week", re.compile(r"(\d{4})-?[Ww](\d{2})-?([1-7])[Tt\s]" + _CLOCK + _ZONE)),
    ("named", re.compile(r"(?:[^\W\d_]{2,10}\.?,\s*)?(\d{1,2})(?:\.|st|nd|rd|th)?[\s-]+([^\W\d_]{3,10})\.?,?[\s-]+(\d{4})[,\sT]+" + _CLOCK + _ZONE)),
    ("us", re.compile(r"(?:[^\W\d_]{2,10}\.?,\s*)?([^\W\d_]{3,10})\.?\s+(\d{1,2})(?:st|nd|rd|th)?,?\s+(\d{4})[,\s]+" + _CLOCK + _ZONE)),
    ("c", re.compile(r"[^\W\d_]{3}\s+([^\W\d_]{3})\s+(\d{1,2})\s+(\d{1,2}):(\d{2}):(\d{2})\s+(?:([A-Za-z]{1,5})\s+)?(\d{4})$")),
    ("numeric", re.compile(r"(\d{1,2})([-/.])(\d{1,2})\2(\d{4}|\d{2})(?:[,\sTt]+" + _CLOCK + _ZONE + r"|$)")),
]
_EPOCHS = re.compile(r"(-?\d{9,10}|\d{13}|\d{16}|\d{19})(?:\.(\d+))?$")
_OFFSET = re.compile(r"(?:(?:utc|gmt)\s*)?([+-])(\d{1,2})(?::?(\d{2}))?(?:\s*\(?(?:[a-z]{1,5}|[+-]\d{2}:?\d{0,2})\)?)?(?:\s+m=\S+)?$")
_CANONICAL = re.compile(r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}Z")


def _folded(word: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", word.lower()) if not unicodedata.combining(c))


@lru_cache(4096)
def month_of(word: str) -> int:
    """1 to 12, 0 if the word is no month or could be several."""
    word = _folded(word.strip("."))
    if len(word) < 3:
        return 0
    fits = [i for i, names in enumerate(MONTHS, 1) if word in names.split()] or [i for i, names in enumerate(MONTHS, 1) if any(n.startswith(word) for n in names.split())]
    if not fits and word == "sept":
        fits = [9]
    return fits[0] if len(fits) == 1 else 0


@lru_cache(256)
def _zone(name: str) -> ZoneInfo | timezone:
    try:
        return ZoneInfo(name)
    except Exception:
        return timezone.utc


def _offsets(text: str) -> list[int] | None:
    """Minutes east of UTC that a zone text may mean; [] for none given, None if it is no zone."""
    text = text.strip().strip("()").lower()
    if not text:
        return []
    if m := _OFFSET.match(text):
        minutes = int(m[2]) * 60 + int(m[3] or 0)
        return None if minutes > 15 * 60 or int(m[3] or 0) > 59 else [minutes if m[1] == "+" else -minutes]
    return list(ZONES[text]) if text in ZONES else None


def _wall(year: int, month: int, day: int, hour: int, minute: int, second: int, fraction: str | None, half: str | None) -> datetime | None:
    if half:
        if not 1 <= hour <= 12:
            return None
        hour = hour % 12 + (12 if half in "pP" else 0)
    extra = timedelta(0)
    if hour == 24 and minute == second == 0:
        hour, extra = 0, timedelta(days=1)
    try:
        return datetime(year, month, day, hour, minute, second, int(((fraction or "") + "000000")[:6])) + extra
    except (ValueError, OverflowError):
        return None


def _micros(wall: datetime) -> int:
    return (wall - _EPOCH) // timedelta(microseconds=1)


def instant_norm(micros: int) -> str:
    return (_EPOCH + timedelta(microseconds=micros)).strftime("%Y-%m-%dT%H:%M:%S.%f").rjust(26, "0") + "Z"


def _placed(style: str, wall: datetime, zone_text: str, host_zone: str, cost: int) -> list[tuple[str, int, int]]:
    """The wall time on every clock it may have been read from."""
    offsets = _offsets(zone_text)
    if offsets is None:
        return []
    host = _zone(host_zone)
    if offsets:
        if len(offsets) == 1:
            return [(style, _micros(wall - timedelta(minutes=offsets[0])), cost)]
        # those the host's clock has at some time of that year, best just now
        own = [_minutes(wall.replace(tzinfo=host)), *(_minutes(datetime(wall.year, m, 1, tzinfo=host)) for m in (1, 7))]
        meant = next(([o] for o in own if o in offsets), offsets)
        return [(style, _micros(wall - timedelta(minutes=o)), cost + (0 if o in meant else AGAINST)) for o in offsets]
    first = wall - (wall.replace(tzinfo=host).utcoffset() or timedelta(0))  # the first of two; before the change, if skipped
    second = wall - (wall.replace(tzinfo=host, fold=1).utcoffset() or timedelta(0))
    out = [(f"{style}-local", _micros(first), cost)]
    if second != first:
        out.append((f"{style}-local", _micros(second), cost + AGAINST))
    return out


def _minutes(at: datetime) -> int:
    return (at.utcoffset() or timedelta(0)) // timedelta(minutes=1)


def _orders(a: str, b: str, c: str, order: str) -> list[tuple[str, int, int, int, int]]:
    """(style, year, month, day, cost) of a numeric date in every order; as validity decides, the caller drops what is impossible."""
    dmy, mdy = ("dmy", _year(c), int(b), int(a)), ("mdy", _year(c), int(a), int(b))
    against = 0 if order == ANY_ORDER else AGAINST
    first, second = (mdy, dmy) if order == "mdy" else (dmy, mdy)
    out = [(*first, 0)] + ([(*second, against)] if int(a) != int(b) else [])
    if len(a) == len(c) == 2:
        out.append(("ymd", _year(a), int(b), int(c), against))
    return out


def _year(text: str) -> int:
    return int(text) + (2000 if len(text) == 2 else 0)


def read_instant(text: str | None, host_zone: str, order: str) -> list[Reading]:
    """Readings of a text as a moment; none if it denotes no real time."""
    if not text:
        return []
    if len(text) == 20 and _CANONICAL.fullmatch(text):
        try:
            micros = _micros(datetime.fromisoformat(text[:19]))
        except ValueError:
            return []
        return [("canonical", micros, 0, instant_norm(micros))]
    text = text.strip(_STRIP)
    found: list[tuple[str, int, int]] = []
    if m := _EPOCHS.match(text):
        digits, fraction = m[1], m[2]
        scale = {10: 6, 9: 6, 13: 3, 16: 0}.get(len(digits.lstrip("-")))
        number = int(digits) // 1000 if scale is None else int(digits) * 10**scale
        if fraction and scale == 6:
            number += int((fraction + "000000")[:6])
        if abs(number) < 250_000_000_000_000_000:
            found.append((f"epoch{len(digits)}", number, 0))
    else:
        for style, form in _TIME_FORMS:
            if m := form.match(text):
                found = _of_form(style, m, host_zone, order)
                if found:
                    break
    best: dict[int, tuple[str, int, int]] = {}
    for reading in found:
        if reading[1] not in best or reading[2] < best[reading[1]][2]:
            best[reading[1]] = reading
    return [(*r, instant_norm(r[1])) for r in best.values() if 0 <= r[1] + 62_135_596_800_000_000]


def _of_form(style: str, m: re.Match, host_zone: str, order: str) -> list[tuple[str, int, int]]:
    g = m.groups()
    clock: tuple = (0, 0, 0, None, None, "")
    dates: list[tuple[str, int, int, int, int]] = []  # style, year, month, day, cost
    if style == "iso":
        dates = [(style + g[1], int(g[0]), int(g[2]), int(g[3]), 0)]
        clock = g[4:]
    elif style == "compact":
        dates = [(style, int(g[0]), int(g[1]), int(g[2]), 0)]
        clock = (g[3], g[4], g[5], g[6], None, g[7])
    elif style == "ordinal":
        try:
            day = date(int(g[0]), 1, 1) + timedelta(days=int(g[1]) - 1)
        except (ValueError, OverflowError):
            return []
        if day.year != int(g[0]):
            return []
        dates, clock = [(style, day.year, day.month, day.day, 0)], g[2:]
    elif style == "week":
        try:
            day = date.fromisocalendar(int(g[0]), int(g[1]), int(g[2]))
        except ValueError:
            return []
        dates, clock = [(style, day.year, day.month, day.day, 0)], g[3:]
    elif style == "named":
        dates, clock = [(style, int(g[2]), month_of(g[1]), int(g[0]), 0)], g[3:]
    elif style == "us":
        dates, clock = [(style, int(g[2]), month_of(g[0]), int(g[1]), 0)], g[3:]
    elif style == "c":
        dates, clock = [(style, int(g[6]), month_of(g[0]), int(g[1]), 0)], (g[2], g[3], g[4], None, None, g[5] or "")
    else:
        dates = [(name + g[1], *rest) for name, *rest in _orders(g[0], g[2], g[3], order)]
        clock = g[4:]
    hour, minute, second, fraction, half, zone_text = clock
    out = []
    for name, year, month, day, cost in dates:
        wall = _wall(year, month, day, int(hour or 0), int(minute or 0), int(second or 0), fraction, half)
        if wall is not None:
            out += _placed(name, wall, zone_text or "", host_zone, cost)
    return out


_DATE_EXACT = re.compile(r"\d{4}(?:-\d{2}(?:-\d{2})?)?")
_DATE_FORMS = [
    ("ymd", re.compile(r"(\d{4})([-/.])(\d{1,2})\2(\d{1,2})(?:[Tt\s]\s*\d{1,2}:\d{2}.*)?$")),
    ("ordinal", re.compile(r"(\d{4})-(\d{3})$")),
    ("compact", re.compile(r"(\d{4})(\d{2})(\d{2})$")),
    ("ym", re.compile(r"(\d{4})[-/.](\d{1,2})$")),
    ("my", re.compile(r"(\d{1,2})[-/.](\d{4})$")),
    ("year", re.compile(r"(\d{4})$")),
    ("numeric", re.compile(r"(\d{1,2})([-/.])(\d{1,2})\2(\d{4}|\d{2})(?:[,\sTt]+\d{1,2}:\d{2}.*)?$")),
    ("cjk", re.compile(r"(\d{4})\s*年(?:\s*(\d{1,2})\s*月(?:\s*(\d{1,2})\s*日)?)?$")),
    ("named", re.compile(r"(?:[^\W\d_]{2,10}\.?,\s*)?(\d{1,2})(?:\.|st|nd|rd|th|er|º|ª)?(?:\s+de)?[\s-]+([^\W\d_]{3,10})\.?,?(?:\s+de[l]?)?[\s-]+(\d{4}|\d{2})(?:[,\sT]+\d{1,2}:\d{2}.*)?$")),
    ("us", re.compile(r"(?:[^\W\d_]{2,10}\.?,\s*)?([^\W\d_]{3,10})\.?\s+(\d{1,2})(?:st|nd|rd|th)?,?\s+(\d{4})$")),
    ("month", re.compile(r"([^\W\d_]{3,10})\.?,?(?:\s+de)?[\s-]+(\d{4})$")),
    ("yearmonth", re.compile(r"(\d{4})[,\s-]+([^\W\d_]{3,10})\.?(?:[\s-]+(\d{1,2}))?$")),
]
_AROUND = re.compile(r"^(?:(?:c|ca|circa|approx|about|um|vers|hacia)\.?\s*(?=\d{4}))|^(?:©|\(c\)|copyright)\s*", re.IGNORECASE)


def read_date(text: str | None, host_zone: str, order: str) -> list[Reading]:
    """Readings of a text as a calendar date of the precision it gives, taken as written."""
    if not text:
        return []
    plain = text.strip(_STRIP)
    while plain and (plain[0], plain[-1]) in (("[", "]"), ("(", ")"), ("<", ">")):
        plain = plain[1:-1].strip(_STRIP)
    plain = _AROUND.sub("", plain).rstrip("?.").strip(_STRIP)
    for style, form in _DATE_FORMS:
        if (m := form.match(plain)) and (found := _dates_of_form(style, m, order)):
            return found
    return []


def _dates_of_form(style: str, m: re.Match, order: str) -> list[Reading]:
    g = m.groups()
    if style == "ymd":
        wanted = [(style, int(g[0]), int(g[2]), int(g[3]), 0)]
    elif style == "ordinal":
        first = int(g[0])
        if not 1 <= first <= 9999 or not 1 <= int(g[1]) <= (366 if _leap(first) else 365):
            return []
        day = date(first, 1, 1) + timedelta(days=int(g[1]) - 1)
        wanted = [(style, day.year, day.month, day.day, 0)]
    elif style == "compact":
        wanted = [(style, int(g[0]), int(g[1]), int(g[2]), 0)]
    elif style == "ym":
        wanted = [(style, int(g[0]), int(g[1]), None, 0)]
    elif style == "my":
        wanted = [(style, int(g[1]), int(g[0]), None, 0)]
    elif style == "year":
        wanted = [(style, int(g[0]), None, None, 0)]
    elif style == "numeric":
        wanted = _orders(g[0], g[2], g[3], order)
    elif style == "cjk":
        wanted = [(style, int(g[0]), int(g[1]) if g[1] else None, int(g[2]) if g[2] else None, 0)]
    elif style == "named":
        wanted = [(style, _year(g[2]), month_of(g[1]), int(g[0]), 0)]
    elif style == "us":
        wanted = [(style, int(g[2]), month_of(g[0]), int(g[1]), 0)]
    elif style == "month":
        wanted = [(style, int(g[1]), month_of(g[0]), None, 0)]
    else:
        wanted = [(style, int(g[0]), month_of(g[1]), int(g[2]) if g[2] else None, 0)]
    out: list[Reading] = []
    for name, year, month, day, cost in wanted:
        try:
            at = date(year, 1 if month is None else month, 1 if day is None else day)
        except ValueError:
            continue
        norm = f"{year:04d}" + ("" if month is None else f"-{month:02d}") + ("" if day is None else f"-{day:02d}")
        out.append((name, (at.toordinal() - 719163) * 86_400_000_000, cost, norm))
    return out


def _leap(year: int) -> bool:
    return year % 4 == 0 and (year % 100 != 0 or year % 400 == 0)


def is_exact_instant(text: str) -> bool:
    return _CANONICAL.fullmatch(text) is not None


def is_exact_date(text: str) -> bool:
    return _DATE_EXACT.fullmatch(text) is not None

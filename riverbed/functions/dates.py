"""Dates as sources write them: readings with precision, days named in a text."""

from __future__ import annotations

import datetime as dt
import re
import unicodedata

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

READING = T.StructType([T.StructField("value", T.TimestampNTZType()), T.StructField("precision", T.StringType())])
#: Month names in English, Spanish, Portuguese and French, and the first letters of the first two (fixed values).
MONTHS = {name: k + 1 for names, short in (
    (("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"), True),
    (("enero", "febrero", "marzo", "abril", "mayo", "junio", "julio", "agosto", "septiembre", "octubre", "noviembre", "diciembre"), True),
    (("janeiro", "fevereiro", "março", "abril", "maio", "junho", "julho", "agosto", "setembro", "outubro", "novembro", "dezembro"), False),
    (("janvier", "février", "mars", "avril", "mai", "juin", "juillet", "août", "septembre", "octobre", "novembre", "décembre"), False),
) for k, full in enumerate(names) for name in ((full, full[:3]) if short else (full,))} | {"sept": 9}

_ISO = re.compile(r"^(\d{4})-(\d{1,2})-(\d{1,2})(?:[T ](\d{1,2}):(\d{2})(?::(\d{2})(?:\.\d+)?)?\s*(Z|[+-]\d{2}:?\d{2})?)?$")
_MAIL = re.compile(r"^(?:\w{3},\s*)?(\d{1,2})\s+(\w{3,})\.?\s+(\d{4})(?:\s+(\d{1,2}):(\d{2})(?::(\d{2}))?\s*(GMT|UTC|Z|[+-]\d{4})?)?$")
_HAN = re.compile(r"^(\d{4})年(\d{1,2})月(\d{1,2})日(?:\s*(\d{1,2})[:：](\d{2}))?$")
_NAME = "|".join(sorted(MONTHS, key=len, reverse=True))
_DAY, _TH = r"(?P<d>\d{1,2})", r"(?:st|nd|rd|th|er)?"
_YEAR = r"(?:,?\s+(?:de\s+)?(?P<y>\d{4})(?![-\d/.]))?"
#: The forms in which a text names a day.
_FORMS = tuple(
    re.compile(form, re.I)
    for form in (
        rf"\b(?P<y>\d{{4}})[-/.](?P<m>\d{{1,2}})[-/.]{_DAY}\b",
        rf"(?P<y>\d{{4}})\s*年\s*(?P<m>\d{{1,2}})\s*月\s*{_DAY}\s*[日号]",
        rf"(?<!\d)(?P<m>\d{{1,2}})\s*月\s*{_DAY}\s*[日号]",
        rf"\b{_DAY}{_TH}\s+(?:of\s+|de\s+)?(?P<m>{_NAME})\b\.?{_YEAR}",
        rf"\b(?P<m>{_NAME})\b\.?\s+{_DAY}{_TH}\b{_YEAR}",
    )
)


def _zone(text: str | None) -> dt.timedelta:
    if not text or text in ("Z", "GMT", "UTC"):
        return dt.timedelta(0)
    digits = text.replace(":", "")
    return (1 if digits[0] == "+" else -1) * dt.timedelta(hours=int(digits[1:3]), minutes=int(digits[3:5]))


def read_date(text: str | None) -> tuple[dt.datetime, str] | None:
    """The instant (UTC) and its precision: day, minute or second; None if it is no date."""
    text = (text or "").strip()
    try:
        if m := _ISO.match(text):
            y, mo, d, h, mi, s, z = m.groups()
        elif m := _MAIL.match(text):
            d, name, y, h, mi, s, z = m.groups()
            mo = MONTHS[name.lower()[:3]]
        elif m := _HAN.match(text):
            (y, mo, d, h, mi), s, z = m.groups(), None, "+0800"
        else:
            return None
        value = dt.datetime(int(y), int(mo), int(d), int(h or 0), int(mi or 0), int(s or 0))
        value = value - _zone(z) if h is not None else value
    except (KeyError, ValueError, OverflowError):
        return None
    return value, "day" if h is None else "minute" if s is None else "second"


#: Words before a day that make it the end of a period, by language (fixed values).
PERIOD_WORDS = {
    "en": ("ended", "ending", "through", "as at", "as of", "month to", "months to", "quarter to", "half to", "half-year to", "period to", "year to", "results to"),
    "zh": ("截至", "截止", "截止到", "截止至"),
    "es": ("terminado el", "terminada el", "al cierre de", "al cierre del"),
    "pt": ("terminado em", "terminada em"),
}
#: What stands between the two days of a range (fixed values).
RANGE_WORDS = ("to", "until", "至", "到", "~", "–", "—", "-")


def _ends_period(before: str) -> bool:
    """Whether the words before a day say that a period ends with it."""
    said = " ".join(before.lower().split()).removesuffix(" on")
    return any(said.endswith(w) and (not w.isascii() or not said[: -len(w)][-1:].isalnum()) for words in PERIOD_WORDS.values() for w in words)


def _ends_range(before: str, day_before: bool) -> bool:
    """Whether a day is the second of a range; ``before`` begins behind the day named before, if there is one."""
    said = before.strip().lower()
    for word in RANGE_WORDS:
        if said == word and day_before:
            return True
        # the first day may be no more than its number: 1-5 March
        first = said.removesuffix(word).rstrip()
        if said.endswith(word) and re.search(r"\d(?:st|nd|rd|th|er)?$|\d\s*[日号]$", first):
            return True
    return False


def written_days(text: str | None, near: dt.date | None) -> list[dt.date]:
    """Days that a text names; the ends of periods and of ranges are no events and left out.

    A day without a year is of the report's year (``near``), or of the year before where it
    would lie after the report; without a report day such days are passed over.
    """
    folded = unicodedata.normalize("NFKC", text or "")
    named = sorted((m for form in _FORMS for m in form.finditer(folded)), key=lambda m: (m.start(), -m.end()))
    found, end = set(), None
    for m in named:
        if end is not None and m.start() < end:
            continue  # part of the day before
        before = folded[end or 0 : m.start()]
        closes = _ends_period(before[-40:]) or _ends_range(before[-40:], end is not None)
        end = m.end()
        if closes or (m["y"] if "y" in m.re.groupindex else None) is None and near is None:
            continue
        year = m["y"] if "y" in m.re.groupindex else None
        month = int(m["m"]) if m["m"].isdigit() else MONTHS[m["m"].lower()]
        try:
            day = dt.date(int(year or near.year), month, int(m["d"]))
            found.add(day if year or day <= near else day.replace(year=near.year - 1))
        except ValueError:
            continue  # no such day
    return sorted(found)


@F.pandas_udf(READING)
def read_date_udf(s: pd.Series) -> pd.DataFrame:
    rows = [read_date(x) or (None, None) for x in s]
    return pd.DataFrame({"value": pd.to_datetime([r[0] for r in rows]), "precision": [r[1] for r in rows]})


@F.pandas_udf(T.ArrayType(T.DateType()))
def written_days_udf(s: pd.Series, near: pd.Series) -> pd.Series:
    return pd.Series([written_days(t, n) for t, n in zip(s, near, strict=True)])

"""Numbers in texts: in words, with either decimal mark, and checked against a source."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

#: Han digits, units and their values (fixed values).
HAN_DIGITS = dict(zip("零一二三四五六七八九", range(10), strict=True)) | {"〇": 0, "两": 2}
HAN_UNITS = {"十": 10, "百": 100, "千": 1000}
HAN_GROUPS = {"万": 10**4, "亿": 10**8}
#: Spanish number words (fixed values).
SPANISH = {
    "cero": 0, "un": 1, "uno": 1, "una": 1, "dos": 2, "tres": 3, "cuatro": 4, "cinco": 5, "seis": 6, "siete": 7, "ocho": 8, "nueve": 9, "diez": 10, "once": 11,
    "doce": 12, "trece": 13, "catorce": 14, "quince": 15, "dieciséis": 16, "diecisiete": 17, "dieciocho": 18, "diecinueve": 19, "veinte": 20, "veintiuno": 21,
    "veintidós": 22, "veintitrés": 23, "veinticuatro": 24, "veinticinco": 25, "veintiséis": 26, "veintisiete": 27, "veintiocho": 28, "veintinueve": 29,
    "treinta": 30, "cuarenta": 40, "cincuenta": 50, "sesenta": 60, "setenta": 70, "ochenta": 80, "noventa": 90, "cien": 100, "ciento": 100, "doscientos": 200,
    "trescientos": 300, "cuatrocientos": 400, "quinientos": 500, "seiscientos": 600, "setecientos": 700, "ochocientos": 800, "novecientos": 900,
}

_NUMBER = re.compile(r"\d[\d.,]*\d|\d")
_SCALES = {"thousand": 1e3, "million": 1e6, "billion": 1e9, "万": 1e4, "亿": 1e8, "%": 1.0}
_FIGURE = re.compile(r"(\d[\d.,]*\d|\d)\s?(thousand|million|billion|万|亿|%)?", re.I)


def han_number(text: str) -> int | None:
    total = section = 0
    digit: int | None = None
    for c in text:
        if c in HAN_DIGITS:
            digit = HAN_DIGITS[c]
        elif c in HAN_UNITS:
            section += (1 if digit is None else digit) * HAN_UNITS[c]
            digit = None
        elif c in HAN_GROUPS:
            group = section + (digit or 0)
            total = total + group * HAN_GROUPS[c] if total >= HAN_GROUPS[c] else (total + group) * HAN_GROUPS[c]
            section, digit = 0, None
        else:
            return None
    return total + section + (digit or 0) if text else None


def spanish_number(text: str) -> int | None:
    total = part = 0
    words = [w for w in text.lower().split() if w != "y"]
    for w in words:
        if w == "mil":
            total, part = total + max(part, 1) * 1000, 0
        elif w in ("millón", "millones"):
            total, part = (total + max(part, 1)) * 10**6, 0
        elif w in SPANISH:
            part += SPANISH[w]
        else:
            return None
    return total + part if words else None


def readings(text: str) -> list[float]:
    """All values that a number's marks allow: 1.234 is a thousand or one and a bit."""
    if not _NUMBER.fullmatch(text):
        return []
    out = set()
    for thousands, point in ((",", "."), (".", ",")):
        whole, _, part = text.partition(point) if text.count(point) == 1 else (text, "", "")
        if text.count(point) > 1 or thousands in part:
            continue
        groups = whole.split(thousands)
        if len(groups) == 1 or (1 <= len(groups[0]) <= 3 and all(len(g) == 3 for g in groups[1:])):
            out.add(float("".join(groups) + ("." + part if part else "")))
    return sorted(out)


def figures(text: str | None) -> list[tuple[str, list[float]]]:
    """Each figure of a text and its possible values, scale words applied."""
    return [(m[0].strip(), [v * _SCALES.get((m[2] or "").lower(), 1.0) for v in readings(m[1])]) for m in _FIGURE.finditer(text or "")]


def check(copy: str | None, source: str | None) -> tuple[str, list[str]]:
    """``ok``, ``soft`` (only a scale differs) or ``hard`` (no such figure), and the figures at fault."""
    known = {v for _, values in figures(source) for v in values}
    hard, soft = [], []
    for written, values in figures(copy):
        if any(abs(v - k) <= 0.005 * max(abs(v), abs(k)) for v in values for k in known):
            continue
        near = any(k and v and abs(abs(v / k) / s - 1) < 0.005 for v in values for k in known for s in (10, 100, 1e3, 1e4, 1e6, 0.1, 0.01, 1e-3, 1e-4, 1e-6))
        (soft if near else hard).append(written)
    return ("hard", hard + soft) if hard else ("soft", soft) if soft else ("ok", [])


def checked(pairs: DataFrame) -> DataFrame:
    """``id, verdict, findings`` for rows of ``id, copy, source``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(i, *check(c, s)) for i, c, s in zip(b["id"], b["copy"], b["source"], strict=True)]
            yield pd.DataFrame(rows, columns=["id", "verdict", "findings"])

    return pairs.select("id", "copy", "source").mapInPandas(run, "id long, verdict string, findings array<string>")

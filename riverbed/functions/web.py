"""Requests: bots, devices, systems, routes, referrers; text for pages."""

from __future__ import annotations

import functools

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What scripted clients call themselves; "bot" counts at a word's end only (fixed values).
BOT_WORDS = (
    "spider", "crawl", "slurp", "preview", "monitor", "uptime", "pingdom", "lighthouse", "pagespeed", "headless", "phantomjs", "selenium", "puppeteer", "playwright",
    "curl", "wget", "python", "go-http", "java/", "okhttp", "axios", "node-fetch", "undici", "scrapy", "httpclient", "facebookexternalhit", "bytespider",
)
BOT_ENDS = r"bot(?:\b|_)"
#: Ordered patterns; the first that matches names the class (fixed values).
DEVICES = ((r"(?i)ipad|tablet|playbook|silk|kindle|android(?!.*\bmobile\b)", "tablet"), (r"(?i)mobi|iphone|ipod|android|windows phone|harmonyos|openharmony", "phone"))
SYSTEMS = ((r"(?i)iphone|ipad|ipod", "ios"), (r"(?i)harmonyos|openharmony", "harmony"), (r"(?i)android", "android"), (r"(?i)windows", "windows"), (r"(?i)mac os x|macintosh", "mac"), (r"(?i)cros", "chromeos"), (r"(?i)linux|x11", "linux"))


def _first(text: Column, rules: tuple, otherwise: str) -> Column:
    out = None
    for pattern, name in rules:
        out = F.when(text.rlike(pattern), name) if out is None else out.when(text.rlike(pattern), name)
    return out.otherwise(otherwise)


def is_bot(agent: Column) -> Column:
    said = F.lower(agent)
    return F.coalesce(F.trim(agent) == "", F.lit(True)) | functools.reduce(Column.__or__, (F.contains(said, F.lit(w)) for w in BOT_WORDS), said.rlike(BOT_ENDS))


def device(agent: Column) -> Column:
    return _first(F.coalesce(agent, F.lit("")), DEVICES, "desktop")


def system(agent: Column) -> Column:
    return _first(F.coalesce(agent, F.lit("")), SYSTEMS, "other")


def page_path(path: Column) -> Column:
    """A path without query, fragment, end slash and the English prefix."""
    bare = F.regexp_replace(F.regexp_extract(path, r"^[^?#]*", 0), r"(?<=.)/+$", "")
    folded = F.regexp_replace(bare, r"^/en(?=/|$)", "")
    return F.when(folded == "", "/").otherwise(folded)


def route(path: Column, static: list[str], dynamic: list[str]) -> Column:
    """The known route of a path: itself if static, a section with ``:id`` if dynamic, else null."""
    clean = page_path(path)
    out = F.when(clean.isin(*static), clean)
    for section in dynamic:
        out = out.when(clean.rlike(f"^/{section}/[^/]+$"), f"/{section}/:id")
    return out


def host(url: Column) -> Column:
    """A URL's host without www."""
    return F.nullif(F.lower(F.regexp_extract(url, r"^https?://(?:[^@/]*@)?(?:www\.)?([^/:?#]+)", 1)), F.lit(""))


def collapsed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def truncated(text: Column, most: int) -> Column:
    """At most ``most`` code points, the last one an ellipsis where something was cut."""
    return F.when(F.length(text) > most, F.concat(F.rtrim(F.substring(text, 1, most - 1)), F.lit("…"))).otherwise(text)


def without_tags(text: Column) -> Column:
    return collapsed(F.regexp_replace(F.regexp_replace(text, r"(?is)<(script|style)\b.*?</\1>", " "), r"<[^>]*>", " "))


def escaped(text: Column) -> Column:
    out = F.replace(text, F.lit("&"), F.lit("&amp;"))
    for c, e in (("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(c), F.lit(e))
    return out

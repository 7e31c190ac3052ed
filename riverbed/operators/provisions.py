"""Versions of structured texts: provisions, their alignment and differences."""

from __future__ import annotations

import difflib
import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from riverbed.functions.figures import han_number

#: Similarity that two provisions need to be one, and what an equal number adds (fixed values).
SAME, SAME_NUMBER = 0.45, 0.2
_HAN = "0-9一二三四五六七八九十百零〇两"
#: Headings by numbering family (fixed patterns).
FAMILIES = (r"^(?:Article|Section|Sec\.|Art\.)\s+(\d+)\b", rf"^第\s*([{_HAN}]+)\s*条", r"^(\d+)[.)]\s+\S")
#: Lines that head a group of provisions and belong to none (fixed patterns).
GROUPS = re.compile(rf"^(?:第\s*[{_HAN}]+\s*[编章节]|(?:Chapter|Part|Title|Division|Cap[ií]tulo|T[ií]tulo|Secci[oó]n)\s+(?:\d+|[IVXLC]+)\b)", re.I)
#: What begins an annex, whose provisions count anew (fixed words).
ANNEXES = ("附件", "附表", "附录", "annex", "appendix", "schedule", "anexo")
_ANNEX = re.compile(rf"^({'|'.join(ANNEXES)})\s*([{_HAN}]+|[IVXLC]+\b|[A-Z]\b)?\s*[:：.]?\s*(.*)$", re.I)
#: What the lines that a family matches begin with; no quotes, and any digit besides.
_FIRST, _FAMILIES = "AS第", tuple(re.compile(f).match for f in FAMILIES)


def _value(number: str) -> int | None:
    return int(number) if number.isdigit() else han_number(number)


def _annex(line: str) -> str | None:
    """The annex that a line begins, or None."""
    m = _ANNEX.match(line)
    if not m or not m[2] and m[3] or m[3][-1:] in ("。", "；", ";", "."):
        return None
    return m[1].lower() + (f"-{m[2]}" if m[2] else "")


def split(text: str) -> list[tuple[str, str, str]]:
    """``(number, text, sha256)`` of each provision, by the numbering family with most hits; a head comes first.

    Numbers rise, in figures or in Han numerals: a line with a lower or an equal one refers
    to another provision and belongs to the one before.  An annex counts from the beginning
    and names its provisions ``annex-2/1``; lines that head chapters belong to none, quoted
    lines head nothing.
    """
    lines = [x.strip() for x in (text or "").split("\n")]
    # a line that heads nothing shows it by its first sign
    likely = {k: x for k, x in enumerate(lines) if x and (x[0] in _FIRST or x[0].isdigit())}
    found = [{k: m for k, x in likely.items() if (m := family(x))} for family in _FAMILIES]
    family = max(found, key=len)
    parts: list[tuple[str, list[str]]] = [("head", [])]
    annex, last = "", 0
    for k, line in enumerate(lines):
        if not line:
            continue
        heads = family.get(k)
        value = _value(heads[1]) if heads else None
        if len(parts) > 1 and (named := _annex(line)):
            annex, last = f"{named}/", 0
        elif value is not None and value > last:
            last = value
            parts.append((f"{annex}{value}", [line]))
        elif heads or not GROUPS.match(line) or len(line) > 160 or line[-1] in ";,":
            parts[-1][1].append(line)
    seen: Counter = Counter()
    out = []
    for number, body in parts:
        if plain := "\n".join(body):
            seen[number] += 1
            key = number if seen[number] == 1 else f"{number}#{seen[number]}"
            out.append((key, plain, hashlib.sha256(plain.encode()).hexdigest()))
    return out


def _grams(text: str) -> Counter:
    plain = "".join(text.split())
    han = sum("一" <= c <= "鿿" for c in plain)
    return Counter(plain[i : i + 2] for i in range(len(plain) - 1)) if han * 2 > len(plain) else Counter(text.lower().split())


def likeness(a: str, b: str) -> float:
    """Dice over words, or over character pairs of Han texts."""
    x, y = _grams(a), _grams(b)
    return 2 * sum((x & y).values()) / (sum(x.values()) + sum(y.values())) if x or y else 0.0


def align(old: list[tuple[str, str, str]], new: list[tuple[str, str, str]]) -> list[tuple[int | None, int | None]]:
    """Pair provisions in order: equal hashes first, then the most alike in each gap."""
    blocks = difflib.SequenceMatcher(None, [p[2] for p in old], [p[2] for p in new], autojunk=False).get_matching_blocks()
    out, i, j = [], 0, 0
    for a, b, n in blocks:
        out += _gap(old, new, i, a, j, b)
        out += [(a + k, b + k) for k in range(n)]
        i, j = a + n, b + n
    return out


def _gap(old, new, i0, i1, j0, j1):
    rows, cols = i1 - i0, j1 - j0
    best = [[0.0] * (cols + 1) for _ in range(rows + 1)]
    score = [[0.0] * cols for _ in range(rows)]
    for i in range(rows - 1, -1, -1):
        for j in range(cols - 1, -1, -1):
            s = likeness(old[i0 + i][1], new[j0 + j][1]) + (SAME_NUMBER if old[i0 + i][0] == new[j0 + j][0] else 0)
            score[i][j] = s if s >= SAME else 0.0
            best[i][j] = max(best[i + 1][j], best[i][j + 1], best[i + 1][j + 1] + score[i][j] if score[i][j] else 0.0)
    out, i, j = [], 0, 0
    while i < rows or j < cols:
        if i < rows and j < cols and score[i][j] and best[i][j] == best[i + 1][j + 1] + score[i][j]:
            out.append((i0 + i, j0 + j))
            i, j = i + 1, j + 1
        elif i < rows and (j == cols or best[i][j] == best[i + 1][j]):
            out.append((i0 + i, None))
            i += 1
        else:
            out.append((None, j0 + j))
            j += 1
    return out


def compare_versions(pairs: DataFrame) -> DataFrame:
    """``pair_id, old_number, new_number, state`` of two versions' provisions (same, changed, added, removed).

    ``pairs``: pair_id, old, new (texts).  Pairs are independent rows.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for pair, old, new in zip(b["pair_id"], b["old"], b["new"], strict=True):
                x, y = split(old), split(new)
                for i, j in align(x, y):
                    state = "added" if i is None else "removed" if j is None else "same" if x[i][2] == y[j][2] else "changed"
                    rows.append((pair, None if i is None else x[i][0], None if j is None else y[j][0], state))
            yield pd.DataFrame(rows, columns=["pair_id", "old_number", "new_number", "state"])

    return pairs.select("pair_id", "old", "new").mapInPandas(run, "pair_id long, old_number string, new_number string, state string")

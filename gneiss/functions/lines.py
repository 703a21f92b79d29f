"""The line predicates of ``text`` for Arrow tasks, where a line is cleaned once: as columns each predicate would clean it
again. Tests hold both forms equal. Java's classes are ASCII unless (?U) is on, its dot stops at every line terminator."""

from __future__ import annotations

import re
import unicodedata
from typing import Any

from .text import COMMON_HEADINGS, LAYOUT_MARKS, LOCAL_HEADINGS, WHITE

_BREAK = re.compile("\r\n|\r|\n")
_TABS, _RUNS = re.compile(r"[ \t]{2,}|\t"), re.compile(f"[{WHITE}]{{2,}}|[{WHITE.replace(' ', '')}]")
_DOTTED, _NUMBERED = re.compile(r"\.{3,}\s*\d{1,3}\s*\Z", re.A), re.compile(r"\d+(?:\.\d+)*\s+", re.A)
_BEFORE_MARK, _AFTER_END = re.compile(r"\s+([,.;:!?])", re.A), re.compile(r"([.!?])\s+(?=[A-Z])", re.A)
_DOI, _URL = re.compile(r"10\.\d{4,9}/\S+", re.A), re.compile(r"https?://|www\.")
_FORM = re.compile(r"(\d+(?:\.\d+){0,3})\.?\s+([^\n\r\x85\u2028\u2029]+)\Z", re.A)
_PROSE = re.compile(r"(?ai:\d+\s+(?:were|was|are|is|the|a|an|in|of|to|for|from|with|on|by|and|or|both|two|one|several|these|those|this|that))(?!\w)")
_NAME = re.compile(r"\d+\s+[A-Z][^.!?]{0,25},\s*\Z", re.A)
_YEAR, _MARK = re.compile(r"\b(?:19|20)\d{2}\b"), re.compile(r"\b(?:doi|pmid|issn|isbn)\b")
_AUTHOR = re.compile(r"\bet\s+al\.?\b|\b[A-Z][a-z]+,\s+[A-Z]\.?|\b[A-Z][a-z]+\s+[A-Z][a-z]+,\s+[A-Z]")
_CODE, _COUNT = re.compile(r"(?<!\w)(?ai:CPG|DOI|PMID|ISSN|ISBN)(?!\w)"), re.compile(r"[A-Za-z][A-Za-z ]+\s+\d{2,4}\Z", re.A)
_SPACED, _LETTERS = re.compile(r"(?:[A-Za-z]\s+){3,}[A-Za-z]\Z", re.A), re.compile("[^A-Za-z]")
_SPACE, _NUMBER = re.compile(r"\s+", re.A), re.compile(r"\d{1,4}\Z", re.A)


def clean_line(line: str) -> str:
    line = _TABS.sub(" ", line) if "  " in line or "\t" in line else line
    return line.strip(WHITE).replace("ﬁ", "fi").replace("ﬂ", "fl")


def _one_blank(text: str) -> str:
    """Blanks are the only white space that is printable."""
    return text if "  " not in text and text.isprintable() else _RUNS.sub(" ", text)


def squeeze(text: str) -> str:
    return _one_blank(text).strip(" ")


def line_key(line: str) -> str:
    return _one_blank(line).lower()


def raw_lines(text: str) -> list[str]:
    return _BREAK.split(text)


def clean_lines(text: str | None) -> list[str]:
    return [x for x in map(clean_line, raw_lines(text or "")) if x]


def is_layout_key(low: str) -> bool:
    return low == "" or any(m in low for m in LAYOUT_MARKS)


def is_page_number(line: str) -> bool:
    return _NUMBER.match(line) is not None


def is_doi_or_url(line: str) -> bool:
    low = line.lower()
    return "doi.org/" in low or _URL.match(low) is not None or _DOI.search(low) is not None


def is_contents_page(text: str, lines: list[str]) -> bool:
    """``lines`` are the text's clean lines."""
    if "contents" in text.lower() and "table of contents" in line_key(clean_line(text)):
        return True
    if len(lines) < 8:
        return False
    dotted = sum(_DOTTED.search(x) is not None for x in lines)
    return dotted >= 3 or dotted >= 1 and sum(_NUMBERED.match(x) is not None for x in lines) >= 6


def repaired(lines: list[str]) -> str | None:
    """The text of a page of one word a line, joined; None for other pages."""
    n = len(lines)
    if n < 12 or sum(len(x) <= 18 and len(squeeze(x).split(" ")) <= 2 for x in lines) < 0.65 * n:
        return None
    sizes = sorted(map(len, lines))
    if (sizes[(n - 1) // 2] + sizes[n // 2]) / 2 > 18:
        return None
    return _AFTER_END.sub("\\1\n", _BEFORE_MARK.sub(r"\1", " ".join(lines)))


def _joined_capitals(line: str) -> str:
    return _SPACE.sub("", line) if _SPACED.match(line) else line


def _numbered(t: str) -> tuple[str, str] | None:
    form = _FORM.match(t)
    if not form:
        return None
    number, title = form[1], clean_line(form[2])
    words, common = len(squeeze(title).split(" ")), title.lower() in COMMON_HEADINGS
    low, letter = title.lower(), next((c for c in title if c.isalpha()), "")
    reject = (
        _PROSE.match(t) or _NAME.match(t) or is_doi_or_url(t) or is_layout_key(line_key(t))
        or "et al" in low or _YEAR.search(title) or title.count(",") >= 2 or _AUTHOR.search(title) or _MARK.search(low)
        or title[-1:] in (",", ";", ":") or len(title) < 3 or len(title) > 180 or letter and unicodedata.category(letter) == "Ll"
        or "." not in number and words <= 2 and not common or _CODE.search(title) or _COUNT.match(title) or words == 1 and not common
    )
    return None if reject else (number, title)


def heading(line: str) -> dict[str, Any] | None:
    """``classify_heading`` of a line."""
    t = clean_line(line)
    if t == "" or len(t) > 180 or is_page_number(t) or is_doi_or_url(t) or is_layout_key(line_key(t)):
        return None
    if found := _numbered(t):
        number, title = found
        return {"text": f"{number} {title}", "number": number, "title": title, "level": number.count(".") + 1, "kind": "numbered", "persistent": True}
    compact = clean_line(_joined_capitals(t))
    low = compact.lower().rstrip(":")
    if low in LOCAL_HEADINGS:
        kind = "local"
    elif low in COMMON_HEADINGS:
        kind = "common"
    else:
        own = _joined_capitals(compact)
        letters = _LETTERS.sub("", own)
        if not (own != "" and len(own) <= 140 and own.lower() not in LOCAL_HEADINGS and len(letters) >= 5 and letters.upper() == letters and len(squeeze(own).split(" ")) <= 16):
            return None
        kind = "caps"
    return {"text": compact, "number": None, "title": compact, "level": 0, "kind": kind, "persistent": False}

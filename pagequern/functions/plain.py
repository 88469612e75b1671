"""Scalar operators on plain strings, for stages that already hold a page; each says what text.py says of a column."""

from __future__ import annotations

import re

from . import lexicons as X

WS = "[\\t-\\r \\x85\\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
AROUND_NEWLINE = re.compile(WS + "*\\n" + WS + "*")
BLANKS = re.compile("[ \\t]{2,}")
OUTER = re.compile(f"^{WS}+|{WS}+$")
RUN = re.compile(WS + "+")
NO_PUNCTUATION = {ord(c): None for c in X.PUNCTUATION}
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def clean_text(s: str) -> str:
    """C1."""
    if "\n" in s:
        s = AROUND_NEWLINE.sub("\n", s)
    if "  " in s or "\t" in s:
        s = BLANKS.sub(" ", s)
    return s.strip(SPACES)


def norm_title(s: str) -> str:
    """C6."""
    for x in X.TITLE_DASHES:
        s = s.replace(x, "-")
    for x in X.TITLE_QUOTES:
        s = s.replace(x, '"')
    return RUN.sub(" ", s.replace("\xa0", " ").translate(NO_PUNCTUATION)).strip(" ")


def grams(s: str) -> list[str]:
    """C7 without the hash, which only equality is asked of."""
    return [s[i : i + 3] for i in range(len(s) - 2)]


def similarity(first: list[str], second: list[str]) -> float | None:
    """C8."""
    if not first and not second:
        return None
    has = set(second)
    return 200.0 * sum(g in has for g in first) / (len(first) + len(second))


def strip(s: str) -> str:
    return s.strip(SPACES)


def best_title(title: str, others: list[tuple[int, str]], least: float, digits: int = 12) -> tuple[float, int, str] | None:
    """(similarity, place, text) of the text most like the title, the last of equals; None if none is like it."""
    mine, seen = grams(norm_title(title)), {}
    best = None
    for at, text in others:
        if text not in seen:
            seen[text] = similarity(mine, grams(norm_title(text)))
        sim = seen[text]
        sim = None if sim is None else round(sim, digits)
        if sim is not None and sim >= least and (best is None or (sim, at) > best[:2]):
            best = (sim, at, text)
    return best

"""Detection of the charset of bytes (E5).

Marks at the start, escape sequences, alternating zero bytes and valid UTF-8 decide
by themselves.  Otherwise every candidate that can read all bytes is scored by what it
makes of those that are not ASCII: the share of characters that are frequent in the
writing it is for, less what is implausible there (controls, private characters, a
capital after a small letter, a lone letter of another script inside a word).  The
highest score wins, the first of equals.
"""

from __future__ import annotations

import codecs
import re

MARKS = [(codecs.BOM_UTF8, "utf-8"), (codecs.BOM_UTF32_LE, "utf-32-le"), (codecs.BOM_UTF32_BE, "utf-32-be"), (codecs.BOM_UTF16_LE, "utf-16-le"), (codecs.BOM_UTF16_BE, "utf-16-be")]
# Frequent letters beyond ASCII by writing.
CYRILLIC = "оеаинтсрвлкмдпуяыьзбгчйхжшюцщэё"
GREEK = "αοιετσνηυρπκλμςωγδχθφβξζψάέίόήύώ"
HEBREW = "יוהלאתרבשמםנןדעקפחטזגצכסךץף"
ARABIC = "اليمنورتبةعدفسهكقحجشصطخضذزغثظئءؤىأإآ"
THAI = "านรกอเงมยลวดทสตะปบคหแพไขจโชใีิั่้์ุูำ็ญณถธนผฝฟภศษซฉฐฮ"
WESTERN = "éèêëàâäáãåæçñöôóòõøüùûúíîïìßÉÖÄÜÅØÇ«»’‘“”„…–—°§£€©®·•¿¡ºª"
CENTRAL = "ąćęłńóśźżĄĆĘŁŃÓŚŹŻčďěňřšťůžýáíéúČĎĚŇŘŠŤŮŽőűŐŰăâîşţöüäßđ„”–…"
TURKISH = "ğışİĞŞçöüÇÖÜâ’“”–…"
#: charset, kind of writing, frequent characters
SINGLE = [
    ("windows-1251", "block", CYRILLIC), ("koi8-r", "block", CYRILLIC), ("iso-8859-5", "block", CYRILLIC), ("ibm866", "block", CYRILLIC), ("mac-cyrillic", "block", CYRILLIC),
    ("windows-1253", "block", GREEK), ("windows-1255", "block", HEBREW), ("windows-1256", "block", ARABIC), ("windows-874", "block", THAI),
    ("windows-1252", "latin", WESTERN), ("windows-1254", "latin", TURKISH), ("windows-1250", "latin", CENTRAL), ("iso-8859-2", "latin", CENTRAL),
]
PYTHON = {"windows-874": "cp874", "windows-949": "cp949", "ibm866": "cp866", "big5": "big5hkscs", "shift_jis": "cp932"}
#: charset, lead bytes of its frequent characters (kana, common ideographs, syllables)
DOUBLE = [("shift_jis", ((0x82, 0x83), (0x88, 0x97))), ("euc-jp", ((0xA4, 0xA5), (0xB0, 0xCF))), ("windows-949", ((0xB0, 0xC8),)), ("gb18030", ((0xB0, 0xD7),)), ("big5", ((0xA4, 0xC6),))]
KANA = re.compile("[\u3041-\u30fe]")
HANGUL = re.compile("[\uac00-\ud7a3]")
IDEOGRAPH = re.compile("[\u4e00-\u9fff]")
FOREIGN = re.compile("[^\\x00-\\x7f]")
ODD = re.compile("[\x80-\x9f\ue000-\uf8ff\ufffd]")
CASE = re.compile(r"[a-zà-öø-ÿа-яα-ω](?=[A-ZÀ-ÖØ-ÞА-ЯΑ-Ω])")
RUN = re.compile("[^\\x00-\\x7f]+")


def detect(raw: bytes) -> str:
    """A charset the bytes can be read in; windows-1252 if nothing speaks for another."""
    for mark, name in MARKS:
        if raw.startswith(mark):
            return name
    if b"\x1b$" in raw and raw.isascii():
        return "iso-2022-jp"
    first, second = raw[::2].count(0), raw[1::2].count(0)
    if first + second > 1 and len(raw) % 2 == 0 and max(first, second) > 0.9 * (first + second):
        return "utf-16-be" if first > second else "utf-16-le"
    try:
        raw.decode("utf-8")
        return "utf-8"
    except UnicodeDecodeError as e:
        if e.start > len(raw) - 4 and FOREIGN.search(raw[: e.start].decode("utf-8", "ignore")):  # cut inside its last character
            return "utf-8"
    scores = [(double(raw, name, leads), name) for name, leads in DOUBLE] + [(single(raw, name, kind, frequent), name) for name, kind, frequent in SINGLE]
    best = max(scores, key=lambda x: x[0])
    return best[1] if best[0] > 0 else "windows-1252"


def single(raw: bytes, name: str, kind: str, frequent: str) -> float:
    try:
        text = raw.decode(PYTHON.get(name, name))
    except UnicodeDecodeError:
        return 0.0
    runs = RUN.findall(text)
    n = sum(map(len, runs))
    if not n:
        return 0.0
    odd = len(ODD.findall(text)) + len(CASE.findall(text))
    if kind == "latin":
        # single letters between ASCII ones
        hits = sum(c in frequent for r in runs for c in r)
        return (hits - 2 * odd) / n * min(1.0, 2.0 * len(runs) / n)
    letters = "".join(runs).lower()
    # letters stand in words of their own script; the less frequent ones count for less
    hits = sum(1.0 - 0.4 * at / len(frequent) for c in letters if (at := frequent.find(c)) >= 0)
    words = sum(len(r) for r in runs if len(r) > 1)
    return (hits - 2 * odd) / n * (words / n)


def double(raw: bytes, name: str, leads) -> float:
    try:
        text = raw.decode(PYTHON.get(name, name))
    except UnicodeDecodeError as e:
        if e.start < len(raw) - 2:  # else cut inside its last character
            return 0.0
        text = raw[: e.start].decode(PYTHON.get(name, name))
    found = FOREIGN.findall(text)
    if not found:
        return 0.0
    pairs = [x for run in re.findall(rb"(?:[\x81-\xfe][\x40-\xfe])+", raw) for x in run[::2]]
    hits = sum(any(a <= b <= z for a, z in leads) for b in pairs) / max(1, len(pairs))
    kana, hangul, ideographs = (len(x.findall(text)) for x in (KANA, HANGUL, IDEOGRAPH))
    wide = (kana + hangul + ideographs) / len(found)
    odd = len(ODD.findall(text)) / len(found)
    if name in ("shift_jis", "euc-jp"):
        fit = 1.0 if kana > 0.15 * len(found) else 0.5 * kana / (0.15 * len(found))
    elif name == "windows-949":
        fit = hangul / len(found)
    else:
        fit = 1.0 if not kana > 0.15 * len(found) else 0.5
    return max(0.0, hits * min(1.0, 1.15 * wide) * fit - 2 * odd)

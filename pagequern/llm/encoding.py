"""Problem 6: text decoded with the wrong charset, labelled by a hidden Markov model.

One state is clean text; every other state is a pair (charset written, charset
read).  A state emits a character given the one before it.  The emissions are
fitted on the clean reference texts of the language table: as they are (and with
the harmless variety of real text: decomposed, full-width, invisible characters)
for the clean state, and garbled by its pair for every other state.  Viterbi
decoding runs over all texts of a batch at a time, on the positions at which one
of two neighbours is not ASCII.  Each labelled span then gets the inverse of its
state's garbling.

Null and pure ASCII texts are clean: every charset of the pairs reads ASCII bytes as
ASCII and other bytes as other characters, so nothing that a pair changes is ASCII;
for the same reason characters between ASCII ones have equal emissions in all states
and cannot change the labels.  (Text of which an exporter made question marks has no
charset to undo; it is not looked for.)  A replacement character is the trace of
bytes that were lost, hence a garbled span that cannot be restored.
"""

from __future__ import annotations

import functools
import re
import unicodedata

import numpy as np
import pandas as pd

from . import codepoints as C

# Fixed values: (written, read) of the states; "x2" garbles twice.
PAIRS = [
    ("utf-8", "cp1252"), ("utf-8", "latin-1"), ("utf-8 x2", "cp1252"), ("utf-8 x2", "latin-1"), ("utf-8", "mac_roman"), ("utf-8", "cp437"), ("utf-8", "cp1251"),
    ("utf-8", "koi8_r"), ("utf-8", "cp932"), ("utf-8", "gb18030"), ("utf-8", "cp1254"), ("utf-8", "cp874"), ("utf-8", "cp1250"), ("utf-8", "iso8859_9"),
    ("cp1251", "cp1252"), ("cp1251", "latin-1"), ("cp1251", "koi8_r"), ("koi8_r", "cp1251"), ("koi8_r", "cp1252"), ("koi8_r", "latin-1"), ("cp866", "cp1251"), ("cp1251", "cp866"),
    ("gb18030", "cp1252"), ("gb18030", "latin-1"), ("cp932", "cp1252"), ("cp932", "latin-1"), ("euc_jp", "latin-1"), ("big5", "latin-1"), ("cp932", "gb18030"), ("gb18030", "cp932"),
    ("cp874", "cp1252"), ("cp874", "latin-1"), ("cp1252", "cp437"), ("cp1252", "mac_roman"), ("mac_roman", "cp1252"), ("mac_roman", "latin-1"), ("cp437", "cp1252"),
    ("cp437", "latin-1"), ("cp1252", "cp1251"), ("cp1252", "koi8_r"), ("cp1252", "cp1250"), ("cp1254", "cp1252"), ("iso8859_9", "latin-1"), ("cp1252", "utf-8"), ("cp1251", "utf-8"), ("cp932", "utf-8"), ("gb18030", "utf-8"),
]
SINGLE_BYTE = {"cp1251", "koi8_r", "cp866", "cp1252", "cp1254", "iso8859_9", "mac_roman", "cp437", "cp874"}
ENTER, LEAVE = 1e-4, 1e-2
ALPHA = 2.0
NOT_ASCII = re.compile(r"[^\x00-\x7f]+")
FIT_ROWS = 5000
GAIN = 15.0  # how much likelier (log) a repaired span must be as clean text
GAIN_VALID = 12.0  # the same where only valid UTF-8 can come out
GAIN_SAME = 45.0  # the same where letters turn into others of their own script
CYRILLIC = {"cp1251", "koi8_r", "cp866"}
LOST = 0.25  # share of characters that may stay unreadable in a lossy repair
# Signs that clean pages hold besides their language's letters.
SIGNS = "–—·•›‹»«©®™×✓✉°§€£¥½¼→←…’‘“”„¿¡№ªº±µ²³"


def encode(text: str, charset: str, errors: str = "strict") -> bytes:
    """Bytes in a charset; code points 80-9F stand for the bytes a charset leaves undefined."""
    if charset == "utf-8":
        return text.encode("utf-8", errors)
    try:
        return text.encode(charset)
    except UnicodeEncodeError:
        out = bytearray()
        for ch in text:
            try:
                out += ch.encode(charset)
            except UnicodeEncodeError:
                if 0x80 <= ord(ch) <= 0x9F:
                    out.append(ord(ch))
                elif errors == "strict":
                    raise
        return bytes(out)


def decode(raw: bytes, charset: str) -> str:
    """Text of bytes as a lenient reader makes it; undefined bytes become controls or replacement characters."""
    try:
        return raw.decode(charset)
    except UnicodeDecodeError:
        if charset in ("utf-8", "cp932", "gb18030", "euc_jp", "big5"):
            return raw.decode(charset, "replace")
        table = decoding_table(charset)
        return "".join(table[b] for b in raw)


@functools.lru_cache(64)
def decoding_table(charset: str) -> list[str]:
    out = []
    for b in range(256):
        try:
            out.append(bytes([b]).decode(charset))
        except UnicodeDecodeError:
            out.append(chr(b))
    return out


def garble(text: str, pair: tuple[str, str]) -> str | None:
    """Text written and read by a pair; None where it cannot be written or does not change."""
    written, read = pair
    times = 2 if written.endswith(" x2") else 1
    out = text
    for _ in range(times):
        try:
            out = decode(encode(out, written.split()[0]), read)
        except (UnicodeEncodeError, LookupError):
            return None
    return out if out != text else None


def restore(span: str, pair: tuple[str, str]) -> str | None:
    """The inverse; None where bytes were lost."""
    written, read = pair
    if read == "utf-8" or "�" in span:
        return None
    out = span
    for _ in range(2 if written.endswith(" x2") else 1):
        try:
            out = encode(out, read).decode(written.split()[0])
        except (UnicodeEncodeError, UnicodeDecodeError):
            return None
    return out


def variants(text: str, salt: int):
    """Clean text as it may also come: each with another harmless form."""
    yield text
    yield unicodedata.normalize("NFD", text)
    yield text.replace(" ", " ", 2).replace("« ", "« ")
    yield "".join(chr(ord(c) + 0xFEE0) if c.isascii() and c.isalpha() else c for c in text[: 40 + salt % 20]) + text[40 + salt % 20 :]
    for z in "​‌‍­﻿⁠":
        yield "".join(c + z if (i * 7 + salt) % 23 == 0 and c.isalpha() else c for i, c in enumerate(text))
    yield text.translate(str.maketrans("aeopcs", "аеорсѕ"))
    yield text.translate(str.maketrans("yixov", "уіхον"))
    yield text.upper()
    yield f"<p>{text}</p><p>{text}{text}</p>"
    sign = SIGNS[salt % len(SIGNS)]
    yield f"{sign} {text[:60]} {sign} {text[60:]}>{sign}< {sign}"
    yield f"a {sign} b{sign} (c){sign}d 1{sign} {sign}2{sign}"


def _events(cp: np.ndarray, row: np.ndarray):
    """Indices of characters that count: they or the one before them are not ASCII."""
    foreign = cp > 0x7F
    prev = np.zeros(len(cp), bool)
    prev[1:] = foreign[:-1] & (row[1:] == row[:-1])
    return np.flatnonzero(foreign | prev)


def _symbol(cp: np.ndarray) -> np.ndarray:
    """Code points, with ASCII reduced to four classes."""
    s = cp.astype(np.int64)
    a = s < 0x80
    c = s[a]
    letter = ((c | 32) >= 97) & ((c | 32) <= 122)
    s[a] = np.where(letter, 1, np.where(c <= 32, 2, np.where((c >= 48) & (c <= 57), 3, 4)))
    return s


class Model:
    def __init__(self, texts: list[str], pairs=PAIRS):
        sets = [[v for i, t in enumerate(texts) for v in variants(t, i)]]
        kept = []
        for p in pairs:
            g = [x for x in (garble(t, p) for t in texts) if x]
            if p[1] == "utf-8":  # what a lossy reader leaves differs by bytes only
                g = [x for x in g if "�" in x]
            if len(g) >= 5:
                kept.append(p)
                sets.append(g)
        self.pairs = kept
        k = len(sets)
        keys, chars = [], []
        for s in sets:
            cp, off = C.from_list(s)
            row = C.rows_of(off)
            at = _events(cp, row)
            sym = _symbol(cp)
            prev = np.where((at > 0) & (row[np.maximum(at - 1, 0)] == row[at]), sym[np.maximum(at - 1, 0)], 2)
            keys.append((prev << 21) | sym[at])
            chars.append(sym[at])
        self.keys = np.unique(np.concatenate(keys))
        self.chars = np.unique(np.concatenate(chars + [x >> 21 for x in keys]))
        n2 = np.zeros((len(self.keys), k), np.float32)
        n1 = np.zeros((len(self.chars), k), np.float32)
        nprev = np.zeros((len(self.chars), k), np.float32)
        for j in range(k):
            np.add.at(n2[:, j], np.searchsorted(self.keys, keys[j]), 1)
            np.add.at(n1[:, j], np.searchsorted(self.chars, chars[j]), 1)
            np.add.at(nprev[:, j], np.searchsorted(self.chars, keys[j] >> 21), 1)
        total = n1.sum(0)
        block = (self.chars >> 7).astype(np.int64)
        self.block_share = np.zeros(((0x110000 >> 7) + 1, k), np.float32)
        for j in range(k):
            np.add.at(self.block_share[:, j], block, n1[:, j])
        self.block_share /= np.maximum(total, 1)
        backoff = 0.02 * self.block_share / 128 + 1e-8
        backoff[:, 0] = np.maximum(backoff[:, 0], 2e-7)  # clean text may hold any character
        self.backoff = backoff
        self.uni = 0.98 * n1 / np.maximum(total, 1) + backoff[block]
        self.n2, self.nprev = n2, nprev
        stay = np.log(np.where(np.arange(k) == 0, 1 - ENTER * (k - 1), 1 - LEAVE))
        self.stay, self.enter, self.leave = stay, np.log(ENTER), np.log(LEAVE)

    def emission(self, prev: np.ndarray, cur: np.ndarray) -> np.ndarray:
        """Log probability of each event in each state."""
        i = np.minimum(np.searchsorted(self.chars, cur), len(self.chars) - 1)
        uni = np.where((self.chars[i] == cur)[:, None], self.uni[i], self.backoff[cur >> 7])
        i = np.minimum(np.searchsorted(self.chars, prev), len(self.chars) - 1)
        before = np.where((self.chars[i] == prev)[:, None], self.nprev[i], 0)
        key = (prev << 21) | cur
        i = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        pair = np.where((self.keys[i] == key)[:, None], self.n2[i], 0)
        return np.log((pair + ALPHA * uni) / (before + ALPHA))

    def label(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, position in the row, state) of every event, by the best path."""
        cp, off = C.from_list(texts)
        row = C.rows_of(off)
        at = _events(cp, row)
        if not len(at):
            z = np.zeros(0, np.int64)
            return z, z, z
        sym = _symbol(cp)
        prev = np.where((at > 0) & (row[np.maximum(at - 1, 0)] == row[at]), sym[np.maximum(at - 1, 0)], 2)
        e = self.emission(prev, sym[at]).astype(np.float32)
        r = row[at]
        rows, begin, size = np.unique(r, return_index=True, return_counts=True)
        order = np.argsort(-size, kind="stable")
        begin, size = begin[order], size[order]
        k, steps = e.shape[1], int(size[0])
        v = np.full((len(begin), k), self.enter, np.float32)
        v[:, 0] = 0
        v += e[begin]
        back = np.zeros((len(at), k), np.int8)  # 0 stayed, 1 came from another state
        source = np.zeros(len(at), np.int16)  # best state to leave for the clean one
        for t in range(1, steps):
            m = int(np.searchsorted(-size, -t, "left"))  # lanes longer than t
            u = v[:m]
            other = u[:, 1:].argmax(1) + 1
            to_clean = u[np.arange(m), other] + self.leave
            new = u + self.stay
            from_clean = u[:, :1] + self.enter
            j = begin[:m] + t
            moved = from_clean > new
            moved[:, 0] = to_clean > new[:, 0]
            new = np.where(moved, from_clean, new)
            new[:, 0] = np.where(moved[:, 0], to_clean, u[:, 0] + self.stay[0])
            back[j] = moved
            source[j] = other
            v[:m] = new + e[j]
        state = np.zeros(len(at), np.int16)
        cur = v.argmax(1)
        for t in range(steps - 1, -1, -1):
            m = int(np.searchsorted(-size, -t, "left")) if t else len(begin)
            j = begin[:m] + t
            c = cur[:m]
            state[j] = c
            moved = back[j, c] == 1
            cur[:m] = np.where(moved, np.where(c == 0, source[j], 0), c)
        return r, at - off[r], state

    def clean_score(self, texts: list[str]) -> np.ndarray:
        """Log probability of each text as clean text, over its counting characters."""
        cp, off = C.from_list(texts)
        row = C.rows_of(off)
        at = _events(cp, row)
        sym = _symbol(cp)
        prev = np.where((at > 0) & (row[np.maximum(at - 1, 0)] == row[at]), sym[np.maximum(at - 1, 0)], 2)
        return np.bincount(row[at], self.emission(prev, sym[at])[:, 0] if len(at) else None, len(texts))

    def spans(self, texts: list[str]) -> list[tuple[int, int, int, int]]:
        """(row, first, end, state) of every labelled span."""
        r, pos, s = self.label(texts)
        if not len(r):
            return []
        cut = np.ones(len(r), bool)
        cut[1:] = (r[1:] != r[:-1]) | (s[1:] != s[:-1])
        head = np.flatnonzero(cut)
        tail = np.append(head[1:], len(r)) - 1
        out = []
        for a, b in zip(head.tolist(), tail.tolist()):
            if s[a]:
                out.append((int(r[a]), int(pos[a]), int(pos[b]) + 1, int(s[a])))
        return out


def repair(model: Model, texts: list[str]) -> list[tuple[int, str, str, bool, str]]:
    """(row, written, read, restored, text after repair) of every affected text, by its longest span's pair.

    A labelled span counts only if undoing its pair makes the field likelier as
    clean text, or if it holds replacement characters.
    """
    by: dict[int, list] = {}
    for row, a, b, s in model.spans(texts):
        by.setdefault(row, []).append((a, b, s))
    rows, fields, olds, news = [], [], [], []
    for row, spans in by.items():
        t = texts[row]
        for a, b, s in spans:
            span = t[a:b]
            if disguised(span):
                continue
            pair = model.pairs[s - 1]
            if pair[0] in SINGLE_BYTE and "\ufffd" not in span and apart(t, a, b):
                continue
            fixed, whole = undo(span, pair)
            if fixed is None:  # a sibling of the state's pair
                for other in model.pairs:
                    if other != pair and other[0].split()[0] == pair[0].split()[0]:
                        fixed, whole = undo(span, other, lossy=False)
                        if fixed is not None:
                            break
            if fixed is None and "\ufffd" not in span:
                continue
            rows.append(row)
            fields.append((a, b, s, span if fixed is None else fixed, whole))
            olds.append(t[max(0, a - 1) : b + 1])
            news.append(t[max(0, a - 1) : a] + fields[-1][3] + t[b : b + 1])
    gain = model.clean_score(news) - model.clean_score(olds) if rows else np.zeros(0)
    good: dict[int, list] = {}
    for row, f, g, old in zip(rows, fields, gain.tolist(), olds):
        pair = model.pairs[f[2] - 1]
        need = GAIN_VALID if pair[0].startswith("utf-8") and f[4] else GAIN_SAME if set(pair) <= CYRILLIC else GAIN
        if g >= need or "\ufffd" in old:
            good.setdefault(row, []).append(f)
    out = []
    for row, spans in good.items():
        t, parts, done = texts[row], [], 0
        for a, b, s, fixed, _ in spans:
            parts += [t[done:a], fixed]
            done = b
        parts.append(t[done:])
        long = max(spans, key=lambda x: x[1] - x[0])
        written, read = model.pairs[long[2] - 1]
        out.append((row, written, read, all(x[4] for x in spans) and "\ufffd" not in t, "".join(parts)))
    return out


def apart(text: str, a: int, b: int) -> bool:
    """True if every letter of the span that is not ASCII stands alone between others than letters."""
    for i in range(a, b):
        if ord(text[i]) > 0x7F and text[i].isalpha():
            if (i > 0 and text[i - 1].isalpha()) or (i + 1 < len(text) and text[i + 1].isalpha()):
                return False
    return True


def disguised(span: str) -> bool:
    """True if all that is not ASCII are look-alikes of Latin letters."""
    from .lookalike import tables

    latin = tables()[8]
    other = [ord(c) for c in span if ord(c) > 0x7F]
    return all(latin[c] < 0x80 for c in other)


def undo(span: str, pair: tuple[str, str], lossy: bool = True) -> tuple[str | None, bool]:
    """(span with the pair undone, whether all of it was), as a whole, run by run, or with losses."""
    fixed = restore(span, pair)
    if fixed is None and span and span[-1].isascii():
        fixed = restore(span[:-1], pair)
        fixed = None if fixed is None else fixed + span[-1]
    if fixed is not None:
        return (fixed, True) if fixed != span else (None, False)
    fixed = piecewise(span, pair)
    if fixed is not None and fixed != span:
        return fixed, not NOT_ASCII.search(span) or all(restore(m, pair) is not None for m in NOT_ASCII.findall(span))
    if pair[1] == "utf-8" or not pair[0].startswith(("utf-8", "gb18030", "cp932", "euc_jp", "big5")):
        return None, False
    if not lossy:
        return None, False
    out, lost = span, 0
    for _ in range(2 if pair[0].endswith(" x2") else 1):
        kept = "".join(c for c in out if encodable(c, pair[1]))
        lost += len(out) - len(kept)
        out = encode(kept, pair[1], "ignore").decode(pair[0].split()[0], "replace")
    lost += out.count("\ufffd")
    if lost > LOST * sum(ord(c) > 0x7F for c in out):
        return None, False
    return out.replace("\ufffd", ""), False


@functools.lru_cache(100_000)
def encodable(char: str, charset: str) -> bool:
    return bool(encode(char, charset, "ignore"))


def piecewise(span: str, pair: tuple[str, str]) -> str | None:
    """Inverts run by run where the span as a whole does not decode; None if no run does."""
    hits = 0

    def one(m):
        nonlocal hits
        x = restore(m.group(), pair)
        hits += x is not None
        return m.group() if x is None else x

    out = NOT_ASCII.sub(one, span)
    return out if hits else None


def affected(articles, samples, fields=("title", "clean_html"), fit_rows: int = FIT_ROWS):
    """page_id, field_name, written, read, restored, original of fields that were read with the wrong charset."""
    from pyspark.sql import functions as F

    # the model is fitted on at most fit_rows reference texts
    texts = [r.text for r in samples.where("text IS NOT NULL").select("text").orderBy(F.xxhash64("text")).limit(fit_rows).collect()]
    model = Model(texts) if texts else None  # without reference texts nothing can be told
    long = articles.select(
        F.col("page_id").cast("long"), F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("value")) for f in fields])).alias("x")
    ).select("page_id", "x.field_name", "x.value")
    long = long.where(F.col("value").rlike(r"[^\x00-\x7f]"))

    def run(pdfs):
        for pdf in pdfs:
            for part in C.frames(pdf, "value"):
                got = repair(model, part["value"].tolist()) if model else []
                if not got:
                    continue
                i = [g[0] for g in got]
                yield pd.DataFrame({
                    "page_id": part["page_id"].to_numpy()[i], "field_name": part["field_name"].to_numpy()[i], "written": [g[1] for g in got],
                    "read": [g[2] for g in got], "restored": [g[3] for g in got], "original": [g[4] for g in got],
                })

    return long.mapInPandas(run, "page_id long, field_name string, written string, read string, restored boolean, original string").distinct()

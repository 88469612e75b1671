"""Problem 1: sentence units by a finite transducer run as a parallel prefix scan.

Rules are stated once, as transitions between a dozen states on some twenty
character classes, and compiled to a table.  A batch of texts is one array of
classes, with an end mark after each text that resets the machine.  The array is
cut into chunks; every chunk is reduced to its function from entry state to exit
state (all chunks step in parallel); the functions are composed by a parallel
prefix scan; a second pass with the known entry states gives the outputs.  A very
long document is therefore just many chunks.

Before the machine runs, classes are resolved from their neighbours: quotation
marks to opening or closing ones (pairs only; an unmatched mark is an ordinary
closing mark), full stops to abbreviation, number or terminal ones.

Units: direct speech with everything inside and its speaker tag, before or after,
is one unit; closing marks belong to the unit they close; three full stops are a
pause inside a sentence; a space between two Thai letters divides; the end of the
text ends a unit.  Null, empty and blank texts have no unit.
"""

from __future__ import annotations

import functools
import unicodedata

import numpy as np
import pyarrow as pa

from . import codepoints as C
from . import words as W

# ---------------------------------------------------------------- fixed values
# Abbreviations after which no sentence ends.
NEVER = (
    "dr dres prof mr mrs ms st sr sra srta dra sta sto ste mme mlle mm sig sigra dott ssa fr hr hrn mevr dhr bijv "
    "vgl bzw abb cf cfr vs avda av kap bd mio mrd milj mln mld molenstr kvarng str sok cad bkz şek örn см рис ул млн млрд "
    "тыс гл стр дом afb resp ex ej ca approx kl bl"
).split()
# Abbreviations that a number follows; before anything else the full stop is terminal.
NUMBERED = "no nr nos fig figs sec p pp vol ch art núm num nº n abb cap bl tab рис".split()
MONTHS = "januar februar märz april mai juni juli august september oktober november dezember".split()
SPEECH_VERBS_SPACED = ["कहा", "पूछा", "बोला", "बोली"]
SPEECH_VERBS_UNSPACED = "说道问"
REPLY_ENDS = "こうだ"

CLASSES = "OTHER UPPER LOWER DIGIT SPACE DOT STRONG CJKEND OPEN CLOSE CLOSER THAI HAN KANA CASELESS TO TAGVERB COMMA DASH END".split()
(OTHER, UPPER, LOWER, DIGIT, SPACE, DOT, STRONG, CJKEND, OPEN, CLOSE, CLOSER, THAI, HAN, KANA, CASELESS, TO, TAGVERB, COMMA, DASH, END) = range(len(CLASSES))
SKIP = 99
STATES = "START TEXT P PS PC Q QT QTC A AS AC TAG TAGV TH THS".split()
START, TEXT, P, PS, PC, Q, QT, QTC, A, AS, AC, TAG, TAGV, TH, THS = range(len(STATES))
NONE, HERE, MARK, BACK = range(4)  # no border; border here; remember here; border at the remembered place
LETTERS = (UPPER, LOWER, THAI, HAN, KANA, CASELESS, TO, TAGVERB)
ENDS = (DOT, STRONG, CJKEND)


@functools.lru_cache(1)
def transducer() -> tuple[np.ndarray, np.ndarray]:
    """(next state, output) by state and class."""
    step = np.full((len(STATES), len(CLASSES)), TEXT, np.uint8)
    out = np.zeros((len(STATES), len(CLASSES)), np.uint8)

    def rule(states, classes, to, o=NONE):
        for s in states if isinstance(states, tuple) else (states,):
            for c in classes if isinstance(classes, tuple) else (classes,):
                step[s, c], out[s, c] = to, o

    def enter(states, classes, o):
        """A character that begins or goes on with plain text."""
        for c in classes if isinstance(classes, tuple) else (classes,):
            rule(states, c, {DOT: P, STRONG: P, CJKEND: PC, OPEN: Q, THAI: TH}.get(c, TEXT), o)

    everything = tuple(range(len(CLASSES)))
    for s in (START, TEXT):
        enter(s, everything, NONE)
    rule(START, (SPACE, CLOSER), START)
    # after a terminal mark (P), and a space (PS)
    enter((P, PS), everything, NONE)
    rule((P, PS), (UPPER, OPEN, HAN, KANA, CASELESS, THAI, TAGVERB, TO), TEXT, HERE)
    rule((P, PS), OPEN, Q, HERE)
    rule((P, PS), THAI, TH, HERE)
    rule(PS, DIGIT, TEXT, HERE)
    rule(P, SPACE, PS)
    rule(PS, SPACE, PS)
    rule(P, (DOT, STRONG, CLOSER), P)
    rule(P, CJKEND, PC)
    rule(PS, (STRONG, CLOSER), PS)
    # after the full stop of a script that needs no space (PC)
    rule(PC, everything, TEXT, HERE)
    rule(PC, OPEN, Q, HERE)
    rule(PC, THAI, TH, HERE)
    rule(PC, (DOT, STRONG, CJKEND, CLOSER, SPACE), PC)
    # inside quotation marks; QT and QTC: right after a terminal mark
    rule((Q, QT, QTC), everything, Q)
    rule((Q, QT), (DOT, STRONG), QT)
    rule(QTC, (DOT, STRONG), QTC)
    rule((Q, QT, QTC), CJKEND, QTC)
    rule(QT, (SPACE, CLOSER), QT)
    rule(QTC, (SPACE, CLOSER), QTC)
    rule(Q, CLOSE, TEXT)
    rule(QT, CLOSE, A)
    rule(QTC, CLOSE, AC)
    # after a quotation that ended with a terminal mark; AS: and a space; AC: of a script without spaces
    for s in (A, AS, AC):
        enter(s, everything, HERE)
        rule(s, (COMMA, DASH, TO, OTHER, CLOSE), TEXT)
        rule(s, (HAN, CASELESS, TAGVERB), TAG, MARK)
        rule(s, (DOT, STRONG), P)
        rule(s, CJKEND, PC)
        rule(s, CLOSER, s)
    rule(A, SPACE, AS)
    rule(AS, SPACE, AS)
    rule(AC, SPACE, AC)
    rule((A, AS), LOWER, TEXT)
    # a possible speaker tag in a script without case
    enter((TAG, TAGV), everything, BACK)
    rule((TAG, TAGV), (HAN, CASELESS, SPACE, TO), TAG)
    rule((TAG, TAGV), TAGVERB, TAGV)
    rule(TAGV, SPACE, TAGV)
    rule(TAGV, (DOT, STRONG), P)
    rule(TAGV, CJKEND, PC)
    # Thai
    enter((TH, THS), everything, NONE)
    rule(TH, THAI, TH)
    rule(TH, SPACE, THS)
    rule(THS, SPACE, THS)
    rule(THS, (UPPER, HAN, KANA, CASELESS), TEXT, HERE)
    rule(THS, THAI, TH, HERE)
    rule(THS, OPEN, Q, HERE)
    for s in range(len(STATES)):  # the end of a text
        rule(s, END, START, BACK if s in (TAG,) else NONE)
    return step, out


@functools.lru_cache(1)
def base_class() -> np.ndarray:
    """Class of a code point by itself."""
    t = np.zeros(0x110000, np.uint8)
    for c in range(0x110000):
        if 0xD800 <= c <= 0xDFFF:
            continue
        ch = chr(c)
        cat = unicodedata.category(ch)
        if cat in ("Zs", "Zl", "Zp") or ch in "\t\n\r\v\f":
            t[c] = SPACE
        elif cat == "Cf":
            t[c] = SKIP
        elif 0xE00 <= c <= 0xE7F and cat[0] in "LM":
            t[c] = THAI
        elif cat in ("Lu", "Lt"):
            t[c] = UPPER
        elif cat == "Ll":
            t[c] = LOWER
        elif cat == "Nd":
            t[c] = DIGIT
        elif 0x3040 <= c <= 0x30FF or 0xFF66 <= c <= 0xFF9F:
            t[c] = KANA
        elif 0x3400 <= c <= 0x9FFF or 0x20000 <= c <= 0x3FFFF:
            t[c] = HAN
        elif cat[0] == "L" or (cat[0] == "M" and 0x900 <= c <= 0xDFF):
            t[c] = CASELESS
    for s, k in (("。｡！？।॥", CJKEND), ("!?…‼⁇⁈⁉؟۔", STRONG), (".", DOT), (")]}）］", CLOSER), (",;:，、；：،", COMMA), ("—–", DASH), (SPEECH_VERBS_UNSPACED, TAGVERB), ("¿¡", UPPER)):
        for ch in s:
            t[ord(ch)] = k
    return t


@functools.lru_cache(1)
def word_sets() -> dict[str, np.ndarray]:
    def hashes(ws):
        out = []
        for w in ws:
            cp, off = C.from_list([w])
            h = W.find(cp, off)[2]
            if len(h):
                out.append(h[-1])
        return np.unique(np.array(out, np.uint64))

    return {"never": hashes(NEVER), "numbered": hashes(NUMBERED), "months": hashes(MONTHS), "т": hashes(["т"]), "end": hashes(["д", "п"])}


def _member(h: np.ndarray, known: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(known, h), len(known) - 1)
    return known[at] == h


QUOTES = {"“": 1, "”": 2, "«": 3, "»": 4, "„": 5, '"': 6, "‘": 7, "’": 8, "「": 9, "『": 9, "」": 10, "』": 10, "‚": 5, "‹": 3, "›": 4, "‟": 1, "＂": 6}


def _quotes(cp: np.ndarray, cls: np.ndarray, row: np.ndarray) -> None:
    """Resolves quotation marks and dialogue dashes to OPEN, CLOSE or CLOSER in cls."""
    kind = np.zeros(len(cp), np.uint8)
    marks = np.flatnonzero(np.isin(cp, [ord(q) for q in QUOTES]) | (cls == DASH))
    if not len(marks):
        return
    for q, k in QUOTES.items():
        kind[marks[cp[marks] == ord(q)]] = k
    n = len(cp)
    prev = np.where(marks > 0, marks - 1, 0)
    nxt = np.minimum(marks + 1, n - 1)
    first = (marks == 0) | (row[prev] != row[marks])
    final = (marks == n - 1) | (row[nxt] != row[marks])
    pc, nc = cls[prev], cls[nxt]
    before_gap = first | (pc == SPACE)
    after_gap = final | (nc == SPACE)
    letter_next = ~final & (np.isin(nc, LETTERS) | (nc == DIGIT) | (cp[nxt] == ord("¿")) | (cp[nxt] == ord("¡")))
    after_end = ~first & np.isin(pc, (DOT, STRONG, CJKEND, COMMA, CLOSER))
    soft_next = after_gap | np.isin(nc, (COMMA, DOT, STRONG, CJKEND, CLOSER)) | (kind[nxt] > 0)
    k = kind[marks]
    way = np.zeros(len(marks), np.int8)  # 1 opens, 2 closes
    way[(k == 1)] = 1
    way[(k == 1) & ~before_gap & soft_next] = 2
    way[(k == 2)] = 2
    way[(k == 2) & (before_gap | (pc == COMMA)) & letter_next] = 1
    way[(k == 3)] = 1
    way[(k == 3) & ~before_gap & soft_next] = 2
    way[(k == 4)] = 2
    way[(k == 4) & before_gap & letter_next] = 1
    way[k == 5] = 1
    way[k == 6] = 2
    way[(k == 6) & (before_gap | (pc == COMMA)) & letter_next] = 1
    way[(k == 7)] = 1
    way[(k == 8) & after_end & soft_next] = 2
    way[(k == 8) & ~first & (pc != SPACE) & ~np.isin(pc, LETTERS) & after_gap] = 2
    way[k == 9] = 1
    way[k == 10] = 2
    # dialogue dash: before a letter without a space; capital begins speech, small letter begins the tag
    dash = k == 0
    way[dash & before_gap & letter_next & (nc != LOWER)] = 3
    way[dash & before_gap & letter_next & (nc == LOWER)] = 4
    use = way > 0
    marks, way = marks[use], way[use]
    if not len(marks):
        return
    same = np.zeros(len(marks), bool)
    same[:-1] = row[marks[:-1]] == row[marks[1:]]
    follow = np.zeros(len(marks), np.int8)
    follow[:-1] = way[1:]
    ok_open = ((way == 1) & same & (follow == 2)) | ((way == 3) & same & (follow == 4))
    ok_close = np.zeros(len(marks), bool)
    ok_close[1:] = ok_open[:-1]
    cls[marks[ok_open]] = OPEN
    cls[marks[ok_close]] = CLOSE
    lone = ~ok_open & ~ok_close
    cls[marks[lone & (way == 2)]] = CLOSER
    cls[marks[lone & ((way == 1) | (way == 3))]] = OPEN_LONE


OPEN_LONE = 98


def _classes(cp: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Resolved class of every (visible) code point."""
    cls = base_class()[cp].copy()
    n = len(cp)
    _quotes(cp, cls, row)
    cls[cls == OPEN_LONE] = UPPER  # an unmatched opening mark can only begin a unit
    off = np.flatnonzero(np.diff(row, prepend=-1, append=-1))
    first, end, h = W.find(cp, off)
    sets = word_sets()
    for verb in SPEECH_VERBS_SPACED:
        at = np.flatnonzero(cp == ord(verb[-1]))
        at = at[at >= len(verb) - 1]
        for j, ch in enumerate(reversed(verb)):
            at = at[cp[at - j] == ord(ch)]
        cls[at] = TAGVERB
    dots = np.flatnonzero(cls == DOT)
    if len(dots):
        nxt = np.minimum(dots + 1, n - 1)
        prv = np.maximum(dots - 1, 0)
        run = ((cp[nxt] == 46) & (nxt != dots) & (row[nxt] == row[dots])) | ((cp[prv] == 46) & (prv != dots) & (row[prv] == row[dots]))
        own_end = (cp[prv] >= 0x900) & (cp[prv] < 0x980)  # Devanagari ends sentences with its own mark
        cls[dots[run | own_end]] = OTHER  # a pause
        dots = dots[~run & ~own_end]
    if len(dots) and len(first):
        w = np.searchsorted(end, dots)
        w = np.minimum(w, len(end) - 1)
        has = end[w] == dots
        size = end[w] - first[w]
        letter = cp[first[w]]  # initials are basic Latin or Cyrillic letters
        single = has & (size == 1) & np.isin(cls[first[w]], (UPPER, LOWER)) & ((letter < 0x80) | ((letter >= 0x400) & (letter < 0x500)))
        prev_w = np.maximum(w - 1, 0)
        after_t = has & _member(h[w], sets["end"]) & _member(h[prev_w], sets["т"]) & (first[w] - end[prev_w] <= 3)
        never = has & _member(h[w], sets["never"])
        # what follows, past one space
        n1 = np.minimum(dots + 1, n - 1)
        n2 = np.where(cls[n1] == SPACE, np.minimum(dots + 2, n - 1), n1)
        inside = row[n2] == row[dots]
        before_digit = inside & (cls[n2] == DIGIT)
        numbered = has & _member(h[w], sets["numbered"]) & before_digit
        spelled = has & single & (cp[np.maximum(first[w] - 1, 0)] == 46) & (first[w] > 0)  # p.m., e.g.: terminal only before a capital
        follow = np.minimum(np.searchsorted(first, dots), len(first) - 1)
        month = has & (cls[first[w]] == DIGIT) & (first[follow] == n2) & _member(h[follow], sets["months"])
        glued = has & (cls[n1] == LOWER) | (has & (cls[n1] == DIGIT))
        plain = (never | numbered | single | month | glued) & ~after_t & ~spelled
        cls[dots[plain]] = OTHER
    ends = np.flatnonzero((cp == ord("。")) & (np.arange(n) >= len(REPLY_ENDS)) & (np.arange(n) < n - 1))
    if len(ends):
        hit = np.isin(cp[ends + 1], [ord("『"), ord("「")])
        for j, ch in enumerate(reversed(REPLY_ENDS)):
            hit &= cp[ends - 1 - j] == ord(ch)
        cls[ends[hit]] = OTHER
    # と counts as a tag only right after a closing mark
    to = np.flatnonzero(cp == ord("と"))
    if len(to):
        cls[to[(to > 0) & (cls[np.maximum(to - 1, 0)] == CLOSE)]] = TO
    return cls


CHUNK = 64


def run_transducer(cls: np.ndarray) -> np.ndarray:
    """Output of every position: chunk functions composed by prefix scan."""
    step, out = transducer()
    s, n = len(STATES), len(cls)
    chunks = -(-n // CHUNK)
    pad = np.full(chunks * CHUNK, SPACE, np.uint8)
    pad[:n] = cls
    grid = np.ascontiguousarray(pad.reshape(chunks, CHUNK).T)
    fn = np.tile(np.arange(s, dtype=np.uint8), (chunks, 1))
    for c in grid:  # all chunks take one step
        fn = step[fn, c[:, None]]
    gap = 1
    while gap < chunks:  # prefix scan of function composition
        fn[gap:] = np.take_along_axis(fn[gap:], fn[:-gap].astype(np.int64), 1)
        gap *= 2
    state = np.zeros(chunks, np.uint8)
    state[1:] = fn[:-1, START]
    result = np.empty((CHUNK, chunks), np.uint8)
    for i, c in enumerate(grid):
        result[i] = out[state, c]
        state = step[state, c]
    return result.T.reshape(-1)[:n]


def borders(cp: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, end position in code points within the row) of every unit."""
    n = len(off) - 1
    row = C.rows_of(off)
    flat = base_class()[cp]
    seen = np.flatnonzero(flat != SKIP)
    vcp, vrow = cp[seen], row[seen]
    if not len(vcp):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cls = _classes(vcp, vrow)
    # an end mark after each row
    counts = np.bincount(vrow, minlength=n)
    at = np.arange(len(vcp)) + vrow
    full = np.full(len(vcp) + n, END, np.uint8)
    full[at] = cls
    ends_at = np.cumsum(counts) + np.arange(n)
    o = run_transducer(full)
    idx = np.arange(len(full))
    mark = np.maximum.accumulate(np.where(o == MARK, idx, -1))
    start = np.concatenate([idx[o == HERE], mark[(o == BACK)], ends_at])
    start = np.unique(start[start >= 0])
    solid = np.full(len(full), -1)
    keep = cls != SPACE
    solid[at[keep]] = seen[keep]
    last = np.maximum.accumulate(solid)
    start = start[start > 0]
    pos = last[start - 1]  # the last visible character before the border
    frow = np.empty(len(full), np.int64)
    frow[at] = vrow
    frow[ends_at] = np.arange(n)
    r = frow[start]
    ok = (pos >= 0) & (pos >= off[r])
    pos, r = pos[ok], r[ok]
    fresh = np.ones(len(pos), bool)
    fresh[1:] = pos[1:] != pos[:-1]
    return r[fresh], pos[fresh] - off[r[fresh]] + 1


def split_list(texts: list[str | None]) -> list[list[str]]:
    """Units of each text, for other operators; leading white space is dropped."""
    cp, off = C.from_list(texts)
    r, e = borders(cp, off)
    out: list[list[str]] = [[] for _ in texts]
    begin = [0] * len(texts)
    for i, p in zip(r.tolist(), e.tolist()):
        out[i].append((texts[i] or "")[begin[i] : p].lstrip())
        begin[i] = p
    return out


def _units(batches):
    for b in (piece for whole in batches for piece in C.pieces(whole, "text")):
        cp, off = C.from_arrow(b.column("text"))
        r, e = borders(cp, off)
        take = pa.array(r)
        yield pa.RecordBatch.from_arrays(
            [b.column("page_id").take(take), b.column("field_name").take(take), b.column("block_no").take(take), pa.array(e, pa.int32())],
            names=["page_id", "field_name", "block_no", "end_pos"],
        )


def sentence_units(texts):
    """Units of a table page_id, field_name, block_no, text; other columns are ignored."""
    from pyspark.sql import functions as F

    t = texts.select(F.col("page_id").cast("long"), F.col("field_name").cast("string"), F.col("block_no").cast("int"), F.col("text").cast("string")).where("text IS NOT NULL")
    return t.mapInArrow(_units, "page_id long, field_name string, block_no int, end_pos int")


def _paragraphs(batches):
    from ..functions.htmltree import parse, text_content

    for b in batches:
        ids, nos, texts = [], [], []
        for page, html in zip(b.column("page_id").to_pylist(), b.column("clean_html").to_pylist()):
            tree = parse(html or "", fragment=True)
            for i, tag in enumerate(tree.tag):
                if tag == "p":
                    ids.append(page)
                    nos.append(i)
                    texts.append(text_content(tree, i))
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(nos, pa.int32()), pa.array(texts, pa.string())], names=["page_id", "block_no", "text"])


def paragraphs(articles):
    """page_id, block_no, text of the ``p`` elements of clean_html; block_no is the element's ordinal."""
    from pyspark.sql import functions as F

    a = articles.where("clean_html IS NOT NULL").select(F.col("page_id").cast("long"), "clean_html")
    return a.mapInArrow(_paragraphs, "page_id long, block_no int, text string")

"""Problem 10: documents whose text was cut off before its end.

Two kinds of evidence, both over all documents:

* near-copies: a cut copy is like the beginning of its whole text, so five-word
  shingles are min-hashed (one permutation hashing, banded) for the beginnings of
  16, 48, 144, ... words; a text meets longer ones in the bands of its own length.
  Pairs are verified by aligning their shared shingles: at least 0.8 of the
  shorter text's shingles must be in the longer one, the alignment must end at
  the shorter text's end, and the longer one must go on in the same word or line;
* closing-word terminality: how often the closing tokens of a document end a
  cell elsewhere.  Cells before the last one are complete, so their ends are the
  statistics; a closing that ends too small a share of them is no end.  Lengths at
  which significantly many texts of a source end are its field's limits; there a
  closing that could be either (base64, a table's head, a word of which more
  stands elsewhere) is a cut.

One pass over the texts makes a small row a document (closings of its cells,
words that end its sentences, band hashes); all statistics come from those rows.
Identical texts are one candidate.  No bucket is compared pair by pair: a text
looks for the run of five words before its last word, in a bucket it shares,
where the longer texts have that run inside a line.  All longer texts with one
run and bucket are a class; its first and last member are verified, and the rest
only for texts that neither of them confirms.

Null and blank texts are not cut.  Without cells the whole text is one cell of
kind markdown.
"""

from __future__ import annotations

import functools
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import cut
from . import codepoints as C
from . import words as W

SHINGLE = 5
SIMILARITY = 0.8
BANDS = 5
ROWS = 3  # min-hashes a band
BINS = BANDS * ROWS
LEVELS = [16 * 3**i for i in range(16)]  # words of the beginnings that are min-hashed
END = 32  # least length of a text that can be a cut copy
SPIKE = 16.0  # log-likelihood ratio from which on a length is a limit of its source
AROUND = 64  # lengths before and after one that tell how many texts end there by chance
KNOWN_SHARE = 0.002  # a word is kept as it is in a closing if so large a share of documents close a cell with it
KNOWN_LEAST = 5
END_SHARE = 2e-5  # a closing is an end if it ends so large a share of the complete cells of its kind
END_LEAST = 2  # ... and so many of them, for one says nothing
END_RATE = 0.002  # a word ends sentences if it does so at so large a share of its occurrences
STRUCTURE_SHARE = 0.002  # a closing line of signs, a list item or heading is usual from so large a share of documents on
PAUSE_RATE = 0.25  # an ellipsis is the author's only after a word that ends a sentence at so large a share of its occurrences
CLOSING_SHARE = 0.005  # a text without a full stop may end in the same words in so large a share of documents
ABBREVIATION = 5  # a longer word before a full stop is no abbreviation

# Marks an exporter may put after a cut.
MARK = re.compile(r"\s*(?:\.\.\.|…|\[(?:\.\.\.|…|truncated|cut|more)\]|<(?:truncated|cut|snip)>|\((?:truncated|cut|more|continued)\)|\[\+?\d+ (?:chars|more)\])\s*$", re.IGNORECASE)
TOKEN = re.compile(r"\d+(?:[.,:]\d+)*|[^\W\d]\w*|[^\w\s]")
STOP = ".!?。！？।"
AFTER_STOP = "\"'”’»)]*_"
STOPPED = re.compile(r"[.!?](?=\s|\Z)|[。！？]")
CLOSERS = "\"'”’»)*_"  # between a sentence's last word and its stop
LETTERS = re.compile(r"[^\W\d_]{2,}")
ANY = "*"  # stands for all sources together, whose limits hold for texts without a source
MARK_SIZE = 64  # no mark is longer
LAST_WORD = re.compile(r"[^\W\d_]{2,}\Z")
FEW = 1_000_000  # keys (of 8 bytes) that are sent to all executors at most
BITS = 1 << 27  # of the bitmap that stands for more of them
WIDE = re.compile(r"[぀-ヿ㐀-鿿]{2,}")
OPENERS = {"(": ")", "[": "]", "{": "}"}


def mark_at(text: str) -> re.Match | None:
    """The exporter's mark at the end of a text."""
    return MARK.search(text, max(0, len(text) - MARK_SIZE))


def shape(token: str) -> str:
    """Numbers by their form, other tokens as they are."""
    if token[0].isdigit():
        parts = re.split(r"[.,:]", token)
        return "#" if len(parts) == 1 else "#" + "." * (len(parts) - 2) + "." + str(len(parts[-1]))
    return token


def open_statement(code: str) -> bool:
    """True if brackets or quotes of the last statement are still open."""
    depth: list[str] = []
    i, n = 0, len(code)
    while i < n:
        ch = code[i]
        if ch in "\"'":
            q = code[i : i + 3] if code[i : i + 3] in ('"""', "'''") else ch
            j = code.find(q, i + len(q))
            line = code.find("\n", i)
            if j < 0 or (len(q) == 1 and 0 <= line < j):
                if len(q) == 3 or line < 0:
                    return True
                i = line  # an apostrophe in a comment or shell line
                continue
            i = j + len(q)
            continue
        if ch == "#":
            line = code.find("\n", i)
            if line < 0:
                break
            i = line
            continue
        if ch in OPENERS:
            depth.append(OPENERS[ch])
        elif ch in ")]}":
            if depth and depth[-1] == ch:
                depth.pop()
        i += 1
    return bool(depth)


def last_tokens(line: str) -> list[str]:
    """The last four tokens of a line, with numbers by their form; short lines recur, so their results are shared."""
    return _shared_tokens(line) if len(line) <= 80 else _last_tokens(line)


def _last_tokens(line: str) -> list[str]:
    got = TOKEN.findall(line[-160:]) if len(line) > 160 else []
    if len(got) < 5:  # the first of these may be a part
        got = TOKEN.findall(line)
    return [shape(x) for x in got[-4:]]


_shared_tokens = functools.lru_cache(1 << 14)(_last_tokens)


def closing(kind: str, text: str, statement: bool = True) -> tuple[str, list[str], bool]:
    """(kind of line, last tokens in order, statement open if asked) of a cell's end."""
    t = text.rstrip()
    line = t[t.rfind("\n") + 1 :]
    opened = False
    if kind == "code":
        opened = statement and open_statement(t)
    elif kind == "markdown":
        s = line.lstrip()
        if s.startswith("#"):
            kind = "heading"
        elif re.match(r"(?:[-*+]|\d+[.)])\s", s):
            kind = "item"
    elif kind == "output" and len(line) > 40 and re.fullmatch(r"[A-Za-z0-9+/=]+", line):
        run = re.search(r"[A-Za-z0-9+/=\n]+\Z", t).group().replace("\n", "")
        return "base64", ["open" if len(run) % 4 else "=" if run[-1] == "=" else "full"], len(run) % 4 != 0
    elif kind == "output":
        before = t[:-len(line)].rstrip("\n") if line else ""
        prev = before[before.rfind("\n") + 1 :]
        a, b = TABLE_ROW.match(prev), TABLE_ROW.match(line)
        if a and b and len(prev.split()) > len(line.split()):
            opened = True
    toks = last_tokens(line)
    if kind in ("item", "heading") and sentence_state(toks) == "stop":
        kind = "markdown"  # a line that is a sentence ends like any other
    return kind, toks, opened


TABLE_ROW = re.compile(r"\s*\d+\s+(?:-?\d+\.\d+|NaN)(?:\s|$)")


def _cells(text: str, kinds, starts, lengths) -> list[tuple[str, str]]:
    if not kinds:
        return [("markdown", text)]
    prefixed = "# %%" in text
    out = []
    for k, s, n in zip(kinds, starts, lengths):
        if s is None or n is None:
            continue
        x = text[s : s + n]
        if prefixed and k != "code":
            x = "\n".join(y[2:] if y.startswith("# ") else "" if y == "#" else y for y in x.split("\n"))
        out.append((k or "markdown", x))
    return out or [("markdown", text)]


def shingle_hashes(h: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place of the first word, hash) of every run of SHINGLE words within a row."""
    m = len(h) - SHINGLE + 1
    if m <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    s = np.zeros(m, np.uint64)
    for j in range(SHINGLE):
        s = s * W.MULT + h[j : j + m]
    at = np.flatnonzero(row[:m] == row[SHINGLE - 1 :])
    return at, W.mix(s[at])


def band_hashes(h: np.ndarray, row: np.ndarray, n: int) -> tuple[list[list[int]], list[list[int]]]:
    """(bands of all beginnings, bands of the longest beginning) of each row.

    One permutation hashing with rotation of empty bins.  The signature of a
    beginning is the minimum of the one before and what was added, so the shingles
    are gone through once.  A row of fewer words than the first level has no bands.
    """
    size = np.bincount(row, minlength=n)
    begin = np.zeros(n + 1, np.int64)
    np.cumsum(size, out=begin[1:])
    at, s = shingle_hashes(h, row)
    r = row[at]
    last = at - begin[r] + SHINGLE  # words up to the shingle's end
    level = np.searchsorted(LEVELS, last)
    bins = (s % np.uint64(BINS)).astype(np.int64)
    sig = np.full((n, BINS), np.iinfo(np.uint64).max, np.uint64)
    every: list[list[int]] = [[] for _ in range(n)]
    own: list[list[int]] = [[] for _ in range(n)]
    order = np.argsort(level, kind="stable")
    cuts = np.searchsorted(level[order], np.arange(len(LEVELS) + 1))
    for k, words in enumerate(LEVELS):
        rows = np.flatnonzero(size >= words)
        if not len(rows):
            break
        part = order[cuts[k] : cuts[k + 1]]
        np.minimum.at(sig, (r[part], bins[part]), s[part])
        got = _banded(sig[rows], k).view(np.int64).tolist()
        for i, x in zip(rows.tolist(), got):
            every[i] += x
            own[i] = x
    return every, own


def _banded(sig: np.ndarray, level: int) -> np.ndarray:
    empty = sig == np.iinfo(np.uint64).max
    out = sig.copy()
    for step in range(1, BINS):
        if not empty.any():
            break
        donor, has = np.roll(sig, -step, axis=1), ~np.roll(sig == np.iinfo(np.uint64).max, -step, axis=1)
        fill = empty & has
        out = np.where(fill, donor + np.uint64(step * int(W.MULT) & W.MASK), out)
        empty &= ~fill
    bands = np.zeros((len(sig), BANDS), np.uint64)
    for b in range(BANDS):
        x = np.full(len(sig), b + 1 + BANDS * level, np.uint64)
        for j in range(ROWS):
            x = W.mix(x * W.MULT + out[:, b * ROWS + j])
        bands[:, b] = x
    return bands


SCHEMA = "doc_id long, src string, size long, same binary, bands array<long>, own array<long>, anchor struct<part:long,whole:long,last:long>, closings array<struct<kind:string,toks:array<string>>>, last struct<kind:string,toks:array<string>,bare:array<string>,opened:boolean,marked:boolean,fragment:boolean>, enders array<struct<word:string,docs:long,ends:long,occurs:long>>"


def sentence_ends(text: str, last: bool) -> list[str]:
    """Words before the full stops of a cell; in a document's last cell without its end, which is what is judged.

    A stop before a digit or a small letter ("Sec. 2", "e.g. so") ends no sentence.
    """
    text = text.rstrip()
    if last:
        m = mark_at(text)
        text = text[: m.start()].rstrip() if m else text
    out = []
    for m in STOPPED.finditer(text):
        at = m.end()
        j = at - 1
        if text[j] in "。！？":
            word = text[j - 2 : j] if j > 1 else ""
            if not WIDE.fullmatch(word):
                continue
        else:
            while j and text[j - 1] in CLOSERS:
                j -= 1
            k = j
            while k and text[k - 1].isalpha():
                k -= 1
            if j - k < 2:
                continue
            word = text[k:j].lower()
        after = text[at + 1 : at + 2] if text[at : at + 1] == " " else ""
        if after and not after.isspace():  # the common case: one space
            if after.islower() or after.isdigit():
                continue
        else:
            rest = text[at : at + 9]
            solid = rest.lstrip()
            rest, after = rest[: len(rest) - len(solid)], solid[:1]
            if (last and not after) or ("\n" not in rest and (after.islower() or after.isdigit())):
                continue
        out.append(word)
    return out


def occurrences(text: str) -> list[str]:
    """All words of a text in the forms in which they can end a sentence."""
    return [*LETTERS.findall(text.lower()), *(r[i : i + 2] for r in WIDE.findall(text) if len(r) > 2 for i in range(len(r) - 1))]


def _digest(batches):
    import hashlib
    from collections import Counter

    typ = pa.list_(pa.struct([("kind", pa.string()), ("toks", pa.list_(pa.string()))]))
    ends_typ = pa.list_(pa.struct([("word", pa.string()), ("docs", pa.int64()), ("ends", pa.int64()), ("occurs", pa.int64())]))
    anchor_typ = pa.struct([("part", pa.int64()), ("whole", pa.int64()), ("last", pa.int64())])
    last_typ = pa.struct([("kind", pa.string()), ("toks", pa.list_(pa.string())), ("bare", pa.list_(pa.string())), ("opened", pa.bool_()), ("marked", pa.bool_()), ("fragment", pa.bool_())])
    for whole in batches:
        for b in C.pieces(whole, "text"):
            cp, off = C.from_arrow(b.column("text"))
            first, _, h = W.find(cp, off)
            row = np.searchsorted(off, first, "right") - 1
            bands, own = band_hashes(h, row, b.num_rows)
            ends_at = np.searchsorted(row, np.arange(b.num_rows), "right")
            begins_at = np.concatenate([[0], ends_at[:-1]])
            told = np.flatnonzero(ends_at - begins_at > SHINGLE)
            tails = dict(zip(told.tolist(), zip(*(x.tolist() for x in anchors(cp, first, h, ends_at[told])))))
            closes, lasts, same, size, ends_with = [], [], [], [], []
            docs, ended, occurs = Counter(), Counter(), Counter()  # of the slice; they stand in its first row
            cols = [b.column(c).to_pylist() for c in ("text", "kinds", "starts", "lengths")]
            for text, kinds, starts, lengths in zip(*cols):
                cells = _cells(text, kinds, starts, lengths)
                got = [closing(k, x, False)[:2] for k, x in cells[:-1] if x.strip()]
                kind, x = cells[-1]
                k, toks, opened = closing(kind, x)
                m = mark_at(x.rstrip())
                bare = x.rstrip()[: m.start()] if m else x
                k2, bare_toks, opened2 = closing(kind, bare)
                closes.append([{"kind": a, "toks": t} for a, t in got])
                lasts.append({"kind": k, "toks": toks, "bare": bare_toks, "opened": opened or opened2, "marked": bool(m), "fragment": fragment(text)})
                ends: list[str] = []
                heads: set[tuple[str, str]] = set()
                for no, (kk, xx) in enumerate(cells, 1):
                    if kk == "markdown":
                        ends += sentence_ends(xx, no == len(cells))
                        occurs.update(occurrences(xx))
                        for ln in xx.rstrip().split("\n")[:-1]:
                            if ln.startswith("#"):
                                heads.add(tuple(last_tokens(ln)))
                closes[-1] += [{"kind": "heading", "toks": list(z)} for z in heads]
                ended.update(ends)
                docs.update(set(ends))
                same.append(hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=16).digest())
                size.append(len(text))
                whole_text = text.rstrip()
                mark = mark_at(whole_text)
                got = tails.get(len(size) - 1)
                if mark:
                    whole_text = whole_text[: mark.start()].rstrip()
                    cp1, off1 = C.from_list([whole_text])
                    first1, _, h1 = W.find(cp1, off1)
                    got = tuple(int(x[0]) for x in anchors(cp1, first1, h1, np.array([len(h1)]))) if len(h1) > SHINGLE else None
                ends_with.append(dict(zip(("part", "whole", "last"), got)) if got and own[len(size) - 1] and can_tell(whole_text) else None)
            enders = [[{"word": w, "docs": docs[w], "ends": ended[w], "occurs": k} for w, k in occurs.items()], *[[]] * (b.num_rows - 1)]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("src"), pa.array(size, pa.int64()), pa.array(same, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array([x if y is not None else [] for x, y in zip(own, ends_with)], pa.list_(pa.int64())), pa.array(ends_with, anchor_typ), pa.array(closes, typ), pa.array(lasts, last_typ), pa.array(enders[: b.num_rows], ends_typ)],
                names=["doc_id", "src", "size", "same", "bands", "own", "anchor", "closings", "last", "enders"],
            )


def digest(documents: DataFrame) -> DataFrame:
    """One small row a document with text (SCHEMA)."""
    from .mixing import source_name

    docs = documents.where("text IS NOT NULL AND trim(text) <> ''").select(
        F.col("doc_id").cast("long").alias("doc_id"), source_name(F.col("source")).alias("src"), "text",
        F.col("cells.kind").alias("kinds"), F.col("cells.start_pos").alias("starts"), F.col("cells.len_chars").alias("lengths"),
    )
    return docs.mapInArrow(_digest, SCHEMA)


class Terminality:
    """Statistics of closings over all distinct texts, and the verdict by closing words.

    No text is evidence for itself: identical texts count once among final closings,
    and what counts those leaves the judged text out.
    """

    def __init__(self, digests: DataFrame):
        self.d = digests
        n = digests.count()
        least = max(KNOWN_LEAST, int(KNOWN_SHARE * n))
        word = F.col("t").rlike(r"(?U)^\p{L}|^_")
        inside = digests.select(F.explode(F.array_distinct(F.transform(F.flatten("closings.toks"), F.lower))).alias("t")).where(word).groupBy("t").count()
        # what the judged ends hold may be parts of words: identical texts count once
        last = digests.select(F.xxhash64("same").alias("s"), F.explode(F.array_distinct(F.transform(F.array_union("last.toks", "last.bare"), F.lower))).alias("t")).where(word).distinct().groupBy("t").count()
        common = inside.unionByName(last).groupBy("t").agg(F.sum("count").alias("count")).where(F.col("count") > least)
        self.known = [r.t for r in common.select("t").collect()]  # at most (closing words a document) / KNOWN_SHARE words
        self.documents = n

    def keyed(self) -> tuple[DataFrame, DataFrame]:
        known = set(self.known)

        def mask(toks):
            return [t if not (t[0].isalpha() or t[0] == "_") or t.lower() in known else "X" for t in toks]

        def run_cells(pdfs):
            for pdf in pdfs:
                out: dict[tuple[str, str], int] = {}
                for kind, toks in zip(pdf["kind"], pdf["toks"]):
                    ks = keys(kind, mask(list(toks)))
                    if kind == "heading" and len(toks):
                        ks.append(("heading", "1" + toks[-1].lower()))
                    for k in ks:
                        out[k] = out.get(k, 0) + 1
                if out:
                    yield pd.DataFrame([(*k, v) for k, v in out.items()], columns=["kind", "k", "n"])

        def run_last(pdfs):
            for pdf in pdfs:
                rows = []
                for doc, same, src, size, last in zip(pdf["doc_id"], pdf["same"], pdf["src"], pdf["size"], pdf["last"]):
                    toks, bare = list(last["toks"]), list(last["bare"])
                    m = mask(toks)
                    ks = keys(last["kind"], m)
                    lone = len(toks) > 1 and toks[-2] == "#"
                    form = "x" if m and m[-1] == "X" else "word" if m and (m[-1][0].isalnum()) else "sign"
                    w = next((t for t in reversed(bare) if t[0].isalpha()), "")
                    rows.append((doc, same, src, size, bool(last["fragment"]), last["kind"], toks == ["full"], ks[0][1], ks[1][1], sentence_state(toks), sentence_state(bare), ender_of(w), bool(last["opened"]), "1" + toks[-1].lower() if toks else "", form, lone))
                if rows:
                    yield pd.DataFrame(rows, columns=["doc_id", "same", "src", "size", "fragment", "kind", "full", "k3", "k2", "state", "bare_state", "word", "opened", "k1", "form", "lone"])

        cells = self.d.select(F.explode("closings").alias("c")).select("c.kind", "c.toks").mapInPandas(run_cells, "kind string, k string, n long").groupBy("kind", "k").agg(F.sum("n").alias("n"))
        last = self.d.select("doc_id", "same", F.coalesce("src", F.lit(ANY)).alias("src"), "size", "last").mapInPandas(run_last, "doc_id long, same binary, src string, size long, fragment boolean, kind string, full boolean, k3 string, k2 string, state string, bare_state string, word string, opened boolean, k1 string, form string, lone boolean")
        # only hashes of closings are exchanged; both are joined several times
        cells = cells.select("kind", F.xxhash64("kind", "k").alias("k"), F.col("k").startswith("3").alias("three"), "n")
        last = last.select(*[c for c in last.columns if c not in ("k1", "k2", "k3", "word")], *[F.xxhash64("kind", k).alias(k) for k in ("k1", "k2", "k3")], F.xxhash64("word").alias("word"), F.length("word").alias("letters"))
        return cut(cells), cut(last)

    def limits(self) -> DataFrame:
        """(src, size): lengths of a source (of all texts: ANY) at which significantly more texts end than around them."""
        one = self.d.groupBy("same").agg(F.min(F.struct(F.coalesce("src", F.lit(ANY)).alias("src"), "size")).alias("r")).select("r.*")
        sizes = one.where(F.col("src") != ANY).unionByName(one.withColumn("src", F.lit(ANY))).groupBy("src", "size").agg(F.count("*").alias("n"))
        sizes = cut(sizes.withColumn("part", F.floor(F.col("size") / AROUND)))  # one row a length
        near = sizes.select("src", F.explode(F.array(F.col("part") - 1, F.col("part"), F.col("part") + 1)).alias("part"), F.col("size").alias("other"), F.col("n").alias("k"))
        x = sizes.join(near, ["src", "part"]).where((F.abs(F.col("size") - F.col("other")) <= AROUND) & (F.col("size") != F.col("other")))
        x = sizes.join(x.groupBy("src", "size").agg(F.sum("k").alias("k")), ["src", "size"], "left")
        by_chance = F.greatest(F.coalesce("k", F.lit(0)), F.lit(1)) / (2.0 * AROUND)
        ratio = F.col("n") * F.log(F.col("n") / by_chance) - (F.col("n") - by_chance)
        return x.where((F.col("n") >= 2 * by_chance) & (ratio >= SPIKE)).select("src", "size", F.lit(True).alias("limit"))

    def verdicts(self) -> DataFrame:
        """doc_id, score (how often the closing ends complete cells) and whether the closing is no end."""
        cells, last = self.keyed()
        enders = self.d.select(F.explode("enders").alias("e")).groupBy("e.word").agg(F.sum("e.docs").alias("ends"), (F.sum("e.ends") / F.sum("e.occurs")).alias("rate")).where("ends > 0").withColumn("word", F.xxhash64("word"))
        finals = last.groupBy("k3").agg((F.countDistinct("same") - 1).alias("finals"))  # others than the judged one
        x = last.drop("same")
        for k in ("3", "2", "1"):
            x = x.join(cells.select(F.col("k").alias(f"k{k}"), F.col("n").alias(f"n{k}")), f"k{k}", "left")
        x = x.join(finals, "k3", "left").drop("k1", "k2", "k3").join(enders, "word", "left").drop("word")
        x = x.join(self.limits(), ["src", "size"], "left").withColumn("limit", F.coalesce("limit", F.lit(False)))
        for c in ("n3", "n2", "n1", "finals", "ends", "rate"):
            x = x.withColumn(c, F.coalesce(F.col(c), F.lit(0)))
        totals = {r.kind: r.n for r in cells.where("three").groupBy("kind").agg(F.sum("n").alias("n")).collect()}  # one row a kind
        least = F.create_map(*[F.lit(y) for k, n in totals.items() for y in (k, float(max(END_LEAST, END_SHARE * n)))]) if totals else F.create_map().cast("map<string,double>")

        def enough(c: str):
            return F.col(c) >= F.coalesce(F.try_element_at(least, F.col("kind")), F.lit(float(END_LEAST)))

        ender = (F.col("ends") >= END_LEAST) & (F.col("rate") >= END_RATE)
        unsure = F.col("limit") & ((F.col("form") == "x") | F.col("fragment"))
        frequent = F.col("finals") >= max(3, int(STRUCTURE_SHARE * self.documents))
        sentence = (F.col("state") == "stop") & (enough("n2") | ender | (F.col("letters") > ABBREVIATION))
        pause = (F.col("state") == "pause") & ((F.col("bare_state") == "stop") | (F.col("rate") >= PAUSE_RATE))
        seen = enough("n3") | frequent
        # without a full stop only signs ("$$", "---", ")") or frequent whole words end a text
        structure = (F.col("state") == "open") & (F.col("form") != "x") & F.when(F.col("form") == "sign", seen).otherwise(F.greatest("finals", "n3") >= max(10, int(CLOSING_SHARE * self.documents)))
        text_end = (F.col("kind") == "markdown") & (sentence | pause | structure)
        item_end = (F.col("kind") == "item") & (sentence | ((F.col("form") != "x") & seen & ~unsure))
        heading_end = (F.col("kind") == "heading") & (enough("n1") | (frequent & (F.col("form") != "x")) | sentence | (~F.col("limit") & ~F.col("fragment") & (ender | (~F.col("lone") & enough("n3")))))
        sure64 = (F.col("kind") == "base64") & ~(F.col("limit") & F.col("full"))
        other_end = ~F.col("kind").isin("markdown", "item", "heading") & ~F.col("opened") & ((enough("n3") & ~((F.col("kind") == "output") & unsure) & (F.col("kind") != "base64")) | sure64)
        return x.select("doc_id", F.col("n3").alias("score"), (~(text_end | item_end | heading_end | other_end)).alias("no_end"))


def keys(kind: str, toks: list[str]) -> list[tuple[str, str]]:
    """Closing keys of three and two tokens; a closing number keeps one more token before it."""
    three = toks[-3:]
    two = toks[-3:] if len(toks) > 1 and toks[-2].startswith("#") else toks[-2:]
    return [(kind, "3" + "\u0001".join(three)), (kind, "2" + "\u0001".join(two))]


def sentence_state(toks: list[str]) -> str:
    """'stop' after a full stop with closing marks, 'pause' after an ellipsis, else 'open'."""
    i = len(toks)
    while i and toks[i - 1] in AFTER_STOP:
        i -= 1
    if not i:
        return "open"
    if toks[i - 1] == "…" or toks[max(0, i - 3) : i] == [".", ".", "."]:
        return "pause"
    return "stop" if toks[i - 1] in STOP else "open"


def ender_of(word: str) -> str:
    """The form in which a closing word stands among words that end sentences."""
    if word and "぀" <= word[-1] <= "鿿":
        return word[-2:]
    return word.lower()


def anchors(cp: np.ndarray, first: np.ndarray, h: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the words before each place in stop: hashes of the five before the last with its first letter, of all six, and of the last.

    The last word may be a part only.
    """
    five, six = _runs(h, stop - SHINGLE - 1)
    letter = W.tables()[1][cp[first[stop - 1]]].astype(np.uint64)
    return W.mix(five * W.MULT + letter).view(np.int64), six.view(np.int64), h[stop - 1].view(np.int64)


def can_tell(s: str) -> bool:
    """A text's end, without white space and mark, that can tell a cut."""
    return len(s) >= END and s[-1] not in STOP


def _runs(h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of SHINGLE words from each place, and of one word more."""
    x = np.zeros(len(at), np.uint64)
    for j in range(SHINGLE):
        x = x * W.MULT + h[at + j]
    return W.mix(x), W.mix(W.mix(x * W.MULT + h[at + SHINGLE]) + np.uint64(1))


def fragment(text: str) -> bool:
    """The last word stands nowhere else in the text, but begins a longer word of it."""
    s = text.rstrip()
    m = LAST_WORD.search(s, max(0, len(s) - 2 * MARK_SIZE))
    if not m:
        return False
    w = m.group()
    if len(w) == 2 * MARK_SIZE or s.count(w) == 1:
        return False
    at, longer = s.find(w), False
    while at < m.start():
        before, after = s[at - 1 : at], s[at + len(w) : at + len(w) + 1]
        if not before.isalpha():
            if not after.isalpha():
                return False
            longer = True
        at = s.find(w, at + 1)
    return longer


def _inside(batches):
    """(h, next, doc_id): runs after which a line goes on, as shorter texts look for them.

    A run of SHINGLE words and the first letter of the next word in the line, with that
    word, which a cut may have shortened; a run of one word more, if yet another word
    follows in the line, after which a cut may have come (next is 0).
    """
    for whole in batches:
        for b in C.pieces(whole, "text"):
            cp, off = C.from_arrow(b.column("text"))
            first, end, h = W.find(cp, off)
            row = np.searchsorted(off, first, "right") - 1
            lines = np.zeros(len(cp) + 1, np.int64)
            np.cumsum(cp == 0x0A, out=lines[1:])
            on = np.zeros(len(h), bool)  # word i is followed by another one in its line
            on[:-1] = (row[1:] == row[:-1]) & (lines[first[1:]] == lines[end[:-1]])
            at = np.arange(max(len(h) - SHINGLE, 0))
            at = at[(row[at] == row[at + SHINGLE - 1]) & on[at + SHINGLE - 1]]
            if not len(at):
                continue
            five, six = _runs(h, at)
            nxt = at + SHINGLE
            letter = W.tables()[1][cp[first[nxt]]].astype(np.uint64)
            more = on[nxt]
            keys = np.concatenate([W.mix(five * W.MULT + letter), six[more]])
            words = np.concatenate([h[nxt], np.zeros(int(more.sum()), np.uint64)])
            rows = np.concatenate([row[at], row[at[more]]])
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(words.view(np.int64)), b.column("doc_id").take(pa.array(rows))], names=["h", "next", "doc_id"])


def likely(df: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    """Rows of df whose long column may be among keys, without an exchange of df; a join with the keys follows everywhere.

    Few keys, by count, are sent to all executors; of more of them a bitmap of BITS
    hashes is, of 16 MB whatever their number.
    """
    keys = cut(keys.select(column).distinct())
    if keys.count() <= FEW:
        return df.join(F.broadcast(keys), column, "left_semi")
    bit = F.pmod(F.xxhash64(column), F.lit(BITS))
    maps = keys.select(bit.alias("bit")).groupBy(F.bitmap_bucket_number("bit").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("map"))
    near = df.withColumn("bit", bit).withColumn("bucket", F.bitmap_bucket_number("bit")).join(F.broadcast(maps), "bucket")
    at = F.bitmap_bit_position("bit")
    byte = F.conv(F.hex(F.substring("map", (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return near.where(F.pmod(F.floor(byte / F.pow(F.lit(2), at % 8)), F.lit(2)) == 1).select(*df.columns)


def aligned(short: str, long: str) -> bool:
    """True if short is a near-copy of a beginning of long, their alignment ends with short, and long goes on in the same word or line."""
    s = short.rstrip()
    m = mark_at(s)
    s = s[: m.start()].rstrip() if m else s
    (first, _, h), (first2, end2, h2) = (W.find(*C.from_list([t])) for t in (s, long))
    a, b = (shingle_hashes(x, np.zeros(len(x), np.int64))[1] for x in (h, h2))
    if len(h) <= SHINGLE or not len(b):
        return False
    whole = a[:-1]  # the last word may be a part
    if np.isin(np.unique(whole), b).mean() < SIMILARITY:
        return False
    word = s[int(first[-1]) :]
    for i in np.flatnonzero(b == whole[-1]).tolist():  # where the alignment ends with the short text
        at = i + SHINGLE
        if at >= len(h2):
            continue
        # most shared shingles lie on few shifts up to here: those before the end must be before the place found
        if np.isin(np.unique(whole), b[: i + 1]).mean() < SIMILARITY:
            continue
        start = int(first2[at])
        if "\n" in long[int(end2[at - 1]) : start] or not long[start:].startswith(word):
            continue
        rest = long[start + len(word) :]
        if not rest.strip() or rest[0] == "\n" or (m and MARK.fullmatch(rest)):
            continue
        return True
    return False


def _verify(pdfs):
    for pdf in pdfs:
        hit = [aligned(a, b) for a, b in zip(pdf["short_text"], pdf["long_text"])]
        if any(hit):
            yield pdf.loc[hit, ["short"]]


class Copies:
    """Texts that a verified near-copy shows to be cut."""

    def __init__(self, digests: DataFrame, texts: DataFrame):
        """digests: SCHEMA; texts: doc_id, text."""
        self.texts = texts
        one = digests.groupBy("same").agg(F.min(F.struct("doc_id", "bands", "own", "anchor")).alias("r")).select("r.*")
        banded = one.select("doc_id", F.explode("bands").alias("band"), F.array_contains("own", F.col("band")).alias("own"))
        shared = banded.groupBy("band").agg(F.count("*").alias("n"), F.max("own").alias("cuts")).where("n > 1 AND cuts").select("band")
        self.members = cut(banded.join(shared, "band"))  # texts of buckets in which one can be a cut copy of another
        ends = one.where("anchor IS NOT NULL").select("doc_id", F.explode(F.array("anchor.part", "anchor.whole")).alias("h"), F.col("anchor.last").alias("last"))
        self.shorts = cut(self.members.where("own").join(ends, "doc_id").select("h", "band", "last", F.col("doc_id").alias("short")))

    def classes(self) -> tuple[DataFrame, DataFrame]:
        """(h, next, band, doc_id) of texts that go on after the run h, and (h, next, band, low, high, n): their classes."""
        runs = likely(self.texts, self.members, "doc_id").mapInArrow(_inside, "h long, next long, doc_id long")
        runs = likely(runs, self.shorts, "h").distinct()
        longs = cut(runs.join(self.members.select("doc_id", "band"), "doc_id").select("h", "next", "band", "doc_id"))
        return longs, longs.groupBy("h", "next", "band").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count("*").alias("n"))

    def verified(self, pairs: DataFrame) -> DataFrame:
        """short of the verified ones of the pairs (short, long)."""
        pairs = cut(pairs)
        need = pairs.select(F.col("short").alias("doc_id")).union(pairs.select(F.col("long").alias("doc_id")))
        some = likely(self.texts, need, "doc_id")
        both = pairs.join(some.select(F.col("doc_id").alias("short"), F.col("text").alias("short_text")), "short").join(
            some.select(F.col("doc_id").alias("long"), F.col("text").alias("long_text")), "long"
        )
        return both.select("short", "short_text", "long_text").mapInPandas(_verify, "short long").distinct()

    def found(self) -> DataFrame:
        """doc_id of one text of each group of identical ones."""
        longs, classes = self.classes()
        met = cut(self.shorts.join(classes, ["h", "band"]).where(F.col("next") != F.col("last")))
        ends = met.select("short", F.explode(F.array("low", "high")).alias("long")).where("short <> long").distinct()
        sure = cut(self.verified(ends))
        # what neither end of a class confirms is compared with all the others of it
        left = met.where("n > 2").join(sure, "short", "left_anti").select("h", "next", "band", "short", "low", "high")
        rest = left.join(longs.withColumnRenamed("doc_id", "long"), ["h", "next", "band"]).where("long NOT IN (short, low, high)").select("short", "long").distinct()
        return sure.union(self.verified(rest)).select(F.col("short").alias("doc_id")).distinct()


class Truncation:
    """documents: doc_id, source, text, cells; other columns are ignored."""

    def __init__(self, documents: DataFrame):
        self.documents = documents
        self.digests = cut(digest(documents))

    def by_copies(self) -> DataFrame:
        """doc_id of texts whose alignment with a verified near-copy ends early, with all ids of the same text."""
        texts = self.documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        hit = Copies(self.digests, texts).found()
        same = self.digests.select("doc_id", "same")
        return same.join(hit.join(same, "doc_id").select("same").distinct(), "same", "left_semi").select("doc_id")

    def found(self) -> DataFrame:
        """doc_id of every document cut off before its end."""
        closing_words = Terminality(self.digests).verdicts().where("no_end").select("doc_id")
        return self.by_copies().union(closing_words).distinct()

    def by_source(self) -> DataFrame:
        """source (null as is), documents, truncated, share."""
        flagged = self.found().withColumn("cut", F.lit(1))
        x = self.digests.select("doc_id", F.col("src").alias("source")).join(flagged, "doc_id", "left")
        g = x.groupBy("source").agg(F.count("*").alias("documents"), F.count("cut").alias("truncated"))
        return g.withColumn("share", F.round(F.col("truncated") / F.col("documents"), 6))

"""Problem 7: template residue, filler and server messages in place of content.

1. Every line (block of clean_html) is normalised - lower case, one space, the
   digits of messages (references, times) as 0 - and its hash counted by host,
   each page once.
2. Lines on a large share of a host's other pages are its boilerplate and are
   subtracted: what is left is the page's residual.  A page without content of its
   own in the residual keeps its messages: there they stand in the article's place.
3. A field is reported if a line of its residual shows an unfilled placeholder,
   filler, or a sentence that a classifier takes for a template's default text, a
   server's error or access message or a notice on scripts or browser checks.  The
   classifier (logistic regression on hashed character n-grams of a sentence) is
   fitted on the labelled table of template_table and on at most FIT_ROWS reference
   texts as ordinary sentences.  A title is one line and the whole field, so nothing
   is subtracted from it.

A sentence must be a message as a whole, titles must be one (after the site's own
name), so texts that only tell about such things are no evidence.
Literal text (code, pre) is not looked at.  Null and blank fields give nothing;
a row delivered again counts once; pages without a site form one host.
"""

from __future__ import annotations

import functools
import hashlib
import re

import numpy as np
import pandas as pd

from ..plans.lineage import cut
from . import blocks, sentences
from . import codepoints as C
from . import template_table as table
from . import words as W

FIT_ROWS = 5_000
BITS = 15
DIMENSIONS = 1 << BITS  # of hashed n-grams
MIX = np.uint64(0xBF58476D1CE4E5B9)
MESSAGE_SCORE = 1.8  # log-odds from which on a sentence is a message
RECURRENT_SHARE = 0.3  # of a host's other pages

# Placeholders of template languages.
PLACEHOLDER = re.compile(
    r"""
      \{\{\s*[#/^&>]?\s*(?!cite|reflist|main\b|main\||see\b|cn\b|stub|infobox)[A-Za-z_][\w.\-]*(?:\s+[a-z_]\w*)?\s*(?:\|\s*\w+\s*)?\}\}(?<!\|\}\})
    | \$\{\{?\s*[A-Za-z_][\w.]*\s*\}?\}
    | \#\{\s*[A-Za-z_][\w.]*\s*\}
    | <%[=\-]?[^%<>]{1,60}%>
    | \{%-?[^%{}]{1,60}-?%\}
    | %\([A-Za-z_]\w*\)[sdif]
    | %%[A-Z][A-Z_ ]*%%
    | (?<![\w%])%[A-Z][A-Z_]{2,}%(?![\w%])
    | \#\#[A-Z][A-Z_]{2,}\#\#
    | (?<![\w])__(?!TOC__|NOTOC__|FORCETOC__|NOEDITSECTION__|INDEX__|NOINDEX__|NEWSECTIONLINK__)[A-Z][A-Z_]*[A-Z]__(?!\w)
    | (?<![\w\\{}^$_/])\{\d{1,2}\}(?![\w{}^])
    | (?<![\w{}\\])\{\$[a-z_]\w*\}
    | (?<!\w)@@?[A-Z]\w*\.[A-Z]\w*\b
    | \[(?:insert|your|ihre?r?|votre|su|tu|seu|il\ tuo|uw|ditt|enter|add|placeholder|name\ here)\b[^\]\n]{0,30}\](?!\()
    | \b[XY]{2}/[XY]{2}/[XY]{4}\b
    | \[object\ [A-Z]\w+\]
    """,
    re.VERBOSE | re.IGNORECASE,
)
# Alternatives above that are only meant in capitals are checked again here.
CAPITALS = re.compile(r"^(?:%|__|\#\#|[XY]|@)")

# Words of the customary filler text.
FILLER = frozenset(
    "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud "
    "exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur "
    "excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum".split()
)

# Titles that are a server's or a template's as a whole.
TITLE = re.compile(
    r"^(?:"
    + "|".join(
        [
            r"(?:error )?\d{3}(?: [-–:(]?\s?(?:\(?not found\)?|\(?page not found\)?|forbidden|bad gateway|internal server error|service unavailable|unauthorized|gateway time-?out))?\)?",
            r"error \d{3}.*", r"page not found", r"not found", r"access denied", r"forbidden", r"service (?:temporarily )?unavailable", r"bad gateway", r"internal server error", r"session expired",
            r"attention required!?", r"login required", r"just a moment(?:\.\.\.|…)?", r"enable (?:cookies|javascript)(?: to continue)?", r"javascript (?:is )?(?:disabled|required)", r"one moment,? please(?:\.\.\.|…)?",
            r"untitled(?: document| page| \d+)?", r"new page(?: \d+)?", r"sample page", r"hello world!?", r"document", r"undefined", r"null", r"nan", r"none", r"index of /.*",
            r"your (?:headline|title) (?:goes )?here", r"(?:page )?title(?: goes)? here", r"hier steht der titel", r"titre de la page ici", r"título de la página aquí", r"titolo della pagina qui", r"lorem ipsum.*",
            r"\[page title\]", r"\[\[title\]\]", r"\{\d\}(?: [-|] \{\d\})?", r"\{\$?[a-z_]\w*\}", r"@?model\.title", r"@[\w.]+",
            r"seite nicht gefunden", r"página no encontrada", r"página não encontrada", r"page introuvable", r"pagina non trovata", r"pagina niet gevonden", r"sidan hittades inte", r"sayfa bulunamadı",
            r"страница не найдена", r"页面不存在", r"ページが見つかりません", r"पृष्ठ नहीं मिला", r"ไม่พบหน้า.*",
        ]
    )
    + r")$",
    re.IGNORECASE,
)
AFFIX = re.compile(r"\s+[-–—|·»:]+\s+|:\s+|\s*::\s*|\s*\|\s*")
WORD = re.compile(r"[^\W\d_]+")
SPACE = re.compile(r"\s+")
DIGIT = re.compile(r"\d")


SIGN = re.compile(r"[{}$#<%@\[\]_]|[XYxy]{2}/")  # one of which every placeholder has


def placeholder(text: str) -> bool:
    if not SIGN.search(text):
        return False
    for m in PLACEHOLDER.finditer(text):
        s = m.group()
        if CAPITALS.match(s) and s != s.upper() and not s.startswith(("%(", "@")):
            continue
        if s[0] == "@" and not re.match(r"@@?[A-Z]\w*\.[A-Z]", s):
            continue
        return True
    return False


def filler(text: str) -> bool:
    """Most words of a longer text are those of the filler text."""
    words = WORD.findall(text.lower())
    return len(words) >= 4 and sum(map(FILLER.__contains__, words)) >= 0.8 * len(words)


def title_evidence(title: str | None) -> bool:
    if not title or not title.strip():
        return False
    t = SPACE.sub(" ", title.strip())
    if placeholder(t) or filler(t):
        return True
    parts = [t, *[p.strip() for p in AFFIX.split(t)]]
    return any(p and TITLE.match(p) for p in parts)


def hashed(sentences_: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(sentence, hashed n-gram) of all n-grams of 2 to 5 characters of sentences in their normal form with marked ends."""
    if not len(sentences_):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    # all at once: each between marks that occur in no text
    text = "\u0003\u0002".join(s.replace("\u0003", " ") for s in sentences_)
    cp, _ = C.from_list([DIGIT.sub("0", f"\u0002{text.lower()}\u0003")])
    off = np.concatenate([[0], np.flatnonzero(cp == 3) + 1])
    row = C.rows_of(off)
    rows, keys = [], []
    h = cp.astype(np.uint64)
    for n in range(2, 6):
        if len(cp) < n:
            break
        h = h[:-1] * W.MULT + cp[n - 1 :].astype(np.uint64)
        ok = row[: len(h)] == row[n - 1 :]
        rows.append(row[: len(h)][ok])
        h_ok = h[ok]
        keys.append((((h_ok ^ (h_ok >> np.uint64(29))) * MIX) >> np.uint64(64 - BITS)).astype(np.int64))
    return (np.concatenate(rows), np.concatenate(keys)) if rows else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def labelled() -> tuple[list[str], list[str]]:
    """Sentences of the table that are messages, and those that are none."""
    return [m for v in table.MESSAGES.values() for m in table.split(v)], table.split(table.TELLING) + table.split(table.MENUS)


class Evidence:
    """Logistic regression on hashed n-grams; classes weigh the same; adaptive gradient steps."""

    def __init__(self, texts: list[str] = (), steps: int = 250, messages: list[str] | None = None, telling: list[str] | None = None):
        ordinary = [u for us in sentences.split_list(list(texts)) for u in us]
        messages = messages or labelled()[0]
        others = ordinary + (telling or labelled()[1]) * 2
        y = np.array([1.0] * len(messages) + [0.0] * len(others))
        weigh = np.where(y > 0, len(y) / (2 * len(messages)), len(y) / (2 * len(others)))
        row, key = hashed(messages + others)
        scale = 1 / np.sqrt(np.maximum(np.bincount(row, minlength=len(y)), 1))
        self.w, self.b = np.zeros(DIMENSIONS), 0.0
        seen, seen_b = np.full(DIMENSIONS, 1e-8), 1e-8
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(np.bincount(row, weights=self.w[key], minlength=len(y)) * scale + self.b, -30, 30)))
            d = (p - y) * weigh
            g = np.bincount(key, weights=(d * scale)[row], minlength=DIMENSIONS) / len(y) + 1e-5 * self.w
            seen += g * g
            seen_b += d.mean() ** 2
            self.w -= 0.5 * g / np.sqrt(seen)
            self.b -= 0.5 * d.mean() / np.sqrt(seen_b)

    def score(self, sentences_: list[str]) -> np.ndarray:
        """Log-odds that each sentence is a message."""
        row, key = hashed(sentences_)
        n = np.bincount(row, minlength=len(sentences_))
        return np.bincount(row, weights=self.w[key], minlength=len(sentences_)) / np.sqrt(np.maximum(n, 1)) + self.b

    def shows(self, lines: list[str]) -> np.ndarray:
        """True for lines with a sentence that is a message."""
        units = sentences.split_list(lines)
        flat = [u for us in units for u in us]
        owner = np.repeat(np.arange(len(units)), [len(us) for us in units])
        out = np.zeros(len(lines), bool)
        if flat:
            out[owner[self.score(flat) > MESSAGE_SCORE]] = True
        return out


@functools.lru_cache(1)
def default_evidence() -> Evidence:
    """The classifier without reference texts."""
    return Evidence()


def bodies_parts(bodies: list[str | None], evidence: Evidence | None = None) -> list[tuple[list[str], list[str]]]:
    """Lines of each body that show evidence, and the others."""
    lines = [[SPACE.sub(" ", b.text.strip()) for b in blocks.blocks(html, literal=False)] for html in bodies]
    flat = [s for ls in lines for s in ls]
    shown = (evidence or default_evidence()).shows(flat)
    out, at = [], 0
    for ls in lines:
        parts: tuple[list[str], list[str]] = [], []
        for s in ls:
            parts[not (shown[at] or placeholder(s) or filler(s))].append(s)
            at += 1
        out.append(parts)
    return out


def body_lines(html: str | None) -> list[str]:
    """Lines of a body that show evidence."""
    return bodies_parts([html])[0][0]


def normal_line(s: str, evidence: bool = True) -> str:
    s = SPACE.sub(" ", s.strip().lower())
    return DIGIT.sub("0", s) if evidence else s


def line_hash(s: str, evidence: bool = True) -> int:
    return int.from_bytes(hashlib.blake2b(normal_line(s, evidence).encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


def lines_of(articles, evidence: Evidence):
    """page_id, site, title (shows evidence), shown and others (hashes of body lines with and without evidence), one row a page."""
    from pyspark.sql import functions as F

    def run(pdfs):
        for pdf in (piece for whole in pdfs for piece in C.frames(whole, "clean_html")):
            rows = []
            for p, site, title, parts in zip(pdf["page_id"], pdf["site"], pdf["title"], bodies_parts(pdf["clean_html"].tolist(), evidence)):
                shown, others = ({line_hash(s, e) for s in part} for part, e in zip(parts, (True, False)))
                rows.append((p, site, title_evidence(title), sorted(shown), sorted(others - shown)))
            yield pd.DataFrame(rows, columns=["page_id", "site", "title", "shown", "others"])

    a = articles.select(F.col("page_id").cast("long"), F.coalesce("site", F.lit("")).alias("site"), "title", "clean_html")
    found = a.mapInPandas(run, "page_id long, site string, title boolean, shown array<long>, others array<long>")
    # deliveries of a page are one page; their lines are put together
    one = found.groupBy("page_id").agg(F.min("site").alias("site"), F.max("title").alias("title"), F.array_distinct(F.flatten(F.collect_set("shown"))).alias("shown"), F.array_distinct(F.flatten(F.collect_set("others"))).alias("others"))
    return cut(one)


def recurrent(lines, share: float = RECURRENT_SHARE):
    """(site, h) of lines that stand on at least ``share`` of the other pages of a host, for every page that has them."""
    from pyspark.sql import functions as F

    pages = lines.groupBy("site").agg(F.count("*").alias("pages"))
    often = lines.select("site", F.explode(F.array_union("shown", "others")).alias("h")).groupBy("site", "h").agg(F.count("*").alias("n")).where("n > 1")
    return often.join(pages, "site").where(F.col("n") - 1 >= share * (F.col("pages") - 1)).select("site", "h")


def residue(articles, samples=None, share: float = RECURRENT_SHARE, fit_rows: int = FIT_ROWS):
    """(page_id, field_name) of titles and bodies with evidence in what is left without the host's boilerplate.

    articles: page_id, site, title, clean_html; samples: text, reference texts of the
    languages to expect; other columns are ignored.
    """
    from pyspark.sql import functions as F

    texts = [r.text for r in samples.where("text IS NOT NULL").select("text").orderBy(F.xxhash64("text")).limit(fit_rows).collect()] if samples is not None else []
    lines = lines_of(articles, Evidence(texts) if texts else default_evidence())
    often = cut(recurrent(lines, share))
    bodies = lines.where(F.size("shown") > 0)
    both = F.array(F.struct(F.lit(True).alias("shown"), F.col("shown").alias("hs")), F.struct(F.lit(False).alias("shown"), F.col("others").alias("hs")))
    each = bodies.select("page_id", "site", F.explode(both).alias("x")).select("page_id", "site", "x.shown", F.explode("x.hs").alias("h"))
    left = each.join(often, ["site", "h"], "left_anti")  # the residual
    own = left.groupBy("page_id").agg(F.count_if("shown").alias("evidence"), F.count_if(~F.col("shown")).alias("own"))
    judged = bodies.select("page_id", F.size("shown").alias("all")).join(own, "page_id", "left")
    in_place = F.coalesce("own", F.lit(0)) < F.col("all")  # messages for the most part
    found = judged.where((F.coalesce("evidence", F.lit(0)) > 0) | in_place).select("page_id", F.lit("clean_html").alias("field_name"))
    return lines.where("title").select("page_id", F.lit("title").alias("field_name")).unionByName(found)

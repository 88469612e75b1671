"""Problem 2: blocks of a page that belong to the site, not to the article.

1. The standard-library parser's events are streamed once.  A line of the page is
   a block (an element other than an inline one with text of its own); it keeps
   its text length, the text inside links, the tags it took, and the chain of
   containers it stands in.
2. Text-to-tag ratios of the lines are smoothed with a Gaussian and divided into
   content and other lines by a two-means threshold.
3. The content region is the lowest container that holds the bulk of the content
   lines' text, lines beside a heading of the first order weighing more; it is pulled
   up to where that heading is inside.  The outer element of a fragment, which is an
   article already, weighs as much.
4. Lines outside the region go.  Inside it, lines of nested containers go when
   their container is a site's box: by its tag or class words, or because it is a
   wrapper that is not part of the article's flow (it does not carry the bulk of the
   region's content; if the article itself is divided into wrappers, less than half
   of its text is content by density).  Single lines go when they are trails,
   labelled links or mostly links.

A page whose region holds no content line at all keeps what stands in the
article's place: the first container that is no site's box.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import numpy as np
import pandas as pd

from ..functions.htmltree import CLOSES_LIKE, CLOSES_P, HEAD_TAGS, P_SCOPE, VOID
from .blocks import INLINE, SILENT

SIGMA = 1.0
BULK = 0.6  # share of the content lines' text that a region must hold
DIVIDED = 0.1  # an article with so small a share of its text outside nested containers is made of them
HEADLINE = 8  # how much more content beside the headline weighs
# Containers by tag, and words of classes and ids, that belong to a site.
SITE_TAGS = frozenset("nav aside footer form menu dialog".split())
SITE_WORDS = re.compile(
    r"(?:^|[\W_])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|share|sharing|social|related|teaser\w*|more|newsletter|subscri\w*|signup|cookies?|ck|consent|gdpr|privacy|comments?|disqus|replies|side-?bar|menu\w*|nav\w*|crumbs?|breadcrumbs?|foot\w*|legal|copyright|layout|login|popup|modal|recommend\w*|outbrain|taboola|widget|trending|most-?read|tags?|pager|pagination)(?:$|[\W_\d])",
    re.IGNORECASE,
)
FLOW = frozenset("p h1 h2 h3 h4 h5 h6 figure figcaption blockquote ul ol li dl dt dd table tr td th tbody thead caption pre".split())
WRAPPERS = frozenset("div section article main header center body html".split())
TRAIL = re.compile(r"\s[›»>/→]\s")
COPYRIGHT = re.compile(r"^\s*(?:©|\(c\)|copyright\b)", re.IGNORECASE)


class Lines(HTMLParser):
    """Streams a page's events into lines; keeps only open elements and the containers passed."""

    def __init__(self, fragment: bool):
        super().__init__(convert_charrefs=True)
        self.fragment = fragment
        self.count = 0
        self.stack: list[tuple[str, int, int, int]] = []  # tag, ordinal, owner, link depth
        self.tag: dict[int, str] = {}
        self.attr: dict[int, str] = {}
        self.up: dict[int, int] = {}
        self.text: dict[int, list[str]] = {}
        self.link: dict[int, int] = {}
        self.tags: dict[int, int] = {}
        self.labelled: dict[int, bool] = {}
        self.silent = 0
        self.in_head = self.in_body = False
        self.open_p = 0

    def _open(self, tag: str, attrs) -> None:
        i = self.count
        self.count += 1
        top = self.stack[-1] if self.stack else None
        if tag in INLINE or tag in SILENT:
            owner = top[2] if top else i
            if owner in self.tags:
                self.tags[owner] += 1
        else:
            owner = i
            self.tag[i] = tag
            self.up[i] = top[2] if top else -1
            self.tags[i] = 1
            a = dict(attrs)
            self.attr[i] = " ".join(filter(None, (a.get("class"), a.get("id"), a.get("role"))))
        if tag in VOID:
            return
        if tag in SILENT:
            self.silent += 1
        if tag == "p":
            self.open_p += 1
        self.stack.append((tag, i, owner, (top[3] if top and tag in INLINE else 0) + (tag == "a")))

    def _pop_to(self, depth: int) -> None:
        while len(self.stack) > depth:
            tag = self.stack.pop()[0]
            if tag in SILENT:
                self.silent -= 1
            elif tag == "p":
                self.open_p -= 1

    def _close(self, tags, stops) -> None:
        for d in range(len(self.stack) - 1, -1, -1):
            t = self.stack[d][0]
            if t in tags:
                self._pop_to(d)
                return
            if t in stops:
                return

    def _frame(self, tag: str) -> None:
        if self.fragment or self.in_body:
            return
        if not self.count:
            if tag == "html":
                return
            self._open("html", ())
        if tag in ("html", "head"):
            return
        if tag in HEAD_TAGS:
            if not self.in_head:
                self._open("head", ())
                self.in_head = True
            return
        if self.in_head:
            self._close({"head"}, ())
        if tag != "body":
            self._open("body", ())
            self.in_body = True

    def handle_starttag(self, tag, attrs):
        if not self.fragment:
            if tag in ("html", "head", "body") and (tag in self.tag.values()):
                return
            self._frame(tag)
            self.in_head |= tag == "head"
            self.in_body |= tag == "body"
        if self.open_p and tag in CLOSES_P:
            self._close({"p"}, P_SCOPE)
        if tag in CLOSES_LIKE:
            self._close(*CLOSES_LIKE[tag])
        self._open(tag, attrs)

    handle_startendtag = handle_starttag

    def handle_endtag(self, tag):
        if tag in VOID or (tag in ("html", "body") and not self.fragment):
            return
        for d in range(len(self.stack) - 1, -1, -1):
            t = self.stack[d][0]
            if t == tag:
                self._pop_to(d)
                return
            if t == "table":
                return

    def handle_data(self, data):
        if self.silent:
            return
        if not self.fragment and not self.in_body:
            if not self.stack or self.stack[-1][0] in ("html", "head"):
                if not data.strip():
                    return
                self._frame("")
        if not self.stack:
            return
        tag, _, owner, link = self.stack[-1]
        self.text.setdefault(owner, []).append(data)
        if link:
            self.link[owner] = self.link.get(owner, 0) + len(data.strip())
        elif tag in ("strong", "b") and data.rstrip().endswith(":") and not "".join(self.text[owner][:-1]).strip():
            self.labelled[owner] = True


def smooth(x: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian smoothing over neighbouring lines, with the ends mirrored."""
    if len(x) < 2:
        return x.astype(float)
    r = max(1, int(np.ceil(2 * sigma)))
    k = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    return np.convolve(np.pad(x.astype(float), r, mode="reflect" if len(x) > r else "edge"), k / k.sum(), "valid")


def threshold(x: np.ndarray) -> float:
    """The border between two clusters of smoothed ratios (two-means on the logarithm)."""
    v = np.log1p(x)
    lo, hi = float(v.min()), float(v.max())
    for _ in range(20):
        cut = (lo + hi) / 2
        a, b = v[v <= cut], v[v > cut]
        if not len(a) or not len(b):
            break
        lo, hi = float(a.mean()), float(b.mean())
    return float(np.expm1((lo + hi) / 2))


def unwanted(html: str, fragment: bool) -> list[int]:
    """Ordinals of the blocks that must go."""
    s = Lines(fragment)
    s.feed(html)
    s.close()
    head = {i for i, t in s.tag.items() if t == "head"}
    body = next((i for i, t in s.tag.items() if t == "body"), -1) if not fragment else (0 if s.count else -1)
    if body < 0:
        return []
    text = {i: "".join(p) for i, p in s.text.items()}
    nos = [i for i in sorted(text) if text[i].strip() and i in s.tag and not _within(s, i, head) and (i != body or fragment)]
    nos = [i for i in nos if i != body and (i > body or fragment)]
    if not nos:
        return []
    length = np.array([len(text[i].strip()) for i in nos], float)
    link = np.array([s.link.get(i, 0) for i in nos], float)
    ratio = smooth((length - link) / np.array([max(1, s.tags[i]) for i in nos]))
    content = (ratio > threshold(ratio)) & (link < 0.5 * length)
    if not content.any():
        content = length - link >= (length - link).max()
    chain = {i: _chain(s, i, body) for i in nos}
    boxed = {c: _site_box(s, c) for i in nos for c in chain[i]}
    # text of content lines by container, site boxes counting nothing
    mass: dict[int, float] = {}
    own: dict[int, float] = {}  # of lines that stand in the container itself, not in a nested one
    every: dict[int, float] = {}  # of all lines
    for i, n, ok in zip(nos, length, content):
        for c in chain[i]:
            every[c] = every.get(c, 0.0) + n
        if ok and not any(boxed[c] for c in chain[i]):
            for k, c in enumerate(chain[i]):
                mass[c] = mass.get(c, 0.0) + n
            c = next((c for c in chain[i] if s.tag[c] in WRAPPERS and c != i), body)
            own[c] = own.get(c, 0.0) + n
    # the lowest container with the bulk of the content lines, those beside the headline weighing more ...
    h1 = None if fragment else next((i for i in nos if s.tag[i] == "h1" and not any(boxed[c] for c in chain[i])), None)
    beside = set(chain[h1]) if h1 is not None else set()
    region = body
    while True:
        kids = [c for c in mass if s.up[c] == region and s.tag[c] in WRAPPERS and c != region]
        weight = {c: mass[c] * (HEADLINE if c in beside else 1) for c in kids}
        best = max(kids, key=lambda c: weight[c], default=None)
        here = own.get(region, 0.0) * (HEADLINE if fragment and region == body else 1)  # a fragment's outer element is the article's
        if best is None or weight[best] < BULK * (here + sum(weight.values())):
            break
        region = best
    # ... that holds the headline as well
    while h1 is not None and region != body and region not in beside:
        region = s.up[region]
    if h1 is None and region == body and not mass and not fragment:
        first = next((i for i in nos if not any(boxed[c] for c in chain[i])), None)
        if first is not None:
            tops = [c for c in chain[first] if s.up[c] == body and s.tag[c] in WRAPPERS]
            region = tops[0] if tops else body
    divided = own.get(region, 0.0) < DIVIDED * mass.get(region, 0.0)  # the article itself stands in nested containers
    out = []
    for i, n, a in zip(nos, length, link):
        inside = region == body or region in chain[i] or i == region
        path = chain[i][: chain[i].index(region)] if region in chain[i] else chain[i]
        nested = [c for c in path if s.tag[c] in WRAPPERS or s.tag[c] in SITE_TAGS or _site_box(s, c)]
        gone = not inside or any(boxed[c] for c in path) or _site_box(s, i) or (s.tag[i] in WRAPPERS and i != region and i != body)
        gone = gone or any(_foreign(s, c, region, mass, every if divided else None) for c in nested if c != region and not (h1 is not None and c in chain[h1]))
        gone = gone or _odd_line(s, i, text[i], n, a)
        if gone:
            out.append(i)
    return out


def _within(s: Lines, i: int, those: set[int]) -> bool:
    while i >= 0:
        if i in those:
            return True
        i = s.up[i]
    return False


def _chain(s: Lines, i: int, body: int) -> list[int]:
    """Containers of a block from the inside out, up to and with the body, and the block itself if it is one."""
    out = [i] if s.tag[i] not in FLOW else []
    i = s.up[i]
    while i >= 0:
        out.append(i)
        if i == body:
            break
        i = s.up[i]
    return out


def _site_box(s: Lines, c: int) -> bool:
    if s.tag[c] in ("html", "body", "main", "article"):
        return False
    return s.tag[c] in SITE_TAGS or bool(s.attr[c] and s.attr[c] != "content" and SITE_WORDS.search(s.attr[c]))


def _foreign(s: Lines, c: int, region: int, mass: dict[int, float], every: dict[int, float] | None) -> bool:
    """A nested wrapper that is no part of the article.

    Where the article's lines stand in the region itself, that is a wrapper that does
    not carry the bulk of the region; where they stand in nested wrappers
    (``every`` is given), one of whose text less than half is content by density.
    """
    if s.tag[c] not in WRAPPERS:
        return False
    if every is None:
        return mass.get(c, 0.0) < BULK * max(mass.get(region, 0.0), 1.0)
    return mass.get(c, 0.0) < 0.5 * every.get(c, 0.0)


def _odd_line(s: Lines, i: int, text: str, n: float, link: float) -> bool:
    """Trails, labelled links, lines made of links, copyright lines."""
    t = text.strip()
    if s.tag[i] in ("h1", "figcaption"):
        return False
    if link >= 0.5 * n and (s.labelled.get(i) or n > 0 and link >= 0.8 * n):
        return True
    if len(TRAIL.findall(t)) >= 2 and len(t) < 300 and not re.search(r"[.!?。！？]\s", t):
        return True
    return bool(COPYRIGHT.match(t))


def unwanted_blocks(pages, articles):
    """(page_id, field_name, block_no) of the blocks that must go.

    pages: page_id, html; articles: page_id, clean_html; other columns are
    ignored.  Null and empty markup gives nothing; repeated rows count once.
    """
    from pyspark.sql import functions as F

    def one(df, column):
        return df.where(F.col(column).isNotNull()).select(F.col("page_id").cast("long"), F.lit(column).alias("field_name"), F.col(column).alias("markup"))

    both = one(pages, "html").unionByName(one(articles, "clean_html"))

    def run(pdfs):
        for pdf in pdfs:
            ids, names, nos = [], [], []
            for p, f, m in zip(pdf["page_id"], pdf["field_name"], pdf["markup"]):
                got = unwanted(m, f == "clean_html")
                ids += [p] * len(got)
                names += [f] * len(got)
                nos += got
            if ids:
                yield pd.DataFrame({"page_id": ids, "field_name": names, "block_no": nos})

    return both.mapInPandas(run, "page_id long, field_name string, block_no int").distinct()

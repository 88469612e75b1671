"""The article of one page, computed on intervals.

A page is a list of elements in preorder and a list of text tokens in document
order.  An element covers a contiguous range of each, so text content, link
density and dropping a subtree are range operations; nothing is moved.  Dropping
keeps an element's tail (the token after its range), stripping does not.

A loose piece of text directly inside a ``div`` counts as a paragraph of its own
(a virtual one, named by its token).
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from html import escape

from ..functions import lexicons as X
from ..functions.htmltree import VOID, parse

SPACES = re.compile(r"\s*\n\s*")
BLANKS = re.compile(r"[ \t]{2,}")
UNLIKELY, MAYBE = re.compile(X.UNLIKELY, re.I), re.compile(X.MAYBE, re.I)
POSITIVE, NEGATIVE = re.compile(X.POSITIVE, re.I), re.compile(X.NEGATIVE, re.I)
USELESS = re.compile(X.USELESS_CLASS)
SENTENCE_STOP = re.compile(r"\.( |$)")
BASE = {t: s for s, tags in X.TAG_SCORES.items() for t in tags}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}


def clean(text: str) -> str:
    return BLANKS.sub(" ", SPACES.sub("\n", text)).strip()


class PageTree:
    def __init__(self, html: str, positive: str | None = None, negative: str | None = None, least: int = 25):
        t = parse(html)
        self.tag, self.attrs, self.parent, self.end = t.tag, t.attrs, t.parent, t.end
        n = len(self.tag)
        self.positive = re.compile(positive) if positive else None
        self.negative = re.compile(negative) if negative else None
        self.least = least
        self.text: list[str] = []
        self.owner: list[int] = []  # element a token stands directly in
        self.lo, self.hi = [0] * n, [0] * n
        self.tail_token = [-1] * n
        closing: list[int] = []
        for i in range(n):
            while closing and self.end[closing[-1]] < i:
                self._shut(closing.pop(), t)
            self.lo[i] = len(self.text)
            closing.append(i)
            if t.text[i]:
                self.text.append("".join(t.text[i]))
                self.owner.append(i)
        while closing:
            self._shut(closing.pop(), t)
        self.live = [True] * n
        self.live_token = [True] * len(self.text)
        self.kids: list[list[int]] = [[] for _ in range(n)]  # child elements in order
        self.own: list[list[int]] = [[] for _ in range(n)]  # tokens that stand directly in an element
        self.of_tag: dict[str, list[int]] = {}
        for i in range(n):
            if self.parent[i] >= 0:
                self.kids[self.parent[i]].append(i)
            self.of_tag.setdefault(self.tag[i], []).append(i)
        for k, i in enumerate(self.owner):
            self.own[i].append(k)
        self.virtual: set[int] = set()
        self.loose: list[int] = []
        self.canonical = next((a.get("href") for g, a in zip(self.tag, self.attrs) if g == "link" and " ".join(a.get("rel", "").split()) == "canonical" and a.get("href")), None)
        title = next(iter(self.of_tag.get("title", ())), None)
        base = next((i for i in self.of_tag.get("base", ()) if self.attrs[i].get("href")), None)
        self.base = self.attrs[base]["href"].strip() if base is not None else None
        self.title = "".join(self.text[self.lo[title] : self.hi[title]]) if title is not None else None
        self.error: str | None = None if "head" in self.tag else "no head element"

    def _shut(self, i: int, t) -> None:
        self.hi[i] = len(self.text)
        if t.tail[i] and self.parent[i] >= 0:
            self.tail_token[i] = len(self.text)
            self.text.append("".join(t.tail[i]))
            self.owner.append(self.parent[i])

    # ------------------------------------------------------------ ranges
    def drop(self, i: int, tail: bool = False) -> None:
        for j in range(i, self.end[i] + 1):
            self.live[j] = False
        for k in range(self.lo[i], self.hi[i]):
            self.live_token[k] = False
        if tail and self.tail_token[i] >= 0:
            self.live_token[self.tail_token[i]] = False

    def content(self, item) -> str:
        """Text content of an element, or of a virtual paragraph given as (token,)."""
        if isinstance(item, tuple):
            return self.text[item[0]]
        return "".join(self.text[k] for k in range(self.lo[item], self.hi[item]) if self.live_token[k])

    def length(self, item) -> int:
        return len(clean(self.content(item)))

    def inside(self, i: int, tag: str) -> list[int]:
        those = self.of_tag.get(tag, [])
        return [j for j in those[bisect_right(those, i) : bisect_right(those, self.end[i])] if self.live[j]]

    def density(self, item) -> float:
        if isinstance(item, tuple):
            return 0.0
        return sum(self.length(a) for a in self.inside(item, "a")) / max(self.length(item), 1)

    def children(self, i: int) -> list:
        """Live children in order: elements, and virtual paragraphs as (token,)."""
        out = [(self.lo[j], 1, j) for j in self.kids[i] if self.live[j]]
        out += [(k, 0, (k,)) for k in self.own[i] if k in self.virtual and self.live_token[k]]
        return [x[2] for x in sorted(out, key=lambda x: (x[0], x[1]))]

    def direct(self, item) -> str | None:
        """Text before the first surviving child; None if there is none."""
        if isinstance(item, tuple):
            return self.text[item[0]]
        stop = next((self.lo[j] for j in self.kids[item] if self.live[j]), self.hi[item])
        parts = []
        for k in self.own[item]:
            if k >= stop or k in self.virtual:
                break
            if self.live_token[k]:
                parts.append(self.text[k])
        return "".join(parts) if parts else None

    def ancestors(self, i: int) -> list[int]:
        out = []
        i = self.parent[i]
        while i >= 0:
            out.append(i)
            i = self.parent[i]
        return out

    # ------------------------------------------------------------ weights
    def weight(self, i: int) -> int:
        w = 0
        for f in (self.attrs[i].get("class"), self.attrs[i].get("id")):
            if f:
                w += 25 * bool(POSITIVE.match(f)) - 25 * bool(NEGATIVE.match(f)) + self._keywords(f)
        return w + self._keywords("tag-" + self.tag[i])

    def _keywords(self, s: str) -> int:
        return 25 * bool(self.positive and self.positive.match(s)) - 25 * bool(self.negative and self.negative.match(s))

    # ------------------------------------------------------------ stages
    def prune(self) -> None:
        """Scripts, styles, links; stripped elements; useless and unlikely ones; loose text."""
        for i in range(len(self.tag)):
            if self.live[i] and self.tag[i] in ("script", "style", "link"):
                self.drop(i)
        for i in range(len(self.tag)):
            if self.live[i] and self.tag[i] in X.STRIPPED:
                self.drop(i, tail=True)
        for i in range(len(self.tag)):
            if self.live[i] and USELESS.search(self.attrs[i].get("class", "")):
                if self.tag[i] == "html":
                    self.error = "the root element is useless"
                    return
                self.drop(i)
        self.scope = next((i for i in range(len(self.tag)) if self.tag[i] == "body" and self.live[i]), None)
        if self.scope is None:
            self.scope = next((i for i in range(len(self.tag)) if self.tag[i] == "article" and self.live[i]), 0 if self.tag else None)
        if self.scope is None:
            self.error = "no content"
            return
        for i in range(self.scope, self.end[self.scope] + 1):
            s = f"{self.attrs[i].get('class', '')} {self.attrs[i].get('id', '')}"
            if self.live[i] and self.tag[i] not in ("html", "body") and UNLIKELY.search(s) and not MAYBE.search(s):
                self.drop(i)
        for i in range(self.scope + 1, self.end[self.scope] + 1):
            if self.live[i] and self.tag[i] == "br" and self.tag[self.parent[i]] == "div":
                self.drop(i)
        for k, o in enumerate(self.owner):
            if self.live_token[k] and self.live[o] and self.tag[o] == "div" and o > self.scope and o <= self.end[self.scope] and self.text[k].strip():
                self.virtual.add(k)
        self.loose = sorted(self.virtual)

    def scores(self) -> dict[int, float]:
        """Candidates with their scores, in the order they were met."""
        first, last = self.scope, self.end[self.scope]
        paras = [(self.lo[i], i) for i in range(first + 1, last + 1) if self.live[i] and self.tag[i] == "p"] + [(k, (k,)) for k in self.virtual]
        order = [p for _, p in sorted(paras, key=lambda x: (x[0], not isinstance(x[1], tuple)))]
        order += [i for g in ("pre", "td") for i in range(first + 1, last + 1) if self.live[i] and self.tag[i] == g]
        score: dict[int, float] = {}
        for p in order:
            up = self.owner[p[0]] if isinstance(p, tuple) else self.parent[p]
            if up < 0:
                continue
            t = clean(self.content(p))
            if len(t) < self.least:
                continue
            gain = 2 + t.count(",") + min(len(t) / 100, 3)
            for c, g in ((up, gain), (self.parent[up], gain / 2)):
                if c >= 0:
                    score[c] = score.get(c, self.weight(c) + BASE.get(self.tag[c], 0)) + g
        return {c: s * (1 - self.density(c)) * (1 + len(self.content(c)) / 500) for c, s in score.items()}

    def assemble(self, score: dict[int, float]) -> tuple[list, int | None, bool]:
        """(items of the article, first item with text, whether a wrapper is put around them)."""
        if not score:
            return [self.scope], None, False
        best = max(score, key=lambda c: score[c])
        if self.parent[best] < 0:
            self.error = "the best candidate is the root element"
            return [], None, True
        need = max(10, 0.2 * score[best])
        items = []
        for x in self.children(self.parent[best]):
            s = None if isinstance(x, tuple) else score.get(x)
            take = x == best or (s is not None and s >= need)
            if not take and (isinstance(x, tuple) or self.tag[x] == "p"):
                d, t = self.density(x), self.direct(x) or ""
                take = (len(t) > 80 and d < 0.25) or (len(t) <= 80 and d == 0 and bool(SENTENCE_STOP.search(t)))
            if take:
                items.append(x)
        first = next((x for x in items if self.direct(x) is not None and len(clean(self.direct(x))) >= 5), None)
        return items, first, True

    def sanitise(self, items: list) -> None:
        """Drops headings, forms and containers that do not belong to an article."""
        els = [j for x in items if not isinstance(x, tuple) for j in range(x, self.end[x] + 1)]
        roots = {x for x in items if not isinstance(x, tuple)}
        for i in els:
            if self.live[i] and self.tag[i] in HEADINGS and (self.weight(i) < 0 or self.density(i) > 0.33):
                self.drop(i)
        for i in els:
            if self.live[i] and self.tag[i] in ("form", "iframe", "textarea"):
                self.drop(i)
        for g in ("table", "ul", "div"):
            for i in reversed(els):
                if not self.live[i] or self.tag[i] != g:
                    continue
                w = self.weight(i)
                if w < 0 or (self.content(i).count(",") < 10 and self._thin(i, w) and self._around(i, items if i in roots else self.children(self.parent[i])) <= 1000):
                    self.drop(i)

    def _thin(self, i: int, w: int) -> bool:
        n = {k: len(self.inside(i, k)) for k in ("p", "img", "li", "embed")}
        n["p"] += sum(1 for k in self.loose[bisect_left(self.loose, self.lo[i]) : bisect_left(self.loose, self.hi[i])] if self.live_token[k])
        inputs = sum(1 for j in self.inside(i, "input") if self.attrs[j].get("type") != "hidden")
        size, d = self.length(i), self.density(i)
        return (
            (n["p"] > 0 and n["img"] > n["p"]) or inputs > n["p"] / 3 or (w < 25 and d > 0.2) or (w >= 25 and d > 0.5)
            or (n["li"] - 100 > n["p"] and self.tag[i] != "ul") or (size < self.least and n["img"] not in (1, 2)) or (n["embed"] == 1 and size < 75) or n["embed"] > 1
        )

    def _around(self, i: int, row: list) -> int:
        """Text lengths of the nearest non-empty neighbours, summed."""
        at = row.index(i)
        after = next((n for n in map(self.length, row[at + 1 :]) if n), 0)
        before = next((n for n in map(self.length, reversed(row[:at])) if n), 0)
        return after + before

    def markup(self, items: list, wrap: bool, compat: bool) -> str:
        """Serialised items without attributes (in compat mode with those that survived there)."""
        out = ["<div>"] if wrap else []
        for x in items:
            if isinstance(x, tuple):
                if self.live_token[x[0]]:
                    out.append(f"<p>{escape(self.text[x[0]], quote=False)}</p>")
            elif self.live[x]:
                self._write(x, out, compat)
        return "".join(out + ["</div>"] if wrap else out)

    def _write(self, top: int, out: list[str], compat: bool) -> None:
        """Serialises a subtree; open elements are kept in a list, so depth has no limit."""
        todo: list = [top]
        while todo:
            x = todo.pop()
            if isinstance(x, str):
                out.append(x)
                continue
            if isinstance(x, tuple):
                t = escape(self.text[x[0]], quote=False)
                out.append(f"<p>{t}</p>" if x[0] in self.virtual else t)
                continue
            kept = "".join(f' {k}="{escape(v)}"' for k, v in self.attrs[x].items() if compat and ("-" in k or ":" in k or not v))
            out.append(f"<{self.tag[x]}{kept}>")
            if self.tag[x] not in VOID:
                todo.append(f"</{self.tag[x]}>")
            # a token before a child begins where that child does or earlier
            inner = [(self.lo[j], 0, j) for j in self.kids[x] if self.live[j]] + [(k, 1, (k,)) for k in self.own[x] if self.live_token[k]]
            todo += [y[2] for y in sorted(inner, key=lambda y: (y[0], y[1]))][::-1]

"""Tolerant HTML parsing on the event stream of the standard library.

``parse`` turns markup into parallel lists in document order (preorder).  The
repair rules are stated here because every later operator relies on them:

* void elements never stay open;
* a block start tag closes an open ``p`` and everything left open inside it;
* ``li``, ``dt``/``dd``, ``tr``, ``td``/``th`` and ``option`` close their like
  within the nearest list, table or select;
* an end tag closes up to its nearest open element, an unmatched one is ignored;
* ``html``, ``head`` and ``body`` are supplied when a whole page lacks them;
* comments and declarations hold nothing; the text around them is joined;
* the end of input closes everything.
"""

from __future__ import annotations

from html.parser import HTMLParser

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section summary table ul".split()
)
HEAD_TAGS = frozenset("title meta link style script base noscript".split())
#: start tag -> (tags it closes, tags at which the search stops)
CLOSES_LIKE = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
P_SCOPE = frozenset("table td th button body html".split())


class TreeBuilder(HTMLParser):
    """Collects elements as parallel lists; index = ordinal of the start tag."""

    def __init__(self, fragment: bool):
        super().__init__(convert_charrefs=True)
        self.fragment = fragment
        self.tag: list[str] = []
        self.attrs: list[dict[str, str]] = []
        self.parent: list[int] = []
        self.depth: list[int] = []
        self.child_idx: list[int] = []
        self.end: list[int] = []
        self.text: list[list[str]] = []
        self.tail: list[list[str]] = []
        self.children: list[int] = []
        self.last_child: list[int] = []
        self.stack: list[int] = []
        self.open_p = 0
        self.in_head = False
        self.in_body = False

    def _push(self, tag: str, attrs: dict[str, str]) -> int:
        i = len(self.tag)
        p = self.stack[-1] if self.stack else -1
        self.tag.append(tag)
        self.attrs.append(attrs)
        self.parent.append(p)
        self.depth.append(len(self.stack))
        self.end.append(i)
        self.text.append([])
        self.tail.append([])
        self.children.append(0)
        self.last_child.append(-1)
        if p >= 0:
            self.child_idx.append(self.children[p])
            self.children[p] += 1
            self.last_child[p] = i
        else:
            self.child_idx.append(0)
        self.stack.append(i)
        if tag == "p":
            self.open_p += 1
        return i

    def _pop_to(self, depth: int) -> None:
        last = len(self.tag) - 1
        while len(self.stack) > depth:
            i = self.stack.pop()
            self.end[i] = last
            if self.tag[i] == "p":
                self.open_p -= 1

    def _close(self, tags, stops) -> None:
        for d in range(len(self.stack) - 1, -1, -1):
            t = self.tag[self.stack[d]]
            if t in tags:
                self._pop_to(d)
                return
            if t in stops:
                return

    def _frame(self, tag: str) -> None:
        """Supplies html, head and body before ``tag`` ('' stands for text)."""
        if self.fragment or self.in_body:
            return
        if not self.tag:
            if tag == "html":
                return
            self._push("html", {})
        if tag in ("html", "head"):
            return
        if tag in HEAD_TAGS:
            if not self.in_head:
                self._push("head", {})
                self.in_head = True
            return
        if self.in_head:
            self._close({"head"}, ())
        if tag != "body":
            self._push("body", {})
            self.in_body = True

    def handle_starttag(self, tag, attrs):
        if not self.fragment:
            if tag in ("html", "head", "body"):
                known = self.tag.index(tag) if tag in self.tag else -1
                if known >= 0:
                    for k, v in attrs:
                        self.attrs[known].setdefault(k, v or "")
                    return
            self._frame(tag)
            if tag == "head":
                self.in_head = True
            elif tag == "body":
                self.in_body = True
        if self.open_p and tag in CLOSES_P:
            self._close({"p"}, P_SCOPE)
        like = CLOSES_LIKE.get(tag)
        if like:
            self._close(*like)
        d: dict[str, str] = {}
        for k, v in attrs:
            if k not in d:
                d[k] = v or ""
        self._push(tag, d)
        if tag in VOID:
            self._pop_to(len(self.stack) - 1)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if tag in VOID:
            return
        if tag in ("html", "body") and not self.fragment:
            return  # what follows still belongs to the body
        for d in range(len(self.stack) - 1, -1, -1):
            t = self.tag[self.stack[d]]
            if t == tag:
                self._pop_to(d)
                return
            if t == "table" and tag not in ("html", "body"):
                return

    def handle_data(self, data):
        if not self.stack:
            if self.fragment or not data.strip():
                if self.fragment and self.tag:
                    self.tail[0].append(data)
                return
            self._frame("")
        elif not self.fragment and not self.in_body and self.tag[self.stack[-1]] in ("html", "head"):
            if not data.strip():
                return
            self._frame("")
        cur = self.stack[-1]
        last = self.last_child[cur]
        (self.text[cur] if last < 0 else self.tail[last]).append(data)

    def finish(self) -> "TreeBuilder":
        self.close()
        self._pop_to(0)
        return self


def parse(html: str, fragment: bool = False) -> TreeBuilder:
    """Parses a page, or with ``fragment`` a piece of one (no implied frame)."""
    b = TreeBuilder(fragment)
    b.feed(html)
    return b.finish()


def text_content(t: TreeBuilder, i: int) -> str:
    """All text of element i and everything in it, in document order."""
    out: list[str] = []
    stack: list[int] = []
    for j in range(i, t.end[i] + 1):
        while stack and t.end[stack[-1]] < j:
            out.extend(t.tail[stack.pop()])
        out.extend(t.text[j])
        stack.append(j)
    while len(stack) > 1:
        out.extend(t.tail[stack.pop()])
    return "".join(out)

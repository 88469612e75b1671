"""Problem 4: markup shown to the reader, and its conversion to clean text.

Each body is cut into flat text blocks.  A block is described by its word count
and link density, those of its two neighbours, and how often each form of the
four markup languages occurs in it.  One decision tree a language, fitted on the
small labelled tables of markup_table, says whether the block shows its markup: the
forms tell most, the links and lengths around a block tell a trail, a menu or a list
of links from a quotation, a heading or a list.
Text inside code and pre does not count; nor do placeholders of templates.

``clean_text`` turns a body into text in which headings ("# "), list items
("- "), code (fenced) and formulas ("$...$") can still be told, whether they were
real elements or shown markup.  Null and blank bodies give no rows.
"""

from __future__ import annotations

import functools
import html as html_lib
import re

import numpy as np
import pandas as pd

from ..functions.htmltree import parse
from . import blocks
from .markup_table import LABELLED, P1, P2, P3, PAGES
from .templates import PLACEHOLDER

KINDS = {"html": "h", "markdown": "m", "wiki": "w", "latex": "l"}
# Element names whose tags show HTML.
TAGS = "a|abbr|article|aside|b|blockquote|body|br|button|center|cite|code|dd|del|div|dl|dt|em|font|footer|form|h[1-6]|head|header|hr|html|i|iframe|img|input|ins|label|li|link|main|meta|nav|ol|option|p|pre|q|s|script|section|select|small|span|strong|style|sub|sup|svg|table|tbody|td|th|thead|tr|u|ul|video"
LATEX_COMMANDS = (
    "begin|end|section|subsection|subsubsection|chapter|paragraph|emph|textbf|textit|texttt|underline|item|cite|citep|citet|ref|eqref|label|footnote|caption|includegraphics|frac|sqrt|sum|int|prod|alpha|beta|gamma|delta|epsilon|"
    "lambda|mu|pi|sigma|theta|leq|geq|neq|approx|times|cdot|ldots|dots|infty|partial|href|url|usepackage|documentclass|title|author|maketitle|newline|par|centering|mathbf|mathrm|text|left|right"
)
# One feature a form, by language.
FORMS = {
    "h": [
        rf"</?(?:{TAGS})(?:\s[^<>]*)?/?>", r"<!--.*?-->|<!--", r"&(?:[a-zA-Z]{2,8}\d?|#\d{2,6}|#x[0-9a-fA-F]{2,6});",
    ],
    "m": [
        r"(?:^|(?<=\s))#{1,6} (?=\S)", r"\*\*[^\s*][^*\n]*\*\*|(?<!\w)__[a-z\d][^_\n]*__(?!\w)", r"~~[^\s~][^~\n]*~~", r"!?\[[^\[\]\n]+\]\((?:https?:|/|\.|#)[^()\s]*\)", r"\[[^\[\]\n]+\]\[\w+\]|^\[\w+\]: \S+", r"```|(?<!`)`[^`'\n]+`(?!`)",
        r"[-*+] \[[ xX]\] ", r"\|\s?:?-{3,}:?\s?\|", r"\n={3,}\s*$|\n={3,}\s", r"^\s*> \S|\s> [^\s<>\d][^<>]*> [^\s\d]", r"^\d+\. \S[^\n]*\n\s*\d+\. ", r"(?:^|\n)[-*+] \S[^\n]*\n[-*+] (?!\[\[)", r"(?<![\w*])\*[^\s*\[][^*\n]*[^\s*]\*(?![\w*])",
    ],
    "w": [
        r"\[\[[^\[\]\n]+\]\]", r"'''?[^'\n]+'''?", r"(?:^|\s)(={2,5}) [^=\n]+ \1(?:\s|$)", r"\{\{[^{}|]+\|[^{}]*\}\}", r"\{\||\|\}|^\|-", r"__(?:NO)?(?:TOC|EDITSECTION|INDEX|FORCETOC)__", r"#REDIRECT", r"~{3,5}(?!\w)(?<!~~\w)", r"</?ref\b[^<>]*>",
        r"\[https?://\S+ [^\[\]]+\]", r"^:{2,}\S",
    ],
    "l": [
        rf"\\(?:{LATEX_COMMANDS})\b\*?", r"\$\$", r"\\[\[\]()]", r"\\[%&$#_]", r"``[^`'\n]+''", r"~\\[a-z]+", r"(?<!\$)\$[^$\n]*[\\^_=][^$\n]*\$(?!\w)",
    ],
}
COMPILED = {k: [re.compile(r, re.M | re.S if r.startswith("<!") else re.M) for r in rs] for k, rs in FORMS.items()}
LATEX_QUOTE = re.compile(r"``[^`'\n]+''")
MAYBE = re.compile(r"[<>&*_~`#|=\[\]{}\\$'^>]|^\d+\. |^- |\n- ", re.M)


def features(text: str, around: tuple[float, ...] = (0.0,) * 6) -> list[float]:
    """Word count and link density of the block before, this one and the one after, then the forms."""
    t = PLACEHOLDER.sub(" ", text)
    t = t if t.strip("[] ") != "title" else " "
    no_quotes = LATEX_QUOTE.sub(" ", t)
    out = list(around)
    for k, rs in COMPILED.items():
        for r in rs:
            s = no_quotes if k in "mw" else t
            out.append(float(min(9, len(r.findall(s)))))
    return out


class Tree:
    """A small classification tree (Gini), grown until its leaves are pure."""

    def __init__(self, x: np.ndarray, y: np.ndarray, depth: int = 20):
        self.value = bool(y.mean() > 0.5)
        self.feature = -1
        if depth == 0 or y.all() or not y.any():
            return
        best = (self._gini(y) * len(y) - 1e-9, -1, 0.0)
        for j in range(x.shape[1]):
            for cut in np.unique(x[:, j])[:-1]:
                left = x[:, j] <= cut
                g = self._gini(y[left]) * left.sum() + self._gini(y[~left]) * (~left).sum()
                if g < best[0] - 1e-12:
                    best = (g, j, float(cut))
        if best[1] < 0:
            return
        _, self.feature, self.cut = best
        left = x[:, self.feature] <= self.cut
        self.low, self.high = Tree(x[left], y[left], depth - 1), Tree(x[~left], y[~left], depth - 1)

    @staticmethod
    def _gini(y: np.ndarray) -> float:
        p = y.mean() if len(y) else 0.0
        return 2 * p * (1 - p)

    def __call__(self, row: list[float]) -> bool:
        node = self
        while node.feature >= 0:
            node = node.low if row[node.feature] <= node.cut else node.high
        return node.value


def described(page: list[tuple[str, float]]) -> list[list[float]]:
    """Features of each block of a page, given as (text, link density) in order."""
    size = [(float(len(t.split())), d) for t, d in page]
    none = (0.0, 0.0)
    return [features(t.strip(), (*(size[i - 1] if i else none), *size[i], *(size[i + 1] if i + 1 < len(size) else none))) for i, (t, _) in enumerate(page)]


def table() -> tuple[np.ndarray, list[str]]:
    """Features and kinds of all labelled blocks: those of whole pages, and single ones with and without neighbours."""
    x, y = [], []
    for page in PAGES:
        x += described([(t, d) for t, d, _ in page])
        y += [k for _, _, k in page]
    for t, k in LABELLED:
        for around in (("", ""), (P1, P2), (P3, P1)):
            page = [(around[0], 0.0), (t, 0.0), (around[1], 0.0)]
            x.append(described(page if around[0] else page[1:2])[1 if around[0] else 0])
            y.append(k)
    return np.array(x), y


@functools.lru_cache(1)
def trees() -> dict[str, Tree]:
    x, y = table()
    return {name: Tree(x, np.array([k in ks for ks in y])) for name, k in KINDS.items()}


def shown(html: str | None) -> dict[str, list[int]]:
    """Kinds of markup a body shows, with the numbers of the blocks that show them."""
    bs = blocks.blocks(html, literal=False)
    out: dict[str, list[int]] = {}
    size = [(float(b.words), b.density) for b in bs]
    none = (0.0, 0.0)
    for i, b in enumerate(bs):
        if not MAYBE.search(b.text):
            continue
        row = features(b.text.strip(), (*(size[i - 1] if i else none), *size[i], *(size[i + 1] if i + 1 < len(bs) else none)))
        for name, tree in trees().items():
            if tree(row):
                out.setdefault(name, []).append(b.no)
    return out


# ---------------------------------------------------------------- clean text
SHOWN_RULES = {
    "latex": [
        (r"\\(?:section|chapter)\*?\{([^{}]*)\}", r"\n# \1\n"), (r"\\(?:sub)+section\*?\{([^{}]*)\}", r"\n## \1\n"), (r"\\begin\{verbatim\}(.*?)\\end\{verbatim\}", r"\n```\1```\n"),
        (r"\\begin\{(?:equation|align)\*?\}(.*?)\\end\{(?:equation|align)\*?\}", r"$\1$"), (r"\\\[(.*?)\\\]", r"$\1$"), (r"\$\$(.*?)\$\$", r"$\1$"), (r"\s*\\item\s+", r"\n- "), (r"\\(?:begin|end)\{\w+\*?\}", r"\n"),
        (r"~?\\(?:cite[pt]?|ref|eqref|label)\{[^{}]*\}", ""), (r"\\footnote\{([^{}]*)\}", r" (\1)"), (r"\\(?:emph|text\w\w|underline)\{([^{}]*)\}", r"\1"), (r"``([^`']*)''", r"“\1”"), (r"\\ldots\b", "…"), (r"\\([%&$#_])", r"\1"),
    ],
    "wiki": [
        (r"(?m)(?:^|(?<=\s))(={2,5}) ([^=\n]+) \1", lambda m: "\n" + "#" * (len(m.group(1)) - 1) + " " + m.group(2) + "\n"), (r"#REDIRECT\s*", ""), (r"\[\[(?:File|Image|Category)[^\[\]]*\]\]", ""), (r"\[\[(?:[^\[\]|]*\|)?([^\[\]|]*)\]\]", r"\1"),
        (r"\[https?://\S+ ([^\[\]]+)\]", r"\1"), (r"'''?([^'\n]+)'''?", r"\1"), (r"\{\{[^{}|]+\|[^{}]*\}\}", ""), (r"\{\|[^\n]*", ""), (r"(?m)^\|\}", ""), (r"(?m)^\|-+", ""), (r"(?m)^[!|] ?", "- "), (r"<ref\b[^<>]*>(.*?)</ref>", r" (\1)"), (r"__[A-Z]+__", ""), (r"~{3,5}", ""), (r"(?m)^[:]{1,6}", ""), (r"(?m)^\* ", "- "),
    ],
    "markdown": [
        (r"(?m)^([^\n]+)\n={3,}\s*$", r"# \1"), (r"(?:^|(?<=\s))(#{1,6}) ([^\n#]+?)(?: #+)?(?=\n|$)", r"\n\1 \2\n"), (r"!\[([^\[\]]*)\]\([^()\s]*\)", r"\1"), (r"\[([^\[\]\n]+)\]\([^()\s]*\)", r"\1"), (r"(?m)^\[\w+\]: \S+", ""), (r"\[([^\[\]\n]+)\]\[\w+\]", r"\1"),
        (r"\*\*([^*\n]+)\*\*", r"\1"), (r"(?<!\w)__([^_\n]+)__(?!\w)", r"\1"), (r"~~([^~\n]+)~~", r"\1"), (r"(?<![\w*])\*([^\s*][^*\n]*)\*(?![\w*])", r"\1"), (r"[-*+] \[[ xX]\] ", "- "), (r"(?m)^[*+] ", "- "), (r"(?m)^\|[\s:|-]+\|$", ""), (r"(?m)^> ", ""),
    ],
    "html": [
        (r"<!--.*?-->", ""), (r"<h([1-6])[^<>]*>(.*?)</h\1>", lambda m: "\n" + "#" * int(m.group(1)) + " " + m.group(2) + "\n"), (r"<li[^<>]*>", "\n- "), (r"<pre[^<>]*>(.*?)</pre>", r"\n```\n\1\n```\n"), (r"<br\s*/?>|</?(?:p|div|ul|ol|tr|table)[^<>]*>", "\n"),
        (rf"</?(?:{TAGS})(?:\s[^<>]*)?/?>", ""),
    ],
}
RULES = {k: [(re.compile(p, re.S), r) for p, r in v] for k, v in SHOWN_RULES.items()}
HEADINGS = {f"h{i}": "#" * i + " " for i in range(1, 7)}


def convert(text: str, kinds) -> str:
    """A block's text with the shown markup of the given kinds resolved."""
    for k in ("html", "latex", "wiki", "markdown"):
        if k in kinds:
            for rx, to in RULES[k]:
                text = rx.sub(to, text)
            if k == "html":
                text = html_lib.unescape(text)
    return re.sub(r"[ \t]+", " ", re.sub(r"\n\s*\n+", "\n", text)).strip()


def clean_text(html: str | None) -> str | None:
    """Clean text of a body, or None without any text."""
    if not html or not html.strip():
        return None
    tree = parse(html, fragment=True)
    kinds_of: dict[int, set[str]] = {}
    for k, nos in shown(html).items():
        for n in nos:
            kinds_of.setdefault(n, set()).add(k)
    out = []
    for b in blocks.blocks(html, tree=tree):
        up, i = [], b.no
        while i >= 0:
            up.append(tree.tag[i])
            i = tree.parent[i]
        inside_pre = "pre" in up or (b.tag != "p" and any(tree.tag[j] == "pre" for j in range(b.no, tree.end[b.no] + 1)))
        if inside_pre:
            out.append("```\n" + b.text.strip("\n") + "\n```")
            continue
        s = convert(b.text, kinds_of[b.no]) if b.no in kinds_of else re.sub(r"\s+", " ", b.text).strip()
        if b.tag in HEADINGS:
            s = HEADINGS[b.tag] + s
        elif b.tag == "li":
            s = "- " + s
        elif b.tag == "blockquote" or "blockquote" in up:
            s = "> " + s
        if s:
            out.append(s)
    return "\n\n".join(out) or None


def shown_markup(articles):
    """(page_id, markup) for each kind of markup a body shows."""
    from pyspark.sql import functions as F

    a = articles.where("clean_html IS NOT NULL").select(F.col("page_id").cast("long"), "clean_html")

    def run(pdfs):
        for pdf in pdfs:
            rows = [(p, k) for p, h in zip(pdf["page_id"], pdf["clean_html"]) for k in shown(h)]
            if rows:
                yield pd.DataFrame(rows, columns=["page_id", "markup"])

    return a.mapInPandas(run, "page_id long, markup string").distinct()


def clean_bodies(articles):
    """(page_id, clean_text) of every body with text."""
    from pyspark.sql import functions as F

    a = articles.where("clean_html IS NOT NULL").select(F.col("page_id").cast("long"), "clean_html")

    def run(pdfs):
        for pdf in pdfs:
            out = pd.DataFrame({"page_id": pdf["page_id"], "clean_text": [clean_text(h) for h in pdf["clean_html"]]})
            out = out[out["clean_text"].notna()]
            if len(out):
                yield out

    return a.mapInPandas(run, "page_id long, clean_text string")

"""Flat text blocks of clean_html: the text of each element that is no inline one.

A block is an element other than an inline one that holds non-blank text directly
or through inline elements only.  Its number is the ordinal of its start tag.
"""

from __future__ import annotations

from dataclasses import dataclass

from ..functions.htmltree import TreeBuilder, parse

INLINE = frozenset("a b i u em strong span code img br small sub sup abbr cite q mark kbd s del ins".split())
SILENT = frozenset("script style".split())
LITERAL = frozenset("code pre".split())


@dataclass
class Block:
    no: int
    tag: str
    text: str  # with literal text (code, pre) left out when asked
    links: int  # characters inside links
    parent: int

    @property
    def words(self) -> int:
        return len(self.text.split())

    @property
    def density(self) -> float:
        return self.links / max(1, len(self.text))


def blocks(html: str | None, literal: bool = True, tree: TreeBuilder | None = None) -> list[Block]:
    """Blocks in document order; ``literal=False`` leaves out what code and pre hold."""
    if not html and tree is None:
        return []
    t = tree or parse(html or "", fragment=True)
    n = len(t.tag)
    text: list[list[str]] = [[] for _ in range(n)]
    links = [0] * n
    # owner: nearest element that is no inline one; flags are inherited
    owner, in_link, mute = [0] * n, [False] * n, [False] * n
    after: list[list[int]] = [[] for _ in range(n)]
    for i in range(n):
        p, tag = t.parent[i], t.tag[i]
        inline = tag in INLINE
        owner[i] = owner[p] if inline and p >= 0 else i
        in_link[i] = tag == "a" or (p >= 0 and in_link[p] and inline)
        mute[i] = tag in SILENT or (not literal and tag in LITERAL) or (p >= 0 and mute[p])
        after[t.end[i]].append(i)

    def add(i: int, parts: list[str]) -> None:
        if parts and i >= 0 and not mute[i]:
            s = "".join(parts)
            text[owner[i]].append(s)
            if in_link[i]:
                links[owner[i]] += len(s)

    for i in range(n):
        if t.tag[i] == "br" and t.parent[i] >= 0:
            add(t.parent[i], ["\n"])
        add(i, t.text[i])
        for j in sorted(after[i], reverse=True):
            if t.parent[j] >= 0:
                add(t.parent[j], t.tail[j])
    out = []
    for i in range(n):
        if owner[i] == i:
            s = "".join(text[i])
            if s.strip():
                out.append(Block(i, t.tag[i], s, links[i], t.parent[i]))
    return out

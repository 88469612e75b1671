"""What SQL users call: a table function for nodes and functions on text.

``register(spark)`` makes these available to spark.sql:

* ``html_nodes(html)``: node_id, end_id, parent_id, depth, child_idx, tag, text, tail
  of a page's elements, with LATERAL for a table of pages;
* ``page_tree(html)``: the path of every element, one line each, for looking at a page;
* ``clean_text``, ``norm_title``, ``vote_language``, ``detect_charset`` as functions.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..functions import plain, voting
from ..functions.charsets import detect
from ..functions.htmltree import parse
from .shipping import ship


def paths(html: str | None) -> list[str]:
    """Tag, id and classes of each element below those of its ancestors."""
    t = parse(html or "")
    names: list[str] = []
    for tag, attrs, up in zip(t.tag, t.attrs, t.parent):
        own = tag + (f"#{attrs['id']}" if attrs.get("id") else "") + "".join(f".{c}" for c in (attrs.get("class") or "").split())
        names.append(f"{names[up]} > {own}" if up >= 0 else own)
    return names


class HtmlNodes:
    def eval(self, html: str):
        t = parse(html or "")
        for i in range(len(t.tag)):
            yield i, t.end[i], t.parent[i] if t.parent[i] >= 0 else None, t.depth[i], t.child_idx[i], t.tag[i], "".join(t.text[i]) or None, "".join(t.tail[i]) or None


class PageTreeLines:
    def eval(self, html: str):
        for i, x in enumerate(paths(html)):
            yield i, x


def _each(fn):
    return lambda s: pd.Series([None if x is None else fn(x) for x in s], dtype=object)


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.udtf.register("html_nodes", F.udtf(HtmlNodes, returnType="node_id int, end_id int, parent_id int, depth int, child_idx int, tag string, text string, tail string"))
    spark.udtf.register("page_tree", F.udtf(PageTreeLines, returnType="node_id int, path string"))
    for name, fn in (("clean_text", plain.clean_text), ("norm_title", plain.norm_title), ("vote_language", voting.vote), ("detect_charset", lambda b: detect(bytes(b)))):
        spark.udf.register(name, F.pandas_udf(_each(fn), "string"))

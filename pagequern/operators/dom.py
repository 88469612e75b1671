"""Relational operators on the node table (interval encoding).

nodes: page_id, node_id (preorder), end_id (last descendant), parent_id, depth,
child_idx, tag, attrs, text, tail.  Every join is on page_id first, so nodes are
exchanged once by page; within a page an interval condition decides.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.htmltree import parse
from ..functions.plain import clean_text

SCHEMA = "page_id long, node_id int, end_id int, parent_id int, depth int, child_idx int, tag string, attrs map<string,string>, text string, tail string"


def _parse(batches):
    for b in batches:
        cols: list[list] = [[] for _ in range(10)]
        for page, html in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            t = parse(html)
            n = len(t.tag)
            for c, v in zip(cols, ([page] * n, range(n), t.end, [p if p >= 0 else None for p in t.parent], t.depth, t.child_idx, t.tag, [list(a.items()) for a in t.attrs], ["".join(x) or None for x in t.text], ["".join(x) or None for x in t.tail])):
                c.extend(v)
        types = [pa.int64(), *[pa.int32()] * 5, pa.string(), pa.map_(pa.string(), pa.string()), pa.string(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=[x.split()[0] for x in SCHEMA.split(", ")])


def parse_pages(pages: DataFrame) -> DataFrame:
    """The node table of pages (page_id, html); null markup has no nodes."""
    return pages.where("html IS NOT NULL AND trim(html) <> ''").select(F.col("page_id").cast("long"), "html").mapInArrow(_parse, SCHEMA)


def nodes_of(table: DataFrame, where: Column | str | None = None) -> DataFrame:
    """A node table with each node once, exchanged by page: the joins and groupings that follow keep that partitioning.

    A condition is applied before the exchange, so it reaches the scan; deliveries of a node are equal in all columns.
    """
    return (table if where is None else table.where(where)).repartition("page_id").dropDuplicates(["page_id", "node_id"])


def within(n: str, e: str, proper: bool = False) -> Column:
    """Node n lies in the subtree of e."""
    low = F.col(f"{n}.node_id") > F.col(f"{e}.node_id") if proper else F.col(f"{n}.node_id") >= F.col(f"{e}.node_id")
    return (F.col(f"{n}.page_id") == F.col(f"{e}.page_id")) & low & (F.col(f"{n}.node_id") <= F.col(f"{e}.end_id"))


def descendants(nodes: DataFrame, roots: DataFrame, proper: bool = True) -> DataFrame:
    """(root_id, node columns) of the nodes in the subtrees of roots."""
    return nodes.alias("n").join(roots.select("page_id", "node_id", "end_id").alias("e"), within("n", "e", proper)).select(F.col("e.node_id").alias("root_id"), "n.*")


MEASURES = "page_id long, node_id int, end_id int, tag string, raw int, length int, commas int, links int, content string"


def by_page(nodes: DataFrame, columns: list[str], one, schema: str) -> DataFrame:
    """one(page_id, list of column lists) -> rows, for each page with its nodes in order.

    Nodes must be partitioned by page (nodes_of); a page is as large as one document.
    """
    names = [x.split()[0] for x in schema.split(", ")]

    def pages(batches):
        held: list = []
        for b in batches:
            ids = b.column(0).to_numpy()
            cut = np.flatnonzero(np.diff(ids)) + 1
            parts = [b.slice(lo, hi - lo) for lo, hi in zip([0, *cut.tolist()], [*cut.tolist(), len(ids)])] if len(ids) else []
            for part in parts:
                if held and held[0].column(0)[0].as_py() != part.column(0)[0].as_py():
                    yield held
                    held = []
                held.append(part)
        if held:
            yield held

    def run(batches):
        out: list[tuple] = []
        for held in pages(batches):
            cols = [sum((b.column(i).to_pylist() for b in held), []) for i in range(1, held[0].num_columns)]
            out += one(held[0].column(0)[0].as_py(), cols)
            if len(out) > 20_000:
                yield pa.RecordBatch.from_pandas(pd.DataFrame(out, columns=names), preserve_index=False)
                out = []
        if out:
            yield pa.RecordBatch.from_pandas(pd.DataFrame(out, columns=names), preserve_index=False)

    ordered = nodes.select("page_id", *columns).sortWithinPartitions("page_id", "node_id")
    return ordered.mapInArrow(lambda bs: _typed(run(bs), schema), schema)


def _typed(batches, schema: str):
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string()}
    fields = pa.schema([(n, kinds[k]) for n, k in (x.split() for x in schema.split(", "))])
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(f.name).cast(f.type) for f in fields], schema=fields)


def spans(ids: list, ends: list, texts: list, tails: list) -> tuple[str, list[int], list[int]]:
    """(all text of a page, begin and end of each element's content in it).

    An element's content is contiguous: its text, its children with their tails.
    """
    parts, size, open_ = [], 0, []
    begin, end = [0] * len(ids), [0] * len(ids)

    def close(until: int) -> None:
        nonlocal size
        while open_ and ends[open_[-1]] < until:
            k = open_.pop()
            end[k] = size
            if open_ and tails[k]:  # the root's tail is in nothing
                parts.append(tails[k])
                size += len(tails[k])

    for k, i in enumerate(ids):
        close(i)
        open_.append(k)
        begin[k] = size
        if texts[k]:
            parts.append(texts[k])
            size += len(texts[k])
    close(1 << 62)
    return "".join(parts), begin, end


def measures(nodes: DataFrame, tags: list[str] | None = None, content: bool = False) -> DataFrame:
    """page_id, node_id, end_id, tag, raw and clean length, commas of the clean text, clean length of links inside (nested ones count twice).

    One pass over each page: contents are slices of the page's text.  Of the given
    tags only, if any are given; with the text itself if asked.
    """
    wanted = set(tags) if tags else None

    def one(page, cols):
        ids, ends, tag, texts, tails = cols
        whole, begin, end = spans(ids, ends, texts, tails)
        links = [0] * (len(ids) + 1)
        clean_of: dict[int, str] = {}
        for k, t in enumerate(tag):
            n = 0
            if t == "a" or wanted is None or t in wanted:
                clean_of[k] = clean_text(whole[begin[k] : end[k]])
                n = len(clean_of[k]) if t == "a" else 0
            links[k + 1] = links[k] + n
        place = {i: k for k, i in enumerate(ids)}
        rows = []
        for k, t in enumerate(tag):
            if wanted is None or t in wanted:
                c = clean_of[k]
                last = place.get(ends[k], k)
                rows.append((page, ids[k], ends[k], t, end[k] - begin[k], len(c), c.count(","), links[last + 1] - links[k + 1], whole[begin[k] : end[k]] if content else None))
        return rows

    return by_page(nodes, ["node_id", "end_id", "tag", "text", "tail"], one, MEASURES)


def text_content(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """(page_id, node_id, content): all text in each root, in document order."""
    return measures(nodes, content=True).select("page_id", "node_id", "content").join(roots.select("page_id", "node_id"), ["page_id", "node_id"], "left_semi")


def link_density(nodes: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """(page_id, node_id, length, link_length, density) of roots, or of all elements (A4); nested links count twice."""
    m = measures(nodes)
    if roots is not None:
        m = m.join(roots.select("page_id", "node_id"), ["page_id", "node_id"], "left_semi")
    return m.select("page_id", "node_id", "length", F.col("links").alias("link_length"), (F.col("links") / F.greatest(F.col("length"), F.lit(1))).alias("density"))


def drop_subtrees(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """Nodes outside the subtrees of roots."""
    return nodes.alias("n").join(roots.select("page_id", "node_id", "end_id").alias("e"), within("n", "e"), "left_anti")


def child_counts(nodes: DataFrame, roots: DataFrame, tags: list[str]) -> DataFrame:
    """(page_id, node_id, one count a tag) of descendants."""
    counted = descendants(nodes, roots).groupBy("page_id", F.col("root_id").alias("node_id")).agg(*[F.count_if(F.col("tag") == t).alias(t) for t in tags])
    out = roots.select("page_id", "node_id").join(counted, ["page_id", "node_id"], "left")
    return out.select("page_id", "node_id", *[F.coalesce(F.col(t), F.lit(0)).cast("long").alias(t) for t in tags])


def scope(nodes: DataFrame) -> DataFrame:
    """(page_id, node_id) of each page's body, else article, else article body by property."""
    rank = F.when(F.col("tag") == "body", 0).when(F.col("tag") == "article", 1).when(F.col("attrs")["itemprop"] == "articleBody", 2)
    return nodes.withColumn("r", rank).where("r IS NOT NULL").groupBy("page_id").agg(F.min_by("node_id", F.struct("r", "node_id")).alias("node_id"))


def common_ancestor(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(page_id, a, b, node_id): lowest common proper ancestor of two nodes, the root if there is none."""
    n = nodes.select("page_id", "node_id", "end_id", "depth").alias("n")
    p = pairs.select("page_id", "a", "b").alias("p")
    both = n.join(p, (F.col("n.page_id") == F.col("p.page_id")) & (F.col("n.node_id") < F.least("p.a", "p.b")) & (F.col("n.end_id") >= F.greatest("p.a", "p.b")))
    low = both.groupBy(F.col("p.page_id").alias("page_id"), "a", "b").agg(F.max_by("n.node_id", "n.depth").alias("node_id"))
    return pairs.select("page_id", "a", "b").join(low, ["page_id", "a", "b"], "left").withColumn("node_id", F.coalesce("node_id", F.lit(0)))


def sibling_lengths(lengths: DataFrame) -> DataFrame:
    """Adds the sum of the nearest non-empty neighbours' lengths.

    lengths: page_id, parent_id, child_idx, length.
    """
    from pyspark.sql import Window

    w = Window.partitionBy("page_id", "parent_id").orderBy("child_idx")
    some = F.when(F.col("length") > 0, F.col("length"))
    before = F.last(some, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    after = F.first(some, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    return lengths.withColumn("around", F.coalesce(before, F.lit(0)) + F.coalesce(after, F.lit(0)))

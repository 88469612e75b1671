"""From pages to articles: the whole pipeline as one map over pages.

Pages are independent, so the plan has no shuffle: one Arrow stage parses a page
and works on its tree, up to the title's choice; lead image, sentences and the output
document are column expressions on its rows; one Arrow UDF tells language and summary.  The same transformation runs on a stream.

Every page gives a row; what goes wrong with one is told in error_msg.
"""

from __future__ import annotations

from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import plain as P
from ..functions import summary as S
from ..functions import text as T
from ..plans.lineage import cut
from ..plans.options import ExtractOptions
from . import dom
from .pagetree import PageTree

STAGE = (
    "page_id long, url string, base string, canonical_url string, raw_title string, title_text string, body string, paragraphs array<string>, box int, box_end int, "
    "images array<struct<pos:int,src:string,srcset:string,data:array<string>,width:string,height:string>>, error_msg string"
)
COLUMNS = "page_id url base canonical_url raw_title title_text body paragraphs box box_end images error_msg".split()
TEMPLATE = (
    '<!DOCTYPE html>\n<html lang="%s">\n<head>\n<meta charset="utf-8">\n<title>%s</title>\n%s</head>\n<body>\n<article itemscope itemtype="http://schema.org/Article">\n'
    '<meta itemprop="inLanguage" content="%s">\n%s<h1 itemprop="headline">%s</h1>\n<div itemprop="articleBody">\n%s%s\n</div>\n</article>\n</body>\n</html>'
)


def _page(page_id, url, html, o: ExtractOptions, keywords) -> tuple:
    fail = (page_id, url, *[None] * 9)
    if not url:
        return (*fail, "Empty or null URL to perform")
    if html is None or not html.strip():
        return (*fail, "Document is empty")
    t = PageTree(html, *keywords, least=o.min_paragraph)
    if t.error:
        return (*fail, t.error)
    t.prune()
    if t.error:
        return (*fail, t.error)
    items, first, wrap = t.assemble(t.scores())
    if t.error:
        return (*fail, t.error)
    title = (t.title or "").strip() or None
    # title and image see the pruned page, not yet the sanitised article
    stop = None if first is None else (t.owner[first[0]] + 0.5 if isinstance(first, tuple) else first)
    start = set() if first is None else set([t.owner[first[0]], *t.ancestors(t.owner[first[0]])] if isinstance(first, tuple) else t.ancestors(first))
    last = t.end[t.scope]
    heads, images = [], []
    for i in range(t.scope, last + 1) if title and t.tag[t.scope] == "body" else ():
        if stop is not None and i >= stop:
            break
        if t.live[i]:
            d = (t.direct(i) or "").strip()
            if d and len(d) <= len(title):
                heads.append((i, d))
    for i in t.of_tag.get("img", ()):
        if t.live[i]:
            a = t.attrs[i]
            images.append({"pos": i, "src": a.get("src"), "srcset": a.get("srcset"), "data": [v for k, v in a.items() if k.startswith("data")], "width": a.get("width"), "height": a.get("height")})
    best = P.best_title(title, heads, o.title_similarity) if heads else None
    # the lowest element around the article's start and its title; the whole page without both
    box = 0
    if best and start:
        box = t.parent[best[1]]
        while box > 0 and box not in start:
            box = t.parent[box]
    box = max(box, 0)
    t.sanitise(items)
    body = t.markup(items, wrap, o.compat)
    paras = []
    for x in items:
        for y in [x] if isinstance(x, tuple) else ([x] if t.live[x] and t.tag[x] == "p" else []) + t.inside(x, "p"):
            s = t.direct(y)
            if s:
                paras.append(s)
    base = urljoin(url, t.base) if t.base else url
    return page_id, url, base, t.canonical or url, title, best[2] if best else title, body, paras, box, t.end[box] if t.end else 0, images, None


def _safe_page(page_id, url, html, o: ExtractOptions, keywords) -> tuple:
    """Whatever goes wrong with a page is told in its row."""
    try:
        return _page(page_id, url, html, o, keywords)
    except Exception as e:  # noqa: BLE001
        return (page_id, url, *[None] * 9, f"{type(e).__name__}: {e}")


def _stage(pages: DataFrame, o: ExtractOptions) -> DataFrame:
    keywords = T.compile_keywords(_plain(o.positive_keywords)), T.compile_keywords(_plain(o.negative_keywords))

    def run(pdfs):
        for pdf in pdfs:
            rows = [_safe_page(p, u, h, o, keywords) for p, u, h in zip(pdf["page_id"], pdf["url"], pdf["html"])]
            yield pd.DataFrame(rows, columns=COLUMNS)

    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInPandas(run, STAGE)


def _plain(words):
    return list(words) if isinstance(words, tuple) else words


def measured_images(images: Column, base: Column, o: ExtractOptions) -> Column:
    """url, w, h and pos of each image; both sizes are 0 where an attribute is missing."""

    def one(i: Column) -> Column:
        w, h = T.image_size(i["width"], i["height"])
        return F.struct(T.image_url(i["src"], i["srcset"], i["data"], base, o.min_srcset).alias("url"), w.alias("w"), h.alias("h"), i["pos"].alias("pos"))

    return F.transform(images, one)


def best_image(images: Column, o: ExtractOptions) -> Column:
    """URL of the largest good one of measured images, the first of equals."""
    good = F.filter(images, lambda i: i["url"].isNotNull() & T.good_image(i["url"], i["w"], i["h"], o.min_image, o.max_ratio))
    return F.array_max(F.transform(good, lambda i: F.struct((i["w"].cast("long") * i["h"]).alias("area"), (-i["pos"]).alias("first"), i["url"].alias("url"))))["url"]


def with_sizes(staged: DataFrame, sizes: DataFrame) -> DataFrame:
    """Fills in the sizes of images without both attributes from a table url, width, height.

    Only ids, URLs and numbers are exchanged besides the pages that hold such images.
    """
    each = staged.select("page_id", F.explode("images").alias("i")).where("i.url IS NOT NULL AND (i.w = 0 OR i.h = 0)").select("page_id", F.col("i.url").alias("url")).distinct()
    known = each.join(sizes.groupBy("url").agg(F.max(F.struct("width", "height")).alias("size")), "url").where("size.width IS NOT NULL AND size.height IS NOT NULL")
    of_page = known.groupBy("page_id").agg(F.map_from_entries(F.collect_list(F.struct("url", "size"))).alias("sizes"))
    x = staged.join(of_page, "page_id", "left")

    def fill(i: Column) -> Column:
        got = F.try_element_at(F.col("sizes"), i["url"])
        use = got.isNotNull() & ((i["w"] == 0) | (i["h"] == 0))
        return F.struct(i["url"].alias("url"), F.when(use, got["width"]).otherwise(i["w"]).alias("w"), F.when(use, got["height"]).otherwise(i["h"]).alias("h"), i["pos"].alias("pos"))

    return x.withColumn("images", F.transform("images", fill)).drop("sizes")


def titles_of_nodes(nodes: DataFrame, least: float = 50.0) -> DataFrame:
    """(page_id, best, similarity): the text in or below the body that is most like the page's title, else the title (K2)."""

    def one(page, cols):
        ids, tag, texts = cols
        title = next((P.strip(x) for t, x in zip(tag, texts) if t == "title" and x), None)
        body = next((i for i, t in zip(ids, tag) if t == "body"), None)
        if title is None:
            return []
        own = [(i, P.strip(x)) for i, x in zip(ids, texts) if x and body is not None and i >= body]
        got = P.best_title(title, [(i, x) for i, x in own if x and len(x) <= len(title)], least, 6)
        return [(page, got[2], got[0]) if got else (page, title, 100.0)]

    return dom.by_page(nodes, ["node_id", "tag", "text"], one, "page_id long, best string, similarity double")


def escaped(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def document(lang: Column, title: Column, description: Column, image: Column, body: Column, compat: bool = False) -> Column:
    """The output document (S10); values are escaped; an absent description or image leaves no trace."""
    lang, title = escaped(F.coalesce(lang, F.lit(""))), escaped(F.coalesce(title, F.lit("")))
    told = F.lit("%s") if compat else escaped(description)
    about = F.when(F.length(description) > 0, F.concat(F.lit('<meta name="description" content="'), told, F.lit('">\n'))).otherwise("")
    meta = F.when(image.isNotNull(), F.concat(F.lit('<meta itemprop="image" content="'), escaped(image), F.lit('">\n'))).otherwise("")
    img = F.when(image.isNotNull(), F.concat(F.lit('<img src="'), escaped(image), F.lit('">\n'))).otherwise("")
    return F.format_string(TEMPLATE, lang, title, about, lang, meta, title, img, body)


def extract_articles(pages: DataFrame, options: ExtractOptions | None = None, sizes: DataFrame | None = None) -> DataFrame:
    """page_id, url, canonical_url, title, image_url, language, clean_html, description, error_msg of pages (O1).

    pages: page_id, url, html; other columns are ignored.  A page without a title
    keeps title null and says so in error_msg; a page without text has null
    language and description.  ``sizes`` (url, width, height) holds sizes of images
    whose elements do not tell them; with ``fetch_images`` they are fetched.
    """
    o = options or ExtractOptions()
    s = _stage(pages, o)
    inside = F.filter("images", lambda i: (i["pos"] > F.col("box")) & (i["pos"] <= F.col("box_end")))
    s = s.withColumn("images", measured_images(inside, F.col("base"), o))
    if o.fetch_images and sizes is None:
        from ..sources.web import image_heads

        s = cut(s)  # the URLs are looked up, then joined
        unknown = s.select(F.explode("images").alias("i")).where("i.url IS NOT NULL AND (i.w = 0 OR i.h = 0)").select("i.url")
        sizes = image_heads(unknown, dict(o.headers))
    if sizes is not None:
        s = with_sizes(s, sizes)
    title = F.when(F.col("raw_title").isNotNull(), T.clean_entities(T.cleaned_title(F.col("title_text"))))
    s = s.withColumn("title", title).withColumn("image_url", best_image(F.col("images"), o))
    whole = F.filter(F.flatten(F.transform("paragraphs", S.sentences)), S.complete)
    s = s.withColumn("told", S.told_column(F.col("title"), S.sentences(F.array_join(whole, " ")), o.summary_sentences))
    s = s.withColumn("language", F.col("told.language")).withColumn("description", T.clean_description(F.col("told.summary")))
    s = s.withColumn("description", F.when(F.length("description") > 0, F.col("description")))
    doc = F.when(F.col("body").isNotNull(), document(F.col("language"), F.col("title"), F.col("description"), F.col("image_url"), F.col("body"), o.compat))
    told = F.coalesce("error_msg", F.when(F.col("raw_title").isNull(), F.lit("no title")))
    return s.select("page_id", "url", "canonical_url", "title", "image_url", "language", doc.alias("clean_html"), "description", told.alias("error_msg"))

"""Queries over the reference operators, each with the SQL it is checked against.

A query without SQL is one whose result SQL cannot state (parsing, lenient
decoding, the whole pipeline).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import lexicons as X
from ..functions import summary as S
from ..functions import text as T
from ..functions import voting
from ..operators import article, decoding, dom, images, scoring
from ..sources.tables import spread, table
from . import sql as Q

_queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_sql: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        _queries[fn.__name__] = fn
        if sql:
            _sql[fn.__name__] = sql
        return fn

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)


def values(spark: SparkSession, columns: str, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, columns)


def _pages(spark, d):
    return table(spark, d, "pages").select("page_id", "url", "html").distinct()


def _articles(spark, d, *columns):
    return table(spark, d, "articles").select("page_id", *columns).distinct()


def _nodes(spark, d, where=None):
    return dom.nodes_of(table(spark, d, "nodes"), where)


# ------------------------------------------------------------ sources, charsets
@query("SELECT DISTINCT page_id, url, length(html) AS html_length FROM pages")
def page_scan(spark, d):
    return table(spark, d, "pages").select("page_id", "url", F.length("html").cast("long").alias("html_length")).distinct()


@query(f"SELECT DISTINCT page_id, status, CASE WHEN status NOT IN ({', '.join(map(str, X.GOOD_STATUS))}) THEN 'HTTP error. Status: ' || status END AS error_msg FROM raw_pages")
def http_status_error(spark, d):
    return table(spark, d, "raw_pages").select("page_id", "status", T.status_error(F.col("status")).alias("error_msg")).distinct()


@query(f"SELECT name, {Q.charset_alias('name')} AS charset, count(*) AS n FROM (SELECT page_charset AS name FROM articles UNION ALL SELECT header_charset FROM raw_pages) WHERE name IS NOT NULL GROUP BY 1, 2")
def charset_alias(spark, d):
    names = table(spark, d, "articles").select(F.col("page_charset").alias("name")).unionAll(table(spark, d, "raw_pages").select("header_charset"))
    return names.where("name IS NOT NULL").groupBy("name", T.charset_alias(F.col("name")).alias("charset")).agg(F.count("*").alias("n"))


@query(
    f"""SELECT page_id, coalesce({Q.charset_alias("nullif(m1, '')")}, {Q.charset_alias("nullif(m2, '')")}) AS charset, (m1 <> '')::INT + (m2 <> '')::INT AS declared FROM (
    SELECT DISTINCT page_id, regexp_extract(html, '<meta[^>]*?[ \\t\\r\\n]charset=["'']?([^"''>;/ ]+)', 1) AS m1,
    regexp_extract(html, '<meta[^>]*?http-equiv=["'']?[cC][oO][nN][tT][eE][nN][tT]-[tT][yY][pP][eE]["'']?[^>]*?content=["''][^"''>]*?charset=([^"''>; ]+)', 1) AS m2 FROM pages WHERE html IS NOT NULL)"""
)
def page_charset(spark, d):
    p = _pages(spark, d).where("html IS NOT NULL").select("page_id", T.declared_charsets(F.col("html")).alias("c")).distinct()
    return p.select("page_id", F.try_element_at("c", F.lit(1)).alias("charset"), F.size("c").alias("declared"))


@query(
    """SELECT p.page_id, coalesce(l.href, p.url) AS canonical_url FROM (SELECT DISTINCT page_id, url FROM pages) p LEFT JOIN (
    SELECT page_id, arg_min(attrs['href'], node_id) AS href FROM nodes WHERE tag = 'link' AND trim(attrs['rel']) = 'canonical' AND attrs['href'] IS NOT NULL GROUP BY page_id) l ON p.page_id = l.page_id"""
)
def page_canonical(spark, d):
    links = table(spark, d, "nodes").where((F.col("tag") == "link") & (T.collapse(F.col("attrs")["rel"]) == "canonical") & F.col("attrs")["href"].isNotNull())
    href = links.groupBy("page_id").agg(F.min_by(F.col("attrs")["href"], "node_id").alias("href"))
    return table(spark, d, "pages").select("page_id", "url").distinct().join(href, "page_id", "left").select("page_id", F.coalesce("href", "url").alias("canonical_url"))


@query(
    f"""WITH r AS (SELECT DISTINCT page_id, url, status, header_charset, body FROM raw_pages), c AS (SELECT *, replace(replace(replace(replace(body::VARCHAR, '\\x22', '"'), '\\x27', ''''), '\\x0A', chr(10)), '\\x0D', chr(13)) AS t FROM r),
    m AS (SELECT *, nullif(regexp_extract(t, '<meta[^>]*?[ \\t\\r\\n]charset=["'']?([^"''>;/ ]+)', 1), '') AS m1, nullif(regexp_extract(t, '<meta[^>]*?http-equiv=["'']?[cC][oO][nN][tT][eE][nN][tT]-[tT][yY][pP][eE]["'']?[^>]*?content=["''][^"''>]*?charset=([^"''>; ]+)', 1), '') AS m2 FROM c)
    SELECT page_id, status, coalesce({Q.charset_alias('m1')}, {Q.charset_alias('m2')}, {Q.charset_alias("nullif(trim(header_charset), '')")}, 'detect') AS charset, octet_length(body) AS size FROM m WHERE octet_length(body) > 0"""
)
def charset_choice(spark, d):
    """The charset each received page is read in: declared, else told by the server, else to be detected."""
    raw = table(spark, d, "raw_pages").dropDuplicates(["page_id", "url", "status", "header_charset", "body"]).where("length(body) > 0")
    return raw.select("page_id", "status", F.coalesce(decoding.told_charset(), F.lit("detect")).alias("charset"), F.length("body").cast("long").alias("size"))


@query()
def decoded_pages(spark, d):
    return decoding.decode_pages(spread(table(spark, d, "raw_pages")))


@query()
def detected_charset(spark, d):
    raw = spread(table(spark, d, "raw_pages").select("page_id", "body").where("length(body) > 0"))
    return raw.select("page_id", F.pandas_udf(lambda s: s.map(lambda b: decoding.detect(bytes(b))), "string")("body").alias("charset")).distinct()


# ------------------------------------------------------------ scalar text
@query(f"SELECT doc_id, length({Q.clean('text')}) AS clean_length FROM documents WHERE text IS NOT NULL")
def text_clean_length(spark, d):
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", T.clean_length(F.col("text")).cast("long").alias("clean_length"))


@query(f"SELECT DISTINCT page_id, {Q.norm_title('title')} AS normalized FROM articles WHERE title IS NOT NULL")
def title_normalized(spark, d):
    return _articles(spark, d, "title").where("title IS NOT NULL").select("page_id", T.norm_title(F.col("title")).alias("normalized")).distinct()


@query(
    f"""SELECT page_id, kind, {Q.cleaned_title('raw')} AS cleaned FROM (SELECT DISTINCT page_id, title, kind, prefix || title || suffix AS raw FROM articles,
    (VALUES (1, '', ''), (2, '12.05.2015  ', ' |'), (3, '12-05 ', ' —'), (4, '... ', ' « »')) v(kind, prefix, suffix) WHERE title IS NOT NULL)"""
)
def title_cleaned(spark, d):
    forms = [(1, "", ""), (2, "12.05.2015  ", " |"), (3, "12-05 ", " —"), (4, "... ", " « »")]
    raw = F.array(*[F.struct(F.lit(k).alias("kind"), F.concat(F.lit(a), "title", F.lit(b)).alias("raw")) for k, a, b in forms])
    x = _articles(spark, d, "title").where("title IS NOT NULL").select("page_id", F.explode(raw).alias("x"))
    return x.select("page_id", "x.kind", T.cleaned_title(F.col("x.raw")).alias("cleaned"))


@query(f"SELECT DISTINCT page_id, md5({Q.clean_entities('clean_html')}) AS unescaped FROM articles WHERE clean_html IS NOT NULL")
def entity_clean(spark, d):
    return _articles(spark, d, "clean_html").where("clean_html IS NOT NULL").select("page_id", F.md5(T.clean_entities(F.col("clean_html"))).alias("unescaped"))


@query(f"SELECT DISTINCT page_id, {Q.collapse(Q.clean_entities(Q.replace(Q.replace('description', 'Â' + chr(160), ' '), chr(160), ' ')))} AS cleaned FROM articles WHERE description IS NOT NULL")
def description_clean(spark, d):
    return _articles(spark, d, "description").where("description IS NOT NULL").select("page_id", T.clean_description(F.col("description")).alias("cleaned")).distinct()


@query(f"SELECT DISTINCT page_id, array_to_string({Q.grams(Q.norm_title('title'))}, '|') AS grams FROM articles WHERE title IS NOT NULL")
def title_grams(spark, d):
    return _articles(spark, d, "title").where("title IS NOT NULL").select("page_id", F.array_join(T.grams(T.norm_title(F.col("title"))), "|").alias("grams")).distinct()


@query()
def title_shingles(spark, d):
    return _articles(spark, d, "title").where("title IS NOT NULL").select("page_id", T.shingles(T.norm_title(F.col("title"))).alias("shingles"))


@query(
    f"""WITH t AS (SELECT page_id, title, lead(title) OVER (ORDER BY page_id) AS other FROM (SELECT DISTINCT page_id, title FROM articles WHERE title IS NOT NULL)),
    g AS (SELECT page_id, {Q.grams(Q.norm_title('title'))} AS a, {Q.grams(Q.norm_title('other'))} AS b FROM t WHERE other IS NOT NULL)
    SELECT page_id, round(200.0 * len(list_filter(a, lambda x: list_contains(b, x))) / nullif(len(a) + len(b), 0), 6) AS similarity FROM g"""
)
def title_similarity(spark, d):
    t = _articles(spark, d, "title").where("title IS NOT NULL").withColumn("bucket", F.floor(F.col("page_id") / 100000))
    # the next title by id: within blocks of ids, so no task holds all titles; a block's last meets the next block's first
    w = Window.partitionBy("bucket").orderBy("page_id")
    firsts = t.groupBy((F.col("bucket")).alias("b")).agg(F.min_by("title", "page_id").alias("first"))
    nexts = firsts.select("b", F.lead("first").over(Window.orderBy("b")).alias("follow"))  # one row a block
    x = t.withColumn("in_block", F.lead("title").over(w)).join(F.broadcast(nexts), t["bucket"] == nexts["b"], "left")
    x = x.withColumn("other", F.coalesce("in_block", "follow")).where("other IS NOT NULL")
    sim = T.similarity(T.shingles(T.norm_title(F.col("title"))), T.shingles(T.norm_title(F.col("other"))))
    return x.select("page_id", F.round(sim, 6).alias("similarity"))


@query(
    f"""WITH n AS (SELECT DISTINCT page_id, node_id, tag, text FROM nodes),
    t AS (SELECT page_id, {Q.strip('text')} AS title FROM n WHERE tag = 'title' AND text IS NOT NULL AND length(text) > 0),
    b AS (SELECT page_id, min(node_id) AS body FROM n WHERE tag = 'body' GROUP BY 1),
    c AS (SELECT n.page_id, n.node_id, {Q.strip('n.text')} AS cand, t.title FROM n JOIN t ON n.page_id = t.page_id JOIN b ON n.page_id = b.page_id WHERE n.node_id >= b.body AND n.text IS NOT NULL),
    g AS (SELECT page_id, node_id, cand, {Q.grams(Q.norm_title('title'))} AS a, {Q.grams(Q.norm_title('cand'))} AS b FROM c WHERE length(cand) > 0 AND length(cand) <= length(title)),
    s AS (SELECT page_id, node_id, cand, round(200.0 * len(list_filter(a, lambda x: list_contains(b, x))) / nullif(len(a) + len(b), 0), 6) AS sim FROM g),
    k AS (SELECT page_id, arg_max(cand, struct_pack(s := sim, n := node_id)) AS best, max(sim) AS sim FROM s WHERE sim >= 50 GROUP BY page_id)
    SELECT t.page_id, {Q.cleaned_title('coalesce(k.best, t.title)')} AS title, coalesce(k.sim, 100.0)::DOUBLE AS similarity FROM t LEFT JOIN k ON t.page_id = k.page_id"""
)
def title_best(spark, d):
    return article.titles_of_nodes(_nodes(spark, d)).select("page_id", T.cleaned_title(F.col("best")).alias("title"), "similarity")


# ------------------------------------------------------------ weights and rules
@query(
    f"""SELECT DISTINCT page_id, node_id, {Q.vocabulary_weight("coalesce(attrs['class'], '')")} + {Q.vocabulary_weight("coalesce(attrs['id'], '')")} AS weight, {Q.tag_score('tag')} AS tag_score FROM nodes"""
)
def class_weight(spark, d):
    n = _nodes(spark, d)
    return n.select("page_id", "node_id", T.class_weight(F.col("tag"), F.col("attrs")["class"], F.col("attrs")["id"]).alias("weight"), T.tag_score(F.col("tag")).alias("tag_score"))


@query(
    f"""SELECT word, count(*) AS n, {Q.vocabulary_weight('word')} AS weight, CASE WHEN regexp_matches(word, '^(?:main|c-|tag-div)') THEN 25 ELSE 0 END - CASE WHEN regexp_matches(word, '^(?:foot|share|tag-nav)') THEN 25 ELSE 0 END AS keywords
    FROM (SELECT unnest([attrs['class'], attrs['id'], 'tag-' || tag]) AS word FROM (SELECT DISTINCT page_id, node_id, tag, attrs FROM nodes)) WHERE word <> '' GROUP BY word"""
)
def keyword_weight(spark, d):
    """Weights of all classes, ids and tags by the vocabulary and by given keywords."""
    n = _nodes(spark, d).select(F.explode(F.array(F.col("attrs")["class"], F.col("attrs")["id"], F.concat(F.lit("tag-"), "tag"))).alias("word")).where("word <> ''")
    v = n.groupBy("word").agg(F.count("*").alias("n"))
    return v.select("word", "n", T.vocabulary_weight(F.col("word")).alias("weight"), T.keyword_weight(F.col("word"), T.compile_keywords("Main,c-,tag-div"), T.compile_keywords(["Foot", "share", "tag-nav"])).alias("keywords"))


@query(
    f"""WITH n AS (SELECT DISTINCT page_id, node_id, end_id, tag, attrs FROM nodes), u AS (SELECT * FROM n WHERE {Q.unlikely("attrs['class']", "attrs['id']", 'tag')})
    SELECT n.page_id, count(*) AS kept FROM n WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.page_id = n.page_id AND n.node_id BETWEEN u.node_id AND u.end_id) GROUP BY 1"""
)
def unlikely_dropped(spark, d):
    n = _nodes(spark, d)
    roots = n.where(T.unlikely(F.col("attrs")["class"], F.col("attrs")["id"], F.col("tag")))
    return dom.drop_subtrees(n, roots).groupBy("page_id").agg(F.count("*").alias("kept"))


@query(
    f"""WITH n AS (SELECT DISTINCT page_id, node_id, end_id, tag, attrs FROM nodes), u AS (SELECT * FROM n WHERE tag IN ('script', 'style', 'link', {', '.join(repr(x) for x in X.STRIPPED)}) OR regexp_matches(coalesce(attrs['class'], ''), '{X.USELESS_CLASS}'))
    SELECT n.page_id, n.tag, count(*) AS kept FROM n WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.page_id = n.page_id AND n.node_id BETWEEN u.node_id AND u.end_id) GROUP BY 1, 2"""
)
def stripped_dropped(spark, d):
    n = _nodes(spark, d)
    roots = n.where(F.col("tag").isin("script", "style", "link", *X.STRIPPED) | F.coalesce(F.col("attrs")["class"].rlike(X.USELESS_CLASS), F.lit(False)))
    return dom.drop_subtrees(n, roots).groupBy("page_id", "tag").agg(F.count("*").alias("kept"))


@query(
    """SELECT page_id, arg_min(node_id, struct_pack(r := r, n := node_id)) AS node_id FROM (SELECT DISTINCT page_id, node_id,
    CASE WHEN tag = 'body' THEN 0 WHEN tag = 'article' THEN 1 WHEN attrs['itemprop'] = 'articleBody' THEN 2 END AS r FROM nodes) WHERE r IS NOT NULL GROUP BY page_id"""
)
def page_scope(spark, d):
    return dom.scope(_nodes(spark, d, (F.col("tag").isin("body", "article")) | (F.col("attrs")["itemprop"] == "articleBody")))


LOOSE = f"regexp_matches(coalesce(t, ''), {Q.lit('[^' + Q.WS[1:-1] + ']')})"


@query(
    f"""WITH n AS (SELECT DISTINCT page_id, node_id, parent_id, tag, text, tail FROM nodes), x AS (SELECT page_id, node_id AS div_id, text AS t FROM n WHERE tag = 'div' UNION ALL
    SELECT c.page_id, c.parent_id, c.tail FROM n c JOIN n p ON p.page_id = c.page_id AND p.node_id = c.parent_id WHERE p.tag = 'div') SELECT page_id, div_id, count(*) AS pieces FROM x WHERE {LOOSE} GROUP BY 1, 2"""
)
def loose_text(spark, d):
    """Pieces of text directly inside a div, which count as paragraphs."""
    n = _nodes(spark, d)
    divs = n.where("tag = 'div'").select("page_id", F.col("node_id").alias("div_id"), "text")
    tails = n.select("page_id", F.col("parent_id").alias("div_id"), F.col("tail").alias("t")).join(divs.select("page_id", "div_id"), ["page_id", "div_id"])
    pieces = divs.select("page_id", "div_id", F.col("text").alias("t")).unionByName(tails)
    return pieces.where(F.length(T.strip(F.col("t"))) > 0).groupBy("page_id", "div_id").agg(F.count("*").alias("pieces"))


@query("SELECT page_id, k AS name, count(*) AS n FROM (SELECT page_id, e.key AS k, e.value AS v FROM (SELECT page_id, unnest(map_entries(attrs)) AS e FROM (SELECT DISTINCT page_id, node_id, attrs FROM nodes))) WHERE k LIKE '%-%' OR k LIKE '%:%' OR v = '' GROUP BY 1, 2")
def attribute_survivors(spark, d):
    """Attributes that stay in compat mode: with a hyphen or colon in the name, or empty."""
    e = _nodes(spark, d).select("page_id", F.explode("attrs").alias("name", "v"))
    return e.where(F.col("name").contains("-") | F.col("name").contains(":") | (F.col("v") == "")).groupBy("page_id", "name").agg(F.count("*").alias("n"))


@query("SELECT page_id, tag, count(*) AS n, min(node_id) AS first_id, max(node_id) AS last_id FROM (SELECT DISTINCT page_id, node_id, tag FROM nodes) WHERE tag IN ('p', 'pre', 'td') GROUP BY 1, 2")
def tag_streams(spark, d):
    n = _nodes(spark, d, F.col("tag").isin("p", "pre", "td"))
    return n.groupBy("page_id", "tag").agg(F.count("*").alias("n"), F.min("node_id").alias("first_id"), F.max("node_id").alias("last_id"))


PARAGRAPHS = Q.content("p", "tag IN ('p', 'pre', 'td') AND parent_id IS NOT NULL")


@query(f"WITH {Q.NODES}, {PARAGRAPHS} SELECT page_id, node_id, length(c) AS cleaned_length, round({Q.paragraph_score('c')}, 6) AS score FROM (SELECT page_id, node_id, {Q.clean('content')} AS c FROM p) WHERE length(c) >= 25")
def paragraph_score(spark, d):
    return scoring.paragraphs(_nodes(spark, d)).select("page_id", "node_id", F.col("length").cast("long").alias("cleaned_length"), F.round("score", 6).alias("score"))


@query(
    f"""WITH {Q.NODES}, {Q.content('c', "true")}, {Q.content('a', "tag = 'a'")},
    l AS (SELECT e.page_id, e.node_id, sum(length({Q.clean('a.content')})) AS n FROM n e JOIN a ON a.page_id = e.page_id AND a.node_id > e.node_id AND a.node_id <= e.end_id GROUP BY 1, 2)
    SELECT c.page_id, c.node_id, length({Q.clean('c.content')}) AS length, coalesce(l.n, 0)::BIGINT AS link_length, round(coalesce(l.n, 0) / greatest(length({Q.clean('c.content')}), 1), 6) AS density
    FROM c LEFT JOIN l ON c.page_id = l.page_id AND c.node_id = l.node_id"""
)
def link_density(spark, d):
    x = dom.link_density(_nodes(spark, d))
    return x.select("page_id", "node_id", F.col("length").cast("long").alias("length"), F.col("link_length").cast("long").alias("link_length"), F.round("density", 6).alias("density"))


@query(Q.CANDIDATES + " SELECT page_id, node_id, round(score, 7) AS content_score FROM s")
def candidate_score(spark, d):
    return scoring.candidates(_nodes(spark, d)).select("page_id", "node_id", F.round("content_score", 7).alias("content_score"))


@query(Q.CANDIDATES + " SELECT page_id, node_id, round(score, 7) AS content_score FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY round(score, 6) DESC, tag_rank, first_p, grand) AS r FROM s) WHERE r = 1")
def best_candidate(spark, d):
    return scoring.best(scoring.candidates(_nodes(spark, d))).select("page_id", "node_id", F.round("content_score", 7).alias("content_score"))


@query(
    f"""WITH {Q.NODES}, {Q.content('c', "true")}, x AS (SELECT n.page_id, n.node_id, n.parent_id, n.child_idx, length({Q.clean('c.content')}) AS len FROM n JOIN c USING (page_id, node_id))
    SELECT page_id, node_id, coalesce(last_value(nullif(len, 0) IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + coalesce(first_value(nullif(len, 0) IGNORE NULLS) OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0) AS around
    FROM x WINDOW w AS (PARTITION BY page_id, parent_id ORDER BY child_idx)"""
)
def sibling_lengths(spark, d):
    n = _nodes(spark, d)
    x = dom.measures(n).select("page_id", "node_id", "length").join(n.select("page_id", "node_id", "parent_id", "child_idx"), ["page_id", "node_id"])
    return dom.sibling_lengths(x).select("page_id", "node_id", F.col("around").cast("long").alias("around"))


COUNTED = ["p", "img", "li", "a", "embed", "input"]


@query(
    f"""WITH n AS (SELECT DISTINCT page_id, node_id, end_id, tag FROM nodes) SELECT e.page_id, e.node_id, {', '.join(f"count(*) FILTER (x.tag = '{t}') AS {t}" for t in COUNTED)}
    FROM n e LEFT JOIN n x ON x.page_id = e.page_id AND x.node_id > e.node_id AND x.node_id <= e.end_id WHERE e.tag IN ('table', 'ul', 'div') GROUP BY 1, 2"""
)
def container_counts(spark, d):
    n = _nodes(spark, d)
    return dom.child_counts(n, n.where(F.col("tag").isin("table", "ul", "div")), COUNTED)


CONTAINERS = "e.tag IN ('table', 'ul', 'div')"
MEASURED = f"""{Q.NODES}, {Q.content('t', 'true')}, c AS MATERIALIZED (SELECT page_id, node_id, {Q.clean('content')} AS cleaned FROM t),
    ld AS MATERIALIZED (SELECT e.page_id, e.node_id, sum(length(c.cleaned)) AS links FROM n e JOIN n a ON a.page_id = e.page_id AND a.tag = 'a' AND a.node_id > e.node_id AND a.node_id <= e.end_id JOIN c ON c.page_id = a.page_id AND c.node_id = a.node_id GROUP BY 1, 2),
    m AS MATERIALIZED (SELECT n.*, length(c.cleaned) AS len, coalesce(ld.links, 0) / greatest(length(c.cleaned), 1) AS density,
      {Q.vocabulary_weight("coalesce(n.attrs['class'], '')")} + {Q.vocabulary_weight("coalesce(n.attrs['id'], '')")} AS weight FROM n JOIN c USING (page_id, node_id) LEFT JOIN ld USING (page_id, node_id))"""


def _weighed(n):
    """Nodes with clean length, link density and class weight."""
    m = dom.measures(n).select("page_id", "node_id", "length", (F.col("links") / F.greatest(F.col("length"), F.lit(1))).alias("density"))
    return n.withColumn("weight", T.class_weight(F.col("tag"), F.col("attrs")["class"], F.col("attrs")["id"])).join(m, ["page_id", "node_id"])


@query(
    f"""WITH {MEASURED}, k AS (SELECT e.page_id, e.node_id, count(*) FILTER (x.tag = 'p') AS p, count(*) FILTER (x.tag = 'img') AS img, count(*) FILTER (x.tag = 'li') AS li, count(*) FILTER (x.tag = 'embed') AS embed,
      count(*) FILTER (x.tag = 'input' AND coalesce(x.attrs['type'], '') <> 'hidden') AS input FROM n e LEFT JOIN n x ON x.page_id = e.page_id AND x.node_id > e.node_id AND x.node_id <= e.end_id WHERE {CONTAINERS} GROUP BY 1, 2)
    SELECT page_id, node_id, input, weight < 0 AS negative, ((p > 0 AND img > p) OR input > p / 3.0) AS by_counts, ((weight < 25 AND density > 0.2) OR (weight >= 25 AND density > 0.5)) AS by_density,
    ((p > 0 AND img > p) OR input > p / 3.0 OR (weight < 25 AND density > 0.2) OR (weight >= 25 AND density > 0.5) OR (li - 100 > p AND tag NOT IN ('ul', 'ol')) OR (len < 25 AND (img = 0 OR img > 2)) OR (embed = 1 AND len < 75) OR embed > 1) AS removed
    FROM m JOIN k USING (page_id, node_id)"""
)
def removal_rules(spark, d):
    """Reasons to remove each table, list and div (F10-F14, J3 without hidden inputs, A11)."""
    n = _nodes(spark, d)
    roots = n.where(F.col("tag").isin("table", "ul", "div"))
    counted = n.withColumn("tag", F.when((F.col("tag") == "input") & (F.coalesce(F.col("attrs")["type"], F.lit("")) == "hidden"), "hidden").otherwise(F.col("tag")))
    k = dom.child_counts(counted, roots, ["p", "img", "li", "embed", "input"])
    v = _weighed(n).join(k, ["page_id", "node_id"])
    c = F.col
    return v.select("page_id", "node_id", "input", (c("weight") < 0).alias("negative"), T.counts_rule(c("p"), c("img"), c("input")).alias("by_counts"), T.density_rule(c("weight"), c("density")).alias("by_density"), T.removal_rule(c("tag"), c("p"), c("img"), c("li"), c("embed"), c("input"), c("length"), c("weight"), c("density")).alias("removed"))


@query(
    Q.CANDIDATES + f""", b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY round(score, 6) DESC, tag_rank, first_p, grand) AS r FROM s) WHERE r = 1)
    SELECT x.page_id, x.node_id, b.node_id AS best_id, x.node_id = b.node_id OR coalesce(s.score >= greatest(10, b.score * 0.2), false) OR (x.tag = 'p' AND ((length(coalesce(x.text, '')) > 80 AND coalesce(ld.links, 0) / greatest(length(c.cleaned), 1) < 0.25)
      OR (length(coalesce(x.text, '')) <= 80 AND coalesce(ld.links, 0) = 0 AND regexp_matches(coalesce(x.text, ''), '\\.( |$)')))) AS appended
    FROM b JOIN n bn ON bn.page_id = b.page_id AND bn.node_id = b.node_id JOIN n x ON x.page_id = bn.page_id AND x.parent_id = bn.parent_id JOIN c ON c.page_id = x.page_id AND c.node_id = x.node_id
    LEFT JOIN s ON s.page_id = x.page_id AND s.node_id = x.node_id LEFT JOIN ld ON ld.page_id = x.page_id AND ld.node_id = x.node_id"""
)
def sibling_filter(spark, d):
    """Siblings of each page's best candidate and whether they join the article."""
    n = _nodes(spark, d)
    scored = scoring.candidates(n)
    best = scoring.best(scored).select("page_id", F.col("node_id").alias("best_id"), F.col("content_score").alias("best"))
    parent = best.join(n.select("page_id", F.col("node_id").alias("best_id"), "parent_id"), ["page_id", "best_id"]).where("parent_id IS NOT NULL")
    x = n.join(parent, ["page_id", "parent_id"]).join(scored.select("page_id", "node_id", F.col("content_score").alias("score")), ["page_id", "node_id"], "left")
    x = x.join(dom.link_density(n).select("page_id", "node_id", "density"), ["page_id", "node_id"])
    c = F.col
    return x.select("page_id", "node_id", "best_id", ((c("node_id") == c("best_id")) | T.appendable(c("tag"), c("score"), c("best"), c("text"), c("density"))).alias("appended"))


@query(f"WITH {MEASURED} SELECT page_id, node_id, (weight < 0 OR density > 0.33) AS dropped FROM m WHERE tag IN ('h1', 'h2', 'h3', 'h4', 'h5', 'h6')")
def heading_drop(spark, d):
    """Headings that do not belong to an article (F8)."""
    x = _weighed(_nodes(spark, d)).where(F.col("tag").isin("h1", "h2", "h3", "h4", "h5", "h6"))
    return x.select("page_id", "node_id", ((F.col("weight") < 0) | (F.col("density") > 0.33)).alias("dropped"))


@query(
    """WITH n AS (SELECT DISTINCT page_id, node_id, end_id, tag FROM nodes), u AS (SELECT * FROM n WHERE tag IN ('form', 'iframe', 'textarea'))
    SELECT n.page_id, count(*) AS kept, sum(n.node_id)::BIGINT AS places FROM n WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.page_id = n.page_id AND n.node_id BETWEEN u.node_id AND u.end_id) GROUP BY 1"""
)
def form_drop(spark, d):
    """Elements outside forms, frames and text areas."""
    n = _nodes(spark, d)
    return dom.drop_subtrees(n, n.where(F.col("tag").isin("form", "iframe", "textarea"))).groupBy("page_id").agg(F.count("*").alias("kept"), F.sum("node_id").alias("places"))


@query(
    """WITH n AS (SELECT DISTINCT page_id, node_id, parent_id, depth, tag FROM nodes), s AS (SELECT n.*, row_number() OVER (PARTITION BY page_id, tag ORDER BY node_id DESC) AS back FROM n WHERE tag IN ('table', 'ul', 'div'))
    SELECT page_id, tag, node_id, back FROM s"""
)
def reversed_streams(spark, d):
    """Containers by tag from the page's end to its beginning, the order in which they are judged (P5)."""
    n = _nodes(spark, d, F.col("tag").isin("table", "ul", "div"))
    return n.select("page_id", "tag", "node_id", F.row_number().over(Window.partitionBy("page_id", "tag").orderBy(F.desc("node_id"))).cast("long").alias("back"))


# ------------------------------------------------------------ images
# src of every image and href of every link with the URL of its page
LINKED = """(SELECT DISTINCT n.page_id, n.node_id, n.tag, coalesce(n.attrs['src'], n.attrs['href']) AS link, p.url AS base, n.attrs['width'] AS width, n.attrs['height'] AS height FROM nodes n JOIN (SELECT DISTINCT page_id, url FROM pages) p ON n.page_id = p.page_id
    WHERE (n.tag = 'img' AND n.attrs['src'] IS NOT NULL) OR (n.tag = 'a' AND n.attrs['href'] IS NOT NULL))"""
HOST, PATH = "regexp_extract(base, '^([a-z]+://[^/?#]*)', 1)", "regexp_replace(regexp_replace({0}, '^[a-z]+://[^/?#]*', ''), '[?#].*$', '')"
ABSOLUTE = f"""CASE WHEN regexp_matches(link, '^[a-zA-Z][a-zA-Z0-9+.-]*://') OR regexp_matches(link, '^(mailto|tel|javascript|data):') THEN link WHEN link LIKE '//%' THEN regexp_extract(base, '^([a-z]+:)', 1) || link WHEN link = '' THEN base
    WHEN link LIKE '?%' THEN regexp_extract(base, '^([^?#]*)', 1) || link WHEN link LIKE '#%' THEN regexp_extract(base, '^([^#]*)', 1) || link WHEN link LIKE '/%' THEN {HOST} || link
    ELSE {HOST} || regexp_replace({PATH.format("base")}, '[^/]*$', '') || CASE WHEN {PATH.format("base")} = '' THEN '/' ELSE '' END || link END"""
SIZE = "CASE WHEN try_cast(trim(width) AS INT) IS NULL OR try_cast(trim(height) AS INT) IS NULL THEN 0 ELSE try_cast(trim({0}) AS INT) END"
VALID = "(path LIKE '%.jpg' OR path LIKE '%jpeg' OR path LIKE '%png')"


def _linked(spark, d, tags):
    n = table(spark, d, "nodes").where(F.col("tag").isin(tags) & F.coalesce(F.col("attrs")["src"], F.col("attrs")["href"]).isNotNull())
    n = n.where(((F.col("tag") == "img") & F.col("attrs")["src"].isNotNull()) | ((F.col("tag") == "a") & F.col("attrs")["href"].isNotNull()))
    n = n.select("page_id", "node_id", "tag", "attrs", F.coalesce(F.col("attrs")["src"], F.col("attrs")["href"]).alias("link"))
    return dom.nodes_of(n).join(table(spark, d, "pages").select("page_id", F.col("url").alias("base")).distinct(), "page_id")


def _sizes():
    w, h = T.image_size(F.col("attrs")["width"], F.col("attrs")["height"])
    return w.alias("width"), h.alias("height")


@query(f"SELECT page_id, node_id, {ABSOLUTE} AS url FROM {LINKED}")
def absolute_links(spark, d):
    """Every link and image address, made absolute against its page."""
    return _linked(spark, d, ["img", "a"]).select("page_id", "node_id", T.absolute_url(F.col("link"), F.col("base")).alias("url"))


@query(
    f"""SELECT page_id, node_id, CASE WHEN {VALID} THEN url END AS image_url, width, height FROM (SELECT page_id, node_id, url, {PATH.format("url")} AS path, {SIZE.format('width')} AS width, {SIZE.format('height')} AS height
    FROM (SELECT *, {ABSOLUTE} AS url FROM {LINKED} WHERE tag = 'img'))"""
)
def image_src(spark, d):
    """Address and told size of every image."""
    n = _linked(spark, d, ["img"])
    url = T.image_url(F.col("attrs")["src"], F.col("attrs")["srcset"], F.array().cast("array<string>"), F.col("base"))
    return n.select("page_id", "node_id", url.alias("image_url"), *_sizes())


@query(
    """SELECT page_id, arg_max(src, struct_pack(a := w::BIGINT * h, n := -node_id)) AS image_path, max(w::BIGINT * h) AS area FROM (SELECT DISTINCT page_id, node_id, attrs['src'] AS src, try_cast(attrs['width'] AS INT) AS w, try_cast(attrs['height'] AS INT) AS h FROM nodes WHERE tag = 'img')
    WHERE w >= 580 AND h >= 250 AND greatest(w, h)::DOUBLE / least(w, h) <= 3 AND NOT regexp_matches(src, '"""
    + X.IMAGE_DENY + "') AND regexp_matches(src, '" + X.IMAGE_ALLOW + "') GROUP BY page_id"
)
def image_best(spark, d):
    n = _nodes(spark, d, "tag = 'img'")
    w, h = T.image_size(F.col("attrs")["width"], F.col("attrs")["height"])
    x = n.select("page_id", "node_id", F.col("attrs")["src"].alias("src"), w.alias("w"), h.alias("h"))
    good = x.where(T.good_image(F.col("src"), F.col("w"), F.col("h")))
    area = F.col("w").cast("long") * F.col("h")
    return good.groupBy("page_id").agg(F.max_by("src", F.struct(area.alias("a"), (-F.col("node_id")).alias("n"))).alias("image_path"), F.max(area).alias("area"))


@query(
    f"""SELECT page_id, node_id, NOT regexp_matches(path, '{X.IMAGE_DENY}') AND regexp_matches(path, '{X.IMAGE_ALLOW}') AS path_ok, {VALID} AS valid, (w = 0 OR h = 0 OR coalesce(greatest(w, h)::DOUBLE / nullif(least(w, h), 0) > 3, true)) AS banner
    FROM (SELECT page_id, node_id, {PATH.format("url")} AS path, {SIZE.format('width')} AS w, {SIZE.format('height')} AS h FROM (SELECT *, {ABSOLUTE} AS url FROM {LINKED}))"""
)
def image_filter(spark, d):
    """Filters of image addresses and sizes over all links and images."""
    x = _linked(spark, d, ["img", "a"]).select("page_id", "node_id", T.absolute_url(F.col("link"), F.col("base")).alias("url"), *_sizes())
    c = F.col
    return x.select("page_id", "node_id", T.image_path_ok(c("url")).alias("path_ok"), T.valid_image_url(c("url")).alias("valid"), T.banner(c("width"), c("height")).alias("banner"))


# a srcset made of the addresses of a page's images in order, the k-th of them k * 250 wide
@query(
    f"""WITH i AS (SELECT page_id, node_id, link, base, row_number() OVER (PARTITION BY page_id ORDER BY node_id) AS k FROM {LINKED} WHERE tag = 'img' AND NOT contains(link, ',') AND NOT contains(link, ' ')),
    u AS (SELECT page_id, k, url, k * 250 AS size, {PATH.format("url")} AS path FROM (SELECT *, {ABSOLUTE} AS url FROM i))
    SELECT page_id, count(*) AS entries, coalesce(arg_min(url, k) FILTER ({VALID} AND size >= 600), arg_min(url, k) FILTER ({VALID})) AS image_url FROM u GROUP BY page_id"""
)
def image_srcset(spark, d):
    """The choice among the entries of a srcset."""
    i = _linked(spark, d, ["img"]).where(~F.col("link").contains(",") & ~F.col("link").contains(" "))
    i = i.withColumn("k", F.row_number().over(Window.partitionBy("page_id").orderBy("node_id")))
    g = i.groupBy("page_id", "base").agg(F.count("*").alias("entries"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "link"))), lambda x: F.concat(x["link"], F.lit(" "), (x["k"] * 250).cast("string"), F.lit("w"))), ", ").alias("srcset"))
    return g.select("page_id", "entries", T.srcset_url(F.col("srcset"), F.col("base")).alias("image_url"))


@query(
    f"""SELECT page_id, node_id, CASE WHEN {VALID} THEN url ELSE coalesce(nullif(regexp_extract(regexp_extract(url, '\\?([^#]*)', 1), '((?:https?|ftp)://[^\\s&"''<>]*?\\.(?:jpe?g|png))', 1), ''), url) END AS url
    FROM (SELECT page_id, node_id, url, {PATH.format("url")} AS path FROM (SELECT page_id, node_id, CASE WHEN tag = 'img' THEN base || '?w=9&u=' || a ELSE a END AS url FROM (SELECT *, {ABSOLUTE} AS a FROM {LINKED})))"""
)
def embedded_image(spark, d):
    """Image addresses inside the query of another address, here of each page's own (C17)."""
    x = _linked(spark, d, ["img", "a"]).withColumn("a", T.absolute_url(F.col("link"), F.col("base")))
    u = F.when(F.col("tag") == "img", F.concat("base", F.lit("?w=9&u="), "a")).otherwise(F.col("a"))
    return x.select("page_id", "node_id", T.embedded_image_url(u).alias("url"))


# the heads of three formats are made of the told sizes of all images, then read
TOLD = f"(SELECT DISTINCT page_id, node_id, {SIZE.format('width')} AS w, {SIZE.format('height')} AS h FROM {LINKED} WHERE tag = 'img')"


@query(f"SELECT page_id, node_id, format, w AS width, h AS height FROM {TOLD}, (VALUES ('png'), ('gif'), ('jpeg')) f(format) WHERE w BETWEEN 1 AND 65535 AND h BETWEEN 1 AND 65535")
def image_headers(spark, d):
    """Sizes in the heads of PNG, GIF and JPEG images."""
    x = _linked(spark, d, ["img"]).select("page_id", "node_id", *_sizes()).where("width BETWEEN 1 AND 65535 AND height BETWEEN 1 AND 65535")

    def big(c, digits):
        return F.lpad(F.hex(c), digits, "0")

    def little(c):
        return F.concat(F.substring(big(c, 4), 3, 2), F.substring(big(c, 4), 1, 2))

    w, h = F.col("width"), F.col("height")
    heads = {
        "png": F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), big(w, 8), big(h, 8)), "gif": F.concat(F.lit("474946383961"), little(w), little(h)),
        "jpeg": F.concat(F.lit("FFD8FFE000104A46494600010100000100010000FFC0001108"), big(h, 4), big(w, 4), F.lit("03012200021101031101")),
    }
    e = x.select("page_id", "node_id", F.explode(F.array(*[F.struct(F.lit(k).alias("format"), F.unhex(v).alias("b")) for k, v in heads.items()])).alias("x")).select("page_id", "node_id", "x.*")
    e = e.withColumn("s", F.coalesce(T.png_size(F.col("b")), T.gif_size(F.col("b")))).withColumn("j", decoding.jpeg_column(F.col("b")))
    return e.select("page_id", "node_id", "format", *[F.coalesce(F.col(f"s.{k}"), F.col(f"j.{k}")).alias(k) for k in ("width", "height")])


# sizes of every second image count as not told; the table of sizes has the largest of the address
SIZED_SQL = f"""WITH a AS (SELECT page_id, node_id, {ABSOLUTE} AS url, {SIZE.format('width')} AS w, {SIZE.format('height')} AS h FROM {LINKED} WHERE tag = 'img'), f AS (SELECT url, max(w) AS fw, max(h) AS fh FROM a WHERE w > 0 AND node_id % 3 > 0 GROUP BY url),
    i AS (SELECT a.page_id, a.node_id AS pos, a.url, CASE WHEN w = 0 OR h = 0 OR node_id % 2 = 0 THEN coalesce(fw, -1) ELSE w END AS width, CASE WHEN w = 0 OR h = 0 OR node_id % 2 = 0 THEN coalesce(fh, -1) ELSE h END AS height FROM a LEFT JOIN f USING (url))"""


def _sized(spark, d):
    x = _linked(spark, d, ["img"]).select("page_id", F.col("node_id").alias("pos"), T.absolute_url(F.col("link"), F.col("base")).alias("url"), *_sizes())
    sizes = x.where("width > 0 AND pos % 3 > 0").groupBy("url").agg(F.max("width").alias("width"), F.max("height").alias("height"))
    return images.fill_sizes(x.withColumn("width", F.when(F.col("pos") % 2 == 0, 0).otherwise(F.col("width"))), sizes)


@query(SIZED_SQL + " SELECT page_id, pos, url || ' (' || width || ' x ' || height || ', ' || CASE WHEN width >= 580 AND height >= 250 THEN 'good' ELSE 'not good' END || ')' AS label FROM i")
def image_sizes(spark, d):
    """Sizes that elements do not tell come from a table of sizes."""
    good = (F.col("width") >= 580) & (F.col("height") >= 250)
    return _sized(spark, d).select("page_id", "pos", images.label(F.col("url"), F.col("width"), F.col("height"), good).alias("label"))


@query(
    SIZED_SQL + f""" SELECT page_id, arg_min(url, struct_pack(a := -(width::BIGINT) * height, p := pos)) AS url FROM (SELECT *, {PATH.format("url")} AS path FROM i) WHERE width >= 580 AND height >= 250 AND greatest(width, height)::DOUBLE / least(width, height) <= 3
    AND NOT regexp_matches(path, '{X.IMAGE_DENY}') AND regexp_matches(path, '{X.IMAGE_ALLOW}') GROUP BY page_id"""
)
def image_best_sized(spark, d):
    return images.best_images(_sized(spark, d))


# ------------------------------------------------------------ sentences and summaries
@query(f"SELECT page_id, i, s AS sentence FROM (SELECT page_id, unnest(ss) AS s, generate_subscripts(ss, 1) - 1 AS i FROM (SELECT DISTINCT page_id, {Q.sentences('description')} AS ss FROM articles WHERE description IS NOT NULL)) WHERE {Q.complete('s')}")
def complete_sentences(spark, d):
    a = _articles(spark, d, "description").where("description IS NOT NULL")
    x = a.select("page_id", F.posexplode(S.sentences(F.col("description"))).alias("i", "sentence"))
    return x.where(S.complete(F.col("sentence"))).select("page_id", F.col("i").cast("long").alias("i"), "sentence")


@query(f"SELECT doc_id, len({Q.sentences('text')}) AS sentences, len({Q.words('text')}) AS words FROM documents WHERE text IS NOT NULL")
def sentence_tokens(spark, d):
    t = spread(table(spark, d, "documents").select("doc_id", "text").where("text IS NOT NULL"))
    return t.select("doc_id", F.size(S.sentences(F.col("text"))).cast("long").alias("sentences"), F.size(S.words(F.col("text"))).cast("long").alias("words"))


@query(Q.EDGES + " SELECT page_id, i, j, round(w, 6) AS w FROM edges WHERE i < j")
def sentence_similarity(spark, d):
    a = _articles(spark, d, "description").where("description IS NOT NULL")
    x = a.select("page_id", F.transform(S.sentences(F.col("description")), S.words).alias("sets"))
    at = F.sequence(F.lit(0), F.greatest(F.size("sets") - 1, F.lit(0)))
    pairs = F.flatten(F.transform(at, lambda i: F.transform(at, lambda j: F.struct(i.cast("long").alias("i"), j.cast("long").alias("j"), F.round(S.overlap(F.get("sets", i), F.get("sets", j)), 6).alias("w")))))
    return x.where("size(sets) > 0").select("page_id", F.explode(F.filter(pairs, lambda e: (e["i"] < e["j"]) & (e["w"] > 0))).alias("e")).select("page_id", "e.*")


@query(Q.ranks_sql(12) + " SELECT page_id, i, round(r, 6) AS pr FROM r12")
def sentence_rank(spark, d):
    a = _articles(spark, d, "description").where("description IS NOT NULL")
    x = a.select("page_id", S.ranks(F.transform(S.sentences(F.col("description")), S.words), 12).alias("pr"))
    return x.select("page_id", F.posexplode("pr").alias("i", "pr")).where("pr IS NOT NULL").select("page_id", F.col("i").cast("long").alias("i"), F.round("pr", 6).alias("pr"))


@query(Q.ranks_sql(12) + ", k AS (SELECT page_id, i, row_number() OVER (PARTITION BY page_id ORDER BY round(r, 6) DESC, i) AS rn FROM r12) SELECT k.page_id, string_agg(s.s, ' ' ORDER BY k.i) AS summary FROM k JOIN sents s ON s.page_id = k.page_id AND s.i = k.i WHERE rn <= 2 GROUP BY 1")
def summary_topn(spark, d):
    a = _articles(spark, d, "description").where("description IS NOT NULL")
    x = a.select("page_id", S.sentences(F.col("description")).alias("s")).withColumn("pr", S.ranks(F.transform("s", S.words), 12))
    e = x.select("page_id", "s", F.posexplode("pr").alias("i", "pr")).where("pr IS NOT NULL")
    k = e.withColumn("rn", F.row_number().over(Window.partitionBy("page_id").orderBy(F.round("pr", 6).desc(), "i"))).where("rn <= 2")  # the top-k of a summary
    g = k.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("i", F.get("s", F.col("i")).alias("t")))).alias("top"))
    return g.select("page_id", F.array_join(F.transform("top", lambda t: t["t"]), " ").alias("summary"))


@query()
def document_summary(spark, d):
    t = spread(table(spark, d, "documents").select("doc_id", "text").where("text IS NOT NULL"))
    x = t.select("doc_id", F.filter(S.sentences(F.col("text")), S.complete).alias("s"), voting.language(F.col("text")).alias("lang"))
    return x.select("doc_id", "lang", S.summary_column(F.col("s"), F.col("lang"), 5).alias("summary"))


@query(Q.language_vote("description", "articles", "page_id"))
def language_vote(spark, d):
    a = _articles(spark, d, "description").where("description IS NOT NULL")
    return a.select("page_id", voting.language(F.col("description")).alias("lang"))


@query()
def stems(spark, d):
    t = table(spark, d, "lang_samples")
    return t.select("sample_id", S.stems_column(S.words(F.col("text")), F.col("lang")).alias("stems"))


# ------------------------------------------------------------ parsing and the pipeline
@query("SELECT page_id, node_id, end_id, parent_id, depth, child_idx, tag FROM (SELECT DISTINCT page_id, node_id, end_id, parent_id, depth, child_idx, tag FROM nodes) WHERE page_id IN (SELECT page_id FROM pages WHERE html IS NOT NULL)")
def dom_nodes(spark, d):
    return dom.parse_pages(spread(table(spark, d, "pages").select("page_id", "html"))).select("page_id", "node_id", "end_id", "parent_id", "depth", "child_idx", "tag").distinct()


@query(
    """WITH n AS (SELECT DISTINCT page_id, node_id, end_id, depth, tag FROM nodes), h AS (SELECT page_id, min(node_id) AS a FROM n WHERE tag = 'h1' GROUP BY 1), g AS (SELECT page_id, max(node_id) AS b FROM n WHERE tag = 'p' GROUP BY 1)
    SELECT h.page_id, h.a, g.b, coalesce(arg_max(n.node_id, n.depth), 0) AS node_id FROM h JOIN g ON h.page_id = g.page_id LEFT JOIN n ON n.page_id = h.page_id AND n.node_id < least(h.a, g.b) AND n.end_id >= greatest(h.a, g.b) GROUP BY 1, 2, 3"""
)
def image_container(spark, d):
    n = _nodes(spark, d)
    a = n.where("tag = 'h1'").groupBy("page_id").agg(F.min("node_id").alias("a"))
    b = n.where("tag = 'p'").groupBy("page_id").agg(F.max("node_id").alias("b"))
    return dom.common_ancestor(n, a.join(b, "page_id"))


def _template_sql() -> str:
    """The parts of the template joined with the SQL of its values."""
    e = {k: Q.escaped(v) for k, v in (("lang", "coalesce(language, '')"), ("title", "coalesce(title, '')"), ("told", "description"), ("image", "image_url"))}
    about = f"CASE WHEN length(description) > 0 THEN '<meta name=\"description\" content=\"' || {e['told']} || '\">' || chr(10) ELSE '' END"
    meta = f"CASE WHEN image_url IS NOT NULL THEN '<meta itemprop=\"image\" content=\"' || {e['image']} || '\">' || chr(10) ELSE '' END"
    img = f"CASE WHEN image_url IS NOT NULL THEN '<img src=\"' || {e['image']} || '\">' || chr(10) ELSE '' END"
    parts = article.TEMPLATE.split("%s")
    out = Q.lit(parts[0])
    for value, part in zip((e["lang"], e["title"], about, e["lang"], meta, e["title"], img, "clean_html"), parts[1:]):
        out += f" || {value} || {Q.lit(part)}"
    return out


@query(f"SELECT DISTINCT page_id, md5({_template_sql()}) AS document FROM articles WHERE clean_html IS NOT NULL")
def article_template(spark, d):
    """The output document of every stored article."""
    a = _articles(spark, d, "language", "title", "image_url", "description", "clean_html").where("clean_html IS NOT NULL")
    doc = article.document(*[F.col(c) for c in ("language", "title", "description", "image_url", "clean_html")])
    return a.select("page_id", F.md5(doc).alias("document")).distinct()


PARTS = f"""WITH n AS (SELECT DISTINCT page_id, node_id, tag, attrs, text FROM nodes), t AS (SELECT page_id, arg_min({Q.strip('text')}, node_id) AS title FROM n WHERE tag = 'title' GROUP BY 1),
    l AS (SELECT page_id, arg_min(attrs['href'], node_id) AS href FROM n WHERE tag = 'link' AND {Q.strip("attrs['rel']")} = 'canonical' AND attrs['href'] <> '' GROUP BY 1)"""


@query(
    PARTS + """ SELECT p.page_id, coalesce(l.href, CASE WHEN html IS NOT NULL THEN p.url END) AS canonical_url, CASE WHEN html IS NULL OR trim(html) = '' THEN 'Document is empty' WHEN nullif(t.title, '') IS NULL THEN 'no title' END AS error_msg, coalesce(t.title, '') <> '' AND html IS NOT NULL AS titled
    FROM (SELECT DISTINCT page_id, url, html FROM pages) p LEFT JOIN t USING (page_id) LEFT JOIN l USING (page_id)"""
)
def article_parts(spark, d):
    """What the pipeline tells of every page besides its content: address, error, whether it has a title."""
    a = article.extract_articles(spread(table(spark, d, "pages").select("page_id", "url", "html").distinct()))
    return a.select("page_id", "canonical_url", "error_msg", F.col("title").isNotNull().alias("titled"))


@query()
def article_extract(spark, d):
    return article.extract_articles(spread(table(spark, d, "pages").select("page_id", "url", "html"))).distinct()


@query()
def article_html(spark, d):
    return article_extract(spark, d).select("page_id", "clean_html")


@query()
def article_from_bytes(spark, d):
    raw = decoding.decode_pages(spread(table(spark, d, "raw_pages"))).where("error_msg IS NULL")
    return article.extract_articles(raw)

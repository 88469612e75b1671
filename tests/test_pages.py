"""Parsing, extraction, decoding, sources and streams on small pages."""

import http.server
import threading

import pytest
from pyspark.sql import functions as F

from pagequern.functions.htmltree import parse, text_content
from pagequern.operators import decoding, dom
from pagequern.operators.article import extract_articles
from pagequern.plans.options import ExtractOptions

LONG = "This is a sentence of the article, with commas, that goes on for a while. The town hall of the article was closed again. "
PAGE = (
    '<html><head><title>The big story of the town - News</title><link rel="canonical" href="http://a.example/c"></head><body><nav class="menu"><a href="/">Home</a></nav>'
    f'<h2>The big story of the town</h2><div id="content"><p>{LONG * 3}</p><p>{LONG * 2}</p><img src="/a.jpg" width="900" height="400"><ul><li>x</li></ul> lost tail</div><div class="sidebar"><p>{LONG}</p></div></body></html>'
)


def test_repairs():
    t = parse("<p>one<b>two<p>three<ul><li>a<li>b</ul></p><br>end")
    assert t.tag == ["html", "head", "body"] + ["p", "b", "p", "ul", "li", "li", "br"] or t.tag == ["html", "body", "p", "b", "p", "ul", "li", "li", "br"]
    assert all(t.parent[i] < i <= t.end[i] for i in range(len(t.tag)))
    f = parse("<div>a<b>c</b>d<!-- x -->e</div>", fragment=True)
    assert f.tag == ["div", "b"] and text_content(f, 0) == "acde"
    assert parse("", fragment=True).tag == []


def test_nodes_nest(spark):
    df = spark.createDataFrame([(1, PAGE), (2, None), (3, "")], "page_id long, html string")
    rows = dom.parse_pages(df).collect()
    assert {r.page_id for r in rows} == {1}
    by = {r.node_id: r for r in rows}
    for r in rows:
        if r.parent_id is not None:
            assert by[r.parent_id].node_id < r.node_id <= r.end_id <= by[r.parent_id].end_id


def test_article(spark):
    df = spark.createDataFrame([(1, "http://a.example/x", PAGE, "extra"), (2, "http://a.example/y", None, ""), (3, None, PAGE, ""), (4, "http://a.example/z", "<p>no head</p>", "")], "page_id long, url string, html string, title string")
    r = {x.page_id: x for x in extract_articles(df).collect()}
    a = r[1]
    assert a.title == "The big story of the town" and a.canonical_url == "http://a.example/c" and a.language == "en" and a.error_msg is None
    assert a.image_url == "http://a.example/a.jpg"
    assert "town hall" in a.clean_html and "Home" not in a.clean_html and "lost tail" not in a.clean_html and "<li>" not in a.clean_html
    assert a.description and "%s" not in a.clean_html
    assert r[2].error_msg == "Document is empty" and r[3].error_msg.startswith("Empty") and r[4].error_msg
    compat = extract_articles(df.where("page_id = 1"), ExtractOptions(compat=True)).first()
    assert 'content="%s"' in compat.clean_html
    with pytest.raises(ValueError):
        ExtractOptions(summary_sentences=-1)


def test_empty_table(spark):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    assert extract_articles(df).count() == 0


def test_decoding(spark):
    rows = [
        (1, "u", 200, None, '<head><meta charset="GB2312"></head>城市'.encode("gb18030")), (2, "u", 404, "utf-8", b"x"), (3, "u", 200, "x-none", b"<p>x"), (4, "u", 200, None, None), (5, "u", 200, None, "é".encode("utf-8")), (6, "u", 200, "latin-1", "é".encode("latin-1")),
    ]
    got = {r.page_id: r for r in decoding.decode_pages(spark.createDataFrame(rows, "page_id long, url string, status int, header_charset string, body binary")).collect()}
    assert got[1].charset == "gb18030" and "城市" in got[1].html
    assert got[2].error_msg == "HTTP error. Status: 404" and got[3].error_msg == "unknown encoding: x-none" and got[4].error_msg == "Document is empty"
    assert got[5].html == "é" and got[6].html == "é"


def test_text_content_and_density(spark):
    n = dom.parse_pages(spark.createDataFrame([(1, "<html><head></head><body><p>ab <a href='x'>cde</a> f<b>g</b></p></body></html>")], "page_id long, html string"))
    p = n.where("tag = 'p'")
    assert dom.text_content(n, p).first().content == "ab cde fg"
    d = dom.link_density(n, p).first()
    assert (d.length, d.link_length) == (9, 3)


def test_web_source(spark):
    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            ok = self.path == "/ok"
            self.send_response(200 if ok else 404)
            self.send_header("Content-Type", "text/html; charset=utf-8")
            self.end_headers()
            self.wfile.write(b"<p>hi</p>")

        def log_message(self, *a):
            pass

    srv = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=srv.serve_forever, daemon=True).start()
    from pagequern.sources.web import PageSource

    spark.dataSource.register(PageSource)
    base = f"http://127.0.0.1:{srv.server_port}"
    rows = {r.page_id: r for r in spark.read.format("pages").option("urls", f"{base}/ok\n{base}/no").load().collect()}
    srv.shutdown()
    assert rows[0].status == 200 and bytes(rows[0].body) == b"<p>hi</p>" and rows[0].header_charset == "utf-8"
    assert rows[1].error_msg == "HTTP error. Status: 404"


def test_stream(spark, tmp_path):
    from pagequern.sources.sinks import write_articles, write_documents
    from pagequern.streaming.articles import write_stream

    src = str(tmp_path / "in")
    pages = spark.createDataFrame([(1, "http://a.example/x", PAGE)], "page_id long, url string, html string")
    pages.write.parquet(src)
    q = write_stream(spark.readStream.schema(pages.schema).parquet(src), str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.first().title == "The big story of the town"
    write_articles(got, str(tmp_path / "a"))
    write_documents(got, str(tmp_path / "d"))
    assert spark.read.text(str(tmp_path / "d")).count() == 1 and spark.read.parquet(str(tmp_path / "a")).count() == 1


def test_page_tree_agrees_with_relational_scores(spark):
    """The per-page computation and the node-table one choose the same candidate scores on plain pages."""
    from pagequern.operators import scoring
    from pagequern.operators.pagetree import PageTree

    html = f"<html><head><title>t</title></head><body><main><p>{LONG}</p><p>{LONG * 2}</p></main></body></html>"
    t = PageTree(html)
    t.prune()
    want = {k: round(v, 6) for k, v in t.scores().items()}
    n = dom.parse_pages(spark.createDataFrame([(1, html)], "page_id long, html string"))
    got = {r.node_id: round(r.content_score, 6) for r in scoring.candidates(n).collect()}
    assert got == want
    assert scoring.best(scoring.candidates(n)).first().node_id == max(want, key=want.get)
    assert F is not None


def test_deep_and_broken_pages_give_rows(spark, monkeypatch):
    deep = f"<html><head><title>t</title></head><body><div><p>{LONG * 3}{'<span>' * 5000}deep{'</span>' * 5000}</p></div></body></html>"
    df = spark.createDataFrame([(1, "http://a.example/x", deep)], "page_id long, url string, html string")
    r = extract_articles(df).first()
    assert r.error_msg is None and r.clean_html.count("<span>") == 5000
    from pagequern.operators import article

    class Broken(str):
        def strip(self, *a):
            raise RecursionError("too deep")

    assert article._safe_page(1, "http://a.example/x", Broken("x"), ExtractOptions(), (None, None))[-1] == "RecursionError: too deep"


def test_order_of_siblings_without_text_between(spark):
    html = f"<html><head><title>t</title></head><body><div><figure><img src='/a.jpg'><figcaption>cap</figcaption></figure><p>{LONG * 3}</p><p>{LONG}</p></div></body></html>"
    out = extract_articles(spark.createDataFrame([(1, "http://a.example/x", html)], "page_id long, url string, html string")).first().clean_html
    assert "<figure><img><figcaption>cap</figcaption></figure>" in out


def test_base_and_options_for_images(spark):
    img = '<img src="../b/a.jpg" width="300" height="200"><img src="c.jpg" width="400" height="90">'
    html = f'<html><head><base href="/img/x/"><title>t</title></head><body><div><p>{LONG * 3}</p><p>{LONG}</p>{img}</div></body></html>'
    df = spark.createDataFrame([(1, "http://a.example/p/q", html)], "page_id long, url string, html string")
    assert extract_articles(df).first().image_url is None
    assert extract_articles(df, ExtractOptions(min_image=(300, 80), max_ratio=2.0)).first().image_url == "http://a.example/img/b/a.jpg"
    assert extract_articles(df, ExtractOptions(min_image=(350, 80), max_ratio=5.0)).first().image_url == "http://a.example/img/x/c.jpg"


def test_sizes_of_images_are_fetched(spark):
    png = bytes.fromhex("89504E470D0A1A0A0000000D49484452") + (900).to_bytes(4, "big") + (400).to_bytes(4, "big") + b"\0" * 200_000
    seen = []

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            seen.append((self.path, self.headers.get("X-Test")))
            self.send_response(200 if self.path == "/big.png" else 404)
            self.end_headers()
            if self.path == "/big.png":
                try:
                    self.wfile.write(png)
                except OSError:  # only the head is read
                    pass

        def log_message(self, *a):
            pass

    srv = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=srv.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{srv.server_port}/p"
    html = f'<html><head><title>t</title></head><body><div><p>{LONG * 3}</p><p>{LONG}</p><img src="/big.png"><img src="/gone.png"><img src="/told.jpg" width="600" height="300"></div></body></html>'
    df = spark.createDataFrame([(1, base, html), (2, base, html), (3, base, None)], "page_id long, url string, html string")
    plain = {r.page_id: r.image_url for r in extract_articles(df).collect()}
    rows = {r.page_id: r.image_url for r in extract_articles(df, ExtractOptions(fetch_images=True, headers={"X-Test": "yes"})).collect()}
    srv.shutdown()
    assert plain[1].endswith("/told.jpg") and rows[1] == rows[2] and rows[1].endswith("/big.png") and rows[3] is None
    assert sorted(seen) == [("/big.png", "yes"), ("/gone.png", "yes")]  # distinct URLs, once each
    table = spark.createDataFrame([(plain[1].replace("told.jpg", "gone.png"), 2000, 900)], "url string, width int, height int")
    assert extract_articles(df.where("page_id = 1"), sizes=table).first().image_url.endswith("/gone.png")


def test_spans_of_elements():
    assert dom.spans([0, 1, 2, 3], [3, 2, 2, 3], ["a", "b", None, "e"], [None, "d", "c", None]) == ("abcde", [0, 1, 2, 4], [5, 3, 2, 5])
    assert dom.spans([], [], [], []) == ("", [], [])


def test_sql_surface(spark):
    from pagequern.plans import surface

    surface.register(spark)
    spark.createDataFrame([(1, "<div id='a' class='b c'>x<p>y</p>z</div>"), (2, None)], "page_id int, html string").createOrReplaceTempView("some_pages")
    rows = spark.sql("SELECT page_id, n.tag, n.text, n.tail FROM some_pages, LATERAL html_nodes(html) n WHERE n.tag IN ('div', 'p')").collect()
    assert sorted(tuple(r) for r in rows) == [(1, "div", "x", None), (1, "p", "y", "z")]
    lines = [r.path for r in spark.sql("SELECT t.* FROM some_pages, LATERAL page_tree(html) t").collect()]
    assert any(x.endswith("div#a.b.c > p") for x in lines)
    r = spark.sql("SELECT clean_text('a \t\t b') AS a, norm_title('A — «b»') AS b, vote_language('der Hund und die Katze') AS c, detect_charset(encode('é', 'UTF-8')) AS d, clean_text(null) AS e").first()
    assert tuple(r) == ("a  b".replace("  ", " "), "A b", "de", "utf-8", None)


def test_headers_of_options_are_sent(spark):
    seen = []

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            seen.append(self.headers.get("X-Who"))
            self.send_response(200)
            self.end_headers()
            self.wfile.write(b"<p>hi</p>")

        def log_message(self, *a):
            pass

    srv = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=srv.serve_forever, daemon=True).start()
    from pagequern.sources.web import read_pages

    got = read_pages(spark, [f"http://127.0.0.1:{srv.server_port}/{i}" for i in range(3)], ExtractOptions(headers={"X-Who": "me"})).collect()
    srv.shutdown()
    assert len(got) == 3 and set(seen) == {"me"}

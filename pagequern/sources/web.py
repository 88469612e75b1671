"""A Spark data source that fetches pages by URL (S1), and image heads (S3)."""

from __future__ import annotations

import urllib.error
import urllib.request

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "page_id long, url string, status int, header_charset string, body binary, error_msg string"


def fetch(url: str, headers: dict | None = None, timeout: float | None = None, most: int | None = None) -> tuple:
    """(final url, status, header charset, body, error); failures are told, never raised."""
    if not url:
        return url, None, None, None, "Empty or null URL to perform"
    try:
        with urllib.request.urlopen(urllib.request.Request(url, headers=headers or {}), timeout=timeout) as r:
            return r.url, r.status, r.headers.get_content_charset(), r.read(most) if most else r.read(), None
    except urllib.error.HTTPError as e:
        return url, e.code, None, None, f"HTTP error. Status: {e.code}"
    except Exception as e:  # noqa: BLE001
        return url, None, None, None, str(e) or type(e).__name__


class PageSource(DataSource):
    """spark.read.format("pages").option("urls", "one a line").load(); options: timeout, header.<name>, partitions."""

    @classmethod
    def name(cls) -> str:
        return "pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def read_pages(spark, urls: list[str], options=None, timeout: float = 30.0, partitions: int = 8):
    """Pages of a list of URLs, fetched with the headers of the options."""
    spark.dataSource.register(PageSource)
    reader = spark.read.format("pages").option("urls", "\n".join(urls)).option("timeout", str(timeout)).option("partitions", str(partitions))
    for k, v in dict(options.headers if options else {}).items():
        reader = reader.option(f"header.{k}", v)
    return reader.load()


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.urls = [u.strip() for u in options.get("urls", "").split("\n") if u.strip()]
        self.timeout = float(options.get("timeout", 30))
        self.headers = {k[len("header."):]: v for k, v in options.items() if k.startswith("header.")}
        self.parts = max(1, min(int(options.get("partitions", 8)), len(self.urls) or 1))

    def partitions(self):
        return [InputPartition(i) for i in range(self.parts)]

    def read(self, partition):
        for i in range(partition.value, len(self.urls), self.parts):
            url, status, charset, body, error = fetch(self.urls[i], self.headers, self.timeout)
            yield i, url, status, charset, body, error


HEAD_BYTES = 64 * 1024
SLOTS = 4  # tasks among which the images of one host are divided
AT_ONCE = 4  # images a task fetches at a time


def image_heads(urls, headers: dict | None = None, timeout: float = 5.0, most: int = HEAD_BYTES):
    """(url, width, height) of distinct image URLs, -1 and -1 where they cannot be read (S3).

    Only the first bytes of an image are read.  A host's images go to at most SLOTS
    tasks with AT_ONCE requests each, whatever share of all images it holds.
    """
    from concurrent.futures import ThreadPoolExecutor

    import pandas as pd
    from pyspark.sql import functions as F

    from ..functions import text as T
    from ..operators.decoding import jpeg_column

    def run(pdfs):
        with ThreadPoolExecutor(AT_ONCE) as pool:
            for pdf in pdfs:
                yield pd.DataFrame({"url": pdf["url"], "body": list(pool.map(lambda u: fetch(u, headers, timeout, most)[3], pdf["url"]))})

    host = F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.\-]*://([^/?#]*)", 1)
    one = urls.select("url").where("url IS NOT NULL").distinct()
    got = one.repartition(host, F.pmod(F.xxhash64("url"), F.lit(SLOTS))).mapInPandas(run, "url string, body binary")
    size = F.coalesce(T.png_size(F.col("body")), T.gif_size(F.col("body")))
    got = got.withColumn("s", size).withColumn("j", jpeg_column(F.col("body")))
    return got.select("url", *[F.coalesce(F.col(f"s.{d}"), F.col(f"j.{d}"), F.lit(-1)).alias(d) for d in ("width", "height")])

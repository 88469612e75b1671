"""Articles from a stream of pages.

The pipeline is a map over pages, so it runs on a stream as it is; a page
delivered again is dropped by its id within the watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.article import extract_articles
from ..plans.options import ExtractOptions


def stream_articles(pages: DataFrame, options: ExtractOptions | None = None, delivered: str | None = None, late: str = "1 day") -> DataFrame:
    """Streaming articles; ``delivered`` names a timestamp column to drop repeated deliveries by."""
    if delivered:
        pages = pages.withWatermark(delivered, late).dropDuplicatesWithinWatermark(["page_id"])
    return extract_articles(pages, options)


def write_stream(pages: DataFrame, path: str, checkpoint: str, options: ExtractOptions | None = None, **kw):
    """Starts a query that appends articles to a Parquet folder."""
    return stream_articles(pages, options, **kw).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()

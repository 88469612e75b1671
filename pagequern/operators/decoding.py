"""From received bytes to page text: charset choice and lenient decoding."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.charsets import PYTHON, detect


def _decoded(body: pd.Series, declared: pd.Series) -> pd.DataFrame:
    out = []
    for b, c in zip(body, declared):
        if b is None:
            out.append((None, None, "Document is empty"))
            continue
        name = c or detect(bytes(b))
        try:
            out.append((name, bytes(b).decode(PYTHON.get(name, name), "ignore"), None))
        except LookupError:
            out.append((name, None, f"unknown encoding: {name}"))
    return pd.DataFrame(out, columns=["charset", "html", "error"])


def told_charset():
    """The first charset a page declares, else the server's; null without any."""
    ascii_view = F.decode(F.col("body"), "ISO-8859-1")
    return F.nullif(F.coalesce(F.try_element_at(T.declared_charsets(ascii_view), F.lit(1)), T.charset_alias(T.strip(F.col("header_charset")))), F.lit(""))


def decode_pages(raw: DataFrame) -> DataFrame:
    """page_id, url, charset, html, error_msg of received pages (page_id, url, status, header_charset, body).

    The charset is the first one the page declares, else the header's, else a
    detected one; bytes that do not fit are left out.  Unaccepted statuses and
    unknown charsets are told in error_msg; null and empty bodies are empty pages.
    """
    page = raw.dropDuplicates(["page_id", "url", "status", "header_charset", "body"])
    d = page.withColumn("x", F.pandas_udf(_decoded, "struct<charset:string,html:string,error:string>")(F.when(F.length("body") > 0, F.col("body")), told_charset()))
    error = F.coalesce(T.status_error(F.col("status")), F.col("x.error"))
    return d.select("page_id", "url", "x.charset", F.when(error.isNull(), F.col("x.html")).alias("html"), error.alias("error_msg"))


def jpeg_size(b: bytes | None) -> tuple[int, int] | None:
    """Width and height of a JPEG with a JFIF or Exif mark, found by walking its segments."""
    if not b or b[6:10] not in (b"JFIF", b"Exif"):
        return None
    i = 2
    while i + 9 <= len(b):
        if b[i] != 0xFF:
            return None
        code = b[i + 1]
        if 0xC0 <= code <= 0xCF and code not in (0xC4, 0xC8, 0xCC):
            h, w = struct.unpack(">HH", b[i + 5 : i + 9])
            return w, h
        i += 2 + struct.unpack(">H", b[i + 2 : i + 4])[0]
    return None


def _jpeg_sizes(body: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([jpeg_size(bytes(b)) or (None, None) if b is not None else (None, None) for b in body], columns=["width", "height"])


def jpeg_column(body):
    """Struct of width and height of each row's JPEG, nulls where it is none."""
    return F.pandas_udf(_jpeg_sizes, "struct<width:int,height:int>")(body)

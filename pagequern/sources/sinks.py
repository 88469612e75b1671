"""Writing articles: Parquet partitioned by language, or the documents as text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_articles(articles: DataFrame, path: str, mode: str = "errorifexists") -> None:
    articles.withColumn("lang", F.coalesce("language", F.lit("none"))).write.mode(mode).partitionBy("lang").parquet(path)


def write_documents(articles: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One document a line, newlines as entities."""
    articles.where("clean_html IS NOT NULL").select(F.replace("clean_html", F.lit("\n"), F.lit("&#10;")).alias("value")).write.mode(mode).text(path)

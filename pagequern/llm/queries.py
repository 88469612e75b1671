"""The pN_ queries: every problem's operator over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import spread, table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .sentences import paragraphs, sentence_units

    articles = table(spark, d, "articles")
    told = articles.where(F.col("description").isNotNull()).select("page_id", F.lit("description").alias("field_name"), F.lit(0).alias("block_no"), F.col("description").alias("text"))
    probed = articles.select("page_id", "clean_html").join(table(spark, d, "probe_pages"), "page_id", "left_semi")
    inside = paragraphs(spread(probed)).select("page_id", F.lit("clean_html").alias("field_name"), "block_no", "text")
    return sentence_units(told).unionByName(sentence_units(inside)).distinct()


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    from .boilerplate import unwanted_blocks

    return unwanted_blocks(spread(table(spark, d, "pages").select("page_id", "html")), spread(table(spark, d, "articles").select("page_id", "clean_html")))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    from .lookalike import same_look_pairs

    return same_look_pairs(table(spark, d, "articles").select("page_id", "title", "description"), "page_id", ["title", "description"])


def p3_classes(spark: SparkSession, d: str) -> DataFrame:
    from .lookalike import SameLook

    return SameLook(table(spark, d, "articles").select("page_id", "title", "description"), "page_id", ["title", "description"]).classes()


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    from .markup import shown_markup

    return shown_markup(spread(table(spark, d, "articles").select("page_id", "clean_html")))


def p4_clean(spark: SparkSession, d: str) -> DataFrame:
    from .markup import clean_bodies

    return clean_bodies(spread(table(spark, d, "articles").select("page_id", "clean_html")))


def p5_segments(spark: SparkSession, d: str) -> DataFrame:
    from .language import language_segments

    return language_segments(spread(table(spark, d, "articles").select("page_id", "language", "description")), table(spark, d, "lang_samples"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    from .language import wrong_or_mixed

    return wrong_or_mixed(p5_segments(spark, d))


def p6_repaired(spark: SparkSession, d: str) -> DataFrame:
    from .encoding import affected

    return affected(spread(table(spark, d, "articles").select("page_id", "title", "clean_html")), table(spark, d, "lang_samples"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return p6_repaired(spark, d).select("page_id", "field_name").distinct()


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    from .templates import residue

    return residue(spread(table(spark, d, "articles").select("page_id", "site", "title", "clean_html")), table(spark, d, "lang_samples"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    from .leak import leaked_items

    return leaked_items(spread(table(spark, d, "documents").select("doc_id", "text", "cells")), table(spark, d, "benchmark"))


def _mixture(spark: SparkSession, d: str):
    from .mixing import Mixture

    return Mixture(spread(table(spark, d, "documents").select("doc_id", "source", "text")), table(spark, d, "mix_targets"))


def p9_mixture(spark: SparkSession, d: str) -> DataFrame:
    return _mixture(spark, d).documents()


def p9_posteriors(spark: SparkSession, d: str) -> DataFrame:
    return _mixture(spark, d).posteriors()


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return _mixture(spark, d).shares()


def _truncation(spark: SparkSession, d: str):
    from .truncation import Truncation

    return Truncation(spread(table(spark, d, "documents").select("doc_id", "source", "text", "cells")))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return _truncation(spark, d).found()


def p10_shares(spark: SparkSession, d: str) -> DataFrame:
    return _truncation(spark, d).by_source()


#: what the bench times
HEADLINE = [f"p{n}_{'mixture' if n == 9 else 'found'}" for n in range(1, 11)]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in sorted(globals().items()) if k[0] == "p" and k[1:2].isdigit()}

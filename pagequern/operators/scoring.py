"""Candidate scoring over the node table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import dom

MIN_PARAGRAPH = 25


SCORED = ["p", "pre", "td"]


def measured(nodes: DataFrame) -> DataFrame:
    """Nodes with what scoring asks of them: one pass over each page, no text beyond it."""
    return dom.measures(nodes).select("page_id", "node_id", "tag", "raw", "length", "commas", "links")


def paragraphs(nodes: DataFrame, least: int = MIN_PARAGRAPH, measures: DataFrame | None = None) -> DataFrame:
    """Scored p, pre and td elements with parent and grandparent (U1, J1, F6, part of A1)."""
    m = dom.measures(nodes, SCORED) if measures is None else measures.where(F.col("tag").isin(SCORED))
    long = m.where(F.col("length") >= least).select("page_id", "node_id", "length", (F.lit(2.0) + F.col("commas") + F.least(F.col("length") / 100.0, F.lit(3.0))).alias("score"))
    up = nodes.select("page_id", F.col("node_id").alias("parent_id"), F.col("parent_id").alias("grand_id"))
    rank = F.when(F.col("tag") == "p", 0).when(F.col("tag") == "pre", 1).otherwise(2)
    p = nodes.where(F.col("tag").isin(SCORED) & F.col("parent_id").isNotNull()).select("page_id", "node_id", "parent_id", rank.alias("tag_rank"))
    return p.join(long, ["page_id", "node_id"]).join(up, ["page_id", "parent_id"])


def candidates(nodes: DataFrame, positive: str | None = None, negative: str | None = None, least: int = MIN_PARAGRAPH) -> DataFrame:
    """(page_id, node_id, seq, content_score): scaled scores with insertion order (A1-A3)."""
    m = measured(nodes)
    p = paragraphs(nodes, least, m)
    gains = p.select("page_id", F.col("parent_id").alias("node_id"), "score", F.struct("tag_rank", F.col("node_id").alias("p"), F.lit(0).alias("grand")).alias("seq")).union(
        p.where("grand_id IS NOT NULL").select("page_id", F.col("grand_id").alias("node_id"), F.col("score") / 2, F.struct("tag_rank", F.col("node_id").alias("p"), F.lit(1).alias("grand")))
    )
    summed = gains.groupBy("page_id", "node_id").agg(F.sum("score").alias("gain"), F.min("seq").alias("seq"))
    out = nodes.select("page_id", "node_id", "tag", "attrs").join(summed, ["page_id", "node_id"]).join(m.drop("tag"), ["page_id", "node_id"])
    base = T.class_weight(F.col("tag"), F.col("attrs")["class"], F.col("attrs")["id"], positive, negative) + T.tag_score(F.col("tag"))
    score = (base + F.col("gain")) * (1 - F.col("links") / F.greatest(F.col("length"), F.lit(1))) * (1 + F.col("raw") / 500.0)
    return out.select("page_id", "node_id", "seq", score.alias("content_score"))


def best(scored: DataFrame) -> DataFrame:
    """(page_id, node_id, content_score) of the best candidate; ties go to the one met first (K1)."""
    order = F.struct(F.round("content_score", 6).alias("s"), (-F.col("seq.tag_rank")).alias("a"), (-F.col("seq.p")).alias("b"), (-F.col("seq.grand")).alias("c"))
    return scored.groupBy("page_id").agg(F.max_by(F.struct("node_id", "content_score"), order).alias("x")).select("page_id", "x.*")

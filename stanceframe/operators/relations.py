"""Edges between claims, derived from what was said about a subject, by whom, and when."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import edge_id, polarity


def with_polarity(claims: DataFrame) -> DataFrame:
    return claims.withColumn("sign", F.signum(polarity("stance", "sentiment")).cast("int"))


def stance_edges(claims: DataFrame) -> DataFrame:
    """Claims of two speakers on one subject agree or dispute: one edge per subject, unordered pair of speakers, and kind.

    The edge stands between the pair that comes first by claim_id, from the newer claim to the older (equal times: from
    the larger id). Only the first claim of each (subject, speaker, sign) can be in that pair, so the self-join is over
    speakers, not claims. Needs claim_id, subject, speaker_id, stance, sentiment, event_time.
    """
    first = with_polarity(claims).where("sign <> 0").groupBy("subject", "speaker_id", "sign").agg(F.min(F.struct("claim_id", "event_time")).alias("c"))
    a, b = (first.select("subject", F.col("speaker_id").alias(f"s{x}"), F.col("sign").alias(f"sign{x}"), F.col("c").alias(f"c{x}")) for x in "ab")
    pairs = a.join(b, "subject").where("sa < sb").select("subject", "sa", "sb", (F.col("signa") == F.col("signb")).alias("same"), F.least("ca", "cb").alias("x"), F.greatest("ca", "cb").alias("y"))
    one = pairs.groupBy("subject", "sa", "sb", "same").agg(F.min(F.struct("x", "y")).alias("p"))
    newer_x = F.col("p.x.event_time") > F.col("p.y.event_time")
    src, dst = (F.when(newer_x, F.col(f"p.{m}")).otherwise(F.col(f"p.{n}")) for m, n in ("xy", "yx"))
    kind = F.when(F.col("same"), "agrees_with").otherwise("disputes")
    out = one.select("subject", kind.alias("type"), src.alias("src"), dst.alias("dst"))
    return out.select("subject", "type", F.col("src.claim_id").alias("src_id"), F.col("dst.claim_id").alias("dst_id"), F.col("src.event_time").alias("event_time"), edge_id("type", F.col("src.claim_id"), F.col("dst.claim_id")).alias("edge_id"))


def supersession_edges(claims: DataFrame) -> DataFrame:
    """A speaker's claim supersedes the one just before it on the subject when both take sides, and opposite ones."""
    order = Window.partitionBy("speaker_id", "subject").orderBy("event_time", "claim_id")
    near = with_polarity(claims).withColumn("before", F.lag("sign").over(order)).withColumn("dst_id", F.lag("claim_id").over(order))
    hit = near.where("sign <> 0 and before <> 0 and sign <> before")
    return hit.select("subject", F.lit("supersedes").alias("type"), F.col("claim_id").alias("src_id"), "dst_id", "event_time", edge_id(F.lit("supersedes"), "claim_id", "dst_id").alias("edge_id"))


def mention_edges(claims: DataFrame, secondary: DataFrame) -> DataFrame:
    """Claim to each distinct secondary entity (claim_id, canonical_id) that is not its subject."""
    pairs = claims.join(secondary, "claim_id").where("canonical_id <> subject").select("subject", "claim_id", "canonical_id", "event_time").dropDuplicates(["claim_id", "canonical_id"])
    return pairs.select("subject", F.lit("mentions").alias("type"), F.col("claim_id").alias("src_id"), F.col("canonical_id").alias("dst_id"), "event_time", edge_id(F.lit("mentions"), "claim_id", "canonical_id").alias("edge_id"))


def derived_edges(claims: DataFrame, secondary: DataFrame | None = None) -> DataFrame:
    """Mentions, stance edges and supersessions; of equal edge ids the first kind in this order stays."""
    kinds = [*([mention_edges(claims, secondary)] if secondary is not None else []), stance_edges(claims), supersession_edges(claims)]
    union = kinds[0].withColumn("kind", F.lit(0))
    for i, frame in enumerate(kinds[1:], 1):
        union = union.unionByName(frame.withColumn("kind", F.lit(i)))
    columns = [c for c in union.columns if c not in ("kind", "edge_id")]
    return union.groupBy("edge_id").agg(F.min_by(F.struct(*columns), "kind").alias("e")).select("edge_id", "e.*")


def asserted_edges(claims: DataFrame) -> DataFrame:
    """The edges that every loaded claim brings: speaker asserts it, it is about its subject, it appears in its episode."""
    kinds = F.array(
        F.struct(F.lit("asserts").alias("type"), F.col("speaker_id").alias("src_id"), F.col("claim_id").alias("dst_id")),
        F.struct(F.lit("about").alias("type"), F.col("claim_id").alias("src_id"), F.col("subject").alias("dst_id")),
        F.struct(F.lit("appears_in").alias("type"), F.col("claim_id").alias("src_id"), F.col("episode_id").alias("dst_id")),
    )
    rows = claims.select("event_time", F.explode(kinds).alias("e")).select("e.*", "event_time", F.col("event_time").alias("valid_from"))
    return rows.withColumn("edge_id", edge_id("type", "src_id", "dst_id")).dropDuplicates(["edge_id"])


def adjacency(edges: DataFrame) -> DataFrame:
    """Undirected neighbours along edges that are not invalidated."""
    alive = edges.where(~F.col("invalidated"))
    both = alive.select(F.col("src_id").alias("id"), F.col("dst_id").alias("neighbour")).union(alive.select("dst_id", "src_id"))
    return both.distinct()

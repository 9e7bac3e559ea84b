"""How the view of a subject moved: buckets, directions and people."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import stance_sign, weight

DAY_US = 86_400_000_000


def most_claimed_subject(claims: DataFrame) -> DataFrame:
    """The subject with the most claims; ties go to the smaller key."""
    return claims.groupBy("subject").agg(F.count(F.lit(1)).alias("n_claims")).orderBy(F.desc("n_claims"), "subject").limit(1)


def with_event_time(claims: DataFrame, episodes: DataFrame) -> DataFrame:
    """Claims of known episodes with the time these came out."""
    return claims.join(episodes.select("episode_id", F.col("published_at").alias("event_time")), "episode_id")


def bucketed(claims: DataFrame, days: float = 30) -> DataFrame:
    """``bucket``: how many widths after the subject's first claim. A window over the subject's minimum would gather a
    subject in one task, so the origin is aggregated and joined."""
    width = int(days * DAY_US)
    if width <= 0:
        raise ValueError("a bucket needs a positive width")
    origin = claims.groupBy("subject").agg(F.min("event_time").alias("origin"))
    late = F.unix_micros("event_time") - F.unix_micros("origin")
    return claims.join(origin, "subject").withColumn("bucket", F.floor(late / F.lit(width)).cast("bigint")).withColumn("bucket_start", F.timestamp_micros(F.unix_micros("origin") + F.col("bucket") * width))


def _mean(value: Column) -> Column:
    return F.sum(weight("confidence") * value) / F.sum(weight("confidence"))


def consensus_buckets(claims: DataFrame, days: float = 30) -> DataFrame:
    """Per subject and bucket: number of claims, confidence-weighted sentiment and stance, speakers.

    Needs subject, speaker_id, stance, sentiment, confidence, event_time. A confidence of 0 or less weighs 1e-9.
    """
    return bucketed(claims, days).groupBy("subject", "bucket").agg(
        F.count(F.lit(1)).alias("claim_count"), _mean(F.col("sentiment")).alias("net_sentiment"), _mean(stance_sign("stance")).alias("net_stance"),
        F.count_distinct("speaker_id").alias("n_speakers"), F.first("bucket_start").alias("bucket_start"),
    )


def bucket_speakers(claims: DataFrame, days: float = 30) -> DataFrame:
    """Per subject, bucket and speaker: number of claims, mean sentiment, and the order in which they first spoke."""
    each = bucketed(claims, days).groupBy("subject", "bucket", "speaker_id").agg(F.count(F.lit(1)).alias("claim_count"), F.avg("sentiment").alias("mean_sentiment"), F.min(F.struct("event_time", "seq")).alias("first"))
    order = Window.partitionBy("subject", "bucket").orderBy("first")
    return each.withColumn("position", F.row_number().over(order)).drop("first")


def zero_filled(buckets: DataFrame) -> DataFrame:
    """Every bucket between a subject's first and last; empty ones have no claims and zeros."""
    spans = buckets.groupBy("subject").agg(F.sequence(F.min("bucket"), F.max("bucket")).alias("all"))
    whole = spans.select("subject", F.explode("all").alias("bucket"))
    return whole.join(buckets.drop("bucket_start"), ["subject", "bucket"], "left").fillna(0, ["claim_count", "n_speakers"]).fillna(0.0, ["net_sentiment", "net_stance"])


def trend_direction(buckets: DataFrame, threshold: float = 0.1) -> DataFrame:
    """Per subject: direction and delta over its populated buckets.

    A step above the threshold rose, one below its negative fell; both is mixed. Otherwise a small delta is flat, else
    its sign decides. One bucket is insufficient.
    """
    order = Window.partitionBy("subject").orderBy("bucket")
    steps = buckets.withColumn("step", F.col("net_sentiment") - F.lag("net_sentiment").over(order))
    agg = steps.groupBy("subject").agg(
        F.count(F.lit(1)).alias("n_buckets"), F.coalesce(F.bool_or(F.col("step") > threshold), F.lit(False)).alias("rose"), F.coalesce(F.bool_or(F.col("step") < -threshold), F.lit(False)).alias("fell"),
        (F.max_by("net_sentiment", "bucket") - F.min_by("net_sentiment", "bucket")).alias("delta"),
    )
    direction = F.when(F.col("n_buckets") < 2, "insufficient").when(F.col("rose") & F.col("fell"), "mixed").when(F.abs("delta") < threshold, "flat").when(F.col("delta") > 0, "rising").otherwise("falling")
    return agg.select("subject", "n_buckets", direction.alias("direction"), F.when(F.col("n_buckets") < 2, 0.0).otherwise(F.col("delta")).alias("sentiment_delta"))


def belief_history(claims: DataFrame, days: float = 30) -> DataFrame:
    """Per person and subject, the buckets where the person spoke: their count and mean sentiment, the bucket's stance."""
    own = bucket_speakers(claims, days).select("subject", "bucket", "speaker_id", "claim_count", "mean_sentiment")
    return own.join(consensus_buckets(claims, days).select("subject", "bucket", "net_stance"), ["subject", "bucket"])


def belief_direction(history: DataFrame, threshold: float = 0.1) -> DataFrame:
    """Last minus first of a person's sentiments: rising, falling or flat."""
    agg = history.groupBy("speaker_id", "subject").agg((F.max_by("mean_sentiment", "bucket") - F.min_by("mean_sentiment", "bucket")).alias("delta"), F.count(F.lit(1)).alias("n_buckets"))
    return agg.withColumn("direction", F.when(F.col("delta") > threshold, "rising").when(F.col("delta") < -threshold, "falling").otherwise("flat"))


def who_discussed(hits: DataFrame, k: int = 25) -> DataFrame:
    """Distinct speakers among the first ``k`` hits (rank, speaker_id, claim_id), in rank order, each with the first anchor."""
    first = hits.where(F.col("rank") <= k).where("coalesce(speaker_id, '') <> ''").groupBy("speaker_id").agg(F.min("rank").alias("rank"), F.min_by("claim_id", "rank").alias("claim_id"))
    return first.orderBy("rank")

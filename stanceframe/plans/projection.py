"""The test tables seen as claims, segments, edges and vectors: each projection twice, for Spark and for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as claims: 50 speakers, 100 subjects, five stances."""
    kind = F.col("event_type")
    stance = F.when(kind == "purchase", "asserts").when(kind == "click", "predicts").when(kind == "view", "hedges").when(kind == "error", "disputes").otherwise("retracts")
    day = F.date_trunc("day", F.col("ts").cast("timestamp"))
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"), F.concat(F.lit("c"), F.lpad(F.col("event_id").cast("string"), 8, "0")).alias("claim_id"), F.concat(F.lit("spk-"), (F.col("user_id") % 50).cast("string")).alias("speaker_id"),
        F.concat(F.lit("ent-"), F.regexp_extract("props", "([0-9]+)", 1)).alias("subject"), stance.alias("stance"), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("value") / 250 - 1)).alias("sentiment"),
        ((F.col("event_id") % 101) / 100.0).cast("double").alias("confidence"), F.concat(F.lit("ep-"), F.date_format(day, "yyyyMMdd")).alias("episode_id"), day.alias("event_time"),
    )


CLAIMS = """claims AS (
  SELECT event_id AS seq, 'c' || lpad(event_id::VARCHAR, 8, '0') AS claim_id, 'spk-' || (user_id % 50) AS speaker_id,
         'ent-' || regexp_extract(props, '([0-9]+)', 1) AS subject,
         CASE event_type WHEN 'purchase' THEN 'asserts' WHEN 'click' THEN 'predicts' WHEN 'view' THEN 'hedges' WHEN 'error' THEN 'disputes' ELSE 'retracts' END AS stance,
         greatest(-1, least(1, value / 250 - 1)) AS sentiment, (event_id % 101) / 100.0::DOUBLE AS confidence,
         'ep-' || strftime(ts, '%Y%m%d') AS episode_id, date_trunc('day', ts)::TIMESTAMP AS event_time
  FROM events)"""


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One asserts edge per claim: every fifth ends after some days, every seventh is invalidated."""
    c = claims(spark, sf_dir)
    ends = F.when(F.col("seq") % 5 == 0, F.timestamp_seconds(F.unix_seconds("event_time") + 86400 * (F.col("seq") % 20)))
    return c.select(
        F.concat(F.lit("edge-"), "claim_id").alias("edge_id"), F.lit("asserts").alias("type"), F.col("speaker_id").alias("src_id"), F.col("claim_id").alias("dst_id"), "event_time", F.col("event_time").alias("valid_from"),
        ends.alias("valid_to"), (F.col("seq") % 7 == 0).alias("invalidated"), F.col("seq").alias("load_seq"),
    )


EDGES = """edges AS (
  SELECT 'edge-' || claim_id AS edge_id, 'asserts' AS type, speaker_id AS src_id, claim_id AS dst_id, event_time, event_time AS valid_from,
         CASE WHEN seq % 5 = 0 THEN event_time + to_days((seq % 20)::INTEGER) END AS valid_to, seq % 7 = 0 AS invalidated, seq AS load_seq
  FROM claims)"""


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations as segments of six seconds, which overlap the next by one."""
    c = table(spark, sf_dir, "conversations")
    return c.select(
        F.concat(F.lit("conv-"), F.col("conv_id").cast("string")).alias("episode_id"), F.col("turn").cast("int").alias("seg_idx"), F.col("role").alias("speaker"), F.col("text"),
        (F.col("turn") * 5.0).cast("double").alias("t_start"), (F.col("turn") * 5.0 + 4 + F.length("text") % 4).cast("double").alias("t_end"),
    )


SEGMENTS = """segments AS (
  SELECT 'conv-' || conv_id AS episode_id, turn::INTEGER AS seg_idx, role AS speaker, text, turn * 5.0::DOUBLE AS t_start,
         (turn * 5.0 + 4 + length(text) % 4)::DOUBLE AS t_end
  FROM conversations)"""


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.col("label"))


def with_(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"

"""Idempotent ingest: items are known by their key, contents by their hash."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import JOB_STATUSES


def status_counts(jobs: DataFrame) -> DataFrame:
    """Jobs of every status, those without any too."""
    known = jobs.sparkSession.createDataFrame([(s,) for s in JOB_STATUSES], "status string")
    return known.join(jobs.groupBy("status").agg(F.count(F.lit(1)).alias("n")), "status", "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("bigint"))


def new_items(items: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """The first item by seq of each key that is not known; blank keys are left out."""
    fresh = items.where(F.coalesce(F.trim(key), F.lit("")) != "").join(known.select(key).distinct(), key, "left_anti")
    first = fresh.groupBy(key).agg(F.min_by(F.struct(*[c for c in items.columns if c != key]), "seq").alias("first"))
    return first.select(key, "first.*").select(*items.columns)


def content_dedupe(blobs: DataFrame, order_col: str) -> DataFrame:
    """Blobs (content) with their hash and whether an earlier one has the same content.

    The hash alone is shuffled; the earliest row of each is found by aggregation, so a content that many rows share makes
    no large window.
    """
    hashed = blobs.withColumn("content_hash", F.sha2("content", 256)).drop("content")
    first = hashed.groupBy("content_hash").agg(F.min(order_col).alias("first"))
    return hashed.join(first, "content_hash").withColumn("deduped", F.col(order_col) > F.col("first")).drop("first")


def cache_misses(requests: DataFrame, cache: DataFrame | None, *parts: str) -> DataFrame:
    """Requests with the key of their content that the cache (cache_key) does not hold, each key once."""
    keyed = requests.withColumn("cache_key", F.sha2(F.to_json(F.struct(*parts)), 256)).dropDuplicates(["cache_key"])
    return keyed if cache is None else keyed.join(cache.select("cache_key"), "cache_key", "left_anti")

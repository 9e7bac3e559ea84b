"""Shows from charts: ranks within a domain, one row per show, and the subset worth a deep look."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rank_feeds(listing: DataFrame, limit: int) -> DataFrame:
    """Feeds (domain, feed_url, seq) of each domain in listing order, the first of equal urls, cut at ``limit``."""
    first = Window.partitionBy("domain", "feed_url").orderBy("seq")
    kept = listing.withColumn("at", F.row_number().over(first)).where("at = 1").drop("at", "rank")
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy("domain").orderBy("seq"))).where(F.col("rank") <= limit)


def high_velocity(rows: DataFrame, least: int = 15, most: int = 25) -> DataFrame:
    """The shows with the highest rates: up to ``most`` that have any, filled up to ``least`` from the rest."""
    if least > most:
        raise ValueError("least is more than most")
    fields = ["show_id", "rank", "seq", "episodes_per_month", "recent_count"]
    best = rows.groupBy("show_id").agg(F.max_by(F.struct(*fields), F.struct("episodes_per_month", "recent_count", -F.col("seq"))).alias("b")).select("b.*")
    top = best.orderBy(F.desc("episodes_per_month"), F.desc("recent_count"), "rank", "show_id").limit(most)
    place = F.row_number().over(Window.orderBy(F.desc("episodes_per_month"), F.desc("recent_count"), "rank", "show_id"))  # over ``most`` rows
    signal = (F.col("episodes_per_month") > 0) | (F.col("recent_count") > 0)
    return top.withColumn("place", place).where(signal | (F.col("place") <= least)).drop("place")


def merge_shows(rows: DataFrame) -> DataFrame:
    """One row per show: domains in the order first seen, feed of the first row."""
    first = rows.groupBy("show_id", "domain").agg(F.min("seq").alias("seq"), F.min_by("feed_url", "seq").alias("feed_url"))
    return first.groupBy("show_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "domain"))), lambda s: s["domain"]).alias("domains"), F.min_by("feed_url", "seq").alias("feed_url"))


def show_id(feed_id: str, guid: str, title: str, domain: str) -> Column:
    """The id of a feed: by its number, else its guid, else its domain and title, where each character that is neither a
    letter nor a digit is a hyphen."""
    name = F.regexp_replace(F.regexp_replace(F.lower(F.trim(F.coalesce(F.col(title), F.lit("untitled")))), r"[^\p{L}\p{N}]", "-"), "^-+|-+$", "")
    by_name = F.concat_ws("-", F.col(domain), F.when(name == "", "untitled").otherwise(name))
    return F.coalesce(F.concat(F.lit("pi-"), F.col(feed_id).cast("string")), F.concat(F.lit("guid-"), F.nullif(F.col(guid), F.lit(""))), by_name)

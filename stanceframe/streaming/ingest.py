"""Incremental ingest: files arrive, items are taken once, claims upsert the graph."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.load import GraphTables, VersionedTable
from ..sources.jobs import new_items


def run_available(stream: DataFrame, checkpoint: str, batch: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Everything that is there now, in batches, then stop; the checkpoint says what was done."""
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingest_items(spark: SparkSession, source: str, schema: str, table: str, checkpoint: str, key: str = "guid") -> StreamingQuery:
    """JSON items to a table with each key once, however late it comes again: the table itself remembers the keys."""
    items = VersionedTable(spark, table)

    def batch(rows: DataFrame, epoch: int) -> None:
        known = items.current()
        rows = rows.withColumn("seq", F.monotonically_increasing_id())
        # an epoch that runs again finds its keys known, so it appends nothing
        fresh = new_items(rows, known if known is not None else rows.limit(0), key).drop("seq").withColumn("epoch", F.lit(epoch).cast("bigint"))
        items.append(fresh)

    return run_available(spark.readStream.schema(schema).json(source), checkpoint, batch)


def ingest_claims(spark: SparkSession, source: str, schema: str, tables: GraphTables, episodes: DataFrame, checkpoint: str, ingested: str) -> StreamingQuery:
    """JSON claims to the graph tables; edges of touched subjects are derived anew, so claims may come late."""

    def batch(rows: DataFrame, epoch: int) -> None:
        if not rows.isEmpty():
            tables.load(rows, episodes, ingested, epoch)

    return run_available(spark.readStream.schema(schema).json(source), checkpoint, batch)


def live_buckets(claims: DataFrame, width: str = "7 days", late: str = "1 day") -> DataFrame:
    """Running counts and confidence-weighted sentiment per subject and window, with a watermark."""
    w = F.when(F.col("confidence") > 0, F.col("confidence")).otherwise(1e-9)
    return claims.withWatermark("event_time", late).groupBy(F.window("event_time", width), "subject").agg(F.count(F.lit(1)).alias("claim_count"), (F.sum(w * F.col("sentiment")) / F.sum(w)).alias("net_sentiment"))

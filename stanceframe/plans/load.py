"""From resolved claims to the tables of the graph, and versions of tables on disk."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import claim_id
from ..operators.relations import asserted_edges, derived_edges
from ..operators.temporal import upsert_edges, upsert_latest
from ..sources.storage import list_names, read_text, remove, write_text


def loadable(claims: DataFrame) -> DataFrame:
    """Claims of a resolved speaker about a resolved subject."""
    return claims.where("coalesce(speaker_id, '') <> '' and coalesce(subject, '') <> ''")


def claim_rows(claims: DataFrame, episodes: DataFrame, ingested: str) -> DataFrame:
    """Claims (claim_seq, speaker_id, predicate, subject, object, stance, sentiment, confidence, episode_id, t_start, t_end)
    with their content id and time; the first of equal ids stays. An unknown episode takes the time of ingestion."""
    timed = loadable(claims).join(episodes.select("episode_id", "published_at"), "episode_id", "left").withColumn("event_time", F.coalesce("published_at", F.lit(ingested).cast("timestamp"))).drop("published_at")
    named = timed.withColumn("claim_id", claim_id("speaker_id", "predicate", "subject", "object", "episode_id", "t_start"))
    columns = [c for c in named.columns if c != "claim_id"]
    return named.groupBy("claim_id").agg(F.min_by(F.struct(*columns), "claim_seq").alias("c")).select("claim_id", "c.*")


def edge_rows(claims: DataFrame, ingested: str, load_seq: int, secondary: DataFrame | None = None) -> DataFrame:
    """All edges of a batch of claim rows, once each."""
    derived = derived_edges(claims, secondary).select("edge_id", "type", "src_id", "dst_id", "event_time").withColumn("valid_from", F.col("event_time"))
    rows = asserted_edges(claims).unionByName(derived)
    return rows.withColumns({"ingestion_time": F.lit(ingested).cast("timestamp"), "valid_to": F.lit(None).cast("timestamp"), "invalidated": F.lit(False), "load_seq": F.lit(load_seq).cast("bigint")})


class VersionedTable:
    """A Parquet table on shared storage whose versions are lists of folders.

    Each version is a small file of its own that appears whole, so a writer that dies leaves the table as it was, and of
    two that write the same version one fails. ``append`` adds a folder and rewrites nothing; ``replace`` starts anew.
    The last ``keep`` versions stay readable; folders of older ones are removed.
    """

    def __init__(self, spark: SparkSession, path: str, keep: int = 2):
        self.spark, self.path, self.keep = spark, path.rstrip("/"), keep

    def _versions(self) -> list[str]:
        return [n for n in list_names(self.spark, self.path) if n.startswith("VERSION-") and not n.endswith(".part")]

    def _folders(self, version: str) -> list[str]:
        return json.loads(read_text(self.spark, f"{self.path}/{version}"))

    def current(self) -> DataFrame | None:
        versions = self._versions()
        if not versions:
            return None
        found = [self.spark.read.parquet(f"{self.path}/{f}") for f in self._folders(versions[-1])]
        out = found[0]
        for frame in found[1:]:
            out = out.unionByName(frame)
        return out

    def _add(self, rows: DataFrame, kept: list[str], partition_by: tuple[str, ...]) -> DataFrame:
        versions, folder = self._versions(), f"data-{uuid.uuid4().hex}"
        rows.write.partitionBy(*partition_by).parquet(f"{self.path}/{folder}")
        n = int(versions[-1].removeprefix("VERSION-")) + 1 if versions else 0
        write_text(self.spark, f"{self.path}/VERSION-{n:012d}", json.dumps([*kept, folder]))
        versions = self._versions()
        live = {f for v in versions[-self.keep :] for f in self._folders(v)}
        for version in versions[: -self.keep]:
            for old in set(self._folders(version)) - live:
                remove(self.spark, f"{self.path}/{old}")
            remove(self.spark, f"{self.path}/{version}")
        return self.current()

    def append(self, rows: DataFrame, partition_by: tuple[str, ...] = ()) -> DataFrame:
        versions = self._versions()
        return self._add(rows, self._folders(versions[-1]) if versions else [], partition_by)

    def replace(self, rows: DataFrame, partition_by: tuple[str, ...] = ()) -> DataFrame:
        return self._add(rows, [], partition_by)


class GraphTables:
    """Claims and edges on disk. A batch recomputes the derived edges of the subjects it touches, so late claims count."""

    def __init__(self, spark: SparkSession, path: str):
        self.claims, self.edges = VersionedTable(spark, f"{path}/claims"), VersionedTable(spark, f"{path}/edges")

    def load(self, claims: DataFrame, episodes: DataFrame, ingested: str, load_seq: int) -> int:
        """Upsert a batch; loading it again changes nothing. Returns the number of claims in it."""
        rows = claim_rows(claims, episodes, ingested).withColumn("load_seq", F.lit(load_seq).cast("bigint"))
        stored = self.claims.current()
        everything = self.claims.replace(upsert_latest(stored, rows, "claim_id") if stored is not None else rows)
        touched = rows.select("subject").distinct()
        fresh = edge_rows(everything.join(touched, "subject", "left_semi"), ingested, load_seq)
        old = self.edges.current()
        if old is not None:
            # derived edges of touched subjects that no longer follow go, unless they are history
            mine = everything.join(touched, "subject", "left_semi").select(F.col("claim_id").alias("src_id"))
            stale = old.where("type in ('agrees_with', 'disputes', 'supersedes') and not invalidated").join(mine, "src_id", "left_semi").join(fresh.select("edge_id"), "edge_id", "left_anti").select("edge_id")
            fresh = upsert_edges(old.join(stale, "edge_id", "left_anti").select(*fresh.columns), fresh)
        self.edges.replace(fresh, ("type",))
        return rows.count()

"""Canonical entities and speakers that last: what one call resolves, the next one finds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import normal_name, speaker_id
from ..operators.identity import resolve_incremental
from ..schemas import ENTITIES
from .load import VersionedTable


class EntityStore:
    """Entities (``schemas.ENTITIES`` and insert_seq) in a versioned table."""

    def __init__(self, spark: SparkSession, path: str):
        self.table, self.empty = VersionedTable(spark, path), spark.createDataFrame([], f"{ENTITIES}, insert_seq bigint")

    def entities(self) -> DataFrame:
        found = self.table.current()
        return self.empty if found is None else found

    def resolve(self, forms: DataFrame) -> DataFrame:
        """`resolve_incremental` of forms (entity_type, form, name, qid, vector, seq) against the store, which takes in
        the new entities: each with the name, vector and qid of its first form, and all its names as aliases."""
        stored = self.entities()
        known = stored.agg(F.max("insert_seq")).first()[0] or 0
        decided = resolve_incremental(forms, stored)
        rows = forms.join(decided, ["entity_type", "form"]).withColumn("insert_seq", F.col("seq").cast("bigint") + F.lit(known + 1))
        fresh = rows.join(stored.select("canonical_id").distinct(), "canonical_id", "left_anti")
        first = lambda c: F.min_by(c, "seq")
        new = fresh.groupBy("canonical_id").agg(
            first("name").alias("canonical_name"), first("entity_type").alias("entity_type"), F.max("qid").alias("qid"), first("vector").alias("embedding"),
            F.array_sort(F.collect_set("name")).alias("aliases"), F.min("insert_seq").alias("insert_seq"),
        )
        out = rows.select("entity_type", "form", "canonical_id", "tier")
        merged = self.table.append(new.select(self.empty.columns))
        return out.join(merged.select("canonical_id").distinct(), "canonical_id", "left_semi").select(out.columns)


class SpeakerStore:
    """Speakers (speaker_id, name, qid) by QID, else by normal name: one for a name in every episode."""

    def __init__(self, spark: SparkSession, path: str):
        self.table, self.empty = VersionedTable(spark, path), spark.createDataFrame([], "speaker_id string, name string, qid string, key string")

    def speakers(self) -> DataFrame:
        found = self.table.current()
        return self.empty if found is None else found

    def resolve(self, names: DataFrame) -> DataFrame:
        """(key, speaker_id, display_name) for names (name, qid, seq), by normal name; a name that is stored keeps its
        speaker, and its first spelling is the display name."""
        rows = names.withColumn("key", normal_name("name")).groupBy("key").agg(F.min_by("name", "seq").alias("name"), F.max("qid").alias("qid"))
        stored = self.speakers().groupBy("key").agg(F.min("speaker_id").alias("speaker_id"))
        fresh = rows.join(stored, "key", "left_anti").select(speaker_id("qid", F.col("key")).alias("speaker_id"), "name", "qid", "key")
        everyone = self.table.append(fresh)
        shown = everyone.groupBy("speaker_id").agg(F.min("name").alias("display_name"))
        return rows.select("key").join(everyone.select("key", "speaker_id"), "key").join(shown, "speaker_id").select("key", "speaker_id", "display_name")

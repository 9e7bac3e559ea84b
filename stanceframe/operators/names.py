"""Names that people say: who is introduced, and which label is whose."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import normal_name

# A name, the phrases that introduce a guest and oneself, and what may trail a name.
NAME = r"(?-i:[A-Z][a-zA-Z'’.-]+(?:\s+[A-Z][a-zA-Z'’.-]+){0,2})"
GUEST_INTROS = (
    rf"\bmy guest today is\s+({NAME})",
    rf"\bjoining me (?:today\s+)?is\s+({NAME})",
    rf"\bI'?m here with\s+({NAME})",
    rf"\b(?:please\s+)?welcom(?:e|ing)\s+({NAME})",
    rf"\btoday I'?m (?:joined|talking) (?:by|with)\s+({NAME})",
    rf"\bour guest (?:today )?is\s+({NAME})",
)
SELF_INTROS = (
    rf"\bI'?m\s+({NAME})",
    rf"\bI am\s+({NAME})",
    rf"\bthis is\s+({NAME})",
)
TRAILING = r"\b(today|here|with me|on the show|back)\b.*$"


def clean_name(c: Column) -> Column:
    """Without dots and commas at the ends and without what trails a name."""
    cut = F.trim(F.regexp_replace(F.trim(c), r"^[.,]+|[.,]+$", ""))
    return F.trim(F.regexp_replace(cut, f"(?i){TRAILING}", ""))


def _guests(segments: DataFrame) -> DataFrame:
    """Every guest that a segment introduces, with its place (``at``) by pattern, then position."""
    found = F.flatten(F.array(*[F.regexp_extract_all("text", F.lit(f"(?i){p}"), F.lit(1)) for p in GUEST_INTROS]))
    return segments.select("episode_id", "seg_idx", "speaker", F.posexplode(found).alias("at", "raw")).withColumn("name", clean_name(F.col("raw"))).where("name <> ''")


def introduced(segments: DataFrame) -> DataFrame:
    """(episode_id, name, seg_idx): guests that a segment introduces, each name once per episode, where first said."""
    best = _guests(segments).groupBy("episode_id", F.lower("name").alias("key")).agg(F.min(F.struct("seg_idx", "at", "name")).alias("first"))
    return best.select("episode_id", "first.name", "first.seg_idx")


def label_names(segments: DataFrame, roster: DataFrame | None = None) -> DataFrame:
    """(episode_id, label, name): a label is who it first says it is.

    A guest whom a label introduces is the episode's first other label, in order of appearance, unless that one has a
    name already. Names of a roster (full_name) take its spelling.
    """
    own_name = F.coalesce(*[F.nullif(clean_name(F.regexp_extract("text", f"(?i){p}", 1)), F.lit("")) for p in SELF_INTROS])
    own = segments.withColumn("own", own_name).where("own is not null").groupBy("episode_id", F.col("speaker").alias("label")).agg(F.min_by("own", "seg_idx").alias("name"))
    # of each episode only its first two labels can be a target
    seen = segments.groupBy("episode_id", "speaker").agg(F.min("seg_idx").alias("seen"))
    order = seen.groupBy("episode_id").agg(F.array_sort(F.collect_list(F.struct("seen", "speaker"))).alias("labels"))
    at = lambda i: F.try_element_at("labels", F.lit(i))["speaker"]
    aimed = _guests(segments).join(order, "episode_id").withColumn("label", F.when(F.col("speaker") == at(1), at(2)).otherwise(at(1))).where("label is not null")
    guest = aimed.groupBy("episode_id", "label").agg(F.min(F.struct("seg_idx", "at", "name")).alias("g")).select("episode_id", "label", "g.name")
    out = own.unionByName(guest.join(own, ["episode_id", "label"], "left_anti"))
    if roster is None:
        return out
    spelled = roster.groupBy(normal_name("full_name").alias("key")).agg(F.min("full_name").alias("full_name"))
    return out.withColumn("key", normal_name("name")).join(spelled, "key", "left").select("episode_id", "label", F.coalesce("full_name", "name").alias("name"))


def guest_labels(segments: DataFrame, hosts: DataFrame) -> DataFrame:
    """(episode_id, label): the label with the most talk time that is no host's (episode_id, label); ties to the smaller."""
    own = segments.join(hosts.select("episode_id", F.col("label").alias("speaker")), ["episode_id", "speaker"], "left_anti")
    each = own.groupBy("episode_id", "speaker").agg(F.sum(F.greatest(F.lit(0.0), F.col("t_end") - F.col("t_start"))).alias("seconds"))
    order = Window.partitionBy("episode_id").orderBy(F.desc("seconds"), "speaker")
    return each.withColumn("at", F.row_number().over(order)).where("at = 1").select("episode_id", F.col("speaker").alias("label"))

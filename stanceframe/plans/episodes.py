"""The write path in one call: segments of many episodes to claims in the graph tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import normal_name
from ..operators import extraction, names, segments as S
from .load import GraphTables, claim_rows
from .stores import EntityStore, SpeakerStore


@dataclass
class Collaborators:
    """What a run needs from outside. ``extract`` answers prompts (episode_id, chunk_index, prompt) with ``raw``; ``embed``
    gives forms (entity_type, form, name, seq) a ``vector`` and a ``qid``; both are DataFrame to DataFrame, so a service is
    called in `mapInPandas`, or answers come from a table."""

    extract: Callable[[DataFrame], DataFrame]
    embed: Callable[[DataFrame], DataFrame]
    entities: EntityStore
    speakers: SpeakerStore
    graph: GraphTables


def run_episodes(rows: DataFrame, episodes: DataFrame, c: Collaborators, *, ingested: str, load_seq: int, least_share: float = 0.05, max_chars: int = 6000, ground: bool = True, roster: DataFrame | None = None) -> DataFrame:
    """Load the claims of segments (episode_id, seg_idx, speaker, text, t_start, t_end) and return them.

    In this order: labels with little talk time go; labels take the names that are said; chunks, prompts and answers;
    claims with a reason to be dropped go; the others are grounded, take their speaker and their subject, and are loaded
    with all edges. The whole batch is resolved and loaded at once, so edges cross episodes.
    """
    rows = S.prune_low_talk_time(rows, least_share)
    said = names.label_names(rows, roster).withColumn("qid", F.lit(None).cast("string")).withColumn("seq", F.xxhash64("episode_id", "label"))
    people = c.speakers.resolve(said.select("name", "qid", "seq"))
    resolution = said.withColumn("key", normal_name("name")).join(people, "key").select("episode_id", "label", F.col("speaker_id").alias("resolved_id"))

    chunks = S.packed_chunks(rows, max_chars)
    labels = rows.groupBy("episode_id").agg(F.collect_set("speaker").alias("labels"))
    answers = c.extract(extraction.chunk_prompts(chunks, rows)).join(chunks.select("episode_id", "chunk_index", F.col("t_start").alias("c_start"), F.col("t_end").alias("c_end")), ["episode_id", "chunk_index"]).join(labels, "episode_id")
    parsed = extraction.parse_claims(answers.withColumn("chunk_id", F.to_json(F.struct("episode_id", "chunk_index")))).where("drop_reason is null")
    at = F.from_json("chunk_id", "episode_id string, chunk_index int")
    found = parsed.select(at["episode_id"].alias("episode_id"), at["chunk_index"].alias("chunk_index"), "item_idx", F.col("speaker_label").alias("label"), "predicate", F.col("subject").alias("name"), "subject_type", "object", "stance", "sentiment", "confidence", "t_start", "t_end")
    found = found.withColumn("claim_seq", F.xxhash64("episode_id", "chunk_index", "item_idx"))
    if ground:
        found = extraction.ground_claims(found, rows).drop("grounded", "score")
    found = extraction.stamp_speakers(found, resolution).withColumn("speaker_id", F.coalesce("resolved_id", F.concat_ws("/", "episode_id", "label")))

    form = normal_name("name")
    forms = found.groupBy(F.col("subject_type").alias("entity_type"), form.alias("form")).agg(F.min("name").alias("name"), F.min(F.pmod("claim_seq", F.lit(1 << 40))).alias("seq"))
    subjects = c.entities.resolve(c.embed(forms))
    named = found.withColumn("form", form).join(subjects.select(F.col("entity_type").alias("subject_type"), "form", F.col("canonical_id").alias("subject")), ["subject_type", "form"])
    loaded = named.select("claim_seq", "speaker_id", "predicate", "subject", "object", "stance", "sentiment", "confidence", "episode_id", "t_start", "t_end")
    c.graph.load(loaded, episodes, ingested, load_seq)
    return claim_rows(loaded, episodes, ingested)

"""From model output to claims: predicates, validation with reasons, grounding in the transcript."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import clamp
from ..functions.text_udfs import BestMatch
from ..schemas import ENTITY_TYPES, STANCES
from .predicates import PREDICATES, map_predicate

#: Seconds that a span may lie outside its chunk.
TOLERANCE = 0.05
ITEM = "struct<speaker_label: string, predicate: string, subject: string, subject_type: string, object: string, stance: string, sentiment: string, confidence: string, t_start: string, t_end: string>"


def parse_claims(outputs: DataFrame, vocabulary: Sequence[str] = PREDICATES, synonyms: Mapping[str, str] | None = None) -> DataFrame:
    """Items of raw model output (chunk_id, raw, labels, c_start, c_end) with the reason why one is dropped, else null.

    What is not a JSON object with a list of claims gives one row with the reason ``not_json``.
    """
    parsed = outputs.withColumn("parsed", F.from_json("raw", f"claims array<{ITEM}>"))
    rows = parsed.select("chunk_id", "labels", "c_start", "c_end", F.posexplode_outer("parsed.claims").alias("item_idx", "item"))
    x = lambda name: F.col(f"item.{name}")
    start, end = x("t_start").try_cast("double"), x("t_end").try_cast("double")
    predicate = map_predicate(x("predicate"), vocabulary, synonyms)
    stance = F.lower(F.trim(x("stance")))
    reason = (
        F.when(F.col("item").isNull(), "not_json").when(~F.coalesce(F.array_contains("labels", x("speaker_label")), F.lit(False)), "unknown_label").when(predicate.isNull(), "unknown_predicate")
        .when(start.isNull() | end.isNull(), "no_times").when(end < start, "span_reversed").when((start < F.col("c_start") - TOLERANCE) | (end > F.col("c_end") + TOLERANCE), "outside_chunk")
        .when(F.coalesce(F.trim(x("subject")), F.lit("")) == "", "no_subject").when(~F.coalesce(stance.isin(*STANCES), F.lit(False)), "unknown_stance").when(x("object").isNull(), "no_object")
    )
    inside = lambda c: F.when(c.isNotNull(), F.greatest(F.col("c_start"), F.least(F.col("c_end"), c)))
    kind = F.lower(F.trim(x("subject_type")))
    return rows.select(
        "chunk_id", "item_idx", x("speaker_label").alias("speaker_label"), predicate.alias("predicate"), F.trim(x("subject")).alias("subject"),
        F.when(kind.isin(*ENTITY_TYPES), kind).otherwise("concept").alias("subject_type"), x("object").alias("object"), stance.alias("stance"),
        clamp(F.coalesce(x("sentiment").try_cast("double"), F.lit(0.0)), -1, 1).alias("sentiment"), clamp(F.coalesce(x("confidence").try_cast("double"), F.lit(0.5)), 0, 1).alias("confidence"),
        inside(start).alias("t_start"), inside(end).alias("t_end"), reason.alias("drop_reason"),
    )


def validate_claims(claims: DataFrame) -> DataFrame:
    """Claims with ``reasons``, an array of what is wrong with each; empty where nothing is."""
    rules = {
        "stance": F.col("stance").isin(*STANCES), "sentiment": F.col("sentiment").between(-1, 1), "confidence": F.col("confidence").between(0, 1), "span": F.col("t_end") >= F.col("t_start"),
        "speaker": F.coalesce("speaker_id", F.lit("")) != "", "subject": F.coalesce("subject", F.lit("")) != "",
    }
    wrong = F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()])
    return claims.withColumn("reasons", F.filter(wrong, lambda r: r.isNotNull()))


def ground_claims(claims: DataFrame, segments: DataFrame, threshold: float = 0.45) -> DataFrame:
    """Claims (claim_seq, episode_id, object, t_start, t_end, label) moved to the segment of their episode that says it best.

    A score under the threshold leaves a claim as it is; ties go to the earlier segment.
    """
    s = segments.where("episode_id is not null").select("episode_id", "seg_idx", "text", F.struct(F.col("speaker").alias("s_label"), F.col("t_start").alias("s0"), F.col("t_end").alias("s1")).alias("b"))
    b, columns = s.schema["b"], claims.columns
    schema = T.StructType([*claims.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("b", b.dataType)])

    def run(some: pa.Table, said: pa.Table) -> pa.Table:
        said = said.sort_by("seg_idx")
        best = BestMatch(said["text"].to_pylist())
        found = [best.of(x) if len(said) else (None, None) for x in some["object"].to_pylist()]
        spans = said["b"].combine_chunks().take(pa.array([i for _, i in found], pa.int64()))
        return pa.table([*some.select(columns).columns, pa.array([x for x, _ in found], pa.float64()), spans], names=[*columns, "score", "b"])

    # an episode is the unit of work: its texts are sent once, not once a claim
    out = claims.groupBy("episode_id").cogroup(s.groupBy("episode_id")).applyInArrow(run, schema)
    out = out.withColumn("grounded", F.coalesce(F.col("score") >= threshold, F.lit(False)))
    moved = {"t_start": "b.s0", "t_end": "b.s1", "label": "b.s_label"}
    return out.select(*[F.when(F.col("grounded"), F.col(moved[c])).otherwise(F.col(c)).alias(c) if c in moved else F.col(c) for c in claims.columns], "grounded", "score")


def stamp_speakers(claims: DataFrame, resolution: DataFrame) -> DataFrame:
    """Claims with the resolved id of their label in their episode; an unknown label stays null."""
    return claims.join(resolution.select("episode_id", "label", "resolved_id"), ["episode_id", "label"], "left")


def resolve_roster(labels: DataFrame, roster: DataFrame) -> DataFrame:
    """Labels (episode_id, label) as the full names of a roster (episode_id, full_name): the whole name, a first name, a
    surname or a part that only one of them has; a first name or surname of several stops there, unchanged."""
    r = roster.groupBy("episode_id").agg(F.array_sort(F.collect_set("full_name")).alias("names"))
    low = F.lower(F.trim("label"))
    names = F.coalesce("names", F.array().cast("array<string>"))
    by = lambda test: F.filter(names, test)
    exact, first = by(lambda n: F.lower(n) == low), by(lambda n: F.element_at(F.split(F.lower(n), " "), 1) == low)
    last, part = by(lambda n: F.element_at(F.split(F.lower(n), " "), -1) == low), by(lambda n: F.instr(F.lower(n), low) > 0)
    pick = F.when(F.size(exact) > 0, F.get(exact, F.lit(0)))
    for found, stops in ((first, True), (last, True), (part, False)):
        pick = pick.when(F.size(found) == 1, F.get(found, F.lit(0)))
        pick = pick.when(F.size(found) > 1, F.col("label")) if stops else pick
    return labels.join(r, "episode_id", "left").select("episode_id", "label", pick.otherwise(F.col("label")).alias("speaker"))


def fold_claims(claims: DataFrame, key: str) -> DataFrame:
    """The first row by claim_seq of each key."""
    return claims.groupBy(key).agg(F.min_by(F.struct(*[c for c in claims.columns if c != key]), "claim_seq").alias("first")).select(key, "first.*").select(*claims.columns)


def chunk_prompts(chunks: DataFrame, segments: DataFrame, vocabulary: Sequence[str] = PREDICATES) -> DataFrame:
    """(episode_id, chunk_index, prompt) of packed chunks: the episode, the window, who speaks, the lines, and what to return."""
    inside = segments.select("episode_id", "seg_idx", "speaker").join(chunks.select("episode_id", "chunk_index", "first_idx", "last_idx"), "episode_id").where("seg_idx between first_idx and last_idx")
    who = inside.groupBy("episode_id", "chunk_index").agg(F.array_join(F.array_sort(F.collect_set("speaker")), ", ").alias("who"))
    fields = "speaker_label, predicate, subject, subject_type (" + "|".join(ENTITY_TYPES) + "), object, stance (" + "|".join(STANCES) + "), sentiment (-1 to 1), confidence (0 to 1), t_start, t_end (seconds, inside the window)"
    task = f'Return JSON {{"claims": [...]}}, one object for each claim that a line supports, with {fields}. Predicates: {", ".join(vocabulary)}. Without claims return {{"claims": []}}.'
    text = F.concat(
        F.lit("Episode "), "episode_id", F.lit("\nSeconds "), F.format_string("%.2f to %.2f", "t_start", "t_end"), F.lit("\nSpeakers: "), "who",
        F.lit("\nLines, each as [start-end] SPEAKER: text\n\n"), "text", F.lit("\n\n" + task),
    )
    return chunks.join(who, ["episode_id", "chunk_index"]).select("episode_id", "chunk_index", text.alias("prompt"))

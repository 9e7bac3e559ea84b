"""Two time axes: when something was said, and when it was held to be so."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Moment = dt.datetime | str | None


def moment(at: Moment) -> Column:
    return F.lit(at).cast("timestamp")


def live(as_of: Moment = None) -> Column:
    """Without a moment: not invalidated. At one: valid_from <= moment < valid_to, whatever the flag says."""
    if as_of is None:
        return ~F.col("invalidated")
    at = moment(as_of)
    return (F.col("valid_from") <= at) & (F.col("valid_to").isNull() | (F.col("valid_to") > at))


def current_state(edges: DataFrame, as_of: Moment = None) -> DataFrame:
    return edges.where(live(as_of))


def within_event_time(start: Moment = None, end: Moment = None) -> Column:
    """Closed window on the time of the event; rows without a time pass."""
    et = F.coalesce("event_time", "valid_from")
    inside = F.lit(True)
    if start is not None:
        inside = inside & (et >= moment(start))
    if end is not None:
        inside = inside & (et <= moment(end))
    return et.isNull() | inside


def overlaps_validity(start: Moment = None, end: Moment = None) -> Column:
    """Closed window on validity; open ends pass."""
    lower, out = F.coalesce("valid_from", "event_time"), F.lit(False)
    if end is not None:
        out = out | F.coalesce(lower > moment(end), F.lit(False))
    if start is not None:
        out = out | F.coalesce(F.col("valid_to") < moment(start), F.lit(False))
    return ~out


def invalidate(edges: DataFrame, ids: DataFrame, at: Moment) -> DataFrame:
    """End the edges of ``ids`` (edge_id) at a moment; the first end of an edge stands."""
    hit = F.col("hit").isNotNull() & ~F.col("invalidated")
    marked = edges.join(ids.select("edge_id").distinct().withColumn("hit", F.lit(True)), "edge_id", "left")
    return marked.select(
        *[F.when(hit, moment(at)).otherwise(F.col(c)).alias(c) if c == "valid_to" else (F.col(c) | F.coalesce("hit", F.lit(False))).alias(c) if c == "invalidated" else F.col(c) for c in edges.columns]
    )


def set_validity_window(edges: DataFrame, which: Column, valid_from: Moment = None, valid_to: Moment = None) -> DataFrame:
    """Move the window of some edges; what is not given stays, and the flag is untouched."""
    for name, at in (("valid_from", valid_from), ("valid_to", valid_to)):
        if at is not None:
            edges = edges.withColumn(name, F.when(which, moment(at)).otherwise(F.col(name)))
    return edges


def query_claims(claims: DataFrame, edges: DataFrame, speakers: DataFrame, entities: DataFrame, *, subject: str | None = None, speaker: str | None = None, predicate: str | None = None, as_of: Moment = None, include_invalidated: bool = False) -> DataFrame:
    """Claims with a live ``asserts`` edge, their speaker and subject, and the time of their first edge.

    Filters combine with AND and reach the scan. ``include_invalidated`` keeps every claim, with or without an edge.
    ``edges`` needs ``load_seq`` to say which came first. Ordered by claim_id.
    """
    for column, value in (("subject_canonical_id", subject), ("speaker_id", speaker), ("predicate", predicate)):
        if value is not None:
            claims = claims.where(F.col(column) == value)
    asserts = edges.where("type = 'asserts'")
    if not include_invalidated:
        claims = claims.join(asserts.where(live(as_of)).select(F.col("dst_id").alias("claim_id")), "claim_id", "left_semi")
    first = asserts.groupBy(F.col("dst_id").alias("claim_id")).agg(F.min_by("event_time", "load_seq").alias("event_time"))
    names = speakers.select("speaker_id", F.col("name").alias("speaker_name"))
    subjects = entities.select(F.col("canonical_id").alias("subject_canonical_id"), F.col("canonical_name").alias("subject_name"))
    return claims.join(first, "claim_id", "left").join(names, "speaker_id", "left").join(subjects, "subject_canonical_id", "left").orderBy("claim_id")


def _best(rows: DataFrame, key: str, *order: Column) -> DataFrame:
    """The row of each key that is largest in this order; aggregated partially, so a key with many rows stays small."""
    best = rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns if c != key]), F.struct(*order)).alias("best"))
    return best.select(key, "best.*").select(*rows.columns)


def upsert_edges(stored: DataFrame, loaded: DataFrame) -> DataFrame:
    """Last load wins, but a live reload never replaces an invalidated edge. Both need ``load_seq``."""
    return _best(stored.unionByName(loaded), "edge_id", F.col("invalidated"), F.col("load_seq"))


def upsert_latest(stored: DataFrame, loaded: DataFrame, key: str) -> DataFrame:
    """Last load wins (speakers, claims)."""
    return _best(stored.unionByName(loaded), key, F.col("load_seq"))


def upsert_entities(stored: DataFrame, loaded: DataFrame) -> DataFrame:
    """The first record keeps name, type and qid; aliases are the ordered exact-distinct union."""
    rows = stored.unionByName(loaded)
    heads = rows.groupBy("canonical_id").agg(F.min_by(F.struct("canonical_name", "entity_type", "qid"), "load_seq").alias("head"), F.min("load_seq").alias("load_seq"))
    each = rows.select("canonical_id", "load_seq", F.posexplode("aliases").alias("pos", "alias"))
    firsts = each.groupBy("canonical_id", "alias").agg(F.min(F.struct("load_seq", "pos")).alias("at"))
    lists = firsts.groupBy("canonical_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "alias"))), lambda s: s["alias"]).alias("aliases"))
    return heads.join(lists, "canonical_id", "left").select("canonical_id", "head.*", F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"), "load_seq")

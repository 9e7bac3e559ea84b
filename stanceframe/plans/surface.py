"""Five questions over the claim tables, as DataFrames."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import consensus, retrieval, temporal


class Surface:
    """``claims``: claim_id, text, embedding, speaker_id, subject, stance, sentiment, confidence, event_time, valid_from,
    valid_to, seq. ``neighbours``: id, neighbour. ``embed`` turns a query into a vector."""

    def __init__(self, claims: DataFrame, neighbours: DataFrame, embed: Callable[[str], Sequence[float]]):
        self.claims, self.neighbours, self.embed = claims, neighbours, embed

    def search_dialogue(self, query: str, *, since: temporal.Moment = None, until: temporal.Moment = None, top_k: int = 10, overlap: bool = False) -> DataFrame:
        inside = temporal.overlaps_validity(since, until) if overlap else temporal.within_event_time(since, until)
        found = retrieval.hybrid(self.claims.where(inside), self.neighbours, query, self.embed(query), top_k=top_k)
        return found.join(self.claims.drop("embedding"), "claim_id").orderBy(F.desc("score"), "claim_id")

    def who_discussed(self, topic: str, *, since: temporal.Moment = None, top_k: int = 25) -> DataFrame:
        hits = self.search_dialogue(topic, since=since, top_k=top_k)
        ranked = hits.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "claim_id")))  # over top_k rows
        return consensus.who_discussed(ranked, top_k)

    def consensus_trend(self, subject: str, *, days: float = 30) -> tuple[DataFrame, DataFrame]:
        buckets = consensus.consensus_buckets(self.claims.where(F.col("subject") == subject), days)
        return buckets.orderBy("bucket"), consensus.trend_direction(buckets)

    def belief_history(self, person: str, subject: str, *, days: float = 30) -> tuple[DataFrame, DataFrame]:
        own = consensus.belief_history(self.claims.where(F.col("subject") == subject), days).where(F.col("speaker_id") == person)
        return own.orderBy("bucket"), consensus.belief_direction(own)

    def provenance_lookup(self, claim: str) -> DataFrame:
        return retrieval.provenance(self.claims, claim)

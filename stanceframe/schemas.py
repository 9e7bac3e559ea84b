"""Closed vocabularies and table schemas."""

from __future__ import annotations


#: Fixed values of the data model.
STANCES = ("asserts", "predicts", "hedges", "disputes", "retracts")
STANCE_SIGN = {"asserts": 1.0, "predicts": 0.5, "hedges": 0.0, "disputes": -1.0, "retracts": -1.0}
ENTITY_TYPES = ("person", "organization", "concept", "work")
EDGE_TYPES = ("asserts", "about", "mentions", "agrees_with", "disputes", "supersedes", "appears_in")
DIRECTIONS = ("rising", "falling", "mixed", "flat", "insufficient")
JOB_STATUSES = ("queued", "leased", "done", "failed")



SPAN = "struct<episode_id: string, t_start: double, t_end: double, transcript_offset: int>"
SEGMENTS = "episode_id string, seg_idx int, speaker string, text string, t_start double, t_end double"
WORDS = "episode_id string, word_idx int, text string, t_start double, t_end double, speaker string"
EXTRACTED_CLAIMS = (
    "claim_seq bigint, speaker struct<label: string, resolved_id: string, name: string>, predicate string,"
    " subject struct<name: string, type: string, canonical_id: string, qid: string>, object string, stance string,"
    f" sentiment double, confidence double, span {SPAN}"
)
CLAIMS = (
    "claim_id string, predicate string, stance string, object string, sentiment double, confidence double, span_episode_id string,"
    " span_t_start double, span_t_end double, speaker_id string, subject_canonical_id string"
)
EDGES = "edge_id string, type string, src_id string, dst_id string, event_time timestamp, ingestion_time timestamp, valid_from timestamp, valid_to timestamp, invalidated boolean"
ENTITIES = "canonical_id string, canonical_name string, entity_type string, qid string, embedding array<double>, aliases array<string>"
SPEAKERS = "speaker_id string, name string, is_host boolean, qid string"
JOBS = "id string, idempotency_key string, payload string, status string, attempts int, lease_expires_at double, seq bigint"
MANIFEST = (
    "version int, rows array<struct<show_id: string, feed_url: string, domains: array<string>, known_hosts: array<string>,"
    " reference_audio: map<string, string>, deep_backfill: boolean>>"
)
CORPUS = "name string, compiled string, note string, episodes array<struct<id: string, show: string, episode: string, title: string, date: string, host: string, guests: array<string>, topic: string, url: string, format: string>>"

"""Transcripts as ordered segments: talk time, chunks, spans, and who spoke which word."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import overlap, word_count

#: Seconds that a word takes where a transcript has no times.
SECONDS_PER_WORD = 0.4


def talk_time(segments: DataFrame) -> DataFrame:
    """(episode_id, speaker, seconds, share); the share is null where nobody spoke."""
    each = segments.groupBy("episode_id", "speaker").agg(F.sum(F.greatest(F.lit(0.0), F.col("t_end") - F.col("t_start"))).alias("seconds"))
    total = F.sum("seconds").over(Window.partitionBy("episode_id"))
    return each.withColumn("share", F.when(total > 0, F.col("seconds") / total))


def prune_low_talk_time(segments: DataFrame, least: float = 0.05) -> DataFrame:
    """Segments of speakers with at least this share; all stay where nobody spoke or the share is 0 or less."""
    if not 0 <= least <= 1:
        raise ValueError("a share lies between 0 and 1")
    low = talk_time(segments).where(F.col("share") < least).select("episode_id", "speaker")
    return segments.join(low, ["episode_id", "speaker"], "left_anti").select(*segments.columns) if least > 0 else segments


def dominant_speaker(segments: DataFrame, keys: list[str]) -> DataFrame:
    """The label with the most talk time per group; ties to the smaller label."""
    each = segments.groupBy(*keys, "speaker").agg(F.sum(F.greatest(F.lit(0.0), F.col("t_end") - F.col("t_start"))).alias("seconds"))
    order = Window.partitionBy(*keys).orderBy(F.desc("seconds"), "speaker")
    return each.withColumn("at", F.row_number().over(order)).where("at = 1").select(*keys, "speaker", "seconds")


def fixed_chunks(segments: DataFrame, n: int = 3) -> DataFrame:
    """Runs of n segments without overlap: text in order, span, dominant speaker."""
    if n < 1:
        raise ValueError("a chunk needs a segment")
    placed = segments.withColumn("chunk_index", F.floor(F.col("seg_idx") / n).cast("int"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seg_idx", "text"))), lambda s: s["text"]), " ")
    chunks = placed.groupBy("episode_id", "chunk_index").agg(text.alias("text"), F.min("t_start").alias("t_start"), F.max("t_end").alias("t_end"))
    return chunks.join(dominant_speaker(placed, ["episode_id", "chunk_index"]).drop("seconds"), ["episode_id", "chunk_index"])


def synthesize_spans(segments: DataFrame) -> DataFrame:
    """Times from word counts alone: each segment starts where the one before ended."""
    order = Window.partitionBy("episode_id").orderBy("seg_idx")
    words = segments.withColumn("words", word_count("text"))
    end = F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return words.withColumn("t_end", end * SECONDS_PER_WORD).withColumn("t_start", (end - F.col("words")) * SECONDS_PER_WORD)


def merge_adjacent(segments: DataFrame) -> DataFrame:
    """Consecutive segments of a speaker become one; blank ones go first."""
    order = Window.partitionBy("episode_id").orderBy("seg_idx")
    rows = segments.where("trim(coalesce(text, '')) <> ''")
    rows = rows.withColumn("turn", F.sum(F.when(F.lag("speaker").over(order).eqNullSafe(F.col("speaker")), 0).otherwise(1)).over(order))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seg_idx", "text"))), lambda s: F.trim(s["text"])), " ")
    return rows.groupBy("episode_id", "turn", "speaker").agg(text.alias("text"), F.min("t_start").alias("t_start"), F.max("t_end").alias("t_end"), F.count(F.lit(1)).alias("n_segments"))


def best_overlap(spans: DataFrame, segments: DataFrame, key: str) -> DataFrame:
    """For each span (key, episode_id, s_start, s_end) the segment it overlaps most; ties to the first. Equal episodes meet, so no range join is without a key."""
    near = spans.join(segments, "episode_id").withColumn("seconds", overlap("s_start", "s_end", "t_start", "t_end")).where("seconds > 0")
    best = near.groupBy(key).agg(F.max_by(F.struct("seg_idx", "speaker", "text", "seconds"), F.struct("seconds", -F.col("seg_idx"))).alias("hit"))
    return spans.join(best, key, "left").select(*spans.columns, "hit.*")


def verify_citations(citations: DataFrame, segments: DataFrame, speakers: DataFrame, min_overlap: float = 0.0) -> DataFrame:
    """Whether the segment a citation (citation_id, episode_id, s_start, s_end, cited_speaker) overlaps most is the cited
    speaker's. ``speakers``: (episode_id, seg_idx, speaker_id)."""
    best = best_overlap(citations, segments, "citation_id").join(speakers, ["episode_id", "seg_idx"], "left")
    reason = (
        F.when(F.coalesce("seconds", F.lit(0.0)) <= min_overlap, "no_overlap")
        .when(F.coalesce("speaker_id", F.lit("")) == "", "unresolved_speaker").when(F.col("speaker_id") != F.col("cited_speaker"), "wrong_speaker").otherwise("verified")
    )
    return best.withColumn("reason", reason).withColumn("verified", F.col("reason") == "verified")


def containing_segment(spans: DataFrame, segments: DataFrame, key: str, tolerance: float = 0.05) -> DataFrame:
    """The first segment that holds the whole span, give or take the tolerance."""
    inside = (F.col("s_start") >= F.col("t_start") - tolerance) & (F.col("s_end") <= F.col("t_end") + tolerance)
    held = spans.join(segments, "episode_id").where(inside).groupBy(key).agg(F.min_by(F.struct("seg_idx", "speaker"), "seg_idx").alias("hit"))
    return spans.join(held, key, "left").select(*spans.columns, "hit.*")


def words_to_speakers(words: DataFrame, turns: DataFrame, default: str = "SPEAKER_00") -> DataFrame:
    """Each word (episode_id, word_idx, w_start, w_end) to the turn it overlaps most, else to the nearest by its middle,
    else to the default label. Ties: earliest start, end, label."""
    mid = (F.col("w_start") + F.col("w_end")) / 2
    gap = F.greatest(F.lit(0.0), F.col("t_start") - mid, mid - F.col("t_end"))
    near = words.join(turns.select("episode_id", "speaker", "t_start", "t_end"), "episode_id").withColumn("seconds", overlap("w_start", "w_end", "t_start", "t_end")).withColumn("gap", F.when(F.col("seconds") > 0, 0.0).otherwise(gap))
    best = near.groupBy("episode_id", "word_idx").agg(F.min_by("speaker", F.struct(-F.col("seconds"), "gap", "t_start", "t_end", "speaker")).alias("label"))
    return words.join(best, ["episode_id", "word_idx"], "left").withColumn("speaker", F.coalesce("label", F.lit(default))).drop("label")


def majority_speaker(words: DataFrame, key: str) -> DataFrame:
    """The label with the most word seconds per segment; ties to the smaller label."""
    each = words.groupBy(key, "speaker").agg(F.sum(F.col("w_end") - F.col("w_start")).alias("seconds"))
    return each.groupBy(key).agg(F.min_by("speaker", F.struct(-F.col("seconds"), "speaker")).alias("speaker"))


def crosstalk(turns: DataFrame) -> DataFrame:
    """Where two labels speak at once: overlaps of turns of different labels, merged where they touch."""
    a = turns.select("episode_id", F.col("speaker").alias("sa"), F.col("t_start").alias("a0"), F.col("t_end").alias("a1"))
    b = turns.select("episode_id", F.col("speaker").alias("sb"), F.col("t_start").alias("b0"), F.col("t_end").alias("b1"))
    hits = a.join(b, "episode_id").where("sa < sb").select("episode_id", F.greatest("a0", "b0").alias("lo"), F.least("a1", "b1").alias("hi")).where("hi > lo")
    order = Window.partitionBy("episode_id").orderBy("lo", "hi")
    reach = F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1))
    islands = hits.withColumn("new", F.when(F.col("lo") <= reach, 0).otherwise(1)).withColumn("island", F.sum("new").over(order))
    return islands.groupBy("episode_id", "island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))


CHUNKS = "episode_id string, chunk_index int, first_idx int, last_idx int, text string, t_start double, t_end double"


def _line(speaker: str, text: str, start: float, end: float) -> str:
    return f"[{start:.2f}-{end:.2f}] {speaker}: {text}"


def packed_chunks(segments: DataFrame, max_chars: int = 6000, overlap_segments: int = 1) -> DataFrame:
    """Greedy runs of whole segments up to ``max_chars`` of rendered text; the last ones are repeated in the next chunk.

    Where a chunk ends decides where the next begins, so an episode is packed in one piece (a task holds an episode).
    """
    if max_chars < 1 or overlap_segments < 0:
        raise ValueError("max_chars must be positive and the overlap not negative")

    def pack(episode: pd.DataFrame) -> pd.DataFrame:
        rows = episode.sort_values("seg_idx").reset_index(drop=True)
        lines = [_line(*x) for x in zip(rows.speaker, rows.text, rows.t_start, rows.t_end, strict=True)]
        out, start = [], 0
        while start < len(lines):
            stop, size = start + 1, len(lines[start])
            while stop < len(lines) and size + 1 + len(lines[stop]) <= max_chars:
                size += 1 + len(lines[stop])
                stop += 1
            part = rows.iloc[start:stop]
            out.append((rows.episode_id[0], len(out), int(part.seg_idx.iloc[0]), int(part.seg_idx.iloc[-1]), "\n".join(lines[start:stop]), part.t_start.min(), part.t_end.max()))
            if stop == len(lines):
                break
            start = stop - min(overlap_segments, stop - start - 1)
        return pd.DataFrame(out, columns=[c.split()[0] for c in CHUNKS.split(", ")])

    return segments.select("episode_id", "seg_idx", "speaker", "text", "t_start", "t_end").groupBy("episode_id").applyInPandas(pack, CHUNKS)


def resegment(words: DataFrame, max_seconds: float = 15.0) -> DataFrame:
    """Words (episode_id, word_idx, text, t_start, t_end, speaker) to segments: a new one on a change of label, when it
    would outlast ``max_seconds``, and after . ! or ?; a blank label counts as A."""

    def split(episode: pd.DataFrame) -> pd.DataFrame:
        out: list[list] = []
        for w in episode.sort_values("word_idx").itertuples():
            label = w.speaker if isinstance(w.speaker, str) and w.speaker.strip() else "A"
            if out and out[-1][2] == label and w.t_end - out[-1][4] <= max_seconds and out[-1][3][-1][-1:] not in (".", "!", "?"):
                out[-1][3].append(w.text)
                out[-1][5] = max(out[-1][5], w.t_end)
            else:
                out.append([w.episode_id, len(out), label, [w.text], w.t_start, w.t_end])
        return pd.DataFrame([(e, i, s, " ".join(t), a, b) for e, i, s, t, a, b in out], columns=["episode_id", "seg_idx", "speaker", "text", "t_start", "t_end"])

    return words.groupBy("episode_id").applyInPandas(split, "episode_id string, seg_idx int, speaker string, text string, t_start double, t_end double")


def finalize(rows: DataFrame) -> DataFrame:
    """Rows (episode_id, row_idx, speaker, text, t nullable) to segments by a running cursor.

    A segment starts at its own time or the cursor, whichever is later, and ends where the next row's own time says, if
    that is later, else after 0.4 s a word. Rows without text go first.
    """

    def run(episode: pd.DataFrame) -> pd.DataFrame:
        rows = [r for r in episode.sort_values("row_idx").itertuples() if isinstance(r.text, str) and r.text.strip()]
        out, cursor = [], 0.0
        for i, r in enumerate(rows):
            start = cursor if pd.isna(r.t) else max(float(r.t), cursor)
            after = rows[i + 1].t if i + 1 < len(rows) else None
            spoken = start + max(1, len(r.text.split())) * SECONDS_PER_WORD
            end = float(after) if after is not None and not pd.isna(after) and after > start else spoken
            out.append((r.episode_id, i, r.speaker, r.text.strip(), start, end))
            cursor = end
        return pd.DataFrame(out, columns=["episode_id", "seg_idx", "speaker", "text", "t_start", "t_end"])

    return rows.groupBy("episode_id").applyInPandas(run, "episode_id string, seg_idx int, speaker string, text string, t_start double, t_end double")


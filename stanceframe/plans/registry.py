"""Named queries over the test tables, each with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.text_udfs import html_to_text
from ..operators import charts, consensus, evaluation, extraction, identity, predicates, relations, retrieval, segments, temporal
from ..sources import jobs
from .projection import CLAIMS, EDGES, SEGMENTS, claims, edges, segments as segment_rows, table, vectors, with_

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: A moment inside the tables' month, and windows around it.
AS_OF, FROM, UNTIL = "2024-01-15 00:00:00", "2024-01-10 00:00:00", "2024-01-20 00:00:00"
SIGN = "CASE stance WHEN 'asserts' THEN 1.0 WHEN 'predicts' THEN 0.5 WHEN 'hedges' THEN 0.0 ELSE -1.0 END"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


def nine(*names: str) -> list:
    return [F.round(n, 9).alias(n) for n in names]


# bitemporal state ----------------------------------------------------------------------------------------------------
@query(with_(CLAIMS, EDGES) + f"SELECT edge_id, src_id, dst_id FROM edges WHERE valid_from <= TIMESTAMP '{AS_OF}' AND (valid_to IS NULL OR valid_to > TIMESTAMP '{AS_OF}')")
def edges_live_as_of(spark, sf_dir):
    return temporal.current_state(edges(spark, sf_dir), AS_OF).select("edge_id", "src_id", "dst_id")


@query(with_(CLAIMS, EDGES) + "SELECT edge_id, src_id, dst_id FROM edges WHERE NOT invalidated")
def edges_current_state(spark, sf_dir):
    return temporal.current_state(edges(spark, sf_dir)).select("edge_id", "src_id", "dst_id")


@query(with_(CLAIMS, EDGES) + """SELECT c.claim_id, c.speaker_id, c.subject AS subject_canonical_id, upper(c.speaker_id) AS speaker_name, CASE WHEN c.subject LIKE '%9' THEN NULL ELSE 'name ' || c.subject END AS subject_name,
  epoch(c.event_time)::BIGINT AS event_s FROM claims c JOIN edges e ON e.dst_id = c.claim_id WHERE c.stance = 'asserts' AND NOT e.invalidated""")
def claims_point_filter(spark, sf_dir):
    c = claims(spark, sf_dir).select("claim_id", F.col("stance").alias("predicate"), "speaker_id", F.col("subject").alias("subject_canonical_id"))
    speakers = c.select("speaker_id").distinct().withColumn("name", F.upper("speaker_id"))
    entities = c.select(F.col("subject_canonical_id").alias("canonical_id")).distinct().where("canonical_id not like '%9'").withColumn("canonical_name", F.concat(F.lit("name "), "canonical_id"))
    found = temporal.query_claims(c, edges(spark, sf_dir), speakers, entities, predicate="asserts")
    return found.select("claim_id", "speaker_id", "subject_canonical_id", "speaker_name", "subject_name", F.unix_seconds("event_time").alias("event_s"))


@query(with_(CLAIMS, EDGES) + f"""SELECT edge_id, epoch(CASE WHEN load_seq % 3 = 0 AND NOT invalidated THEN TIMESTAMP '{UNTIL}' ELSE valid_to END)::BIGINT AS valid_to_s, invalidated OR load_seq % 3 = 0 AS invalidated FROM edges""")
def edge_invalidate(spark, sf_dir):
    e = edges(spark, sf_dir)
    done = temporal.invalidate(e, e.where("load_seq % 3 = 0").select("edge_id"), UNTIL)
    return done.select("edge_id", F.unix_seconds("valid_to").alias("valid_to_s"), "invalidated")


@query(with_(CLAIMS, EDGES) + """, loads AS (SELECT edge_id, src_id, invalidated, load_seq FROM edges UNION ALL SELECT edge_id, 'reload', load_seq % 11 = 0, load_seq + 1000000000 FROM edges WHERE load_seq % 2 = 0)
SELECT edge_id, src_id, invalidated, load_seq FROM (SELECT *, row_number() OVER (PARTITION BY edge_id ORDER BY invalidated DESC, load_seq DESC) AS nth FROM loads) WHERE nth = 1""")
def edges_upsert_precedence(spark, sf_dir):
    e = edges(spark, sf_dir).select("edge_id", "src_id", "invalidated", "load_seq")
    again = e.where("load_seq % 2 = 0").select("edge_id", F.lit("reload").alias("src_id"), (F.col("load_seq") % 11 == 0).alias("invalidated"), (F.col("load_seq") + 1_000_000_000).alias("load_seq"))
    return temporal.upsert_edges(e, again)


@query(with_(CLAIMS) + """, rows AS (SELECT subject AS canonical_id, seq AS load_seq, unnest(['x' || (seq % 3), 'y' || (seq % 5)]) AS alias, unnest([0, 1]) AS pos, speaker_id FROM claims),
firsts AS (SELECT canonical_id, alias, min((load_seq, pos)) AS nth FROM rows GROUP BY ALL)
SELECT f.canonical_id, array_to_string(list(alias ORDER BY nth), ',') AS aliases, any_value(h.canonical_name) AS canonical_name
FROM firsts f JOIN (SELECT subject AS canonical_id, arg_min(speaker_id, seq) AS canonical_name FROM claims GROUP BY 1) h USING (canonical_id) GROUP BY 1""")
def entities_upsert(spark, sf_dir):
    c = claims(spark, sf_dir)
    e = c.select(F.col("subject").alias("canonical_id"), F.col("speaker_id").alias("canonical_name"), F.lit("concept").alias("entity_type"), F.lit(None).cast("string").alias("qid"), F.array(F.concat(F.lit("x"), (F.col("seq") % 3).cast("string")), F.concat(F.lit("y"), (F.col("seq") % 5).cast("string"))).alias("aliases"), F.col("seq").alias("load_seq"))
    return temporal.upsert_entities(e.where("load_seq % 2 = 0"), e.where("load_seq % 2 = 1")).select("canonical_id", "canonical_name", F.array_join("aliases", ",").alias("aliases"))


@query(with_(CLAIMS, EDGES) + f"SELECT edge_id FROM edges WHERE event_time BETWEEN TIMESTAMP '{FROM}' AND TIMESTAMP '{UNTIL}'")
def temporal_window_filter(spark, sf_dir):
    return edges(spark, sf_dir).where(temporal.within_event_time(FROM, UNTIL)).select("edge_id")


@query(with_(CLAIMS, EDGES) + f"SELECT edge_id FROM edges WHERE NOT (valid_from > TIMESTAMP '{UNTIL}' OR coalesce(valid_to < TIMESTAMP '{FROM}', false))")
def temporal_validity_overlap(spark, sf_dir):
    return edges(spark, sf_dir).where(temporal.overlaps_validity(FROM, UNTIL)).select("edge_id")


# consensus -----------------------------------------------------------------------------------------------------------
BUCKETS = f"""origins AS (SELECT subject, min(event_time) AS origin FROM claims GROUP BY 1),
bucketed AS (SELECT c.*, CASE WHEN confidence > 0 THEN confidence ELSE 1e-9 END AS w, {SIGN} AS sgn, ((epoch_us(event_time) - epoch_us(origin)) // (7 * 86400000000))::BIGINT AS bucket FROM claims c JOIN origins USING (subject)),
buckets AS (SELECT subject, bucket, count(*) AS claim_count, sum(w * sentiment) / sum(w) AS net_sentiment, sum(w * sgn) / sum(w) AS net_stance, count(DISTINCT speaker_id) AS n_speakers FROM bucketed GROUP BY ALL)"""


@query(with_(CLAIMS, BUCKETS) + "SELECT subject, bucket, claim_count, round(net_sentiment, 9) AS net_sentiment, round(net_stance, 9) AS net_stance, n_speakers FROM buckets")
def consensus_buckets(spark, sf_dir):
    found = consensus.consensus_buckets(claims(spark, sf_dir), 7)
    return found.select("subject", "bucket", "claim_count", *nine("net_sentiment", "net_stance"), "n_speakers")


@query(with_(CLAIMS, BUCKETS) + """, b AS (SELECT subject, bucket, round(net_sentiment, 9) AS s FROM buckets), steps AS (SELECT *, s - lag(s) OVER (PARTITION BY subject ORDER BY bucket) AS step FROM b),
a AS (SELECT subject, count(*) AS n, bool_or(step > 0.1) AS rose, bool_or(step < -0.1) AS fell, arg_max(s, bucket) - arg_min(s, bucket) AS delta FROM steps GROUP BY 1)
SELECT subject, n AS n_buckets, CASE WHEN n < 2 THEN 'insufficient' WHEN rose AND fell THEN 'mixed' WHEN abs(delta) < 0.1 THEN 'flat' WHEN delta > 0 THEN 'rising' ELSE 'falling' END AS direction, round(CASE WHEN n < 2 THEN 0.0 ELSE delta END, 9) AS sentiment_delta FROM a""")
def consensus_trend_direction(spark, sf_dir):
    buckets = consensus.consensus_buckets(claims(spark, sf_dir), 7).withColumn("net_sentiment", F.round("net_sentiment", 9))
    return consensus.trend_direction(buckets).select("subject", "n_buckets", "direction", *nine("sentiment_delta"))


@query(with_("claims0 AS (SELECT * FROM (" + CLAIMS[CLAIMS.index("(") + 1 : -1] + "))", "claims AS (SELECT * FROM claims0 WHERE subject NOT LIKE '%1' OR extract('day' FROM event_time) % 10 < 3)", BUCKETS) + """
SELECT s.subject, s.bucket, coalesce(claim_count, 0) AS claim_count, coalesce(round(net_sentiment, 9), 0) AS net_sentiment FROM (SELECT subject, unnest(range(min(bucket), max(bucket) + 1)) AS bucket FROM buckets GROUP BY subject) s LEFT JOIN buckets b USING (subject, bucket)""")
def consensus_zero_filled(spark, sf_dir):
    gaps = claims(spark, sf_dir).where("subject not like '%1' or day(event_time) % 10 < 3")
    return consensus.zero_filled(consensus.consensus_buckets(gaps, 7)).select("subject", "bucket", "claim_count", *nine("net_sentiment"))


@query(with_(CLAIMS, BUCKETS) + """SELECT b.subject, b.bucket, o.speaker_id, o.claim_count, round(o.m, 9) AS mean_sentiment, round(b.net_stance, 9) AS net_stance FROM (SELECT subject, bucket, speaker_id, count(*) AS claim_count, avg(sentiment) AS m FROM bucketed GROUP BY ALL) o JOIN buckets b USING (subject, bucket)""")
def belief_history(spark, sf_dir):
    found = consensus.belief_history(claims(spark, sf_dir), 7)
    return found.select("subject", "bucket", "speaker_id", "claim_count", *nine("mean_sentiment", "net_stance"))


@query(with_(CLAIMS, BUCKETS) + """, h AS (SELECT subject, bucket, speaker_id, round(avg(sentiment), 9) AS m FROM bucketed GROUP BY ALL), d AS (SELECT speaker_id, subject, arg_max(m, bucket) - arg_min(m, bucket) AS delta FROM h GROUP BY ALL)
SELECT speaker_id, subject, CASE WHEN delta > 0.1 THEN 'rising' WHEN delta < -0.1 THEN 'falling' ELSE 'flat' END AS direction FROM d""")
def belief_direction(spark, sf_dir):
    history = consensus.bucket_speakers(claims(spark, sf_dir), 7).withColumn("mean_sentiment", F.round("mean_sentiment", 9))
    return consensus.belief_direction(history).select("speaker_id", "subject", "direction")


@query(with_(CLAIMS, BUCKETS) + """SELECT subject, bucket, speaker_id, row_number() OVER (PARTITION BY subject, bucket ORDER BY t, s) AS position FROM (SELECT subject, bucket, speaker_id, min((event_time, seq))[1] AS t, min((event_time, seq))[2] AS s FROM bucketed GROUP BY ALL)""")
def bucket_speaker_order(spark, sf_dir):
    return consensus.bucket_speakers(claims(spark, sf_dir), 7).select("subject", "bucket", "speaker_id", F.col("position").cast("bigint").alias("position"))


@query(with_(CLAIMS) + "SELECT subject, count(*) AS n_claims FROM claims GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1")
def most_claimed_subject(spark, sf_dir):
    return consensus.most_claimed_subject(claims(spark, sf_dir))


@query(with_(CLAIMS) + """, hits AS (SELECT claim_id, speaker_id, row_number() OVER (ORDER BY sentiment DESC, claim_id) AS rank FROM claims)
SELECT speaker_id, min(rank) AS rank, arg_min(claim_id, rank) AS claim_id FROM hits WHERE rank <= 25 GROUP BY 1""")
def who_discussed(spark, sf_dir):
    top = claims(spark, sf_dir).orderBy(F.desc("sentiment"), "claim_id").limit(25)
    from pyspark.sql import Window

    hits = top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("sentiment"), "claim_id")).cast("bigint"))
    return consensus.who_discussed(hits)


# relations -----------------------------------------------------------------------------------------------------------
POLAR = f"""polar AS (SELECT claim_id, subject, speaker_id, event_time, sign({SIGN} * CASE WHEN sentiment = 0 THEN 1 ELSE abs(sentiment) END)::INTEGER AS sign FROM claims)"""
STANCE = """f AS (SELECT subject, speaker_id, sign, min((claim_id, event_time)) AS c FROM polar WHERE sign <> 0 GROUP BY ALL),
p AS (SELECT a.subject, a.speaker_id AS sa, b.speaker_id AS sb, a.sign = b.sign AS same, least(a.c, b.c) AS x, greatest(a.c, b.c) AS y FROM f a JOIN f b ON a.subject = b.subject AND a.speaker_id < b.speaker_id),
one AS (SELECT subject, sa, sb, same, min((x, y)) AS q FROM p GROUP BY ALL),
stance_edges AS (SELECT subject, CASE WHEN same THEN 'agrees_with' ELSE 'disputes' END AS type, CASE WHEN q[1][2] > q[2][2] THEN q[1][1] ELSE q[2][1] END AS src_id, CASE WHEN q[1][2] > q[2][2] THEN q[2][1] ELSE q[1][1] END AS dst_id FROM one)"""
SUPERSEDES = """l AS (SELECT *, lag(sign) OVER w AS before, lag(claim_id) OVER w AS dst_id FROM polar WINDOW w AS (PARTITION BY speaker_id, subject ORDER BY event_time, claim_id)),
supersedes AS (SELECT subject, 'supersedes' AS type, claim_id AS src_id, dst_id FROM l WHERE sign <> 0 AND before <> 0 AND sign <> before)"""


@query(with_(CLAIMS, POLAR, STANCE) + "SELECT subject, type, src_id, dst_id FROM stance_edges")
def stance_edges(spark, sf_dir):
    return relations.stance_edges(claims(spark, sf_dir)).select("subject", "type", "src_id", "dst_id")


@query(with_(CLAIMS, POLAR, SUPERSEDES) + "SELECT subject, type, src_id, dst_id FROM supersedes")
def supersession_edges(spark, sf_dir):
    return relations.supersession_edges(claims(spark, sf_dir)).select("subject", "type", "src_id", "dst_id")


@query(with_(CLAIMS) + "SELECT DISTINCT claim_id AS src_id, 'ent-' || k AS dst_id FROM (SELECT claim_id, subject, unnest([seq % 97, seq % 89, seq % 97]) AS k FROM claims) WHERE 'ent-' || k <> subject")
def mention_edges(spark, sf_dir):
    c = claims(spark, sf_dir)
    others = c.select("claim_id", F.explode(F.array(F.col("seq") % 97, F.col("seq") % 89, F.col("seq") % 97)).alias("k")).select("claim_id", F.concat(F.lit("ent-"), F.col("k").cast("string")).alias("canonical_id"))
    return relations.mention_edges(c, others).select("src_id", "dst_id")


@query(with_(CLAIMS, POLAR, STANCE, SUPERSEDES) + "SELECT DISTINCT type, src_id, dst_id FROM (SELECT type, src_id, dst_id FROM stance_edges UNION ALL SELECT type, src_id, dst_id FROM supersedes)")
def derived_edges_all(spark, sf_dir):
    return relations.derived_edges(claims(spark, sf_dir)).select("type", "src_id", "dst_id")


@query(with_(CLAIMS) + """SELECT type, count(*) AS n, count(DISTINCT src_id) AS n_src, count(DISTINCT dst_id) AS n_dst FROM (SELECT 'asserts' AS type, speaker_id AS src_id, claim_id AS dst_id FROM claims UNION SELECT 'about', claim_id, subject FROM claims UNION SELECT 'appears_in', claim_id, episode_id FROM claims) GROUP BY 1""")
def asserted_edges(spark, sf_dir):
    e = relations.asserted_edges(claims(spark, sf_dir))
    return e.groupBy("type").agg(F.count_distinct("edge_id").alias("n"), F.count_distinct("src_id").alias("n_src"), F.count_distinct("dst_id").alias("n_dst"))


@query(with_(CLAIMS, EDGES) + "SELECT DISTINCT * FROM (SELECT src_id AS id, dst_id AS neighbour FROM edges WHERE NOT invalidated UNION ALL SELECT dst_id, src_id FROM edges WHERE NOT invalidated)")
def adjacency(spark, sf_dir):
    return relations.adjacency(edges(spark, sf_dir))


@query(with_(CLAIMS) + "SELECT claim_id, 'claim-' || left(sha1(concat_ws(chr(31), speaker_id, stance, subject, '', episode_id)), 16) AS content_id FROM claims")
def content_ids(spark, sf_dir):
    return claims(spark, sf_dir).select("claim_id", S.content_id("claim", "speaker_id", "stance", "subject", F.lit(""), "episode_id").alias("content_id"))


# segments ------------------------------------------------------------------------------------------------------------
TALK = "talk AS (SELECT episode_id, speaker, sum(greatest(0, t_end - t_start)) AS seconds FROM segments GROUP BY ALL)"


@query(with_(SEGMENTS, TALK) + "SELECT episode_id, speaker, round(seconds, 9) AS seconds, round(seconds / sum(seconds) OVER (PARTITION BY episode_id), 9) AS share FROM talk")
def talk_time_share(spark, sf_dir):
    return segments.talk_time(segment_rows(spark, sf_dir)).select("episode_id", "speaker", *nine("seconds", "share"))


@query(with_(SEGMENTS, TALK) + "SELECT s.episode_id, s.seg_idx, s.speaker FROM segments s JOIN (SELECT *, seconds / sum(seconds) OVER (PARTITION BY episode_id) AS share FROM talk) USING (episode_id, speaker) WHERE share >= 0.45")
def talk_time_prune(spark, sf_dir):
    return segments.prune_low_talk_time(segment_rows(spark, sf_dir), 0.45).select("episode_id", "seg_idx", "speaker")


@query(with_(SEGMENTS) + """, c AS (SELECT *, (seg_idx // 3)::INTEGER AS chunk_index FROM segments), t AS (SELECT episode_id, chunk_index, speaker, sum(greatest(0, t_end - t_start)) AS s FROM c GROUP BY ALL)
SELECT c.episode_id, c.chunk_index, string_agg(text, ' ' ORDER BY seg_idx) AS text, min(t_start) AS t_start, max(t_end) AS t_end, any_value(d.speaker) AS speaker
FROM c JOIN (SELECT episode_id, chunk_index, speaker FROM (SELECT *, row_number() OVER (PARTITION BY episode_id, chunk_index ORDER BY s DESC, speaker) AS nth FROM t) WHERE nth = 1) d USING (episode_id, chunk_index) GROUP BY 1, 2""")
def naive_chunks_dominant_speaker(spark, sf_dir):
    return segments.fixed_chunks(segment_rows(spark, sf_dir), 3).select("episode_id", "chunk_index", "text", "t_start", "t_end", "speaker")


@query(with_(SEGMENTS) + """, w AS (SELECT episode_id, seg_idx, greatest(1, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> ''))) AS words FROM segments), e AS (SELECT *, sum(words) OVER (PARTITION BY episode_id ORDER BY seg_idx) AS ends FROM w)
SELECT episode_id, seg_idx, round((ends - words) * 0.4::DOUBLE, 9) AS t_start, round(ends * 0.4::DOUBLE, 9) AS t_end FROM e""")
def synthesized_spans(spark, sf_dir):
    return segments.synthesize_spans(segment_rows(spark, sf_dir)).select("episode_id", "seg_idx", *nine("t_start", "t_end"))


@query(with_(SEGMENTS) + """, s AS (SELECT *, CASE WHEN seg_idx % 3 = 0 THEN 'user' ELSE speaker END AS spk FROM segments WHERE trim(text) <> ''), n AS (SELECT *, CASE WHEN lag(spk) OVER w = spk THEN 0 ELSE 1 END AS fresh FROM s WINDOW w AS (PARTITION BY episode_id ORDER BY seg_idx)),
t AS (SELECT *, sum(fresh) OVER (PARTITION BY episode_id ORDER BY seg_idx)::BIGINT AS turn FROM n) SELECT episode_id, turn, spk AS speaker, count(*) AS n_segments, min(t_start) AS t_start, max(t_end) AS t_end FROM t GROUP BY ALL""")
def adjacent_turn_merge(spark, sf_dir):
    s = segment_rows(spark, sf_dir).withColumn("speaker", F.when(F.col("seg_idx") % 3 == 0, "user").otherwise(F.col("speaker")))
    return segments.merge_adjacent(s).select("episode_id", "turn", "speaker", "n_segments", "t_start", "t_end")


SPANS = "spans AS (SELECT episode_id || '#' || seg_idx AS citation_id, episode_id, t_start + 3 AS s_start, t_end + 2.5 AS s_end, CASE WHEN seg_idx % 4 = 0 THEN 'id-user' ELSE 'id-assistant' END AS cited_speaker FROM segments)"


def _spans(spark, sf_dir):
    return segment_rows(spark, sf_dir).select(F.concat_ws("#", "episode_id", "seg_idx").alias("citation_id"), "episode_id", (F.col("t_start") + 3).alias("s_start"), (F.col("t_end") + 2.5).alias("s_end"), F.when(F.col("seg_idx") % 4 == 0, "id-user").otherwise("id-assistant").alias("cited_speaker"))


@query(with_(SEGMENTS, SPANS) + """, o AS (SELECT s.citation_id, s.cited_speaker, g.seg_idx, g.speaker, least(s.s_end, g.t_end) - greatest(s.s_start, g.t_start) AS seconds FROM spans s JOIN segments g USING (episode_id)),
b AS (SELECT *, row_number() OVER (PARTITION BY citation_id ORDER BY seconds DESC, seg_idx) AS nth FROM o WHERE seconds > 0)
SELECT s.citation_id, b.seg_idx, CASE WHEN b.seg_idx IS NULL THEN 'no_overlap' WHEN b.seg_idx % 7 = 6 THEN 'unresolved_speaker' WHEN 'id-' || b.speaker <> s.cited_speaker THEN 'wrong_speaker' ELSE 'verified' END AS reason FROM spans s LEFT JOIN b ON b.citation_id = s.citation_id AND nth = 1""")
def citation_verification(spark, sf_dir):
    g = segment_rows(spark, sf_dir)
    speakers = g.where("seg_idx % 7 <> 6").select("episode_id", "seg_idx", F.concat(F.lit("id-"), "speaker").alias("speaker_id"))
    return segments.verify_citations(_spans(spark, sf_dir), g, speakers).select("citation_id", "seg_idx", "reason")


@query(with_(SEGMENTS, SPANS) + """SELECT s.citation_id, min(g.seg_idx) AS seg_idx FROM spans s LEFT JOIN segments g ON g.episode_id = s.episode_id AND s.s_start + 1 >= g.t_start - 0.05 AND s.s_start + 2 <= g.t_end + 0.05 GROUP BY 1""")
def span_containment(spark, sf_dir):
    s = _spans(spark, sf_dir).select("citation_id", "episode_id", (F.col("s_start") + 2).alias("s_end"), (F.col("s_start") + 1).alias("s_start"))
    return segments.containing_segment(s, segment_rows(spark, sf_dir), "citation_id").select("citation_id", "seg_idx")


@query(with_(SEGMENTS) + """, h AS (SELECT a.episode_id, greatest(a.t_start, b.t_start) AS lo, least(a.t_end, b.t_end) AS hi FROM segments a JOIN segments b ON a.episode_id = b.episode_id AND a.speaker < b.speaker),
k AS (SELECT * FROM h WHERE hi > lo), n AS (SELECT *, CASE WHEN lo <= max(hi) OVER (PARTITION BY episode_id ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM k),
i AS (SELECT *, sum(fresh) OVER (PARTITION BY episode_id ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS island FROM n) SELECT episode_id, island::BIGINT AS island, min(lo) AS lo, max(hi) AS hi FROM i GROUP BY ALL""")
def crosstalk_islands(spark, sf_dir):
    return segments.crosstalk(segment_rows(spark, sf_dir)).select("episode_id", "island", "lo", "hi")


WORDS = "words AS (SELECT episode_id, seg_idx AS word_idx, t_start + 4.6 AS w_start, t_start + 5.2 AS w_end FROM segments)"


@query(with_(SEGMENTS, WORDS) + """, o AS (SELECT w.episode_id, w.word_idx, g.speaker, g.t_start, g.t_end, greatest(0, least(w_end, g.t_end) - greatest(w_start, g.t_start)) AS seconds, greatest(0, g.t_start - (w_start + w_end) / 2, (w_start + w_end) / 2 - g.t_end) AS gap FROM words w JOIN segments g USING (episode_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY episode_id, word_idx ORDER BY -seconds, CASE WHEN seconds > 0 THEN 0 ELSE gap END, t_start, t_end, speaker) AS nth FROM o) SELECT w.episode_id, w.word_idx, coalesce(r.speaker, 'SPEAKER_00') AS speaker FROM words w LEFT JOIN r ON r.episode_id = w.episode_id AND r.word_idx = w.word_idx AND nth = 1""")
def word_to_turn_overlap(spark, sf_dir):
    g = segment_rows(spark, sf_dir)
    words = g.select("episode_id", F.col("seg_idx").alias("word_idx"), (F.col("t_start") + 4.6).alias("w_start"), (F.col("t_start") + 5.2).alias("w_end"))
    return segments.words_to_speakers(words, g).select("episode_id", "word_idx", "speaker")


@query()
def resegmented_words(spark, sf_dir):
    w = segment_rows(spark, sf_dir).select("episode_id", "speaker", F.posexplode(F.split("text", " ")).alias("i", "text"), "seg_idx")
    words = w.select("episode_id", (F.col("seg_idx") * 10_000 + F.col("i")).cast("int").alias("word_idx"), "text", (F.col("seg_idx") * 5 + F.col("i") * 0.1).alias("t_start"), (F.col("seg_idx") * 5 + F.col("i") * 0.1 + 0.1).alias("t_end"), "speaker")
    return segments.resegment(words)


# retrieval -----------------------------------------------------------------------------------------------------------
PROBE = [float((i % 5) - 2) for i in range(64)]
PROBE_SQL = f"{PROBE}::DOUBLE[64]"


@query(f"""SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], {PROBE}::DOUBLE[]), 9) AS score FROM embeddings ORDER BY list_cosine_similarity(embedding::DOUBLE[], {PROBE}::DOUBLE[]) DESC, vec_id LIMIT 20""")
def cosine_topk(spark, sf_dir):
    return retrieval.cosine_topk(vectors(spark, sf_dir), PROBE, 20, id_col="vec_id").select("vec_id", *nine("score"))


@query("""WITH m AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 100 = 0), s AS (SELECT m.vec_id AS mention_id, e.vec_id, list_cosine_similarity(m.v, e.embedding::DOUBLE[]) AS score FROM m JOIN embeddings e ON e.label = m.label)
SELECT mention_id, vec_id, rank, round(score, 9) AS score FROM (SELECT *, row_number() OVER (PARTITION BY mention_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5""")
def candidates_topk_by_type(spark, sf_dir):
    v = vectors(spark, sf_dir)
    mentions = v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("mention_id"), F.col("label").alias("entity_type"), F.col("embedding").alias("vector"))
    entities = v.select("vec_id", F.col("label").alias("entity_type"), "embedding", F.col("vec_id").alias("insert_seq"))
    return retrieval.topk_by_type(mentions, entities, 5).select("mention_id", "vec_id", F.col("rank").cast("bigint").alias("rank"), *nine("score"))


DOCS = "docs AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS words FROM documents)"
QUESTIONS = "questions AS (SELECT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM benchmark)"
SCORES = """n AS (SELECT count(*) AS n_docs, avg(len(words)) AS avgdl FROM docs), p AS (SELECT doc_id, len(words) AS length, unnest(words) AS term FROM docs),
tf AS (SELECT doc_id, length, term, count(*) AS tf FROM p GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1), q AS (SELECT query_id, term, count(*) AS qtf FROM questions GROUP BY ALL),
scores AS (SELECT query_id, doc_id, sum(qtf * greatest(0, ln((n_docs - df + 0.5) / (df + 0.5) + 1)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / avgdl))) AS score FROM tf JOIN df USING (term) JOIN q USING (term) CROSS JOIN n GROUP BY ALL)"""


@query(with_(DOCS, QUESTIONS, SCORES) + "SELECT query_id, doc_id, round(score, 9) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM scores) WHERE rank <= 10")
def bm25_topk(spark, sf_dir):
    from pyspark.sql import Window

    docs = table(spark, sf_dir, "documents")
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    scored = retrieval.bm25(docs, asked, id_col="doc_id", top=10).select("query_id", F.col("id").alias("doc_id"), *nine("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return scored.withColumn("rank", F.row_number().over(order).cast("bigint")).where("rank <= 10")


@query(with_(CLAIMS) + """, a AS (SELECT claim_id AS id, row_number() OVER (ORDER BY sentiment DESC, claim_id) AS rank FROM claims), b AS (SELECT claim_id AS id, row_number() OVER (ORDER BY confidence DESC, claim_id) AS rank FROM claims)
SELECT id, round(sum(s), 9) AS score FROM (SELECT id, 1.0 / (60 + rank) AS s FROM a WHERE rank <= 200 UNION ALL SELECT id, 0.5 / (60 + rank) FROM b WHERE rank <= 200) GROUP BY 1""")
def rrf_fusion(spark, sf_dir):
    from pyspark.sql import Window

    c = claims(spark, sf_dir)
    lists = [c.orderBy(F.desc(x), "claim_id").limit(200).select(F.col("claim_id").alias("id"), F.row_number().over(Window.orderBy(F.desc(x), "claim_id")).alias("rank")) for x in ("sentiment", "confidence")]
    return retrieval.fuse(lists, weights=[1.0, 0.5]).select("id", *nine("score"))


LINKS = "links AS (SELECT DISTINCT o_custkey AS id, o_orderkey % 1000 AS neighbour FROM orders)"


@query(with_(LINKS) + """, g AS (SELECT id, neighbour FROM links UNION SELECT neighbour, id FROM links), h1 AS (SELECT DISTINCT neighbour AS id FROM g WHERE id IN (1, 2)),
r1 AS (SELECT id FROM h1 WHERE id NOT IN (1, 2)), h2 AS (SELECT DISTINCT neighbour AS id FROM g WHERE id IN (SELECT id FROM r1)) SELECT unnest([1, 2])::BIGINT AS id, 0 AS hop UNION ALL SELECT id, 1 FROM r1 UNION ALL SELECT id, 2 FROM h2 WHERE id NOT IN (1, 2) AND id NOT IN (SELECT id FROM r1)""")
def bfs_hops(spark, sf_dir):
    one = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), (F.col("o_orderkey") % 1000).alias("neighbour")).distinct()
    both = one.union(one.select("neighbour", "id")).distinct()
    return retrieval.graph_distance(spark.range(1, 3), both, 2)


@query()
def hybrid_search(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").join(vectors(spark, sf_dir), F.col("doc_id") == F.col("vec_id"), "left").select(F.col("doc_id").alias("claim_id"), "text", "embedding")
    near = vectors(spark, sf_dir).select(F.col("vec_id").alias("id"), (F.col("vec_id") + 1).alias("neighbour"))
    return retrieval.hybrid(docs, near, "the and thing of", PROBE, top_k=20)


@query("SELECT doc_id AS claim_id FROM documents WHERE instr(lower(text), 'the than') > 0 ORDER BY doc_id LIMIT 1")
def provenance_lookup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("claim_id"), "text")
    return _provenance(docs)


def _provenance(docs):
    text_ids = docs.select(F.lpad(F.col("claim_id").cast("string"), 12, "0").alias("claim_id"), "text")
    return retrieval.provenance(text_ids, " The Than ").select(F.col("claim_id").cast("bigint").alias("claim_id"))


@query(with_(CLAIMS) + "SELECT subject, count(*) AS count FROM (SELECT * FROM claims ORDER BY sentiment DESC, claim_id LIMIT 50) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1")
def dominant_subject(spark, sf_dir):
    return retrieval.dominant_subject(claims(spark, sf_dir).orderBy(F.desc("sentiment"), "claim_id").limit(50))


# identity ------------------------------------------------------------------------------------------------------------
@query("""WITH m AS (SELECT p_partkey AS mention_id, p_name AS name FROM part), e AS (SELECT lower(p_name) AS k, min(p_partkey) AS canonical_id FROM part GROUP BY 1) SELECT mention_id, canonical_id FROM m JOIN e ON lower(m.name) = e.k""")
def exact_name_match(spark, sf_dir):
    parts = table(spark, sf_dir, "part")
    mentions = parts.select(F.col("p_partkey").alias("mention_id"), F.upper("p_name").alias("name"), F.lit("concept").alias("entity_type"))
    entities = parts.select(F.col("p_partkey").alias("canonical_id"), F.col("p_name").alias("canonical_name"), F.lit("concept").alias("entity_type"), F.lit(None).cast("array<string>").alias("aliases"), F.col("p_partkey").alias("insert_seq"))
    return identity.exact_matches(mentions, entities)


GALLERY = """g AS (SELECT label AS host_id, i, avg(x) AS x FROM (SELECT label, unnest(embedding::DOUBLE[]) AS x, unnest(range(64)) AS i FROM embeddings WHERE vec_id % 2 = 0) GROUP BY ALL), hosts AS (SELECT host_id, list(x ORDER BY i) AS c FROM g GROUP BY 1),
s AS (SELECT e.vec_id AS voice_id, h.host_id, list_cosine_similarity(e.embedding::DOUBLE[], h.c) AS score FROM embeddings e CROSS JOIN hosts h WHERE e.vec_id % 2 = 1)"""


@query(with_(GALLERY) + """, r AS (SELECT *, row_number() OVER (PARTITION BY voice_id ORDER BY score DESC, host_id DESC) AS nth FROM s) SELECT a.voice_id, CASE WHEN a.score >= 0.2 AND a.score - b.score >= 0.05 THEN a.host_id END AS host_id, round(a.score, 9) AS score FROM r a LEFT JOIN r b ON a.voice_id = b.voice_id AND b.nth = 2 WHERE a.nth = 1""")
def gallery_match_margin(spark, sf_dir):
    v = vectors(spark, sf_dir)
    hosts = identity.gallery(v.where("vec_id % 2 = 0").select(F.col("label").alias("host_id"), F.col("embedding").alias("vector")))
    return identity.match_voices(v.where("vec_id % 2 = 1").select(F.col("vec_id").alias("voice_id"), F.col("embedding").alias("vector")), hosts, 0.2, 0.05).select("voice_id", "host_id", *nine("score"))


@query("""WITH a AS (SELECT o_orderkey AS seq, 'ep-' || (o_orderkey % 50) AS episode_id, 'Guest ' || (o_custkey % 30) AS name FROM orders) SELECT lower(name) AS key, count(DISTINCT episode_id) AS n_episodes, arg_min(name, seq) AS name, 'guest-' || trim(regexp_replace(lower(arg_min(name, seq)), '[^a-z0-9]+', '-', 'g'), '-') AS guest_id FROM a GROUP BY 1 HAVING count(DISTINCT episode_id) >= 2""")
def recurring_guests(spark, sf_dir):
    a = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("seq"), F.concat(F.lit("ep-"), (F.col("o_orderkey") % 50).cast("string")).alias("episode_id"), F.concat(F.lit("Guest "), (F.col("o_custkey") % 30).cast("string")).alias("name"), F.lit(False).alias("from_metadata"))
    return identity.recurring_guests(a)


@query("""WITH n AS (SELECT s_suppkey AS seq, 'Name ' || (s_suppkey % 40) AS name, CASE WHEN s_suppkey % 4 = 0 THEN 'Q' || (s_suppkey % 20) END AS qid FROM supplier) SELECT coalesce('spk-wd-' || qid, 'spk-' || left(sha1(lower(name)), 10)) AS speaker_id, arg_min(name, seq) AS display_name, max(qid) AS qid FROM n GROUP BY 1""")
def canonical_speakers(spark, sf_dir):
    k = F.col("s_suppkey")
    n = table(spark, sf_dir, "supplier").select(k.alias("seq"), F.concat(F.lit("Name "), (k % 40).cast("string")).alias("name"), F.when(k % 4 == 0, F.concat(F.lit("Q"), (k % 20).cast("string"))).alias("qid"))
    return identity.canonical_speakers(n)


@query()
def greedy_clusters(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return identity.cluster_forms(v.select(F.concat(F.lit("type"), F.col("label").cast("string")).alias("entity_type"), F.concat(F.lit("form "), F.col("vec_id").cast("string")).alias("form"), F.col("embedding").alias("vector")))


# charts, manifests, jobs ---------------------------------------------------------------------------------------------
CHART = "chart AS (SELECT 'show-' || (p_partkey % 60) AS show_id, 'feed-' || (p_partkey % 60) AS feed_url, 'domain-' || (p_size % 8) AS domain, p_partkey AS rank, (floor(p_retailprice)::INTEGER % 13)::DOUBLE AS episodes_per_month, (p_size % 4)::BIGINT AS recent_count, p_partkey AS seq FROM part)"


def _chart(spark, sf_dir):
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(F.concat(F.lit("show-"), (k % 60).cast("string")).alias("show_id"), F.concat(F.lit("feed-"), (k % 60).cast("string")).alias("feed_url"), F.concat(F.lit("domain-"), (F.col("p_size") % 8).cast("string")).alias("domain"), k.alias("rank"), (F.floor("p_retailprice").cast("int") % 13).cast("double").alias("episodes_per_month"), (F.col("p_size") % 4).cast("bigint").alias("recent_count"), k.alias("seq"))


@query(with_(CHART) + """, best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY show_id ORDER BY episodes_per_month DESC, recent_count DESC, seq) AS nth FROM chart) WHERE nth = 1), r AS (SELECT *, row_number() OVER (ORDER BY episodes_per_month DESC, recent_count DESC, rank, show_id) AS place FROM best),
n AS (SELECT count(*) FILTER (WHERE episodes_per_month > 0 OR recent_count > 0) AS signal FROM r) SELECT show_id FROM r, n WHERE place <= least(25, greatest(15, signal))""")
def velocity_subset_topk(spark, sf_dir):
    return charts.high_velocity(_chart(spark, sf_dir)).select("show_id")


@query(with_(CHART) + """, f AS (SELECT show_id, domain, min(seq) AS nth FROM chart GROUP BY ALL) SELECT show_id, array_to_string(list(domain ORDER BY nth), ',') AS domains, (SELECT arg_min(feed_url, seq) FROM chart c WHERE c.show_id = f.show_id) AS feed_url FROM f GROUP BY show_id""")
def manifest_merge(spark, sf_dir):
    return charts.merge_shows(_chart(spark, sf_dir)).select("show_id", F.array_join("domains", ",").alias("domains"), "feed_url")


@query(with_(CHART) + "SELECT domain, show_id, rank FROM (SELECT domain, show_id, row_number() OVER (PARTITION BY domain ORDER BY seq) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY domain, feed_url ORDER BY seq) AS nth FROM chart) WHERE nth = 1) WHERE rank <= 10")
def chart_ranking(spark, sf_dir):
    return charts.rank_feeds(_chart(spark, sf_dir), 10).select("domain", "show_id", F.col("rank").cast("bigint").alias("rank"))


@query("SELECT s.status, count(j.status) AS n FROM (SELECT unnest(['queued', 'leased', 'done', 'failed']) AS status) s LEFT JOIN (SELECT CASE o_orderstatus WHEN 'O' THEN 'queued' WHEN 'F' THEN 'done' ELSE 'leased' END AS status FROM orders) j USING (status) GROUP BY 1")
def queue_status_counts(spark, sf_dir):
    status = F.when(F.col("o_orderstatus") == "O", "queued").when(F.col("o_orderstatus") == "F", "done").otherwise("leased")
    return jobs.status_counts(table(spark, sf_dir, "orders").select(status.alias("status")))


@query("SELECT 'guid-' || (event_id % 700) AS guid, min(event_id) AS seq FROM events WHERE event_id % 700 >= 50 GROUP BY 1")
def guid_dedupe(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.concat(F.lit("guid-"), (F.col("event_id") % 700).cast("string")).alias("guid"), F.col("event_id").alias("seq"))
    known = spark.range(50).select(F.concat(F.lit("guid-"), F.col("id").cast("string")).alias("guid"))
    return jobs.new_items(e, known, "guid").select("guid", "seq")


@query("SELECT doc_id, sha256(text) AS content_hash, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) > 1 AS deduped FROM documents")
def content_hash_dedupe(spark, sf_dir):
    return jobs.content_dedupe(table(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("binary").alias("content")), "doc_id").select("doc_id", "content_hash", "deduped")


# evaluation ----------------------------------------------------------------------------------------------------------
ARMS = "arms AS (SELECT unnest(['alone', 'search', 'rag', 'graph']) AS arm)"
RUBRIC = """weights AS (SELECT unnest(['accuracy', 'attribution', 'coverage', 'clarity', 'brevity']) AS dimension, unnest([2.0, 3.0, 2.0, 1.0, 1.0])::DOUBLE AS weight),
scores AS (SELECT o_orderkey // 5 AS query_id, ['alone', 'search', 'rag'][1 + o_custkey % 3] AS arm, ['accuracy', 'attribution', 'coverage', 'clarity', 'brevity'][1 + o_orderkey % 5] AS dimension, avg((o_custkey % 10) / 10.0::DOUBLE) AS raw FROM orders GROUP BY ALL),
totals AS (SELECT a.query_id, a.arm, round(sum(weight * coalesce(CASE WHEN dimension = 'attribution' THEN least(coalesce(raw, 0), 0.5) ELSE raw END, 0)) / sum(weight), 9) AS total FROM (SELECT DISTINCT query_id, arm FROM scores) a CROSS JOIN weights LEFT JOIN scores USING (query_id, arm, dimension) GROUP BY ALL)"""


def _totals(spark, sf_dir):
    name = lambda names, i: F.element_at(F.array(*[F.lit(n) for n in names]), (i + 1).cast("int"))
    dims = ["accuracy", "attribution", "coverage", "clarity", "brevity"]
    o = table(spark, sf_dir, "orders")
    scores = o.groupBy(F.expr("o_orderkey div 5").alias("query_id"), name(["alone", "search", "rag"], F.col("o_custkey") % 3).alias("arm"), name(dims, F.col("o_orderkey") % 5).alias("dimension")).agg(F.avg((F.col("o_custkey") % 10) / 10.0).alias("raw"))
    weights = spark.createDataFrame(list(zip(dims, [2.0, 3.0, 2.0, 1.0, 1.0], strict=True)), "dimension string, weight double")
    citations = scores.select("query_id", "arm").distinct().select("query_id", "arm", F.explode(F.array(F.lit(True), F.lit(False))).alias("verified"))
    return evaluation.rubric_totals(scores, weights, citations).select("query_id", "arm", *nine("total"))


def _arms(spark):
    return spark.createDataFrame([("alone",), ("search",), ("rag",), ("graph",)], "arm string")


@query(with_(RUBRIC) + "SELECT query_id, arm, total FROM totals")
def rubric_totals(spark, sf_dir):
    return _totals(spark, sf_dir)


@query(with_(RUBRIC, ARMS) + "SELECT arm, round(coalesce(avg(total), 0), 9) AS mean_total FROM arms LEFT JOIN totals USING (arm) GROUP BY 1")
def mean_totals(spark, sf_dir):
    return evaluation.mean_totals(_totals(spark, sf_dir), _arms(spark)).select("arm", *nine("mean_total"))


@query(with_(RUBRIC, ARMS) + ", top AS (SELECT query_id, max(total) AS m FROM totals GROUP BY 1), w AS (SELECT query_id, min(arm) AS arm FROM totals JOIN top USING (query_id) WHERE total = m GROUP BY 1 HAVING count(*) = 1) SELECT arm, count(w.query_id) AS wins FROM arms LEFT JOIN w USING (arm) GROUP BY 1")
def strict_wins(spark, sf_dir):
    return evaluation.strict_wins(_totals(spark, sf_dir), _arms(spark))


@query("""WITH r AS (SELECT quality AS a, 1 - toxic AS b FROM labels), n AS (SELECT count(*) AS n, avg((a = b)::INTEGER) AS po FROM r), pe AS (SELECT sum(x.c * y.c)::DOUBLE AS chance FROM (SELECT a AS l, count(*) AS c FROM r GROUP BY 1) x JOIN (SELECT b AS l, count(*) AS c FROM r GROUP BY 1) y USING (l))
SELECT n, round(po, 9) AS agreement, round((po - chance / n / n) / (1 - chance / n / n), 9) AS kappa FROM n, pe""")
def kappa(spark, sf_dir):
    r = table(spark, sf_dir, "labels").select(F.col("quality").alias("a"), (1 - F.col("toxic")).alias("b"))
    return evaluation.kappa(r).select("n", *nine("agreement", "kappa"))


@query("""WITH nodes AS (SELECT c_custkey AS canonical_id, lower(c_mktsegment) AS name, 'Q' || (c_custkey % 7) AS qid FROM customer), probes AS (SELECT unnest(['BUILDING', 'machinery.', 'nothing']) AS probe, unnest(['Q1', NULL, NULL]) AS qid)
SELECT p.probe, count(DISTINCT n.canonical_id) AS fragments FROM probes p LEFT JOIN nodes n ON n.qid = p.qid OR n.name = rtrim(lower(p.probe), '.') GROUP BY 1""")
def fragmentation(spark, sf_dir):
    nodes = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("canonical_id"), F.col("c_mktsegment").alias("name"), F.lit(None).cast("array<string>").alias("aliases"), F.concat(F.lit("Q"), (F.col("c_custkey") % 7).cast("string")).alias("qid"))
    probes = spark.createDataFrame([("BUILDING", None, "Q1"), ("machinery.", None, None), ("nothing", None, None)], "probe string, aliases array<string>, qid string")
    return evaluation.fragmentation(nodes, probes)


# scalars and text ----------------------------------------------------------------------------------------------------
@query("""SELECT conv_id, turn, CASE WHEN f = '' THEN NULL ELSE list_sum(list_transform(list_reverse(string_split(f, ':')), lambda x, i: x::DOUBLE * 60 ** (i - 1))) END AS seconds FROM (SELECT conv_id, turn, regexp_extract('said [' || turn || ':' || lpad((conv_id % 60)::VARCHAR, 2, '0') || CASE WHEN conv_id % 2 = 0 THEN ':07.5' ELSE '' END || '] x', '(\\d+:)?\\d{1,2}:\\d{2}(\\.\\d+)?') AS f FROM conversations)""")
def parse_hms(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    text = F.concat(F.lit("said ["), F.col("turn").cast("string"), F.lit(":"), F.lpad((F.col("conv_id") % 60).cast("string"), 2, "0"), F.when(F.col("conv_id") % 2 == 0, ":07.5").otherwise(""), F.lit("] x"))
    return c.select("conv_id", "turn", S.parse_hms(text).alias("seconds"))


@query("""SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace('[x] (Laughs loudly) ' || text, '\\[[^\\]]*\\]', ' ', 'g'), '\\(\\s*(laughs?|laughing|laughter|music|applause|crosstalk|inaudible|unintelligible|sighs?|pause|silence|noise|chuckles?|coughs?)[^)]*\\)', ' ', 'gi'), '\\s+', ' ', 'g')) AS text FROM documents""")
def clean_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", S.clean_text(F.concat(F.lit("[x] (Laughs loudly) "), "text")).alias("text"))


@query("""WITH t AS (SELECT conv_id, turn, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS x, lag(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) OVER (PARTITION BY conv_id ORDER BY turn) AS y FROM conversations)
SELECT conv_id, turn, round(CASE WHEN len(x) = 0 OR len(y) = 0 THEN 0 ELSE len(list_intersect(x, y)) / (len(x) + len(y) - len(list_intersect(x, y))) END, 9) AS score FROM t WHERE y IS NOT NULL""")
def token_jaccard(spark, sf_dir):
    from pyspark.sql import Window

    t = table(spark, sf_dir, "conversations").withColumn("before", F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))).where("before is not null")
    return t.select("conv_id", "turn", F.round(S.token_jaccard("text", "before"), 9).alias("score"))


@query("""SELECT page_id, regexp_replace(regexp_replace(lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1)), ':[0-9]+$', ''), '^www\\.', '') AS host, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM pages JOIN part ON p_partkey = page_id + 1""")
def slug_ids(spark, sf_dir):
    pages, parts = table(spark, sf_dir, "pages"), table(spark, sf_dir, "part")
    return pages.join(parts, F.col("p_partkey") == F.col("page_id") + 1).select("page_id", S.host_of("url").alias("host"), S.slug("p_name").alias("slug"))


#: Wordings that are in the vocabulary, mean a word of it, hold one, or say nothing of it.
WORDINGS = [
    *predicates.PREDICATES, "Rates_Positive", "RATES-POSITIVE", "  forecasts  ", "anticipates", "bullish on", "Bearish", "praises", "concurs", "casts  doubt_on", "predict", "endorse", "strongly criticizes", "clearly forecasts it",
    "rates", "positive", "negative", "flibbertigibbets", "", "   ", "backss", "agree to disagree", "it supports", "question-s",
]
WORDED = "list_extract([" + ", ".join(f"'{w}'" for w in WORDINGS) + f"], 1 + (event_id % {len(WORDINGS)})::INTEGER)"
VOCABULARY = "vocab AS (SELECT unnest([" + ", ".join(f"'{p}'" for p in predicates.PREDICATES) + "]) AS p), syn AS (SELECT unnest([" + ", ".join(f"{{'w': '{w}', 'p': '{p}'}}" for p, many in predicates.SYNONYMS.items() for w in many) + "]) AS s)"


@query(rf"""WITH {VOCABULARY}, spaced AS (SELECT replace(p, '_', ' ') AS w, p FROM vocab), alone AS (SELECT w, p FROM (SELECT unnest(string_split(p, '_')) AS w, p FROM vocab) WHERE w NOT IN ('rates', 'positive', 'negative')),
raw AS (SELECT DISTINCT {WORDED} AS raw FROM events), t AS (SELECT raw, trim(regexp_replace(lower(raw), '[\s_\-]+', ' ', 'g')) AS t FROM raw), forms AS (SELECT raw, t, CASE WHEN t LIKE '%s' THEN t[:-2] END AS one FROM t),
words AS (SELECT raw, unnest(string_split(t, ' ')) AS w, generate_subscripts(string_split(t, ' '), 1) AS nth FROM t),
worded AS (SELECT raw, arg_min(coalesce(a.p, b.p), nth) AS p FROM words LEFT JOIN alone a ON a.w = words.w LEFT JOIN alone b ON words.w LIKE '%s' AND b.w = words.w[:-2] WHERE coalesce(a.p, b.p) IS NOT NULL GROUP BY 1),
mapped AS (SELECT f.raw, coalesce((SELECT p FROM spaced WHERE w = t), (SELECT s.p FROM syn WHERE s.w = t), (SELECT p FROM spaced WHERE w = one), (SELECT s.p FROM syn WHERE s.w = one), (SELECT p FROM spaced WHERE w = t || 's'), (SELECT p FROM worded WHERE worded.raw = f.raw)) AS predicate FROM forms f)
SELECT event_id, predicate FROM (SELECT event_id, {WORDED} AS raw FROM events) JOIN mapped USING (raw)""")
def predicate_mapping(spark, sf_dir):
    raw = F.get(F.array(*[F.lit(w) for w in WORDINGS]), (F.col("event_id") % len(WORDINGS)).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", predicates.map_predicate(raw).alias("predicate"))


@query(with_(CLAIMS) + "SELECT claim_id, array_to_string(list_filter([CASE WHEN stance = 'hedges' THEN 'stance' END, CASE WHEN sentiment > 0.5 THEN 'sentiment' END, CASE WHEN subject = 'ent-7' THEN 'subject' END], lambda x: x IS NOT NULL), ',') AS reasons FROM claims")
def claim_validation(spark, sf_dir):
    c = claims(spark, sf_dir).select("claim_id", F.when(F.col("stance") != "hedges", F.col("stance")).alias("stance"), F.when(F.col("sentiment") > 0.5, 2.0).otherwise(F.col("sentiment")).alias("sentiment"), "confidence", "speaker_id", F.when(F.col("subject") != "ent-7", F.col("subject")).alias("subject"), F.lit(0.0).alias("t_start"), F.lit(1.0).alias("t_end"))
    return extraction.validate_claims(c).select("claim_id", F.array_join("reasons", ",").alias("reasons"))


@query()
def grounded_claims(spark, sf_dir):
    s = segment_rows(spark, sf_dir)
    c = s.select(F.monotonically_increasing_id().alias("claim_seq"), "episode_id", F.col("text").alias("object"), F.lit(190.0).alias("t_start"), F.lit(200.0).alias("t_end"), F.lit("SPEAKER_99").alias("label"))
    return extraction.ground_claims(c, s)


@query()
def page_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", html_to_text("html").alias("text"))


from . import registry_more  # noqa: E402, F401

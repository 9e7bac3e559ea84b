"""More named queries with their SQL: names, resolution, chunks, extraction, upserts, evaluation and small values."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import charts, consensus, evaluation, extraction, identity, names, relations, retrieval, segments, temporal
from ..sources import jobs, tables
from . import load
from .projection import CLAIMS, EDGES, SEGMENTS, claims, edges, segments as segment_rows, table, vectors, with_
from .registry import AS_OF, FROM, UNTIL, nine, query

# names ---------------------------------------------------------------------------------------------------------------
#: Turns that introduce people; the same expression in both dialects.
SAID = """CASE (seg_idx + length(text)) % 5 WHEN 0 THEN concat('Hello, this is ', {0}, ' and my guest today is ', {1}, ' here.')
 WHEN 1 THEN concat('Thanks. Im ', {1}, ', glad to be on.') WHEN 2 THEN concat('please welcome ', {2}, ' today; JOINING ME IS ', {0}) WHEN 3 THEN concat('i am here and I am ', {2}) ELSE text END"""
_WHO = ["CASE length(text) % 3 WHEN 0 THEN 'Ann Lee' WHEN 1 THEN 'Bo O-Neil Smith' ELSE 'J.R. Doe' END", "CASE length(text) % 4 WHEN 0 THEN 'Cy Fox.' WHEN 1 THEN 'Di van Dyk' ELSE 'Ed Poe Ray Hall' END", "CASE length(text) % 2 WHEN 0 THEN 'Flo Back' ELSE 'Gus Orr' END"]
SAID = SAID.format(*_WHO)


def _clean(c: str) -> str:
    return f"trim(regexp_replace(trim(regexp_replace(trim({c}), '^[.,]+|[.,]+$', '', 'g')), '(?i){names.TRAILING}', ''))"


def _quoted(pattern: str) -> str:
    return "'(?i)" + pattern.replace("'", "''") + "'"


GUESTS = f"""said AS (SELECT episode_id, seg_idx, speaker, {SAID} AS text FROM segments),
guests AS (SELECT * FROM (SELECT episode_id, seg_idx, speaker, pos, {_clean("raw")} AS name FROM (SELECT episode_id, seg_idx, speaker, unnest(l) AS raw, generate_subscripts(l, 1) AS pos FROM
 (SELECT *, flatten([{", ".join(f"regexp_extract_all(text, {_quoted(p)}, 1)" for p in names.GUEST_INTROS)}]) AS l FROM said))) WHERE name <> '')"""


def _said(spark, sf_dir):
    return segment_rows(spark, sf_dir).withColumn("text", F.expr(SAID))


@query(with_(SEGMENTS, GUESTS) + "SELECT episode_id, arg_min(name, (seg_idx, pos)) AS name, min(seg_idx) AS seg_idx FROM guests GROUP BY episode_id, lower(name)")
def introduced_names(spark, sf_dir):
    return names.introduced(_said(spark, sf_dir))


@query(with_(SEGMENTS, GUESTS) + f""", own AS (SELECT episode_id, speaker AS label, arg_min(name, seg_idx) AS name FROM (SELECT *, coalesce({", ".join("nullif(" + _clean(f"regexp_extract(text, {_quoted(p)}, 1)") + ", '')" for p in names.SELF_INTROS)}) AS name FROM said) WHERE name IS NOT NULL GROUP BY ALL),
seen AS (SELECT episode_id, speaker, row_number() OVER (PARTITION BY episode_id ORDER BY m) AS nth FROM (SELECT episode_id, speaker, min(seg_idx) AS m FROM segments GROUP BY 1, 2)),
aimed AS (SELECT g.*, CASE WHEN g.speaker = a.speaker THEN b.speaker ELSE a.speaker END AS label FROM guests g JOIN seen a ON a.episode_id = g.episode_id AND a.nth = 1 LEFT JOIN seen b ON b.episode_id = g.episode_id AND b.nth = 2),
found AS (SELECT episode_id, label, name FROM own UNION ALL SELECT episode_id, label, arg_min(name, (seg_idx, pos)) FROM aimed a WHERE label IS NOT NULL AND NOT EXISTS (SELECT 1 FROM own o WHERE o.episode_id = a.episode_id AND o.label = a.label) GROUP BY 1, 2)
SELECT episode_id, label, CASE WHEN lower(name) = 'ann lee' THEN 'ANN  Lee' ELSE name END AS name FROM found""")
def label_names(spark, sf_dir):
    return names.label_names(_said(spark, sf_dir), spark.createDataFrame([("ANN  Lee",)], "full_name string"))


@query(with_(SEGMENTS) + """, t AS (SELECT episode_id, speaker, sum(greatest(0, t_end - t_start)) AS s FROM segments WHERE speaker <> 'user' GROUP BY ALL)
SELECT episode_id, speaker AS label FROM (SELECT *, row_number() OVER (PARTITION BY episode_id ORDER BY s DESC, speaker) AS nth FROM t) WHERE nth = 1""")
def guest_labels(spark, sf_dir):
    s = segment_rows(spark, sf_dir)
    return names.guest_labels(s, s.where("speaker = 'user'").select("episode_id", F.col("speaker").alias("label")).distinct())


# resolution ----------------------------------------------------------------------------------------------------------
KINDS = ("person", "organization", "concept", "work")


@query(f"""WITH k AS (SELECT vec_id, embedding::DOUBLE[] AS v, {list(KINDS)}[label % 4 + 1] AS kind FROM embeddings), m AS (SELECT vec_id, kind, list_transform(v, lambda x: x + 0.02) AS v FROM k WHERE vec_id % 100 = 0),
q AS (SELECT m.vec_id, min(e.vec_id) AS by_qid FROM m JOIN k e ON e.kind = m.kind AND e.vec_id % 50 = 0 AND e.vec_id = m.vec_id * 2 AND m.vec_id % 200 = 100 GROUP BY 1), n AS (SELECT m.vec_id, min(e.vec_id) AS by_name FROM m JOIN k e ON e.kind = m.kind AND e.vec_id = m.vec_id * 3 GROUP BY 1),
s AS (SELECT m.vec_id, e.vec_id AS eid, list_cosine_similarity(m.v, e.v) AS score FROM m JOIN k e USING (kind) WHERE m.vec_id NOT IN (SELECT vec_id FROM q) AND m.vec_id NOT IN (SELECT vec_id FROM n)),
b AS (SELECT vec_id, arg_max(eid, (score, -eid)) AS eid, max(score) AS score FROM s GROUP BY 1),
t AS (SELECT m.vec_id, by_qid, by_name, eid, score, CASE WHEN by_qid IS NOT NULL THEN 'qid' WHEN by_name IS NOT NULL THEN 'exact' WHEN score >= CASE WHEN kind IN ('person', 'organization') THEN 0.86 ELSE 0.90 END THEN 'embedding' WHEN score < CASE WHEN kind IN ('person', 'organization') THEN 0.62 ELSE 0.70 END OR score IS NULL THEN 'new' ELSE 'ask' END AS tier
 FROM m LEFT JOIN q USING (vec_id) LEFT JOIN n USING (vec_id) LEFT JOIN b USING (vec_id))
SELECT vec_id AS mention_id, coalesce(by_qid, by_name, CASE WHEN tier IN ('embedding', 'ask') THEN eid END) AS canonical_id, tier, round(score, 9) AS score FROM t""")
def cascade_tiers(spark, sf_dir):
    """Every entity against the stated mentions (identifiers divisible by 100)."""
    v = vectors(spark, sf_dir)
    i = F.col("vec_id")
    kind = F.element_at(F.array(*[F.lit(k) for k in KINDS]), (F.col("label") % 4 + 1).cast("int"))
    qid = lambda n: F.concat(F.lit("Q"), n.cast("string"))
    e = v.select(i.alias("canonical_id"), kind.alias("entity_type"), F.concat(F.lit("Name "), i.cast("string")).alias("canonical_name"), F.when(i % 50 == 0, qid(i)).alias("qid"), "embedding", F.lit(None).cast("array<string>").alias("aliases"), i.alias("insert_seq"))
    m = v.where(i % 100 == 0).select(i.alias("mention_id"), kind.alias("entity_type"), F.concat(F.lit("name  "), (i * 3).cast("string")).alias("name"), F.when(i % 200 == 100, qid(i * 2)).alias("qid"), F.transform("embedding", lambda x: x + 0.02).alias("vector"))
    return identity.cascade(m, e).select("mention_id", "canonical_id", "tier", *nine("score"))


@query("""WITH r AS (SELECT c_custkey AS seq, c_nationkey AS canonical_id, CASE WHEN c_custkey % 2 = 0 THEN ' ' || lower(c_mktsegment) ELSE c_mktsegment || '  ' || (c_custkey % 3) END AS alias FROM customer),
f AS (SELECT canonical_id, arg_min(alias, seq) AS alias, min(seq) AS seq FROM r GROUP BY canonical_id, trim(regexp_replace(lower(alias), '\\s+', ' ', 'g'))) SELECT canonical_id, string_agg(alias, '|' ORDER BY seq) AS aliases FROM f GROUP BY 1""")
def merged_aliases(spark, sf_dir):
    k, seg = F.col("c_custkey"), F.col("c_mktsegment")
    alias = F.when(k % 2 == 0, F.concat(F.lit(" "), F.lower(seg))).otherwise(F.concat(seg, F.lit("  "), (k % 3).cast("string")))
    rows = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("canonical_id"), alias.alias("alias"), k.alias("seq"))
    return identity.merge_aliases(rows).select("canonical_id", F.array_join("aliases", "|").alias("aliases"))


@query("""WITH c AS (SELECT 'name ' || (s_suppkey % 30) AS name, s_suppkey AS rank, 'Q' || s_suppkey AS qid, CASE WHEN s_suppkey % 4 = 1 THEN 'An Economist of ' || s_nationkey ELSE 'somebody' END AS description FROM supplier),
e AS (SELECT c_custkey AS entity_id, CASE c_custkey % 3 WHEN 0 THEN 'person' WHEN 1 THEN 'organization' ELSE 'concept' END AS kind, 'name ' || (c_custkey % 35) AS name, c_custkey % 2 = 0 AS asks FROM customer)
SELECT entity_id, arg_min(qid, (CASE WHEN asks AND contains(lower(description), 'economist') THEN 0 ELSE 1 END, rank)) AS qid FROM e JOIN c USING (name) WHERE kind <> 'concept' GROUP BY 1""")
def picked_candidates(spark, sf_dir):
    s, k = F.col("s_suppkey"), F.col("c_custkey")
    about = F.when(s % 4 == 1, F.concat(F.lit("An Economist of "), F.col("s_nationkey").cast("string"))).otherwise("somebody")
    c = table(spark, sf_dir, "supplier").select(F.concat(F.lit("name "), (s % 30).cast("string")).alias("name"), s.alias("rank"), F.concat(F.lit("Q"), s.cast("string")).alias("qid"), about.alias("description"))
    e = table(spark, sf_dir, "customer").select(k.alias("entity_id"), F.when(k % 3 == 0, "person").when(k % 3 == 1, "organization").otherwise("concept").alias("entity_type"), F.concat(F.lit("name "), (k % 35).cast("string")).alias("name"))
    return identity.pick_candidates(e, c, e.where("entity_id % 2 = 0").select("entity_id", F.lit("ECONOMIST").alias("hint")))


RESOLVERS = """first AS (SELECT DISTINCT episode_id, speaker AS label, 'host-' || episode_id AS id FROM segments WHERE speaker = 'user' AND length(episode_id) % 2 = 0), second AS (SELECT DISTINCT episode_id, speaker AS label, 'guest-' || speaker AS id FROM segments WHERE speaker <> 'system')"""


def _resolvers(spark, sf_dir):
    s = segment_rows(spark, sf_dir).select("episode_id", F.col("speaker").alias("label")).distinct()
    one = s.where("label = 'user' and length(episode_id) % 2 = 0").withColumn("resolved_id", F.concat(F.lit("host-"), "episode_id"))
    return s, one, s.where("label <> 'system'").withColumn("resolved_id", F.concat(F.lit("guest-"), "label"))


@query(with_(SEGMENTS, RESOLVERS) + "SELECT DISTINCT s.episode_id, s.speaker AS label, coalesce(a.id, b.id) AS resolved_id FROM segments s LEFT JOIN first a ON a.episode_id = s.episode_id AND a.label = s.speaker LEFT JOIN second b ON b.episode_id = s.episode_id AND b.label = s.speaker")
def resolved_labels(spark, sf_dir):
    labels, *resolvers = _resolvers(spark, sf_dir)
    return identity.resolve_labels(labels, *resolvers)


@query(with_(SEGMENTS, RESOLVERS) + "SELECT s.episode_id, s.seg_idx, s.speaker AS label, a.id AS resolved_id FROM segments s LEFT JOIN first a ON a.episode_id = s.episode_id AND a.label = s.speaker")
def stamped_speakers(spark, sf_dir):
    _, one, _ = _resolvers(spark, sf_dir)
    return extraction.stamp_speakers(segment_rows(spark, sf_dir).select("episode_id", "seg_idx", F.col("speaker").alias("label")), one)


# chunks and extraction -----------------------------------------------------------------------------------------------
@query((with_(SEGMENTS) + """, l AS (SELECT *, row_number() OVER (PARTITION BY episode_id ORDER BY seg_idx) - 1 AS i, printf('[%.2f-%.2f] %s: %s', t_start, t_end, speaker, text) AS line FROM segments),
c AS (SELECT *, sum(length(line) + 1) OVER (PARTITION BY episode_id ORDER BY i) AS cum, count(*) OVER (PARTITION BY episode_id) AS n FROM l),
e AS (SELECT a.episode_id, a.i AS s, any_value(a.n) AS n, greatest(a.i + 1, coalesce(max(b.i + 1) FILTER (WHERE b.cum - (a.cum - length(a.line) - 1) - 1 <= 800), 0)) AS stop FROM c a JOIN c b ON a.episode_id = b.episode_id AND b.i >= a.i GROUP BY a.episode_id, a.i),
r AS (SELECT episode_id, 0 AS k, s, stop, n FROM e WHERE s = 0 UNION ALL SELECT e.episode_id, k + 1, e.s, e.stop, e.n FROM r JOIN e ON e.episode_id = r.episode_id AND e.s = r.stop - least(1, r.stop - r.s - 1) WHERE r.stop < r.n)
SELECT r.episode_id, k::INTEGER AS chunk_index, min(seg_idx) AS first_idx, max(seg_idx) AS last_idx, string_agg(line, chr(10) ORDER BY i) AS text, min(t_start) AS t_start, max(t_end) AS t_end FROM r JOIN c ON c.episode_id = r.episode_id AND c.i >= r.s AND c.i < r.stop GROUP BY 1, 2""").replace("WITH ", "WITH RECURSIVE ", 1))
def packed_chunks(spark, sf_dir):
    return segments.packed_chunks(segment_rows(spark, sf_dir), 800, 1)


@query(with_(SEGMENTS) + """, x AS (SELECT episode_id || '#' || seg_idx AS chunk_id, *, t_end - seg_idx % 2 AS c_end FROM segments)
SELECT chunk_id, 0 AS item_idx, speaker AS speaker_label, 'expects' AS predicate, trim(left(text, 12)) AS subject, 'person' AS subject_type, text AS object, 'asserts' AS stance, least(1, seg_idx * 0.5)::DOUBLE AS sentiment, 0.5::DOUBLE AS confidence, least(c_end, t_start) AS t_start, least(c_end, t_end) AS t_end,
 CASE WHEN speaker = 'system' THEN 'unknown_label' WHEN t_end > c_end + 0.05 THEN 'outside_chunk' WHEN trim(left(text, 12)) = '' THEN 'no_subject' END AS drop_reason FROM x WHERE seg_idx % 5 <> 4
UNION ALL SELECT chunk_id, NULL, NULL, NULL, NULL, 'concept', NULL, NULL, 0, 0.5, NULL, NULL, 'not_json' FROM x WHERE seg_idx % 5 = 4""")
def claim_extraction(spark, sf_dir):
    fields = [F.col("speaker").alias("speaker_label"), F.lit("anticipates").alias("predicate"), F.substring("text", 1, 12).alias("subject"), F.lit("Person").alias("subject_type"), F.col("text").alias("object"), F.lit("Asserts ").alias("stance"), (F.col("seg_idx") * 0.5).alias("sentiment"), "t_start", "t_end"]
    item = F.to_json(F.struct(F.array(F.struct(*fields)).alias("claims")))
    out = segment_rows(spark, sf_dir).select(F.concat_ws("#", "episode_id", "seg_idx").alias("chunk_id"), F.when(F.col("seg_idx") % 5 == 4, "not json").otherwise(item).alias("raw"), F.array(F.lit("user"), F.lit("assistant")).alias("labels"), F.col("t_start").alias("c_start"), (F.col("t_end") - F.col("seg_idx") % 2).alias("c_end"))
    return extraction.parse_claims(out)


@query((with_(SEGMENTS) + """, r AS (SELECT *, row_number() OVER (PARTITION BY episode_id ORDER BY seg_idx) - 1 AS i, CASE WHEN seg_idx % 3 <> 1 THEN seg_idx * 4.0::DOUBLE END AS t, 0.4::DOUBLE * greatest(1, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> ''))) AS spoken FROM segments WHERE trim(text, E' \\n\\t\\r') <> ''),
n AS (SELECT *, lead(t) OVER (PARTITION BY episode_id ORDER BY i) AS after FROM r),
f AS (SELECT episode_id, i, coalesce(t, 0) AS a, CASE WHEN after > coalesce(t, 0) THEN after ELSE coalesce(t, 0) + spoken END AS b FROM n WHERE i = 0
 UNION ALL SELECT n.episode_id, n.i, greatest(coalesce(n.t, f.b), f.b), CASE WHEN n.after > greatest(coalesce(n.t, f.b), f.b) THEN n.after ELSE greatest(coalesce(n.t, f.b), f.b) + spoken END FROM f JOIN n ON n.episode_id = f.episode_id AND n.i = f.i + 1)
SELECT episode_id, i::INTEGER AS seg_idx, round(a, 6) AS t_start, round(b, 6) AS t_end FROM f""").replace("WITH ", "WITH RECURSIVE ", 1))
def finalized_segments(spark, sf_dir):
    rows = segment_rows(spark, sf_dir).select("episode_id", F.col("seg_idx").alias("row_idx"), "speaker", "text", F.when(F.col("seg_idx") % 3 != 1, F.col("seg_idx") * 4.0).alias("t"))
    return segments.finalize(rows).select("episode_id", "seg_idx", F.round("t_start", 6).alias("t_start"), F.round("t_end", 6).alias("t_end"))


@query(with_(SEGMENTS) + "SELECT episode_id, arg_min(speaker, (-s, speaker)) AS speaker FROM (SELECT episode_id, speaker, sum(t_end - t_start) AS s FROM segments GROUP BY ALL) GROUP BY 1")
def majority_speakers(spark, sf_dir):
    words = segment_rows(spark, sf_dir).withColumnsRenamed({"t_start": "w_start", "t_end": "w_end"})
    return segments.majority_speaker(words, "episode_id").select("episode_id", "speaker")


# graph tables --------------------------------------------------------------------------------------------------------
@query(with_(CLAIMS) + "SELECT c.claim_id, e.event_time FROM (SELECT claim_id, episode_id FROM claims) c JOIN (SELECT DISTINCT episode_id, event_time FROM claims WHERE day(event_time) % 2 = 0) e USING (episode_id)")
def claims_with_event_time(spark, sf_dir):
    c = claims(spark, sf_dir)
    episodes = c.where("day(event_time) % 2 = 0").select("episode_id", F.col("event_time").alias("published_at")).distinct()
    return consensus.with_event_time(c.drop("event_time"), episodes).select("claim_id", "event_time")


LOADED = f"""loaded AS (SELECT seq, speaker_id, stance, subject, CASE WHEN seq % 4 = 0 THEN 'same' ELSE 'object ' || seq % 50 END AS object, episode_id, (seq % 3)::DOUBLE AS t_start, event_time FROM claims WHERE subject <> 'ent-7' AND speaker_id <> 'spk-3'),
named AS (SELECT 'claim-' || left(sha1(concat_ws(chr(31), speaker_id, stance, subject, object, episode_id, printf('%.3f', t_start))), 16) AS claim_id, CASE WHEN episode_id LIKE '%5' THEN TIMESTAMP '{AS_OF}' ELSE event_time END AS event_time, seq FROM loaded)"""


def _loaded(spark, sf_dir):
    c = claims(spark, sf_dir)
    n = F.col("seq")
    rows = c.select(n.alias("claim_seq"), F.when(F.col("speaker_id") != "spk-3", F.col("speaker_id")).alias("speaker_id"), F.col("stance").alias("predicate"), "stance", F.when(F.col("subject") != "ent-7", F.col("subject")).otherwise("").alias("subject"), F.when(n % 4 == 0, "same").otherwise(F.concat(F.lit("object "), (n % 50).cast("string"))).alias("object"), "sentiment", "confidence", "episode_id", (n % 3).cast("double").alias("t_start"))
    return rows, c.where("episode_id not like '%5'").select("episode_id", F.col("event_time").alias("published_at")).distinct()


@query(with_(CLAIMS, LOADED) + "SELECT claim_id, epoch(arg_min(event_time, seq))::BIGINT AS event_s, min(seq) AS claim_seq FROM named GROUP BY 1")
def loaded_claims(spark, sf_dir):
    return load.claim_rows(*_loaded(spark, sf_dir), AS_OF).select("claim_id", F.unix_seconds("event_time").alias("event_s"), "claim_seq")


@query(with_(CLAIMS) + """, e AS (SELECT 'asserts' AS type, speaker_id AS src_id, claim_id AS dst_id FROM claims UNION SELECT 'about', claim_id, subject FROM claims UNION SELECT 'appears_in', claim_id, episode_id FROM claims)
SELECT 'edge-' || left(sha1(concat_ws(chr(31), type, src_id, dst_id)), 16) AS edge_id, * FROM e""")
def asserted_edge_rows(spark, sf_dir):
    return relations.asserted_edges(claims(spark, sf_dir)).select("edge_id", "type", "src_id", "dst_id")


@query(with_(CLAIMS, EDGES) + f"SELECT edge_id, epoch(valid_from)::BIGINT AS from_s, epoch(CASE WHEN load_seq % 4 = 1 THEN TIMESTAMP '{UNTIL}' ELSE valid_to END)::BIGINT AS to_s, invalidated FROM edges")
def validity_windows(spark, sf_dir):
    moved = temporal.set_validity_window(edges(spark, sf_dir), F.col("load_seq") % 4 == 1, valid_to=UNTIL)
    return moved.select("edge_id", F.unix_seconds("valid_from").alias("from_s"), F.unix_seconds("valid_to").alias("to_s"), "invalidated")


@query(with_(CLAIMS) + "SELECT speaker_id, arg_max(claim_id, seq) AS name, max(seq) AS load_seq FROM claims GROUP BY 1")
def latest_speakers(spark, sf_dir):
    rows = claims(spark, sf_dir).select("speaker_id", F.col("claim_id").alias("name"), F.col("seq").alias("load_seq"))
    return temporal.upsert_latest(rows.where("load_seq % 3 = 0"), rows.where("load_seq % 3 <> 0"), "speaker_id")


@query("""SELECT 'spk-' || s_suppkey AS id, s_name AS label, 'speaker' AS "group" FROM supplier UNION ALL SELECT 'ent-' || c_custkey, c_mktsegment, 'entity' FROM customer
UNION ALL SELECT 'claim-' || doc_id, CASE WHEN length(text) > 60 THEN left(text, 59) || '…' ELSE text END, 'claim' FROM documents""")
def viewer_nodes(spark, sf_dir):
    named = lambda name, prefix, key, *columns: table(spark, sf_dir, name).select(F.concat(F.lit(prefix), F.col(key).cast("string")).alias("key"), *columns)
    s = named("supplier", "spk-", "s_suppkey", F.col("s_name").alias("name")).withColumnRenamed("key", "speaker_id")
    e = named("customer", "ent-", "c_custkey", F.col("c_mktsegment").alias("canonical_name")).withColumnRenamed("key", "canonical_id")
    c = named("documents", "claim-", "doc_id", F.col("text").alias("object")).withColumnRenamed("key", "claim_id")
    return tables.graph_nodes(s, e, c)


@query(f"SELECT event_id FROM events WHERE date_trunc('day', ts)::TIMESTAMP >= TIMESTAMP '{FROM}' AND date_trunc('day', ts)::TIMESTAMP <= TIMESTAMP '{UNTIL}'")
def events_in_window(spark, sf_dir):
    return claims(spark, sf_dir).withColumn("valid_from", F.lit(None).cast("timestamp")).where(temporal.within_event_time(FROM, UNTIL)).select(F.col("seq").alias("event_id"))


# sources -------------------------------------------------------------------------------------------------------------
@query("""SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'pi-' || p_partkey WHEN p_partkey % 3 = 1 THEN 'guid-' || p_size ELSE 'domain-' || (p_size % 8) || '-' || trim(regexp_replace(lower(trim(p_name)), '[^a-z0-9]', '-', 'g'), '-') END AS show_id FROM part""")
def show_ids(spark, sf_dir):
    k = F.col("p_partkey")
    feeds = table(spark, sf_dir, "part").select(k, F.when(k % 3 == 0, k).alias("id"), F.when(k % 3 == 1, F.col("p_size").cast("string")).otherwise("").alias("guid"), F.col("p_name").alias("title"), F.concat(F.lit("domain-"), (F.col("p_size") % 8).cast("string")).alias("domain"))
    return feeds.select("p_partkey", charts.show_id("id", "guid", "title", "domain").alias("show_id"))


@query(with_(SEGMENTS) + "SELECT episode_id, (row_number() OVER (PARTITION BY episode_id ORDER BY seg_idx) - 1)::INTEGER AS seg_idx, speaker, trim(text) AS text, round(seg_idx * 1.5, 6)::DOUBLE AS t_start, round(seg_idx * 1.5 + CASE WHEN seg_idx % 4 = 3 THEN 0 ELSE 0.25 END, 6)::DOUBLE AS t_end FROM segments WHERE trim(text) <> ''")
def service_segments(spark, sf_dir):
    n = F.col("seg_idx")
    said = F.struct("speaker", "text", (n * 1500).cast("string").alias("start"), F.when(n % 4 == 3, "bad").otherwise((n * 1500 + 250).cast("string")).alias("end"))
    raw = segment_rows(spark, sf_dir).groupBy("episode_id").agg(F.array_sort(F.collect_list(F.struct("seg_idx", said.alias("u")))).alias("all"))
    raw = raw.select("episode_id", F.to_json(F.struct(F.transform("all", lambda x: x["u"]).alias("utterances"))).alias("raw"))
    return tables.speech_service(raw).select("episode_id", F.col("seg_idx").cast("int").alias("seg_idx"), "speaker", "text", F.round("t_start", 6).alias("t_start"), F.round("t_end", 6).alias("t_end"))


@query("SELECT DISTINCT source, lang FROM documents WHERE NOT (lang = 'en' AND source IN (SELECT source FROM documents WHERE doc_id % 7 = 0 AND lang = 'en'))")
def uncached_requests(spark, sf_dir):
    asked = table(spark, sf_dir, "documents").select("source", "lang")
    cache = jobs.cache_misses(table(spark, sf_dir, "documents").where("doc_id % 7 = 0 and lang = 'en'").select("source", "lang"), None, "source", "lang")
    return jobs.cache_misses(asked, cache, "source", "lang").select("source", "lang")


@query("SELECT title, min(doc_id) AS claim_seq FROM (SELECT doc_id, lang || '-' || source AS title FROM documents) GROUP BY 1")
def folded_claims(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.concat_ws("-", "lang", "source").alias("title"), F.col("doc_id").alias("claim_seq"))
    return extraction.fold_claims(rows, "title")


# evaluation ----------------------------------------------------------------------------------------------------------
@query("SELECT (SELECT string_agg(DISTINCT c_mktsegment, ',' ORDER BY c_mktsegment) FROM customer) AS domains, (SELECT string_agg(DISTINCT 'kind-' || (c_nationkey % 4), ',' ORDER BY 'kind-' || (c_nationkey % 4)) FROM customer) AS archetypes")
def query_coverage(spark, sf_dir):
    asked = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("domain"), F.concat(F.lit("kind-"), (F.col("c_nationkey") % 4).cast("string")).alias("archetype"))
    return evaluation.coverage(asked).select(F.array_join("domains", ",").alias("domains"), F.array_join("archetypes", ",").alias("archetypes"))


@query("SELECT o_orderkey // 5 AS query_id, CASE o_custkey % 3 WHEN 0 THEN 'alone' WHEN 1 THEN 'search' ELSE 'rag' END AS arm, count(*) FILTER (WHERE o_orderstatus = 'F') AS n_verified, count(*) FILTER (WHERE o_orderstatus <> 'F') AS n_rejected FROM orders GROUP BY 1, 2")
def verified_citations(spark, sf_dir):
    arm = F.when(F.col("o_custkey") % 3 == 0, "alone").when(F.col("o_custkey") % 3 == 1, "search").otherwise("rag")
    cited = table(spark, sf_dir, "orders").select(F.expr("o_orderkey div 5").alias("query_id"), arm.alias("arm"), (F.col("o_orderstatus") == "F").alias("verified"))
    return evaluation.verified_citations(cited)


@query("""WITH f AS (SELECT 'p' || (c_nationkey % 5) AS probe, count(DISTINCT c_custkey) AS fragments FROM customer GROUP BY 1) SELECT count(*) AS n_probes, round(avg(fragments), 9) AS mean_fragments, arg_min(probe, (-fragments, probe)) AS worst_probe, max(fragments) AS worst_fragments FROM f""")
def fragmentation_summary(spark, sf_dir):
    nodes = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("canonical_id"), F.concat(F.lit("p"), (F.col("c_nationkey") % 5).cast("string")).alias("name"), F.lit(None).cast("array<string>").alias("aliases"), F.lit(None).cast("string").alias("qid"))
    probes = spark.createDataFrame([(f"p{i}", None, None) for i in range(5)], "probe string, aliases array<string>, qid string")
    return evaluation.fragmentation_report(evaluation.fragmentation(nodes, probes)).select("n_probes", *nine("mean_fragments"), "worst_probe", "worst_fragments")


@query("""SELECT round(60 * count(*)::DOUBLE / sum(o_custkey % 9), 9) AS episodes_per_minute, round(sum(o_custkey % 7)::DOUBLE / count(*), 9) AS cost_per_episode, round(sum(o_custkey % 5)::DOUBLE / count(*), 9) AS claims_per_episode,
 round(sum(o_custkey % 3)::DOUBLE / sum(o_custkey % 5), 9) AS valid_span_rate, round(sum(o_custkey % 2)::DOUBLE / sum(o_custkey % 5), 9) AS valid_attribution_rate, round(sum(o_custkey % 4)::DOUBLE / sum(o_custkey % 6), 9) AS parse_rate FROM orders""")
def approach_scores(spark, sf_dir):
    n = lambda k: F.sum(F.col("o_custkey") % k)
    run = table(spark, sf_dir, "orders").agg(F.count(F.lit(1)).alias("episodes"), n(9).alias("seconds"), n(7).alias("cost"), n(5).alias("claims"), n(3).alias("valid_spans"), n(2).alias("valid_speakers"), n(4).alias("parsed"), n(6).alias("attempts"))
    return evaluation.approach_score(run).select(*nine("episodes_per_minute", "cost_per_episode", "claims_per_episode", "valid_span_rate", "valid_attribution_rate", "parse_rate"))


# small values --------------------------------------------------------------------------------------------------------
@query("""SELECT event_id, greatest(0, CASE WHEN event_id % 5 = 0 THEN 0 ELSE value * 1000 / 1000.0 END)::DOUBLE AS seconds, (value >= 50)::INTEGER + (value >= 120)::INTEGER AS band, coalesce(nullif(CASE WHEN event_id % 3 = 0 THEN '' ELSE event_type END, ''), props) AS subject,
 greatest(-1, least(1, value / 100 - 1))::DOUBLE AS clamped FROM events""")
def small_values(spark, sf_dir):
    e, n = table(spark, sf_dir, "events"), F.col("event_id")
    ms = F.when(n % 5 == 0, "bad").otherwise((F.col("value") * 1000).cast("string"))
    return e.select("event_id", F.round(S.milliseconds(ms), 9).alias("seconds"), S.bin_of("value", [50.0, 120.0]).cast("int").alias("band"), S.subject_key(F.when(n % 3 == 0, "").otherwise(F.col("event_type")), "props").alias("subject"), S.clamp(F.col("value") / 100 - 1, -1.0, 1.0).alias("clamped"))


@query("""SELECT event_id, epoch_us(CASE event_id % 3 WHEN 0 THEN to_timestamp(event_id * 1000)::TIMESTAMP WHEN 1 THEN TIMESTAMP '2024-01-15 00:00:00' ELSE TIMESTAMP '2023-05-06 07:08:09' END) AS published_us FROM events""")
def published_moments(spark, sf_dir):
    n = F.col("event_id")
    raw = F.when(n % 3 == 0, (n * 1000).cast("string")).when(n % 3 == 1, "no date").otherwise("2023-05-06 07:08:09")
    return table(spark, sf_dir, "events").select("event_id", F.unix_micros(S.published_at(raw, F.lit(AS_OF).cast("timestamp"))).alias("published_us"))


@query("SELECT doc_id, greatest(1, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')))::INTEGER AS words, CASE WHEN length(text) > 80 THEN left(text, 79) || '…' ELSE text END AS cut FROM documents")
def text_values(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", S.word_count("text").alias("words"), S.truncate("text", 80).alias("cut"))


@query("SELECT id, hop, row_number() OVER (ORDER BY hop, id)::INTEGER AS rank FROM (SELECT 1 AS id, 0 AS hop UNION ALL SELECT DISTINCT o_orderkey % 1000, 1 FROM orders WHERE o_custkey = 1 AND o_orderkey % 1000 <> 1 AND o_orderkey % 1000 IN (SELECT c_custkey FROM customer))")
def graph_ranking(spark, sf_dir):
    links = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), (F.col("o_orderkey") % 1000).alias("neighbour")).distinct()
    return retrieval.graph_ranking(spark.range(1, 2), links, table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")), 1)

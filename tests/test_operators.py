import datetime as dt
import difflib

import pytest
from pyspark.sql import functions as F

from stanceframe.functions import scalars, text_udfs
from stanceframe.operators import charts, consensus, evaluation, extraction, identity, relations, retrieval, segments, temporal

T = lambda day: dt.datetime(2026, 1, day)


def one(spark, expr, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'double' if isinstance(v, float) else 'string'}" for k, v in values.items()))
    return row.select(expr.alias("x")).first()[0]


@pytest.mark.parametrize(("text", "seconds"), [("[00:01:23]", 83.0), ("at 3:04 he", 184.0), ("1:03:04.5", 3784.5), ("none", None), ("", None)])
def test_parse_hms(spark, text, seconds):
    assert one(spark, scalars.parse_hms("t"), t=text) == seconds


def test_text_scalars(spark):
    assert one(spark, scalars.clean_text("t"), t="a [music]  b (Laughs loudly) (more on that)\n c") == "a b (more on that) c"
    assert one(spark, scalars.slug("t", "show"), t=" The  Big-Show! ") == "the-big-show" and one(spark, scalars.slug("t", "show"), t="!!") == "show"
    assert one(spark, scalars.host_of("t"), t="https://me@WWW.Example.com:443/x?y") == "example.com"
    assert one(spark, scalars.episode_from_url("t"), t="https://x.org/a/Ep 12.pdf?q#z") == "ep-12"
    assert one(spark, scalars.word_count("t"), t="  ") == 1 and one(spark, scalars.word_count("t"), t="a b c") == 3
    assert one(spark, scalars.tokens("t"), t="Día-2 x") == ["d", "a", "2", "x"]
    assert one(spark, scalars.milliseconds("t"), t="1500") == 1.5 and one(spark, scalars.milliseconds("t"), t="bad") == 0.0
    assert one(spark, scalars.truncate("t", 5), t="abcdefgh") == "abcd…"


def test_unicode_scalars(spark):
    frame = spark.createDataFrame([("Straße ﬁ",), (None,)], "t string")
    assert [r[0] for r in frame.select(text_udfs.normal_surface("t")).collect()] == ["strasse fi", None]
    assert text_udfs.match_score_text("abcd", "bcde") == pytest.approx(0.5 * difflib.SequenceMatcher(None, "abcd", "bcde").ratio())
    assert text_udfs.html_text("<p>a</p><script>no</script><template><b>no</b></template>b <i>c</i>") == "a\nb\nc"


def test_live_and_windows(spark):
    rows = [("a", T(1), None, False), ("b", T(1), T(5), True), ("c", T(6), None, False), ("d", T(1), T(5), False)]
    e = spark.createDataFrame([(i, v, v, t, f) for i, v, t, f in rows], "edge_id string, event_time timestamp, valid_from timestamp, valid_to timestamp, invalidated boolean")
    ids = lambda frame: sorted(r.edge_id for r in frame.collect())
    assert ids(temporal.current_state(e)) == ["a", "c", "d"]
    assert ids(temporal.current_state(e, T(4))) == ["a", "b", "d"] and ids(temporal.current_state(e, T(5))) == ["a"]
    assert ids(e.where(temporal.within_event_time(T(2), None))) == ["c"] and ids(e.where(temporal.within_event_time(T(1), T(1)))) == ["a", "b", "d"]
    assert ids(e.where(temporal.overlaps_validity(T(6), T(9)))) == ["a", "c"]
    once = temporal.invalidate(e, e.where("edge_id in ('a', 'b')"), T(9)).collect()
    assert {r.edge_id: (r.valid_to, r.invalidated) for r in once if r.edge_id in "ab"} == {"a": (T(9), True), "b": (T(5), True)}
    assert temporal.set_validity_window(e, F.col("edge_id") == "a", valid_to=T(3)).where("valid_to is not null").count() == 3


def claims(spark, rows):
    return spark.createDataFrame([(i, f"c{i:02}", s, sub, st, se, co, t) for i, (s, sub, st, se, co, t) in enumerate(rows)], "seq long, claim_id string, speaker_id string, subject string, stance string, sentiment double, confidence double, event_time timestamp")


def test_consensus(spark):
    c = claims(spark, [("a", "x", "asserts", -0.7, 1.0, T(1)), ("b", "x", "asserts", -0.5, 1.0, T(2)), ("a", "x", "disputes", 0.9, 0.0, T(20)), ("b", "y", "hedges", 0.1, 0.5, T(1))])
    got = {(r.subject, r.bucket): r for r in consensus.consensus_buckets(c, 7).collect()}
    assert got["x", 0].net_sentiment == pytest.approx(-0.6) and got["x", 2].net_sentiment == pytest.approx(0.9) and got["x", 2].net_stance == -1.0
    assert {r.subject: r.direction for r in consensus.trend_direction(consensus.consensus_buckets(c, 7)).collect()} == {"x": "rising", "y": "insufficient"}
    assert [r.claim_count for r in consensus.zero_filled(consensus.consensus_buckets(c, 7)).where("subject = 'x'").orderBy("bucket").collect()] == [2, 0, 1]
    with pytest.raises(ValueError, match="positive"):
        consensus.consensus_buckets(c, 0)


def test_relations(spark):
    c = claims(spark, [("a", "x", "asserts", 0.5, 1.0, T(1)), ("b", "x", "disputes", 0.5, 1.0, T(2)), ("a", "x", "hedges", 0.5, 1.0, T(3)), ("a", "x", "disputes", 0.0, 1.0, T(4)), ("c", "x", "predicts", 0.4, 1.0, T(4)), ("c", "x", "retracts", 0.4, 1.0, T(5))])
    got = {(r.type, r.src_id, r.dst_id) for r in relations.derived_edges(c).collect()}
    assert ("disputes", "c01", "c00") in got and ("supersedes", "c05", "c04") in got
    assert not any(t == "supersedes" and s == "c03" for t, s, _ in got)  # the hedge between stands in the way
    assert ("agrees_with", "c03", "c01") in got
    assert relations.asserted_edges(c.withColumn("episode_id", F.lit("e"))).groupBy("type").count().where("count = 6").count() == 3


def test_retrieval(spark):
    lists = [spark.createDataFrame([(x, i + 1) for i, x in enumerate(s)], "id string, rank int") for s in ("ABC", "BAD")]
    assert [r.id for r in retrieval.fuse(lists).orderBy(F.desc("score"), "id").collect()] == ["A", "B", "C", "D"]
    with pytest.raises(ValueError, match="weights"):
        retrieval.fuse(lists, weights=[1.0])
    c = spark.createDataFrame([("a", "apple pie", [1.0, 0.0]), ("b", "apple apple tree", [0.0, 1.0]), ("c", "nothing", [0.0, 0.0])], "claim_id string, text string, embedding array<double>")
    ranked = retrieval.bm25_ranking(c, "apple apple").orderBy("rank").collect()
    assert [r.id for r in ranked] == ["b", "a", "c"] and ranked[2].score == 0
    near = spark.createDataFrame([("a", "c"), ("c", "a")], "id string, neighbour string")
    got = {r.claim_id: r for r in retrieval.hybrid(c, near, "pie", [1.0, 0.0], seed_k=1).collect()}
    assert got["a"].graph_rank == 1 and got["c"].graph_rank == 2 and got["b"].graph_rank is None
    with pytest.raises(ValueError, match="query"):
        retrieval.hybrid(c, near, " ", [1.0, 0.0])
    assert retrieval.provenance(c, "b").first().claim_id == "b" and retrieval.provenance(c, " PIE ").first().claim_id == "a" and retrieval.provenance(c, " ").count() == 0


def turns(spark, rows, episode="e"):
    return spark.createDataFrame([(episode, i, s, t, float(a), float(b)) for i, (s, t, a, b) in enumerate(rows)], "episode_id string, seg_idx int, speaker string, text string, t_start double, t_end double")


def test_segments(spark):
    s = turns(spark, [("A", "one two", 0, 95), ("B", "x", 95, 100), ("A", "three", 100, 100), ("C", "", 100, 99)])
    assert {r.speaker for r in segments.prune_low_talk_time(s, 0.05).collect()} == {"A", "B"}
    assert segments.prune_low_talk_time(turns(spark, [("A", "x", 0, 0)])).count() == 1
    with pytest.raises(ValueError, match="share"):
        segments.prune_low_talk_time(s, 2)
    chunk = segments.fixed_chunks(s, 3).orderBy("chunk_index").first()
    assert (chunk.text, chunk.speaker) == ("one two x three", "A")
    packed = segments.packed_chunks(turns(spark, [("A", "x" * n, 0, 1) for n in (20, 20, 200, 20)]), 90, 1).orderBy("chunk_index").collect()
    assert [(r.first_idx, r.last_idx) for r in packed] == [(0, 1), (1, 1), (2, 2), (3, 3)]
    assert [r.speaker for r in segments.merge_adjacent(turns(spark, [("A", "x", 0, 1), ("A", "y", 1, 2), ("B", "z", 2, 3)])).orderBy("turn").collect()] == ["A", "B"]


def test_words_and_crosstalk(spark):
    t = turns(spark, [("A", "", 0, 5), ("B", "", 4, 9), ("A", "", 8, 12), ("C", "", 20, 22)])
    words = spark.createDataFrame([("e", 0, 4.0, 4.4), ("e", 1, 6.0, 6.5), ("e", 2, 15.0, 15.5), ("f", 0, 0.0, 1.0)], "episode_id string, word_idx int, w_start double, w_end double")
    assert [r.speaker for r in segments.words_to_speakers(words, t).orderBy("episode_id", "word_idx").collect()] == ["A", "B", "A", "SPEAKER_00"]
    assert [(r.lo, r.hi) for r in segments.crosstalk(t).orderBy("lo").collect()] == [(4.0, 5.0), (8.0, 9.0)]
    w = spark.createDataFrame([("e", i, x, i * 1.0, i + 0.9, s) for i, (x, s) in enumerate([("a", "A"), ("b.", "A"), ("c", "A"), ("d", "B"), ("e", " ")])], "episode_id string, word_idx int, text string, t_start double, t_end double, speaker string")
    assert [(r.speaker, r.text) for r in segments.resegment(w).orderBy("seg_idx").collect()] == [("A", "a b."), ("A", "c"), ("B", "d"), ("A", "e")]
    assert [r.text for r in segments.resegment(w.where("word_idx < 3").withColumn("text", F.lit("w")), 1.5).orderBy("seg_idx").collect()] == ["w", "w", "w"]


def test_citations(spark):
    s = turns(spark, [("A", "", 0, 6), ("B", "", 6, 12)])
    who = spark.createDataFrame([("e", 0, "id-a"), ("e", 1, "id-b")], "episode_id string, seg_idx int, speaker_id string")
    c = spark.createDataFrame([(1, "e", 1.0, 3.0, "id-a"), (2, "e", 5.0, 9.0, "id-a"), (3, "e", 50.0, 60.0, "id-a"), (4, "x", 1.0, 2.0, "id-a")], "citation_id int, episode_id string, s_start double, s_end double, cited_speaker string")
    assert {r.citation_id: r.reason for r in segments.verify_citations(c, s, who).collect()} == {1: "verified", 2: "wrong_speaker", 3: "no_overlap", 4: "no_overlap"}


def test_extraction(spark):
    import json

    good = {"speaker_label": "A", "predicate": "Raises", "subject": " Apple ", "subject_type": "Company", "object": "x", "stance": "asserts", "sentiment": 7, "t_start": 0.97, "t_end": 2}
    bad = {"speaker_label": "unknown_label", "predicate": "unknown_predicate", "t_end": "span_reversed", "subject": "no_subject", "stance": "unknown_stance", "object": "no_object", "t_start": "no_times"}
    values = {"speaker_label": "Z", "predicate": "zzz", "t_end": 0.5, "subject": " ", "stance": "maybe", "object": None, "t_start": "soon"}
    raws = [json.dumps({"claims": [good, *[good | {k: values[k]} for k in bad]]}), "no json", json.dumps({"claims": [good | {"t_end": 9}]})]
    out = spark.createDataFrame([(i, r, ["A", "B"], 1.0, 5.0) for i, r in enumerate(raws)], "chunk_id int, raw string, labels array<string>, c_start double, c_end double")
    rows = extraction.parse_claims(out, ["predicts"], {"raises": "predicts"}).orderBy("chunk_id", "item_idx").collect()
    first = rows[0]
    assert (first.drop_reason, first.predicate, first.subject, first.subject_type, first.sentiment, first.confidence, first.t_start) == (None, "predicts", "Apple", "concept", 1.0, 0.5, 1.0)
    assert [r.drop_reason for r in rows[1:8]] == [*bad.values()]
    assert [r.drop_reason for r in rows[8:]] == ["not_json", "outside_chunk"]


def test_grounding(spark):
    s = turns(spark, [("A", "cats sleep all day", 0, 6), ("B", "rates will rise in spring", 6, 12)])
    c = spark.createDataFrame([(1, "e", "rates will rise", 190.0, 200.0, "S99"), (2, "e", "zzz", 190.0, 200.0, "S99")], "claim_seq int, episode_id string, object string, t_start double, t_end double, label string")
    got = {r.claim_seq: (r.t_start, r.label, r.grounded) for r in extraction.ground_claims(c, s).collect()}
    assert got == {1: (6.0, "B", True), 2: (190.0, "S99", False)}


def test_roster(spark):
    labels = spark.createDataFrame([("e", x) for x in ("Ann Lee", "ann", "lee", "Bob", "smi", "zed")], "episode_id string, label string")
    roster = spark.createDataFrame([("e", x) for x in ("Ann Lee", "Kim Lee", "Bob Smith")], "episode_id string, full_name string")
    assert {r.label: r.speaker for r in extraction.resolve_roster(labels, roster).collect()} == {"Ann Lee": "Ann Lee", "ann": "Ann Lee", "lee": "lee", "Bob": "Bob Smith", "smi": "Bob Smith", "zed": "zed"}


def test_identity(spark):
    e = spark.createDataFrame([("e1", "person", "Ann Lee", "Q1", [1.0, 0.0], ["A. Lee"], 1), ("e2", "person", "Bob", None, [0.0, 1.0], None, 2)], "canonical_id string, entity_type string, canonical_name string, qid string, embedding array<double>, aliases array<string>, insert_seq int")
    m = spark.createDataFrame([(1, "person", "x", "Q1", [0.0, 1.0]), (2, "person", "a. lee", None, [0.0, 1.0]), (3, "person", "y", None, [0.1, 1.0]), (4, "person", "z", None, [-1.0, 0.0]), (5, "person", "w", None, [1.0, 1.0]), (6, "work", "Bob", None, [0.0, 1.0])], "mention_id int, entity_type string, name string, qid string, vector array<double>")
    assert {r.mention_id: (r.canonical_id, r.tier) for r in identity.cascade(m, e).collect()} == {1: ("e1", "qid"), 2: ("e1", "exact"), 3: ("e2", "embedding"), 4: (None, "new"), 5: ("e1", "ask"), 6: (None, "new")}
    voices = spark.createDataFrame([(1, [1.0, 0.1]), (2, [1.0, 1.0]), (3, [-1.0, 0.0])], "voice_id int, vector array<double>")
    hosts = identity.gallery(spark.createDataFrame([("h1", [0.9, 0.0]), ("h1", [1.1, 0.0]), ("h2", [0.0, 1.0])], "host_id string, vector array<double>"))
    assert {r.voice_id: r.host_id for r in identity.match_voices(voices, hosts, 0.7, 0.05).collect()} == {1: "h1", 2: None, 3: None}
    forms = spark.createDataFrame([("work", "long form", [1.0, 0.0]), ("work", "form", [0.99, 0.1]), ("person", "form", [1.0, 0.0])], "entity_type string, form string, vector array<double>")
    assert {(r.entity_type, r.form): r.seed for r in identity.cluster_forms(forms).collect()} == {("work", "long form"): "long form", ("work", "form"): "long form", ("person", "form"): "form"}
    a = spark.createDataFrame([("e", "Apple", 1), ("e", "APPLE", 2), ("e", "iPhone", 3)], "canonical_id string, alias string, seq int")
    assert identity.merge_aliases(a).first().aliases == ["Apple", "iPhone"]
    c = spark.createDataFrame([("Jane", 1, "Q999", "actor"), ("Jane", 2, "Q111", "finance economist")], "name string, rank int, qid string, description string")
    who = spark.createDataFrame([(1, "Jane", "person"), (2, "Jane", "person"), (3, "Jane", "work")], "entity_id int, name string, entity_type string")
    hints = spark.createDataFrame([(1, "Finance")], "entity_id int, hint string")
    assert {r.entity_id: r.qid for r in identity.pick_candidates(who, c, hints).collect()} == {1: "Q111", 2: "Q999"}
    guests = spark.createDataFrame([("e1", "Ann Lee", False, 1), ("e2", "ann  lee", True, 2), ("e1", "Bob", False, 3)], "episode_id string, name string, from_metadata boolean, seq int")
    assert [(r.key, r.guest_id) for r in identity.recurring_guests(guests).collect()] == [("ann lee", "guest-ann-lee")]


def test_evaluation(spark):
    rows = [(1, 1)] * 20 + [(1, 0)] * 5 + [(0, 1)] * 10 + [(0, 0)] * 15
    r = evaluation.kappa(spark.createDataFrame(rows, "a int, b int")).first()
    assert (round(r.agreement, 2), round(r.kappa, 2)) == (0.70, 0.40)
    assert evaluation.kappa(spark.createDataFrame([(1, 1)] * 3, "a int, b int")).first().kappa == 1.0
    with pytest.raises(ValueError, match="most"):
        evaluation.check_weights({"a": 1, "b": 1, "c": 0.5}, "a", ["c"])
    evaluation.check_weights({"a": 2, "b": 1, "c": 0.5}, "a", ["c"])
    run = spark.createDataFrame([(2, 0.0, 1.0, 0, 0, 0, 0, 0)], "episodes int, seconds double, cost double, claims int, valid_spans int, valid_speakers int, parsed int, attempts int")
    assert tuple(evaluation.approach_score(run).first()) == (0.0, 0.5, 0.0, 0.0, 0.0, None)


def test_charts(spark):
    rows = spark.createDataFrame([(f"s{i}", i, i, float(i % 3), 0) for i in range(40)], "show_id string, rank int, seq int, episodes_per_month double, recent_count int")
    assert charts.high_velocity(rows).count() == 25 and charts.high_velocity(rows.withColumn("episodes_per_month", F.lit(0.0))).count() == 15
    with pytest.raises(ValueError, match="more"):
        charts.high_velocity(rows, 5, 2)

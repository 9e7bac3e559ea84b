import json

import pytest
from pyspark.sql import functions as F

from stanceframe.plans import load
from stanceframe.plans.surface import Surface
from stanceframe.sources import jobs, tables, transcripts
from stanceframe.streaming import ingest

PAGES = {
    "https://www.dwarkesh.com/p/one": "Menu\n(00:00:00) – Start\nAnn Lee \n00:00:00\nHello there.\n00:00:05 – Part\nMore words\nBob Ray\n00:00:09\nYes [laughs] indeed.",
    "https://lexfridman.com/two.html": "Title\nAnn Lee\n(00:00:00)\nFirst.\n\nBob Ray\n(00:00:10)\nSecond.\nA heading\n(00:00:20)\nStill second.\nAnn Lee\n(00:00:30)\nThird\nBob Ray\n(00:00:40)\nEnd",
    "https://80000hours.org/three": "Chrome\nCold open [00:00:05]\nRob Wiblin:\nHello.\nmore\nChapter [00:01:00]\nAjeya Cotra: \nThanks.",
    "https://jimruttshow.com/four": "Home\nJim\n: Hello all.\nand more\nNate\n\n: Thanks.\nSubscribe\nJunk",
    "https://singjupost.com/five": "TRANSCRIPT:\nIntro\nSAM HARRIS:\nI am here.\nThe AI Dilemma\nJOHN DOE: Well, yes.\nMore of it.\nRelated Posts\nJunk.",
    "https://www.thegreatsimplification.com/six": "PLEASE NOTE [00:00:00] Tristan Harris: There is [00:00:20] a lot 1 The Great Simplification of it. [00:00:47] Nate Hagens: Today.",
    "https://lironshapira.substack.com/seven": "Cold Open\nLiron\n\n00:15:17\nI ask.\nBen\n\n00:15:30\nI answer.\nSubscribe\nLiron\n00:16:00\nno",
    "https://centerforhumanetechnology.substack.com/eight": "Share\n0:00\nNarration.\nTristan Harris: Welcome.\nmore of it\nTim Fist: Thanks for that.\nRECOMMENDED MEDIA\nX: y",
}
EXPECTED = {
    "one": [("Ann Lee", "Hello there. 00:00:05 – Part More words", 0.0, 9.0), ("Bob Ray", "Yes indeed.", 9.0, 9.8)],
    "two": [("Ann Lee", "First.", 0.0, 10.0), ("Bob Ray", "Second. A heading", 10.0, 20.0), ("Bob Ray", "Still second.", 20.0, 30.0), ("Ann Lee", "Third", 30.0, 40.0), ("Bob Ray", "End", 40.0, 40.4)],
    "three": [("Rob Wiblin", "Hello. more", 5.0, 60.0), ("Ajeya Cotra", "Thanks.", 60.0, 60.4)],
    "four": [("Jim", "Hello all. and more", 0.0, 1.6), ("Nate", "Thanks.", 1.6, 2.0)],
    "five": [("SAM HARRIS", "I am here.", 0.0, 1.2), ("JOHN DOE", "Well, yes. More of it.", 1.2, 3.2)],
    "six": [("Tristan Harris", "There is a lot of it.", 0.0, 47.0), ("Nate Hagens", "Today.", 47.0, 47.4)],
    "seven": [("Liron", "I ask.", 917.0, 930.0), ("Ben", "I answer.", 930.0, 930.8)],
    "eight": [("Tristan Harris", "Welcome. more of it", 0.0, 1.6), ("Tim Fist", "Thanks for that.", 1.6, 2.8)],
}


def test_layouts(spark):
    pages = spark.createDataFrame([*PAGES.items(), ("https://other.org/x", "A: b"), ("https://dwarkesh.com/none", None)], "url string, text string")
    got = {}
    for r in transcripts.parse_transcripts(pages).orderBy("episode_id", "seg_idx").collect():
        got.setdefault(r.episode_id, []).append((r.speaker, r.text, round(r.t_start, 6), round(r.t_end, 6)))
    assert got == EXPECTED
    assert [r.host for r in transcripts.unknown_hosts(pages).collect()] == ["other.org"]


def test_times_never_go_back():
    rows = transcripts.timed([("A", "one two", 10.0), ("B", "three", 5.0), ("C", "[x]", 6.0), ("D", "four", None)])
    assert [(s, round(a, 6), round(b, 6)) for s, _, a, b in rows] == [("A", 10.0, 10.8), ("B", 10.8, 11.2), ("D", 11.2, 11.6)]


def test_manifest(spark, tmp_path):
    row = {"show_id": "s1", "feed_url": "u", "domains": ["a"], "known_hosts": ["Ann"], "reference_audio": {"Ann": "f"}, "deep_backfill": True}
    path = tmp_path / "m.json"
    path.write_text(json.dumps({"version": 1, "rows": [row]}))
    shows = tables.read_manifest(spark, str(path))
    assert tables.shows_of_domain(shows, "a").count() == 1 and tables.shows_of_domain(shows, "b").count() == 0
    tables.write_manifest(shows, str(tmp_path / "n.json"))
    assert tables.read_manifest(spark, str(tmp_path / "n.json")).collect() == shows.collect()
    for wrong in ([row, row], [row | {"show_id": ""}], [row | {"reference_audio": {"Bob": "f"}}]):
        path.write_text(json.dumps({"version": 1, "rows": wrong}))
        with pytest.raises(ValueError, match="ids"):
            tables.read_manifest(spark, str(path))


def test_corpus_and_service(spark, tmp_path):
    path = tmp_path / "c.json"
    path.write_text(json.dumps({"name": "n", "episodes": [{"id": "e", "show": "The Show!", "date": "2026-01-02", "host": "Ann", "guests": ["Bob", "Ann", ""]}, {"id": "f", "show": "", "date": ""}]}))
    e, f = tables.read_corpus(spark, str(path), "2026-05-05").orderBy("episode_id").collect()
    assert (e.show_id, e.published_at.isoformat(), e.known_speakers) == ("the-show", "2026-01-02T00:00:00", ["Ann", "Bob"]) and f.published_at.month == 5
    raw = json.dumps({"utterances": [{"speaker": "B", "text": "late", "start": 2000, "end": 1000}, {"speaker": "A", "text": " ", "start": 0}, {"speaker": "A", "text": "x", "start": "500", "end": "bad"}]})
    got = tables.speech_service(spark.createDataFrame([("e", raw)], "episode_id string, raw string")).orderBy("seg_idx").collect()
    assert [(r.seg_idx, r.speaker, r.t_start, r.t_end) for r in got] == [(0, "A", 0.5, 0.5), (1, "B", 2.0, 2.0)]


CLAIM = "claim_seq long, speaker_id string, predicate string, subject string, object string, stance string, sentiment double, confidence double, episode_id string, t_start double"


def test_graph_tables_are_idempotent(spark, tmp_path):
    episodes = spark.createDataFrame([("e1", "2026-01-01"), ("e2", "2026-02-01")], "episode_id string, d string").selectExpr("episode_id", "cast(d as timestamp) published_at")
    first = spark.createDataFrame([(1, "a", "p", "x", "o", "asserts", 0.5, 1.0, "e1", 1.0), (2, "a", "p", "x", "o", "asserts", 0.9, 1.0, "e1", 1.0), (3, None, "p", "x", "o", "asserts", 0.5, 1.0, "e1", 1.0)], CLAIM)
    late = spark.createDataFrame([(1, "b", "p", "x", "o", "disputes", 0.5, 1.0, "e2", 1.0), (2, "a", "p", "x", "not o", "disputes", 0.5, 1.0, "e2", 2.0)], CLAIM)
    graph = load.GraphTables(spark, str(tmp_path / "g"))
    assert graph.load(first, episodes, "2026-03-01", 1) == 1
    for n in (2, 3):  # the second time changes nothing
        assert graph.load(late, episodes, "2026-03-01", n) == 2
        kinds = {r.type: r["count"] for r in graph.edges.current().groupBy("type").count().collect()}
        assert kinds == {"asserts": 3, "about": 3, "appears_in": 3, "disputes": 1, "agrees_with": 1, "supersedes": 1}
    nodes = tables.graph_nodes(spark.createDataFrame([("a", "Ann")], "speaker_id string, name string"), spark.createDataFrame([("x", "X")], "canonical_id string, canonical_name string"), graph.claims.current())
    tables.write_graph(nodes, graph.edges.current(), str(tmp_path / "graph.json"))
    written = tables.load_graph(str(tmp_path / "graph.json"))
    assert len(written["nodes"]) == 5 and len(written["edges"]) == 12 and tables.load_graph(str(tmp_path / "none")) == {"nodes": [], "edges": []}


def test_streams(spark, tmp_path):
    items, source = tmp_path / "items", "guid string, title string"
    items.mkdir()
    for n, rows in enumerate(([("g1", "a"), ("g1", "b"), ("", "c")], [("g1", "later"), ("g2", "d")])):
        (items / f"{n}.json").write_text("\n".join(json.dumps({"guid": g, "title": t}) for g, t in rows))
        ingest.ingest_items(spark, str(items), source, str(tmp_path / "table"), str(tmp_path / "check")).awaitTermination()
    got = load.VersionedTable(spark, str(tmp_path / "table")).current()
    assert sorted((r.guid, r.title) for r in got.collect()) == [("g1", "a"), ("g2", "d")]

    claims = tmp_path / "claims"
    claims.mkdir()
    graph, episodes = load.GraphTables(spark, str(tmp_path / "g")), spark.createDataFrame([("e1", "x")], "episode_id string, d string").selectExpr("episode_id", "timestamp'2026-01-01' published_at")
    (claims / "0.json").write_text(json.dumps({"claim_seq": 1, "speaker_id": "a", "predicate": "p", "subject": "s", "object": "o", "stance": "asserts", "sentiment": 1.0, "confidence": 1.0, "episode_id": "e1", "t_start": 0.0}))
    ingest.ingest_claims(spark, str(claims), CLAIM, graph, episodes, str(tmp_path / "check2"), "2026-02-02").awaitTermination()
    assert graph.claims.current().count() == 1


def test_jobs(spark):
    assert {r.status: r.n for r in jobs.status_counts(spark.createDataFrame([("done",), ("done",)], "status string")).collect()} == {"queued": 0, "leased": 0, "done": 2, "failed": 0}


def test_surface(spark):
    rows = [(i, f"c{i}", t, v, s, "x", "asserts", 0.1 * i, 1.0, f"2026-0{i + 1}-01") for i, (t, v, s) in enumerate([("apple phone", [1.0, 0.0], "a"), ("apple", [0.9, 0.1], "b"), ("pear", [0.0, 1.0], ""), ("apple again", [1.0, 0.0], "a")])]
    c = spark.createDataFrame(rows, "seq long, claim_id string, text string, embedding array<double>, speaker_id string, subject string, stance string, sentiment double, confidence double, d string")
    c = c.withColumn("event_time", F.col("d").cast("timestamp")).withColumn("valid_from", F.col("event_time")).withColumn("valid_to", F.lit(None).cast("timestamp"))
    s = Surface(c, spark.createDataFrame([], "id string, neighbour string"), lambda q: [1.0, 0.0])
    assert [r.claim_id for r in s.search_dialogue("apple", since="2026-02-01", until="2026-03-01").collect()] == ["c1", "c2"]
    assert {r.speaker_id for r in s.who_discussed("apple").collect()} == {"a", "b"}
    buckets, trend = s.consensus_trend("x")
    assert buckets.count() == 3 and trend.first().direction == "rising"
    own, direction = s.belief_history("a", "x")
    assert own.count() == 2 and direction.first().direction == "rising"
    assert s.provenance_lookup("pear").first().claim_id == "c2"

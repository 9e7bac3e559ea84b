import json

import pytest
from pyspark.sql import functions as F

from stanceframe.plans import episodes, evaluate, load, stores
from stanceframe.sources import storage

SEG = "episode_id string, seg_idx int, speaker string, text string, t_start double, t_end double"


def test_versions_append_and_replace(spark, tmp_path):
    table = load.VersionedTable(spark, f"file://{tmp_path}/t")
    assert table.current() is None
    one = spark.createDataFrame([(1, "a")], "k int, v string")
    assert table.append(one).count() == 1 and table.append(one.withColumn("k", F.lit(2))).count() == 2
    first = [n for n in storage.list_names(spark, f"{tmp_path}/t") if n.startswith("data-")]
    table.append(one.withColumn("k", F.lit(3)))
    # an append leaves what is there as it is
    assert set(first) < set(storage.list_names(spark, f"{tmp_path}/t")) and sorted(r.k for r in table.current().collect()) == [1, 2, 3]
    table.replace(one)
    table.replace(one)
    assert table.current().count() == 1 and len([n for n in storage.list_names(spark, f"{tmp_path}/t") if n.startswith("data-")]) == 2
    with pytest.raises(FileExistsError):
        storage.write_text(spark, f"{tmp_path}/t/{storage.list_names(spark, f'{tmp_path}/t')[-1]}", "x")


def test_stores_last(spark, tmp_path):
    forms = lambda rows: spark.createDataFrame(rows, "entity_type string, form string, name string, qid string, vector array<double>, seq bigint")
    entities = stores.EntityStore(spark, str(tmp_path / "e"))
    one = {r.form: r for r in entities.resolve(forms([("organization", "acme", "Acme", None, [1.0, 0.0], 0), ("person", "ann", "Ann", "Q1", [0.0, 1.0], 1)])).collect()}
    assert one["ann"].canonical_id == "wd-Q1" and one["acme"].tier == "new"
    again = stores.EntityStore(spark, str(tmp_path / "e"))
    two = {r.form: (r.canonical_id, r.tier) for r in again.resolve(forms([("organization", "acme", "ACME", None, [0.0, 1.0], 0), ("organization", "the acme", "The Acme", None, [1.0, 0.1], 1), ("person", "annie", "Annie", "Q1", None, 2)])).collect()}
    assert two == {"acme": (one["acme"].canonical_id, "exact"), "the acme": (one["acme"].canonical_id, "embedding"), "annie": ("wd-Q1", "qid")}
    assert again.entities().count() == 2
    names = lambda rows: spark.createDataFrame(rows, "name string, qid string, seq int")
    first = {r.key: r.speaker_id for r in stores.SpeakerStore(spark, str(tmp_path / "s")).resolve(names([("Ann  Lee", None, 0), ("Bo", "Q9", 1)])).collect()}
    then = {r.key: (r.speaker_id, r.display_name) for r in stores.SpeakerStore(spark, str(tmp_path / "s")).resolve(names([("ANN LEE", "Q7", 0), ("Cy", None, 1)])).collect()}
    assert first["bo"] == "spk-wd-Q9" and then["ann lee"] == (first["ann lee"], "Ann  Lee") and then["cy"][1] == "Cy"


def test_episodes_are_loaded(spark, tmp_path):
    rows = [(e, i, s, t, i * 5.0, i * 5.0 + 5) for e in ("e1", "e2") for i, (s, t) in enumerate([("A", "I'm Ann Lee, and my guest today is Bo Fox."), ("B", "Rates will fall next year, I am sure of it."), ("A", "Rates will rise instead, as they always do.")])]
    asked = []

    def extract(prompts):
        asked.extend(r.prompt for r in prompts.collect())
        item = lambda label, obj, stance: {"speaker_label": label, "predicate": "anticipates", "subject": "Rates", "subject_type": "concept", "object": obj, "stance": stance, "sentiment": 0.5, "confidence": 0.9, "t_start": 0.0, "t_end": 5.0}
        raw = json.dumps({"claims": [item("B", "Rates will fall next year, I am sure of it.", "asserts"), item("A", "Rates will rise instead, as they always do.", "disputes"), item("Z", "x", "asserts")]})
        return prompts.withColumn("raw", F.lit(raw))

    graph = load.GraphTables(spark, str(tmp_path / "g"))
    c = episodes.Collaborators(extract, lambda f: f.withColumn("qid", F.lit(None).cast("string")).withColumn("vector", F.array(F.lit(1.0), F.lit(0.0))), stores.EntityStore(spark, str(tmp_path / "e")), stores.SpeakerStore(spark, str(tmp_path / "s")), graph)
    published = spark.sql("select * from values ('e1', timestamp'2024-01-01'), ('e2', timestamp'2024-02-01') as t(episode_id, published_at)")
    for load_seq in (1, 2):  # loading again changes nothing
        got = episodes.run_episodes(spark.createDataFrame(rows, SEG), published, c, ingested="2024-03-01", load_seq=load_seq).collect()
        assert len(got) == 4 and len({r.subject for r in got}) == 1 and len({r.speaker_id for r in got}) == 2
        assert {(r.t_start, r.object[:15]) for r in got} == {(5.0, "Rates will fall"), (10.0, "Rates will rise")}
        assert graph.claims.current().count() == 4
        kinds = {r["type"]: r["count"] for r in graph.edges.current().groupBy("type").count().collect()}
        assert kinds["asserts"] == 4 and kinds["disputes"] == 1
    assert "Speakers: A, B" in asked[0] and "rates_positive" in asked[0] and "[5.00-10.00] B: Rates will fall" in asked[0]


def test_comparison(spark):
    def broken(q):
        raise RuntimeError("no service")

    arms = {"plain": lambda q: "short", "long": lambda q: "a long answer", "broken": broken}
    rate = lambda q, a: {"accuracy": min(1.0, len(a) / 10), "clarity": 0.5}
    found = evaluate.compare(spark, [("q1", "Who?"), ("q2", "When?")], arms, rate, {"accuracy": 3.0, "clarity": 1.0}, second=rate)
    report = evaluate.report(found)
    assert [(a["arm"], a["wins"]) for a in report["arms"]] == [("long", 2), ("plain", 0), ("broken", 0)]
    assert report["agreement"]["kappa"] == 1.0 and report["answers"][0]["error"] == "RuntimeError: no service"
    text = evaluate.as_markdown(json.loads(evaluate.as_json(report)))
    assert "| long | 0.875 | 2 |" in text and "failed: RuntimeError: no service" in text and text.count("## q") == 2

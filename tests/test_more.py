import pytest
from pyspark.sql import functions as F

from stanceframe.operators import evaluation, identity, names
from stanceframe.sources import jobs
from stanceframe.sources.queue import LeaseQueue

SEG = "episode_id string, seg_idx int, speaker string, text string, t_start double, t_end double"


def test_names(spark):
    rows = [("e", 0, "A", "I'm Darian Woods, and my guest today is Cardiff Garcia.", 0.0, 5.0), ("e", 1, "B", "Thanks. welcome cardiff garcia", 5.0, 9.0), ("e", 2, "A", "Please welcome Cardiff Garcia today", 9.0, 30.0), ("f", 0, "X", "no names here", 0.0, 1.0)]
    s = spark.createDataFrame(rows, SEG)
    assert [(r.name, r.seg_idx) for r in names.introduced(s).collect()] == [("Cardiff Garcia", 0)]
    assert {r.label: r.name for r in names.label_names(s, spark.createDataFrame([("DARIAN Woods",)], "full_name string")).collect()} == {"A": "DARIAN Woods", "B": "Cardiff Garcia"}
    hosts = spark.createDataFrame([("e", "A")], "episode_id string, label string")
    assert {(r.episode_id, r.label) for r in names.guest_labels(s, hosts).collect()} == {("e", "B"), ("f", "X")}


def test_incremental_resolution(spark):
    store = spark.createDataFrame([("c1", "organization", "Apple", None, [1.0, 0.0], ["Apple Inc"], 1), ("c2", "person", "Apple", "Q5", [1.0, 0.0], None, 2)], "canonical_id string, entity_type string, canonical_name string, qid string, embedding array<double>, aliases array<string>, insert_seq int")
    forms = [("apple inc", "Apple  Inc", None, [0.0, 1.0]), ("pear", "Pear", None, [0.0, 1.0]), ("the pear", "The Pear", None, [0.05, 1.0]), ("fig", "Fig", "Q7", [-1.0, 0.0]), ("figs", "Figs", "Q7", [0.0, -1.0]), ("apple shop", "Apple shop", None, [1.0, 0.1])]
    frame = spark.createDataFrame([("organization", f, n, q, v, i) for i, (f, n, q, v) in enumerate(forms)], "entity_type string, form string, name string, qid string, vector array<double>, seq int")
    got = {r.form: (r.canonical_id, r.tier) for r in identity.resolve_incremental(frame, store).collect()}
    assert got["apple inc"] == ("c1", "exact") and got["apple shop"] == ("c1", "embedding") and got["fig"] == ("wd-Q7", "new") and got["figs"] == ("wd-Q7", "qid")
    assert got["pear"][1] == "new" and got["pear"][0].startswith("ent-") and got["the pear"] == (got["pear"][0], "embedding")


def test_lease_queue(tmp_path):
    now = [1000.0]
    for path in (":memory:", str(tmp_path / "q.db")):
        q = LeaseQueue(path, lambda: now[0])
        first = q.enqueue({"guid": "g", "x": 1})
        assert q.enqueue({"guid": "g", "x": 2}) == first and q.enqueue({"guid": "g"}, "k").key == "k"
        with pytest.raises(ValueError, match="key"):
            q.enqueue({})
        job = q.lease(300)
        assert (job.id, job.attempts, job.status) == (first.id, 1, "leased") and q.lease().key == "k" and q.lease() is None
        now[0] += 300
        assert q.lease().id == first.id and q.get(first.id).attempts == 2
        q.ack(first.id)
        q.nack(q.lease().id, requeue=False)
        assert q.stats() == {"queued": 0, "leased": 0, "done": 1, "failed": 1}
        with pytest.raises(KeyError):
            q.ack("none")


def test_blinding_and_cache(spark):
    answers = spark.createDataFrame([(q, a) for q in range(30) for a in ("x", "y", "z")], "query_id int, arm string")
    key = evaluation.blinded(answers, 3)
    assert key.select("query_id", "label").distinct().count() == 90 and key.where("label = 'answer_A'").select("arm").distinct().count() > 1
    assert evaluation.unblinded(key.select("query_id", "label"), key).join(answers, ["query_id", "arm"]).count() == 90
    cited = answers.withColumn("verified", F.col("arm") == "x")
    assert {tuple(r)[2:] for r in evaluation.verified_citations(cited).collect()} == {(1, 0), (0, 1)}
    good = {"episodes_per_minute": 1.0, "cost_per_episode": 1.0, "valid_span_rate": 1.0, "valid_attribution_rate": 1.0}
    assert evaluation.recommend(good, good) == "b" and evaluation.recommend(good, good | {"valid_span_rate": 0.0}) == "a"
    misses = jobs.cache_misses(answers, None, "arm")
    assert misses.count() == 3 and jobs.cache_misses(answers, misses.where("arm = 'x'"), "arm").count() == 2

"""Queries whose steps meet in blocks or keep only what can still win: the same results, however the blocks fall."""

import math
import random
import re

import pytest

from pyspark.sql import Window
from pyspark.sql import functions as F

from stanceframe.functions import text_udfs
from stanceframe.functions.scalars import cosine
from stanceframe.operators import extraction, identity, lexical, nearest, retrieval


def greedy(forms, threshold):
    """The clusters as defined, a form at a time."""
    seeds, out = [], {}
    for kind, form, v in sorted(forms, key=lambda r: (-len(r[1]), r[1])):
        size = math.sqrt(sum(x * x for x in v))
        best, found = threshold, None
        for name, w in (s[1:] for s in seeds if s[0] == kind):
            other = math.sqrt(sum(x * x for x in w))
            score = sum(x * y for x, y in zip(v, w, strict=True)) / (size * other) if size and other else 0.0
            if score >= best:
                best, found = score, name
        if found is None:
            seeds.append((kind, form, v))
        out[kind, form] = found or form
    return out


def test_greedy_clusters_in_rounds(spark):
    rng = random.Random(5)
    forms = [(f"type{i % 2}", "f" * rng.randint(1, 9) + str(i), [rng.choice([-1.0, 0.0, 1.0, 2.0]) for _ in range(4)]) for i in range(120)]
    frame = spark.createDataFrame(forms, "entity_type string, form string, vector array<double>").repartition(3)
    for block in (25, 1000):
        assert {(r.entity_type, r.form): r.seed for r in identity.cluster_forms(frame, 0.85, block=block).collect()} == greedy(forms, 0.85)
    with pytest.raises(Exception, match="differ in size"):
        identity.cluster_forms(frame.union(spark.createDataFrame([("type0", "odd", [1.0])], frame.schema))).collect()


def test_candidates_are_picked_once_a_name(spark):
    ranked = [(f"name {i % 2}", i, f"Q{i}", "An Economist" if i == 300 else None if i == 0 else f"somebody {i % 3}") for i in range(400)]
    c = spark.createDataFrame(ranked, "name string, rank int, qid string, description string")
    who = spark.createDataFrame([(i, f"name {i % 2}", "person") for i in range(400)] + [(400, "unknown", "person"), (401, "name 1", "work")], "entity_id int, name string, entity_type string")
    hints = spark.createDataFrame([(i, "ECONOMIST") for i in range(0, 400, 4)] + [(2, None), (6, "nobody"), (6, "body 2"), (10, None)], "entity_id int, hint string")
    picked = identity.pick_candidates(who, c, hints)
    # a description that is missing holds no hint
    assert {r.entity_id: r.qid for r in picked.collect()} == {i: "Q300" if i % 4 == 0 else "Q2" if i == 6 else f"Q{i % 2}" for i in range(400)}


def test_nearest_by_type_in_blocks(spark):
    rng = random.Random(6)
    vector = lambda: [rng.choice([-1.0, 0.0, 0.0, 1.0]) for _ in range(3)]
    e = spark.createDataFrame([(f"e{i}", f"type{i % 2}", vector(), i) for i in range(90)] + [("none", "type0", None, 90), ("odd", None, [0.0] * 3, 91)], "canonical_id string, entity_type string, embedding array<double>, insert_seq int")
    m = spark.createDataFrame([(i, f"type{i % 3}", vector()) for i in range(30)] + [(30, None, [1.0] * 3)], "mention_id int, entity_type string, vector array<double>")
    order = Window.partitionBy("mention_id").orderBy(F.desc("score"), "insert_seq")
    pairs = m.join(e.where("embedding is not null"), "entity_type").withColumn("score", cosine("vector", "embedding"))
    for k in (1, 4):
        top = lambda rows: {tuple(r) for r in rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("mention_id", "canonical_id", "rank", "score").collect()}  # noqa: B023, E731
        for block in (11, 1000):
            near = nearest.nearest_by_type(m, e, k, block)
            assert top(near) == top(pairs) and near.groupBy("mention_id").count().where(F.col("count") > k * -(-e.count() // block)).count() == 0


def test_a_mention_without_a_vector_is_new(spark):
    e = spark.createDataFrame([("e1", "person", "Ann", None, [1.0, 0.0], None, 1)], "canonical_id string, entity_type string, canonical_name string, qid string, embedding array<double>, aliases array<string>, insert_seq int")
    m = spark.createDataFrame([(1, "person", "x", None, None), (2, "person", "y", None, [1.0, 0.0])], "mention_id int, entity_type string, name string, qid string, vector array<double>")
    assert {r.mention_id: (r.canonical_id, r.tier) for r in identity.cascade(m, e).collect()} == {1: (None, "new"), 2: ("e1", "embedding")}


def test_bm25_scores_documents_where_they_are_read(spark, monkeypatch):
    words = ["apple", "tree", "the", "x1", "zed"]
    rng = random.Random(7)
    texts = [" ".join(rng.choice(words) + rng.choice(["", ".", "é", "-B"]) for _ in range(rng.randint(0, 9))) for _ in range(60)] + ["", None, "ÀPPLE apple", "the"] + ["tree Tree"] * 30
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    q = spark.createDataFrame([("a", "the Apple, the tree"), ("b", "zed zed"), ("c", "unknown"), ("d", None), ("e", "X1 b")], "query_id string, query string")
    known = {i: re.findall("[a-z0-9]+", t.lower()) for i, t in enumerate(texts) if t is not None}
    mean, expected = sum(map(len, known.values())) / len(known), {}
    for query, asked in (("a", ["the", "apple", "the", "tree"]), ("b", ["zed", "zed"]), ("e", ["x1", "b"])):
        for i, t in known.items():
            parts = [retrieval.idf(len(texts), sum(w in x for x in known.values())) * t.count(w) * 2.5 / (t.count(w) + 1.5 * (0.25 + 0.75 * len(t) / mean)) for w in asked if w in t]
            if parts:
                expected[query, i] = round(sum(parts), 9)
    for cells in (lexical.CELLS, 40):
        monkeypatch.setattr(lexical, "CELLS", cells)
        scored = retrieval.bm25(d, q, id_col="doc_id")
        assert {(r.query_id, r.id): round(r.score, 9) for r in scored.collect()} == expected
        assert "hashpartitioning" not in scored._jdf.queryExecution().toString()
        best = {}
        for r in retrieval.bm25(d, q, id_col="doc_id", top=4).collect():
            best.setdefault(r.query_id, []).append((-round(r.score, 9), r.id))
        assert {k: sorted(v)[:4] for k, v in best.items()} == {k: sorted((-s, i) for (q, i), s in expected.items() if q == k)[:4] for k in ("a", "b", "e")}


def test_hybrid_search_counts_ranks_without_a_sort_of_all(spark):
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice(["apple", "pie", "tree", "zed"]) for _ in range(rng.randint(0, 5))), [rng.choice([0.0, 1.0, 2.0]), 1.0] if i % 3 else None) for i in range(900)]
    c = spark.createDataFrame(rows, "claim_id bigint, text string, embedding array<double>")
    near = spark.createDataFrame([(i, (i * 7 + 1) % 900) for i in range(900)], "id bigint, neighbour bigint")
    lists = [retrieval.cosine_ranking(c.where("embedding is not null"), [1.0, 0.2]), retrieval.bm25_ranking(c, "pie tree")]
    seeds = retrieval.fuse(lists).orderBy(F.desc("score"), "id").limit(3)
    lists.append(retrieval.graph_ranking(seeds, near, c.select(F.col("claim_id").alias("id")), 2))
    ranks = [{r.id: r["rank"] for r in one.collect()} for one in lists]
    best = sorted(((-sum(1 / (60 + r[i]) for r in ranks if i in r), i) for i in range(900)))[:4]
    got = retrieval.hybrid(c, near, "pie tree", [1.0, 0.2], top_k=4, seed_k=3, depth=2)
    assert [(r.claim_id, round(r.score, 12), r.semantic_rank, r.lexical_rank, r.graph_rank) for r in got.collect()] == [(i, round(-s, 12), *(r.get(i) for r in ranks)) for s, i in best]
    assert "Window" not in got._jdf.queryExecution().optimizedPlan().toString()
    plain = retrieval.hybrid(c.limit(2), near, "pie", [1.0, 0.2], top_k=4, traverse=False).collect()
    assert len(plain) == 2 and all(r.graph_rank is None for r in plain)


def test_grounding_scores_only_what_can_win():
    rng = random.Random(9)
    text = lambda: "".join(rng.choice("abc é.") for _ in range(rng.choice([0, 1, 3, 8, 30, 210])))
    for _ in range(60):
        said = [text() for _ in range(6)] + ["ab" * 120, None, "é." * rng.choice([1, 150])]
        said += [(rng.choice(said) or "").upper()]
        rng.shuffle(said)
        best = text_udfs.BestMatch(said)
        for evidence in [*said, text(), "cab a"]:
            score, at = max((text_udfs.match_score_text(evidence, t), -i) for i, t in enumerate(said))
            assert best.of(evidence) == (score, -at)
    turns = [f"turn {i} of many that are much alike" for i in range(200)]
    best = text_udfs.BestMatch(turns)
    assert [best.of(t) for t in turns] == [(1.0, i) for i in range(200)] and not best.matchers
    # brackets cannot match a word: only the first text is compared
    other = text_udfs.BestMatch(["rates will rise soon", *["[]{}" * i for i in range(1, 50)]])
    assert other.of("rates will rise")[1] == 0 and len(other.matchers) == 1


def test_a_claim_of_no_episode_stays(spark):
    s = spark.createDataFrame([("e", 0, "A", "rates will rise", 0.0, 5.0), (None, 1, "B", "rates will rise", 5.0, 9.0)], "episode_id string, seg_idx int, speaker string, text string, t_start double, t_end double")
    c = spark.createDataFrame([(1, "e", "rates will rise"), (2, "f", "rates will rise"), (3, None, "rates will rise"), (4, "e", None)], "claim_seq int, episode_id string, object string").selectExpr("*", "190D AS t_start", "200D AS t_end", "'S99' AS label")
    got = {r.claim_seq: (r.t_start, r.label, r.grounded, r.score) for r in extraction.ground_claims(c, s).collect()}
    assert got == {1: (0.0, "A", True, 1.0), 2: (190.0, "S99", False, None), 3: (190.0, "S99", False, None), 4: (190.0, "S99", False, 0.0)}

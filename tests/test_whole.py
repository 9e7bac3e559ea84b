"""Queries over every row: against their SQL on tables that would show a cut, or by brute force."""

import os

import duckdb

from stanceframe.functions.text_udfs import match_score_text
from stanceframe.plans import registry

from .test_queries import SF, norm

SF2 = "/root/testdata/sf0.01"


def by_sql(sf, name):
    con = duckdb.connect()
    for table in os.listdir(sf):
        con.execute(f"CREATE VIEW {table.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{sf}/{table}{'/*.parquet' if os.path.isdir(f'{sf}/{table}') else ''}')")
    found = con.execute(registry.ORACLES[name])
    columns = [c[0] for c in found.description]
    return norm(found.fetchall(), columns)


def by_spark(spark, sf, name):
    got = registry.QUERIES[name](spark, sf)
    return norm([tuple(r) for r in got.collect()], got.columns)


def test_clean_text_keeps_the_whole_text(spark, tmp_path):
    long = "one  two [noise] (laughs) " * 40 + "the end"
    spark.createDataFrame([(1, long), (2, "short"), (3, None)], "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.text for r in registry.QUERIES["clean_text"](spark, str(tmp_path)).collect()}
    assert got == {1: "one two " * 40 + "the end", 2: "short", 3: None}
    assert by_spark(spark, SF, "clean_text") == by_sql(SF, "clean_text")


def test_greedy_clusters_hold_every_vector(spark, tmp_path):
    rows = [(i, [1.0, 0.0] if i < 510 else [0.0, 1.0], i % 2) for i in range(520)]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label bigint").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = {(r.entity_type, r.form): r.seed for r in registry.QUERIES["greedy_clusters"](spark, str(tmp_path)).collect()}
    # the longest form is first, of equals the smallest: form 100 and form 101 are the seeds of what equals them
    assert got == {(f"type{i % 2}", f"form {i}"): f"form {100 + i % 2}" if i < 510 else f"form {510 + i % 2}" for i in range(520)}


def test_orders_of_every_customer_count(spark):
    for name in ("bfs_hops", "recurring_guests"):
        assert by_spark(spark, SF2, name) == by_sql(SF2, name), name


def test_bm25_searches_every_language(spark):
    assert by_spark(spark, SF, "bm25_topk") == by_sql(SF, "bm25_topk")


def test_hybrid_search_keeps_documents_without_a_vector(spark, tmp_path):
    docs = [(0, "the thing", "en"), (1, "nothing here", "de"), (2, "the and thing of", "fr"), (3, "else", "en")]
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    near = [(0, [float(i == 2) for i in range(64)], 0), (1, [float(i == 4) for i in range(64)], 0)]
    spark.createDataFrame(near, "vec_id bigint, embedding array<float>, label bigint").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = {r.claim_id: (r.semantic_rank, r.lexical_rank) for r in registry.QUERIES["hybrid_search"](spark, str(tmp_path)).collect()}
    assert got == {0: (2, 2), 1: (1, 3), 2: (None, 1), 3: (None, 4)}


def test_every_turn_is_grounded_by_its_whole_text(spark, tmp_path):
    tail = "so the harbour freight was weighed again at noon by other hands"
    turns = [(c, t, "user", f"turn {t} " + "and then we spoke of many things " * 4 + tail * (t % 2) + str(c)) for c in range(2) for t in range(5)] + [(2, 0, "user", ""), (2, 1, "user", None), (2, 2, "system", "short")]
    spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    expected = []
    for c, _, _, text in turns:
        score, at, role, said = max((match_score_text(text, s), -t, r, s) for k, t, r, s in turns if k == c)
        moved = (role, -at * 5.0, -at * 5.0 + 4 + len(said) % 4) if score >= 0.45 else ("SPEAKER_99", 190.0, 200.0)
        expected.append((f"conv-{c}", text, *moved, score >= 0.45, round(score, 9)))
    got = registry.QUERIES["grounded_claims"](spark, str(tmp_path)).collect()
    assert len({r.claim_seq for r in got}) == len(turns)
    assert sorted(((r.episode_id, r.object, r.label, r.t_start, r.t_end, r.grounded, round(r.score, 9)) for r in got), key=repr) == sorted(expected, key=repr)


def test_words_and_turns_are_all_segments(spark, tmp_path):
    turns = [(c, t, f"role-{t}", "x" * (t % 5)) for c in range(2) for t in range(70)]
    spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    for sf in (SF, str(tmp_path)):
        assert by_spark(spark, sf, "word_to_turn_overlap") == by_sql(sf, "word_to_turn_overlap")
    assert registry.QUERIES["word_to_turn_overlap"](spark, str(tmp_path)).count() == len(turns)

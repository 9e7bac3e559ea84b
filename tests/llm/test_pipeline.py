import random
from collections import Counter, defaultdict

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from stanceframe.llm import common, rule_ensemble

from . import data
from .test_encoding import check_packing
from .test_links import roots, word_sets

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def corpus():
    rnd = random.Random(9)
    words = [f"w{i}" for i in range(500)]
    rows = []
    for i in range(160):
        good = i % 4 != 3
        text = " ".join(rnd.choices(words, k=rnd.randint(40, 90))) + "." if good else " ".join(["SPAM!!"] * rnd.randint(20, 60))
        rows.append((i, text, "en", "s", len(text)))
    for i in range(160, 200):  # exact and near copies of good ones
        base = rows[4 * (i % 7)][1].split(" ")
        if i % 2:
            base[i % 30] = rnd.choice(words)
        rows.append((i, " ".join(base), "en", "s", 1))
    rows += [(300, None, None, None, None), (301, "", "en", "s", 0), rows[0], (None, rows[1][1], "en", "s", 1)]
    labels = [(i, int(i % 4 != 3), 0) for i in range(0, 160) if i % 5]
    return rows, labels


def test_run_is_that_of_brute_force(spark, tmp_path):
    rows, labels = corpus()
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = common.read_table(spark, str(tmp_path), "documents")
    scored = rule_ensemble.score_documents(docs, common.read_table(spark, str(tmp_path), "labels")).collect()
    good = {r.doc_id for r in scored if r.predicted}
    assert {i for i in range(160) if i % 4 != 3} <= good and not {i for i in range(160) if i % 4 == 3} & good

    left = [r for r in dict.fromkeys(rows) if r[0] in good]
    best = {}
    for r in left:
        best[r[1] or ""] = max(best.get(r[1] or "", -1), -1 if r[0] is None else r[0])
    left = [r for r in left if best[r[1] or ""] == (-1 if r[0] is None else r[0])]
    sets = word_sets(left, 5)
    root = roots(list(sets), [(a, b) for a in sets for b in sets if a is not None and b is not None and a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])])
    kept = {i for i in root if root[i] == i}
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in got} == kept
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert check_packing(got, {r[0]: [*library.encode(r[1] or "", add_special_tokens=False).ids, 2] for r in left if r[0] in kept}) == 0


def test_stages_keep_columns(spark, tmp_path):
    spark.createDataFrame([(0, 1, 0), (1, 0, 0)], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for docs in (data.docs(spark), data.empty(spark)):
        for _, stage in corpus_pipeline.STAGES[1:-1]:
            assert stage(spark, docs, str(tmp_path)).columns == docs.columns
    exact = Counter((r.doc_id, r.text or "") for r in corpus_pipeline.exact(spark, data.docs(spark), "").collect())
    texts = defaultdict(int)
    for (_, t), n in exact.items():
        texts[t] += n
    assert set(texts.values()) == {1} and set(texts) == {r[1] or "" for r in data.rows()}


def test_large_ids_beside_a_null_are_dropped(spark):
    large = [2**53 + 1 + 2 * i for i in range(20)]
    docs = spark.createDataFrame([(i, "t") for i in [*large, None, 5]], "doc_id bigint, text string").coalesce(1)
    gone = spark.createDataFrame([(i, False) for i in large], "doc_id bigint, kept boolean")
    assert sorted(common.without_rows(docs, gone).collect(), key=repr) == [(5, "t"), (None, "t")]


def test_rules_as_columns_are_those_of_numpy(spark):
    import numpy as np

    rows, labels = corpus()
    docs = spark.createDataFrame(rows, SCHEMA)
    known = dict((i, y) for i, y, _ in labels)
    x = np.array([rule_ensemble.text_statistics(t or "") for i, t, *_ in rows if i in known])
    y = np.array([known[i] for i, *_ in rows if i in known], float)
    model = rule_ensemble.fit(x, y)
    assert model.rules
    score = {r[0]: r[1] for r in rule_ensemble.statistics(docs).select("doc_id", model.column()).collect()}
    for i, t, *_ in rows:
        margin = model.bias + sum(w for w, terms in model.rules if all(c.holds(np.array([rule_ensemble.text_statistics(t or "")]))[0] for c in terms))
        assert i is None or abs(score[i] - 1 / (1 + np.exp(-margin))) < 1e-9


def test_classifier_without_labels(spark):
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    got = rule_ensemble.score_documents(data.docs(spark), none).collect()
    assert len(got) == len(data.rows()) and {r.score for r in got} == {0.5}
    assert rule_ensemble.score_documents(data.empty(spark), none).count() == 0
    one = spark.createDataFrame([(0, 1, 0), (None, 0, 0), (1, None, 0)], "doc_id bigint, quality int, toxic int")
    assert all(r.score > 0.5 for r in rule_ensemble.score_documents(data.docs(spark), one).collect())

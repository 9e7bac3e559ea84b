import hashlib
from collections import defaultdict

import pyarrow as pa
import pytest

from stanceframe.llm import exact_dedup

from . import data


@pytest.mark.parametrize("keep", ["smallest", "largest"])
@pytest.mark.parametrize("memtable", [1, 1000])
def test_groups(spark, keep, memtable):
    groups = defaultdict(list)
    for r in data.rows():
        groups[r[1] or ""].append(r[0])
    got = exact_dedup.exact_groups(data.docs(spark), keep=keep, memtable_rows=memtable).collect()
    assert len(got) == len(data.rows())
    best = max if keep == "largest" else min
    expected = sorted((str(i), str(best((x for x in ids if x is not None), default=None)), len(ids), hashlib.sha256(t.encode()).hexdigest()) for t, ids in groups.items() for i in ids)
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.text_sha256) for r in got) == expected
    assert all(r.doc_id == r.keep_id for r in got if r.kept)
    assert sum(r.kept for r in got) == len(groups)


def test_empty_and_lookup(spark):
    assert exact_dedup.exact_groups(data.empty(spark)).count() == 0
    runs = exact_dedup.flush_runs(data.docs(spark).select("doc_id", "text"))
    level = exact_dedup.compact(exact_dedup.entries(runs))
    assert exact_dedup.lookup(level, [hashlib.sha256(b"one").digest()]).first().doc_id == 5


@pytest.mark.parametrize("keep", ["smallest", "largest"])
def test_any_bigint_is_an_identifier(spark, keep):
    ends = [-(2**63), 2**63 - 1]
    docs = spark.createDataFrame([(i, "same") for i in [*ends, 0, None]], "doc_id bigint, text string").repartition(3)
    got = exact_dedup.exact_groups(docs, keep=keep).collect()
    assert {(r.keep_id, r.group_size) for r in got} == {(ends[keep == "largest"], 4)} and [r.doc_id for r in got if r.kept] == [ends[keep == "largest"]]


def test_runs_merge_across_batches_of_rows(spark, monkeypatch):
    rows = [(f"{i % 7}".encode() * 32, i, 0, i, 1) for i in sorted(range(90), key=lambda i: i % 7)]
    whole = pa.table(dict(zip(["digest", "doc_id", "run", "pos", "n"], map(list, zip(*rows, strict=True)), strict=True)))
    for size in (1, 4, 90):
        got = pa.Table.from_batches(list(exact_dedup._merge(iter(whole.to_batches(max_chunksize=size))))).to_pydict()
        assert got["doc_id"] == list(range(7)) and got["n"] == [13] * 6 + [12]


def test_many_rows_of_one_task(spark):
    docs = spark.range(25_000).coalesce(1).selectExpr("id as doc_id", "concat('text ', id % 24000) as text")
    got = exact_dedup.exact_groups(docs)
    assert got.where("kept").count() == 24_000 and got.where("group_size = 2 and keep_id < 1000").count() == 2000


@pytest.mark.parametrize("keep", ["smallest", "largest"])
def test_batches_meet_the_levels_before_them(spark, tmp_path, keep):
    index = exact_dedup.MergeIndex(spark, str(tmp_path / "index"), keep=keep, fanout=2)
    best = min if keep == "smallest" else max
    earlier, seen = None, {}
    for b, ids in enumerate([range(10, 20), range(5, 15), range(0, 30, 3), [], [-(2**63), 2**63 - 1]]):
        docs = [(i, f"text {i % 4}") for i in ids]
        frame = spark.createDataFrame(docs, "doc_id bigint, text string")
        for i, t in docs:
            seen.setdefault(t, []).append(i)
        got = index.add(frame, earlier).collect()
        assert sorted((r.doc_id, r.keep_id, r.group_size) for r in got) == sorted((i, best(seen[t]), len(seen[t])) for i, t in docs), b
        # of an identifier that came before the earlier row is the one that is kept
        before = {x[0] for x in (earlier.collect() if earlier is not None else [])}
        assert sorted(r.doc_id for r in got if r.kept) == sorted({best(seen[t]) for _, t in docs} & set(ids) - before), b
        earlier = frame if earlier is None else earlier.unionByName(frame)
    assert len(index.levels()) < 5
    assert index.lookup([hashlib.sha256(b"text 1").digest()]).first().n == len(seen["text 1"])


def test_normalised(spark):
    docs = spark.createDataFrame([(1, "A"), (2, "a"), (3, "b")], "doc_id bigint, text string")
    assert {(r.doc_id, r.keep_id) for r in exact_dedup.exact_groups(docs, normalise=str.lower).collect()} == {(1, 1), (2, 1), (3, 3)}

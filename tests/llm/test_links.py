import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from stanceframe.llm import cover_tree, links, near_dedup, shingles

from . import data


def roots(nodes, edges):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def packed(keys):
    return np.array(keys, np.int64).tobytes()


def test_components(spark):
    rnd = random.Random(5)
    edges = [(rnd.randint(0, 400), rnd.randint(0, 400)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1040)] + [(7, 7)]
    got = {r.id: r.component for r in links.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == roots({x for e in edges for x in e}, edges)
    assert links.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


@pytest.mark.parametrize("held_by", [1, 2048])
def test_links_beyond_the_pivot(spark, monkeypatch, held_by):
    """In one bucket only neighbours agree: stars around the pivot alone would find one link."""
    monkeypatch.setattr(links, "HELD_BY", held_by)
    rng = np.random.default_rng(1)
    hashes = np.sort(rng.integers(0, 1 << 63, 80, dtype=np.uint64))
    sets = {i: (hashes[i : i + 10] if i != 30 else hashes[60:80]) for i in range(50)}
    bands = spark.createDataFrame([(i, packed([1, 100 + i])) for i in sets], "id bigint, bands binary")
    table = spark.createDataFrame([(i, [int(x) for x in s]) for i, s in sets.items()], "id bigint, payload array<bigint>")
    both = F.size(F.array_intersect("x", "y"))
    agree = lambda pairs: pairs.where(100 * both >= 80 * (F.size("x") + F.size("y") - both))
    split = lambda c: [np.array(x, np.uint64) for x in c.to_pylist()]
    got = {r.id: r.component for r in links.link_components(bands, lambda ids: table.join(ids, "id"), agree, split, 80, n_keys=100).collect()}
    assert {i: got.get(i, i) for i in sets} == {i: 0 if i < 30 else 30 if i == 30 else 31 for i in sets}


def test_shared_buckets(spark):
    """Packed entries say the same as a group by key, whatever the identifiers and the ranges."""
    rnd = random.Random(2)
    for ids in ([*range(300)], [rnd.randint(-(2**63), 2**63 - 1) for _ in range(300)]):
        rows = [(i, [rnd.choice([-5, 7, rnd.randint(-(2**63), 2**63 - 1)]), rnd.randint(0, 50) << 56]) for i in ids]
        want = {}
        for i, keys in rows:
            for k in keys:
                want.setdefault(k, []).append(i)
        frame = spark.createDataFrame([(i, packed(k)) for i, k in rows], "id bigint, bands binary").repartition(5)
        for n_keys in (1, links.RANGE_KEYS * 9):
            got = links.shared_buckets(frame, n_keys).collect()
            assert {r.key: (r.pivot, r.n) for r in got} == {k: (min(v), len(v)) for k, v in want.items() if len(v) > 1}


def test_order_of_words():
    rng = np.random.default_rng(0)
    for x in (rng.integers(0, 1 << 63, 5000, dtype=np.uint64), rng.integers(0, 3000, 5000, dtype=np.uint64), rng.integers(0, 9, 5000, dtype=np.uint64) << np.uint64(40), np.zeros(0, np.uint64), np.full(3, 2**64 - 1, np.uint64)):
        order, heads = links._distinct(x)
        assert (order == np.argsort(x, kind="stable")).all() and (heads == np.unique(np.sort(x), return_index=True)[1]).all()


def test_equal_nodes_take_the_component_of_their_first(spark):
    sets = {1: [1, 2, 3, 4, 5], 2: [1, 2, 3, 4, 5], 3: [1, 2, 3, 4, 5, 6], 4: [9], 5: [9]}
    bands = spark.createDataFrame([(i, packed([10 if i < 4 else 11])) for i in sets], "id bigint, bands binary")
    table = spark.createDataFrame([*sets.items()], "id bigint, payload array<bigint>")
    equal = spark.createDataFrame([(2, 1), (5, 4)], "id bigint, rep bigint")
    both = F.size(F.array_intersect("x", "y"))
    agree = lambda pairs: pairs.where(100 * both >= 80 * (F.size("x") + F.size("y") - both))
    split = lambda c: [np.array(x, np.uint64) for x in c.to_pylist()]
    got = links.link_components(bands, lambda ids: table.join(ids, "id"), agree, split, 80, n_keys=5, equal=lambda ids: equal.join(ids, "id", "left_semi"))
    assert {r.id: r.component for r in got.collect()} == {1: 1, 2: 1, 3: 1, 5: 4}


@pytest.mark.parametrize("held_by", [2, 2048])
def test_proposed_pairs_lose_no_link(spark, monkeypatch, held_by):
    """Families of sets, each its own component: every pair that is similar enough is proposed, and once."""
    monkeypatch.setattr(links, "HELD_BY", held_by)
    rng = np.random.default_rng(9)
    sets = {}
    for family in range(6):
        base = rng.integers(0, 1 << 62, 40)
        for _ in range(12):
            sets[len(sets)] = np.unique(np.r_[rng.permutation(base)[: rng.integers(33, 41)], rng.integers(0, 1 << 62, rng.integers(0, 4))])
    rows = [(i, i, i % 3 > 0, [int(v) for v in s]) for i, s in sets.items()]
    split = lambda c: [np.array(x, np.uint64) for x in c.to_pylist()]
    frame = spark.createDataFrame(rows, "id bigint, component bigint, stray boolean, payload array<bigint>").repartition(4)
    got = [(r.a, r.b) for r in links._prefix_pairs(frame, split, 80).collect()]
    want = {(a, b) for a in sets for b in sets if a < b and (a % 3 or b % 3) and 100 * len(np.intersect1d(sets[a], sets[b])) >= 80 * len(np.union1d(sets[a], sets[b]))}
    assert len(got) == len(set(got)) and len(want) > 20
    assert want <= set(got)


def test_proposed_pairs_in_the_order_of_words(spark):
    """The first common shingle bounds what two sets can share: both ends must order words beyond 2^63 alike."""
    rng = np.random.default_rng(3)
    common = np.r_[rng.integers(0, 1 << 62, 2, dtype=np.uint64), rng.integers(1 << 63, 1 << 64, 34, dtype=np.uint64)]
    rows = [(i, i, True, np.r_[common, rng.integers(0, 1 << 64, 4, dtype=np.uint64)].view(np.int64).tolist()) for i in range(2)]
    frame = spark.createDataFrame(rows, "id bigint, component bigint, stray boolean, payload array<bigint>")
    split = lambda c: [np.array(x, np.int64).view(np.uint64) for x in c.to_pylist()]
    assert [(r.a, r.b) for r in links._prefix_pairs(frame, split, 80).collect()] == [(0, 1)]


@pytest.mark.parametrize("bits", [64, 512])
def test_sketched_pairs_lose_no_link(spark, monkeypatch, bits):
    """Families of sets in two buckets, repeated: every pair that is similar enough stays, once, and most strangers go."""
    monkeypatch.setattr(links, "SKETCH_BITS", bits)
    rng = np.random.default_rng(9)
    sets = {}
    for _ in range(6):
        base = rng.integers(0, 1 << 64, 40, dtype=np.uint64)
        for _ in range(12):
            sets[len(sets)] = np.unique(np.r_[rng.permutation(base)[: rng.integers(33, 41)], rng.integers(0, 1 << 64, rng.integers(0, 4), dtype=np.uint64)])
    payload = spark.createDataFrame([(i, s.view(np.int64).tolist()) for i, s in sets.items()], "id bigint, payload array<bigint>")
    members = [(k, i, i // 2) for i in sets for k in (i < 36, 2 + (i < 36), 9)]
    split = lambda c: [np.array(x, np.int64).view(np.uint64) for x in c.to_pylist()]
    got = [(r.a, r.b) for r in links._sketched_pairs(spark.createDataFrame([(int(k), i, c) for k, i, c in members], "key bigint, id bigint, component bigint"), payload, split, 80).collect()]
    want = {(a, b) for a in sets for b in sets if a < b and a // 2 != b // 2 and 100 * len(np.intersect1d(sets[a], sets[b])) >= 80 * len(np.union1d(sets[a], sets[b]))}
    assert len(got) == len(set(got)) and len(want) > 20 and want <= set(got)
    assert len(got) < (800 if bits == 64 else 400)


@pytest.mark.parametrize("paired", [1, 1024])
def test_small_buckets_need_no_prefixes(spark, monkeypatch, paired):
    """Only neighbours agree: buckets of few members meet by sketches, larger ones as before, with the same components."""
    monkeypatch.setattr(links, "PAIRED", paired)
    called, old = [], links._prefix_pairs
    monkeypatch.setattr(links, "_prefix_pairs", lambda *a: called.append(1) or old(*a))
    hashes = np.sort(np.random.default_rng(1).integers(0, 1 << 63, 80, dtype=np.uint64))
    sets = {i: (hashes[i : i + 10] if i != 30 else hashes[60:80]) for i in range(50)}
    bands = spark.createDataFrame([(i, packed([1, 100 + i])) for i in sets], "id bigint, bands binary")
    table = spark.createDataFrame([(i, [int(x) for x in s]) for i, s in sets.items()], "id bigint, payload array<bigint>")
    both = F.size(F.array_intersect("x", "y"))
    agree = lambda pairs: pairs.where(100 * both >= 80 * (F.size("x") + F.size("y") - both))
    split = lambda c: [np.array(x, np.uint64) for x in c.to_pylist()]
    got = {r.id: r.component for r in links.link_components(bands, lambda ids: table.join(ids, "id"), agree, split, 80, n_keys=100).collect()}
    assert {i: got.get(i, i) for i in sets} == {i: 0 if i < 30 else 30 if i == 30 else 31 for i in sets}
    assert bool(called) == (paired == 1)


def word_sets(rows, width):
    out = {}
    for i, text, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        out[i] = frozenset([tuple(w[k : k + width]) for k in range(len(w) - width + 1)] or ([tuple(w)] if w else []))
    return out


def test_alike_members_of_a_small_bucket_meet_along_a_forest(spark):
    """Sixty sets alike and a pivot unlike them: the pairs that are looked at grow with the members, not with their square."""
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    sets = {i: np.unique(np.delete(base, i - 1)) for i in range(1, 61)} | {0: rng.integers(0, 1 << 63, 59, dtype=np.uint64)}
    bands = spark.createDataFrame([(i, packed([1])) for i in sets], "id bigint, bands binary")
    table = spark.createDataFrame([(i, [int(x) for x in s]) for i, s in sets.items()], "id bigint, payload array<bigint>")
    looked, both = [], F.size(F.array_intersect("x", "y"))
    agree = lambda pairs: looked.append(pairs.count()) or pairs.where(100 * both >= 80 * (F.size("x") + F.size("y") - both))
    split = lambda c: [np.array(x, np.uint64) for x in c.to_pylist()]
    got = {r.id: r.component for r in links.link_components(bands, lambda ids: table.join(ids, "id"), agree, split, 80, n_keys=61).collect()}
    assert {i: got.get(i, i) for i in sets} == {i: min(i, 1) for i in sets}
    assert sum(looked) <= 3 * len(sets)


def test_sketches_of_large_sets_tell_strangers_apart(spark):
    """Sets of thousands of shingles, of which two in three are common, are no candidates; those that are alike stay."""
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    own = lambda k, n: np.r_[base[: 3000 - n], rng.integers(0, 1 << 63, n, dtype=np.uint64)]
    sets = {0: base, 1: own(1, 100), **{k: own(k, 1000) for k in range(2, 8)}, 8: base[:2600], 9: base[:2040]}
    payload = spark.createDataFrame([(i, [int(x) for x in s]) for i, s in sets.items()], "id bigint, payload array<bigint>")
    members = spark.createDataFrame([(1, i, i) for i in sets], "key bigint, id bigint, component bigint")
    split = lambda c: [np.array(x, np.uint64) for x in c.to_pylist()]
    got = {(r.a, r.b) for r in links._sketched_pairs(members, payload, split, 80).collect()}
    want = {(a, b) for a in sets for b in sets if a < b and 100 * len(np.intersect1d(sets[a], sets[b])) >= 80 * len(np.union1d(sets[a], sets[b]))}
    assert len(want) > 2 and want <= got and len(got) <= len(want) + 3


@pytest.mark.parametrize("n, m", [(1, 0), (40, 30), (40, 400)])
def test_forest(n, m):
    """As many edges as it takes, over the same components, and the lightest ones."""
    rng = np.random.default_rng(n + m)
    u, v, w = rng.integers(0, n, m), rng.integers(0, n, m), rng.integers(0, 5, m)
    taken = links._forest(u, v, w)
    want = roots(range(n), zip(u.tolist(), v.tolist(), strict=True))
    assert roots(range(n), zip(u[taken].tolist(), v[taken].tolist(), strict=True)) == want
    assert len(taken) == n - len(set(want.values()))
    weight, tree = 0, {i: i for i in range(n)}
    for e in np.argsort(w, kind="stable").tolist():  # Kruskal
        if tree[int(u[e])] != tree[int(v[e])]:
            weight, gone, into = weight + int(w[e]), tree[int(u[e])], tree[int(v[e])]
            tree = {i: into if r == gone else r for i, r in tree.items()}
    assert int(w[taken].sum()) == weight


def test_sketches_take_one_python_process_a_task(spark, monkeypatch):
    """A filter in a Python step of its own would double the workers that each executor holds from then on."""
    plans, made = [], links._sketched_pairs
    monkeypatch.setattr(links, "_sketched_pairs", lambda *args, **more: plans.append(made(*args, **more)) or plans[-1])
    sets = {i: [*range(i, i + 10)] for i in range(20)}
    bands = spark.createDataFrame([(i, packed([1])) for i in sets], "id bigint, bands binary")
    table = spark.createDataFrame([*sets.items()], "id bigint, payload array<bigint>")
    both = F.size(F.array_intersect("x", "y"))
    agree = lambda pairs: pairs.where(100 * both >= 80 * (F.size("x") + F.size("y") - both))
    split = lambda c: [np.array(x, np.uint64) for x in c.to_pylist()]
    got = links.link_components(bands, lambda ids: table.join(ids, "id"), agree, split, 80, n_keys=20).collect()
    assert {r.id: r.component for r in got} == dict.fromkeys(sets, 0)
    (plan,) = (p._jdf.queryExecution().sparkPlan().toString() for p in plans)
    assert plan.count("MapInArrow") == 1 and "ArrowEvalPython" not in plan


@pytest.mark.parametrize("width", [1, 4, 5])
def test_shingles(width):
    texts = [r[1] or "" for r in data.rows()]
    expected = word_sets(list(enumerate(texts)), width)
    got = shingles.word_shingles(texts, width)
    assert [len(g) for g in got] == [len(expected[i]) for i in range(len(texts))]
    for i in range(len(texts)):
        for j in range(i):
            assert len(np.intersect1d(got[i], got[j])) == len(expected[i] & expected[j])


def near_rows():
    rnd = random.Random(2)
    words = [f"w{i}" for i in range(400)]
    base = [rnd.choices(words, k=60) for _ in range(4)]
    rows = []
    for i in range(150):
        text = list(base[i % 4])
        for _ in range(rnd.randint(0, 6)):
            text[rnd.randrange(len(text))] = rnd.choice(words)
        rows.append((i, " ".join(text)))
    return rows + [(1000 + i, t) for i, t in rows[:5]] + [(2000, None), (2001, ""), (2002, "Few Words"), (2003, "few  words"), (2004, "few words more")]


def test_near_groups_are_those_of_brute_force(spark):
    rows = near_rows()
    sets = word_sets(rows, 4)
    ids = list(sets)
    edges = [(a, b) for a in ids for b in ids if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    expected = roots(ids, edges)
    got = near_dedup.near_groups(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4), width=4).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == {i: (len(sets[i]), expected[i], expected[i] == i) for i in ids}
    assert len(got) == len(rows)


def test_near_groups_of_odd_rows(spark):
    got = near_dedup.near_groups(data.docs(spark)).collect()
    assert len(got) == len(data.rows())
    assert [(r.component_id, r.kept) for r in got if r.doc_id is None] == [(None, True)]
    assert {r.component_id for r in got if r.doc_id in (0, 4, 10)} == {0}
    assert near_dedup.near_groups(data.empty(spark)).count() == 0
    twice = spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e f"), (2, "g h i j k l"), (3, "g h i j k l")], "doc_id bigint, text string")
    assert {r.component_id for r in near_dedup.near_groups(twice).collect()} == {1}


def brute(rows, cosine):
    n, comp, edges = {}, {}, []
    for k, (i, v, label) in enumerate(rows):
        n[k] = 0
        for j, (_, w, other) in enumerate(rows):
            if j == k or label is None or label != other or v is None or w is None or len(v) != len(w) or None in v or None in w:
                continue
            a, b = np.array(v, float), np.array(w, float)
            if np.isfinite(a).all() and np.isfinite(b).all() and a.any() and b.any() and a @ b / np.sqrt((a @ a) * (b @ b)) >= cosine:
                n[k] += 1
                edges.append((k, j))
    root = roots(range(len(rows)), edges)
    for r in set(root.values()):
        members = [k for k in root if root[k] == r]
        least = min((rows[k][0] for k in members if rows[k][0] is not None), default=None)
        comp |= dict.fromkeys(members, least)
    return sorted((str(rows[k][0]), n[k], str(comp[k])) for k in root)


@pytest.mark.parametrize("block", [16, 2048])
def test_cosine_links_are_those_of_brute_force(spark, block):
    rng = np.random.default_rng(4)
    centre = rng.normal(size=(3, 8))
    rows = [(i, (centre[i % 3] + rng.normal(size=8) * rng.choice([0.0, 0.05, 0.15, 0.8])).tolist(), i % 2) for i in range(220)]
    rows += [(300 + i, rows[i][1], rows[i][2]) for i in range(9)] + [(400, None, 1), (401, [0.0] * 8, 1), (402, [float("nan")] * 8, 1), (403, [1.0, None] * 4, 1), (404, rows[0][1], None)]
    rows += [(405, [1.0, 2.0], 1), (406, [2.0, 4.0], 1), (None, rows[0][1], rows[0][2]), (407, [], 1), (5, rows[5][1], rows[5][2]), (408, [1e200] * 8, 0), (409, [1e-200] * 8, 0)]
    rows = [r for r in rows if block == 16 or r[0] not in (408, 409)]
    got = cover_tree.cosine_links(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int").repartition(3), block=block).collect()
    with np.errstate(over="ignore", under="ignore", invalid="ignore", divide="ignore"):
        expected = brute([r for r in rows if r[0] not in (408, 409)], 0.98)
    assert sorted((str(r.vec_id), r.n_links, str(r.component_id)) for r in got if r.vec_id not in (408, 409)) == expected
    assert all(r.n_links == 1 for r in got if r.vec_id in (408, 409))
    assert all(r.kept == (r.vec_id == r.component_id) for r in got if r.vec_id is not None)


def test_cosine_links_of_nothing(spark):
    assert cover_tree.cosine_links(spark.createDataFrame([], "vec_id bigint, embedding array<float>, label int")).count() == 0


def clustered(rng, clusters, each, width=16, spread=0.03):
    centres = rng.normal(size=(clusters, width))
    x = np.repeat(centres / np.linalg.norm(centres, axis=1, keepdims=True), each, axis=0)
    return x + rng.normal(size=x.shape) * spread / np.sqrt(width)


@pytest.mark.parametrize("n_left", [0, 200])
def test_traversal_prunes_and_loses_no_link(n_left):
    """Nested levels over clusters: node pairs are dropped by their radii, and the links are those of all pairs."""
    raw = clustered(np.random.default_rng(6), 30, 20)
    raw = np.concatenate([raw[np.random.default_rng(1).permutation(600)], np.random.default_rng(7).normal(size=(100, 16))])
    tree, depth = cover_tree.cover_tree(cover_tree.unit(raw)), 0
    while tree.kids:
        assert all(k.radius <= tree.radius + 1e-6 for k in tree.kids)
        tree, depth = max(tree.kids, key=lambda k: len(k.points)), depth + 1
    assert depth >= 2
    found = cover_tree.Links(np.ones(len(raw), np.int64))
    pruned = cover_tree.dual_traversal(raw, n_left, 0.98, found, n_left == 0)
    g = cover_tree.unit(raw) @ cover_tree.unit(raw).T >= 0.98
    np.fill_diagonal(g, False)
    if n_left:
        g[:n_left, :n_left] = g[n_left:, n_left:] = False
    assert pruned > 1000 and (found.count == g.sum(axis=1)).all()
    assert {i: found.root(i) for i in range(len(raw))} == roots(range(len(raw)), zip(*np.nonzero(g), strict=True))


def test_clusters_stay_in_their_cells(spark, monkeypatch):
    """Vectors of clusters are not sent to every block of their label."""
    sent, whole = [], cover_tree.materialize

    def seen(frame, label, **options):
        out = whole(frame, label, **options)
        if label == "block-pairs":
            sent.append(out.count())
        return out

    monkeypatch.setattr(cover_tree, "materialize", seen)
    raw = clustered(np.random.default_rng(3), 40, 30)
    rows = [(i, v.tolist(), 0) for i, v in enumerate(raw)]
    got = cover_tree.cosine_links(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int"), block=60).collect()
    g = cover_tree.unit(raw) @ cover_tree.unit(raw).T >= 0.98
    assert {r.vec_id: r.n_links for r in got} == dict(enumerate((g.sum(axis=1) - 1).tolist()))
    assert sent[0] < 100  # of about 40 cells, which have 820 pairs
